"""Sources and sinks of manifests, transcripts and audio headers."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from speechtab import schemas
from speechtab.functions import text as X
from speechtab.sources import wav


def read_manifest(spark: SparkSession, path: str, kind: str = "cuts", partitions: int | None = None) -> DataFrame:
    """JSON lines (gzip or not) under the declared schema, with a ``corrupt`` column for lines that are no JSON.

    Gzip files do not split: give ``partitions`` to deal the rows out by id after reading.
    """
    schema = T.StructType([*schemas.KINDS[kind].fields, T.StructField("corrupt", T.StringType())])
    df = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "corrupt").json(path)
    return df.repartition(partitions, "id") if partitions else df


def write_manifest(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.drop("corrupt").write.mode(mode).option("compression", "gzip").json(path)


def read_shards(spark: SparkSession, root: str, prefix: str = "ssl_", suffix: str = "", kind: str = "cuts") -> DataFrame:
    """All shards ``<root>/<pool>/*_cuts_<pool without its first four characters><suffix>.<digits>.jsonl.gz``.

    Adds ``pool`` and ``shard``; files of other label versions (suffixes) are not read.
    """
    df = read_manifest(spark, f"{root}/{prefix}*/*_cuts_*{suffix}.*.jsonl.gz", kind)
    file = F.col("_metadata.file_path")
    df = df.withColumn("pool", F.regexp_extract(file, r"([^/]+)/[^/]+$", 1)).withColumn("shard", F.regexp_extract(file, r"\.(\d+)\.jsonl\.gz$", 1))
    name = F.concat(F.lit("_cuts_"), F.substr("pool", F.lit(5)), F.lit(suffix), F.lit("."), "shard", F.lit(".jsonl.gz"))
    return df.where((F.col("shard") != "") & F.endswith(file, name))


def shuffle_shards(df: DataFrame, seed: int = 142, key: str = "shard") -> DataFrame:
    """``df`` with ``shard_order``: places of its distinct shards in a seeded order that any rerun repeats."""
    order = W.orderBy(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))).cast("binary")), key)
    return df.join(df.select(key).distinct().withColumn("shard_order", F.row_number().over(order).cast("long")), key)


def split_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(utt_id, text) of transcript lines ``id text...``, and the quarantine: lines without a text."""
    parsed = lines.withColumn("utt_id", F.regexp_extract("value", r"^\s*(\S+)\s+\S", 1))
    good = parsed.where("utt_id <> ''").withColumn("text", F.regexp_extract("value", r"(?s)^\s*\S+\s+(.*)$", 1))
    return good.drop("value"), parsed.where("utt_id = ''").drop("utt_id")


def read_transcripts(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Lines of all ``*.trans.txt`` below ``root`` with the directory they lie in."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.trans.txt").text(root)
    return split_lines(raw.withColumn("dir", F.regexp_extract("_metadata.file_path", r"^(.*)/[^/]*$", 1)))


def audio_index(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """recordings (id, path, sampling_rate, channels, num_samples, duration) of all ``*.wav`` below root, and the others (path, error).

    Headers are read by seeking from chunk to chunk, however far back the samples lie. No file gives no rows.
    """
    found = wav.register(spark).read.format("wav").load(root)
    good = found.where("error is null")
    good = good.select(X.derive_id(F.col("path")).alias("id"), "path", "sampling_rate", "channels", "num_samples", (F.col("num_samples") / F.col("sampling_rate")).alias("duration"))
    return good, found.where("error is not null").select("path", "error")


def write_audio(df: DataFrame, path: str, mode: str = "append") -> None:
    """A WAV file below ``path`` for each row (id, sampling_rate, channels, bits, data, perhaps comment)."""
    wav.register(df.sparkSession)
    df.write.format("wav").mode(mode).save(path)


def indexed(df: DataFrame, order: list, name: str = "idx") -> DataFrame:
    """``df`` with its place (from 0) in a total order, without a window over all rows.

    Range-sorted partitions are counted; each row's place is its place within the partition plus the
    counts before. Only the counts (one row a partition) meet in one task.
    """
    from speechtab.session import bounded, checkpointed

    part = checkpointed(df.orderBy(*order).withColumn("__part", F.spark_partition_id()))
    upto = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    starts = part.groupBy("__part").agg(F.count("*").alias("__n")).withColumn("__start", F.coalesce(F.sum("__n").over(upto), F.lit(0))).drop("__n")
    within = F.row_number().over(W.partitionBy("__part").orderBy(*order)) - 1
    return part.withColumn("__at", within).join(bounded(starts), "__part").withColumn(name, (F.col("__start") + F.col("__at")).cast("long")).drop("__part", "__at", "__start")


def split_manifest(df: DataFrame, per_shard: int = 200_000, order: list | None = None) -> DataFrame:
    """``df`` with ``shard``: eight digits, consecutive rows of the order, ``per_shard`` to each."""
    rows = indexed(df, order or ["id"])
    return rows.withColumn("shard", F.lpad(F.floor(F.col("idx") / per_shard).cast("string"), 8, "0"))


def write_shards(df: DataFrame, path: str) -> None:
    df.repartition("shard").write.partitionBy("shard").option("compression", "gzip").json(path)


def cuts_to_text(cuts: DataFrame) -> DataFrame:
    """One line per cut: the text of its first supervision."""
    return cuts.select(F.get("supervisions", F.lit(0))["text"].alias("value"))


def transcript_corpus(lines: DataFrame, col: str = "value") -> DataFrame:
    return lines.withColumn(col, X.after_first_field(F.col(col)))


def prepared(spark: SparkSession, path: str) -> bool:
    """Whether a writer has finished ``path`` (its success marker is there)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_SUCCESS")
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def write_if_absent(df: DataFrame, path: str, form: str = "parquet") -> bool:
    """Writes unless already prepared; returns whether it wrote. What an unfinished writer left is replaced."""
    if prepared(df.sparkSession, path):
        return False
    df.write.mode("overwrite").format(form).save(path)
    return True


def write_symbols(df: DataFrame, path: str) -> None:
    """``symbol id`` lines by id."""
    df.orderBy("id").select(F.concat_ws(" ", "symbol", F.col("id").cast("string"))).write.text(path)


def write_lexicon(lexicon: DataFrame, path: str) -> None:
    lexicon.orderBy("ord").select(F.concat_ws(" ", "word", F.array_join("tokens", " "))).write.text(path)


def error_report(aligned: DataFrame) -> DataFrame:
    """setting, section, place, value: the lines of each setting's error report from ``hyps.align``'s rows.

    Section 0 is the head, 1 each cut's aligned pairs by cut id (``(ref->hyp)`` where they differ, ``*`` for none), 2 substitutions, 3 deletions and 4 insertions by falling count, 5 each
    word's counts by falling errors. ``place`` orders a section's lines.
    """
    from speechtab.operators import hyps

    pair = F.arrays_zip(F.col("ref_words").alias("r"), F.col("hyp_words").alias("h"))
    shown = lambda p: F.when(p["r"].eqNullSafe(p["h"]), p["r"]).otherwise(F.concat(F.lit("("), F.coalesce(p["r"], F.lit("*")), F.lit("->"), F.coalesce(p["h"], F.lit("*")), F.lit(")")))
    line = lambda rows, section, place, value: rows.select("setting", F.lit(section).alias("section"), place.alias("place"), value.alias("value"))
    total = hyps.wer(aligned).select("setting", F.round("wer", 4).cast("string").alias("wer"))
    kinds = aligned.groupBy("setting").agg(*[F.sum(c).alias(c) for c in ("inserted", "deleted", "substituted", "n_ref", "correct")]).join(total, "setting")
    first = F.concat(F.lit("%WER = "), F.coalesce("wer", F.lit("-")))
    second = F.format_string("Errors: %d insertions, %d deletions, %d substitutions, over %d reference words (%d correct)", "inserted", "deleted", "substituted", "n_ref", "correct")
    heads = line(kinds, 0, F.lit("0"), first).unionByName(line(kinds, 0, F.lit("1"), second))
    cuts = line(aligned, 1, F.coalesce("cut_id", F.lit("")), F.concat(F.coalesce("cut_id", F.lit("")), F.lit(":\t"), F.array_join(F.transform(pair, shown), " ")))
    errors = aligned.select("setting", F.explode(pair).alias("p")).where(~F.col("p.r").eqNullSafe(F.col("p.h"))).groupBy("setting", "p").agg(F.count("*").alias("n"))
    falling = lambda n, text: F.concat(F.lpad((F.lit(10**15) - n).cast("string"), 16, "0"), F.lit(" "), text)
    kind = F.when(F.col("p.h").isNull(), 3).when(F.col("p.r").isNull(), 4).otherwise(2)
    text = F.when(kind == 2, F.concat_ws(" -> ", "p.r", "p.h")).otherwise(F.coalesce("p.r", "p.h"))
    listed = errors.select("setting", kind.alias("section"), falling(F.col("n"), text).alias("place"), F.concat(F.col("n").cast("string"), F.lit(" "), text).alias("value"))
    bad = F.col("substituted") + F.col("deleted") + F.col("inserted")
    words = hyps.word_errors(aligned)
    words = line(words, 5, falling(bad, F.col("word")), F.concat_ws("\t", "word", *[F.col(c).cast("string") for c in ("correct", "substituted", "deleted", "inserted")]))
    return heads.unionByName(cuts).unionByName(listed).unionByName(words)


def write_results(results: DataFrame, path: str) -> None:
    """For each setting its recogs (ref and hyp lines by cut id) and error report, and a summary: ``settings<TAB>WER``, then the settings from best to worst.

    ``recogs`` and ``errs`` have a folder per setting (``setting=...``); their lines are range-sorted over as many files as they need, and file names keep the order.
    """
    from speechtab.operators import hyps
    from speechtab.session import checkpointed

    lines = F.explode(F.array(F.concat_ws("", "cut_id", F.lit(":\tref="), F.to_json("ref")), F.concat_ws("", "cut_id", F.lit(":\thyp="), F.to_json("hyp"))))
    results.select("setting", "cut_id", lines.alias("value")).orderBy("setting", "cut_id", F.desc("value")).select("setting", "value").write.partitionBy("setting").text(f"{path}/recogs")
    aligned = checkpointed(hyps.align(results))
    error_report(aligned).orderBy("setting", "section", "place").select("setting", "value").write.partitionBy("setting").text(f"{path}/errs")
    best = hyps.wer(aligned).select(F.lit(1).alias("k"), "wer", "setting", F.concat_ws("\t", "setting", F.coalesce(F.round("wer", 4).cast("string"), F.lit("-"))).alias("value"))
    head = results.sparkSession.createDataFrame([(0, None, None, "settings\tWER")], best.schema)
    head.unionByName(best).coalesce(1).sortWithinPartitions("k", "wer", "setting").select("value").write.text(f"{path}/wer-summary")  # a row per setting


def write_named_shards(df: DataFrame, root: str, pool: str = "pool", shard: str = "shard", suffix: str = "") -> None:
    """``<root>/<pool>/x_cuts_<pool without its first four characters><suffix>.<shard>.jsonl.gz`` files that ``read_shards`` finds.

    Rows are written by tasks, a shard to each; the driver then only renames the files.
    """
    spark = df.sparkSession
    tmp = f"{root.rstrip('/')}/_writing"
    df.repartition(pool, shard).write.partitionBy(pool, shard).option("compression", "gzip").json(tmp)
    jpath = spark._jvm.org.apache.hadoop.fs.Path
    store = jpath(root).getFileSystem(spark._jsc.hadoopConfiguration())
    for status in store.globStatus(jpath(f"{tmp}/{pool}=*/{shard}=*/part-*")):
        source = status.getPath()
        number, name = (x.getName().partition("=")[2] for x in (source.getParent(), source.getParent().getParent()))
        store.mkdirs(jpath(f"{root}/{name}"))
        store.rename(source, jpath(f"{root}/{name}/x_cuts_{name[4:]}{suffix}.{number}.jsonl.gz"))
    store.delete(jpath(tmp), True)


def safe_name(setting: str) -> str:
    return re.sub(r"[^\w.-]", "_", setting)
