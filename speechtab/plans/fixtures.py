"""Views of the given tables as the inputs of the operators: DataFrames and the same expressions as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from speechtab.functions.text import words


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    frames = F.floor(F.col("n_chars") * 2 / 3).cast("long")
    return d.select(
        F.concat_ws("-", "source", F.col("doc_id").cast("string")).alias("recording_id"),
        F.concat(F.lit("/corpus/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".wav")).alias("source_path"),
        frames.alias("num_frames"), (frames / 100.0).alias("duration"), (frames * 160).alias("num_samples"), F.lit(16000).alias("sampling_rate"),
        "doc_id", "lang", "text", "source", F.size(words(F.col("text"))).cast("long").alias("n_tokens"),
    )


def supervisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two supervisions for each labelled document: its first and its second half, the second running past the end."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    base = recordings(spark, sf_dir).join(labels, "doc_id")
    half = F.floor(F.col("num_frames") / 2)
    rows = base.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
    start = F.when(F.col("k") == 0, F.lit(0.0)).otherwise(half / 100.0)
    dur = F.when(F.col("k") == 0, half / 100.0).otherwise(F.col("num_frames") / 100.0)
    return rows.select(F.concat_ws("-", "recording_id", F.col("k").cast("string")).alias("id"), "recording_id", start.alias("start"), dur.alias("duration"), F.lit(0).alias("channel"), F.col("lang").alias("language"), F.col("source").alias("speaker"), "text")


def vad(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    start = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(1704067200000000)) / 1e6).cast("long")
    w = W.partitionBy("recording_id").orderBy("start_ms", "event_id")
    rows = e.select(F.col("user_id").alias("recording_id"), "event_id", start.alias("start_ms"), "value")
    end = F.col("start_ms") + F.greatest(F.floor(F.col("value") * 200), F.lit(100))
    return rows.withColumn("end_ms", F.least(end, F.coalesce(F.lead("start_ms").over(w), end)).cast("long")).drop("value")


def label_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document: line (order), words."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return d.select((F.col("doc_id") * 1_000_000 + F.col("pos")).alias("line"), "text", words(F.col("text")).alias("words"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.floor(F.col("vec_id") / 25).cast("string").alias("cut_id"), F.col("vec_id").alias("vec_id"), (F.col("vec_id") % 25).cast("int").alias("t"), F.col("embedding").alias("feat"), "label")


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)
    return f.select(F.col("cut_id").alias("utt_id"), "t", F.col("feat").alias("logits"), (F.col("label") * 6).cast("int").alias("target"), (F.col("vec_id") % 3 == 0).alias("masked"))


def nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return li.select(F.col("l_orderkey").alias("utt_id"), F.row_number().over(w).cast("long").alias("hyp"), (-F.col("l_quantity")).alias("am"), (-F.col("l_discount") * 100).alias("lm"), (-F.col("l_tax") * 100).alias("ng"), "l_partkey", "l_suppkey")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation turn as reference; the hypothesis drops every 7th word and garbles every 11th."""
    c = table(spark, sf_dir, "conversations")
    v = words(F.col("text"))
    changed = F.transform(F.filter(F.transform("ref", lambda x, i: F.struct(x.alias("w"), (i + 1).alias("i"))), lambda x: x["i"] % 7 != 0), lambda x: F.when(x["i"] % 11 == 0, F.lit("x")).otherwise(x["w"]))
    return c.select(F.col("role").alias("setting"), F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("cut_id"), v.alias("ref")).withColumn("hyp", changed)


#: The same views in SQL.
SQL = {
    "recordings": r"""SELECT source || '-' || doc_id AS recording_id, '/corpus/' || source || '/' || doc_id || '.wav' AS source_path,
      CAST(floor(n_chars * 2 / 3) AS BIGINT) AS num_frames, CAST(floor(n_chars * 2 / 3) AS BIGINT) / 100.0::DOUBLE AS duration,
      CAST(floor(n_chars * 2 / 3) AS BIGINT) * 160 AS num_samples, 16000 AS sampling_rate, doc_id, lang, text, source,
      CAST(len(list_filter(regexp_split_to_array(text, '[ \t\r\n]+'), lambda w: w <> '')) AS BIGINT) AS n_tokens FROM documents""",
    "supervisions": r"""SELECT recording_id || '-' || k AS id, recording_id, CASE WHEN k = 0 THEN 0.0::DOUBLE ELSE floor(num_frames / 2) / 100.0::DOUBLE END AS start,
      CASE WHEN k = 0 THEN floor(num_frames / 2) / 100.0::DOUBLE ELSE num_frames / 100.0::DOUBLE END AS duration, 0 AS channel, lang AS language, source AS speaker, text
      FROM recordings JOIN labels USING (doc_id), (VALUES (0), (1)) AS kk(k)""",
    "vad0": r"""SELECT user_id AS recording_id, event_id, CAST(floor((epoch_us(ts) - 1704067200000000) / 1e6) AS BIGINT) AS start_ms, value FROM events""",
    "vad": r"""SELECT recording_id, event_id, start_ms, CAST(least(start_ms + greatest(floor(value * 200), 100),
      coalesce(lead(start_ms) OVER (PARTITION BY recording_id ORDER BY start_ms, event_id), start_ms + greatest(floor(value * 200), 100))) AS BIGINT) AS end_ms FROM vad0""",
    "lines": r"""SELECT doc_id * 1000000 + i - 1 AS line, t AS text, list_filter(regexp_split_to_array(t, '[ \t\r\n]+'), lambda w: w <> '') AS words
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)""",
    "frames": r"""SELECT CAST(vec_id // 25 AS VARCHAR) AS cut_id, vec_id, CAST(vec_id % 25 AS INTEGER) AS t, embedding AS feat, label FROM embeddings""",
    "logits": r"""SELECT cut_id AS utt_id, t, feat AS logits, label * 6 AS target, vec_id % 3 = 0 AS masked FROM frames""",
    "nbest": r"""SELECT l_orderkey AS utt_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS hyp,
      -l_quantity AS am, -l_discount * 100 AS lm, -l_tax * 100 AS ng, l_partkey, l_suppkey FROM lineitem""",
    "pairs": r"""SELECT role AS setting, conv_id || '-' || turn AS cut_id, list_filter(regexp_split_to_array(text, '[ \t\r\n]+'), lambda w: w <> '') AS ref FROM conversations""",
}
NEEDS = {"supervisions": ["recordings"], "vad": ["vad0"], "logits": ["frames"]}


def sql(views: str, body: str) -> str:
    """``body`` after the named views (and those they need); ``WITH`` parts of the body join the list, ``RECURSIVE`` first word allowed."""
    names: list[str] = []

    def need(v: str) -> None:
        for x in NEEDS.get(v, []):
            need(x)
        if v not in names:
            names.append(v)

    for v in views.split():
        need(v)
    body = body.strip()
    recursive = body.upper().startswith("WITH RECURSIVE")
    head = ",\n".join(f"{v} AS ({SQL[v]})" for v in names)
    if body.upper().startswith("WITH"):
        body = body[len("WITH RECURSIVE" if recursive else "WITH") :].lstrip()
        return f"WITH {'RECURSIVE ' if recursive else ''}{head},\n{body}" if head else f"WITH {'RECURSIVE ' if recursive else ''}{body}"
    return f"WITH {head}\n{body}" if head else body
