"""ARPA language-model files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed pattern of an entry: log10 probability, words, optional back-off.
ENTRY = r"^\s*(-?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][-+]?\d+)?|-inf)\t(\S+(?: \S+)*)(?:\t(-?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][-+]?\d+)?|-?inf))?\s*$"


def parse_arpa(lines: DataFrame) -> DataFrame:
    """n, hist, w, log_p, log_bo of entry lines (column value); the order is the number of words."""
    part = lambda k: F.regexp_extract("value", ENTRY, k)
    hits = lines.where(F.col("value").rlike(ENTRY)).select(part(1).try_cast("double").alias("log_p"), F.split(part(2), " ").alias("ngram"), F.when(part(3) != "", part(3).try_cast("double")).alias("log_bo"))
    n = F.size("ngram")
    return hits.select(n.cast("int").alias("n"), F.slice("ngram", F.lit(1), n - 1).alias("hist"), F.element_at("ngram", -1).alias("w"), "log_p", "log_bo")


def read_arpa(spark: SparkSession, path: str) -> DataFrame:
    """The first model below ``path``; entries after the first ``\\end\\`` line are another model's and are left out.

    The files' lines are ordered by file name and place, so a model may lie in several part files.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    place = F.struct("file", "block", "row")
    end = lines.where(F.trim("value") == "\\end\\").agg(F.min(place).alias("end"))  # one row
    return parse_arpa(lines.crossJoin(F.broadcast(end)).where(F.col("end").isNull() | (place < F.col("end"))).select("value"))


def _lines(lm: DataFrame) -> DataFrame:
    """section, rank and key, by which a file's lines are sorted, and what makes up a line: an entry's numbers p and b, its words being the key, or a finished head."""
    number = lambda c: F.greatest(F.col(c), F.lit(-99.0))
    gram, none = F.array_join(F.concat("hist", F.array("w")), " "), F.lit(None).cast("double")
    rows = lm.select(F.col("n").alias("section"), F.lit(1).alias("rank"), gram.alias("key"), F.coalesce(number("log_p"), F.lit(-99.0)).alias("p"), F.when(F.col("log_bo").isNotNull(), number("log_bo")).alias("b"), F.lit(None).cast("string").alias("head"))
    orders = lm.groupBy("n").count()
    fixed = lambda section, rank, head: orders.select(section.alias("section"), rank.alias("rank"), F.lit("").alias("key"), none.alias("p"), none.alias("b"), head.alias("head"))
    heads = fixed(F.col("n"), F.lit(0), F.format_string("\\%d-grams:", "n"))
    blanks = fixed(F.col("n"), F.lit(2), F.lit(""))
    counts = fixed(F.lit(0), F.col("n").cast("int"), F.format_string("ngram %d=%d", "n", "count"))
    ends = [(0, -1, "", None, None, "\\data\\"), (0, 99, "", None, None, ""), (99, 0, "", None, None, "\\end\\")]
    return lm.sparkSession.createDataFrame(ends, "section int, rank int, key string, p double, b double, head string").unionByName(counts).unionByName(heads).unionByName(rows).unionByName(blanks)


def _value() -> Column:
    entry = F.concat_ws("\t", F.format_string("%.7f", "p"), "key", F.when(F.col("b").isNotNull(), F.format_string("%.7f", "b")))
    return F.coalesce("head", entry).alias("value")


def arpa_lines(lm: DataFrame) -> DataFrame:
    """section, line order and value of the file's lines; log_p null or of probability 0 is written as -99."""
    return _lines(lm).select("section", "rank", "key", _value())


def write_arpa(lm: DataFrame, path: str, compression: str = "none") -> None:
    """Range-sorted text: the part files in name order are the ARPA file, with ``compression="gzip"`` each one packed (as a whole they are one gzip file).

    Numbers are sorted and made text only as they are written, so an n-gram's words move once.
    """
    _lines(lm).orderBy("section", "rank", "key").select(_value()).write.option("compression", compression).text(path)
