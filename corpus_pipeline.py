"""Corpus pipeline: each stage reads what its predecessor kept; the last returns the token digests.

Stages take (spark, docs, sf_dir) and return a DataFrame; all but the last return the columns of
documents, whatever further columns there are and whatever their names. ``run`` writes each stage's result as
Parquet to the shared folder and reads it again. SQL cannot express the learned stages, so ORACLE_SQL is None;
the stages are tested one by one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speechtab.llm import bpe, mixing, neardup, pii, toxicity
from speechtab.llm.common import discard, short_batches, stage

ORACLE_SQL = None
#: Words of a shingle in the near-duplicate stage.
SHINGLE = 5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go.

    Null and empty texts score the model's bias and stay unless that alone rejects them. Repeated rows and ids, null ids and ties are
    scored each by itself. Empty tables stay empty; without labels nothing goes.
    """
    short_batches(spark)
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that of smallest id; five-word shingles, similarity 0.8.

    Null, empty and blank texts link with nothing and stay. Of rows with one id the one of smallest text stays (one of repeated rows);
    rows without an id stay. Empty tables stay empty.
    """
    short_batches(spark)
    if docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count():
        row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
        one = docs.where("doc_id is not null").groupBy("doc_id").agg(F.coalesce(F.min_by(row, "text"), F.first(row)).alias("row")).select("row.*")
        docs = one.unionByName(docs.where("doc_id is null"))
    gone = neardup.near_duplicates(docs, SHINGLE).where(~F.col("kept")).select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts give way to their kind; n_chars follows.

    All rows stay, null and empty texts, repeated rows and rows without an id as they are. Empty tables stay empty.
    """
    short_batches(spark)
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document once per epoch in which the mix takes it; the one on a source's cut with the words before the cut.

    Documents without words (null, empty, blank texts) are taken no words of, so they leave. Repeated rows and ids, and rows without an id, are
    documents of their own; a null source is a source. Empty tables stay empty.
    """
    taken = mixing.mix(docs, row=True).where("taken > 0")
    copies = F.transform(
        F.sequence(F.lit(1).cast("long"), F.ceil(F.col("taken") / F.col("size"))),
        lambda i: F.least(F.col("size"), F.col("taken") - (i - 1) * F.col("size")),
    )
    rows = taken.select("row", "size", F.explode(copies).alias("words"))
    parts = F.slice(F.regexp_extract_all("row.text", F.lit(r"[\x20\x09-\x0D]*" + mixing.WORD), F.lit(0)), 1, F.col("words").cast("int"))
    cut = F.when(F.col("words") < F.col("size"), F.array_join(parts, "")).otherwise(F.col("row.text"))
    rows = rows.withColumn("row", F.col("row").withField("text", cut)).select("row.*")
    if "n_chars" in rows.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*(F.col(f"`{c}`") for c in docs.columns))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token counts and digests of ids and decoded texts, one row for each row.

    Null and empty texts have no tokens. Repeated rows, null ids and further columns change nothing. Empty tables stay empty.
    """
    short_batches(spark)
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("pii", redact_pii),
    ("mixing", mix_sources),
    ("bpe", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        before, docs = docs, stage(step(spark, docs, sf_dir), name)
        discard(before)  # the next stage reads only what this one kept
    return docs
