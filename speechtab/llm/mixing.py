"""Mixing sources to target weights, in DataFrame functions only.

Sizes are summed by source; capped targets come from one water level over the sources (a table of
one row per source). Each document gets a hash-random key. Documents of a source are cut into key
ranges, the ranges' sums give each range its offset, and a window within one range gives each document
its running sum, so no task holds a whole source. The source's budget is cut at the exact word: whole
epochs first, then the documents before the cut, and the document on the cut in part.

Null texts have size 0; a null source is a source of its own, last in order. A row without an id takes its key from its text's digest, so such rows
spread over the ranges too. Rows of equal key (repeated ids) are ordered by id, size and text digest, then, where whole rows are carried, by their other columns, so a rerun
over other partitions takes the same. Empty tables give no rows. Sources without words have target 0. Columns other than doc_id, text and source never change the draw.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from speechtab.llm.common import stage

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_EPOCHS = 2


def sizes(df: DataFrame, row: bool = False) -> DataFrame:
    """doc_id, source, size (words), key: the hash-random order of the documents, tie: the order within a key; with ``row`` all columns as a struct."""
    digest = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    others = [F.col(f"`{f.name}`") for f in df.schema.fields if row and "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    return df.select(
        *([F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row")] if row else []),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat(F.lit("mix-0:"), F.coalesce(F.col("doc_id").cast("string"), digest)).cast("binary")).alias("key"),
        F.struct(digest, F.xxhash64(*others) if others else F.lit(0)).alias("tie"),
    )


def targets(by_source: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size, target from (source, source_size); one row per source.

    Sources at their cap are those whose cap per weight lies under the water level
    (budget - caps before) / (weights from here on), in order of cap per weight.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    t = by_source.withColumn("weight", F.element_at(cycle, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    t = t.withColumn("cap", F.lit(max_epochs) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    whole = W.partitionBy(F.lit(1))
    before = W.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    from_here = W.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(0, W.unboundedFollowing)
    t = t.withColumn("budget", F.lit(share) * F.sum("source_size").over(whole))
    t = t.withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(from_here))
    t = t.withColumn("open", F.col("ratio") > F.col("level"))
    level = F.coalesce(F.max(F.when(F.col("open"), F.col("level"))).over(whole), F.lit(0.0))
    return t.select("source", "source_size", F.when(F.col("open"), F.col("weight") * level).otherwise(F.col("cap").cast("double")).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS, row: bool = False) -> DataFrame:
    """doc_id, source, size, source_size, target, taken: words that the mix takes of each document; with ``row`` its whole row too."""
    s = stage(sizes(docs, row), "mix-sizes")
    ranged = s.withColumn("range", F.substring("key", 1, 3))
    by_range = ranged.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    by_range = stage(by_range, "mix-ranges")  # at most 4096 rows a source
    goal = targets(by_range.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, share, max_epochs)
    upto = W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    offsets = by_range.withColumn("offset", F.coalesce(F.sum("range_size").over(upto), F.lit(0)))
    plan = offsets.alias("o").join(goal.alias("g"), F.col("o.source").eqNullSafe(F.col("g.source"))).select("o.source", "o.range", "o.offset", "g.source_size", "g.target")
    inner = W.partitionBy("r.source", "r.range").orderBy("key", F.col("doc_id").asc_nulls_last(), "size", "tie").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = ranged.alias("r").withColumn("inner", F.sum("size").over(inner)).join(plan.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")) & (F.col("r.range") == F.col("p.range")))
    start = F.col("p.offset") + F.col("inner") - F.col("size")
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - epochs * F.col("source_size")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - start))
    return rows.select(*(["row"] if row else []), "doc_id", F.col("r.source").alias("source"), "size", "source_size", "target", taken.cast("long").alias("taken"))


ORACLE = r"""
WITH s AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
             md5('mix-0:' || coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))) AS key, md5(coalesce(text, '')) AS tie FROM documents),
b AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY source),
w AS (SELECT *, CAST(CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight, 2 * source_size AS cap FROM b),
l AS (SELECT *, cap / weight AS ratio,
        (1.5 * CAST(sum(source_size) OVER () AS DOUBLE) - CAST(coalesce(sum(cap) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
        / sum(weight) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, CASE WHEN ratio > level THEN weight * coalesce(max(CASE WHEN ratio > level THEN level END) OVER (), 0) ELSE CAST(cap AS DOUBLE) END AS target FROM l),
r AS (SELECT s.doc_id, s.source, s.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
        CAST(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id NULLS LAST, s.size, s.tie ROWS UNBOUNDED PRECEDING) AS BIGINT) - s.size AS start
      FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM r)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - start)) AS BIGINT) AS taken FROM e
"""
