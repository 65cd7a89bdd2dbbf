"""Queries over hypotheses, batches, labels, clusters and streams."""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speechtab.operators import batching as B
from speechtab.operators import cluster as K
from speechtab.operators import hyps as H
from speechtab.plans import fixtures as V
from speechtab.plans.fixtures import sql
from speechtab.session import checkpointed, shared_path
from speechtab.sources import manifests as M

Q: dict = {}


def query(body: str | None = None, views: str = ""):
    def keep(f):
        Q[f.__name__] = (f, sql(views, body) if body else None)
        return f

    return keep


@query("""WITH a AS (SELECT utt_id, t, list_transform(logits, lambda x, i: CASE WHEN i = 1 THEN x - 0.1::FLOAT ELSE x END) AS v FROM logits), b AS (SELECT utt_id, t, list_position(v, list_max(v)) - 1 AS y FROM a)
SELECT utt_id, coalesce(string_agg(y, ' ' ORDER BY t) FILTER (y NOT IN (0, 2)), '') AS ys, coalesce(string_agg(t, ' ' ORDER BY t) FILTER (y NOT IN (0, 2)), '') AS ts FROM b GROUP BY utt_id""", "logits")
def greedy_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = V.logits(spark, sf_dir)
    adjusted = f.withColumn("logits", F.transform("logits", lambda x, i: F.when(i == 0, (x - F.lit(0.1).cast("float")).cast("float")).otherwise(x)))
    g = H.greedy_labels(adjusted)
    return g.select("utt_id", F.array_join("ys", " ").alias("ys"), F.array_join("ts", " ").alias("ts"))


def two_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = V.logits(spark, sf_dir).select("utt_id", "t", "logits")
    return f.withColumn("logits", F.explode(F.array("logits", F.reverse("logits"))))


@query("""WITH e AS (SELECT utt_id, t, unnest(list_transform(logits, lambda x, i: {'k': i - 1, 'x': (x::DOUBLE + logits[65 - i]::DOUBLE) / 2})) AS s FROM logits)
SELECT utt_id, t, CAST(s.k AS BIGINT) AS token, round(s.x, 6) AS score FROM e""", "logits")
def ensemble_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = H.ensemble_mean(two_models(spark, sf_dir))
    return e.select("utt_id", "t", F.col("token").cast("long").alias("token"), F.round("score", 6).alias("score"))


@query("""WITH s AS (SELECT utt_id, t, ln(list_sum(list_transform(logits, lambda x: exp(x::DOUBLE)))) AS z, logits FROM logits),
e AS (SELECT utt_id, t, z, unnest(list_transform(logits, lambda x, i: {'k': i - 1, 'x': (x::DOUBLE + logits[65 - i]::DOUBLE) / 2})) AS s FROM s)
SELECT utt_id, t, CAST(s.k AS BIGINT) AS token, round(s.x - z, 6) AS score FROM e""", "logits")
def ensemble_mean_log_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = H.ensemble_mean(two_models(spark, sf_dir), "log_probs")
    return e.select("utt_id", "t", F.col("token").cast("long").alias("token"), F.round("score", 6).alias("score"))


@query("SELECT utt_id, CAST(l_suppkey % 5 AS BIGINT) AS ys, round(max(am) + ln(sum(exp(am - m))), 6) AS log_prob FROM (SELECT *, max(am) OVER (PARTITION BY utt_id, l_suppkey % 5) AS m FROM nbest) GROUP BY ALL", "nbest")
def merge_hyps(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = V.nbest(spark, sf_dir).select("utt_id", (F.col("l_suppkey") % 5).alias("ys"), F.col("am").alias("log_prob"))
    return H.merge_hyps(n).withColumn("log_prob", F.round("log_prob", 6))


@query("SELECT utt_id, hyp, rank FROM (SELECT utt_id, hyp, row_number() OVER (PARTITION BY utt_id ORDER BY am DESC, hyp) AS rank FROM nbest) WHERE rank <= 3", "nbest")
def topk_hyps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.topk_hyps(V.nbest(spark, sf_dir).withColumnRenamed("am", "log_prob"), 3).select("utt_id", "hyp", "rank")


@query("SELECT utt_id, hyp FROM (SELECT utt_id, hyp, row_number() OVER (PARTITION BY utt_id ORDER BY am / (2 + l_partkey % 7) DESC, hyp) AS rank FROM nbest) WHERE rank = 1", "nbest")
def best_hyp_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = V.nbest(spark, sf_dir).withColumnRenamed("am", "log_prob").withColumn("length", 2 + F.col("l_partkey") % 7)
    return H.topk_hyps(n, 1, norm=True).select("utt_id", "hyp")


@query("SELECT utt_id, hyp, am AS log_prob FROM nbest WHERE am > -20", "nbest")
def filter_hyps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.filter_hyps(V.nbest(spark, sf_dir).withColumnRenamed("am", "log_prob"), -20.0).select("utt_id", "hyp", "log_prob")


def _grid(score: str, name: str, second: bool) -> str:
    grid = "(VALUES (0.1::DOUBLE), (0.3), (0.5)) AS g(s)" + (", (VALUES (0.05::DOUBLE), (0.1)) AS h(d)" if second else "")
    return f"WITH x AS (SELECT {name} AS setting, utt_id, hyp, {score} AS score FROM nbest, {grid}), r AS (SELECT *, row_number() OVER (PARTITION BY setting, utt_id ORDER BY score DESC, hyp) AS k FROM x) SELECT setting, utt_id, hyp, round(score, 6) AS score FROM r WHERE k = 1"


def _rescored(spark: SparkSession, sf_dir: str, form: str) -> DataFrame:
    return H.rescore_grid(V.nbest(spark, sf_dir), form).select("setting", "utt_id", "hyp", F.round("score", 6).alias("score"))


@query(_grid("am + s * lm", "printf('nnlm_scale_%.2f', s)", False), "nbest")
def rescore_grid_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rescored(spark, sf_dir, "lm")


@query(_grid("am / s + lm - d * ng * ln(10)", "printf('nnlm_scale_%.2f_lodr_scale_%.2f', s, d)", True), "nbest")
def rescore_grid_lodr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rescored(spark, sf_dir, "lodr")


@query(_grid("am + s * ng + d * lm", "'ngram_lm_scale_' || s || '_nnlm_scale_' || d", True), "nbest")
def rescore_grid_ngram_rnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rescored(spark, sf_dir, "ngram_rnn")


#: Edit distances of ``w`` (id, r, h: word lists) by rows of the cost table.
DISTANCE = """h AS (SELECT id, j, CASE WHEN j > 0 THEN h[j] END AS y FROM (SELECT id, h, unnest(range(0, len(h) + 1)) AS j FROM w)),
r AS (SELECT id, i, r[i] AS x FROM (SELECT id, r, unnest(range(1, len(r) + 1)) AS i FROM w)),
d AS (SELECT id, 0 AS i, j, j AS c FROM h
  UNION ALL SELECT id, i, j, min(c - j) OVER (PARTITION BY id ORDER BY j) + j FROM (
    SELECT d.id, r.i, d.j, least(d.c + 1, coalesce(lag(d.c) OVER (PARTITION BY d.id ORDER BY d.j) + CASE WHEN h.y = r.x THEN 0 ELSE 1 END, d.c + 1)) AS c
    FROM d JOIN r ON r.id = d.id AND r.i = d.i + 1 JOIN h ON h.id = d.id AND h.j = d.j)),
dist AS (SELECT w.id, d.c AS errors FROM w JOIN d ON d.id = w.id AND d.i = len(w.r) AND d.j = len(w.h))"""
HYP = "list_transform(list_filter(list_transform(ref, lambda x, i: {'w': x, 'i': i}), lambda z: z.i % 7 <> 0), lambda z: CASE WHEN z.i % 11 = 0 THEN 'x' ELSE z.w END)"


@query(f"""WITH RECURSIVE w AS (SELECT {{'u': cut_id, 'hyp': k}} AS id, ref AS r, CASE WHEN k = 0 THEN {HYP} ELSE list_reverse(ref) END AS h FROM pairs, (VALUES (0), (1)) AS kk(k)), {DISTANCE}
SELECT id.u AS utt_id, CAST(arg_min(id.hyp, errors * 2 + id.hyp) AS BIGINT) AS hyp, min(errors) AS errors FROM dist GROUP BY id.u""", "pairs")
def oracle_hyp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per conversation turn: its garbled text or the turn's reversed words, whichever is closer."""
    p = V.pairs(spark, sf_dir)
    n = p.select(F.col("cut_id").alias("utt_id"), F.posexplode(F.array("hyp", F.reverse("ref"))).alias("hyp", "words"))
    return H.oracle_hyp(n.withColumn("hyp", F.col("hyp").cast("long")), p.select(F.col("cut_id").alias("utt_id"), "ref"))


#: The path of each pair of ``w``: K, S, D or I by word, carried along the rows of the cost table; of equal costs the diagonal, then the row above.
PATHS = """h AS (SELECT id, j, CASE WHEN j > 0 THEN h[j] END AS y FROM (SELECT id, h, unnest(range(0, len(h) + 1)) AS j FROM w)),
r AS (SELECT id, i, r[i] AS x FROM (SELECT id, r, unnest(range(1, len(r) + 1)) AS i FROM w)),
d AS (SELECT id, 0 AS i, j, j AS c, repeat('I', j) AS s FROM h
  UNION ALL SELECT id, i, j, c, CASE WHEN f IS NOT NULL THEN f ELSE last_value(f IGNORE NULLS) OVER z || repeat('I', CAST(j - last_value(CASE WHEN f IS NOT NULL THEN j END IGNORE NULLS) OVER z AS BIGINT)) END
  FROM (SELECT id, i, j, c, CASE WHEN dc = c THEN ds || e WHEN uc = c THEN us || 'D' END AS f FROM (
    SELECT *, min(least(uc, coalesce(dc, uc)) - j) OVER (PARTITION BY id ORDER BY j) + j AS c FROM (
      SELECT d.id, r.i, d.j, d.c + 1 AS uc, d.s AS us, CASE WHEN h.y = r.x THEN 'K' ELSE 'S' END AS e, lag(d.c) OVER o + CASE WHEN h.y = r.x THEN 0 ELSE 1 END AS dc, lag(d.s) OVER o AS ds
      FROM d JOIN r ON r.id = d.id AND r.i = d.i + 1 JOIN h ON h.id = d.id AND h.j = d.j WINDOW o AS (PARTITION BY d.id ORDER BY d.j))))
  WINDOW z AS (PARTITION BY id ORDER BY j)),
path AS (SELECT w.id, w.r, w.h, d.s FROM w JOIN d ON d.id = w.id AND d.i = len(w.r) AND d.j = len(w.h))"""
PAIRED = f"""WITH RECURSIVE w AS (SELECT {{'s': setting, 'u': cut_id}} AS id, ref AS r, {HYP} AS h FROM pairs), {PATHS}"""
#: One row per step of a path: its words.
STEPPED = """step AS (SELECT id, p, e, CASE WHEN e <> 'I' THEN r[CAST(i AS BIGINT)] END AS x, CASE WHEN e <> 'D' THEN h[CAST(j AS BIGINT)] END AS y FROM (
  SELECT id, r, h, p, e, sum(CASE WHEN e <> 'I' THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY p) AS i, sum(CASE WHEN e <> 'D' THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY p) AS j
  FROM (SELECT id, r, h, unnest(string_split(s, '')) AS e, generate_subscripts(string_split(s, ''), 1) AS p FROM path WHERE s <> '')))"""


@query(f"""{PAIRED} SELECT id.s AS setting, id.u AS cut_id, CAST(len(r) AS BIGINT) AS n_ref, CAST(len(s) - len(replace(s, 'K', '')) AS BIGINT) AS correct,
  CAST(len(s) - len(replace(s, 'S', '')) AS BIGINT) AS substituted, CAST(len(s) - len(replace(s, 'D', '')) AS BIGINT) AS deleted, CAST(len(s) - len(replace(s, 'I', '')) AS BIGINT) AS inserted FROM path""", "pairs")
def align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.align(V.pairs(spark, sf_dir)).drop("ref_words", "hyp_words")


@query(f"""WITH RECURSIVE w AS (SELECT {{'s': setting, 'u': cut_id}} AS id, ref AS r, {HYP} AS h FROM pairs), {DISTANCE}, t AS (SELECT id.s AS setting, CAST(sum(errors) AS BIGINT) AS errors, CAST(sum(len(r)) AS BIGINT) AS n_ref FROM dist JOIN w USING (id) GROUP BY id.s)
SELECT setting, errors, n_ref, round(100 * errors / n_ref, 6) AS wer FROM t""", "pairs")
def wer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.wer(H.align(V.pairs(spark, sf_dir))).withColumn("wer", F.round("wer", 6))


@query(f"""{PAIRED}, {STEPPED} SELECT id.s AS setting, coalesce(x, y) AS word, count(*) FILTER (e = 'K') AS correct, count(*) FILTER (e = 'S') AS substituted, count(*) FILTER (e = 'D') AS deleted,
  count(*) FILTER (e = 'I') AS inserted FROM step GROUP BY ALL""", "pairs")
def word_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.word_errors(H.align(V.pairs(spark, sf_dir)))


@query(f"""{PAIRED}, {STEPPED}, n AS (SELECT id.s AS setting, count(*) FILTER (e = 'K') AS k, count(*) FILTER (e = 'S') AS s, count(*) FILTER (e = 'D') AS d, count(*) FILTER (e = 'I') AS i FROM step GROUP BY ALL),
v AS (SELECT *, CAST(round(100 * (s + d + i) / (k + s + d), 4) AS VARCHAR) AS wer FROM n),
x AS (SELECT id.s AS setting, e, x, y, count(*) AS c FROM step WHERE e <> 'K' GROUP BY ALL)
SELECT '' AS setting, 'settings' || chr(9) || 'WER' AS value UNION ALL SELECT '', setting || chr(9) || wer FROM v
UNION ALL SELECT setting, '%WER = ' || wer FROM v
UNION ALL SELECT setting, 'Errors: ' || i || ' insertions, ' || d || ' deletions, ' || s || ' substitutions, over ' || (k + s + d) || ' reference words (' || k || ' correct)' FROM v
UNION ALL SELECT path.id.s, path.id.u || ':' || chr(9) || coalesce(string_agg(CASE WHEN e = 'K' THEN x ELSE '(' || coalesce(x, '*') || '->' || coalesce(y, '*') || ')' END, ' ' ORDER BY p), '') FROM path LEFT JOIN step USING (id) GROUP BY path.id
UNION ALL SELECT setting, c || ' ' || CASE WHEN e = 'S' THEN x || ' -> ' || y ELSE coalesce(x, y) END FROM x
UNION ALL SELECT id.s, concat_ws(chr(9), coalesce(x, y), count(*) FILTER (e = 'K'), count(*) FILTER (e = 'S'), count(*) FILTER (e = 'D'), count(*) FILTER (e = 'I')) FROM step GROUP BY id.s, coalesce(x, y)""", "pairs")
def result_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The error reports of every setting and the summary (setting ''), written and read back."""
    path = shared_path(spark, "reports")
    M.write_results(V.pairs(spark, sf_dir), path)
    return spark.read.text(f"{path}/errs").select(F.col("setting").cast("string").alias("setting"), "value").unionByName(spark.read.text(f"{path}/wer-summary").select(F.lit("").alias("setting"), "value"))


def cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = V.recordings(spark, sf_dir)
    return r.select(F.col("recording_id").alias("cut_id"), "duration", "num_frames", F.concat(F.lit("b"), (F.col("doc_id") % 97).cast("string")).alias("batch_id"))


CUTS = "cuts AS (SELECT recording_id AS cut_id, duration, num_frames, 'b' || (doc_id % 97) AS batch_id FROM recordings)"


@query("SELECT cut_id, row_number() OVER (ORDER BY duration DESC, cut_id) - 1 AS place FROM (SELECT recording_id AS cut_id, duration FROM recordings)", "recordings")
def sort_by_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of all cuts in the operator's order, as its range-sorted partitions hold them."""
    rows = B.sort_by_duration(cuts(spark, sf_dir)).withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id() % (1 << 33))
    rows = checkpointed(rows.select("cut_id", "part", "at"))
    sizes = rows.groupBy("part").agg(F.count("*").alias("n"))  # a row a partition
    before = sizes.alias("a").join(sizes.alias("b"), F.col("b.part") < F.col("a.part"), "left").groupBy("a.part").agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("before"))
    return rows.join(before, "part").select("cut_id", (F.col("at") + F.col("before")).alias("place"))


#: Batches of rows ``o`` (lane, k: place in the lane) by a fold per lane.
FOLD = """f AS (SELECT lane, k, 0 AS number, duration AS total FROM o WHERE k = 1
  UNION ALL SELECT o.lane, o.k, CASE WHEN total > 0 AND total + o.duration > 100 THEN number + 1 ELSE number END, CASE WHEN total > 0 AND total + o.duration > 100 THEN 0.0 ELSE total END + o.duration
  FROM f JOIN o ON o.lane = f.lane AND o.k = f.k + 1)"""
HASH = "CAST('0x' || substr(md5({}), 1, 8) AS BIGINT)"


@query(f"WITH RECURSIVE {CUTS}, o AS (SELECT *, 0 AS lane, row_number() OVER (ORDER BY cut_id) AS k FROM cuts), {FOLD} SELECT cut_id, '0-' || number AS batch_id FROM o JOIN f USING (lane, k)", "recordings")
def simple_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.simple_batches(cuts(spark, sf_dir).drop("batch_id"), 100.0, ["cut_id"]).select("cut_id", "batch_id")


@query(f"""WITH RECURSIVE {CUTS}, e AS (SELECT unnest(quantile_disc(duration, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS edge FROM cuts),
g AS (SELECT cut_id, duration, (SELECT count(DISTINCT edge) FROM e WHERE edge < duration) AS bucket FROM cuts),
o AS (SELECT *, 2 * bucket AS lane, row_number() OVER (PARTITION BY bucket ORDER BY {HASH.format("cut_id || ':0:0'")}, cut_id) AS k FROM g), {FOLD},
b AS (SELECT cut_id, bucket, duration, number, max(number) OVER (PARTITION BY lane) AS final, sum(duration) OVER (PARTITION BY lane, number) + max(duration) OVER (PARTITION BY lane, number) AS more FROM o JOIN f USING (lane, k))
SELECT cut_id, bucket, 2 * bucket || '-' || number AS batch_id FROM b WHERE number < final OR more > 100""", "recordings")
def bucket_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.bucket_batches(cuts(spark, sf_dir).drop("batch_id"), 10, 100.0).select("cut_id", "bucket", "batch_id")


@query(f"""WITH {CUTS}, p AS (SELECT batch_id, round(sum(duration), 6) AS total, count(*)::DOUBLE AS rows, max(duration) AS longest FROM cuts GROUP BY batch_id),
x AS (SELECT batch_id, 'total' AS criterion, total AS value FROM p UNION ALL SELECT batch_id, 'rows', rows FROM p UNION ALL SELECT batch_id, 'longest', longest FROM p)
SELECT criterion, batch_id, value FROM (SELECT *, row_number() OVER (PARTITION BY criterion ORDER BY value DESC, batch_id) AS r FROM x) WHERE r = 1""", "recordings")
def pessimistic_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.pessimistic_batches(cuts(spark, sf_dir))


@query(f"WITH {CUTS} SELECT cut_id, size, 0::BIGINT AS start, least(num_frames, size) AS length, size - least(num_frames, size) AS padding FROM (SELECT *, least(max(num_frames) OVER (PARTITION BY batch_id), 1000) AS size FROM cuts)", "recordings")
def collate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.collate(cuts(spark, sf_dir), pad=True, cap=1000).select("cut_id", "size", "start", "length", "padding")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.transform(F.array_sort(F.collect_list(F.struct("t", "label"))), lambda x: x["label"])
    f = V.frames(spark, sf_dir).groupBy("cut_id").agg(v.alias("labels"))
    return f.select("cut_id", "labels", (F.size("labels") * 2).cast("long").alias("num_frames"), F.concat(F.lit("b"), (F.col("cut_id").cast("long") % 5).cast("string")).alias("batch_id"))


LABELLED = "lab AS (SELECT cut_id, list(label ORDER BY t) AS labels, count(*) * 2 AS num_frames, 'b' || (CAST(cut_id AS BIGINT) % 5) AS batch_id FROM frames GROUP BY cut_id)"


@query(f"""WITH {LABELLED}, s AS (SELECT *, least(min(num_frames) OVER w, 40) AS size, min(len(labels)) OVER w AS shortest FROM lab WINDOW w AS (PARTITION BY batch_id))
SELECT cut_id, array_to_string(list_slice(labels, 1, least(CAST(round_even(size * 0.5, 0) AS BIGINT), shortest)), ' ') AS labels FROM s""", "frames")
def collate_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = B.collate(labelled(spark, sf_dir), cap=40)
    return B.collate_labels(c, 0.5, 10).select("cut_id", F.array_join("labels", " ").alias("labels"))


@query(f"""WITH {LABELLED}, s AS (SELECT cut_id, labels, CASE WHEN num_frames * 0.75 > len(labels) THEN CAST(floor(len(labels) / 0.75) AS BIGINT) ELSE num_frames END AS t FROM lab)
SELECT cut_id, t AS num_frames, array_to_string(list_transform(range(0, t), lambda i: labels[CAST(floor(i * 0.75) AS BIGINT) + 1]), ' ') AS labels FROM s""", "frames")
def resample_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.resample_labels(labelled(spark, sf_dir), 0.75).select("cut_id", "num_frames", F.array_join("labels", " ").alias("labels"))


@query("""WITH c AS (SELECT cut_id, feat, t, max(t) OVER (PARTITION BY cut_id) AS top, min(t) OVER (PARTITION BY cut_id) AS low, count(*) OVER (PARTITION BY cut_id) AS n FROM frames),
x AS (SELECT cut_id, n, n * 2 + 7 AS size, (n + 7) // 2 AS lead, list(feat ORDER BY t) AS v FROM c GROUP BY cut_id, n)
SELECT cut_id, size, i AS t, round(list_sum(list_transform(v[greatest(1, least(n, i - lead + 1))], lambda y: y::DOUBLE)), 4) AS energy FROM (SELECT *, unnest(range(size)) AS i FROM x)""", "frames")
def pad_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cut's frames repeated at both edges up to twice their number and seven."""
    v = F.transform(F.array_sort(F.collect_list(F.struct("t", "feat"))), lambda x: x["feat"])  # a cut's frames
    f = V.frames(spark, sf_dir).groupBy("cut_id").agg(v.alias("feats")).withColumn("size", (F.size("feats") * 2 + 7).cast("long"))
    out = f.select("cut_id", "size", F.posexplode(B.pad_edges(F.col("feats"), F.col("size"))).alias("t", "feat"))
    return out.select("cut_id", "size", F.col("t").cast("long").alias("t"), F.round(F.aggregate("feat", F.lit(0.0), lambda a, x: a + x), 4).alias("energy"))


@query(f"""WITH {CUTS}, s AS (SELECT cut_id, least(num_frames, 1000) AS n, least(max(num_frames) OVER (PARTITION BY batch_id), 1000) AS size FROM cuts),
g AS (SELECT *, size * 3 // 7 AS dst, size // greatest(size * 3 // 7, 1) AS r FROM s),
m AS (SELECT cut_id, dst, list_transform(range(0, dst), lambda i: i * r >= n) AS mask FROM g)
SELECT cut_id, CAST(dst AS BIGINT) AS frames, CAST(len(list_filter(mask, lambda x: x)) AS BIGINT) AS padded, md5(array_to_string(list_transform(mask, lambda x: CASE WHEN x THEN '1' ELSE '0' END), '')) AS mask FROM m""", "recordings")
def shrink_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The padding mask of collated cuts at three sevenths of their rate, where the last frames do not divide."""
    c = B.collate(cuts(spark, sf_dir), pad=True, cap=1000).withColumn("to", F.floor(F.col("size") * 3 / 7).cast("long"))
    mask = F.concat(F.array_repeat(F.lit(False), F.col("length").cast("int")), F.array_repeat(F.lit(True), F.col("padding").cast("int")))
    c = c.withColumn("mask", B.shrink_mask(mask, F.col("to")))
    bits = F.array_join(F.transform("mask", lambda x: F.when(x, "1").otherwise("0")), "")
    return c.select("cut_id", F.col("to").alias("frames"), F.size(F.filter("mask", lambda x: x)).cast("long").alias("padded"), F.md5(bits.cast("binary")).alias("mask"))


@query(f"""WITH RECURSIVE {CUTS}, o AS (SELECT *, 0 AS lane, row_number() OVER (ORDER BY cut_id) AS k FROM cuts), {FOLD},
b AS (SELECT '0-' || number AS batch_id, cut_id, o.duration AS d, max(o.duration) OVER (PARTITION BY number) AS room, row_number() OVER (PARTITION BY number ORDER BY o.duration DESC, cut_id) AS i FROM o JOIN f USING (lane, k)),
g AS (SELECT batch_id, i, 1 AS grp, 0.0::DOUBLE AS offs, [d] AS ends FROM b WHERE i = 1
  UNION ALL SELECT batch_id, i, coalesce(hit, len(ends) + 1), CASE WHEN hit IS NULL THEN 0.0 ELSE ends[hit] + 1.0 END,
    CASE WHEN hit IS NULL THEN list_append(ends, d) ELSE list_concat(list_append(list_slice(ends, 1, hit - 1), ends[hit] + 1.0 + d), list_slice(ends, hit + 1, len(ends))) END
  FROM (SELECT b.batch_id, b.i, b.d, g.ends, list_position(list_transform(g.ends, lambda e: e + 1.0 + b.d <= b.room + 1e-9), true) AS hit FROM g JOIN b ON b.batch_id = g.batch_id AND b.i = g.i + 1))
SELECT batch_id, cut_id, CAST(grp - 1 AS BIGINT) AS "group", round(offs, 6) AS "offset" FROM g JOIN b USING (batch_id, i)""", "recordings")
def concat_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of at most 100 pooled seconds, each packed."""
    batches = B.simple_batches(cuts(spark, sf_dir).drop("batch_id"), 100.0, ["cut_id"])
    return B.concat_plan(batches).withColumn("offset", F.round("offset", 6))


@query()
def span_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cut, in batches of like length; without a length it counts as empty. Planned on every second frame and filled up to each batch's largest count, a tenth dropped."""
    c = cuts(spark, sf_dir).drop("batch_id").withColumns({x: F.coalesce(x, F.lit(0).cast(t)) for x, t in (("duration", "double"), ("num_frames", "long"))})
    m = B.span_masks(B.bucket_batches(c, drop_last=False), add=True, dropout=0.1, rate=2)
    runs = F.zip_with("starts", "lengths", lambda s, n: F.concat_ws("+", s.cast("string"), n.cast("string")))
    return m.select("cut_id", "batch_id", F.col("n_masked").alias("n"), F.array_join(runs, " ").alias("masked"))


@query(f"""WITH {CUTS}, s AS (SELECT cut_id, axis, i, least(most, CASE WHEN axis = 'time' THEN num_frames ELSE 80 END) AS most, CASE WHEN axis = 'time' THEN num_frames ELSE 80 END AS whole
  FROM cuts, (VALUES ('time', 0, 100), ('time', 1, 100), ('freq', 0, 27), ('freq', 1, 27)) AS x(axis, i, most)),
l AS (SELECT *, {HASH.format("cut_id || ':' || axis || ':' || i || ':0:size'")} % (most + 1) AS length FROM s)
SELECT cut_id, axis, {HASH.format("cut_id || ':' || axis || ':' || i || ':0:at'")} % (whole - length + 1) AS start, length FROM l""", "recordings")
def specaug_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.specaug_plan(cuts(spark, sf_dir))


@query()
def fit_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frame's label under ten fitted centres."""
    f = V.frames(spark, sf_dir)
    centres, _ = K.fit_kmeans(f, 10, seed=1, max_iter=20)
    return K.labels_per_cut(K.assign_kmeans(f, centres))


def _round(i: int) -> str:
    return f"""a{i} AS MATERIALIZED (SELECT cut_id, t, f.feat, arg_min(id, list_sum(list_transform(list_zip(f.feat, c.feat), lambda z: (z[1]::DOUBLE - z[2]) ** 2))) AS label FROM frames f, c{i} c GROUP BY cut_id, t, f.feat),
m{i} AS (SELECT label AS id, list(x ORDER BY d) AS feat FROM (SELECT label, d, avg(y) AS x FROM (SELECT label, unnest(feat)::DOUBLE AS y, generate_subscripts(feat, 1) AS d FROM a{i}) GROUP BY label, d) GROUP BY label),
c{i + 1} AS MATERIALIZED (SELECT c.id, coalesce(m.feat, c.feat) AS feat FROM c{i} c LEFT JOIN m{i} m USING (id))"""


@query(f"""WITH c0 AS (SELECT label AS id, list_transform(feat, lambda x: x::DOUBLE) AS feat FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM frames) WHERE k = 1), {_round(0)}, {_round(1)}, {_round(2)}
SELECT id, d AS dim, round(x, 6) AS value FROM (SELECT id, unnest(feat) AS x, generate_subscripts(feat, 1) - 1 AS d FROM c3)""", "frames")
def refine_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centres after three rounds from the first vector of each label."""
    f = V.frames(spark, sf_dir)
    fixed = f.groupBy(F.col("label").alias("id")).agg(F.min_by("feat", "vec_id").alias("feat"))
    ids = [r["id"] for r in fixed.select("id").orderBy("id").collect()]  # one row a label
    centres, _ = K.fit_kmeans(f.drop("label"), start=K.centres_of(fixed), max_iter=3)
    rows = spark.createDataFrame(list(zip(ids, centres)), "id int, feat array<double>")
    return rows.select("id", F.posexplode("feat").alias("dim", "x")).select("id", F.col("dim").cast("long").alias("dim"), F.round("x", 6).alias("value"))


@query("""WITH c AS (SELECT label AS id, feat FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM frames) WHERE k = 1),
d AS (SELECT cut_id, t, id, list_sum(list_transform(list_zip(f.feat, c.feat), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) ** 2)) AS x FROM frames f, c),
a AS (SELECT cut_id, t, arg_min(id, x) AS label FROM d GROUP BY cut_id, t) SELECT cut_id, string_agg(label, ' ' ORDER BY t) AS labels FROM a GROUP BY cut_id""", "frames")
def assign_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first vector of each label as fixed centres."""
    f = V.frames(spark, sf_dir)
    fixed = f.groupBy(F.col("label").alias("id")).agg(F.min_by("feat", "vec_id").alias("feat"))
    return K.labels_per_cut(K.assign_kmeans(f.drop("label"), K.centres_of(fixed)))


@query()
def frame_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of a tone per document whose samples are its text's bytes."""
    d = V.table(spark, sf_dir, "documents")
    audio = d.select(F.col("doc_id").cast("string").alias("cut_id"), F.lit(16000).alias("sampling_rate"), F.col("text").cast("binary").alias("samples"))
    total = functools.reduce(lambda a, k: a + F.get("feat", F.lit(k)), range(80), F.lit(0.0))
    return K.frame_features(audio, decode=tone).select("cut_id", "t", F.round(total, 3).alias("energy"))


def tone(text: bytes) -> np.ndarray:
    """A sample for each character."""
    return (np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), np.uint32) % 128 - 64.0) / 64.0


def _streamed(spark: SparkSession, df: DataFrame, plan, name: str) -> DataFrame:
    """``df`` written to the shared folder, replayed as a stream through ``plan``, and the sink read back."""
    from speechtab.session import shared_path
    from speechtab.streaming.stateful import STATE_STORE

    path = shared_path(spark, f"stream-{name}")
    df.write.parquet(f"{path}/in")
    old = spark.conf.get(STATE_STORE[0], None)
    spark.conf.set(*STATE_STORE)
    try:
        source = spark.readStream.schema(df.schema).parquet(f"{path}/in")
        out = plan(source)
        out.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").option("path", f"{path}/out").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(STATE_STORE[0], old) if old else spark.conf.unset(STATE_STORE[0])
    return spark.read.schema(out.schema).parquet(f"{path}/out")


@query("""SELECT CAST(recording_id AS VARCHAR) AS recording_id, CAST(row_number() OVER (PARTITION BY recording_id ORDER BY start_ms, event_id) - 1 AS BIGINT) AS seg_idx, start_ms, end_ms FROM vad""", "vad")
def stream_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    from speechtab.plans.manifests import segment_events
    from speechtab.streaming.stateful import stream_segments as plan

    e = segment_events(spark, sf_dir)
    last = F.row_number().over(W.partitionBy("recording_id").orderBy(F.desc("chunk"), F.desc("item"))) == 1
    return _streamed(spark, e.withColumn("is_final", last).withColumn("ts", F.timestamp_millis(F.lit(1704067200000) + F.col("chunk"))), plan, "segments")


@query("""WITH b AS (SELECT utt_id, t, list_position(logits, list_max(logits)) - 1 AS y FROM logits)
SELECT utt_id, coalesce(string_agg(y, ' ' ORDER BY t) FILTER (y <> 0), '') AS ys, coalesce(string_agg(t, ' ' ORDER BY t) FILTER (y <> 0), '') AS ts FROM b GROUP BY utt_id""", "logits")
def stream_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    from speechtab.streaming.stateful import stream_greedy as plan

    f = V.logits(spark, sf_dir).select("utt_id", "t", "logits")
    f = f.withColumn("is_final", F.col("t") == F.max("t").over(W.partitionBy("utt_id"))).withColumn("ts", F.timestamp_millis(F.lit(1704067200000) + F.col("t")))
    d = _streamed(spark, f, plan, "greedy")
    return d.select("utt_id", F.array_join("ys", " ").alias("ys"), F.array_join("ts", " ").alias("ts"))
