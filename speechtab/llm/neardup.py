"""MinHash near-duplicates: universal hash minima, banding, signature then full-set verification, components.

Words (blank-separated, A-Z folded) form shingles of ``width`` words (two for the query, five for the pipeline's stage); a text of
fewer words is one shingle; a text without words has none and links with nothing. Documents of one shingle set form a class and only its
smallest id goes on. ``BANDS`` x ``ROWS`` minima of multiply-add hashes give band keys; a pair at
similarity 0.8 misses all bands with probability 5e-6. Shingles are 64-bit ids.

Within a band bucket each member is paired with the bucket's smallest id, never with all others. A
one-bit-per-minimum signature drops pairs far below the threshold, and each document's best partner
is confirmed on full sets. Buckets that still hold several components are then taken up again: only
members of different components are paired there, each pair once, so that no link is lost. Their documents
get a wide sketch first (4096 bits), which leaves pairs near the threshold to the full sets.
Components come from alternating large-star and small-star rounds over tables in the shared folder.

Repeated ids keep their smallest text (null only if all are); null ids have no place in a component and are left out.
Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from speechtab.llm.common import U64, buffers, discard, distinct_per_doc, mix, release, small, stage, words

BANDS, ROWS = 40, 6
MINIMA = BANDS * ROWS
#: 100 * intersection >= NUM * union.
NUM = 80
#: Signature bits that must agree: six deviations under the mean at similarity 0.8.
AGREE = int(MINIMA * 0.9 - 6 * (MINIMA * 0.09) ** 0.5)
#: Further partners confirmed, per document, before buckets are taken up again.
SECOND = 3
#: Ids up to this count (16 MB) are broadcast to pick candidate texts; more are joined by shuffle.
BROADCAST_IDS = 2_000_000
#: Bytes of text that are compared together.
CONFIRM_BYTES = 2 << 20
#: Tasks over which the members of one class are spread.
SALTS = 64
_RNG = np.random.default_rng(5)
_A = _RNG.integers(0, 2**63, MINIMA, dtype=np.uint64) * U64(2) + U64(1)
_B = _RNG.integers(0, 2**63, MINIMA, dtype=np.uint64)
SIGN = ["s0", "s1", "s2", "s3"]
#: Minima of the wide sketch, its columns, and the bits that must agree: four and a half deviations under the mean (5e-6, as the bands).
WIDE = 4096
WIDE_COLS = [f"w{i}" for i in range(WIDE // 64)]
WIDE_AGREE = int(WIDE * 0.9 - 4.5 * (WIDE * 0.09) ** 0.5)


def shingle_sets(texts: pa.Array, width: int = 2) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Per slice lo..hi of documents: (document in the slice, shingle id), distinct and sorted; fewer than ``width`` words are one shingle."""
    for lo, hi, h, counts in words(texts):
        doc = np.repeat(np.arange(hi - lo), counts)
        left = np.repeat(np.cumsum(counts), counts) - np.arange(len(h))  # words from here to the text's end
        ids = h
        for j in range(1, width):
            after = np.append(h[j:], np.zeros(min(j, len(h)), np.uint64))
            after[left <= j] = U64(0x5851F42D4C957F2D)
            ids = mix(ids * U64(0x9E3779B97F4A7C15) + (after ^ (after << U64(21))))
        keep = (left >= width) | ((left == np.repeat(counts, counts)) & (left < width))
        yield lo, hi, *distinct_per_doc(doc[keep], ids[keep])


def sign(docs: DataFrame, width: int = 2) -> DataFrame:
    """doc_id, n_shingles, d0, d1 (digest of the set), s0..s3 (signature bits), bands (none for sets under 4: they link to equal sets only)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, doc, ids in shingle_sets(b.column(1), width):
                n = np.bincount(doc, minlength=hi - lo).astype(np.int64)
                has = np.flatnonzero(n)
                begin = np.searchsorted(doc, has)
                d = np.zeros((2, hi - lo), np.uint64)
                s = np.zeros((4, hi - lo), np.uint64)
                bands = np.zeros((len(has), BANDS), np.uint64)
                if len(has):
                    d[0, has] = np.add.reduceat(ids * U64(0xD1342543DE82EF95), begin)
                    d[1, has] = np.add.reduceat(mix(ids ^ U64(0xA0761D6478BD642F)), begin)
                    v = np.empty_like(ids)
                    for k in range(MINIMA):
                        np.multiply(ids, _A[k], out=v)
                        np.add(v, _B[k], out=v)
                        low = np.minimum.reduceat(v, begin) >> U64(32)
                        j = k // ROWS
                        bands[:, j] = mix(bands[:, j] + low + U64(j + 1))
                        s[k // 60, has] |= (low & U64(1)) << U64(k % 60)
                banded = n[has] >= 4
                offsets = np.zeros(hi - lo + 1, np.int32)
                offsets[1:][has[banded]] = BANDS
                as_list = pa.ListArray.from_arrays(pa.array(np.cumsum(offsets, dtype=np.int32)), pa.array(bands[banded].ravel().view(np.int64)))
                cols = [pa.array(x.view(np.int64)) for x in (*d, *s)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(n), *cols, as_list], ["doc_id", "n_shingles", "d0", "d1", *SIGN, "bands"])
        release()

    schema = "doc_id long, n_shingles long, d0 long, d1 long, " + ", ".join(f"{s} long" for s in SIGN) + ", bands array<long>"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def sketch(docs: DataFrame, width: int = 2) -> DataFrame:
    """doc_id, w0..: one bit of each of ``WIDE`` further minima, for the few documents of open buckets."""
    mult, plus = (np.random.default_rng(55).integers(0, 2**63, (2, WIDE), dtype=np.uint64)) * U64(2) + U64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, doc, ids in shingle_sets(b.column(1), width):
                has, begin = np.unique(doc, return_index=True)
                out = np.zeros((len(WIDE_COLS), hi - lo), np.uint64)
                v = np.empty_like(ids)
                for k in range(WIDE if len(has) else 0):
                    np.multiply(ids, mult[k], out=v)
                    np.add(v, plus[k], out=v)
                    low = np.minimum.reduceat(v, begin) >> U64(32)
                    out[k // 64, has] |= (low & U64(1)) << U64(k % 64)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), *(pa.array(x.view(np.int64)) for x in out)], ["doc_id", *WIDE_COLS])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in WIDE_COLS))


def confirm(pairs: DataFrame, texts: DataFrame, width: int = 2) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the threshold."""
    ta = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
    tb = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = sum(np.diff(buffers(batch.column(c))[0]) for c in (2, 3))
            part = np.cumsum(size) // CONFIRM_BYTES
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), batch.num_rows]
            for at, to in zip(cuts, cuts[1:]):
                b = batch.slice(at, to - at)
                sides = []
                for col in (2, 3):
                    parts = [(lo + doc, ids) for lo, _, doc, ids in shingle_sets(b.column(col), width)]
                    sides.append([np.concatenate(x) for x in zip(*parts)])
                n = [np.bincount(doc, minlength=b.num_rows) for doc, _ in sides]
                doc, ids = (np.concatenate(x) for x in zip(*sides))
                order = np.lexsort((ids, doc))
                doc, ids = doc[order], ids[order]
                both = np.bincount(doc[1:][(doc[1:] == doc[:-1]) & (ids[1:] == ids[:-1])], minlength=b.num_rows)
                keep = pa.array((100 * both >= NUM * (n[0] + n[1] - both)) & (both > 0))
                yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], ["a", "b"])
        release()

    return pairs.join(ta, "a").join(tb, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (smallest node reachable) of every node with an edge, by alternating large-star and small-star."""
    e = stage(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    mark = lambda t: tuple(t.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
    seen = mark(e)
    while seen[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small_ = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, e = e, stage(small_.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
        now = mark(e)
        discard(last)
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component"))


def agreement(x: str, y: str):
    return F.lit(MINIMA) - differing(x, y, SIGN)


def differing(x: str, y: str, cols: list[str]):
    bits = [F.bit_count(F.col(f"{x}.{c}").bitwiseXOR(F.col(f"{y}.{c}"))) for c in cols]
    return reduce(lambda a, b: a + b, bits)


def close(x: str, y: str):
    """Sizes and signatures that a pair at the threshold can have."""
    sizes = (100 * F.least(f"{x}.n_shingles", f"{y}.n_shingles")) >= NUM * F.greatest(f"{x}.n_shingles", f"{y}.n_shingles")
    return sizes & (agreement(x, y) >= AGREE)


def near_duplicates(docs: DataFrame, width: int = 2) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each id; shingles of ``width`` words."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    signed = stage(sign(docs, width), "signed")
    if signed.groupBy("doc_id").count().where("count > 1").limit(1).count():
        docs = docs.groupBy("doc_id").agg(F.min("text").alias("text"))
        signed = stage(sign(docs, width), "signed")
    sets = signed.where("n_shingles > 0").select("doc_id", "n_shingles", "d0", "d1", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("salt"))
    classes = sets.groupBy("n_shingles", "d0", "d1").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).where("n > 1").drop("n")
    classes = classes.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))  # only sets that repeat: a large class meets its row in many tasks
    member = stage(sets.join(classes, ["n_shingles", "d0", "d1", "salt"], "left").select("doc_id", F.coalesce("rep", "doc_id").alias("rep")), "members")
    reps = signed.join(member.where("doc_id = rep").select("doc_id"), "doc_id")
    info = stage(reps.select("doc_id", "n_shingles", *SIGN, "bands"), "representatives")
    row = info.select("doc_id", F.explode("bands").alias("band"))
    shared = row.groupBy("band").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1").select("band", "least")
    bucket = stage(row.join(shared, "band"), "buckets")
    info_table, bands, info = info, info.select("doc_id", "bands"), info.drop("bands")

    pairs = bucket.where("doc_id <> least").select(F.col("least").alias("a"), F.col("doc_id").alias("b")).distinct()
    judged = pairs.join(info.alias("x"), F.col("a") == F.col("x.doc_id")).join(info.alias("y"), F.col("b") == F.col("y.doc_id")).where(close("x", "y"))
    judged = stage(judged.select("a", "b", agreement("x", "y").alias("agree")), "judged")
    best = stage(judged.groupBy("b").agg(F.max_by("a", F.struct("agree", -F.col("a"))).alias("a")).select("a", "b"), "best")

    def texts_of(chosen: DataFrame) -> DataFrame:
        ids = chosen.select(F.col("a").alias("doc_id")).unionByName(chosen.select(F.col("b").alias("doc_id"))).distinct()
        return docs.join(small(ids, BROADCAST_IDS), "doc_id", "left_semi")

    links = stage(confirm(best, texts_of(best), width), "links")
    found = components(links)

    def labels(ids: DataFrame, key: str, name: str) -> DataFrame:
        named = found.select(F.col("node").alias(key), F.col("component").alias(name))
        return ids.join(named, key, "left").withColumn(name, F.coalesce(name, key))

    rest = labels(labels(judged.join(best, ["a", "b"], "left_anti"), "a", "ca"), "b", "cb").where("ca <> cb")
    turn = F.row_number().over(W.partitionBy("b").orderBy(F.desc("agree"), "a"))
    second = stage(rest.withColumn("turn", turn).where(F.col("turn") <= SECOND).select("a", "b"), "second")
    late = stage(confirm(second, texts_of(second), width), "links")
    if late.limit(1).count():
        links = links.unionByName(late)
        found = components(links)
    tried = best.unionByName(second)

    labelled = labels(info, "doc_id", "component")
    open_ = bucket.select("band", "doc_id").join(labelled, "doc_id")
    several = open_.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("band")
    open_ = stage(open_.join(several, "band"), "open")
    ids = open_.select("doc_id").distinct()
    wide = sketch(docs.join(small(ids, BROADCAST_IDS), "doc_id", "left_semi"), width).join(bands, "doc_id")
    narrow, open_ = open_, stage(open_.join(wide, "doc_id"), "wide")
    discard(narrow)
    x, y = open_.alias("x"), open_.alias("y")
    wider = differing("x", "y", WIDE_COLS) <= WIDE - WIDE_AGREE
    shared_band = F.filter(F.zip_with("x.bands", "y.bands", lambda p, q: F.when(p == q, p)), lambda p: p.isNotNull())
    once = F.get(shared_band, F.lit(0)) == F.col("x.band")  # a pair counts in its first common bucket
    met = (F.col("x.band") == F.col("y.band")) & (F.col("x.doc_id") < F.col("y.doc_id")) & (F.col("x.component") != F.col("y.component")) & close("x", "y") & wider & once
    more = x.join(y, met).select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b"))
    more = stage(more.join(tried, ["a", "b"], "left_anti"), "more")
    if more.limit(1).count():
        late = stage(confirm(more, texts_of(more), width), "links")
        if late.limit(1).count():
            found = components(links.unionByName(late))
    discard(info_table, bucket, judged, best, second, open_, more)  # what follows reads the signatures, the classes and the components
    out = signed.select("doc_id", "n_shingles").join(member, "doc_id", "left").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.coalesce("component", "rep", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) >= 2 THEN list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) WHEN len(ws) = 1 THEN [ws[1]] ELSE [] END) AS sh FROM w),
n AS (SELECT doc_id, CAST(coalesce(len(sh), 0) AS BIGINT) AS n FROM s),
e AS (SELECT doc_id, unnest(sh) AS g FROM s),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM e x JOIN e y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
l2 AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS c FROM n UNION SELECT l2.b, r.c FROM r JOIN l2 ON l2.a = r.node),
m AS (SELECT node, min(c) AS component_id FROM r GROUP BY node)
SELECT n.doc_id, n.n AS n_shingles, component_id, n.doc_id = component_id AS kept FROM n JOIN m ON m.node = n.doc_id
"""
