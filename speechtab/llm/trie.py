"""Prefix trie of rebuilt conversations from composable fingerprints.

A conversation's turns are ordered by turn (null first; turns of equal number by role, then by the content's SHA-256). It is rebuilt as the
first ``h`` turns of its base conversation and its own turns from ``h`` on. No rebuilt text is made: each turn has a content digest and,
from it, four residues f modulo a prime of 31 bits. The fingerprint of turns 1..n is the product of their maps x -> r x + f, written as
sum of f_j r^(j-1); products compose, so a rebuilt prefix is

    head(base, h) + r^(h' - h) (own(pos) - own(h)),   h' the base's turns in use,

with h <= 8 and powers from a literal table. Own products are window sums over range-sorted partitions; where a conversation lies in several
partitions, the earlier partitions' products are composed before (a few rows per partition border, no matter how long a conversation is).

Nodes are groups of equal (depth, fingerprint). Each member's row refers to the turn that it ends in by that turn's digest and to its parent by the
parent's fingerprint; a group whose members differ in either is a collision, and then all is done again with another multiplier. So
equality is proved level by level. Sums over subtrees: a node's weight belongs to its smallest member, whose own prefixes are the node's
ancestors; suffix sums along each conversation, then one sum over each node's members.

Null roles and texts are empty; rows without a conv_id take no part; equal rows are turns of their own; an empty table has no node. A conversation of no turns
after rebuilding belongs to the root alone. Other columns are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from speechtab.llm.common import small, stage

HEAD, EVERY = 9, 5
P = (1 << 31) - 1
PARTS = 4
#: Turns of a conversation that one window partition sums; longer ones are summed by pieces.
PIECE = 4096
BROADCAST_ROWS = 200_000
DRAWS = 4


def multipliers(draw: int) -> list[int]:
    return [int.from_bytes(hashlib.sha256(f"trie-{draw}-{k}".encode()).digest()[:8], "big") % (P - 2) + 2 for k in range(PARTS)]


def powers(r: int, exponents: range) -> str:
    """SQL of an array of powers of r modulo P; one string, which folds to one literal."""
    return f"cast(split('{' '.join(str(pow(r, e, P)) for e in exponents)}', ' ') AS array<bigint>)"


def power(r: int, exponent: str) -> str:
    """SQL of r^exponent modulo P for a non-negative column, from literal tables of one byte each."""
    out = ""
    for byte in range(4):
        part = f"get({powers(pow(r, 1 << (8 * byte), P), range(256))}, cast(shiftright({exponent}, {8 * byte}) & 255 AS int))"
        out = f"({out} * {part} % {P})" if out else part
    return out


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, digest (of role and text), bytes (of the text)."""
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    content = F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text")
    return rows.select("conv_id", "turn", "role", F.sha2(content.cast("binary"), 256).alias("digest"), F.octet_length("text").cast("long").alias("bytes"))


def prefixes(rows: DataFrame, draw: int) -> DataFrame:
    """conv_id, pos (from 1), digest, bytes, and the products b0.. of turns 1..pos and p0.. of turns 1..pos-1; ``rows`` sorted by range, with their partition as ``part``."""
    r = multipliers(draw)
    within = W.partitionBy("part", "conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "digest")
    rows = rows.withColumn("i", F.row_number().over(within).cast("long"))
    rows = rows.withColumns({f"f{k}": F.expr(f"cast(conv(substring(digest, {1 + 12 * k}, 12), 16, 10) AS bigint) % {P} * {power(r[k], 'i - 1')} % {P}") for k in range(PARTS)})
    upto = within.rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumns({f"s{k}": F.sum(f"f{k}").over(upto) for k in range(PARTS)})
    rows = rows.select("*", *(F.expr(x) for k in range(PARTS) for x in (f"s{k} % {P} AS b{k}", f"(s{k} - f{k}) % {P} AS p{k}")))
    # what lies in earlier partitions: only conversations on a border, at most two a partition
    pieces = rows.groupBy("conv_id", "part").agg(F.count("*").alias("n"), *(F.sum(f"f{k}").alias(f"t{k}") for k in range(PARTS)))
    cut = pieces.groupBy("conv_id").agg(F.count("*").alias("m")).where("m > 1").select("conv_id")
    before = W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    pieces = pieces.join(cut, "conv_id", "left_semi").withColumn("off", F.coalesce(F.sum("n").over(before), F.lit(0)))
    pieces = pieces.withColumns({f"o{k}": F.coalesce(F.sum(F.expr(f"t{k} % {P} * {power(r[k], 'off')} % {P}")).over(before), F.lit(0)) for k in range(PARTS)}).where("off > 0")
    pieces = pieces.select(F.col("conv_id").alias("c"), F.col("part").alias("at"), "off", *(F.expr(x) for k in range(PARTS) for x in (f"o{k} % {P} AS o{k}", f"{power(r[k], 'off')} AS x{k}")))
    pieces = small(stage(pieces, "trie-borders"), BROADCAST_ROWS)
    rows = rows.join(pieces, (F.col("conv_id") == F.col("c")) & (F.col("part") == F.col("at")), "left")
    whole = (f"if(off IS NULL, {x}{k}, (o{k} + x{k} * {x}{k}) % {P}) AS {x}{k}" for x in "bp" for k in range(PARTS))
    return rows.selectExpr("conv_id", "i + coalesce(off, 0) AS pos", "digest", "bytes", *whole)


def rebuilt(pre: DataFrame, draw: int) -> DataFrame:
    """A row for each prefix of each rebuilt conversation: conv_id, depth, key (fingerprint), up (its parent's), digest, bytes, ends (it is the whole conversation)."""
    r, names = multipliers(draw), [f"b{k}" for k in range(PARTS)]
    ids = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEAD
    first = F.when(F.col("pos") < HEAD, F.struct("pos", "digest", "bytes", *names, *(f"p{k}" for k in range(PARTS))))
    convs = pre.groupBy("conv_id").agg(F.max("pos").alias("n"), F.array_sort(F.collect_list(first)).alias("first"))  # at most eight a conversation
    convs = stage(convs.withColumn("h", ids.cast("long")).withColumn("base", F.col("conv_id") - F.col("conv_id") % EVERY), "trie-heads")
    base = convs.select(F.col("conv_id").alias("base"), F.col("first").alias("head"))
    none = F.array().cast(convs.schema["first"].dataType)
    convs = convs.join(base, "base", "left").withColumn("head", F.slice(F.coalesce("head", none), 1, F.col("h").cast("int")))
    convs = convs.withColumn("used", F.size("head").cast("long")).withColumn("total", F.col("used") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    convs = stage(convs, "trie-rebuilt")

    def key(values: list[str]) -> str:
        return f"concat_ws('.', {', '.join(values)})"

    of = lambda name: [f"{name}{k}" for k in range(PARTS)]
    root = convs.selectExpr("conv_id", "0L AS depth", f"{key(['0'] * PARTS)} AS key", "'' AS up", "'' AS digest", "0L AS bytes", "total = 0 AS ends")
    heads = convs.selectExpr("conv_id", "total", "explode(head) AS t").selectExpr("conv_id", "t.pos AS depth", f"{key(of('t.b'))} AS key", f"{key(of('t.p'))} AS up", "t.digest", "t.bytes", "total = t.pos AS ends")
    last = lambda array, n, k: f"if({n} > 0, element_at({array}, cast(greatest({n}, 1) AS int)).b{k}, 0)"
    joints = convs.where("n > h").selectExpr("conv_id AS c", "h", "used", "total", *(f"{last('head', 'used', k)} AS h{k}" for k in range(PARTS)), *(f"{last('first', 'h', k)} AS w{k}" for k in range(PARTS)))
    tail = pre.join(small(joints, BROADCAST_ROWS), (F.col("conv_id") == F.col("c")) & (F.col("pos") > F.col("h")))
    shift = [f"get({powers(r[k], range(1 - HEAD, HEAD))}, cast(used - h + {HEAD - 1} AS int))" for k in range(PARTS)]
    composed = lambda name: key([f"(h{k} + {shift[k]} * (({name}{k} - w{k} + {P}) % {P})) % {P}" for k in range(PARTS)])
    tails = tail.selectExpr("conv_id", "pos - h + used AS depth", f"{composed('b')} AS key", f"{composed('p')} AS up", "digest", "bytes", "pos - h + used = total AS ends")
    return root.unionByName(heads).unionByName(tails)


def from_below(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` (conv_id, depth, ...) with each column summed over the conversation's rows from this depth down, piece by piece."""
    rows = rows.withColumn("piece", F.floor(F.col("depth") / PIECE))
    inner = W.partitionBy("conv_id", "piece").orderBy(F.desc("depth")).rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumns({c: F.sum(c).over(inner) for c in columns})
    long_ = rows.where(F.col("depth") % PIECE == 0)  # a piece's first row holds its whole sum
    long_ = long_.join(small(long_.where("piece = 1").select("conv_id"), BROADCAST_ROWS), "conv_id", "left_semi")
    deeper = W.partitionBy("conv_id").orderBy(F.desc("piece")).rowsBetween(W.unboundedPreceding, -1)
    rest = long_.select(F.col("conv_id").alias("c"), F.col("piece").alias("at"), *(F.coalesce(F.sum(c).over(deeper), F.lit(0)).alias(f"more_{c}") for c in columns))
    rows = rows.join(small(rest, BROADCAST_ROWS), (F.col("conv_id") == F.col("c")) & (F.col("piece") == F.col("at")), "left")
    return rows.withColumns({c: F.col(c) + F.coalesce(f"more_{c}", F.lit(0)) for c in columns}).drop("piece", "c", "at", *(f"more_{c}" for c in columns))


def digests(ends: DataFrame) -> DataFrame:
    """depth, key, ends_sha256: the SHA-256 of a node's ids (``conv_id``), ascending and comma-joined.

    Ids are sorted by range; each partition packs a node's ids into one text, and a node's texts are hashed as a stream, so no list of ids is held.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, lo, ids, out = None, 0, [], []
        for b in batches:
            for d, k, c in zip(*(x.to_pylist() for x in b.columns)):
                if (d, k) != node or len(ids) >= 4096:
                    if ids:
                        out.append((*node, lo, ",".join(ids)))
                    node, lo, ids = (d, k), c, []
                ids.append(str(c))
            if len(out) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], ["depth", "key", "lo", "ids"])
                out = []
        if ids:
            out.append((*node, lo, ",".join(ids)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], ["depth", "key", "lo", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha, out = None, None, []
        for b in batches:
            for d, k, _, ids in zip(*(x.to_pylist() for x in b.columns)):
                if (d, k) != node:
                    if node:
                        out.append((*node, sha.hexdigest()))
                    node, sha = (d, k), hashlib.sha256(ids.encode())
                else:
                    sha.update(f",{ids}".encode())
            if len(out) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], ["depth", "key", "ends_sha256"])
                out = []
        if node:
            out.append((*node, sha.hexdigest()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], ["depth", "key", "ends_sha256"])

    order = ["depth", "key", "conv_id"]
    packed = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pack, "depth long, key string, lo long, ids string")
    return packed.repartition("depth", "key").sortWithinPartitions("depth", "key", "lo").mapInArrow(hashed, "depth long, key string, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: one row per node."""
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    rows = stage(turns(conversations).repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "trie-turns")
    for draw in range(DRAWS):
        paths = stage(rebuilt(stage(prefixes(rows, draw), "trie-prefixes"), draw), "trie-paths")
        same = F.max(F.struct("digest", "up")) == F.min(F.struct("digest", "up"))
        nodes = paths.groupBy("depth", "key").agg(F.min("conv_id").alias("rep"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes"), F.max("up").alias("up"), same.alias("same"))
        nodes = stage(nodes, "trie-nodes")
        if not nodes.where("not same").limit(1).count():
            break
    else:
        raise RuntimeError("fingerprints collide under every multiplier")
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("up").alias("key")).agg(F.count("*").alias("n_children"))
    nodes = stage(nodes.drop("same").join(children, ["depth", "key"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "trie-children")
    own = nodes.select(F.col("rep").alias("conv_id"), "depth", ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"), (F.col("n_children") == 0).cast("long").alias("n_leaves"))
    weighed = paths.select("conv_id", "depth", "key").join(own, ["conv_id", "depth"], "left").na.fill(0, ["saved_tokens", "n_leaves"])
    sums = from_below(weighed, ["saved_tokens", "n_leaves"]).groupBy("depth", "key").agg(F.sum("saved_tokens").alias("saved_tokens"), F.sum("n_leaves").alias("n_leaves"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("key").alias("up"), F.col("rep").alias("parent_conv_id"))
    out = nodes.join(sums, ["depth", "key"]).join(digests(paths.where("ends")), ["depth", "key"], "left").join(parents, ["depth", "up"], "left")
    return out.select(F.col("rep").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


#: Prefixes as joined digests of 64 characters each; ancestors are their heads.
ORACLE = (
    r"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), d) AS pos, d, bytes
  FROM (SELECT conv_id, turn, role, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS d, strlen(coalesce(text, '')) AS bytes FROM conversations WHERE conv_id IS NOT NULL)),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS base, """
    # the checksum of a conversation's decimal id
    + r"""xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
  lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))) % 9 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, 0 AS own, pos, d, bytes FROM c JOIN t ON t.conv_id = c.base AND pos <= h UNION ALL SELECT c.conv_id, 1, pos, d, bytes FROM c JOIN t ON t.conv_id = c.conv_id AND pos > h),
p AS (SELECT conv_id, row_number() OVER w AS depth, string_agg(d, '') OVER w AS key, bytes FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY own, pos)
      UNION ALL SELECT conv_id, 0, '', 0 FROM c),
e AS (SELECT *, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM p),
n AS (SELECT depth, key, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(bytes) AS weight,
        sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM e GROUP BY depth, key),
k AS (SELECT depth - 1 AS depth, left(key, CAST(64 * (depth - 1) AS BIGINT)) AS key, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
l AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (depth, key)),
a AS (SELECT up AS depth, left(key, CAST(64 * up AS BIGINT)) AS key, sum(weight) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM (SELECT *, unnest(range(depth + 1)) AS up FROM l) GROUP BY ALL)
SELECT l.conv_id, l.depth, q.conv_id AS parent_conv_id, l.n_convs, l.n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, l.ends_sha256
FROM l JOIN a ON a.depth = l.depth AND a.key = l.key LEFT JOIN n q ON q.depth = l.depth - 1 AND q.key = left(l.key, CAST(64 * (l.depth - 1) AS BIGINT)) AND l.depth > 0
"""
)
