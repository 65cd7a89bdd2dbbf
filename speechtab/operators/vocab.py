"""Vocabularies, lexicons and their arc tables."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from speechtab.session import bounded, staged

#: Rows of a table that travel to every task; the rest of a larger one is joined.
HEAD = 1 << 19


def char_vocab(lines: DataFrame, reserved: tuple[str, ...] = ("<blk>", "<sos/eos>", "<unk>")) -> DataFrame:
    """symbol, id: characters by first occurrence after the reserved symbols. ``lines``: line (order), text."""
    chars = F.filter(F.split(F.regexp_replace("text", r"[ \t\r\n]+", ""), ""), lambda c: c != "")
    own = lines.select("line", chars.alias("chars")).select("line", "chars", F.explode(F.array_distinct("chars")).alias("symbol"))  # a row per distinct character of a line
    first = own.select("line", "symbol", F.array_position("chars", F.col("symbol")).alias("pos")).groupBy("symbol").agg(F.min(F.struct("line", "pos")).alias("at"))
    first = first.where(~F.col("symbol").isin(*reserved))
    ids = first.select("symbol", (F.row_number().over(W.orderBy("at")) + len(reserved) - 1).cast("long").alias("id"))  # as many rows as there are characters
    head = lines.sparkSession.createDataFrame([(s, i) for i, s in enumerate(reserved)], "symbol string, id long")
    return head.unionByName(ids)


def sorted_vocab(symbols: DataFrame, head: tuple[str, ...], tail: tuple[str, ...]) -> DataFrame:
    """symbol, id: reserved head, the distinct symbols in code-point order, reserved tail."""
    from speechtab.sources.manifests import indexed

    body = symbols.select("symbol").where(~F.col("symbol").isin(*head, *tail)).distinct()
    n = body.count()
    fixed = [(s, i) for i, s in enumerate(head)] + [(s, len(head) + n + i) for i, s in enumerate(tail)]
    ids = indexed(body, ["symbol"]).select("symbol", (F.col("idx") + len(head)).alias("id"))
    return symbols.sparkSession.createDataFrame(fixed, "symbol string, id long").unionByName(ids)


def topk_vocab(tokens: DataFrame, size: int, reserved: tuple[str, ...] = ("<blk>", "<sos/eos>", "<unk>")) -> DataFrame:
    """symbol, id, n: reserved symbols and the most frequent tokens, up to ``size`` in all."""
    n = tokens.where(~F.col("token").isin(*reserved)).groupBy("token").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token").limit(size - len(reserved))
    ids = n.select(F.col("token").alias("symbol"), (F.row_number().over(W.orderBy(F.desc("n"), "token")) + len(reserved) - 1).cast("long").alias("id"), "n")
    head = tokens.sparkSession.createDataFrame([(s, i, 0) for i, s in enumerate(reserved)], "symbol string, id long, n long")
    return head.unionByName(ids)


def char_lexicon(words: DataFrame, vocab: DataFrame) -> DataFrame:
    """word, tokens: words all of whose characters are in the vocabulary, split into them; ``<UNK>`` last (ord null in the source)."""
    chars = words.select("word", F.filter(F.split(F.regexp_replace("word", r"^[ \t]+|[ \t]+$", ""), ""), lambda c: c != "").alias("tokens"))
    known = bounded(vocab.select(F.col("symbol").alias("c")))
    oov = chars.select("word", F.explode(F.array_distinct("tokens")).alias("c")).join(known, "c", "left_anti").select("word").distinct()
    good = chars.join(oov, "word", "left_anti")
    unk = words.sparkSession.createDataFrame([("<UNK>", ["<unk>"])], "word string, tokens array<string>")
    return good.unionByName(unk)


def add_disambig(lexicon: DataFrame) -> DataFrame:
    """``lexicon`` (ord, word, tokens) with ``#k`` appended to repeated token sequences and to prefixes of others."""
    seq = F.array_join("tokens", " ")
    lex = lexicon.withColumn("seq", seq)
    count = lex.groupBy("seq").agg(F.count("*").alias("n"))
    prefixes = lex.where(F.size("tokens") > 1).select(F.explode(F.transform(F.sequence(F.lit(1), F.size("tokens") - 1), lambda k: F.array_join(F.slice("tokens", 1, k), " "))).alias("seq")).distinct()
    marked = lex.join(count, "seq").join(prefixes.withColumn("p", F.lit(True)), "seq", "left")
    k = F.row_number().over(W.partitionBy("seq").orderBy("ord"))
    need = (F.col("n") > 1) | F.col("p").isNotNull()
    return marked.withColumn("k", k).select("ord", "word", F.when(need, F.concat("tokens", F.array(F.concat(F.lit("#"), "k")))).otherwise(F.col("tokens")).alias("tokens"))


def _states(lexicon: DataFrame, first: int) -> DataFrame:
    """``lexicon`` with ``base``: the first inner state of each entry, a running sum over the entries' order."""
    from speechtab.sources.manifests import indexed

    rows = indexed(lexicon, ["ord"], "__i").withColumn("__b", F.floor(F.col("__i") / 65_536))
    own = F.size("tokens") - 1
    sums = rows.groupBy("__b").agg(F.sum(own).alias("__n"))
    sums = sums.withColumn("__off", F.coalesce(F.sum("__n").over(W.orderBy("__b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    within = F.sum(own).over(W.partitionBy("__b").orderBy("__i").rowsBetween(W.unboundedPreceding, 0)) - own
    return rows.withColumn("__w", within).join(bounded(sums), "__b").withColumn("base", (F.col("__off") + F.col("__w") + first).cast("long"))


def _steps(lexicon: DataFrame, tokens: DataFrame, words: DataFrame, first: int, loop: int, unk: str | None) -> DataFrame:
    """src, dst (null at an entry's last token), ilabel, olabel of every token of every entry."""
    rows = _states(lexicon, first).select("base", F.col("word").alias("__w"), F.size("tokens").alias("n"), F.posexplode("tokens").alias("i", "symbol"))
    t, w = bounded(tokens.select("symbol", F.col("id").alias("t"))), bounded(words.select(F.col("symbol").alias("__w"), F.col("id").alias("w")))
    rows = rows.join(t, "symbol", "left").join(w, "__w", "left")
    src = F.when(F.col("i") == 0, loop).otherwise(F.col("base") + F.col("i") - 1).cast("long")
    dst = F.when(F.col("i") < F.col("n") - 1, F.col("base") + F.col("i")).cast("long")
    label = F.coalesce("t", F.lit(_id(tokens, unk))) if unk else F.col("t")
    return rows.select(src.alias("src"), dst.alias("dst"), label.cast("long").alias("ilabel"), F.when(F.col("i") == 0, F.col("w")).otherwise(0).cast("long").alias("olabel"))


def _id(symbols: DataFrame, symbol: str) -> int | None:
    row = symbols.where(F.col("symbol") == symbol).select("id").first()
    return row[0] if row else None


def _finished(arcs: DataFrame, loop: int, first: int, lexicon: DataFrame, loops: tuple[int, int] | None) -> DataFrame:
    if loops:
        arcs = add_self_loops(arcs, *loops)
    inner = lexicon.agg(F.coalesce(F.sum(F.size("tokens") - 1), F.lit(0)).alias("n"))
    final = inner.select(F.lit(loop).cast("long").alias("src"), (F.col("n") + first).cast("long").alias("dst"), F.lit(-1).cast("long").alias("ilabel"), F.lit(-1).cast("long").alias("olabel"), F.lit(0.0).alias("score"))
    return arcs.unionByName(final)


def lexicon_arcs(lexicon: DataFrame, tokens: DataFrame, words: DataFrame, loops: tuple[int, int] | None = None) -> DataFrame:
    """src, dst, ilabel, olabel, score of a lexicon (ord, word, tokens) without silence; words leave and enter at state 0."""
    s = _steps(lexicon, tokens, words, 1, 0, "<unk>")
    arcs = s.select("src", F.coalesce("dst", F.lit(0)).alias("dst"), "ilabel", "olabel", F.lit(0.0).alias("score"))
    return _finished(arcs, 0, 1, lexicon, loops)


def lexicon_arcs_sil(lexicon: DataFrame, tokens: DataFrame, words: DataFrame, sil: str = "SIL", p: float = 0.5, loops: tuple[int, int] | None = None) -> DataFrame:
    """As ``lexicon_arcs`` with an optional silence after each word: last tokens have two arcs, states count from 3."""
    yes, no = math.log(p), math.log(1 - p)
    s = _steps(lexicon, tokens, words, 3, 1, None)
    ends = F.when(F.col("dst").isNotNull(), F.array(F.struct(F.col("dst").alias("dst"), F.lit(0.0).alias("score")))).otherwise(F.array(F.struct(F.lit(1).cast("long").alias("dst"), F.lit(no).alias("score")), F.struct(F.lit(2).cast("long").alias("dst"), F.lit(yes).alias("score"))))
    arcs = s.select("src", F.explode(ends).alias("e"), "ilabel", "olabel").select("src", "e.dst", "ilabel", "olabel", "e.score")
    fixed = [(0, 1, 0, 0, no), (0, 2, 0, 0, yes), (2, 1, _id(tokens, sil), 0, 0.0)]
    arcs = arcs.sparkSession.createDataFrame(fixed, "src long, dst long, ilabel long, olabel long, score double").unionByName(arcs)
    return _finished(arcs, 1, 3, lexicon, loops)


def add_self_loops(arcs: DataFrame, token: int, word: int) -> DataFrame:
    """``arcs`` and a loop (token, word) on each state with an arc out of it whose olabel is not 0."""
    lit = lambda x: F.lit(x).cast("long")
    states = arcs.where("olabel <> 0").select("src").distinct()
    return arcs.unionByName(states.select("src", F.col("src").alias("dst"), lit(token).alias("ilabel"), lit(word).alias("olabel"), F.lit(0.0).alias("score")))


def looked_up(rows: DataFrame, col: str, table: DataFrame, source: str, target: str, other: int | str | None = None) -> DataFrame:
    """``rows`` with each item of array ``col`` replaced by ``target`` of the row of ``table`` whose ``source`` it is, ``other`` where there is none. ``source`` is unique.

    At most ``HEAD`` rows of the table travel to every task: all of them, or those of most uses (column ``n``; uses are counted where it is absent). Items that
    they lack, rare ones, meet the rest of the table in a join and come back by row, so neither all items nor the whole table are moved.
    """
    kind = table.schema[target].dataType
    head = table.select(source, target).limit(HEAD + 1).toArrow()
    whole = head.num_rows <= HEAD
    if not whole:
        if "n" not in table.columns:
            uses = rows.select(F.explode(col).alias(source)).groupBy(source).agg(F.count("*").alias("n"))
            table = staged(table.select(source, target).join(uses, source, "left"))
        level = F.floor(4 * F.log2(F.greatest(F.coalesce("n", F.lit(0)), F.lit(1))))
        low = math.inf
        for r in table.groupBy(level.alias("k")).count().orderBy(F.desc("k")).collect():  # four rows for each doubling of uses
            if (whole := whole + r["count"]) > HEAD:
                break
            low = r["k"]
        head = table.where(level >= low).select(source, target).toArrow()
        others = table.where(level < low).select(F.col(source).alias("__item"), F.col(target).alias("__to"))
        whole = False
    known, meant = (head.column(i).combine_chunks() for i in (0, 1))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i = b.schema.get_field_index(col)
            lists = b.column(i)
            at, items = _flat(lists)
            code = items.dictionary_encode()
            found = meant.take(pc.index_in(code.dictionary, value_set=known.cast(items.type))).take(code.indices)
            columns = [*b.columns[:i], _lists(at, found, lists), *b.columns[i + 1 :]]
            if whole and other is not None:
                columns[i] = _lists(at, pc.fill_null(found, other), lists)
            if not whole:
                lost = pc.is_null(found).to_numpy(zero_copy_only=False)
                columns.append(_lists(np.append(0, np.cumsum(lost))[at], items.filter(pa.array(lost)), lists))
            yield pa.RecordBatch.from_arrays(columns, [*b.schema.names, *([] if whole else ["__rest"])])

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i, j = b.schema.get_field_index(col), b.schema.get_field_index("__late")
            lists = b.column(i)
            at, items = _flat(lists)
            items = pc.replace_with_mask(items, pc.is_null(items), _flat(b.column(j))[1])
            items = items if other is None else pc.fill_null(items, other)
            columns = [_lists(at, items, lists) if k == i else c for k, c in enumerate(b.columns) if k != j]
            yield pa.RecordBatch.from_arrays(columns, [n for k, n in enumerate(b.schema.names) if k != j])

    items = rows.schema[col].dataType
    fields = [T.StructField(f.name, T.ArrayType(kind)) if f.name == col else f for f in rows.schema.fields]
    if whole:
        return rows.mapInArrow(first, T.StructType(fields))
    row = T.StructField("__row", T.LongType())
    mapped = staged(rows.withColumn("__row", F.monotonically_increasing_id()).mapInArrow(first, T.StructType([*fields, row, T.StructField("__rest", items)])))
    rare = mapped.select("__row", F.posexplode("__rest").alias("__pos", "__item")).join(others, "__item", "left")
    late = F.transform(F.array_sort(F.collect_list(F.struct("__pos", "__to"))), lambda x: x["__to"])
    late = rare.groupBy("__row").agg(late.alias("__late"))  # a row's rare items
    return mapped.drop("__rest").join(late, "__row", "left").drop("__row").mapInArrow(second, T.StructType(fields))


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """Where each list begins, and the end; and the items of all. Null lists are empty."""
    return np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))), lists.flatten()


def _lists(at: np.ndarray, items: pa.Array, like: pa.ListArray) -> pa.ListArray:
    """Lists of ``items`` that begin at ``at``, null where those of ``like`` are."""
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), items, mask=pc.is_null(like) if like.null_count else None)


def to_ids(rows: DataFrame, symbols: DataFrame, oov: str = "<unk>", token: str = "token") -> DataFrame:
    """``rows`` with ``id`` of each token, that of ``oov`` where it is not in the table; where ``token`` is an array, ``id`` is one in its place."""
    unknown = _id(symbols, oov)
    if isinstance(rows.schema[token].dataType, T.ArrayType):
        return looked_up(rows.withColumnRenamed(token, "id"), "id", symbols, "symbol", "id", unknown)
    table = bounded(symbols.select(F.col("symbol").alias(token), "id"))
    return rows.join(table, token, "left").withColumn("id", F.coalesce("id", F.lit(unknown)))


def detokenize(ids: DataFrame, symbols: DataFrame) -> DataFrame:
    """key, text of (key, ids): pieces joined, word marks to blanks, trimmed; a row each. Ids without a symbol are left out, and so are rows of no others."""
    pieces = looked_up(ids.select("key", "ids"), "ids", symbols, "id", "symbol").withColumn("ids", F.array_compact("ids")).where(F.size("ids") > 0)
    return pieces.select("key", F.trim(F.replace(F.array_join("ids", ""), F.lit("▁"), F.lit(" "))).alias("text"))


def encode_pieces(df: DataFrame, text: str = "text", model: str | None = None, by: str = "word") -> DataFrame:
    """``df`` with ``pieces``: by a SentencePiece model (shipped once to each worker), words or characters."""
    if model is None:
        from speechtab.functions.text import words as split_words

        pieces: Column = split_words(F.col(text)) if by == "word" else F.filter(F.split(text, ""), lambda c: c != "")
        return df.withColumn("pieces", pieces)
    import pandas as pd
    from pyspark import SparkFiles
    from pyspark.sql.functions import pandas_udf

    df.sparkSession.sparkContext.addFile(model)
    name = model.rpartition("/")[2]

    @pandas_udf("array<string>")
    def pieces_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=SparkFiles.get(name))
        for b in batches:
            yield pd.Series(sp.encode(b.fillna("").tolist(), out_type=str, num_threads=1))

    return df.withColumn("pieces", pieces_of(F.col(text)))
