"""Queries over vocabularies, lexicons and language models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speechtab.functions import text as X
from speechtab.operators import lm as L
from speechtab.operators import vocab as O
from speechtab.plans import fixtures as V
from speechtab.plans.fixtures import sql
from speechtab.session import discard, shared_path, staged

Q: dict = {}
ORDER = 3


def query(body: str | None = None, views: str = ""):
    def keep(f):
        Q[f.__name__] = (f, sql(views, body) if body else None)
        return f

    return keep


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.lines(spark, sf_dir).select("line", F.posexplode("words").alias("pos", "token"))


def worded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.lines(spark, sf_dir).select("line", "words").where(F.size("words") > 0)


def per_line(spark: SparkSession, sf_dir: str, rows: DataFrame, value: str) -> DataFrame:
    """``rows`` (line, array ``value``) with one row for each line number; arrays of one number merge by position, as a grouping of their items would.

    Numbers recur only where documents share an id or have none, or where a text has a million lines: only then rows are grouped.
    """
    d = V.table(spark, sf_dir, "documents").groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.octet_length("text")).alias("most"))
    if not d.where("doc_id is null or n > 1 or most >= 999999").limit(1).count():
        return rows
    items = F.array_sort(F.collect_list(F.struct("pos", "item")))
    return rows.select("line", F.posexplode(value).alias("pos", "item")).groupBy("line").agg(F.transform(items, lambda x: x["item"]).alias(value))


def small_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.topk_vocab(tokens(spark, sf_dir), 2000)


TOK = "tok AS (SELECT line, w.i AS pos, w.token AS token FROM (SELECT line, unnest(list_transform(words, lambda x, i: {'token': x, 'i': i})) AS w FROM lines))"
VOCAB = """voc AS (SELECT token AS symbol, row_number() OVER (ORDER BY n DESC, token) + 2 AS id, n FROM (SELECT token, count(*) AS n FROM tok GROUP BY token ORDER BY n DESC, token LIMIT 1997)
  UNION ALL SELECT * FROM (VALUES ('<blk>', 0, 0), ('<sos/eos>', 1, 0), ('<unk>', 2, 0)))"""


@query(f"WITH {TOK}, {VOCAB} SELECT t.line, string_agg(coalesce(v.id, 2), ' ' ORDER BY pos) AS ids FROM tok t LEFT JOIN voc v ON v.symbol = t.token GROUP BY t.line", "lines")
def to_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = O.to_ids(worded(spark, sf_dir), staged(small_vocab(spark, sf_dir)), token="words")
    return per_line(spark, sf_dir, ids, "id").select("line", F.array_join(F.col("id").cast("array<string>"), " ").alias("ids"))


@query(f"WITH {TOK} SELECT line AS key, string_agg(token, ' ' ORDER BY pos) AS text FROM tok GROUP BY line", "lines")
def detokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = lambda w: F.concat(F.lit("▁"), w)
    uses = staged(tokens(spark, sf_dir).groupBy(marked(F.col("token")).alias("symbol")).agg(F.count("*").alias("n")))
    voc = staged(O.sorted_vocab(uses, ("<unk>",), ()).join(uses, "symbol", "left"))
    ids = O.to_ids(worded(spark, sf_dir).withColumn("words", F.transform("words", marked)), voc, token="words")
    return O.detokenize(per_line(spark, sf_dir, ids, "id").toDF("key", "ids"), voc)


@query("SELECT line, CAST(len(words) AS BIGINT) AS n, array_to_string(words, '|') AS pieces FROM lines", "lines")
def encode_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = O.encode_pieces(V.lines(spark, sf_dir))
    return p.select("line", F.size("pieces").cast("long").alias("n"), F.array_join("pieces", "|").alias("pieces"))


@query("SELECT line, CASE WHEN len(words) > 0 THEN '<s> ' || array_to_string(words, ' ') || ' </s>' ELSE '<s> </s>' END AS marked FROM lines", "lines")
def add_bos_eos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.lines(spark, sf_dir).select("line", F.array_join(X.add_bos_eos(F.col("words")), " ").alias("marked"))


CHARS = r"ch AS (SELECT line, c.i AS pos, c.x AS symbol FROM (SELECT line, unnest(list_transform(string_split(regexp_replace(text, '[ \t\r\n]+', '', 'g'), ''), lambda x, i: {'x': x, 'i': i})) AS c FROM lines) WHERE c.x <> '')"


@query(f"WITH {CHARS}, f AS (SELECT symbol, min(line * 1000000 + pos) AS seen FROM ch GROUP BY symbol) SELECT symbol, row_number() OVER (ORDER BY seen) + 2 AS id FROM f UNION ALL SELECT * FROM (VALUES ('<blk>', 0), ('<sos/eos>', 1), ('<unk>', 2))", "lines")
def char_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.char_vocab(V.lines(spark, sf_dir))


@query(f"""WITH {TOK}, d AS (SELECT token, row_number() OVER (ORDER BY token) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT token FROM tok))
SELECT token AS symbol, k + 2 AS id FROM d UNION ALL SELECT h, i FROM (VALUES ('<eps>', 0), ('!SIL', 1), ('<UNK>', 2)) AS x(h, i)
UNION ALL SELECT h, (SELECT max(n) FROM d) + i FROM (VALUES ('#0', 3), ('<s>', 4), ('</s>', 5)) AS x(h, i)""", "lines")
def sorted_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.sorted_vocab(tokens(spark, sf_dir).select(F.col("token").alias("symbol")), ("<eps>", "!SIL", "<UNK>"), ("#0", "<s>", "</s>"))


@query(f"WITH {TOK}, {VOCAB} SELECT symbol, id, n FROM voc", "lines")
def topk_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return small_vocab(spark, sf_dir)


def word_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens(spark, sf_dir).select(F.col("token").alias("word")).distinct()


@query(f"""WITH {TOK}, w AS (SELECT DISTINCT token AS word FROM tok) SELECT word, array_to_string(string_split(word, ''), ' ') AS tokens FROM w WHERE regexp_full_match(word, '[a-z]+') UNION ALL SELECT '<UNK>', '<unk>'""", "lines")
def char_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    letters = spark.createDataFrame([(chr(c),) for c in range(97, 123)], "symbol string")
    return O.char_lexicon(word_list(spark, sf_dir), letters).select("word", F.array_join("tokens", " ").alias("tokens"))


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names spelt by their words without the last letter's case: many share a spelling or start another."""
    p = V.table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("ord"), F.concat_ws("_", "p_name", F.col("p_partkey").cast("string")).alias("word"), F.split(F.lower("p_type"), " ").alias("t"), (F.col("p_partkey") % 3).alias("k")).select("ord", "word", F.slice("t", F.lit(1), F.greatest(F.size("t") - F.col("k"), F.lit(0)).cast("int")).alias("tokens")).where(F.size("tokens") > 0)


LEX = "lex AS (SELECT p_partkey AS ord, p_name || '_' || p_partkey AS word, list_slice(string_split(lower(p_type), ' '), 1, len(string_split(lower(p_type), ' ')) - p_partkey % 3) AS tokens FROM part WHERE len(string_split(lower(p_type), ' ')) > p_partkey % 3)"
DIS = """c AS (SELECT array_to_string(tokens, ' ') AS seq, count(*) AS n FROM lex GROUP BY 1),
pre AS (SELECT DISTINCT array_to_string(list_slice(tokens, 1, k), ' ') AS seq FROM (SELECT tokens, unnest(range(1, len(tokens))) AS k FROM lex)),
dis AS (SELECT ord, word, CASE WHEN c.n > 1 OR pre.seq IS NOT NULL THEN list_append(tokens, '#' || row_number() OVER (PARTITION BY c.seq ORDER BY ord)) ELSE tokens END AS tokens
  FROM lex JOIN c ON c.seq = array_to_string(tokens, ' ') LEFT JOIN pre ON pre.seq = c.seq)"""


@query(f"WITH {LEX}, {DIS} SELECT ord, array_to_string(tokens, ' ') AS tokens FROM dis")
def add_disambig(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.add_disambig(lexicon(spark, sf_dir)).select("ord", F.array_join("tokens", " ").alias("tokens"))


def symbols(lex: DataFrame, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    t = O.sorted_vocab(lex.select(F.explode("tokens").alias("symbol")), ("<blk>", "SIL", "<unk>"), ("#0",))
    return t, lex.select(F.col("word").alias("symbol"), F.col("ord").alias("id"))


SYM = """t AS (SELECT symbol, row_number() OVER (ORDER BY symbol) + 2 AS id FROM (SELECT DISTINCT unnest(tokens) AS symbol FROM lex)),
st AS (SELECT ord, tokens, coalesce(sum(len(tokens) - 1) OVER (ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM lex),
x AS (SELECT ord, off, len(tokens) AS n, unnest(tokens) AS tok, generate_subscripts(tokens, 1) AS i FROM st)"""


@query(f"""WITH {LEX}, {SYM}, a AS (SELECT CAST(CASE WHEN i = 1 THEN 0 ELSE off + i - 1 END AS BIGINT) AS src, CAST(CASE WHEN i < n THEN off + i ELSE 0 END AS BIGINT) AS dst, t.id AS ilabel, CASE WHEN i = 1 THEN ord ELSE 0 END AS olabel FROM x JOIN t ON t.symbol = x.tok)
SELECT *, 0.0::DOUBLE AS score FROM a UNION ALL SELECT 0, CAST((SELECT sum(len(tokens) - 1) + 1 FROM lex) AS BIGINT), -1, -1, 0.0""")
def lexicon_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lex = lexicon(spark, sf_dir)
    return O.lexicon_arcs(lex, *symbols(lex, spark))


@query(f"""WITH {LEX}, {SYM}, b AS (SELECT CAST(CASE WHEN i = 1 THEN 1 ELSE off + i + 1 END AS BIGINT) AS src, CAST(off + i + 2 AS BIGINT) AS nxt, i, n, t.id AS ilabel, CASE WHEN i = 1 THEN ord ELSE 0 END AS olabel FROM x JOIN t ON t.symbol = x.tok),
a AS (SELECT src, nxt AS dst, ilabel, olabel, 0.0::DOUBLE AS score FROM b WHERE i < n UNION ALL SELECT src, d, ilabel, olabel, s FROM b, (VALUES (1, ln(0.6::DOUBLE)), (2, ln(0.4::DOUBLE))) AS e(d, s) WHERE i = n
  UNION ALL SELECT * FROM (VALUES (0, 1, 0, 0, ln(0.6::DOUBLE)), (0, 2, 0, 0, ln(0.4::DOUBLE)), (2, 1, 1, 0, 0.0)) UNION ALL SELECT 1, CAST((SELECT sum(len(tokens) - 1) + 3 FROM lex) AS BIGINT), -1, -1, 0.0)
SELECT src, dst, ilabel, olabel, round(score, 6) AS score FROM a""")
def lexicon_arcs_sil(spark: SparkSession, sf_dir: str) -> DataFrame:
    lex = lexicon(spark, sf_dir)
    return O.lexicon_arcs_sil(lex, *symbols(lex, spark), p=0.4).withColumn("score", F.round("score", 6))


@query(f"""WITH {LEX}, {SYM}, a AS (SELECT CAST(CASE WHEN i = 1 THEN 0 ELSE off + i - 1 END AS BIGINT) AS src, CAST(CASE WHEN i < n THEN off + i ELSE 0 END AS BIGINT) AS dst, t.id AS ilabel, CASE WHEN i = 1 THEN ord ELSE 0 END AS olabel FROM x JOIN t ON t.symbol = x.tok)
SELECT src, dst, ilabel, olabel FROM a UNION ALL SELECT DISTINCT src, src, 7, 9 FROM a WHERE olabel <> 0 UNION ALL SELECT 0, CAST((SELECT sum(len(tokens) - 1) + 1 FROM lex) AS BIGINT), -1, -1""")
def add_self_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    lex = lexicon(spark, sf_dir)
    return O.lexicon_arcs(lex, *symbols(lex, spark), loops=(7, 9)).drop("score")


def grams_sql(order: int) -> str:
    parts = " UNION ALL ".join(f"SELECT {n} AS n, unnest(list_transform(range(1, len(v) - {n} + 2), lambda i: {{'h': array_to_string(list_slice(v, i, i + {n} - 2), ' '), 'w': v[i + {n} - 1], 'c': {'NULL::VARCHAR' if n == order else 'CASE WHEN i > 1 THEN v[i - 1] END'}}})) AS g FROM m" for n in range(1, order + 1))
    return f"""m AS MATERIALIZED (SELECT list_concat(list_concat(['<s>'], words), ['</s>']) AS v FROM lines), gr AS MATERIALIZED ({parts}),
cnt AS MATERIALIZED (SELECT n, g.h AS hist, g.w AS w, count(*) AS c, count(DISTINCT g.c) AS contexts FROM gr GROUP BY ALL),
dis AS MATERIALIZED (SELECT n, count(*) FILTER (c = 1) AS n1, count(*) FILTER (c = 2) AS n2, CASE WHEN n = 1 THEN 0 ELSE greatest(0.1::DOUBLE, count(*) FILTER (c = 1)) / (count(*) FILTER (c = 1) + 2 * count(*) FILTER (c = 2)) END AS d FROM cnt GROUP BY n),
tot AS MATERIALIZED (SELECT cnt.*, d, sum(c) OVER (PARTITION BY cnt.n, hist) AS total, sum(contexts) OVER (PARTITION BY cnt.n, hist) AS stars FROM cnt JOIN dis USING (n)),
pr AS MATERIALIZED (SELECT n, hist, w, c, contexts, CASE WHEN n = {order} OR stars = 0 THEN greatest(c - d, 0) / total ELSE greatest(contexts - d, 0) / stars END AS f FROM tot),
kid AS MATERIALIZED (SELECT n, hist, w, f, CASE WHEN n = 2 THEN '' ELSE regexp_replace(hist, '^[^ ]+ ', '') END AS tail FROM pr WHERE n > 1),
su AS MATERIALIZED (SELECT k.n, k.hist, sum(k.f) AS sf, sum(l.f) AS sl FROM kid k JOIN pr l ON l.n = k.n - 1 AND l.hist = k.tail AND l.w = k.w GROUP BY k.n, k.hist),
bo AS MATERIALIZED (SELECT pr.*, CASE WHEN pr.n < {order} AND pr.w <> '</s>' AND sl < 1 - 1e-9 THEN (1 - sf) / (1 - sl) END AS bow FROM pr LEFT JOIN su ON su.n = pr.n + 1 AND su.hist = CASE WHEN pr.n = 1 THEN pr.w ELSE pr.hist || ' ' || pr.w END)"""


@query(f"WITH {grams_sql(3)} SELECT n, hist, w, c, contexts FROM cnt", "lines")
def ngram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.ngram_counts(V.lines(spark, sf_dir), 3).withColumn("hist", F.array_join("hist", " "))


@query(f"WITH {grams_sql(3)} SELECT n, n1, n2, round(d, 6) AS d FROM dis", "lines")
def kn_discounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.kn_discounts(L.ngram_counts(V.lines(spark, sf_dir), 3)).withColumn("d", F.round("d", 6))


@query(f"WITH {grams_sql(3)} SELECT n, hist, w, round(f, 6) AS f FROM pr", "lines")
def kn_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.kn_table(V.lines(spark, sf_dir), 3, weights=False).select("n", F.array_join("hist", " ").alias("hist"), "w", F.round("f", 6).alias("f"))


@query(f"WITH {grams_sql(3)} SELECT n, hist, w, round(f, 6) AS f, round(bow, 6) AS bow FROM bo", "lines")
def kn_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.kn_table(V.lines(spark, sf_dir), 3).select("n", F.array_join("hist", " ").alias("hist"), "w", F.round("f", 6).alias("f"), F.round("bow", 6).alias("bow"))


def model(spark: SparkSession, sf_dir: str, upto: int = ORDER) -> DataFrame:
    """The corpus model, of it the orders ``upto``."""
    m = L.kn_model(V.lines(spark, sf_dir), ORDER)
    return staged(m if upto == ORDER else m.where(F.col("n") <= upto), *m.reads)


LG = """lg AS MATERIALIZED (SELECT n, hist, w, CASE WHEN f > 1e-99 THEN log10(f) ELSE -99 END AS p, CASE WHEN bow IS NOT NULL THEN CASE WHEN bow > 1e-99 THEN log10(bow) ELSE -99 END END AS b FROM bo),
u AS MATERIALIZED (SELECT w, p, b FROM lg WHERE n = 1), bi AS MATERIALIZED (SELECT hist AS h, w, hist || ' ' || w AS g, p, b FROM lg WHERE n = 2), tri AS MATERIALIZED (SELECT hist AS h, w, p FROM lg WHERE n = 3)"""
BENCH = r"bench AS (SELECT item_id AS line, list_filter(regexp_split_to_array(text, '[ \t\r\n]+'), lambda w: w <> '') AS words FROM benchmark)"
#: Scores of q (a: null in a bigram, h, w): the longest gram there is, else the history's back-off and a shorter one.
SCORED = """z AS (SELECT q.*, coalesce(CASE WHEN a IS NOT NULL THEN tri.p END, CASE WHEN a IS NOT NULL THEN coalesce(bh.b, 0) ELSE 0 END + coalesce(bi.p, coalesce(hu.b, 0) + u.p)) AS s
  FROM q LEFT JOIN tri ON tri.h = a || ' ' || q.h AND tri.w = q.w LEFT JOIN bi bh ON bh.h = a AND bh.w = q.h LEFT JOIN bi ON bi.h = q.h AND bi.w = q.w LEFT JOIN u AS hu ON hu.w = q.h LEFT JOIN u ON u.w = q.w)"""


@query(f"""WITH {grams_sql(3)}, {BENCH}, need AS MATERIALIZED (SELECT DISTINCT unnest(words) AS w FROM bench), {LG.replace("FROM bo)", "FROM bo SEMI JOIN need USING (w))")}, q AS MATERIALIZED (SELECT DISTINCT words[i] AS a, words[i + 1] AS h, words[i + 2] AS w FROM (SELECT words, unnest(range(1, len(words) - 1)) AS i FROM bench)), {SCORED}
SELECT a, h, w, round(s, 6) AS log_p FROM z""", "lines")
def lm_logp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct word triples of the benchmark texts under the corpus model."""
    b = V.table(spark, sf_dir, "benchmark").select(X.words(F.col("text")).alias("v")).where(F.size("v") > 2)
    triples = F.transform(F.sequence(F.lit(1), F.size("v") - 2), lambda i: F.slice("v", i, F.lit(3)))
    q = b.select(F.explode(triples).alias("ngram")).distinct()
    m = L.kn_model(V.lines(spark, sf_dir), ORDER)
    scored = L.lm_logp(q, m, ORDER)
    discard(*m.reads)
    return scored.select(*[F.col("ngram")[i].alias(x) for i, x in enumerate("ahw")], F.round("log_p", 6).alias("log_p"))


@query(f"""WITH {grams_sql(3)}, {LG}, {BENCH}, v AS (SELECT line, list_concat(list_concat(['<s>'], words), ['</s>']) AS v FROM bench),
q AS (SELECT line, CASE WHEN i > 1 THEN v[i - 1] END AS a, v[i] AS h, v[i + 1] AS w FROM (SELECT line, v, unnest(range(1, len(v))) AS i FROM v)), {SCORED}
SELECT line, count(*) AS n, round(sum(s), 6) AS log_p FROM z GROUP BY line""", "lines")
def lm_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = V.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("line"), X.words(F.col("text")).alias("words"))
    m = L.kn_model(V.lines(spark, sf_dir), ORDER)
    scored = L.lm_sentence(b, m, ORDER)
    discard(*m.reads)
    return scored.select("line", "n", F.round("log_p", 6).alias("log_p"))


@query(f"""WITH {grams_sql(3)}, {LG} SELECT w AS hist, round(p, 6) AS log_joint FROM u WHERE w <> '</s>'
UNION ALL SELECT g AS hist, round((SELECT p FROM u WHERE w = '</s>') + p, 6) FROM bi WHERE h = '<s>' AND w <> '</s>' UNION ALL SELECT g, round(u.p + bi.p, 6) FROM bi JOIN u ON u.w = bi.h WHERE bi.h <> '<s>' AND bi.w <> '</s>'""", "lines")
def lm_joint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Joint probability of every history of one and of two words (that of <s> alone keeps its own value)."""
    m = model(spark, sf_dir, ORDER - 1)  # no prefix of such a history is longer
    h = m.where("w <> '</s>'").select(F.concat("hist", F.array("w")).alias("hist"))
    return L.lm_joint(h, m, ORDER).select(F.array_join("hist", " ").alias("hist"), F.round("log_joint", 6).alias("log_joint"))


def _lg(x: str) -> str:
    return f"CASE WHEN {x} > 0 THEN log10({x}) END"


def _dropped(rows: str) -> str:
    """Rows (h, w, p, low, bow, lj) of one order with what their removal costs."""
    return f"""(SELECT *, -pow(10, lj) * (pow(10, p) * (low + ne - p) + num * (ne - coalesce(bow, 0))) AS delta FROM (SELECT *, {_lg("num + pow(10, p)")} - {_lg("den + pow(10, low)")} AS ne FROM (
  SELECT *, 1 - sum(pow(10, p)) OVER (PARTITION BY h) AS num, 1 - sum(pow(10, low)) OVER (PARTITION BY h) AS den FROM ({rows}))))"""


#: One order at a time, each a table: trigrams, then bigrams that are no live histories, then back-off weights from low to high.
PRUNED = f"""e AS (SELECT p FROM u WHERE w = '</s>'),
r3 AS MATERIALIZED (SELECT tri.h, tri.w, tri.p, bi.p AS low, hb.b AS bow, CASE WHEN hb.h = '<s>' THEN (SELECT p FROM e) ELSE hu.p END + hb.p AS lj
  FROM tri JOIN bi hb ON hb.g = tri.h LEFT JOIN u hu ON hu.w = hb.h JOIN bi ON bi.h = hb.w AND bi.w = tri.w),
k3 AS MATERIALIZED (SELECT h, w, p FROM {_dropped("SELECT * FROM r3")} WHERE NOT coalesce(pow(10, delta) - 1 < 1e-7, false)),
r2 AS MATERIALIZED (SELECT bi.h, bi.w, bi.g, bi.p, u.p AS low, hu.b AS bow, hu.p AS lj FROM bi JOIN u ON u.w = bi.w JOIN u hu ON hu.w = bi.h),
k2 AS MATERIALIZED (SELECT h, w, g, p FROM {_dropped("SELECT * FROM r2")} WHERE NOT coalesce(pow(10, delta) - 1 < 1e-7, false) OR g IN (SELECT h FROM k3)),
b1 AS MATERIALIZED (SELECT k2.h, 1 - sum(pow(10, k2.p)) AS num, 1 - sum(pow(10, u.p)) AS den FROM k2 JOIN u ON u.w = k2.w GROUP BY k2.h),
k1 AS MATERIALIZED (SELECT u.w, u.p, {_lg("num")} - {_lg("den")} AS b FROM u LEFT JOIN b1 ON b1.h = u.w),
b2 AS MATERIALIZED (SELECT k3.h, 1 - sum(pow(10, k3.p)) AS num, 1 - sum(pow(10, coalesce(k2.p, coalesce(hu.b, 0) + u.p))) AS den
  FROM k3 LEFT JOIN k2 ON k2.h = split_part(k3.h, ' ', 2) AND k2.w = k3.w JOIN k1 u ON u.w = k3.w JOIN k1 hu ON hu.w = split_part(k3.h, ' ', 2) GROUP BY k3.h)"""


@query(f"""WITH {grams_sql(3)}, {LG}, {PRUNED}
SELECT 1 AS n, '' AS hist, w, round(p, 6) AS log_p, round(b, 6) AS log_bo FROM k1 UNION ALL
SELECT 2, k2.h, k2.w, round(p, 6), round({_lg("num")} - {_lg("den")}, 6) FROM k2 LEFT JOIN b2 ON b2.h = k2.g UNION ALL SELECT 3, h, w, round(p, 6), NULL FROM k3""", "lines")
def prune_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = L.kn_model(V.lines(spark, sf_dir), ORDER)
    p = L.prune_lm(m, ORDER, 1e-7)
    discard(*m.reads)
    return p.select("n", F.array_join("hist", " ").alias("hist"), "w", F.round("log_p", 6).alias("log_p"), F.round("log_bo", 6).alias("log_bo"))


@query(f"""WITH {grams_sql(3)}, {LG}, t0 AS MATERIALIZED (SELECT sum(pow(10, p)) AS total FROM u),
t1 AS MATERIALIZED (SELECT h AS hist, sum(pow(10, bi.p)) + pow(10, coalesce(any_value(hu.b), 0)) * ((SELECT total FROM t0) - sum(pow(10, u.p))) AS total FROM bi JOIN u ON u.w = bi.w LEFT JOIN u AS hu ON hu.w = bi.h GROUP BY h),
t2 AS MATERIALIZED (SELECT tri.h AS hist, sum(pow(10, tri.p)) + pow(10, coalesce(any_value(hb.b), 0)) * (coalesce(any_value(t1.total), 1) - sum(pow(10, bi.p))) AS total
  FROM tri JOIN bi ON bi.h = string_split(tri.h, ' ')[2] AND bi.w = tri.w LEFT JOIN bi AS hb ON hb.g = tri.h LEFT JOIN t1 ON t1.hist = string_split(tri.h, ' ')[2] GROUP BY tri.h)
SELECT hist, round(total, 6) AS total, abs(total - 1) <= 1e-6 AS ok FROM (SELECT '' AS hist, total FROM t0 UNION ALL SELECT * FROM t1 UNION ALL SELECT * FROM t2)""", "lines")
def validate_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = L.kn_model(V.lines(spark, sf_dir), ORDER)
    v = L.validate_lm(m, ORDER)
    discard(*m.reads)
    return v.select(F.array_join("hist", " ").alias("hist"), F.round("total", 6).alias("total"), "ok")


@query(f"WITH {grams_sql(3)}, {LG} SELECT n, hist, w, round(p, 7) AS log_p, round(b, 7) AS log_bo FROM lg", "lines")
def arpa_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus model written as a packed ARPA file and read again: seven decimals are kept."""
    from speechtab.sources.arpa import read_arpa, write_arpa

    path = shared_path(spark, "arpa")
    write_arpa(m := model(spark, sf_dir), path, compression="gzip")
    discard(m)  # only the file is read on
    return read_arpa(spark, path).select("n", F.array_join("hist", " ").alias("hist"), "w", F.round("log_p", 7).alias("log_p"), F.round("log_bo", 7).alias("log_bo"))
