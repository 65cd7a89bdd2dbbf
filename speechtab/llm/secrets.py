"""Secret scans in DataFrame functions only.

Base kinds are fixed patterns. The method adds spans of kind ``markov``: runs of at least ``MIN_TOKEN``
key characters whose log-likelihood under a character Markov model of random strings exceeds that under
a model of ordinary identifiers by more than ``MIN_LLR`` and by more than ``MIN_RATE`` for each letter and digit, that hold at least ``MIN_DISTINCT`` different letters and digits, and that overlap no base span. Runs of the shape of
a UUID are identifiers, and counting up (abcdef...) is no secret. All models are first-order over letters and digits; other characters, dates and runs of digits alone begin a new
segment and say nothing. A history's row is smoothed towards its class's own letter frequencies, so a history that a class never saw falls back to these instead of to a uniform row.
There are two models of random strings, and the likelier one counts: one of the values that base patterns mark in the whole table (as they stand, in capitals and in small letters), one
of ``DRAWS`` strings drawn at random from all letters and digits. Ordinary are the other words of about ``SAMPLE_DOCS`` documents drawn by a hash (of the id, or of the text where there is
none), and identifiers, which are words that stood together, written the ways identifiers are (with underscores, hyphens, slashes, in camel case, in capitals, numbered). Each distinct sample counts
once. The models are tables of fixed size, so they travel as literals.

Positions come from the pieces between matches: their lengths and those of the matches are summed, in blocks of matches, so that a text of very
many matches takes no square of their number.
Null and empty texts have no spans; without labelled samples no span is added. Repeated rows are
scanned each by itself. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed patterns of the base kinds, in order.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "markov")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
TOKEN = "[A-Za-z0-9+/_=-]"
NUMBER = "(?<![A-Za-z0-9])([0-9]+|[0-9]{4}-?[0-9]{2}-?[0-9]{2}[Tt_-]?[0-9]{2}-?[0-9]{2}(-?[0-9]{2})?[Zz]?)(?![A-Za-z0-9])"
UUID = "^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$"
MIN_TOKEN, MIN_LLR, MIN_DISTINCT, SAMPLE_DOCS, DRAWS, SMOOTHING = 16, 25.0, 8, 20_000, 4096, 0.5
ORDINARY, MARKED, DRAWN = range(3)
#: Least ratio for each letter and digit: long identifiers of words that the corpus lacks gather some, random strings much.
MIN_RATE = 2.2
#: Observations that a class's letter frequencies count for in each history's row.
BACK_OFF = 20.0
SPAN = "array<struct<start:bigint,kind:int,end:bigint,value:string>>"
#: Matches summed together.
BLOCK = 256
#: One word group in so many gives an identifier.
EVERY = 16


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def located(text: Column, pattern: str, kind: int, least: int = 0, group: int = 0) -> Column:
    """Spans (start, kind, end, value of ``group``) of all matches, of which ``group`` has ``least`` characters or more."""
    found = F.zip_with(
        F.transform(F.split(text, pattern, -1), F.length),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda gap, m: F.when(m.isNotNull(), F.struct(gap.cast("long").alias("gap"), F.length(m).cast("long").alias("n"), m.alias("v"))),  # none after the last piece
    )
    if group:
        found = F.zip_with(found, F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda x, v: F.when(v.isNotNull(), F.struct(x["gap"].alias("gap"), x["n"].alias("n"), v.alias("v"))))
    span = lambda start, x, at: F.struct(start.alias("start"), F.lit(kind).alias("kind"), (at + x["gap"] + x["n"]).alias("end"), x["v"].alias("value"))
    zero, none = F.lit(0).cast("long"), F.array().cast(SPAN)
    step = lambda acc, x: F.struct((acc["at"] + x["gap"] + x["n"]).alias("at"), F.concat(acc["out"], F.array(span(acc["at"] + x["gap"], x, acc["at"]))).alias("out"))
    block = lambda found, i: F.aggregate(F.slice(found, i * BLOCK + 1, F.lit(BLOCK)), F.struct(zero.alias("at"), none.alias("out")), step)
    blocks = lambda found: F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / BLOCK).cast("int")), lambda i: block(found, i))
    shift = lambda at, s: F.struct((s["start"] + at).alias("start"), s["kind"].alias("kind"), (s["end"] + at).alias("end"), s["value"].alias("value"))
    joined_ = F.aggregate(
        let(F.filter(found, lambda x: x.isNotNull()), blocks),
        F.struct(zero.alias("at"), F.array().cast(f"array<{SPAN}>").alias("out")),
        lambda acc, b: F.struct((acc["at"] + b["at"]).alias("at"), F.concat(acc["out"], F.array(F.transform(b["out"], lambda s: shift(acc["at"], s)))).alias("out")),
        lambda acc: F.flatten(acc["out"]),
    )
    return F.when(text.rlike(pattern), F.filter(joined_, lambda s: F.length(s["value"]) >= max(1, least))).otherwise(none)


def base_spans(text: Column) -> list[Column]:
    return [located(text, ASSIGN, 0, 6, 2), located(text, ACCESS, 1), located(text, HEX, 2)]


def codes(token: Column) -> Column:
    """Places of a token's characters in the alphabet, from 1; 0 for others, and for numbers and dates, which end a segment."""
    return F.transform(F.split(F.regexp_replace(token, NUMBER, "-"), ""), lambda c: F.position(c, F.lit(ALPHABET)))


def identifiers(words: Column) -> Column:
    """Identifiers of three words that stand together, one for each ``EVERY`` words, in eight ways of writing by turns."""
    cap = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1000)))
    at = lambda i, k: F.get(words, i * EVERY + k)
    ways = lambda i: F.array(
        F.concat_ws("_", at(i, 0), at(i, 1), at(i, 2)),
        F.concat_ws("-", at(i, 0), at(i, 1), at(i, 2)),
        F.concat_ws("/", at(i, 0), at(i, 1), at(i, 2)),
        F.concat(F.lower(at(i, 0)), cap(at(i, 1)), cap(at(i, 2))),
        F.concat(cap(at(i, 0)), cap(at(i, 1)), cap(at(i, 2))),
        F.upper(F.concat_ws("_", at(i, 0), at(i, 1), at(i, 2))),
        F.concat(F.concat_ws("_", at(i, 0), at(i, 1)), (i % 100).cast("string")),
        F.concat(F.concat_ws("-", at(i, 0), at(i, 1)), F.lit("-"), (2000 + i % 30).cast("string")),
    )
    places = F.when(F.size(words) >= 3, F.sequence(F.lit(0), F.floor((F.size(words) - 3) / EVERY).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.get(ways(i), F.pmod(F.xxhash64(at(i, 0), at(i, 1)), F.lit(8)).cast("int")))


def labelled_samples(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, draws: int = DRAWS) -> DataFrame:
    """token, class, each once: base values of all documents and random draws; words outside base spans and identifiers of such words, of a sample."""
    n = max(1, docs.count())
    grain = 1 << 40
    draw = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), "text"), F.lit("sample")), F.lit(grain))
    some = docs.where((draw < int(min(1.0, sample_docs / n) * grain) + 1) & F.col("text").isNotNull()).select("text")
    values = docs.select(F.explode(F.flatten(F.array(*base_spans(F.col("text"))))).alias("span")).select(F.lit(MARKED).alias("class"), F.explode(F.array("span.value", F.upper("span.value"), F.lower("span.value"))).alias("token"))
    cleared = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), ACCESS, " "), HEX, " ")
    words = some.select(F.regexp_extract_all(cleared, F.lit(TOKEN + "{4,}"), F.lit(0)).alias("words"))
    words = words.withColumn("letters", F.filter("words", lambda w: w.rlike("^[A-Za-z]+$")))
    plain = words.select(F.explode(F.concat("words", identifiers(F.col("letters")))).alias("token")).select(F.lit(ORDINARY).alias("class"), "token")
    drawn = docs.sparkSession.range(draws).select(F.lit(DRAWN).alias("class"), F.base64(F.unhex(F.sha2(F.concat(F.lit("draw-"), "id").cast("binary"), 256))).alias("token"))
    return values.unionByName(plain).distinct().unionByName(drawn)


def fit(samples: DataFrame, smoothing: float = SMOOTHING, back_off: float = BACK_OFF) -> list[list[float]]:
    """For each model of random strings the log-likelihood ratios of each (previous, next) character, row by row; previous 0 is a segment's start, next 0 says nothing."""
    k = len(ALPHABET) + 1
    steps = F.zip_with(F.concat(F.array(F.lit(0)), "c"), F.col("c"), lambda a, b: F.when(b > 0, a * k + b))
    counted = samples.select("class", codes(F.col("token")).alias("c")).select("class", F.explode(steps).alias("step")).where("step is not null").groupBy("class", "step").count()
    counts = {(r["class"], r["step"]): r["count"] for r in counted.collect()}  # at most 3 * k * k rows

    def rows(kind: int) -> list[list[float]]:
        row = [[counts.get((kind, prev * k + x), 0) for x in range(1, k)] for prev in range(k)]
        letters = [sum(r[x] for r in row) + smoothing for x in range(k - 1)]
        share = [v / sum(letters) for v in letters]
        return [[math.log((c + back_off * q) / (sum(r) + back_off)) for c, q in zip(r, share)] for r in row]

    kinds = sorted({kind for kind, _ in counts})
    if kinds[:1] != [ORDINARY]:
        return []
    plain = rows(ORDINARY)
    return [[x for a, b in zip(rows(kind), plain) for x in [0.0, *(p - q for p, q in zip(a, b))]] for kind in kinds[1:]]


def llr(token: Column, models: list[list[float]]) -> Column:
    """Log-likelihood ratio of a token: the likelier model of random strings against ordinary ones; 0 without models."""
    if not models:
        return F.lit(0.0)
    k = len(ALPHABET) + 1
    tables = [F.split(F.lit(",".join(f"{x:.4f}" for x in m)), ",").cast("array<double>") for m in models]  # each folded to one literal
    sums = [f"s{i}" for i in range(len(models))]
    start = F.struct(F.lit(0).alias("prev"), *(F.lit(0.0).alias(s) for s in sums))
    step = lambda acc, x: F.struct(x.alias("prev"), *((acc[s] + F.get(t, acc["prev"] * k + x)).alias(s) for s, t in zip(sums, tables)))
    return F.aggregate(codes(token), start, step, lambda acc: F.array_max(F.array(*(acc[s] for s in sums))))


def varied(token: Column) -> Column:
    """Whether a token holds enough different letters and digits, seldom counts up or down by one, and is no UUID."""
    plain = F.split(F.regexp_replace(token, "[^A-Za-z0-9]", ""), "")
    counting = lambda v: F.size(F.filter(F.zip_with(v, F.slice(v, 2, F.size(v)), lambda a, b: F.abs(F.ascii(a) - F.ascii(b)) == 1), lambda x: x)) * 2 >= F.size(v)
    return (F.size(F.array_distinct(plain)) >= MIN_DISTINCT) & ~let(plain, counting) & ~token.rlike(UUID)


def joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, models: list[list[float]], min_llr: float = MIN_LLR) -> DataFrame:
    """doc_id, base, added: arrays of spans (start, kind, end, value), base spans by start then kind."""
    t = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    a, b, c = base_spans(F.col("text"))
    t = t.select("doc_id", F.array_sort(F.concat(a, b, c)).alias("base"), located(F.col("text"), TOKEN + f"{{{MIN_TOKEN},}}", 3).alias("runs"))
    free = F.filter("runs", lambda r: ~F.exists("base", lambda s: (s["start"] < r["end"]) & (r["start"] < s["end"])))
    return t.select("doc_id", "base", F.filter(free, lambda r: varied(r["value"]) & (llr(r["value"], models) > F.greatest(F.lit(min_llr), MIN_RATE * F.length(F.regexp_replace(r["value"], "[^A-Za-z0-9]", ""))))).alias("added"))


def find_secrets(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, min_llr: float = MIN_LLR) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov: fit on the sample, scan every whole text."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = scan(docs, fit(labelled_samples(docs, sample_docs)), min_llr)
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        n(0).alias("n_assign"),
        n(1).alias("n_access"),
        n(2).alias("n_hex"),
        F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        joined(F.array_sort(F.concat("base", "added"))).alias("spans"),
        F.size("added").cast("long").alias("n_markov"),
    )
