"""Personal data by weak supervision.

Base kinds are fixed patterns and always stay. Further candidates are shapes that the base rules do not take whole: digit groups,
dates, account numbers, spelt-out mail addresses, names after a title, street addresses. Every candidate gets
a vote of yes, no or nothing from nine labelers: pattern (regex), word list (gazetteer) and
neighbourhood (context) ones. Expectation-maximisation over the counts of vote patterns of all
candidates in the corpus (the patterns are at most 3^9) estimates each labeler's reliability without
labels; each starts as, and is weakly held to be, better than chance, which fixes which class is the private one. The resulting probabilities train a logistic span classifier over shape features, on the same
counted groups of candidates; candidates it takes for private at ``MIN_PROBABILITY`` or more are added as spans of
kind ``other``, unless they overlap a base span.

Null and empty texts have no spans. Without candidates nothing is added. Repeated rows are scanned each by
itself. Other columns are ignored (``redact`` keeps them).
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechtab.llm.common import map_rows, release

KINDS = ("email", "ip", "card", "phone", "other")
#: Fixed patterns; each gives the leftmost non-overlapping matches of its base kind.
AT_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
HINT = re.compile(r"[0-9@]")
#: Word lists: titles before a name, given names, words before data of a person and before numbers that are none, endings of mail domains, street words.
TITLES = "Mr Mrs Ms Dr Herr Frau Señor Señora Madame Monsieur Mme".split()
GIVEN_NAMES = frozenset("Ana Anna Carlos Claire David Elena Emma Hans James Jean John Juan Julia Karl Laura Luis Maria Marie Mary Michael Paul Peter Pierre Robert Sarah Sophie Thomas".split())
PRIVATE_WORDS = frozenset("phone tel telefon teléfono téléphone mobile call fax card visa iban ssn account konto cuenta compte ip host mail email contact born birth dob geboren address adresse".split())
OTHER_WORDS = frozenset("version section chapter page license release isbn doi item token secret password order invoice figure table number no nr updated published copyright".split())
DOMAIN_ENDINGS = frozenset("com org net edu gov io de fr es uk eu info".split())
STREETS = "Street St Avenue Ave Road Rd Lane Boulevard Straße Strasse Platz Calle Rue".split()
#: Shapes of further candidates, by name.
SHAPE = re.compile(
    r"(?P<grouped>\+?[0-9]{1,3}\x20?\([0-9]{2,4}\)\x20?[0-9]{3,4}-[0-9]{3,4}(?![0-9])|\([0-9]{3}\)\x20?[0-9]{3}-[0-9]{4}(?![0-9])|(?<![0-9.-])[0-9]{3}-[0-9]{2,3}-[0-9]{4}(?![0-9-]))"
    r"|(?P<date>(?<![0-9/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[/.][0-9]{1,2}[/.][0-9]{4})(?![0-9/-]))"
    r"|(?P<dotted>(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]))"
    r"|(?P<street>(?<![0-9])[0-9]{1,4}\x20[A-Z][a-zß]+\x20(?:" + "|".join(STREETS) + r")\b)"
    r"|(?P<number>(?<![0-9])[0-9]{9,19}(?![0-9]))"
    r"|(?P<account>\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?\b)"
    r"|(?P<mail>\b[A-Za-z0-9._-]{2,32}\x20?[(\[]?(?:\x20at\x20|at)[)\]]\x20?[A-Za-z0-9-]{2,32}\x20?[(\[]?(?:\x20dot\x20|dot)[)\]]\x20?[A-Za-z]{2,6}\b)"
    r"|(?P<name>\b(?:" + "|".join(TITLES) + r")\.?\x20[A-ZÄÖÜÉÑ][a-zäöüßéèñ]+(?:\x20[A-ZÄÖÜÉÑ][a-zäöüßéèñ]+)?)"
)
#: What a text needs to hold any candidate.
MAY_HOLD = r"[0-9]|[\])]\x20?[A-Za-z0-9-]{2,32}\x20?[(\[]?(?:\x20dot\x20|dot)|\b(?:" + "|".join(TITLES) + r")\.?\x20"
HOLDS = re.compile(MAY_HOLD)
MIN_PROBABILITY, PRIOR_VOTES, PRIOR_RIGHT, EM_ROUNDS, FIT_ROUNDS = 0.7, 10.0, 0.8, 50, 200
LABELERS, FEATURES = 9, 11


def luhn(digits: str) -> bool:
    double = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)
    return sum(int(d) if i % 2 == 0 else double[int(d)] for i, d in enumerate(reversed(digits))) % 10 == 0


def mod_97(account: str) -> bool:
    """The check of international account numbers."""
    code = account.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start."""
    out: list[tuple[int, int, int]] = []
    if not HINT.search(text):
        return out
    before = 0
    for m in AT_DOMAIN.finditer(text) if "@" in text else ():
        start = m.start()
        while start > before and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            out.append((0, start, m.end()))
            before = m.end()
    for m in IP.finditer(text):
        if all(int(x[-4:]) <= 255 and len(x.lstrip("0")) <= 3 for x in m.group().split(".")):
            out.append((1, *m.span()))
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    for m in PHONE.finditer(text) if "+" in text else ():
        if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append((3, *m.span()))
    return out


def candidates(text: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, bool, tuple[int, ...], tuple[int, ...]]]:
    """(start, end, in a base span, votes -1/0/1 of the labelers, features 0/1) of each candidate shape."""
    if not HOLDS.search(text):
        return
    ends = sorted((s, e) for _, s, e in base)
    at = 0
    for m in SHAPE.finditer(text):
        s, e = m.span()
        while at < len(ends) and ends[at][1] <= s:
            at += 1
        inside = at < len(ends) and ends[at][0] < e
        shape, value, before, after = m.lastgroup, m.group(), text[max(0, s - 40) : s], text[e : e + 24]
        digits = "".join(c for c in value if "0" <= c <= "9")
        words = [w.strip(".,:;#*%&$!|\"'()").lower() for w in before.split()[-3:]]
        private, other = any(w in PRIVATE_WORDS for w in words), any(w in OTHER_WORDS for w in words)
        octets = shape == "dotted" and all(int(x) <= 255 for x in value.split("."))
        checked = (shape == "number" and len(digits) >= 12 and luhn(digits)) or (shape == "account" and mod_97(value))
        can_check = shape == "account" or (shape == "number" and len(digits) >= 12)
        monotonous = 0 < len(set(digits)) <= 2 and shape != "street"
        known = (shape == "name" and any(w in GIVEN_NAMES for w in value.split())) or (shape == "mail" and value.rpartition(" ")[2].rpartition("]")[2].rpartition(")")[2].lower() in DOMAIN_ENDINGS)
        votes = (
            1 if shape in ("grouped", "street") else -1 if shape == "number" and len(digits) < 12 else 0,  # regex: numbers in groups, and short ones without
            (1 if octets else -1) if shape == "dotted" else 0,  # regex: four octets
            (1 if checked else -1) if can_check else 0,  # regex: check digits
            1 if shape in ("name", "mail") else 0,  # regex: a title, a spelt-out address
            1 if known else -1 if shape == "mail" else 0,  # gazetteer: given names, endings of domains
            1 if private else -1 if shape == "date" else 0,  # gazetteer: words before data of a person; a date needs one
            -1 if other else 0,  # gazetteer: words before other numbers
            1 if re.search(r"[A-Za-z0-9]@[A-Za-z0-9]|\+[0-9]", before + after) else 0,  # context: other personal data close by
            -1 if before[-1:] in ("=", ":", "\"", "/", "#") or monotonous else 0,  # context: a value, a reference, a filler
        )
        yield s, e, inside, votes, tuple(map(int, (shape == "grouped", shape == "number", shape == "date" and not private, shape in ("street", "name"), shape == "mail", octets, checked, known, private, other, votes[8] < 0)))


def tally(docs: DataFrame) -> DataFrame:
    """votes, features (strings), n: counts of candidates of all documents by vote pattern and shape features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[tuple[str, str]] = Counter()
        for b in batches:
            for t in b.column(0):
                text = t.as_py()
                if text:
                    for *_, votes, features in candidates(text, []):
                        seen["".join("-0+"[v + 1] for v in votes), "".join(map(str, features))] += 1
        keys = list(seen)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([seen[k] for k in keys], pa.int64())], ["votes", "features", "n"])
        release()

    return docs.select("text").where(F.col("text").rlike(MAY_HOLD)).mapInArrow(run, "votes string, features string, n long").groupBy("votes", "features").agg(F.sum("n").alias("n"))


def reliabilities(votes: np.ndarray, n: np.ndarray, rounds: int = EM_ROUNDS) -> tuple[np.ndarray, float, np.ndarray]:
    """Probability of each row being private, the private share of all, and each labeler's reliability (how often its votes are right), by EM.

    Where a labeler does not vote it says nothing. ``PRIOR_VOTES`` made-up votes of each labeler, ``PRIOR_RIGHT`` of them right, hold it to be
    better than chance. Before any vote the classes are even: an estimated balance would swallow the class with fewer labelers.
    """
    right = np.full(votes.shape[1], PRIOR_RIGHT)
    p = np.full(len(votes), 0.5)
    cast = (votes != 0).T @ n
    for _ in range(rounds):
        odds = votes @ np.log(right / (1 - right))
        p = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        agree = ((votes > 0) * p[:, None] + (votes < 0) * (1 - p[:, None])).T @ n
        right = (agree + PRIOR_VOTES * PRIOR_RIGHT) / (cast + PRIOR_VOTES)
    return p, float(p @ n / n.sum()), right


def train(features: np.ndarray, p: np.ndarray, n: np.ndarray, rounds: int = FIT_ROUNDS) -> np.ndarray:
    """Weights (bias last) of the logistic span classifier on the estimated probabilities."""
    x = np.column_stack([features, np.ones(len(features))])
    w, share = np.zeros(x.shape[1]), n / n.sum()
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-x @ w))
        h = (x * (share * q * (1 - q))[:, None]).T @ x + 1e-4 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (share * (q - p)) + 1e-4 * w)
        w -= np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit(docs: DataFrame) -> np.ndarray:
    """Classifier weights from the votes of all candidates in ``docs``; a few thousand counted groups come to the driver."""
    rows = sorted(docs.transform(tally).collect())
    if not rows:
        return np.append(np.zeros(FEATURES), -1.0)
    votes = np.array([["-0+".index(c) - 1 for c in r["votes"]] for r in rows])
    n = np.array([r["n"] for r in rows], float)
    p, _, _ = reliabilities(votes, n)
    return train(np.array([[int(c) for c in r["features"]] for r in rows], float), p, n)


def all_spans(text: str, w: np.ndarray) -> list[tuple[int, int, int]]:
    """Base spans and those the classifier adds, by kind, then start."""
    base = base_spans(text)
    least = np.log(MIN_PROBABILITY / (1 - MIN_PROBABILITY))
    added = [(4, s, e) for s, e, inside, _, f in candidates(text, base) if not inside and sum(a for a, x in zip(w, f) if x) + w[-1] >= least]
    return base + added


def as_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_other, n_spans."""
    w = fit(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, sha, spans = [], [], []
            for t in b.column(1):
                found = all_spans(t.as_py() or "", w)
                counts.append([sum(k == kind for k, _, _ in found) for kind in range(5)] + [len(found)])
                sha.append(hashlib.sha256(as_text([x for x in found if x[0] < 4]).encode()).hexdigest())
                spans.append(as_text(found))
            n = np.array(counts, np.int64).reshape(-1, 6)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(n[:, k]) for k in range(4)), pa.array(sha, pa.string()), pa.array(spans, pa.string()), pa.array(n[:, 4]), pa.array(n[:, 5])], names)
        release()

    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_other", "n_spans"]
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_other long, n_spans long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def redacted(text: str, w: np.ndarray) -> str:
    """The text with each span (overlapping ones as one, named by the first) replaced by its kind in angle brackets."""
    out, at = [], 0
    for start, end, kind in sorted((s, e, k) for k, s, e in all_spans(text, w)):
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind].upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]]) if out else text


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data replaced in text and n_chars, if there, set anew; all rows and columns stay."""
    w = fit(docs)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [redacted(t, w) if t else t for t in b.column(at).to_pylist()]
            yield b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))
        release()

    out = map_rows(docs, run)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
