"""Column functions on texts, ids and paths."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType


@pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


#: A character that NFKC may change, alone or with its neighbours: all but ASCII and the accented Latin letters from U+00C0 to U+0131.
UNSTABLE = r"[^\x00-\x7F\x{00C0}-\x{0131}]"


def composed(col: Column) -> Column:
    """NFKC of a text; only texts with a character that it may change travel to a Python worker, nulls stand for the others there."""
    return F.coalesce(nfkc(F.when(col.rlike(UNSTABLE), col)), col)


def normalize_text(col: Column, compose: bool = True) -> Column:
    """NFKC, bracketed parts and ? ! - , to blanks, outer dots off, inner dots and white space to single blanks, upper case.

    ``compose=False`` leaves out NFKC for texts known to be stable under it, and so stays in the JVM.
    """
    t = F.regexp_replace(composed(col) if compose else col, r"\([^\)]*\)", " ")
    t = F.regexp_replace(t, r"^\.+|\.+$", "")
    t = F.regexp_replace(t, r"(?U)[?!\-,.\s]+", " ")
    return F.upper(F.trim(t))


def derive_id(path: Column) -> Column:
    """parent directory, dash, file name without its last suffix."""
    parent, name = F.regexp_extract(path, r"([^/]*)/[^/]*$", 1), F.regexp_extract(path, r"([^/]*)$", 1)
    return F.concat(parent, F.lit("-"), F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""))


def speaker_of(utterance_id: Column) -> Column:
    """The id up to its first dash."""
    return F.regexp_replace(utterance_id, r"(?s)-.*$", "")


def remap_prefix(path: Column, old: str, new: str) -> Column:
    """``path`` with prefix ``old`` replaced; a path without it is an error, as an assertion would be."""
    moved = F.concat(F.lit(new), F.substr(path, F.lit(len(old) + 1)))
    return F.when(path.isNull(), path).when(path.startswith(old), moved).otherwise(F.raise_error(F.concat(F.lit("path outside the prefix: "), path)))


def words(text: Column) -> Column:
    """Non-empty pieces between white space."""
    return F.filter(F.split(text, r"[ \t\r\n]+"), lambda w: w != "")


def after_first_field(line: Column) -> Column:
    """Drops what stands before the first blank, and it; a line without blank passes unchanged."""
    return F.regexp_replace(line, r"^[^ ]* ", "")


def collapse_repeats(arr: Column) -> Column:
    """The array without items equal to the one before; a leading empty string goes too."""
    return F.filter(arr, lambda x, i: F.when(i == 0, x.cast("string") != "").otherwise(x != F.get(arr, i - 1)))


def add_bos_eos(arr: Column, bos: str = "<s>", eos: str = "</s>") -> Column:
    return F.concat(F.array(F.lit(bos)), arr, F.array(F.lit(eos)))


def half_even(x: Column) -> Column:
    """Rounding to the nearest integer, halves to even."""
    return F.bround(x).cast("long")


def to_frames(seconds: Column, frame_shift: float = 0.01) -> Column:
    return half_even(seconds / F.lit(frame_shift))
