"""Text keys: whitespace stripping, case folding, ticker and headline normal forms."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .numeric import col

#: Characters that count as blank at the ends of a text, by the rule of Python's own strip.
WHITESPACE = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())
TICKER_SUFFIX = r"\.IS$"


def strip(c: str | Column) -> Column:
    return F.btrim(col(c), F.lit(WHITESPACE))


@cache
def _folds() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """Where full case folding differs from lower case: letters with a one-letter fold, those folds, and (letter, fold) of the others."""
    single, multiple = {}, {}
    for letter in map(chr, range(sys.maxunicode + 1)):
        lower, fold = letter.lower(), letter.casefold()
        if fold != lower and len(lower) == 1 and lower not in single and lower not in multiple:
            (single if len(fold) == 1 else multiple)[lower] = fold
    return "".join(single), "".join(single.values()), tuple(multiple.items())


SHARP_S = "\u00df"


def _ranges(letters: str) -> str:
    """The inside of a character class; neighbours are one range, so that a test has few alternatives."""
    out: list[list[int]] = []
    for code in sorted(map(ord, letters)):
        if out and code == out[-1][1] + 1:
            out[-1][1] = code
        else:
            out.append([code, code])
    return "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in out)


def casefold(c: str | Column) -> Column:
    """Full Unicode case folding: lower case, then the folds that differ from it.

    Most texts are done with lower case, or with the sharp s written out: one scan for letters beyond Latin tells so. Only texts
    that hold one of the rare letters take a translate over the one-letter folds, and only those with one of the hundred or so
    longer folds (ligatures) the replacements.
    """
    letters, folds, multiple = _folds()
    lower = F.lower(col(c))
    rare = letters + "".join(letter for letter, _ in multiple if letter != SHARP_S)
    latin = "".join(letter for letter in rare if ord(letter) < 0x100)
    beyond = min(ord(letter) for letter in rare if ord(letter) >= 0x100)
    text = F.translate(lower, letters, folds)
    longer = text
    for letter, fold in multiple:
        longer = F.replace(longer, F.lit(letter), F.lit(fold))
    rarely = F.when(text.rlike(f"[{_ranges(''.join(letter for letter, _ in multiple))}]"), longer).otherwise(text)
    has_rare = lower.rlike(rf"[{_ranges(latin)}\x{{{beyond:X}}}-\x{{10FFFF}}]") & lower.rlike(f"[{_ranges(rare)}]")
    return F.when(has_rare, rarely).when(F.contains(lower, F.lit(SHARP_S)), F.replace(lower, F.lit(SHARP_S), F.lit("ss"))).otherwise(lower)


def ticker(c: str | Column, suffix: bool = True) -> Column:
    """Upper case, stripped, exchange suffix removed; a missing value becomes ''."""
    text = strip(F.upper(F.coalesce(col(c), F.lit(""))))
    return F.regexp_replace(text, TICKER_SUFFIX, "") if suffix else text


@F.arrow_udf(T.StringType())
def nfkc(text: pa.Array) -> pa.Array:
    """Compatibility normal form; Spark has no builtin for it. About a MB of an Arrow batch (a longer text alone) at a time becomes Python strings."""
    megabyte = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False), dtype=np.int64) >> 20
    cuts = [0, *(np.flatnonzero(np.diff(megabyte)) + 1).tolist(), len(text)]
    normal = lambda value: None if value is None else unicodedata.normalize("NFKC", value)
    return pa.concat_arrays([pa.array([normal(value) for value in text.slice(a, b - a).to_pylist()], pa.string()) for a, b in zip(cuts, cuts[1:])])


def headline(c: str | Column, unicode_form: bool = True) -> Column:
    """Comparable form of a headline: folded, without links and punctuation, single-spaced."""
    text = casefold(nfkc(col(c)) if unicode_form else col(c))
    text = F.regexp_replace(text, r"(?U)https?://\S+", " ")
    # Letters, numbers and underscore only: the JVM's \w would also keep combining marks.
    text = F.regexp_replace(text, r"(?U)[^\p{L}\p{N}_\s\x1c-\x1f]", " ")
    return strip(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " "))


def digest(*parts: str | Column) -> Column:
    """Fixed-width key for long text, so shuffles carry 64 characters instead of the whole text."""
    return F.sha2(F.concat_ws("|", *[col(p) for p in parts]), 256)


def iso_timestamp(c: str | Column) -> Column:
    """ISO form; the fraction appears only when it is not zero."""
    c = col(c)
    micros = F.date_format(c, "SSSSSS")
    base = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(micros == "000000", base).otherwise(F.concat_ws(".", base, micros))
