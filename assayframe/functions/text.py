"""Text expressions: tokens, overlap, sentences and the exact Unicode token set."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The token pattern in Java's syntax and in Python's.
TOKEN = r"[\p{L}\p{N}]+(?:['’][\p{L}\p{N}]+)*"
_EXACT = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
#: White space as Python's strings know it, which is one definition for all that follows.
SPACE = "[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
OTHER = SPACE.replace("[", "[^", 1)
_SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
#: A sentence ends after its marks and closing quotes where white space or the end follows, or at line ends.
BOUNDARY = rf"""([.!?]["')\]]*)(?:{SPACE}+|\z)|\n+"""
_BOUNDARY = re.compile(BOUNDARY.replace(r"\z", r"\Z"))
#: Cuts are marked by CUT; where a text holds the mark's first character, that is written as ESCAPED meanwhile.
MARK, CUT, ESCAPED = "\u0001", "\u0001c", "\u0001e"


def tokens(text: Column) -> Column:
    """Distinct lower-case tokens, all in the JVM."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)))


def exact_tokens(text: Column) -> Column:
    """Distinct tokens after NFKC and case folding, which Spark has no function for."""

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: sorted({m[0] for m in _EXACT.finditer(unicodedata.normalize("NFKC", t or "").casefold())}))

    return run(text)


def shared(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def union_size(a: Column, b: Column) -> Column:
    return F.size(F.array_union(a, b))


def overlap(common: Column, n_a: Column, n_b: Column) -> Column:
    """Shared over all tokens of two sets, from their sizes; 0 where there is no token. Equal fractions give equal doubles."""
    return F.coalesce(common / F.nullif(n_a + n_b - common, F.lit(0)), F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two arrays without repeats."""
    return overlap(shared(a, b), F.size(a), F.size(b))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(_SPACES))


def strip_left(text: Column) -> Column:
    return F.ltrim(text, F.lit(_SPACES))


def strip_right(text: Column) -> Column:
    return F.rtrim(text, F.lit(_SPACES))


def segments(text: Column) -> Column:
    """The text cut after each sentence boundary; joined again they are the text."""
    safe = F.replace(text, F.lit(MARK), F.lit(ESCAPED))
    cut = F.split(F.regexp_replace(safe, BOUNDARY, "$0" + CUT), CUT)
    return F.when(F.contains(text, F.lit(MARK)), F.transform(cut, lambda s: F.replace(s, F.lit(ESCAPED), F.lit(MARK)))).otherwise(cut)


def sentences(text: Column) -> Column:
    """Sentences in order, stripped, without empty ones."""
    return F.filter(F.transform(segments(text), strip), lambda s: s != "")


def spans(text: Column) -> Column:
    """(start, stop) of every sentence in code points of the text, without surrounding white space and empty sentences.

    Offsets need a running sum, which array functions only give in quadratic time, so one pass in Python makes them.
    """

    @F.pandas_udf("array<struct<start:int,stop:int>>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [{"start": a, "stop": b} for a, b in _spans(t or "")])

    return run(text)


def _spans(text: str):
    at = 0
    for stop in [*(m.end() for m in _BOUNDARY.finditer(text)), len(text)]:
        part = text[at:stop]
        if inner := part.strip():
            start = at + len(part) - len(part.lstrip())
            yield start, start + len(inner)
        at = stop


def trim_ids(ids: Column, eos: int, pad: int) -> Column:
    """The ids before the first end or padding id."""
    ends = F.transform(F.array(F.lit(eos), F.lit(pad)), lambda e: F.array_position(ids, e))
    first = F.array_min(F.filter(ends, lambda p: p > 0))
    return F.when(first.isNull(), ids).otherwise(F.slice(ids, F.lit(1), (first - 1).cast("int")))


def words(text: Column) -> Column:
    return F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")


def leading(text: Column, n: int) -> Column:
    """The first ``n`` white-space tokens; nothing behind them is read."""
    return words(F.regexp_extract(text, rf"\A{SPACE}*+((?:{OTHER}++{SPACE}++){{0,{n - 1}}}+{OTHER}*+)", 1))


def slug(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def sanitized(error: Column, folder: str | None = None) -> Column:
    """One line of at most 500 characters, in which ``folder`` is written as <folder>."""
    line = strip(F.regexp_replace(error, f"{SPACE}+", " "))
    return F.left(F.replace(line, F.lit(folder), F.lit("<folder>")) if folder else line, F.lit(500))
