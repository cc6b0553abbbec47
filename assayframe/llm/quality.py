"""Quality rules: a learned decision list over text statistics, applied as Spark conditional expressions.

Sequential covering: a rule is grown one threshold condition at a time by information gain on one part of the
labelled rows, pruned from its end on the other part, kept if it is precise enough, and the rows that it covers
are set aside before the next. The rules reject; what no rule covers is kept.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a fit sees at most; they are those of the least hash, so every size is treated alike.
MAX_LABELLED = 20_000
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_marks", "n_distinct", "n_lone")
#: Statistics per word, letter or line: what conditions are on.
FEATURES = {
    "n_words": "cast(n_words as double)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(n_letters, 1)",
    "letter_share": "n_letters / greatest(word_chars, 1)",
    "mark_share": "n_marks / greatest(n_words, 1)",
    "distinct_share": "n_distinct / greatest(n_words, 1)",
    "lone_share": "n_lone / greatest(n_words, 1)",
    "line_words": "n_words / greatest(n_lines, 1)",
}
_SPACES = re.compile(r"[ \t-\r]")
_SYMBOLS = re.compile(r"[#*$%&|<>]")
_LETTERS = re.compile(r"[^\W\d_]")
_UPPER = re.compile(r"[A-Z]")
_MARKS = re.compile(r"[!?]")


def text_stats(text: str | None) -> tuple[int, ...]:
    """The statistics of one whole text, in the order of STATS."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    if not n:
        return (0, 0, len(_SYMBOLS.findall(text)), 0, 0, 0, 0, 0, len(_MARKS.findall(text)), 0, 0)
    seen: set[str] = set()
    lines = dups = 0
    for line in text.split("\n"):
        if line and _has_word(line):
            lines += 1
            if line in seen:
                dups += 1
            else:
                seen.add(line)
    known: dict[bytes, int] = {}
    codes = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    repeat = 0
    if n > 3:
        pair = codes[:-1] * len(known) + codes[1:]
        _, pair = np.unique(pair, return_inverse=True)  # small again, so that no product overflows
        _, where, count = np.unique(pair[:-1] * len(known) + codes[2:], return_inverse=True, return_counts=True)
        again = count[where] > 1
        covered = np.zeros(n, bool)
        for shift in range(3):
            covered[shift : n - 2 + shift] |= again
        repeat = int(covered.sum())
    return (
        n,
        len(text) - len(_SPACES.findall(text)),
        len(_SYMBOLS.findall(text)),
        dups,
        repeat,
        lines,
        len(_UPPER.findall(text)),
        len(_LETTERS.findall(text)),
        len(_MARKS.findall(text)),
        len(known),
        sum(1 for w in words if len(w) == 1),
    )


def _has_word(line: str) -> bool:
    return bool(line.strip(" \t\n\r\x0b\x0c"))


def stats(docs: DataFrame) -> DataFrame:
    """doc_id and STATS of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([text_stats(t.as_py()) for t in batch.column("text")], np.int64).reshape(-1, len(STATS))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(rows[:, i]) for i in range(len(STATS)))], names=["doc_id", *STATS]
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, " + ", ".join(f"{s} long" for s in STATS)
    )


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature, ``<=`` or ``>``, threshold) that rejects."""

    conditions: tuple[tuple[str, str, float], ...]

    def covers(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for feature, sign, at in self.conditions:
            out &= (x[feature] <= at) if sign == "<=" else (x[feature] > at)
        return out

    def sql(self) -> str:
        return " AND ".join(f"({FEATURES[f]}) {sign} {at!r}D" for f, sign, at in self.conditions)


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, most: int = 4, cuts: int = 48) -> Rule:
    """Adds the condition of the best gain on bad rows until no good row is covered."""
    covered, conditions = np.ones(len(bad), bool), []
    while len(conditions) < most and (covered & ~bad).any():
        p, n = int((covered & bad).sum()), int((covered & ~bad).sum())
        before, best = math.log2(p / (p + n)), (1e-9, None)
        for feature, values in x.items():
            own, own_bad = values[covered], bad[covered]
            for at in np.unique(np.quantile(own, np.linspace(0, 1, cuts + 2)[1:-1], method="lower")):
                low = own <= at
                for sign, take in (("<=", low), (">", ~low)):
                    p1 = int((take & own_bad).sum())
                    if p1:
                        gain = p1 * (math.log2(p1 / int(take.sum())) - before)
                        if gain > best[0]:
                            best = (gain, (feature, sign, float(at)))
        if best[1] is None:
            break
        feature, sign, at = best[1]
        own = x[feature][covered]
        at = (float(own[own <= at].max()) + float(own[own > at].min())) / 2 if (own > at).any() else at  # midway between neighbours
        # A tighter condition of the same kind takes the place of the wider one.
        conditions = [c for c in conditions if c[:2] != (feature, sign)] + [(feature, sign, at)]
        covered &= (x[feature] <= at) if sign == "<=" else (x[feature] > at)
    return Rule(tuple(conditions))


def _precision(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> tuple[float, int]:
    covered = rule.covers(x)
    p, n = int((covered & bad).sum()), int((covered & ~bad).sum())
    return (p - n) / max(1, p + n), p


def learn(x: dict[str, np.ndarray], bad: np.ndarray, max_rules: int = 12, least: float = 0.9, support: int = 5) -> list[Rule]:
    """Sequential covering. Every third row prunes, the others grow. ``least``: precision that a rule must show on both
    parts; ``support``: bad rows that it must cover while growing."""
    n = len(bad)
    prune = np.arange(n) % 3 == 2
    left, rules = np.ones(n, bool), []
    while len(rules) < max_rules:
        grow_rows, prune_rows = left & ~prune, left & prune
        if int((grow_rows & bad).sum()) < support:
            break
        gx, gb = {f: v[grow_rows] for f, v in x.items()}, bad[grow_rows]
        px, pb = {f: v[prune_rows] for f, v in x.items()}, bad[prune_rows]
        rule = _grow(gx, gb)
        if not rule.conditions:
            break
        shorter = [Rule(rule.conditions[:k]) for k in range(len(rule.conditions), 0, -1)]
        rule = max(shorter, key=lambda r: _precision(r, px, pb))
        share, caught = _precision(rule, gx, gb)
        seen, _ = _precision(rule, px, pb)
        if caught < support or (share + 1) / 2 < least or (pb.any() and rule.covers(px).any() and (seen + 1) / 2 < least):
            break
        rules.append(rule)
        left &= ~rule.covers(x)
    return rules


def fit(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> list[Rule]:
    """Rules from ``labels`` (doc_id, quality 0 or 1) and the statistics of those documents.

    Null labels and ids are left out; of a repeated label or document all rows count. No labels: no rules.
    """
    chosen = (
        labels.where("doc_id is not null and quality is not null")
        .select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "quality")
        .limit(limit)
    )
    # At most ``limit`` label rows: a proven bound for the broadcasts.
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(
        F.broadcast(chosen.select("doc_id").distinct()), "doc_id", "left_semi"
    )
    rows = (
        stats(known)
        .join(F.broadcast(chosen), "doc_id")
        .orderBy(F.xxhash64("doc_id"), "doc_id", "quality", *STATS)
        .limit(limit)
        .selectExpr("quality", *(f"{e} AS {f}" for f, e in FEATURES.items()))
        .toPandas()
    )
    if rows.empty:
        return []
    x = {f: rows[f].to_numpy(np.float64) for f in FEATURES}
    return learn(x, rows["quality"].to_numpy() == 0)


def base_failed() -> Column:
    return F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")


def verdict(rules: list[Rule]) -> Column:
    """The decision list: the first rule that fits rejects, the number of the rule being kept; 0 accepts."""
    out = None
    for i, rule in enumerate(rules, 1):
        test = F.expr(rule.sql())
        out = F.when(test, F.lit(i)) if out is None else out.when(test, F.lit(i))
    return F.lit(0) if out is None else out.otherwise(F.lit(0))


def judge(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> DataFrame:
    """doc_id, statistics, base_failed, kept and rule (number of the rule that rejected, 0 for none).

    Nulls: a null text has no words and fails the base; a null doc_id is carried. Empty texts fail the base, repeated
    rows each give a row, long texts are read whole. Empty tables: no rows, or no rules where there are no labels.
    Other columns are ignored.
    """
    rules = fit(docs, labels, limit)
    return (
        stats(docs)
        .withColumn("base_failed", base_failed())
        .withColumn("rule", verdict(rules))
        .withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
    )


def keep(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> DataFrame:
    """The rows of ``docs`` that :func:`judge` keeps, with all their columns."""
    rules = fit(docs, labels, limit)

    @F.pandas_udf(", ".join(f"{s} long" for s in STATS))
    def measure(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([text_stats(t) for t in text], columns=STATS)

    held = F.struct(*(F.col(c).alias(c) for c in docs.columns)).alias("row")
    measured = docs.select(held, measure("text").alias("s")).select("row", "s.*")
    return measured.where(~base_failed() & (verdict(rules) == 0)).select("row.*")
