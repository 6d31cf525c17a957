"""Quality rules: a decision list learned from labelled documents.

Fixed rules reject a text that is too short or mostly repeats itself. The rest is judged by a
decision list that sequential covering learns from labels: grow a conjunction of thresholds on
statistics of the text until it covers low-quality documents only, prune it on held-out rows,
keep it if it is still precise there, take out what it covers and go on. The list is emitted as
ordered Spark conditions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from anbar.llm.common import per_text, table, written

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
WINDOW = 8
LEAST_WORDS, REPEAT_PERCENT = 20, 30
STATS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_lines long, n_distinct long, n_upper long, n_digits long, n_marks long, n_stops long, "
    "n_chars long"
)
#: Odd factors for hashes of word windows.
FACTORS = np.random.default_rng(8).integers(1, 1 << 63, WINDOW, dtype=np.uint64) | np.uint64(1)
UPPER = np.zeros(256, bool)
UPPER[ord("A") : ord("Z") + 1] = True
DIGIT = np.zeros(256, bool)
DIGIT[ord("0") : ord("9") + 1] = True
MARK = np.zeros(256, bool)
MARK[[ord(c) for c in "!?;:,\"'()[]{}/\\=+_~^@`-"]] = True
STOP = ord(".")


def repeated_words(words: Sequence[str]) -> int:
    """Words in windows of eight words that occur twice or more in the text, all counted."""
    n = len(words)
    if n <= WINDOW:
        return 0
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.uint64, n)
    if len(number) == n:
        return 0
    windows = np.zeros(n - WINDOW + 1, np.uint64)
    for i, factor in enumerate(FACTORS):
        windows += (ids[i : n - WINDOW + 1 + i] + np.uint64(1)) * factor
    order = np.argsort(windows, kind="stable")
    sorted_windows = windows[order]
    same = sorted_windows[1:] == sorted_windows[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(windows), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    # A word is covered if one of the eight windows that hold it is repeated.
    edges = np.zeros(n + 1, np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + WINDOW, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def text_stats(texts: list[str | None]) -> Iterator[tuple]:
    """STATS of each text; null counts as empty."""
    for value in texts:
        text = value or ""
        words = WORDS.findall(text)
        lines = [x for x in text.split("\n") if WORDS.search(x)]
        chars = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
        yield (
            len(words), sum(map(len, words)), int(sum(chars[ord(c)] for c in SYMBOLS)),
            len(lines) - len(set(lines)), repeated_words(words),
            len(lines), len(set(words)), int(chars[UPPER].sum()), int(chars[DIGIT].sum()),
            int(chars[MARK].sum()), int(chars[STOP]), len(text),
        )


def _share(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(0.0)


#: What the rules may test.
FEATURES = {
    "words": lambda: F.col("n_words").cast("double"),
    "mean_word": lambda: _share("word_chars", "n_words"),
    "symbols_per_word": lambda: _share("n_symbols", "n_words"),
    "dup_line_share": lambda: _share("n_dup_lines", "n_lines"),
    "repeat_share": lambda: _share("n_repeat_words", "n_words"),
    "distinct_share": lambda: _share("n_distinct", "n_words"),
    "words_per_line": lambda: _share("n_words", "n_lines"),
    "upper_share": lambda: _share("n_upper", "n_chars"),
    "digit_share": lambda: _share("n_digits", "n_chars"),
    "marks_per_word": lambda: _share("n_marks", "n_words"),
    "stops_per_word": lambda: _share("n_stops", "n_words"),
}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = F.col(self.feature)
        return value > self.threshold if self.above else value <= self.threshold

    def holds(self, values: np.ndarray) -> np.ndarray:
        return values > self.threshold if self.above else values <= self.threshold


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    precision: float

    def column(self) -> Column:
        return reduce(lambda a, b: a & b, [c.column() for c in self.conditions])

    def __str__(self) -> str:
        parts = [f"{c.feature} {'>' if c.above else '<='} {c.threshold:.6g}" for c in self.conditions]
        return " and ".join(parts)


def _covered(conditions: Sequence[Condition], x: dict[str, np.ndarray], n: int) -> np.ndarray:
    held = np.ones(n, bool)
    for c in conditions:
        held &= c.holds(x[c.feature])
    return held


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, most: int) -> list[Condition]:
    """Add the condition with the highest information gain until no good row is covered."""
    chosen: list[Condition] = []
    held = np.ones(len(bad), bool)
    while len(chosen) < most and (held & ~bad).any():
        p0, n0 = (held & bad).sum(), (held & ~bad).sum()
        if not p0:
            break
        before = np.log2(p0 / (p0 + n0))
        best: tuple[float, Condition | None] = (1e-9, None)
        for name in sorted(x):
            values, target = x[name][held], bad[held]
            order = np.argsort(values, kind="stable")
            v, t = values[order], target[order]
            ends = np.flatnonzero(v[1:] != v[:-1])  # a threshold lies between different values
            if not len(ends):
                continue
            below_p = np.cumsum(t)[ends].astype(float)
            below_n = (ends + 1) - below_p
            middle = (v[ends] + v[ends + 1]) / 2
            for above in (False, True):
                p = p0 - below_p if above else below_p
                n = n0 - below_n if above else below_n
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(p / (p + n)) - before), -1.0)
                i = int(gain.argmax())
                if gain[i] > best[0]:
                    best = (gain[i], Condition(name, above, float(middle[i])))
        if best[1] is None:
            break
        chosen.append(best[1])
        held &= best[1].holds(x[best[1].feature])
    return chosen


def _prune(conditions: list[Condition], x: dict[str, np.ndarray], bad: np.ndarray) -> list[Condition]:
    """The start of the conjunction with the best (bad - good) / covered on held-out rows."""
    best, kept = -2.0, conditions
    for k in range(1, len(conditions) + 1):
        held = _covered(conditions[:k], x, len(bad))
        if held.any():
            value = (2.0 * bad[held].sum() - held.sum()) / held.sum()
            if value >= best:
                best, kept = value, conditions[:k]
    return kept


def learn_rules(
    x: dict[str, np.ndarray],
    bad: np.ndarray,
    precision: float = 0.9,
    most_rules: int = 20,
    most_conditions: int = 4,
    least_rows: int = 5,
    seed: int = 6,
) -> list[Rule]:
    """Sequential covering: ordered conjunctions that find ``bad`` rows.

    Two thirds of the rows grow a rule, the others prune it. A rule stays if on both it covers
    at least ``precision`` bad rows; covering ends with the first rule that does not, or that
    covers fewer than ``least_rows``.
    """
    bad = np.asarray(bad, bool)
    left = np.ones(len(bad), bool)
    rng = np.random.default_rng(seed)
    rules: list[Rule] = []
    while len(rules) < most_rules and (left & bad).any():
        grow = left & (rng.random(len(bad)) < 2 / 3)
        hold = left & ~grow
        conditions = _grow({k: v[grow] for k, v in x.items()}, bad[grow], most_conditions)
        if not conditions:
            break
        held_out = {k: v[hold] for k, v in x.items()}
        conditions = _prune(conditions, held_out, bad[hold])
        covered = _covered(conditions, x, len(bad)) & left
        reached = [bad[covered & part].mean() for part in (grow, hold) if (covered & part).any()]
        if covered.sum() < least_rows or min(reached, default=0.0) < precision:
            break
        rules.append(Rule(tuple(conditions), float(bad[covered].mean())))
        left &= ~covered
    return rules


def document_stats(
    docs: DataFrame, key: str = "doc_id", text: str = "text", also: Sequence[str] = ()
) -> DataFrame:
    """Statistics, features and ``base_failed`` of every document, with its columns ``also``."""
    stats = per_text(docs, key, text, STATS, text_stats, also)
    too_short = F.col("n_words") < LEAST_WORDS
    repeats = 100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")
    return stats.withColumns(
        {name: make() for name, make in FEATURES.items()} | {"base_failed": too_short | repeats}
    )


def learned_from(
    stats: DataFrame, labels: DataFrame, key: str = "doc_id", fit_rows: int = 20_000, **settings
) -> list[Rule]:
    """Rules from the labelled documents that pass the base rules.

    ``fit_rows`` bounds the labelled rows taken to the driver; beyond it, those with the
    smallest hashed ids are used, and a bar on the hash keeps the others on the executors.
    Null labels are left out; without labels there are no rules.
    """
    known = labels.where("quality is not null").groupBy(key).agg(F.min("quality").alias("quality"))
    rows = stats.where(~F.col("base_failed")).join(known, key)
    order = F.xxhash64(F.lit("fit"), key)
    labelled = rows.count()
    if labelled > fit_rows:
        place = F.shiftrightunsigned(order, 11) / F.lit(float(1 << 53))
        rows = rows.where(place < 1.2 * fit_rows / labelled)
    rows = rows.orderBy(order, key).limit(fit_rows).select("quality", *FEATURES).toPandas()
    x = {name: rows[name].to_numpy(float) for name in FEATURES}
    return learn_rules(x, rows["quality"].to_numpy() == 0, **settings)


def verdict(rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(kept, number of the deciding rule): conditions in order; 0 is the base rules, null none."""
    decided = F.when(F.col("base_failed"), 0)
    for i, rule in enumerate(rules, 1):
        decided = decided.when(rule.column(), i)
    decided = decided.cast("int")
    return decided.isNull(), decided


def judged(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    also: Sequence[str] = (),
    **settings,
) -> DataFrame:
    """``document_stats`` with ``kept`` and ``rule``, learned from ``labels``."""
    stats = written(document_stats(docs, key, text, also))
    kept, rule = verdict(learned_from(stats, labels, key, **settings))
    return stats.withColumns({"kept": kept, "rule": rule})


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return judged(docs, labels).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "rule",
    )
