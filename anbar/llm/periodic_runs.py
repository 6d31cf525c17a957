"""Periodic runs of words, found through string synchronising sets.

A run is a stretch of words with smallest period q that no neighbour extends, at least four
periods and six words long. All pairs of equal places would be too many; hence dyadic scales.
At scale t = 1, 2, 4 .. words the scale looks for periods q with t <= q < 2t:

* Every place has a hash of the t words from it on. A place is *synchronising* if among the
  places i .. i+t the smallest hash stands at i or at i+t. Whether it is depends on the 2t words
  from i on only, so a run repeats its synchronising places at the distance of its period, and in
  every t places there is one.
* Places whose t words have a period of t/4 or less are left out of the minimum: in such highly
  periodic regions all places would look alike, and their runs belong to smaller scales, which
  have found them already.
* Two synchronising places with equal 2t words, less than 2t apart, propose their distance as a
  period. Those of one context are more than t/4 apart, so a place has at most eight partners.
* A proposed period is extended word by word in both directions, which decides; hashes only select.

Periods below four words have no room for a scale: they are read off directly, by comparing each
word with the one 1, 2 or 3 places on. Texts of a batch are worked on side by side in one array.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence
from itertools import count
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from anbar.llm.common import WORD, table

WORDS = re.compile(WORD)
#: Shortest run: in words, and in periods.
MIN_WORDS = 6
MIN_PERIODS = 4
#: Periods below the first scale, read off directly.
DIRECT = 4
#: Words of texts that are worked on together.
TOGETHER = 1 << 17

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class Run(NamedTuple):
    start: int
    length: int
    period: int


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _A
    x = (x ^ (x >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(32))


def _stretches(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal stretches of True."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]])))
    return edges[::2], edges[1::2]


def _window_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of ``values[i : i + width]`` for every i with a whole window."""
    done, low = 1, values
    while 2 * done <= width:
        low = np.minimum(low[:-done], low[done:])
        done *= 2
    rest = width - done
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def _extended(ids: np.ndarray, at: int, period: int) -> tuple[int, int]:
    """The maximal stretch around ``at`` and ``at + period`` in which words a period apart agree."""
    end, step = at, 64
    while end + period < len(ids):
        stop = min(end + step, len(ids) - period)
        differs = np.flatnonzero(ids[end:stop] != ids[end + period : stop + period])
        if len(differs):
            end += int(differs[0])
            break
        end, step = stop, step * 2
    start, step = at, 64
    while start:
        stop = max(start - step, 0)
        differs = np.flatnonzero(ids[stop:start] != ids[stop + period : start + period])
        if len(differs):
            start = stop + int(differs[-1]) + 1
            break
        start, step = stop, step * 2
    return start, end + period


def _proposals(ids: np.ndarray, t: int, hashes: np.ndarray, known: dict) -> Iterator[tuple[int, int]]:
    """(place, period) with t <= period < 2t, from pairs of synchronising places."""
    places = len(ids) - t + 1
    if places <= t:
        return
    ranked = hashes[:places].copy()
    for (start, end), period in known.items():
        # The t words from a place on lie in a run of a small period.
        if 4 * period <= t and end - start >= t:
            ranked[start : end - t + 1] = np.iinfo(np.uint64).max
    least = _window_minimum(ranked, t + 1)
    left_out = np.uint64(np.iinfo(np.uint64).max)
    first, last = ranked[: len(least)], ranked[t : t + len(least)]
    chosen = np.flatnonzero(((first == least) | (last == least)) & (least != left_out))
    if len(chosen) < 2:
        return
    context = _mixed(hashes[chosen] * _B + hashes[chosen + t])
    order = np.lexsort((chosen, context))
    place, context = chosen[order], context[order]
    for step in range(1, len(place)):
        apart = place[step:] - place[:-step]
        near = (context[step:] == context[:-step]) & (apart < 2 * t)
        if not near.any():
            return  # partners of a context are sorted by place: later ones are farther away
        fits = np.flatnonzero(near & (apart >= t))
        yield from zip(place[fits].tolist(), apart[fits].tolist(), strict=True)


def periodic_runs(ids: np.ndarray, longest: int | None = None) -> list[tuple[int, int, int]]:
    """(start, end, period) of all stretches of at least four periods, by start and period.

    ``ids`` number the words; ``longest`` bounds the length of a text in it, if texts are joined
    by numbers that occur once.
    """
    n = len(ids)
    longest = n if longest is None else longest
    known: dict[tuple[int, int], int] = {}

    def add(start: int, end: int, period: int) -> None:
        # A stretch that also has a shorter period is that period's run, of the same extent.
        if end - start >= MIN_PERIODS * period and known.get((start, end), period) >= period:
            known[start, end] = period

    for period in range(1, min(DIRECT, n)):
        starts, ends = _stretches(ids[:-period] == ids[period:])
        for i in np.flatnonzero(ends - starts >= (MIN_PERIODS - 1) * period):
            add(int(starts[i]), int(ends[i]) + period, period)
    hashes, t = _mixed(ids.astype(np.uint64) + np.uint64(1)), 1
    while MIN_PERIODS * t <= longest:
        if t >= DIRECT:
            until: dict[int, int] = {}
            for at, period in sorted(_proposals(ids, t, hashes, known)):
                if at + period >= until.get(period, 0):
                    start, end = _extended(ids, at, period)
                    until[period] = end
                    add(start, end, period)
        if len(hashes) > t:
            hashes = _mixed(hashes[:-t] * _A + hashes[t:])
        t *= 2
    return sorted((start, end, period) for (start, end), period in known.items())


def runs_of_texts(texts: Sequence[Sequence[str]]) -> list[list[Run]]:
    """Runs of each text, by start and period. A text is a sequence of words."""
    number: dict[str, int] = defaultdict(count().__next__)
    parts, offsets, at = [], [], 0
    for i, words in enumerate(texts):
        offsets.append(at)
        parts.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
        parts.append(np.array([-1 - i]))  # ends a text; occurs once
        at += len(words) + 1
    found: list[list[Run]] = [[] for _ in texts]
    if not texts:
        return found
    starts = np.array(offsets)
    sizes = np.array([len(w) for w in texts])
    ids = np.concatenate(parts)
    for start, end, period in periodic_runs(ids, int(sizes.max())):
        if end - start >= MIN_WORDS:
            i = int(np.searchsorted(starts, start, side="right")) - 1
            found[i].append(Run(start - offsets[i], end - start, period))
    return found


def collapsed(words: Sequence[str], runs: Sequence[Run]) -> list[str]:
    """``words`` without those that some run holds after its first period."""
    drop = np.zeros(len(words), bool)
    for start, length, period in runs:
        drop[start + period : start + length] = True
    return [w for w, gone in zip(words, drop.tolist(), strict=True) if not gone]


Rewrite = Callable[[object, list[str]], list[str]]

RUNS = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in Run._fields]))
_ARROW_RUNS = pa.list_(pa.struct([(n, pa.int64()) for n in Run._fields]))


def document_runs(
    docs: DataFrame, key: str = "doc_id", text: str = "text", rewrite: Rewrite | None = None
) -> DataFrame:
    """(key, n_words, runs, collapsed): one row per row of ``docs``.

    ``runs`` are (start, length, period) in words, by start and period; ``collapsed`` is the text
    without the words that a run holds after its first period, joined by single spaces.
    ``rewrite(key, words)`` may replace the words of a text first. Null, empty and blank texts
    have no words. Keys may repeat or be null; an empty table gives no rows.
    """
    schema = T.StructType([docs.schema[key]]).add("n_words", "long").add("runs", RUNS).add("collapsed", "string")

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            start = size = 0
            held: list[list[str]] = []
            for i, one in enumerate(texts):
                words = WORDS.findall(one) if one else []
                held.append(rewrite(keys[i], words) if rewrite else words)
                size += len(words)
                if size >= TOGETHER or i + 1 == len(texts):
                    found = runs_of_texts(held)
                    columns = [
                        batch.column(0).slice(start, len(held)),
                        pa.array([len(w) for w in held], pa.int64()),
                        pa.array([[r._asdict() for r in runs] for runs in found], _ARROW_RUNS),
                        pa.array([" ".join(collapsed(w, r)) for w, r in zip(held, found, strict=True)], pa.string()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=schema.names)
                    start, size, held = i + 1, 0, []

    return docs.select(docs[key], docs[text]).mapInArrow(mapped, schema)


def repeated_in_place(key: object, words: list[str]) -> list[str]:
    """A tenth of the documents, by the CRC-32 of their id, repeat a part of themselves to the end."""
    if key is None or not words:
        return words
    h = zlib.crc32(str(key).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document as digests, with the run of most periods."""
    found = document_runs(table(spark, sf_dir, "documents"), rewrite=repeated_in_place)
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    # Runs stand by start and period: only a larger exponent takes the place of an earlier run.
    best = F.reduce(
        "runs",
        F.get("runs", F.lit(0)),
        lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best),
    )
    digests = found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best.alias("best"),
        F.sha2(F.array_join(F.transform(line, lambda x: F.concat(x, F.lit("\n"))), "").cast("binary"), 256).alias(
            "runs_sha256"
        ),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
    return digests.select(
        "doc_id",
        "n_runs",
        "best.*",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )
