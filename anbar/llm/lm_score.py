"""Language-model scores by masked pseudo-likelihood.

A small network sees the two words on each side of a masked word and predicts it; the sum of
the log-probabilities of all words, each masked in turn, scores a document. For the network words
are hashed into a fixed number of buckets, and it predicts one of ``CLASSES`` classes of them on
two levels, a group of classes and then a class of the group, so a word costs 2 * ``GROUPS`` scores.
Within a class each exact word is as likely as in the corpus, and each bucket keeps one
occurrence for words not seen, so the probabilities sum to one.

Words are counted exactly, in a written table that grows with the corpus. Scoring knows the
``OFTEN`` most frequent ones; the others are looked up by a join. Training covers every word:
each round every task masks its share of the words of all its documents, the rounds' shares
together being all words, trains on them from the same start, and the tasks' weights are
averaged by the words they trained on. What is exchanged grows with the number of tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from anbar.llm.common import table, task_sums, written
from anbar.llm.minhash_dedup import GOLDEN, _mixed, word_hashes

BUCKET_BITS = 14
BUCKETS = 1 << BUCKET_BITS
GROUPS = 16
CLASSES = GROUPS * GROUPS
OWN = 128
WIDTH = 16
SIDE = 2
PAD = BUCKETS
OFTEN = 1 << 16
PLACES = [*range(-SIDE, 0), *range(1, SIDE + 1)]


def _probabilities(scores: np.ndarray) -> np.ndarray:
    """The softmax of each row, in place."""
    np.clip(scores, -60, 60, out=scores)
    np.exp(scores, out=scores)
    scores /= scores @ np.ones((scores.shape[1], 1), scores.dtype)
    return scores


def _slots(group: np.ndarray) -> tuple[np.ndarray, int]:
    """Where each row goes in a table with as many places for each group, and their number."""
    order, sizes = np.argsort(group.astype(np.uint8), kind="stable"), np.bincount(group, minlength=GROUPS)
    most = int(sizes.max())
    slot = np.empty(len(group), np.int64)
    slot[order] = np.arange(len(group)) + np.repeat(np.arange(GROUPS) * most - np.cumsum(sizes) + sizes, sizes)
    return slot, most


def _dealt(rows: np.ndarray, slot: np.ndarray, most: int) -> np.ndarray:
    """The rows of each group, and zeros in the places left."""
    out = np.zeros((GROUPS * most, rows.shape[1]), rows.dtype)
    out[slot] = rows
    return out.reshape(GROUPS, most, -1)


def _taken(dealt: np.ndarray, slot: np.ndarray) -> np.ndarray:
    return dealt.reshape(-1, dealt.shape[2]).take(slot, axis=0)


class Network(NamedTuple):
    """Word vectors (the last row pads), a factor per place, and the two levels of the output.

    Class c is member c // GROUPS of group c % GROUPS.
    """

    words: np.ndarray
    places: np.ndarray
    group_out: np.ndarray
    group_bias: np.ndarray
    member_out: np.ndarray
    member_bias: np.ndarray

    @classmethod
    def start(cls, class_share: np.ndarray, seed: int) -> Network:
        rng = np.random.default_rng(seed)
        share = class_share.reshape(GROUPS, GROUPS).T
        return cls(
            rng.normal(0, 0.3, (BUCKETS + 1, WIDTH)).astype(np.float32),
            np.ones((2 * SIDE, WIDTH), np.float32),
            rng.normal(0, 0.1, (WIDTH, GROUPS)).astype(np.float32),
            np.log(share.sum(axis=1)).astype(np.float32),
            rng.normal(0, 0.1, (GROUPS, WIDTH, GROUPS)).astype(np.float32),
            np.log(share / share.sum(axis=1, keepdims=True)).astype(np.float32),
        )

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self]).astype(np.float64)

    def of(self, flat: np.ndarray) -> Network:
        parts, at = [], 0
        for x in self:
            parts.append(flat[at : at + x.size].reshape(x.shape).astype(np.float32))
            at += x.size
        return Network(*parts)

    def hidden(self, context: np.ndarray) -> np.ndarray:
        total = np.zeros((len(context), WIDTH), np.float32)
        for j in range(2 * SIDE):
            total += self.words.take(context[:, j], axis=0) * self.places[j]
        return np.tanh(total)

    def _spans(self, wanted: np.ndarray) -> list[tuple[int, int, int]]:
        """(group, start, end) of each group in classes that are sorted by group."""
        heads = np.searchsorted(wanted % GROUPS, np.arange(GROUPS + 1)).tolist()
        return [(g, at, end) for g, (at, end) in enumerate(pairwise(heads)) if end > at]

    def _levels(self, hidden: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of all groups, and of the members of the wanted one; sorted by group."""
        members = self.member_bias[wanted % GROUPS]
        for g, at, end in self._spans(wanted):
            members[at:end] += hidden[at:end] @ self.member_out[g]
        return _probabilities(hidden @ self.group_out + self.group_bias), _probabilities(members)

    def log_classes(self, context: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Log-probability of the wanted class in each context."""
        order = np.argsort((wanted % GROUPS).astype(np.uint8), kind="stable")
        hidden, sorted_, row = self.hidden(context[order]), wanted[order], np.arange(len(wanted))
        groups, members = self._levels(hidden, sorted_)
        logs = np.empty(len(wanted), np.float32)
        logs[order] = np.log(groups[row, sorted_ % GROUPS] * members[row, sorted_ // GROUPS])
        return logs

    def learn(self, context: np.ndarray, wanted: np.ndarray, rate: float) -> None:
        """One step of gradient descent on the cross-entropy of a small batch."""
        n = len(wanted)
        group, row = wanted % GROUPS, np.arange(n)
        slot, most = _slots(group)
        vectors = self.words.take(context, axis=0)
        hidden = np.tanh(np.einsum("njw,jw->nw", vectors, self.places))
        dealt = _dealt(hidden, slot, most)  # so that one call has the products of all groups
        groups = _probabilities(hidden @ self.group_out + self.group_bias)
        members = _probabilities(_taken(dealt @ self.member_out, slot) + self.member_bias.take(group, axis=0))
        groups[row, group] -= 1
        members[row, wanted // GROUPS] -= 1
        errors = _dealt(members, slot, most)
        back = groups @ self.group_out.T + _taken(errors @ self.member_out.transpose(0, 2, 1), slot)
        self.group_out[...] -= rate / n * (hidden.T @ groups)
        self.group_bias[...] -= rate / n * groups.sum(axis=0)
        self.member_out[...] -= rate / n * (dealt.transpose(0, 2, 1) @ errors)
        self.member_bias[...] -= rate / n * (np.ones((1, most), np.float32) @ errors)[:, 0]
        back *= 1 - hidden * hidden
        # A word is in few contexts of a batch, so its vector gets the step of each, unaveraged.
        rows = context.ravel().astype(np.uint16)
        order = np.argsort(rows, kind="stable")
        steps = back.take(order // (2 * SIDE), axis=0) * self.places.take(order % (2 * SIDE), axis=0)
        self.places[...] -= rate / n * np.einsum("nw,njw->jw", back, vectors)
        rows = rows[order]
        heads = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
        # Two numbers at a time, as one complex number.
        sums = np.add.reduceat(steps.view(np.complex64), heads, axis=0).view(np.float32)
        self.words[rows[heads]] -= rate / 5 * sums


class Vocabulary(NamedTuple):
    """Class of each bucket, its log-share within the class, and its words and one unseen."""

    class_of: np.ndarray
    log_share: np.ndarray
    class_share: np.ndarray
    smooth: np.ndarray

    @classmethod
    def of(cls, counts: np.ndarray) -> Vocabulary:
        """The most frequent buckets are classes of their own, the rest is dealt out in turn."""
        smooth = counts + 1.0
        order = np.lexsort((np.arange(BUCKETS), -counts))
        class_of = np.empty(BUCKETS, np.int64)
        class_of[order[:OWN]] = np.arange(OWN)
        class_of[order[OWN:]] = OWN + np.arange(BUCKETS - OWN) % (CLASSES - OWN)
        totals = np.bincount(class_of, smooth, CLASSES)
        return cls(class_of, np.log(smooth / totals[class_of]), totals / totals.sum(), smooth)


class Often(NamedTuple):
    """The hashes of frequent words in order, and the log of their counts."""

    words: np.ndarray
    log_count: np.ndarray

    def places_of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of each word, whether it is there)."""
        if not len(self.words):
            return np.zeros(len(words), np.int64), np.zeros(len(words), bool)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return at, self.words[at] == words


def _words(texts: list[str | None], chars: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes of the words, words per text) of groups of texts."""
    group: list[str] = []
    size = 0
    for i, text in enumerate(texts):
        group.append(text or "")
        size += len(group[-1])
        if size > chars or i == len(texts) - 1:
            yield word_hashes(group)
            group, size = [], 0


def bucket_of(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def contexts(buckets: np.ndarray, counts: np.ndarray, chosen: np.ndarray | None = None) -> np.ndarray:
    """The words around each word, or each of those ``chosen`` by place, from its own text only;
    PAD beyond its ends."""
    at = np.arange(len(buckets)) + SIDE * np.repeat(np.arange(1, len(counts) + 1), counts)
    apart = np.full(len(buckets) + SIDE * (len(counts) + 1), PAD, np.int64)
    apart[at] = buckets
    if chosen is not None:
        at = at[chosen]
    out = np.empty((len(at), 2 * SIDE), np.int64)
    for j, step in enumerate(PLACES):
        out[:, j] = apart[at + step]
    return out


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n): the 64-bit hash of every word of the documents and its count, written."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group, _ in _words(batch.column(0).to_pylist(), 1 << 20):
                words, n = np.unique(group, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], names=["word", "n"])

    found = docs.select(text).mapInArrow(counted, "word long, n long")
    return written(found.groupBy("word").agg(F.sum("n").alias("n")))


def bucket_sums(counts: DataFrame) -> np.ndarray:
    """Words per bucket from ``word_counts``."""
    bucket = F.shiftrightunsigned("word", 64 - BUCKET_BITS).alias("bucket")
    sums = counts.groupBy(bucket).agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS)
    out[sums["bucket"].to_numpy()] = sums["n"].to_numpy()
    return out


def bucket_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Words per bucket over all documents."""
    return bucket_sums(word_counts(docs, text))


def often(counts: DataFrame, most: int | None = None) -> Often:
    """The most frequent words of ``word_counts``, at most ``most`` (OFTEN) of them.

    A bar on the count, from a histogram of its magnitudes, picks them on the executors.
    """
    most = OFTEN if most is None else most
    level = F.floor(F.log2("n") * 8)
    sizes = sorted(counts.groupBy(level.alias("level")).count().collect(), reverse=True)
    bar, taken = None, 0
    for magnitude, size in sizes:
        taken += size
        if taken > most:
            break
        bar = magnitude
    if bar is None:
        return Often(np.empty(0, np.uint64), np.empty(0))
    rows = counts.where(level >= bar).toArrow()
    words = rows["word"].to_numpy().view(np.uint64)
    order = np.argsort(words)
    return Often(words[order], np.log(rows["n"].to_numpy())[order])


def masks(counts: np.ndarray, number: int, rounds: int) -> np.ndarray:
    """The words, by place, that round ``number`` masks; each word is in one of the rounds."""
    ends = np.cumsum(counts)
    place = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)
    mixed = _mixed((place.astype(np.uint64) + np.uint64(1)) * GOLDEN)
    return np.flatnonzero(mixed % np.uint64(rounds) == number)


def train_on(
    network: Network, vocabulary: Vocabulary, groups: Iterator[tuple[np.ndarray, np.ndarray]],
    number: int, rounds: int, rate: float, rng: np.random.Generator, batch: int = 256,
) -> int:
    """Train in place on the words of each group that the round masks; the words trained on."""
    trained = 0
    for words, counts in groups:
        chosen = masks(counts, number, rounds)
        if not len(chosen):
            continue
        rng.shuffle(chosen)
        buckets = bucket_of(words)
        context = contexts(buckets, counts, chosen)
        wanted = vocabulary.class_of[buckets[chosen]]
        for at in range(0, len(chosen), batch):
            network.learn(context[at : at + batch], wanted[at : at + batch], rate)
        trained += len(chosen)
    return trained


def train(
    docs: DataFrame, vocabulary: Vocabulary, text: str = "text",
    rounds: int = 2, rate: float = 1.0, seed: int = 9,
) -> Network:
    """Rounds of local training over all documents and averaging of the weights."""
    network = Network.start(vocabulary.class_share, seed)
    for number in range(rounds):
        start, step = network, rate / (number + 1)

        def trained(batches: Iterator[pa.RecordBatch], start=start, step=step, number=number) -> np.ndarray:
            from pyspark import TaskContext

            own = start.of(start.flat())
            rng = np.random.default_rng([seed, number, TaskContext.get().partitionId()])
            words = 0
            for rows in batches:
                groups = _words(rows.column(0).to_pylist())
                words += train_on(own, vocabulary, groups, number, rounds, step, rng)
            return np.append(own.flat() * words, words)

        total = task_sums(docs.select(text), trained, len(network.flat()) + 1)
        if total[-1]:
            network = network.of(total[:-1] / total[-1])
    return network


def bucket_logs(
    buckets: np.ndarray, counts: np.ndarray, network: Network, vocabulary: Vocabulary, step: int = 4096
) -> np.ndarray:
    """Log-probability of the bucket of each word."""
    context = contexts(buckets, counts)
    wanted = vocabulary.class_of[buckets]
    logs = vocabulary.log_share[buckets]
    for at in range(0, len(buckets), step):
        part = slice(at, at + step)
        logs[part] += network.log_classes(context[part], wanted[part])
    return logs


def score_texts(
    texts: list[str | None], network: Network, vocabulary: Vocabulary
) -> Iterator[tuple[int, float | None, float | None]]:
    """(words, summed log-probability of their buckets, its mean) of each text; null without words."""
    for words, counts in _words(texts):
        logs = bucket_logs(bucket_of(words), counts, network, vocabulary)
        ends = np.cumsum(counts)
        for n, end in zip(counts.tolist(), ends.tolist(), strict=True):
            total = float(logs[end - n : end].sum()) if n else None
            yield n, total, total / n if n else None


def score_parts(
    texts: list[str | None], network: Network, vocabulary: Vocabulary, known: Often
) -> Iterator[tuple[int, float | None, np.ndarray]]:
    """(words, summed log-probability with counts of 1 for the words not known, those words)."""
    for words, counts in _words(texts):
        buckets = bucket_of(words)
        logs = bucket_logs(buckets, counts, network, vocabulary) - np.log(vocabulary.smooth[buckets])
        at, there = known.places_of(words)
        logs[there] += known.log_count[at[there]]
        ends = np.cumsum(counts)
        for n, end in zip(counts.tolist(), ends.tolist(), strict=True):
            own = slice(end - n, end)
            yield n, float(logs[own].sum()) if n else None, words[own][~there[own]]


def scored(
    docs: DataFrame, network: Network, vocabulary: Vocabulary, key: str = "doc_id", text: str = "text",
    counts: DataFrame | None = None,
) -> DataFrame:
    """One row per document: key, n_words, log_likelihood, mean_log_likelihood.

    Whole texts are scored. Null, empty and blank texts have no words and null scores. Exact words
    are scored by ``counts``, the ``word_counts`` of the corpus, by default of ``docs``.
    """
    counts = word_counts(docs, text) if counts is None else counts
    known = often(counts)
    fields = "n_words long, __row long, __part double, __rest array<long>"
    schema = T.StructType([docs.schema[key], *T.StructType.fromDDL(fields)])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            n, part, rest = [], [], [np.empty(0, np.uint64)]
            for words, total, others in score_parts(batch.column(1).to_pylist(), network, vocabulary, known):
                n.append(words)
                part.append(total)
                rest.append(others)
            ends = pa.array(np.cumsum([len(x) for x in rest]), pa.int32())
            lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(rest).view(np.int64)))
            rows = pa.array(np.arange(row, row + len(n)), pa.int64())
            row += len(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), rows, pa.array(part, pa.float64()), lists],
                names=schema.names,
            )

    found = written(docs.select(docs[key], docs[text]).mapInArrow(parts, schema))
    # A count of 1 has the logarithm 0. Whole numbers add up the same in any order.
    log_count = (F.log("n") * float(1 << 32)).cast("long")
    rest = found.select("__row", F.explode("__rest").alias("word")).join(counts.where("n > 1"), "word")
    own = rest.groupBy("__row").agg(F.sum(log_count).alias("__own"))
    total = F.col("__part") + F.coalesce(F.col("__own") / float(1 << 32), F.lit(0.0))
    return found.drop("__rest").join(own, "__row", "left").select(
        key, "n_words", total.alias("log_likelihood"), (total / F.col("n_words")).alias("mean_log_likelihood"),
    )


def pseudo_likelihood(docs: DataFrame, key: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """Train on ``docs`` and score each of them."""
    counts = word_counts(docs, text)
    vocabulary = Vocabulary.of(bucket_sums(counts))
    return scored(docs, train(docs, vocabulary, text, **settings), vocabulary, key, text, counts)


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = pseudo_likelihood(table(spark, sf_dir, "documents"))
    return scores.withColumn("perplexity", F.exp(-F.col("mean_log_likelihood")))
