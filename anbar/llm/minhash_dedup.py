"""Near-duplicate documents by improved consistent weighted sampling.

Documents are sets of five-word shingles with weights (1 + ln tf) * idf. Consistent weighted
sampling draws a shingle per hash so that two documents draw the same one with a probability
equal to their weighted Jaccard similarity. Bands of samples make candidates, the exact
weighted Jaccard similarity verifies them, and links make groups.

The inverse document frequency is damped to 1 .. 2 so that a passage which many documents
share counts less, but a large group of near copies stays alike. Frequencies are counted over
all documents in a fixed number of hashed shingle buckets, so the table has a fixed size.

Candidates of a band meet in cells. A cell is resolved with union-find: documents that are
connected already are not compared again, and only a spanning forest comes out. Equal sets of
documents that meet in several bands are resolved once. Larger groups are dealt into cells of
``cell_rows``; afterwards only documents that are not yet connected are compared across cells,
in cells of ``cross_rows`` documents, so a group is moved once per ``cross_rows`` of those.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from anbar.llm.common import small, table, task_sums, written
from anbar.llm.components import components

SHINGLE = 5
BUCKET_BITS = 18
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, in place."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> np.ndarray:
    factors = np.full(n, 0x100000001B3, np.uint64)
    factors[0] = 1
    return np.multiply.accumulate(factors)


_power_table = [_powers(4096)]


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-case words of the texts, end to end, and the words of each text."""
    data = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    raw = np.frombuffer(b" ".join([b"", *data, b""]), np.uint8)
    space = SPACE[raw]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    sizes = ends - starts
    longest = int(sizes.max())
    if longest > len(_power_table[0]):
        _power_table[0] = _powers(2 * longest)
    first = np.repeat(starts, sizes)
    at = np.flatnonzero(~space)
    value = (raw[at].astype(np.uint64) + np.uint64(1)) * _power_table[0][at - first]
    heads = np.zeros(len(starts), np.int64)
    np.cumsum(sizes[:-1], out=heads[1:])
    words = _mixed(np.add.reduceat(value, heads) + sizes.astype(np.uint64) * GOLDEN)
    bounds = np.cumsum([1, *(len(d) + 1 for d in data)])
    counts = np.diff(np.searchsorted(starts, bounds))
    return words, counts


def shingles(words: np.ndarray) -> np.ndarray:
    """Hashes of the five-word windows of one text; a shorter text is one shingle."""
    n = len(words)
    if not n:
        return words
    width = min(SHINGLE, n)
    out = words[: n - width + 1].copy()
    for i in range(1, width):
        out = out * np.uint64(0xD6E8FEB86659FD93) + words[i : n - width + 1 + i]
    return _mixed(out)


def bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _each_text(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word hashes, shingle hashes) of each text; batches of texts are hashed together."""
    group: list[str] = []
    size = 0

    def flush() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        words, counts = word_hashes(group)
        at = 0
        for n in counts:
            yield words[at : at + n], shingles(words[at : at + n])
            at += n

    for text in texts:
        group.append(text or "")
        size += len(group[-1])
        if size > 1 << 18:
            yield from flush()
            group, size = [], 0
    if group:
        yield from flush()


# --- document frequencies ---------------------------------------------------


def document_frequencies(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Documents per shingle bucket, over all documents; then their number."""
    size = 1 << BUCKET_BITS

    def counted(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        counts = np.zeros(size + 1)
        for batch in batches:
            for _, found in _each_text(batch.column(0).to_pylist()):
                counts[size] += 1
                counts[np.unique(bucket(found))] += 1
        return counts

    return task_sums(docs.select(text), counted, size + 1)


def damped_idf(frequencies: np.ndarray, documents: float) -> np.ndarray:
    """1 + ln((N + 1) / (df + 1)) / ln(N + 1), so 1 .. 2."""
    spread = np.log(documents + 1.0)
    return 1 + np.log((documents + 1) / (frequencies + 1)) / max(spread, 1.0)


def weighted(found: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles, sorted, and their weights."""
    ids, counts = np.unique(found, return_counts=True)
    return ids, (1 + np.log(counts)) * idf[bucket(ids)]


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of minima over sum of maxima."""
    at = np.searchsorted(b[0], a[0])
    at[at == len(b[0])] = 0
    same = b[0][at] == a[0] if len(b[0]) else np.zeros(len(a[0]), bool)
    shared = np.minimum(a[1][same], b[1][at[same]]).sum()
    whole = a[1].sum() + b[1].sum() - shared
    return float(shared / whole) if whole else 1.0


# --- sampling ---------------------------------------------------------------


def _unit(high: np.ndarray) -> np.ndarray:
    """(0, 1) from 32-bit values."""
    return (high.astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-32)


def consistent_samples(
    ids: np.ndarray, weights: np.ndarray, starts: np.ndarray, hashes: int
) -> np.ndarray:
    """Improved consistent weighted sampling: one value per text and hash.

    ``ids`` and ``weights`` of several texts stand end to end, each text's from ``starts``.
    r and c are gamma(2, 1), beta is uniform, all hashes of the shingle and the hash number;
    t = floor(ln w / r + beta), ln y = r (t - beta), and the shingle with the smallest
    ln c - ln y - r is drawn together with its t.
    """
    log_w = np.log(weights).astype(np.float32)
    lengths = np.diff(np.append(starts, len(ids)))
    texts = np.repeat(np.arange(len(starts)), lengths)
    out = np.empty((len(starts), hashes), np.uint64)
    low = np.uint64(0xFFFFFFFF)
    half = np.uint64(32)
    tiny = np.float32(2.0**-33)
    for k in range(hashes):
        one = _mixed(ids + np.uint64((2 * k + 1) * int(GOLDEN) % 2**64))
        two = _mixed(one + GOLDEN)
        r = -np.log(np.maximum(_unit(one >> half) * _unit(one & low), tiny * tiny))
        c = -np.log(np.maximum(_unit(two >> half) * _unit(two & low), tiny * tiny))
        beta = _unit((one ^ (two * GOLDEN)) >> half)
        r = np.maximum(r, np.float32(1e-6))
        t = np.floor(log_w / r + beta)
        a = np.log(np.maximum(c, np.float32(1e-30))) - r * (t - beta) - r
        least = np.minimum.reduceat(a, starts)
        at = np.flatnonzero(a == np.repeat(least, lengths))
        _, first = np.unique(texts[at], return_index=True)
        at = at[first]
        out[:, k] = _mixed(ids[at] + t[at].astype(np.int64).astype(np.uint64) * GOLDEN)
    return out


def _signatures(docs: DataFrame, key: str, text: str, idf: np.ndarray, bands: int, rows: int) -> DataFrame:
    """(id, h1, h2, words, k0 ..): hashes of the word sequence and one key per band."""
    names = ["id", "h1", "h2", "words", *[f"k{i}" for i in range(bands)]]
    fields = [T.StructField("id", docs.schema[key].dataType)]
    schema = T.StructType(fields + [T.StructField(n, T.LongType()) for n in names[1:]])

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n = len(texts)
            out = np.zeros((n, bands + 3), np.uint64)
            waiting: list[tuple[int, np.ndarray, np.ndarray]] = []
            held = 0

            def flush(waiting: list, out: np.ndarray) -> None:
                if not waiting:
                    return
                at = np.array([w[0] for w in waiting])
                sizes = np.array([len(w[1]) for w in waiting])
                starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                got = consistent_samples(
                    np.concatenate([w[1] for w in waiting]),
                    np.concatenate([w[2] for w in waiting]), starts, bands * rows,
                )
                for b in range(bands):
                    mixed = np.full(len(at), b + 1, np.uint64) * GOLDEN
                    for r in range(rows):
                        mixed = _mixed(mixed * np.uint64(0xD6E8FEB86659FD93) + got[:, b * rows + r])
                    out[at, 3 + b] = mixed

            for i, (words, found) in enumerate(_each_text(texts)):
                if len(words):
                    place = np.arange(1, len(words) + 1, dtype=np.uint64)
                    out[i, 0] = _mixed(words + place * GOLDEN).sum()
                    out[i, 1] = _mixed(words ^ (place * np.uint64(0xD6E8FEB86659FD93))).sum()
                    out[i, 2] = len(words)
                    ids, weights = weighted(found, idf)
                    waiting.append((i, ids, weights))
                    held += len(ids)
                    if held > 1 << 15:
                        flush(waiting, out)
                        waiting, held = [], 0
            flush(waiting, out)
            columns = [pa.array(out[:, j].astype(np.int64)) for j in range(bands + 3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)

    return docs.select(docs[key], docs[text]).mapInArrow(sampled, schema)


# --- cells ------------------------------------------------------------------


class _Union:
    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = x
        while (up := self.parent.get(root, root)) != root:
            root = up
        while (up := self.parent.get(x, x)) != root:
            self.parent[x], x = root, up
        return root

    def join(self, a: int, b: int) -> None:
        a, b = sorted((self.find(a), self.find(b)))
        self.parent[b] = a


def _near(sets: list[tuple[np.ndarray, np.ndarray]], rows: list[int], similarity: float):
    """(i, the documents that may be as similar to i) for each i of ``rows``, all at once per i.

    The bound is kept with a little room for sums in another order; links are verified after it.
    """
    sizes = np.array([len(ids) for ids, _ in sets])
    held = np.flatnonzero(sizes)
    starts = np.cumsum(sizes[held]) - sizes[held]
    weights = np.concatenate([w for _, w in sets])
    shingle, place = np.unique(np.concatenate([ids for ids, _ in sets]), return_inverse=True)
    ends = np.cumsum(sizes)
    total = np.array([w.sum() for _, w in sets])
    own = np.zeros(len(shingle))
    share = similarity / (1 + similarity) - 1e-9
    for i in rows:
        if not sizes[i]:
            continue
        mine = slice(ends[i] - sizes[i], ends[i])
        own[place[mine]] = weights[mine]
        shared = np.zeros(len(sets))
        shared[held] = np.add.reduceat(np.minimum(weights, own[place]), starts)
        own[place[mine]] = 0
        near = shared >= share * (total + total[i])
        near[i] = False
        yield i, np.flatnonzero(near).tolist()


def _resolver(idf: np.ndarray, similarity: float):
    """Resolves a cell: rows (id, text, component, minor); pairs without a minor are skipped
    if the cell has any. Gives a link for each union."""

    def resolved(cell: pa.Table) -> pa.Table:
        ids, texts = cell["id"].to_pylist(), cell["text"].to_pylist()
        known, minor = cell["component"].to_pylist(), cell["minor"].to_pylist()
        crossing = cell["crossing"][0].as_py()
        sets = [weighted(found, idf) for _, found in _each_text(texts)]
        order = sorted(range(len(ids)), key=lambda i: ids[i])
        union = _Union()
        a, b = [], []

        def compare(i: int, j: int) -> None:
            if union.find(ids[i]) == union.find(ids[j]):
                return
            if weighted_jaccard(sets[i], sets[j]) >= similarity:
                union.join(ids[i], ids[j])
                a.append(ids[i])
                b.append(ids[j])

        if crossing:
            for i in order:
                union.join(known[i], ids[i])
            for i, near in _near(sets, [i for i in order if minor[i]], similarity):
                for j in near:
                    compare(i, j)
        else:
            total = [w.sum() for _, w in sets]
            for x, i in enumerate(order):
                for j in order[:x]:
                    if min(total[i], total[j]) >= similarity * max(total[i], total[j]):
                        compare(i, j)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return resolved


def _with_texts(cells: DataFrame, docs: DataFrame, key: str, text: str, broadcast_rows: int) -> DataFrame:
    """The rows of cells with their texts; only texts of documents in a cell are moved."""
    wanted = written(cells.select("id").distinct().withColumnRenamed("id", "wanted"))
    if small(wanted, broadcast_rows):
        wanted = F.broadcast(wanted)
    texts = docs.select(docs[key].cast("long").alias("id"), docs[text].alias("text"))
    texts = texts.join(wanted, F.col("id") == F.col("wanted"), "left_semi")
    return cells.join(texts, "id")


def _links(cells: DataFrame, idf: np.ndarray, similarity: float) -> DataFrame:
    return written(cells.groupBy("cell", "chunk", "other").applyInArrow(_resolver(idf, similarity), "a long, b long"))


def bands_for(similarity: float, rows: int, miss: float) -> int:
    """The bands with which a pair of that similarity never meets with at most ``miss``."""
    if similarity >= 1:
        return 1
    return max(1, math.ceil(math.log(miss) / math.log1p(-(similarity**rows))))


def near_duplicates(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    similarity: float = 0.8,
    bands: int | None = None,
    rows: int = 3,
    cell_rows: int = 64,
    cross_rows: int = 1024,
    broadcast_rows: int = 500_000,
    miss: float = 2e-4,
) -> DataFrame:
    """(key, component_id, n_copies, kept), one row per row of ``docs``.

    Without ``bands`` there are so many that a pair at ``similarity`` is missed with at most ``miss``.

    ``component_id`` is the smallest id of the group; ``n_copies`` counts the rows with the same
    words in the same order. A text below five words is one shingle. Texts without words, null
    or blank, are copies of each other. Rows that repeat an id share its verdict; rows without
    id stay as they are.
    """
    bands = bands or bands_for(similarity, rows, miss)
    frequencies = document_frequencies(docs, text)
    idf = damped_idf(frequencies[:-1], frequencies[-1])
    signed = written(_signatures(docs, key, text, idf, bands, rows))
    keys = [f"k{i}" for i in range(bands)]
    usable = signed.where("id is not null")
    classes = written(
        usable.groupBy("h1", "h2").agg(
            F.min(F.col("id").cast("long")).alias("rep"), F.count("*").alias("n_copies"),
            F.max("words").alias("words"), *[F.min(k).alias(k) for k in keys],
        )
    )
    met = classes.where("words > 0").select(F.col("rep").alias("id"), F.explode(F.array(*keys)).alias("band"))
    groups = met.groupBy("band").agg(
        F.count("*").alias("n"), F.min("id").alias("first"), F.bit_xor(F.xxhash64("id")).alias("sum")
    )
    # Bands in which the same documents meet are resolved once.
    groups = written(
        groups.where("n > 1").groupBy("n", "first", "sum").agg(F.min("band").alias("cell")).select("cell", "n")
    )
    members = written(met.join(groups, F.col("band") == F.col("cell")).select("cell", "n", "id"))
    none = F.lit(0).cast("long")
    chunk = F.when(
        F.col("n") > cell_rows, F.pmod(F.xxhash64("cell", "id"), F.ceil(F.col("n") / cell_rows))
    ).otherwise(none)
    first = members.select(
        "cell", chunk.alias("chunk"), none.alias("other"), "id", none.alias("component"),
        F.lit(False).alias("minor"), F.lit(False).alias("crossing"),
    )
    links = _links(_with_texts(first, docs, key, text, broadcast_rows), idf, similarity)
    large = members.where(F.col("n") > cell_rows)
    links = links.unionByName(_across(large, links, docs, key, text, idf, similarity, cross_rows, broadcast_rows))
    groups_of = components(links).withColumnRenamed("id", "rep")
    verdicts = classes.select(
        F.col("h1").alias("c1"), F.col("h2").alias("c2"), "rep", "n_copies"
    ).join(groups_of, "rep", "left")
    match = (F.col("h1") == F.col("c1")) & (F.col("h2") == F.col("c2")) & F.col("id").isNotNull()
    out = signed.select("id", "h1", "h2").join(verdicts, match, "left")
    component = F.coalesce("component", "rep")
    return out.select(
        F.col("id").alias(key),
        component.alias("component_id"),
        F.coalesce("n_copies", F.lit(1)).alias("n_copies"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )


def _across(
    large: DataFrame, links: DataFrame, docs: DataFrame, key: str, text: str, idf: np.ndarray,
    similarity: float, cross_rows: int, broadcast_rows: int,
) -> DataFrame:
    """Links between the cells of a large group, of documents that are not connected yet.

    Every pair of a group is either in one cell, connected, or has a member outside of the
    group's largest component: those minor members meet all members, in cells of their own.
    """
    joined = large.join(components(links), "id", "left")
    joined = written(joined.withColumn("component", F.coalesce("component", "id")))
    sizes = joined.groupBy("cell", "component").agg(F.count("*").alias("size"))
    biggest = sizes.groupBy("cell").agg(
        F.max(F.struct("size", "component"))["component"].alias("major"),
        F.sum("size").alias("all"), F.max("size").alias("most"),
    ).where("all > most")
    some = joined.join(biggest, "cell").withColumn("minor", F.col("component") != F.col("major"))
    all_chunks = F.ceil(F.col("all") / cross_rows)
    minor_chunks = F.ceil((F.col("all") - F.col("most")) / cross_rows)

    def chunk(salt: int, many: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit(salt), "cell", "id"), many)

    def upto(many: Column) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), many - 1))

    base = ["cell", "id", "component", "minor", F.lit(True).alias("crossing")]
    minors = some.where("minor").select(*base, chunk(1, minor_chunks).alias("chunk"), upto(all_chunks).alias("other"))
    others = some.select(*base, upto(minor_chunks).alias("chunk"), chunk(2, all_chunks).alias("other"))
    rows = minors.unionByName(others).select("cell", "chunk", "other", "id", "component", "minor", "crossing")
    rows = written(rows.distinct())
    return _links(_with_texts(rows, docs, key, text, broadcast_rows), idf, similarity)


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
