"""Byte-level BPE encoding and decoding with forced boundaries.

Whatever the merges do, each of their results is a token of the vocabulary. Two bytes that
stand side by side in no token can therefore never end up in one: the place between them is a
certain cut. A piece of text is cut there, its fragments are merged independently of each other
and their ids are concatenated. Fragments are short and repeat, so most are looked up.

No piece goes on behind a space that follows a word, so a word with the space before it has the
same ids wherever it stands. A group of texts is cut into words and its different words are found
in Arrow; each of them is split and looked up once, and the ids of the texts are gathered.

The merges are this module's own; only the character classes of unusual scripts come from the
tokenizer's splitter, whose Unicode tables differ from Python's.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator, Sequence
from itertools import pairwise
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from anbar.llm.common import table, text_batches, vocabulary

#: How a byte-level vocabulary splits a text into pieces.
SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: A space inside or at the end of white space, which can be in one piece with what is before it.
INNER_SPACE = re.compile(r" (?!\S)(?<=\s\s)")
#: Characters in whose classes Python and the tokenizer may differ.
UNUSUAL = re.compile(
    "[^\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-՗ -⁯₠-⅏ぁ-ヿ一-鿿가-힣]"
)
#: Fragments up to these lengths are merged side by side, longer ones one by one with a heap.
WIDTHS = (4, 8, 16, 48)
#: Fragments merged at a time.
ROWS = 4096
#: The rank of a pair that is not merged.
NEVER = 1 << 30
#: What stands behind the end of a fragment in place of a byte.
NO_BYTE = 256
#: Entries of a look-up table; a full one becomes the older half, from which those in use come back.
TABLE = 150_000
#: Pieces from this length on are not remembered.
LONG_PIECE = 256
#: Characters of texts that go into one record batch of ids.
BATCH_CHARS = 1 << 20


def byte_letters() -> dict[str, int]:
    """The printable letter of each byte in a byte-level vocabulary file, by rule: printable
    Latin-1 bytes stand for themselves, the others are numbered on from 256."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    letters = {chr(b): b for b in plain}
    rest = [b for b in range(256) if b not in set(plain)]
    return letters | {chr(256 + i): b for i, b in enumerate(rest)}


def slices(sizes: Sequence[int], most: int) -> Iterator[tuple[int, int]]:
    """Consecutive slices whose sizes sum to about ``most``; each has one entry at least."""
    start = held = 0
    for i, size in enumerate(sizes):
        held += size
        if held >= most:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(sizes):
        yield start, len(sizes)


def gathered(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slices of ``values`` at ``starts`` end to end, and where each begins and the last ends."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    return values[np.repeat(starts - ends[:-1], sizes) + np.arange(ends[-1])], ends


def _slices(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """An array of the slices of ``values`` between neighbouring ``bounds``."""
    out = np.empty(len(bounds) - 1, object)
    out[:] = [values[a:b] for a, b in pairwise(bounds.tolist())]
    return out


class Bpe:
    """A byte-level BPE vocabulary from a tokenizer file."""

    def __init__(self, path: str) -> None:
        spec = json.loads(Path(path).read_text("utf-8"))
        model, splitter = spec["model"], spec["pre_tokenizer"] or {}
        plain = splitter.get("type") == "ByteLevel" and splitter["use_regex"] and not splitter["add_prefix_space"]
        plain = plain and model["type"] == "BPE" and not model.get("dropout") and not model.get("ignore_merges")
        plain = plain and not (model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"))
        added = spec["added_tokens"]
        plain = plain and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added)
        if not plain or spec["normalizer"]:
            raise ValueError(f"not a plain byte-level BPE vocabulary: {path}")
        self.path = path
        letters, vocab = byte_letters(), model["vocab"]
        self.bytes_of = [b""] * (1 + max([*vocab.values(), *(t["id"] for t in added)]))
        self.forced = np.ones(1 << 16, bool)
        for token, number in vocab.items():
            raw = bytes(letters[c] for c in token)
            self.bytes_of[number] = raw
            for a, b in zip(raw, raw[1:], strict=False):
                self.forced[a << 8 | b] = False
        self.byte_ids = [vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[a], vocab[b]] = rank, vocab[a + b]
        known = sorted((a << 32 | b, rank, made) for (a, b), (rank, made) in self.merges.items())
        pairs, ranks, made = zip(*known, strict=True)
        self.pairs, self.pair_rank, self.pair_made = np.array(pairs), np.array(ranks, np.int32), np.array(made, np.int32)
        #: By pair of bytes, of which NO_BYTE may be one: the id of the first, rank and result of their merge.
        sides = [*self.byte_ids, -1]
        pairs_of_bytes = [self.merges.get((a, b), (NEVER, -1)) for a in sides for b in sides]
        self.byte_rank, self.byte_made = np.array(pairs_of_bytes, np.int32).T.copy()
        self.byte_id = np.repeat(np.array(sides, np.int32), len(sides))
        self.special = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in added}
        for t in added:
            self.bytes_of[t["id"]] = t["content"].encode()
        longest_first = sorted(self.special, key=len, reverse=True)
        self.specials = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if added else None
        self.splitter = None
        self.known: dict[str, bytes] = dict(self.special)
        self.older: dict[str, bytes] = {}

    # --- text to ids ---

    def pieces(self, text: str) -> list[str]:
        """Special tokens spelled out, and the pieces of what lies between them."""
        if self.specials is not None and self.specials.search(text):
            parts = self.specials.split(text)
            return [p for i, x in enumerate(parts) for p in ([x] if i % 2 else self._split(x))]
        return self._split(text)

    def _split(self, text: str) -> list[str]:
        if not UNUSUAL.search(text):
            return SPLIT.findall(text)
        if self.splitter is None:
            from tokenizers import Tokenizer

            self.splitter = Tokenizer.from_file(self.path).pre_tokenizer
        return [text[a:b] for _, (a, b) in self.splitter.pre_tokenize_str(text)]

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of merging each pair; rank ``NEVER`` where there is no merge."""
        wanted = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, wanted), len(self.pairs) - 1)
        hit = (self.pairs[at] == wanted) & (left >= 0) & (right >= 0)
        return np.where(hit, self.pair_rank[at], np.int32(NEVER)), self.pair_made[at]

    def _merge_rows(self, letters: np.ndarray) -> np.ndarray:
        """The ids of the fragments in the rows of ``letters``, NO_BYTE behind their ends, merged
        side by side: in each round every row merges its pair of lowest rank, leftmost first.
        What is merged into its left neighbour becomes -1."""
        n, width = letters.shape
        out, rows = np.empty((n, width), np.int32), np.arange(n)
        wide = width + 1  # the last column stands beyond both ends
        letters = np.pad(letters, ((0, 0), (0, 2)), constant_values=NO_BYTE)
        pair = np.ascontiguousarray(letters[:, :-1] * np.int32(NO_BYTE + 1) + letters[:, 1:])
        ids, rank, made = (x.take(pair) for x in (self.byte_id, self.byte_rank, self.byte_made))
        after = np.tile(np.append(np.arange(1, wide, dtype=np.int32), width), (n, 1))
        before = np.tile(np.append(width, np.arange(width, dtype=np.int32)), (n, 1)).astype(np.int32)
        while True:
            flat_ids, flat_rank, flat_made, flat_after, flat_before = (
                x.reshape(-1) for x in (ids, rank, made, after, before)
            )
            row = np.arange(len(rows)) * wide
            while True:
                at = row + rank.argmin(1)
                going = flat_rank[at] != NEVER
                many = np.count_nonzero(going)
                if many < 0.6 * len(rows):
                    break
                mine = row
                if many < len(rows):
                    at, mine = at[going], row[going]
                gone = mine + flat_after[at]
                following = flat_after[gone]
                next_, last = mine + following, mine + flat_before[at]
                flat_ids[at], flat_ids[gone], flat_rank[gone] = flat_made[at], -1, NEVER
                flat_after[at], flat_before[next_] = following, at - mine
                middle = flat_ids[at]
                ranks, results = self._ranks(
                    np.concatenate([flat_ids[last], middle]), np.concatenate([middle, flat_ids[next_]])
                )
                flat_rank[last], flat_rank[at] = ranks[:many], ranks[many:]
                flat_made[last], flat_made[at] = results[:many], results[many:]
            out[rows[~going]] = ids[~going, :-1]
            if not many:
                return out
            rows, ids, rank, made, after, before = (x[going] for x in (rows, ids, rank, made, after, before))

    def merged_long(self, fragment: bytes) -> list[int]:
        """One fragment in O(n log n): a heap of pairs over a linked list."""
        merges = self.merges
        ids = [self.byte_ids[b] for b in fragment]
        n = len(ids)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = []
        for i in range(n - 1):
            if (m := merges.get((ids[i], ids[i + 1]))) is not None:
                heap.append((m[0], i, m[1], ids[i], ids[i + 1]))
        heapq.heapify(heap)
        while heap:
            _, i, made, a, b = heapq.heappop(heap)
            j = right[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # one of the two has been merged since
            ids[i], ids[j] = made, -1
            k = right[i] = right[j]
            if k < n:
                left[k] = i
            for x, y in ((left[i], i), (i, k)):
                if x >= 0 and y < n and (m := merges.get((ids[x], ids[y]))) is not None:
                    heapq.heappush(heap, (m[0], x, m[1], ids[x], ids[y]))
        return [x for x in ids if x >= 0]

    def encode_pieces(self, pieces: Sequence[str]) -> list[bytes]:
        """Ids of each piece as little-endian unsigned 32-bit numbers: all pieces are cut at the
        forced boundaries, and fragments of similar length are merged together."""
        raw = [p.encode() for p in pieces]
        data = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum([len(r) for r in raw])
        cut = self.forced[data[:-1].astype(np.int64) << 8 | data[1:]]
        cut[ends[:-1] - 1] = True
        starts = np.concatenate([[0], np.flatnonzero(cut) + 1])
        sizes = np.diff(starts, append=len(data))
        ids = np.array(self.byte_ids, np.int32)[data]
        for low, high in zip((1, *WIDTHS), WIDTHS, strict=False):
            mine = (sizes > low) & (sizes <= high)
            if mine.any():
                place = np.arange(high)
                spots = starts[mine][:, None] + place
                inside = place < sizes[mine][:, None]
                rows = np.where(inside, data[np.minimum(spots, len(ids) - 1)], np.int16(NO_BYTE))
                merged = [self._merge_rows(rows[i : i + ROWS]) for i in range(0, len(rows), ROWS)]
                ids[spots[inside]] = np.concatenate(merged)[inside]
        for i in np.flatnonzero(sizes > WIDTHS[-1]):
            start, end = starts[i], starts[i] + sizes[i]
            merged = self.merged_long(data[start:end].tobytes())
            ids[start:end] = -1
            ids[start : start + len(merged)] = merged
        kept = ids >= 0
        flat = ids[kept].astype("<u4").tobytes()
        bounds = [0, *(4 * np.cumsum(kept)[ends - 1]).tolist()]
        return [flat[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]

    def _learn(self, pieces: Sequence[str]) -> list[bytes]:
        """Ids of pieces that are not in the younger table."""
        found = list(map(self.older.get, pieces))
        new = [i for i, ids in enumerate(found) if ids is None]
        if new:
            for i, ids in zip(new, self.encode_pieces([pieces[i] for i in new]), strict=True):
                found[i] = ids
        self.known.update(zip(pieces, found, strict=True))
        for p in [p for p in pieces if len(p) >= LONG_PIECE]:
            del self.known[p]
        return found

    def _ids_of(self, pieces: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, the place in them of each piece, its number of ids). Each different piece is
        looked up once, and those not known are merged together."""
        if len(self.known) > TABLE:
            self.known, self.older = dict(self.special), self.known
        coded = pa.array(pieces, pa.large_string()).dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.known.get, distinct))
        new = [i for i, ids in enumerate(found) if ids is None]
        if new:
            for i, ids in zip(new, self._learn([distinct[i] for i in new]), strict=True):
                found[i] = ids
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        codes = coded.indices.to_numpy()
        return np.frombuffer(b"".join(found), "<u4"), (np.cumsum(sizes) - sizes)[codes], sizes[codes]

    def _by_word(self, text: str) -> bool:
        """Whether cutting the text before its spaces leaves its pieces whole."""
        if UNUSUAL.search(text) or INNER_SPACE.search(text):
            return False
        return self.specials is None or not self.specials.search(text)

    def encode(self, texts: Sequence[str]) -> list[np.ndarray]:
        """Ids of each text."""
        by_word = np.fromiter(map(self._by_word, texts), bool, len(texts))
        mine = [t for t, b in zip(texts, by_word, strict=True) if b]
        cut = pc.split_pattern(pa.array(mine, pa.large_string()), " ")
        bounds, coded = cut.offsets.to_numpy(), cut.values.dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        # Side by side, words that neither begin nor end with white space split as they do alone.
        plain = [w != "" and not (w[0].isspace() or w[-1].isspace()) for w in words]
        pieces = SPLIT.findall("".join([f" {w}" for w, p in zip(words, plain, strict=True) if p]))
        heads = [i for i, p in enumerate(pieces) if p[0] == " "]
        lists = [SPLIT.findall(f" {w}") for w, p in zip(words, plain, strict=True) if not p]
        lists += [SPLIT.findall(t.partition(" ")[0]) for t in mine]  # no space before a first word
        lists += [self.pieces(t) for t, b in zip(texts, by_word, strict=True) if not b]
        ends = np.cumsum([len(pieces), *map(len, lists)])
        for found in lists:
            pieces += found
        # A unit is a word, a first word or the whole of another text.
        units = np.concatenate([np.array(heads, np.int64), ends])
        ids, starts, sizes = self._ids_of(pieces)
        ids, places = gathered(ids, starts, sizes)
        places = places[units]
        unit_of = np.empty(len(words), np.int64)
        unit_of[np.argsort(~np.array(plain, bool), kind="stable")] = np.arange(len(words))
        of_word = unit_of[coded.indices.to_numpy()]
        of_word[bounds[:-1]] = np.arange(len(words), len(words) + len(mine))
        flat, at = gathered(ids, places[of_word], np.diff(places)[of_word])
        at = at[bounds]
        out = np.empty(len(texts), object)
        out[np.flatnonzero(by_word)] = _slices(flat, at)
        out[np.flatnonzero(~by_word)] = _slices(ids, places[len(words) + len(mine) :])
        return out.tolist()

    def of_each(self, texts: Sequence[str], chars: int = BATCH_CHARS) -> Iterator[np.ndarray]:
        """Ids of each text, worked on in groups of about ``chars`` characters."""
        for a, b in slices([len(t) + 1 for t in texts], chars):
            yield from self.encode(texts[a:b])

    # --- ids to text ---

    def decode(self, ids: Sequence[int]) -> str:
        """The bytes of all tokens as one UTF-8 text; bytes that are none become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


_loaded: dict[str, Bpe] = {}


def loaded(path: str) -> Bpe:
    """The vocabulary of a file, read once in a process."""
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def encode(
    docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", keep: Sequence[str] = ()
) -> DataFrame:
    """(key, ``keep`` ..., ids array<int>) of each row's whole text, one row per row of ``docs``.

    Special tokens spelled out in a text become their ids. Null and empty texts have no ids;
    keys may repeat or be null; an empty table gives no rows.
    """
    carried = [key, *keep]
    schema = T.StructType([docs.schema[c] for c in carried]).add("ids", T.ArrayType(T.IntegerType()))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(tokenizer)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            for a, b in slices([len(t or "") + 1 for t in texts], BATCH_CHARS):
                ids = bpe.encode([t or "" for t in texts[a:b]])
                offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                flat = np.concatenate(ids).astype(np.int32)
                columns = [batch.column(i).slice(a, b - a) for i in range(len(carried))]
                columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return text_batches(docs).select(*[docs[c] for c in carried], docs[text]).mapInArrow(encoded, schema)


def decode(
    encoded: DataFrame, tokenizer: str, key: str = "doc_id", ids: str = "ids", text: str = "text",
    keep: Sequence[str] = (),
) -> DataFrame:
    """(key, ``keep`` ..., text) of rows of ids, special tokens spelled out; null ids count as none."""
    carried = [key, *keep]
    schema = T.StructType([encoded.schema[c] for c in carried]).add(text, T.StringType())

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(tokenizer)
        for batch in batches:
            rows = batch.column(batch.num_columns - 1)
            sizes = rows.value_lengths().fill_null(0).to_pylist()
            flat = rows.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum([0, *sizes]).tolist()
            for a, b in slices([n + 1 for n in sizes], BATCH_CHARS):
                texts = [bpe.decode(flat[x:y].tolist()) for x, y in pairwise(ends[a : b + 1])]
                columns = [batch.column(i).slice(a, b - a) for i in range(len(carried))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string())], names=schema.names)

    return encoded.select(*[encoded[c] for c in carried], encoded[ids]).mapInArrow(decoded, schema)


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and the text decoded from them, as digests; one row per document."""
    tokenizer = vocabulary()
    ids = encode(table(spark, sf_dir, "documents"), tokenizer).select(
        "doc_id",
        "ids",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
    )
    texts = decode(ids, tokenizer, keep=["n_tokens", "ids_sha256"])
    return texts.select(
        "doc_id", "n_tokens", "ids_sha256", F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256")
    )
