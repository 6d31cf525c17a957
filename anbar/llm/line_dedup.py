"""Line dedup over a whole corpus: exact copies and lines one edit away from an earlier line.

A line is a trimmed, non-blank part of a text between newlines. It is removed if an earlier
line, by (document id, line number), is equal to it, or, from ``min_near_chars`` characters on,
is at most one character edit away. Blank lines stay.

The method is a deletion-neighbourhood join. A line of n characters has n variants with one
character deleted, too many to emit for every line of a corpus. The same idea with longer
deletions comes first, and only lines that meet another one go on:

1. one of two halves deleted: at most four hashed keys per line;
2. one block of 64 characters deleted: n / 64 keys;
3. one character of that block deleted: at most 65 keys, joined and verified.

Lines at most one edit apart share a key at each level, so nothing is lost. Lines that share a
key of the third level with the gap at one place all differ in that place only, and a line
shares an insertion key with one shorter line only. So comparing each with the earliest on the
other side is complete, and no key group is ever paired with itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from anbar.llm.common import small, table, written

BLOCK_CHARS = 64
BLANKS = " \t\r\x0b\x0c"
#: Where a line stands. Ids may repeat or be null, so the hash of the text tells rows apart.
PLACE = ("id", "text_hash", "no")


def _lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, text_hash, no, line) of the non-blank lines, no from 0."""
    split = docs.select(
        F.col(key).alias("id"), F.xxhash64(text).alias("text_hash"),
        F.posexplode(F.split(F.col(text), "\n")).alias("no", "raw"),
    )
    return split.select(*PLACE, F.trim("raw", F.lit(BLANKS)).alias("line")).where(F.col("line") != "")


def _hashes() -> dict[str, Column]:
    return {"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit("second"), F.col("line"))}


def _gap_key(line: Column, least: Column, start: Column, end: Column, level: int) -> Column:
    """Hash of a line without what lies between ``start`` and the part ``end`` .. ``least``.

    ``least`` is the length of the shorter line of a pair. The part before the gap is counted
    from the left and the part after it from the right, so the longer line has one character
    more in the gap.
    """
    before = F.substring(line, F.lit(1), start)
    after = F.right(line, least - end)
    return F.xxhash64(F.lit(level), least, start, before, after)


def _half_keys(min_chars: int) -> Column:
    line, n = F.col("line"), F.length("line")
    keys = []
    for least in (n, n - 1):
        half = F.floor(least / 2).cast("int")
        zero = F.lit(0)
        for start, end in ((zero, half), (half, least)):
            keys.append(F.when(least >= min_chars, _gap_key(line, least, start, end, 1)))
    return F.array(*keys)


def _shared(rows: DataFrame, key: str) -> DataFrame:
    """The rows whose key two different lines have."""
    keys = rows.groupBy(key).agg(F.min("h1").alias("a"), F.max("h1").alias("b"))
    return rows.join(keys.where("a <> b").select(key), key, "left_semi")


def _blocks(lines: DataFrame, min_chars: int) -> DataFrame:
    """One row per line, shorter length and block: the key and the characters in the block."""
    n = F.length("line")
    lengths = lines.select("*", F.explode(F.array(n, n - 1)).alias("least")).where(
        F.col("least") >= min_chars
    )
    last = F.floor((F.col("least") - 1) / BLOCK_CHARS).cast("int")
    starts = lengths.select("*", F.explode(F.sequence(F.lit(0), last)).alias("block"))
    start = F.col("block") * BLOCK_CHARS
    end = F.least(start + BLOCK_CHARS, F.col("least"))
    inside = F.substring("line", start + 1, n - (F.col("least") - end) - start)
    return starts.select(
        *PLACE, "h1", "h2",
        (n > F.col("least")).alias("longer"),
        _gap_key(F.col("line"), F.col("least"), start, end, 2).alias("key"),
        inside.alias("inside"),
    )


def _deletions(blocks: DataFrame) -> DataFrame:
    """The variants within the bound: one character deleted at each place, or none."""
    inside = F.col("inside")
    places = F.sequence(F.lit(0), F.length("inside") - 1)

    def without(i: Column) -> Column:
        return F.concat(F.substring(inside, F.lit(1), i), F.substring(inside, i + 2, F.length(inside)))

    inserted = F.lit(-1)
    replaced = F.transform(places, lambda i: F.xxhash64("key", i, without(i)))
    whole = F.array(F.xxhash64("key", inserted, inside))
    shortened = F.transform(places, lambda i: F.xxhash64("key", inserted, without(i)))
    variants = F.when(F.col("longer"), F.array_distinct(shortened)).otherwise(
        F.concat(replaced, whole)
    )
    return blocks.select(
        *PLACE, "h1", "h2", "longer", "inside", F.explode(variants).alias("variant")
    )


def _near_removed(firsts: DataFrame, lines: DataFrame, min_chars: int, broadcast_rows: int):
    """(h1, h2) of the distinct lines that are one edit away from an earlier line."""
    halves = firsts.select("h1", F.explode("halves").alias("half")).where("half is not null")
    meeting = written(_shared(halves, "half").select("h1").distinct())
    if small(meeting, broadcast_rows):
        meeting = F.broadcast(meeting)
    texts = lines.withColumns(_hashes()).join(meeting, "h1", "left_semi")
    candidates = texts.groupBy("h1", "h2").agg(
        F.min(F.struct(*PLACE)).alias("at"), F.min("line").alias("line")
    )
    candidates = written(candidates.select("at.*", "h1", "h2", "line"))
    variants = written(_deletions(_shared(_blocks(candidates, min_chars), "key")))
    place = F.struct(*PLACE, "inside")
    earliest = variants.groupBy("variant").agg(
        F.min(F.when(~F.col("longer"), place)).alias("short"),
        F.min(F.when(F.col("longer"), place)).alias("long"),
        F.count("*").alias("members"),
    )
    # A key of one line needs no join; of replacement keys only the short side is filled.
    met = variants.join(earliest.where("members > 1"), "variant")
    other = (
        F.when(F.col("longer"), F.col("short"))
        .when(F.col("long").isNotNull(), F.col("long"))
        .otherwise(F.col("short"))
    )
    pairs = met.withColumn("other", other).where(
        F.struct(*[f"other.{c}" for c in PLACE]) < F.struct(*PLACE)
    )
    close = F.levenshtein("inside", F.col("other.inside"), 1).between(0, 1)
    return pairs.where(close).select("h1", "h2").distinct()


def kept_lines(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    min_near_chars: int = 16,
    broadcast_rows: int = 500_000,
) -> DataFrame:
    """(id, text_hash, nos): numbers of the lines that stay, for each text with at least one.

    A line below ``min_near_chars`` has an edit bound of 0, a longer one of 1; numbers of list
    items are thus not taken for copies. Null texts have no lines. Null ids come first; of rows
    that repeat an id, the one whose text has the smaller hash. Equal rows, with the same id and
    text, share their fate: they count as one.
    ``broadcast_rows`` bounds a broadcast of 8-byte hashes; beyond it the lines are shuffled.
    """
    lines = _lines(docs, key, text)
    firsts = written(
        lines.withColumns(_hashes())
        .withColumn("halves", _half_keys(min_near_chars))
        .groupBy("h1", "h2")
        .agg(F.min(F.struct(*PLACE)).alias("at"), F.min("halves").alias("halves"))
        .select("at.*", "h1", "h2", "halves")
    )
    near = _near_removed(firsts, lines, min_near_chars, broadcast_rows)
    stay = firsts.join(near, ["h1", "h2"], "left_anti")
    return stay.groupBy("id", "text_hash").agg(F.collect_list("no").alias("nos"))


def line_dedup(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    min_near_chars: int = 16,
    report: dict[str, str] | None = None,
) -> DataFrame:
    """``docs`` with the kept and the blank lines of each text, in their order, untrimmed.

    Null texts stay null; a text whose lines all go keeps its blank lines or becomes empty.
    ``report`` may name columns to add: {"lines": name, "kept": name} of non-blank lines.
    """
    kept = kept_lines(docs, key, text, min_near_chars)
    kept = kept.select(F.col("id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("nos").alias("__nos"))
    # The hash first: rows without an id must not meet in one task.
    same = (F.xxhash64(docs[text]) == kept["__hash"]) & docs[key].eqNullSafe(kept["__id"])
    joined = docs.join(kept, same, "left")
    numbered = F.transform(
        "__parts", lambda raw, i: F.when(F.trim(raw, F.lit(BLANKS)) == "", i)
    )
    mine = F.coalesce("__nos", F.array().cast("array<int>"))
    steps = {
        "__parts": F.split(F.col(text), "\n"),
        "__blanks": F.array_compact(numbered),
        "__stay": F.when(F.col(text).isNotNull(), mine),
        "__clean": F.array_join(
            F.transform(F.array_sort(F.concat("__stay", "__blanks")), lambda i: F.get("__parts", i)),
            "\n",
        ),
    }
    for name, step in steps.items():  # one projection each, so that none is computed twice
        joined = joined.withColumn(name, step)
    extra = {
        "lines": F.coalesce(F.size("__parts") - F.size("__blanks"), F.lit(0)).cast("long"),
        "kept": F.when(F.col(text).isNull(), 0).otherwise(F.size("__stay")).cast("long"),
    }
    return joined.select(
        *[F.col("__clean").alias(c) if c == text else F.col(c) for c in docs.columns],
        *[extra[k].alias(v) for k, v in (report or {}).items()],
    )


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup(docs, report={"lines": "n_lines", "kept": "n_kept"})
    return out.select("doc_id", "n_lines", "n_kept", F.md5("text").alias("text_md5"))


#: Quadratic in lines of like length, so independent of the variants; for small tables.
SQL = r"""
WITH raw AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS raw,
         generate_subscripts(string_split(text, chr(10)), 1) - 1 AS no
  FROM documents
), lines AS (
  SELECT doc_id, no, raw, trim(raw, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS line FROM raw
), firsts AS (
  SELECT line, min((doc_id, no)) AS pos, length(line) AS n FROM lines WHERE line <> '' GROUP BY line
), near AS (
  SELECT DISTINCT s.line
  FROM firsts s, (SELECT unnest([n - 1, n, n + 1]) AS near_n, line, pos, n FROM firsts WHERE n >= 16) t
  WHERE s.n = t.near_n AND s.n >= 16 AND t.pos < s.pos
    AND (left(s.line, s.n // 2) = left(t.line, s.n // 2)
      OR left(s.line, t.n // 2) = left(t.line, t.n // 2)
      OR right(s.line, s.n - 1 - s.n // 2) = right(t.line, s.n - 1 - s.n // 2)
      OR right(s.line, t.n - 1 - t.n // 2) = right(t.line, t.n - 1 - t.n // 2))
    AND levenshtein(s.line, t.line) <= 1
), marked AS (
  SELECT l.doc_id, l.no, l.raw, l.line <> '' AS counted,
         l.line = '' OR ((l.doc_id, l.no) = f.pos AND l.line NOT IN (SELECT line FROM near)) AS stays
  FROM lines l LEFT JOIN firsts f ON f.line = l.line
)
SELECT d.doc_id,
       count(*) FILTER (WHERE counted) AS n_lines,
       count(*) FILTER (WHERE counted AND stays) AS n_kept,
       CASE WHEN d.text IS NOT NULL
            THEN md5(coalesce(string_agg(raw, chr(10) ORDER BY no) FILTER (WHERE stays), '')) END AS text_md5
FROM documents d LEFT JOIN marked m ON m.doc_id = d.doc_id
GROUP BY d.doc_id, d.text
"""
