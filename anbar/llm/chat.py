"""Chat formatting with cumulative-snapshot collapse.

Loggers often write a conversation again after each turn. A conversation whose turns are the
first turns of a longer one, or an exact copy of one with a smaller id, is dropped; the rest is
rendered with a chat template.

Every turn gets a hash of all turns up to it (two 64-bit values, combined by xor of hashes that
include the place, so the order counts). A conversation is a prefix of another if its last hash
is one of the other's earlier ones: an anti-join on equal hashes, without pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from anbar.llm.common import table, written


def _turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place from 1, role, text), without repeated rows and rows without id."""
    rows = conversations.where("conv_id is not null").select(
        "conv_id", "turn",
        F.coalesce("role", F.lit("unknown")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    rows = rows.dropDuplicates()
    order = Window.partitionBy("conv_id").orderBy(
        F.col("turn").asc_nulls_last(), F.col("role"), F.col("text")
    )
    return rows.withColumn("place", F.row_number().over(order)).drop("turn")


def _rolling(turns: DataFrame) -> DataFrame:
    """Adds h1 and h2, the hashes of all turns up to this one."""
    upto = Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)

    def rolled(salt: int) -> Column:
        return F.bit_xor(F.xxhash64(F.lit(salt), "place", "role", "text")).over(upto)

    return turns.withColumns({"h1": rolled(1), "h2": rolled(2)})


def maximal(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies) of the conversations that stay.

    ``n_copies`` counts the conversations with the same turns, itself included. Turns are
    ordered by ``turn`` (null last), then role and text; repeated rows count once; a null role
    is "unknown", a null text is empty; rows without conv_id belong to no conversation.
    """
    marks = written(_rolling(_turns(conversations)).select("conv_id", "place", "h1", "h2"))
    lengths = marks.groupBy("conv_id").agg(
        F.max("place").alias("n_turns"),
        F.max_by("h1", "place").alias("h1"),
        F.max_by("h2", "place").alias("h2"),
    )
    classes = lengths.groupBy("n_turns", "h1", "h2").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies")
    )
    # Turn 1 .. n-1 of every conversation class; a class stands for all its copies.
    firsts = marks.join(classes.select("conv_id", "n_turns"), "conv_id").where("place < n_turns")
    prefixes = firsts.select(F.col("place").alias("n_turns"), "h1", "h2").distinct()
    return classes.join(prefixes, ["n_turns", "h1", "h2"], "left_anti").select(
        "conv_id", "n_turns", "n_copies"
    )


def render(
    conversations: DataFrame,
    start: str = "<|im_start|>",
    end: str = "<|im_end|>",
) -> DataFrame:
    """One row per maximal conversation: conv_id, n_turns, n_copies, text."""
    kept = maximal(conversations)
    turns = _turns(conversations).join(kept, "conv_id")
    line = F.concat(F.lit(start), "role", F.lit("\n"), "text", F.lit(f"{end}\n"))
    lines = turns.withColumn("line", line).groupBy("conv_id").agg(
        F.max("n_turns").cast("long").alias("n_turns"),
        F.max("n_copies").alias("n_copies"),
        F.sort_array(F.collect_list(F.struct("place", "line"))).alias("lines"),
    )
    return lines.select(
        "conv_id", "n_turns", "n_copies", F.array_join("lines.line", "").alias("text")
    )


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render(table(spark, sf_dir, "conversations"))


#: Compares whole renderings instead of hashes.
SQL = r"""
WITH rows AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text) AS place,
         '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS line
  FROM rows
), upto AS (
  SELECT conv_id, place, string_agg(line, '') OVER (PARTITION BY conv_id ORDER BY place) AS head,
         count(*) OVER (PARTITION BY conv_id) AS n
  FROM turns
), whole AS (
  SELECT min(conv_id) AS conv_id, n AS n_turns, count(*) AS n_copies, head AS text
  FROM upto WHERE place = n GROUP BY n, head
)
SELECT conv_id, n_turns, n_copies, text FROM whole
WHERE text NOT IN (SELECT head FROM upto WHERE place < n)
"""
