"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; its
result is written as Parquet and read again. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anbar.llm.common import small, table, word_count, written
from anbar.llm.line_dedup import line_dedup
from anbar.llm.minhash_dedup import near_duplicates
from anbar.llm.mixing import mix, shuffled
from anbar.llm.packing import pack, vocabulary
from anbar.llm.quality import judged

BROADCAST_ROWS = 500_000


def _numbered(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """``docs`` with a number per row and the hash of its text, and the names of the two.

    The numbers are fixed once written, so a row has one whatever its id, or without one.
    """
    row, text_hash = "__row", "__hash"
    taken = {c.lower() for c in docs.columns}
    while row in taken or text_hash in taken:
        row, text_hash = f"_{row}", f"_{text_hash}"
    numbers = {row: F.monotonically_increasing_id(), text_hash: F.xxhash64("text")}
    return written(docs.withColumns(numbers)), row, text_hash


def _without(docs: DataFrame, row: str, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose number is not in ``gone``."""
    gone = written(gone.select(F.col(row).alias("gone")))
    if small(gone, BROADCAST_ROWS):
        gone = F.broadcast(gone)
    return docs.join(gone, docs[row] == gone["gone"], "left_anti")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the learned decision list reject go, each row by its text."""
    numbered, row, _ = _numbered(docs)
    verdicts = judged(numbered, table(spark, sf_dir, "labels"), also=[row])
    return _without(numbered, row, verdicts.where(~F.col("kept"))).select(docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that occur earlier in the corpus, or nearly, go; documents stay, n_chars follows."""
    clean = line_dedup(docs)
    if "n_chars" in clean.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row stays: the one with the smallest id.

    Rows without an id come last; of rows that share an id, the one with the smaller hash of its
    text, and of equal rows one.
    """
    numbered, row, text_hash = _numbered(docs)
    groups = written(near_duplicates(numbered, key=row).select(row, "component_id"))
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", text_hash, row)
    ranked = groups.join(numbered.select(row, "doc_id", text_hash), row)
    stays = ranked.groupBy("component_id").agg(F.min(place)[row].alias("stays"))
    gone = groups.join(stays, groups[row] == stays["stays"], "left_anti")
    return _without(numbered, row, gone).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, in the order of the mix."""
    return shuffled(mix(docs, word_count(F.col("text")))).select("row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixed documents with their place in sequences of 2048 tokens."""
    return pack(docs, vocabulary())


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", dedup_lines),
    ("minhash near-dedup", near_dedup),
    ("source mixing", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: SQL can express neither the sampling nor the mix nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs


QUERIES = {"pipeline": run}
ORACLE = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
