"""Near-duplicate embeddings by random-hyperplane sign hashing.

Signs of projections on random hyperplanes put vectors with a small angle into equal buckets
with high probability; several tables make a miss improbable. Inside the buckets all cosines
are computed exactly. Equal vectors are one class from the start, and a bucket above
``block_rows`` is cut into chunks whose pairs are separate tasks, so neither copies nor hot
buckets gather anywhere. Tasks return link counts and a spanning forest, never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anbar.config import Config
from anbar.llm.common import small, table, written
from anbar.llm.components import components
from anbar.operators.joins import join_counted


def table_shape(rows: int, cosine: float, bucket_rows: int = 1024, miss: float = 1e-4) -> tuple[int, int]:
    """(bits, tables): buckets of about ``bucket_rows`` unrelated vectors, and so many tables
    that a pair at exactly ``cosine`` is missed with probability ``miss``; closer pairs less."""
    bits = min(60, max(1, math.ceil(math.log2(max(2, rows / bucket_rows)))))
    agree = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(miss) / math.log(1 - agree)))


def _codes(x: np.ndarray, bits: int, tables: int, seed: int) -> np.ndarray:
    planes = np.random.default_rng([seed, x.shape[1]]).standard_normal((x.shape[1], bits * tables))
    signs = (x @ planes > 0).reshape(len(x), tables, bits)
    place = np.left_shift(np.int64(1), np.arange(bits, dtype=np.int64))
    return signs.astype(np.int64) @ place


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column, end to end, and the length of each list."""
    lengths = np.diff(column.offsets.to_numpy())
    return column.flatten().to_numpy().astype(np.float64), lengths


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two that bring their largest component near 1.

    Products and cosines keep all their digits, and very large or small components neither
    overflow nor vanish in the squares.
    """
    if not x.size:
        return x
    _, power = np.frexp(np.abs(x).max(axis=1))
    return np.ldexp(x, -power[:, None])


def _sign(vectors: DataFrame, bits: int, tables: int, seed: int) -> DataFrame:
    """Adds the codes of a vector, one per table."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, lengths = _matrix(batch.column(2))
            codes = np.empty((len(lengths), tables), np.int64)
            ends = np.cumsum(lengths)
            for n in np.unique(lengths):
                at = np.flatnonzero(lengths == n)
                x = scaled(flat[(ends[at] - n)[:, None] + np.arange(n)])
                codes[at] = _codes(x, bits, tables, seed)
            offsets = np.arange(len(lengths) + 1, dtype=np.int32) * tables
            column = pa.ListArray.from_arrays(offsets, codes.ravel())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, column], names=["rep", "copies", "vec", "codes"]
            )

    kind = vectors.schema["vec"].dataType.simpleString()
    return vectors.mapInArrow(signed, f"rep long, copies long, vec {kind}, codes array<long>")


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index each of 0 .. n-1 reaches over the links a - b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        root = root[root]
        while (root != root[root]).any():
            root = root[root]
        if (root == before).all():
            return root


def _links(cosine: float, step: int = 512):
    def of_cell(cell: pa.Table) -> pa.Table:
        cell = cell.combine_chunks()
        tab, crossing = cell["tab"][0].as_py(), cell["low"][0].as_py() != cell["high"][0].as_py()
        rep = cell["rep"].to_numpy()
        order = np.argsort(rep, kind="stable")
        rep = rep[order]
        copies = cell["copies"].to_numpy()[order]
        chunk = cell["chunk"].to_numpy()[order]
        flat, lengths = _matrix(cell["vec"].chunk(0))
        x = scaled(flat.reshape(len(rep), int(lengths[0]))[order])
        codes = cell["codes"].chunk(0).flatten().to_numpy().reshape(len(rep), -1)[order]
        norm = np.sqrt((x * x).sum(axis=1))
        count = np.zeros(len(rep), np.int64)
        left, right = [], []
        for at in range(0, len(rep), step):
            mine = slice(at, min(at + step, len(rep)))
            dots = x[mine] @ x.T
            i, j = np.nonzero(dots >= cosine * (norm[mine, None] * norm[None, :]))
            i = i + at
            keep = i < j
            if crossing:
                keep &= chunk[i] != chunk[j]
            i, j = i[keep], j[keep]
            if tab:  # a pair counts in the first table that holds it
                new = np.ones(len(i), bool)
                for t in range(tab):
                    new &= codes[i, t] != codes[j, t]
                i, j = i[new], j[new]
            np.add.at(count, i, copies[j])
            np.add.at(count, j, copies[i])
            # A forest of the links so far stands for them.
            left.append(i)
            right.append(j)
            root = forest(len(rep), np.concatenate(left), np.concatenate(right))
            left, right = [np.arange(len(rep))], [root]
        linked = count > 0
        return pa.table({"id": rep[linked], "n": count[linked], "to": rep[root][linked]})

    return of_cell


def near_vectors(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    cosine: float = 0.95,
    block_rows: int = 2048,
    broadcast_rows: int = 200_000,
    seed: int = 2,
    cfg: Config | None = None,
) -> DataFrame:
    """(key, n_links, component_id, kept), one row per row of ``vectors``.

    Links join rows whose vectors have one length and ``cosine`` or more, in double precision,
    whatever their ids. Null, zero and empty vectors, and vectors with null or non-finite
    components, link with nothing. ``component_id`` is the smallest id of the component, null if
    none of its rows has one; rows of such a component are kept, other rows without id are not.
    """
    cfg = cfg or Config()
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists("vec", lambda x: x != 0)
    usable = F.coalesce(F.col("vec").isNotNull() & finite & some, F.lit(False))
    hashes = {
        "h1": F.when(usable, F.xxhash64("vec")),
        "h2": F.when(usable, F.xxhash64(F.lit("second"), "vec")),
    }
    ids = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vec"))
    ids = written(ids.withColumns(hashes))
    classes = ids.where("h1 is not null").groupBy("h1", "h2").agg(
        F.min("id").alias("first"), F.count("*").alias("copies"), F.min("vec").alias("vec")
    )
    # Different vectors may share an id, so classes are numbered; the number is fixed once written.
    classes = written(classes.withColumn("rep", F.monotonically_increasing_id()))
    bits, tables = table_shape(classes.count(), cosine)
    signed = written(_sign(classes.select("rep", "copies", "vec"), bits, tables, seed))
    length = F.size("vec").alias("length")
    code = F.posexplode("codes").alias("tab", "code")
    sizes = signed.select(length, code).groupBy("tab", "code", "length").agg(F.count("*").alias("n"))
    chunks = F.ceil(F.col("n") / block_rows).alias("chunks")
    hot = written(sizes.where(F.col("n") > block_rows).select("tab", "code", "length", chunks))
    if small(hot, broadcast_rows):
        hot = F.broadcast(hot)
    rows = signed.select("rep", "copies", "vec", "codes", length, code)
    rows = rows.join(hot, ["tab", "code", "length"], "left")
    chunk = F.pmod(F.xxhash64("rep"), F.coalesce("chunks", F.lit(1))).alias("chunk")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("chunks", F.lit(1)) - 1))
    cells = rows.select("*", chunk).select("*", other.alias("other"))
    cell = ["tab", "code", "length", "low", "high"]
    cells = cells.select(
        "tab", "code", "length",
        F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"),
        "rep", "copies", "chunk", "vec", "codes",
    )
    found = written(cells.groupBy(*cell).applyInArrow(_links(cosine), "id long, n long, to long"))
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    joined = components(found, "id", "to")
    linked = classes.select("rep", "first").join(joined.withColumnRenamed("id", "rep"), "rep")
    heads = linked.groupBy("component").agg(F.min("first").alias("head"), F.count("*").alias("members"))
    of_class = (
        classes.select("h1", "h2", "rep", "first", "copies")
        .join(counts.withColumnRenamed("id", "rep"), "rep", "left")
        .join(joined.withColumnRenamed("id", "rep"), "rep", "left")
    )
    of_class = join_counted(of_class, written(heads), ["component"], "members", cfg)
    of_class = of_class.select(
        "h1", "h2", "copies",
        (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("head", "first").alias("component_id"),
    )
    out = join_counted(ids.drop("vec"), written(of_class), ["h1", "h2"], "copies", cfg)
    component = F.coalesce("component_id", F.when(F.col("h1").isNull(), F.col("id")))
    return out.select(
        F.col("id").alias(key),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, component.isNull()).alias("kept"),
    )


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


#: All pairs; for small tables.
SQL = """
WITH RECURSIVE vectors AS MATERIALIZED (
  SELECT row_number() OVER () AS no, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v
  FROM embeddings
), usable AS (
  SELECT * FROM vectors
  WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(v, lambda x: x <> 0)) > 0
), links AS MATERIALIZED (
  SELECT a.no AS a, b.no AS b, b.vec_id AS b_id FROM usable a JOIN usable b ON a.no <> b.no
  WHERE list_dot_product(a.v, b.v)
        / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= 0.95
), reach AS (
  SELECT no, vec_id AS root FROM vectors WHERE vec_id IS NOT NULL
  UNION
  SELECT links.b, reach.root FROM reach JOIN links ON links.a = reach.no
  WHERE links.b_id IS NULL OR reach.root < links.b_id
), roots AS (
  SELECT no, min(root) AS component_id FROM reach GROUP BY no
), degrees AS (
  SELECT a AS no, count(*) AS n FROM links GROUP BY a
)
SELECT v.vec_id, coalesce(d.n, 0) AS n_links, r.component_id,
       coalesce(v.vec_id = r.component_id, r.component_id IS NULL) AS kept
FROM vectors v LEFT JOIN roots r USING (no) LEFT JOIN degrees d USING (no)
"""
