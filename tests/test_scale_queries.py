"""What the registered queries keep while they run, on small tables of their own."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from anbar.config import CANONICAL_TO_PERSIAN, Config
from anbar.operators import cleaning
from anbar.sources.sinks import write_bi_export
from catalog import spark_queries as catalog


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Twelve parts with a line in most of 30 months."""
    folder = str(tmp_path_factory.mktemp("tables"))
    lines = []
    for p in range(1, 13):
        for m in range(30):
            if (p * 5 + m) % 6:
                day = datetime.datetime(1996 + m // 12, m % 12 + 1, (p + m) % 27 + 1)
                lines.append((m * 20 + p, p, p % 3, 1 + m % 7, float((p * 7 + m * 3) % 50 + 1), "ANR"[m % 3], "OF"[p % 2], day))
    spark.createDataFrame(
        lines,
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double,"
        " l_returnflag string, l_linestatus string, l_shipdate timestamp",
    ).write.parquet(f"{folder}/lineitem.parquet")
    parts = [(p, f"name {p}", f"Brand#{p % 4}", f"TYPE {p % 5}") for p in range(1, 13)]
    columns = "p_partkey bigint, p_name string, p_brand string, p_type string"
    spark.createDataFrame(parts, columns).write.parquet(f"{folder}/part.parquet")
    orders = spark.range(0, 700).select(
        F.col("id").alias("o_orderkey"), (F.col("id") % 11).alias("o_custkey"),
        F.concat(F.lit("P"), (F.col("id") % 5).cast("string")).alias("o_orderpriority"),
    )
    orders.write.parquet(f"{folder}/orders.parquet")
    return folder


def cached_frames(spark) -> int:
    return len(spark.sparkContext._jsc.getPersistentRDDs())


def test_ranking_reads_stored_features_and_no_cached_panel(spark, tables):
    before = cached_frames(spark)
    rows, names = catalog.feature_rows(spark, tables)
    assert rows.columns == [*names, "target"]
    assert catalog.top_features(spark, tables).count() == min(10, len(names))
    assert cached_frames(spark) == before


def test_short_dictionaries_are_looked_up_first(spark, monkeypatch):
    """What crosses an exchange for a long dictionary carries codes of the other labels."""
    rows = [(i, f"w{i}", f"s{i % 2}", f"u{i % 5}") for i in range(40)]
    df = spark.createDataFrame(rows, "seq int, doc_type string, status string, unit string")
    asked = []
    join = cleaning.join_counted
    monkeypatch.setattr(cleaning, "join_counted", lambda left, right, keys, *a: asked.extend(keys) or join(left, right, keys, *a))
    codes = cleaning.encode_labels(df, cleaning.label_dictionary(df), Config())
    assert asked == ["status", "unit", "doc_type"]
    assert codes.columns == df.columns
    assert [tuple(r) for r in codes.orderBy("seq").collect()] == [(i, i, i % 2, i % 5) for i in range(40)]


@pytest.mark.parametrize("headers", [False, True])
def test_abc_sheet_of_the_export_is_read_from_it(spark, tmp_path, headers):
    """Without a given sheet the export's rows are made once."""
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rows = [("1403/01", datetime.date(2024, 4, 1), 1, "A", 1, 1403, "1403/01/05")] * 3
    rows += [("1402/12", datetime.date(2024, 3, 1), 2, "C", 2, 1402, "1402/12/20")]
    schema = "jalali_month string, month_start date, product_code bigint, abc_class string, month_rank int, jalali_year int, jalali_date string"
    df = spark.createDataFrame(rows, schema).mapInArrow(counted, schema)
    paths = write_bi_export(df, str(tmp_path), headers=headers)
    assert made.value == 4
    assert spark.read.parquet(paths["PowerBI_Data"]).count() == 4
    sheet = spark.read.parquet(paths["ABC_Analysis"])
    assert sheet.columns[0] == (CANONICAL_TO_PERSIAN["jalali_month"] if headers else "jalali_month")
    assert sorted(tuple(r)[2:4] for r in sheet.collect()) == [(1, "A"), (2, "C")]


def test_raw_rows_are_read_once_for_dictionary_and_codes(spark):
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rows = [(i, "1403/01/05", str(i % 3), "4", f"w{i % 9}", f"c{i}") for i in range(30)]
    schema = "seq int, jalali_date string, product_code string, qty string, warehouse string, counterparty string"
    raw = spark.createDataFrame(rows, schema).mapInArrow(counted, schema)
    cleaned, _ = cleaning.clean_transactions(raw, Config(broadcast_rows=0))
    got = cleaned.select("seq", "product_code", "warehouse", "counterparty").collect()
    assert made.value == 30
    assert sorted(map(tuple, got)) == [(i, i % 3, i % 9, i) for i in range(30)]
