"""What the panel moves and writes on its way."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from anbar.config import Config
from anbar.operators import panel as panels
from anbar.plans.session import stored

CFG = Config()


def prepared_rows(spark, products: int = 6, months: int = 16):
    """A row per product and month, some products without sales in some months."""
    rows = []
    for p in range(products):
        for m in range(months):
            if (p + m) % 4:
                day = datetime.date(2020 + m // 12, m % 12 + 1, 10)
                rows.append((p, f"name {p}", float(p * 7 + m % 5 + 1), day, 1))
    df = spark.createDataFrame(
        rows, "product_code bigint, product_name string, qty double, gregorian_date date, working_day int"
    )
    return df.withColumns(
        {
            "month_start": F.trunc("gregorian_date", "MM"),
            "jalali_month": F.date_format(F.add_months("gregorian_date", -621 * 12), "yyyy/MM"),
        }
    )


def test_stored_rows_are_the_same_and_dealt_by_key(spark):
    rows = [(i % 7 if i % 5 else None, i, f"t{i}" if i % 3 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, v int, t string")
    kept = stored(df, "k")
    assert kept.dtypes == df.dtypes
    assert sorted(map(str, kept.collect())) == sorted(map(str, df.collect()))
    counted = kept.unionByName(kept).groupBy("k", "t").count()
    assert "Exchange" not in counted._jdf.queryExecution().executedPlan().toString()


def test_stored_gives_its_shuffle_files_back(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    stored(spark.range(100).groupBy(F.col("id") % 3).count().toDF("k", "n"), "k")
    assert spark.conf.get(name) == before


def test_panel_does_not_move_its_grid(spark):
    f = panels.facts(prepared_rows(spark), CFG)
    panel = panels.panel_from_facts(f, CFG)
    assert "Exchange" not in panel.frame._jdf.queryExecution().executedPlan().toString()
    assert panel.frame.count() == 6 * panel.months


def test_facts_hold_the_sums_and_ranks_of_both_jalali_months(spark):
    f = panels.facts(prepared_rows(spark), CFG)
    got = {(r["product_code"], r["month_start"]): r for r in f.monthly.collect()}
    ranks = {(r["product_code"], r["jalali_month"]): r["month_rank"] for r in f.abc.collect()}
    cells = prepared_rows(spark).collect()
    assert set(got) == {(r["product_code"], r["month_start"]) for r in cells}
    for r in cells:
        found = got[r["product_code"], r["month_start"]]
        assert found["original_target"] == r["qty"]
        assert found["month_rank"] == ranks[r["product_code"], r["jalali_month"]]
