"""Independent DuckDB SQL for the registered queries.

Built from named common table expressions; each query lists the ones it needs.
"""

from __future__ import annotations

MONTHS = (
    "['فروردین','اردیبهشت','خرداد','تیر','مرداد','شهریور',"
    "'مهر','آبان','آذر','دی','بهمن','اسفند']"
)


def r(expr: str, places: int) -> str:
    """Half-even rounding, as the Spark side does it."""
    scale = f"1e{places}"
    return f"round_even(({expr}) * {scale}, 0) / {scale}"


def tx(variant: str = "plain", labels: bool = False) -> str:
    qty, extra, orders = "l_quantity", "", ""
    code = "l_partkey * 1000000 + l_suppkey" if variant == "small" else "l_partkey"
    if variant == "returns":
        qty = (
            "CASE WHEN l_partkey % 50 = 0 OR (l_returnflag = 'R' AND l_linenumber = 7) "
            "THEN -l_quantity ELSE l_quantity END"
        )
    if labels:
        orders = "JOIN orders ON l_orderkey = o_orderkey"
        extra = """, l_returnflag AS doc_type, l_linestatus AS status, p_type AS product_nature,
            p_brand AS unit, CAST(l_suppkey AS VARCHAR) AS warehouse,
            CAST(o_custkey AS VARCHAR) AS counterparty, o_orderpriority AS consumption_location"""
    return f"""tx AS (
        SELECT {code} AS product_code, p_name AS product_name, {qty} AS qty,
            CAST(l_shipdate AS DATE) AS gregorian_date, l_orderkey, l_linenumber{extra}
        FROM lineitem JOIN part ON l_partkey = p_partkey {orders})"""


def jalali(source: str, date: str, name: str, keep: str = "*") -> str:
    """CTE chain adding jy, jm, jd of a date column."""
    return f"""{name}_0 AS (
        SELECT {keep}, datediff('day', DATE '2024-03-20', {date}) + 1094997 AS d0 FROM {source}),
    {name}_1 AS (SELECT *, d0 % 12053 AS r33, (d0 % 12053) % 1461 AS r4 FROM {name}_0),
    {name}_2 AS (
        SELECT *, -1595 + 33 * (d0 // 12053) + 4 * (r33 // 1461)
                + CASE WHEN r4 > 365 THEN (r4 - 1) // 365 ELSE 0 END AS jy,
            CASE WHEN r4 > 365 THEN (r4 - 1) % 365 ELSE r4 END AS rest FROM {name}_1),
    {name} AS (
        SELECT * EXCLUDE (d0, r33, r4, rest, jy), CAST(jy AS INTEGER) AS jy,
            CAST(CASE WHEN rest < 186 THEN 1 + rest // 31
                 ELSE 7 + (rest - 186) // 30 END AS INTEGER) AS jm,
            CAST(CASE WHEN rest < 186 THEN 1 + rest % 31
                 ELSE 1 + (rest - 186) % 30 END AS INTEGER) AS jd
        FROM {name}_2)"""


CALENDAR = """cal AS (
        SELECT DISTINCT CAST(l_shipdate AS DATE) AS cal_date,
            CASE WHEN isodow(l_shipdate) = 5 THEN 0 ELSE 1 END AS wd
        FROM lineitem WHERE day(l_shipdate) <> 15)"""

DATED = (
    jalali("tx", "gregorian_date", "jtx")
    + f""",
    {CALENDAR},
    dated AS (
        SELECT jtx.* EXCLUDE (jy, jm, jd),
            format('{{:04d}}/{{:02d}}/{{:02d}}', jy, jm, jd) AS jalali_date,
            jy AS jalali_year, format('{{:04d}}/{{:02d}}', jy, jm) AS jalali_month,
            {MONTHS}[jm] AS jalali_month_name, jd AS jalali_day,
            CAST((jm - 1) // 3 + 1 AS INTEGER) AS jalali_season,
            CAST(year(gregorian_date) AS INTEGER) AS g_year,
            CAST(month(gregorian_date) AS INTEGER) AS g_month,
            CAST(day(gregorian_date) AS INTEGER) AS g_day,
            CAST(isodow(gregorian_date) - 1 AS INTEGER) AS g_weekday,
            CAST(date_trunc('month', gregorian_date) AS DATE) AS month_start,
            CAST(coalesce(wd, 0) AS INTEGER) AS working_day
        FROM jtx LEFT JOIN cal ON gregorian_date = cal_date)"""
)

WINSOR = """logs AS (SELECT *, ln(1 + greatest(qty, 0)) AS lq FROM dated),
    own AS (
        SELECT product_code, count(*) AS n, quantile_cont(lq, 0.25) AS q1,
            quantile_cont(lq, 0.75) AS q3 FROM logs GROUP BY product_code),
    overall AS (
        SELECT quantile_cont(lq, 0.25) AS g1, quantile_cont(lq, 0.75) AS g3 FROM logs),
    quartiles AS (
        SELECT product_code, CASE WHEN n >= 10 THEN q1 ELSE g1 END AS q1,
            CASE WHEN n >= 10 THEN q3 ELSE g3 END AS q3 FROM own, overall),
    treated AS (
        SELECT logs.* EXCLUDE (qty, lq), qty AS original_qty,
            CAST(greatest(round_even(
                CASE WHEN lq < q1 - 1.5 * (q3 - q1) THEN round_even((exp(q1 - 1.5 * (q3 - q1)) - 1) * 1e9, 0) / 1e9
                     WHEN lq > q3 + 1.5 * (q3 - q1) THEN round_even((exp(q3 + 1.5 * (q3 - q1)) - 1) * 1e9, 0) / 1e9
                     ELSE greatest(qty, 0) END, 0), 0) AS BIGINT) AS qty
        FROM logs JOIN quartiles USING (product_code))"""

ABC = f"""monthly AS (
        SELECT jalali_month, product_code, CAST(sum(qty) AS BIGINT) AS month_qty,
            count(*) AS month_txn_count FROM treated GROUP BY ALL),
    ranked AS (
        SELECT *, CAST(row_number() OVER w AS INTEGER) AS month_rank,
            CAST(sum(month_qty) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum,
            CAST(sum(month_qty) OVER (PARTITION BY jalali_month) AS BIGINT) AS total
        FROM monthly WINDOW w AS (PARTITION BY jalali_month ORDER BY month_qty DESC, product_code)),
    abc AS (
        SELECT jalali_month, product_code, month_qty, month_txn_count, month_rank,
            CASE WHEN total > 0 THEN {r('month_qty / total * 100', 2)} ELSE 0 END AS share_pct,
            CASE WHEN total > 0 THEN {r('cum / total * 100', 2)} ELSE 0 END AS cum_pct,
            CASE WHEN total <= 0 THEN 'C' WHEN (cum - month_qty) * 100 < 70 * total THEN 'A'
                 WHEN (cum - month_qty) * 100 < 90 * total THEN 'B' ELSE 'C' END AS abc_class
        FROM ranked)"""

ENRICHED = """enriched AS (
        SELECT treated.*, month_qty, month_txn_count, month_rank, share_pct, cum_pct, abc_class
        FROM treated LEFT JOIN abc USING (jalali_month, product_code))"""

AGG = """agg AS (
        SELECT month_start, product_code, CAST(sum(qty) AS DOUBLE) AS target,
            sum(original_qty) AS original_target, CAST(sum(working_day) AS BIGINT) AS working_day,
            max(month_txn_count) AS month_txn_count, max(share_pct) AS share_pct,
            max(cum_pct) AS cum_pct, max(month_rank) AS month_rank,
            max(jalali_year) AS jalali_year, max(jalali_season) AS jalali_season
        FROM enriched GROUP BY ALL)"""

GRID = """span AS (SELECT min(month_start) AS lo, max(month_start) AS hi FROM dated),
    months AS (
        SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS month_start
        FROM span),
    products AS (SELECT DISTINCT product_code, product_name FROM dated),
    grid AS (SELECT * FROM products, months)"""

PANEL = (
    jalali("months", "month_start", "jmonths")
    + """,
    labelled AS (
        SELECT month_start, format('{:04d}/{:02d}', jy, jm) AS jalali_month,
            CAST((jm - 1) // 3 + 1 AS INTEGER) AS jalali_season FROM jmonths),
    dense AS (
        SELECT g.product_code, g.product_name, g.month_start,
            coalesce(target, 0) AS target, coalesce(original_target, 0) AS original_target,
            coalesce(working_day, 0) AS working_day,
            coalesce(a.month_txn_count, 0) AS month_txn_count,
            coalesce(a.share_pct, 0) AS share_pct, coalesce(a.cum_pct, 0) AS cum_pct,
            coalesce(a.month_rank, 0) AS month_rank, coalesce(jalali_year, 0) AS jalali_year,
            m.jalali_season, m.jalali_month, coalesce(abc_class, 'C') AS abc_class
        FROM grid g JOIN labelled m ON g.month_start = m.month_start
        LEFT JOIN agg a ON g.month_start = a.month_start AND g.product_code = a.product_code
        LEFT JOIN abc c ON c.jalali_month = m.jalali_month AND c.product_code = g.product_code),
    panel AS (
        SELECT *, CASE abc_class WHEN 'A' THEN 1 WHEN 'B' THEN 2 ELSE 3 END AS abc_encoded,
            CAST(month(month_start) AS INTEGER) AS g_month,
            coalesce(lag(target, 1) OVER w, 0) AS lag_1,
            coalesce(lag(target, 2) OVER w, 0) AS lag_2,
            coalesce(lag(target, 3) OVER w, 0) AS lag_3,
            coalesce(avg(target) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 0)
                AS rolling_mean_3,
            coalesce(stddev_samp(target) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 0)
                AS rolling_std_3
        FROM dense WINDOW w AS (PARTITION BY product_code ORDER BY month_start))"""
)

FEATURES = (
    "working_day", "month_txn_count", "share_pct", "cum_pct", "month_rank", "jalali_year",
    "jalali_season", "abc_encoded", "g_month", "lag_1", "lag_2", "lag_3",
    "rolling_mean_3", "rolling_std_3",
)


def with_(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n    ".join(parts) + "\n"


def chain(upto: str, variant: str = "plain", labels: bool = False) -> list[str]:
    steps = {
        "tx": tx(variant, labels), "dated": DATED, "treated": WINSOR, "abc": ABC,
        "enriched": ENRICHED, "agg": AGG, "grid": GRID, "panel": PANEL,
    }
    names = list(steps)
    return [steps[n] for n in names[: names.index(upto) + 1]]


def query(upto: str, body: str, variant: str = "plain", labels: bool = False, extra=()) -> str:
    return with_(*chain(upto, variant, labels), *extra) + body


LABELS = (
    "doc_type", "status", "product_nature", "unit", "warehouse", "counterparty",
    "consumption_location",
)

DICTIONARY = (
    "pairs AS ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS label, {c} AS value, gregorian_date AS d, l_orderkey, l_linenumber "
        "FROM tx"
        for c in LABELS
    )
    + """),
    dictionary AS (
        SELECT label, value, CAST(row_number() OVER (
            PARTITION BY label ORDER BY min(row(d, l_orderkey, l_linenumber)), value) - 1
            AS INTEGER) AS code, count(*) AS n
        FROM pairs GROUP BY label, value)"""
)

SPLIT = """span2 AS (SELECT lo, datediff('month', lo, hi) + 1 AS n FROM span),
    marked AS (
        SELECT panel.*, datediff('month', lo, month_start) AS ix, n * 4 // 5 AS n_train,
            CASE WHEN datediff('month', lo, month_start) < n * 4 // 5
                 THEN 'train' ELSE 'test' END AS split
        FROM panel, span2)"""

METRICS = ", ".join(
    f"{r(body, 4)} AS {name}"
    for name, body in {
        "MAE": "avg(abs(target - lag_1))",
        "MSE": "avg((target - lag_1) * (target - lag_1))",
        "RMSE": "sqrt(avg((target - lag_1) * (target - lag_1)))",
        "MAPE": "avg(abs((target - lag_1) / CASE WHEN target = 0 THEN 1 ELSE target END)) * 100",
    }.items()
)

CORR = (
    "corr_scores AS ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS Feature, {r(f'coalesce(abs(corr(CAST({c} AS DOUBLE), target)), 0)', 4)}"
        " AS Correlation_Abs FROM panel"
        for c in FEATURES
    )
    + ")"
)

MI = (
    "longform AS ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS name, product_code, month_start, CAST({c} AS DOUBLE) AS v FROM panel"
        for c in (*FEATURES, "target")
    )
    + f"""),
    sorted AS (
        SELECT name, v, row_number() OVER (PARTITION BY name ORDER BY v) AS rn,
            count(*) OVER (PARTITION BY name) AS n FROM longform),
    borders AS (
        SELECT DISTINCT name, v AS b FROM sorted, generate_series(1, 9) g(i)
        WHERE rn = (n * i + 9) // 10),
    binned AS (
        SELECT l.name, l.product_code, l.month_start, count(b) AS bin
        FROM longform l LEFT JOIN borders ON l.name = borders.name AND l.v >= b GROUP BY ALL),
    joint AS (
        SELECT x.name AS Feature, x.bin AS bx, y.bin AS by_, count(*) AS nxy
        FROM binned x JOIN binned y USING (product_code, month_start)
        WHERE y.name = 'target' AND x.name <> 'target' GROUP BY ALL),
    margins AS (
        SELECT *, sum(nxy) OVER (PARTITION BY Feature) AS n,
            sum(nxy) OVER (PARTITION BY Feature, bx) AS nx,
            sum(nxy) OVER (PARTITION BY Feature, by_) AS ny FROM joint),
    mi_scores AS (
        SELECT Feature, {r('sum(nxy / n * ln(nxy * n / (nx * ny)))', 4)} AS Mutual_Information
        FROM margins GROUP BY Feature)"""
)

LIVE = """live AS (
        SELECT product_code, sum(original_target) AS total, count(*) AS rows
        FROM panel GROUP BY product_code HAVING sum(original_target) > 0)"""

LAST = """lastrow AS (
        SELECT panel.* FROM panel JOIN live USING (product_code), span
        WHERE month_start = hi)"""

ROLL = (
    LIVE
    + ",\n    "
    + LAST
    + """,
    steps AS (
        SELECT product_code, product_name, 0 AS horizon, lag_2 AS a, lag_1 AS b, target AS c
        FROM lastrow
        UNION ALL
        SELECT product_code, product_name, horizon + 1, b, c, greatest((a + b + c) / 3, 0)
        FROM steps WHERE horizon < 6),
    ahead AS (
        SELECT product_code, product_name, horizon, c AS forecast,
            CAST(hi + to_months(CAST(horizon AS INTEGER)) AS DATE) AS ds
        FROM steps, span WHERE horizon > 0),
    """
    + jalali("ahead", "ds", "jahead")
    + """,
    forecasts AS (
        SELECT product_code, product_name, ds, format('{:04d}/{:02d}', jy, jm) AS jalali_month,
            horizon, forecast, 'Rolling Mean' AS Model FROM jahead)"""
)

SHEET = jalali("(SELECT month_start, sum(target) AS y FROM panel GROUP BY ALL)", "month_start", "jt")

MINMAX_COLUMNS = ("lag_1", "rolling_mean_3", "target", "g_month")


def scaled_cte() -> str:
    bounds = ", ".join(
        f"min({c}) FILTER (split = 'train') AS lo_{c}, max({c}) FILTER (split = 'train') AS hi_{c}"
        for c in MINMAX_COLUMNS
    )
    values = ", ".join(
        f"(m.{c} - lo_{c}) / CASE WHEN hi_{c} > lo_{c} THEN CAST(hi_{c} - lo_{c} AS DOUBLE) "
        f"ELSE 1 END AS scaled_{c}"
        for c in MINMAX_COLUMNS
    )
    return f"""train_bounds AS (SELECT product_code, {bounds} FROM marked GROUP BY product_code),
    scaled AS (
        SELECT m.product_code, m.month_start, m.split, m.ix, m.n_train, {values}
        FROM marked m JOIN train_bounds USING (product_code))"""


TX_KEYS = "product_code, gregorian_date, original_qty, qty"
ROUNDED_PANEL = (
    f"SELECT * REPLACE ({r('rolling_mean_3', 6)} AS rolling_mean_3, "
    f"{r('rolling_std_3', 6)} AS rolling_std_3) FROM panel"
)
DROP_KEYS = "EXCLUDE (l_orderkey, l_linenumber)"
CODED = "SELECT t.* REPLACE (" + ", ".join(f"d_{c}.code AS {c}" for c in LABELS) + ")"
CODE_JOINS = " ".join(
    f"JOIN dictionary d_{c} ON d_{c}.label = '{c}' AND d_{c}.value = t.{c}" for c in LABELS
)

#: What the documents with faults mean, from the clean columns they were made of.
DIRTY = (
    """shifted AS (
        SELECT l_orderkey, l_linenumber, l_orderkey % 17 AS fault,
            CAST(CASE WHEN l_orderkey % 13 = 5 THEN CAST(l_shipdate AS DATE) - INTERVAL 275 YEAR
                 WHEN l_orderkey % 13 = 6 THEN CAST(l_shipdate AS DATE) + INTERVAL 245 YEAR
                 ELSE CAST(l_shipdate AS DATE) END AS DATE) AS day,
            CASE WHEN l_orderkey % 19 = 1 THEN 9007199254000000000 + l_partkey
                 WHEN l_orderkey % 19 IN (2, 3, 4) THEN NULL
                 WHEN l_orderkey % 19 = 7 THEN l_partkey * 1000 ELSE l_partkey END AS product_code,
            CASE WHEN l_orderkey % 29 = 1 THEN 'نامشخص' ELSE CAST(l_partkey AS VARCHAR) END
                AS product_name,
            CAST(CASE WHEN l_orderkey % 23 = 1 THEN 1000 + l_quantity
                 WHEN l_orderkey % 23 IN (2, 3, 7) THEN 0
                 WHEN l_orderkey % 23 = 4 THEN l_quantity + 0.5
                 WHEN l_orderkey % 23 = 5 THEN l_quantity * 10
                 WHEN l_orderkey % 23 = 6 THEN -l_quantity ELSE l_quantity END AS DOUBLE) AS qty
        FROM lineitem),
    """
    + jalali("shifted", "day", "jdirty")
    + """,
    dirty AS (
        SELECT *, fault IN (1, 2, 3, 7) AS undated, format('{:04d}/{:02d}', jy, jm) AS jm_key
        FROM jdirty)"""
)
WHEN_DATED = "CASE WHEN NOT undated THEN {} END AS {}"
DIRTY_LOGS = """dlogs AS (
        SELECT *, ln(1 + greatest(qty, 0)) AS lq FROM dirty WHERE NOT undated),
    down AS (
        SELECT product_code, count(*) AS n, quantile_cont(lq, 0.25) AS q1,
            quantile_cont(lq, 0.75) AS q3 FROM dlogs GROUP BY product_code),
    dall AS (SELECT quantile_cont(lq, 0.25) AS g1, quantile_cont(lq, 0.75) AS g3 FROM dlogs),
    dq AS (
        SELECT l_orderkey, l_linenumber, d.product_code, qty, lq,
            CASE WHEN n >= 10 AND d.product_code IS NOT NULL THEN q1 ELSE g1 END AS q1,
            CASE WHEN n >= 10 AND d.product_code IS NOT NULL THEN q3 ELSE g3 END AS q3
        FROM dlogs d JOIN down ON d.product_code IS NOT DISTINCT FROM down.product_code, dall)"""

#: y(t) = b y(t - 1) by least squares on all but the last two train months, then two steps.
AR = """arseries AS (
        SELECT product_code, ix, n_train, target AS y,
            target - lag(target) OVER (PARTITION BY product_code ORDER BY ix) AS dy FROM marked),
    arpairs AS (
        SELECT *, lag(y) OVER w AS py, lag(dy) OVER w AS pdy FROM arseries
        WINDOW w AS (PARTITION BY product_code ORDER BY ix)),
    arfit AS (
        SELECT product_code,
            coalesce(sum(y * py) / nullif(sum(py * py), 0), 0) AS b0,
            coalesce(sum(dy * pdy) / nullif(sum(pdy * pdy), 0), 0) AS b1
        FROM arpairs WHERE ix < n_train - 2 GROUP BY product_code),
    arends AS (
        SELECT product_code, max(y) FILTER (ix = n_train - 3) AS y0,
            max(dy) FILTER (ix = n_train - 3) AS d0,
            max(y) FILTER (ix = n_train - 2) AS a1, max(y) FILTER (ix = n_train - 1) AS a2
        FROM arseries GROUP BY product_code),
    arscores AS (
        SELECT product_code, '1,0,0' AS "order",
            (abs(b0 * y0 - a1) + abs(b0 * b0 * y0 - a2)) / 2 AS mae
        FROM arfit JOIN arends USING (product_code)
        UNION ALL
        SELECT product_code, '1,1,0',
            (abs(y0 + b1 * d0 - a1) + abs(y0 + b1 * d0 + b1 * b1 * d0 - a2)) / 2
        FROM arfit JOIN arends USING (product_code))"""

WINDOW_MEAN = (
    """lastix AS (SELECT max(ix) AS m FROM marked),
    windowstate AS (
        SELECT product_code, product_name, max(lag_1) FILTER (ix = m - 2) AS a,
            max(lag_1) FILTER (ix = m - 1) AS b, max(lag_1) FILTER (ix = m) AS c
        FROM marked, lastix GROUP BY ALL),
    ranges AS (
        SELECT product_code, lo_lag_1 AS low, lo_target AS base,
            CASE WHEN hi_lag_1 > lo_lag_1 THEN hi_lag_1 - lo_lag_1 ELSE 1 END AS wide,
            CASE WHEN hi_target > lo_target THEN hi_target - lo_target ELSE 1 END AS reach
        FROM train_bounds),
    rolled AS (
        SELECT product_code, product_name, 0 AS horizon, a, b, c FROM windowstate
        UNION ALL
        SELECT r.product_code, product_name, horizon + 1, b, c,
            greatest(((a - low) / wide + (b - low) / wide + (c - low) / wide) / 3 * reach + base, 0)
        FROM rolled r JOIN ranges USING (product_code) WHERE horizon < 6),
    rolledahead AS (
        SELECT product_code, product_name, horizon, c AS forecast,
            CAST(hi + to_months(CAST(horizon AS INTEGER)) AS DATE) AS ds
        FROM rolled, span WHERE horizon > 0),
    """
    + jalali("rolledahead", "ds", "jrolled")
)

LAST_VALUE = (
    """lastahead AS (
        SELECT product_code, target AS forecast,
            CAST(hi + to_months(CAST(h AS INTEGER)) AS DATE) AS ds
        FROM lastrow, span, generate_series(1, 6) g(h)),
    """
    + jalali("lastahead", "ds", "jlast")
    + """,
    bothmodels AS (
        SELECT 'Last Value' AS model, format('{:04d}/{:02d}', jy, jm) AS measure,
            greatest(forecast, 0) AS forecast FROM jlast
        UNION ALL SELECT Model, jalali_month, forecast FROM forecasts),
    errors AS (
        SELECT 'Last Value' AS model, target, lag_1 AS guess FROM marked WHERE split = 'test'
        UNION ALL
        SELECT 'Rolling Mean', target, rolling_mean_3 FROM marked WHERE split = 'test'),
    measures AS (
        SELECT model, avg(abs(target - guess)) AS MAE, avg((target - guess) ** 2) AS MSE,
            sqrt(avg((target - guess) ** 2)) AS RMSE,
            avg(abs((target - guess) / CASE WHEN target = 0 THEN 1 ELSE target END)) * 100 AS MAPE
        FROM errors GROUP BY model),
    sheetrows AS (
        SELECT 'All_Products_Forecast' AS sheet, model, measure, sum(forecast) AS value,
            count(*) AS rows FROM bothmodels GROUP BY ALL
        UNION ALL
        SELECT 'ML_Product_Forecast', model, measure, sum(forecast), count(*) FROM bothmodels
        WHERE model = 'Last Value' GROUP BY ALL
        UNION ALL
        SELECT 'Model_Evaluation', model, measure, value, 1 FROM (
            UNPIVOT measures ON MAE, MSE, RMSE, MAPE INTO NAME measure VALUE value))"""
)

ORACLE: dict[str, str] = {
    "raw_cleaned": with_(DIRTY)
    + "SELECT l_orderkey, l_linenumber, product_code, product_name, qty FROM dirty",
    "raw_dates": with_(DIRTY)
    + "SELECT l_orderkey, l_linenumber, "
    + ", ".join(
        WHEN_DATED.format(expr, name)
        for expr, name in (
            ("day", "gregorian_date"), ("jy", "jalali_year"), ("jm_key", "jalali_month"),
            ("jd", "jalali_day"), ("CAST(isodow(day) - 1 AS INTEGER)", "g_weekday"),
        )
    )
    + " FROM dirty",
    "raw_winsorized": with_(DIRTY, DIRTY_LOGS)
    + """SELECT l_orderkey, l_linenumber, product_code, qty AS original_qty,
            CAST(greatest(round_even(
                CASE WHEN lq < q1 - 1.5 * (q3 - q1) THEN round_even((exp(q1 - 1.5 * (q3 - q1)) - 1) * 1e9, 0) / 1e9
                     WHEN lq > q3 + 1.5 * (q3 - q1) THEN round_even((exp(q3 + 1.5 * (q3 - q1)) - 1) * 1e9, 0) / 1e9
                     ELSE greatest(qty, 0) END, 0), 0) AS BIGINT) AS qty FROM dq""",
    "quarantine_rows": with_(DIRTY)
    + """SELECT l_orderkey, l_linenumber, qty,
            CASE fault WHEN 1 THEN jy || '/13/01' WHEN 2 THEN 'تاریخ' WHEN 3 THEN NULL
                WHEN 4 THEN format('{:04d}/{:02d}/{:02d} 10:20', jy, jm, jd)
                WHEN 5 THEN format('{}-{}-{}', jy, jm, jd)
                WHEN 6 THEN format('{:04d}.{:02d}.{:02d}', jy, jm, jd)
                WHEN 7 THEN jy || '/07/31'
                ELSE format('{:04d}/{:02d}/{:02d}', jy, jm, jd) END AS jalali_date
            FROM dirty WHERE product_code IS NULL""",
    "undated_rows": with_(DIRTY)
    + """SELECT l_orderkey, l_linenumber,
            CASE WHEN fault = 3 THEN 'no date' ELSE 'not a valid date' END AS reason
            FROM dirty WHERE undated""",
    "input_summary": with_(DIRTY)
    + """SELECT count(*) AS rows, count(*) FILTER (qty % 1 <> 0) AS fractional_rows,
            count(*) FILTER (product_code IS NULL) AS rows_without_code,
            count(*) FILTER (fault = 3) AS rows_without_date,
            count(*) FILTER (undated) AS undated_rows FROM dirty""",
    "sarima_ar_scores": query(
        "panel", f'SELECT product_code, "order", {r("mae", 4)} AS mae FROM arscores',
        extra=(SPLIT, AR),
    ),
    "seq_rollout_mean": query(
        "panel",
        f"""SELECT product_code, product_name, ds, format('{{:04d}}/{{:02d}}', jy, jm) AS jalali_month,
            horizon, {r('forecast', 4)} AS forecast, 'Window Mean' AS Model FROM jrolled""",
        extra=(SPLIT, scaled_cte(), WINDOW_MEAN),
    ),
    "report_sheets": query(
        "panel",
        f"SELECT sheet, model, measure, {r('value', 4)} AS value, rows FROM sheetrows",
        extra=(SPLIT, ROLL, LAST_VALUE),
    ),
    "digits_numeric": """
        SELECT l_orderkey, l_linenumber,
            CASE WHEN l_linenumber = 7 THEN t || 'd' ELSE ' ' || t END AS digits,
            CASE WHEN l_linenumber = 7 THEN NULL
                 ELSE CAST(replace(t, ',', '') AS DOUBLE) END AS value
        FROM (SELECT l_orderkey, l_linenumber, format('{:,.2f}', l_extendedprice) AS t
              FROM lineitem)""",
    "label_codes": with_(tx(labels=True), DICTIONARY) + "SELECT * FROM dictionary",
    "clean_transactions": with_(tx(labels=True), DICTIONARY)
    + CODED.replace("t.*", "l_orderkey, product_code, product_name, qty, ").replace(
        " REPLACE (", ""
    )[:-1]
    + f" FROM tx t {CODE_JOINS}",
    "jalali_dates": query(
        "dated",
        """SELECT product_code, jalali_date, gregorian_date, jalali_year, jalali_month,
            jalali_month_name, jalali_day, jalali_season, g_year, g_month, g_day, g_weekday,
            month_start FROM dated""",
    ),
    "month_features": with_(
        *chain("dated"),
        """span AS (SELECT min(month_start) AS lo, max(month_start) AS hi FROM dated),
    every AS (
        SELECT CAST(unnest(generate_series(lo, hi + INTERVAL 6 MONTH, INTERVAL 1 MONTH)) AS DATE)
            AS month_start, hi FROM span)""",
        jalali("every", "month_start", "j"),
    )
    + f"""SELECT month_start, format('{{:04d}}/{{:02d}}', jy, jm) AS jalali_month,
        {MONTHS}[jm] AS jalali_month_name, CAST((jm - 1) // 3 + 1 AS INTEGER) AS jalali_season,
        jy AS jalali_year, month_start > hi AS is_future FROM j""",
    "working_day_calendar": with_(CALENDAR)
    + "SELECT cal_date AS gregorian_date, CAST(wd AS INTEGER) AS working_day FROM cal",
    "working_day_join": query(
        "dated", "SELECT product_code, qty, gregorian_date, working_day FROM dated"
    ),
    "quantity_bounds": query(
        "treated",
        f"""SELECT product_code, n, {r('q1 - 1.5 * (q3 - q1)', 6)} AS low,
            {r('q3 + 1.5 * (q3 - q1)', 6)} AS high FROM own""",
    ),
    "winsorized_qty": query("treated", f"SELECT {TX_KEYS} FROM treated"),
    "winsorized_small_groups": query("treated", f"SELECT {TX_KEYS} FROM treated", "small"),
    "winsorized_returns": query("treated", f"SELECT {TX_KEYS} FROM treated", "returns"),
    "monthly_consumption": query("abc", "SELECT * FROM monthly"),
    "abc_monthly": query("abc", "SELECT * FROM abc"),
    "abc_monthly_returns": query("abc", "SELECT * FROM abc", "returns"),
    "abc_enriched": query("enriched", f"SELECT * {DROP_KEYS} FROM enriched"),
    "abc_export": query(
        "enriched",
        """SELECT DISTINCT jalali_month, month_start, product_code, abc_class, month_rank,
            month_qty, month_txn_count, share_pct, cum_pct FROM enriched""",
    ),
    "bi_export": query(
        "enriched",
        f"SELECT * {DROP_KEYS} FROM ({CODED} FROM enriched t {CODE_JOINS})",
        labels=True,
        extra=(DICTIONARY,),
    ),
    "panel_grid": query("grid", "SELECT * FROM grid"),
    "panel_agg": query("agg", "SELECT * FROM agg"),
    "panel_full": query("panel", ROUNDED_PANEL),
    "panel_returns": query("panel", ROUNDED_PANEL, "returns"),
    "panel_lags": query(
        "panel", "SELECT product_code, month_start, target, lag_1, lag_2, lag_3 FROM panel"
    ),
    "panel_rolling": query(
        "panel",
        "SELECT product_code, month_start, target, rolling_mean_3, rolling_std_3 "
        f"FROM ({ROUNDED_PANEL})",
    ),
    "total_series": query(
        "panel", "SELECT month_start, sum(target) AS y FROM panel GROUP BY ALL ORDER BY 1"
    ),
    "time_split": query(
        "panel",
        "SELECT split, month_start, count(*) AS rows, sum(target) AS target "
        "FROM marked GROUP BY ALL",
        extra=(SPLIT,),
    ),
    "cv_folds": query(
        "panel",
        """SELECT product_code, month_start, CAST(CASE
                WHEN pos < (n % 3) * (n // 3 + 1) THEN pos // (n // 3 + 1)
                ELSE n % 3 + (pos - (n % 3) * (n // 3 + 1)) // (n // 3) END AS INTEGER) AS fold
            FROM (SELECT product_code, month_start, count(*) OVER () AS n,
                    row_number() OVER (ORDER BY product_code, month_start) - 1 AS pos
                  FROM marked WHERE split = 'train')""",
        extra=(SPLIT,),
    ),
    "feature_corr": query("panel", "SELECT * FROM corr_scores", extra=(CORR,)),
    "feature_mi": query("panel", "SELECT * FROM mi_scores", extra=(MI,)),
    "top_features": query(
        "panel",
        """SELECT * FROM corr_scores JOIN mi_scores USING (Feature)
            ORDER BY Mutual_Information DESC, Feature LIMIT 10""",
        extra=(CORR, MI),
    ),
    "naive_eval": query(
        "panel", f"SELECT {METRICS} FROM marked WHERE split = 'test'", extra=(SPLIT,)
    ),
    "naive_eval_by_product": query(
        "panel",
        f"SELECT product_code, {METRICS} FROM marked WHERE split = 'test' GROUP BY product_code",
        extra=(SPLIT,),
    ),
    "live_products": query("panel", "SELECT * FROM live", "returns", extra=(LIVE,)),
    "last_state": query(
        "panel",
        """SELECT product_code, product_name, CAST(month_txn_count AS DOUBLE) AS month_txn_count,
            CAST(abc_encoded AS DOUBLE) AS abc_encoded, lag_2 AS target_0, lag_1 AS target_1,
            target AS target_2 FROM lastrow""",
        "returns",
        extra=(LIVE, LAST),
    ),
    "recursive_mean_forecast": query(
        "panel",
        f"SELECT * REPLACE ({r('forecast', 6)} AS forecast) FROM forecasts",
        "returns",
        extra=(ROLL,),
    ),
    "total_forecast_sheet": query(
        "panel",
        f"""SELECT "Persian Month", "Model Name", {r('v', 4)} AS "Forecasting Value" FROM (
            SELECT format('{{:04d}}/{{:02d}}', jy, jm) AS "Persian Month",
                'Actual' AS "Model Name", y AS v FROM jt WHERE jy >= 1379
            UNION ALL
            SELECT jalali_month, Model, sum(forecast) FROM forecasts
            GROUP BY jalali_month, Model)
        ORDER BY 2, 1""",
        extra=(ROLL, SHEET),
    ),
    "product_sheet": query(
        "panel",
        f"""SELECT product_code, product_name, ds AS month_start, jalali_month,
            Model AS "Model Name", {r('forecast', 6)} AS "Forecasting Value", horizon
            FROM forecasts""",
        extra=(ROLL,),
    ),
    "minmax_scaled": query(
        "panel",
        "SELECT product_code, month_start, split, "
        + ", ".join(f"{r(f'scaled_{c}', 6)} AS scaled_{c}" for c in MINMAX_COLUMNS[:3])
        + " FROM scaled",
        extra=(SPLIT, scaled_cte()),
    ),
    "sequences": query(
        "panel",
        f"""SELECT product_code, month_start, split, {r('scaled_target', 6)} AS label,
            CAST(pos AS INTEGER) AS pos,
            {r('[l3, l2, l1][pos + 1]', 6)} AS lag_1, {r('[m3, m2, m1][pos + 1]', 6)} AS g_month
            FROM windowed, generate_series(0, 2) g(pos) WHERE l3 IS NOT NULL""",
        extra=(
            SPLIT,
            scaled_cte().replace("scaled AS (", "scaled AS MATERIALIZED ("),
            """windowed AS (
        SELECT product_code, month_start, split, scaled_target,
            lag(scaled_lag_1, 1) OVER w AS l1, lag(scaled_lag_1, 2) OVER w AS l2,
            lag(scaled_lag_1, 3) OVER w AS l3, lag(scaled_g_month, 1) OVER w AS m1,
            lag(scaled_g_month, 2) OVER w AS m2, lag(scaled_g_month, 3) OVER w AS m3
        FROM scaled WINDOW w AS (PARTITION BY product_code, split ORDER BY ix))""",
        ),
    ),
}
ORACLE["seq_choice"] = query(
    "panel",
    f"""SELECT selection, CAST(candidate AS INTEGER) AS candidate, {r('mae', 4)} AS "MAE",
        row_number() OVER (PARTITION BY selection ORDER BY mae, candidate) = 1 AS chosen
        FROM scores""",
    "returns",
    extra=(
        SPLIT,
        LIVE,
        scaled_cte().replace("scaled AS (", "scaled AS MATERIALIZED ("),
        """earlier AS (
        SELECT product_code, ix, split, n_train, lag(scaled_lag_1, 1) OVER w AS l1,
            lag(scaled_lag_1, 2) OVER w AS l2, lag(scaled_lag_1, 3) OVER w AS l3
        FROM scaled WINDOW w AS (PARTITION BY product_code, split ORDER BY ix)),
    compared AS (
        SELECT *, CASE WHEN split = 'test' THEN 'test' ELSE 'validation' END AS selection
        FROM earlier
        WHERE l3 IS NOT NULL AND (split = 'test' OR ix >= n_train * 4 // 5)
          AND product_code IN (SELECT product_code FROM live)),
    guesses AS (
        SELECT *, unnest([(l1 + l2 + l3) / 3, l1,
                greatest(least(l1, l2), least(greatest(l1, l2), l3))]) AS guess,
            unnest([0, 1, 2]) AS candidate
        FROM compared),
    scores AS (
        SELECT selection, candidate, avg(abs(m.target - (lo_target + guess * CASE
            WHEN hi_target > lo_target THEN hi_target - lo_target ELSE 1 END))) AS mae
        FROM guesses g JOIN train_bounds USING (product_code)
            JOIN marked m ON m.product_code = g.product_code AND m.ix = g.ix
        GROUP BY ALL)""",
    ),
)
# Other ways to the same rows.
ORACLE["abc_sheet"] = ORACLE["abc_export"]
ORACLE["csv_reader"] = ORACLE["raw_cleaned"]
