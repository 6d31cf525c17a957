"""Settings and the fixed names and values the jobs agree on."""

from __future__ import annotations

from dataclasses import dataclass

# ---------------------------------------------------------------------------
# Texts and numbers that must be exactly these for equal results.
# ---------------------------------------------------------------------------
PERSIAN_DIGITS = "۰۱۲۳۴۵۶۷۸۹"
ARABIC_DIGITS = "٠١٢٣٤٥٦٧٨٩"

JALALI_MONTH_NAMES = (
    "فروردین", "اردیبهشت", "خرداد", "تیر", "مرداد", "شهریور",
    "مهر", "آبان", "آذر", "دی", "بهمن", "اسفند",
)

MISSING_TEXT = "نامشخص"
MISSING_LABEL = "Unknown"

# Header texts of the stock documents and our names for them.
PERSIAN_TO_CANONICAL = {
    "تاریخ": "jalali_date",
    "تاریخ شمسی": "jalali_date",
    "مقدار (اصلی)": "qty",
    "کد کالا": "product_code",
    "نام کالا": "product_name",
    "نوع سند": "doc_type",
    "وضعیت": "status",
    "ماهیت کالا": "product_nature",
    "واحد سنجش": "unit",
    "انبار": "warehouse",
    "طرف مقابل": "counterparty",
    "طرف مقابل 4": "counterparty",
    "محل مصرف": "consumption_location",
}

# Header texts of the written reports.
CANONICAL_TO_PERSIAN = {
    "jalali_date": "تاریخ شمسی",
    "qty": "مقدار (اصلی)",
    "product_code": "کد کالا",
    "product_name": "نام کالا",
    "doc_type": "نوع سند",
    "status": "وضعیت",
    "product_nature": "ماهیت کالا",
    "unit": "واحد سنجش",
    "warehouse": "انبار",
    "counterparty": "طرف مقابل",
    "consumption_location": "محل مصرف",
    "gregorian_date": "تاریخ میلادی",
    "jalali_year": "سال شمسی",
    "jalali_month": "ماه شمسی",
    "jalali_month_name": "نام ماه شمسی",
    "jalali_day": "روز شمسی",
    "jalali_season": "فصل شمسی",
    "g_year": "سال میلادی",
    "g_month": "ماه میلادی",
    "g_day": "روز میلادی",
    "g_weekday": "روز هفته میلادی",
    "month_start": "تاریخ شروع ماه میلادی",
    "working_day": "روز کاری",
    "abc_class": "کلاس ABC",
    "month_rank": "رتبه کالا در ماه",
    "month_qty": "مجموع مصرف کالا در ماه",
    "month_txn_count": "تعداد تراکنش کالا در ماه",
    "share_pct": "سهم درصد کالا از مصرف ماه",
    "cum_pct": "درصد تجمعی ماه",
}

LABEL_COLUMNS = (
    "doc_type", "status", "product_nature", "unit",
    "warehouse", "counterparty", "consumption_location",
)

ABC_CODES = {"A": 1, "B": 2, "C": 3}

ABC_EXPORT_COLUMNS = (
    "jalali_month", "month_start", "product_code", "abc_class", "month_rank",
    "month_qty", "month_txn_count", "share_pct", "cum_pct",
)

MODEL_NAMES = {
    "rf": "Random Forest",
    "gbt": "Gradient Boosting",
    "trend": "Trend Seasonal",
    "sarima": "SARIMA",
    "seq": "Sequence Window",
}

MODEL_CODES = {
    "RF": "rf",
    "XGB": "gbt",
    "Prophet": "trend",
    "SARIMA": "sarima",
    "Bi-LSTM": "seq",
}

# Panel columns that are no features.
NOT_FEATURES = (
    "product_code", "product_name", "month_start", "jalali_month",
    "target", "original_target", "abc_class",
)

# ---------------------------------------------------------------------------
# End of fixed values.
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Config:
    """Every number a run can be tuned with."""

    horizon: int = 6
    a_threshold: int = 70
    b_threshold: int = 90
    winsor_min_rows: int = 10
    winsor_fence: float = 1.5
    lags: tuple[int, ...] = (1, 2, 3)
    rolling: int = 3
    top_features: int = 10
    train_share: float = 0.8
    folds: int = 3
    seq_length: int = 3
    report_from_year: int = 1404
    # The years a timestamp with nanoseconds can hold.
    jalali_years: tuple[int, int] = (1056, 1641)
    forecast_std_ddof: int = 0
    feature_scope: str = "panel"  # or "train": rank features on train months only
    seq_selection: str = "test"  # or "validation": tail of the train months
    seed: int = 42
    mi_bins: int = 10

    # Tree models. The grids below are the full ones; tests pass smaller ones.
    max_bins: int = 64
    rf_trees: int = 200
    rf_depths: tuple[int, ...] = (3, 5)
    rf_leaf_rows: tuple[int, ...] = (1, 3)
    gbt_rounds: tuple[int, ...] = (100, 200)
    gbt_depths: tuple[int, ...] = (3, 5, 7)
    gbt_rates: tuple[float, ...] = (0.01, 0.05, 0.1)
    gbt_leaf_rows: tuple[int, ...] = (1, 3)
    importance_trees: int = 100
    importance_tree_depth: int = 10
    importance_rounds: int = 100
    importance_round_depth: int = 6
    importance_rate: float = 0.3
    min_grid_rows: int = 10
    cv_parallelism: int = 4

    # Sequence-window model: (rounds, depth, rate) per candidate.
    seq_candidates: tuple[tuple[int, int, float], ...] = (
        (20, 3, 0.1), (40, 4, 0.1), (60, 5, 0.05),
    )

    # A lookup side up to this many rows and bytes is broadcast; a larger one is joined by
    # shuffle, with only its hot keys broadcast. Hot is a key that owns more than one part in
    # ``hot_per_partition`` x shuffle partitions of all rows, so the bar follows the task size.
    broadcast_rows: int = 200_000
    broadcast_bytes: int = 64 << 20
    hot_per_partition: int = 4


def model_codes(models) -> list[str]:
    """Resolve a model choice ("all", our codes or the five classic codes)."""
    chosen = [models] if isinstance(models, str) else list(models)
    if "all" in chosen:
        return list(MODEL_NAMES)
    codes = []
    for name in chosen:
        code = MODEL_CODES.get(name, name)
        if code not in MODEL_NAMES:
            raise ValueError(f"unknown model code: {name!r}")
        if code not in codes:
            codes.append(code)
    return codes
