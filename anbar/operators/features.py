"""Feature candidates and their ranking by correlation and mutual information."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from anbar.config import NOT_FEATURES, Config
from anbar.functions.numbers import half_even
from anbar.operators.prefix import values_at


def feature_candidates(panel: DataFrame) -> list[str]:
    """Numeric panel columns that are neither key nor target."""
    return [
        f.name
        for f in panel.schema.fields
        if isinstance(f.dataType, NumericType) and f.name not in NOT_FEATURES
    ]


def as_features(panel: DataFrame, candidates: list[str]) -> DataFrame:
    """Candidates as DOUBLE without nulls."""
    return panel.withColumns(
        {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in candidates}
    )


def unpivot(df: DataFrame, columns: list[str], name: str, value: str) -> DataFrame:
    pairs = [F.struct(F.lit(c).alias(name), F.col(c).alias(value)) for c in columns]
    return df.select(F.inline(F.array(*pairs)))


def correlations(features: DataFrame, candidates: list[str], target: str = "target") -> DataFrame:
    """(Feature, Correlation_Abs): one aggregate over all candidates.

    From covariance and deviations, because ``corr`` raises on a constant column.
    """
    y = F.col(target).cast("double")

    def strength(c: str):
        spread = F.stddev_pop(F.col(c)) * F.stddev_pop(y)
        return F.abs(F.try_divide(F.covar_pop(F.col(c), y), spread)).alias(c)

    wide = features.agg(*[strength(c) for c in candidates])
    value = F.col("value")
    return unpivot(wide, candidates, "Feature", "value").select(
        "Feature",
        half_even(F.when(value.isNull() | F.isnan(value), 0.0).otherwise(value), 4).alias(
            "Correlation_Abs"
        ),
    )


#: Rank error of the first look at a border, as a share of all rows, is one in so many.
ACCURACY = 10_000


def bin_borders(
    features: DataFrame, columns: list[str], bins: int, accuracy: int = ACCURACY
) -> dict[str, list[float]]:
    """Equal-frequency bin borders of every column, exact: the ceil(n*i/bins)-th values.

    Selection by brackets, without turning the columns to rows: one aggregate finds a lower and
    an upper value around each border, a second one counts the rows below and up to them. Only
    rows inside of a bracket, a few in ``accuracy``, are then ranked by value, and none where
    the bracket is a single value. A bracket that missed its border is opened to all values.
    """
    shares = [min(max(i / bins + d, 0.0), 1.0) for i in range(1, bins) for d in (-3 / accuracy, 3 / accuracy)]
    ends = features.agg(
        F.count("*").alias("n"),
        *[F.percentile_approx(c, shares, accuracy).alias(f"ends_{i}") for i, c in enumerate(columns)],
    ).first()
    n = ends["n"]
    if not n:
        return {c: [] for c in columns}
    ranks = [-(-n * i // bins) for i in range(1, bins)]
    brackets = [list(zip(ends[f"ends_{i}"][::2], ends[f"ends_{i}"][1::2], strict=True)) for i in range(len(columns))]
    below = {(i, low): f"b{i}_{k}" for i, b in enumerate(brackets) for k, low in enumerate({x for x, _ in b})}
    up_to = {(i, high): f"u{i}_{k}" for i, b in enumerate(brackets) for k, high in enumerate({x for _, x in b})}
    counts = features.agg(
        *[F.count_if(F.col(columns[i]) < low).alias(name) for (i, low), name in below.items()],
        *[F.count_if(F.col(columns[i]) <= high).alias(name) for (i, high), name in up_to.items()],
    ).first()

    borders: dict[str, list[float]] = {c: [] for c in columns}
    inside, places = [], {}
    for i, c in enumerate(columns):
        for k, ((low, high), rank) in enumerate(zip(brackets[i], ranks, strict=True)):
            before = counts[below[i, low]]
            found = before < rank <= counts[up_to[i, high]]
            if found and low == high:
                borders[c].append(low)
                continue
            key = i * bins + k
            places[key] = rank - (before if found else 0)
            match = F.col(c).between(low, high) if found else F.lit(True)
            inside.append(F.when(match, F.struct(F.lit(key).alias("key"), F.col(c).alias("value"))))
    if inside:
        near = features.select(F.inline(F.array_compact(F.array(*inside))))
        counted = near.groupBy("key", "value").agg(F.count("*").alias("n_rows"))
        numbers = F.create_map(*[F.lit(x) for pair in places.items() for x in pair])
        place = F.element_at(numbers, F.col("key")).cast("long") - 1
        for row in values_at(counted, ["key"], "value", "n_rows", [place]).collect():
            borders[columns[row["key"] // bins]].append(row["v"][0])
    return {c: sorted(set(found)) for c, found in borders.items()}


def mutual_information(
    features: DataFrame, candidates: list[str], cfg: Config, target: str = "target"
) -> DataFrame:
    """(Feature, Mutual_Information) between equal-frequency bins of feature and target.

    Rows are binned by literal borders and counted per (feature, bin, bin) before any
    shuffle, so what travels is at most bins x bins rows per feature and task.
    """
    df = features.select(*candidates, F.col(target).cast("double").alias(target))
    borders = bin_borders(df, [*candidates, target], cfg.mi_bins)

    def bin_of(c: str):
        found = F.lit(0)
        for b in borders.get(c, []):
            found = found + (F.col(c) >= F.lit(b)).cast("int")
        return found

    binned = df.select(*[bin_of(c).alias(c) for c in [*candidates, target]])
    pairs = [
        F.struct(F.lit(c).alias("Feature"), F.col(c).alias("bx"), F.col(target).alias("by"))
        for c in candidates
    ]
    joint = (
        binned.select(F.inline(F.array(*pairs)))
        .groupBy("Feature", "bx", "by")
        .agg(F.count("*").cast("double").alias("nxy"))
    )
    per = Window.partitionBy("Feature")
    with_margins = joint.withColumns(
        {
            "n": F.sum("nxy").over(per),
            "nx": F.sum("nxy").over(Window.partitionBy("Feature", "bx")),
            "ny": F.sum("nxy").over(Window.partitionBy("Feature", "by")),
        }
    )
    term = F.col("nxy") / F.col("n") * F.log(
        F.col("nxy") * F.col("n") / (F.col("nx") * F.col("ny"))
    )
    return with_margins.groupBy("Feature").agg(
        half_even(F.sum(term), 4).alias("Mutual_Information")
    )


def ranked(importance: DataFrame) -> DataFrame:
    return importance.orderBy(F.desc("Mutual_Information"), "Feature")


def top_features(importance: DataFrame, cfg: Config) -> DataFrame:
    return ranked(importance).limit(cfg.top_features)
