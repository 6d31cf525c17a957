"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. Every source gets a target size in words. Its documents are dealt into blocks by hash, and
   the mix draws whole passes over the blocks and a last partial pass in a permuted order.
2. The draws of all sources are the root of a tree. Each node deals its exact number of draws
   per source to its two children as drawing without replacement would (a multivariate
   hypergeometric draw), down to the output shards.
3. Each shard takes the next draws from the permuted list of each source, so shards are
   disjoint, and shuffles its documents locally.

All randomness is a hash of the seed and of names, so reruns and retried tasks agree.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from anbar.config import Config
from anbar.llm.common import small, table, word_count, written
from anbar.operators.joins import join_counted
from anbar.operators.prefix import dense_positions, running_totals

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
LIMIT = 2.0


def source_targets(
    sized: DataFrame,
    source: str = "source",
    size: str = "size",
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    limit: float = LIMIT,
) -> DataFrame:
    """Per source: ``docs``, ``words`` and ``target`` (double), in words.

    Sources in code point order, null last, weigh ``weights``, repeating. Targets share
    ``share`` times all words by weight; none is above ``limit`` times its source, and what
    is cut off goes to the others by weight. That is one level L with
    target = min(limit * words, L * weight): ordered by limit * words / weight, the sources
    before a place are full and the rest share what is left.
    """
    sources = sized.groupBy(source).agg(
        F.count("*").alias("docs"), F.sum(size).alias("words")
    )
    order = [F.col(source).isNull(), F.col(source)]
    ranked = written(dense_positions(sources, order, "place"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = ranked.withColumn("weight", F.get(cycle, F.pmod("place", F.lit(len(weights)))))
    ranked = ranked.withColumn("ratio", limit * F.col("words") / F.col("weight"))
    sums = running_totals(
        ranked, [], [F.col("ratio"), F.col("place")],
        {"words": F.col("words"), "weight": F.col("weight")},
    )
    left = share * F.col("total_words") - limit * (F.col("run_words") - F.col("words"))
    sums = sums.withColumn(
        "level", left / (F.col("total_weight") - F.col("run_weight") + F.col("weight"))
    )
    # The first place that is not full; if rounding leaves none, all are full.
    level = sums.where("level <= ratio").agg(F.min_by("level", F.struct("ratio", "place")).alias("level"))
    chosen = level.first()["level"]
    chosen = float("inf") if chosen is None else chosen
    return ranked.select(
        source, "docs", "words",
        F.when(F.col("words") == 0, 0.0)
        .otherwise(F.least(limit * F.col("words"), F.lit(chosen) * F.col("weight")))
        .alias("target"),
    )


# --- the splitting tree -----------------------------------------------------


def _uniform(*parts: Column) -> Column:
    """In [0, 1), from a hash."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(1 << 53))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _walk(first: Column, last: Column, ratio: Callable[[Column], Column]) -> Column:
    """Weights of first .. last, each ``ratio`` (of its place) times the one before; starts at 1."""
    start = F.struct(F.lit(1.0).alias("w"), F.array().cast("array<double>").alias("all"))
    steps = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))

    def step(a: Column, k: Column) -> Column:
        return _let(
            a["w"] * ratio(k),
            lambda w: F.struct(w.alias("w"), F.concat(a["all"], F.array(w)).alias("all")),
        )

    return F.aggregate(steps, start, step, lambda a: a["all"])


def _place_of(weights: Column, passed: Column) -> Column:
    """Index of the first weight at which the running sum is above ``passed``, or the last."""
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).cast("long").alias("n"))

    def step(a: Column, w: Column) -> Column:
        upto = a["sum"] + w
        return F.struct(upto.alias("sum"), (a["n"] + (upto <= passed).cast("long")).alias("n"))

    return F.aggregate(weights, start, step, lambda a: F.least(a["n"], F.size(weights) - 1))


def hypergeometric(population: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """Number of marked among ``drawn`` out of ``population``, by inversion of ``u``.

    The probabilities are walked outwards from the mode, relative to the mode, up to twelve
    standard deviations away; what lies beyond is below the resolution of a double.
    """
    low = F.greatest(F.lit(0).cast("long"), drawn + marked - population)
    high = F.least(drawn, marked)
    rest = population - marked - drawn
    share = marked / F.greatest(population, F.lit(1))
    reach = F.ceil(12 * F.sqrt(drawn * share * (1 - share)) + 12).cast("long")
    middle = F.floor((drawn + 1.0) * (marked + 1.0) / (population + 2.0)).cast("long")

    def around(mode: Column) -> Column:
        def up(k: Column) -> Column:  # weight of k over weight of k - 1
            return (marked - k + 1.0) * (drawn - k + 1.0) / (k * (rest + k * 1.0))

        def down(j: Column) -> Column:  # j steps below the mode: weight of that over the next
            k = mode - j
            return (k + 1.0) * (rest + k + 1.0) / ((marked - k) * (drawn - k * 1.0))

        sides = F.struct(
            _walk(mode + 1, F.least(high, mode + reach), up).alias("upper"),
            _walk(F.lit(1).cast("long"), mode - F.greatest(low, mode - reach), down).alias("lower"),
        )
        return _let(sides, lambda s: chosen(mode, s))

    def chosen(mode: Column, sides: Column) -> Column:
        above = F.size(sides["upper"]).cast("long")
        weights = F.concat(F.array(F.lit(1.0)), sides["upper"], sides["lower"])
        return _let(
            _let(weights, lambda w: _let(_total(w) * u, lambda passed: _place_of(w, passed))),
            lambda place: F.when(place <= above, mode + place).otherwise(mode - (place - above)),
        )

    return _let(F.greatest(low, F.least(high, middle)), around)


def _total(weights: Column) -> Column:
    return F.aggregate(weights, F.lit(0.0), lambda a, w: a + w)


def split_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(source_no, shard, n): how many of each source's draws each shard gets; all are dealt.

    ``quotas`` has (source_no, quota). Shards are of equal size, within one draw.
    """
    root = quotas.agg(
        F.sort_array(F.collect_list(F.struct("source_no", "quota"))).alias("quotas"),
        F.sum("quota").alias("all"),
    )
    nodes = root.select(
        F.lit(0).cast("long").alias("low"), F.lit(shards).cast("long").alias("high"), "all",
        "quotas",
    )

    def dealt_before(shard: Column) -> Column:
        return F.floor(F.col("all") / shards * shard).cast("long")

    width, depth = shards, 0
    while width > 1:
        middle = F.floor((F.col("low") + F.col("high")) / 2).cast("long")
        here = F.when(F.col("high") == shards, F.col("all")).otherwise(dealt_before(F.col("high")))
        start = F.struct(
            (here - dealt_before(F.col("low"))).alias("population"),
            (dealt_before(middle) - dealt_before(F.col("low"))).alias("drawn"),
            F.array().cast("array<bigint>").alias("taken"),
        )

        def deal(a: Column, q: Column) -> Column:
            u = _uniform(F.lit(seed), F.col("low"), F.col("high"), q["source_no"])
            return _let(
                hypergeometric(a["population"], q["quota"], a["drawn"], u),
                lambda n: F.struct(
                    (a["population"] - q["quota"]).alias("population"),
                    (a["drawn"] - n).alias("drawn"),
                    F.concat(a["taken"], F.array(n)).alias("taken"),
                ),
            )

        left = F.aggregate("quotas", start, deal, lambda a: a["taken"])
        parted = nodes.withColumn("middle", middle).withColumn("left", left)
        to_left = F.zip_with(
            "quotas", "left",
            lambda q, n: F.struct(q["source_no"].alias("source_no"), n.alias("quota")),
        )
        to_right = F.zip_with(
            "quotas", "left",
            lambda q, n: F.struct(q["source_no"].alias("source_no"), (q["quota"] - n).alias("quota")),
        )
        single = F.col("high") - F.col("low") == 1
        children = F.when(
            single, F.array(F.struct("low", "high", "quotas"))
        ).otherwise(
            F.array(
                F.struct("low", F.col("middle").alias("high"), to_left.alias("quotas")),
                F.struct(F.col("middle").alias("low"), "high", to_right.alias("quotas")),
            )
        )
        nodes = parted.select("all", F.explode(children).alias("c")).select("c.*", "all")
        width, depth = (width + 1) // 2, depth + 1
        if depth % 4 == 0 or width <= 1:  # short plans, and a wide tree spreads over the cluster
            nodes = written(nodes.repartition(2 ** max(0, depth - 4), "low"))
    leaves = nodes.select(F.col("low").alias("shard"), F.explode("quotas").alias("q"))
    return leaves.select("q.source_no", "shard", F.col("q.quota").alias("n")).where("n > 0")


# --- the mix ----------------------------------------------------------------


def _named(source: Column) -> dict[str, Column]:
    """A source as two columns without nulls."""
    return {"no_source": source.isNull(), "name": F.coalesce(source, F.lit(""))}


def mix(
    docs: DataFrame,
    size: Column,
    key: str = "doc_id",
    source: str = "source",
    targets: DataFrame | None = None,
    seed: int = 17,
    docs_per_block: int = 128,
    shard_words: int = 1 << 20,
    broadcast_rows: int = 200_000,
) -> DataFrame:
    """The mix: one row for each time a row of ``docs`` is taken.

    Columns: ``row`` (all columns of the row as a struct, so names cannot clash), ``shard``,
    ``pass`` and ``order``, by which a shard is sorted. ``size`` gives words, null as 0.
    A source's passes: the whole part of target / words, and one partial pass that ends where
    the target is reached, within half a document. Null sources are a source of their own. Rows
    with the same key, source and size share their fate; others with one key, or with none, are
    drawn apart. Sources without words are not taken.
    """
    cfg = Config(broadcast_rows=broadcast_rows)
    rows = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"),
        docs[key].alias("id"), docs[source].alias("source"),
        F.coalesce(size, F.lit(0)).cast("long").alias("size"),
    )
    slim = written(rows.drop("row"))
    if targets is None:
        targets = source_targets(slim)
    named = _named(F.col("source"))
    plan = written(
        targets.where("words > 0").withColumns(named).select(
            *named, "docs",
            F.xxhash64(*named).alias("source_no"),
            F.ceil(F.col("docs") / docs_per_block).cast("long").alias("blocks"),
            F.floor(F.col("target") / F.col("words")).cast("long").alias("passes"),
            F.col("target"), F.col("words").alias("source_words"),
        )
    )
    plan = plan.withColumn(
        "rest", F.greatest(F.lit(0.0), F.col("target") - F.col("passes") * F.col("source_words"))
    )

    def in_blocks(found: DataFrame) -> DataFrame:
        """Adds source_no, block and place; rows of sources without words go."""
        lookup = plan.select(*named, "docs", "source_no", "blocks")
        found = join_counted(found.withColumns(named), lookup, list(named), "docs", cfg)
        block = F.pmod(F.xxhash64(F.lit(seed), F.lit("block"), "id", "size"), F.col("blocks"))
        place = F.xxhash64(F.lit(seed), F.lit("place"), "id", "size")
        found = found.where(F.col("source_no").isNotNull())
        return found.withColumns({"block": block, "place": place}).drop(*named, "source", "blocks")

    slim = written(in_blocks(slim))
    blocks = slim.groupBy("source_no", "block").agg(F.sum("size").alias("words"))
    blocks = blocks.join(plan.select("source_no", "passes", "rest"), "source_no")
    first_to_last = F.sequence(F.lit(0).cast("long"), F.col("passes"))
    passes = blocks.select("*", F.explode(first_to_last).alias("pass"))
    passes = passes.withColumn(
        "turn", F.xxhash64(F.lit(seed), F.lit("turn"), "pass", "source_no", "block")
    )
    last = F.col("pass") == F.col("passes")
    order = [F.col("pass"), F.col("turn"), F.col("block")]
    sums = running_totals(
        passes, ["source_no"], order, {"part": F.when(last, F.col("words")).otherwise(0)}
    )
    before = F.col("run_part") - F.col("words")
    drawn = sums.where(~last | ((before < F.col("rest")) & (F.col("words") > 0))).select(
        "source_no", "block", "pass", "turn",
        F.when(last & (F.col("run_part") > F.col("rest")), F.col("rest") - before).alias("room"),
    )
    draws = written(
        running_totals(drawn, ["source_no"], order, {"n": F.lit(1).cast("long")}).select(
            "source_no", "block", "pass", "room", (F.col("run_n") - 1).alias("position")
        )
    )

    # The block in which a source's target is reached is cut at a place in its own order.
    border = draws.where("room is not null").select("source_no", "block", "room")
    steps = slim.join(border, ["source_no", "block"]).groupBy("source_no", "room", "place")
    steps = steps.agg(F.sum("size").alias("size"))
    upto = F.sum("size").over(Window.partitionBy("source_no").orderBy("place"))
    cuts = steps.withColumn("upto", upto).where(F.col("upto") - F.col("size") / 2 <= F.col("room"))
    cuts = cuts.groupBy("source_no").agg(F.max("place").alias("cut"))
    nothing = F.lit(-(1 << 63)).cast("long")
    draws = draws.join(cuts, "source_no", "left").withColumn(
        "cut", F.when(F.col("room").isNotNull(), F.coalesce("cut", nothing))
    )

    words = plan.agg(F.sum("target").alias("words")).first()["words"] or 0
    shards = max(1, round(words / shard_words))
    quotas = draws.groupBy("source_no").agg(F.count("*").alias("quota"))
    dealt = split_quotas(quotas, shards, seed)
    ends = running_totals(dealt, ["source_no"], [F.col("shard")], {"n": F.col("n")})
    positions = F.sequence(F.col("run_n") - F.col("n"), F.col("run_n") - 1)
    places = ends.select("source_no", "shard", F.explode(positions).alias("position"))
    placed = draws.join(places, ["source_no", "position"])
    placed = written(placed.select("source_no", "block", "shard", "pass", "cut"))
    if small(placed, broadcast_rows):
        placed = F.broadcast(placed)
    mixed = in_blocks(rows).join(placed, ["source_no", "block"])
    mixed = mixed.where(F.col("cut").isNull() | (F.col("place") <= F.col("cut")))
    own = F.xxhash64(F.lit(seed), F.lit("order"), "shard", "pass", "id", "size")
    return mixed.select("row", "shard", "pass", own.alias("order"))


def shuffled(mixed: DataFrame) -> DataFrame:
    """The rows of ``mix`` dealt out by shard and in the order of each shard."""
    return mixed.repartition("shard").sortWithinPartitions("shard", "order", "pass")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    targets = written(source_targets(sized))
    mixed = mix(sized, F.col("size"), targets=targets)
    equal = ["doc_id", "source", "size"]
    taken = mixed.select("row.*", "shard").groupBy(*[F.col(c).alias(f"taken_{c}") for c in equal]).agg(
        F.count("*").alias("times"), F.sort_array(F.collect_set("shard")).alias("shards"),
    )
    # Equal rows are taken equally often: each has its part of what all were taken.
    copies = sized.groupBy(*equal).agg(F.count("*").alias("copies")).where("copies > 1")
    copies = copies.withColumnsRenamed({c: f"copied_{c}" for c in equal})
    named = _named(F.col("source"))
    lookup = targets.withColumns(named).select(
        *named, "docs", F.col("words").alias("source_size"), "target"
    )
    rows = join_counted(sized.withColumns(named), lookup, list(named), "docs", Config())

    def same(prefix: str) -> Column:
        match = [F.col(c).eqNullSafe(F.col(f"{prefix}_{c}")) for c in equal]
        return match[0] & match[1] & match[2]

    joined = rows.join(taken, same("taken"), "left").join(copies, same("copied"), "left")
    times = F.coalesce("times", F.lit(0)) / F.coalesce("copies", F.lit(1))
    joined = joined.withColumn("n_taken", times.cast("long"))
    return joined.select(
        "doc_id", "size", "source_size", "target",
        (F.col("n_taken") * F.col("size")).alias("taken"),
        "n_taken",
        F.coalesce("shards", F.array().cast("array<bigint>")).alias("shards"),
    )
