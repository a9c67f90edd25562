"""Exact order statistics and running totals over groups of any size.

A window over one large group is a single task.  Here equal values are summed first and
every group is cut into ordered buckets, and each bucket into slices, that are pure
functions of the value (see :func:`order_buckets`).  Bucket and slice totals, combined
before the shuffle, give the offset of each slice, and only the inside of a slice is
sorted.  All plans are lazy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazardloom.functions.numbers import order_buckets


def _with_buckets(df: DataFrame, order: str, descending: bool = False) -> DataFrame:
    bucket, inside = order_buckets(F.col(order))
    sign = -1 if descending else 1
    return df.withColumn("_b", bucket * sign).withColumn("_s", inside * sign)


def _offsets(df: DataFrame, groups: list[str], measures: list[str]) -> DataFrame:
    """Per (group, bucket, slice): the measures before it, its own sums, and the group's totals."""
    sums = [F.sum(m).alias(m) for m in measures]
    slices = df.groupBy(*groups, "_b", "_s").agg(*sums)
    buckets = slices.groupBy(*groups, "_b").agg(*sums)
    whole = Window.partitionBy(*groups)
    earlier = whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select(
        *groups,
        "_b",
        *[F.coalesce(F.sum(m).over(earlier), F.lit(0)).alias(f"_bucket_{m}") for m in measures],
        *[F.sum(m).over(whole).alias(f"total_{m}") for m in measures],
    )
    inside = Window.partitionBy(*groups, "_b").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select(
        *groups, "_b", "_s", *measures, *[F.coalesce(F.sum(m).over(inside), F.lit(0)).alias(f"_slice_{m}") for m in measures]
    )
    return slices.join(buckets, [*groups, "_b"]).select(
        *groups,
        "_b",
        "_s",
        *[F.col(m).alias(f"_own_{m}") for m in measures],
        *[(F.col(f"_bucket_{m}") + F.col(f"_slice_{m}")).alias(f"_before_{m}") for m in measures],
        *[f"total_{m}" for m in measures],
    )


def running_totals(
    df: DataFrame, groups: list[str], order: str, measures: list[str], descending: bool = True
) -> DataFrame:
    """Per group and distinct value of ``order``: measure sums, running and group totals.

    Ties are summed first.  Adds ``cum_<m>`` (including the row's own value) and
    ``total_<m>`` for every measure.
    """
    tied = _with_buckets(df.groupBy(*groups, order).agg(*[F.sum(m).alias(m) for m in measures]), order, descending)
    direction = F.col(order).desc() if descending else F.col(order).asc()
    inside = Window.partitionBy(*groups, "_b", "_s").orderBy(direction)
    running = tied.select("*", *[F.sum(m).over(inside).alias(f"_run_{m}") for m in measures])
    return running.join(_offsets(tied, groups, measures), [*groups, "_b", "_s"]).select(
        *groups,
        order,
        *measures,
        *[(F.col(f"_before_{m}") + F.col(f"_run_{m}")).alias(f"cum_{m}") for m in measures],
        *[f"total_{m}" for m in measures],
    )


def grouped_median(
    df: DataFrame, groups: list[str], value: str, into: str = "median", *, mean_of: str | None = None,
    count_into: str | None = None,
) -> DataFrame:
    """Exact median per group, missing values skipped; (a + b) / 2 for an even count.

    Equal values are counted first, map-side, so a hot group with few values is a few
    rows; the counts locate the slice of the middle ranks, and only that slice is sorted.
    ``mean_of`` adds the group mean of another column and ``count_into`` the number of its
    values, from the same counted rows.
    """
    extra = [F.sum(mean_of).alias("_s_of"), F.count(mean_of).alias("_n_of")] if mean_of else []
    present = df.where(F.col(value).isNotNull() & ~F.isnan(value))
    # -0.0 and 0.0 are one value.
    valued = present.withColumn(value, F.col(value) + F.lit(0.0)).groupBy(*groups, value).agg(
        F.count(F.lit(1)).alias("_n"), *extra
    )
    rows = _with_buckets(valued, value)
    lo, hi = F.expr("(total__n - 1) div 2"), F.expr("total__n div 2")
    offsets = _offsets(rows, groups, ["_n"])
    middle = offsets.where((F.col("_before__n") <= hi) & (F.col("_before__n") + F.col("_own__n") > lo))
    inside = Window.partitionBy(*groups, "_b", "_s").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    candidates = (
        rows.select(*groups, value, "_b", "_s", "_n")
        .join(middle, [*groups, "_b", "_s"])
        .withColumn("_upto", F.col("_before__n") + F.sum("_n").over(inside))
        .where((F.col("_upto") - F.col("_n") <= hi) & (F.col("_upto") > lo))
    )
    medians = candidates.groupBy(*groups).agg(((F.min(value) + F.max(value)) / 2.0).alias(into))
    if not mean_of:
        return medians
    means = valued.groupBy(*groups).agg(
        (F.sum("_s_of") / F.nullif(F.sum("_n_of"), F.lit(0))).alias(mean_of), F.sum("_n_of").alias(count_into or "_n_of")
    )
    joined = medians.join(means, groups)
    return joined if count_into else joined.drop("_n_of")


def _holding(counts: DataFrame, by: str, need: Column) -> DataFrame:
    """Of the ordered bins of every ``target``, the one that holds the row of rank ``need``; the rank inside it."""
    upto = F.sum("n").over(Window.partitionBy("target").orderBy(by))
    ranked = counts.withColumn("_upto", upto).withColumn("_need", need)
    inside = ranked.where((F.col("_upto") > F.col("_need")) & (F.col("_upto") - F.col("n") <= F.col("_need")))
    return inside.select("target", "low", "high", (F.col("_need") - F.col("_upto") + F.col("n")).alias("need"))


def column_medians(df: DataFrame, columns: list[str], slices: int = 1 << 18) -> DataFrame:
    """One row (column, median) per numeric column that has any value; exact, (a + b) / 2 for an even count.

    Three scans narrow the range around the two middle ranks of all columns at once: counts of
    equal-ratio bins, of equal-width slices of the bin that holds the rank, and of the values of the
    slice that does.  Counts are summed before the shuffle, which holds columns x bins rows
    however many rows the table has.  Lazy: a scan is joined to the ranges from the one before, two broadcast rows per column.
    """
    listed = [F.struct(F.lit(i).alias("i"), (F.col(f"`{c}`").cast("double") + F.lit(0.0)).alias("v")) for i, c in enumerate(columns)]
    cells = df.select(F.inline(F.array(*listed))).where(F.col("v").isNotNull() & ~F.isnan("v"))  # -0.0 became 0.0
    largest = F.lit(1.7976931348623157e308)  # infinities share the bin of the largest doubles
    finite = F.greatest(F.least(F.col("v"), largest), -largest)
    bins = cells.groupBy("i", order_buckets(finite)[0].alias("b")).agg(
        F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")
    )
    # Targets 2 i and 2 i + 1 are the lower and the upper middle rank of column i.
    sized = bins.withColumn("_total", F.sum("n").over(Window.partitionBy("i")))
    middle = [
        F.struct((F.col("i") * 2 + side).alias("target"), "b", "n", "low", "high", F.expr(f"(_total - {1 - side}) div 2").alias("need"))
        for side in (0, 1)
    ]
    found = _holding(sized.select(F.inline(F.array(*middle))), "b", F.col("need"))

    def narrowed(found: DataFrame, by: Column) -> DataFrame:
        """The range that holds each target's rank after counting the cells of its range by ``by``."""
        ranges = F.broadcast(found.withColumn("i", F.expr("target div 2").cast("int")))
        near = cells.join(ranges, "i").where(F.col("v").between(F.col("low"), F.col("high")))
        counts = near.groupBy("target", by.alias("b")).agg(
            F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.max("need").alias("need")
        )
        return _holding(counts, "b", F.col("need"))

    place = F.try_divide((F.col("v") - F.col("low")) * F.lit(float(slices)), F.col("high") - F.col("low"))
    values = narrowed(narrowed(found, F.coalesce(F.floor(F.nanvl(place, F.lit(0.0))), F.lit(0))), F.col("v"))
    names = F.array(*[F.lit(c) for c in columns])
    medians = values.groupBy(F.expr("target div 2").cast("int").alias("_i")).agg(((F.min("low") + F.max("low")) / 2.0).alias("median"))
    return medians.select(F.element_at(names, F.col("_i") + 1).alias("column"), "median")


def digest(seed: int, key: Column) -> Column:
    """Reproducible random order of keys, the same in every engine."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def digest_thresholds(df: DataFrame, groups: list[str], hashed: str, wanted: Column) -> DataFrame:
    """Per group the ``wanted``-th smallest digest, where ``wanted`` may use the group size ``n``.

    Only the one bucket per group that holds the threshold is sorted.  ``taken`` of the ``times`` rows with
    the threshold's digest belong to the sample; fewer than all only where digests repeat.
    """
    rows = df.select(*groups, F.col(hashed), F.substring(hashed, 1, 6).alias("_b"))
    whole = Window.partitionBy(*groups)
    upto = whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    counts = rows.groupBy(*groups, F.substring("_b", 1, 3).alias("_a"), "_b").agg(F.count(F.lit(1)).alias("_c"))
    coarse = counts.groupBy(*groups, "_a").agg(F.sum("_c").alias("_ac"))
    coarse = (
        coarse.withColumn("_aupto", F.sum("_ac").over(whole.orderBy("_a").rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("n", F.sum("_ac").over(whole))
        .withColumn("_k", wanted.cast("long"))
        .where((F.col("_aupto") >= F.col("_k")) & (F.col("_aupto") - F.col("_ac") < F.col("_k")))
        .select(*groups, "_a", "_k", (F.col("_k") - F.col("_aupto") + F.col("_ac")).alias("_left"))
    )
    boundary = (
        counts.join(coarse, [*groups, "_a"])
        .withColumn("_upto", F.sum("_c").over(upto))
        .where((F.col("_upto") >= F.col("_left")) & (F.col("_upto") - F.col("_c") < F.col("_left")))
        .select(*groups, "_b", (F.col("_left") - F.col("_upto") + F.col("_c")).alias("_need"))
    )
    inside = rows.groupBy(*groups, "_b", hashed).agg(F.count(F.lit(1)).alias("_times"))
    rank = F.sum("_times").over(Window.partitionBy(*groups, "_b").orderBy(hashed))
    return (
        inside.join(boundary, [*groups, "_b"])
        .withColumn("_rank", rank)
        .where((F.col("_rank") >= F.col("_need")) & (F.col("_rank") - F.col("_times") < F.col("_need")))
        .select(
            *groups,
            F.col(hashed).alias("threshold"),
            (F.col("_need") - F.col("_rank") + F.col("_times")).alias("taken"),
            F.col("_times").alias("times"),
        )
    )


# Copies of one row that a task makes at a time.
COPIES = 1 << 16


def drawn(df: DataFrame, key: str, group: str | None, wanted: Column, into: str, seed: int = 42, unique: bool = False) -> DataFrame:
    """Add ``into``: whether a row is among the first ``wanted`` of its group, in a reproducible random order of the keys.

    Rows with one key are ordered by a hash of all their columns, so only wholly equal rows are
    alike; of these the wanted number is drawn too: they are counted and made anew, so a key that
    holds half the rows is neither sorted nor sent to one task.  Rows without a group aren't drawn.
    With ``unique`` the caller vouches for unique keys: one scan less, and repeated keys at the threshold raise.
    """
    columns = [F.col(f"`{c}`") for c in df.columns]
    place = digest(seed, F.col(f"`{key}`"))
    if not unique:
        place = F.concat(F.coalesce(place, F.lit("")), F.lpad(F.hex(F.xxhash64(F.struct(*columns))), 16, "0"))
    hashed = df.withColumn("_place", place)
    groups = [group] if group else []
    found = digest_thresholds(hashed.where(F.col(f"`{group}`").isNotNull()) if group else hashed, groups, "_place", wanted)
    packed = F.struct("threshold", "taken", "times")
    if group:
        by_group = found.agg(F.map_from_entries(F.collect_list(F.struct(group, packed)))).scalar()
        attached = hashed.withColumn("_by_group", by_group).withColumn("_limit", F.try_element_at("_by_group", F.col(f"`{group}`"))).drop("_by_group")
    else:
        attached = hashed.withColumn("_limit", found.select(packed).scalar())
    below = F.coalesce(F.col("_place") < F.col("_limit.threshold"), F.lit(False))
    at = F.coalesce(F.col("_place") == F.col("_limit.threshold"), F.lit(False))
    in_part = at & (F.col("_limit.taken") < F.col("_limit.times"))
    if unique:
        refused = F.raise_error(F.lit("keys repeat: no exact sample")).cast("boolean")
        return attached.withColumn(into, F.when(in_part, refused).otherwise(below | at)).drop("_place", "_limit")
    whole = attached.where(~in_part).withColumn(into, below | at).drop("_place", "_limit")
    equal = attached.where(in_part).groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"), F.max("_limit.taken").alias("_taken"))
    some = equal.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / COPIES))).alias("_part")).repartition("_part")
    last = F.least(F.col("_n"), (F.col("_part") + 1) * COPIES) - 1
    copies = some.select("*", F.explode(F.sequence(F.col("_part") * COPIES, last)).alias("_i"))
    copies = copies.withColumn(into, F.col("_i") < F.col("_taken")).select(*columns, into)
    return whole.unionByName(copies)


def sample_exact(df: DataFrame, key: str, n: int, seed: int = 42, unique: bool = False) -> DataFrame:
    """Exactly ``n`` rows (all, if there are fewer) in a reproducible random choice of keys; see :func:`drawn`."""
    return drawn(df, key, None, F.least(F.lit(n), F.col("n")), "_drawn", seed, unique).where("_drawn").drop("_drawn")


def stratified_split(df: DataFrame, key: str, cls: str, test_share: float = 0.2, seed: int = 42, unique: bool = False) -> DataFrame:
    """Add ``is_test``: round(share * size) rows of every class, reproducibly chosen; see :func:`drawn`.

    The thresholds, one per class, are one map value of the plan, so rows aren't shuffled
    to get theirs; rows without a class are training rows.
    """
    return drawn(df, key, cls, F.floor(F.col("n") * test_share + 0.5), "is_test", seed, unique)
