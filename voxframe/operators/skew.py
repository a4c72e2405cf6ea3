"""Exact per-group operations that never put one hot group into one task.

Any key may hold a large share of all rows. These helpers split such a group
by a salt, a block or a value range, work on the pieces, and combine small
per-piece summaries; the results equal the single-group ones.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import cut_lineage

# distinct values of one group or range that one task may order
RANGE_VALUES = 1_000_000
# a key with more rows than this is heavy
HEAVY = 100_000
# narrow rows that one task may sort or group
TASK_ROWS = 500_000


def pieces_of(rows: DataFrame) -> int | None:
    """Tasks of :data:`TASK_ROWS` for a stored table, or None if the shuffle partitions are enough. Parquet counts its rows in the footers."""
    pieces = -(-rows.count() // TASK_ROWS)
    return pieces if pieces > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def attach(rows: DataFrame, per_key: DataFrame, keys: Sequence[str], spread: Sequence[str], how: str = "inner",
           salts: int = 16, heavy: str | None = None, pieces: int | None = None) -> DataFrame:
    """Join one-row-per-key attributes to many rows with salted keys.

    ``per_key`` is repeated once per salt, so the rows of a hot key spread over
    ``salts`` tasks. A small ``per_key`` still becomes a broadcast under AQE.

    Where keys are nearly as many as rows, ``heavy`` names a column of ``per_key`` with the
    rows of a key: only keys with more than :data:`HEAVY` of them are repeated, and these are few.
    ``per_key`` should be a stored table then. The sizes of stored files say little about rows, so it is not broadcast.

    ``pieces`` (see :func:`pieces_of`) deals the rows to so many tasks, where the shuffle partitions are too few for them.
    """
    if heavy is not None:
        hot = F.col(heavy) > HEAVY
        marks = per_key.where(hot).select(*keys).withColumn("_hot", F.lit(True))
        spread_rows = rows.join(F.broadcast(marks), list(keys), "left")
        salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")).otherwise(0)
        repeated = F.when(hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
        salted_keys = per_key.withColumn("_salt", F.explode(repeated)).drop(heavy).hint("merge")
        return spread_rows.withColumn("_salt", salt).drop("_hot").join(salted_keys, [*keys, "_salt"], how).drop("_salt")
    salted_rows = rows.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    if pieces is not None:
        salted_rows = salted_rows.repartition(pieces, *keys, "_salt")
    salted_keys = per_key.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted_rows.join(salted_keys, [*keys, "_salt"], how).drop("_salt")


def rank_in_ranges(rows: DataFrame, keys: Sequence[str], piece: Column, order: Sequence, out: str = "rank") -> DataFrame:
    """Exact ``row_number`` per key.

    ``piece`` must rise with ``order``; it cuts each group into pieces that are
    ranked on their own, and the sizes of the lower pieces are added.
    """
    cut = rows.withColumn("_piece", piece)
    sizes = cut.groupBy(*keys, "_piece").agg(F.count("*").alias("_n"))
    below = W.partitionBy(*keys).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_piece", F.coalesce(F.sum("_n").over(below), F.lit(0)).alias("_before"))
    inside = W.partitionBy(*keys, "_piece").orderBy(*order)
    return (
        cut.withColumn("_local", F.row_number().over(inside))
        .join(offsets, [*keys, "_piece"])
        .withColumn(out, (F.col("_before") + F.col("_local")).cast("bigint"))
        .drop("_piece", "_local", "_before")
    )


def rank_by_hash(rows: DataFrame, keys: Sequence[str], hash_col: str, ties: Sequence[str], out: str = "rank") -> DataFrame:
    """Exact rank per key in hash order; two hex digits give 256 even pieces."""
    return rank_in_ranges(rows, keys, F.substring(hash_col, 1, 2), [hash_col, *ties], out)


def running_before(rows: DataFrame, keys: Sequence[str], order: str, value: Column, out: str, block: int = 4096) -> DataFrame:
    """Maximum of ``value`` over all earlier rows of the group, by blocks of ``order``."""
    cut = rows.withColumn("_block", F.floor(F.col(order) / block)).withColumn("_v", value)
    tops = cut.groupBy(*keys, "_block").agg(F.max("_v").alias("_top"))
    earlier = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    carried = tops.select(*keys, "_block", F.max("_top").over(earlier).alias("_carried"))
    inside = W.partitionBy(*keys, "_block").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return (
        cut.withColumn("_inside", F.max("_v").over(inside))
        .join(carried, [*keys, "_block"])
        .withColumn(out, F.greatest("_inside", "_carried"))
        .drop("_block", "_v", "_inside", "_carried")
    )


def exact_quantiles(rows: DataFrame, keys: Sequence[str], value: str, quantiles: dict[str, float], weight: str | None = None,
                    splits: int = 64, most: int = RANGE_VALUES) -> DataFrame:
    """Exact linearly interpolated quantiles per group.

    Equal values are counted first; ``weight`` names a column of counts. While a
    group has more than ``most`` distinct values, approximate split points cut it
    into ranges, the counts of the ranges tell which of them hold a wanted rank, and
    only those go on, as groups of their own. What is left is ordered. A NaN in the
    group makes every quantile NaN; NULLs are ignored.
    """
    keys = list(keys)
    times = F.count("*") if weight is None else F.sum(weight)
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(times.alias("_n"))
    # with no key columns, a constant column keeps the joins below equi-joins
    group = keys or ["_all"]
    if not keys:
        counts = counts.withColumn("_all", F.lit(0))
    counts = cut_lineage(counts)
    largest = counts.groupBy(*group).agg(F.count("*").alias("_size")).agg(F.max("_size")).first()[0] or 0
    totals = None if largest <= most else cut_lineage(counts.groupBy(*group).agg(F.sum("_n").alias("_total"), F.max(F.isnan("_v")).alias("_nan"), F.count("*").alias("_size")))
    ranks = {}
    for name, q in quantiles.items():
        position = F.lit(float(q)) * (F.col("_total") - 1)
        ranks[name] = (position, F.floor(position), F.ceil(position))

    def wanted(before: Column, size: Column) -> Column:
        return reduce(lambda a, b: a | b, [(before <= r) & (r < before + size) for _, *pair in ranks.values() for r in pair])

    part = counts.withColumns({"_slot": F.lit(0).cast("bigint"), "_before": F.lit(0).cast("bigint")})
    slot = [*group, "_slot"]
    while largest > most:
        points = [i / splits for i in range(1, splits)]
        cuts = part.groupBy(*slot).agg(F.percentile_approx("_v", points, 1000).alias("_cuts"))
        tagged = attach(part, cuts, slot, ["_v"]).withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col("_v")))).drop("_cuts")
        sizes = tagged.groupBy(*slot, "_range", "_before").agg(F.sum("_n").alias("_sum"), F.count("*").alias("_values"))
        lower = W.partitionBy(*slot).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
        placed = sizes.withColumn("_start", F.col("_before") + F.coalesce(F.sum("_sum").over(lower), F.lit(0))).join(totals.drop("_nan", "_size"), group)
        needed = cut_lineage(placed.where(wanted(F.col("_start"), F.col("_sum"))).select(*slot, "_range", "_start", "_values"))
        kept = attach(tagged.drop("_before"), needed.drop("_values"), [*slot, "_range"], ["_v"])
        part = cut_lineage(kept.select(*group, "_v", "_n", (F.col("_slot") * splits + F.col("_range")).alias("_slot"), F.col("_start").alias("_before")))
        before, largest = largest, needed.agg(F.max("_values")).first()[0] or 0
        if largest == before:  # the split points could not part it
            break
    if totals is None:
        # every group fits one task, so one shuffle gives the places and the totals, and no table of groups is joined
        whole = W.partitionBy(*group)
        before = F.sum("_n").over(whole.orderBy("_v").rowsBetween(W.unboundedPreceding, -1))
        placed = counts.withColumns({"_start": F.coalesce(before, F.lit(0)), "_total": F.sum("_n").over(whole), "_nan": F.max(F.isnan("_v")).over(whole)})
    else:
        inside = W.partitionBy(*slot).orderBy("_v").rowsBetween(W.unboundedPreceding, -1)
        start = F.col("_before") + F.coalesce(F.sum("_n").over(inside), F.lit(0))
        placed = attach(part.withColumn("_start", start), totals, group, ["_v"], heavy="_size")

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_start") <= rank) & (rank < F.col("_start") + F.col("_n")), F.col("_v")))

    aggs = [F.max("_nan").alias("_nan"), F.max("_total").alias("_total")]
    for name, (_, low, high) in ranks.items():
        aggs += [at(low).alias(f"_{name}_low"), at(high).alias(f"_{name}_high")]
    found = placed.groupBy(*group).agg(*aggs)
    cols = []
    for name, (position, low, _) in ranks.items():
        a, b = F.col(f"_{name}_low"), F.col(f"_{name}_high")
        cols.append(F.when(F.col("_nan"), F.lit(float("nan"))).otherwise(a + (b - a) * (position - low)).alias(name))
    return found.select(*keys, *cols)


def first_by(order: Sequence[Column], value: Column) -> Column:
    """Aggregate: the value of the row that comes first in ``order`` (no window)."""
    return F.min_by(value, F.struct(*order))
