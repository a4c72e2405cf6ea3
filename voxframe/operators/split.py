"""Stratified splits with exact sizes.

Positions in the split lists follow from a few counts and each case's rank in
its stratum, so no list is ever built: the rank is exact and skew-safe, and
the counts travel as one scalar row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.draws import draw_key
from ..functions.scalars import SIZE_CLASSES, classify_size
from .skew import rank_by_hash

SPLITS = ("train", "val", "test")


def _stratum_plan(stage: DataFrame, n_train: Column, n_val: Column, n_test: Column) -> DataFrame:
    """One row: per size class how many cases go to test and val, and where each split's list continues."""
    row = stage.agg(*[F.count_if(F.col("tumor_category") == c).alias(c) for c in SIZE_CLASSES])
    row = row.withColumns({"_total": n_train + n_val + n_test, "_val": n_val, "_test": n_test})
    for c in SIZE_CLASSES:
        n = F.col(c)
        row = row.withColumns({
            f"{c}_t0": F.greatest(F.lit(1), F.bround(n * F.col("_test") / F.col("_total"), 0).cast("bigint")),
            f"{c}_v0": F.greatest(F.lit(1), F.bround(n * F.col("_val") / F.col("_total"), 0).cast("bigint")),
        })
        squeezed = (n - F.col(f"{c}_t0") - F.col(f"{c}_v0") < 1) & (n >= 3)
        # list slices stop at the end of a short stratum
        row = row.withColumns({
            f"{c}_squeezed": squeezed,
            f"{c}_val": F.when(squeezed, F.least(F.col(f"{c}_v0"), F.floor((n - 1) / 2))).otherwise(
                F.least(n - F.least(n, F.col(f"{c}_t0")), F.col(f"{c}_v0"))),
        })
        row = row.withColumn(f"{c}_test", F.when(F.col(f"{c}_squeezed"), n - 1 - F.col(f"{c}_val")).otherwise(F.least(n, F.col(f"{c}_t0"))))
        row = row.withColumn(f"{c}_train", n - F.col(f"{c}_test") - F.col(f"{c}_val"))
    fields = []
    for i, c in enumerate(SIZE_CLASSES):
        earlier = {s: sum((F.col(f"{e}_{s}") for e in SIZE_CLASSES[:i]), F.lit(0)) for s in SPLITS}
        fields.append(F.struct(F.col(f"{c}_test").alias("test"), F.col(f"{c}_val").alias("val"),
                               *[earlier[s].cast("bigint").alias(f"{s}_before") for s in SPLITS]).alias(c))
    return row.select(F.struct(*fields).alias("plan"))


def stratified_split(cases: DataFrame, n_train: Column, n_val: Column, n_test: Column, seed: int = 42) -> DataFrame:
    """``case_id, tumor_category, split, list_pos``; rounding may miss the targets.

    Within a size class the order is a seeded hash; test first, then val, the
    rest train. ``list_pos`` is the place in the split's list (small, medium,
    large). The targets are columns, so they may come from a scalar subquery.
    """
    stage = cases.withColumn("tumor_category", classify_size(F.col("volume")))
    keyed = stage.withColumn("_key", draw_key(seed, F.col("case_id")))
    ranked = rank_by_hash(keyed, ["tumor_category"], "_key", ["case_id"]).drop("_key")
    plan = _stratum_plan(stage, n_train, n_val, n_test).scalar()
    cat = F.col("tumor_category")
    own = F.when(cat == "small", F.col("_plan.small")).when(cat == "medium", F.col("_plan.medium")).otherwise(F.col("_plan.large"))
    rows = ranked.withColumn("_plan", plan).withColumn("_own", own).drop("_plan")
    rank, test, val = F.col("rank"), F.col("_own.test"), F.col("_own.val")
    split = F.when(rank <= test, "test").when(rank <= test + val, "val").otherwise("train")
    pos = (
        F.when(rank <= test, F.col("_own.test_before") + rank)
        .when(rank <= test + val, F.col("_own.val_before") + rank - test)
        .otherwise(F.col("_own.train_before") + rank - test - val)
    )
    return rows.select(*cases.columns, "tumor_category", split.alias("split"), pos.cast("bigint").alias("list_pos"))


def _moves(split: DataFrame, n_train: Column, n_val: Column, n_test: Column) -> DataFrame:
    """One row: list sizes and how many tail rows go where."""
    zero = F.lit(0)

    def over(x, y):
        return F.greatest(zero, F.col(x) - F.col(y))

    row = split.agg(*[F.count_if(F.col("split") == s).alias(s) for s in SPLITS])
    row = row.withColumns({"to_train": n_train, "to_val": n_val, "to_test": n_test})
    row = row.withColumns({
        "surplus": over("train", "to_train"),
        "deficit": over("to_train", "train"),
    })
    row = row.withColumns({
        "train_val": F.least("surplus", over("to_val", "val")),
        "val_train": F.least("deficit", over("val", "to_val")),
    })
    row = row.withColumns({
        "train_test": F.least(F.col("surplus") - F.col("train_val"), over("to_test", "test")),
        "test_train": F.least(F.col("deficit") - F.col("val_train"), over("test", "to_test")),
    })
    row = row.withColumns({
        "val_now": F.col("val") + F.col("train_val") - F.col("val_train"),
        "test_now": F.col("test") + F.col("train_test") - F.col("test_train"),
    })
    row = row.withColumns({
        "val_test": F.least(over("val_now", "to_val"), over("to_test", "test_now")),
        "test_val": F.least(over("test_now", "to_test"), over("to_val", "val_now")),
    })
    wanted = [*SPLITS, "train_val", "train_test", "val_train", "val_test", "test_train", "test_val"]
    return row.select(F.struct(*wanted).alias("moves"))


def adjust_split(split: DataFrame, n_train: Column, n_val: Column, n_test: Column) -> DataFrame:
    """Exact sizes by moving rows from the list tails, in closed form.

    A train surplus goes to val, then test; a deficit is filled from val, then
    test; last, val and test balance each other.
    """
    rows = split.withColumn("_m", _moves(split, n_train, n_val, n_test).scalar())
    now = F.col("split")
    size = F.when(now == "train", F.col("_m.train")).when(now == "val", F.col("_m.val")).otherwise(F.col("_m.test"))
    rows = rows.withColumn("_tail", size - F.col("list_pos"))

    def leave(first: str, first_to: str, second: str, second_to: str) -> Column:
        one, two = F.col(f"_m.{first}"), F.col(f"_m.{second}")
        return F.when(F.col("_tail") < one, first_to).when(F.col("_tail") < one + two, second_to).otherwise(now)

    final = (
        F.when(now == "train", leave("train_val", "val", "train_test", "test"))
        .when(now == "val", leave("val_train", "train", "val_test", "test"))
        .otherwise(leave("test_train", "train", "test_val", "val"))
    )
    return rows.withColumn("split", final).drop("_m", "_tail", "list_pos")


def validate_split(split: DataFrame, cases: DataFrame, targets: DataFrame) -> DataFrame:
    """Counts of violations: overlap, missing or foreign cases, wrong sizes.

    One grouping over the memberships and the known cases answers the three
    set checks; ``targets`` is ``(split, target)``.
    """
    member = [F.max((F.col("split") == s).cast("int")).alias(s) for s in SPLITS]
    both = split.select("case_id", "split", F.lit(0).alias("known")).unionByName(
        cases.select("case_id", F.lit(None).cast("string").alias("split"), F.lit(1).alias("known"))
    )
    per_case = both.groupBy("case_id").agg(F.max("known").alias("known"), *member).fillna(0, list(SPLITS))
    lists = sum((F.col(s) for s in SPLITS), F.lit(0))
    checks = per_case.agg(
        F.count_if(lists > 1).alias("overlapping"),
        F.count_if((lists == 0) & (F.col("known") == 1)).alias("missing"),
        F.count_if((lists > 0) & (F.col("known") == 0)).alias("foreign"),
    )
    sizes = targets.join(split.groupBy("split").agg(F.count("*").alias("size")), "split", "left").fillna(0, ["size"])
    wrong = sizes.agg(F.count_if(F.col("size") != F.col("target")).alias("n")).select(F.lit("wrong_size").alias("check"), "n")
    return checks.unpivot([], ["overlapping", "missing", "foreign"], "check", "n").unionByName(wrong)
