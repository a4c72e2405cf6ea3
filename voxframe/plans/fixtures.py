"""The given tables seen as volumes, slices, cases and runs.

Each fixture exists twice: as a DataFrame over the parquet tables and as the
SQL text of a common table expression for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.skew import pieces_of, rank_in_ranges

NX, NY, NZ = 16, 16, 7
N_VOXELS = NX * NY * NZ


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scored_voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """voxels with a probability and a truth flag."""
    lines = table(spark, sf_dir, "lineitem")
    cells = ["case_id", "x", "y", "z"]
    rows = lines.select(
        F.col("l_suppkey").alias("case_id"),
        (F.col("l_partkey") % 16).cast("int").alias("x"),
        (F.col("l_orderkey") % 16).cast("int").alias("y"),
        (F.col("l_linenumber") - 1).cast("int").alias("z"),
        (F.col("l_discount") * 10).alias("prob"),
        F.when((F.col("l_returnflag") == "R") & (F.col("l_tax") >= 0.06), 1).otherwise(0).alias("gt"),
    )
    # few voxels come twice, so nothing is lost by grouping after the shuffle
    if pieces := pieces_of(lines):
        rows = rows.repartition(pieces, *cells)
    return rows.groupBy(*cells).agg(F.max("prob").alias("prob"), F.max("gt").alias("gt"))


F1 = """f1 as (select l_suppkey as case_id, cast(l_partkey % 16 as int) as x, cast(l_orderkey % 16 as int) as y,
  cast(l_linenumber - 1 as int) as z, max(l_discount * 10) as prob,
  max(case when l_returnflag = 'R' and l_tax >= 0.06 then 1 else 0 end) as gt from lineitem group by 1, 2, 3, 4)"""


def voxel_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shape and spacing of the F1 cases: one row per distinct case."""
    return (
        table(spark, sf_dir, "lineitem")
        .select(F.col("l_suppkey").alias("case_id"))
        .distinct()
        .select(
            "case_id",
            F.lit(N_VOXELS).alias("n_voxels"),
            F.lit(NX).alias("nx"),
            F.lit(NY).alias("ny"),
            F.lit(NZ).alias("n_slices"),
            (F.lit(0.5) + (F.col("case_id") % 5) * 0.125).alias("sx"),
            (F.lit(0.5) + (F.col("case_id") % 5) * 0.125).alias("sy"),
            (F.lit(1.0) + (F.col("case_id") % 4) * 0.5).alias("sz"),
        )
        .withColumn("voxel_mm3", F.col("sx") * F.col("sy") * F.col("sz"))
    )


VOXEL_CASES = f"""cases as (select case_id, {N_VOXELS} as n_voxels, {NZ} as n_slices, 0.5::double + (case_id % 5) * 0.125::double as sx,
  0.5::double + (case_id % 5) * 0.125::double as sy, 1.0::double + (case_id % 4) * 0.5::double as sz,
  (0.5::double + (case_id % 5) * 0.125::double) * (0.5::double + (case_id % 5) * 0.125::double) * (1.0::double + (case_id % 4) * 0.5::double) as voxel_mm3
  from (select distinct l_suppkey as case_id from lineitem))"""

# paired mask of F1 at threshold 0.5
MASK = """mask as (select case_id, x, y, z, cast(prob > 0.5 as int) as pred, gt from f1 where prob > 0.5 or gt = 1)"""


def slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """slices with a foreground count and a mean intensity."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(
            F.col("l_suppkey").alias("case_id"),
            ((F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate") - 1).cast("int").alias("slice_idx"),
        )
        .agg(
            F.sum(F.when((F.col("l_returnflag") == "R") & (F.col("l_tax") >= 0.07) & (F.col("l_discount") >= 0.08), 1).otherwise(0)).alias("n_pos"),
            (F.avg("l_quantity") / 50).alias("slice_mean"),
        )
    )


F2 = """f2 as (select l_suppkey as case_id, cast((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 as int) as slice_idx,
  cast(sum(case when l_returnflag = 'R' and l_tax >= 0.07 and l_discount >= 0.08 then 1 else 0 end) as bigint) as n_pos,
  avg(l_quantity) / 50 as slice_mean from lineitem group by 1, 2)"""


def case_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """case statistics with all three size classes."""
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_custkey").alias("case_id"))
        .agg(
            F.sum("o_totalprice").alias("_price"),
            F.count("*").alias("positive_slices"),
            F.sum(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).alias("n_components"),
        )
        .select("case_id", (F.col("_price") * (1 + F.col("case_id") % 7) / 2000).alias("volume"), "positive_slices", "n_components")
    )


F3 = """f3 as (select o_custkey as case_id, sum(o_totalprice) * (1 + o_custkey % 7) / 2000 as volume, count(*) as positive_slices,
  cast(sum(case when o_orderstatus = 'F' then 1 else 0 end) as bigint) as n_components from orders group by o_custkey)"""


def pixel_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8x8 array slices; eight consecutive vectors form a case."""
    return table(spark, sf_dir, "embeddings").select(
        F.floor(F.col("vec_id") / 8).alias("case_id"),
        (F.col("vec_id") % 8).cast("int").alias("slice_idx"),
        F.col("embedding").cast("array<double>").alias("pixels"),
        "label",
    )


F4 = """f4 as (select vec_id // 8 as case_id, cast(vec_id % 8 as int) as slice_idx, label, embedding as pixels from embeddings),
 px as (select case_id, slice_idx, label, i - 1 as p, (i - 1) // 8 as r, (i - 1) % 8 as c, cast(pixels[i] as double) as v
  from f4, (select unnest(range(1, 65)) as i))"""


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run history; the epoch counts the run's events in time order."""
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run_id"),
        "ts",
        "event_id",
        (F.col("value") / 500).alias("score"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).alias("nonfinite"),
    )
    ranked = rank_in_ranges(events, ["run_id"], F.col("ts").cast("date"), ["ts", "event_id"], "epoch")
    return ranked.select("run_id", F.col("epoch").cast("int").alias("epoch"), "score", "nonfinite")


F5 = """f5 as (select user_id as run_id, cast(row_number() over (partition by user_id order by ts, event_id) as int) as epoch,
  value / 500 as score, case when event_type = 'error' then 1 else 0 end as nonfinite from events)"""


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """content fingerprints."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("case_id"), F.col("doc_id").alias("pos"), F.md5("text").alias("fingerprint"), "source", "lang", "n_chars"
    )


F6 = "f6 as (select doc_id as case_id, md5(text) as fingerprint, source, lang, n_chars from documents)"


def scored_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """probability against a binary truth, grouped by language."""
    labels = table(spark, sf_dir, "labels")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return labels.join(docs, "doc_id").select(
        F.col("doc_id").alias("item_id"),
        F.col("lang").alias("case_id"),
        F.least(F.col("n_chars").cast("double") / 2000.0, F.lit(1.0)).alias("prob"),
        F.col("quality").alias("gt"),
        "toxic",
    )


F7 = """f7 as (select l.doc_id as item_id, d.lang as case_id, least(cast(d.n_chars as double) / 2000.0::double, 1.0::double) as prob, l.quality as gt, l.toxic
  from labels l join documents d on l.doc_id = d.doc_id)"""


def run_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8: scores by (run, seed, case)."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(
            F.col("l_linenumber").alias("run_id"),
            F.when(F.col("l_linestatus") == "F", 42).otherwise(43).alias("seed"),
            F.col("l_suppkey").alias("case_id"),
        )
        .agg((F.avg("l_discount") * 10).alias("dice"), (F.avg("l_quantity")).alias("hd95"),
             (F.avg("l_tax") * 10).alias("sensitivity"), (F.avg("l_extendedprice") / 100000).alias("precision"))
    )


F8 = """f8 as (select l_linenumber as run_id, case when l_linestatus = 'F' then 42 else 43 end as seed, l_suppkey as case_id,
  avg(l_discount) * 10 as dice, avg(l_quantity) as hd95, avg(l_tax) * 10 as sensitivity, avg(l_extendedprice) / 100000 as "precision"
  from lineitem group by 1, 2, 3)"""


def case_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """flips, spacing and shape per case."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        k.alias("case_id"),
        F.when(k % 2 == 0, -1).otherwise(1).alias("flip_x"),
        F.when(k % 3 == 0, -1).otherwise(1).alias("flip_y"),
        F.lit(1).alias("flip_z"),
        (F.lit(0.5) + (k % 5) * 0.125).alias("sp_xy"),
        (F.lit(1.0) + (k % 4) * 0.5).alias("sp_z"),
        F.lit(NX).alias("nx"),
        F.lit(NY).alias("ny"),
        F.lit(NZ).alias("nz"),
    )


F9 = f"""f9 as (select s_suppkey as case_id, case when s_suppkey % 2 = 0 then -1 else 1 end as flip_x,
  case when s_suppkey % 3 = 0 then -1 else 1 end as flip_y, 1 as flip_z, 0.5::double + (s_suppkey % 5) * 0.125::double as sp_xy,
  1.0::double + (s_suppkey % 4) * 0.5::double as sp_z, {NX} as nx, {NY} as ny, {NZ} as nz from supplier)"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ordered neighbours within a case."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("case_id"), F.col("turn").cast("int").alias("slice_idx"), F.length("text").alias("n_pos")
    )


F10 = "f10 as (select conv_id as case_id, cast(turn as int) as slice_idx, length(text) as n_pos from conversations)"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double, so both engines' summation orders compare equal."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
