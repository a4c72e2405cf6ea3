"""Stored slices, splits, metadata, statistics and experiment runs."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

METADATA = (
    "case_id string, original_affine array<array<double>>, original_shape array<int>, original_spacing array<double>, ornt array<array<double>>, "
    "canonical_shape array<int>, canonical_spacing array<double>, target_spacing array<double>, resampled_shape array<int>, "
    "crop_bbox struct<x_min:int,x_max:int,y_min:int,y_max:int,z_min:int,z_max:int>, cropped_shape array<int>, target_slice_size array<int>, hu_min double, hu_max double"
)
RUN_PATH = r"experiments/([^/]+)/seed_([^/]+)/"


def write_slices(slices: DataFrame, path: str) -> None:
    """Whole volumes, one folder per split, ordered by case and slice.

    Overwrites everything, so a case that moved to another split leaves no
    stale copy behind.
    """
    ranged = slices.repartitionByRange("split", "case_id", "slice_idx").sortWithinPartitions("split", "case_id", "slice_idx")
    ranged.write.mode("overwrite").partitionBy("split").parquet(path)


def write_bucketed(rows: DataFrame, path: str, buckets: int, *order: str) -> DataFrame:
    """``rows`` as a table in ``buckets`` by case, sorted inside, and the table.

    Tables with the same number of buckets join and group by case without a shuffle.
    Choose it so that a bucket fits a task; a case that is larger than that should stay in
    a plain table, since all its rows share a bucket. The name is taken from the folder.
    """
    name = re.sub(r"[^a-z0-9]", "_", path.rstrip("/").rsplit("/", 1)[-1].lower())
    # one file a bucket
    dealt = rows.repartition(buckets, "case_id")
    dealt.write.mode("overwrite").bucketBy(buckets, "case_id").sortBy("case_id", *order).option("path", path).saveAsTable(name)
    return rows.sparkSession.table(name)


def read_slices(spark: SparkSession, path: str, split: str | None = None, first: int | None = None, last: int | None = None) -> DataFrame:
    """Any subset; the split prunes folders and the slice range row groups."""
    rows = spark.read.parquet(path)
    if split is not None:
        rows = rows.where(F.col("split") == split)
    if first is not None:
        rows = rows.where(F.col("slice_idx") >= first)
    if last is not None:
        rows = rows.where(F.col("slice_idx") <= last)
    return rows


def read_split(spark: SparkSession, path: str) -> DataFrame:
    """``case_id, split`` from a split document; a missing file raises at once."""
    lists = "train array<string>, val array<string>, test array<string>"
    doc = spark.read.schema(f"{lists}, splits struct<{lists.replace(' array', ':array')}>").json(path, multiLine=True)
    parts = [
        doc.select(F.explode(F.coalesce(F.col(s), F.col(f"splits.{s}"))).alias("case_id"), F.lit(s).alias("split")) for s in ("train", "val", "test")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """One row per case of an index document, arrays as stored."""
    case = "struct<split:string,n_slices:int,positive_slices:array<int>,body_slices:array<int>,tumor_voxels:bigint>"
    doc = spark.read.schema(f"cases map<string,{case}>").json(path, multiLine=True)
    return doc.select(F.explode("cases").alias("case_id", "c")).select("case_id", "c.*")


def index_flags(index: DataFrame) -> DataFrame:
    """Slice rows with positive and body flags from the stored lists."""
    rows = index.select("case_id", "positive_slices", "body_slices", F.explode(F.sequence(F.lit(0), F.col("n_slices") - 1)).alias("slice_idx"))
    return rows.select(
        "case_id", "slice_idx", F.array_contains("positive_slices", F.col("slice_idx")).alias("is_positive"),
        F.array_contains("body_slices", F.col("slice_idx")).alias("is_body"),
    )


def read_metadata(spark: SparkSession, pattern: str, lines: bool = False) -> DataFrame:
    """Reconstruction metadata, one document per case: a file each, or with ``lines`` a line each."""
    rows = spark.read.schema(METADATA).json(pattern, multiLine=not lines)
    return rows.withColumn("ornt", F.col("ornt").cast("array<array<int>>"))


def without_metadata(cases: DataFrame, metadata: DataFrame) -> DataFrame:
    """Cases to report and skip."""
    return cases.select("case_id").distinct().join(metadata, "case_id", "left_anti")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True, enforceSchema=False)


def discover_runs(spark: SparkSession, root: str, config_schema: str = "exp_name string, seed int, model_type string, loss_type string, sampling string, n_adjacent int, lr double") -> DataFrame:
    """``run_id, run_seed`` of every run folder, named configuration fields, and ``config``: all of them as text."""
    rows = spark.read.text(f"{root}/experiments/*/seed_*/config.json", wholetext=True)
    path = F.col("_metadata.file_path")
    keys = [F.regexp_extract(path, RUN_PATH, 1).alias("run_id"), F.regexp_extract(path, RUN_PATH, 2).cast("int").alias("run_seed")]
    named = F.from_json("value", config_schema).alias("named")
    return rows.select(*keys, named, F.from_json("value", "map<string,string>").alias("config")).select("run_id", "run_seed", "named.*", "config")


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """The leaves of a report written as lines."""
    lines = spark.read.schema("section string, name string, values map<string,double>").json(path)
    return lines.select("section", "name", F.explode("values").alias("leaf", "value"))


def run_overview(spark: SparkSession, root: str) -> DataFrame:
    """Every run with its configuration, the Dice its report gives, and its per-case scores in short.

    A run without a report or without scores has NULL there.
    """
    runs = discover_runs(spark, root)
    reports = read_report(spark, f"{root}/experiments/*/seed_*/benchmark_report.json").select(
        F.regexp_extract(F.input_file_name(), RUN_PATH, 1).alias("run_id"), F.regexp_extract(F.input_file_name(), RUN_PATH, 2).cast("int").alias("run_seed"), "section", "leaf", "value")
    told = reports.where("section = 'test_metrics_summary' and leaf = 'mean_dice_3d'").select("run_id", "run_seed", F.col("value").alias("reported_dice"))
    scores = read_run_table(spark, root, "test_results_per_patient.csv", "case_id string, dice_3d double")
    short = scores.groupBy("run_id", F.col("seed").alias("run_seed")).agg(F.count("*").alias("n_cases"), F.avg("dice_3d").alias("mean_dice"), F.min("dice_3d").alias("worst_dice"))
    keys = ["run_id", "run_seed"]
    return runs.join(told, keys, "left").join(short, keys, "left")


def read_run_table(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """One CSV of every run, keyed by the folder names."""
    rows = spark.read.schema(schema).csv(f"{root}/experiments/*/seed_*/{name}", header=True, enforceSchema=False)
    path = F.col("_metadata.file_path")
    return rows.select(F.regexp_extract(path, RUN_PATH, 1).alias("run_id"), F.regexp_extract(path, RUN_PATH, 2).cast("int").alias("seed"), "*")
