"""Dataset manifest and path resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.skew import attach

MANIFEST = (
    "name string, description string, modality map<string,string>, labels map<string,string>, numTraining int, numTest int, "
    "training array<struct<image:string,label:string>>, test array<string>"
)


def case_name(path: Column) -> Column:
    """File name without ``.gz`` and ``.nii``."""
    name = F.substring_index(path, "/", -1)
    return F.replace(F.replace(name, F.lit(".gz"), F.lit("")), F.lit(".nii"), F.lit(""))


def read_manifest(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """``role, pos, case_id, image, label`` in list order; the test list is optional.

    ``lines``: every line of the files is a manifest, for as many of them as a file system would not hold as files.
    """
    doc = spark.read.schema(MANIFEST).json(path, multiLine=not lines)
    training = doc.select(F.posexplode("training").alias("pos", "c")).select(
        F.lit("training").alias("role"), "pos", case_name(F.col("c.image")).alias("case_id"), "c.image", "c.label"
    )
    test = doc.select(F.posexplode(F.coalesce("test", F.array().cast("array<string>"))).alias("pos", "image")).select(
        F.lit("test").alias("role"), "pos", case_name(F.col("image")).alias("case_id"), "image", F.lit(None).cast("string").alias("label")
    )
    return training.unionByName(test)


def _directory(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def resolve_paths(cases: DataFrame, files: DataFrame) -> DataFrame:
    """``case_id, path, resolved, rule``: the first layout that exists wins.

    1 the path itself, 2 without ``.gz``, 3 and 4 nested in a directory of the
    same name (``.nii``, then ``.nii.gz``), 5 the lowest path of any volume
    under the directory whose name starts with the base name. ``resolved`` is
    null when nothing matches. All rules are equi-joins: rule 5 meets on the
    prefixes of the file names, reduced to one path per wanted prefix first.
    """
    clean = F.regexp_replace("path", r"^[./]+", "")
    rows = cases.select("case_id", "path", clean.alias("clean"))
    rows = rows.withColumns({"dir": _directory(F.col("clean")), "base": F.substring_index(F.substring_index("clean", "/", -1), ".", 1)})
    root = F.when(F.col("dir") == "", F.lit("")).otherwise(F.concat("dir", F.lit("/")))
    nested = lambda s: F.concat(root, "base", F.lit(f"{s}/"), "base", F.lit(s))
    keys = F.array(
        F.struct(F.lit(1).alias("rule"), F.col("clean").alias("key")),
        F.struct(F.lit(2).alias("rule"), F.when(F.endswith("clean", F.lit(".gz")), F.regexp_replace("clean", r"\.gz$", "")).alias("key")),
        F.struct(F.lit(3).alias("rule"), nested(".nii").alias("key")),
        F.struct(F.lit(4).alias("rule"), nested(".nii.gz").alias("key")),
    )
    wanted = rows.select("case_id", F.explode(keys).alias("k")).select("case_id", "k.rule", "k.key").where("key is not null")
    direct = wanted.join(files.select(F.col("path").alias("key")).distinct(), "key")
    direct = direct.groupBy("case_id").agg(F.min(F.struct("rule", "key")).alias("hit")).select("case_id", "hit.rule", F.col("hit.key").alias("resolved"))

    open_rows = rows.join(direct, "case_id", "left_anti").select("case_id", "dir", "base")
    # every (ancestor directory, name prefix) of a volume file that some open case asks for
    volumes = files.where(F.col("path").rlike(r"\.nii(\.gz)?$")).select("path", _directory(F.col("path")).alias("dir"), F.substring_index("path", "/", -1).alias("name"))
    parts = F.split("dir", "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    volumes = volumes.select("path", "name", F.explode(F.array_distinct(F.concat(ancestors, F.array(F.lit(""))))).alias("dir"))
    # one folder may hold every file: its rows are salted, only prefixes of wanted lengths are
    # made, and each prefix shrinks to its lowest path before it meets the cases
    lengths = open_rows.groupBy("dir").agg(F.collect_set(F.length("base")).alias("lengths"))
    volumes = attach(volumes, lengths, ["dir"], ["path"])
    prefix = F.explode(F.transform(F.filter("lengths", lambda n: n <= F.length("name")), lambda n: F.substring(F.col("name"), F.lit(1), n)))
    smallest = volumes.select("dir", "path", prefix.alias("base")).groupBy("dir", "base").agg(F.min("path").alias("resolved"))
    lowest = smallest.join(open_rows.select("dir", "base").distinct(), ["dir", "base"], "left_semi")
    loose = open_rows.join(lowest, ["dir", "base"]).select("case_id", F.lit(5).alias("rule"), "resolved")
    return rows.select("case_id", "path").join(direct.unionByName(loose), "case_id", "left").select("case_id", "path", "resolved", "rule")


def require_resolved(resolved: DataFrame) -> DataFrame:
    """Raise for cases without a file; names the first five."""
    missing = [r.path for r in resolved.where("resolved is null").orderBy("case_id").limit(5).collect()]
    if missing:
        raise FileNotFoundError(f"no file matches {missing}")
    return resolved
