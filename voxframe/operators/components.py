"""Connected components of sparse masks (six face neighbours).

Voxels are grouped into cubes of bounded size. Inside a cube the components
come from array operations on at most ``block**3`` cells. Only cube faces are
then compared. The remaining graph of cube components is far smaller than the
mask: a case whose counted edges fit a bound is joined in one task, any other by
alternating large-star and small-star joins (Kiveris et al., 2014). A
component's label is its lowest raster index.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import cut_lineage
from .batches import map_sorted_groups
from .masks import VOXEL, raster_index
from .skew import attach

DEFAULT_BLOCK = 64
# at most this many label pairs of one case are joined inside a task (16 MB)
LOCAL_EDGES = 1_000_000


def join_pairs(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lowest member of each of ``n`` items' sets after joining ``a[i]`` with ``b[i]``."""
    parent = np.arange(n)
    while True:
        pa_, pb = parent[a], parent[b]
        low, high = np.minimum(pa_, pb), np.maximum(pa_, pb)
        apart = low != high
        if not apart.any():
            return parent
        np.minimum.at(parent, high[apart], low[apart])
        while True:
            jumped = parent[parent]
            if np.array_equal(jumped, parent):
                break
            parent = jumped


def _lowest_ids(positions: np.ndarray, steps: tuple[int, ...], ids: np.ndarray) -> np.ndarray:
    """Lowest id of each cell's component.

    ``positions`` are distinct and ascending; cells whose positions differ by
    one of ``steps`` touch.
    """
    pairs = []
    for step in steps:
        at = np.minimum(np.searchsorted(positions, positions + step), len(positions) - 1)
        hit = np.flatnonzero(positions[at] == positions + step)
        pairs.append(np.stack([hit, at[hit]]))
    parent = join_pairs(len(positions), *np.concatenate(pairs, axis=1))
    lowest = np.full(len(positions), np.iinfo(np.int64).max)
    np.minimum.at(lowest, parent, ids)
    return lowest[parent]


def label_within_blocks(mask: DataFrame, ny: int, nz: int, block: int, carry: Sequence[str] = ()) -> DataFrame:
    """Component labels inside each cube of ``block**3`` cells; columns named in ``carry`` stay beside them."""
    side = block + 1  # one spare cell per axis keeps neighbours from wrapping around
    local = [F.pmod(F.col(a), F.lit(block)).cast("bigint") for a in "xyz"]
    cubes = mask.select(
        *VOXEL,
        raster_index("x", "y", "z", F.lit(ny), F.lit(nz)).alias("id"),
        *[F.floor(F.col(a) / block).cast("int").alias(f"b{a}") for a in "xyz"],
        ((local[0] * side + local[1]) * side + local[2]).alias("cell"),
        *carry,
    )

    def label(table: pa.Table, starts: np.ndarray):
        # whole cubes side by side on one axis, so a single pass labels them all
        cube = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, table.num_rows)))
        positions = table.column("cell").to_numpy() + cube * (side**3 + side**2)
        labels = _lowest_ids(positions, (side * side, side, 1), table.column("id").to_numpy())
        out = table.select([*VOXEL, *carry]).append_column("label", pa.array(labels))
        yield from out.to_batches()

    kinds = {c: mask.schema[c].dataType.simpleString() for c in ("case_id", *carry)}
    schema = ", ".join([f"case_id {kinds['case_id']}", "x int, y int, z int", *[f"{c} {kinds[c]}" for c in carry], "label bigint"])
    return map_sorted_groups(cubes, ["case_id", "bx", "by", "bz"], ["cell"], schema, label, mask)


def _face_edges(labelled: DataFrame, ny: int, nz: int, block: int) -> DataFrame:
    """Pairs of labels that touch across a cube face, repeated ones too.

    A voxel on a lower face reports at its own place, one on an upper face at
    the place of its neighbour; where both reports meet, the labels touch.
    """
    reports, at_face = [], F.lit(False)
    # one number names a face: the place, in a raster with a spare cell at the ends, and the axis
    place = raster_index("x", "y", "z", F.lit(ny + 1), F.lit(nz + 1)) * 3
    steps = {"x": (ny + 1) * (nz + 1), "y": nz + 1, "z": 1}
    for i, axis in enumerate("xyz"):
        inner = F.pmod(F.col(axis), F.lit(block))
        at_face = at_face | (inner == 0) | (inner == block - 1)
        reports.append(F.when(inner == 0, F.struct((place + i).alias("face"), F.col("label").alias("a"), F.lit(None).cast("bigint").alias("b"))))
        reports.append(F.when(inner == block - 1, F.struct((place + (3 * steps[axis] + i)).alias("face"), F.lit(None).cast("bigint").alias("a"), F.col("label").alias("b"))))
    faces = labelled.where(at_face).select("case_id", F.explode(F.filter(F.array(*reports), lambda r: r.isNotNull())).alias("r")).select("case_id", "r.*")
    met = faces.groupBy("case_id", "face").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return met.where("a is not null and b is not null").select("case_id", "a", "b")


def resolve_graph(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame | None:
    """``(case_id, label, root)`` for every node of an undirected label graph, or None without edges.

    A case whose edges are counted and fit ``local_edges`` is joined inside one
    task; a larger one goes through the star joins.
    """
    edges = cut_lineage(edges.where("a <> b").select("case_id", F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    sizes = edges.groupBy("case_id").agg(F.count("*").alias("n"))
    largest = sizes.agg(F.max("n")).first()[0] or 0
    if largest == 0:
        return None
    if largest <= local_edges:
        return _resolve_in_task(edges)
    # no node has more neighbours than its case has edges
    bounded = largest <= LOCAL_EDGES
    if not local_edges:
        return _resolve_by_stars(edges, bounded)
    small = attach(edges, sizes.where(F.col("n") <= local_edges).select("case_id"), ["case_id"], ["u", "v"])
    large = attach(edges, sizes.where(F.col("n") > local_edges).select("case_id"), ["case_id"], ["u", "v"])
    return _resolve_in_task(small).unionByName(_resolve_by_stars(large, bounded))


def _resolve_in_task(edges: DataFrame) -> DataFrame:
    def join(table: pa.Table, starts: np.ndarray):
        u, v = table.column("u").to_numpy(), table.column("v").to_numpy()
        case = table.column("case_id")
        for start, end in zip(starts, np.append(starts[1:], table.num_rows)):
            nodes, at = np.unique(np.concatenate([u[start:end], v[start:end]]), return_inverse=True)
            parent = join_pairs(len(nodes), at[: end - start], at[end - start :])
            name = pa.array([case[int(start)].as_py()] * len(nodes), case.type)
            yield pa.RecordBatch.from_arrays([name, pa.array(nodes), pa.array(nodes[parent])], names=["case_id", "label", "root"])

    kind = edges.schema["case_id"].dataType.simpleString()
    return map_sorted_groups(edges, ["case_id"], [], f"case_id {kind}, label bigint, root bigint", join)


def _resolve_by_stars(edges: DataFrame, bounded: bool = False) -> DataFrame:
    """Large-star links each larger neighbour to the lowest one around a node,
    small-star the lower neighbours; both only join and group. A node with very
    many neighbours contributes a minimum, never a list; where ``bounded`` says that
    all have few, one shuffle brings a node's neighbours together. Converged when a
    round leaves the edge set unchanged.
    """
    def with_lowest(rows: DataFrame) -> DataFrame:
        """The lowest neighbour of ``u`` as ``m``."""
        if bounded:
            return rows.withColumn("m", F.min("v").over(W.partitionBy("case_id", "u")))
        return attach(rows, rows.groupBy("case_id", "u").agg(F.min("v").alias("m")), ["case_id", "u"], ["v"])

    current = cut_lineage(edges)
    before = None
    while True:
        digest = F.sum(F.xxhash64("case_id", "u", "v").cast("decimal(38,0)"))
        summary = tuple(current.agg(F.count("*"), digest).first())
        if before == summary:
            return current.select("case_id", F.col("u").alias("label"), F.col("v").alias("root"))
        before = summary
        # large-star: around every node, link larger neighbours to the lowest of node and neighbours
        both = current.select("case_id", "u", "v").unionByName(current.select("case_id", F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_lowest(both).where("v > u").select("case_id", F.col("v").alias("u"), F.least("m", "u").alias("v"))
        # small-star: link the lower neighbours and the node itself to the lowest
        pairs = F.explode(F.array(*[F.struct(F.col(c).alias("u"), F.col("m").alias("v")) for c in ("u", "v")])).alias("p")
        small = with_lowest(large if bounded else large.distinct()).select("case_id", pairs).select("case_id", "p.u", "p.v").where("u <> v").distinct()
        current = cut_lineage(small)


def connected_components(mask: DataFrame, ny: int, nz: int, block: int = DEFAULT_BLOCK, local_edges: int = LOCAL_EDGES, carry: Sequence[str] = ()) -> DataFrame:
    """``(case_id, x, y, z, label)`` with the lowest raster index as label, and the columns of ``mask`` named in ``carry``."""
    labelled = cut_lineage(label_within_blocks(mask, ny, nz, block, carry))
    edges = _face_edges(labelled, ny, nz, block)
    roots = resolve_graph(edges, local_edges)
    if roots is None:
        return labelled
    # a label has the voxels of one cube at most, and there are nearly as many labels as voxels
    merged = labelled.join(roots.hint("merge"), ["case_id", "label"], "left")
    return merged.select(*VOXEL, *carry, F.coalesce("root", "label").alias("label"))


def component_sizes(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("case_id", "label").agg(F.count("*").alias("size"))


def component_stats(labelled: DataFrame, cases: DataFrame) -> DataFrame:
    """Count, largest component in voxels, mm3 and percent of the mask.

    ``cases`` carries ``voxel_mm3`` and keeps cases with an empty mask (zeros).
    """
    per_case = component_sizes(labelled).groupBy("case_id").agg(
        F.count("*").alias("n_components"), F.max("size").alias("largest_voxels"), F.sum("size").alias("_all")
    )
    joined = cases.select("case_id", "voxel_mm3").join(per_case, "case_id", "left").fillna(0, ["n_components", "largest_voxels", "_all"])
    return joined.select(
        "case_id",
        "n_components",
        "largest_voxels",
        (F.col("largest_voxels") * F.col("voxel_mm3")).alias("largest_mm3"),
        F.when(F.col("_all") > 0, F.col("largest_voxels") * 100.0 / F.col("_all")).otherwise(F.lit(0.0)).alias("largest_pct"),
    )


def fp_components(labelled_pred: DataFrame, gt: DataFrame) -> DataFrame:
    """Predicted components without any truth voxel, per case that has a prediction."""
    hits = labelled_pred.join(gt.select(*VOXEL).withColumn("_hit", F.lit(1)), VOXEL, "left")
    per_component = hits.groupBy("case_id", "label").agg(F.max(F.coalesce("_hit", F.lit(0))).alias("hit"))
    return per_component.groupBy("case_id").agg(F.sum((F.col("hit") == 0).cast("int")).alias("fp_components"))


def component_fate(labelled: DataFrame, min_fraction: float = 0.10, min_voxels: int = 0) -> DataFrame:
    """``(case_id, label, size, keep)``: keep by size relative to the case's largest.

    The largest component (lowest label on ties) always stays; with both limits
    off everything does.
    """
    return fate_of_sizes(component_sizes(labelled), min_fraction, min_voxels)


def fate_of_sizes(sizes: DataFrame, min_fraction: float = 0.10, min_voxels: int = 0) -> DataFrame:
    """The same from one row ``case_id, label, size`` per component; further columns stay."""
    if min_fraction <= 0 and min_voxels <= 0:
        return sizes.withColumn("keep", F.lit(True))
    top = sizes.groupBy("case_id").agg(
        F.max("size").alias("_max"), F.max_by("label", F.struct(F.col("size"), -F.col("label"))).alias("_first")
    )
    cutoff = F.greatest(F.lit(float(min_voxels)), F.lit(float(min_fraction)) * F.col("_max"))
    # every case has its top; a left join never broadcasts the components, whose stored files tell little about their rows
    return attach(sizes.where("case_id is not null"), top, ["case_id"], ["label"], "left").select(
        *sizes.columns, ((F.col("size") >= cutoff) | (F.col("label") == F.col("_first"))).alias("keep")
    )


def filter_components(labelled: DataFrame, min_fraction: float = 0.10, min_voxels: int = 0,
                      fate: DataFrame | None = None) -> DataFrame:
    """Voxels of the components that stay."""
    fate = cut_lineage(component_fate(labelled, min_fraction, min_voxels)) if fate is None else fate
    return attach(labelled, fate.where("keep").select("case_id", "label", "size"), ["case_id", "label"], ["x", "y", "z"], heavy="size")


def removed_components(fate: DataFrame) -> DataFrame:
    return fate.groupBy("case_id").agg(F.sum((~F.col("keep")).cast("int")).alias("components_removed"))
