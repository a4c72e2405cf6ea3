"""Axis orientation as array columns.

An orientation is ``ARRAY<ARRAY<INT>>`` with one ``[out_axis, flip]`` pair per
input axis, and an affine is ``ARRAY<ARRAY<DOUBLE>>`` (4x4).
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

AXES = (0, 1, 2)


def _cell(matrix: Column, row: int, col: int) -> Column:
    return F.element_at(F.element_at(matrix, row + 1), col + 1)


def _let(value: Column, body) -> Column:
    """Bind an expression once, so that it is not repeated where it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def orientation(affine: Column) -> Column:
    """Each input axis goes to the world axis its column points along most.

    Defined for axis-aligned affines; two columns that pick the same world axis
    raise an error.
    """

    def axis(column: Column) -> Column:
        size = F.transform(column, lambda v: F.abs(v))
        out = (F.array_position(size, F.array_max(size)) - 1).cast("int")
        return _let(out, lambda o: F.array(o, F.when(F.element_at(column, o + 1) < 0, -1).otherwise(1)))

    def pairs(m: Column) -> Column:
        columns = F.array(*[F.array(*[_cell(m, r, c) for r in AXES]) for c in AXES])
        return F.transform(columns, axis)

    def checked(found: Column) -> Column:
        targets = F.array_distinct(F.transform(found, lambda p: F.element_at(p, 1)))
        oblique = F.raise_error(F.lit("oblique affine: two axes map to the same world axis")).cast("array<array<int>>")
        return F.when(F.size(targets) == 3, found).otherwise(oblique)

    return _let(_let(affine, pairs), checked)


def axis_codes(affine: Column) -> Column:
    """Letters of the positive direction of each input axis, e.g. ``LAS``."""
    letters = F.array(*map(F.lit, "RASLPI"))
    code = lambda p: F.element_at(letters, F.element_at(p, 1) + F.when(F.element_at(p, 2) == 1, 1).otherwise(4))
    return F.array_join(F.transform(orientation(affine), code), "")


def invert_orientation(ornt: Column) -> Column:
    """``inverse[out] = [in, flip]``."""
    def entry(out):
        position = F.array_position(F.transform(ornt, lambda p: F.element_at(p, 1)), out).cast("int")
        return F.array((position - 1).cast("int"), F.element_at(F.element_at(ornt, position), 2))

    return F.transform(F.sequence(F.lit(0), F.lit(2)), entry)


def permute_axes(values: Column, ornt: Column) -> Column:
    """``out[ornt[i].axis] = values[i]``; used for spacings and shapes."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(2)),
        lambda out: F.element_at(
            values, F.array_position(F.transform(ornt, lambda p: F.element_at(p, 1)), out).cast("int")
        ),
    )


def inverse_orientation_affine(ornt: Column, shape: Column) -> Column:
    """Affine that takes reoriented voxel indices back to the original ones."""

    def row(pair: Column, size: Column) -> Column:
        flip = F.element_at(pair, 2).cast("double")
        cells = [F.when(F.element_at(pair, 1) == c, flip).otherwise(F.lit(0.0)) for c in AXES]
        return F.array(*cells, F.when(flip < 0, size.cast("double") - 1.0).otherwise(F.lit(0.0)))

    return F.concat(F.zip_with(ornt, shape, row), F.array(F.array(*map(F.lit, (0.0, 0.0, 0.0, 1.0)))))


def matmul4(left: Column, right: Column) -> Column:
    """Product of two 4x4 matrices."""
    columns = lambda m: F.transform(F.sequence(F.lit(1), F.lit(4)), lambda c: F.transform(m, lambda r: F.element_at(r, c)))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)
    return _let(_let(right, columns), lambda cols: F.transform(left, lambda r: F.transform(cols, lambda c: dot(r, c))))


def canonical_affine(affine: Column, shape: Column, ornt: Column) -> Column:
    return matmul4(affine, inverse_orientation_affine(ornt, shape))
