"""NIfTI-1 volumes as header rows and slice rows.

One file is one row of Spark's binary source; decoding is a small helper inside
the task. A file that cannot be decoded yields a row with ``error`` set and the
job goes on.
"""

from __future__ import annotations

import struct
import zlib
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from .manifest import case_name

# NIfTI-1 data type codes.
DTYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4"}
HEADER_BYTES = 348
HEADER_BLOCK = 4096

HEADER = "case_id string, path string, shape array<int>, spacing array<double>, affine array<array<double>>, error string"
SLICE = "case_id string, slice_idx int, height int, width int, n_slices int, sx double, sy double, sz double, pixels array<float>, error string"


def _unpacked(content: bytes, limit: int | None = None) -> bytes:
    if content[:2] != b"\x1f\x8b":
        return content[:limit]
    parts, size = [], 0
    while content and (limit is None or size < limit):  # one round per gzip member
        stream = zlib.decompressobj(wbits=31)
        part = stream.decompress(content, limit - size) if limit else stream.decompress(content)
        if not stream.eof and not limit:
            raise ValueError("compressed file is cut short")
        parts.append(part)
        size += len(part)
        content = stream.unused_data
        if not stream.eof:
            break
    return b"".join(parts)


def parse_header(raw: bytes) -> dict:
    """Shape, spacing, affine and layout from the fixed 348-byte header."""
    if len(raw) < HEADER_BYTES:
        raise ValueError("file is shorter than a header")
    order = "<" if struct.unpack_from("<i", raw)[0] == HEADER_BYTES else ">"
    if struct.unpack_from(order + "i", raw)[0] != HEADER_BYTES:
        raise ValueError("not a NIfTI-1 header")
    dim = struct.unpack_from(order + "8h", raw, 40)
    if any(size > 1 for size in dim[4 : dim[0] + 1]):
        raise ValueError(f"volume has more than three dimensions: {list(dim[1:dim[0] + 1])}")
    pixdim = struct.unpack_from(order + "8f", raw, 76)
    offset, slope, inter = struct.unpack_from(order + "3f", raw, 108)
    code = struct.unpack_from(order + "h", raw, 70)[0]
    if code not in DTYPES:
        raise ValueError(f"unsupported data type code {code}")
    qform, sform = struct.unpack_from(order + "2h", raw, 252)
    affine = np.eye(4)
    if sform > 0:
        affine[:3] = np.array(struct.unpack_from(order + "12f", raw, 280)).reshape(3, 4)
    elif qform > 0:
        b, c, d, *shift = struct.unpack_from(order + "6f", raw, 256)
        a = np.sqrt(max(0.0, 1.0 - b * b - c * c - d * d))
        rotation = np.array([
            [a * a + b * b - c * c - d * d, 2 * (b * c - a * d), 2 * (b * d + a * c)],
            [2 * (b * c + a * d), a * a + c * c - b * b - d * d, 2 * (c * d - a * b)],
            [2 * (b * d - a * c), 2 * (c * d + a * b), a * a + d * d - b * b - c * c],
        ])
        affine[:3, :3] = rotation * np.array([pixdim[1], pixdim[2], pixdim[3] * (-1.0 if pixdim[0] < 0 else 1.0)])
        affine[:3, 3] = shift
    else:
        affine[:3, :3] = np.diag(pixdim[1:4])
    return {"shape": list(dim[1:4]), "spacing": [float(p) for p in pixdim[1:4]], "affine": affine.tolist(),
            "dtype": order + DTYPES[code], "offset": int(offset), "slope": slope, "inter": inter}


def list_volumes(spark: SparkSession, pattern: str) -> DataFrame:
    """Paths and sizes only; no content is read."""
    files = spark.read.format("binaryFile").load(pattern)
    return files.select(case_name(F.col("path")).alias("case_id"), "path", "length")


def _files(spark: SparkSession, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").load(pattern).select(case_name(F.col("path")).alias("case_id"), "path", "content")


def _header_bytes(path: str) -> bytes:
    """The first bytes of a volume: reads a block, more only if that does not unpack to a header."""
    files, name = fs.FileSystem.from_uri(path if path.startswith("/") else quote(path, safe=":/@"))
    content, raw = b"", b""
    with files.open_input_stream(name, compression=None, buffer_size=0) as stream:
        while len(raw) < HEADER_BYTES and (block := stream.read(HEADER_BLOCK)):
            content += block
            raw = _unpacked(content, HEADER_BYTES)
    return raw


def read_headers(spark: SparkSession, pattern: str) -> DataFrame:
    """Header columns per file, from a block of each; contents are neither loaded nor shipped.

    Tasks open the files through ``pyarrow.fs``, which must know their scheme;
    a file that it cannot open gives an error row.
    """

    def decode(batches):
        for pdf in batches:
            rows = []
            for case, path in zip(pdf["case_id"], pdf["path"]):
                try:
                    h = parse_header(_header_bytes(path))
                    rows.append((case, path, h["shape"], h["spacing"], h["affine"], None))
                except Exception as error:
                    rows.append((case, path, None, None, None, str(error)))
            yield pd.DataFrame(rows, columns=["case_id", "path", "shape", "spacing", "affine", "error"])

    return list_volumes(spark, pattern).select("case_id", "path").mapInPandas(decode, HEADER)


LAYOUT = "case_id string, path string, packed boolean, shape array<int>, spacing array<double>, dtype string, offset bigint, slope double, inter double, error string"


def _layouts(spark: SparkSession, pattern: str) -> DataFrame:
    """Where the values of each file lie, from a block of it."""

    def decode(batches):
        for pdf in batches:
            rows = []
            for case, path in zip(pdf["case_id"], pdf["path"]):
                try:
                    with _open(path) as file:
                        packed = file.read_at(2, 0) == b"\x1f\x8b"
                    h = parse_header(_header_bytes(path))
                    rows.append((case, path, packed, h["shape"], h["spacing"], h["dtype"], h["offset"], h["slope"], h["inter"], None))
                except Exception as error:
                    rows.append((case, path, None, None, None, None, None, None, None, str(error)))
            yield pd.DataFrame(rows, columns=["case_id", "path", "packed", "shape", "spacing", "dtype", "offset", "slope", "inter", "error"])

    return list_volumes(spark, pattern).select("case_id", "path").mapInPandas(decode, LAYOUT)


def _open(path: str):
    files, name = fs.FileSystem.from_uri(path if path.startswith("/") else quote(path, safe=":/@"))
    return files.open_input_file(name)


def _skip_to(file, start: int, size: int) -> bytes:
    """``size`` unpacked bytes from ``start`` on of a compressed file; what lies before is unpacked and let go."""
    stream, at, out = zlib.decompressobj(wbits=31), 0, b""
    while len(out) < size and (block := file.read(1 << 20)):
        while block and len(out) < size:
            part = stream.decompress(block)
            low = max(0, start - at)
            out += part[low:]
            at += len(part)
            block = stream.unused_data
            if stream.eof:
                stream = zlib.decompressobj(wbits=31)
    return out[:size]


def read_slice_range(spark: SparkSession, pattern: str, first: int | None = None, last: int | None = None, block: int = 16) -> DataFrame:
    """Slice rows ``first`` to ``last`` of every volume, in file orientation, from the bytes of these slices only.

    The headers decide what there is to read; each block of ``block`` slices of a plain file is one piece of work
    and one ranged read. A compressed file is one piece, unpacked up to its last wanted slice. A file that cannot be
    read gives an error row, one that has no slice in the range none.
    """
    low = F.lit(max(0, first or 0))
    top = F.element_at("shape", 3) - 1
    high = top if last is None else F.least(top, F.lit(last))
    step = F.when(F.col("packed"), F.greatest(high - low + 1, F.lit(1))).otherwise(F.lit(block))
    known = _layouts(spark, pattern)
    good = known.where("error is null").withColumns({"low": low.cast("int"), "high": high.cast("int"), "step": step.cast("int")}).where("low <= high")
    work = good.select("*", F.explode(F.sequence(F.col("low"), F.col("high"), F.col("step"))).alias("start")).withColumn("end", F.least(F.col("start") + F.col("step") - 1, F.col("high")))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def read(batches):
        for pdf in batches:
            for w in pdf.to_dict("records"):
                height, width, depth = (int(n) for n in w["shape"])
                kind = np.dtype(w["dtype"])
                plane = height * width * kind.itemsize
                try:
                    size, at = plane * (w["end"] - w["start"] + 1), w["offset"] + plane * w["start"]
                    with _open(w["path"]) as file:
                        raw = _skip_to(file, at, size) if w["packed"] else file.read_at(size, at)
                    values = np.frombuffer(raw, kind, size // kind.itemsize).reshape(-1, width, height)
                    if w["slope"] not in (0.0, 1.0) or w["inter"]:
                        values = values * np.float32(w["slope"] or 1.0) + np.float32(w["inter"])
                    pixels = [np.ascontiguousarray(v.T, dtype=np.float32).ravel() for v in values]
                    index, error = list(range(w["start"], w["end"] + 1)), [None] * len(pixels)
                except Exception as problem:
                    pixels, index, error = [[]], [w["start"]], [str(problem)]
                n = len(index)
                yield pd.DataFrame({"case_id": [w["case_id"]] * n, "slice_idx": index, "height": [height] * n, "width": [width] * n, "n_slices": [depth] * n,
                                    "sx": [w["spacing"][0]] * n, "sy": [w["spacing"][1]] * n, "sz": [w["spacing"][2]] * n, "pixels": pixels, "error": error})

    rows = work.repartition(parts, "path", "start").mapInPandas(read, SLICE)
    zero, none = F.lit(0), F.lit(0.0)
    failed = known.where("error is not null").select(
        "case_id", zero.alias("slice_idx"), zero.alias("height"), zero.alias("width"), zero.alias("n_slices"), none.alias("sx"), none.alias("sy"), none.alias("sz"), F.array().cast("array<float>").alias("pixels"), "error")
    return rows.unionByName(failed)


def write_volumes(slices: DataFrame, path: str) -> None:
    """One plain NIfTI-1 file of 32-bit floats per case, written by tasks, with the spacings on the diagonal of its affine.

    ``slices``: ``case_id, slice_idx, height, width, sx, sy, sz, pixels``, whole volumes. A volume is put together in
    one task; its size is that of one file.
    """
    def write(table: pa.Table) -> pa.Table:
        rows = table.sort_by("slice_idx")
        height, width, depth = rows["height"][0].as_py(), rows["width"][0].as_py(), rows.num_rows
        spacing = [rows[c][0].as_py() for c in ("sx", "sy", "sz")]
        volume = np.stack([np.asarray(p.values, np.float32).reshape(height, width) for p in rows["pixels"]], axis=2)
        head = bytearray(352)
        struct.pack_into("<i", head, 0, HEADER_BYTES)
        struct.pack_into("<8h", head, 40, 3, height, width, depth, 1, 1, 1, 1)
        struct.pack_into("<2h", head, 70, 16, 32)
        struct.pack_into("<8f", head, 76, 1.0, *spacing, 0.0, 0.0, 0.0, 0.0)
        struct.pack_into("<3f", head, 108, 352.0, 1.0, 0.0)
        struct.pack_into("<2h", head, 252, 0, 1)
        struct.pack_into("<12f", head, 280, spacing[0], 0, 0, 0, 0, spacing[1], 0, 0, 0, 0, spacing[2], 0)
        head[344:348] = b"n+1\0"
        case = str(rows["case_id"][0].as_py())
        files, folder = fs.FileSystem.from_uri(path if path.startswith("/") else quote(path, safe=":/@"))
        files.create_dir(folder, recursive=True)
        with files.open_output_stream(f"{folder}/{case}.nii") as out:
            out.write(bytes(head) + volume.tobytes(order="F"))
        return pa.table({"case_id": [case]})

    written = slices.select("case_id", "slice_idx", "height", "width", "sx", "sy", "sz", F.col("pixels").cast("array<float>")).groupBy("case_id").applyInArrow(write, "case_id string")
    written.write.format("noop").mode("overwrite").save()


def _canonical(volume: np.ndarray, spacing: list, affine: list) -> tuple[np.ndarray, list]:
    turn = np.asarray(affine)[:3, :3]
    target = np.abs(turn).argmax(axis=0)
    flipped = volume[tuple(slice(None, None, -1 if turn[target[i], i] < 0 else 1) for i in range(3))]
    order = [int(np.flatnonzero(target == o)[0]) for o in range(3)]
    return np.transpose(flipped, order), [spacing[i] for i in order]


def read_volumes(spark: SparkSession, pattern: str, canonical: bool = False) -> DataFrame:
    """Slice rows with row-major ``float`` pixels; one file per task batch.

    ``canonical`` reorients while decoding, when the whole volume is at hand
    anyway, so that no later step has to turn slices.
    """

    def decode(batches):
        for pdf in batches:
            for case, content in zip(pdf["case_id"], pdf["content"]):
                try:
                    raw = _unpacked(content)
                    h = parse_header(raw)
                    volume = np.frombuffer(raw, h["dtype"], int(np.prod(h["shape"])), h["offset"]).reshape(h["shape"], order="F")
                    if h["slope"] not in (0.0, 1.0) or h["inter"]:
                        volume = volume * np.float32(h["slope"] or 1.0) + np.float32(h["inter"])
                    spacing = h["spacing"]
                    if canonical:
                        volume, spacing = _canonical(volume, spacing, h["affine"])
                    height, width, depth = volume.shape
                    for z in range(depth):
                        pixels = np.ascontiguousarray(volume[:, :, z], dtype=np.float32).ravel()
                        yield pd.DataFrame({"case_id": [case], "slice_idx": [z], "height": [height], "width": [width], "n_slices": [depth],
                                            "sx": [spacing[0]], "sy": [spacing[1]], "sz": [spacing[2]], "pixels": [pixels], "error": [None]})
                except Exception as error:
                    yield pd.DataFrame({"case_id": [case], "slice_idx": [0], "height": [0], "width": [0], "n_slices": [0],
                                        "sx": [0.0], "sy": [0.0], "sz": [0.0], "pixels": [[]], "error": [str(error)]})

    return _files(spark, pattern).mapInPandas(decode, SLICE)


def mask_voxels(slices: DataFrame, above: float = 0.5) -> DataFrame:
    """Sparse voxels of label slices."""
    cells = slices.select("case_id", "slice_idx", "width", F.posexplode("pixels").alias("p", "v")).where(F.col("v") > above)
    return cells.select("case_id", F.floor(F.col("p") / F.col("width")).cast("int").alias("x"), (F.col("p") % F.col("width")).cast("int").alias("y"), F.col("slice_idx").alias("z"))
