"""Image stacks and volumes in the MRC and SPIDER formats.

Stacks are split by byte range: one small row a slice of images is planned on the driver, and tasks read their
own slices, so a stack of any size is spread over the cluster. Paths must be visible to all executors.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.session import ship_package

HEADER = 1024
MODE_FLOAT = 2


def opened(path: str, write: bool = False):
    """A file of any store that the path's scheme names: local without one, or file, hdfs, s3, gs and so on."""
    from pyarrow import fs

    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path[5:]
    if "://" in path:
        where, at = fs.FileSystem.from_uri(path)
    else:
        where, at = fs.LocalFileSystem(), os.path.abspath(path)
    if write:
        where.create_dir(at.rsplit("/", 1)[0], recursive=True)
        return where.open_output_stream(at)
    return where.open_input_file(at)


def mrc_header(raw: bytes) -> dict[str, object]:
    """Columns, rows, sections, mode, bytes of the extended header and byte order."""
    for order in "<>":
        nx, ny, nz, mode = struct.unpack(f"{order}4i", raw[:16])
        if 0 <= mode < 16 and 0 < nx < 1 << 20 and 0 < ny < 1 << 20 and 0 < nz < 1 << 28:
            return {"nx": nx, "ny": ny, "nz": nz, "mode": mode, "extended": struct.unpack(f"{order}i", raw[92:96])[0], "order": order}
    raise ValueError("not an MRC header")


def pack_header(nx: int, ny: int, nz: int, pixel: float = 1.0) -> bytes:
    """A header of 256 numbers for 32-bit floats."""
    head = bytearray(HEADER)
    struct.pack_into("<4i", head, 0, nx, ny, nz, MODE_FLOAT)
    struct.pack_into("<3i", head, 28, nx, ny, nz)
    struct.pack_into("<6f", head, 40, nx * pixel, ny * pixel, nz * pixel, 90.0, 90.0, 90.0)
    struct.pack_into("<3i", head, 64, 1, 2, 3)
    head[208:212] = b"MAP "
    head[212:216] = b"\x44\x44\x00\x00"
    return bytes(head)


def read_mrc(path: str) -> np.ndarray:
    """The float volume (z, y, x) of a file in either byte order; NaNs stay."""
    with opened(path) as f:
        raw = f.read()
    h = mrc_header(raw)
    if h["mode"] != MODE_FLOAT:
        raise ValueError("only 32-bit float files are supported")
    at = HEADER + int(h["extended"])
    return np.frombuffer(raw, f"{h['order']}f4", h["nx"] * h["ny"] * h["nz"], at).reshape(h["nz"], h["ny"], h["nx"]).astype(np.float32)


def write_mrc(path: str, volume: np.ndarray, pixel: float = 1.0) -> None:
    z, y, x = volume.shape
    with opened(path, write=True) as f:
        f.write(pack_header(x, y, z, pixel))
        f.write(np.ascontiguousarray(volume, "<f4").tobytes())


def spider_header(nx: int, ny: int, n: int = 0) -> np.ndarray:
    """256 or more big-endian floats; n > 0: that of a stack of n images."""
    records = -(-1024 // (4 * nx))
    head = np.zeros(records * nx, ">f4")
    head[0], head[1], head[4], head[11], head[12] = 1, ny, 1, nx, records
    head[21], head[22] = records * nx * 4, nx * 4
    if n:
        head[23], head[25], head[26] = 2, n, n
    return head


def write_spider(path: str, images: np.ndarray) -> None:
    """A stack of (count, ny, nx) images, each with its own header."""
    n, ny, nx = images.shape
    with opened(path, write=True) as f:
        f.write(spider_header(nx, ny, n).tobytes())
        for image in images:
            f.write(spider_header(nx, ny).tobytes())
            f.write(np.ascontiguousarray(image, ">f4").tobytes())


def read_spider(path: str) -> np.ndarray:
    """The images (count, ny, nx) of a file or stack in either byte order."""
    with opened(path) as f:
        raw = f.read()
    order = next(o for o in "><" if np.frombuffer(raw, f"{o}f4", 5)[4] in (1, 3, -11, -12))
    head = np.frombuffer(raw, f"{order}f4", 256)
    ny, nx, size = int(head[1]), int(head[11]), int(head[21])
    if head[23] > 0:
        n, each = int(head[25]), size + 4 * nx * ny
        return np.stack([np.frombuffer(raw, f"{order}f4", nx * ny, size + i * each + size).reshape(ny, nx) for i in range(n)]).astype(np.float32)
    return np.frombuffer(raw, f"{order}f4", nx * ny, size).reshape(1, ny, nx).astype(np.float32)


def read_stacks(spark: SparkSession, paths: list[str], slice_images: int = 256) -> DataFrame:
    """(name, index, n, pixels) of all images of MRC stacks; index counts from 1."""
    ship_package(spark)
    slices = []
    for path in paths:
        with opened(path) as f:
            h = mrc_header(f.read(HEADER))
        slices += [(path, k, min(slice_images, h["nz"] - k)) for k in range(0, h["nz"], slice_images)]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first, n in zip(*(c.to_pylist() for c in batch.columns)):
                with opened(path) as f:
                    h = mrc_header(f.read(HEADER))
                    size = h["nx"] * h["ny"]
                    f.seek(HEADER + h["extended"] + 4 * first * size)
                    data = np.frombuffer(f.read(4 * n * size), f"{h['order']}f4").astype(np.float32)
                offsets = pa.array(np.arange(n + 1, dtype=np.int32) * size)
                yield pa.record_batch(
                    [pa.array([path] * n), pa.array(np.arange(first + 1, first + n + 1)), pa.array([h["nx"]] * n, pa.int32()), pa.ListArray.from_arrays(offsets, pa.array(data))],
                    ["name", "index", "n", "pixels"],
                )

    plan = spark.createDataFrame(slices, "path string, first long, n long").repartition(max(1, len(slices)))
    return plan.mapInArrow(read, "name string, index long, n int, pixels array<float>")


def write_stack(images: DataFrame, path: str, order: str, pixels: str = "pixels", pixel: float = 1.0) -> int:
    """Write square images as an MRC stack in the given order, and tell how many: tasks pack them, the driver streams their bytes."""
    ship_package(images.sparkSession)

    @F.arrow_udf("binary")
    def packed(batch: pa.Array) -> pa.Array:
        return pa.array([np.asarray(x, "<f4").tobytes() for x in batch.to_pylist()], pa.binary())

    first = images.select(F.size(pixels)).first()
    side = int(round(first[0] ** 0.5)) if first else 1
    total = images.count()
    ordered = images.repartitionByRange(order).sortWithinPartitions(order).select(packed(pixels).alias("b"))
    with opened(path, write=True) as f:
        f.write(pack_header(side, side, total, pixel))
        for row in ordered.toLocalIterator():
            f.write(bytes(row["b"]))
    return total


def join_images(particles: DataFrame, stack: DataFrame, image_name: str = "ImageName") -> DataFrame:
    """particles with the pixels that their index@stack names."""
    from lumenfold.functions.strings import name_index, name_stack

    keyed = particles.withColumns({"__i": name_index(F.col(image_name)), "__s": name_stack(F.col(image_name))})
    met = keyed.join(stack, (keyed["__i"] == stack["index"]) & (keyed["__s"] == stack["name"]))
    return met.drop("__i", "__s", "index", "name")


def convert(source: str, target: str) -> None:
    """.mrcs to .dat or back; other pairs are an error."""
    ends = (source.rsplit(".", 1)[-1], target.rsplit(".", 1)[-1])
    if ends == ("mrcs", "dat"):
        write_spider(target, read_mrc(source))
    elif ends == ("dat", "mrcs"):
        write_mrc(target, read_spider(source))
    else:
        raise ValueError(f"no conversion from {ends[0]} to {ends[1]}")
