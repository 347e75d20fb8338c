"""Grey pictures of images: montages, BMP and TIFF files, for viewers and debugging."""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.sources.stacks import opened


def grey(image: np.ndarray) -> np.ndarray:
    """Values from 0 (the least) to 255 (the largest), halves rounded up; an even image is black."""
    low, high = float(image.min()), float(image.max())
    if high <= low:
        return np.zeros(image.shape, np.uint8)
    return np.floor((image - low) / (high - low) * 255 + 0.5).astype(np.uint8)


def montage(images: np.ndarray, columns: int) -> np.ndarray:
    """(count, n, n) images side by side in rows of `columns`, each in its own range of grey; free places are black."""
    count, n = images.shape[:2]
    rows = -(-count // columns)
    out = np.zeros((rows * n, columns * n), np.uint8)
    for k, image in enumerate(images):
        y, x = divmod(k, columns)
        out[y * n : (y + 1) * n, x * n : (x + 1) * n] = grey(image)
    return out


def write_bmp(path: str, picture: np.ndarray) -> None:
    """An 8-bit picture with a grey palette, rows from the bottom up, each filled to four bytes."""
    h, w = picture.shape
    wide = -(-w // 4) * 4
    palette = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 4, 1)
    palette[:, 3] = 0
    at = 54 + palette.size
    rows = np.zeros((h, wide), np.uint8)
    rows[:, :w] = picture[::-1]
    with opened(path, write=True) as f:
        f.write(b"BM" + struct.pack("<IHHI", at + rows.size, 0, 0, at) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 8, 0, rows.size, 2835, 2835, 256, 0))
        f.write(palette.tobytes() + rows.tobytes())


def read_bmp(path: str) -> np.ndarray:
    """The picture of a file that write_bmp() wrote."""
    with opened(path) as f:
        raw = f.read()
    at, w, h = struct.unpack("<I", raw[10:14])[0], *struct.unpack("<ii", raw[18:26])
    wide = -(-w // 4) * 4
    return np.frombuffer(raw, np.uint8, h * wide, at).reshape(h, wide)[::-1, :w]


def write_tiff(path: str, pictures: list[np.ndarray]) -> None:
    """One page a picture: 8-bit grey, uncompressed, a single strip."""
    out = bytearray(struct.pack("<2sHI", b"II", 42, 8))
    for k, picture in enumerate(pictures):
        h, w = picture.shape
        tags = [(256, 4, 1, w), (257, 4, 1, h), (258, 3, 1, 8), (259, 3, 1, 1), (262, 3, 1, 1), (273, 4, 1, 0), (277, 3, 1, 1), (278, 4, 1, h), (279, 4, 1, w * h)]
        data = len(out) + 2 + 12 * len(tags) + 4
        following = data + w * h + (w * h) % 2 if k + 1 < len(pictures) else 0
        entries = b"".join(struct.pack("<HHII", t, kind, n, data if t == 273 else v) for t, kind, n, v in tags)
        out += struct.pack("<H", len(tags)) + entries + struct.pack("<I", following) + picture.astype(np.uint8).tobytes() + b"\0" * ((w * h) % 2)
    with opened(path, write=True) as f:
        f.write(bytes(out))


def read_tiff(path: str) -> list[np.ndarray]:
    """The pages of a file that write_tiff() wrote."""
    with opened(path) as f:
        raw = f.read()
    pages, at = [], struct.unpack("<I", raw[4:8])[0]
    while at:
        n = struct.unpack("<H", raw[at : at + 2])[0]
        tags = {t: v for t, _, _, v in (struct.unpack("<HHII", raw[at + 2 + 12 * i : at + 14 + 12 * i]) for i in range(n))}
        pages.append(np.frombuffer(raw, np.uint8, tags[256] * tags[257], tags[273]).reshape(tags[257], tags[256]))
        at = struct.unpack("<I", raw[at + 2 + 12 * n : at + 6 + 12 * n])[0]
    return pages


def page_of_images(images: DataFrame, order: str, page: int, size: int, pixels: str = "pixels") -> np.ndarray:
    """The images of one page (from 0) in the given order, as an array: what a viewer shows at once."""
    from lumenfold.operators.particles import top_pages

    rows = top_pages(images, [F.col(order)], page, size).orderBy(order).select(pixels).collect()
    side = int(round(len(rows[0][0]) ** 0.5)) if rows else 1
    return np.array([r[0] for r in rows], float).reshape(len(rows), side, side)
