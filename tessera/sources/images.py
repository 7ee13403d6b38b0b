"""Picture files as rows: PNG decoding and frame measures in Arrow batches."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.kernels import frame_qc, perceptual_hash

# Fixed values of the format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


class PictureError(ValueError):
    pass


def chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    if not data.startswith(SIGNATURE):
        raise PictureError("not a PNG file")
    at = len(SIGNATURE)
    while at + 12 <= len(data):
        size = int.from_bytes(data[at : at + 4])
        body = data[at + 8 : at + 8 + size]
        if len(body) < size or zlib.crc32(data[at + 4 : at + 8 + size]) != int.from_bytes(data[at + 8 + size : at + 12 + size]):
            raise PictureError("broken chunk")
        yield data[at + 4 : at + 8], body
        at += 12 + size


def unfilter(raw: np.ndarray, step: int) -> np.ndarray:
    """Rows of (filter, bytes) as plain bytes; ``step``: bytes a pixel."""
    kinds, rows = raw[:, 0], raw[:, 1:].copy()
    wide = rows.shape[1]
    above = np.zeros(wide, np.uint8)
    for kind, row in zip(kinds, rows, strict=True):
        if kind == 1:  # sums along each channel wrap like bytes
            for c in range(step):
                row[c::step] = np.cumsum(row[c::step], dtype=np.uint8)
        elif kind == 2:
            row += above
        elif kind in (3, 4):
            left = [0] * step
            corner = [0] * step
            out, up = row.tolist(), above.tolist()
            for k in range(wide):
                c = k % step
                a, b = left[c], up[k]
                if kind == 3:
                    guess = (a + b) >> 1
                else:
                    p = a + b - corner[c]
                    guess = min((a, b, corner[c]), key=lambda q, p=p: abs(p - q))
                left[c] = out[k] = (out[k] + guess) & 255
                corner[c] = b
            row[:] = out
        elif kind:
            raise PictureError(f"unknown filter {kind}")
        above = row
    return rows


def read_png(data: bytes) -> np.ndarray:
    """Height by width (by channels) samples, 8 or 16 bits; palettes become colours.
    Interlaced files aren't read."""
    head, packed, palette = None, [], None
    for kind, body in chunks(data):
        if kind == b"IHDR":
            head = body
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body)
    if head is None:
        raise PictureError("no header")
    width, height = int.from_bytes(head[:4]), int.from_bytes(head[4:8])
    depth, colour, interlaced = head[8], head[9], head[12]
    if interlaced or colour not in CHANNELS:
        raise PictureError("interlaced" if interlaced else "unknown colour type")
    n = CHANNELS[colour]
    line = (width * n * depth + 7) // 8
    try:
        raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    except zlib.error as error:
        raise PictureError(str(error)) from error
    if len(raw) < height * (line + 1):
        raise PictureError("too short")
    rows = unfilter(raw[: height * (line + 1)].reshape(height, line + 1), max(1, n * depth // 8))
    if depth == 16:
        out = rows.reshape(-1).view(">u2").astype(np.uint16).reshape(height, width, n)
    elif depth == 8:
        out = rows.reshape(height, width, n)
    else:
        bits = np.unpackbits(rows, axis=1)[:, : width * depth].reshape(height, width, depth)
        value = bits @ (1 << np.arange(depth - 1, -1, -1))
        out = (value if colour == 3 else value * (255 // ((1 << depth) - 1))).astype(np.uint8)[:, :, None]
    if colour == 3:
        if palette is None or out.max(initial=0) >= len(palette):
            raise PictureError("no palette for all pixels")
        out = palette[out[:, :, 0]]
    return out[:, :, 0] if out.shape[2] == 1 else out


def write_png(a: np.ndarray) -> bytes:
    """An 8- or 16-bit grey or colour picture as PNG."""
    wide = a.astype(">u2") if a.dtype == np.uint16 else a.astype(np.uint8)
    rows = np.frombuffer(np.ascontiguousarray(wide).tobytes(), np.uint8).reshape(a.shape[0], -1)
    raw = np.hstack([np.zeros((len(rows), 1), np.uint8), rows]).tobytes()
    colour = {1: 0, 2: 4, 3: 2, 4: 6}[a.shape[2] if a.ndim == 3 else 1]
    head = a.shape[1].to_bytes(4) + a.shape[0].to_bytes(4) + bytes([16 if a.dtype == np.uint16 else 8, colour, 0, 0, 0])
    chunk = lambda kind, body: len(body).to_bytes(4) + kind + body + zlib.crc32(kind + body).to_bytes(4)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


QC = ("sharpness", "mean_luma", "clip_frac", "dark_frac", "veg_frac")


def measure_pictures(files: DataFrame) -> DataFrame:
    """files (path, content) -> path, height, width, measures, phash and error (null if read)."""

    def run(batches):
        import pandas as pd

        for batch in batches:
            out = []
            for path, data in zip(batch["path"], batch["content"], strict=True):
                try:
                    a = read_png(data or b"")
                    rgb = (a >> 8 if a.dtype == np.uint16 else a).astype(np.uint8)
                    rgb = np.repeat(rgb[:, :, None], 3, 2) if rgb.ndim == 2 else rgb[:, :, :3] if rgb.shape[2] > 2 else np.repeat(rgb[:, :, :1], 3, 2)
                    qc = frame_qc(rgb)
                    out.append((path, *a.shape[:2], *[qc[k] for k in QC], perceptual_hash(rgb.mean(2)), None))
                except PictureError as error:
                    out.append((path, None, None, *[None] * len(QC), None, str(error)))
            yield pd.DataFrame(out, columns=["path", "height", "width", *QC, "phash", "error"]).astype({"height": "Int64", "width": "Int64"})

    schema = "path string, height long, width long, " + ", ".join(f"{c} double" for c in QC) + ", phash string, error string"
    return files.select("path", "content").mapInPandas(run, schema)


def read_pictures(spark: SparkSession, path: str, pattern: str = "*.png") -> DataFrame:
    """PNG files below a folder with their measures."""
    return measure_pictures(spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path))


def depth_at(files: DataFrame, points: DataFrame, radius: int = 4) -> DataFrame:
    """points (path, u, v) with depth, the robust depth around each in its 16-bit picture, and
    error (null if that was read)."""
    from tessera.operators.kernels import robust_depth

    def run(batches):
        import pandas as pd

        for batch in batches:
            out = []
            for path, data, pts in zip(batch["path"], batch["content"], batch["points"], strict=True):
                try:
                    a = read_png(data or b"")
                    a = a[:, :, 0] if a.ndim == 3 else a
                    out += [(path, p["u"], p["v"], robust_depth(a, p["u"], p["v"], radius), None) for p in pts]
                except PictureError as error:
                    out += [(path, p["u"], p["v"], None, str(error)) for p in pts]
            yield pd.DataFrame(out, columns=["path", "u", "v", "depth", "error"])

    grouped = points.groupBy("path").agg(F.collect_list(F.struct("u", "v")).alias("points"))
    return files.join(grouped, "path").select("path", "content", "points").mapInPandas(run, "path string, u double, v double, depth double, error string")
