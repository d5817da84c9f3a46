"""Operator 9, media columns: GIF.

``gif_frames`` reads a binary column of GIF files: code streams are decoded, palettes, disposal and
transparency applied, and each file gives its timed frames (delay, place, composed RGBA pixels)
with a colour histogram per frame. ``store_as_gif`` is the way back: bytes become the palette indices of frames
of 192 columns and up to 64 rows, one after the other in time.

The query stores every text's UTF-8 bytes this way, reads the stored bytes back through the same decoder and compositor, takes
the payload from the composed canvases, and its ``feature`` is the sum of the frames' colour histograms, each
weighted by the time its frame is shown: ``bins`` numbers for red, then green, then blue.

Memory: frames are decoded one at a time onto one canvas; a canvas or frame of more than gif.PIXELS pixels, or of more than the file could paint, is an error.
With ``pixels`` the column holds all frames of a file, FRAME_BYTES of them at most; beyond that the row has an error, and ``pixels=False`` gives all else.

Defined results: a null text is an empty text; a null file gives a null media row, a broken one a row with its error, never a
failed job; texts of any length become more frames; equal texts give equal values; rows repeat as they repeat; an empty table gives an empty table; input
columns named like an output column (in any case) are replaced.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import gif
from .common import append_columns, table

COLUMNS, ROWS, DELAY = 192, 64, 4
PAD = 192
FRAME_BYTES = 1 << 28


def store_as_gif(payload: bytes) -> bytes:
    """Payload (a positive multiple of COLUMNS bytes) as frames that each paint over the canvas."""
    data = np.frombuffer(payload, np.uint8).reshape(-1, COLUMNS)
    parts = [data[i : i + ROWS] for i in range(0, len(data), ROWS)]
    frames = [gif.Frame(0, 0, COLUMNS, len(p), p, None, DELAY, 1) for p in parts]
    return gif.encode(frames, COLUMNS, len(parts[0]))


def histogram(rgba: np.ndarray, bins: int = 8) -> np.ndarray:
    """Pixels by red, green and blue in ``bins`` (a power of two) equal steps each; transparent pixels are left out."""
    seen = rgba.reshape(-1, 4)
    if not seen[:, 3].all():
        seen = seen[seen[:, 3] > 0]
    shift = 9 - bins.bit_length()
    return np.concatenate([np.bincount(seen[:, c] >> shift, minlength=bins) for c in range(3)])


def timed_frames(data: bytes, bins: int, pixels: bool) -> list[dict]:
    """The frames of a file, as gif_frames returns them."""
    rows, held = [], 0
    for i, f in enumerate(gif.decode(data)):
        held += f.canvas.nbytes if pixels else 0
        if held > FRAME_BYTES:
            raise ValueError(f"the frames have more than {FRAME_BYTES} bytes of pixels")
        rows.append({"index": i, "left": f.left, "top": f.top, "width": f.width, "height": f.height, "delay_cs": f.delay_cs, "disposal": f.disposal, "pixels": f.canvas.tobytes() if pixels else None, "histogram": histogram(f.canvas, bins).tolist()})
    return rows


def gif_frames(media: DataFrame, column: str = "content", bins: int = 8, pixels: bool = True) -> DataFrame:
    """media with gif: (width, height, duration_cs, error, frames: array of (index, left, top, width,
    height, delay_cs, disposal, pixels as RGBA bytes, histogram))."""
    frame = T.StructType([T.StructField(n, T.IntegerType()) for n in ("index", "left", "top", "width", "height", "delay_cs", "disposal")] + [T.StructField("pixels", T.BinaryType()), T.StructField("histogram", T.ArrayType(T.LongType()))])
    whole = T.StructType([T.StructField(n, T.IntegerType()) for n in ("width", "height", "duration_cs")] + [T.StructField("error", T.StringType()), T.StructField("frames", T.ArrayType(frame))])

    def one(data: bytes | None) -> dict | None:
        if data is None:
            return None
        try:
            rows = timed_frames(data, bins, pixels)
        except (ValueError, IndexError, gif.struct.error) as e:
            return {"width": None, "height": None, "duration_cs": None, "error": str(e) or type(e).__name__, "frames": None}
        w, h = gif.size(data)
        return {"width": w, "height": h, "duration_cs": sum(f["delay_cs"] for f in rows), "error": None, "frames": rows}

    return append_columns(media, [column], [T.StructField("gif", whole)], lambda: lambda files: [[one(x) for x in files.to_pylist()]])


DIGEST = [("n_bytes", T.LongType()), ("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("frames", T.LongType()), ("duration_cs", T.LongType()), ("feature", T.StringType())]


def text_media_digest(text: str | None, bins: int = 8) -> tuple:
    raw = (text or "").encode()
    media = store_as_gif(raw + b" " * (-len(raw) % PAD if raw else PAD))
    digest, size, tail, frames, duration, counts = hashlib.sha256(), 0, b"", 0, 0, np.zeros(3 * bins, np.int64)
    for f in gif.decode(media):
        part = f.canvas[f.top : f.top + f.height, f.left : f.left + f.width, 0].tobytes()
        digest.update(part)
        size, tail = size + len(part), part[-16:]
        frames, duration = frames + 1, duration + f.delay_cs
        counts += f.delay_cs * histogram(f.canvas, bins)
    return len(raw), size, digest.hexdigest(), zlib.crc32(tail), len(media), hashlib.sha256(media).hexdigest(), frames, duration, ":".join(map(str, counts.tolist()))


def op9_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")

    def make():
        def run(texts):
            rows = [text_media_digest(t.as_py()) for t in texts]
            return [list(c) for c in zip(*rows)]

        return run

    return append_columns(docs, ["text"], [T.StructField(n, k) for n, k in DIGEST], make).drop("text")
