"""Media columns: byte payloads stored as GIF frames and read back, with the frames' times and colour histograms.

A payload is laid out in rows of ``width`` samples and cut into pictures of at most ``rows`` rows, shown one after
the other. Pictures are decoded from the stored bytes by the general decoder (LZW streams, palettes, disposal,
transparency), so the samples that are returned are those of the file.

Null text counts as empty; an empty payload is one row of zero samples. Repeated rows give equal values. An empty
table gives no rows. A longer text gives more pictures; one document's pictures must fit in a task.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifline.llm import gif

WIDTH, ROWS, DELAY = 64, 256, 4
FRAME = "struct<at:int,delay:int,left:int,top:int,width:int,height:int,histogram:array<int>>"
DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
GREY = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 3, 1)


def padded(data: bytes, unit: int = WIDTH) -> bytes:
    """With zero bytes up to a positive multiple of ``unit``."""
    return data.ljust(max(unit, -(-len(data) // unit) * unit), b"\0")


def store(payload: bytes, width: int = WIDTH, rows: int = ROWS, delay: int = DELAY) -> bytes:
    samples = np.frombuffer(payload, np.uint8).reshape(-1, width)
    out = gif.Gif(width, min(rows, len(samples)), 0, GREY)
    for at in range(0, len(samples), rows):
        out.images.append(gif.Image(0, 0, samples[at : at + rows], GREY, delay))
    return gif.encode(out)


def load(media: bytes) -> tuple[bytes, list[tuple[int, int, np.ndarray]]]:
    """The samples of all pictures in order, and each shown frame's start, duration and colour histogram.

    The histogram counts the shown canvas's pixels by their top bits: three of red, three of green, two of blue.
    """
    found = gif.decode(media)
    samples = b"".join(im.samples.tobytes() for im in found.images)
    plain = all(im.transparent is None and im.disposal < 2 and im.palette is found.palette and im.left == im.top == 0 and im.samples.shape[1] == found.width for im in found.images)
    frames = []
    if plain and found.palette is not None:  # opaque pictures from the top left corner on: the canvas is the last full rows
        canvas = np.zeros((found.height, found.width), np.uint8)
        bins = _bins(np.pad(found.palette, ((0, 256 - len(found.palette)), (0, 0))))
        at = 0
        for im in found.images:
            canvas[: len(im.samples)] = im.samples[: found.height]
            frames.append((at, im.delay, np.bincount(bins, np.bincount(canvas.ravel(), minlength=256), 256).astype(np.int64)))
            at += im.delay
    else:
        for canvas, at, delay in found.frames():
            frames.append((at, delay, np.bincount(_bins(canvas[..., :3].reshape(-1, 3)), minlength=256)))
    return samples, frames


def _bins(rgb: np.ndarray) -> np.ndarray:
    return (rgb[:, 0] & 0xE0) | (rgb[:, 1] & 0xE0) >> 3 | rgb[:, 2] >> 6


def feature(frames: list[tuple[int, int, np.ndarray]]) -> str:
    """Frames, total time, and the shares (thousandths, down) of the eight grey levels over all shown frames."""
    total = sum(h for _, _, h in frames)
    levels = [int(total[k << 5 : (k + 1) << 5].sum()) for k in range(8)]
    return f"frames={len(frames)};time={sum(d for _, d, _ in frames)};levels={','.join(str(x * 1000 // max(1, sum(levels))) for x in levels)}"


def as_gif(docs: DataFrame, column: str = "text") -> DataFrame:
    """(doc_id, media, frames): each text's bytes as a GIF, and its timed frames with their histograms."""

    def make(batches):
        for batch in batches:
            media, frames = [], []
            for x in batch.column(1):
                one = store(padded((x.as_py() or "").encode()))
                media.append(one)
                found = gif.decode(one)
                frames.append([{"at": a, "delay": d, "left": im.left, "top": im.top, "width": im.samples.shape[1], "height": im.samples.shape[0], "histogram": h.tolist()} for (a, d, h), im in zip(load(one)[1], found.images)])
            kind = pa.struct([(k, pa.int32()) for k in ("at", "delay", "left", "top", "width", "height")] + [("histogram", pa.list_(pa.int32()))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(media, pa.binary()), pa.array(frames, pa.list_(kind))], ["doc_id", "media", "frames"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("string")).mapInArrow(make, f"doc_id long, media binary, frames array<{FRAME}>")


def digest(docs: DataFrame, column: str = "text") -> DataFrame:
    """A row for each document: sizes and digests of payload and stored form, and a feature of the frames read back."""

    def make(batches):
        for batch in batches:
            out = [[] for _ in range(7)]
            for x in batch.column(1):
                data = (x.as_py() or "").encode()
                media = store(padded(data))
                back, frames = load(media)
                row = (len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(frames))
                for column, value in zip(out, row):
                    column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = [f.split()[0] for f in DIGEST.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(out, kinds))], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("string")).mapInArrow(make, DIGEST)
