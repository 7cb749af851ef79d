"""Helpers that the training-data operators share: scratch tables, Arrow slices, vectorised hashes."""

from __future__ import annotations

import atexit
import ctypes
import hashlib
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MADE: list = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. A local session without one gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _MADE:
        _MADE.append(tempfile.mkdtemp(prefix="motifline-"))
        import shutil

        atexit.register(shutil.rmtree, _MADE[0], True)
    return f"file://{_MADE[0]}"


class Scratch:
    """Tables of one run, written below the shared folder, so that later steps survive lost executors.

    Tables that the returned DataFrame still reads stay until the session's end; ``drop`` and ``keep`` remove others at once.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.names: set[str] = set()
        atexit.register(self.drop)

    def put(self, df: DataFrame, name: str, **options) -> DataFrame:
        self.names.add(name)
        path = f"{self.root}/{name}"
        df.write.options(**options).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def keep(self, *names: str) -> None:
        """Drop all other tables."""
        for name in self.names - set(names):
            self.drop(name)
        self.names &= set(names)

    def drop(self, name: str = "") -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the session is over; its owner clears the folder
            if name:
                raise


def spread_join(rows: DataFrame, table: DataFrame, on: list[str], copies: str, share: int = 1000) -> DataFrame:
    """``rows`` joined with ``table`` (one row a key; ``copies``: how many of ``rows`` have it) without a hot task.

    Keys that more than 1 / ``share`` of the matching rows have, fewer than ``share``, are broadcast; the others are
    joined by a shuffle. Both should be tables, as they are read twice.
    """
    total = table.agg(F.sum(copies)).first()[0] or 0
    hot = F.broadcast(table.where(F.col(copies) * share > F.lit(total)))
    cold = rows.join(hot.select(*on), on, "left_anti").join(table.where(F.col(copies) * share <= F.lit(total)), on)
    return rows.join(hot, on).select(cold.columns).unionByName(cold)


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Give freed memory back to the system. Python workers outlive their tasks, and would hold the most they ever used."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def slices(batch: pa.RecordBatch, column: str = "text", most: int = 1_000_000):
    """Cut a batch into runs of rows whose texts hold about ``most`` bytes; a longer text is a run of its own.

    Yields (rows, data, starts): the rows, their UTF-8 bytes back to back (null: empty), and len(rows) + 1 offsets.
    Memory that the batch's slices took is given back after the last one.
    """
    if not batch.num_rows:
        return
    text = batch.column(batch.schema.get_field_index(column))
    if text.null_count:
        text = text.fill_null(b"" if pa.types.is_binary(text.type) or pa.types.is_large_binary(text.type) else "")
    text = text.cast(pa.large_binary()) if text.type != pa.large_binary() else text
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2], np.uint8) if text.buffers()[2] is not None and text.buffers()[2].size else np.zeros(0, np.uint8)
    at, n = 0, batch.num_rows
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        to = min(to, n)
        yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to
    del text, offsets, data
    release()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads each bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def random_words(n: int, seed: int) -> np.ndarray:
    return mix64((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed) * np.uint64(1 << 32)) * np.uint64(0x9E3779B97F4A7C15))


class Rolling:
    """Polynomial hashes modulo 2**64 of any span of a byte array, by one cumulative sum.

    ``of(start, end)`` depends on the spanned bytes alone (after ``table`` maps each byte to a 64-bit word). Some
    different strings of 1,024 bytes and more collide for every base, so these hashes choose places and never tell that
    texts are equal.
    """

    _powers: dict = {}

    def __init__(self, data: np.ndarray, seed: int, table: np.ndarray | None = None):
        n = len(data)
        up, down = self._grown(seed, n)
        table = random_words(256, seed) if table is None else table
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(table[data] * up[:n], out=self.sums[1:])
        self.down = down

    @classmethod
    def _grown(cls, seed: int, n: int):
        have = cls._powers.get(seed)
        if have is None or len(have[0]) <= n:
            base = (int(random_words(1, seed + 77)[0]) & ~7) | 5
            back = pow(base, -1, 1 << 64)
            size = max(1 << 16, n + n // 4 + 1)
            out = []
            for b in (base, back):
                steps = np.full(size, b, np.uint64)
                steps[0] = 1
                out.append(np.cumprod(steps, dtype=np.uint64))
            cls._powers[seed] = have = tuple(out)
        return have

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.down[start])


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def words(data: np.ndarray, starts: np.ndarray):
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``, none across two texts, and each text's number of words."""
    solid = np.zeros(len(data) + 2, np.int8)
    solid[1:-1] = ~SPACE[data]
    step = np.diff(solid)
    inner = starts[1:-1][(starts[1:-1] > 0) & (starts[1:-1] < len(data))]
    both = np.unique(inner[(solid[inner] == 1) & (solid[inner + 1] == 1)])  # a word ends and another begins
    begin, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    if len(both):
        begin, end = np.sort(np.concatenate([begin, both])), np.sort(np.concatenate([end, both]))
    return begin, end, np.diff(np.searchsorted(begin, starts))


def word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """(words, 2): two 64-bit hashes of each word. Up to 16 bytes are mixed as they are, longer words by BLAKE2."""
    size = end - begin
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    eight = np.ndarray(len(data) + 9, "<u8", padded, strides=(1,))  # the eight bytes from each place
    keep = np.r_[np.uint64(0), (~np.uint64(0)) >> (np.uint64(8) * np.arange(7, -1, -1, dtype=np.uint64))]  # masks of 0 to 8 bytes
    low = eight[begin] & keep[np.minimum(size, 8)]
    high = eight[np.minimum(begin + 8, len(data))] & keep[np.clip(size - 8, 0, 8)]
    out = np.empty((len(begin), 2), np.uint64)
    for k, add in enumerate(random_words(2, 91)):
        out[:, k] = mix64(mix64(mix64(low + add) + high) + size.astype(np.uint64))
    long = np.flatnonzero(size > 16)
    if len(long):
        raw = data.tobytes()
        digests = [hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(begin[long].tolist(), end[long].tolist())]
        out[long] = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)
    return out


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores before it as make it no column of ``docs``."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
