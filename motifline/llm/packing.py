"""Best-fit packing of token sequences, planned on the histogram of lengths.

Documents are cut into pieces of at most ``most`` tokens. Best-fit decreasing runs on the driver over the counts of
the ``most`` possible lengths, never over documents: it opens and fills whole runs of equal sequences at once and
gives a plan of slots, one row for each run. Pieces then take slots by joining on their rank within their length.

Plan size: for each length every run of equal sequences with enough room is split once at most, so the plan grows
with the number of distinct lengths (4,096), not with the documents.

Null text counts as empty; an empty document still has its end token and so one piece. Repeated rows are packed each
by itself, in an order fixed by their content; ties among equal pieces may take either slot. A very long text is cut
into as many pieces as it needs. Null ids sort first. An empty table gives no rows. Extra columns are ignored, whatever
their names.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from motifline.llm.common import Scratch, release
from motifline.llm.tokenizing import default_path, tokenizer

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str, most: int = 4096, end: int = 1, keep_ids: bool = False) -> DataFrame:
    """A row for each piece; ``keep_ids`` adds the token ids themselves (array<int>)."""

    def cut(batches):
        encode = tokenizer(path).encode
        for batch in batches:
            out = [[] for _ in range(6)]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end)).astype("<u4")
                for k, at in enumerate(range(0, len(ids), most)):
                    part = ids[at : at + most]
                    for column, x in zip(out, (doc_id, k, at, len(part), zlib.crc32(part.tobytes()), part.astype(np.int32) if keep_ids else None)):
                        column.append(x)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            n = 6 if keep_ids else 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out[:n], kinds)], names[:n])
        release()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES + (", ids array<int>" if keep_ids else ""))


def plan(counts: dict[int, int], most: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts. Rows (length, first rank, past-last rank, first sequence, offset).

    Open sequences are kept as runs of neighbouring numbers with the same room; the fullest that still fit come first.
    """
    rooms: list[int] = []  # the rooms that some run has, sorted
    runs: dict[int, list[tuple[int, int]]] = {}  # room: (first sequence, how many)
    out, opened = [], 0

    def add(room: int, first: int, n: int) -> None:
        if room not in runs:
            runs[room] = []
            insort(rooms, room)
        mine = runs[room]
        if mine and mine[-1][0] + mine[-1][1] == first:
            mine[-1] = (mine[-1][0], mine[-1][1] + n)
        else:
            mine.append((first, n))

    for length in sorted(counts, reverse=True):
        rank, n = 0, counts[length]
        while rank < n:
            k = bisect_left(rooms, length)
            if k < len(rooms):
                room = rooms[k]
                first, have = runs[room].pop()
                if not runs[room]:
                    del runs[room], rooms[k]
                take = min(have, n - rank)
                if take < have:
                    add(room, first + take, have - take)
                out.append((length, rank, rank + take, first, most - room))
                if room > length:
                    add(room - length, first, take)
                rank += take
            else:  # new sequences, each with as many of this length as the best fit would put there at once
                each = most // length
                full, rest = divmod(n - rank, each)
                for j in range(each):
                    if full:
                        out.append((length, rank, rank + full, opened, j * length))
                        rank += full
                if full and most - each * length:
                    add(most - each * length, opened, full)
                opened += full
                if rest:
                    for j in range(rest):
                        out.append((length, rank, rank + 1, opened, j * length))
                        rank += 1
                    add(most - rest * length, opened, 1)
                    opened += 1
    return out


def pack(spark: SparkSession, docs: DataFrame, path: str | None = None, most: int = 4096, end: int = 1, salts: int = 256) -> DataFrame:
    """The pieces of ``docs`` (doc_id, text) with sequence_id and offset.

    A rank within a length is a rank within (length, salt) plus the counts of lower salts, so no length, however
    common, is ranked in one task.
    """
    scratch = Scratch(spark, "packing")
    cut = scratch.put(pieces(docs, path or default_path(), most, end), "pieces")
    order = ["doc_id", "piece", "start", "ids_crc32"]
    salted = cut.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    by_salt = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    below = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    before = by_salt.select("length", "_salt", F.coalesce(F.sum("_n").over(below), F.lit(0)).alias("_before"))
    counts = {r["length"]: r["_n"] for r in cut.groupBy("length").agg(F.count("*").alias("_n")).collect()}  # at most ``most`` rows
    slots = spark.createDataFrame(plan(counts, most), "length long, _from long, _to long, _first long, offset long")
    ranked = salted.withColumn("_in", F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*order)) - 1)
    ranked = ranked.join(before, ["length", "_salt"]).withColumn("_rank", F.col("_in") + F.col("_before"))
    took = (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))
    placed = ranked.alias("r").join(F.broadcast(slots).alias("s"), (F.col("r.length") == F.col("s.length")) & took)  # bounded by the lengths
    return placed.select("doc_id", "piece", "start", F.col("r.length").alias("length"), "ids_crc32", (F.col("_first") + F.col("_rank") - F.col("_from")).alias("sequence_id"), "offset")
