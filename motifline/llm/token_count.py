"""Token counts by a separator scan over flat token files that have no index.

A flat file is token ids of fixed width, each document followed by an end-of-document id. Files are cut into blocks of
a fixed number of tokens, wherever documents lie. Each block is searched for the id as one array; of a block only the
number of ids, the places of the first and last, and the lengths between them go on. A prefix scan over a file's
blocks (sums of tokens and ids, running maximum of the last id's place) stitches documents that cross blocks. The scan
has two levels, blocks within runs of ``span`` blocks and then the runs, so that no task scans one huge file's blocks.

``write`` makes such files of a table's texts, as rows of blocks, with a manifest of ids in the order written;
``blocks_of`` cuts real files. Null and empty texts have no tokens and count 0. Repeated rows each count. What follows
a file's last end id is reported with ``ended`` false. A very long text spans as many blocks as it needs. Ids that the
width can't hold, or that equal the end id, are an error. Ties don't arise. An empty table or file gives no rows. Extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from motifline.llm.tokenizing import tokenizer

BLOCK = 1 << 16
END = 0xFFFF  # no id of the tokenizer, so no text can hold it
WIDTH = "<u2"


def write(docs: DataFrame, path: str, block: int = BLOCK, end: int = END, width: str = WIDTH) -> DataFrame:
    """A flat file for each partition: file, block, data (bytes), ended (ids of the rows whose end lies in the block)."""
    if end > np.iinfo(width).max:
        raise ValueError(f"the end id {end} doesn't fit {width}")

    def rows(batches):
        encode, file = tokenizer(path).encode, TaskContext.get().partitionId()
        held, size, ended, number = [], 0, [], 0
        names = ["file", "block", "data", "ended"]

        def out(data, ids):
            return pa.RecordBatch.from_arrays([pa.array([file], pa.int64()), pa.array([number], pa.int64()), pa.array([data.tobytes()], pa.binary()), pa.array([ids], pa.list_(pa.int64()))], names)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end))
                if len(ids) > 1 and (ids[:-1].max() > np.iinfo(width).max or (ids[:-1] == end).any()):
                    raise ValueError(f"an id of document {doc_id} doesn't fit {width} or is the end id {end}")
                ids = ids.astype(width)
                held.append(ids)
                size += len(ids)
                while size > block or (size == block and held):
                    flat = np.concatenate(held)
                    whole = size == block
                    yield out(flat[:block], [*ended, doc_id] if whole else ended)
                    number += 1
                    held, size, ended = ([], 0, []) if whole else ([flat[block:]], size - block, [])
                    if whole:
                        break
                else:
                    ended.append(doc_id)
        if size:
            yield out(np.concatenate(held), ended)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(rows, "file long, block long, data binary, ended array<long>")


def blocks_of(spark: SparkSession, paths: str | list[str], block: int = BLOCK, width: str = WIDTH) -> DataFrame:
    """Flat files (each below Spark's 2 GB for one value) as blocks."""
    step = block * np.dtype(width).itemsize

    def rows(batches):
        for batch in batches:
            for file, data in zip(batch.column(0), batch.column(1)):
                raw = data.as_py()
                for k, at in enumerate(range(0, len(raw), step)):
                    yield pa.RecordBatch.from_arrays([pa.array([file.as_py()], pa.string()), pa.array([k], pa.int64()), pa.array([raw[at : at + step]], pa.binary())], ["file", "block", "data"])

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInArrow(rows, "file string, block long, data binary")


def _found(blocks: DataFrame, end: int, width: str) -> DataFrame:
    """Of each block: tokens, end ids, the first's and last's places, and the places of all."""
    kind = blocks.schema["file"].dataType.simpleString()

    def rows(batches):
        for batch in batches:
            out = [[] for _ in range(3)]
            for data in batch.column(2):
                ids = np.frombuffer(data.as_buffer(), width)
                at = np.flatnonzero(ids == end)
                for column, x in zip(out, (len(ids), len(at), at)):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.int64()))], ["file", "block", "n", "ends", "at"])

    return blocks.select("file", "block", "data").mapInArrow(rows, f"file {kind}, block long, n long, ends long, at array<long>")


def _prefix(found: DataFrame, span: int) -> DataFrame:
    """Adds what lies before each block in its file: tokens, end ids, and the place after the last end id."""
    found = found.withColumn("_run", F.expr(f"block div {span}"))
    inside = Window.partitionBy("file", "_run").orderBy("block")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    local = found.withColumn("_n", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("_ends", F.coalesce(F.sum("ends").over(before), F.lit(0)))
    local = local.withColumn("_last", F.when(F.col("ends") > 0, F.col("_n") + F.try_element_at("at", F.lit(-1)) + 1)).withColumn("_upto", F.max("_last").over(before))
    runs = local.groupBy("file", "_run").agg(F.sum("n").alias("rn"), F.sum("ends").alias("re"), F.max("_last").alias("rl"))
    earlier = Window.partitionBy("file").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("pn", F.coalesce(F.sum("rn").over(earlier), F.lit(0))).withColumn("pe", F.coalesce(F.sum("re").over(earlier), F.lit(0)))
    runs = runs.withColumn("pl", F.coalesce(F.max(F.col("pn") + F.col("rl")).over(earlier), F.lit(0))).select("file", "_run", "pn", "pe", "pl")
    out = local.join(runs, ["file", "_run"])
    return out.select("file", "block", "n", "at", (F.col("pn") + F.col("_n")).alias("tokens_before"), (F.col("pe") + F.col("_ends")).alias("ends_before"), F.coalesce(F.col("pn") + F.col("_upto"), F.col("pl")).alias("open_from"))


def scan(blocks: DataFrame, end: int = END, width: str = WIDTH, span: int = 1024) -> DataFrame:
    """(file, ordinal, start, n_tokens, ended): each document's place in its file and its tokens, without the end id."""
    placed = _prefix(_found(blocks, end, width), span)
    ends = F.transform("at", lambda x: x + F.col("tokens_before"))
    begins = F.concat(F.array("open_from"), F.transform(ends, lambda x: x + 1))
    each = placed.where(F.size("at") > 0).select("file", "ends_before", F.posexplode(F.arrays_zip(F.slice(begins, 1, F.size("at")).alias("a"), ends.alias("b"))).alias("_k", "_p"))
    done = each.select("file", (F.col("ends_before") + F.col("_k")).alias("ordinal"), F.col("_p.a").alias("start"), (F.col("_p.b") - F.col("_p.a")).alias("n_tokens"), F.lit(True).alias("ended"))
    files = placed.groupBy("file").agg(F.max(F.col("tokens_before") + F.col("n")).alias("all"), F.max(F.col("ends_before") + F.size("at")).alias("ordinal"), F.max(F.coalesce(F.col("tokens_before") + F.try_element_at("at", F.lit(-1)) + 1, F.col("open_from"))).alias("start"))
    rest = files.where("all > start").select("file", "ordinal", "start", (F.col("all") - F.col("start")).alias("n_tokens"), F.lit(False).alias("ended"))
    return done.unionByName(rest)


def by_document(blocks: DataFrame, end: int = END, width: str = WIDTH, span: int = 1024) -> DataFrame:
    """(doc_id, n_tokens): the scan's counts with the names that the writer's manifest has for them, by order in the file."""
    listed = blocks.select("file", "block", F.size("ended").cast("long").alias("n"), F.size("ended").cast("long").alias("ends"), F.transform(F.sequence(F.lit(1), F.size("ended")), lambda x: x.cast("long")).alias("at"), "ended")
    order = _prefix(listed.drop("ended"), span).select("file", "block", "ends_before")
    names = listed.join(order, ["file", "block"]).where("n > 0").select("file", "ends_before", F.posexplode("ended").alias("_k", "doc_id"))
    names = names.select("file", (F.col("ends_before") + F.col("_k")).alias("ordinal"), "doc_id")
    return names.join(scan(blocks, end, width, span).where("ended"), ["file", "ordinal"]).select("doc_id", "n_tokens")
