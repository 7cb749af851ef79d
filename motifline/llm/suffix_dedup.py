"""Exact substring dedup: every byte covered by a ``length``-byte string that starts anywhere else too is removed.

1. Windows (strings of ``length`` bytes) are assigned to anchors: the leftmost position in the window whose ``gram``
   bytes have the least hash. The choice depends on the window's bytes alone, so equal windows have equal anchors at
   equal places. A run is the windows of one anchor; there is about one run for each (length - gram) / 2 bytes.
2. Runs with equal anchor and bytes (128-bit BLAKE2 digests of all their bytes) are counted, pre-aggregated. A run that
   occurs again is removed whole. A run that does not, whose anchor bytes no other run has, repeats nothing.
3. The rest, runs that share an anchor with different ones around it, are the ends of repeats. One run of each kind
   brings its bytes to its anchor's group, and the group's windows are suffix-sorted (deep-shallow), those of each
   distance to the anchor apart, since equal windows have equal ones; neighbours that agree in ``length`` bytes repeat.
4. A group of more than ``large`` runs is split before it is sorted: its windows are parted in ``WAYS`` by their distance
   to the anchor, and the windows of a part are grouped by all the bytes that they must share, which are the more the
   narrower the part. Steps 2 to 4 are then taken on the parts' runs. After three levels (at 400 bytes) a group's windows
   are equal, so this ends, and a passage that very many documents share never meets in one task.
5. Each text takes the intervals of its runs and drops their bytes.

Rolling hashes only choose anchors and form groups; what is equal is told by BLAKE2 digests and by sorting the bytes.
Texts are known by two 64-bit hashes; equal texts share their intervals. Matches never cross documents. Null text is
empty. Texts shorter than ``length`` lose nothing. A very long text is one row of the input and of the result; the
intervals gathered for it are a fraction of its bytes. Repeated rows each repeat the other; ties don't arise. An empty
table gives no rows. Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motifline.llm.common import Rolling, Scratch, release, slices, spread_join
from motifline.llm.suffix_sort import deep_shallow

RUNS = "k1 long, k2 long, start long, n long, place long, gram long, s1 long, s2 long"
KEY = ["gram", "s1", "s2"]  # names a kind of run: its anchor's hash and its digest
#: A run's part: its group, digest, first window in the run, anchor's place in the data, least and greatest distance to the anchor
PARTS = "gram long, s1 long, s2 long, group long, t1 long, t2 long, at long, place long, lo int, hi int, data binary"
KIND = ["group", "t1", "t2"]
SPANS = "array<struct<a:long,b:long>>"
#: Parts that a large group's distances to the anchor are cut into at each level; fewer need more levels, each of six jobs.
WAYS = 8


def _sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    out, have = v, 1
    while have * 2 <= width:
        out = np.minimum(out[: len(out) - have], out[have:])
        have *= 2
    return np.minimum(out[: len(v) - width + 1], out[width - have : width - have + len(v) - width + 1])


def runs(data: np.ndarray, starts: np.ndarray, length: int, gram: int):
    """Runs of windows with one anchor: text number, first window (in the slice), windows, anchor's distance to the first, anchor hash, digest."""
    size = np.diff(starts)
    long = np.flatnonzero(size >= length)
    if not len(long):
        return tuple(np.zeros(0, np.int64) for _ in range(7))
    rolled = Rolling(data, 61)
    at = np.arange(len(data) - gram + 1)
    h = rolled.of(at, at + gram)
    low = _sliding_min(h & np.uint64(0xFFFFFFFF00000000) | at.astype(np.uint64), length - gram + 1)
    count = size[long] - length + 1
    text = np.repeat(long, count)
    window = np.arange(count.sum()) + np.repeat(starts[:-1][long] - (np.cumsum(count) - count), count)
    anchor = (low[window] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])])
    n = np.diff(np.r_[new, len(window)])
    first, place = window[new], anchor[new]
    raw = data.tobytes()
    digests = _digests([raw[a:b] for a, b in zip(first.tolist(), (first + n - 1 + length).tolist())])
    return text[new], first, n, place - first, h[place].view(np.int64), digests[:, 0], digests[:, 1]


def _digests(parts: list[bytes]) -> np.ndarray:
    """(parts, 2) signed words."""
    return np.frombuffer(b"".join([hashlib.blake2b(x, digest_size=16).digest() for x in parts]), "<i8").reshape(-1, 2)


def find_runs(keyed: DataFrame, length: int, gram: int) -> DataFrame:
    def rows(batches):
        for batch in batches:
            k1, k2 = (batch.column(k).to_numpy() for k in (0, 1))
            done = 0
            for own, data, starts in slices(batch):
                text, first, *rest = runs(data, starts, length, gram)
                columns = [k1[done + text], k2[done + text], first - starts[text], *rest]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [f.split()[0] for f in RUNS.split(", ")])
                done += own.num_rows

    return keyed.select("k1", "k2", "text").mapInArrow(rows, RUNS)


def _parts(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 8 + [pa.int32()] * 2 + [pa.binary()]
    columns = zip(*out) if out else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [f.split()[0] for f in PARTS.split(", ")])


def _pieces(keyed: DataFrame, wanted: DataFrame, length: int, gram: int) -> DataFrame:
    """Runs' bytes from one row of each text: that of its least id."""
    a, b = keyed.alias("a"), wanted.alias("b")
    on = (F.col("a.k1") == F.col("b.k1")) & (F.col("a.k2") == F.col("b.k2")) & F.col("a.doc_id").eqNullSafe(F.col("b._one"))
    joined = a.join(b, on).select("a.text", "b.runs")

    def rows(batches):
        for batch in batches:
            out = []
            for text, found in zip(batch.column(0), batch.column(1)):
                raw = text.as_py().encode()
                for r in found.as_py():
                    own = (r["gram"], r["s1"], r["s2"])
                    out.append((*own, *own, 0, r["place"], 0, length - gram, raw[r["start"] : r["start"] + r["n"] - 1 + length]))
            yield _parts(out)

    return joined.mapInArrow(rows, PARTS)  # repeated rows bring a text again; their runs are removed whole by count


def _split(pieces: DataFrame, length: int) -> DataFrame:
    """The windows of each piece parted by their distance to the anchor, grouped by what a part's windows share."""

    def rows(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                raw, place, lo, hi = r["data"], r["place"], r["lo"], r["hi"]
                last, width = len(raw) - length, -(-(hi - lo + 1) // WAYS)
                for a in range(lo, hi + 1, width):
                    b = min(a + width - 1, hi)
                    first, end = max(0, place - b), min(last, place - a)
                    if first <= end:
                        common = hashlib.blake2b(raw[place - a : place - b + length], digest_size=8, person=f"{a}-{b}".encode()).digest()
                        data = raw[first : end + length]
                        out.append((r["gram"], r["s1"], r["s2"], int.from_bytes(common, "little", signed=True), *_digests([data])[0].tolist(), r["at"] + first, place - first, a, b, data))
            yield _parts(out)

    return pieces.mapInArrow(rows, PARTS)


def _intervals(yes: np.ndarray, starts: np.ndarray, n: np.ndarray, shift: list[int]) -> list[list[dict]]:
    """For each piece its maximal stretches of repeated windows, as {a: first, b: past last} in its run."""
    out = []
    for at, m, k in zip(starts.tolist(), n.tolist(), shift):
        step = np.diff(np.r_[0, yes[at : at + m].astype(np.int8), 0])
        out.append([{"a": a + k, "b": b + k} for a, b in zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist())])
    return out


def sort_groups(pieces: DataFrame, length: int, most: int = 1_500_000) -> DataFrame:
    """Suffix-sort the windows of each group's runs: (gram, s1, s2, spans) of the runs with repeated windows."""
    kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))

    def solve(table: pa.Table):
        raw = table.column(5).to_pylist()
        size = np.array([len(r) for r in raw])
        begin = np.cumsum(size) - size
        data = np.frombuffer(b"".join(raw), np.uint8)
        n = size - length + 1
        base = np.cumsum(n) - n
        position = np.arange(n.sum()) + np.repeat(begin - base, n)
        _, group = np.unique(table.column(3).to_numpy(), return_inverse=True)
        distance = np.repeat(table.column(6).to_numpy() + begin, n) - position  # to the anchor: equal windows have equal ones
        order, same = deep_shallow(data, position, np.repeat(group * length, n) + distance, length)
        yes = np.zeros(len(position), bool)
        yes[order[same]] = True
        yes[order[:-1][same[1:]]] = True
        spans = _intervals(yes, base, n, table.column(4).to_pylist())
        has = pa.array([bool(s) for s in spans])
        return pa.RecordBatch.from_arrays([*(table.column(k).combine_chunks() for k in range(3)), pa.array(spans, kind)], [*KEY, "spans"]).filter(has)

    def rows(batches):
        held, size, last = [], 0, None
        for batch in batches:
            gram = batch.column(3).to_numpy()
            bytes_ = np.array([len(x) for x in batch.column(5).to_pylist()])
            at = 0
            for i in range(batch.num_rows):
                if size > most and gram[i] != last:  # a group ends, and enough is held
                    if i > at:
                        held.append(batch.slice(at, i - at))
                    yield solve(pa.Table.from_batches(held))
                    held, size, at = [], 0, i
                size += int(bytes_[i])
                last = gram[i]
            if batch.num_rows > at:
                held.append(batch.slice(at))
        if held:
            yield solve(pa.Table.from_batches(held))
        held.clear()
        release()

    return pieces.select(*KEY, "group", "at", "data", "place").repartition("group").sortWithinPartitions("group").mapInArrow(rows, f"gram long, s1 long, s2 long, spans {SPANS}")


def repeats(scratch: Scratch, pieces: DataFrame, length: int, large: int) -> DataFrame:
    """(gram, s1, s2, spans) of the runs with windows that another piece of their group has. pieces: one of each kind."""
    found, level = [], 0
    while True:
        sizes = pieces.groupBy("group").agg(F.count("*").alias("many")).where((F.col("many") > large))
        hot = scratch.put(sizes, f"hot{level}")
        few = not hot.limit(1).count()
        found.append(scratch.put(sort_groups(pieces if few else pieces.join(hot, "group", "left_anti"), length), f"spans{level}"))
        if few:
            break
        level += 1
        parts = scratch.put(_split(pieces.join(hot.select("group"), "group", "left_semi"), length), f"parts{level}")
        kinds = scratch.put(parts.groupBy(*KIND).agg(F.count("*").alias("copies")), f"kinds{level}")
        n = (F.octet_length("data") - length + 1).cast("long")
        again = spread_join(parts.select(*KEY, *KIND, "at", n.alias("n")), kinds.where("copies > 1"), KIND, "copies")
        found.append(scratch.put(again.select(*KEY, F.array(F.struct(F.col("at").alias("a"), (F.col("at") + F.col("n")).alias("b"))).cast(SPANS).alias("spans")), f"again{level}"))
        open_ = kinds.groupBy("group").agg(F.count("*").alias("many")).where("many > 1").select("group")
        pieces = scratch.put(parts.dropDuplicates(KIND).join(open_, "group"), f"pieces{level}").select(*parts.columns)
        scratch.drop(f"parts{level}")
    every = found[0]
    for one in found[1:]:
        every = every.unionByName(one)
    return every.groupBy(*KEY).agg(F.flatten(F.collect_list("spans")).alias("spans"))  # at most a run's windows, once for each level


def _cut(rows: DataFrame, length: int) -> DataFrame:
    def cut(batches):
        for batch in batches:
            out = [[] for _ in range(4)]
            for text, spans in zip(batch.column(1), batch.column(2)):
                raw = (text.as_py() or "").encode()
                found = spans.as_py() or []
                if found:
                    edge = np.zeros(len(raw) + 1, np.int64)
                    np.add.at(edge, [s["a"] for s in found], 1)
                    np.add.at(edge, [s["b"] - 1 + length for s in found], -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                    n_spans = int(np.count_nonzero(np.diff(np.r_[False, gone].astype(np.int8)) == 1))
                else:
                    kept, n_spans = raw, 0
                for column, x in zip(out, (len(raw), len(raw) - len(kept), n_spans, kept)):
                    column.append(x)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            digest = pa.array([hashlib.sha256(x).hexdigest() for x in out[3]], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(out, kinds)), digest], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    return rows.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")


def dedup(spark: SparkSession, docs: DataFrame, length: int = 400, gram: int = 64, large: int = 1000) -> DataFrame:
    """docs (doc_id, text) to doc_id, n_bytes, n_removed, n_spans, kept (the bytes that remain) and kept_sha256."""
    scratch = Scratch(spark, "suffix")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(1), "text")})
    every = scratch.put(find_runs(keyed.where(F.octet_length("text") >= length), length, gram), "runs")
    kinds = scratch.put(every.groupBy(*KEY).agg(F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("k1", "k2", "start", "n", "place")]), "kinds")
    anchors = kinds.groupBy("gram").agg(F.count("*").alias("many"), F.sum("copies").alias("all")).where("all > 1").select("gram", "many")
    kinds = scratch.put(kinds.join(anchors, "gram"), "shared")
    scratch.drop("kinds")

    open_ = kinds.where("many > 1")
    wanted = open_.groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "n", "place", *KEY)).alias("runs"))  # at most a text's runs
    one = keyed.where(F.octet_length("text") >= length).groupBy("k1", "k2").agg(F.min("doc_id").alias("doc_id"))
    wanted = wanted.join(one, ["k1", "k2"]).withColumnRenamed("doc_id", "_one")
    pieces = scratch.put(_pieces(keyed, wanted, length, gram), "pieces")
    spans = scratch.put(repeats(scratch, pieces, length, large), "spans")

    whole = kinds.where("copies > 1").select(*KEY, F.array(F.struct(F.lit(0).cast("long").alias("a"), F.col("n").alias("b"))).alias("spans"), "copies")
    part = spans.join(kinds.where("copies = 1").select(*KEY, "copies"), KEY)
    found = scratch.put(whole.unionByName(part.select(whole.columns)), "found")
    hits = spread_join(every.select("k1", "k2", "start", *KEY), found, KEY, "copies")
    hits = hits.select("k1", "k2", "start", "spans").dropDuplicates(["k1", "k2", "start"])
    hits = hits.groupBy("k1", "k2").agg(F.flatten(F.collect_list(F.transform("spans", lambda s: F.struct((s["a"] + F.col("start")).alias("a"), (s["b"] + F.col("start")).alias("b"))))).alias("spans"))
    hits = scratch.put(hits, "intervals")
    scratch.keep("intervals")
    return _cut(keyed.join(hits, ["k1", "k2"], "left").select("doc_id", "text", "spans"), length)
