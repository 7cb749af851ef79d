"""Near-duplicates by a chosen-path set similarity join on word shingles.

1. Each text becomes its set of distinct five-word shingles (64-bit hashes of its words' BLAKE2 hashes), 128 minwise
   tokens of 32 bits, a sketch of two bits of each, and a 128-bit digest of the set, from two independent families of
   hashes. Texts with equal digests are one from here on (pre-aggregated), under a name that begins with their least id.
2. Chosen paths (Christiani, Pagh and Sivertsen, 2018): in each of ``trees`` independent trees a set goes down the
   branches of minwise tokens that its node selects, 4/3 of them on average, to the child named by the token's value.
   A node of up to ``limit`` sets is compared exhaustively by sketches.
3. A larger node is never gathered. A few pivots are drawn from it; the sets alike to the largest group of pivots are
   tied to it, each by one pair. If up to ``limit`` sets remain, they are compared with the whole node in blocks, else
   all go on to the node's children. Sets that remain differ from the pivots in a third of their tokens or more, so
   branching parts them, and it goes on until no node is open; there is no depth at which pairs are given up.
4. Pairs whose sketches agree four standard errors below the threshold make candidate components. Only a spanning
   forest of each node's pairs is kept, never all pairs.
5. Inside a candidate component of up to ``block`` sets every pair that the sketches allow, and that links don't
   connect yet, is confirmed on the full sets, and each link on the shingles themselves. Larger components are dealt
   into blocks that share pivots. If up to ``parts`` * ``block`` sets then lie outside the component's largest class,
   they are compared with all of its blocks; if more do, steps 2 and 3 are taken inside the component, with the classes found so
   far in the pivots' stead and full sets compared in the nodes. Either way a text is copied a bounded number of times.
6. Classes are the connected components of the confirmed links. They are named by their least set, whose name holds the
   least id, so rows are never gathered or joined by class.

Words are ``[^\\x20\\x09-\\x0D]+`` after A-Z are lower-cased; a text with one to four words has one shingle, the whole
sequence. Null, empty and blank texts have no shingles, are linked with nothing and are their own class. Rows with a
null id belong to their text's class but never name it. Repeated rows are in one class. A very long text is one set
like any other; its bucket holds up to ``block`` texts. Ties between candidate pairs are taken in an order fixed by
names. An empty table gives no rows. Extra columns are ignored by ``classes`` and kept by ``keep_one``, whatever their
names.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from motifline.llm.common import SPACE, Scratch, fresh, mix64, random_words, release, slices, spread_join, word_hashes, words
from motifline.llm.graph import components

SHINGLE, TOKENS = 5, 128
CASE = np.arange(256, dtype=np.uint8)
CASE[65:91] += 32
XOR, TIMES = (random_words(TOKENS, 5) >> np.uint64(32)).astype(np.uint32), (random_words(TOKENS, 6) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
SETS = "doc_id long, n_shingles long, set binary, tokens binary, key long"


def _chained(word: np.ndarray, n_words: np.ndarray) -> list[np.ndarray]:
    """Each text's distinct shingle hashes, sorted, from its words' hashes."""
    first = np.cumsum(n_words) - n_words
    m = max(0, len(word) - SHINGLE + 1)
    h = np.full(m, 77, np.uint64)
    for k in range(SHINGLE):
        h = mix64(h * np.uint64(3) + word[k : k + m])
    out = []
    for at, n in zip(first.tolist(), n_words.tolist()):
        if n >= SHINGLE:
            out.append(np.unique(h[at : at + n - SHINGLE + 1]))
        elif n:
            x = np.full(1, n, np.uint64)
            for k in range(n):
                x = mix64(x * np.uint64(5) + word[at + k])
            out.append(x)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def shingles(data: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """Each text's distinct shingle hashes, sorted."""
    return shingles_and_digests(data, starts, False)[0]


def shingles_and_digests(data: np.ndarray, starts: np.ndarray, digests: bool = True) -> tuple[list[np.ndarray], list[bytes]]:
    """Also 16 bytes for each text that depend on its set alone."""
    data = CASE[data]
    begin, end, n_words = words(data, starts)
    word = word_hashes(data, begin, end)
    one = _chained(word[:, 0], n_words)
    if not digests:
        return one, []
    two = _chained(word[:, 1], n_words)
    return one, [np.array([mix64(a + np.uint64(11)).sum(dtype=np.uint64), mix64(b + np.uint64(13)).sum(dtype=np.uint64)], "<u8").tobytes() for a, b in zip(one, two)]


def exact_shingles(text: bytes) -> set:
    """The shingles themselves, as tuples of words."""
    w = [x for x in text.translate(_SPLIT).split(b" ") if x]
    return set(zip(*[w[k:] for k in range(SHINGLE)])) if len(w) >= SHINGLE else {tuple(w)}


_SPLIT = bytes(32 if SPACE[b] else int(CASE[b]) for b in range(256))


def minwise(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, TOKENS) minwise tokens; all ones for an empty set."""
    n = np.array([len(s) for s in sets])
    out = np.full((len(sets), TOKENS), 0xFFFFFFFF, np.uint32)
    if not n.sum():
        return out
    full = n > 0
    h = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    at = (np.cumsum(n) - n)[full]
    for k in range(TOKENS):
        out[full, k] = np.minimum.reduceat((h ^ XOR[k]) * TIMES[k], at)
    return out


def sketch(tokens: np.ndarray) -> np.ndarray:
    """(n, 4) words that hold two bits of each of the 128 tokens."""
    two = ((tokens * np.uint32(0x9E3779B1)) >> np.uint32(30)).astype(np.uint64).reshape(-1, 4, 32)
    return (two << (2 * np.arange(32, dtype=np.uint64))).sum(axis=2, dtype=np.uint64)


def agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many of the 128 two-bit tokens agree."""
    x = a ^ b
    x = (x | x >> np.uint64(1)) & np.uint64(0x5555555555555555)
    return TOKENS - np.bitwise_count(x).sum(axis=-1).astype(np.int64)


def least_agreeing(threshold: float) -> int:
    p = threshold + (1 - threshold) / 4
    return math.floor(TOKENS * (p - 4 * math.sqrt(p * (1 - p) / TOKENS)))


def key_of() -> Column:
    """Tells texts apart."""
    return F.xxhash64(F.col("text").cast("string"))


def describe(docs: DataFrame) -> DataFrame:
    def rows(batches):
        for batch in batches:
            for own, data, starts in slices(batch):
                sets, digests = shingles_and_digests(data, starts)
                tokens = minwise(sets)
                columns = [own.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array([t.tobytes() if len(s) else None for s, t in zip(sets, tokens)], pa.binary()), own.column(2)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "set", "tokens", "key"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), key_of().alias("key")).mapInArrow(rows, SETS)


FLIP = -(1 << 63)


def _name(doc_id: Column, set_: Column) -> Column:
    """25 bytes in the order of (doc_id, nulls last; set)."""
    id_ = F.when(doc_id.isNull(), F.lit("01" + "00" * 8)).otherwise(F.concat(F.lit("00"), F.lpad(F.hex(doc_id.bitwiseXOR(F.lit(FLIP))), 16, "0")))
    return F.concat(F.unhex(id_), set_)


def _id_of(name: Column) -> Column:
    """The id that a name begins with."""
    text = F.hex(name)
    return F.when(F.substring(text, 1, 2) == "00", F.conv(F.substring(text, 3, 16), 16, -10).cast("long").bitwiseXOR(F.lit(FLIP)))


def _sketched(rows: DataFrame) -> DataFrame:
    """One row for each set: its name, the row it is taken from (least id, then key), its tokens and rows."""
    out = rows.groupBy("set").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("_r"), F.min("tokens").alias("tokens"), F.count("*").alias("copies"))
    return out.select("set", _name(F.col("_r.doc_id"), F.col("set")).alias("name"), F.col("_r.doc_id").alias("rep"), F.col("_r.key").alias("rep_key"), "tokens", "copies")


def _tokens(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, TOKENS)


def _branches(path: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The positions that nodes select: row numbers of ``path`` and positions, one or (in a third of the nodes) two for each."""
    h = mix64(path ^ np.uint64(0x5851F42D4C957F2D))
    one = (h % np.uint64(TOKENS)).astype(np.int64)
    step = (h >> np.uint64(20)) % np.uint64(TOKENS - 1)
    two = (one + 1 + step.astype(np.int64)) % TOKENS
    more = np.flatnonzero((h >> np.uint64(40)) % np.uint64(3) == 0)
    return np.r_[np.arange(len(path)), more], np.r_[one, two[more]]


def _child(path: np.ndarray, position: np.ndarray, value: np.ndarray) -> np.ndarray:
    return mix64(path + mix64(position.astype(np.uint64) << np.uint64(32) | value.astype(np.uint64)))


NODES = "path long, name binary, sketch binary, class binary"


def _node_batch(path, names: pa.Array, sk: np.ndarray, classes: pa.Array, which: np.ndarray) -> pa.RecordBatch:
    raw, take = sk.astype("<u8").tobytes(), pa.array(which)
    return pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), names.take(take), pa.array([raw[32 * i : 32 * i + 32] for i in which.tolist()], pa.binary()), classes.take(take)], ["path", "name", "sketch", "class"])


def roots(sets: DataFrame, trees: int, seed: int) -> DataFrame:
    """The first level of every tree. sets: name, tokens, class, and salt, which tells forests apart."""

    def rows(batches):
        start = random_words(trees, 1000 + seed)
        for batch in batches:
            tokens, n = _tokens(batch.column(1)), batch.num_rows
            if not n:
                continue
            path = mix64(start[:, None] + batch.column(3).to_numpy().view(np.uint64)[None, :]).ravel()
            row, position = _branches(path)
            which = row % n
            yield _node_batch(_child(path[row], position, tokens[which, position]), batch.column(0), sketch(tokens), batch.column(2), which)
        release()

    return sets.select("name", "tokens", "class", "salt").mapInArrow(rows, NODES)


def deeper(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """The children of ``nodes``."""

    def rows(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            path, tokens = batch.column(0).to_numpy().view(np.uint64), _tokens(batch.column(2))
            which, position = _branches(path)
            yield _node_batch(_child(path[which], position, tokens[which, position]), batch.column(1), sketch(tokens), batch.column(3), which)
        release()

    return _few(nodes.select("path", "name", "class")).join(sets.select("name", "tokens"), "name").select("path", "name", "tokens", "class").mapInArrow(rows, NODES)


def forest(sk: np.ndarray, least: int, label: np.ndarray | None = None):
    """A spanning forest of the pairs that agree in ``least`` tokens: (i, j). Rows with one label are connected already."""
    n = len(sk)
    label = np.arange(n) if label is None else label
    for i in range(n - 1):
        other = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
        if not len(other):
            continue
        other = other[agreeing(sk[other], sk[i]) >= least]
        found, at = np.unique(label[other], return_index=True)
        for one, j in zip(found.tolist(), other[at].tolist()):
            yield i, j
            label[label == one] = label[i]


def _groups(batches, key: int):
    """Runs of equal keys of batches that are sorted by it, as tables; a run may span batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key).to_numpy(zero_copy_only=False)
        cut = np.flatnonzero(k[1:] != k[:-1]) + 1
        if held and held[-1].column(key)[-1].as_py() != k[0]:
            yield pa.Table.from_batches(held)
            held = []
        if len(cut):
            yield pa.Table.from_batches([*held, batch.slice(0, int(cut[-1]))])
            held = [batch.slice(int(cut[-1]))]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)
    held.clear()
    release()


def compare(rows: DataFrame, least: int) -> DataFrame:
    """Candidate pairs (a, b) of buckets that each fit in a task. rows: bucket, name, sketch, main (these are tied already)."""

    def pairs(batches):
        for table in _groups(batches, 0):
            bucket = table.column(0).to_numpy()
            names = table.column(1).to_pylist()
            sk = np.frombuffer(b"".join(table.column(2).to_pylist()), "<u8").reshape(-1, 4)
            main = table.column(3).to_numpy()
            edge = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
            size = np.diff(edge)
            two = edge[:-1][size == 2]
            two = two[agreeing(sk[two], sk[two + 1]) >= least]
            a, b = [names[i] for i in two.tolist()], [names[i + 1] for i in two.tolist()]
            for at, n in zip(edge[:-1][size > 2].tolist(), size[size > 2].tolist()):
                label = np.where(main[at : at + n], n, np.arange(n))
                for i, j in forest(sk[at : at + n], least, label):
                    a.append(names[at + i])
                    b.append(names[at + j])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    return rows.select("bucket", "name", "sketch", "main").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(pairs, "a binary, b binary")


def _few(df: DataFrame, most: int = 100_000) -> DataFrame:
    """``df`` marked for broadcast if it has ``most`` rows at most."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def descend(scratch: Scratch, nodes: DataFrame, sets: DataFrame, limit: int, judge: Callable[[DataFrame, int], DataFrame], name: str, rounds: int = 500) -> list[DataFrame]:
    """Tables of buckets (bucket, name, sketch, class, main) of about ``limit`` rows to 2 * ``limit`` that hold all nodes' comparisons.

    ``judge`` makes a table of the rows of nodes beyond ``limit`` with ``main``: rows of a node's main part need no comparison with
    each other. Nodes whose other rows are more than ``limit`` go on to their children.
    """
    out, keep = [], ["bucket", "name", "sketch", "class", "main"]
    for level in range(1, rounds + 1):
        big = scratch.put(nodes.groupBy("path").agg(F.count("*").alias("_n")).where(F.col("_n") > limit), f"{name}-big{level}")
        some = bool(big.limit(1).count())
        small = nodes.join(_few(big.select("path")), "path", "left_anti") if some else nodes
        out.append(small.withColumn("main", F.lit(False)).withColumnRenamed("path", "bucket").select(keep))
        if not some:
            return out
        judged = judge(scratch.put(nodes.join(_few(big.select("path")), "path", "left_semi"), f"{name}-large{level}"), level)
        rest = judged.groupBy("path").agg(F.count("*").alias("_n"), F.count(F.when(~F.col("main"), 1)).alias("_r")).where("_r > 0")
        rest = scratch.put(rest, f"{name}-rest{level}")
        near = spread_join(judged, rest.where(F.col("_r") <= limit), ["path"], "_n")
        blocks = F.ceil(F.col("_n") / limit).cast("long")
        own = F.pmod(F.xxhash64("name", "path"), blocks)
        every = F.sequence(F.lit(0).cast("long"), blocks - 1)
        dealt = near.withColumn("_block", F.explode(F.when(F.col("main"), F.array(own)).otherwise(every)))
        out.append(dealt.withColumn("bucket", F.xxhash64("path", "_block")).select(keep))
        far = rest.where(F.col("_r") > limit)
        if not far.limit(1).count():
            return out
        nodes = scratch.put(deeper(judged.join(_few(far.select("path")), "path", "left_semi"), sets), f"{name}-nodes{level + 1}")
    raise RuntimeError(f"nodes are still open after {rounds} levels")


def _settle(least: int):
    """Pivots of each node with the part that they are in, and whether it is the largest."""
    kind = pa.list_(pa.struct([("name", pa.binary()), ("sketch", pa.binary()), ("part", pa.int32())]))

    def rows(batches):
        for batch in batches:
            pivots, main, a, b = [], [], [], []
            for found in batch.column(2).to_pylist():
                found = list({p["name"]: p for p in found}.values())
                sk = np.frombuffer(b"".join(p["sketch"] for p in found), "<u8").reshape(-1, 4)
                label = np.arange(len(found))
                pairs = list(forest(sk, least, label))
                a.append([found[i]["name"] for i, _ in pairs])
                b.append([found[j]["name"] for _, j in pairs])
                pivots.append([{"name": p["name"], "sketch": p["sketch"], "part": int(k)} for p, k in zip(found, label)])
                main.append(int(np.bincount(label).argmax()))
            lists = pa.list_(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pivots, kind), pa.array(main, pa.int32()), pa.array(a, lists), pa.array(b, lists)], ["path", "_n", "pivots", "main", "a", "b"])

    return rows


def _tied(least: int):
    """Of each row, whether it is alike to a pivot of the main part, and one alike pivot of each part."""

    def rows(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(4)
            size = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten()
            sk = np.frombuffer(b"".join(flat.field("sketch").to_pylist()), "<u8").reshape(-1, 4)
            row = np.repeat(np.arange(batch.num_rows), size)
            own = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<u8").reshape(-1, 4)
            alike = np.flatnonzero(agreeing(sk, own[row]) >= least)
            part, at = flat.field("part").to_numpy()[alike], row[alike]
            _, first = np.unique(at.astype(np.int64) << 32 | part, return_index=True)
            main = np.zeros(batch.num_rows, bool)
            main[at[part == batch.column(5).to_numpy()[at]]] = True
            near = pa.ListArray.from_arrays(pa.array(np.searchsorted(at[first], np.arange(batch.num_rows + 1)), pa.int32()), flat.field("name").take(pa.array(alike[first])))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), pa.array(main), near], [*(f.split()[0] for f in NODES.split(", ")), "main", "near"])

    return rows


def candidates(scratch: Scratch, sets: DataFrame, trees: int, limit: int, least: int, seed: int, pivots: int) -> DataFrame:
    """Pairs (a, b) that connect what the trees' nodes hold to be alike; repeats among them."""
    found = []

    def judge(large: DataFrame, level: int) -> DataFrame:
        least_by = lambda k: F.min(F.struct(F.xxhash64("name", "path", F.lit(k)).alias("h"), "name", "sketch"))
        lead = large.groupBy("path").agg(F.count("*").alias("_n"), *[least_by(k).alias(f"_p{k}") for k in range(pivots)])
        lead = lead.select("path", "_n", F.array(*[F.struct(F.col(f"_p{k}.name").alias("name"), F.col(f"_p{k}.sketch").alias("sketch")) for k in range(pivots)]).alias("pivots"))
        lead = scratch.put(lead, f"lead{level}")  # few rows, which few workers read
        lead = scratch.put(lead.mapInArrow(_settle(least), "path long, _n long, pivots array<struct<name:binary,sketch:binary,part:int>>, main int, a array<binary>, b array<binary>"), f"pivots{level}")
        found.append(lead.select(F.explode(F.arrays_zip("a", "b")).alias("e")).select("e.a", "e.b"))
        rows = spread_join(large, lead.select("path", "_n", "pivots", F.col("main").alias("_main")), ["path"], "_n")
        rows = rows.select("path", "name", "sketch", "class", "pivots", "_main").mapInArrow(_tied(least), f"{NODES}, main boolean, near array<binary>")
        rows = scratch.put(rows, f"tied{level}")
        found.append(rows.select(F.col("name").alias("a"), F.explode("near").alias("b")).where("a <> b"))
        return rows.drop("near")

    nodes = roots(sets.withColumns({"class": F.lit(None).cast("binary"), "salt": F.lit(0).cast("long")}), trees, seed)
    buckets = descend(scratch, nodes, sets, limit, judge, "tree")
    return _all([*found, scratch.put(compare(_all(buckets), least), "pairs")])  # of all levels at once: paths tell them apart


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def confirm(rows: DataFrame, threshold: float, least: int) -> DataFrame:
    """Links (a, b) inside each bucket, confirmed on the full sets, as few as connect what they connect.

    rows: bucket, name, sketch, text, class and side. Pairs of one class are connected already. Rows of side 1 are only
    compared with those of sides 2 and 3, where a row of side 3 is of side 1 in another bucket; of side 0, all pairs.
    """
    percent = round(threshold * 100)

    def links(batches):
        for table in _groups(batches, 0):
            edges = np.flatnonzero(np.r_[True, (k := table.column(0).to_numpy())[1:] != k[:-1], True])
            a, b = [], []
            for at, to in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if to - at > 1:
                    for x, y in _confirmed(table.slice(at, to - at), percent, least):
                        a.append(x)
                        b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    return rows.select("bucket", "name", "sketch", "text", "class", "side").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(links, "a binary, b binary")


def _confirmed(table: pa.Table, percent: int, least: int):
    table = table.combine_chunks()
    names, texts, own = table.column("name").to_pylist(), table.column("text"), []
    _, label = np.unique(np.array(table.column("class").to_pylist(), dtype="S25"), return_inverse=True)
    if label.max() == 0:
        return
    for batch in table.to_batches():
        for _, data, starts in slices(batch):
            own += shingles(data, starts)
    sk = np.frombuffer(b"".join(table.column("sketch").to_pylist()), "<u8").reshape(-1, 4)
    size, side = np.array([len(s) for s in own]), table.column("side").to_numpy()
    order = np.argsort(np.argsort(np.array(names, dtype="S25")))
    exact = lambda i: exact_shingles(texts[i].as_py().encode())
    for i in range(len(names)):
        if side[i] == 0:
            other = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
        elif side[i] == 1:
            other = np.flatnonzero((label != label[i]) & ((side == 2) | ((side == 3) & (order > order[i]))))
        else:
            continue
        other = other[100 * np.minimum(size[other], size[i]) >= percent * np.maximum(size[other], size[i])]
        agree = agreeing(sk[other], sk[i])
        other, agree = other[agree >= least], agree[agree >= least]
        mine = None
        for j in other[np.argsort(-agree, kind="stable")].tolist():
            if label[j] == label[i]:
                continue
            both = np.concatenate([own[i], own[j]])
            both.sort()
            inter = int((both[1:] == both[:-1]).sum())
            if 100 * inter >= percent * (size[i] + size[j] - inter):
                mine, other_ = mine or exact(i), exact(j)
                inter = len(mine & other_)
                if 100 * inter >= percent * (len(mine) + len(other_) - inter):
                    yield names[i], names[j]
                    label[label == label[j]] = label[i]


def by_class(scratch: Scratch) -> Callable[[DataFrame, int], DataFrame]:
    """Of each node the rows of its most frequent class are its main part."""

    def judge(large: DataFrame, level: int) -> DataFrame:
        count = large.groupBy("path", "class").agg(F.count("*").alias("_c"))
        most = count.groupBy("path").agg(F.max(F.struct("_c", "class")).alias("_most"), F.sum("_c").alias("_n")).select("path", "_n", F.col("_most.class").alias("_main"))
        rows = spread_join(large, scratch.put(most, f"inner-classes{level}"), ["path"], "_n")
        return scratch.put(rows.select("path", "name", "sketch", "class", (F.col("class") == F.col("_main")).alias("main")), f"inner-judged{level}")

    return judge


def linked(spark: SparkSession, docs: DataFrame, threshold: float = 0.75, trees: int = 10, limit: int = 1000, block: int = 500, parts: int = 8, pivots: int = 6, seed: int = 0) -> tuple[Scratch, DataFrame, DataFrame]:
    """docs (doc_id, text) to its scratch folder, a row for each row (doc_id, n_shingles, key, set), and one for each set: set, name, rep, rep_key, copies and root, the name of its class."""
    scratch, least = Scratch(spark, "near-dup"), least_agreeing(threshold)
    described = scratch.put(describe(docs), "described", compression="lz4")
    sets = scratch.put(_sketched(described.where("n_shingles > 0")), "sets", compression="lz4")
    pairs = candidates(scratch, sets, trees, limit, least, seed, pivots)
    groups = components(scratch, pairs, "groups").select(F.col("node").alias("name"), F.col("root").alias("group"))
    wide = scratch.put(groups.groupBy("group").agg(F.count("*").alias("_n")).where(F.col("_n") > block), "wide")  # groups of several blocks
    some_wide = bool(wide.limit(1).count())
    members = sets.select("name", "rep", "rep_key", "tokens").join(groups, "name")
    if some_wide:
        size = scratch.put(spread_join(groups, wide, ["group"], "_n").select("name", "_n"), "sizes")
        members = members.join(size, "name", "left")
    else:
        members = members.withColumn("_n", F.lit(None).cast("long"))
    # the texts of candidates alone: one for each set
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), key_of().alias("key"))
    texts = whole.join(members, F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("key") == F.col("rep_key")))
    texts = scratch.put(_with_sketch(texts.select("name", "group", "_n", "tokens", "text")), "texts")

    # blocks of a group, and in groups of several blocks the pivots in each
    blocks = F.coalesce(F.ceil(F.col("_n") / block), F.lit(1)).cast("long")
    own, every = F.pmod(F.xxhash64("name"), blocks), F.sequence(F.lit(0).cast("long"), blocks - 1)
    rows = texts.withColumn("_block", own).select("name", "group", "sketch", "text", "_block")
    if some_wide:
        large = texts.where("_n IS NOT NULL")
        order = F.xxhash64("name", F.lit(7))
        pivot = large.groupBy("group", F.pmod(order, F.lit(8)).alias("_slot")).agg(F.min(order).alias("_order")).select("group", "_order")
        common = large.withColumn("_order", order).join(_few(pivot), ["group", "_order"], "left_semi")
        common = common.withColumn("_block", F.explode(every)).where(F.col("_block") != own)
        rows = rows.unionByName(common.select(rows.columns))
    links = scratch.put(confirm(rows.withColumn("bucket", F.xxhash64("group", "_block")).withColumn("class", F.col("name")).withColumn("side", F.lit(0)), threshold, least), "links")
    found = components(scratch, links, "linked")

    if some_wide:  # what lies outside the largest class of its group
        placed = large.select("name", "group", "_n", "sketch").join(found.withColumnRenamed("node", "name"), "name", "left")
        placed = scratch.put(placed.select("name", "group", "sketch", "_n", F.coalesce("root", "name").alias("class")), "placed")
        count = placed.groupBy("group", "_n", "class").agg(F.count("*").alias("_c"))
        most = count.groupBy("group", "_n").agg(F.max(F.struct("_c", "class")).alias("_most"), F.sum("_c").alias("_all"))
        most = scratch.put(most.select("group", "_n", F.col("_most.class").alias("_main"), (F.col("_all") - F.col("_most._c")).alias("_r")).where("_r > 0"), "rest")
        if most.limit(1).count():
            slim = placed.drop("_n")
            # the rest in parts, each against all blocks: up to ``parts`` + 1 copies of a text on average
            fits, cut = F.col("_r") <= parts * block, F.ceil(F.col("_r") / block).cast("long")
            few = scratch.put(spread_join(slim, most.where(fits), ["group"], "_n"), "few")
            part, outside = F.pmod(F.xxhash64("name", F.lit(3)), cut), F.col("class") != F.col("_main")
            rest = few.where(outside).withColumn("_part", part).withColumn("_block", F.explode(every)).withColumn("side", F.lit(1))
            whole_ = few.withColumn("_block", own).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), cut - 1))).withColumn("side", F.when(outside, 3).otherwise(2))
            at = ["group", "_block", "_part", "name", "class", "side"]
            dealt = [rest.select(at).unionByName(whole_.select(at)).withColumn("bucket", F.xxhash64("group", "_block", "_part", F.lit("rest"))).select("bucket", "name", "class", "side")]
            many = scratch.put(spread_join(slim, most.where(~fits), ["group"], "_n").select("name", "class", F.xxhash64("group").alias("salt")), "many")
            if many.limit(1).count():
                nodes = scratch.put(roots(many.join(sets.select("name", "tokens"), "name"), trees, seed + 1), "inner-nodes1")
                for part in descend(scratch, nodes, sets, block, by_class(scratch), "inner"):
                    dealt.append(part.select("bucket", "name", "class", F.lit(0).alias("side")))
            buckets = scratch.put(_all(dealt), "buckets")
            open_ = buckets.groupBy("bucket").agg(F.min("class").alias("a"), F.max("class").alias("b")).where("a <> b").select("bucket")
            buckets = buckets.join(open_, "bucket")
            rows = texts.select("name", "sketch", "text").join(buckets, "name")
            more = scratch.put(confirm(rows, threshold, least), "more-links")
            found = components(scratch, links.union(more), "relinked")

    classed = sets.drop("tokens").join(found.withColumnRenamed("node", "name"), "name", "left").withColumn("root", F.coalesce("root", "name"))
    return scratch, described.select("doc_id", "n_shingles", "key", "set"), scratch.put(classed, "classed")


def classes(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """docs (doc_id, text) to doc_id, n_shingles, component_id (the class's least id) and kept (the row that names its class)."""
    scratch, rows, classed = linked(spark, docs, **options)
    own = spread_join(rows.where("n_shingles > 0"), classed.select("set", "copies", _id_of(F.col("root")).alias("component_id")), ["set"], "copies")
    out = own.select("doc_id", "n_shingles", "component_id").unionByName(rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    scratch.keep("described", "classed")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def _with_sketch(rows: DataFrame) -> DataFrame:
    def add(batches):
        for batch in batches:
            if batch.num_rows:
                raw = sketch(_tokens(batch.column(3))).astype("<u8").tobytes()
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array([raw[i : i + 32] for i in range(0, len(raw), 32)], pa.binary()), batch.column(4)], ["name", "group", "_n", "sketch", "text"])

    return rows.mapInArrow(add, "name binary, group binary, _n long, sketch binary, text string")


def keep_one(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """One row of each class, that of its least id (null ids last), then of its least text hash, with all its columns.

    Blank texts are classes of their own; rows with neither an id nor a text go.
    """
    scratch, rows, classed = linked(spark, docs.select("doc_id", "text"), **options)
    id_, key, many = fresh(docs, "_id", "_key", "_many")
    firsts = classed.where("name = root").select(F.col("rep").alias("doc_id"), F.col("rep_key").alias("key")).unionByName(rows.where("n_shingles = 0").select("doc_id", "key").distinct())
    again = rows.groupBy("doc_id", "key").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("i"), F.col("key").alias("k"))
    firsts = firsts.join(again, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("key") == F.col("k")), "left")
    firsts = scratch.put(firsts.select(F.col("doc_id").alias(id_), F.col("key").alias(key), F.col("k").isNotNull().alias(many)), "firsts")
    scratch.keep("firsts")
    some = docs.where(F.col("doc_id").isNotNull() | F.col("text").isNotNull())
    kept = some.join(firsts, some["doc_id"].cast("long").eqNullSafe(F.col(id_)) & (key_of() == F.col(key)))
    one = kept.where(~F.col(many)).unionByName(kept.where(many).dropDuplicates(["doc_id", "text"]))
    return one.select(*docs.columns)
