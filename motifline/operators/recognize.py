"""Recognition: matches of a pattern in an event table.

An event table has id, ts (long), event_type and the pattern's attributes; is_reset is optional. Order is (ts, id)
within each value of the pattern's partition attribute.

``matches`` lists every match with its events and picks the cheapest plan that can: one window pass (``lag_chain``,
``next_chain``), range joins (``range_join``), or runs folded over the sorted stream (``run_fold``). ``label`` runs
the deterministic automaton and gives each event its state; ``detections`` are its final states.

Folds read a partition's events as a sorted stream and keep only the automaton's state, never a partition's rows.
``label`` can also cut a long partition into chunks of time: an automaton's moves compose, so each chunk gives a
map from entry to exit states, maps are chained, and a second pass labels all chunks at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import accumulate, product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from motifline.functions import predicates as P
from motifline.plans import ast
from motifline.plans.automaton import TAKE, Nfa
from motifline.plans.compiled import CompiledPattern

MATCH = "pattern_id int, part string, match_ts long, end_id long, events array<long>, first_counter long, last_counter long"
WHOLE = "$"  # the partition's name where a pattern has no partition attribute
TASK_ROWS = 200_000  # events that one task sorts, about


def _part(pattern: ast.Pattern) -> Column:
    return F.col(pattern.partition_by).cast("string") if pattern.partition_by else F.lit(WHOLE)


def dealt(df: DataFrame, by: str, rows: int = TASK_ROWS) -> DataFrame:
    """The events, with ``by`` as a string, dealt by it so that a task gets about ``rows`` of them.

    Patterns that partition by it need no shuffle of their own then, and what their sorts hold depends neither on the
    input's size nor on the session's number of shuffle partitions.
    """
    n = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))
    return df.withColumn(by, F.col(by).cast("string")).repartition(n, by)


def _clean(df: DataFrame, pattern: ast.Pattern) -> DataFrame:
    """With _part and _epoch; reset events end an epoch and go."""
    out = df.withColumn("_part", _part(pattern))
    if "is_reset" not in df.columns:
        return out.withColumn("_epoch", F.lit(0).cast("long"))
    order = Window.partitionBy("_part").orderBy("ts", "id")
    return out.withColumn("_epoch", F.sum(F.col("is_reset").cast("long")).over(order)).where(~F.coalesce("is_reset", F.lit(False)))


def _order() -> Window:
    return Window.partitionBy("_part", "_epoch").orderBy("ts", "id")


def _bounds(df: DataFrame, rows: int) -> list[tuple[int, int]]:
    """Places (ts, id) that cut a stream into stretches of about ``rows`` events; one event in ``rows`` / 100 is drawn to
    find them. Results don't depend on where they lie."""
    n = df.count()
    k = -(-n // rows)
    if k < 2:
        return []
    drawn = sorted(tuple(r) for r in df.select("ts", "id").dropna().sample(fraction=min(1.0, 100 * k / n), seed=1).collect())
    return sorted({drawn[len(drawn) * i // k] for i in range(1, k)}) if drawn else []


def _stretched(df: DataFrame, bounds: list[tuple[int, int]]) -> DataFrame:
    """With _stretch, the number of bounds at or before the event, by halving."""
    ts, ids = (F.array(*[F.lit(b[k]).cast("long") for b in bounds]) for k in (0, 1))
    df = df.withColumn("_stretch", F.lit(0))
    for k in reversed(range(len(bounds).bit_length())):
        at = F.col("_stretch") + ((1 << k) - 1)
        ts_, id_ = F.get(ts, at), F.get(ids, at)
        passed = F.coalesce((F.col("ts") > ts_) | ((F.col("ts") == ts_) & (F.col("id") >= id_)), F.lit(False))
        df = df.withColumn("_stretch", F.col("_stretch") + F.when(passed, 1 << k).otherwise(0))
    return df


def _counted(df: DataFrame, pattern: ast.Pattern, stretch: int) -> tuple[DataFrame, int]:
    """With _part, _epoch and _cnt, the event's number in its partition; reset events go. And the number of stretches.

    A stream without partitions of more than ``stretch`` events is numbered in stretches of time, dealt over tasks: places
    in a stretch plus the events before it.
    """
    bounds = [] if pattern.partition_by else _bounds(df, stretch)
    if not bounds:
        return _clean(df, pattern).withColumn("_cnt", F.row_number().over(Window.partitionBy("_part").orderBy("ts", "id")).cast("long")), 1
    reset = F.coalesce("is_reset", F.lit(False)) if "is_reset" in df.columns else F.lit(False)
    rows = _stretched(df.withColumn("_part", _part(pattern)).withColumn("_reset", reset.cast("long")), bounds)
    sizes = {r["_stretch"]: r for r in rows.groupBy("_stretch").agg(F.sum(1 - F.col("_reset")).alias("n"), F.sum("_reset").alias("resets")).collect()}

    def before(what: str) -> Column:
        sums = accumulate((sizes[k][what] if k in sizes else 0 for k in range(len(bounds))), initial=0)
        return F.get(F.array(*[F.lit(x).cast("long") for x in sums]), F.col("_stretch"))

    w = Window.partitionBy("_stretch").orderBy("ts", "id")
    rows = rows.repartition(2 * len(sizes), "_stretch")
    epoch = F.sum("_reset").over(w) + before("resets") if "is_reset" in df.columns else F.lit(0).cast("long")
    rows = rows.withColumn("_epoch", epoch).where("_reset = 0")
    return rows.withColumn("_cnt", F.row_number().over(w) + before("n")).drop("_reset"), len(sizes)


def _blocks(rows: DataFrame, n: int, stretch: int, longest: int) -> DataFrame:
    """With _block, ``stretch`` numbers each; the last events of a block come once more, not _own, before the next one's."""
    size = max(stretch, longest)
    at, block = (F.col("_cnt") - 1) % size, F.floor((F.col("_cnt") - 1) / size)
    blocks = F.when(at > size - longest, F.array(block, block + 1)).otherwise(F.array(block))
    return rows.withColumn("_block", F.explode(blocks)).withColumn("_own", F.col("_block") == block).repartition(2 * n, "_block")


def _match(c: CompiledPattern, ts, end, events, first, last) -> list[Column]:
    return [F.lit(c.pattern_id).alias("pattern_id"), F.col("_part").alias("part"), ts.alias("match_ts"), end.alias("end_id"), events.alias("events"), first.alias("first_counter"), last.alias("last_counter")]


# --- which plan ---------------------------------------------------------------------------------------------------
def _branches(formula) -> list[tuple] | None:
    """A choice- and sequence-only formula as sequences of events; None for any other."""
    if isinstance(formula, ast.Event):
        return [(formula,)]
    if isinstance(formula, ast.Alt):
        parts = [_branches(p) for p in formula.parts]
        return None if None in parts else [b for p in parts for b in p]
    if isinstance(formula, ast.Seq):
        parts = [_branches(p) for p in formula.parts]
        return None if None in parts else [tuple(e for b in bs for e in b) for bs in product(*parts)]
    return None


def _plain(formula) -> tuple | None:
    """A sequence of single events."""
    if isinstance(formula, ast.Event):
        return (formula,)
    return tuple(formula.parts) if isinstance(formula, ast.Seq) and all(isinstance(p, ast.Event) for p in formula.parts) else None


def _refs(sentence) -> set[str]:
    return {x.register for a in ast.atoms(sentence) for x in a.args if isinstance(x, ast.Ref)}


def strategy(c: CompiledPattern) -> str:
    f, plain = c.pattern.formula, None
    if _branches(f) is not None:
        return "lag_chain"
    if isinstance(f, (ast.SkipAny, ast.SkipNext)):
        plain = _plain(f.part)
    if plain and isinstance(f, ast.SkipNext) and not any(e.store or _refs(e.sentence) for e in plain):
        return "next_chain"
    if plain and isinstance(f, ast.SkipAny) and all(not _refs(e.sentence) - {x.store for x in plain[:k]} for k, e in enumerate(plain)):
        return "range_join"
    return "run_fold"


def matches(df: DataFrame, c: CompiledPattern, how: str | None = None, **options) -> DataFrame:
    """(pattern_id, part, match_ts, end_id, events, first_counter, last_counter), one row a match."""
    return {"lag_chain": lag_chain, "next_chain": next_chain, "range_join": range_join, "run_fold": run_fold}[how or strategy(c)](df, c, **options)


def all_matches(df: DataFrame, patterns: list[CompiledPattern], **options) -> DataFrame:
    out = matches(df, patterns[0], **options)
    for c in patterns[1:]:
        out = out.unionByName(matches(df, c, **options))
    return out


def end_points(found: DataFrame) -> DataFrame:
    """Where matches end, each once."""
    return found.dropDuplicates(["pattern_id", "part", "end_id"]).select("pattern_id", "part", "match_ts", "end_id", "last_counter")


# --- one window pass ----------------------------------------------------------------------------------------------
def lag_chain(df: DataFrame, c: CompiledPattern, stretch: int = TASK_ROWS) -> DataFrame:
    """Contiguous fixed-length sequences: each element is judged on the row that many places back."""
    p, w = c.pattern, _order()
    found = list(dict.fromkeys(_branches(p.formula)))
    rows, n = _counted(df, p, stretch)
    if n > 1:
        rows, w = _blocks(rows, n, stretch, max(map(len, found))), Window.partitionBy("_block", "_epoch").orderBy("_cnt")
    plain = list(dict.fromkeys(e.sentence for b in found for e in b if not _refs(e.sentence)))
    for k, s in enumerate(plain):
        rows = rows.withColumn(f"_is{k}", P.sentence_column(s, P.Columns()))
    tests = []
    for b in found:
        n, ok = len(b), F.lit(not (p.window and p.window_type == "count" and p.window < len(b)))
        at = {e.store: k for k, e in enumerate(b) if e.store}

        def back(k: int, n: int = n):
            return P.Columns(lambda name: F.lag(name, n - 1 - k).over(w) if n - 1 - k else F.col(name))

        for k, e in enumerate(b):
            refs = _refs(e.sentence)
            if not refs:
                is_ = f"_is{plain.index(e.sentence)}"
                ok = ok & (F.lag(is_, n - 1 - k, False).over(w) if n - 1 - k else F.col(is_))
            elif all(r in at and at[r] < k for r in refs):
                ok = ok & P.sentence_column(e.sentence, back(k), {r: back(at[r]) for r in refs}) & (F.row_number().over(w) >= n)
            else:
                ok = F.lit(False)  # the register is still unset there
        if p.window and p.window_type == "time":
            ok = ok & (F.abs(F.col("ts") - F.lag("ts", n - 1).over(w)) < p.window if n > 1 else F.lit(True))
        tests.append(F.when(ok & (F.row_number().over(w) >= n), F.lit(n)))
    ids = F.array(*[F.lag("id", k).over(w) for k in range(max(map(len, found)) - 1, -1, -1)])
    rows = rows.withColumn("_ids", ids).withColumn("_lengths", F.array_compact(F.array(*tests))).where(F.size("_lengths") > 0)
    rows = (rows.where("_own") if "_own" in rows.columns else rows).withColumn("_n", F.explode("_lengths"))
    return rows.select(*_match(c, F.col("ts"), F.col("id"), F.slice("_ids", -F.col("_n"), F.col("_n")), F.col("_cnt") - F.col("_n") + 1, F.col("_cnt")))


def next_chain(df: DataFrame, c: CompiledPattern, stretch: int = TASK_ROWS) -> DataFrame:
    """Skip-till-next over plain elements: each row knows the next row that each later element takes."""
    p = c.pattern
    parts = _plain(p.formula.part)
    rows, _ = _counted(df, p, stretch)
    names = ["_first", *[f"_takes{k}" for k in range(1, len(parts))]]
    rows = rows.select("id", "ts", "_part", "_epoch", "_cnt", *[P.sentence_column(e.sentence, P.Columns()).alias(x) for x, e in zip(names, parts)])
    rows = rows.where(reduce(Column.__or__, map(F.col, names)))  # what no element takes need not be sorted again
    later = Window.partitionBy("_part", "_epoch").orderBy(F.desc("ts"), F.desc("id")).rowsBetween(Window.unboundedPreceding, -1)
    here = [F.col("id"), F.col("ts"), F.col("_cnt").alias("cnt")]
    for k in range(len(parts) - 1, 0, -1):
        rest = [F.col(f"_next{k + 1}").alias("next")] if k + 1 < len(parts) else []
        rows = rows.withColumn(f"_at{k}", F.when(F.col(f"_takes{k}"), F.struct(*here, *rest)))
        rows = rows.withColumn(f"_next{k}", F.last(f"_at{k}", ignorenulls=True).over(later))
    rows = rows.where("_first")
    chain = [f"_next1{'.next' * k}" for k in range(len(parts) - 1)]
    last = F.col(chain[-1]) if chain else F.struct(*here)
    rows = rows.where(last.isNotNull())
    if p.window:
        rows = rows.where(F.abs(last["cnt"] - F.col("_cnt")) < p.window if p.window_type == "count" else F.abs(last["ts"] - F.col("ts")) < p.window)
    events = F.array(F.col("id"), *[F.col(x)["id"] for x in chain])
    return rows.select(*_match(c, last["ts"], last["id"], events, F.col("_cnt"), last["cnt"]))


# --- joins --------------------------------------------------------------------------------------------------------
def range_join(df: DataFrame, c: CompiledPattern, stretch: int = TASK_ROWS) -> DataFrame:
    """Skip-till-any over single events: each later element joins on partition, order, window and registers.

    With a window, rows are bucketed by counter or time; a later element lies in its first's bucket or the next.
    """
    p = c.pattern
    parts = _plain(p.formula.part)
    needed = sorted({n for e in parts for a in ast.atoms(e.sentence) for n in P.find(a).reads(*a.args)} & set(df.columns) - {"id", "ts"})
    rows = _counted(df, p, stretch)[0].select("id", "ts", "_part", "_epoch", "_cnt", *needed)
    scale = "_cnt" if p.window_type == "count" else "ts"
    if p.window:
        rows = rows.withColumn("_bucket", F.floor(F.col(scale) / p.window))

    def named(k: int) -> DataFrame:
        out = rows if _refs(parts[k].sentence) else rows.where(P.sentence_column(parts[k].sentence, P.Columns()))
        return out.select([F.col(x).alias(x if k == 0 and x in ("_part", "_epoch") else f"{x}_{k}") for x in out.columns])

    def side(k: int) -> P.Columns:
        return P.Columns(lambda name: F.col(f"{name}_{k}"))

    out = named(0)
    if _refs(parts[0].sentence):
        out = out.where(F.lit(False))
    for k in range(1, len(parts)):
        right = named(k)
        on = F.col("_part").eqNullSafe(F.col(f"_part_{k}")) & (F.col("_epoch") == F.col(f"_epoch_{k}")) & (F.col(f"_cnt_{k}") > F.col(f"_cnt_{k - 1}"))
        if p.window:
            out = out.withColumn("_near", F.explode(F.array(F.col("_bucket_0"), F.col("_bucket_0") + 1)))
            on = on & (F.col("_near") == F.col(f"_bucket_{k}")) & (F.abs(F.col(f"{scale}_{k}") - F.col(f"{scale}_0")) < p.window)
        refs = _refs(parts[k].sentence)
        if refs:
            on = on & P.sentence_column(parts[k].sentence, side(k), {r: side(next(i for i, e in enumerate(parts) if e.store == r)) for r in refs})
        out = out.join(right, on).drop("_near", f"_part_{k}", f"_epoch_{k}")
    n = len(parts) - 1
    return out.select(*_match(c, F.col(f"ts_{n}"), F.col(f"id_{n}"), F.array(*[F.col(f"id_{k}") for k in range(n + 1)]), F.col("_cnt_0"), F.col(f"_cnt_{n}")))


# --- folds --------------------------------------------------------------------------------------------------------
def mask_column(c: CompiledPattern) -> Column:
    """One bit for each predicate that the event alone decides."""
    out = F.lit(0).cast("long")
    for k, a in enumerate(c.alphabet.static):
        out = out + F.when(P.column(a, P.Columns()), F.lit(1 << k)).otherwise(F.lit(0)).cast("long")
    return out


def symbol_column(c: CompiledPattern) -> Column:
    """The number of the event's min-term, or -1 for one that the declarations exclude."""
    masks = c.alphabet.masks
    if masks == list(range(1 << len(c.alphabet.atoms))):
        return mask_column(c).cast("int")
    found = F.create_map(*[F.lit(x) for k, m in enumerate(masks) for x in (m, k)])
    return F.coalesce(F.try_element_at(found, mask_column(c).cast("int")), F.lit(-1))


def _sorted(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.repartition(*keys).sortWithinPartitions(*keys, "ts", "id")


def _runs(batches: Iterator[pa.RecordBatch], keys: int):
    """Stretches of rows with equal keys (the first columns), and whether the key is new since the last stretch."""
    before = None
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, bool)
        new[0] = True
        for k in range(keys):
            column = batch.column(k).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            new[1:] |= column[1:] != column[:-1]
        cuts = [*np.flatnonzero(new).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            key = tuple(batch.column(k)[a].as_py() for k in range(keys))
            yield key, key != before, batch.slice(a, b - a)
            before = key


LABELS = "part string, id long, ts long, counter long, symbol int, before int, state int, detected boolean"


def label(df: DataFrame, c: CompiledPattern, chunks: int = 0) -> DataFrame:
    """Each event's counter, symbol, and state before and after, with ``detected`` on final states.

    ``chunks``: cut the stream into about so many stretches of time, for partitions too long for one task.
    """
    dfa, p = c.dfa, c.pattern
    rows = df.withColumn("_part", _part(p)).withColumn("_symbol", symbol_column(c))
    rows = rows.withColumn("_symbol", F.when(F.coalesce(F.col("is_reset"), F.lit(False)), F.lit(-2)).otherwise(F.col("_symbol"))) if "is_reset" in df.columns else rows
    rows = rows.select("_part", "ts", "id", "_symbol")
    table, finals, start = dfa.table.tolist(), np.isin(np.arange(dfa.n), sorted(dfa.finals)), dfa.start

    def fold(symbols: list[int], state: int) -> list[int]:
        out = []
        for s in symbols:
            if s == -1:
                raise ValueError("an event has predicates that are declared exclusive")
            state = start if s == -2 else table[state][s]
            out.append(state)
        return out

    def out_batch(part, stretch, symbols, states, entry, counter):
        n = len(symbols)
        after = np.array(states, np.int32)
        before = np.r_[np.int32(entry), after[:-1]].astype(np.int32)
        real = np.array(symbols) != -2
        counters = counter + np.cumsum(real)
        kept = pa.array(real)
        batch = pa.RecordBatch.from_arrays(
            [pa.array([part] * n, pa.string()), stretch.column("id"), stretch.column("ts"), pa.array(counters.astype(np.int64)), pa.array(np.array(symbols, np.int32)), pa.array(before), pa.array(after), pa.array(finals[after])],
            ["part", "id", "ts", "counter", "symbol", "before", "state", "detected"],
        )
        return batch if real.all() else batch.filter(kept), int(counters[-1])

    if not chunks:

        def rows_of(batches):
            state, counter = start, 0
            for (part,), new, stretch in _runs(batches, 1):
                if new:
                    state, counter = start, 0
                symbols = stretch.column("_symbol").to_pylist()
                states = fold(symbols, state)
                batch, counter = out_batch(part, stretch, symbols, states, state, counter)
                state = states[-1]
                yield batch

        return _sorted(rows, ["_part"]).mapInArrow(rows_of, LABELS)

    # a chunk is a range of time, fixed by quantiles, so both passes cut alike
    bounds = sorted(set(rows.approxQuantile("ts", [k / chunks for k in range(1, chunks)], 0.001))) if chunks > 1 else []
    number = F.lit(0)
    for b in bounds:
        number = number + (F.col("ts") >= F.lit(b)).cast("int")
    rows = rows.select("_part", number.alias("_chunk"), "ts", "id", "_symbol")
    n_states = dfa.n

    def maps(batches):
        key, now, counter = None, None, 0
        moves = np.array(table, np.int32)
        for (part, chunk), new, stretch in _runs(batches, 2):
            if new:
                if key is not None:
                    yield _map_batch(key, now, counter)
                key, now, counter = (part, chunk), np.arange(n_states, dtype=np.int32), 0
            for s in stretch.column("_symbol").to_pylist():
                if s == -1:
                    raise ValueError("an event has predicates that are declared exclusive")
                now = np.full(n_states, start, np.int32) if s == -2 else moves[now, s]
                counter += s != -2
        if key is not None:
            yield _map_batch(key, now, counter)

    def _map_batch(key, now, counter):
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.string()), pa.array([key[1]], pa.int32()), pa.array([now.tolist()], pa.list_(pa.int32())), pa.array([counter], pa.int64())], ["_part", "_chunk", "move", "n"])

    def chain(batches):
        state, counter = start, 0
        for (part,), new, stretch in _runs(batches, 1):
            if new:
                state, counter = start, 0
            for chunk, move, n in zip(*(stretch.column(k).to_pylist() for k in ("_chunk", "move", "n"))):
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.string()), pa.array([chunk], pa.int32()), pa.array([state], pa.int32()), pa.array([counter], pa.int64())], ["_part", "_chunk", "_entry", "_counter"])
                state, counter = move[state], counter + n

    moved = _sorted(rows, ["_part", "_chunk"]).mapInArrow(maps, "_part string, _chunk int, move array<int>, n long")
    entries = moved.repartition("_part").sortWithinPartitions("_part", "_chunk").mapInArrow(chain, "_part string, _chunk int, _entry int, _counter long")
    joined = rows.join(entries, rows["_part"].eqNullSafe(entries["_part"]) & (rows["_chunk"] == entries["_chunk"])).select(rows["_part"], rows["_chunk"], "ts", "id", "_symbol", "_entry", "_counter")

    def labelled(batches):
        state = counter = 0
        for (part, _), new, stretch in _runs(batches, 2):
            if new:
                state, counter = stretch.column("_entry")[0].as_py(), stretch.column("_counter")[0].as_py()
            symbols = stretch.column("_symbol").to_pylist()
            states = fold(symbols, state)
            batch, counter = out_batch(part, stretch, symbols, states, state, counter)
            state = states[-1]
            yield batch

    return _sorted(joined, ["_part", "_chunk"]).mapInArrow(labelled, LABELS)


def detections(df: DataFrame, c: CompiledPattern, chunks: int = 0) -> DataFrame:
    """(pattern_id, part, match_ts, end_id, last_counter): where the deterministic automaton is in a final state."""
    found = label(df, c, chunks).where("detected")
    return found.select(F.lit(c.pattern_id).alias("pattern_id"), "part", F.col("ts").alias("match_ts"), F.col("id").alias("end_id"), F.col("counter").alias("last_counter"))


class RunLimit(RuntimeError):
    """A partition has more runs at once than allowed. Give the pattern a window, or raise the limit."""


class Runs:
    """All runs of one partition. Feed events in order; each call gives the matches that end there.

    kleene_tail: ``full``, each match with all its events; ``delta``, only what joined since the run's last match;
    ``first``, a run ends with its first match.
    """

    def __init__(self, c: CompiledPattern, limit: int = 100_000, kleene_tail: str = "full", reset_on_match: bool = False, expire: int = -1):
        if kleene_tail not in ("full", "delta", "first"):
            raise ValueError(f"unknown kleene_tail {kleene_tail}")
        self.nfa: Nfa = c.nfa
        self.c, self.limit, self.tail, self.reset_on_match, self.expire = c, limit, kleene_tail, reset_on_match, expire
        self.index, self.n_static = c.alphabet.index, len(c.alphabet.static)
        self.dynamic = list(enumerate(c.alphabet.dynamic, len(c.alphabet.static)))
        self.cache: dict = {}
        self.counter, self.runs = 0, []

    def _holds(self, guard, mask: int) -> bool:
        key = (guard, mask)
        found = self.cache.get(key)
        if found is None:
            if len(self.cache) > 100_000:
                self.cache.clear()
            found = self.cache[key] = ast.holds(guard, mask, self.index)
        return found

    def reset(self) -> None:
        self.runs = []

    def feed(self, id_: int, ts: int, mask: int, values: dict):
        """Matches (events, first counter) that end with this event; ``values`` are the attributes that registers need."""
        self.counter += 1
        window, by_count = self.c.pattern.window, self.c.pattern.window_type == "count"
        now, found, event = [], [], P.Values(values)
        start = (self.nfa.start, {}, None, None, (), ts)
        for state, stored, first, first_ts, events, born in [*self.runs, start]:
            if window and first is not None and abs(self.counter - first if by_count else ts - first_ts) >= window:
                continue
            if self.expire >= 0 and first is not None and ts - born > self.expire:
                continue
            full = mask
            for k, a in self.dynamic:
                if P.value(a, event, stored):
                    full |= 1 << k
            for e in self.nfa.edges[state]:
                if e.target == self.nfa.start or not self._holds(e.guard, full):
                    continue
                taken = e.output == TAKE
                run = (e.target, {**stored, e.store: event} if e.store else stored, self.counter if taken and first is None else first, ts if taken and first_ts is None else first_ts, (*events, id_) if taken else events, born)
                if e.target in self.nfa.finals:
                    found.append((list(run[4]), run[2]))
                    if self.tail == "first":
                        continue
                    if self.tail == "delta":
                        run = (*run[:4], (), born)
                if self.nfa.edges[e.target]:
                    now.append(run)
        if len(now) > self.limit:
            raise RunLimit(f"{len(now)} runs at event {id_}")
        self.runs = [] if found and self.reset_on_match else now
        return found


def fold_columns(df: DataFrame, c: CompiledPattern) -> tuple[DataFrame, list[str]]:
    """What a fold reads: _part, ts, id, _reset, _mask and the attributes that registers compare."""
    needed = sorted({n for a in c.alphabet.dynamic for n in P.find(a).reads(*a.args)})
    reset = F.coalesce(F.col("is_reset"), F.lit(False)) if "is_reset" in df.columns else F.lit(False)
    rows = df.withColumn("_part", _part(c.pattern)).withColumn("_mask", mask_column(c)).withColumn("_reset", reset)
    return rows.select("_part", "ts", "id", "_reset", "_mask", *needed), needed


def run_fold(df: DataFrame, c: CompiledPattern, limit: int = 100_000, kleene_tail: str = "full", reset_on_match: bool = False, expire: int = -1) -> DataFrame:
    """Any pattern: runs of the nondeterministic automaton, with registers, over each partition's sorted stream."""
    rows, needed = fold_columns(df, c)
    schema = pa.schema([("pattern_id", pa.int32()), ("part", pa.string()), ("match_ts", pa.int64()), ("end_id", pa.int64()), ("events", pa.list_(pa.int64())), ("first_counter", pa.int64()), ("last_counter", pa.int64())])

    def fold(batches):
        runs = None
        for (part,), new, stretch in _runs(batches, 1):
            if new:
                runs = Runs(c, limit, kleene_tail, reset_on_match, expire)
            out = []
            columns = [stretch.column(k).to_pylist() for k in ("ts", "id", "_reset", "_mask")]
            extra = [stretch.column(n).to_pylist() for n in needed]
            for i, (ts, id_, reset, mask) in enumerate(zip(*columns)):
                if reset:
                    runs.reset()
                    continue
                for events, first in runs.feed(id_, ts, mask, {n: x[i] for n, x in zip(needed, extra)}):
                    out.append({"pattern_id": c.pattern_id, "part": part, "match_ts": ts, "end_id": id_, "events": events, "first_counter": first, "last_counter": runs.counter})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)

    return _sorted(rows, ["_part"]).mapInArrow(fold, MATCH)


def compare(a: DataFrame, b: DataFrame, ends_only: bool = False) -> DataFrame:
    """Rows of one match table that the other lacks, with ``side`` left or right.

    Both tables are read once and counted together, so a task holds one plan of each side.
    """
    keys = ["pattern_id", "part", "end_id"] if ends_only else ["pattern_id", "part", "end_id", "events"]
    both = a.select(*keys, F.lit(1).cast("long").alias("_side")).unionByName(b.select(*keys, F.lit(-1).cast("long").alias("_side")))
    more = F.sum("_side")
    if ends_only:
        more = F.max(F.greatest("_side", F.lit(0))) + F.min(F.least("_side", F.lit(0)))
    found = both.groupBy(*keys).agg(more.alias("_more")).where("_more <> 0")
    found = found.withColumn("side", F.when(F.col("_more") > 0, "left").otherwise("right"))
    return found.withColumn("side", F.explode(F.array_repeat("side", F.abs("_more").cast("int")))).drop("_more")


def schema() -> T.StructType:
    return T.StructType.fromDDL(MATCH)
