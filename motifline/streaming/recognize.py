"""Recognition on streaming event tables: one keyed state for each partition of the pattern, rows ordered in each batch.

``label_stream`` keeps the automaton's state and counter; ``match_stream`` the runs of the nondeterministic automaton.
Order across batches is the order of arrival; within a batch (ts, id).
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from motifline.operators.recognize import LABELS, MATCH, Runs, _part, fold_columns, symbol_column
from motifline.plans.compiled import CompiledPattern


def label_stream(events: DataFrame, c: CompiledPattern) -> DataFrame:
    """The columns of a batch ``label``, in append mode."""
    dfa, table = c.dfa, c.dfa.table.tolist()
    reset = F.coalesce(F.col("is_reset"), F.lit(False)) if "is_reset" in events.columns else F.lit(False)
    rows = events.withColumn("_part", F.coalesce(_part(c.pattern), F.lit(""))).withColumn("_symbol", F.when(reset, -2).otherwise(symbol_column(c))).select("_part", "ts", "id", "_symbol")

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState):
        at, counter = state.get if state.exists else (dfa.start, 0)
        pdf = pd.concat(list(frames)).sort_values(["ts", "id"])
        out = []
        for ts, id_, s in zip(pdf.ts.tolist(), pdf.id.tolist(), pdf._symbol.tolist()):
            if s == -1:
                raise ValueError("an event has predicates that are declared exclusive")
            before, at = at, dfa.start if s == -2 else table[at][s]
            if s != -2:
                counter += 1
                out.append((key[0], id_, ts, counter, s, before, at, at in dfa.finals))
        state.update((at, counter))
        if out:
            yield pd.DataFrame(out, columns=["part", "id", "ts", "counter", "symbol", "before", "state", "detected"]).astype({"symbol": np.int32, "before": np.int32, "state": np.int32})

    return rows.groupBy("_part").applyInPandasWithState(step, LABELS, "state int, counter long", "append", GroupStateTimeout.NoTimeout)


def match_stream(events: DataFrame, c: CompiledPattern, **options) -> DataFrame:
    """The columns of batch ``matches``, in append mode. options: those of ``Runs``."""
    rows, needed = fold_columns(events, c)
    rows = rows.withColumn("_part", F.coalesce("_part", F.lit("")))

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState):
        runs = Runs(c, **options)
        if state.exists:
            runs.counter, runs.runs = pickle.loads(state.get[0])
        pdf = pd.concat(list(frames)).sort_values(["ts", "id"])
        out = []
        for r in pdf.to_dict("records"):
            if r["_reset"]:
                runs.reset()
                continue
            for found, first in runs.feed(r["id"], r["ts"], r["_mask"], {n: r[n] for n in needed}):
                out.append((c.pattern_id, key[0], r["ts"], r["id"], found, first, runs.counter))
        state.update((pickle.dumps((runs.counter, runs.runs)),))
        if out:
            yield pd.DataFrame(out, columns=[f.split()[0] for f in MATCH.split(", ")]).astype({"pattern_id": np.int32})

    return rows.groupBy("_part").applyInPandasWithState(step, MATCH, "runs binary", "append", GroupStateTimeout.NoTimeout)
