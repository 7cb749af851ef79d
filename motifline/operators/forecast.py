"""Forecasts on a labelled stream, and their scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motifline.operators.recognize import label
from motifline.operators.waiting import Forecast, forecast_of, full_order, table
from motifline.plans import automaton
from motifline.plans.compiled import CompiledPattern

TABLE = "state int, start int, end int, middle double, prob double, positive boolean"
CONTEXT_TABLE = "context string, " + TABLE


def table_frame(spark, forecasts: dict) -> DataFrame:
    """Valid forecasts by state, or by (context text, state)."""
    rows = [((*k, f.start, f.end, f.middle, f.prob, f.positive) if isinstance(k, tuple) else (k, f.start, f.end, f.middle, f.prob, f.positive)) for k, f in forecasts.items() if f.valid]
    return spark.createDataFrame(rows, CONTEXT_TABLE if any(isinstance(k, tuple) for k in forecasts) else TABLE)


def emit(labels: DataFrame, forecasts: dict, c: CompiledPattern, finals: bool = False, gate: Column | None = None, most: int = 200_000) -> DataFrame:
    """A forecast for each event whose state has one: (part, id, ts, counter, state, start, end, middle, prob,
    positive, start_counter, end_counter). ``gate`` is a condition on the labelled rows; final states emit if asked.

    The table has one row for each state of the automaton; up to ``most`` rows it is broadcast.
    """
    rows = labels if finals else labels.where(~F.col("detected"))
    if gate is not None:
        rows = rows.where(gate)
    known = table_frame(labels.sparkSession, forecasts)
    keys = [k for k in ("context", "state") if k in known.columns]
    out = rows.join(F.broadcast(known) if len(forecasts) <= most else known, keys)
    return out.select("part", "id", "ts", "counter", "state", "start", "end", "middle", "prob", "positive", (F.col("counter") + F.col("start")).alias("start_counter"), (F.col("counter") + F.col("end")).alias("end_counter"))


def distance_gate(c: CompiledPattern, low: float, high: float, next_ts: str = "nextCETimestamp") -> Column | None:
    """When to emit: always (-1), by the share of the way that a state has left (below 1), or by the time to the next match (1 and above)."""
    if low == -1:
        return None
    if low < 1:
        left = automaton.remaining(c.dfa)
        return F.col("state").isin([s for s, x in enumerate(left) if low <= x <= high])
    return (F.col(next_ts) - F.col("ts")).between(low, high)


def forecast(df: DataFrame, c: CompiledPattern, chain, method: str = "smart-scan", threshold: float = 0.5, horizon: int = 200, spread: int = 200, finals: bool = False, gate: Column | None = None, chunks: int = 0) -> DataFrame:
    """Label a stream and emit full-order forecasts."""
    centers = automaton.distances(c.dfa)
    found = table(full_order(chain, horizon, finals), method, threshold, spread, dict(enumerate(centers)))
    return emit(label(df, c, chunks), found, c, finals, gate)


def context_forecasts(tree, c: CompiledPattern, pairs, method: str = "smart-scan", threshold: float = 0.5, horizon: int = 200, spread: int = 200, cutoff: float = 0.001) -> dict:
    """Forecasts by (context text, state) for the given (context, state) pairs of a variable-order model."""
    from motifline.operators.suffix_trees import waiting

    out = {}
    for context, state in pairs:
        name = "," + ",".join(map(str, context)) if context else ""
        out[(name, state)] = forecast_of(waiting(tree, c.dfa, context, state, horizon, cutoff), method, threshold, spread)
    return out


def forecast_variable(df: DataFrame, c: CompiledPattern, tree, finals: bool = False, gate: Column | None = None, **options) -> DataFrame:
    """Label a stream with contexts and emit variable-order forecasts. Pairs of context and state that occur come to the
    driver, at most nodes times states."""
    from motifline.operators.suffix_trees import label_contexts

    labels = label_contexts(df, c, tree)
    pairs = [(tuple(int(x) for x in r["context"].split(",") if x), r["state"]) for r in labels.select("context", "state").distinct().collect()]
    return emit(labels, context_forecasts(tree, c, pairs, **options) or {("", 0): Forecast()}, c, finals, gate)


# --- scores -------------------------------------------------------------------------------------------------------
def _with_next(forecasts: DataFrame, labels: DataFrame, inclusive: bool) -> DataFrame:
    """Adds the first detection at or after the forecast's start (inclusive) or after its event, by one window pass."""
    d = labels.where("detected").select("part", F.col("counter").alias("_at"), F.lit(1).alias("_kind"), F.col("counter").alias("_hit"))
    at = F.col("start_counter") if inclusive else F.col("counter") + 1
    f = forecasts.withColumn("_at", at.cast("long")).withColumn("_kind", F.lit(0)).withColumn("_hit", F.lit(None).cast("long"))
    both = f.unionByName(d, allowMissingColumns=True)
    later = Window.partitionBy("part").orderBy(F.desc("_at"), F.desc("_kind")).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("_next", F.last("_hit", ignorenulls=True).over(later)).where("_kind = 0").drop("_at", "_kind", "_hit")


def classification_counts(forecasts: DataFrame, labels: DataFrame) -> DataFrame:
    """One row (tp, tn, fp, fn): was there a detection within the forecast's interval?"""
    hit = F.coalesce(F.col("_next") <= F.col("end_counter"), F.lit(False))
    one = lambda ok: F.count(F.when(ok, 1))
    yes = F.col("positive")
    return _with_next(forecasts, labels, True).agg(one(hit & yes).alias("tp"), one(~hit & ~yes).alias("tn"), one(~hit & yes).alias("fp"), one(hit & ~yes).alias("fn"))


def classification_scores(counts: DataFrame) -> DataFrame:
    """Adds precision, recall, f1, specificity, accuracy, npv, informedness (-1 where undefined) and mcc (0 where undefined)."""
    tp, tn, fp, fn = (F.col(k).cast("double") for k in ("tp", "tn", "fp", "fn"))

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b != 0, a / b).otherwise(F.lit(-1.0))

    precision, recall, specificity, npv = ratio(tp, tp + fp), ratio(tp, tp + fn), ratio(tn, tn + fp), ratio(tn, tn + fn)
    out = counts.select("tp", "tn", "fp", "fn", precision.alias("precision"), recall.alias("recall"), specificity.alias("specificity"), ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"), npv.alias("npv"))
    known = (F.col("precision") != -1) & (F.col("recall") != -1)
    both = F.col("precision") + F.col("recall")
    out = out.withColumn("f1", F.when(known & (both > 0), 2 * F.col("precision") * F.col("recall") / both).when(known, F.lit(float("nan"))).otherwise(F.lit(-1.0)))
    out = out.withColumn("informedness", F.when((F.col("recall") != -1) & (F.col("specificity") != -1), F.col("recall") + F.col("specificity") - 1).otherwise(F.lit(-1.0)))
    good = F.sqrt(F.col("precision") * F.col("recall") * F.col("specificity") * F.col("npv"))
    bad = F.sqrt((1 - F.col("precision")) * (1 - F.col("recall")) * (1 - F.col("specificity")) * (1 - F.col("npv")))
    some = (F.col("precision") != -1) & (F.col("recall") != -1) & (F.col("specificity") != -1) & (F.col("npv") != -1)
    return out.withColumn("mcc", F.when(some, good - bad).otherwise(F.lit(0.0)))


def judged(forecasts: DataFrame, labels: DataFrame) -> DataFrame:
    """Interval forecasts held against the next detection after their event; those after the last one are left out."""
    rows = _with_next(forecasts, labels, False).where("_next IS NOT NULL").withColumnRenamed("_next", "detection")
    correct = F.col("detection").between(F.col("start_counter"), F.col("end_counter"))
    miss = F.when(correct, 0).when(F.col("detection") < F.col("start_counter"), F.col("start_counter") - F.col("detection")).otherwise(F.col("detection") - F.col("end_counter"))
    rows = rows.withColumn("correct", correct).withColumn("spread", F.col("end") - F.col("start")).withColumn("deviation", miss.cast("long"))
    alpha = 1.0 - F.when(F.col("prob") == 1.0, F.lit(0.99)).otherwise(F.col("prob"))
    return rows.withColumn("distance", F.when(correct, F.col("detection") - F.col("start_counter"))).withColumn("interval_score", F.col("spread") + F.when(correct, F.lit(0.0)).otherwise(2 / alpha * F.col("deviation")))


def _ratios(rows: DataFrame, keys: list[str]) -> DataFrame:
    n = F.count("*")
    return rows.groupBy(*keys).agg(
        n.alias("forecasts"), F.count(F.when(F.col("correct"), 1)).alias("correct"), (F.count(F.when(F.col("correct"), 1)) / n).alias("precision"), F.avg("spread").alias("spread"),
        F.coalesce(F.avg("distance"), F.lit(-1.0)).alias("distance"), F.avg("interval_score").alias("interval_score"), F.avg("prob").alias("confidence"), F.avg("deviation").alias("mae"),
        F.sqrt(F.avg(F.col("deviation") * F.col("deviation"))).alias("rmse"), F.avg(F.col("deviation") / F.col("detection")).alias("mare"),
    )


def regression_scores(forecasts: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: precision, spread, distance, interval score, errors; loss_ratio and no_forecast_ratio are shares of detections."""
    rows = judged(forecasts, labels)
    per = rows.groupBy("part", "detection").agg(F.max("correct").alias("caught"))
    all_ = labels.where("detected").select("part", F.col("counter").alias("detection")).join(per, ["part", "detection"], "left")
    lost = all_.agg(F.count("*").alias("detections"), F.avg(F.when(F.coalesce("caught", F.lit(False)), 0.0).otherwise(1.0)).alias("loss_ratio"), F.avg(F.when(F.col("caught").isNull(), 1.0).otherwise(0.0)).alias("no_forecast_ratio"))
    return _ratios(rows.withColumn("_one", F.lit(1)), ["_one"]).join(lost.withColumn("_one", F.lit(1)), "_one", "right").drop("_one")


def regression_by_state(forecasts: DataFrame, labels: DataFrame) -> DataFrame:
    """The same by the state that made the forecast; loss_ratio: detections that none of the state's pending forecasts caught."""
    rows = judged(forecasts, labels)
    per = rows.groupBy("state", "part", "detection").agg(F.max("correct").alias("caught"))
    total = labels.where("detected").agg(F.count("*").alias("_all")).withColumn("_one", F.lit(1))
    lost = per.where("NOT caught").groupBy("state").agg(F.count("*").alias("missed")).withColumn("_one", F.lit(1)).join(total, "_one").select("state", (F.col("missed") / F.col("_all")).alias("loss_ratio"))
    return _ratios(rows, ["state"]).join(lost, "state", "left").withColumn("loss_ratio", F.coalesce("loss_ratio", F.lit(0.0)))


def next_scores(labelled: list[tuple[DataFrame, dict]]) -> DataFrame:
    """Of several patterns on one stream, how often was the set of those that matched at an event foretold the event before?

    labelled: (labels, next_table) of each pattern. One row: events with a match, and those whose matches were all foretold.
    """
    out = None
    for k, (labels, forecasts) in enumerate(labelled):
        yes = F.col("before").isin([s for s, f in forecasts.items() if f.positive])
        one = labels.select("part", "id", F.col("detected"), (F.col("detected") & ~yes).alias("missed"))
        out = one if out is None else out.unionByName(one)
    per = out.groupBy("part", "id").agg(F.max("detected").alias("any"), F.max("missed").alias("missed")).where("any")
    return per.agg(F.count("*").alias("events"), F.count(F.when(~F.col("missed"), 1)).alias("foretold"))


def recognition_stats(labels: DataFrame, seconds: float) -> dict:
    """Stream size, matches, and events a second for a measured time."""
    r = labels.agg(F.count("*").alias("events"), F.count(F.when(F.col("detected"), 1)).alias("matches")).first()
    return {"events": r["events"], "matches": r["matches"], "seconds": seconds, "throughput": r["events"] / seconds if seconds else float("inf")}
