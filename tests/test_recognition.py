"""Recognition plans against each other and against hand-made results."""

import random

import pytest
from pyspark.sql import functions as F

from motifline.functions import predicates as P
from motifline.operators import forecast as fc
from motifline.operators import markov, suffix_trees, waiting
from motifline.operators import recognize as R
from motifline.plans import ast
from motifline.plans.compiled import compile_one, keywords
from motifline.sources import readers, sinks, synthetic

T = "IsEventTypePredicate"
EXCLUSIVE = f"~({T}(A),{T}(B),{T}(C))"


@pytest.fixture(scope="module")
def stream(spark):
    rng = random.Random(11)
    rows = [(k, rng.choice("ABC"), k * 3 + rng.randrange(3), f"p{rng.randrange(3)}", float(rng.randrange(6)), None if rng.random() < 0.1 else rng.choice("xy")) for k in range(1, 121)]
    return spark.createDataFrame(rows, "id long, event_type string, ts long, who string, v double, s string").cache()


def found(df):
    return sorted((r["part"], tuple(r["events"]), r["first_counter"], r["last_counter"], r["match_ts"]) for r in df.collect())


def test_two_events(spark):
    s = synthetic.of_types(spark, ["a", "b", "a", "b"])
    c = compile_one(f";({T}(a),{T}(b))")
    assert [e for _, e, *_ in found(R.matches(s, c))] == [(1, 2), (3, 4)]
    assert [r["end_id"] for r in R.detections(s, c).orderBy("end_id").collect()] == [2, 4]


@pytest.mark.parametrize(
    "text",
    [
        f";({T}(A),{T}(B)){{partitionBy:who}}",
        f";({T}(A),+({T}(B),;({T}(C),{T}(C)))){{partitionBy:who}}{{window:2}}",
        f"+({T}(A),{T}(A))",
        f"+({T}(A),|({T}(A),{T}(B))){{partitionBy:who}}",
        f';({T}(A)["x"],^(-{T}(A),GTAttr(v,"x")),LTAttr(v,"x")){{partitionBy:who}}',
        f';(TruePredicate()["x"],EQAttrStr(s,"x")){{partitionBy:who}}{{window:8}}{{windowType:time}}',
        f'@(;({T}(A),{T}(B),{T}(C))){{partitionBy:who}}',
        f'@(;({T}(A),|({T}(B),GT(v,3.0)))){{partitionBy:who}}{{window:3}}',
        f'@(;({T}(A),BT(v,2.0,4.0))){{window:9}}{{windowType:time}}',
        f'#(;({T}(A),{T}(B),{T}(C))){{partitionBy:who}}{{window:5}}',
        f'#(;({T}(A)["x"],^({T}(B),GTAttr(v,"x"))["y"],EQAttr(v,"y"))){{partitionBy:who}}{{window:30}}{{windowType:time}}',
        f';(EQAttr(v,"x"),{T}(A)["x"]){{partitionBy:who}}',
    ],
)
def test_planned_and_folded_matches_agree(stream, text):
    c = compile_one(text)
    assert R.strategy(c) != "run_fold"
    assert found(R.matches(stream, c)) == found(R.run_fold(stream, c))


@pytest.mark.parametrize("text", [f"*({T}(A))", f";({T}(A),*({T}(B)),{T}(C))", f"+(;({T}(A),{T}(B)),{T}(C))", f"#(;({T}(A),{T}(B)))", f"@(;({T}(A),{T}(B)))", f";({T}(A),!({T}(B)),{T}(C))"])
def test_detections_are_end_points_with_overlap(stream, text):
    c = compile_one(text + "{partitionBy:who}", EXCLUSIVE, "overlap")
    ends = {(r["part"], r["end_id"]) for r in R.end_points(R.run_fold(stream, c)).collect()}
    if text.startswith("*"):  # accepts the empty word, so every event ends a match; runs list those with events
        ends = {(r["who"], r["id"]) for r in stream.collect()}
    assert {(r["part"], r["end_id"]) for r in R.detections(stream, c).collect()} == ends


def test_chunks_label_as_one_stream_does(stream):
    c = compile_one(f";({T}(A),*({T}(B)),{T}(C))", EXCLUSIVE)
    whole = sorted(map(tuple, R.label(stream, c).collect()))
    assert sorted(map(tuple, R.label(stream, c, chunks=7).collect())) == whole
    c = compile_one(f";({T}(A),{T}(A)){{partitionBy:who}}", EXCLUSIVE)
    assert sorted(map(tuple, R.label(stream, c, chunks=5).collect())) == sorted(map(tuple, R.label(stream, c).collect()))


def test_kleene_tails_and_limits(spark):
    s = synthetic.of_types(spark, ["A", "B", "B"])
    c = compile_one(f";({T}(A),*({T}(B)))")
    lists = lambda **o: sorted(tuple(r["events"]) for r in R.run_fold(s, c, **o).collect())
    assert lists() == [(1,), (1, 2), (1, 2, 3)]
    assert lists(kleene_tail="delta") == [(1,), (2,), (3,)]
    assert lists(kleene_tail="first") == [(1,)]
    every = compile_one("#(;(TruePredicate(),TruePredicate(),TruePredicate()))")
    with pytest.raises(Exception, match="runs at event"):
        R.run_fold(synthetic.of_types(spark, ["A"] * 40), every, limit=20).collect()


def test_resets_end_runs(spark):
    rows = [(1, "A", 1, False), (2, "RESET", 1, True), (3, "B", 2, False), (4, "A", 3, False), (5, "B", 4, False)]
    s = spark.createDataFrame(rows, "id long, event_type string, ts long, is_reset boolean")
    for text in (f";({T}(A),{T}(B))", f"#(;({T}(A),{T}(B)))", f"@(;({T}(A),{T}(B)))"):
        c = compile_one(text)
        assert [tuple(r["events"]) for r in R.matches(s, c).collect()] == [(4, 5)]
        assert [tuple(r["events"]) for r in R.run_fold(s, c).collect()] == [(4, 5)]
        assert [r["end_id"] for r in R.detections(s, c).collect()] == [5]


def test_missing_attributes(spark):
    s = spark.createDataFrame([(1, "A", 1, None), (2, "A", 2, 5.0)], "id long, event_type string, ts long, v double")
    assert [r["end_id"] for r in R.matches(s, compile_one("GT(v,1.0)")).collect()] == [2]
    with pytest.raises(Exception, match="missing attribute"):
        s.select(P.sentence_column(ast.Atom("GT", ("v", 1.0)), P.Columns(), strict=True)).collect()
    with pytest.raises(ValueError, match="unknown predicate"):
        R.matches(s, compile_one("Nope(v)"))


def test_excluded_valuations_are_refused(spark):
    c = compile_one(";(GT(v,1.0),GT(v,2.0))", "~(GT(v,1.0),GT(v,2.0))")
    s = spark.createDataFrame([(1, "A", 1, 5.0)], "id long, event_type string, ts long, v double")
    with pytest.raises(Exception, match="declared exclusive"):
        R.label(s, c).collect()


def test_own_predicates(spark):
    P.predicate("Even", 1)(lambda e, a: e.num(a) % 2 == 0)
    s = synthetic.of_types(spark, list("AAAA")).withColumn("v", F.col("id").cast("double"))
    assert [r["end_id"] for r in R.matches(s, compile_one("Even(v)")).orderBy("end_id").collect()] == [2, 4]


def test_comparison_and_lines(spark, stream):
    a = R.matches(stream, compile_one(f";({T}(A),{T}(B)){{partitionBy:who}}"))
    b = R.matches(stream, compile_one(f"@(;({T}(A),{T}(B))){{partitionBy:who}}"))
    assert R.compare(a, a).count() == 0 and R.compare(a, b).where("side = 'left'").count() == 0 < R.compare(a, b).count()
    assert R.compare(a, b, ends_only=True).where("side = 'left'").count() == 0
    first = sinks.match_lines(a).first()["value"]
    assert first.startswith("MATCH: Timestamp->") and first.endswith("->COMPLETE")
    assert sinks.detections_table(a).columns == ["id", "ts", "partitionval", "state", "events"]


# --- sources ------------------------------------------------------------------------------------------------------
def read(spark, tmp_path, text, kind):
    (tmp_path / "lines").write_text(text)
    return [r.asDict() for r in readers.read(spark, f"file://{tmp_path}/lines", kind).orderBy("id").collect()]


def test_line_formats(spark, tmp_path):
    rows = read(spark, tmp_path, "A,1\nB,2\nRESET,-1\n", "csv")
    assert [(r["id"], r["event_type"], r["ts"], r["is_reset"]) for r in rows] == [(1, "A", 1, False), (2, "B", 2, False), (3, "RESET", -1, True)]
    assert [r["ts"] for r in readers.placed_resets(readers.read(spark, f"file://{tmp_path}/lines", "csv")).orderBy("id").collect()] == [1, 2, 2]
    with pytest.raises(Exception, match="can't parse"):
        read(spark, tmp_path, "A,one\n", "csv")
    r = read(spark, tmp_path, '{"timestamp": 5, "speed": 1.5, "n": {"a": 1}}\n{"timestamp": 6, "speed": 2}\n', "json")
    assert [(x["ts"], x["speed"], x["event_type"]) for x in r] == [(5, 1.5, "GenericJson"), (6, 2.0, "GenericJson")]
    r = read(spark, tmp_path, "10,227,-4.5,48.3,12.5,90,91,x,99\n-1,227,0,0,0,0,0,x\n", "maritime")
    assert (r[0]["mmsi"], r[0]["speed"], r[0]["nextCETimestamp"], r[1]["is_reset"], r[1]["nextCETimestamp"]) == ("227", 12.5, 99, True, -1)
    r = read(spark, tmp_path, "BUY(id=7,name=RIMM,volume=3,price=2.5,ts=44)\nSELL(id=8,name=INTC,volume=1,price=1,ts=45)\n", "stock")
    assert [(x["id"], x["event_type"], x["name"], x["volume"], x["price"], x["ts"]) for x in r] == [(7, "BUY", "RIMM", 3, 2.5, 44), (8, "SELL", "INTC", 1, 1.0, 45)]
    r = read(spark, tmp_path, "LOAD(id=1,t=17,v=2.5,p=0,h=4)\n", "homes")
    assert (r[0]["ts"], r[0]["plug_timestamp"], r[0]["value"], r[0]["householdId"]) == (17, "17", 2.5, 4)
    fields = ["id=3", "m=a", "h=b", "p=1", "d=77", "s=1", "x=2", "z=East Harlem/North", "y=Mid wood", *[f"f{k}=0" for k in range(6)], "total=9.5"]
    r = read(spark, tmp_path, f"TRIP({','.join(fields)})\n", "taxi")
    assert (r[0]["ts"], r[0]["pickupZone"], r[0]["dropoffZone"], r[0]["totalAmount"]) == (77, "EastHarlemNorth", "Midwood", 9.5)


def test_spatial_predicates(spark):
    rows = [(1, -4.4753, 48.3827, 10.0, 0.0), (2, -4.2, 48.3827, 20.0, 270.0), (3, -4.2, 48.3827, 20.0, 90.0), (4, None, 48.0, 1.0, 1.0)]
    s = spark.createDataFrame(rows, "id long, lon double, lat double, speed double, heading double").withColumn("ts", F.col("id")).withColumn("event_type", F.lit("x"))
    ends = lambda t: [r["end_id"] for r in R.matches(s, compile_one(t)).orderBy("end_id").collect()]
    assert ends("WithinCirclePredicate(-4.47530,48.38273,5.0)") == [1]
    assert ends("OutsideCirclePredicate(-4.47530,48.38273,5.0)") == [2, 3]
    assert ends("DistanceBetweenPredicate(-4.47530,48.38273,15.0,25.0)") == [2, 3]
    assert ends("HeadingTowardsPredicate(BrestPort)") == [1, 2]


def test_splits(spark):
    s = synthetic.independent(spark, 100, {"A": 0.5, "B": 0.5}, 3, ["x", "y"])
    train, test = readers.split(s, 0.3, 0.2)
    assert sorted(r["id"] for r in train.collect()) == list(range(21, 51)) and test.count() == 70
    assert len(list(readers.folds(s, 5))) == 5
    told = synthetic.conditional(spark, 50, {(): {"A": 1.0}, ("A",): {"B": 1.0}, ("B",): {"A": 1.0}})
    assert [r["event_type"] for r in told.orderBy("id").collect()] == ["A", "B"] * 25
    assert synthetic.from_xml('<s><probability given="A" type="B" value="0.5"/></s>') == {("A",): {"B": 0.5}}


# --- models on streams --------------------------------------------------------------------------------------------
def test_counted_contexts(spark):
    word = [1, 1, 1, 2, 1, 1, 2, 1, 1, 1]
    s = spark.createDataFrame([("$", k, x) for k, x in enumerate(word)], "part string, counter long, symbol int")
    n = {tuple(r["context"]): r["n"] for r in suffix_trees.count_contexts(s, 1, full_only=True).collect()}
    assert n == {(1,): 7, (2,): 2, (1, 1): 5, (1, 2): 2, (2, 1): 2}


def test_forecasts_and_scores(spark, stream):
    c = compile_one(f";({T}(A),{T}(B)){{partitionBy:who}}", EXCLUSIVE)
    labels = R.label(stream, c).cache()
    chain = markov.learn_markov(stream, c)
    assert not chain.check()
    rows = labels.orderBy("part", "counter").collect()
    hits = {}
    for r in rows:
        hits.setdefault(r["part"], []).append(r["counter"]) if r["detected"] else None

    forecasts = fc.forecast(stream, c, chain, "classify-nextk", 0.4, 20, 3)
    want = [0, 0, 0, 0]
    for f in forecasts.collect():
        yes = any(f["start_counter"] <= h <= f["end_counter"] for h in hits.get(f["part"], []))
        want[{(True, True): 0, (False, False): 1, (False, True): 2, (True, False): 3}[(yes, f["positive"])]] += 1
    assert tuple(fc.classification_counts(forecasts, labels).first()) == tuple(want)
    score = fc.classification_scores(fc.classification_counts(forecasts, labels)).first()
    assert score["precision"] == (want[0] / (want[0] + want[2]) if want[0] + want[2] else -1)

    intervals = fc.forecast(stream, c, chain, "smart-scan", 0.4, 20, 20)
    good = total = spread = 0
    for f in intervals.collect():
        later = [h for h in hits.get(f["part"], []) if h > f["counter"]]
        if later:
            total, good, spread = total + 1, good + (f["start_counter"] <= later[0] <= f["end_counter"]), spread + f["end"] - f["start"]
    got = fc.regression_scores(intervals, labels).first()
    assert (got["forecasts"], got["correct"]) == (total, good) and abs(got["spread"] - spread / total) < 1e-9
    assert got["detections"] == sum(map(len, hits.values()))
    assert sum(r["forecasts"] for r in fc.regression_by_state(intervals, labels).collect()) == total
    assert sinks.forecasts_table(fc.judged(intervals, labels)).count() == total
    assert sinks.forecast_lines(intervals).first()["value"].startswith("PREDICTION@")
    gated = fc.forecast(stream, c, chain, "smart-scan", 0.4, 20, 20, gate=fc.distance_gate(c, 0.0, 0.5))
    assert 0 < gated.count() < intervals.count()

    times = {r["state"]: r["mean"] for r in waiting.remaining_times(labels).collect()}
    gaps = {}
    for r in rows:
        later = [h for h in hits.get(r["part"], []) if h > r["counter"]]
        if later:
            gaps.setdefault(r["state"], []).append(later[0] - r["counter"])
    assert times == pytest.approx({s: sum(g) / len(g) for s, g in gaps.items()})
    assert set(waiting.mean_based(waiting.remaining_times(labels), 10)) == set(times)


def test_variable_order_on_streams(stream):
    c = compile_one(f";({T}(A),{T}(B)){{partitionBy:who}}", EXCLUSIVE)
    tree = suffix_trees.learn_tree(suffix_trees.learn_counts(stream, c, 2), 2)
    rows = suffix_trees.label_contexts(stream, c, tree).orderBy("part", "counter").collect()
    past, before = (), None
    for r in rows:
        past = ((r["symbol"],) + (past if r["part"] == before else ()))[:2]
        before = r["part"]
        want = tree.longest(past)
        assert r["context"] == ("," + ",".join(map(str, want)) if want else "")
    loss = suffix_trees.log_loss(R.label(stream, c).select("part", "counter", "symbol"), tree).first()
    assert loss["n"] == len(rows) and loss["log_loss"] > 0
    assert fc.forecast_variable(stream, c, tree, method="classify-nextk", horizon=5, spread=3).count() > 0


def test_comparison_counts_copies_in_one_pass(spark, stream):
    rows = [(0, "p", 1, [1, 2]), (0, "p", 1, [1, 2]), (0, "p", 1, [1, 2]), (0, None, 2, [2]), (0, "q", 3, [4, 3]), (0, "q", 3, [3])]
    a = spark.createDataFrame(rows, "pattern_id int, part string, end_id long, events array<long>")
    b = spark.createDataFrame([rows[0], rows[3], (0, "q", 5, [5]), (0, "q", 5, [5])], a.schema)
    got = [(r["part"], r["end_id"], r["events"], r["side"]) for r in R.compare(a, b).collect()]
    assert sorted(got) == [("p", 1, [1, 2], "left")] * 2 + [("q", 3, [3], "left"), ("q", 3, [4, 3], "left")] + [("q", 5, [5], "right")] * 2
    got = [(r["part"], r["end_id"], r["side"]) for r in R.compare(a, b, ends_only=True).collect()]
    assert sorted(got) == [("q", 3, "left"), ("q", 5, "right")]
    a, b = (R.matches(stream, compile_one(text)) for text in (f";({T}(A),{T}(B)){{partitionBy:who}}", f"@(;({T}(A),{T}(B))){{partitionBy:who}}"))
    plan = [x._jdf.queryExecution().optimizedPlan().toString().count("Window [") for x in (a, b, R.compare(a, b))]
    assert plan[2] <= plan[0] + plan[1]  # each side is planned once


def test_events_are_dealt_by_their_count(spark, stream):
    n = spark.sparkContext.defaultParallelism
    many = R.dealt(stream, "who", rows=10)
    assert many.rdd.getNumPartitions() == 12 > n == R.dealt(stream, "who").rdd.getNumPartitions()
    c = compile_one(f"@(;({T}(A),{T}(B))){{partitionBy:who}}")
    assert found(R.matches(many, c)) == found(R.matches(stream, c))
    plan = R.matches(many, c)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_NUM" in plan


@pytest.mark.parametrize("text", [f";({T}(A),{T}(B))", f"+(;({T}(A),{T}(B),{T}(C)),;({T}(B),{T}(A)),{T}(C))", f';({T}(A)["x"],GTAttr(v,"x"),{T}(B)){{window:5}}{{windowType:time}}', f"#(;({T}(A),{T}(B))){{window:3}}", f"@(;({T}(A),{T}(B)))"])
@pytest.mark.parametrize("resets", [False, True])
def test_whole_streams_in_stretches(stream, text, resets):
    s = stream.withColumn("ts", F.floor(F.col("ts") / 9)).select("id", "event_type", "ts", "v")  # ties in time
    s = s.withColumn("ts", F.when(F.col("id") > 2, F.col("ts")))  # and events without one, which come first
    if resets:
        s = s.withColumn("is_reset", F.when(F.col("id") % 7 > 0, F.col("id") % 11 == 0))
    c, w = compile_one(text), R.Window.partitionBy(F.lit(0)).orderBy("ts", "id")
    want = found(R.matches(s, c, stretch=1000))
    assert want
    for stretch in (5, 40):
        assert found(R.matches(s, c, stretch=stretch)) == want
    if not resets:
        got = {r["id"]: r["_cnt"] for r in R._counted(s, c.pattern, 7)[0].collect()}
        assert got == {r["id"]: r["n"] for r in s.withColumn("n", F.row_number().over(w)).collect()}


def test_no_task_holds_a_whole_stream(spark):
    n = 2000
    s = spark.range(n).select("id", F.lit("A").alias("event_type"), F.lit(5).cast("long").alias("ts"))  # all at one time
    rows, stretches = R._counted(s, compile_one(f";({T}(A),{T}(A))").pattern, 100)
    sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert stretches == 20 and sum(sizes) == n and max(sizes) <= n / 3
    assert R.matches(s, compile_one(f";({T}(A),{T}(A))"), stretch=100).count() == n - 1


def test_orders_are_compared(stream):
    c = compile_one(f";({T}(A),{T}(B))", EXCLUSIVE)
    best, scores = markov.best_order(stream, c, 1, folds=2)
    assert best in (0, 1) and len(scores) == 2 and all(s >= 1 for s in scores)


def test_keywords_on_a_stream(spark):
    s = synthetic.of_types(spark, list("ABCABXAB"))
    assert [r["end_id"] for r in R.detections(s, keywords([["A", "B"], ["B", "C", "A"]])).orderBy("end_id").collect()] == [2, 4, 5, 8]
