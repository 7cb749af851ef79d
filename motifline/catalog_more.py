"""More registered queries: line formats, splits, spatial predicates, resets, automaton states, waiting times, forecasts and their scores, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motifline import catalog as C
from motifline.functions.geo import RADIUS_KM
from motifline.functions.predicates import predicate
from motifline.operators import forecast as fc
from motifline.operators import markov, waiting
from motifline.operators import recognize as R
from motifline.plans import ast, automaton, compiled
from motifline.plans.compiled import compile_one
from motifline.sources import readers

QUERIES: dict = {}
SQL: dict[str, str] = {}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# --- line formats: lines made of a table's rows, parsed ------------------------------------------------------------
def parsing(name: str, table: str, id_: str, line: str, kind: str, columns: list[str], sql: str, **options) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        lines = spark.read.parquet(f"{sf_dir}/{table}.parquet").select(F.expr(id_).alias("id"), F.expr(line).alias("value"))
        return readers.DOMAINS[kind](lines, **options).select(*columns)

    QUERIES[name] = run
    SQL[name] = sql


MICROS = "unix_micros(CAST(ts AS TIMESTAMP))"
K = "get_json_object(props, '$.k')"
parsing("parse_csv", "events", "event_id", f"concat(event_type, ', ', if(event_type = 'error', -1, {MICROS}))", "csv", ["id", "event_type", "ts", "is_reset"],
        "SELECT event_id AS id, event_type, CASE WHEN event_type = 'error' THEN -1 ELSE epoch_us(ts) END AS ts, event_type = 'error' AS is_reset FROM events")
parsing("parse_json", "events", "event_id", f"to_json(named_struct('timestamp', {MICROS}, 'what', event_type, 'value', value))", "json", ["id", "ts", "event_type", "what", "value"],
        "SELECT event_id AS id, epoch_us(ts) AS ts, 'GenericJson' AS event_type, event_type AS what, value FROM events", schema="timestamp long, what string, value double")
parsing("parse_maritime", "events", "event_id", f"concat_ws(',', {MICROS}, user_id, value, {K}, value, {K}, value, event_type)", "maritime", ["id", "event_type", "ts", "is_reset", "mmsi", "lon", "lat", "speed", "heading"],
        "SELECT event_id AS id, 'SampledCritical' AS event_type, epoch_us(ts) AS ts, false AS is_reset, user_id::VARCHAR AS mmsi, value AS lon, json_extract_string(props, '$.k')::DOUBLE AS lat, value AS speed, json_extract_string(props, '$.k')::DOUBLE AS heading FROM events")
parsing("parse_stock", "orders", "o_orderkey", "concat(if(o_orderstatus = 'O', 'BUY', 'SELL'), '(id=', o_orderkey, ',name=', o_orderpriority, ',volume=', o_custkey, ',price=', o_totalprice, ',ts=', unix_micros(CAST(o_orderdate AS TIMESTAMP)), ')')", "stock", ["id", "event_type", "ts", "name", "price"],
        "SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'O' THEN 'BUY' ELSE 'SELL' END AS event_type, epoch_us(o_orderdate) AS ts, o_orderpriority AS name, o_totalprice AS price FROM orders")

parsing("parse_homes", "orders", "o_orderkey", "concat('LOAD(id=', o_orderkey, ',plug=', unix_micros(CAST(o_orderdate AS TIMESTAMP)), ',value=', o_totalprice, ',property=1,household=', o_custkey, ')')", "homes", ["id", "event_type", "ts", "value", "householdId"],
        "SELECT o_orderkey AS id, 'LOAD' AS event_type, epoch_us(o_orderdate) AS ts, o_totalprice AS value, o_custkey AS householdId FROM orders")
parsing("parse_taxi", "orders", "o_orderkey", "concat('TRIP(id=', o_orderkey, ',a=1,b=2,c=3,ts=', unix_micros(CAST(o_orderdate AS TIMESTAMP)), ',d=4,e=5,from=', o_orderpriority, ' / x,to=', o_orderstatus, repeat(',z=0', 6), ',total=', o_totalprice, ')')", "taxi", ["id", "event_type", "ts", "pickupZone", "dropoffZone", "totalAmount"],
        "SELECT o_orderkey AS id, 'TRIP' AS event_type, epoch_us(o_orderdate) AS ts, regexp_replace(o_orderpriority, '[\\s/]', '', 'g') || 'x' AS pickupZone, o_orderstatus AS dropoffZone, o_totalprice AS totalAmount FROM orders")


def halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = readers.split(C.user_events(spark, sf_dir), 0.3, 0.2)
    return train.select("id", F.lit("train").alias("share")).unionByName(test.select("id", F.lit("test").alias("share")))


QUERIES["stream_split"] = halves
SQL["stream_split"] = """WITH o AS (SELECT event_id, row_number() OVER (ORDER BY epoch_us(ts), event_id) AS r, count(*) OVER () AS n FROM events)
SELECT event_id AS id, CASE WHEN r > floor(n * 0.2) AND r <= floor(n * 0.2) + floor(n * 0.3) THEN 'train' ELSE 'test' END AS share FROM o"""


# --- predicates of place and equality ------------------------------------------------------------------------------
def placed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events with a made-up place each."""
    return C.user_events(spark, sf_dir).withColumn("lon", F.col("value") / 4).withColumn("lat", F.col("k") - 50)


C.STREAM_SQL[placed_events] = f"SELECT *, value / 4 AS lon, k - 50 AS lat FROM ({C.STREAM_SQL[C.user_events]})"


def km(e: str, lon: float, lat: float) -> str:
    a = f"(pow(sin(radians({lat} - {e}.lat) / 2), 2) + cos(radians({e}.lat)) * cos(radians({lat})) * pow(sin(radians({lon} - {e}.lon) / 2), 2))"
    return f"(2 * {RADIUS_KM} * atan2(sqrt({a}), sqrt(1 - {a})))"


def matching(name: str, stream, text: str, sql: str) -> None:
    C.matching(name, stream, text, sql)
    QUERIES[name], SQL[name] = C.QUERIES.pop(name), C.SQL.pop(name)


matching("pred_within_circle", placed_events, ";(WithinCirclePredicate(30.0,10.0,3000.0),IsEventTypePredicate(view)){partitionBy:user}", C.joined_sql([km("{e}", 30.0, 10.0) + " < 3000", C.kind("view")], C.NEXT_TO))
matching("pred_outside_circle", placed_events, ";(OutsideCirclePredicate(30.0,10.0,3000.0),OutsideCirclePredicate(30.0,10.0,3000.0),WithinCirclePredicate(30.0,10.0,3000.0)){partitionBy:user}", C.joined_sql(["NOT " + km("{e}", 30.0, 10.0) + " < 3000"] * 2 + [km("{e}", 30.0, 10.0) + " < 3000"], C.NEXT_TO))
matching("pred_between_circles", placed_events, ";(DistanceBetweenPredicate(30.0,10.0,1000.0,4000.0),IsEventTypePredicate(click)){partitionBy:user}", C.joined_sql([f"{km('{e}', 30.0, 10.0)} > 1000 AND {km('{e}', 30.0, 10.0)} < 4000", C.kind("click")], C.NEXT_TO))
matching("pred_equal_number", C.user_events, ";(EQ(k,50.0),GT(k,50.0)){partitionBy:user}", C.joined_sql(["{e}.k = 50", "{e}.k > 50"], C.NEXT_TO))


# --- resets --------------------------------------------------------------------------------------------------------
def with_resets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An error ends all that its user has open and is no event."""
    events = C.user_events(spark, sf_dir).withColumn("is_reset", F.col("event_type") == "error")
    return R.matches(events, compile_one(f"@(;({C.is_('view')},{C.is_('purchase')})){{partitionBy:user}}")).select("part", F.array_join("events", ",").alias("events"))


QUERIES["reset_events"] = with_resets
SQL["reset_events"] = f"""WITH {C.stream_sql(C.user_events)}, e AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY part ORDER BY n) AS epoch FROM s),
p AS (SELECT *, first(CASE WHEN event_type = 'purchase' THEN id END IGNORE NULLS) OVER (PARTITION BY part, epoch ORDER BY n ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS q FROM e)
SELECT part, id || ',' || q AS events FROM p WHERE event_type = 'view' AND q IS NOT NULL"""


# --- predicates of users' own --------------------------------------------------------------------------------------
@predicate("IsMultipleOf", 2)
def is_multiple_of(e, attr: str, n: float):
    return F.pmod(e.num(attr), F.lit(n)) == 0


matching("pred_registered", C.user_events, ";(IsMultipleOf(k,10.0),-IsMultipleOf(k,2.0)){partitionBy:user}", C.joined_sql(["{e}.k % 10 = 0", "{e}.k % 2 <> 0"], C.NEXT_TO))


# --- automata ------------------------------------------------------------------------------------------------------
def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.label(C.user_events(spark, sf_dir), C.PAIR).select("part", "id", "counter", "before", "state", "detected")


QUERIES["dfa_state"] = states
SQL["dfa_state"] = f"WITH {C.labelled_sql()} SELECT part, id, n AS counter, before::INTEGER AS before, state::INTEGER AS state, state = {C.pair_states()[2]} AS detected FROM l"
TWO = compile_one(f";({C.is_('view')},{C.is_('purchase')}){{order:2}}{{partitionBy:user}}", C.ONE_TYPE)
QUERIES["detect_order_two"] = C.detected(TWO, C.user_events)
SQL["detect_order_two"] = C.SQL["detect_view_purchase"]
PLAIN = compile_one(f";({C.is_('view')},{C.is_('purchase')}){{partitionBy:user}}", C.ONE_TYPE, select=False)
QUERIES["detect_without_satisfiability"] = C.detected(PLAIN, C.user_events)
SQL["detect_without_satisfiability"] = C.SQL["detect_view_purchase"]




def by_user(formula) -> compiled.CompiledPattern:
    return compile_one(ast.Pattern(formula, 0, "user"))


# the same language from a table, a saved automaton, builders and an XML tree
TYPES = ["view", "purchase"]
FROM_TABLE = compiled.from_table(TYPES, [[1, 0, 0], [1, 2, 0], [1, 0, 0]], 0, [2], partition_by="user")
for name_, c_ in {"detect_from_table": FROM_TABLE, "detect_saved_table": compiled.from_json(FROM_TABLE.to_json()), "detect_saved_pattern": compiled.from_json(C.PAIR.to_json()), "detect_built": by_user(compiled.concat(*TYPES)),
                  "detect_xml": by_user(compiled.from_xml("<concat><symbol value='view'/><symbol value='purchase'/></concat>"))}.items():
    QUERIES[name_] = C.detected(c_, C.user_events)
    SQL[name_] = C.SQL["detect_view_purchase"]
BRANCHES = by_user(compiled.concat("signup", compiled.union("click", "view"), "purchase"))
QUERIES["detect_union"] = C.detected(BRANCHES, C.user_events)
SQL["detect_union"] = f"""WITH {C.stream_sql(C.user_events)}, p AS (SELECT *, lag(event_type) OVER w AS t1, lag(event_type, 2) OVER w AS t2 FROM s WINDOW w AS (PARTITION BY part ORDER BY n))
SELECT 0::INTEGER AS pattern_id, part, ts AS match_ts, id AS end_id, n AS last_counter FROM p WHERE t2 = 'signup' AND t1 IN ('click', 'view') AND event_type = 'purchase'"""
CYCLE = by_user(compiled.concat("signup", compiled.star("view"), "purchase"))
QUERIES["detect_star"] = C.detected(CYCLE, C.user_events)
SQL["detect_star"] = f"""WITH {C.stream_sql(C.user_events)}, p AS (SELECT *, last(CASE WHEN event_type <> 'view' THEN event_type END IGNORE NULLS) OVER (PARTITION BY part ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS t FROM s)
SELECT 0::INTEGER AS pattern_id, part, ts AS match_ts, id AS end_id, n AS last_counter FROM p WHERE t = 'signup' AND event_type = 'purchase'"""


def compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of skip-till-next and of contiguous pairs that the other lacks."""
    events = R.dealt(C.user_events(spark, sf_dir), "user")
    text = f";({C.is_('view')},{C.is_('purchase')})"
    found = R.compare(R.matches(events, compile_one(f"@({text}){{partitionBy:user}}")), R.matches(events, compile_one(f"{text}{{partitionBy:user}}")))
    return found.select("part", "end_id", F.array_join("events", ",").alias("events"), "side")


QUERIES["compare_matches"] = compared
SQL["compare_matches"] = f"""WITH {C.stream_sql(C.user_events)}, a AS ({C.NEXT_SQL}), b AS ({C.joined_sql([C.kind("view"), C.kind("purchase")], C.NEXT_TO)}),
x AS (SELECT part, ids[2] AS end_id, array_to_string(ids, ',') AS events FROM a), y AS (SELECT part, ids[2] AS end_id, array_to_string(ids, ',') AS events FROM b)
SELECT *, 'left' AS side FROM (SELECT * FROM x EXCEPT ALL SELECT * FROM y) UNION ALL SELECT *, 'right' FROM (SELECT * FROM y EXCEPT ALL SELECT * FROM x)"""


def plans_agree(how: str):
    """The same matches by another plan."""
    c = compile_one(f"@(;({C.is_('view')},{C.is_('purchase')})){{partitionBy:user}}{{window:20}}")
    return lambda spark, sf_dir: C.shown(R.matches(C.user_events(spark, sf_dir), c, how))


for how_ in ("next_chain", "run_fold"):
    QUERIES[f"plan_{how_}"] = plans_agree(how_)
    SQL[f"plan_{how_}"] = C.chain_sql(C.user_events, C.NEXT_SQL + " AND q.n - n < 20")


def counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fc.recognition_stats(R.label(C.user_events(spark, sf_dir), C.PAIR), 2.0)
    return spark.createDataFrame([(found["events"], found["matches"], found["throughput"])], "events long, matches long, throughput double")


QUERIES["recognition_stats"] = counted
SQL["recognition_stats"] = f"WITH {C.labelled_sql()} SELECT count(*) AS events, count(*) FILTER (state = {C.pair_states()[2]}) AS matches, count(*) / 2 AS throughput FROM l"


# --- waiting times and forecasts -----------------------------------------------------------------------------------
HORIZON = 100


def chain(spark: SparkSession, sf_dir: str) -> markov.MarkovChain:
    return markov.learn_markov(C.user_events(spark, sf_dir), C.PAIR)


def times(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = waiting.full_order(chain(spark, sf_dir), HORIZON, finals=True)
    return spark.createDataFrame([(int(s), k, round(float(p), 9)) for s, d in found.items() for k, p in enumerate(d, 1)], "state int, events int, prob double")


def expectations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = waiting.full_order(chain(spark, sf_dir), HORIZON)
    return spark.createDataFrame([(int(s), round(waiting.expected(d), 6)) for s, d in found.items()], "state int, expected double")


def model_sql() -> str:
    """wt: state, k, p, of the pair's states that are not final; m: the transition probabilities."""
    s, v, d = C.pair_states()
    at = {"s": s, "v": v, "d": d}
    cells = ", ".join(f"coalesce(max(p) FILTER (before = {at[x]} AND state = {at[y]}), 0) AS {x}{y}" for x in at for y in at)
    return f"""WITH RECURSIVE {C.labelled_sql()}, q AS (SELECT before, state, count(*) / sum(count(*)) OVER (PARTITION BY before) AS p FROM l GROUP BY before, state),
m AS MATERIALIZED (SELECT {cells} FROM q),
w AS (SELECT 1 AS k, 1 - (ss + sv) AS a, 1 - (vs + vv) AS b FROM m UNION ALL SELECT k + 1, ss * a + sv * b, vs * a + vv * b FROM w, m WHERE k < {HORIZON}),
wt AS MATERIALIZED (SELECT {s} AS state, k, greatest(a, 0) AS p FROM w UNION ALL SELECT {v}, k, greatest(b, 0) FROM w)"""


QUERIES["wt_dist"] = times
SQL["wt_dist"] = f"""{model_sql()} SELECT state::INTEGER AS state, k::INTEGER AS events, round(p, 9) AS prob FROM wt
UNION ALL SELECT {C.pair_states()[2]}::INTEGER, k::INTEGER, round(CASE WHEN k = 1 THEN dd ELSE greatest(lag(a) OVER (ORDER BY k) * ds + lag(b) OVER (ORDER BY k) * dv, 0) END, 9) FROM w, m"""
QUERIES["wt_expected"] = expectations
SQL["wt_expected"] = f"{model_sql()} SELECT state::INTEGER AS state, round(sum(k * p), 6) AS expected FROM wt GROUP BY state"

#: method, threshold, spread of the tables of forecasts
TABLES = (("classify-nextk", 0.3, 10), ("classify-win", 0.3, 6), ("argmax", 0.3, 50), ("full-scan", 0.5, 100), ("smart-scan", 0.5, 100), ("fixed-spread", 0.2, 8))


def tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, out = waiting.full_order(chain(spark, sf_dir), HORIZON), []
    centers = dict(enumerate(automaton.distances(C.PAIR.dfa)))
    for method, threshold, spread in TABLES:
        for s, f in waiting.table(found, method, threshold, spread, centers).items():
            out.append((method, int(s), f.start, f.end, round(f.middle, 6), round(f.prob, 6), f.positive))
    return spark.createDataFrame(out, "method string, state int, start int, end int, middle double, prob double, positive boolean")


def table_sql(method: str, threshold: float, spread: int) -> str:
    """A query over iv (state, a, b, prob) and wt: state, a, b, prob, top of the valid forecasts."""
    if method == "classify-nextk":
        return f"SELECT state, a, b, prob, NULL::INTEGER AS top FROM iv WHERE a = 1 AND b = {spread}"
    if method == "classify-win":
        s, v, _ = C.pair_states()
        center = f"CASE state WHEN {s} THEN 2 WHEN {v} THEN 1 END"
        return f"SELECT state, a, b, prob, NULL::INTEGER AS top FROM iv WHERE a = greatest(1, {center} - {spread // 2}) AND b = {center} + {spread // 2}"
    if method == "argmax":
        return f"""SELECT state, a, b, prob, top FROM (SELECT iv.*, top FROM iv JOIN (SELECT state AS of, k AS top FROM wt QUALIFY row_number() OVER (PARTITION BY state ORDER BY p DESC, k) = 1) t ON iv.state = of
  JOIN range(0, {HORIZON}) j(j) ON a = greatest(1, top - j.j) AND b = least({HORIZON}, top + j.j) WHERE prob >= {threshold} OR a = 1 AND b = {HORIZON} QUALIFY row_number() OVER (PARTITION BY state ORDER BY j.j) = 1) WHERE b - a <= {spread}"""
    if method == "fixed-spread":
        return f"SELECT state, a, b, prob, NULL::INTEGER AS top FROM (SELECT * FROM iv WHERE b - a = {spread} QUALIFY row_number() OVER (PARTITION BY state ORDER BY prob DESC, a) = 1) WHERE prob > {threshold}"
    return f"SELECT state, a, b, prob, NULL::INTEGER AS top FROM (SELECT * FROM iv WHERE prob >= {threshold} QUALIFY row_number() OVER (PARTITION BY state ORDER BY b - a, prob DESC, a) = 1) WHERE b - a <= {spread}"


def tables_sql(which) -> str:
    """f: method, state, start, end, middle, prob, positive."""
    rows = " UNION ALL ".join(f"SELECT '{m}' AS method, {t} AS least, * FROM ({table_sql(m, t, w)})" for m, t, w in which)
    return f"""{model_sql()}, cu AS (SELECT state, k, p, sum(p) OVER (PARTITION BY state ORDER BY k) AS c FROM wt),
iv AS MATERIALIZED (SELECT x.state, x.k AS a, y.k AS b, y.c - x.c + x.p AS prob FROM cu x JOIN cu y ON x.state = y.state AND y.k >= x.k), t AS ({rows}),
f AS MATERIALIZED (SELECT method, state, a AS start, b AS end, coalesce(top::DOUBLE, (SELECT sum(k * p) / sum(p) FROM wt WHERE wt.state = t.state AND k BETWEEN a AND b)) AS middle, prob, method NOT LIKE 'classify%' OR prob >= least AS positive FROM t)"""


QUERIES["forecast_tables"] = tables
SQL["forecast_tables"] = f"{tables_sql(TABLES)} SELECT method, state::INTEGER AS state, start::INTEGER AS start, \"end\"::INTEGER AS \"end\", round(middle, 6) AS middle, round(prob, 6) AS prob, positive FROM f"


def emitted_sql(method: str, threshold: float, spread: int) -> str:
    """e: the emitted forecasts with nx, the next detection after each event, and detected events as d."""
    done = C.pair_states()[2]
    nx = f"first(CASE WHEN state = {done} THEN n END IGNORE NULLS) OVER (PARTITION BY part ORDER BY n ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"
    return f"""{tables_sql([(method, threshold, spread)])}, x AS (SELECT *, {nx} AS nx FROM l), d AS (SELECT part, n AS detection FROM l WHERE state = {done}),
e AS MATERIALIZED (SELECT x.part, x.id, x.ts, x.n AS counter, x.state, f.start, f.end, f.middle, f.prob, f.positive, x.n + f.start AS start_counter, x.n + f.end AS end_counter, nx FROM x JOIN f ON x.state = f.state WHERE x.state <> {done})"""


def forecasts_of(method: str, threshold: float, spread: int):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        events = C.user_events(spark, sf_dir)
        return rounded(fc.forecast(events, C.PAIR, markov.learn_markov(events, C.PAIR), method, threshold, HORIZON, spread))

    return run


SHOWN = 'part, id, ts, counter, state::INTEGER AS state, start::INTEGER AS start, "end"::INTEGER AS "end", round(middle, 6) AS middle, round(prob, 6) AS prob, positive, start_counter, end_counter'
for name_, how in {"forecast_intervals": ("smart-scan", 0.5, 100), "forecast_nextk": ("classify-nextk", 0.3, 10)}.items():
    QUERIES[name_] = forecasts_of(*how)
    SQL[name_] = f"{emitted_sql(*how)} SELECT {SHOWN} FROM e"

JUDGED = """j AS (SELECT *, nx AS detection, nx BETWEEN start_counter AND end_counter AS correct, "end" - start AS spread,
  CASE WHEN nx BETWEEN start_counter AND end_counter THEN 0 WHEN nx < start_counter THEN start_counter - nx ELSE nx - end_counter END AS deviation,
  1 - CASE WHEN prob = 1 THEN 0.99::DOUBLE ELSE prob END AS alpha FROM e WHERE nx IS NOT NULL)"""
RATIOS = """count(*) AS forecasts, count(*) FILTER (correct) AS correct, round(count(*) FILTER (correct) / count(*), 6) AS precision, round(avg(spread), 6) AS spread,
  round(coalesce(avg(CASE WHEN correct THEN detection - start_counter END), -1), 6) AS distance, round(avg(spread + CASE WHEN correct THEN 0 ELSE 2 / alpha * deviation END), 6) AS interval_score,
  round(avg(prob), 6) AS confidence, round(avg(deviation), 6) AS mae, round(sqrt(avg(deviation * deviation)), 6) AS rmse, round(avg(deviation / detection), 6) AS mare"""
QUERIES["forecast_interval_scores"] = lambda spark, sf_dir: rounded(C.interval_scores(spark, sf_dir))
SQL["forecast_interval_scores"] = f"""{emitted_sql("argmax", 0.3, 50)}, {JUDGED}, per AS (SELECT part, detection, max(correct) AS caught FROM j GROUP BY ALL),
lost AS (SELECT count(*) AS detections, round(avg(CASE WHEN coalesce(caught, false) THEN 0.0 ELSE 1.0 END), 6) AS loss_ratio, round(avg(CASE WHEN caught IS NULL THEN 1.0 ELSE 0.0 END), 6) AS no_forecast_ratio FROM d LEFT JOIN per USING (part, detection))
SELECT * FROM (SELECT {RATIOS} FROM j), lost"""
QUERIES["forecast_scores_by_state"] = lambda spark, sf_dir: rounded(C.scores_by_state(spark, sf_dir))
SQL["forecast_scores_by_state"] = f"""{emitted_sql("smart-scan", 0.5, 100)}, {JUDGED}, per AS (SELECT state, part, detection, max(correct) AS caught FROM j GROUP BY ALL),
lost AS (SELECT state, count(*) FILTER (NOT caught) / (SELECT count(*) FROM d) AS loss FROM per GROUP BY state)
SELECT g.state::INTEGER AS state, g.* EXCLUDE (state), round(coalesce(loss, 0), 6) AS loss_ratio FROM (SELECT state, {RATIOS} FROM j GROUP BY state) g LEFT JOIN lost USING (state)"""
QUERIES["forecast_classification"] = lambda spark, sf_dir: rounded(C.classification(spark, sf_dir))
SQL["forecast_classification"] = f"""{emitted_sql("classify-nextk", 0.3, 10)}, h AS (SELECT positive AS yes, coalesce(nx <= end_counter, false) AS hit FROM e),
c AS (SELECT count(*) FILTER (hit AND yes)::DOUBLE AS tp, count(*) FILTER (NOT hit AND NOT yes)::DOUBLE AS tn, count(*) FILTER (NOT hit AND yes)::DOUBLE AS fp, count(*) FILTER (hit AND NOT yes)::DOUBLE AS fn FROM h),
r AS (SELECT *, CASE WHEN tp + fp <> 0 THEN tp / (tp + fp) ELSE -1 END AS precision, CASE WHEN tp + fn <> 0 THEN tp / (tp + fn) ELSE -1 END AS recall, CASE WHEN tn + fp <> 0 THEN tn / (tn + fp) ELSE -1 END AS specificity,
  CASE WHEN tp + tn + fp + fn <> 0 THEN (tp + tn) / (tp + tn + fp + fn) ELSE -1 END AS accuracy, CASE WHEN tn + fn <> 0 THEN tn / (tn + fn) ELSE -1 END AS npv FROM c)
SELECT tp::BIGINT AS tp, tn::BIGINT AS tn, fp::BIGINT AS fp, fn::BIGINT AS fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(specificity, 6) AS specificity, round(accuracy, 6) AS accuracy, round(npv, 6) AS npv,
  round(CASE WHEN precision <> -1 AND recall <> -1 AND precision + recall > 0 THEN 2 * precision * recall / (precision + recall) WHEN precision <> -1 AND recall <> -1 THEN 'nan'::DOUBLE ELSE -1 END, 6) AS f1,
  round(CASE WHEN recall <> -1 AND specificity <> -1 THEN recall + specificity - 1 ELSE -1 END, 6) AS informedness,
  round(CASE WHEN precision <> -1 AND recall <> -1 AND specificity <> -1 AND npv <> -1 THEN sqrt(precision * recall * specificity * npv) - sqrt((1 - precision) * (1 - recall) * (1 - specificity) * (1 - npv)) ELSE 0 END, 6) AS mcc FROM r"""


def next_sql(pairs) -> str:
    parts = []
    for k, (a, b) in enumerate(pairs):
        parts.append(f"""y{k} AS (SELECT part, id, coalesce(event_type = '{b}' AND t1 = '{a}', false) AS detected, CASE WHEN t1 = '{a}' THEN 1 WHEN t1 = '{b}' AND t2 = '{a}' THEN 2 ELSE 0 END AS before FROM p),
z{k} AS (SELECT part, id, detected, detected AND avg(detected::INTEGER) OVER (PARTITION BY before) < 0.15 AS missed FROM y{k})""")
    every = " UNION ALL ".join(f"SELECT * FROM z{k}" for k in range(len(pairs)))
    return f"""WITH {C.stream_sql(C.user_events)}, p AS (SELECT *, lag(event_type) OVER w AS t1, lag(event_type, 2) OVER w AS t2 FROM s WINDOW w AS (PARTITION BY part ORDER BY n)), {", ".join(parts)},
g AS (SELECT part, id, max(missed) AS missed FROM ({every}) GROUP BY part, id HAVING max(detected)) SELECT count(*) AS events, count(*) FILTER (NOT missed) AS foretold FROM g"""


QUERIES["next_scores"] = C.next_foretold
SQL["next_scores"] = next_sql([("view", "purchase"), ("click", "view")])


# --- emission by distance, random and given chains -----------------------------------------------------------------
def gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecasts from states that have half of the way left."""
    events = C.user_events(spark, sf_dir)
    found = fc.forecast(events, C.PAIR, markov.learn_markov(events, C.PAIR), "classify-nextk", 0.3, HORIZON, 10, gate=fc.distance_gate(C.PAIR, 0.4, 0.6))
    return rounded(found)


QUERIES["forecast_gated"] = gated
SQL["forecast_gated"] = f"{emitted_sql('classify-nextk', 0.3, 10)} SELECT {SHOWN} FROM e WHERE state = {C.pair_states()[1]}"


def given_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waiting times where all symbols are equally likely."""
    n = len(C.PAIR.alphabet.masks)
    found = waiting.full_order(markov.chain_of(C.PAIR, [1 / n] * n), 30)
    return spark.createDataFrame([(int(s), k, round(float(p), 9)) for s, d in found.items() for k, p in enumerate(d, 1)], "state int, events int, prob double")


QUERIES["wt_given_probabilities"] = given_times
_n, (_s, _v, _) = float(len(C.PAIR.alphabet.masks)), C.pair_states()
SQL["wt_given_probabilities"] = f"""WITH RECURSIVE w AS (SELECT 1 AS k, 0::DOUBLE AS a, 1 / {_n}::DOUBLE AS b UNION ALL SELECT k + 1, ({_n} - 1) / {_n}::DOUBLE * a + b / {_n}::DOUBLE, ({_n} - 2) / {_n}::DOUBLE * a + b / {_n}::DOUBLE FROM w WHERE k < 30)
SELECT {_s}::INTEGER AS state, k::INTEGER AS events, round(a, 9) AS prob FROM w UNION ALL SELECT {_v}::INTEGER, k::INTEGER, round(b, 9) FROM w"""


# --- hidden Markov model -------------------------------------------------------------------------------------------
def hidden_sql() -> str:
    """Waiting times after one symbol; every count starts at a millionth."""
    at = dict(zip("svd", C.pair_states()))
    every, n = ", ".join(f"({k})" for k in at.values()), len(C.PAIR.alphabet.masks)
    cells = ", ".join(f"max(p) FILTER (state = {at[x]} AND next = {at[y]}) AS {x}{y}" for x in at for y in at)
    into = {y: " + ".join(f"b{x} * {x}{y}" for x in at) for y in at}
    return f"""WITH RECURSIVE {C.labelled_sql()}, y AS (SELECT part, n, state, {C.symbol_sql()} AS symbol, lead(state) OVER (PARTITION BY part ORDER BY n) AS next FROM l),
st AS (SELECT * FROM (VALUES {every}) t(state)), sy AS (SELECT range AS symbol FROM range({n})),
ec AS (SELECT state, symbol, count(*) AS n FROM y GROUP BY ALL), mc AS (SELECT state, next, count(*) AS n FROM y GROUP BY ALL), sc AS (SELECT state, count(*) AS n FROM y WHERE n = 1 GROUP BY ALL),
emits AS (SELECT state, symbol, (1e-6::DOUBLE + coalesce(n, 0)) / sum(1e-6::DOUBLE + coalesce(n, 0)) OVER (PARTITION BY state) AS p FROM (SELECT * FROM st, sy) LEFT JOIN ec USING (state, symbol)),
moves AS (SELECT state, next, (1e-6::DOUBLE + coalesce(n, 0)) / sum(1e-6::DOUBLE + coalesce(n, 0)) OVER (PARTITION BY state) AS p FROM (SELECT st.state, x.state AS next FROM st, st x) LEFT JOIN mc USING (state, next)),
starts AS (SELECT state, (1e-6::DOUBLE + coalesce(n, 0)) / sum(1e-6::DOUBLE + coalesce(n, 0)) OVER () AS p FROM st LEFT JOIN sc USING (state)),
first_ AS (SELECT symbol, state, starts.p * emits.p / sum(starts.p * emits.p) OVER (PARTITION BY symbol) AS p FROM starts JOIN emits USING (state)),
b AS (SELECT symbol, {", ".join(f"max(p) FILTER (state = {at[x]}) AS b{x}" for x in at)} FROM first_ GROUP BY symbol), m AS (SELECT {cells} FROM moves),
w AS (SELECT symbol, 0 AS k, bs, bv, bd, 0::DOUBLE AS prob FROM b UNION ALL SELECT symbol, k + 1, {into["s"]}, {into["v"]}, 0::DOUBLE, {into["d"]} FROM w, m WHERE k < 10)
SELECT symbol::INTEGER AS symbol, k::INTEGER AS events, round(prob, 9) AS prob FROM w WHERE k > 0"""


QUERIES["hidden_markov_waiting"] = lambda spark, sf_dir: rounded(C.hidden_belief(spark, sf_dir), 9)
SQL["hidden_markov_waiting"] = hidden_sql()
