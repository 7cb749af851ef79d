"""The registered queries over the event tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motifline.operators import forecast as fc
from motifline.operators import hidden, markov, suffix_trees, waiting
from motifline.operators import recognize as R
from motifline.plans.compiled import CompiledPattern, compile_one, compile_pattern, keywords
from motifline.sources.readers import events_of

TYPES = ("click", "error", "purchase", "signup", "view")
ONE_TYPE = "~(" + ",".join(f"IsEventTypePredicate({t})" for t in TYPES) + "),+(" + ",".join(f"IsEventTypePredicate({t})" for t in TYPES) + ")"

QUERIES: dict = {}
SQL: dict[str, str] = {}


def is_(t: str) -> str:
    return f"IsEventTypePredicate({t})"


# --- streams ------------------------------------------------------------------------------------------------------
def user_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events_of(t, "event_id", "ts", "event_type", user="user_id", value="value", k=F.get_json_object("props", "$.k").cast("double"))


def customer_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return events_of(t, "o_orderkey", "o_orderdate", "o_orderstatus", customer="o_custkey", price="o_totalprice", priority="o_orderpriority")


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    # the order within an order is (shipdate, linenumber, partkey, suppkey)
    key = F.col("l_linenumber").cast("long") * (1 << 40) + F.col("l_partkey") * (1 << 16) + F.col("l_suppkey")
    return events_of(t.withColumn("_key", key), "_key", "l_shipdate", "l_returnflag", order="l_orderkey", price="l_extendedprice", quantity="l_quantity", flag="l_returnflag")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return events_of(t, "turn", "turn", "role", conversation="conv_id", length=F.length("text").cast("double"))


STREAM_SQL = {
    user_events: "SELECT event_id AS id, epoch_us(ts) AS ts, event_type, user_id::VARCHAR AS part, value, json_extract_string(props, '$.k')::DOUBLE AS k FROM events",
    customer_orders: "SELECT o_orderkey AS id, epoch_us(o_orderdate) AS ts, o_orderstatus AS event_type, o_custkey::VARCHAR AS part, o_totalprice AS price, o_orderpriority AS priority FROM orders",
    order_lines: "SELECT l_linenumber::BIGINT * 1099511627776 + l_partkey * 65536 + l_suppkey AS id, epoch_us(l_shipdate) AS ts, l_returnflag AS event_type, l_orderkey::VARCHAR AS part, l_extendedprice AS price, l_quantity AS quantity FROM lineitem",
    turns: "SELECT turn AS id, turn AS ts, role AS event_type, conv_id::VARCHAR AS part, length(text)::DOUBLE AS length FROM conversations",
}


def stream_sql(stream) -> str:
    """The stream with each event's number in its partition."""
    return f"s AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY part ORDER BY ts, id) AS n FROM ({STREAM_SQL[stream]}))"


def shown(matches: DataFrame) -> DataFrame:
    return matches.select("pattern_id", "part", "match_ts", "end_id", F.array_join("events", ",").alias("events"), "first_counter", "last_counter")


def matching(name: str, stream, text: str, sql: str | None = None, declarations: str = "", **options) -> None:
    """Register the matches of a pattern. ``sql`` is a query over s that gives part and the matched rows' numbers n1 … nk."""
    patterns = compile_pattern(text, declarations)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return shown(R.all_matches(stream(spark, sf_dir), patterns, **options))

    QUERIES[name] = run
    if sql:
        SQL[name] = sql if sql.lstrip().startswith("WITH") else chain_sql(stream, sql)


def chain_sql(stream, body: str, pattern_id: int = 0) -> str:
    """``body`` selects one row a match: part, ids (list of matched ids in order), n_first, n_last, ts_last."""
    return f"WITH {stream_sql(stream)}, m AS ({body}) SELECT {pattern_id}::INTEGER AS pattern_id, part, ts_last AS match_ts, ids[len(ids)] AS end_id, array_to_string(ids, ',') AS events, n_first AS first_counter, n_last AS last_counter FROM m"


def joined_sql(tests: list[str], between: str, window: str = "") -> str:
    """A self-join for k elements e1 … ek. ``between``: how an element's number follows the last one's."""
    k = len(tests)
    tables = " JOIN ".join([f"s e{i}" + (f" ON e{i}.part = e{i - 1}.part AND {between.format(a=f'e{i - 1}', b=f'e{i}')}" if i > 1 else "") for i in range(1, k + 1)])
    where = " AND ".join(t.format(e=f"e{i}") for i, t in enumerate(tests, 1)) + (f" AND {window}" if window else "")
    ids = ", ".join(f"e{i}.id" for i in range(1, k + 1))
    return f"SELECT e1.part AS part, [{ids}] AS ids, e1.n AS n_first, e{k}.n AS n_last, e{k}.ts AS ts_last FROM {tables} WHERE {where}"


def kind(t: str) -> str:
    return "{e}.event_type = '" + t + "'"


NEXT_TO = "{b}.n = {a}.n + 1"
AFTER = "{b}.n > {a}.n"

# contiguous sequences: one window pass
matching("seq_view_purchase", user_events, f";({is_('view')},{is_('purchase')}){{partitionBy:user}}", joined_sql([kind("view"), kind("purchase")], NEXT_TO))
matching("seq_choice", user_events, f";({is_('view')},+({is_('click')},{is_('error')}),{is_('purchase')}){{partitionBy:user}}", joined_sql([kind("view"), "{e}.event_type IN ('click', 'error')", kind("purchase")], NEXT_TO))
matching("seq_time_window", user_events, f";({is_('click')},{is_('click')}){{partitionBy:user}}{{window:600000000}}{{windowType:time}}", joined_sql([kind("click"), kind("click")], NEXT_TO, "e2.ts - e1.ts < 600000000"))
matching("seq_whole_stream", user_events, f";({is_('signup')},{is_('purchase')})", f"WITH s AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY ts, id) AS n FROM ({STREAM_SQL[user_events]})) SELECT 0::INTEGER AS pattern_id, '$' AS part, b.ts AS match_ts, b.id AS end_id, a.id || ',' || b.id AS events, a.n AS first_counter, b.n AS last_counter FROM s a JOIN s b ON b.n = a.n + 1 WHERE a.event_type = 'signup' AND b.event_type = 'purchase'")
matching("seq_register_greater", user_events, f';({is_("view")}["x"],^({is_("purchase")},GTAttr(value,"x"))){{partitionBy:user}}', joined_sql([kind("view"), kind("purchase")], NEXT_TO, "e2.value > e1.value"))
matching("seq_rising_prices", order_lines, ';(GT(price,0.0)["a"],GTAttr(price,"a")["b"],GTAttr(price,"b")){partitionBy:order}', joined_sql(["{e}.price > 0", "true", "true"], NEXT_TO, "e2.price > e1.price AND e3.price > e2.price"))
matching("seq_predicates", customer_orders, f';(^({is_("O")},BT(price,50000.0,150000.0)),|(GTE(price,200000.0),EQStr(priority,HIGH)),^(-LT(price,20000.0),LTE(price,300000.0))){{partitionBy:customer}}', joined_sql(["{e}.event_type = 'O' AND {e}.price >= 50000 AND {e}.price < 150000", "({e}.price >= 200000 OR {e}.priority = 'HIGH')", "NOT {e}.price < 20000 AND {e}.price <= 300000"], NEXT_TO))
matching("seq_json_attribute", user_events, f";(^({is_('view')},LT(k,50.0)),GTE(k,50.0)){{partitionBy:user}}", joined_sql(["{e}.event_type = 'view' AND {e}.k < 50", "{e}.k >= 50"], NEXT_TO))
matching("seq_dialogue", turns, f";({is_('user')},^({is_('assistant')},GT(length,100.0))){{partitionBy:conversation}}", joined_sql([kind("user"), "{e}.event_type = 'assistant' AND {e}.length > 100"], NEXT_TO))
matching("seq_equal_quantity", order_lines, ';(GT(quantity,0.0)["x"],EQAttr(quantity,"x")){partitionBy:order}', joined_sql(["{e}.quantity > 0", "true"], NEXT_TO, "e2.quantity = e1.quantity"))
matching("seq_same_flag", order_lines, f';({is_("R")}["x"],EQAttrStr(flag,"x"),LTAttr(price,"x")){{partitionBy:order}}', joined_sql([kind("R"), kind("R"), "true"], NEXT_TO, "e3.price < e1.price"))

# skip-till-next: running pointers
NEXT_SQL = """SELECT part, [id, q.id] AS ids, n AS n_first, q.n AS n_last, q.ts AS ts_last FROM (
  SELECT *, first(CASE WHEN event_type = 'purchase' THEN {'id': id, 'n': n, 'ts': ts} END IGNORE NULLS) OVER (PARTITION BY part ORDER BY n ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS q FROM s)
  WHERE event_type = 'view' AND q IS NOT NULL"""
matching("next_view_purchase", user_events, f"@(;({is_('view')},{is_('purchase')})){{partitionBy:user}}", NEXT_SQL)
THREE_SQL = """SELECT a.part AS part, [a.id, b.id, c.id] AS ids, a.n AS n_first, c.n AS n_last, c.ts AS ts_last FROM s a
  JOIN s b ON b.part = a.part AND b.n = (SELECT min(n) FROM s x WHERE x.part = a.part AND x.n > a.n AND x.event_type = 'click')
  JOIN s c ON c.part = b.part AND c.n = (SELECT min(n) FROM s x WHERE x.part = b.part AND x.n > b.n AND x.event_type = 'purchase')
  WHERE a.event_type = 'signup' AND c.n - a.n < 12"""
matching("next_three_windowed", user_events, f"@(;({is_('signup')},{is_('click')},{is_('purchase')})){{partitionBy:user}}{{window:12}}", THREE_SQL)

# skip-till-any: bucketed range joins
matching("any_count_window", user_events, f"#(;({is_('view')},{is_('click')},{is_('purchase')})){{partitionBy:user}}{{window:8}}", joined_sql([kind("view"), kind("click"), kind("purchase")], AFTER, "e3.n - e1.n < 8"))
matching("any_time_window_register", user_events, f'#(;({is_("view")}["x"],^({is_("purchase")},GTAttr(value,"x")))){{partitionBy:user}}{{window:3600000000}}{{windowType:time}}', joined_sql([kind("view"), kind("purchase")], AFTER, "e2.ts - e1.ts < 3600000000 AND e2.value > e1.value"))
matching("any_orders", customer_orders, f';({is_("F")},{is_("O")}){{partitionBy:customer}}&#(;(^({is_("O")},GT(price,250000.0))["x"],LTAttr(price,"x"))){{partitionBy:customer}}{{window:4}}')
SQL["any_orders"] = f"""SELECT * FROM ({chain_sql(customer_orders, joined_sql([kind("F"), kind("O")], NEXT_TO))})
UNION ALL SELECT * FROM ({chain_sql(customer_orders, joined_sql(["{e}.event_type = 'O' AND {e}.price > 250000", "true"], AFTER, "e2.n - e1.n < 4 AND e2.price < e1.price"), 1)})"""

# iteration and complement: runs over the sorted stream
matching("kleene_signup_views_purchase", user_events, f";({is_('signup')},*({is_('view')}),{is_('purchase')}){{partitionBy:user}}", """SELECT a.part AS part, list(x.id ORDER BY x.n) AS ids, a.n AS n_first, b.n AS n_last, b.ts AS ts_last
  FROM (SELECT *, sum(CASE WHEN event_type <> 'view' THEN 1 ELSE 0 END) OVER (PARTITION BY part ORDER BY n) AS o FROM s) a
  JOIN (SELECT *, sum(CASE WHEN event_type <> 'view' THEN 1 ELSE 0 END) OVER (PARTITION BY part ORDER BY n) AS o FROM s) b ON a.part = b.part AND b.n > a.n AND b.o = a.o + 1
  JOIN s x ON x.part = a.part AND x.n BETWEEN a.n AND b.n WHERE a.event_type = 'signup' AND b.event_type = 'purchase' GROUP BY a.part, a.n, b.n, b.ts""")
matching("kleene_rising_run", customer_orders, ';(GT(price,100000.0)["x"],*(GTAttr(price,"x"))){partitionBy:customer}{window:3}', """SELECT a.part AS part, list(x.id ORDER BY x.n) AS ids, a.n AS n_first, b.n AS n_last, b.ts AS ts_last FROM s a JOIN s b ON a.part = b.part AND b.n BETWEEN a.n AND a.n + 2
  JOIN s x ON x.part = a.part AND x.n BETWEEN a.n AND b.n WHERE a.price > 100000
  AND NOT EXISTS (SELECT 1 FROM s y WHERE y.part = a.part AND y.n > a.n AND y.n <= b.n AND NOT y.price > a.price) GROUP BY a.part, a.n, b.n, b.ts""")
matching("no_error_between", user_events, f";({is_('signup')},!(;(*(TruePredicate()),{is_('error')},*(TruePredicate()))),{is_('purchase')}){{partitionBy:user}}{{window:10}}", """SELECT a.part AS part, [a.id, b.id] AS ids, a.n AS n_first, b.n AS n_last, b.ts AS ts_last FROM s a JOIN s b ON a.part = b.part AND b.n > a.n AND b.n - a.n < 10
  WHERE a.event_type = 'signup' AND b.event_type = 'purchase' AND NOT EXISTS (SELECT 1 FROM s y WHERE y.part = a.part AND y.n > a.n AND y.n < b.n AND y.event_type = 'error')""")

# end points only (what a deterministic register automaton reports)
REGISTERS = compile_one(f'#(;({is_("view")}["x"],^({is_("purchase")},GTAttr(value,"x")))){{partitionBy:user}}{{window:20}}')


def end_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.end_points(R.matches(user_events(spark, sf_dir), REGISTERS))


QUERIES["end_points_register"] = end_points
SQL["end_points_register"] = f"WITH {stream_sql(user_events)}, m AS ({joined_sql([kind('view'), kind('purchase')], AFTER, 'e2.n - e1.n < 20 AND e2.value > e1.value')}) SELECT DISTINCT 0::INTEGER AS pattern_id, part, ts_last AS match_ts, ids[2] AS end_id, n_last AS last_counter FROM m"


# --- deterministic automata and models ----------------------------------------------------------------------------
PAIR = compile_one(f";({is_('view')},{is_('purchase')}){{partitionBy:user}}", ONE_TYPE)


def detected(c: CompiledPattern, stream, chunks: int = 0):
    return lambda spark, sf_dir: R.detections(stream(spark, sf_dir), c, chunks)


QUERIES["detect_view_purchase"] = detected(PAIR, user_events)
SQL["detect_view_purchase"] = f"WITH {stream_sql(user_events)} SELECT 0::INTEGER AS pattern_id, b.part AS part, b.ts AS match_ts, b.id AS end_id, b.n AS last_counter FROM s a JOIN s b ON a.part = b.part AND b.n = a.n + 1 WHERE a.event_type = 'view' AND b.event_type = 'purchase'"

# one stream without partitions, cut into chunks of time whose moves are chained
REPEAT = compile_one(f";({is_('click')},{is_('click')})", ONE_TYPE)
QUERIES["detect_whole_stream_nonoverlap"] = detected(REPEAT, user_events, 16)
SQL["detect_whole_stream_nonoverlap"] = f"""WITH s AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY ts, id) AS n FROM ({STREAM_SQL[user_events]})),
g AS (SELECT *, sum(CASE WHEN event_type <> 'click' THEN 1 ELSE 0 END) OVER (ORDER BY n) AS island FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY island ORDER BY n) AS place FROM g WHERE event_type = 'click')
SELECT 0::INTEGER AS pattern_id, '$' AS part, ts AS match_ts, id AS end_id, n AS last_counter FROM r WHERE place % 2 = 0"""
WORDS = keywords([["click", "click", "purchase"], ["view", "error"]], partition_by="user")
QUERIES["detect_keywords"] = detected(WORDS, user_events)
SQL["detect_keywords"] = f"""WITH {stream_sql(user_events)}, p AS (SELECT *, lag(event_type) OVER w AS t1, lag(event_type, 2) OVER w AS t2 FROM s WINDOW w AS (PARTITION BY part ORDER BY n))
SELECT 0::INTEGER AS pattern_id, part, ts AS match_ts, id AS end_id, n AS last_counter FROM p WHERE (t2 = 'click' AND t1 = 'click' AND event_type = 'purchase') OR (t1 = 'view' AND event_type = 'error')"""


def pair_states() -> tuple[int, int, int]:
    """The numbers of the pair's states: nothing yet, after a view, after the match."""
    dfa, masks = PAIR.dfa, PAIR.alphabet.masks
    sym = {a.args[0]: masks.index(1 << k) for k, a in enumerate(PAIR.alphabet.atoms)}
    seen = int(dfa.table[dfa.start, sym["view"]])
    return dfa.start, seen, int(dfa.table[seen, sym["purchase"]])


def labelled_sql() -> str:
    start, seen, done = pair_states()
    return f"""{stream_sql(user_events)}, p AS (SELECT *, lag(event_type) OVER w AS t1, lag(event_type, 2) OVER w AS t2 FROM s WINDOW w AS (PARTITION BY part ORDER BY n)),
l AS MATERIALIZED (SELECT part, id, ts, n, event_type, CASE WHEN event_type = 'view' THEN {seen} WHEN event_type = 'purchase' AND t1 = 'view' THEN {done} ELSE {start} END AS state,
  CASE WHEN t1 = 'view' THEN {seen} WHEN t1 = 'purchase' AND t2 = 'view' THEN {done} ELSE {start} END AS before FROM p)"""


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markov.transition_counts(user_events(spark, sf_dir), PAIR)


QUERIES["markov_transitions"] = transitions
SQL["markov_transitions"] = f"WITH {labelled_sql()}, c AS (SELECT before, state, count(*) AS n FROM l GROUP BY ALL) SELECT before::INTEGER AS before, state::INTEGER AS state, n, n / sum(n) OVER (PARTITION BY before) AS prob FROM c"


def remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = waiting.remaining_times(R.label(user_events(spark, sf_dir), PAIR))
    return out.select("state", F.round("mean", 6).alias("mean"), F.round("deviation", 6).alias("deviation"), "n")


QUERIES["remaining_times"] = remaining
SQL["remaining_times"] = f"""WITH {labelled_sql()}, g AS (SELECT state, first(CASE WHEN state = {pair_states()[2]} THEN n END IGNORE NULLS) OVER (PARTITION BY part ORDER BY n ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) - n AS gap FROM l)
SELECT state::INTEGER AS state, round(avg(gap), 6) AS mean, round(coalesce(stddev_samp(gap), 0), 6) AS deviation, count(*) AS n FROM g WHERE gap IS NOT NULL GROUP BY state"""


def symbol_sql() -> str:
    masks = PAIR.alphabet.masks
    return "CASE event_type " + " ".join(f"WHEN '{a.args[0]}' THEN {masks.index(1 << k)}" for k, a in enumerate(PAIR.alphabet.atoms)) + " ELSE 0 END"


def contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_trees.count_contexts(R.label(user_events(spark, sf_dir), PAIR).select("part", "counter", "symbol"), 2)
    return found.select(F.array_join(F.col("context").cast("array<string>"), ",").alias("context"), "n")


QUERIES["context_counts"] = contexts
SQL["context_counts"] = f"""WITH {stream_sql(user_events)}, y AS (SELECT part, n, ({symbol_sql()})::VARCHAR AS a FROM s), z AS (SELECT a, lag(a) OVER w AS b, lag(a, 2) OVER w AS c FROM y WINDOW w AS (PARTITION BY part ORDER BY n)),
e AS (SELECT a AS context FROM z UNION ALL SELECT a || ',' || b FROM z WHERE b IS NOT NULL UNION ALL SELECT a || ',' || b || ',' || c FROM z WHERE c IS NOT NULL) SELECT context, count(*) AS n FROM e GROUP BY context"""


def next_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_trees.count_contexts(R.label(user_events(spark, sf_dir), PAIR).select("part", "counter", "symbol"), 1)
    out = suffix_trees.conditional(found)
    return out.select(F.array_join(F.col("context").cast("array<string>"), ",").alias("context"), "symbol", "n", F.round("prob", 9).alias("prob"))


QUERIES["next_symbol_probabilities"] = next_symbols
SQL["next_symbol_probabilities"] = f"""WITH {stream_sql(user_events)}, y AS (SELECT part, n, {symbol_sql()} AS a FROM s), z AS (SELECT a, lag(a) OVER (PARTITION BY part ORDER BY n) AS b FROM y),
e AS (SELECT '' AS context, a AS symbol FROM z UNION ALL SELECT b::VARCHAR, a FROM z WHERE b IS NOT NULL), c AS (SELECT context, symbol, count(*) AS n FROM e GROUP BY ALL)
SELECT context, symbol::INTEGER AS symbol, n, round(n / sum(n) OVER (PARTITION BY context), 9) AS prob FROM c"""


# --- forecasts: learned on the whole stream, emitted on it, held against what came ---------------------------------
def interval_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = user_events(spark, sf_dir)
    return fc.forecast(events, PAIR, markov.learn_markov(events, PAIR), "smart-scan", 0.5, 100, 100)


def interval_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = user_events(spark, sf_dir)
    labels = R.label(events, PAIR)
    return fc.regression_scores(fc.forecast(events, PAIR, markov.learn_markov(events, PAIR), "argmax", 0.3, 100, 50), labels)


def scores_by_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = user_events(spark, sf_dir)
    return fc.regression_by_state(fc.forecast(events, PAIR, markov.learn_markov(events, PAIR), "smart-scan", 0.5, 100, 100), R.label(events, PAIR))


def classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = user_events(spark, sf_dir)
    found = fc.forecast(events, PAIR, markov.learn_markov(events, PAIR), "classify-nextk", 0.3, 100, 10)
    return fc.classification_scores(fc.classification_counts(found, R.label(events, PAIR)))


def variable_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = user_events(spark, sf_dir)
    tree = suffix_trees.learn_tree(suffix_trees.learn_counts(events, PAIR, 2, 0.001), 2)
    return fc.forecast_variable(events, PAIR, tree, method="classify-nextk", threshold=0.3, horizon=20, spread=10)


def log_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = user_events(spark, sf_dir)
    tree = suffix_trees.learn_tree(suffix_trees.learn_counts(events, PAIR, 2, 0.001), 2)
    return suffix_trees.log_loss(R.label(events, PAIR).select("part", "counter", "symbol"), tree)


def next_foretold(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = user_events(spark, sf_dir)
    both = [PAIR, compile_one(f";({is_('click')},{is_('view')}){{partitionBy:user}}", ONE_TYPE)]
    return fc.next_scores([(R.label(events, c), waiting.next_table(markov.learn_markov(events, c), 0.15)) for c in both])


def hidden_belief(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waiting times after each symbol by a hidden Markov model of the pair's states."""
    labels = R.label(user_events(spark, sf_dir), PAIR)
    n = len(PAIR.alphabet.masks)
    model = hidden.fit(labels, PAIR.dfa.n, n)
    rows = [(s, k, float(p)) for s in range(n) for k, p in enumerate(model.waiting([s], PAIR.dfa.finals, 10), 1)]
    return spark.createDataFrame(rows, "symbol int, events int, prob double")


QUERIES |= {
    "forecast_intervals": interval_forecasts, "forecast_interval_scores": interval_scores, "forecast_scores_by_state": scores_by_state, "forecast_classification": classification,
    "forecast_variable_order": variable_order, "log_loss": log_losses, "next_scores": next_foretold, "hidden_markov_waiting": hidden_belief,
}
