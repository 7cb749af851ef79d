"""Event tables from files and streams: id, event_type, ts, is_reset and the domain's attributes.

A domain is a function from a DataFrame of lines (id, value) to an event table; ``@domain`` adds one. ``read`` gives
lines consecutive ids from 1 in file order; ``read_stream`` takes any streaming source of lines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DOMAINS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def domain(name: str):
    def add(f):
        DOMAINS[name] = f
        return f

    return add


def numbered(df: DataFrame) -> DataFrame:
    """Adds ``id``, consecutive from 1 in the order of partitions and rows: one count for each partition goes to the driver."""
    tagged = df.withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id())
    at, offsets = 0, {}
    for r in sorted(tagged.groupBy("_p").agg(F.count("*").alias("n")).collect(), key=lambda r: r["_p"]):
        offsets[r["_p"]], at = at, at + r["n"]
    if not offsets:
        return df.withColumn("id", F.lit(0).cast("long"))
    start = F.element_at(F.create_map(*[F.lit(x) for kv in offsets.items() for x in kv]), F.col("_p"))
    return tagged.withColumn("id", (F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)) + start + 1).cast("long")).drop("_p", "_m")


def read(spark: SparkSession, path: str, kind: str = "csv") -> DataFrame:
    return DOMAINS[kind](numbered(spark.read.text(path)))


def read_stream(lines: DataFrame, kind: str) -> DataFrame:
    """Events of a streaming DataFrame with ``value`` and, if the source has one, ``id`` (else a running number in each batch)."""
    rows = lines.withColumn("value", F.col("value").cast("string"))
    return DOMAINS[kind](rows if "id" in lines.columns else rows.withColumn("id", F.monotonically_increasing_id()))


def read_kafka(spark: SparkSession, servers: str, topic: str, kind: str, **options) -> DataFrame:
    """Needs Spark's Kafka connector on the class path. The offset is the id; a value ``terminate`` is no event."""
    rows = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).options(**options).load()
    return read_stream(rows.select(F.col("offset").alias("id"), F.col("value").cast("string")).where("value <> 'terminate'"), kind)


def kafka_options(path: str) -> dict:
    """Options from a Java properties file; ``inputTopic`` names the topic."""
    out = {}
    for line in open(path):
        key, eq, value = line.partition("=")
        if eq and not key.lstrip().startswith("#"):
            out[key.strip()] = value.strip()
    return out


def _fields(sep: str = ",") -> list[Column]:
    parts = F.split("value", sep, -1)
    return [F.trim(F.get(parts, k)) for k in range(16)]


def _need(column: Column, kind: str) -> Column:
    """Cast, failing on lines that don't parse."""
    return F.coalesce(column.try_cast(kind), F.raise_error(F.concat(F.lit("can't parse line: "), F.col("value"))).cast(kind))


def placed_resets(df: DataFrame, part: str | None = None) -> DataFrame:
    """Resets have no time of their own: each takes that of the last event before it."""
    w = Window.partitionBy(*([part] if part else [F.lit(0)])).orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    at = F.coalesce(F.last(F.when(~F.col("is_reset"), F.col("ts")), ignorenulls=True).over(w), F.lit(0).cast("long"))
    return df.withColumn("ts", F.when(F.col("is_reset"), at).otherwise(F.col("ts")))


@domain("csv")
def generic_csv(lines: DataFrame) -> DataFrame:
    """type, time; time -1 resets."""
    f = _fields()
    ts = _need(f[1], "long")
    return lines.where("trim(value) <> ''").select("id", f[0].alias("event_type"), ts.alias("ts"), (ts == -1).alias("is_reset"))


@domain("json")
def json_lines(lines: DataFrame, schema: str | None = None) -> DataFrame:
    """One object a line; ``timestamp`` is the time, else the id. Without a schema the lines are read once to find it."""
    if schema is None:
        spark = lines.sparkSession
        schema = spark.read.json(lines.select("value").rdd.map(lambda r: r[0])).schema
    found = lines.select("id", F.from_json("value", schema).alias("_e")).select("id", "_e.*")
    ts = F.coalesce(F.col("timestamp").cast("long"), F.col("id")) if "timestamp" in found.columns else F.col("id")
    return found.withColumn("ts", ts).withColumn("event_type", F.lit("GenericJson")).withColumn("is_reset", F.lit(False))


@domain("maritime")
def maritime(lines: DataFrame) -> DataFrame:
    """time, mmsi, lon, lat, speed, heading, cog, annotation[, time of the next complex event]; time -1 resets that mmsi."""
    f = _fields()
    ts = _need(f[0], "long")
    numbers = [_need(f[k], "double").alias(n) for k, n in enumerate(("lon", "lat", "speed", "heading", "cog"), 2)]
    return lines.where("trim(value) <> ''").select("id", F.lit("SampledCritical").alias("event_type"), ts.alias("ts"), (ts == -1).alias("is_reset"), f[1].alias("mmsi"), *numbers, f[7].alias("annotation"), F.coalesce(f[8].try_cast("long"), F.lit(-1).cast("long")).alias("nextCETimestamp"))


def _call(kinds: str):
    """Fields of KIND(a=x,b=y,…) as texts: the kind and the values."""
    value = F.regexp_extract("value", rf"^\s*(?:{kinds})\((.*)\)\s*$", 1)
    parts = F.split(value, ",", -1)
    return F.regexp_extract("value", rf"^\s*({kinds})\(", 1), [F.trim(F.get(F.split(F.get(parts, k), "="), 1)) for k in range(16)]


@domain("stock")
def stock(lines: DataFrame) -> DataFrame:
    kind, f = _call("BUY|SELL")
    return lines.where("trim(value) <> ''").select(_need(f[0], "int").cast("long").alias("id"), kind.alias("event_type"), _need(f[4], "long").alias("ts"), F.lit(False).alias("is_reset"), f[1].alias("name"), _need(f[2], "int").alias("volume"), _need(f[3], "double").alias("price"))


@domain("homes")
def homes(lines: DataFrame) -> DataFrame:
    kind, f = _call("LOAD")
    return lines.where("trim(value) <> ''").select(_need(f[0], "int").cast("long").alias("id"), kind.alias("event_type"), _need(f[1], "long").alias("ts"), F.lit(False).alias("is_reset"), f[1].alias("plug_timestamp"), _need(f[2], "double").alias("value"), _need(f[4], "long").alias("householdId"))


@domain("taxi")
def taxi(lines: DataFrame) -> DataFrame:
    kind, f = _call("TRIP")
    zone = lambda k: F.regexp_replace(f[k], r"[\s/]", "")
    return lines.where("trim(value) <> ''").select(_need(f[0], "int").cast("long").alias("id"), kind.alias("event_type"), _need(f[4], "long").alias("ts"), F.lit(False).alias("is_reset"), zone(7).alias("pickupZone"), zone(8).alias("dropoffZone"), _need(f[15], "double").alias("totalAmount"))


def events_of(df: DataFrame, id_: str, ts: str, event_type: str | Column | None = None, **attributes) -> DataFrame:
    """Any table as an event table: the id, a time (timestamps become microseconds), a type, and renamed attributes."""
    time = F.col(ts)
    kind = dict(df.dtypes)[ts]
    if kind in ("timestamp", "timestamp_ntz", "date"):
        time = F.unix_micros(time.cast("timestamp"))
    what = event_type if isinstance(event_type, Column) else F.col(event_type) if event_type else F.lit("event")
    return df.select(F.col(id_).cast("long").alias("id"), time.cast("long").alias("ts"), what.cast("string").alias("event_type"), *[(v if isinstance(v, Column) else F.col(v)).alias(k) for k, v in attributes.items()])


# --- splits -------------------------------------------------------------------------------------------------------
def split(df: DataFrame, share: float, offset: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Train and test: the stretch of the stream from ``offset`` that holds ``share`` of the events, and the rest."""
    from motifline.operators.markov import _numbered

    n = df.count()
    rows = _numbered(df) if n else df.withColumn("_row", F.lit(0))
    inside = (F.col("_row") > int(n * offset)) & (F.col("_row") <= int(n * offset) + int(n * share))
    return rows.where(inside).drop("_row"), rows.where(~inside).drop("_row")


def folds(df: DataFrame, k: int = 10):
    for i in range(k):
        yield split(df, 1 / k, i / k)
