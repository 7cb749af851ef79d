"""Made-up event streams: given types, independent draws, draws that depend on the past, and draws from a suffix automaton."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "id long, event_type string, ts long"


def of_types(spark: SparkSession, types) -> DataFrame:
    return spark.createDataFrame([(k, t, k) for k, t in enumerate(types, 1)], SCHEMA)


def independent(spark: SparkSession, size: int, probs: dict[str, float], seed: int = 0, attr: list[str] | None = None) -> DataFrame:
    """Types drawn by probability, on the executors."""
    at, u = 0.0, F.rand(seed)
    rows = spark.range(1, size + 1).withColumn("_u", u)
    kinds, chosen = list(probs), None
    for k in kinds[:-1]:
        at += probs[k]
        chosen = F.when(F.col("_u") < at, k) if chosen is None else chosen.when(F.col("_u") < at, k)
    rows = rows.withColumn("event_type", chosen.otherwise(kinds[-1]) if chosen is not None else F.lit(kinds[-1])).withColumn("ts", F.col("id"))
    if attr:
        rows = rows.withColumn("attr", F.element_at(F.array(*map(F.lit, attr)), (F.floor(F.rand(seed + 1) * len(attr)) + 1).cast("int")))
    return rows.drop("_u")


def conditional(spark: SparkSession, size: int, probs: dict[tuple, dict[str, float]], seed: int = 0) -> DataFrame:
    """probs: next-type probabilities by the last types, latest last; () is what to fall back on."""
    rng, past, out = np.random.default_rng(seed), (), []
    order = max(map(len, probs))
    for _ in range(size):
        context = past
        while context not in probs:
            context = context[1:]
        p = probs[context]
        t = str(rng.choice(list(p), p=np.array(list(p.values())) / sum(p.values())))
        out.append(t)
        past = (*past, t)[-order:] if order else ()
    return of_types(spark, out)


def from_xml(text: str) -> dict[tuple, dict[str, float]]:
    """<probability given="A,B" type="C" value="0.5"/> elements as the table that ``conditional`` takes."""
    import xml.etree.ElementTree as ET

    out: dict[tuple, dict[str, float]] = {}
    for e in ET.fromstring(text).iter("probability"):
        given = tuple(x for x in e.attrib.get("given", "").split(",") if x)
        out.setdefault(given, {})[e.attrib["type"]] = float(e.attrib["value"])
    return out


def of_automaton(spark: SparkSession, automaton, types: list[str], size: int, seed: int = 0) -> DataFrame:
    return of_types(spark, [types[s] for s in automaton.sample(size, np.random.default_rng(seed))])


def replay(df: DataFrame, folder: str, files: int = 10) -> None:
    """Write a stream as ``files`` JSON files in the order of time, one after the other: a file-based streaming source."""
    bounds = sorted(set(df.approxQuantile("ts", [k / files for k in range(1, files)], 0.0)))
    edges = [None, *bounds, None]
    for a, b in zip(edges, edges[1:]):
        part = df.where((F.col("ts") >= a if a is not None else F.lit(True)) & (F.col("ts") < b if b is not None else F.lit(True)))
        part.coalesce(1).write.mode("append").json(folder)
