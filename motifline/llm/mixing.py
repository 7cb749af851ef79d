"""Mixing sources to target weights by Pareto order sampling.

Each source's target is its share by weight, capped at ``cap`` times its size, what is above being reshared by weight.
A document's expected copies are target / source size. Their whole part is taken for certain; for the rest each source
draws a sample without replacement: documents are ranked by random odds over inclusion odds (Rosen's Pareto order),
and the lowest are taken up to the first that exceeds the source's target. A document's inclusion odds are those of
the fractional part of its expected copies times sqrt(size), so longer documents are likelier; ``tilt`` names a column
of other factors. What is still missing after the cut is filled: from the greatest size that fits downwards, of each
size the undrawn document of lowest rank is taken if it still fits.

The random number is the first 52 bits of an MD5 of seed and id, so reruns agree on any cluster. The cut is found
without ranking a source in one task: ranks are bucketed, words are summed by bucket, and only the bucket that holds
the cut (about one in ``buckets`` of a source's rows) is ordered row by row. The fill works on a source's distinct sizes
that fit, which are fewer than its longest document's words.

Null or empty text has size 0 and is never drawn beyond whole copies of nothing; a very long text is one document. A
null source is a source of its own, last. Repeated rows have equal ranks and are drawn together; other ties are ordered
by id, then size. An empty table gives no rows. Extra columns may have any names: ``repeat`` returns them all,
``sample`` those that don't have the name of one of its results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from motifline.llm.common import Scratch


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(F.col(text), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """sizes (source, source_size), one row a source, to (…, weight, target).

    The water level: sources whose cap over weight is lowest stop at their caps, the others share what is left.
    """
    order = [F.col("source").isNull(), F.col("source")]
    every = Window.orderBy(*order)
    out = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(every) - 1, F.lit(len(weights))) + 1).cast("int")).cast("double"))
    out = out.withColumn("_mix_cap", F.col("source_size") * F.lit(float(cap)))
    whole = Window.partitionBy()
    lower = Window.orderBy(F.col("_mix_cap") / F.col("weight"), *order).rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("_mix_cap").over(lower), F.lit(0.0))
    out = out.withColumn("_mix_level", left / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(lower), F.lit(0.0))))
    out = out.withColumn("_mix_level", F.max(F.when(F.col("_mix_level") * F.col("weight") <= F.col("_mix_cap"), F.col("_mix_level"))).over(whole))
    capped = F.least(F.col("_mix_cap"), F.coalesce(F.col("_mix_level") * F.col("weight"), F.col("_mix_cap")))
    return out.select("source", "source_size", "weight", capped.alias("target"))


def plan(sizes: DataFrame, weights: tuple, cap: float) -> DataFrame:
    """One row a source: target, whole copies and the share that is drawn. sizes: (doc_id, source, size)."""
    goal = targets(sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size")), weights, cap).drop("weight")
    goal = goal.withColumn("_mix_whole", F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)).cast("long"))
    goal = goal.withColumn("_mix_words", F.col("target") - F.col("_mix_whole") * F.col("source_size"))
    goal = goal.withColumn("_mix_p", F.coalesce(F.try_divide("_mix_words", "source_size"), F.lit(0.0)))
    return goal


def _ranked(docs: DataFrame, goal: DataFrame, seed: str, buckets: int, few: bool) -> DataFrame:
    """docs with its source's row of ``goal`` and _mix_key: (rank, id, size), null for rows that can't be drawn."""
    goal = goal.withColumnRenamed("source", "_mix_source")
    out = docs.join(F.broadcast(goal) if few else goal, F.col("source").eqNullSafe(F.col("_mix_source"))).drop("_mix_source")
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))
    odds = F.try_divide(F.col("_mix_p"), 1 - F.col("_mix_p")) * F.col("_mix_tilt")
    q = F.try_divide(F.col("_mix_u") / (1 - F.col("_mix_u")), odds)
    out = out.withColumn("_mix_u", u).withColumn("_mix_rank", q / (1 + q))
    key = F.struct(F.col("_mix_rank"), F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).alias("id"), F.col("size"))
    out = out.withColumn("_mix_key", F.when((F.col("_mix_p") > 0) & (F.col("size") > 0) & F.col("_mix_rank").isNotNull(), key))
    return out.withColumn("_mix_bucket", F.when(F.col("_mix_key").isNotNull(), F.least(F.floor(F.col("_mix_rank") * buckets), F.lit(buckets - 1)).cast("int")))


def _fill(left: DataFrame) -> DataFrame:
    """left: source, size, _mix_key, _mix_gap, one row for each size that fits into its source's gap; to the rows taken."""

    def take(rows):
        rows = rows.sort_values("size", ascending=False)
        gap, yes = int(rows["_mix_gap"].iloc[0]) if len(rows) else 0, []
        for n in rows["size"].tolist():
            yes.append(n <= gap)
            gap -= n * yes[-1]
        return rows.loc[yes, ["source", "size"]]

    return left.select("source", "size", F.floor("_mix_gap").cast("long").alias("_mix_gap")).groupBy("source").applyInPandas(take, left.select("source", "size").schema)


def _copies(spark: SparkSession, docs: DataFrame, weights: tuple, cap: float, seed: str, buckets: int, tilt: str | None, few: int) -> DataFrame:
    """row (the columns of ``docs``), doc_id, size, source_size, target and copies."""
    scratch = Scratch(spark, "mixing")
    docs = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "source", n_words().alias("size"), *([F.col(tilt).cast("double").alias("_mix_tilt")] if tilt else []))
    if not tilt:
        docs = docs.withColumn("_mix_tilt", F.sqrt("size"))
    sizes = scratch.put(docs.drop("row"), "sizes")
    goal = scratch.put(plan(sizes, weights, cap), "goal")
    small = goal.count() <= few
    small_or_not = F.broadcast if small else lambda df: df
    ranked = _ranked(sizes, goal, seed, buckets, small)

    # words by bucket of ranks, the bucket that holds the cut, and the cut among its rows
    per = ranked.where("_mix_bucket IS NOT NULL").groupBy("source", "_mix_bucket", "_mix_words").agg(F.sum("size").alias("_mix_sum"))
    upto = Window.partitionBy("source").orderBy("_mix_bucket").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_mix_before", F.coalesce(F.sum("_mix_sum").over(upto), F.lit(0)))
    cut = per.where((F.col("_mix_before") < F.col("_mix_words")) & (F.col("_mix_before") + F.col("_mix_sum") >= F.col("_mix_words")))
    cut = scratch.put(cut.select(F.col("source").alias("_mix_source"), F.col("_mix_bucket").alias("_mix_cut"), "_mix_before"), "cut")
    near = ranked.join(small_or_not(cut), F.col("source").eqNullSafe(F.col("_mix_source")) & (F.col("_mix_bucket") == F.col("_mix_cut")))
    inside = Window.partitionBy("source").orderBy("_mix_key").rowsBetween(Window.unboundedPreceding, -1)
    short = F.col("_mix_words") - F.col("_mix_before") - F.coalesce(F.sum("size").over(inside), F.lit(0))  # words still missing before a row
    near = near.withColumn("_mix_short", short).groupBy("source").agg(F.max(F.when(F.col("_mix_short") >= F.col("size"), F.struct("_mix_key", (F.col("_mix_short") - F.col("size")).alias("gap")))).alias("_l"), F.max("_mix_short").alias("_s"))
    last = near.select(F.col("source").alias("_mix_source"), F.col("_l._mix_key").alias("_mix_last"), F.coalesce("_l.gap", "_s").alias("_mix_gap"))
    goal = goal.join(cut, goal["source"].eqNullSafe(cut["_mix_source"]), "left").drop("_mix_source", "_mix_before").join(last, F.col("source").eqNullSafe(F.col("_mix_source")), "left").drop("_mix_source")
    goal = scratch.put(goal, "plan")

    # what the cut leaves missing
    at_cut = F.col("_mix_last").isNotNull() & (F.col("_mix_key") <= F.col("_mix_last"))
    drawn = F.when(F.col("_mix_bucket").isNull(), False).when(F.col("_mix_cut").isNull() | (F.col("_mix_bucket") < F.col("_mix_cut")), True).when(F.col("_mix_bucket") > F.col("_mix_cut"), False).otherwise(at_cut)
    fits = _ranked(sizes, goal, seed, buckets, small).where(~drawn & F.col("_mix_key").isNotNull() & (F.col("size") <= F.col("_mix_gap")))
    fits = scratch.put(fits.groupBy("source", "size", "_mix_gap").agg(F.min("_mix_key").alias("_mix_key")), "fits")
    taken = _fill(fits).select(F.col("source").alias("_mix_of"), F.col("size").alias("_mix_size"))
    taken = fits.join(taken, F.col("source").eqNullSafe(F.col("_mix_of")) & (F.col("size") == F.col("_mix_size")))
    taken = scratch.put(taken.groupBy("source").agg(F.collect_list("_mix_key").alias("_mix_fill")).withColumnRenamed("source", "_mix_source"), "fill")  # distinct sizes

    goal = goal.join(taken, F.col("source").eqNullSafe(F.col("_mix_source")), "left").drop("_mix_source")
    out = _ranked(docs, scratch.put(goal, "filled"), seed, buckets, small)
    filled = F.coalesce(F.array_contains("_mix_fill", F.col("_mix_key")), F.lit(False))
    scratch.keep("filled")
    return out.select("row", "doc_id", "size", "source_size", "target", (F.col("_mix_whole") + F.when(drawn | filled, 1).otherwise(0)).cast("long").alias("copies"))


RESULTS = ("size", "source_size", "target", "copies")


def sample(spark: SparkSession, docs: DataFrame, weights: tuple = (1, 2, 3), cap: float = 3.0, seed: str = "mix", buckets: int = 4096, tilt: str | None = None, few: int = 100_000) -> DataFrame:
    """``docs`` (doc_id, source, text, …) with size, source_size, target and copies (0 to ``cap``).

    ``tilt`` names a column of positive factors on a document's inclusion odds, instead of sqrt(size). The plan has a
    row for each source; up to ``few`` sources it is broadcast, beyond that joined by a shuffle.
    """
    own = [F.col(f"row.`{c}`") for c in docs.columns if c.lower() not in RESULTS]
    return _copies(spark, docs, weights, cap, seed, buckets, tilt, few).select(*own, *RESULTS)


def repeat(spark: SparkSession, docs: DataFrame, weights: tuple = (1, 2, 3), cap: float = 3.0, seed: str = "mix", buckets: int = 4096, tilt: str | None = None, few: int = 100_000) -> DataFrame:
    """The rows of ``docs`` with all their columns, each as many times as the mix takes it."""
    taken = _copies(spark, docs, weights, cap, seed, buckets, tilt, few).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*[F.col(f"row.`{c}`") for c in docs.columns])


def sql(weights: tuple = (1, 2, 3), cap: float = 3.0, seed: str = "mix") -> str:
    """The mix of ``documents`` for DuckDB: every source ranked as a whole."""
    return rf"""WITH RECURSIVE sized AS (SELECT row_number() OVER () AS row, doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (SELECT source, source_size, ({list(weights)}::DOUBLE[])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)} + 1)::INT] AS weight, source_size * {cap}::DOUBLE AS cap FROM sums),
levels AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER below, 0::DOUBLE)) / (sum(weight) OVER () - coalesce(sum(weight) OVER below, 0::DOUBLE)) AS level
  FROM weighed WINDOW below AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goal AS (SELECT source, source_size, least(cap, coalesce(max(level) FILTER (level * weight <= cap) OVER () * weight, cap)) AS target FROM levels),
parts AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM goal),
odds AS (SELECT *, target - whole * source_size AS words, CASE WHEN source_size > 0 THEN (target - whole * source_size) / source_size ELSE 0::DOUBLE END AS p FROM parts),
drawn AS (SELECT row, doc_id, size, source_size, target, whole, words, p, (('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u, sized.source
  FROM sized JOIN odds ON sized.source IS NOT DISTINCT FROM odds.source),
ranked AS (SELECT *, u / (1 - u) / (p / (1 - p) * sqrt(size::DOUBLE)) AS q FROM drawn WHERE p > 0 AND size > 0),
ordered AS (SELECT *, q / (1 + q) AS rank, coalesce(doc_id, -9223372036854775808) AS id FROM ranked),
cut AS (SELECT *, words - coalesce(sum(size) OVER (PARTITION BY source ORDER BY rank, id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS short FROM ordered),
gaps AS (SELECT source, min(CASE WHEN short >= size THEN short - size ELSE short END) FILTER (short > 0) AS gap FROM cut GROUP BY source),
undrawn AS (SELECT cut.source, size, row FROM cut JOIN gaps ON cut.source IS NOT DISTINCT FROM gaps.source WHERE NOT short >= size AND size <= gap QUALIFY row_number() OVER (PARTITION BY cut.source, size ORDER BY rank, id) = 1),
walk AS (SELECT source, gap, 9223372036854775807 AS size, NULL::BIGINT AS row FROM gaps
  UNION ALL SELECT w.source, w.gap - max(u.size), max(u.size), arg_max(u.row, u.size) FROM walk w JOIN undrawn u ON w.source IS NOT DISTINCT FROM u.source AND u.size <= w.gap AND u.size < w.size GROUP BY w.source, w.gap),
taken AS (SELECT row, true AS yes FROM cut WHERE short >= size UNION ALL SELECT row, true FROM walk WHERE row IS NOT NULL)
SELECT doc_id, size, source_size, target, (whole + coalesce(yes, false)::BIGINT) * size AS taken, whole + coalesce(yes, false)::BIGINT AS copies FROM drawn LEFT JOIN taken USING (row)"""
