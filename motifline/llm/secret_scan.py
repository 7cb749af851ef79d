"""Secret scans with an incremental blob ledger, in DataFrame functions only.

Every version of every path is content-addressed (SHA-256 of its text). A ledger holds, for each pair of blob and rule
version that was ever scanned, the spans found. A scan works on the pairs that the ledger lacks, each blob once however
many paths and versions share it, appends them, and joins the findings back to all paths.

Spans are code-point offsets, end exclusive, of leftmost non-overlapping matches of a rule, without those whose value
is shorter than the rule asks. Null text counts as empty and has no spans. Repeated rows each get their findings. A
very long text is scanned whole, in one row. Spans that tie in start are ordered by rule. An empty table gives no rows.
Input columns beyond those named are ignored by ``scan``; ``redact`` keeps them, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from motifline.llm.common import Scratch, fresh

SPANS = "array<struct<start:int,ord:int,end:int,kind:string>>"
LEDGER = f"blob string, rule string, spans {SPANS}"


@dataclass(frozen=True)
class Rule:
    """A pattern, the group that holds its value, the least length of that value, and text that every match holds."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    holds: str = ""
    version: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


#: The base rules' patterns and least lengths.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, "AKIA"),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
RULES = BASE + (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*(-----END [A-Z ]*PRIVATE KEY-----)?", 0, 1, "PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40, "gh"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40, ".eyJ"),
)


def _spans(text: Column, found: Column, rule: Rule, order: int) -> Column:
    """Where the matches ``found`` lie: text = piece, match, piece, match, …, piece."""
    values = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found
    parts = F.arrays_zip(F.split(text, rule.pattern, -1).alias("piece"), found.alias("match"), values.alias("value"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["piece"])
        end = start + F.coalesce(F.length(x["match"]), F.lit(0))
        span = F.array(F.struct(start.alias("start"), F.lit(order).alias("ord"), end.alias("end"), F.lit(rule.kind).alias("kind"))).cast(SPANS)
        good = F.coalesce(F.length(x["value"]) >= rule.least, F.lit(False))
        return F.struct(end.alias("at"), F.when(good, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    none = F.array().cast(SPANS)
    return F.when(F.size(found) > 0, F.aggregate(parts, F.struct(F.lit(0).alias("at"), none.alias("spans")), step, lambda acc: acc["spans"])).otherwise(none)


def find(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blobs (blob, text, todo: names of the rules to run) to a ledger row for each blob and rule."""
    out = blobs
    for k, r in enumerate(rules):
        run = F.array_contains("todo", r.name)
        run = run & F.contains(F.col("text"), F.lit(r.holds)) if r.holds else run
        out = out.withColumn(f"_found{k}", F.when(run, F.regexp_extract_all(F.col("text"), F.lit(r.pattern), F.lit(0))).otherwise(F.array().cast("array<string>")))
    each = [F.struct(F.lit(r.name).alias("rule"), _spans(F.col("text"), F.col(f"_found{k}"), r, k).alias("spans")) for k, r in enumerate(rules)]
    out = out.select("blob", "todo", F.explode(F.array(*each)).alias("_each"))
    return out.where(F.array_contains("todo", F.col("_each.rule"))).select("blob", "_each.rule", "_each.spans")


def scan(spark: SparkSession, versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Scan what ``ledger`` (a folder that all executors share) lacks.

    ``versions`` has a row for each historical version of each path: ``key`` and text. Returns (paths, findings):
    key and blob of every version, and blob and spans (sorted by start, then rule) of the blobs that have any.
    """
    scratch = Scratch(spark, "secrets")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    all_texts = versions.select(F.col(key).alias("_key"), text.alias("text")).withColumn("blob", F.sha2(F.encode("text", "UTF-8"), 256))
    paths = scratch.put(all_texts.select("_key", "blob"), "paths")
    names = [r.name for r in rules]
    wanted = paths.groupBy("blob").agg(F.min("_key").alias("_key"))
    known = _ledger(spark, ledger)
    if known is not None:
        seen = known.where(F.col("rule").isin(names)).groupBy("blob").agg(F.collect_set("rule").alias("_seen"))
        wanted = wanted.join(seen, "blob", "left").withColumn("todo", F.array_except(F.array(*map(F.lit, names)), F.coalesce("_seen", F.array().cast("array<string>")))).where(F.size("todo") > 0).drop("_seen")
    else:
        wanted = wanted.withColumn("todo", F.array(*map(F.lit, names)))
    # one text for each blob: that of its least key; rows that repeat both bring it again
    a, b = all_texts.alias("a"), wanted.alias("b")
    blobs = a.join(b, (F.col("a.blob") == F.col("b.blob")) & F.col("a._key").eqNullSafe(F.col("b._key"))).select("a.blob", "a.text", "b.todo")
    find(blobs, rules).dropDuplicates(["blob", "rule"]).write.mode("append").parquet(ledger)
    found = _ledger(spark, ledger).where(F.col("rule").isin(names) & (F.size("spans") > 0)).dropDuplicates(["blob", "rule"])
    findings = found.groupBy("blob").agg(F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"))  # as many as there are rules
    return paths, findings


def _ledger(spark: SparkSession, path: str) -> DataFrame | None:
    from py4j.protocol import Py4JJavaError

    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    try:
        there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    except Py4JJavaError as e:
        raise ValueError(f"the ledger {path} can't be reached") from e
    return spark.read.schema(LEDGER).parquet(path) if there else None


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with every maximal run of overlapping spans (sorted by start) replaced by ``mark``."""

    def step(acc: Column, s: Column) -> Column:
        new = s["start"] >= acc["at"]
        kept = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(new, kept).otherwise(acc["out"]).alias("out"))

    end = lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))
    return F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, end)


def redact(spark: SparkSession, docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with the secrets in ``text`` replaced, and ``n_chars``, if there, counted anew. Clean rows stay as they are."""
    _, findings = scan(spark, docs.select("doc_id", "text"), ledger, rules)
    blob, spans = fresh(docs, "_blob", "_spans")
    digest = F.sha2(F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8"), 256)
    out = docs.withColumn(blob, digest).join(findings.select(F.col("blob").alias(blob), F.col("spans").alias(spans)), blob, "left")
    out = out.withColumn("text", F.when(F.col(spans).isNotNull(), redacted(F.col("text"), F.col(spans))).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(spans).isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def sql(rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE) -> str:
    """The spans of ``documents`` for DuckDB, with the counts and digests of the query."""
    each = []
    for k, r in enumerate(rules):
        p = r.pattern.replace("'", "''")
        found = f"regexp_extract_all(t, '{p}', 0)"
        values = f"regexp_extract_all(t, '{p}', {r.group})"
        each.append(f"SELECT row, t, {k} AS ord, '{r.kind}' AS kind, {r.least} AS least, {found} AS ms, {values} AS vs, string_split_regex(t, '{p}') AS ps FROM texts")
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in base)
    text = "kind || ':' || start || ':' || stop"
    kinds = ", ".join(f"'{r.kind}'" for r in base)
    return f"""WITH texts AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents),
hits AS ({" UNION ALL ".join(each)}),
cut AS (SELECT row, ord, kind, least, unnest(range(1, len(ms) + 1)) AS i, ms, vs, ps FROM hits WHERE len(ms) > 0),
spans AS (SELECT row, ord, kind, list_sum(list_transform(ps[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0)::BIGINT AS start, length(ms[i]) AS n
  FROM cut WHERE length(vs[i]) >= least),
ends AS (SELECT row, ord, kind, start, start + n AS stop FROM spans),
found AS (SELECT row, {counts}, sha256(coalesce(string_agg({text}, ',' ORDER BY start, ord) FILTER (kind IN ({kinds})), '')) AS base_sha256, string_agg({text}, ',' ORDER BY start, ord) AS spans FROM ends GROUP BY row)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in base)}, coalesce(base_sha256, sha256('')) AS base_sha256, coalesce(spans, '') AS spans, sha256(t) AS blob
FROM texts LEFT JOIN found USING (row)"""
