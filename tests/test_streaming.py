"""Streaming recognition gives what batch recognition does; the command line runs end to end."""

import random

from motifline import cli
from motifline.operators import recognize as R
from motifline.plans.compiled import compile_one
from motifline.sources import synthetic
from motifline.streaming.recognize import label_stream, match_stream

T = "IsEventTypePredicate"
SCHEMA = "id long, event_type string, ts long, who string, v double"


def drained(spark, df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return sorted(str(tuple(r)) for r in spark.table(name).collect())


def test_streams_match_batches(spark, tmp_path):
    rng = random.Random(5)
    rows = [(k, rng.choice("ABC"), k, f"p{rng.randrange(2)}", float(rng.randrange(5))) for k in range(1, 61)]
    batch = spark.createDataFrame(rows, SCHEMA)
    synthetic.replay(batch, f"file://{tmp_path}/in", 3)
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(f"file://{tmp_path}/in")
    c = compile_one(f";({T}(A),*({T}(B)),{T}(C)){{partitionBy:who}}", f"~({T}(A),{T}(B),{T}(C))")
    assert drained(spark, label_stream(stream(), c), "labels") == sorted(str(tuple(r)) for r in R.label(batch, c).collect())
    c = compile_one(f'#(;({T}(A)["x"],^({T}(B),GTAttr(v,"x")))){{partitionBy:who}}{{window:9}}')
    assert drained(spark, match_stream(stream(), c), "matches") == sorted(str(tuple(r)) for r in R.run_fold(batch, c).collect())


def test_command_line(spark, tmp_path):
    rng = random.Random(6)
    (tmp_path / "s.csv").write_text("".join(f"{rng.choice('ABC')},{k}\n" for k in range(1, 101)))
    (tmp_path / "p.sre").write_text(f";({T}(A),{T}(B)){{order:1}}")
    (tmp_path / "d.txt").write_text(f"~({T}(A),{T}(B),{T}(C))")
    run = lambda *a: cli.main([*a], spark)
    at = lambda n: f"{tmp_path}/{n}"
    run("compile", "--patterns", at("p.sre"), "--declarations", at("d.txt"), "--output", at("fsm"))
    stream = ("--stream", f"file://{tmp_path}/s.csv")
    run("recognition", "--fsm", at("fsm"), *stream, "--output", at("found"), "--stats", at("stats"))
    run("recognition", "--fsm", at("fsm"), "--fsmModel", "nsfa", *stream, "--output", at("all"))
    assert spark.read.parquet(at("found")).count() == spark.read.parquet(at("all")).count() > 0
    run("mle", "--fsm", at("fsm"), *stream, "--output", at("mc"))
    run("forecasting", "--fsm", at("fsm"), "--model", at("mc"), *stream, "--horizon", "20", "--maxSpread", "20", "--output", at("f1"), "--stats", at("fstats"))
    run("learnSPST", "--patterns", at("p.sre"), "--declarations", at("d.txt"), *stream, "--output", at("spst"))
    run("forecasting", "--modelType", "vmm", "--fsm", at("fsm"), "--model", at("spst"), *stream, "--horizon", "10", "--maxSpread", "5", "--foreMethod", "classify-nextk", "--output", at("f2"))
    assert spark.read.parquet(at("f1")).count() > 0 and spark.read.parquet(at("f2")).count() > 0
