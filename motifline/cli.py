"""Command line: compile, recognition, mle, learnSPST and forecasting over files."""

from __future__ import annotations

import argparse
import time
from pathlib import Path

from motifline.operators import forecast as fc
from motifline.operators import markov, suffix_trees
from motifline.operators import recognize as R
from motifline.operators.waiting import METHODS
from motifline.plans import parser
from motifline.plans.compiled import compile_pattern, from_json
from motifline.sources import readers, sinks


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="motifline", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *, stream: bool = True):
        c = sub.add_parser(name)
        if stream:
            c.add_argument("--stream", required=True, help="file or folder of lines")
            c.add_argument("--domain", default="csv", choices=sorted(readers.DOMAINS))
        return c

    c = command("compile", stream=False)
    c.add_argument("--patterns", required=True)
    c.add_argument("--declarations")
    c.add_argument("--countPolicy", default="nonoverlap", choices=("overlap", "nonoverlap"))
    c.add_argument("--output", required=True)
    c = command("recognition")
    c.add_argument("--fsm", required=True)
    c.add_argument("--fsmModel", default="dsfa", choices=("dsfa", "nsfa", "nsra", "dsra"))
    c.add_argument("--reset", action="store_true")
    c.add_argument("--show", action="store_true")
    c.add_argument("--stats")
    c.add_argument("--output")
    c = command("mle")
    c.add_argument("--fsm", required=True)
    c.add_argument("--output", required=True)
    c = command("learnSPST")
    c.add_argument("--patterns", required=True)
    c.add_argument("--declarations")
    c.add_argument("--pMin", type=float, default=0.001)
    c.add_argument("--alpha", type=float, default=0.0)
    c.add_argument("--gammaMin", type=float, default=0.001)
    c.add_argument("--r", type=float, default=1.05)
    c.add_argument("--output", required=True)
    c = command("forecasting")
    c.add_argument("--modelType", default="fmm", choices=("fmm", "vmm"))
    c.add_argument("--fsm", required=True)
    c.add_argument("--model", required=True)
    c.add_argument("--threshold", type=float, default=0.5)
    c.add_argument("--maxSpread", type=int, default=200)
    c.add_argument("--horizon", type=int, default=200)
    c.add_argument("--foreMethod", default="smart-scan", choices=METHODS)
    c.add_argument("--stats", help="folder for scores as CSV")
    c.add_argument("--output")
    return p


def _stream(spark, args, part: str | None):
    events = readers.read(spark, args.stream, args.domain)
    return readers.placed_resets(events, part) if args.domain in ("csv", "maritime") else events


def main(argv: list[str] | None = None, spark=None) -> None:
    args = _parser().parse_args(argv)
    if args.command in ("compile", "learnSPST"):
        declared = parser.read_declarations(args.declarations) if args.declarations else ""
        policy = args.countPolicy if args.command == "compile" else "nonoverlap"
        patterns = compile_pattern(parser.read(args.patterns), declared, policy)
    else:
        patterns = [from_json(x) for x in Path(args.fsm).read_text().splitlines() if x]
    if args.command == "compile":
        Path(args.output).write_text("\n".join(c.to_json() for c in patterns) + "\n")
        return
    if spark is None:
        from pyspark.sql import SparkSession

        from motifline import on_workers

        spark = on_workers(SparkSession.builder.appName("motifline").getOrCreate())
    if args.command == "recognition":
        for c in patterns:
            events = _stream(spark, args, c.pattern.partition_by)
            began = time.time()
            if args.fsmModel == "dsfa":
                found = R.detections(events, c)
            else:
                options = {"how": "run_fold", "reset_on_match": True} if args.reset else {}
                found = R.matches(events, c, **options)
                found = R.end_points(found) if args.fsmModel == "dsra" else found
            if args.output:
                found.write.mode("append").parquet(args.output)
            if args.show:
                sinks.match_lines(found).show(truncate=False)
            if args.stats:
                row = (c.pattern_id, events.count(), found.count(), time.time() - began)
                sinks.write_stats(spark.createDataFrame([row], "pattern_id int, events long, matches long, seconds double"), args.stats)
    elif args.command == "mle":
        Path(args.output).write_text("\n".join(markov.learn_markov(_stream(spark, args, c.pattern.partition_by), c).to_json() for c in patterns) + "\n")
    elif args.command == "learnSPST":
        out = []
        for c in patterns:
            order, plain = c.pattern.order, c.with_order(0)
            counts = suffix_trees.learn_counts(_stream(spark, args, c.pattern.partition_by), plain, order, args.pMin)
            out.append(suffix_trees.learn_tree(counts, order, args.pMin, args.alpha, args.gammaMin, args.r).to_json())
        Path(args.output).write_text("\n".join(out) + "\n")
    else:
        models = [x for x in Path(args.model).read_text().splitlines() if x]
        for c, text in zip(patterns, models):
            events = _stream(spark, args, c.pattern.partition_by)
            if args.modelType == "fmm":
                found = fc.forecast(events, c, markov.MarkovChain.from_json(text), args.foreMethod, args.threshold, args.horizon, args.maxSpread)
            else:
                c = c.with_order(0)
                found = fc.forecast_variable(events, c, suffix_trees.SuffixTree.from_json(text), method=args.foreMethod, threshold=args.threshold, horizon=args.horizon, spread=args.maxSpread)
            if args.output:
                found.write.mode("append").parquet(args.output)
            if args.stats:
                labels = R.label(events, c)
                scores = fc.classification_scores(fc.classification_counts(found, labels)) if args.foreMethod.startswith("classify") else fc.regression_scores(found, labels)
                sinks.write_stats(scores, args.stats)


if __name__ == "__main__":
    main()
