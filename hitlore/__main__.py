"""Jobs over stored logs.

python -m hitlore merge -o OUT [-b ROWS] -i INPUT...   merge logs (block folders, or JSON-lines files ending in .log, .json or .jsonl) by time
python -m hitlore train -l LOG --labels FILE -m MODEL  fit a forest on labelled positions
python -m hitlore score -l LOG -m MODEL [--first N --beyond N] [--human-max 0.3 --bot-min 0.7]  show scores and verdicts
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from hitlore.api import Log
from hitlore.operators import forest, views
from hitlore.sources.entries import label_file


def merge(spark: SparkSession, args: argparse.Namespace) -> None:
    logs = [Log.from_json_lines(spark, p) if p.endswith((".log", ".json", ".jsonl")) else Log.open(spark, p) for p in args.input]
    Log.merged(logs, args.block_size).write(args.output)


def train(spark: SparkSession, args: argparse.Namespace) -> None:
    log = Log.open(spark, args.log).rows
    examples = forest.training_rows(log, label_file(spark, args.labels), labelled_only=args.labelled_only)
    forest.save(forest.fit(examples, settings=forest.Settings(trees=args.trees)), args.model)


def score(spark: SparkSession, args: argparse.Namespace) -> None:
    log = Log.open(spark, args.log)
    scored = forest.scored(log.features(), forest.load(args.model).trees)
    shown = scored.select("position", "score", forest.verdict(F.col("score"), human_max=args.human_max, bot_min=args.bot_min).alias("verdict"))
    beyond = views.end(log.rows) if args.beyond is None else args.beyond
    views.between(shown, args.first, beyond).show(args.rows, truncate=False)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="hitlore", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    jobs = parser.add_subparsers(required=True)
    p = jobs.add_parser("merge")
    p.add_argument("-o", "--output", required=True)
    p.add_argument("-b", "--block-size", type=int, default=100_000, help="rows per block of the output")
    p.add_argument("-i", "--input", nargs="+", required=True)
    p.set_defaults(job=merge)
    p = jobs.add_parser("train")
    p.add_argument("-l", "--log", required=True)
    p.add_argument("--labels", required=True)
    p.add_argument("-m", "--model", required=True)
    p.add_argument("--trees", type=int, default=200)
    p.add_argument("--labelled-only", action="store_true")
    p.set_defaults(job=train)
    p = jobs.add_parser("score")
    p.add_argument("-l", "--log", required=True)
    p.add_argument("-m", "--model", required=True)
    p.add_argument("--first", type=int, default=0)
    p.add_argument("--beyond", type=int)
    p.add_argument("--rows", type=int, default=100, help="rows shown")
    p.add_argument("--human-max", type=float, default=0.3)
    p.add_argument("--bot-min", type=float, default=0.7)
    p.set_defaults(job=score)
    args = parser.parse_args(argv)
    args.job(SparkSession.builder.appName("hitlore").getOrCreate(), args)


if __name__ == "__main__":
    main()
