"""Command line: ``python -m loomstat train|score``."""

from __future__ import annotations

import argparse

from . import fixed
from .plans.runs import DEFAULT_FAMILIES, describe_run, run_scoring, run_training
from .session import build_session, remove_scratch, ship_package
from .sources.tables import TOPIC_FILE
from .spec import load_spec


def main() -> None:
    parser = argparse.ArgumentParser(prog="loomstat")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("train", "score"):
        sub = commands.add_parser(name)
        sub.add_argument("--spec", required=True, help="YAML feature specification")
        sub.add_argument("--data", required=True, help="folder of the topic files")
        sub.add_argument("--out", required=True, help="folder of the run")
        sub.add_argument("--key", default="SEQN")
        sub.add_argument("--format", default="xport", choices=["xport", "parquet", "csv"])
        sub.add_argument("--pattern", default=TOPIC_FILE, help="topic file name, with {file}")
        sub.add_argument("--master")
    train, score = commands.choices["train"], commands.choices["score"]
    train.add_argument("--families", nargs="+", default=list(DEFAULT_FAMILIES))
    train.add_argument("--search", default="study", choices=["study", "grid", "random", "none"])
    train.add_argument("--trials", type=int, default=fixed.STUDY_TRIALS)
    train.add_argument("--seconds", type=float, default=fixed.STUDY_SECONDS)
    train.add_argument("--cv-folds", nargs="*", type=int, default=fixed.CV_STUDY_FOLDS)
    score.add_argument("--cycle", default="H")
    score.add_argument("--bounds", default="refit", choices=["refit", "train"])
    given = parser.parse_args()

    spark = build_session("loomstat", given.master)
    ship_package(spark)
    spec = load_spec(given.spec, given.key, fixed.SENTINEL_CODES)
    if given.command == "train":
        results = run_training(spark, spec, given.data, given.out, given.format, given.pattern, given.families,
                               given.search, None, given.trials, given.seconds, given.cv_folds)
    else:
        results = run_scoring(spark, spec, given.data, given.out, given.cycle, given.format, given.pattern,
                              given.bounds)
    print(describe_run(results))
    remove_scratch(spark)


if __name__ == "__main__":
    main()
