"""Command lines: `python -m verbascope.cli INPUT...` scores texts, `python -m verbascope.cli fit CORPUS OUTPUT` learns rule settings."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from . import __version__

OK, BELOW, FAILED = 0, 1, 2


def resolve(inputs: list[str]) -> list[tuple[str, str, str]]:
    """(kind, value, label): '-' is standard input, an existing file is a file, anything with white space is text, the rest a missing file."""
    out = []
    for n, x in enumerate(inputs, 1):
        if not x:
            raise ValueError(f"input {n} is empty; give text, a file or '-'")
        if x == "-":
            out.append(("text", sys.stdin.read(), "<stdin>"))
        elif _is_file(x):
            out.append(("file", x, x))
        elif any(c.isspace() for c in x):
            out.append(("text", x, f"<text:{n}>"))
        else:
            out.append(("missing", x, x))
    return out


def _is_file(path: str) -> bool:
    try:
        return Path(path).is_file()
    except OSError:  # longer than a path may be
        return False


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.config("spark.ui.enabled", "false").getOrCreate()


def main(argv: list[str] | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    return fit_main(argv[1:]) if argv[:1] == ["fit"] else score_main(argv)


def score_main(argv: list[str]) -> int:
    """0: all passed, 1: a score is below the threshold, 2: nothing could be read."""
    parser = argparse.ArgumentParser(prog="verbascope")
    parser.add_argument("inputs", nargs="+")
    parser.add_argument("-j", "--json", action="store_true")
    parser.add_argument("-v", "--verbose", action="store_true", help="violations and advice")
    parser.add_argument("-q", "--quiet", action="store_true", help="only inputs below the threshold")
    parser.add_argument("-s", "--score-only", action="store_true")
    parser.add_argument("-t", "--threshold", type=int, default=0)
    parser.add_argument("-c", "--config", help="rules as JSON lines")
    parser.add_argument("--counts", action="store_true", help="counters that aren't zero")
    parser.add_argument("--version", action="version", version=__version__)
    args = parser.parse_args(argv)

    from .plans.analysis import analyze
    from .sources import readers, sinks

    try:
        rules = readers.load_rules(args.config) if args.config else None
        targets = resolve(args.inputs)
    except (OSError, TypeError, ValueError) as e:
        print(f"verbascope: {e}", file=sys.stderr)
        return FAILED
    found = []
    for kind, value, label in targets:
        try:
            if kind == "missing":
                raise FileNotFoundError("No such file")
            found.append((len(found), label, value, value if kind == "text" else Path(value).read_text(encoding="utf-8")))
        except (OSError, UnicodeDecodeError) as e:
            print(f"verbascope: {value}: {e}", file=sys.stderr)
    if not found:
        return FAILED
    inputs = _session().createDataFrame(found, "place int, label string, source string, text string")
    results = analyze(inputs.repartitionByRange(len(found), "place"), "text", rules).drop("text").cache()
    if args.json:
        rows = [json.loads(r[0]) for r in sinks.as_json(results.orderBy("place").drop("place", "label")).collect()]
        print(json.dumps(rows[0] if len(rows) == 1 else rows, indent=2, ensure_ascii=False))
    else:  # one partition for each input, shown as soon as it is done
        for r in results.withColumn("line", sinks.summary_line("label", args.counts)).toLocalIterator():
            if args.quiet and not r.score < args.threshold:
                continue
            print(r.score if args.score_only else r.line, flush=True)
            if args.verbose and not args.score_only:
                for v in r.violations:
                    print(f"  {v.rule}: {v.match} ({v.penalty})  {v.context}")
                for a in r.advice:
                    print(f"  - {a}")
    return BELOW if args.threshold > 0 and sinks.any_below(results, args.threshold) else OK


def fit_main(argv: list[str]) -> int:
    """Learns settings from .jsonl, .txt and .md files, given by name or glob: CORPUS OUTPUT, or --output OUTPUT INPUT..."""
    parser = argparse.ArgumentParser(prog="verbascope fit")
    parser.add_argument("inputs", nargs="+")
    parser.add_argument("--output", help="where the rules go, as JSON lines")
    parser.add_argument("--init", help="rules to begin from")
    parser.add_argument("--negative-dataset", nargs="+", action="extend", default=[], help="inputs of which every row has label 0")
    parser.add_argument("--no-calibration", action="store_true")
    parser.add_argument("--version", action="version", version=__version__)
    args = parser.parse_args(argv)

    from .plans.fit import fit
    from .sources import readers

    try:
        if args.output is None and len(args.inputs) != 2:
            raise ValueError("without --output there must be two arguments: CORPUS OUTPUT")
        inputs, output = (args.inputs, args.output) if args.output is not None else (args.inputs[:1], args.inputs[1])
        paths, negative = readers.expand(inputs), readers.expand(args.negative_dataset)
        rules = readers.load_rules(args.init) if args.init else None
        spark = _session()
        rows = readers.labelled(spark, paths)
        if negative:
            rows = rows.unionByName(readers.labelled(spark, negative, 0, 0))
        rows = rows.cache()
        counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
        readers.save_rules(fit(rows, rules=rules, calibrate=not args.no_calibration), output)
    except Exception as e:  # what the rows hold is only known when Spark reads them
        print(f"verbascope fit: {str(e).splitlines()[0]}", file=sys.stderr)
        return FAILED
    print(f"fitted {sum(counts.values())} samples (positive={counts.get(1, 0)}, negative={counts.get(0, 0)}) from {len(paths)} train files and {len(negative)} negative files using init={args.init or '<default>'} calibration={'off' if args.no_calibration else 'on'} -> {output}")
    return OK


if __name__ == "__main__":
    sys.exit(main())
