"""Command line: list, manifest, generate, lock, verify.  Exit code 0, or 1 on any failure.

A command first makes a plan of DataFrames; only then is anything written.
"""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.operators import lockfile as lk
from framewright.plans import corpus
from framewright.sources import corpus_files as cf


class Failure(Exception):
    """A message for the user; the command ends with exit code 1."""


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="framewright", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("list", help="names of all entries in order")
    a.add_argument("--json", action="store_true")
    a = sub.add_parser("manifest", help="the manifest of one entry")
    a.add_argument("name")
    a = sub.add_parser("generate", help="write manifests and media")
    a.add_argument("--out", required=True)
    a.add_argument("--only", action="append", default=[])
    a.add_argument("--dry-run", action="store_true")
    a = sub.add_parser("lock", help="digests of all artifacts")
    a.add_argument("--write")
    a.add_argument("--dry-run", action="store_true")
    a.add_argument("--only", action="append", default=[])
    a = sub.add_parser("verify", help="compare a lockfile with a corpus, or with entries made again")
    a.add_argument("--lock", required=True)
    a.add_argument("--corpus")
    a.add_argument("--only", action="append", default=[])
    return p


def say(lines: list[str]) -> None:
    sys.stdout.write("".join(f"{x}\n" for x in lines))


def _expected(spark: SparkSession, path: str, distinct: bool) -> DataFrame:
    if not os.path.exists(path.removeprefix("file://")) and "://" not in path:
        raise Failure(f"{path}: no such lockfile")
    rows = cf.read_lockfile(spark, path)
    if bad := rows.where("error is not null").select("line", "error").first():
        raise Failure(f"{path}: bad {bad['error']} in {bad['line']!r}")
    rows = rows.select("name", "digest", "length")
    if distinct and (twice := lk.duplicate_names(rows).orderBy("name").first()):
        raise Failure(f"{path}: {twice['name']} stands {twice['n']} times")
    # of repeated names, which only the corpus form allows, one is kept
    return rows.dropDuplicates(["name"])


def _report(expected: DataFrame, found: DataFrame, failed: list[str]) -> int:
    diff = found.orderBy("ord").collect()
    bad = {r["name"] for r in diff}
    good = [r[0] for r in expected.select("name").orderBy("name").collect() if r[0] not in bad]
    say([f"ok {n}" for n in good] + [f"{r['kind']} {r['name']}" + (f": expected {r['expected']}, found {r['actual']}" if r["expected"] else "") for r in diff] + failed)
    total = expected.count()
    say([f"{total} verified, {len(good)} matched, {total - len(good)} failed"])
    return int(bool(diff or failed))


def run(spark: SparkSession, argv: list[str]) -> int:
    try:
        args = arguments().parse_args(argv)
    except SystemExit as e:
        return 1 if e.code else 0
    try:
        return _dispatch(spark, args)
    except (Failure, ValueError) as e:
        sys.stderr.write(f"{e}\n")
        return 1


def _dispatch(spark: SparkSession, args: argparse.Namespace) -> int:
    entries = corpus.catalogue(spark)
    if args.command == "list":
        names = [r[0] for r in entries.orderBy("ord").select("name").collect()]
        say([json.dumps(names, separators=(",", ":"))] if args.json else names)
        return 0
    if args.command == "manifest":
        if not entries.where(F.col("name") == args.name).count():
            raise Failure(f"no entry is called {args.name}")
        say([corpus.manifest_json(corpus.parse_name(args.name))])
        return 0
    if args.command == "generate":
        # unknown names are passed over
        done = corpus.publish(corpus.select_entries(entries, args.only), args.out, args.dry_run).orderBy("name").collect()
        say([f"{'would write' if args.dry_run else 'wrote'} {r['name']} ({r['length']} bytes)" if r["error"] is None else f"failed {r['name']}: {r['error']}" for r in done])
        return int(any(r["error"] for r in done))
    if args.command == "lock":
        lines = [r[0] for r in lk.lockfile_lines(corpus.artifacts(corpus.select_entries(entries, args.only))).collect()]  # two lines an entry
        if args.write and not args.dry_run:
            with open(f"{args.write}.tmp", "w", encoding="utf-8") as f:
                f.write("".join(f"{x}\n" for x in lines))
            os.replace(f"{args.write}.tmp", args.write)
        else:
            say(lines)
        return 0
    expected = _expected(spark, args.lock, distinct=not args.corpus)
    if args.corpus:
        files = cf.read_corpus(spark, args.corpus)
        return _report(expected, lk.differences(expected, files.select("name", "digest", "length")), [])
    entry = F.when(F.col("name").endswith(".json"), F.regexp_replace("name", r"\.json$", "")).otherwise(F.regexp_extract("name", r"^(.*)-media\.", 1))
    expected = expected.withColumn("entry", entry)
    if args.only:
        want = spark.createDataFrame([(n,) for n in args.only], "entry string")
        if unknown := want.join(expected, "entry", "left_anti").first():
            raise Failure(f"{unknown[0]} is not in the lockfile")
        expected = expected.join(want.distinct(), "entry", "left_semi")
    chosen = entries.join(expected.select(F.col("entry").alias("name")).distinct(), "name", "left_semi") if args.only else entries
    made = corpus.artifact_bytes(chosen).select("name", "error", F.sha2("content", 256).alias("digest"), F.octet_length("content").cast("long").alias("length")).cache()
    failed = [f"failed {r['name']}: {r['error']}" for r in made.where("error is not null").collect()]
    expected = expected.join(made.where("error is not null").select(F.col("name").alias("entry")), "entry", "left_anti").select("name", "digest", "length")
    return _report(expected, lk.differences(expected, made.where("error is null").select("name", "digest", "length")), failed)


def main() -> None:
    spark = SparkSession.builder.appName("framewright").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    sys.exit(run(spark, sys.argv[1:]))


if __name__ == "__main__":
    main()
