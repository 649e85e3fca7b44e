"""Command line: list and run queries, scan files, fingerprint a corpus. Run with python -m lodestrand.cli, or through spark-submit."""

from __future__ import annotations

import argparse
import json
import subprocess
import sys

from pyspark.sql import functions as F

from lodestrand.operators import quality
from lodestrand.plans import catalogue
from lodestrand.session import build_session
from lodestrand.sources import files, sinks


def main(argv: list[str] | None = None) -> int:
    """Exit status: 0 done, 1 findings or issues, 2 wrong use."""
    parser = argparse.ArgumentParser(prog="lodestrand")
    parser.add_argument("--master", default="local[*]")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("queries", help="list the queries")
    run = commands.add_parser("run", help="run a query and write its result as Parquet; an existing folder is refused")
    run.add_argument("name")
    run.add_argument("tables")
    run.add_argument("output")
    scan = commands.add_parser("privacy-scan", help="check the tracked files of a repository")
    scan.add_argument("root")
    check = commands.add_parser("validate-data", help="check JSON lines of chunks for unknown keys and broken identities")
    check.add_argument("path")
    mark = commands.add_parser("fingerprint", help="hash the sections and edges of a folder of tables")
    mark.add_argument("tables")
    mark.add_argument("output")
    given = parser.parse_args(argv)
    if given.command == "queries":
        print("\n".join(catalogue.queries()))
        return 0
    if given.command == "run" and given.name not in catalogue.queries():
        print(f"no query {given.name}", file=sys.stderr)
        return 2
    spark = build_session("cli", given.master)
    if given.command == "run":
        catalogue.queries()[given.name](spark, given.tables).write.mode("errorifexists").parquet(given.output)
        return 0
    if given.command == "privacy-scan":
        listed = subprocess.run(["git", "ls-files", "-z"], cwd=given.root, check=True, capture_output=True).stdout.decode().split("\0")
        names = spark.createDataFrame([(n, f"{given.root}/{n}") for n in listed if n], "path string, place string")
        read = spark.read.format("binaryFile").load([r["place"] for r in names.collect()]).select(F.regexp_replace("path", "^file:/*", "/").alias("place"), "length", "content")
        both = names.join(read, "place")
        text = both.select("path", F.try_validate_utf8(F.col("content").cast("string")).alias("text"))
        rows = quality.path_findings(both, "path", "length").unionByName(quality.privacy_findings(text, "path", "text", 5_000_000)).distinct().orderBy("path", "rule").collect()
        for r in rows:
            print(f"{r['path']}: {r['rule']}")
        return int(bool(rows))
    if given.command == "validate-data":
        rows = files.unknown_keys(spark, given.path, files.CHUNKS).select("key").distinct().collect()
        issues = files.corpus_issues(files.read_json_lines(spark, given.path, files.CHUNKS)).collect()
        print(json.dumps({"unknown_keys": [r["key"] for r in rows], "issues": {r["code"]: r["records"] for r in issues}}))
        return int(bool(rows or issues))
    rows = [r.asDict() for r in catalogue.queries()["fingerprint"](spark, given.tables).orderBy("component").collect()]
    sinks.write_atomic(given.output, {"components": rows, "identity": sinks.digest(rows)}, overwrite=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
