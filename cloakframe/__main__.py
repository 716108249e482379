"""python -m cloakframe scan|protect PATH, policy FILE, lists, doctor. Exit codes: 0, 1 error, 2 invalid policy, 3 blocked, 4 withheld."""

from __future__ import annotations

import argparse
import importlib.util
import os
import sys
from collections import Counter

from .functions.catalog import CATEGORY
from .plans.policy import NAMES, load_policy


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="cloakframe", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    for name in ("scan", "protect"):
        p = sub.add_parser(name)
        p.add_argument("path")
        p.add_argument("--policy", default="default")
        p.add_argument("--out")
    sub.add_parser("policy").add_argument("file")
    sub.add_parser("lists")
    sub.add_parser("doctor")
    a = parser.parse_args(argv)
    if a.command == "lists":
        print("policies:", *NAMES)
        for t, c in sorted(CATEGORY.items()):
            print(f"{t:24} {c}")
        return 0
    if a.command == "doctor":
        for m in ("pyspark", "pyarrow", "pandas", "numpy", "regex", "yaml"):
            print(f"{m:10} {'ok' if importlib.util.find_spec(m) else 'missing'}")
        return 0
    if a.command == "policy":
        try:
            with open(a.file) as f:
                print("valid:", load_policy(f.read()).name)
            return 0
        except (ValueError, OSError) as error:
            print(error, file=sys.stderr)
            return 2
    try:
        with open(a.path, encoding="utf-8") as f:
            text = f.read()
    except (OSError, UnicodeDecodeError) as error:
        print(error, file=sys.stderr)
        return 1
    if a.command == "scan":
        from .operators.detect import Detection, Scanner

        for t, n in Counter(s.type for s in Scanner(Detection())(text)[0]).most_common():
            print(f"{t:24} {n}")
        return 0
    from pyspark.sql import Row, SparkSession

    from .operators.protect import protect

    spark = SparkSession.builder.getOrCreate()
    row = protect(spark.createDataFrame([Row(request_id="1", session_id="1", seq=1, text=text)]), a.policy)[0].first()
    if row.safe_text is None:
        return 3 if row.status == "blocked" else 4
    if a.out:
        with os.fdopen(os.open(a.out, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600), "w") as f:
            f.write(row.safe_text)
    else:
        print(row.safe_text)
    return 0


if __name__ == "__main__":
    sys.exit(main())
