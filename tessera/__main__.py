"""Command line: python -m tessera PATH [--table NAME=PARQUET ...] [-e SQL] [--audit-verify | --audit-export | --scrub]."""

from __future__ import annotations

import argparse
import sys

from .dialect import SqlError
from .session import Engine

HELP = "\\explain QUERY shows a plan, \\metrics the counters, \\clear clears the screen, \\q leaves; anything else is SQL"
SHOWN = 1000


def run_line(engine: Engine, line: str, out=sys.stdout) -> bool:
    """Run one line of the prompt; False ends it. Null is shown as [NULL]."""
    word, _, rest = line.strip().partition(" ")
    if word == "\\q":
        return False
    if word == "\\help":
        print(HELP, file=out)
    elif word == "\\clear":
        print("\033[2J\033[H", end="", file=out)
    elif word == "\\metrics":
        print(engine.metrics.render(), end="", file=out)
    elif word == "\\explain":
        print(engine.explain(rest), file=out)
    elif line.strip():
        df = engine.sql(line)
        rows = df.limit(SHOWN + 1).collect()  # what a prompt shows, and whether there is more
        more, rows = len(rows) > SHOWN, rows[:SHOWN]
        if df.columns != ["result"] or rows:
            print("\t".join(df.columns), file=out)
            for r in rows:
                print("\t".join("[NULL]" if v is None else str(v) for v in r), file=out)
        print(f"(the first {SHOWN} rows; there are more)" if more else f"({len(rows)} rows)", file=out)
    return True


def scrub(engine: Engine) -> list[str]:
    """Names of tables whose listed folders cannot be read in full."""
    from .catalog import read

    bad = []
    for name, table in engine.catalog.state["tables"].items():
        try:
            read(engine.spark, table).write.format("noop").mode("overwrite").save()
        except Exception:
            bad.append(name)
    return bad


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tessera")
    p.add_argument("path")
    p.add_argument("--table", action="append", default=[], metavar="NAME=PARQUET")
    p.add_argument("-e", dest="sql", action="append", default=[])
    p.add_argument("--role", default="admin")
    p.add_argument("--audit-verify", action="store_true")
    p.add_argument("--audit-export", action="store_true")
    p.add_argument("--scrub", action="store_true")
    a = p.parse_args(args)
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("tessera").getOrCreate()
    engine = Engine(spark, a.path, dict(t.split("=", 1) for t in a.table), role=a.role)
    if a.audit_verify:
        ok = engine.audit is None or engine.audit.verify()
        print("audit log intact" if ok else "audit log BROKEN")
        return int(not ok)
    if a.audit_export:
        print(engine.audit.export_tsv() if engine.audit else "")
        return 0
    if a.scrub:
        bad = scrub(engine)
        print("all tables readable" if not bad else "unreadable: " + ", ".join(bad))
        return int(bool(bad))
    for line in a.sql:
        run_line(engine, line)
    if not a.sql:
        while True:
            try:
                if not run_line(engine, input("tessera> ")):
                    break
            except EOFError:
                break
            except (SqlError, PermissionError, ValueError) as e:
                print(f"error: {e}")
            except Exception as e:  # Spark's own errors: show the first line and go on
                print(f"error: {str(e).splitlines()[0]}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
