"""A shell: statements up to a semicolon, one line per row."""

from __future__ import annotations

import sys

from larkspur.plans.dialect import DialectError
from larkspur.session import Engine
from larkspur.wire import Server

EXIT = {"exit", "quit", ".exit", ".quit"}
#: Seconds between two rounds of maintenance.
PURGE_SECONDS = 30.0


def shell(engine: Engine, lines, write=print) -> None:
    held = ""
    for line in lines:
        if not held and line.strip().rstrip(";").lower() in EXIT:
            return
        held += line
        if held.count("'") % 2 or not held.rstrip().endswith(";"):
            continue
        try:
            engine.exec(held, lambda columns, row: write(" | ".join(f"{c} = {v}" for c, v in zip(columns, row, strict=True))))
            write("OK")
        except DialectError as e:
            write(f"ERROR: {e}")
        held = ""


def main() -> None:
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("larkspur").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    engine = Engine(spark, sys.argv[1] if len(sys.argv) > 1 else None)
    stop = engine.maintain_every(PURGE_SECONDS)
    if len(sys.argv) > 2:  # a port: remote clients instead of this terminal
        Server(engine, "0.0.0.0", int(sys.argv[2])).serve_forever()
    shell(engine, sys.stdin)
    stop()


if __name__ == "__main__":
    main()
