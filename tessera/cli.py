"""A small shell: ``python -m tessera.cli DATABASE [DATA_DIR]``.

Statements end with a semicolon. ``.tables``, ``.schema [TABLE]``, ``.indexes``,
``.help`` and ``.quit`` are its own.
"""

from __future__ import annotations

import sys

from tessera.engine import Engine

HELP = ".tables  .schema [TABLE]  .indexes  .help  .quit"


def command(db: Engine, line: str) -> str | None:
    """What a dot command prints; None to end."""
    word, _, rest = line.strip().partition(" ")
    tables = db.state["tables"]
    if word == ".quit":
        return None
    if word == ".tables":
        return "\n".join(sorted([*tables, *db.external]))
    if word == ".schema":
        shown = {rest.strip().lower(): tables[rest.strip().lower()]} if rest.strip() else tables
        return "\n".join(f"{name} (" + ", ".join(f"{c['name']} {c['type']}" for c in table["columns"]) + ")" for name, table in sorted(shown.items()))
    if word == ".indexes":
        return "\n".join(f"{index} ON {name} ({', '.join(d['keys'])})" for name, table in sorted(tables.items()) for index, d in sorted(table["indexes"].items()))
    return HELP


def rendered(df, rows: int = 100) -> str:
    """Up to so many rows as a table."""
    found = df.take(rows)
    cells = [df.columns, *[["NULL" if v is None else str(v) for v in r] for r in found]]
    widths = [max(len(r[k]) for r in cells) for k in range(len(df.columns))]
    lines = [" | ".join(v.ljust(w) for v, w in zip(r, widths)).rstrip() for r in cells]
    return "\n".join([lines[0], "-+-".join("-" * w for w in widths), *lines[1:]])


def run(db: Engine, source, out) -> None:
    held = ""
    for line in source:
        if not held and line.startswith("."):
            said = command(db, line)
            if said is None:
                return
            print(said, file=out)
            continue
        held += line
        if held.rstrip().endswith(";"):
            try:
                df = db.sql(held)
                if df is not None:
                    print(rendered(df), file=out)
            except Exception as e:
                print(f"{type(e).__name__}: {str(e).splitlines()[0]}", file=out)
            held = ""


def main() -> None:
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    db = Engine(spark, sys.argv[1])
    if len(sys.argv) > 2:
        db.register_dir(sys.argv[2])
    run(db, sys.stdin, sys.stdout)


if __name__ == "__main__":
    main()
