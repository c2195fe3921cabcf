"""python -m tessera --db DIR [-c STATEMENT] [--version]: one statement, or a prompt with .tables .schema .explain .mode .help .exit."""

from __future__ import annotations

import argparse
import decimal
import sys
import time

from .api import Database
from .errors import ParseError

VERSION = "0.2"


def _number(v) -> bool:
    return isinstance(v, int | float | decimal.Decimal) and not isinstance(v, bool)


def counted(rows: list[tuple]) -> str:
    return f"({len(rows)} row{'' if len(rows) == 1 else 's'})" if rows else "(no rows)"


def table(columns: list[str], rows: list[tuple]) -> str:
    """A box; columns of numbers to the right, and the number of rows below."""
    cells = [[("NULL" if v is None else str(v)) for v in r] for r in rows]
    width = [max(map(len, (c, *(r[i] for r in cells)))) for i, c in enumerate(columns)]
    side = [">" if any(map(_number, v)) and all(x is None or _number(x) for x in v) else "<" for v in (list(zip(*rows, strict=True)) or [()] * len(columns))]
    rule = "+" + "+".join("-" * (w + 2) for w in width) + "+"
    line = lambda r: "|" + "|".join(f" {v:{s}{w}} " for v, w, s in zip(r, width, side, strict=True)) + "|"
    return "\n".join([rule, line(columns), rule, *map(line, cells), *([rule] if rows else []), counted(rows)])


def lines(columns: list[str], rows: list[tuple]) -> str:
    return "\n\n".join(["\n".join(f"{c} = {'NULL' if v is None else v}" for c, v in zip(columns, r, strict=True)) for r in rows] + [counted(rows)])


def plain(columns: list[str], rows: list[tuple]) -> str:
    """Values between bars, without a box or a count: for other programs."""
    return "\n".join(" | ".join("NULL" if v is None else str(v) for v in r) for r in [tuple(columns), *rows])


MODES = {"table": table, "line": lines, "plain": plain}


def shown(db: Database, statement: str, mode: str = "table") -> str:
    columns, rows = db.execute_with_columns(statement)
    if columns == ["affected"]:
        return f"{rows[0][0]} row(s)"
    return MODES[mode](columns, rows) if columns else "OK"


def command(db: Database, text: str, state: dict) -> str | None:
    """The answer to a prompt's line; None ends the session."""
    word, _, rest = text.partition(" ")
    if word == ".exit":
        return None
    if word == ".tables":
        return "\n".join(db.list_tables())
    if word == ".schema":
        return "\n".join(db.get_schema(t) for t in ([rest] if rest else db.list_tables()))
    if word == ".explain":
        return db.explain(rest)
    if word == ".history":
        return "\n".join(state["history"])
    if word == ".mode":
        if rest in MODES:
            state["mode"] = rest
        return state["mode"]
    if word == ".help" or word.startswith("."):
        return ".tables .schema [TABLE] .explain SELECT .history .mode [table|line|plain] .help .exit"
    began = time.time()
    return f"{shown(db, text, state['mode'])}\n({time.time() - began:.3f} s)"


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tessera", description=__doc__)
    parser.add_argument("--db", "--file", "--uri", dest="db", required=True, help="a directory, or its address on any of Spark's file systems")
    parser.add_argument("-c", dest="statement")
    parser.add_argument("--mode", choices=MODES, default="table")
    parser.add_argument("--version", action="version", version=f"tessera {VERSION}")
    given = parser.parse_args(args)
    with Database(given.db) as db:
        if given.statement:
            try:
                print(shown(db, given.statement, given.mode))
                return 0
            except Exception as e:
                print(f"{type(e).__name__}: {e}" + (f"\n{e.snippet()}" if isinstance(e, ParseError) else ""), file=sys.stderr)
                return 1
        state = {"history": [], "mode": given.mode}
        while True:
            try:
                text = input("tessera> ").strip()
            except EOFError:
                return 0
            if not text:
                continue
            state["history"].append(text)
            try:
                answer = command(db, text, state)
            except Exception as e:
                answer = f"{type(e).__name__}: {e}"
            if answer is None:
                return 0
            print(answer)


if __name__ == "__main__":
    sys.exit(main())
