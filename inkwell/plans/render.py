"""Tables, CSV and JSON of a report's rows. Rows are as many as are shown, collected once they are sorted and cut."""

from __future__ import annotations

import json
import os
import sys
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.operators.files import COUNTERS
from inkwell.operators.report import TOTAL

HEADERS = ("FILES", "IMPL", "DOC", "TEST", "TOTAL", "DOC%", "TEST%")
BOLD, DIM, GREEN, RED = "1", "2", "32", "31"
#: Before a family's members.
BRANCH = {"member": "├─  ", "last": "└─  "}


def number(n: int, signed: bool = False) -> str:
    return f"{n:+,}" if signed and n > 0 else f"{n:,}"


def percent(part: int, whole: int) -> str:
    return f"{100 * part / whole:.0f}%" if whole > 0 and 0 <= part <= whole else "—"


def _sum(rows: Sequence[dict]) -> dict:
    return {"family": None, "label": TOTAL, "kind": "total"} | {c: sum(r[c] for r in rows) for c in ("files", *COUNTERS)}


def _lines(row: dict) -> int:
    return sum(row[c] for c in COUNTERS)


def _cells(row: dict, signed: bool) -> list[str]:
    docs, lines = row["impl_comments"] + row["test_comments"], _lines(row)
    values = (row["files"], row["impl_code"], docs, row["test_code"], lines)
    return [number(v, signed) for v in values] + [percent(docs, lines), percent(row["test_code"], row["impl_code"] + row["test_code"])]


def wants_color(choice: str, stream=None) -> bool:
    if choice != "auto":
        return choice == "always"
    return (stream or sys.stdout).isatty() and not os.environ.get("NO_COLOR")


def _paint(text: str, *styles: str | None, on: bool) -> str:
    chosen = [s for s in styles if s]
    return f"\x1b[{';'.join(chosen)}m{text}\x1b[0m" if on and chosen and text else text


def table(header: str, heading: str, rows: Sequence[dict], signed: bool = False, color: bool = False) -> str:
    """A text table; ``rows`` are dictionaries with label, kind, files and the counters, families before their members."""
    total = _sum([r for r in rows if r.get("kind") != "family"])
    labels = [(BRANCH.get(r.get("kind"), ""), r["label"]) for r in rows]
    wide = max(len(p) + len(t) for p, t in [("", heading), ("", TOTAL), *labels])
    body = [_cells(r, signed) for r in rows]
    last = _cells(total, signed)
    widths = [max(len(c[i].encode()) if c[i] == "—" else len(c[i]) for c in [list(HEADERS), last, *body]) for i in range(len(HEADERS))]

    def line(prefix: str, text: str, cells: Sequence[str], style: str | None) -> str:
        out = _paint(prefix, DIM, on=color) + _paint(text, style, on=color) + " " * (wide - len(prefix) - len(text))
        for cell, width in zip(cells, widths, strict=True):
            sign = {"+": GREEN, "-": RED}.get(cell[:1]) if signed else None
            out += "  " + _paint(cell.rjust(width), style, sign, on=color)
        return out

    rule = _paint("─" * (wide + sum(w + 2 for w in widths)), DIM, on=color)
    out = [_paint(header, BOLD, on=color), rule, line("", heading, HEADERS, DIM), rule]
    out += [line(*l, c, BOLD if r.get("kind") == "family" else None) for l, c, r in zip(labels, body, rows, strict=True)]
    return "\n".join([*out, rule, line("", TOTAL, last, BOLD), rule, ""])


def _quoted(field: str) -> str:
    return '"' + field.replace('"', '""') + '"' if any(c in field for c in ',"\n') else field


def csv(heading: str, rows: Sequence[dict]) -> str:
    families = any(r["family"] is not None for r in rows)
    out = [",".join([*(["family"] if families else []), heading.lower(), "files", *COUNTERS, "total"])]
    for r in [*rows, _sum(rows)]:
        first = [_quoted(r["family"] or "")] if families else []
        out.append(",".join([*first, _quoted(r["label"]), *(str(r[c]) for c in ("files", *COUNTERS)), str(_lines(r))]))
    return "\n".join([*out, ""])


def json_value(source: str, dimension: str, rows: Sequence[dict], diff: bool = False) -> dict:
    def one(r: dict) -> dict:
        parts = {side: {kind: r[f"{side}_{kind}"] for kind in ("code", "comments", "blanks")} for side in ("impl", "test")}
        out = {"label": r["label"], "files": r["files"], **parts, "lines": _lines(r)}
        return out if r["family"] is None else out | {"family": r["family"]}

    return {"source": source, "dimension": dimension, "diff": diff, "rows": [one(r) for r in rows], "total": one(_sum(rows))}


def json_text(*args, **options) -> str:
    return json.dumps(json_value(*args, **options), indent=2, ensure_ascii=False) + "\n"


def csv_rows(shown: DataFrame) -> DataFrame:
    """The CSV line of each row as a native column, for results too large for the driver."""
    field = lambda c: F.when(c.rlike(r'[,"\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    total = sum((F.col(c) for c in COUNTERS[1:]), F.col(COUNTERS[0]))
    numbers: list[Column] = [F.col(c).cast("string") for c in ("files", *COUNTERS)] + [total.cast("string")]
    family = F.when(F.col("family").isNotNull(), field(F.col("family")))
    return shown.select(F.concat_ws(",", family, field(F.col("label")), *numbers).alias("line"))


def json_rows(shown: DataFrame) -> DataFrame:
    """The JSON object of each row as a native column."""
    side = lambda s: F.struct(*[F.col(f"{s}_{k}").alias(k) for k in ("code", "comments", "blanks")]).alias(s if s != "impl" else "impl")
    total = sum((F.col(c) for c in COUNTERS[1:]), F.col(COUNTERS[0]))
    return shown.select(F.to_json(F.struct("label", "files", side("impl"), side("test"), total.alias("lines"), "family")).alias("object"))
