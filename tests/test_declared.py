"""Every language of the database against a file made from its own delimiters, whose counts are declared as it is made."""

from __future__ import annotations

import pytest

from inkwell.functions import scanner
from inkwell.functions.languages import Language, registry

REG = registry()


def declared(x: Language) -> tuple[str, int, int, int]:
    """(text, code, comments, blanks): plain lines, each kind of comment by itself and behind code, marks inside strings, blanks."""
    lines: list[tuple[str, str]] = [("  zq 1", "code"), ("", "blank"), (" \t", "blank")]
    for mark in x.line:
        if any(mark == a for a, _ in x.quotes):
            continue  # reads as an open string
        indent = "" if x.fortran else "  "
        lines += [(f"{indent}{mark} said", "comment"), (f"  zq {mark} said" if not x.fortran else "  zq 2", "code")]
    for a, b in x.comments:
        if any(a.startswith(m) or m.startswith(a) for m in x.line):
            continue  # which of the two such a line begins with is told apart by more than its start
        lines += [(f"{a} said {b}", "comment"), (f"{a} said", "comment"), ("", "comment"), ("zq 3", "comment"), (f"said {b}", "comment"), (f"zq {a} said {b}", "code"), ("zq 4", "code")]
    marks = [*x.line, *(a for a, _ in x.comments)]
    for a, b in x.quotes:
        inside = [m for m in marks if not any(q in m or m in q for pair in (*x.quotes, *x.doc, *x.verbatim) for q in pair)]
        lines += [(f"zq = {a} {m} {b}", "code") for m in inside] + [("zq 5", "code")]
    kinds = ["comment" if x.literate and kind == "code" else kind for _, kind in lines]
    return "\n".join(t for t, _ in lines) + "\n", kinds.count("code"), kinds.count("comment"), kinds.count("blank")


@pytest.mark.parametrize("key", sorted(REG.languages))
def test_declared_counts(key):
    text, code, comments, blanks = declared(REG.languages[key])
    got = scanner.count(text.encode(), REG.languages[key], False)
    assert [got[k] + got[k + 3] for k in range(3)] == [code, comments, blanks], scanner.classify(text.encode(), REG.languages[key])
