"""Small sources of our own whose counts were set by hand, several rules of the classifier to each."""

from __future__ import annotations

from typing import NamedTuple

Six = tuple[int, int, int, int, int, int]


class Sample(NamedTuple):
    """``known`` are the six counters, ``docs_as_code`` those with doc strings counted as code where that differs."""

    name: str
    path: str
    text: str
    known: Six
    docs_as_code: Six | None = None


SAMPLES: tuple[Sample, ...] = (
    Sample(
        "a parser with notes, a banner in a string and unit tests", "src/parser.rs",
        "//! Reads ledgers.\n\n/* Entries are kept\n   /* in the order read */\n\n   and never sorted. */\npub fn read(line: &str) -> Entry {\n    let banner = \"/* not a note */ // nor this\"; // but this is\n"
        "    parse(line, banner)\n}\n\n#[cfg(test)]\nmod checks {\n    // braces in text do not count: }\n    const OPEN: &str = \"{{{\";\n\n    fn reads() {\n        read(\"1 apple\");\n    }\n}\npub struct Entry;\n",
        (5, 5, 2, 7, 1, 1),
    ),
    Sample("a raw string that holds a quote and a mark", "src/help.rs", "const HELP: &str = r#\"\n  say \"// hello\"\n\n  /* and leave */\n\"#;\n// the end\n", (5, 1, 0, 0, 0, 0)),
    Sample("a single test below its mark, then production code", "src/sum.rs", "fn add(a: u8) -> u8 { a }\n\n#[test]\nfn adds()\n{\n    add(1); /* one\n    more */\n}\nfn sub(a: u8) -> u8 { a }", (2, 0, 1, 5, 1, 0)),
    Sample(
        "a module with documentation and two kinds of test", "src/orders.py",
        "\"\"\"Orders.\n\nA cart's '''life'''.\n\"\"\"\nimport cart  # the model\n\n# totals\ndef total(rows):\n    \"\"\"In cents.\"\"\"\n    return sum(rows)\n\ndef test_total():\n    rows = [1, 2]\n\n    assert total(rows) == 3\nLIMIT = '# 10'\nclass TestCart:\n    # nothing yet\n    size = 0\n",
        (4, 6, 2, 5, 1, 1), (9, 1, 2, 5, 1, 1),
    ),
    Sample("a driver in C with blocks that do not nest", "src/driver.c", "/* Resets the bus\n * (see /* chapter 2) */\n#include <bus.h>\n\f\nint reset(void) { /* nothing to free */\n\treturn 0; }\n/* one */ int a; /* two */\nchar *s = \"\\\"/*\";\n/* left open\n\nint b;\n", (4, 6, 1, 0, 0, 0)),
    Sample("a header read on another system", "src/limits.h", "// bounds\r\n#define MOST 9\r\n\r\n/* least\r\n   follows */\r\n#define LEAST 1\r\n", (2, 3, 1, 0, 0, 0)),
    Sample("settings with quoted marks and long strings", "conf/site.toml", "# site\ntitle = \"a # b\"\n\nintro = '''\n# not a note\n\n'''\nport = 80 # http\n", (6, 1, 1, 0, 0, 0)),
    Sample("a deployment", "conf/deploy.yaml", "# web\nname: web\n\nargs:\n  # as given\n  - '#1'\n  - two # parts\n\t\n", (4, 2, 2, 0, 0, 0)),
    Sample("a guide", "docs/guide.md", "Guide\n=====\n\n    let a = 1;\n\n* first // of all\n", (0, 4, 2, 0, 0, 0)),
    Sample("a widget and its suites", "src/widget.ts", "export const label = `a\nand // b`;\n/** Draws. */\nfunction draw() {}\n\ndescribe('draw', () => {\n  it('works', () => {\n    // twice\n    draw();\n\n  });\n});\ndraw();\n", (4, 1, 1, 5, 1, 1)),
    Sample("comments that nest beside those that do not", "src/mix.d", "/+ outer\n/+ inner +/\nstill +/\nint a;\n/* flat /* */ int b;\n", (2, 3, 0, 0, 0, 0)),
    Sample("fixed columns", "src/solve.f", "C     SOLVES\n      X = 1\n* STARS\n\n      Y = 'C'\nc low\n", (2, 3, 1, 0, 0, 0)),
    Sample("a whole file of tests", "tests/smoke.go", "package smoke\n\n// runs\nfunc run() { go() }\n", (0, 0, 0, 2, 1, 1)),
    Sample("a mark that no block follows", "src/bare.rs", "#[test]\n" + "call();\n" * 12, (2, 0, 0, 11, 0, 0)),
    Sample("nothing but blanks", "src/blank.c", "\n \t\r\n\f\n", (0, 0, 3, 0, 0, 0)),
)
