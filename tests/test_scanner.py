"""The line classifier: samples of known counts, each rule's finer points, and properties of all inputs."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkwell.functions import scanner
from inkwell.functions.languages import registry
from inkwell.functions.scanner import Config
from inkwell.operators import files
from inkwell.samples import SAMPLES
from inkwell.sources import tree

REG = registry()


def count(key: str | None, text: str | bytes, test: bool = False, **config):
    data = text.encode() if isinstance(text, str) else text
    return scanner.count(data, REG.languages.get(key), test, Config(**config))


@pytest.mark.parametrize("sample", SAMPLES, ids=[s.name for s in SAMPLES])
def test_samples(sample):
    key, test = REG.from_path(sample.path), sample.path.startswith("tests/")
    assert tuple(count(key, sample.text, test)) == sample.known
    assert tuple(count(key, sample.text, test, docs_as_comments=False)) == (sample.docs_as_code or sample.known)


@pytest.mark.parametrize(
    "key,text,known",
    [
        ("Rust", "// a\nx\n\n", (1, 1, 1)),
        ("Rust", "", (0, 0, 0)),
        ("Rust", "\n", (0, 0, 1)),
        ("Rust", "   \n\t\n \r\n", (0, 0, 3)),
        ("D", "/+ a /+ b +/ c +/\nx;\n", (1, 1, 0)),
        ("C", "/* a\n\n", (0, 2, 0)),
        ("Rust", 'let a = "x\ny\\"z\n";\n', (3, 0, 0)),
        ("Perl", "s/\\\"/x/;\n# a\n# b\n", (1, 2, 0)),
        ("Sh", "echo \\\"\n# a\n", (1, 1, 0)),
        ("Sh", 'echo "a\n# b\n', (2, 0, 0)),
        # a line that begins in a string and ends it is judged by its own start
        ("Sh", 'echo "a\n# b"\n', (1, 1, 0)),
        ("Rust", 'let a = r#"\\"#;\n// b\n', (1, 1, 0)),
        ("Markdown", "a\n```\nb\n\n", (0, 3, 1)),
        (None, "// a\n\nb\n", (2, 0, 1)),
        ("Python", "x = '''a\nb'''\n", (2, 0, 0)),
        ("Html", "<!-- a -->\n<p>\n<!-- b\n\n-->\n</p>\n", (2, 4, 0)),
        ("Yaml", "# a\nb: '#'\n", (1, 1, 0)),
        ("FortranLegacy", "c a\n      x = 1\n", (1, 1, 0)),
    ],
)
def test_production_counts(key, text, known):
    assert tuple(count(key, text, docs_as_comments=False)[:3]) == known


@pytest.mark.parametrize(
    "key,text,known",
    [
        ("Rust", "#[test]\nfn a() {\n}\nx;\n", (1, 0, 0, 3, 0, 0)),
        ("Go", "package a\nfunc TestA(t *T) {\n\tx()\n\n}\nfunc b() {}\n", (2, 0, 0, 3, 0, 1)),
        ("Python", "class TestA:\n    def b(self):\n        pass\n\nx = 1\n", (1, 0, 0, 3, 0, 1)),
        # a blank line inside a doc string ends an indented region
        ("Python", 'def test_a():\n    """b\n\n    c"""\n    d()\n', (1, 2, 0, 1, 1, 0)),
        # a test on one line leaves its region open until braces balance or patience ends
        ("JavaScript", "it('a', () => {});\nb();\n", (0, 0, 0, 2, 0, 0)),
        ("JavaScript", "let a = \"describe('\";\n`\nit('x', () => {\n`\n", (4, 0, 0, 0, 0, 0)),
        ("Rust", "#[test]\n#[ignore]\nfn a() {\n}\n", (0, 0, 0, 4, 0, 0)),
    ],
)
def test_regions(key, text, known):
    assert tuple(count(key, text)) == known


def test_escapes_stay_inert_after_a_verbatim_string():
    # the flag of the last string opened outlives it

    scan = scanner.Scan(REG.languages["Rust"], False, Config())
    scan.line(b'r#"x"#')
    assert scan.quote is None and scan.is_verbatim


def test_switches():
    doc = 'def test_a():\n    """b"""\n'
    assert count("Python", doc) == [0, 0, 0, 1, 1, 0]
    assert count("Python", doc, docs_as_comments=False) == [0, 0, 0, 2, 0, 0]
    assert count("Python", doc, test_blocks=False) == [1, 1, 0, 0, 0, 0]
    assert count("Python", doc, test=True) == [0, 0, 0, 1, 1, 0]
    assert count("Python", "a\0\nb") is None and count("Python", "a\nb\0") == [2, 0, 0, 0, 0, 0]
    assert count("Python", "a\0\nb", skip_binary=False) == [2, 0, 0, 0, 0, 0]


def test_bytes_that_are_no_text():
    assert sum(count("Rust", b"\xff\xfe\n// \x80\n\n")) == 3


KEYS = sorted(REG.languages)
alphabet = st.sampled_from(["a", " ", "\t", "\n", "\r\n", "//", "/*", "*/", "#", '"', "'", "`", '"""', "'''", "\\", "{", "}", "<!--", "-->", "(*", "*)", "--", "#[test]", "describe(", "def test_", "\x0b", "é", ";", "%", "r#", '"#'])


@settings(max_examples=400, deadline=None)
@given(st.sampled_from(KEYS), st.lists(alphabet, max_size=60), st.booleans(), st.booleans(), st.booleans())
def test_every_line_is_counted_once(key, parts, test, docs, blocks):
    data = "".join(parts).encode()
    known = count(key, data, test, docs_as_comments=docs, test_blocks=blocks)
    assert sum(known) == len(scanner.lines_of(data))
    lines = scanner.classify(data, REG.languages[key], test, Config(docs, blocks))
    assert known == [sum(1 for k, t in lines if t == side and k == kind) for side in (False, True) for kind in scanner.KINDS]
    assert not test or not any(known[:3])


def step_by_step(data: bytes, language, config: Config) -> list[int]:
    """The scan one byte at a time, as the rules are stated; a check of the compiled patterns."""
    s = scanner.syntax(language)
    quote, is_doc, verbatim, stack, out = None, False, False, [], [0, 0, 0]
    for raw in scanner.lines_of(data):
        trimmed = raw.strip(scanner.BLANKS)
        line = raw if s.fortran else trimmed
        if quote is None and not stack and not trimmed:
            out[2] += 1
            continue
        started, i = bool(stack) or (config.docs_as_comments and quote is not None and is_doc), 0
        while i < len(line) and line[i:].strip(scanner.BLANKS):
            rest = line[i:]
            opener = next((o for o in s.openers if rest.startswith(o[0])), None) if quote is None and not stack else None
            pair = next((p for p in s.comments if rest.startswith(p[0])), None) if quote is None else None
            if quote is not None and rest.startswith(quote):
                i += max(1, len(quote))
                quote = None
            elif not verbatim and rest.startswith(b"\\\\"):
                i += 2
            elif not verbatim and rest[:1] == b"\\" and any(rest[1:].startswith(a) for a, _ in s.quotes):
                i += 2
            elif stack and rest.startswith(stack[-1]):
                i += max(1, len(stack.pop()))
            elif quote is not None:
                i += 1
            elif opener:
                _, quote, is_doc, verbatim = opener
                i += len(opener[0])
            elif pair:
                if not stack or s.nested or pair in s.inner:
                    stack.append(pair[1])
                i += len(pair[0])
            elif not stack and any(rest.startswith(x) for x in s.line):
                break
            else:
                i += 1
        if s.literate:
            comment = True
        elif quote is not None:
            comment = is_doc and config.docs_as_comments
        else:
            pairs = s.comments + (s.doc if config.docs_as_comments else ())
            comment = started or any(trimmed.startswith(x) for x in s.line) or any(trimmed.startswith(a) and trimmed.endswith(b) and len(trimmed) >= len(a + b) for a, b in pairs)
            comment = comment or bool(stack) and any(b == stack[-1] and trimmed.startswith(a) for a, b in s.comments)
        out[1 if comment else 0] += 1
    return out


@settings(max_examples=600, deadline=None)
@given(st.sampled_from(KEYS), st.lists(alphabet, max_size=50), st.booleans())
def test_patterns_agree_with_the_stated_rules(key, parts, docs):
    data, language = "".join(parts).encode(), REG.languages[key]
    known = scanner.count(data, language, False, Config(docs, False))
    assert known[:3] == step_by_step(data, language, Config(docs, False))


def test_one_evaluation_in_the_plan(spark):
    """Texts are split once and cross to Python once, though every counter and the status read the result."""
    made = tree.from_table(spark.range(9), F.concat(F.col("id").cast("string"), F.lit(".rs")), F.concat(F.lit("a\n// b\n"), F.col("id")))
    for frame in (files.report(made, files.Options(include_unknown=True)), files.errors(made)):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("ArrowEvalPython") <= 1 and plan.count(", \n, -1)") <= 1


def test_remembered_lines_change_nothing():
    """A line does the same whether it was seen before or not, in every state it can meet."""
    import random

    r, rust = random.Random(1), registry().languages["Rust"]
    lines = [b"let a = 1;", b"}", b"{", b"/* a", b"b */", b'let s = "x', b'";', b"// c", b"", b"#[test]", b"fn t() {", b"  x();"]
    for _ in range(60):
        data = b"\n".join(r.choice(lines) for _ in range(30))
        first = scanner.count(data, rust)
        assert scanner.count(data, rust) == first
        scanner.syntax.cache_clear()
        assert scanner.count(data, rust) == first
