"""The line classifier: a fold over the lines of one file, which gives six counts.

State carries over lines: an open string, open comments, a region of tests. Only the places where something can change are visited:
for each state one compiled pattern lists, in order of precedence, what may stand there.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

from inkwell.functions.languages import Language

BLANKS = b" \t\n\x0c\r"
CODE, COMMENT, BLANK = 0, 1, 2
KINDS = ("code", "comment", "blank")
#: Lines after a marker within which its block must open.
PATIENCE = 10
#: Bytes of the longest line that is remembered, and lines remembered for a language.
REMEMBERED, MEMORY = 200, 20_000


@dataclass(frozen=True)
class Config:
    docs_as_comments: bool = True
    test_blocks: bool = True
    skip_binary: bool = True


def _any(options) -> str:
    return "|".join(re.escape(o).decode("latin-1") for o in options if o)


class Syntax:
    """A language's delimiters as bytes, and the patterns of each state."""

    def __init__(self, language: Language):
        raw = lambda pairs: tuple((a.encode(), b.encode()) for a, b in pairs)
        self.line = tuple(x.encode() for x in language.line)
        self.comments, self.inner = raw(language.comments), set(raw(language.inner))
        self.quotes, self.doc, self.verbatim = raw(language.quotes), raw(language.doc), raw(language.verbatim)
        self.nested, self.literate, self.fortran = language.nested, language.literate, language.fortran
        self.markers, self.indented = tuple(x.encode() for x in language.test_blocks), language.indent_style
        self.openers = [(a, b, True, False) for a, b in self.doc] + [(a, b, False, True) for a, b in self.verbatim] + [(a, b, False, False) for a, b in self.quotes]
        self.patterns: dict[tuple, re.Pattern[bytes]] = {}
        #: What a line outside strings and comments does, for each set of options.
        self.seen: dict[bool, dict[bytes, tuple]] = {True: {}, False: {}}

    def pattern(self, quote: bytes | None, verbatim: bool, top: bytes | None) -> re.Pattern[bytes]:
        key = (quote, verbatim, top)
        if key not in self.patterns:
            parts = []
            if quote is not None:
                parts.append(f"(?P<quit>{_any([quote])})")
            if not verbatim:
                after = _any(a for a, _ in self.quotes)
                parts.append(r"(?P<skip>\\\\" + (rf"|\\(?={after})" if after else "") + ")")
            if top is not None:
                parts.append(f"(?P<pop>{_any([top])})")
            if quote is None:
                if top is None:
                    parts += [f"(?P<q{i}>{_any([o[0]])})" for i, o in enumerate(self.openers)]
                parts += [f"(?P<c{i}>{_any([a])})" for i, (a, _) in enumerate(self.comments)]
                if top is None:
                    parts += [f"(?P<line>{_any(self.line)})"] if self.line else []
                    parts += [r"(?P<brace>[{}])"]
            self.patterns[key] = re.compile("|".join(parts).encode("latin-1") or b"(?!)", re.S)
        return self.patterns[key]


@lru_cache(maxsize=1024)
def syntax(language: Language) -> Syntax:
    return Syntax(language)


class Scan:
    """The fold's state over one file."""

    def __init__(self, language: Language | None, test_file: bool, config: Config):
        self.language, self.test_file, self.config = language, test_file, config
        self.s = syntax(language) if language else None
        self.quote: bytes | None = None
        self.is_doc = self.is_verbatim = False
        self.stack: list[bytes] = []
        self.tests = bool(self.s and self.s.markers and config.test_blocks and not test_file)
        self.block: list | None = None  # [indent, depth, opened, waited]

    def line(self, raw: bytes) -> tuple[int, bool]:
        """The kind of the next line, and whether it is a test's."""
        if self.s is None:
            return (CODE if raw.strip(BLANKS) else BLANK), self.test_file
        plain = self.quote is None and not self.stack
        if plain:
            # sources repeat their lines: what one does to a scan at rest is remembered
            seen = self.s.seen[self.config.docs_as_comments]
            known = seen.get(raw)
            if known is None:
                known = self._visit(raw)
                if len(raw) <= REMEMBERED:
                    if len(seen) >= MEMORY:
                        seen.clear()
                    seen[raw] = known
            kind, delta, quote, is_doc, is_verbatim, stack, opens, indent = known
            if stack:
                self.stack = list(stack)
            if quote is not None:
                self.quote, self.is_doc, self.is_verbatim = quote, is_doc, is_verbatim
            if kind == BLANK:
                return BLANK, self.test_file or self.block is not None
        else:
            kind, delta, *_, opens, indent = self._visit(raw)
        return kind, self.test_file or (self.tests and self._in_tests(indent, plain and opens, delta))

    def _visit(self, raw: bytes) -> tuple:
        """(kind, change of depth, the state after it, whether it begins with a test marker, indent) of a line; the state is moved on."""
        s, trimmed = self.s, raw.strip(BLANKS)
        if not trimmed and self.quote is None and not self.stack:
            return BLANK, 0, None, False, False, (), False, 0
        line = raw if s.fortran else trimmed
        started = bool(self.stack) or (self.config.docs_as_comments and self.quote is not None and self.is_doc)
        delta = self._advance(line)
        kind = COMMENT if s.literate or self._reads_as_comment(line, trimmed, started) else CODE
        return kind, delta, self.quote, self.is_doc, self.is_verbatim, tuple(self.stack), line.startswith(s.markers or b"\n"), len(raw) - len(raw.lstrip(BLANKS))

    def _advance(self, line: bytes) -> int:
        s, at, delta, end = self.s, 0, 0, len(line.rstrip(BLANKS))
        while at < end:
            m = s.pattern(self.quote, self.is_verbatim, self.stack[-1] if self.stack else None).search(line, at)
            if m is None or m.start() >= end:
                break
            what, at = m.lastgroup, max(m.end(), m.start() + 1)
            if what == "quit":
                self.quote = None
            elif what == "skip":
                at = m.start() + 2 if m.end() - m.start() == 2 else self._past_quote(line, m.end())
            elif what == "pop":
                self.stack.pop()
            elif what == "line":
                break
            elif what == "brace":
                delta += 1 if m[0] == b"{" else -1
            elif what[0] == "q":
                _, self.quote, self.is_doc, self.is_verbatim = s.openers[int(what[1:])]
            else:
                pair = s.comments[int(what[1:])]
                if not self.stack or s.nested or pair in s.inner:
                    self.stack.append(pair[1])
        return delta

    def _past_quote(self, line: bytes, at: int) -> int:
        # a backslash and the opener behind it: two bytes, whatever the opener's length
        return at + 1

    def _reads_as_comment(self, line: bytes, trimmed: bytes, started: bool) -> bool:
        s = self.s
        if self.quote is not None:
            return self.is_doc and self.config.docs_as_comments
        if started or trimmed.startswith(s.line or b"\n"):
            return True
        pairs = s.comments + s.doc if self.config.docs_as_comments else s.comments
        if any(trimmed.startswith(a) and trimmed.endswith(b) and len(trimmed) >= len(a) + len(b) for a, b in pairs):
            return True
        return bool(self.stack) and any(b == self.stack[-1] and trimmed.startswith(a) for a, b in s.comments)

    def _in_tests(self, indent: int, opens: bool, delta: int) -> bool:
        if self.block is not None:
            block = self.block
            if self.s.indented:
                if indent > block[0]:
                    return True
            else:
                block[1] += delta
                block[2] |= delta > 0
                if block[2]:
                    if block[1] <= 0:
                        self.block = None
                    return True
                block[3] += 1
                if block[3] <= PATIENCE:
                    return True
            self.block = None  # the region ended before this line, which may open another
        if opens:
            self.block = [indent, delta, delta > 0, 0]
            return True
        return False


def lines_of(data: bytes) -> list[bytes]:
    """Lines without their end; one carriage return before it goes too. What follows the last line break counts unless empty."""
    lines = data.split(b"\n")
    if lines[-1] == b"":
        lines.pop()
    return [x[:-1] if x.endswith(b"\r") else x for x in lines]


def is_binary(data: bytes) -> bool:
    """Whether the first line holds a NUL."""
    return b"\0" in data[: data.find(b"\n") if b"\n" in data else len(data)]


def count(data: bytes, language: Language | None, test_file: bool = False, config: Config = Config()) -> list[int] | None:  # noqa: B008
    """[impl code, comments, blanks, test code, comments, blanks] of one file; none for a binary one."""
    if config.skip_binary and is_binary(data):
        return None
    scan, out = Scan(language, test_file, config), [0] * 6
    for raw in lines_of(data):
        kind, test = scan.line(raw)
        out[kind + 3 * test] += 1
    return out


def classify(data: bytes, language: Language | None, test_file: bool = False, config: Config = Config()) -> list[tuple[str, bool]]:  # noqa: B008
    """(kind, is test) of each line."""
    scan = Scan(language, test_file, config)
    return [(KINDS[k], t) for k, t in map(scan.line, lines_of(data))]
