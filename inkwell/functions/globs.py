"""Globs as regular expressions that Java and Python read alike, and the ignore-file dialect."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _translate(glob: str, star: str, one: str) -> str:
    out, i, depth = [], 0, 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            j = i
            while j < len(glob) and glob[j] == "*":
                j += 1
            left, right = i == 0 or glob[i - 1] == "/", j == len(glob) or glob[j] == "/"
            if j - i == 2 and left and right:
                if j == len(glob):
                    out.append(".*" if i == 0 else ".+")
                else:
                    out.append("(?:.*/)?")
                    j += 1
            else:
                out.append(star)
            i = j
            continue
        if c == "?":
            out.append(one)
        elif c == "[":
            end = glob.find("]", i + 2 if glob[i + 1 : i + 2] not in ("!", "^") else i + 3)
            if end < 0:
                raise ValueError(f"unclosed character class in {glob!r}")
            body = glob[i + 1 : end]
            negated = body[0] in "!^"
            out.append("[" + "^" * negated + re.sub(r"([\\\[\]&^])", r"\\\1", body[negated:]) + "]")
            i = end
        elif c == "{":
            out.append("(?:")
            depth += 1
        elif c == "}" and depth:
            out.append(")")
            depth -= 1
        elif c == "," and depth:
            out.append("|")
        elif c == "\\" and i + 1 < len(glob):
            i += 1
            out.append(re.escape(glob[i]))
        else:
            out.append(re.escape(c) if c not in "/" else c)
        i += 1
    if depth:
        raise ValueError(f"unclosed group in {glob!r}")
    return "".join(out)


def glob_regex(glob: str) -> str:
    """``*`` and ``?`` stand for slashes too; ``**/`` for no or more directories, ``/**`` for whatever is beneath."""
    return _end(r"(?s)\A(?:" + _translate(glob, ".*", ".") + ")")


def sweetened(glob: str) -> list[str]:
    """A glob as users write it: trimmed; with a last slash all beneath; without a slash at any depth."""
    glob = glob.strip()
    if not glob:
        return []
    bare = glob.rstrip("/")
    globs = [bare, f"{bare}/**"] if glob.endswith("/") else [glob]
    return globs + [f"**/{g}" for g in globs if "/" not in bare]


def _end(regex: str) -> str:
    # an end that both dialects have: nothing may follow
    return regex + r"(?!.|\n)"


def any_of(globs: Iterable[str]) -> str | None:
    """One regular expression that matches a path where any of the globs does."""
    parts = [_translate(g, ".*", ".") for g in globs]
    return _end(r"(?s)\A(?:" + "|".join(parts) + ")") if parts else None


@dataclass(frozen=True)
class Globs:
    """Include and exclude globs; exclusion wins, and with any inclusion a path must match one."""

    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()

    def _regexes(self) -> tuple[str | None, str | None]:
        return any_of(s for g in self.include for s in sweetened(g)), any_of(s for g in self.exclude for s in sweetened(g))

    def condition(self, path: Column) -> Column:
        """A native predicate, so that Spark applies it below everything costly."""
        wanted, refused = self._regexes()
        tests = ([path.rlike(wanted)] if wanted else []) + ([~path.rlike(refused)] if refused else [])
        return reduce(lambda a, b: a & b, tests, F.lit(True))

    def keeps(self, path: str) -> bool:
        wanted, refused = self._regexes()
        return not (refused and re.search(refused, path)) and not (wanted and not re.search(wanted, path))


@dataclass(frozen=True)
class Rule:
    regex: re.Pattern[str]
    keep: bool
    only_dirs: bool


class IgnoreFile:
    """The rules of one ignore file, for paths relative to its directory; the last rule that fits decides.

    A malformed pattern is an error, or passed over where ``lenient``.
    """

    def __init__(self, text: str, name: str = "ignore file", lenient: bool = False):
        self.rules: list[Rule] = []
        for line in text.split("\n"):
            line = line.removesuffix("\r")
            line = re.sub(r"(?<!\\)[ \t]+\Z", "", line)
            if not line or line.startswith("#"):
                continue
            keep = line.startswith("!")
            body = line[keep:].removeprefix("\\") if line[keep:].startswith(("\\!", "\\#")) else line[keep:]
            only_dirs, body = body.endswith("/"), body.rstrip("/")
            anchored, body = "/" in body, body.removeprefix("/")
            if not body:
                continue
            try:
                regex = re.compile(_end(r"(?s)\A(?:" + ("" if anchored else "(?:.*/)?") + _translate(body, "[^/]*", "[^/]") + ")"))
            except (ValueError, re.error) as e:
                if lenient:
                    continue
                raise ValueError(f"{name}: malformed pattern {line!r}: {e}") from e
            self.rules.append(Rule(regex, keep, only_dirs))

    def verdict(self, path: str, is_dir: bool) -> bool | None:
        """True: ignored; False: kept; None: no rule fits."""
        for rule in reversed(self.rules):
            if (is_dir or not rule.only_dirs) and rule.regex.search(path):
                return not rule.keep
        return None

    def verdict_with_parents(self, path: str) -> bool | None:
        """The verdict on a file, or else on its nearest directory that has one."""
        found = self.verdict(path, False)
        while found is None and "/" in path:
            path = path.rsplit("/", 1)[0]
            found = self.verdict(path, True)
        return found
