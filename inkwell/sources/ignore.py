"""Which files of a tree the ignore files in it hide."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from inkwell.functions.globs import IgnoreFile

OWN = ".inkwellignore"
VCS = (".git", ".hg", ".svn", ".jj")


@dataclass(frozen=True)
class IgnoreRules:
    """``files`` are the names of ignore files that count, those that outrank others first, and before ``.gitignore``; a git tree's ``.gitignore`` does not, as what it hides is not committed."""

    files: tuple[str, ...] = (OWN, ".ignore")
    gitignore: bool = True
    hidden: bool = False

    @classmethod
    def none(cls) -> IgnoreRules:
        """No ignore files and no hiding; version control directories are skipped nevertheless."""
        return cls((), False, True)

    @classmethod
    def for_git_tree(cls, hidden: bool = False) -> IgnoreRules:
        return cls(gitignore=False, hidden=hidden)

    @property
    def names(self) -> tuple[str, ...]:
        return self.files + ((".gitignore",) if self.gitignore else ())


@dataclass
class Matcher:
    """Rules of all ignore files of a tree, by name in the rules' order and within one the deepest directory's first."""

    rules: IgnoreRules
    files: list[tuple[str, IgnoreFile]] = field(default_factory=list)

    @classmethod
    def read(cls, paths: Iterable[str], read: Callable[[str], bytes], rules: IgnoreRules) -> Matcher:
        found = []
        for path in paths:
            folder, _, name = path.rpartition("/")
            if name in rules.names:
                found.append((rules.names.index(name), -(folder.count("/") + bool(folder)), folder, IgnoreFile(read(path).decode("utf-8", "replace"), path)))
        found.sort(key=lambda f: f[:3])
        return cls(rules, [f[2:] for f in found])

    def hides(self, path: str) -> bool:
        parts = path.split("/")
        if any(p in VCS for p in parts) or (not self.rules.hidden and any(p.startswith(".") and p not in (".", "..") for p in parts)):
            return True
        for folder, rules in self.files:
            if not folder or path.startswith(folder + "/"):
                verdict = rules.verdict_with_parents(path[len(folder) + 1 if folder else 0 :])
                if verdict is not None:
                    return verdict
        return False


def masked(files: DataFrame, rules: IgnoreRules = IgnoreRules.for_git_tree()) -> DataFrame:  # noqa: B008
    """A frame of files without those that ignore files among its own rows hide.

    The ignore files themselves are collected: a row per directory that has one, of at most the maximal file size.
    """
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    own = files.where(F.element_at(F.split("path", "/"), -1).isin(*rules.names)) if rules.names else files.where(F.lit(False))
    texts = {r["path"]: bytes(r["content"]) for r in own.select("path", F.col("content").cast("binary").alias("content")).toLocalIterator()}
    matcher = Matcher.read(texts, texts.__getitem__, rules)

    @F.pandas_udf(T.BooleanType())
    def shown(paths):
        return paths.map(lambda p: not matcher.hides(p))

    return files.where(shown("path"))
