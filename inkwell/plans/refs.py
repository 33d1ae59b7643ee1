"""What to count: paths, revisions, merge bases, and the choice when nothing is named. Driver-side Python over git's own commands."""

from __future__ import annotations

import os
from dataclasses import dataclass

from inkwell.sources.tree import git, merge_base


@dataclass(frozen=True)
class Ref:
    """``path``: a directory; ``git``: a revision; ``merge``: the merge base of two."""

    kind: str
    one: str
    two: str = ""

    @classmethod
    def parse(cls, text: str) -> Ref:
        if text.startswith("git-merge:"):
            one, _, two = text.removeprefix("git-merge:").partition(":")
            if not one or not two:
                raise ValueError(f"{text!r} must name two revisions: git-merge:A:B")
            return cls("merge", one, two)
        if text.startswith("git:"):
            if not (rev := text.removeprefix("git:")):
                raise ValueError(f"{text!r} must name a revision: git:REV")
            return cls("git", rev)
        if not text:
            raise ValueError("an empty path")
        return cls("path", text)

    def __str__(self) -> str:
        return {"path": self.one, "git": f"git:{self.one}", "merge": f"git-merge:{self.one}:{self.two}"}[self.kind]

    def describe(self, base: str = ".", subdir: str = "") -> str:
        if self.kind == "path":
            return os.path.join(base, self.one, subdir) if subdir else os.path.join(base, self.one) if base != "." else self.one
        name = self.one if self.kind == "git" else f"merge-base({self.one}, {self.two})"
        return f"{name}:{subdir}" if subdir else name

    def revision(self, base: str) -> str:
        return merge_base(base, self.one, self.two) if self.kind == "merge" else self.one


def tidy_subdir(text: str | None) -> str:
    """A subdirectory without leading ``./`` and outer slashes; empty for the root itself."""
    text = (text or "").replace("\\", "/").strip()
    while True:
        shorter = text.strip("/").removeprefix("./")
        if shorter == text:
            return "" if text == "." else text
        text = shorter


def _try(base: str, *args: str) -> str | None:
    try:
        return git(base, *args).decode("utf-8", "replace").strip()
    except (ValueError, OSError):
        return None


def root(base: str) -> str | None:
    return _try(base, "rev-parse", "--show-toplevel") or None


def default_branch(base: str) -> str | None:
    """The branch that origin/HEAD names, else the first that exists of origin/main, origin/master, main, master."""
    named = _try(base, "symbolic-ref", "--quiet", "refs/remotes/origin/HEAD")
    if named and _try(base, "rev-parse", "--verify", "--quiet", named):
        return named.removeprefix("refs/remotes/")
    for branch in ("origin/main", "origin/master", "main", "master"):
        ref = f"refs/remotes/{branch}" if branch.startswith("origin/") else f"refs/heads/{branch}"
        if _try(base, "rev-parse", "--verify", "--quiet", ref):
            return branch
    return None


def head_branch(base: str) -> str | None:
    return _try(base, "symbolic-ref", "--quiet", "--short", "HEAD") or None


def on_branch(base: str, branch: str) -> bool:
    return head_branch(base) == branch.removeprefix("origin/")


def is_dirty(base: str) -> bool:
    """Whether anything is staged, changed or untracked; a status that cannot be read counts as such."""
    status = _try(base, "status", "--porcelain", "--untracked-files=normal")
    return status is None or bool(status)


def default_refs(base: str) -> tuple[list[Ref], str | None]:
    """The refs to count when none is named, and a note for the user."""
    top = root(base)
    if top is None:
        return [Ref("path", ".")], None
    tree = Ref("path", top)
    branch = default_branch(base)
    if branch is None:
        return [tree], f"no default branch found in {top}; counting the working tree instead"
    if on_branch(base, branch) and not is_dirty(base):
        return [tree], None
    try:
        merge_base(base, branch, "HEAD")
    except ValueError:
        return [Ref("git", branch), tree], f"HEAD has no commit in common with {branch}; comparing against {branch} itself"
    return [Ref("merge", branch, "HEAD"), tree], None
