"""Directories, revisions, refs and the command line over temporary trees."""

from __future__ import annotations

import json
import os
import subprocess

import pytest

from inkwell.operators import files
from inkwell.plans import refs
from inkwell.plans.cli import list_families, list_languages, run
from inkwell.sources import tree
from inkwell.sources.ignore import OWN, IgnoreRules, masked

LIB = "//! Doc.\nfn a() {}\nfn b() {}\n\n#[cfg(test)]\nmod tests {\n    #[test]\n    fn c() {\n        a();\n    }\n}\nfn d() {}\n"


def write(root, files: dict[str, str | bytes]) -> None:
    for path, content in files.items():
        at = root / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(content.encode() if isinstance(content, str) else content)


def git(root, *args: str) -> str:
    env = os.environ | {"GIT_CONFIG_GLOBAL": "/dev/null", "GIT_AUTHOR_NAME": "a", "GIT_AUTHOR_EMAIL": "a@b", "GIT_COMMITTER_NAME": "a", "GIT_COMMITTER_EMAIL": "a@b"}
    return subprocess.run(["git", "-C", str(root), *args], check=True, capture_output=True, text=True, env=env).stdout.strip()


def commit(root, message: str = "x") -> str:
    git(root, "add", "-A")
    git(root, "commit", "-qm", message, "--allow-empty")
    return git(root, "rev-parse", "HEAD")


@pytest.fixture
def repo(tmp_path):
    root = tmp_path / "repo"
    root.mkdir()
    git(root, "init", "-q", "-b", "main")
    write(root, {"src/lib.rs": LIB, "src/_u.rs": "x\n", "web/app.ts": "let a = 1;\n", "README.md": "# a\n"})
    commit(root)
    return root


def listed(frame):
    return sorted(r.path for r in frame.select("path").collect())


def value(spark, *args):
    return json.loads(run(spark, [*map(str, args), "--format", "json"]))


class TestDirectory:
    def test_what_is_listed(self, spark, tmp_path):
        write(tmp_path, {"a.rs": "x", "_u.rs": "x", ".h/b.rs": "x", "d/c.rs": "x", "d/skip.rs": "x", "e/keep.rs": "x", ".git/z": "x", ".hg/z": "x", ".gitignore": "skip.rs\ne/*\n!e/keep.rs\n", "d/.ignore": "c.rs\n"})
        os.symlink(tmp_path / "a.rs", tmp_path / "link.rs")
        assert listed(tree.directory(spark, str(tmp_path))) == ["_u.rs", "a.rs", "e/keep.rs"]
        assert listed(tree.directory(spark, str(tmp_path), hidden=True)) == [".gitignore", ".h/b.rs", "_u.rs", "a.rs", "d/.ignore", "e/keep.rs"]
        assert listed(tree.directory(spark, str(tmp_path), ignore=False)) == ["_u.rs", "a.rs", "d/c.rs", "d/skip.rs", "e/keep.rs"]
        assert listed(tree.directory(spark, str(tmp_path), subdir="d", ignore=False)) == ["c.rs", "skip.rs"]
        rows = tree.directory(spark, str(tmp_path), partitionBytes=1).collect()
        assert {(r.size, r.content_id, bytes(r.content), r.error) for r in rows} == {(1, None, b"x", None)}

    def test_rules_above_the_root(self, spark, repo):
        write(repo, {".gitignore": "web/\n/src/lib.rs\n", ".git/info/exclude": "_u.rs\n"})
        assert listed(tree.directory(spark, str(repo / "src"))) == []
        assert listed(tree.directory(spark, str(repo), ignore=False, subdir="src")) == ["_u.rs", "lib.rs"]

    def test_own_rules_outrank_ignore_and_that_gitignore(self, spark, tmp_path):
        """Kinds of files rank before depth: what one kind says holds against another kind's deeper file."""
        write(tmp_path, {".gitignore": "*.log\n*.tmp\n*.own\n", ".ignore": "!a.log\n*.own\n", OWN: "!c.own\n", "a.log": "x", "b.log": "x", "c.own": "x", "d.own": "x"})
        write(tmp_path, {"in/.gitignore": "!e.tmp\na.log\n", "in/e.tmp": "x", "in/f.tmp": "x", "in/a.log": "x"})
        assert listed(tree.directory(spark, str(tmp_path))) == ["a.log", "c.own", "in/a.log", "in/e.tmp"]

    def test_parents_count_outside_a_repository(self, spark, tmp_path):
        write(tmp_path, {".gitignore": "skip.rs\n/top/deep/anchored.rs\n", ".ignore": "b.rs\n", OWN: "c.rs\n", "top/deep/a.rs": "x", **{f"top/deep/{n}.rs": "x" for n in ("b", "c", "skip", "anchored")}})
        assert listed(tree.directory(spark, str(tmp_path / "top/deep"))) == ["a.rs"]
        assert listed(tree.directory(spark, str(tmp_path / "top/deep"), ignore=False)) == ["a.rs", "anchored.rs", "b.rs", "c.rs", "skip.rs"]

    def test_git_rules_end_at_a_repository(self, spark, tmp_path):
        """A repository's top hides git's rules above it, on the way down and from below; other kinds go on."""
        write(tmp_path, {".gitignore": "a.rs\n", ".ignore": "b.rs\n", "own/a.rs": "x", "own/b.rs": "x", "own/c.rs": "x", "own/sub/a.rs": "x", "own/sub/c.rs": "x"})
        git(tmp_path, "init", "-q", "own")
        write(tmp_path, {"own/.git/info/exclude": "/c.rs\n"})
        assert listed(tree.directory(spark, str(tmp_path))) == ["own/a.rs", "own/sub/a.rs", "own/sub/c.rs"]
        assert listed(tree.directory(spark, str(tmp_path / "own"))) == ["a.rs", "sub/a.rs", "sub/c.rs"]
        assert listed(tree.directory(spark, str(tmp_path / "own/sub"))) == ["a.rs", "c.rs"]

    def test_global_excludes(self, tmp_path, monkeypatch):
        write(tmp_path, {"home/.config/git/ignore": "*.bak\n", "t/a.bak": "x", "t/b.rs": "x", "t/c.old": "x", "named": "*.old\n"})
        monkeypatch.setenv("HOME", str(tmp_path / "home"))
        monkeypatch.delenv("XDG_CONFIG_HOME", raising=False)
        monkeypatch.delenv("GIT_CONFIG_GLOBAL", raising=False)
        names = lambda: [p for p, *_ in tree.list_directory(str(tmp_path / "t"), IgnoreRules())]
        assert names() == ["b.rs", "c.old"]
        write(tmp_path, {"home/.gitconfig": f"[core]\n\texcludesFile = {tmp_path}/named\n"})
        assert names() == ["a.bak", "b.rs"]
        write(tmp_path, {"t/.gitignore": "!c.old\n"})
        assert names() == ["a.bak", "b.rs", "c.old"]

    def test_names_that_are_not_utf8(self, spark, tmp_path):
        with open(os.fsencode(tmp_path) + b"/bad\xff.rs", "wb") as f:
            f.write(b"x")
        os.mkdir(os.fsencode(tmp_path) + b"/d\xfe")
        with open(os.fsencode(tmp_path) + b"/d\xfe/in.rs", "wb") as f:
            f.write(b"y")
        write(tmp_path, {"good.rs": "z", ".ignore": "[unclosed\n"})
        rows = {r.path: bytes(r.content) for r in tree.directory(spark, str(tmp_path)).collect()}
        assert rows == {"bad\ufffd.rs": b"x", "d\ufffd/in.rs": b"y", "good.rs": b"z"}
        git(tmp_path, "init", "-q")
        commit(tmp_path)
        assert listed(tree.revision(spark, str(tmp_path), "HEAD", ignore=False)) == sorted(rows)

    def test_kept_hidden_files_links_and_deep_trees(self, tmp_path, monkeypatch):
        deep = "/".join("d" for _ in range(1200))
        monkeypatch.chdir(tmp_path)
        for _ in range(1200):
            os.mkdir("d")
            os.chdir("d")
        open("leaf.rs", "w").close()
        os.chdir(tmp_path)
        write(tmp_path, {".gitignore": "!.kept\n", ".kept": "x", ".other": "x", "sub/a.rs": "x"})
        os.symlink(tmp_path, tmp_path / "sub/loop")
        try:
            found = [p for p, *_ in tree.list_directory(str(tmp_path), IgnoreRules(), follow=True)]
        finally:
            subprocess.run(["rm", "-rf", str(tmp_path / "d")], check=True)
        assert found == [".kept", f"{deep}/leaf.rs", "sub/a.rs"]

    def test_unreadable_files_are_error_rows(self, spark, tmp_path):
        """A file that goes between listing and reading is a row with its error, and the rest is read."""
        write(tmp_path, {"a.rs": "x\n", "b.rs": "y\n"})
        reader = tree.DirectoryReader({"path": str(tmp_path)})
        (part,) = reader.partitions()
        (tmp_path / "a.rs").unlink()
        rows = list(reader.read(part))
        assert [(r[0], r[4] is None) for r in rows] == [("a.rs", False), ("b.rs", True)]
        frame = spark.createDataFrame(rows, tree.SCHEMA)
        assert [r.path for r in files.errors(frame).collect()] == ["a.rs"] and [r.path for r in files.report(frame).collect()] == ["b.rs"]

    def test_errors(self, spark, tmp_path):
        with pytest.raises(Exception, match="no such path"):
            tree.directory(spark, str(tmp_path / "none")).collect()
        with pytest.raises(ValueError, match="no such path"):
            run(spark, [str(tmp_path / "none")])


class TestRevision:
    def test_tree(self, spark, repo):
        write(repo, {"src/new.rs": "x\n"})
        rows = {r.path: r for r in tree.revision(spark, str(repo), "HEAD").collect()}
        assert sorted(rows) == ["README.md", "src/_u.rs", "src/lib.rs", "web/app.ts"]
        assert rows["src/_u.rs"].content_id == git(repo, "rev-parse", "HEAD:src/_u.rs") and rows["src/_u.rs"].size is None
        assert listed(tree.revision(spark, str(repo / "src"), "main", subdir="src")) == ["_u.rs", "lib.rs"]
        with pytest.raises(tree.Missing):
            tree.list_revision(str(repo), "HEAD", "none")
        with pytest.raises(ValueError):
            tree.list_revision(str(repo), "unheard")
        with pytest.raises(ValueError, match="not a directory"):
            tree.list_revision(str(repo), "HEAD", "README.md")

    def test_ignore_rules_in_a_tree(self, spark, repo):
        write(repo, {".gitignore": "web/\n", ".ignore": "src/_u.rs\n", ".x/y.rs": "x\n"})
        git(repo, "add", "-Af")
        commit(repo)
        assert listed(tree.revision(spark, str(repo), "HEAD")) == ["README.md", "src/lib.rs", "web/app.ts"]
        assert ".x/y.rs" in listed(tree.revision(spark, str(repo), "HEAD", hidden=True))
        frame = tree.revision(spark, str(repo), "HEAD", ignore=False, hidden=True)
        assert listed(masked(frame, IgnoreRules())) == ["README.md", "src/lib.rs"]
        assert listed(masked(frame, IgnoreRules.none())) == listed(frame)

    def test_content_ids_are_those_of_git(self, spark, repo):
        from pyspark.sql import functions as F

        from inkwell.operators import diff

        frame = tree.revision(spark, str(repo), "HEAD").withColumn("own", diff.content_id(F.col("content")))
        assert frame.where("own <> content_id").count() == 0


class TestRefs:
    def test_parsing(self):
        parse = refs.Ref.parse
        assert parse("a/b") == refs.Ref("path", "a/b") and parse("git:x:y") == refs.Ref("git", "x:y") and parse("git-merge:a:b:c") == refs.Ref("merge", "a", "b:c")
        assert [str(parse(t)) for t in (".", "git:git:x", "git-merge:a:b")] == [".", "git:git:x", "git-merge:a:b"]
        for bad in ("git:", "git-merge:a", "git-merge::b", "git-merge:a:", ""):
            with pytest.raises(ValueError):
                parse(bad)

    def test_subdirectories(self):
        assert [refs.tidy_subdir(t) for t in (None, ".", "./", "./src/", "/src//", "a\\b", " src ")] == ["", "", "", "src", "src", "a/b", "src"]

    def test_default(self, repo, tmp_path):
        assert refs.default_refs(str(tmp_path)) == ([refs.Ref("path", ".")], None)
        assert refs.default_branch(str(repo)) == "main" and refs.on_branch(str(repo), "origin/main") and not refs.is_dirty(str(repo))
        assert refs.default_refs(str(repo))[0] == [refs.Ref("path", str(repo))]
        write(repo, {"new": "x"})
        assert refs.is_dirty(str(repo)) and refs.default_refs(str(repo))[0][0] == refs.Ref("merge", "main", "HEAD")
        git(repo, "checkout", "-q", "--orphan", "other")
        assert refs.head_branch(str(repo)) == "other"
        found, note = refs.default_refs(str(repo))
        assert found[0] == refs.Ref("git", "main") and "no commit in common" in note
        git(repo, "branch", "-m", "main", "elsewhere")
        found, note = refs.default_refs(str(repo))
        assert len(found) == 1 and "no default branch" in note


class TestCommand:
    def test_one_source(self, spark, repo):
        got = value(spark, repo, "--by", "language")
        rust = next(r for r in got["rows"] if r["label"] == "Rust")
        assert (rust["files"], rust["impl"], rust["test"]["code"], rust["family"]) == (2, {"code": 4, "comments": 1, "blanks": 1}, 7, "Systems")
        assert got["total"]["lines"] == sum(r["lines"] for r in got["rows"])
        assert value(spark, f"git:{git(repo, 'rev-parse', 'HEAD')}", "-C", repo)["rows"] == got["rows"]
        flat = run(spark, [str(repo), "--no-families", "--color", "never", "--sort", "name"])
        assert [x.split()[0] for x in flat.splitlines()[4:-3]] == ["Markdown", "Rust", "TypeScript"] and "─ " not in flat.replace("─" * 9, "")

    def test_change_between_revisions(self, spark, repo):
        write(repo, {"src/lib.rs": LIB.replace("fn d() {}\n", "fn d() {}\nfn e() {}\n")})
        commit(repo)
        got = value(spark, "git:HEAD~1", "git:HEAD", "-C", repo)
        assert got["diff"] and [(r["label"], r["files"], r["impl"]["code"]) for r in got["rows"]] == [("Rust", 0, 1)]
        assert value(spark, "git:HEAD", "git:HEAD", "-C", repo)["rows"] == []
        (repo / "web/app.ts").unlink()
        gone = value(spark, "git:HEAD", ".", "-C", repo)
        assert [(r["label"], r["files"], r["impl"]["code"]) for r in gone["rows"]] == [("TypeScript", -1, -1)]
        assert "+1" in run(spark, ["git:HEAD~1", "git:HEAD", "-C", str(repo), "--color", "never"])

    def test_merge_base(self, spark, repo):
        git(repo, "checkout", "-q", "-b", "topic")
        write(repo, {"src/topic.rs": "x\n"})
        commit(repo)
        git(repo, "checkout", "-q", "main")
        write(repo, {"src/main.rs": "x\ny\n"})
        commit(repo)
        got = value(spark, "git-merge:main:topic", "git:topic", "-C", repo)
        assert got["source"] == "merge-base(main, topic) → topic" and got["total"]["impl"]["code"] == 1

    def test_subdirectories(self, spark, repo):
        assert value(spark, repo, "--in", "web")["total"]["files"] == 1
        write(repo, {"added/a.rs": "x\ny\n"})
        got = value(spark, "git:HEAD", ".", "-C", repo, "--in", "added")
        assert got["source"].startswith("HEAD:added (absent) → ") and got["total"]["impl"]["code"] == 2
        for args in (["git:HEAD", ".", "--in", "none"], ["git:HEAD", "--in", "none"], [".", "--in", "none"]):
            with pytest.raises(ValueError, match="none does not exist in"):
                run(spark, [*args, "-C", str(repo)])

    def test_filters(self, spark, repo):
        assert [r["label"] for r in value(spark, repo, "--files", "-i", "*.rs", "-e", "_*")["rows"]] == ["src/lib.rs"]
        assert [r["label"] for r in value(spark, repo, "-l", "ts")["rows"]] == ["TypeScript"]
        assert value(spark, repo, "--max-file-size", 5)["total"]["files"] == 2
        assert value(spark, repo, "--by", "directory", "--depth", 0)["rows"][0]["label"] == "."
        assert len(value(spark, repo, "--by", "extension", "-n", 1)["rows"]) == 1
        with pytest.raises(ValueError, match="unknown language"):
            run(spark, [str(repo), "-l", "nothing"])

    def test_lists(self):
        assert "Rust" in list_languages() and len(list_families().splitlines()) == 13
