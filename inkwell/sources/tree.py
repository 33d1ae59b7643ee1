"""Directories and git revisions as Spark data sources, and tables as sources.

A source lists on the driver and reads bytes in the tasks, a partition per ``partition_bytes`` of files. Spark's own file source leaves
out names that begin with an underscore or a dot, so it cannot list a source tree.
"""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from inkwell.functions.globs import IgnoreFile
from inkwell.sources.ignore import VCS, IgnoreRules, Matcher

SCHEMA = "path string, size bigint, content_id string, content binary, error string"
PARTITION_BYTES = 32 << 20


class Missing(Exception):
    """A subdirectory that the source does not have."""


@dataclass
class Part(InputPartition):
    files: list[tuple[str, int | None, str | None]]


def _parts(files: list[tuple[str, int | None, str | None]], most: int) -> list[Part]:
    out, size = [Part([])], 0
    for f in files:
        if out[-1].files and (size >= most or len(out[-1].files) >= 10_000):
            out.append(Part([]))
            size = 0
        out[-1].files.append(f)
        size += (f[1] or 16_384) + 1024
    return out


def _true(options, key: str, default: str) -> bool:
    return options.get(key, default).lower() == "true"


def rules_from(options, git: bool) -> IgnoreRules:
    if not _true(options, "ignore", "true"):
        return IgnoreRules((), False, _true(options, "hidden", "false"))
    return IgnoreRules(gitignore=not git, hidden=_true(options, "hidden", "false"))


def shown(path: str) -> str:
    """A path as it is reported: bytes that are not UTF-8 are replaced. The file is opened by the path as it was listed."""
    return os.fsencode(path).decode("utf-8", "replace")


#: Kinds of ignore files by precedence: what one kind says about a path holds whatever the next ones say.
EXCLUDE, GLOBAL = ".git/info/exclude", "global excludes"


class Ignores:
    """The ignore files that hold in a directory: for each kind, the deepest directory's first.

    A rule sees the path from its own file's directory on: ``drop`` characters less than the path below the root, or ``below`` more.
    Git's kinds count outside repositories too, and end at a repository's top.
    """

    def __init__(self, kinds: dict[str, list[tuple[int, str, IgnoreFile]]]):
        self.kinds = kinds

    @staticmethod
    def read(at: str) -> IgnoreFile | None:
        try:
            with open(at, encoding="utf-8", errors="replace") as f:
                return IgnoreFile(f.read(), at, lenient=True)
        except OSError:
            return None

    @classmethod
    def own(cls, folder: str, rules: IgnoreRules) -> tuple[dict[str, IgnoreFile], bool]:
        """The ignore files of one directory by kind, and whether it is a repository's top."""
        names = (*rules.files, *((".gitignore", EXCLUDE) if rules.gitignore else ()))
        return {n: file for n in names if (file := cls.read(os.path.join(folder, n)))}, os.path.exists(os.path.join(folder, ".git"))

    @classmethod
    def above(cls, root: str, rules: IgnoreRules) -> Ignores:
        """What holds over ``root``: files of all directories above it, and the user's excludes."""
        kinds: dict[str, list[tuple[int, str, IgnoreFile]]] = {n: [] for n in (*rules.files, *((".gitignore", EXCLUDE, GLOBAL) if rules.gitignore else ()))}
        here, below = os.path.abspath(root), ""
        inside = not os.path.exists(os.path.join(here, ".git"))
        while kinds and (up := os.path.dirname(here)) != here:
            here, below = up, f"{os.path.basename(here)}/{below}"
            files, top = cls.own(here, rules)
            for name, file in files.items():
                if name in rules.files or inside:
                    kinds[name].append((0, below, file))
            inside = inside and not top
        if GLOBAL in kinds and (file := cls.read(_users_excludes())):
            kinds[GLOBAL].append((0, "", file))
        return cls(kinds)

    def entered(self, folder: str, prefix: str, rules: IgnoreRules) -> Ignores:
        """What holds in a directory below the root, or in the root itself."""
        files, top = self.own(folder, rules)
        if not files and not top:
            return self
        kinds = {}
        for name, found in self.kinds.items():
            kept = [] if top and name in (".gitignore", EXCLUDE) else found
            kinds[name] = [(len(prefix), "", files[name]), *kept] if name in files else kept
        return Ignores(kinds)

    def verdict(self, path: str, is_dir: bool) -> bool | None:
        for found in self.kinds.values():
            for drop, below, file in found:
                verdict = file.verdict(below + path[drop:], is_dir)
                if verdict is not None:
                    return verdict
        return None


def _users_excludes() -> str:
    """The user's own excludes file: the one git's configuration names, or git's default."""
    try:
        named = subprocess.run(["git", "config", "--global", "--type=path", "core.excludesFile"], capture_output=True).stdout.decode("utf-8", "replace").strip()
    except OSError:
        named = ""
    return named or os.path.join(os.environ.get("XDG_CONFIG_HOME") or os.path.join(os.path.expanduser("~"), ".config"), "git", "ignore")


def list_directory(root: str, rules: IgnoreRules, follow: bool = False) -> list[tuple[str, int | None, str | None]]:
    """(path, size, None) of the regular files below ``root``; unreadable directories are passed over, a missing root is an error.

    Directories are visited one after another from a list, so a deep tree needs no deep stack. A hidden entry that an ignore file
    names as kept is kept.
    """
    if not os.path.isdir(root):
        if os.path.isfile(root):
            return [(os.path.basename(root), os.path.getsize(root), None)]
        raise FileNotFoundError(f"no such path: {root}")
    found: list[tuple[str, int | None, str | None]] = []
    waiting = [(root, "", Ignores.above(root, rules))]
    while waiting:
        folder, prefix, ignores = waiting.pop()
        try:
            entries = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError:
            continue
        ignores = ignores.entered(folder, prefix, rules)
        for e in entries:
            path = prefix + e.name
            try:
                is_dir, is_file = e.is_dir(follow_symlinks=follow), e.is_file(follow_symlinks=follow)
                size = e.stat(follow_symlinks=follow).st_size if is_file else None
            except OSError:
                continue
            if is_dir and e.name in VCS:
                continue
            verdict = ignores.verdict(shown(path), is_dir)
            if verdict or (verdict is None and not rules.hidden and e.name.startswith(".")):
                continue
            if is_dir:
                # a followed link that leads back to a directory above it is not entered again
                if not (follow and e.is_symlink() and (os.path.realpath(folder) + "/").startswith(os.path.realpath(e.path) + "/")):
                    waiting.append((e.path, path + "/", ignores))
            elif is_file:
                found.append((path, size, None))
    return sorted(found)


def git(base: str, *args: str, data: bytes | None = None) -> bytes:
    """The output of a git command that reads; an error has git's message."""
    done = subprocess.run(["git", "-C", base, *args], capture_output=True, input=data)
    if done.returncode:
        raise ValueError(done.stderr.decode("utf-8", "replace").strip() or f"git {' '.join(args)} failed")
    return done.stdout


def list_revision(base: str, revision: str, subdir: str = "", ignore: IgnoreRules | None = None) -> list[tuple[str, int | None, str | None]]:
    """(path, None, object id) of the files of a revision's tree; submodules and links are no files. A missing subdirectory raises ``Missing``."""
    commit = git(base, "rev-parse", "--verify", "--end-of-options", f"{revision}^{{commit}}").decode().strip()
    top = git(base, "rev-parse", "--show-toplevel").decode().strip() or base
    prefix = subdir.strip("/")
    if prefix:
        listed = git(top, "ls-tree", "-z", commit, "--", prefix).split(b"\0")[0]
        if not listed:
            raise Missing(prefix)
        if listed.split()[1] != b"tree":
            raise ValueError(f"{prefix} is not a directory in {revision}")
    out: list[tuple[str, int | None, str | None]] = []
    for entry in git(top, "ls-tree", "-r", "-z", f"{commit}:{prefix}").split(b"\0"):
        if entry:
            head, _, path = entry.partition(b"\t")
            mode, _, oid = head.split()[:3]
            if mode in (b"100644", b"100755"):
                out.append((path.decode("utf-8", "replace"), None, oid.decode()))
    out.sort(key=lambda f: (f[0].count("/"), f[0]))
    if ignore is not None:
        ids = {p: i for p, _, i in out}
        matcher = Matcher.read(ids, lambda p: git(top, "cat-file", "blob", ids[p]), ignore)
        out = [f for f in out if not matcher.hides(f[0])]
    return out


def merge_base(base: str, one: str, two: str) -> str:
    return git(base, "merge-base", one, two).decode().strip()


class DirectoryReader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"]
        self.subdir = options.get("subdir", "")
        self.rules = rules_from(options, False)
        self.follow = _true(options, "followlinks", "false")
        self.most = int(options.get("partitionbytes", PARTITION_BYTES))

    def partitions(self):
        return _parts(list_directory(os.path.join(self.root, self.subdir), self.rules, self.follow), self.most)

    def read(self, part) -> Iterator[tuple]:
        root = os.path.join(self.root, self.subdir)
        for path, size, _ in part.files:
            try:
                with open(root if os.path.isfile(root) else os.path.join(root, path), "rb") as f:
                    yield shown(path), size, None, f.read(), None
            except OSError as e:
                yield shown(path), size, None, None, e.strerror or str(e)


class RevisionReader(DataSourceReader):
    def __init__(self, options):
        self.base, self.revision, self.subdir = options.get("path", "."), options["revision"], options.get("subdir", "")
        self.rules = rules_from(options, True)
        self.most = int(options.get("partitionbytes", PARTITION_BYTES))

    def partitions(self):
        return _parts(list_revision(self.base, self.revision, self.subdir, self.rules), self.most)

    def read(self, part) -> Iterator[tuple]:
        if not part.files:
            return
        run = subprocess.Popen(["git", "-C", self.base, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE)
        with run:
            for path, _, oid in part.files:
                run.stdin.write(f"{oid}\n".encode())
                run.stdin.flush()
                head = run.stdout.readline().split()
                if len(head) < 3:
                    yield path, None, oid, None, "missing object"
                    continue
                data = run.stdout.read(int(head[2]))
                run.stdout.read(1)
                yield path, None, oid, data, None
            run.stdin.close()


class Directory(DataSource):
    """``spark.read.format("inkwell_directory").load(root)``; options ignore, hidden, followLinks, subdir, partitionBytes."""

    @classmethod
    def name(cls) -> str:
        return "inkwell_directory"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return DirectoryReader({k.lower(): v for k, v in self.options.items()})


class Revision(DataSource):
    """``spark.read.format("inkwell_git").option("revision", "HEAD").load(base)``; options ignore, hidden, subdir, partitionBytes."""

    @classmethod
    def name(cls) -> str:
        return "inkwell_git"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return RevisionReader({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    for source in (Directory, Revision):
        spark.dataSource.register(source)


def directory(spark: SparkSession, root: str, **options) -> DataFrame:
    register(spark)
    return spark.read.format("inkwell_directory").options(**{k: str(v).lower() if isinstance(v, bool) else v for k, v in options.items()}).load(root)


def revision(spark: SparkSession, base: str, rev: str, **options) -> DataFrame:
    register(spark)
    return spark.read.format("inkwell_git").option("revision", rev).options(**{k: str(v).lower() if isinstance(v, bool) else v for k, v in options.items()}).load(base)


def from_table(table: DataFrame, path: Column, content: Column, size: Column | None = None, content_id: Column | None = None) -> DataFrame:
    """Any frame as a source: a row per file, by expressions over its columns."""
    size = F.octet_length(content) if size is None else size
    return table.select(path.alias("path"), size.cast("long").alias("size"), (F.lit(None).cast("string") if content_id is None else content_id).alias("content_id"), content.alias("content"), F.lit(None).cast("string").alias("error"))


def empty(spark: SparkSession) -> DataFrame:
    """A source without files, for a side that is absent."""
    return spark.createDataFrame([], SCHEMA)
