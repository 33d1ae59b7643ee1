"""A small tree and repository of known content, for the registered queries about directories, revisions and the command line."""

from __future__ import annotations

import os
import subprocess
import tempfile

from pyspark.sql import SparkSession

from inkwell.samples import SAMPLES
from inkwell.sources.ignore import OWN

_made: dict[str, str] = {}
TEXT = {s.path: s.text for s in SAMPLES}
FIRST = {
    "src/orders.py": TEXT["src/orders.py"], "src/driver.c": TEXT["src/driver.c"], "conf/deploy.yaml": TEXT["conf/deploy.yaml"], "docs/guide.md": TEXT["docs/guide.md"],
    ".gitignore": "*.tmp\nbuild/\n", ".ignore": "!kept.tmp\nlocal.yaml\n",
}
#: What the branch ``topic`` changes; none for a file that goes.
SECOND = {"src/driver.c": TEXT["src/driver.c"] + "int c;\n", "docs/guide.md": None, "src/widget.ts": TEXT["src/widget.ts"]}
#: Files that are not committed.
LOOSE = {"kept.tmp": "x\n", "gone.tmp": "x\n", "build/made.rs": "x\n", "local.yaml": "a: 1\n", "conf/own.yaml": "b: 1\n", OWN: "own.yaml\n", ".secret/a.py": "x\n", "run": "#!/bin/sh\necho 1\n"}


def _folder(spark: SparkSession) -> str:
    """A folder that the tasks can read: below ``spark.checkpoint.dir`` where that is a path, a local one only on a local master."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    shared = shared.removeprefix("file://") if shared else ""
    if shared.startswith("/"):
        os.makedirs(shared, exist_ok=True)
        return tempfile.mkdtemp(prefix="inkwell-demo-", dir=shared)
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="inkwell-demo-")


def _git(root: str, *args: str) -> None:
    who = {f"GIT_{w}_{k}": v for w in ("AUTHOR", "COMMITTER") for k, v in (("NAME", "demo"), ("EMAIL", "demo@localhost"), ("DATE", "2020-01-01T00:00:00Z"))}
    subprocess.run(["git", "-C", root, "-c", "core.excludesFile=/dev/null", *args], check=True, capture_output=True, env=os.environ | who)


def _write(root: str, files: dict[str, str | None]) -> None:
    for path, text in files.items():
        at = os.path.join(root, path)
        if text is None:
            os.remove(at)
            continue
        os.makedirs(os.path.dirname(at), exist_ok=True)
        with open(at, "w", encoding="utf-8", newline="") as f:
            f.write(text)


def repository(spark: SparkSession) -> str:
    """The root: ``main`` holds ``FIRST``; ``topic``, which is checked out, changes it by ``SECOND``; ``LOOSE`` lies beside. Made once."""
    key = spark.sparkContext.applicationId
    if key not in _made or not os.path.isdir(_made[key]):
        root = _folder(spark)
        _git(root, "init", "-q", "-b", "main")
        _write(root, FIRST)
        _git(root, "add", "-Af")
        _git(root, "commit", "-qm", "first")
        _git(root, "checkout", "-q", "-b", "topic")
        _write(root, SECOND)
        _git(root, "add", "-Af")
        _git(root, "commit", "-qm", "second")
        _write(root, LOOSE)
        _made[key] = root
    return _made[key]
