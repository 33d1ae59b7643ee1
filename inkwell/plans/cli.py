"""The command line: ``python -m inkwell [REF [REF]]``."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions.globs import Globs
from inkwell.functions.languages import registry
from inkwell.functions.paths import MAX_SIZE
from inkwell.functions.scanner import Config
from inkwell.operators import diff, files, report
from inkwell.plans import refs, render
from inkwell.sources import tree

NAME = "inkwell"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(NAME, description="Count code, comments, blanks and tests of a tree, or their change between two.")
    p.add_argument("refs", nargs="*", metavar="REF", help="a directory, git:REV or git-merge:A:B; two give the change from the first to the second")
    p.add_argument("-C", "--repo", default=".", metavar="DIR")
    p.add_argument("--in", dest="subdir", metavar="PATH")
    p.add_argument("-i", "--include", action="append", default=[], metavar="GLOB")
    p.add_argument("-e", "--exclude", action="append", default=[], metavar="GLOB")
    p.add_argument("-l", "--language", action="append", metavar="LANG")
    p.add_argument("--include-unknown", action="store_true")
    p.add_argument("--max-file-size", type=int, default=MAX_SIZE, metavar="BYTES")
    p.add_argument("--no-ignore", action="store_true")
    p.add_argument("--hidden", action="store_true")
    p.add_argument("--no-test-blocks", action="store_true")
    p.add_argument("--doc-strings-as-code", action="store_true")
    p.add_argument("-j", "--jobs", type=int, default=64, metavar="N", help="accepted for compatibility; Spark reads as many partitions at a time as it has cores")
    group = p.add_mutually_exclusive_group()
    group.add_argument("--by", choices=report.DIMENSIONS)
    group.add_argument("--files", action="store_true")
    p.add_argument("--no-families", action="store_true")
    p.add_argument("--depth", type=int, default=1)
    p.add_argument("--sort", choices=report.SORTS, default="code")
    p.add_argument("-n", "--top", type=int)
    p.add_argument("--format", choices=("table", "json", "csv"), default="table")
    p.add_argument("--color", choices=("auto", "always", "never"), default="auto")
    p.add_argument("--list-languages", action="store_true")
    p.add_argument("--list-families", action="store_true")
    return p


def list_languages() -> str:
    listed = sorted(registry().languages.values(), key=lambda x: x.name)
    width = max(len(x.name) for x in listed)
    return "".join(f"{x.name:<{width}}  {'yes' if x.detects_tests else '-':<4} {', '.join(x.extensions)}\n" for x in listed)


def list_families() -> str:
    reg = registry()
    return "".join(f"{f}: {', '.join(sorted(reg.languages[k].name for k in keys))}\n" for f, keys in sorted(reg.families.items()))


def options_of(args) -> files.Options:
    return files.Options(
        Globs(tuple(args.include), tuple(args.exclude)), tuple(args.language) if args.language else None, args.include_unknown, args.max_file_size or None,
        True, True, Config(not args.doc_strings_as_code, not args.no_test_blocks, True),
    )


def opened(spark: SparkSession, ref: refs.Ref, args, subdir: str) -> DataFrame | None:
    """The files of a ref below the subdirectory, by paths relative to it; none where the ref does not have it."""
    shared = {"ignore": not args.no_ignore, "hidden": args.hidden}
    if ref.kind == "path":
        root = os.path.join(args.repo, ref.one)
        if not os.path.exists(root):
            raise ValueError(f"no such path: {root}")
        root = os.path.join(root, subdir) if subdir else root
        return tree.directory(spark, root, **shared) if os.path.exists(root) else None
    rev = ref.revision(args.repo)
    try:
        tree.list_revision(args.repo, rev, subdir)
    except tree.Missing:
        return None
    return tree.revision(spark, args.repo, rev, subdir=subdir, **shared)


def run(spark: SparkSession, argv: list[str]) -> str:
    """What the command prints; notes and skipped files go to stderr. A user's error raises ``ValueError``."""
    args = parser().parse_args(argv)
    if args.list_languages:
        return list_languages()
    if args.list_families:
        return list_families()
    if len(args.refs) > 2:
        raise ValueError("at most two refs")
    wanted, note = ([refs.Ref.parse(r) for r in args.refs], None) if args.refs else refs.default_refs(args.repo)
    if note:
        print(f"{NAME}: {note}", file=sys.stderr)
    options, subdir = options_of(args), refs.tidy_subdir(args.subdir)
    options.keys()
    dimension = "file" if args.files else args.by or "language"
    families = dimension == "language" and not args.no_families
    sources = [opened(spark, r, args, subdir) for r in wanted]
    names = [r.describe(args.repo, subdir) for r in wanted]
    if all(s is None for s in sources):
        raise ValueError(f"{subdir} does not exist in {' or in '.join(map(str, wanted))}")
    names = [n if s is not None else f"{n} (absent)" for n, s in zip(names, sources, strict=True)]
    sources = [tree.empty(spark) if s is None else s for s in sources]
    both = len(sources) == 2
    if both:
        # a directory's files get the ids that git would give them, so that equal files are not classified
        known = [s.withColumn("content_id", F.coalesce("content_id", diff.content_id(F.col("content")))) for s in sources]
        changed = diff.changed_paths(*known).persist()
        counted = [files.counted(s, options, changed).persist() for s in sources]
    else:
        counted = [files.counted(sources[0], options).persist()]
    for c in counted:
        for row in c.where("status = 'error'").select("path", "message").toLocalIterator():
            print(f"{NAME}: skipped {row['path']}: {row['message']}", file=sys.stderr)
    reports = [c.where("status = 'counted'") for c in counted]
    grouped = diff.diff_rows(*reports, dimension, args.depth, families) if both else report.rows(reports[0], dimension, args.depth, families)
    shown = report.finish(grouped, args.sort, args.top)
    source = " → ".join(names)
    if args.format == "table":
        if families:
            collected = [r.asDict() for r in report.roll_up(shown, args.sort).orderBy("position").collect()]
        else:
            collected = [r.asDict() | {"kind": "plain"} for r in shown.collect()]
        header = f"{NAME}  {source}" + "  (net change)" * both
        return render.table(header, dimension.upper(), collected, both, render.wants_color(args.color))
    collected = [r.asDict() for r in shown.collect()]
    return render.csv(dimension, collected) if args.format == "csv" else render.json_text(source, dimension, collected, diff=both)


def main() -> int:
    spark = SparkSession.builder.appName(NAME).config("spark.ui.showConsoleProgress", "false").getOrCreate()
    try:
        sys.stdout.write(run(spark, sys.argv[1:]))
    except ValueError as e:
        print(f"{NAME}: {e}", file=sys.stderr)
        return 1
    return 0
