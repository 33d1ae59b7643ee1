"""Registered queries over the driver's tables, one or more for each operator, with SQL for both engines where a source is made by SQL.

``events`` gives files whose lines are classified already, ``part`` gives synthesized sources of known counts, ``documents``,
``conversations`` and ``pages`` give texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell import demo
from inkwell.functions import paths
from inkwell.functions.globs import Globs
from inkwell.functions.languages import Registry, registry
from inkwell.functions.scanner import Config
from inkwell.operators import diff, files, report
from inkwell.operators.files import COUNTERS
from inkwell.plans import cli, refs, render
from inkwell.samples import SAMPLES
from inkwell.sources import tree
from inkwell.sources.ignore import IgnoreRules, masked

Query = Callable[[SparkSession, str], DataFrame]

#: A line's file, kind and place, in SQL that Spark and DuckDB read alike. Early and late lines make two snapshots.
EVENT_PATH = """concat('src', cast(user_id % 7 AS STRING), '/', CASE user_id % 4 WHEN 0 THEN 'tests/' WHEN 1 THEN 'lib/' ELSE '' END, 'f', cast(user_id AS STRING),
  CASE user_id % 6 WHEN 0 THEN '.rs' WHEN 1 THEN '.py' WHEN 2 THEN '.ts' WHEN 3 THEN '.md' WHEN 4 THEN '.unknown' ELSE '' END)"""
BEFORE, AFTER = "hour(ts) < 18", "hour(ts) >= 4"
_IS_TEST = "(user_id % 4 = 0 OR event_id % 5 = 0)"
EVENT_COUNTS = {
    f"{side}_{kind}": f"cast(sum(CASE WHEN event_id % 3 = {k} AND {test}{_IS_TEST} THEN 1 ELSE 0 END) AS BIGINT)"
    for side, test in (("impl", "NOT "), ("test", ""))
    for k, kind in enumerate(("code", "comments", "blanks"))
}


def event_files_sql(where: str = "true") -> str:
    counts = ", ".join(f"{e} AS {c}" for c, e in EVENT_COUNTS.items())
    return f"SELECT {EVENT_PATH} AS path, {counts} FROM events WHERE {where} GROUP BY 1"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_report(spark: SparkSession, sf_dir: str, where: str = "true") -> DataFrame:
    """A file report whose lines come classified; languages, families and labels are resolved from paths."""
    rows = _table(spark, sf_dir, "events").where(where).select(F.expr(EVENT_PATH).alias("path"), "user_id", "event_id")
    return paths.resolve(rows.groupBy("path").agg(*[F.expr(e).alias(c) for c, e in EVENT_COUNTS.items()]), shebangs=False)


def _documents(spark: SparkSession, sf_dir: str, ending: str = "") -> DataFrame:
    path = F.concat_ws("/", "lang", "source", F.concat(F.col("doc_id").cast("string"), F.lit(ending)))
    return tree.from_table(_table(spark, sf_dir, "documents"), path, F.coalesce("text", F.lit("")))


def _conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = F.when(F.col("role") == "user", "tests").otherwise("src")
    path = F.concat_ws("/", folder, F.concat(F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string"), F.lit(".txt")))
    return tree.from_table(_table(spark, sf_dir, "conversations"), path, F.coalesce("text", F.lit("")))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.from_table(_table(spark, sf_dir, "pages"), F.concat(F.lit("site/"), F.col("page_id").cast("string"), F.lit(".html")), F.coalesce("html", F.lit("")))


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file per part: a sample behind as many plain lines as the part's size."""
    made = spark.createDataFrame([(i, s.path, s.text) for i, s in enumerate(SAMPLES)], "no int, sample_path string, sample string")
    rows = _table(spark, sf_dir, "part").withColumn("pick", (F.col("p_partkey") % len(SAMPLES)).cast("int")).join(F.broadcast(made), F.col("pick") == F.col("no"))
    folder = F.element_at(F.split("sample_path", "/"), 1)
    path = F.concat_ws("/", folder, F.col("p_partkey").cast("string"), F.element_at(F.split("sample_path", "/"), -1))
    return tree.from_table(rows, path, F.concat(F.repeat(F.lit("a = 1\n"), F.col("p_size")), F.col("sample")))


KEEP_ALL = files.Options(include_unknown=True)


# -- counting ----------------------------------------------------------------------------------------------------------------
def lines_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files without a language: lines are blank or code."""
    return files.report(_documents(spark, sf_dir), KEEP_ALL).select("path", "language", "family", "extension", *COUNTERS)


def prose_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as text files, by two levels of directories."""
    return report.by_directory(files.report(_documents(spark, sf_dir, ".txt")), 2)


def turns_by_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns; a path below ``tests`` is all tests."""
    return report.rows(files.report(_conversations(spark, sf_dir)), "directory")


def pages_as_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.rows(files.report(_pages(spark, sf_dir)), "language")


def classify_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.report(_sources(spark, sf_dir)).select("path", "language_key", "is_test_file", *COUNTERS)


def sources_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.rows(files.report(_sources(spark, sf_dir)), "language")


def sources_without_test_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole-file tests only; every other line is production code."""
    return report.totals(files.report(_sources(spark, sf_dir), files.Options(counting=Config(test_blocks=False))))


def docs_as_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.by_extension(files.report(_sources(spark, sf_dir), files.Options(counting=Config(docs_as_comments=False))))


def line_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line with its verdict, grouped; equal to the counters."""
    lines = files.line_view(_sources(spark, sf_dir))
    return lines.groupBy("kind", "is_test").agg(F.count("*").alias("n"))


def binary_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A NUL in the first line makes a file binary; one in a later line does not."""
    first, later = F.concat(F.lit("a\0b\n"), F.col("p_name")), F.concat(F.col("p_name"), F.lit("\nb\0"))
    text = F.when(F.col("p_size") % 3 == 0, first).when(F.col("p_size") % 3 == 1, later).otherwise(F.col("p_name"))
    made = tree.from_table(_table(spark, sf_dir, "part"), F.concat(F.col("p_partkey").cast("string"), F.lit(".yaml")), text)
    return files.report(made).select("path", *COUNTERS)


# -- selection ---------------------------------------------------------------------------------------------------------------
def include_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    globs = Globs(("src[0-3]/", "*.md"), ("**/lib/**", "f?.py"))
    return event_report(spark, sf_dir).where(globs.condition(F.col("path"))).select("path")


def hidden_and_vcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = F.element_at(F.array(*map(F.lit, (".git", "a/.hg/b", ".hid", "a.b", ".gitx", "x/.."))), (F.col("s_suppkey") % 6 + 1).cast("int"))
    rows = _table(spark, sf_dir, "supplier").select(F.concat(folder, F.lit("/f"), F.col("s_suppkey").cast("string")).alias("path"))
    return rows.select("path", paths.visible(F.col("path")).alias("shown"), paths.visible(F.col("path"), True).alias("shown_hidden"))


def max_file_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.totals(files.report(_documents(spark, sf_dir, ".txt"), files.Options(max_size=2000)))


def only_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.report(_sources(spark, sf_dir), files.Options(languages=("rust", "py"), include_unknown=True)).groupBy("language").agg(F.count("*").alias("n"))


def ignored_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ignore files inside a tree hide some of its files; a deeper file wins over one above it."""
    rules = [(".ignore", "*.md\nsrc1/\n/src2/lib\n!keep.md\n"), ("src3/.ignore", "!*.md\n*.ts\n")]
    own = spark.createDataFrame(rules, "path string, content string")
    listed = event_report(spark, sf_dir).select("path", F.lit("").alias("content")).unionByName(own)
    return masked(listed, IgnoreRules(hidden=True)).select("path")


def only_changed_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counting restricted to changed files, below the classifier."""
    docs = _documents(spark, sf_dir, ".txt")
    changed = F.regexp_replace("content", "the", "THE\n")
    before, after = (d.withColumn("content_id", diff.content_id(F.col("content"))) for d in (docs, docs.withColumn("content", changed)))
    return report.totals(files.report(after, only_paths=diff.changed_paths(before, after)))


# -- languages ---------------------------------------------------------------------------------------------------------------
def language_of_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extensions, file names, suffixes and families of synthesized paths."""
    names = ("a.RS", "b.py", "Makefile", "x.blade.php", "y.php", "dockerfile", ".bashrc", "c.tar.GZ", "noext", "d.Tsx", "CMakeLists.txt", "e.")
    name = F.element_at(F.array(*map(F.lit, names)), (F.col("p_partkey") % len(names) + 1).cast("int"))
    rows = _table(spark, sf_dir, "part").select(F.concat(F.lit("d"), F.col("p_partkey").cast("string"), F.lit("/"), name).alias("path"))
    return paths.resolve(rows).select("path", "language_key", "language", "family", "extension", "is_test_file")


def language_of_shebang(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = ("#!/bin/bash\n", "#!/usr/bin/env ruby -w\n", "#!/usr/bin/python3.12\n", "#! /usr/bin/env  perl\n", "#!/bin/unheard\n", "no", "#!\n", "")
    head = F.element_at(F.array(*map(F.lit, heads)), (F.col("s_suppkey") % len(heads) + 1).cast("int"))
    rows = _table(spark, sf_dir, "supplier").select(F.concat(F.lit("bin/"), F.col("s_suppkey").cast("string")).alias("path"), F.concat(head, F.lit("x")).alias("content"))
    return paths.resolve(rows).select("path", "language_key", "family")


def test_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("src/a.rs", "tests/a.rs", "x/test_a.py", "a_test.go", "x/a.test.ts", "spec/a", "src/Test.java", "benches/a.rs", "a.snap", "src/a_test.py.txt", "fixtures/x.md")
    name = F.element_at(F.array(*map(F.lit, names)), (F.col("s_suppkey") % len(names) + 1).cast("int"))
    rows = _table(spark, sf_dir, "supplier").select(F.concat(F.lit("r"), F.col("s_suppkey").cast("string"), F.lit("/"), name).alias("path"))
    return paths.resolve(rows).select("path", "is_test_file")


def languages_and_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    reg = registry()
    rows = [(f, reg.languages[k].name) for f, keys in reg.families.items() for k in keys]
    return spark.createDataFrame(rows, "family string, name string").groupBy("family").agg(F.array_join(F.sort_array(F.collect_list("name")), ", ").alias("members"))


# -- reports -----------------------------------------------------------------------------------------------------------------
def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.totals(event_report(spark, sf_dir))


def by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.by_language(event_report(spark, sf_dir))


def by_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.by_family(event_report(spark, sf_dir))


def by_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.by_extension(event_report(spark, sf_dir))


def by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.by_path(event_report(spark, sf_dir))


def by_directory_0(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.by_directory(event_report(spark, sf_dir), 0)


def by_directory_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.by_directory(event_report(spark, sf_dir), 1)


def by_directory_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.by_directory(event_report(spark, sf_dir), 2)


def by_any_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.group_by(event_report(spark, sf_dir), F.length("path").cast("long"), "path_length")


def rows_with_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.rows(event_report(spark, sf_dir))


def family_roll_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.roll_up(report.finish(report.rows(event_report(spark, sf_dir))))


def ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, code = F.col("impl_comments") + F.col("test_comments"), F.col("impl_code") + F.col("test_code")
    grouped = report.by_language(event_report(spark, sf_dir))
    return grouped.select("language", report.test_ratio().alias("test_ratio"), report.share(docs, report.lines()).alias("doc_share"), report.percent(F.col("test_code"), code).alias("test_percent"))


def merged_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two snapshots one after another, nothing dropped."""
    return report.totals(report.merge(event_report(spark, sf_dir, BEFORE), event_report(spark, sf_dir, AFTER)))


def _sorted(sort: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = report.rows(event_report(spark, sf_dir), "file")
        place = F.row_number().over(Window.orderBy(*report.order(sort))).cast("long")
        return report.finish(rows, sort).select(place.alias("place"), "label", "files", *COUNTERS)

    query.__name__ = f"sort_{sort}"
    return query


def top_then_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The total is that of the rows shown."""
    return report.with_total(report.finish(report.rows(event_report(spark, sf_dir), "directory", 2), "lines", 5)).drop("family")


def largest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.sort_by_size(event_report(spark, sf_dir)).limit(10).select("path", report.lines().alias("lines"))


# -- change ------------------------------------------------------------------------------------------------------------------
def changed_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = (event_report(spark, sf_dir, w).select("path", F.when(F.col("path").endswith(".md"), None).otherwise(F.concat_ws("-", *COUNTERS)).alias("content_id")) for w in (BEFORE, AFTER))
    return diff.changed_paths(*sides)


def diff_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.diff_by(event_report(spark, sf_dir, BEFORE), event_report(spark, sf_dir, AFTER), report.label("language"), "language")


def diff_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.diff_rows(event_report(spark, sf_dir, BEFORE), event_report(spark, sf_dir, AFTER), "directory", 2).drop("family")


def diff_with_itself(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = event_report(spark, sf_dir)
    return diff.diff_rows(both, both, "file").drop("family")


def diff_against_nothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All files gone: every count negative."""
    both = event_report(spark, sf_dir)
    return diff.diff_rows(both, both.where(F.lit(False)), "family").drop("family")


# -- output ------------------------------------------------------------------------------------------------------------------
def csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.csv_rows(report.rows(event_report(spark, sf_dir)))


def json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.json_rows(report.rows(event_report(spark, sf_dir), "extension"))


# -- trees -------------------------------------------------------------------------------------------------------------------
def tree_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A directory's files by all rules of its ignore files."""
    return tree.directory(spark, demo.repository(spark)).select("path", "size")


def tree_files_unignored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without ignore files, hidden files among them; version control directories stay out."""
    return tree.directory(spark, demo.repository(spark), ignore=False, hidden=True).select("path")


def tree_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.rows(files.report(tree.directory(spark, demo.repository(spark))))


def tree_below(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A subdirectory, with the rules of the directories above it."""
    return tree.directory(spark, demo.repository(spark), subdir="conf").select("path")


def revision_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A revision's files; ``.gitignore`` says nothing about what is committed, and git's ids are those of the contents."""
    held = tree.revision(spark, demo.repository(spark), "topic")
    return held.select("path", F.octet_length("content").cast("long").alias("size"), (F.col("content_id") == diff.content_id(F.col("content"))).alias("same_id"))


def revision_subdirectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.revision(spark, demo.repository(spark), "main", subdir="src", hidden=True).select("path")


def merge_base_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From where two branches part to one of them, by file; equal files are not counted."""
    root = demo.repository(spark)
    sides = [tree.revision(spark, root, r) for r in (tree.merge_base(root, "main", "topic"), "topic")]
    changed = diff.changed_paths(*sides)
    return diff.diff_rows(*(files.report(s, only_paths=changed) for s in sides), "file").drop("family")


def nothing_to_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source that is absent: totals of nothing."""
    return report.totals(files.report(tree.empty(spark)))


def unreadable_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file that cannot be read is a row with its message, and no report's."""
    path, bad = F.concat(F.col("p_partkey").cast("string"), F.lit(".yaml")), F.col("p_size") % 5 == 0
    made = tree.from_table(_table(spark, sf_dir, "part"), path, F.when(~bad, F.lit("a: 1\n"))).withColumn("error", F.when(F.col("content").isNull(), "denied"))
    return files.errors(made).unionByName(files.report(made).select("path", F.lit("counted").alias("message")))


def refs_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for text in ("src", "git:HEAD~1", "git:a:b", "git-merge:main:topic", "git-merge:a:b:c", "git:", "git-merge:a", "git-merge::b", ""):
        try:
            ref = refs.Ref.parse(text)
            rows.append((text, ref.kind, str(ref)))
        except ValueError:
            rows.append((text, "error", None))
    return spark.createDataFrame(rows, "ref string, kind string, spelled string")


def default_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is compared when nothing is named, and what the repository says of itself."""
    root = demo.repository(spark)
    found, note = refs.default_refs(root)
    facts = {"default": refs.default_branch(root), "head": refs.head_branch(root), "dirty": str(refs.is_dirty(root)), "on main": str(refs.on_branch(root, "main")), "refs": " ".join("tree" if r.kind == "path" else str(r) for r in found), "note": note}
    return spark.createDataFrame(list(facts.items()), "fact string, value string")


def subdirectories_tidied(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = (".", "./", "./src/", "/src//", "a\\b", " src ")
    return spark.createDataFrame([(t, refs.tidy_subdir(t)) for t in given], "given string, tidy string")


def _printed(spark: SparkSession, *args: str) -> str:
    return cli.run(spark, [*args, "-C", demo.repository(spark), "--color", "never"])


def _numbered(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(text.splitlines())), "line_no long, line string")


def command_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of a printed table, families above their languages."""
    return _numbered(spark, _printed(spark, "git:main"))


def command_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of a printed change between two revisions, each file with its partner."""
    return _numbered(spark, _printed(spark, "git:main", "git:topic", "--files"))


def command_subdirectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A subdirectory that one side lacks counts as empty there."""
    return _numbered(spark, _printed(spark, "git:main", "git:topic", "--in", "docs", "--format", "csv"))


def command_colored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbered(spark, cli.run(spark, ["git:main", "-C", demo.repository(spark), "--color", "always", "--by", "extension", "-n", "2"]))


def registry_overlaid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages after an overlay changed one and added another; families by any spelling; which languages know tests."""
    built = Registry.build({"languages": {"Rust": {"ext": "rs,rsx"}, "Toy": {"line": "%%", "ext": "toy", "test_blocks": ("test",)}}}, {"Systems": ("Rust", "C")})
    rows = [(k, x.name, ",".join(x.extensions), x.family, x.detects_tests, built.resolve_family(x.family.upper())) for k in ("Rust", "C", "Toy", "Json") for x in [built.languages[k]]]
    return spark.createDataFrame(rows, "key string, name string, extensions string, family string, detects_tests boolean, resolved string")


ALL: tuple[Query, ...] = (
    lines_of_documents, prose_by_source, turns_by_directory, pages_as_html, classify_sources, sources_by_language, sources_without_test_blocks, docs_as_code, line_kinds, binary_files,
    include_exclude, hidden_and_vcs, max_file_size, only_languages, ignored_files, only_changed_paths,
    language_of_path, language_of_shebang, test_paths, languages_and_families,
    totals, by_language, by_family, by_extension, by_path, by_directory_0, by_directory_1, by_directory_2, by_any_key, rows_with_files, family_roll_up, ratios, merged_reports,
    *map(_sorted, report.SORTS), top_then_total, largest_files,
    changed_paths, diff_by_language, diff_rows, diff_with_itself, diff_against_nothing, csv_rows, json_rows,
    tree_files, tree_files_unignored, tree_report, tree_below, revision_files, revision_subdirectory, merge_base_change, nothing_to_count, unreadable_files,
    refs_parsed, default_sources, subdirectories_tidied, command_table, command_change, command_subdirectory, command_colored, registry_overlaid,
)


def queries() -> dict[str, Query]:
    return {q.__name__: q for q in ALL}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All text tables as one tree: counted, by language, largest first."""
    both = _documents(spark, sf_dir, ".txt").unionByName(_conversations(spark, sf_dir)).unionByName(_pages(spark, sf_dir)).unionByName(_sources(spark, sf_dir))
    return report.finish(report.rows(files.report(both)))
