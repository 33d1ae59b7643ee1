"""Reports, change, paths and rendering on small frames."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from inkwell.functions import paths
from inkwell.operators import diff, files, report
from inkwell.operators.files import COUNTERS, Options
from inkwell.plans import render
from inkwell.samples import SAMPLES
from inkwell.sources import tree

ROWS = [
    ("src/main.rs", (10, 2, 3, 0, 0, 0)),
    ("src/lib.rs", (20, 5, 4, 7, 1, 0)),
    ("tests/it.rs", (0, 0, 0, 30, 3, 5)),
    ("web/app.ts", (40, 1, 2, 0, 0, 0)),
]


def made(spark, rows=ROWS):
    frame = spark.createDataFrame([(p, *c) for p, c in rows], "path string, " + ", ".join(f"{c} long" for c in COUNTERS))
    return paths.resolve(frame, shebangs=False)


def six(r):
    return tuple(r[c] for c in COUNTERS)


def keyed(frame, key):
    return {r[key]: six(r) for r in frame.collect()}


def test_grouping(spark):
    r = made(spark)
    assert six(report.totals(r).first()) == (70, 8, 9, 37, 4, 5)
    assert six(report.totals(r.limit(0)).first()) == (0,) * 6
    assert keyed(report.by_language(r), "language") == {"Rust": (30, 7, 7, 37, 4, 5), "TypeScript": (40, 1, 2, 0, 0, 0)}
    assert set(keyed(report.by_family(r), "family")) == {"Systems", "JavaScript"}
    assert set(keyed(report.by_extension(r), "extension")) == {"rs", "ts"}
    assert keyed(report.by_directory(r), "directory")["src"] == (30, 7, 7, 7, 1, 0)
    assert set(keyed(report.by_directory(r, 0), "directory")) == {"."}
    assert set(keyed(report.by_directory(r, 9), "directory")) == {"src", "tests", "web"}
    assert keyed(report.group_by(r, F.substring("path", 1, 1), "k"), "k")["w"] == (40, 1, 2, 0, 0, 0)
    assert [x.path for x in report.sort_by_size(r).collect()] == ["web/app.ts", "tests/it.rs", "src/lib.rs", "src/main.rs"]
    with pytest.raises(ValueError):
        report.rows(r, "nothing")


def test_merging_is_associative_and_keeps_everything(spark):
    a, b, c = made(spark, ROWS[:1]), made(spark, ROWS[1:3]), made(spark, ROWS[2:])
    left, right = report.merge(report.merge(a, b), c), report.merge(a, report.merge(b, c))
    assert sorted(map(tuple, left.collect())) == sorted(map(tuple, right.collect())) and left.count() == 5


def test_roll_up_and_total_follow_the_rows_shown(spark):
    r = made(spark, [*ROWS, ("x.py", (5, 0, 0, 0, 0, 0)), ("x.c", (1, 0, 0, 0, 0, 0))])
    shown = report.finish(report.rows(r), top=3)
    assert [x.label for x in shown.collect()] == ["Rust", "TypeScript", "Python"]
    assert report.total_row(shown).first().impl_code == 75
    rolled = [(x.kind, x.label) for x in report.roll_up(report.finish(report.rows(r))).orderBy("position").collect()]
    assert rolled == [("family", "Systems"), ("member", "Rust"), ("last", "C"), ("family", "JavaScript"), ("last", "TypeScript"), ("family", "Scripting"), ("last", "Python")]
    named = [x.label for x in report.roll_up(report.rows(r), "name").orderBy("position").collect()]
    assert named == ["JavaScript", "TypeScript", "Scripting", "Python", "Systems", "C", "Rust"]


def test_change(spark):
    before, after = made(spark), made(spark, [ROWS[0], ROWS[1], ROWS[2], ("web/app.ts", (40, 1, 2, 0, 0, 0)), ("web/new.ts", (5, 0, 0, 0, 0, 0))])
    assert keyed(diff.diff_by(before, after, report.label("language"), "k"), "k") == {"TypeScript": (5, 0, 0, 0, 0, 0)}
    gone = keyed(diff.diff_by(before, before.limit(0), report.label("language"), "k"), "k")
    assert gone == {"TypeScript": (-40, -1, -2, 0, 0, 0), "Rust": (-30, -7, -7, -37, -4, -5)}
    assert diff.diff_rows(before, before).count() == 0
    empty_file = made(spark, [*ROWS, ("web/empty.ts", (0,) * 6)])
    assert [(r.label, r.files) for r in diff.diff_rows(before, empty_file).collect()] == [("TypeScript", 1)]
    ordered = report.finish(diff.diff_rows(before, made(spark, [("a.py", (10, 0, 0, 0, 0, 0))])), "code")
    assert [r.label for r in ordered.collect()] == ["Rust", "TypeScript", "Python"]


def test_changed_paths(spark):
    side = lambda *rows: spark.createDataFrame(rows, "path string, content_id string")
    before = side(("same", "1"), ("edited", "1"), ("deleted", "1"), ("unknown", None), ("half", "1"))
    after = side(("same", "1"), ("edited", "2"), ("added", "1"), ("unknown", None), ("half", None))
    assert {r.path for r in diff.changed_paths(before, after).collect()} == {"edited", "deleted", "added", "unknown", "half"}


def test_native_lookups_agree_with_the_registry(spark):
    reg = files.registry()
    heads = [b"#!/bin/bash\nx", b"#!/usr/bin/env ruby\n", b"#!/usr/bin/env\n", b"#!/bin/\xff\n", b"", b"#! perl", b"#!/bin/" + b"x" * 140 + b"/bash"]
    listed = ["a.rs", "x/B.PY", "Makefile", "a.blade.php", ".bashrc", "noext", "a.", "d/e.tar.GZ", ".x/y.c"]
    rows = [(p, h) for p in listed for h in heads]
    got = paths.resolve(spark.createDataFrame(rows, "path string, content binary")).collect()
    assert len(got) == len(rows)
    for r in got:
        base = r.path.rsplit("/", 1)[-1]
        key = reg.from_path(r.path) or (reg.from_shebang(bytes(r.content)) if files.registry and paths and __import__("inkwell.functions.languages", fromlist=["x"]).extension(base) is None else None)
        assert r.language_key == key, (r.path, r.content)
        assert r.family == (reg.languages[key].family if key else "Other")


def test_counting_frames(spark):
    rows = [(f"{i}/{s.path}", s.text) for i, s in enumerate(SAMPLES)]
    frame = tree.from_table(spark.createDataFrame(rows, "p string, t string"), F.col("p"), F.col("t"))
    got = {r.path: six(r) for r in files.report(frame).collect()}
    assert got == {f"{i}/{s.path}": s.known for i, s in enumerate(SAMPLES)}
    lines = files.line_view(frame).groupBy("path").count().collect()
    assert {r.path: r["count"] for r in lines} == {p: sum(c) for p, c in got.items()}


def test_selection(spark):
    rows = [("a.rs", "x\n", None), ("b.py", "x\n", None), ("big.rs", "x\n" * 100, None), ("what", "x\n", None), ("bad.rs", None, "denied"), ("bin.rs", "\0", None), (".git/c.rs", "x\n", None), (".h.rs", "x\n", None)]
    frame = spark.createDataFrame(rows, "path string, content string, error string").withColumn("size", F.octet_length("content"))
    seen = lambda **o: {r.path for r in files.report(frame, Options(**o)).collect()}
    assert seen() == {"a.rs", "b.py", "big.rs", ".h.rs"}
    assert seen(max_size=50, hidden=False) == {"a.rs", "b.py"}
    assert seen(include_unknown=True, languages=("Rust",)) == {"a.rs", "big.rs", ".h.rs"}
    assert "what" in seen(include_unknown=True)
    assert [(r.path, r.message) for r in files.errors(frame).collect()] == [("bad.rs", "denied")]
    with pytest.raises(ValueError, match="unknown language"):
        files.report(frame, Options(languages=("nothing",)))


def test_filters_reach_the_scan_and_unused_text_is_not_read(spark, tmp_path):
    spark.createDataFrame([("a.rs", "x")], "path string, content string").write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    plan = files.report(table).select("path")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<path:string>" in plan or "content" in plan
    counted = files.report(table.where("path like 'a%'"))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(path), StringStartsWith(path,a)]" in counted and "ArrowEvalPython" in counted


def test_rendering():
    rows = [{"family": "Systems", "label": "Rust", "kind": "plain", "files": 2, "impl_code": 1000, "impl_comments": 5, "impl_blanks": 0, "test_code": 0, "test_comments": 0, "test_blanks": 0}]
    text = render.table("head", "LANGUAGE", rows)
    assert text.splitlines()[2].split() == ["LANGUAGE", "FILES", "IMPL", "DOC", "TEST", "TOTAL", "DOC%", "TEST%"]
    assert text.splitlines()[4].split() == ["Rust", "2", "1,000", "5", "0", "1,005", "0%", "0%"]
    assert "+1,000" in render.table("head", "LANGUAGE", rows, signed=True) and "\x1b[32m" in render.table("h", "L", rows, True, True)
    assert render.csv("LANGUAGE", [rows[0] | {"label": 'a,"b'}]).splitlines()[1] == 'Systems,"a,""b",2,1000,5,0,0,0,0,1005'
    assert render.csv("FILE", [rows[0] | {"family": None}]).startswith("file,files,")
    value = json.loads(render.json_text("s", "language", rows, diff=False))
    assert value["rows"][0]["impl"] == {"code": 1000, "comments": 5, "blanks": 0} and value["total"]["label"] == "TOTAL" and "family" not in value["total"]
    assert [render.percent(*p) for p in ((1, 8), (3, 8), (0, 0), (-1, 4), (5, 4), (1, 200), (3, 200))] == ["12%", "38%", "—", "—", "—", "0%", "2%"]
    assert [render.number(n, True) for n in (0, 1234, -1234567)] == ["0", "+1,234", "-1,234,567"]


def test_streams(spark, tmp_path):
    from inkwell.streaming import files as streaming

    spark.createDataFrame([(s.path, s.text) for s in SAMPLES], "path string, content string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("path string, content string").parquet(str(tmp_path / "in"))
    query = streaming.running(stream).writeStream.format("memory").queryName("running").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    batch = report.rows(files.report(spark.read.parquet(str(tmp_path / "in"))), families=False)
    assert sorted(map(tuple, spark.table("running").collect()), key=str) == sorted(map(tuple, batch.collect()), key=str)
