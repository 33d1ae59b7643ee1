"""The registry, its lookups, globs and ignore files."""

from __future__ import annotations

import pytest

from inkwell.functions import globs
from inkwell.functions.globs import Globs, IgnoreFile
from inkwell.functions.languages import FAMILIES, Registry, extension, merged, registry

REG = registry()


@pytest.mark.parametrize(
    "path,key",
    [("a.rs", "Rust"), ("x/b.PY", "Python"), ("Makefile", "Makefile"), ("d/DOCKERFILE", "Dockerfile"), ("a.blade.php", "Blade"), ("a.php", "Php"), ("CMakeLists.txt", "CMake"), ("a.tsx", "Tsx"), (".rs", None), ("rs", None), ("a.nothing", None), ("a.go", "Go"), ("n.hex0", "Hex0")],
)
def test_from_path(path, key):
    assert REG.from_path(path) == key


@pytest.mark.parametrize(
    "head,key",
    [(b"#!/bin/bash\n", "Bash"), (b"#!/usr/bin/env python3 -u", "Python"), (b"#!/usr/bin/env ruby", "Ruby"), (b"#! /usr/bin/perl5.8", "Perl"), (b"#!/bin/unheard", None), (b"#!", None), (b"", None), (b"x", None), (b"#!/bin/\xff", None), (b"#!/usr/bin/env", None), (b"#!/bin/" + b"x" * 130 + b"/bash", None)],
)
def test_from_shebang(head, key):
    assert REG.from_shebang(head) == key


def test_resolve():
    assert [REG.resolve(n) for n in ("c++", "RUST", "py", "Jsx", "nothing")] == ["Cpp", "Rust", "Python", "Jsx", None]
    assert REG.resolve_family("systems") == "Systems" and REG.resolve_family("none") is None


def test_facts():
    rust, python = REG.languages["Rust"], REG.languages["Python"]
    assert rust.line == ("//",) and rust.block == (("/*", "*/"),) and rust.nested and ('"', '"') in rust.quotes and ('r#"', '"#') in rust.verbatim and rust.extensions == ("rs",)
    assert python.line == ("#",) and not python.nested and len(python.doc) == 2 and python.indent_style
    assert REG.languages["Cpp"].name == "C++" and REG.languages["Tsx"].name == "TSX" and REG.languages["Markdown"].literate
    assert ("/+", "+/") in REG.languages["D"].inner and not REG.languages["C"].nested and not REG.languages["Css"].detects_tests
    assert REG.languages["Hex0"].family == "Other" and REG.languages["Zig"].test_blocks and not REG.languages["Zig"].test_paths
    assert all("\n" not in d for x in REG.languages.values() for p in (*x.comments, *x.quotes, *x.doc, *x.verbatim) for d in p)
    assert all(d for x in REG.languages.values() for p in (*x.comments, *x.quotes, *x.doc, *x.verbatim) for d in p)


def test_families():
    keys = [k for f in FAMILIES.values() for k in f]
    assert len(FAMILIES) == 13 and len(keys) == len(set(keys)) == 232 and all(REG.languages[k].family != "Other" for k in keys)
    with pytest.raises(ValueError, match="unknown language"):
        Registry.build(families={"A": "Nothing"})
    with pytest.raises(ValueError, match="is in the families"):
        Registry.build(families={"A": "Rust", "B": "Rust"})


def test_overlay_merges_by_key():
    assert merged({"a": {"b": 1, "c": [1]}, "d": 2}, {"a": {"c": [2]}, "e": 3}) == {"a": {"b": 1, "c": [2]}, "d": 2, "e": 3}
    own = Registry.build({"languages": {"Rust": {"test_blocks": ("#[mine]",)}, "Mine": {"line": "!!", "ext": "mine"}}, "global": {"test_paths": ["**/mine/**"]}})
    assert own.languages["Rust"].test_blocks == ("#[mine]",) and own.languages["Rust"].nested
    assert own.from_path("a.mine") == "Mine" and own.test_paths == ("**/mine/**",)


def test_extension():
    assert [extension(b) for b in ("a.b", "a.tar.GZ", ".bashrc", "a", "a.", "..x")] == ["b", "GZ", None, None, "", "x"]


@pytest.mark.parametrize(
    "include,exclude,path,kept",
    [
        ((), (), "a", True), (("*.rs",), (), "x/y.rs", True), (("*.rs",), (), "y.py", False), (("src/",), (), "src/a/b", True), (("src/",), (), "x/src/a", True), (("/src/**",), (), "a", False),
        ((), ("*.rs",), "x/a.rs", False), (("*.rs",), ("x/**",), "x/a.rs", False), ((" ",), (), "a", True), (("a?c",), (), "abc", True), (("[!a]x",), (), "bx", True), (("[!a]x",), (), "ax", False),
        (("{a,b}.c",), (), "b.c", True), (("src/*.rs",), (), "src/x/y.rs", True), (("**/t/**",), (), "t/a", True), (("a.b",), (), "aXb", False), (("a$",), (), "a$", True), (("*.rs",), (), "a.rs\n", False),
    ],
)
def test_globs(include, exclude, path, kept):
    assert Globs(include, exclude).keeps(path) is kept


def test_globs_in_spark_are_the_same(spark):
    from pyspark.sql import functions as F

    paths = ["a", "x/y.rs", "src/a/b", "x/src/a", "b.c", "a$", "a.rs\n", "t/a", "日/ü.rs", ""]
    frame = spark.createDataFrame([(p,) for p in paths], "path string")
    for g in (Globs(("*.rs", "src/"), ("x/**",)), Globs(("{a,b}*",)), Globs((), ("?",)), Globs(("[a-t]/*",))):
        assert [r.k for r in frame.select(g.condition(F.col("path")).alias("k")).collect()] == [g.keeps(p) for p in paths]


@pytest.mark.parametrize("bad", ["[a", "{a,b"])
def test_malformed_globs(bad):
    with pytest.raises(ValueError):
        globs.any_of([bad])


@pytest.mark.parametrize(
    "rules,path,is_dir,verdict",
    [
        ("*.o", "a/b.o", False, True), ("/a", "a", False, True), ("/a", "b/a", False, None), ("a/", "a", False, None), ("a/", "a", True, True), ("a/b", "a/b", False, True), ("a/b", "x/a/b", False, None),
        ("*.o\n!b.o", "b.o", False, False), ("!b.o\n*.o", "b.o", False, True), ("# x", "# x", False, None), ("\\#x", "#x", False, True), ("a  ", "a", False, True), ("**/c", "x/y/c", False, True), ("x/**", "x/y/z", False, True), ("*", "a/b", False, True), ("a*/b", "ax/y/b", False, None), ("", "a", False, None),
    ],
)
def test_ignore_files(rules, path, is_dir, verdict):
    assert IgnoreFile(rules).verdict(path, is_dir) is verdict


def test_ignore_by_parents():
    assert IgnoreFile("build/").verdict_with_parents("build/a/b") is True
    assert IgnoreFile("build/\n!b").verdict_with_parents("build/a/b") is False
    with pytest.raises(ValueError, match="there: malformed"):
        IgnoreFile("[a", "there")
