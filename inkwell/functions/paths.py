"""Columns that a path and the head of a file give: base name, extension, language, family, test mark. All of it native."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions.columns import bind
from inkwell.functions.globs import any_of
from inkwell.functions.languages import OTHER, UNKNOWN, Registry, registry

#: Any component that names a version control directory, and any that is hidden.
VCS = r"(?:\A|/)\.(?:git|hg|svn|jj)(?:/|(?!.|\n))"
HIDDEN = r"(?:\A|/)\.(?!\.?(?:/|(?!.|\n)))"
#: Defaults of the maximal size, in bytes.
MAX_SIZE = 2 << 20


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """What stands behind the base name's last dot; null without one or with a leading one only."""
    base = base_name(path)
    return F.when(base.rlike(r"(?s)\A.+\.[^.]*(?!.|\n)"), F.substring_index(base, ".", -1))


def extension_label(path: Column) -> Column:
    """The lower-cased extension, or the whole base name where there is none."""
    return F.coalesce(F.lower(extension(path)), base_name(path))


def directory(path: Column, depth: int) -> Column:
    """The first ``depth`` components; a path that has no more gives its parent; ``.`` for the root."""
    if depth <= 0:
        return F.lit(".")
    head = F.substring_index(path, "/", depth)
    parent = F.regexp_replace(path, r"(?s)/?[^/]*\z", "")
    group = F.when(head == path, parent).otherwise(head)
    return F.when(group == "", ".").otherwise(group)


def _program(content: Column) -> Column:
    """The lower-cased leading letters of a shebang's program; null where there is none."""
    head = F.substring_index(F.try_validate_utf8(F.substring_index(F.substring(content.cast("binary"), 1, 128).cast("string"), "\n", 1)), "\n", 1)
    last = lambda w: F.element_at(F.split(w, "/"), -1)
    letters = lambda name: F.nullif(F.lower(F.regexp_extract(name, r"\A[A-Za-z]*", 0)), F.lit(""))
    named = lambda words: bind(last(F.get(words, F.lit(0))), lambda first: letters(F.when(first == "env", last(F.get(words, F.lit(1)))).otherwise(first)))
    program = lambda line: F.when(F.startswith(line, F.lit("#!")), bind(F.split(F.trim(F.substring(line, 3, 128)), r"[ \t\f\r]+"), named))
    return bind(head, program)


def _dim(spark, pairs, columns) -> DataFrame:
    """A lookup with a row per entry of the language database; its size is fixed, and so it is broadcast. From Arrow it is a local table."""
    names = [c.split()[0] for c in columns.split(",")]
    rows = pairs or [("", *[None] * (len(names) - 1))]
    kinds = [pa.bool_() if c.split()[1] == "boolean" else pa.string() for c in columns.split(",")]
    return F.broadcast(spark.createDataFrame(pa.table({n: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate(zip(names, kinds, strict=True))})))


def resolve(files: DataFrame, reg: Registry | None = None, shebangs: bool = True, content: str = "content") -> DataFrame:
    """``files`` with language_key, language, family, extension and is_test_file, by path and, where that says nothing, by shebang."""
    reg, spark = reg or registry(), files.sparkSession
    low = F.lower(base_name(F.col("path")))
    ext = F.lower(extension(F.col("path")))
    stems: dict[str, str] = {}
    for key, language in reg.languages.items():
        for stem in (key.lower(), *map(str.lower, language.extensions)):
            stems.setdefault(stem, key)
    out = files.withColumns({"_low": low, "_ext": ext})
    out = out.join(_dim(spark, list(reg.by_filename.items()), "f_name string, f_key string"), F.col("_low") == F.col("f_name"), "left")
    out = out.join(_dim(spark, list(reg.by_extension.items()), "e_name string, e_key string"), F.col("_ext") == F.col("e_name"), "left")
    suffix = F.coalesce(*[F.when(F.endswith("_low", F.lit(s)), F.lit(k)) for s, k in reg.by_suffix], F.lit(None).cast("string"))
    key = F.coalesce("f_key", suffix, "e_key")
    if shebangs and content in files.columns:
        out = out.withColumn("_program", F.when(key.isNull() & F.col("_ext").isNull(), _program(F.col(content))))
        out = out.join(_dim(spark, list(stems.items()), "s_name string, s_key string"), F.col("_program") == F.col("s_name"), "left")
        key = F.coalesce(key, F.col("s_key"))
    out = out.withColumn("language_key", key)
    names = [(k, x.name, x.family, x.detects_tests) for k, x in reg.languages.items()]
    out = out.join(_dim(spark, names, "n_key string, language string, n_family string, detects_tests boolean"), F.col("language_key") == F.col("n_key"), "left")
    out = out.withColumns({"family": F.coalesce("n_family", F.lit(OTHER)), "extension": extension_label(F.col("path")), "is_test_file": path_is_test(F.col("path"), F.col("language_key"), reg)})
    return out.select(*files.columns, "language_key", "language", "family", "extension", "is_test_file")


def path_is_test(path: Column, key: Column, reg: Registry | None = None) -> Column:
    """Whether a path's file is all tests, by the global globs or those of its language."""
    reg = reg or registry()
    own = F.lit(False)
    for k, language in reg.languages.items():
        if language.test_paths:
            own = F.when(key == k, path.rlike(any_of(language.test_paths))).otherwise(own)
    everywhere = any_of(reg.test_paths)
    return (path.rlike(everywhere) if everywhere else F.lit(False)) | F.coalesce(own, F.lit(False))


def visible(path: Column, hidden: bool = False) -> Column:
    """Neither in a version control directory nor, unless asked for, hidden."""
    shown = ~path.rlike(VCS)
    return shown if hidden else shown & ~path.rlike(HIDDEN)


def language_label(language: Column) -> Column:
    return F.coalesce(language, F.lit(UNKNOWN))
