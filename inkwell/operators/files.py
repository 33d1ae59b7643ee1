"""From files to one row of six counters per file.

Filters and lookups are native and come first, so that Spark prunes paths before any text is read into Python. Languages without
strings, blocks or test regions are counted in JVM expressions; the rest go through one Arrow UDF that returns a struct. The UDF gets a
null text for files of the first kind, so their bytes never cross to Python.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions import scanner
from inkwell.functions.columns import bind
from inkwell.functions.globs import Globs
from inkwell.functions.languages import Registry, registry
from inkwell.functions.paths import resolve, visible

COUNTERS = ("impl_code", "impl_comments", "impl_blanks", "test_code", "test_comments", "test_blanks")
_COUNTED = ", ".join(f"{c} bigint" for c in COUNTERS)
BLANKS = " \t\n\x0c\r"


@dataclass(frozen=True)
class Options:
    """What to count. ``languages`` are keys, names or extensions; an unknown one is an error when the plan is made.

    ``max_size`` leaves larger files out where it is given; the command line gives one.
    """

    globs: Globs = Globs()
    languages: tuple[str, ...] | None = None
    include_unknown: bool = False
    max_size: int | None = None
    hidden: bool = True
    shebangs: bool = True
    counting: scanner.Config = scanner.Config()
    registry: Registry = field(default_factory=registry)

    def keys(self) -> list[str] | None:
        if self.languages is None:
            return None
        found = [(name, self.registry.resolve(name)) for name in self.languages]
        if bad := [name for name, key in found if key is None]:
            raise ValueError(f"unknown language: {', '.join(bad)}")
        return [key for _, key in found]


def _lines(content: Column) -> Column:
    """The lines of a text, trimmed; what follows the last line break counts unless empty."""
    whole = lambda x: F.when(F.element_at(x, -1) == "", F.slice(x, F.lit(1), F.size(x) - 1)).otherwise(x)
    return F.transform(bind(F.split(content.cast("string"), "\n", -1), whole), lambda x: F.trim(x, F.lit(BLANKS)))


def is_binary(content: Column) -> Column:
    """Whether the first line holds a NUL."""
    return F.instr(F.substring_index(content.cast("string"), "\n", 1), "\0") > 0


def native_counts(content: Column, markers: Column, test_file: Column) -> Column:
    """Counters of a text in a language that has line comments only; ``markers`` is an array of their openers, empty for none.

    The text is split once, and its lines are visited twice, or once where the language has no comments.
    """

    def counted(lines: Column) -> Column:
        blank = F.size(F.filter(lines, lambda x: x == "")).cast("long")
        comment = F.size(F.filter(lines, lambda x: F.exists(markers, lambda m: F.startswith(x, m)))).cast("long")
        kinds = F.array(F.size(lines).cast("long"), F.when(F.size(markers) > 0, comment).otherwise(F.lit(0).cast("long")), blank)

        def dealt(k: Column) -> Column:
            n, zero = [k[0] - k[1] - k[2], k[1], k[2]], F.lit(0).cast("long")
            values = [F.when(test_file, zero).otherwise(x) for x in n] + [F.when(test_file, x).otherwise(zero) for x in n]
            return F.struct(*[v.alias(c) for v, c in zip(values, COUNTERS, strict=True)])

        return bind(kinds, dealt)

    return bind(_lines(content), counted)


def classifier(reg: Registry, config: scanner.Config):
    """The Arrow UDF (bytes, language key, is test file) -> struct of the counters; null bytes and binary files give nulls.

    It is declared nondeterministic, so that no filter is pushed below it with a second evaluation.
    """
    languages = reg.languages

    @F.pandas_udf(_COUNTED)
    def classify(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        nothing = (None,) * len(COUNTERS)
        for contents, keys, tests in batches:
            rows = [nothing if data is None else scanner.count(bytes(data), languages.get(key), bool(test), config) or nothing for data, key, test in zip(contents, keys, tests, strict=True)]
            yield pd.DataFrame(rows, columns=COUNTERS, dtype="Int64")

    return classify.asNondeterministic()


def selected(files: DataFrame, options: Options) -> DataFrame:
    """The files to be read: by path, size and language, in an order that leaves least to the later tests."""
    kept = files.where(visible(F.col("path"), options.hidden) & options.globs.condition(F.col("path")))
    if options.max_size is not None and "size" in files.columns:
        kept = kept.where(F.col("size").isNull() | (F.col("size") <= options.max_size))
    found = resolve(kept, options.registry, options.shebangs)
    if not options.include_unknown:
        found = found.where(F.col("language_key").isNotNull())
    if (keys := options.keys()) is not None:
        found = found.where(F.col("language_key").isin(keys))
    return found


def counted(files: DataFrame, options: Options | None = None, only_paths: DataFrame | None = None) -> DataFrame:
    """(path, language_key, language, family, extension, is_test_file, six counters, status) of the files that are reported.

    ``files`` has ``path`` and ``content`` (text or bytes), and may have ``size`` and ``error``; a file with an error is a row of status
    ``error`` with its message, a binary one is left out. ``only_paths`` keeps the paths of a frame, by a semi-join below the UDF.
    """
    options = options or Options()
    if only_paths is not None:
        files = files.join(only_paths.select("path"), "path", "left_semi")
    has_error = "error" in files.columns
    found = selected(files, options)
    bare = [k for k, x in options.registry.languages.items() if x.bare]
    lines = {k: options.registry.languages[k].line for k in bare}
    native = F.col("language_key").isNull() | F.col("language_key").isin(bare)
    markers = F.array().cast("array<string>")
    for opener in sorted({v for v in lines.values() if v}):
        keys = [k for k in bare if lines[k] == opener]
        markers = F.when(F.col("language_key").isin(keys), F.array(*map(F.lit, opener))).otherwise(markers)
    text = F.col("content")
    if options.counting.skip_binary:
        # native and below the UDF, so binary files never cross to Python
        found = found.where(~F.coalesce(is_binary(text), F.lit(False)))
    other = classifier(options.registry, options.counting)(F.when(~native, text.cast("binary")), F.col("language_key"), F.col("is_test_file"))
    here = F.when(native, native_counts(text, markers, F.col("is_test_file")))
    out = found.withColumns({"_udf": other, "_native": here}).withColumn("_c", F.coalesce("_native", "_udf"))
    error = F.col("error") if has_error else F.lit(None).cast("string")
    out = out.withColumns({"status": F.when(error.isNotNull(), "error").otherwise("counted"), "message": error})
    return out.select("path", "language_key", "language", "family", "extension", "is_test_file", *[F.coalesce(F.col(f"_c.{c}"), F.lit(0).cast("long")).alias(c) for c in COUNTERS], "status", "message")


def report(files: DataFrame, options: Options | None = None, only_paths: DataFrame | None = None) -> DataFrame:
    """The counted files only."""
    return counted(files, options, only_paths).where("status = 'counted'").drop("status", "message")


def errors(files: DataFrame, options: Options | None = None) -> DataFrame:
    """(path, message) of the files that could not be read."""
    return counted(files, options).where("status = 'error'").select("path", "message")


def line_view(files: DataFrame, options: Options | None = None) -> DataFrame:
    """(path, line_no, kind, is_test): every line with its verdict, for inspection; its counts are those of ``report``."""
    options = options or Options()
    languages, config = options.registry.languages, options.counting

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content, key, test in batch.itertuples(index=False):
                data = bytes(content)
                if config.skip_binary and scanner.is_binary(data):
                    continue
                rows += [(path, no, kind, is_test) for no, (kind, is_test) in enumerate(scanner.classify(data, languages.get(key), bool(test), config), 1)]
            yield pd.DataFrame(rows, columns=["path", "line_no", "kind", "is_test"])

    chosen = selected(files, options).select("path", F.coalesce(F.col("content").cast("binary"), F.lit(b"")).alias("content"), "language_key", "is_test_file")
    return chosen.mapInPandas(run, "path string, line_no long, kind string, is_test boolean")
