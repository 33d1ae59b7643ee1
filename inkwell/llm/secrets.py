"""Secret scanning with an incremental ledger of blobs.

Every text is addressed by the SHA-256 of its bytes. The ledger is a table of (blob, rule_version) pairs already scanned and their
findings; a run scans one representative of each blob that has no entry under the present rules, adds entries for all it scanned,
clean ones included, and joins findings back to every path that holds the blob.

Offsets are code points. Spark has no function that gives the places of all matches, so the text is split at the pattern and the
lengths of the pieces and of the matches are added up.

Defined results: a null text is empty and holds nothing; a text is scanned as a whole however long it is; a null path is a path;
repeated rows each get a row; of the paths of a blob the least stands for it, of its equal rows any; an empty table gives an empty
result and an unchanged ledger; further input columns, whatever their names, are not carried.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm.store import bind, cut

FINDING = "struct<start:int,rank:int,kind:string,end:int>"


@dataclass(frozen=True)
class Pattern:
    """``least`` characters are needed in ``group`` of a match; shorter matches are dropped. ``hint`` must occur in a text that has a match."""

    kind: str
    regex: str
    least: int
    group: int = 0
    hint: str = ""


BASE = (
    Pattern("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2, r"(?i:passw|secret|token|api_?key)"),
    Pattern("access", r"AKIA[A-Z0-9]+", 16),
    Pattern("hex", r"[0-9a-f]+", 32),
)
#: Spans that the method adds: private key headers and prefixed tokens of code hosts.
MORE = (
    Pattern("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 1),
    Pattern("prefixed", r"gh[opsur]_[A-Za-z0-9]+", 40),
)
#: Raised whenever a rule changes, so that old ledger entries no longer count.
VERSION = "rules-1"


def _sift(p: Pattern) -> str:
    """A regex that matches somewhere in every text with a finding of the pattern; cheaper than listing all its matches."""
    return p.hint or {"access": r"AKIA[A-Z0-9]{12}", "hex": r"[0-9a-f]{32}", "prefixed": r"gh[opsur]_[A-Za-z0-9]{36}"}.get(p.kind, p.regex)


def _places(text: Column, p: Pattern, rank: int) -> Column:
    # a maximal run of a class shorter than its least length is dropped and nothing in it can match, so runs may be counted in the regex
    regex = r"(?<![0-9a-f])[0-9a-f]{32,}" if p.kind == "hex" else p.regex
    found = F.struct(F.split(text, regex).alias("gap"), F.regexp_extract_all(text, F.lit(regex), F.lit(0)).alias("whole"), F.regexp_extract_all(text, F.lit(regex), F.lit(p.group)).alias("part"))

    def walk(f: Column) -> Column:
        steps = F.transform(f["whole"], lambda m, i: F.struct(F.length(F.get(f["gap"], i)).alias("gap"), F.length(m).alias("n"), F.length(F.get(f["part"], i)).alias("part")))
        begin = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{FINDING}>").alias("out"))

        def step(a: Column, s: Column) -> Column:
            start = a["at"] + s["gap"]
            one = F.array(F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(p.kind).alias("kind"), (start + s["n"]).alias("end")))
            return F.struct((start + s["n"]).alias("at"), F.when(s["part"] >= p.least, F.concat(a["out"], one)).otherwise(a["out"]).alias("out"))

        return F.aggregate(steps, begin, step)["out"]

    return F.when(text.rlike(_sift(p)), bind(found, walk)).otherwise(F.array().cast(f"array<{FINDING}>"))


def findings(text: Column, patterns=BASE + MORE) -> Column:
    """All findings of a text by start, then by the patterns' order."""
    return F.sort_array(F.concat(*[_places(text, p, i) for i, p in enumerate(patterns)]))


def empty_ledger(spark) -> DataFrame:
    return spark.createDataFrame([], f"blob string, rule_version string, found array<{FINDING}>")


def scan(docs: DataFrame, ledger: DataFrame | None = None, patterns=BASE + MORE, version: str = VERSION, path: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(paths, ledger): ``paths`` has (path, blob, found) for every row of ``docs``; the new ledger is the old one and what was scanned.

    Only digests and paths are shuffled to choose representatives, with partial aggregation first, so a blob that fills a third of
    the rows costs one row per task. Texts of one path each are then joined to their representatives.
    """
    spark = docs.sparkSession
    ledger = ledger if ledger is not None else empty_ledger(spark)
    text = F.coalesce(F.col("text"), F.lit(""))
    held = docs.select(F.col(f"`{path}`").alias("path"), F.sha2(text.cast("binary"), 256).alias("blob"))
    held = cut(held, "secrets-blobs")
    known = ledger.where(F.col("rule_version") == version)
    unseen = held.groupBy("blob").agg(F.min(F.struct(F.col("path").isNull().alias("none"), "path")).alias("r")).join(known.select("blob"), "blob", "left_anti")
    # written before any text is shuffled: where little is unseen, Spark broadcasts it, and the texts stay where they are
    unseen = cut(unseen.select(F.col("blob").alias("u_blob"), F.col("r.path").alias("u_path")), "secrets-unseen")
    texts = docs.select(F.col(f"`{path}`").alias("path"), text.alias("text"))
    one = texts.join(unseen, F.col("path").eqNullSafe(F.col("u_path")) & (F.sha2(F.col("text").cast("binary"), 256) == F.col("u_blob")))
    scanned = one.select(F.col("u_blob").alias("blob"), findings(F.col("text"), patterns).alias("found"))
    # repeated rows of one path hold the blob twice: one entry stays
    entries = scanned.groupBy("blob").agg(F.max("found").alias("found")).select("blob", F.lit(version).alias("rule_version"), "found")
    entries = cut(entries, "secrets-ledger")
    after = ledger.unionByName(entries)
    hits = after.where((F.col("rule_version") == version) & (F.size("found") > 0)).select(F.col("blob").alias("h_blob"), "found")
    joined = held.join(hits, F.col("blob") == F.col("h_blob"), "left")
    paths = joined.select("path", "blob", F.coalesce("found", F.array().cast(f"array<{FINDING}>")).alias("found"))
    return paths, after


def spell(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, found: Column, mask: str = "[secret]") -> Column:
    """The text with every found span, overlapping ones merged, replaced by ``mask``."""

    def joined(spans: Column) -> Column:
        begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

        def step(a: Column, s: Column) -> Column:
            before = F.concat(F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit(mask))
            return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(s["start"] >= a["at"], F.concat(a["out"], F.array(before))).otherwise(a["out"]).alias("out"))

        return bind(F.aggregate(spans, begin, step), lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.length(text))))

    return F.when(F.size(found) > 0, bind(found, joined)).otherwise(text)
