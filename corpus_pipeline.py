"""A corpus pipeline over ``documents``: quality, near copies, benchmark passages, secrets, token ids.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns a frame, which is written as Parquet
and read again as the next one's ``docs``. All but the last return the columns of ``documents``; ``n_chars`` follows a changed text.

Defined results, of every stage: an empty table gives an empty one; further columns are carried under whatever names, the last stage
excepted; texts are read as a whole, however long. Rows that share an id stay or go together, and each gets its own text's changes. What
nulls, empty texts and ties give is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm import decontam, jaccard, pieces, quality, secrets
from inkwell.llm.queries import MODEL, table
from inkwell.llm.store import sweep


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id is in ``ids.id``; a null id meets a null id."""
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["id"]), "left_semi")


def _recounted(joined: DataFrame, docs: DataFrame, text: Column) -> DataFrame:
    """The columns of ``docs`` out of ``joined`` with a new text, and its length as ``n_chars`` where it changed."""
    count = F.when(text.eqNullSafe(docs["text"]), docs["n_chars"]).otherwise(F.length(text).cast("long")) if "n_chars" in docs.columns else None
    new = {"text": text, "n_chars": count}
    return joined.select(*[new[c].alias(c) if c in new else docs[f"`{c}`"] for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go.

    Null and blank texts have no words and go; a null language or source is a group of its own; a null id meets a null id, and stays if
    any row without an id is sound.
    """
    judged = quality.judge(docs.select("doc_id", "lang", "source", "text"), label="pipeline-quality")
    return _only(docs, judged.where("kept").select(F.col("doc_id").alias("id")).distinct())


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays.

    Texts without words are linked with nothing and stay; rows without an id are no document's copy and stay; ties cannot occur, as an
    id is a document.
    """
    found = jaccard.join(docs.select("doc_id", "text"))
    return _only(docs, found.where("component_id is null or component_id = doc_id").select(F.col("doc_id").alias("id")).distinct())


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; the rest of the document stays.

    Null and empty texts hold none; of overlapping passages all covered characters go; an empty benchmark changes nothing.
    """
    before = "before"
    while before.lower() in {c.lower() for c in docs.columns}:
        before += "_"
    cleaned = decontam.clean(docs.withColumn(before, F.col("text")), table(spark, sf_dir, "benchmark"))
    if "n_chars" in docs.columns:
        changed = ~F.col("text").eqNullSafe(F.col(before))
        cleaned = cleaned.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return cleaned.select(*[F.col(f"`{c}`") for c in docs.columns])


def secret_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mask.

    Null and empty texts hold none; overlapping secrets give one mask; equal texts are scanned once and masked alike.
    """
    paths, _ = secrets.scan(docs.select("doc_id", "text"))
    hits = paths.where(F.size("found") > 0).select(F.col("path").alias("h_path"), F.col("blob").alias("h_blob"), "found").dropDuplicates(["h_path", "h_blob"])
    blob = F.sha2(F.coalesce(docs["text"], F.lit("")).cast("binary"), 256)
    joined = docs.join(hits, docs["doc_id"].eqNullSafe(hits["h_path"]) & (blob == hits["h_blob"]), "left")
    text = F.when(hits["found"].isNotNull(), secrets.redact(docs["text"], hits["found"])).otherwise(docs["text"])
    return _recounted(joined, docs, text)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text, and whether decoding gives it back.

    A null text has null ids, an empty one no ids; the model's own blank mark comes back as a blank, and such a text is not the same.
    """
    proto = pieces.read_model(MODEL)
    back = pieces.encode(docs.select("doc_id", "lang", "source", "text"), proto, back="decoded")
    return back.select("doc_id", "lang", "source", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_ids"), "ids", F.col("decoded").eqNullSafe(F.col("text")).alias("same"))


STAGES = [("quality rules", quality_rules), ("n-gram Jaccard join", near_copies), ("benchmark decontamination", benchmark_passages), ("secret scans", secret_spans), ("SentencePiece encoding and decoding", token_ids)]

#: SQL has no BPE encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; a stage's own tables go when its result is written."""
    docs = table(spark, sf_dir, "documents")
    for no, (_, stage) in enumerate(STAGES[:-1]):
        with sweep() as keep:
            docs = keep(stage(spark, docs, sf_dir), f"pipeline-{no}")
    return STAGES[-1][1](spark, docs, sf_dir)
