"""Removal of repeated runs of sentences.

A sentence ends after a full stop, exclamation or question mark and the blank behind it, after such a mark of scripts without blanks,
after a line break, or with the text; blank stretches are no sentences. A sentence of more than ``LONG`` words is cut behind each word
that ``pieces`` picks by its first letter and length, about three in sixteen: places that its words alone decide, so a passage inside a
long sentence is cut alike wherever it stands. A word ends with a blank; a character of scripts without blanks is a word. Every run of ``SIZE``
sentences in a row is hashed over its trimmed sentences. The first of equal runs is the one with the least (doc_id, place); sentences
that any other of them covers are removed, and the rest of the text stays as it is.

Hashes are 96 bits, so no two different runs of a corpus of a hundred terabytes are likely to meet. First places are found by a
grouping with partial aggregation, so a run that a third of all documents hold costs one row per task; only runs that occur twice go
on to the second join, whose hot keys Spark splits. Texts are cut in Arrow batches: in JVM expressions, which call a function a word,
the same cost twice the CPU time.

Defined results: a null text has no sentences and stays null; a null id counts as the largest; rows that share id and text each keep
the first run; sentences go from the row they were found in, known by its id and a hash of its text; a text shorter than a run stays;
a text is cut as a whole however long it is; an empty table gives an empty result; other columns are carried unless they have the
name of a result column, which then wins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm import counts
from inkwell.llm.store import cut, write

#: Sentences in a run.
SIZE = 3
#: Words in a sentence that is not cut.
LONG = 16
SENTENCE = r"(?s).+?(?:[.!?][ \t\r\n]|[\x{3002}\x{FF01}\x{FF1F}\x{0964}]|\n|\z)"
WORD = r"(?s)[\x{2E80}-\x{FFFF}]|[^ \x{2E80}-\x{FFFF}]+ ?| "
BLANK = " \t\r\n"
PLACE = 1 << 32
ODD = np.uint64(0x9E3779B97F4A7C15)

#: ``SENTENCE`` and ``WORD`` for Python; the first skips over whole classes of characters where the other tries each place.
_sentence = re.compile("(?s).[^.!?\n\u3002\uff01\uff1f\u0964]*+(?:[.!?](?![ \t\r\n])[^.!?\n\u3002\uff01\uff1f\u0964]*+)*+(?:[.!?][ \t\r\n]|[\u3002\uff01\uff1f\u0964]|\n|\\Z)")
_word = re.compile("(?s)[\u2e80-\uffff]|[^ \u2e80-\uffff]+ ?| ")
_unspaced = re.compile("[\u2e80-\uffff]")


def pieces(text: str | None) -> list[str]:
    """The text cut into stretches that hold one sentence or blanks; together they are the text."""
    out: list[str] = []
    for sentence in _sentence.findall(text or ""):
        # each word is a character at least
        if len(sentence) <= LONG:
            out.append(sentence)
            continue
        if _unspaced.search(sentence):
            words, blank = _word.findall(sentence), ""
            n = len(words)
            ends = [k for k, w in enumerate(words, 1) if (ord(w[0]) * 5 + len(w) * 11) & 15 < 3]
        else:
            # a blank belongs to the word before it; one at the end leaves an empty word, which is none
            words, blank = sentence.split(" "), " "
            n = len(words) - (words[-1] == "")
            ends = [k for k, w in enumerate(words, 1) if ((ord(w[0]) * 5 if w else 0) + len(w) * 11 + 11) & 15 < 3] if n > LONG else []
        if n <= LONG:
            out.append(sentence)
            continue
        at = 0
        for k in ends:
            if k < n:
                out.append(blank.join(words[at:k]) + blank)
                at = k
        out.append(blank.join(words[at:]))
    return out


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _runs(texts: list[str | None], size: int) -> tuple[np.ndarray, pa.ListArray]:
    """(numbers of sentences, runs) of each text: two hashes of each run, in the order of their first sentences."""
    digests, n = [], []
    for text in texts:
        solid = [s for p in pieces(text) if (s := p.strip(BLANK))]
        digests += map(xxhash.xxh3_128_digest, solid)
        n.append(len(solid))
    n = np.array(n, np.int64)
    one, two = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2).T
    with np.errstate(over="ignore"):
        h, g = np.zeros(max(0, len(one) - size + 1), np.uint64), np.full(max(0, len(one) - size + 1), size, np.uint64)
        for k in range(size):
            h, g = _mix(h * ODD + one[k : k + len(h)]), _mix(g * ODD + two[k : k + len(g)])
    runs = np.maximum(n - size + 1, 0)
    # the runs that lie within one text
    at = np.repeat(np.cumsum(n) - n, runs) + np.arange(int(runs.sum())) - np.repeat(np.cumsum(runs) - runs, runs)
    struct = pa.StructArray.from_arrays([pa.array(h[at].view(np.int64)), pa.array((g[at] >> np.uint64(32)).astype(np.uint32).view(np.int32))], ["h", "g"])
    return n, pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(runs)).astype(np.int32)), struct)


def _keyed(docs: DataFrame, size: int) -> DataFrame:
    """(doc, row, n, runs) of every text: its number of sentences and the hashes of its runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in counts.texts_of(batch):
                n, runs = _runs([None if t is None else t.decode("utf-8", "replace") for t in texts], size)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(n), runs], ["doc", "row", "n", "runs"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("row"), "text")
    return rows.mapInArrow(counts.tidy(run), "doc long, row long, n long, runs array<struct<h:long,g:int>>")


def _place() -> Column:
    """One number that orders as (doc, i) does: a decimal is aggregated in place where a struct would be sorted."""
    order = F.coalesce("doc", F.lit((1 << 63) - 1)).cast("decimal(20,0)") * F.lit(PLACE).cast("decimal(10,0)") + F.col("i").cast("decimal(10,0)")
    return order.cast("decimal(38,0)")


def repeated(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """(doc, row, n, gone) of each text: its id, its hash, its number of sentences, and which of them non-first repeated runs cover."""
    texts = write(_keyed(docs, size), "spans-runs")
    runs = texts.frame.select("doc", "row", F.posexplode("runs").alias("i", "r")).select("doc", "row", "i", "r.h", "r.g")
    first = runs.groupBy("h", "g").agg(F.min(_place()).alias("first"), F.count("*").alias("c")).where("c > 1")
    first = write(first.select(F.col("h").alias("f_h"), F.col("g").alias("f_g"), "first"), "spans-first")
    later = runs.join(first.frame, (F.col("h") == F.col("f_h")) & (F.col("g") == F.col("f_g"))).where(_place() > F.col("first"))
    covered = later.select("doc", "row", F.lit(None).cast("long").alias("n"), F.explode(F.sequence(F.col("i"), F.col("i") + (size - 1))).alias("s"))
    counted = texts.frame.select("doc", "row", "n", F.lit(None).cast("int").alias("s"))
    gone = cut(counted.unionByName(covered).groupBy("doc", "row").agg(F.max("n").alias("n"), F.collect_set("s").alias("gone")), "spans-gone")
    texts.drop()
    first.drop()
    return gone


def _without(text: str, numbers: set[int]) -> str:
    """The text without the sentences of these numbers; blank stretches have none, and stay."""
    out, no = [], 0
    for piece in pieces(text):
        solid = bool(piece.strip(BLANK))
        if not (solid and no in numbers):
            out.append(piece)
        no += solid
    return "".join(out)


def dedupe(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """``docs`` with ``kept_text``, ``n_sentences`` and ``n_removed``; one shuffle of the texts, by document."""
    gone = repeated(docs, size)
    carried = [c for c in docs.columns if c.lower() not in {"kept_text", "n_sentences", "n_removed"}]
    joined = docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone["doc"]) & F.xxhash64(docs["text"]).eqNullSafe(gone["row"]), "left")
    own, text = gone["gone"], docs["text"]

    @F.pandas_udf("string")
    def rebuilt(texts: pd.Series, dropped: pd.Series) -> pd.Series:
        return pd.Series([None if text is None else _without(text, set(numbers.tolist())) for text, numbers in zip(texts, dropped, strict=True)], dtype=object)

    # only texts that lose a sentence cross to Python and are cut again
    loses = F.size(own) > 0
    kept = F.when(loses, rebuilt(F.when(loses, text), F.when(loses, own).otherwise(F.array().cast("array<int>")))).otherwise(text)
    done = [kept.alias("kept_text"), gone["n"].cast("long").alias("n_sentences"), F.size(own).cast("long").alias("n_removed")]
    return joined.select(*[docs[f"`{c}`"] for c in carried], *done)
