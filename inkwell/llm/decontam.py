"""Benchmark decontamination by pigeonhole pieces and Myers' bit-parallel edit distance.

An item of ``m`` characters may differ from a passage by up to ``k = m // per_edit`` edits. It is cut into ``k + 1`` pieces, of which
at least one stands in the passage unchanged; more than that, of the pairs of neighbouring pieces at least one holds at most one edit,
so next to an unchanged piece its pair's other piece stands with one edit at most. An Aho-Corasick automaton finds all pieces of all
items in one pass over a text, the pair is compared, and what remains is verified by Myers' algorithm, which also gives the place.
Every occurrence within the budget is found; none is estimated. An item of fewer than ``min_chars`` characters has no budget: its one
piece is the whole item, which is found where none of its letters or digits touches another letter or digit.

Texts and items are compared with A-Z lower-cased and each blank as a space, which keeps offsets. Items are collected by the driver in
blocks of at most ``BLOCK_BYTES``, each of which takes a pass over the texts: one block for the usual benchmark.

Defined results: null or empty texts have no passages; a text is searched as a whole however long it is; null and blank items are
not searched for;
repeated rows of either side give repeated results; a passage is cut out of the row it was found in, known by its id, null or not, and a
hash of its text; overlapping occurrences of one item give the one with fewest edits, of those the
first; empty tables give an empty result; further columns are not carried.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm.counts import texts_of, tidy
from inkwell.llm.store import cut

BLOCK_BYTES = 16 << 20
FOLD = bytes(range(256)).translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz     "))
SCHEMA = "doc_id long, row long, item_id long, start int, end int, distance int"


def folded(raw: bytes | None) -> str:
    return (raw or b"").translate(FOLD).decode("utf-8", "replace")


def distances(pattern: str, text: str, pinned: bool = False) -> list[int]:
    """For each place of ``text``, the least edits between ``pattern`` and a stretch that ends there (``pinned``: that starts at 0)."""
    m = len(pattern)
    every, top = (1 << m) - 1, 1 << (m - 1)
    at: dict[str, int] = {}
    for i, c in enumerate(pattern):
        at[c] = at.get(c, 0) | 1 << i
    more, less, score, out = every, 0, m, []
    for c in text:
        eq = at.get(c, 0)
        zero = (((eq & more) + more) ^ more) | eq | less  # places whose diagonal step costs nothing
        up = less | (~(zero | more) & every)
        down = more & zero
        score += bool(up & top) - bool(down & top)
        up = (up << 1 | pinned) & every
        more = (down << 1 | ~(zero | up)) & every
        less = up & zero
        out.append(score)
    return out


class Items:
    """The pieces of a block of items in one automaton."""

    def __init__(self, items: list[tuple[int, str]], per_edit: int, min_chars: int):
        self.items = items
        self.short = [len(t) < max(min_chars, per_edit) for _, t in items]
        self.budget = [0 if short else len(t) // per_edit for (_, t), short in zip(items, self.short, strict=True)]
        places: dict[str, list[tuple[int, int, int, int]]] = {}
        for no, (_, text) in enumerate(items):
            n, m = self.budget[no] + 1, len(text)
            cuts = [j * m // n for j in range(n + 1)]
            for j in range(n):
                other = j ^ 1
                beside = (cuts[other], cuts[other + 1]) if other < n else (0, 0)
                places.setdefault(text[cuts[j] : cuts[j + 1]], []).append((no, cuts[j], *beside))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()
        self.any = bool(places)

    def near(self, text: str, no: int, begin: int, a: int, b: int) -> bool:
        """Whether the item's characters ``a`` to ``b`` may stand with one edit at most where the item would begin at ``begin``.

        One edit leaves the first or the last half of a piece unchanged, and shifts the half away from the found piece by one at most.
        """
        if a == b:
            return True
        item, mid = self.items[no][1], (a + b) // 2
        left, right = item[a:mid], item[mid:b]
        for shift in (0, 1, -1):
            x, y = begin + a + shift, begin + mid + shift
            if (x >= 0 and text.startswith(left, x)) or (y >= 0 and text.startswith(right, y)):
                return True
        return False

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item's id, start, end, edits) of all passages of a folded text."""
        if not self.any:
            return []
        windows: dict[int, list[int]] = {}
        exact: dict[int, list[tuple[int, int]]] = {}
        for last, (size, where) in self.automaton.iter(text):
            first = last - size + 1
            for no, offset, a, b in where:
                if self.short[no]:
                    if not (text[first - 1 : first].isalnum() and text[first].isalnum()) and not (text[last : last + 2].isalnum() and last + 1 < len(text)):
                        exact.setdefault(no, []).append((first, last + 1))
                    continue
                begin = first - offset
                if self.near(text, no, begin, a, b):
                    windows.setdefault(no, []).append(begin)
        found = []
        for no, places in exact.items():
            end = 0
            for a, b in places:
                if a >= end:
                    found.append((self.items[no][0], a, b, 0))
                    end = b
        for no, begins in windows.items():
            item, k = self.items[no][1], self.budget[no]
            begins.sort()
            spans: list[list[int]] = []
            for x in begins:
                a, b = max(0, x - k), min(len(text), x + len(item) + k)
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(b, spans[-1][1])
                else:
                    spans.append([a, b])
            for a, b in spans:
                found += [(self.items[no][0], *f) for f in self.passages(text[a:b], item, k, a)]
        return found

    def passages(self, window: str, item: str, k: int, base: int) -> list[tuple[int, int, int]]:
        ends = sorted((d, e) for e, d in enumerate(distances(item, window)) if d <= k)
        taken: list[tuple[int, int, int]] = []
        for d, e in ends:
            if any(s < base + e + 1 and base + e + 1 - max(1, len(item) - k) < t for s, t, _ in taken):
                continue
            back = distances(item[::-1], window[: e + 1][::-1][: len(item) + k], pinned=True)
            start = e + 1 - (1 + min(range(len(back)), key=lambda i: (back[i], i)))
            if not any(s < base + e + 1 and base + start < t for s, t, _ in taken):
                taken.append((base + start, base + e + 1, d))
        return taken


def leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """(doc_id, item_id, start, end, distance) of all passages, in code points. One narrow pass over the texts, no shuffle."""
    return _leaks(docs, benchmark, **options).drop("row")


def _leaks(docs: DataFrame, benchmark: DataFrame, per_edit: int = 10, min_chars: int = 24) -> DataFrame:
    """``leaks`` with ``row``, the hash of the text."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.col("text").rlike("\\S"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("row"))
    out = None
    for no in range(blocks):
        block = [(r["item_id"], folded(r["text"].encode())) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == no).toLocalIterator()]
        held = docs.sparkSession.sparkContext.broadcast(sorted(block, key=lambda x: (x[0] is None, x)))

        def run(batches, held=held):
            search = Items(held.value, per_edit, min_chars)
            for batch in batches:
                ids, hashes = batch.column(0), batch.column(2)
                for a, b, texts in texts_of(batch):
                    got = [(ids[a + k].as_py(), hashes[a + k].as_py(), *f) for k, t in enumerate(texts) for f in search.find(folded(t))]
                    yield pa.RecordBatch.from_arrays([pa.array([g[c] for g in got], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()))], names=["doc_id", "row", "item_id", "start", "end", "distance"])

        part = rows.mapInArrow(tidy(run), SCHEMA)
        out = part if out is None else out.unionByName(part)
    return out


def _without(text: Column, spans: Column) -> Column:
    """The text without the spans (start, end), which may overlap."""
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    step = lambda a, s: F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.concat(a["out"], F.array(F.substring(text, a["at"] + 1, F.greatest(s["start"] - a["at"], F.lit(0))))).alias("out"))
    done = F.transform(F.array(F.aggregate(F.sort_array(spans), begin, step)), lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.length(text))))
    return F.get(done, F.lit(0))


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` with every found passage cut out of its text; other columns and rows stay as they are."""
    found = cut(_leaks(docs, benchmark, **options), "decontam-leaks")
    spans = found.groupBy(F.col("doc_id").alias("l_doc"), F.col("row").alias("l_row")).agg(F.collect_set(F.struct("start", "end")).alias("l_spans"))
    joined = docs.join(spans, docs["doc_id"].cast("long").eqNullSafe(spans["l_doc"]) & (F.xxhash64(docs["text"]) == spans["l_row"]), "left")
    text = F.when(spans["l_spans"].isNotNull(), _without(docs["text"], spans["l_spans"])).otherwise(docs["text"])
    return joined.select(*[text.alias(c) if c == "text" else docs[f"`{c}`"] for c in docs.columns])
