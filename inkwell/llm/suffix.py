"""Removal of every byte under a string of ``threshold`` bytes that also starts in a document with a smaller id, by prefix doubling.

A position is ranked by the string that starts at it; a longer string's rank comes from sorting pairs (rank of its prefix, name of what
follows at an offset), and positions leave as soon as their rank is unique or their string has reached the threshold. The offsets grow
from step to step. All positions of a corpus at every step would be many times the corpus, so one sampled position first speaks for
the windows (strings of ``threshold`` bytes) around it. Each window has one anchor, its string of ``gram`` bytes with the least hash (of
equal ones the leftmost), so equal windows have equal anchors; windows next to each other with one anchor form a run.

1. Far past the threshold. A run whose anchor's hash divides by ``CHUNK`` begins a chunk of runs, some ``6 * CHUNK`` bytes. Spark ranks
   chunks by the names of their whole strings; one that an earlier document holds is removed, and only what no chunk covers goes on.
   An earlier document's windows are never lost by that: the earliest of equal windows is covered by none.
2. Under the threshold. Names of 1, 2, 4 ... bytes up to the anchor's are doubled in the map task. A counted bitmap, which follows the
   data in size, spares Spark most runs whose anchor is unique; above ``MOST`` runs, where a bitmap of bounded size would be full, all
   runs go on. Spark then ranks the anchors, and unique ones leave.
3. Past the threshold. Spark ranks runs by (anchor, name of the whole string); one that an earlier document holds is removed. A run
   whose anchor has no other name needs nothing more.
4. At the edges of repeats, one copy of each run whose anchor has several names, in documents that differ, is opened into its windows.
   Spark doubles these from ``threshold / 2**rounds`` bytes to the threshold: each round sorts the pairs (rank, name at the offset),
   numbers those that several documents hold in their order, and joins the numbers back as new ranks; the rest is unique and leaves.

Ranking groups with partial aggregation before the shuffle and joins back, both sides sorted, where Spark splits hot keys; so a string
in a third of all documents is no task's own. A run is compared by 128 bits, its anchor and its name, of which 64 tell apart the runs
of one anchor; a chunk by 128 bits; a window by 64 bits for each piece.

Defined results: a null text is empty; texts shorter than the threshold stay; equal ids never remove each other's bytes; a null id
counts as larger than all others; bytes go from the row they were found in, known by its id and a hash of its text, so repeated rows
are treated alike and other rows of the same id keep theirs; of ties none matters, as only the least id counts; a very long text is
hashed in parts of at most ``STEP`` bytes, and one that repeats a short period has up to a run for each byte; an empty table gives an empty result; further columns are not carried.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm import counts
from inkwell.llm.store import write

THRESHOLD = 50
GRAM = 38
#: Runs in a chunk.
CHUNK = 16
#: At most a bitmap of anchors of 32 MB; it is used for up to ``MOST`` runs.
SLOTS_LOG2 = 28
MOST = 1 << 32
ODD = np.uint64(0x9E3779B97F4A7C15)
#: Bytes hashed at a time: arrays of that length stay in a core's cache.
PLACES = 16
STEP = 1 << PLACES
LAST = (1 << 63) - 1
#: A removed range is one long: its first byte and, in the lowest bits, its length.
LENGTH_BITS = 20


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: A random number for each byte.
BYTES = _mix(np.arange(1, 257, dtype=np.uint64) * ODD)


class Names:
    """Hashes of all strings of any length up to ``longest`` in a stretch of bytes, doubled from those of 1, 2, 4, ... bytes."""

    def __init__(self, raw: bytes, longest: int):
        with np.errstate(over="ignore"):
            data = np.frombuffer(raw, np.uint8)
            self.level, self.power, length = {1: BYTES[data]}, {1: ODD}, 1
            while 2 * length <= min(longest, len(data)):
                h, p = self.level[length], self.power[length]
                self.level[2 * length], self.power[2 * length] = h[: len(h) - length] * p + h[length:], p * p
                length *= 2

    def of(self, length: int) -> np.ndarray:
        """The hash of every string of ``length`` bytes."""
        out, at, n = None, 0, len(self.level[1]) - length + 1
        with np.errstate(over="ignore"):
            for step in sorted(self.level, reverse=True):
                if length & step:
                    part = self.level[step][at : at + n]
                    out = part if out is None else out * self.power[step] + part
                    at += step
        return out


class Block:
    """The runs of a block of texts, at most ``STEP`` bytes: text, first window, number of windows, anchor and, if asked for, name.

    ``begin`` has each text's first byte. Anchors are mixed once more after the least is chosen: the hashes that win are small ones.
    """

    def __init__(self, texts: list[bytes], threshold: int, gram: int, named: bool = True):
        with np.errstate(over="ignore"):
            raw = b"".join(texts)
            size = np.array([len(t) for t in texts], np.int64)
            self.begin = np.cumsum(size) - size
            self.size = n = len(raw)
            empty = np.zeros(0, np.int64)
            self.text, self.first, self.count, self.anchor, self.name = empty, empty, empty, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
            if n < threshold:
                return
            names = Names(raw, threshold if named else gram)
            grams = _mix(names.of(gram))
            least = (grams >> np.uint64(PLACES)) << np.uint64(PLACES) | np.arange(len(grams), dtype=np.uint64)
            width, length = threshold - gram + 1, 1
            while 2 * length <= width:
                least = np.minimum(least[:-length], least[length:])
                length *= 2
            if width > length:
                least = np.minimum(least[: length - width], least[width - length :])
            at = (least & np.uint64(STEP - 1)).astype(np.int32)
            # a run ends where the anchor changes and where the windows of a text end
            windows = np.maximum(size - threshold + 1, 0)
            change = np.empty(len(at), bool)
            change[0] = True
            np.not_equal(at[1:], at[:-1], out=change[1:])
            change[self.begin[windows > 0]] = True
            ends = self.begin + windows
            change[ends[ends < len(at)]] = True
            new = np.flatnonzero(change)
            count = np.diff(np.append(new, len(at)))
            text = np.searchsorted(self.begin, new, "right") - 1
            inside = new - self.begin[text] < windows[text]
            self.first, self.count, self.text = new[inside], count[inside], text[inside]
            self.anchor = _mix(grams[at[self.first]] + ODD)
            if named:
                # a run's first and last windows overlap, and so cover it
                whole = names.of(threshold)
                self.name = _mix(whole[self.first] * ODD + _mix(whole[self.first + self.count - 1] + self.count.astype(np.uint64)))

    def chunks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(run that begins it, number of windows, two names) of each chunk."""
        head = self.anchor % np.uint64(CHUNK) == 0
        head[np.flatnonzero(np.diff(self.text, prepend=-1))] = True
        head = np.flatnonzero(head)
        with np.errstate(over="ignore"):
            place = (np.arange(len(self.text)) - np.repeat(head, np.diff(np.append(head, len(self.text))))).astype(np.uint64)
            one = np.add.reduceat(_mix(self.name + place * ODD), head)
            two = np.add.reduceat(_mix(self.name * ODD ^ _mix(self.anchor + place)), head)
        return head, np.add.reduceat(self.count, head), one, two


def blocks(texts: list[bytes | None], threshold: int, gram: int, named: bool = True):
    """(numbers of texts, offset in each, Block) over blocks of whole texts, a long one in parts that overlap by a window less a byte."""
    batch, numbers, offsets, total = [], [], [], 0
    for no, text in enumerate(texts):
        text = text or b""
        for at in range(0, max(1, len(text) - threshold + 1), STEP - threshold):
            part = text[at : at + STEP - 1]
            if total + len(part) >= STEP:
                yield np.array(numbers), np.array(offsets), Block(batch, threshold, gram, named)
                batch, numbers, offsets, total = [], [], [], 0
            batch.append(part)
            numbers.append(no)
            offsets.append(at)
            total += len(part)
    if batch:
        yield np.array(numbers), np.array(offsets), Block(batch, threshold, gram, named)


def _anchors(texts, threshold: int, gram: int) -> list[np.ndarray]:
    """The anchors of all runs; one that a text has twice counts as repeated, which spares it no later step but this one."""
    return [b.anchor for _, _, b in blocks(texts, threshold, gram, named=False)]


def _shuffled(rows: DataFrame) -> DataFrame:
    return rows.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), "text", F.xxhash64("text").alias("row"))


def chunks_of(rows: DataFrame, threshold: int, gram: int) -> DataFrame:
    """(one, two, doc, row, at, n): every chunk, with its names and its ``n`` windows from byte ``at``."""

    def run(batches):
        for batch in batches:
            ids, hashes = batch.column(0), batch.column(2)
            for a, b, texts in counts.texts_of(batch):
                own, row = ids.slice(a, b - a).to_numpy(), hashes.slice(a, b - a).to_numpy()
                for numbers, offsets, block in blocks(texts, threshold, gram):
                    if not len(block.text):
                        continue
                    head, n, one, two = block.chunks()
                    text = block.text[head]
                    columns = [one.view(np.int64), two.view(np.int64), own[numbers[text]], row[numbers[text]], block.first[head] - block.begin[text] + offsets[text], n.astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["one", "two", "doc", "row", "at", "n"])

    return rows.mapInArrow(counts.tidy(run), "one long, two long, doc long, row long, at long, n int")


def uncovered(rows: DataFrame, gone: DataFrame, threshold: int) -> DataFrame:
    """(doc, text, row, at): the stretches of each text whose windows ``gone`` (doc, row, at, n) leaves, with their first byte."""
    spans = gone.groupBy(F.col("doc").alias("g_doc"), F.col("row").alias("g_row")).agg(F.collect_list(_range(F.col("n"))).alias("gone"))
    joined = rows.join(spans, (F.col("doc") == F.col("g_doc")) & (F.col("row") == F.col("g_row")), "left")

    def run(batches):
        for batch in batches:
            for a, b, texts in counts.texts_of(batch):
                out = []
                for k, text in enumerate(texts, a):
                    doc, row, spans = batch.column(0)[k].as_py(), batch.column(2)[k].as_py(), batch.column(3)[k]
                    first, end = merged(spans.values.to_numpy()) if spans.is_valid else (np.zeros(0, np.int64),) * 2
                    n = len(text or b"") - threshold + 1
                    out += [(doc, text[x : y + threshold - 1], row, x) for x, y in zip([0, *end.tolist()], [*first.tolist(), n], strict=True) if x < y]
                kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], t) for c, t in enumerate(kinds)], names=["doc", "text", "row", "at"])

    return joined.select("doc", F.col("text").cast("binary").alias("text"), "row", "gone").mapInArrow(counts.tidy(run), "doc long, text binary, row long, at long")


def runs_of(rows: DataFrame, bits: Broadcast, slots_log2: int, threshold: int, gram: int) -> DataFrame:
    """(anchor, name, doc, row, at, n): runs of ``n`` windows from byte ``at``; with a bitmap in ``bits``, those whose anchor several stretches may hold."""

    def run(batches):
        for batch in batches:
            ids, hashes, firsts = batch.column(0), batch.column(2), batch.column(3)
            for a, b, texts in counts.texts_of(batch):
                own, row, begin = (c.slice(a, b - a).to_numpy() for c in (ids, hashes, firsts))
                for numbers, offsets, block in blocks(texts, threshold, gram):
                    keep = slice(None) if bits.value is None else counts.held(bits.value, block.anchor, slots_log2).astype(bool)
                    text = block.text[keep]
                    if not len(text):
                        continue
                    at = block.first[keep] - block.begin[text] + offsets[text] + begin[numbers[text]]
                    columns = [block.anchor[keep].view(np.int64), block.name[keep].view(np.int64), own[numbers[text]], row[numbers[text]], at, block.count[keep].astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor", "name", "doc", "row", "at", "n"])

    return rows.mapInArrow(counts.tidy(run), "anchor long, name long, doc long, row long, at long, n int")


def lengths(threshold: int, rounds: int) -> list[int]:
    """The lengths of strings before and after each round; each is at most twice the one before, and the last is the threshold."""
    out = [threshold]
    for _ in range(rounds):
        out.insert(0, -(-out[0] // 2))
    return out


def windows_of(rows: DataFrame, edges: DataFrame, threshold: int, rounds: int) -> DataFrame:
    """(doc, row, at, rank, piece1, ...): the windows of the runs ``edges`` (doc, row, at, n), with the names of the pieces of each."""
    opened = edges.groupBy(F.col("doc").alias("e_doc"), F.col("row").alias("e_row")).agg(F.collect_list(F.struct("at", "n")).alias("runs"))
    joined = rows.join(opened, (F.col("doc") == F.col("e_doc")) & (F.col("row") == F.col("e_row")))
    joined = joined.select("doc", "row", F.col("text").cast("binary").alias("text"), F.col("runs.at").alias("at"), F.col("runs.n").alias("n"))
    ends = [0, *lengths(threshold, rounds)]
    names = ["doc", "row", "at", "rank", *(f"piece{k}" for k in range(1, rounds + 1))]

    def named(docs: list, row_hashes: list, strings: list[list[bytes]], at: list[np.ndarray], n: list[np.ndarray]) -> pa.RecordBatch:
        size = [len(a) for a in at]
        at, n = np.concatenate(at), np.concatenate(n)
        found = Names(b"".join(s for part in strings for s in part), threshold)
        begin = np.cumsum(n + threshold - 1) - (n + threshold - 1)  # each run's first byte among the joined strings
        inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        place = np.repeat(begin, n) + inside
        pieces = [_mix(found.of(b - a)[place + a]).view(np.int64) for a, b in zip(ends, ends[1:], strict=False)]
        columns = [np.repeat(np.repeat(docs, size), n), np.repeat(np.repeat(row_hashes, size), n), np.repeat(at, n) + inside, *pieces]
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=names)

    def run(batches):
        most, held, total = STEP // (2 * threshold), [], 0
        for batch in batches:
            docs, hashes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for k in range(batch.num_rows):
                text, at, n = batch.column(2)[k].as_py(), batch.column(3)[k].values.to_numpy(), batch.column(4)[k].values.to_numpy().astype(np.int64)
                for a in range(0, len(at), most):
                    x, y = at[a : a + most], n[a : a + most]
                    held.append((docs[k], hashes[k], [text[p : p + c + threshold - 1] for p, c in zip(x.tolist(), y.tolist(), strict=True)], x, y))
                    total += len(x)
                    if total >= most:
                        yield named(*map(list, zip(*held, strict=True)))
                        held, total = [], 0
        if held:
            yield named(*map(list, zip(*held, strict=True)))

    return joined.mapInArrow(counts.tidy(run), ", ".join(f"{c} long" for c in names))


def doubled(windows: DataFrame, rounds: int) -> DataFrame:
    """(doc, row, at): the windows that stand in an earlier document, after all rounds of ranking pairs at growing offsets."""
    alive, last = windows, None
    for k in range(1, rounds + 1):
        pairs = alive.groupBy("rank", f"piece{k}").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("most > least")
        # the pairs' numbers in their sorted order are the new ranks
        ranks = write(pairs.sort("rank", f"piece{k}").select(F.col("rank").alias("r_rank"), F.col(f"piece{k}").alias("r_piece"), "least", F.monotonically_increasing_id().alias("next")), "suffix-ranks")
        more = alive.join(ranks.frame.hint("merge"), (F.col("rank") == F.col("r_rank")) & (F.col(f"piece{k}") == F.col("r_piece")))
        if k == rounds:
            more = more.where("doc > least").select("doc", "row", "at")
        else:
            more = more.select("doc", "row", "at", F.col("next").alias("rank"), *(f"piece{j}" for j in range(k + 1, rounds + 1)))
        done = write(more, "suffix-alive")
        ranks.drop()
        if last:
            last.drop()
        alive, last = done.frame, done
    return alive


def _range(n: Column) -> Column:
    return F.shiftleft("at", LENGTH_BITS) + n


def _ranked(table: DataFrame, key: list[str]) -> DataFrame:
    """The least document of each rank that occurs more than once, under names that do not clash."""
    return table.groupBy(*key).agg(F.min("doc").alias("least"), F.count("*").alias("c")).select(*(F.col(k).alias(f"r_{k}") for k in key), "least", "c")


def repeats(docs: DataFrame, threshold: int = THRESHOLD, gram: int | None = None, slots_log2: int = SLOTS_LOG2, most: int = MOST, rounds: int = 2) -> DataFrame:
    """(doc, row, gone): byte ranges, possibly overlapping, that stand in documents with smaller ids; see ``LENGTH_BITS``."""
    rows = _shuffled(docs)
    long = gram or min(GRAM, threshold)
    chunks = write(chunks_of(rows, threshold, long), "suffix-chunks")
    held = _ranked(chunks.frame, ["one", "two"]).where("c > 1")
    covered = chunks.frame.join(held.hint("merge"), (F.col("one") == F.col("r_one")) & (F.col("two") == F.col("r_two"))).where("doc > least")
    covered = write(covered.select("doc", "row", "at", "n"), "suffix-covered").frame
    chunks.drop()
    rest = write(uncovered(rows, covered, threshold), "suffix-rest")

    total, repeated = counts.n_bytes(rest.frame), None
    n_runs = 2 * total // (threshold - long + 2)
    if n_runs <= most:
        gram = long
        # some four slots a run: a unique anchor seldom meets a repeated one
        slots_log2 = counts.log2_at_least(4 * n_runs, 16, slots_log2)
        (repeated,) = counts.classes(rest.frame, lambda texts: _anchors(texts, threshold, gram), (2,), slots_log2, total)
    # without the bitmap, shorter anchors give fewer runs
    gram = gram or threshold // 2 + 1
    bits = docs.sparkSession.sparkContext.broadcast(repeated)
    runs = write(runs_of(rest.frame, bits, slots_log2, threshold, gram), "suffix-runs")
    bits.destroy()
    rest.drop()
    names = write(_ranked(runs.frame, ["anchor", "name"]), "suffix-names")
    anchors = names.frame.groupBy("r_anchor").agg(F.min("least").alias("a"), F.max("least").alias("b")).where("b > a").select(F.col("r_anchor").alias("a_anchor"))
    ranked = names.frame.join(anchors, F.col("r_anchor") == F.col("a_anchor"), "left")
    ranked = ranked.select("r_anchor", "r_name", "least", "c", F.col("a_anchor").isNotNull().alias("edge")).where("edge or c > 1")
    found = runs.frame.join(ranked.hint("merge"), (F.col("anchor") == F.col("r_anchor")) & (F.col("name") == F.col("r_name")))
    # a run goes if an earlier document holds it; else it is opened if its anchor has other names
    found = write(found.where("doc > least or edge").select("doc", "row", "at", "n", (F.col("doc") > F.col("least")).alias("whole")), "suffix-found").frame
    runs.drop()
    names.drop()
    windows = write(windows_of(rows, found.where("not whole").select("doc", "row", "at", "n"), threshold, rounds), "suffix-windows")
    part = doubled(windows.frame, rounds)
    windows.drop()
    whole = covered.unionByName(found.where("whole").select("doc", "row", "at", "n")).select("doc", "row", _range(F.col("n") + threshold - 1).alias("gone"))
    return whole.unionByName(part.select("doc", "row", _range(F.lit(threshold)).alias("gone")))


def merged(gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, end) of the maximal removed stretches."""
    gone = np.sort(gone)
    at = gone >> LENGTH_BITS
    end = np.maximum.accumulate(at + (gone & ((1 << LENGTH_BITS) - 1)))
    new = np.concatenate([np.ones(min(1, len(at)), bool), at[1:] > end[:-1]])
    return at[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)] if len(at) else end


def dedupe(docs: DataFrame, threshold: int = THRESHOLD, **options) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of every row; ``kept`` is the text's remaining bytes. One shuffle of the texts."""
    gone = repeats(docs, threshold, **options).groupBy(F.col("doc").alias("g_doc"), F.col("row").alias("g_row")).agg(F.collect_list("gone").alias("gone"))
    rows = docs.select("doc_id", "text")
    own = (F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)) == F.col("g_doc")) & (F.xxhash64("text") == F.col("g_row"))
    joined = rows.join(gone, own, "left").select("doc_id", F.col("text").cast("binary").alias("text"), "gone")

    def run(batches):
        for batch in batches:
            texts, out = batch.column(1), []
            for k, spans in enumerate(batch.column(2)):
                text = texts[k].as_py() or b""
                if not spans.is_valid:
                    out.append((len(text), 0, 0, text))
                    continue
                first, end = (x.tolist() for x in merged(spans.values.to_numpy()))
                kept = b"".join(text[x:y] for x, y in zip([0, *end], [*first, len(text)], strict=True))
                out.append((len(text), len(text) - len(kept), len(first), kept))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([o[c] for o in out], t) for c, t in enumerate(kinds))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return joined.mapInArrow(counts.tidy(run), f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, n_removed long, n_spans long, kept binary")
