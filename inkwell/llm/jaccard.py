"""Exact Jaccard join of documents on word shingles, with signatures of one rare or two frequent tokens.

A document's set holds the 64-bit hashes of its distinct five-word shingles. Tokens are ordered unique, rare, frequent, by hash
within each; "unique" means one document holds it, "frequent" more than ``frequent`` do. A pair at the threshold shares at least
``k`` tokens of its prefixes of length ``n - ceil(t n) + k``. Unique tokens are shared by nobody and give no signature; a rare token
is one; frequent tokens are dealt into ``classes`` by hash, and two of one class make one. With frequent tokens of ``G`` classes in a
prefix, ``k = 1 + G``: sharing that many tokens without a rare one among them puts two into one class. Sets smaller than ``SMALL``,
for which that many shared tokens are not certain, use single tokens throughout; sets near that size use both schemes. Large sets have
more classes, one for every ``PER_CLASS`` tokens by powers of two, so that signatures stay in proportion to a set; a set emits the
signatures of each number of classes that a partner at the threshold may have.

The order needs each token's class only, which is read from two bitmaps that follow the data up to a fixed size; hashes that meet in a
slot make a token look more frequent than it is, which costs signatures, one a token at most, and no pair. Tokens are counted by a
shuffle of four bytes each. Over ``MOST_BYTES`` of text, where bitmaps of that size would be full, nothing is counted and every token
is taken for frequent; signatures that no two sets share leave at Spark's grouping in any case.

Equal sets are one vertex. A signature's vertices are first compared with one pivot, which joins groups of copies at a row per copy.
What still shares a signature across components is compared in full: see ``links``. So every pair that shares a signature was compared
or is in one component, which is complete; no pair within a joined group is ever made.

Defined results: without words or text a document has no shingles, no links and itself as component; fewer than five words are one
shingle; ties cannot occur; rows that share an id are one document linked through the text of either; a null id gets a null
component; an empty table gives an empty result; further columns are not carried. Texts are read whole, in slices of bounded size.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm import counts
from inkwell.llm.store import Table, cut, write

WIDTH = 5
PERCENT = 80
SMALL = 64
PER_CLASS = 32
MOST_BYTES = 64 << 30
#: Tasks among which a hub's neighbours are dealt.
SALT = 8
ODD = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    """64-bit hashes of words, forgotten when there are many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        got = self[word] = xxhash.xxh64_intdigest(word)
        return got


_hashes = _Words()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: list[bytes | None], width: int = WIDTH) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text. ``bytes.lower`` and ``bytes.split`` treat A-Z and the six blanks, nothing else."""
    split = [t.lower().split() if t else [] for t in texts]
    counts = [len(s) for s in split]
    flat = np.fromiter((h for s in split for h in map(_hashes.__getitem__, s)), np.uint64, sum(counts))
    with np.errstate(over="ignore"):
        n = len(flat)
        whole = np.zeros(max(0, n - width + 1), np.uint64)
        for k in range(width if n >= width else 0):
            whole = (whole * ODD) + _mix(flat[k : n - width + 1 + k] + np.uint64(k))
        whole = _mix(whole)
        out, at = [], 0
        for c in counts:
            if c >= width:
                out.append(np.unique(whole[at : at + c - width + 1]))
            elif c:
                h = np.uint64(c)
                for x in flat[at : at + c]:
                    h = _mix(h * ODD + x)
                out.append(np.array([h], np.uint64))
            else:
                out.append(np.zeros(0, np.uint64))
            at += c
    return out


def classes_for(n: int, least: int) -> int:
    """The number of classes for a set of ``n`` tokens."""
    return least << max(0, (n // (PER_CLASS * least)).bit_length() - 1)


def signatures(tokens: np.ndarray, kind: np.ndarray, percent: int, classes: int) -> np.ndarray:
    """Signatures of a set; ``kind`` is 0, 1 or 2 for each token: unique, rare, frequent."""
    n = len(tokens)
    need = -(-percent * n // 100)
    order = np.lexsort((tokens, kind))
    tokens, kind = tokens[order], kind[order]
    small = math.ceil(SMALL * percent / 100)
    out = []
    if n < SMALL:
        prefix = slice(0, n - need + 1)
        out.append(tokens[prefix][kind[prefix] > 0])
    if n < small:
        return np.unique(out[0])
    # a partner has between percent of n and n / percent tokens; the larger of the two has the number of classes that counts
    for dealt in {classes_for(m, classes) for m in (n, 100 * n // percent)}:
        k = 1
        while True:
            prefix = slice(0, min(n, n - need + k))
            often = tokens[prefix][kind[prefix] == 2]
            group = (often >> np.uint64(7)) % np.uint64(dealt)
            if (wanted := 1 + len(np.unique(group))) <= k:
                break
            k = wanted
        out.append(tokens[prefix][kind[prefix] == 1])
        by = np.argsort(group, kind="stable")
        often, group = often[by], group[by]
        for part in np.split(often, np.flatnonzero(np.diff(group)) + 1) if len(often) else ():
            a, b = np.triu_indices(len(part), 1)
            with np.errstate(over="ignore"):
                out.append(_mix(part[a] * ODD + part[b]))
    return np.unique(np.concatenate(out))


def signed(docs: DataFrame, maps: Broadcast, slots_log2: int, percent: int, classes: int) -> DataFrame:
    """(doc_id, n, node, sigs): the set's size, a 128-bit digest of the set, and its signatures. ``maps`` holds the two bitmaps."""

    def run(batches):
        several, many = maps.value
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            for a, b, texts in counts.texts_of(batch):
                sizes, nodes, sigs = [], [], []
                for s in shingle_sets(texts):
                    kind = counts.held(several, s, slots_log2) + counts.held(many, s, slots_log2)
                    sizes.append(len(s))
                    nodes.append(hashlib.md5(s.tobytes()).digest() if len(s) else None)
                    sigs.append(signatures(s, kind, percent, classes).view(np.int64) if len(s) and kind.any() else None)
                offsets = np.cumsum([0, *(0 if x is None else len(x) for x in sigs)]).astype(np.int32)
                flat = np.concatenate([np.zeros(0, np.int64), *(x for x in sigs if x is not None)])
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["doc_id", "n", "node", "sigs"])
        _hashes.clear()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(counts.tidy(run), "doc_id long, n long, node binary, sigs array<long>")


def bitmap_of(wanted: DataFrame, slots_log2: int = 24) -> Broadcast:
    """A bitmap, fixed in size, of the ids in ``wanted.rep``."""
    return wanted.sparkSession.sparkContext.broadcast(counts.bitmap(wanted, F.xxhash64("rep"), slots_log2))


def sets_of(docs: DataFrame, wanted: DataFrame, held: Broadcast, slots_log2: int = 24) -> DataFrame:
    """(rep, tokens) of the documents in ``wanted.rep``. Their bitmap spares the others' texts; an exact join follows."""

    def run(batches):
        words = held.value
        for batch in batches:
            batch = batch.filter(pa.array(counts.held(words, batch.column(2).to_numpy().view(np.uint64), slots_log2) == 1))
            for a, b, texts in counts.texts_of(batch):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([s.tobytes() for s in shingle_sets(texts)], pa.binary())], names=["doc", "tokens"])
        _hashes.clear()

    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc"), "text").withColumn("hash", F.xxhash64("doc"))
    found = rows.mapInArrow(counts.tidy(run), "doc long, tokens binary")
    return found.join(wanted, found["doc"] == wanted["rep"]).select("rep", "tokens")


def verified(pairs: DataFrame, sets: DataFrame, percent: int, ends: tuple[str, str] = ("a", "b")) -> DataFrame:
    """(a, b): the two columns ``ends`` of the pairs (a, b, ...) whose sets are similar enough."""
    left, right = sets.select(F.col("rep").alias("a"), F.col("tokens").alias("ta")), sets.select(F.col("rep").alias("b"), F.col("tokens").alias("tb"))
    both = pairs.join(left, "a").join(right, "b").select(F.col(ends[0]).alias("a"), F.col(ends[1]).alias("b"), "ta", "tb")

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.searchsorted(y, x)
                common = int((y[np.minimum(at, len(y) - 1)] == x).sum()) if len(x) and len(y) else 0
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(counts.tidy(run), "a long, b long").distinct()


def components(edges: DataFrame) -> Table:
    """(node, component) of all ends of ``edges`` (a, b): alternating large and small stars until every node points at its least."""
    now = write(edges.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("component")).where("node <> component").distinct(), "stars")
    mark = None
    while True:
        down = now.frame.select(F.col("node").alias("u"), F.col("component").alias("v"))
        both = down.unionByName(down.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
        # a hub's rows are dealt to several tasks, each with a copy of its least neighbour
        salted = both.withColumn("salt", F.pmod(F.hash("v"), F.lit(SALT)))
        least = least.withColumn("c_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        large = salted.join(least, (F.col("u") == F.col("c")) & (F.col("salt") == F.col("c_salt"))).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), "m")
        small = large.join(down, F.col("u") == F.col("c"))
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select(F.col("c").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct()
        last, now = now, write(small.select(F.col("u").alias("node"), F.col("v").alias("component")), "stars")
        last.drop()
        seen = now.frame.agg(F.count("*"), F.sum(F.hash("node", "component").cast("long")), F.sum(F.hash("component", "node").cast("long"))).first()
        if seen == mark:
            return now
        mark = seen


def _labelled(members: DataFrame, found: DataFrame) -> DataFrame:
    return members.join(found, F.col("rep") == F.col("node"), "left").select("sig", "rep", "n", F.coalesce("component", "rep").alias("comp"))


def _pairs(left: str, right: str, percent: int):
    fits = (F.col(f"n_{left}") * 100 >= F.col(f"n_{right}") * percent) & (F.col(f"n_{right}") * 100 >= F.col(f"n_{left}") * percent)
    return fits, F.least(left, right).alias("a"), F.greatest(left, right).alias("b")


def _compared(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b): links that join the components of similar vertices among (rep, comp, block, tokens) of each (pivot, lo, hi).

    A group is two blocks of bounded size, or one. Shared tokens are counted by products of slices of the token matrix. What a group
    joins is returned as a row per component, its least one being ``b``, however many of its pairs are similar.
    """

    def run(table: pa.Table) -> pa.Table:
        rep, comp, block = (table.column(c).to_numpy() for c in ("rep", "comp", "block"))
        lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for chunk in table.column("tokens").chunks for x in chunk]
        size = np.array([len(s) for s in sets], np.int64)
        owner = np.repeat(np.arange(len(sets)), size)
        _, token, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = times[token] > 1
        owner, token = owner[shared], (np.cumsum(times > 1) - 1)[token[shared]]
        by = np.argsort(token, kind="stable")
        owner, token = owner[by], token[by]
        common = np.zeros((len(sets), len(sets)), np.float32)
        for a in range(0, int(token[-1]) + 1 if len(token) else 0, 4096):
            x, y = np.searchsorted(token, [a, a + 4096])
            part = np.zeros((len(sets), 4096), np.float32)
            part[owner[x:y], token[x:y] - a] = 1
            common += part @ part.T
        near = 100 * common >= percent * (size[:, None] + size[None, :] - common)
        if lo != hi:
            near &= block[:, None] != block[None, :]
        name, of = np.unique(comp, return_inverse=True)
        least = np.arange(len(name))
        while True:  # each vertex takes the least of its neighbours' and its component's, until nothing changes
            own = least[of]
            seen = np.minimum(own, np.where(near, own[None, :], len(name)).min(axis=1, initial=len(name)))
            now = least.copy()
            np.minimum.at(now, of, seen)
            if (now == least).all():
                break
            least = now
        joined = least < np.arange(len(name))
        return pa.table({"a": pa.array(name[joined], pa.int64()), "b": pa.array(name[least[joined]], pa.int64())})

    return rows.groupBy("pivot", "lo", "hi").applyInArrow(run, "a long, b long").distinct()


def _stars(labelled: DataFrame) -> DataFrame:
    """(s, c, k, p, n_p) of each signature: its vertices, components, and as pivot the vertex with the least hash.

    The least hash of all gives signatures with nearly the same vertices the same pivot.
    """
    pivot = F.min(F.struct(F.hash("rep").alias("h"), F.col("rep").alias("p"), F.col("n").alias("n_p"))).alias("pivot")
    parts = labelled.groupBy("sig", "comp").agg(F.count("*").alias("c"), pivot)
    stars = parts.groupBy("sig").agg(F.sum("c").alias("c"), F.count("*").alias("k"), F.min("pivot").alias("pivot"))
    return stars.where("k > 1").select(F.col("sig").alias("s"), "c", "pivot.p", "pivot.n_p")


def links(members: DataFrame, sets: DataFrame, percent: int, few: int = 32, block: int = 128, block_tokens: int = 500_000) -> Table:
    """(node, component) over all links among vertices that share a signature.

    First each vertex is compared with the pivots of its signatures, which joins groups of copies at the cost of a row per copy. Then
    whatever shares a signature across components is compared: pair by pair where a signature has up to ``few`` vertices; else the
    vertices that have a pivot in common are dealt into blocks, and two blocks at a time are compared in one task, which returns links
    only. A block has about ``block`` vertices and ``block_tokens`` tokens, however many share the signature.
    """
    sig = F.col("sig") == F.col("s")
    labelled = members.withColumn("comp", F.col("rep"))
    near = labelled.withColumnRenamed("n", "n_rep").join(_stars(labelled), sig).where("rep <> p")
    fits, a, b = _pairs("rep", "p", percent)
    first = write(near.where(fits).select(a, b).distinct(), "jaccard-pairs")
    edges = write(verified(first.frame, sets, percent), "jaccard-edges")
    found = components(edges.frame)

    marked = write(_labelled(members, found.frame), "jaccard-labelled")
    open_ = write(_stars(marked.frame), "jaccard-open")
    labelled = marked.frame
    small = labelled.join(open_.frame.where(F.col("c") <= few).select("s"), sig, "left_semi")
    x = small.select("sig", F.col("rep").alias("x"), F.col("n").alias("n_x"), F.col("comp").alias("c_x"))
    y = small.select(F.col("sig").alias("s"), F.col("rep").alias("y"), F.col("n").alias("n_y"), F.col("comp").alias("c_y"))
    fits, a, b = _pairs("x", "y", percent)
    ends = F.least("c_x", "c_y").alias("ca"), F.greatest("c_x", "c_y").alias("cb")
    second = write(x.join(y, sig & (F.col("c_x") < F.col("c_y")) & fits).select(a, b, *ends).distinct().join(first.frame, ["a", "b"], "left_anti"), "jaccard-pairs")

    large = labelled.join(open_.frame.where(F.col("c") > few).select("s", F.col("p").alias("pivot")), sig)
    near_misses = write(large.select("pivot", "rep", "n", "comp").distinct(), "jaccard-large")
    large = near_misses.frame
    blocks = F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n") / block_tokens)).cast("int")
    dealt = large.join(large.groupBy("pivot").agg(blocks.alias("blocks")).withColumnRenamed("pivot", "g"), F.col("pivot") == F.col("g"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("pivot", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "rep", "comp")
    dealt = dealt.join(sets.withColumnRenamed("rep", "t"), F.col("rep") == F.col("t")).drop("t")
    # links between components, whose names are vertices too
    more = write(verified(second.frame, sets, percent, ("ca", "cb")).unionByName(_compared(dealt, percent)).distinct(), "jaccard-edges")
    if not more.frame.isEmpty():
        above = components(more.frame)
        up = above.frame.select(F.col("node").alias("u_node"), F.col("component").alias("u_component"))
        both = found.frame.join(up, F.col("component") == F.col("u_node"), "left").select("node", F.coalesce("u_component", "component").alias("component"))
        # a component's own vertex is no row of the first table
        last, found = found, write(both.unionByName(up.select(F.col("u_node").alias("node"), F.col("u_component").alias("component"))), "jaccard-components")
        last.drop()
        above.drop()
    for table in (first, second, near_misses, marked, open_, edges, more):
        table.drop()
    return found


def join(docs: DataFrame, percent: int = PERCENT, frequent: int = 32, classes: int = 16, slots_log2: int = counts.SLOTS_LOG2, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``; documents link at ``percent`` per cent and more."""
    total = counts.n_bytes(docs)
    if total <= most_bytes:
        # some four slots a token, up to the bound
        slots_log2 = counts.log2_at_least(total, 16, slots_log2)
        several, many = counts.classes(docs, shingle_sets, (2, frequent + 1), slots_log2, total)
    else:
        slots_log2 = 3
        several = many = np.full(1, 255, np.uint8)
    maps = docs.sparkSession.sparkContext.broadcast((several, many))
    rows = cut(signed(docs, maps, slots_log2, percent, classes), "jaccard-docs")
    maps.destroy()
    reps = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep")).select(F.col("node").alias("r_node"), "rep")
    flat = rows.where("sigs is not null").select("node", "n", F.explode("sigs").alias("sig")).distinct()
    often = flat.groupBy("sig").agg(F.count("*").alias("c")).where("c > 1").select(F.col("sig").alias("s"))
    members = flat.join(often, F.col("sig") == F.col("s"), "left_semi").join(reps, F.col("node") == F.col("r_node")).where("rep is not null")
    held = write(members.select("sig", "rep", "n").distinct(), "jaccard-members")
    wanted = held.frame.select("rep").distinct()
    bits = bitmap_of(wanted)
    sets = write(sets_of(docs, wanted, bits), "jaccard-sets")
    bits.destroy()
    found = links(held.frame, sets.frame, percent).frame
    held.drop()
    sets.drop()
    named = reps.join(found, F.col("rep") == F.col("node"), "left").select("r_node", F.coalesce("component", "rep").alias("c"))
    out = rows.join(named, F.col("node") == F.col("r_node"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("c", "doc_id").alias("component_id"))
