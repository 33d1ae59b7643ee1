"""How often 64-bit tokens occur, as bitmaps of bounded size, and slicing of Arrow batches."""

from __future__ import annotations

import ctypes
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.store import write

SLOTS_LOG2 = 27
SLICE_BYTES = 1 << 22
#: Bytes of text whose tokens a bucket holds.
BUCKET_BYTES = 4 << 20


def slices(sizes: list[int], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes; a larger row is a range of its own."""
    at, total = 0, 0
    for k, n in enumerate(sizes):
        if total and total + n > limit:
            yield at, k
            at, total = k, 0
        total += n
    if at < len(sizes):
        yield at, len(sizes)


def texts_of(batch: pa.RecordBatch, name: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, list[bytes | None]]]:
    column = batch.column(batch.schema.get_field_index(name))
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    for a, b in slices(sizes, limit):
        yield a, b, column.slice(a, b - a).cast(pa.binary()).to_pylist()


def release() -> None:
    """Give memory that is free back to the system: an idle Python worker would keep it beside Spark's own."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(run: Callable) -> Callable:
    """A function over a task's batches that calls ``release`` behind the last one."""

    def wrapped(batches):
        yield from run(batches)
        release()

    return wrapped


def n_bytes(docs: DataFrame) -> int:
    """The bytes of all texts."""
    return docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0


def log2_at_least(n: float, least: int, most: int) -> int:
    """The logarithm of the least power of two that is not under ``n``, between two bounds."""
    return min(most, max(least, math.ceil(math.log2(max(1, n)))))


def classes(docs: DataFrame, tokens: Callable[[list[bytes | None]], list[np.ndarray]], levels: tuple[int, ...], slots_log2: int = SLOTS_LOG2, total: int | None = None) -> list[np.ndarray]:
    """For each level, a bitmap by a token's leading bits: set where a token is held by at least that many documents.

    ``tokens`` gives the distinct tokens of each text. A task sends each token once per document, at most ``max(levels)`` times, as
    four bytes to the bucket of its leading bits. A bucket has an even share of hash space, so no document or token makes it large,
    and the number of buckets follows the texts' bytes (``total``). Tokens that agree in 32 bits more than the bucket's are counted as
    one, which can only set more bits. The bitmaps have the size that the caller chose; the driver puts them together.
    """
    buckets_log2 = log2_at_least((n_bytes(docs) if total is None else total) / BUCKET_BYTES, min(6, slots_log2 - 3), slots_log2 - 3)
    most = max(levels)

    def send(batches):
        for batch in batches:
            for _, _, texts in texts_of(batch):
                found = np.concatenate([np.zeros(0, np.uint64), *tokens(texts)])
                found = np.sort(found >> np.uint64(32 - buckets_log2))  # bucket and 32 more bits
                found = found[np.concatenate([np.ones(min(most, len(found)), bool), found[most:] != found[:-most]])]
                bucket = (found >> np.uint64(32)).astype(np.int64)
                cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
                low = (found & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes()
                ends = [*cuts[1:].tolist(), len(found)]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts].astype(np.int32)), pa.array([low[4 * a : 4 * b] for a, b in zip(cuts.tolist(), ends, strict=False)], pa.binary())], names=["bucket", "tokens"])

    def count(table: pa.Table) -> pa.Table:
        found = np.sort(np.frombuffer(b"".join(table.column("tokens").to_pylist()), "<u4"))
        first = np.flatnonzero(np.diff(found.astype(np.int64), prepend=-1))
        times = np.diff(np.append(first, len(found)))
        bits = []
        for least in levels:
            held = np.zeros(1 << (slots_log2 - buckets_log2), bool)
            held[found[first[times >= least]] >> np.uint32(32 - slots_log2 + buckets_log2)] = True
            bits.append(np.packbits(held, bitorder="little").tobytes())
        del found, first, times
        release()
        return pa.table({"bucket": table.column("bucket")[:1].cast(pa.int32()), "bits": pa.array([bits], pa.list_(pa.binary()))})

    sent = docs.select("text").mapInArrow(tidy(send), "bucket int, tokens binary")
    chunks = write(sent.groupBy("bucket").applyInArrow(count, "bucket int, bits array<binary>"), "counts")
    maps = [np.zeros(1 << (slots_log2 - 3), np.uint8) for _ in levels]
    size = 1 << (slots_log2 - buckets_log2 - 3)
    for row in chunks.frame.toLocalIterator():
        for held, bits in zip(maps, row["bits"], strict=True):
            held[row["bucket"] * size : (row["bucket"] + 1) * size] = np.frombuffer(bits, np.uint8)
    chunks.drop()
    return maps


def held(bits: np.ndarray, tokens: np.ndarray, slots_log2: int = SLOTS_LOG2) -> np.ndarray:
    """Whether each token's bit is set, as 0 or 1."""
    slot = (tokens >> np.uint64(64 - slots_log2)).astype(np.int64)
    return (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1


def bitmap(rows: DataFrame, token, slots_log2: int) -> np.ndarray:
    """A bitmap with the bit of every value of the long column ``token`` set; its words are made by a distributed ``bit_or``."""
    slot = F.shiftrightunsigned(token, 64 - slots_log2)
    words = rows.select(F.shiftright(slot, 5).cast("int").alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(31)).cast("int")).alias("b"))
    out = np.zeros(1 << (slots_log2 - 5), "<u4")
    for batch in words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow().to_batches():
        out[batch.column(0).to_numpy()] = batch.column(1).to_numpy().astype("<u4")
    return out.view(np.uint8)
