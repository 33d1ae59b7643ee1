"""SentencePiece BPE encoding and decoding by suffix-array matching.

A batch's text, each of its words once, is indexed by a suffix array sorted to the length of the longest piece; every piece is binary-searched in it, which
gives a range of suffixes and so all places where the piece occurs. These edges, sorted by the place they end at, are relaxed from
left to right: at each place there is one edge whose piece may follow the piece that the relaxation chose at the edge's start, where
"may follow" means that merging the two pieces' characters by score gives these two pieces back. That chain is the BPE encoding.

No piece holds a space mark after another character, so a text falls into words (a run of space marks and what follows it) that are
encoded apart from each other. The indexed text therefore is not the batch's raw text but its distinct words, each once, in the order
in which they come; words seen before in the process are looked up. That departs from indexing every repetition and changes no result.
Both tables are emptied at a fixed size, so memory does not grow with the input. The model file is read once by the driver (half a
megabyte, sent with the task), never trained and never copied into the package.

Defined results: a null text encodes to null and decodes to null, an empty text to no ids and back to an empty text; characters
outside the vocabulary become their UTF-8 bytes; repeated rows are encoded alike; of merges that tie in score the leftmost comes first; a
text of any length is encoded as a whole; the character U+2581 decodes to a space, as in the model's own library; rows keep
their other columns, unless one is named like the output column, which is replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from inkwell.llm.counts import tidy

MARK = "▁"
#: Parts the words of an index; a private-use character.
SEPARATOR = "\ue000"
SLICE_CHARS = 1 << 20
MAX_WORDS = 200_000
MAX_PAIRS = 50_000
SLOT_BITS = 20
BLOCK_CHARS = 1 << 19
LONG_WORD = 4096


class Model:
    """The pieces, scores and byte ids of a BPE model."""

    def __init__(self, proto: bytes):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_proto=proto)
        plain = [i for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
        self.pieces = {i: m.id_to_piece(i) for i in plain}
        self.ids = {p: i for i, p in self.pieces.items()}
        self.score = {p: m.get_score(i) for p, i in self.ids.items()}
        self.bytes = [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.longest = max(map(len, self.ids))
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("this model has pieces that cross a word's start")
        table = [b""] * m.get_piece_size()
        for i, p in self.pieces.items():
            table[i] = p.replace(MARK, " ").encode()
        for b, i in enumerate(self.bytes):
            table[i] = bytes([b])
        self.unit_len = np.array([len(t) for t in table], np.int64)
        self.unit_at = np.concatenate([[0], np.cumsum(self.unit_len)[:-1]])
        self.units = np.frombuffer(b"".join(table), np.uint8)
        order = sorted(self.ids)
        self.order = np.array([self.ids[p] for p in order], np.int64)
        self.lengths = np.array([len(p) for p in order], np.int64)
        self.codes = np.full((len(order), self.longest), -1, np.int64)
        for k, p in enumerate(order):
            self.codes[k, : len(p)] = [ord(c) for c in p]
        self.pairs: dict[tuple[int, int], bool] = {}
        self.slot_key, self.slot_ok = np.full(1 << SLOT_BITS, -1, np.int64), np.zeros(1 << SLOT_BITS, bool)
        if "\n" in "".join(self.ids):
            raise ValueError("this model has pieces that hold a line break")

    def merge(self, text: str) -> list[str]:
        """BPE by its definition: join the best-scored neighbours, leftmost first, until none can be joined."""
        part, left, right = list(text), list(range(-1, len(text) - 1)), [*range(1, len(text)), -1]
        heap = [(-self.score[s], i, s) for i in range(len(part) - 1) if (s := part[i] + part[i + 1]) in self.score]
        heapq.heapify(heap)
        while heap:
            _, i, s = heapq.heappop(heap)
            j = right[i]
            if not part[i] or j < 0 or part[i] + part[j] != s:
                continue
            part[i], part[j], right[i] = s, "", right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for a, b in ((left[i], i), (i, right[i])):
                if a >= 0 and b >= 0 and (t := part[a] + part[b]) in self.score:
                    heapq.heappush(heap, (-self.score[t], a, t))
        return [p for p in part if p]

    def follows(self, a: int, b: int) -> bool:
        """Whether piece ``b`` may stand after piece ``a``; -1 stands for a word's start, -2 for a character without a piece."""
        if a == -2:
            return self.follows(-1, b)
        if (known := self.pairs.get((a, b))) is None:
            if len(self.pairs) > MAX_PAIRS:
                self.pairs.clear()
            parts = [self.pieces[x] for x in (a, b) if x >= 0]
            known = self.pairs[a, b] = self.merge("".join(parts)) == parts
        return known

    def edges(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(end, start, id) of every occurrence of every piece.

        The suffix array is sorted to the longest piece's length by keys that pack as many characters as a word holds; pieces are
        searched in it key by key, each in the range that its keys so far have left.
        """
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        letters, dense = np.unique(codes, return_inverse=True)
        bits = int(len(letters)).bit_length()
        per, n = 62 // bits, len(codes)
        place = np.searchsorted(letters, self.codes)
        known = (self.codes < 0) | (letters[np.minimum(place, len(letters) - 1)] == self.codes)
        alive = np.flatnonzero(known.all(1))  # a piece with a character that the text has not cannot occur
        spelled = np.where(self.codes[alive] < 0, 0, place[alive] + 1)
        padded = np.concatenate([dense + 1, np.zeros(self.longest + per, np.int64)]).astype(np.int64)
        width = -(-self.longest // per)
        keys = []
        for k in range(width):
            key = np.zeros(n, np.int64)
            for c in range(k * per, (k + 1) * per):
                key = key << bits | padded[c : c + n]
            keys.append(key)
        suffixes = np.lexsort(keys[::-1])
        lo, hi = np.zeros(len(alive), np.int64), np.full(len(alive), n, np.int64)
        length = self.lengths[alive]
        for k, key in enumerate(keys):
            todo = np.flatnonzero((length > k * per) & (lo < hi))
            if not len(todo):
                break
            least, span = np.zeros(len(todo), np.int64), np.ones(len(todo), np.int64)
            for c in range(k * per, (k + 1) * per):
                least = least << bits | (spelled[todo, c] if c < self.longest else 0)
                span = np.where(c < length[todo], 1, span << bits)
            ordered = key[suffixes]
            for bound, wanted in ((lo, least), (hi, least + span)):
                if k == 0:
                    bound[todo] = np.searchsorted(ordered, wanted)
                    continue
                x, y = (first[todo].copy(), last[todo].copy()) if bound is hi else (lo[todo].copy(), hi[todo].copy())
                if bound is lo:
                    first, last = lo.copy(), hi.copy()
                while (open_ := x < y).any():
                    mid = np.minimum((x + y) // 2, n - 1)
                    less = ordered[mid] < wanted
                    x, y = np.where(open_ & less, mid + 1, x), np.where(open_ & ~less, mid, y)
                bound[todo] = x
        count = hi - lo
        which = np.repeat(np.arange(len(count)), count)
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count - lo, count)
        start = suffixes[at]
        return start + length[which], start, self.order[alive][which]

    def may_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``follows`` for arrays, through a table of fixed size in which a newer pair takes an older one's slot."""
        key = (a + 2) * (len(self.unit_len) + 1) + b
        slot = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        out = self.slot_ok[slot]
        miss = np.flatnonzero(self.slot_key[slot] != key)
        if len(miss):
            ask, inverse = np.unique(key[miss], return_inverse=True)
            rows = np.empty(len(ask), np.int64)
            rows[inverse] = miss
            said = np.fromiter((self.follows(x, y) for x, y in zip(a[rows].tolist(), b[rows].tolist(), strict=True)), bool, len(rows))
            out[miss] = said[inverse]
            self.slot_key[slot[rows]], self.slot_ok[slot[rows]] = key[rows], said
            # two new pairs of one slot: the key must belong to the answer beside it
            self.slot_key[slot[rows[self.slot_key[slot[rows]] != key[rows]]]] = -1
        return out

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, number of ids of each)."""
        if any(SEPARATOR in w for w in words):  # no piece holds it: its parts are words of the index, and it is written as bytes
            parts = [w.split(SEPARATOR) for w in words]
            own = sorted({p for w in parts for p in w if p})
            ids, counts = self.encode_words(own)
            known = dict(zip(own, np.split(ids, np.cumsum(counts)[:-1]), strict=True)) | {"": np.zeros(0, np.int32)}
            between = np.array([self.bytes[b] for b in SEPARATOR.encode()], np.int32)
            got = [np.concatenate([x for k, p in enumerate(w) for x in ([between] * (k > 0) + [known[p]])]) for w in parts]
            return np.concatenate([np.zeros(0, np.int32), *got]).astype(np.int32), np.array([len(g) for g in got], np.int64)
        if not words:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        text = SEPARATOR.join(words) + SEPARATOR
        end, start, ids = self.edges(text)
        size = np.array([len(w) for w in words], np.int64)
        begin = np.cumsum(size + 1) - size - 1
        last, back = np.full(len(text) + 1, -3, np.int64), np.zeros(len(text) + 1, np.int64)
        last[begin] = -1
        bare = np.ones(len(text) + 1, bool)
        bare[start[end - start == 1]] = False
        bare[begin + size] = bare[-1] = False
        if int(size.max()) > LONG_WORD:
            self._relax_one_by_one(len(text), end, start, ids, last, back, bare)
        else:
            place = np.arange(len(text) + 1) - np.repeat(np.append(begin, len(text)), np.append(size + 1, 1))  # of each boundary in its word
            depth = place[end].astype(np.int16)
            by = np.argsort(depth, kind="stable")
            end, start, ids, depth = end[by], start[by], ids[by], depth[by]
            cuts = np.searchsorted(depth, np.arange(1, int(size.max()) + 2))
            for d, (x, y) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True), 1):
                ok = self.may_follow(last[start[x:y]], ids[x:y])
                last[end[x:y][ok]], back[end[x:y][ok]] = ids[x:y][ok], start[x:y][ok]
                loose = begin[size >= d] + d
                loose = loose[bare[loose - 1]]
                last[loose], back[loose] = -2, loose - 1
        at, of, chain = begin + size, np.arange(len(words)), []
        while len(at):
            chain.append((of, last[at], at))
            at = back[at]
            more = at > begin[of]
            at, of = at[more], of[more]
        of, got, at = (np.concatenate(c) for c in zip(*chain, strict=True))
        by = np.lexsort((at, of))
        of, got, at = of[by], got[by], at[by]
        if (got == -2).any():  # characters without a piece become their bytes
            spelled = [[self.bytes[b] for b in text[e - 1].encode("utf-8", "replace")] for e in at[got == -2].tolist()]
            times = np.ones(len(got), np.int64)
            times[got == -2] = [len(x) for x in spelled]
            of, got = np.repeat(of, times), np.repeat(got, times)
            got[got == -2] = [i for x in spelled for i in x]
        return got.astype(np.int32), np.bincount(of, minlength=len(words))

    def _relax_one_by_one(self, n, end, start, ids, last, back, bare) -> None:
        """The same relaxation edge by edge, for an index with a word so long that a step per place of a word would be slower."""
        by = np.lexsort((start, end))
        end, start, ids = end[by], start[by], ids[by]
        k, ends, starts, pieces, chosen, origin, m = 0, end.tolist(), start.tolist(), ids.tolist(), last.tolist(), back.tolist(), len(end)
        for e in range(1, n):
            while k < m and ends[k] == e:
                if chosen[e] == -3 and self.follows(chosen[starts[k]], pieces[k]):
                    chosen[e], origin[e] = pieces[k], starts[k]
                k += 1
            if chosen[e] == -3 and bare[e - 1]:
                chosen[e], origin[e] = -2, e - 1
        last[:], back[:] = chosen, origin

    def decode(self, ids: np.ndarray) -> bytes:
        return _gather(self.units, self.unit_at[ids], self.unit_len[ids]).tobytes()


def _gather(pool: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The pool's slices one after another."""
    ends = np.cumsum(length)
    return pool[np.repeat(at - (ends - length), length) + np.arange(int(ends[-1]) if len(ends) else 0)]


class Encoder:
    """Words of a process seen so far, each with its place in a pool of ids."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.at, self.length, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def learn(self, words: set[str]) -> None:
        if len(self.known) + len(words) > MAX_WORDS:
            self.clear()
        # sorted, so that a rerun meets the same order; in blocks, so that the index stays small; long words come last in one of their own
        todo = sorted(words)
        if max(map(len, todo)) > LONG_WORD:
            todo.sort(key=lambda w: len(w) > LONG_WORD)
        size = np.cumsum([len(w) + 1 for w in todo])
        block = size // BLOCK_CHARS + (size[-1] + 1) * np.array([len(w) > LONG_WORD for w in todo])
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(todo)]
        ids, lengths = (np.concatenate(x) for x in zip(*(self.model.encode_words(todo[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)), strict=True))
        self.known |= dict(zip(todo, range(len(self.at), len(self.at) + len(todo)), strict=True))
        self.at = np.concatenate([self.at, len(self.pool) + np.cumsum(lengths) - lengths])
        self.length = np.concatenate([self.length, lengths])
        self.pool = np.concatenate([self.pool, ids])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        words: list[str] = []
        counts = []
        for t in texts:
            split = words_of(t) if t else []
            words += split
            counts.append(len(split))
        distinct = set(words)
        if new := distinct - self.known.keys():
            if len(self.known) + len(new) > MAX_WORDS:
                self.clear()
                new = distinct
            self.learn(new)
        index = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        length = self.length[index]
        ids = _gather(self.pool, self.at[index], length)
        upto = np.concatenate([[0], np.cumsum(length)])[np.cumsum([0, *counts])]
        return ids, np.diff(upto)


WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def words_of(text: str) -> list[str]:
    """The text with a mark before it and for each space, cut before every run of marks and around line breaks, which have no piece."""
    marked = MARK + text.replace(" ", MARK)
    out: list[str] = []
    for k, line in enumerate(marked.split("\n")):
        if k:
            out.append("\n")
        if not line:
            continue
        if MARK + MARK in line or line[-1] == MARK:
            out += WORD.findall(line)
        else:
            first, *rest = line.split(MARK)
            if first:
                out.append(first)
            out += [MARK + w for w in rest]
    return out


def _slices(batch: pa.RecordBatch, sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    at, total = 0, 0
    for k, n in enumerate(sizes):
        if total and total + n > limit:
            yield at, k
            at, total = k, 0
        total += n
    if at < len(sizes):
        yield at, len(sizes)


_models: dict[int, Encoder] = {}


def _encoder(proto: bytes) -> Encoder:
    key = hash(proto)
    if key not in _models:
        _models.clear()
        _models[key] = Encoder(Model(proto))
    return _models[key]


def _appended(frame: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([f for f in frame.schema.fields if f.name.lower() != name.lower()] + [T.StructField(name, kind)])


def _with(batch: pa.RecordBatch, keep: list[str], column: pa.Array, name: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), column], names=[*keep, name])


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _texts(model: Model, flat: np.ndarray, lengths: np.ndarray, nulls: list[bool]) -> pa.Array:
    """The texts of ids that stand one text after another; the first text's space mark goes."""
    size = model.unit_len[flat]
    raw = _gather(model.units, model.unit_at[flat], size).tobytes()
    upto = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(lengths)])].tolist()
    texts = [None if null else raw[x + (raw[x : x + 1] == b" ") : y].decode("utf-8", "replace") for null, x, y in zip(nulls, upto[:-1], upto[1:], strict=True)]
    return pa.array(texts, pa.string())


def encode(docs: DataFrame, proto: bytes, text: str = "text", out: str = "ids", back: str | None = None) -> DataFrame:
    """``docs`` with an array of ids in ``out`` and, if named, the text decoded from them in ``back``.

    No shuffle; a task holds a slice of about ``SLICE_CHARS`` characters.
    """
    schema = _appended(docs, out, T.ArrayType(T.IntegerType()))
    if back:
        schema = T.StructType([f for f in schema.fields if f.name.lower() != back.lower()] + [T.StructField(back, T.StringType())])
    keep = [n for n in schema.names if n not in (out, back)]

    def run(batches):
        encoder = _encoder(proto)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
            for a, b in _slices(batch, sizes, SLICE_CHARS):
                part = column.slice(a, b - a)
                ids, lengths = encoder.encode(part.to_pylist())
                nulls = part.is_null()
                offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32), mask=np.append(nulls.to_numpy(zero_copy_only=False), False))
                coded = _with(batch.slice(a, b - a), keep, pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32())), out)
                yield coded.append_column(back, _texts(encoder.model, ids, lengths, nulls.to_pylist())) if back else coded
        encoder.clear()  # Spark keeps the process for later tasks

    return docs.mapInArrow(tidy(run), schema)


def decode(docs: DataFrame, proto: bytes, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``docs`` with the text of the ids in ``out``. Bytes that form no character are replaced by U+FFFD."""
    schema = _appended(docs, out, T.StringType())
    keep = schema.names[:-1]

    def run(batches):
        model = _encoder(proto).model
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids))
            sizes = pc.fill_null(pc.list_value_length(column), 0).to_pylist()
            for a, b in _slices(batch, sizes, SLICE_CHARS):
                part = column.slice(a, b - a)
                lengths = np.array(sizes[a:b], np.int64)
                flat = part.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                yield _with(batch.slice(a, b - a), keep, _texts(model, flat, lengths, part.is_null().to_pylist()), out)

    return docs.mapInArrow(tidy(run), schema)
