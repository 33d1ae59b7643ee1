"""Plain Python versions of the contracts, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def quality_base(text: str | None) -> tuple[int, int, int, int, int, bool]:
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(grams)
    stand = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(3)}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(stand), n < 50 or 100 * len(stand) > 50 * n


KINDS = (
    ("assign", re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 8, 2),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 16, 0),
    ("hex", re.compile(r"[0-9a-f]+"), 32, 0),
)


def secrets_base(text: str | None) -> str:
    found = [(m.start(), i, k, m.end()) for i, (k, rx, least, g) in enumerate(KINDS) for m in rx.finditer(text or "") if len(m[g]) >= least]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(found))


def chat(rows: list[tuple[str | None, str | None]]) -> tuple[int, str, int, str]:
    turns = [(r or "", t or "") for r, t in rows]
    loss = "".join(t for r, t in turns if r == "assistant")
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(turns), digest("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), digest(loss)


def shingles(text: str | None) -> frozenset:
    words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in WORD.findall(text or "")]
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def components(docs: list[tuple[int, str | None]]) -> dict[int, tuple[int, int]]:
    sets = {d: shingles(t) for d, t in docs}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: (len(sets[d]), root(d)) for d in ids}


def repeats(docs: list[tuple[int, str | None]], n: int = 50) -> dict[int, tuple[int, int, int, str]]:
    raw = {d: (t or "").encode() for d, t in docs}
    least: dict[bytes, int] = {}
    for d in sorted(raw, reverse=True):
        for i in range(len(raw[d]) - n + 1):
            least[raw[d][i : i + n]] = d
    out = {}
    for d, b in raw.items():
        gone = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if least[b[i : i + n]] < d:
                gone[i : i + n] = b"\1" * n
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out[d] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


def sentences(text: str, long: int = 16) -> list[str]:
    """A mark and the blank behind it, a mark of scripts without blanks, or a line break ends a sentence; long ones are cut behind words."""
    out: list[str] = []
    for sentence in re.findall("(?s).+?(?:[.!?][ \t\r\n]|[\u3002\uff01\uff1f\u0964]|\n|\\Z)", text):
        words = re.findall("(?s)[\u2e80-\uffff]|[^ \u2e80-\uffff]+ ?| ", sentence)
        at = 0
        for k, word in enumerate(words, 1):
            if len(words) <= long:
                continue
            if (ord(word[0]) * 5 + len(word) * 11) % 16 < 3 and k < len(words):
                out.append("".join(words[at:k]))
                at = k
        out.append("".join(words[at:]))
    return out


def spans(docs: list[tuple[int, str | None]], split, run: int) -> dict[int, list[int]]:
    """The sentence numbers that a non-first repeated run covers."""
    first: dict[tuple, tuple[int, int]] = {}
    cut = {d: split(t or "") for d, t in docs}
    for d in sorted(cut):
        for i in range(len(cut[d]) - run + 1):
            first.setdefault(tuple(cut[d][i : i + run]), (d, i))
    gone = defaultdict(set)
    for d, s in cut.items():
        for i in range(len(s) - run + 1):
            if first[tuple(s[i : i + run])] != (d, i):
                gone[d] |= set(range(i, i + run))
    return {d: sorted(gone[d]) for d in cut}
