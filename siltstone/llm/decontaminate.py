"""Benchmark decontamination by the q-gram lemma: shared q-grams counted in overlapping diagonal bands, banded alignment on what is left."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, partial

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, unused

#: Characters of a q-gram; the second is for short passages whose edits would leave none of the first.
Q, SHORT_Q = 8, 5
#: Edits allowed for each character of a passage.
EDIT_SHARE = 0.1
#: Items of over PASSAGE characters are passages of so many, one every STEP; an item up to twice that is one passage too.
PASSAGE, STEP = 100, 25
#: Characters of benchmark text that one pass over the documents carries, and passes between tables that cut the lineage.
BLOCK_CHARS, PASSES = 2_000_000, 4
#: Characters of documents that are looked at together; a longer document goes in slices that overlap.
SLICE = 1_000_000
_B = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)]
_BITS = 22
_EMPTY = np.array([], np.int64)


def normal(text: str) -> str:
    """Lower case, white space runs as one space, trimmed."""
    return " ".join(text.lower().split())


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def qgrams(codes: np.ndarray, q: int = Q) -> np.ndarray:
    """64-bit hashes of the runs of q characters, by doubling, then one by one."""
    one = codes.astype(np.uint64) + np.uint64(1)
    one *= np.uint64(0xFF51AFD7ED558CCD)
    one ^= one >> np.uint64(32)
    h, size = one, 1
    while size < q:
        step = size if 2 * size <= q else 1
        h = h[:-step] * _B[size.bit_length() - 1] + (h if step == size else one[size - 1 :])[step:]
        h ^= h >> np.uint64(29)
        size += step
    return h


def spans_of(n: int) -> list[tuple[int, int]]:
    """The passages that an item of n characters is sought as."""
    if n <= PASSAGE:
        return [(0, n)]
    windows = [(a, a + PASSAGE) for a in [*range(0, n - PASSAGE, STEP), n - PASSAGE]]
    return windows + [(0, n)] * (n <= 2 * PASSAGE)


def edits_of(n: int, share: float) -> tuple[int, int]:
    """(q, edits) of a passage of n characters: its full budget with the greater q if that leaves a q-gram, else with the lesser; fewer edits only if neither does."""
    k = int(share * n)
    while True:
        for q in (Q, SHORT_Q):
            if n + 1 - q - k * q >= 1 or k == 0:
                return q, k
        k -= 1


@dataclass
class Passages:
    """Passages of items with their q-gram index. budget: edits allowed; need: q-grams that survive them at least."""

    q: int
    items: np.ndarray
    codes: list[np.ndarray]
    budget: np.ndarray
    need: np.ndarray
    grams: np.ndarray
    first: np.ndarray
    passage: np.ndarray
    place: np.ndarray
    bitmap: np.ndarray

    @classmethod
    def of(cls, items: list[tuple[int, np.ndarray]], q: int = Q, share: float = EDIT_SHARE) -> Passages:
        """Of (item, characters) those passages that are sought by q-grams of q."""
        ids, codes, budget = [], [], []
        for item, c in items:
            for a, b in spans_of(len(c)):
                own, k = edits_of(b - a, share)
                if own == q:
                    ids.append(item)
                    codes.append(c[a:b])
                    budget.append(k)
        budget = np.array(budget, np.int64)
        sizes = np.array([len(c) for c in codes], np.int64)
        hashes = [qgrams(c, q) for c in codes]
        flat = np.concatenate(hashes) if hashes else np.array([], np.uint64)
        passage = np.repeat(np.arange(len(codes)), [len(h) for h in hashes])
        place = np.concatenate([np.arange(len(h)) for h in hashes]) if hashes else _EMPTY
        order = np.argsort(flat, kind="stable")
        grams, first = np.unique(flat[order], return_index=True)
        bitmap = np.zeros(1 << _BITS, bool)
        bitmap[(grams >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        return cls(q, np.array(ids), codes, budget, sizes + 1 - q - budget * q, grams, np.r_[first, len(flat)], passage[order].astype(np.int64), place[order].astype(np.int64), bitmap)

    def candidates(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, least diagonal, greatest diagonal) of the bands that the lemma leaves."""
        if len(codes) < self.q or not len(self.grams):
            return _EMPTY, _EMPTY, _EMPTY
        h = qgrams(codes, self.q)
        at = np.flatnonzero(self.bitmap[(h >> np.uint64(64 - _BITS)).astype(np.int64)])
        j = np.searchsorted(self.grams, h[at])
        j[j == len(self.grams)] = 0
        true = self.grams[j] == h[at]
        at, j = at[true], j[true]
        n = self.first[j + 1] - self.first[j]
        if not n.sum():
            return _EMPTY, _EMPTY, _EMPTY
        entry = np.repeat(self.first[j] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        which = self.passage[entry]
        diagonal = np.repeat(at, n) - self.place[entry] + (1 << 20)
        step = self.budget[which] + 1
        # Hits of one alignment differ by budget diagonals at most, so one of two overlapping bands of twice step has them all.
        keys = np.concatenate([which << 32 | diagonal // (2 * step) << 1, which << 32 | (diagonal + step) // (2 * step) << 1 | 1])
        ordered = np.sort(keys)
        begin = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
        bands, counts = ordered[begin], np.diff(np.r_[begin, len(ordered)])
        bands = bands[counts >= self.need[bands >> 32]]
        if not len(bands):
            return _EMPTY, _EMPTY, _EMPTY
        inverse = np.searchsorted(bands, keys)
        inverse[inverse == len(bands)] = 0
        some = np.flatnonzero(bands[inverse] == keys)
        # A q-gram that the text repeats counted more than once; what the lemma asks for are places of the passage.
        _, once = np.unique(keys[some] << 8 | np.concatenate([self.place[entry], self.place[entry]])[some], return_index=True)
        left = np.bincount(inverse[some[once]], minlength=len(bands)) >= self.need[bands >> 32]
        lo, hi = np.full(len(bands), 1 << 40), np.full(len(bands), -1)
        both = np.concatenate([diagonal, diagonal])
        np.minimum.at(lo, inverse[some], both[some])
        np.maximum.at(hi, inverse[some], both[some])
        which_band = bands >> 32
        return which_band[left], lo[left] - (1 << 20), hi[left] - (1 << 20)


def banded_edits(passage: np.ndarray, text: np.ndarray, lo: int, hi: int, budget: int) -> tuple[int, int]:
    """The fewest edits between the passage and any stretch of text whose alignment stays on diagonals lo - budget to hi + budget, and where that stretch ends.

    More than budget edits are given as budget + 1.
    """
    lo, hi = lo - budget, hi + budget
    width = hi - lo + 1
    ladder = np.arange(width)
    far = budget + 1
    # Column c of row i is text position i + lo + c, exclusive; an alignment may begin anywhere.
    ends = lo + ladder
    row = np.where((ends >= 0) & (ends <= len(text)), 0, far)
    padded = np.full(len(passage) + width + 1, 0xFFFFFFFF, np.uint32)
    a, b = max(lo, 0), min(len(text), len(passage) + hi + 1)
    if a < b:
        padded[a - lo : b - lo] = text[a:b]
    for i, c in enumerate(passage):
        # from row i to i + 1: the same column is a match or replacement, the next one a character of the passage left out
        step = row + (padded[i : i + width] != c)
        step[:-1] = np.minimum(step[:-1], row[1:] + 1)
        row = np.minimum(np.minimum.accumulate(step - ladder) + ladder, far)
        if row.min() >= far:
            return far, -1
    end = int(row.argmin())
    return int(row[end]), len(passage) + lo + end


class Benchmark:
    """Items ready to be sought: passages by their q, and items of under Q characters, which are found as they are between other than word characters."""

    def __init__(self, items: list[tuple[int, str]], share: float = EDIT_SHARE) -> None:
        texts = [(i, normal(t or "")) for i, t in items]
        coded = [(i, _codes(t)) for i, t in texts]
        long = [(i, c) for i, c in coded if len(c) >= Q]
        self.passages = [p for p in (Passages.of(long, q, share) for q in (Q, SHORT_Q)) if len(p.items)]
        short: dict[str, list[int]] = {}
        for (i, t), (_, c) in zip(texts, coded):
            if t and len(c) < Q:
                short.setdefault(t, []).append(i)
        self.short = None
        if short:
            self.short = ahocorasick.Automaton()
            for t, ids in short.items():
                self.short.add_word(t, (t, ids))
            self.short.make_automaton()

    def short_matches(self, text: str) -> Iterator[tuple[int, int, int, int]]:
        word = lambda c: c.isalnum() or c == "_"
        for last, (t, ids) in self.short.iter(text) if self.short else ():
            start, end = last + 1 - len(t), last + 1
            if not (start and word(text[start - 1])) and not (end < len(text) and word(text[end])):
                yield from ((i, start, end, 0) for i in ids)


@lru_cache(maxsize=PASSES)
def _ready(items: tuple[tuple[int, str], ...], share: float) -> Benchmark:
    """A worker builds the index of a block once, for all its tasks."""
    return Benchmark(list(items), share)


def matches(text: str, benchmark: Benchmark) -> list[tuple[int, int, int, int]]:
    """(item, start, end, edits) of each passage found, positions in the normalised text, sorted; start is where its band begins."""
    return matches_of([text], benchmark)[0]


def matches_of(texts: list[str], benchmark: Benchmark) -> list[list[tuple[int, int, int, int]]]:
    found: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
    overlap = 4 * PASSAGE + 64
    pieces: list[tuple[int, int, np.ndarray]] = []
    held = 0

    def search() -> None:
        for passages in benchmark.passages:
            _search(pieces, passages, found)

    for d, t in enumerate(texts):
        t = normal(t)
        found[d] += benchmark.short_matches(t)
        codes = _codes(t)
        for a in range(0, max(len(codes), 1), SLICE):
            piece = codes[max(0, a - overlap) : a + SLICE]
            pieces.append((d, max(0, a - overlap), piece))
            held += len(piece)
            if held >= SLICE:
                search()
                pieces, held = [], 0
    if pieces:
        search()
    return [sorted(set(f)) for f in found]


def _search(pieces: list[tuple[int, int, np.ndarray]], passages: Passages, found: list) -> None:
    gap = np.full(Q, 0xFFFFFFFE, np.uint32)
    starts = np.cumsum([0] + [len(p) + Q for _, _, p in pieces])
    flat = np.concatenate([x for _, _, p in pieces for x in (p, gap)])
    which, lows, highs = passages.candidates(flat)
    for p, lo, hi in zip(which.tolist(), lows.tolist(), highs.tolist()):
        code, budget = passages.codes[p], int(passages.budget[p])
        ends = np.searchsorted(starts, (lo - budget, hi + len(code) + budget), side="right") - 1
        for k in range(max(0, int(ends[0])), min(len(pieces) - 1, int(ends[1])) + 1):
            d, offset, piece = pieces[k]
            at = int(starts[k])
            if len(piece) < len(code) - budget:
                continue
            if lo == hi and at <= lo <= at + len(piece) - len(code) and np.array_equal(flat[lo : lo + len(code)], code):
                edits, end = 0, lo - at + len(code)
            else:
                edits, end = banded_edits(code, piece, lo - at, hi - at, budget)
            if edits <= budget:
                found[d].append((int(passages.items[p]), offset + max(0, end - len(code) - edits), offset + end, edits))


def _find(batches: Iterator[pa.RecordBatch], items: tuple[tuple[int, str], ...], share: float, text_col: str, out: str) -> Iterator[pa.RecordBatch]:
    spans = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int64())]))
    benchmark = _ready(items, share)
    for batch in batches:
        texts = batch.column(batch.schema.names.index(text_col))
        got: list = []
        for i in range(0, len(texts), 256):
            got += matches_of([t.as_py() or "" for t in texts[i : i + 256]], benchmark)
        rows = [[{"item_id": a, "start": b, "end": c, "edits": e} for a, b, c, e in g] for g in got]
        rest = [(c, n) for c, n in zip(batch.columns, batch.schema.names) if n != text_col]
        yield pa.RecordBatch.from_arrays([*(c for c, _ in rest), pa.array(rows, spans)], names=[*(n for _, n in rest), out])


def item_blocks(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> Iterator[tuple[tuple[int, str], ...]]:
    """The benchmark's items in blocks of about block_chars characters, one at a time; null texts and ids are left out."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).alias("t")).dropna()
    total = items.agg(F.sum(F.char_length("t"))).first()[0] or 0
    n = max(1, math.ceil(total / block_chars))
    for i in range(n):
        block = items if n == 1 else items.where(F.pmod(F.xxhash64("item", "t"), F.lit(n)) == i)
        yield tuple(sorted((r["item"], r["t"]) for r in block.collect()))


def find_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", share: float = EDIT_SHARE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs with __spans: array of (item_id, start, end, edits), the passages of benchmark items found in the normalised text.

    Items of over PASSAGE characters are sought as passages of so many, one every STEP, so any stretch of an item of
    PASSAGE + STEP characters is found, and those up to twice PASSAGE as a whole too; shorter ones as a whole. A passage is
    found if a stretch of the text is within share times its length edits. By the q-gram lemma such a stretch has
    length + 1 - q - q * edits of its q-grams on diagonals no further apart than the edits; bands with fewer are left out,
    the others are aligned. q is Q, or SHORT_Q where Q would leave no q-gram; with a share of over a tenth a short passage may
    allow fewer edits, the most that leave one. Items of under Q characters are found where they stand unchanged between
    other than word characters; empty ones are not. Null text counts as empty, null items are left out. All rows and columns
    stay, but for a column of docs that is called __spans, which is replaced; an empty benchmark finds nothing.

    Tasks get a block of the benchmark's texts, of a checked size, and index it once a worker. Documents are read where they
    are; a benchmark of more than PASSES blocks writes them with what is found so far after every PASSES.
    """
    docs = docs.drop("__spans")
    out = docs.withColumn("__spans", F.array().cast("array<struct<item_id: bigint, start: bigint, end: bigint, edits: bigint>>"))
    for i, block in enumerate(item_blocks(benchmark, item_col, item_text_col, block_chars)):
        if i and i % PASSES == 0:
            out = durable(out)
        read, new = unused(out, "__text"), unused(out, "__new")
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema) + f", `{new}` array<struct<item_id: bigint, start: bigint, end: bigint, edits: bigint>>"
        out = out.withColumn(read, F.col(text_col)).mapInArrow(partial(_find, items=block, share=share, text_col=read, out=new), schema)
        out = out.withColumn("__spans", F.concat("__spans", new)).drop(new)
    return out
