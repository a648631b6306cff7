"""SimHash near-duplicates: fingerprints linked by fuzzy Golay keys, then verified."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import durable, parts, unused
from .components import components
from .golay import near_indices

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
SEED = 42
#: (first bit, width) of a fingerprint's segments; each fits a word of the code.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: For near-duplicates: words of a shingle, seeds of the fingerprints over single words, and the bits in which fingerprints over shingles may differ, a fifth.
NEAR_SHINGLE, WORD_SEEDS, FAR_BITS = 5, (42, 43), 12
#: Rows of one key that a task compares; a key with more is dealt out as pairs of blocks of this size.
BLOCK = 4_096
#: Verified pairs that a task holds before it reduces them to stars.
HELD = 1_000_000
#: MinHash bands and the hashes of each: at a similarity of 0.8 a pair shares a band but for 1 in 14,000, at 0.3 once in 18.
BANDS, BAND_ROWS = 24, 5
_FACTORS, _TERMS = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * BAND_ROWS, 1), np.uint64)
_FACTORS |= np.uint64(1)
#: Equal bytes of two sketches from which on a pair that meets in a band is a candidate: 0.62, five deviations under a similarity of 0.8.
SAME_BYTES = 75
#: Shingles that a task compares as one group; candidates with more are dealt out as pairs of blocks of half as many.
SHINGLES_HELD = 1_000_000


def shingle_set(text: bytes, shingle: int = NEAR_SHINGLE) -> np.ndarray:
    """The sorted distinct XXH64 of a UTF-8 text's shingles, A-Z taken as a-z; of a text with fewer words, that of all its words."""
    words = WORDS.findall(text.translate(LOWER))
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else [], np.uint64)
    joined = b" ".join(words)
    ends = (np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1).tolist()
    starts = [0] + [e + 1 for e in ends[:-1]]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter([digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :])], np.uint64))


def bands(hashes: np.ndarray) -> tuple[list[int], bytes]:
    """The keys of a set's MinHash bands, and its sketch, a byte of each of their hashes. None of an empty set.

    Two sets share a band with the probability 1 - (1 - Jaccard ** BAND_ROWS) ** BANDS, and the share of equal bytes is Jaccard, give or take 0.04.
    """
    if not len(hashes):
        return [], b""
    least = np.full(BANDS * BAND_ROWS, ~np.uint64(0))
    for i in range(0, len(hashes), 4_096):
        np.minimum(least, (hashes[i : i + 4_096] * _FACTORS + _TERMS).min(axis=1), out=least)
    return [xxhash.xxh64_intdigest(least[k * BAND_ROWS : (k + 1) * BAND_ROWS].tobytes(), k) for k in range(BANDS)], (_mixed(least) >> np.uint64(56)).astype(np.uint8).tobytes()


def _mixed(h: np.ndarray) -> np.ndarray:
    """Hashes with their bits spread, so that the highest byte of a least one isn't always small."""
    return (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)


def _set_node(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED)


def fingerprint(text: bytes, shingle: int) -> int:
    """The 64-bit SimHash of a UTF-8 text's shingles, A-Z taken as a-z; 0 without words."""
    words = WORDS.findall(text.translate(LOWER))
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = (np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1).tolist()
    starts = [0] + [e + 1 for e in ends[:-1]]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter([digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :])], np.uint64)
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65_536):
        total += np.unpackbits(hashes[i : i + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        marks = [fingerprint((t.as_buffer().to_pybytes() if t.is_valid else b""), shingle) for t in batch.column(1)]
        signed = np.array(marks, np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(signed)], names=["id", "fp"])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t")).mapInArrow(partial(_fingerprints, shingle=shingle), f"id {kind}, fp bigint")


def fuzzy_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, keys): two fingerprints at 4 or fewer differing bits have a key in common.

    Four errors fall on three segments. Either two segments have one error at most each: then what the one's first segment
    decodes to is among the other's six, and the other way round for the second; so both make the key of (six of the first,
    decoded second) and of (decoded first, six of the second). Or the errors are 2, 2 and 0: the third segments are equal, and
    words at distance 2 have one of their six codewords in common; the whole third segment with each of the next one's six makes the keys.
    """
    segs = [((fps >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in SEGMENTS]
    near = [near_indices(s) for s in segs]
    n = np.arange(len(fps))
    where, keys = [], []
    pairs = [(s[:, None], near[(k + 1) % 3]) for k, s in enumerate(segs)]
    pairs += [p for a, b in ((0, 1), (0, 2), (1, 2)) for p in ((near[a], near[b][:, :1]), (near[a][:, :1], near[b]))]
    for kind, (x, y) in zip((0, 1, 2, 3, 3, 4, 4, 5, 5), pairs):
        key = np.int64(kind << 40) | x << 12 | y
        fresh = np.ones(key.shape, bool)
        fresh[:, 1:] = key[:, 1:] != key[:, :1]  # a word near one codeword has it six times
        where.append(np.broadcast_to(n[:, None], key.shape)[fresh])
        keys.append(key[fresh])
    return np.concatenate(where), np.concatenate(keys)


def _keyed(batches: Iterator[pa.RecordBatch], n_keyed: int) -> Iterator[pa.RecordBatch]:
    """Rows of (node, fingerprints...), or of one column that is both, to a row for each key of the first n_keyed fingerprints: the key, the node, the fingerprint that the key is of, and those without keys."""
    for batch in batches:
        columns = [c.to_numpy() for c in batch.columns]
        alone = len(columns) == 1
        for i in range(0, len(columns[0]), 20_000):
            for k, mark in enumerate(columns if alone else columns[1 : 1 + n_keyed]):
                where, keys = fuzzy_keys(mark[i : i + 20_000].view(np.uint64))
                carried = columns if alone else [columns[0], mark, *columns[1 + n_keyed :]]
                yield pa.RecordBatch.from_arrays([pa.array(keys | np.int64(k << 48)), *(pa.array(c[i : i + 20_000][where]) for c in carried)], names=["key", *_carried(batch.schema.names, n_keyed)])


def _carried(columns: list[str], n_keyed: int) -> list[str]:
    return columns if len(columns) == 1 else [columns[0], "mark", *columns[1 + n_keyed :]]


class Stars:
    """Links of fingerprints, reduced to (member, least member of its group)."""

    def __init__(self) -> None:
        self.a, self.b, self.n = [], [], 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.a.append(a)
        self.b.append(b)
        self.n += len(a)
        if self.n > HELD:
            self.reduce()

    def reduce(self) -> None:
        if not self.n:
            return
        a, b = np.concatenate(self.a), np.concatenate(self.b)
        nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
        x, y = ends[: len(a)], ends[len(a) :]
        root = np.arange(len(nodes))
        while True:
            low = np.minimum(root[x], root[y])
            before = root.copy()
            for end in (x, y):
                np.minimum.at(root, root[end], low)
                np.minimum.at(root, end, low)
            while (root[root] != root).any():
                root = root[root]
            if (root == before).all():
                break
        others = root != np.arange(len(nodes))
        self.a, self.b = [nodes[others]], [nodes[root[others]]]
        self.n = int(others.sum())

    def out(self) -> tuple[np.ndarray, np.ndarray]:
        self.reduce()
        empty = np.array([], np.int64)
        return (self.a[0], self.b[0]) if self.n else (empty, empty)


def _link_sorted(keys: np.ndarray, columns: list[np.ndarray], near, stars: Stars) -> None:
    """Links rows of equal key, which stand together, by comparing each with the next, the next but one, and so on."""
    last = np.searchsorted(keys, keys, side="right")
    at, step = np.arange(len(keys)), 1
    nodes, marks = columns[0], [c.view(np.uint64) for c in (columns[1:] or columns)]
    while True:
        at = at[at + step < last[at]]
        if not len(at):
            return
        linked = at[near([np.bitwise_count(m[at] ^ m[at + step]) for m in marks]) & (nodes[at] != nodes[at + step])]
        if len(linked):
            stars.add(nodes[linked], nodes[linked + step])
        step += 1


def _link(batches: Iterator[pa.RecordBatch], near, block: int) -> Iterator[pa.RecordBatch]:
    """batches(key, node, ...) sorted by key. Gives (-1, member, root, ...) for links and the rows themselves, with a null root, of keys with more than block rows."""
    stars, held = Stars(), None
    over: int | None = None  # the key whose rows are passed on

    def passed(rows: list[np.ndarray]) -> pa.RecordBatch:
        key, node, *rest = map(pa.array, rows)
        return pa.RecordBatch.from_arrays([key, node, pa.nulls(len(node), pa.int64()), *rest], names=["key", "a", "b", *names])

    names: list[str] = []
    for batch in batches:
        names = batch.schema.names[2:]
        rows = [c.to_numpy() for c in batch.columns]
        if over is not None:
            n = int(np.searchsorted(rows[0], over, side="right"))
            if n:
                yield passed([r[:n] for r in rows])
            rows = [r[n:] for r in rows]
            if not len(rows[0]):
                continue
            over = None
        if held:
            rows = [np.concatenate(x) for x in zip(held, rows)]
        starts = np.flatnonzero(np.r_[True, rows[0][1:] != rows[0][:-1]])
        sizes = np.diff(np.r_[starts, len(rows[0])])
        large = np.repeat(sizes > block, sizes)
        if large.any():
            yield passed([r[large] for r in rows])
            if large[-1]:
                over = int(rows[0][-1])
            rows = [r[~large] for r in rows]
        end = len(rows[0]) if over is not None else int(np.searchsorted(rows[0], rows[0][-1]))
        _link_sorted(rows[0][:end], [r[:end] for r in rows[1:]], near, stars)
        held = [r[end:] for r in rows]
    if held:
        _link_sorted(held[0], held[1:], near, stars)
    a, b = stars.out()
    for i in range(0, len(a), 50_000):
        n = len(a[i : i + 50_000])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, -1)), pa.array(a[i : i + 50_000]), pa.array(b[i : i + 50_000]), *[pa.nulls(n, pa.int64())] * len(names)], names=["key", "a", "b", *names])


def _within(bits: int, distances: list[np.ndarray]) -> np.ndarray:
    return distances[0] <= bits


def _near_words_and_shingles(bits: int, distances: list[np.ndarray]) -> np.ndarray:
    words, shingles = distances
    return (words <= bits) & (shingles <= FAR_BITS)


def link_nodes(nodes: DataFrame, near, n_keyed: int = 1, block: int = BLOCK) -> DataFrame:
    """nodes(node, fingerprints...), or (fingerprint) alone, to (src, dst): edges that connect what links connect.

    Two nodes are linked if near says so of their distances in one of the first n_keyed fingerprints, which must be 4 bits or
    fewer, for which a common key is certain, and in those after. A task emits a star for each group that it finds, not the pairs within it. A
    key with more than block nodes is handed on: its rows are dealt into blocks, and each pair of blocks is one group of the
    second pass.
    """
    n = parts(nodes.sparkSession)
    columns = _carried(nodes.columns, n_keyed)
    longs = lambda names: ", ".join(f"{c} bigint" for c in names)
    schema = longs(["key", "a", "b", *columns[1:]])
    keyed = nodes.mapInArrow(partial(_keyed, n_keyed=n_keyed), longs(["key", *columns])).repartition(n, "key").sortWithinPartitions("key")
    first = durable(keyed.mapInArrow(partial(_link, near=near, block=block), schema))
    large = first.where("b is null").select("key", F.col("a").alias(columns[0]), *columns[1:])
    edges = first.where("b is not null").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    sizes = durable(large.groupBy("key").agg(F.ceil(F.count("*") * 2 / block).cast("int").alias("blocks")))
    if sizes.isEmpty():
        return edges
    own = F.pmod(F.xxhash64(columns[0]), F.col("blocks")).cast("int")
    dealt = large.join(sizes, "key").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    second = dealt.select(pair.alias("key"), *columns).repartition(n, "key").sortWithinPartitions("key").mapInArrow(partial(_link, near=near, block=1 << 40), schema)
    return edges.unionByName(second.select(F.col("a").alias("src"), F.col("b").alias("dst")))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, bits: int = 4, block: int = BLOCK) -> DataFrame:
    """One row for each input row: id, fingerprint (16 lowercase hex digits), component_id (the smallest id reachable by links).

    Words are runs of anything but ASCII white space, A-Z read as a-z; a fingerprint bit is 1 if over half of the shingles'
    XXH64 (seed 42) have it. A text with fewer words than a shingle is one shingle; null, empty and blank texts have
    fingerprint 0 and are linked like others. Ids are integers; a null id joins components but names none, unless all are
    null. Repeated rows stay. An empty table gives an empty result.

    Linking works on distinct fingerprints, so exact copies cost nothing beyond their own rows.
    """
    marks = durable(fingerprints(docs, id_col, text_col, shingle))
    by_fp = marks.groupBy("fp").agg(F.min("id").alias("least"))
    if not 0 <= bits <= 4:
        raise ValueError("the keys find up to 4 differing bits")
    roots = components(link_nodes(marks.select("fp").distinct(), partial(_within, bits), block=block))
    rooted = by_fp.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    leasts = durable(rooted.groupBy("root").agg(F.min("least").alias("component_id")))  # a table, so that a join can split a large component
    named = rooted.join(leasts, "root").select(F.col("fp").alias("named_fp"), "component_id")
    return marks.join(named, F.col("fp") == F.col("named_fp")).select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _three_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        marks: list[list[int]] = [[] for _ in range(len(WORD_SEEDS) + 1)]
        for t in batch.column(1):
            text = t.as_buffer().to_pybytes() if t.is_valid else b""
            words = list(set(WORDS.findall(text.translate(LOWER))))
            for k, seed in enumerate(WORD_SEEDS):
                hashes = np.array([xxhash.xxh64_intdigest(w, seed) for w in words], np.uint64)
                total = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64) if words else np.zeros(64, np.int64)
                marks[k].append(int(np.packbits(total * 2 > len(words), bitorder="little").view(np.uint64)[0]))
            marks[-1].append(fingerprint(text, NEAR_SHINGLE))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.array(m, np.uint64).view(np.int64)) for m in marks)], names=["id", *(f"w{s}" for s in WORD_SEEDS), "shingles"])


def _nodes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (id, text) with the fingerprints of _three_marks, the node, which is the hash of the text's set of shingles, and the set's bands and sketch."""
    for batch in batches:
        nodes, keys, sketches = [], [], []
        for t in batch.column(1):
            hashes = shingle_set(t.as_buffer().to_pybytes() if t.is_valid else b"")
            nodes.append(_set_node(hashes))
            own, sketch = bands(hashes)
            keys.append(np.array(own, np.uint64).view(np.int64))
            sketches.append(sketch)
        marks = next(_three_marks(iter([batch])))
        yield pa.RecordBatch.from_arrays([*marks.columns, pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], names=[*marks.schema.names, "node", "bands", "sketch"])


def alike(nodes: np.ndarray, sketches: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect the nodes that pairs with SAME_BYTES equal bytes of their sketches connect; pairs that are connected already aren't compared."""
    label, links = np.arange(len(nodes)), []
    for i in range(len(nodes) - 1):
        others = i + 1 + np.flatnonzero(label[i + 1 :] != label[i])
        near = others[(sketches[others] == sketches[i]).sum(axis=1) >= SAME_BYTES]
        fresh, at = np.unique(label[near], return_index=True)
        links += [(int(nodes[i]), int(nodes[j])) for j in near[at]]
        label[np.isin(label, fresh)] = label[i]
    return links


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """batches(key, node, sketch) sorted by key, to (src, dst) of the links in each key's group."""
    width = BANDS * BAND_ROWS
    held: pa.Table | None = None

    def out(rows: pa.Table) -> pa.RecordBatch:
        keys, nodes = rows["key"].to_numpy(), rows["node"].to_numpy()
        sketches = np.frombuffer(b"".join(rows["sketch"].to_pylist()), np.uint8).reshape(-1, width)
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        links = []
        for a, b in zip(starts, np.append(starts[1:], len(keys))):
            links += alike(nodes[a:b], sketches[a:b])
        a, b = zip(*links) if links else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["src", "dst"])

    for batch in batches:
        if not len(batch):
            continue
        rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        keys = rows["key"].to_numpy()
        end = int(np.searchsorted(keys, keys[-1]))
        if end:
            yield out(rows[:end])
        held = rows[end:]
    if held is not None and len(held):
        yield out(held)


def band_links(nodes: DataFrame, block: int = BLOCK) -> DataFrame:
    """(src, dst): links between nodes(node, bands, sketch) that meet in a band with sketches that are alike.

    Pairs are verified where they meet, so what bands alone bring together, at similarities far under 0.8, makes no groups. Nodes alone in a
    band carry no sketch anywhere. A band with more than block nodes is dealt into blocks by its count, and each pair of blocks is one group.
    """
    n = parts(nodes.sparkSession)
    banded = nodes.select("node", F.explode("bands").alias("band"))
    sizes = banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band", F.when(F.col("n") > block, F.ceil(F.col("n") * 2 / block)).otherwise(1).cast("int").alias("blocks"))
    met = banded.join(sizes, "band").join(nodes.select("node", "sketch"), "node")
    dealt = met.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    key = F.xxhash64("band", F.least("own", "other"), F.greatest("own", "other"))
    return dealt.select(key.alias("key"), "node", "sketch").repartition(n, "key").sortWithinPartitions("key").mapInArrow(_alike, "src bigint, dst bigint")


def _sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (root, node, text) to (root, node, n, hashes), those whose text makes the node."""
    for batch in batches:
        rows = []
        for root, node, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            hashes = shingle_set(t.as_buffer().to_pybytes() if t.is_valid else b"")
            if _set_node(hashes) == node % (1 << 64):
                rows.append((root, node, len(hashes), hashes.tobytes()))
        root, node, n, held = zip(*rows) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(root, pa.int64()), pa.array(node, pa.int64()), pa.array(n, pa.int64()), pa.array(held, pa.binary())], names=["root", "node", "n", "hashes"])


def similar_links(nodes: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that connect the nodes that pairs with a Jaccard similarity of 0.8 or more connect; pairs that are connected already aren't compared."""
    nodes, first = np.unique(nodes, return_index=True)
    sets = [sets[i] for i in first]
    sizes = np.array([len(x) for x in sets], np.int64)
    label, links = np.arange(len(nodes)), []
    for i, own in enumerate(sets):
        others = i + 1 + np.flatnonzero((label[i + 1 :] != label[i]) & (5 * sizes[i + 1 :] >= 4 * sizes[i]) & (5 * sizes[i] >= 4 * sizes[i + 1 :]))
        if not len(own) or not len(others):
            continue
        flat = np.concatenate([sets[j] for j in others])
        found = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
        shared = np.add.reduceat(found.astype(np.int64), np.cumsum(sizes[others]) - sizes[others])
        near = others[5 * shared >= 4 * (sizes[i] + sizes[others] - shared)]
        fresh, at = np.unique(label[near], return_index=True)
        links += [(int(nodes[i]), int(nodes[j])) for j in near[at]]
        label[np.isin(label, fresh)] = label[i]
    return links


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """batches(key, node, hashes) sorted by key, to (src, dst) of the links in each key's group."""

    def links(nodes: list[int], sets: list[bytes]) -> pa.RecordBatch:
        found = similar_links(np.array(nodes, np.int64), [np.frombuffer(x, np.uint64) for x in sets])
        a, b = zip(*found) if found else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["src", "dst"])

    key, nodes, sets = None, [], []
    for batch in batches:
        for k, node, held in zip(*(c.to_pylist() for c in batch.columns)):
            if k != key:
                if len(nodes) > 1:
                    yield links(nodes, sets)
                key, nodes, sets = k, [], []
            nodes.append(node)
            sets.append(held)
    if len(nodes) > 1:
        yield links(nodes, sets)


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, held: int = SHINGLES_HELD) -> DataFrame:
    """(id, node, root, component_id) for each row with an id: the smallest id reachable by links of near-duplicates.

    node is the hash of the text's set of shingles and root the least node reachable; groups that share their smallest id differ in root.

    Two documents are linked if the exact Jaccard similarity of their sets of five-word shingles is 0.8 or more; A-Z is read as
    a-z. Candidates are fingerprints over the distinct single words (WORD_SEEDS), which a few edits hardly move, within 4 bits
    by Golay keys while those over shingles are within FAR_BITS, and sets that meet in a MinHash band with sketches that are alike. What candidates connect is a group
    within which all pairs that links have not yet connected are compared by their sets. Texts with equal sets are one node,
    whatever the number of copies; texts without words are copies of each other, and null text counts as empty. A group with
    more than held shingles is dealt into blocks, and each pair of blocks is compared in its own task.
    """
    words = [f"w{s}" for s in WORD_SEEDS]
    kind = "id bigint, " + ", ".join(f"{w} bigint" for w in words) + ", shingles bigint, node bigint, bands array<bigint>, sketch binary"
    n = parts(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("t")).where("id is not null")
    marks = durable(rows.mapInArrow(_nodes_of, kind))
    by_marks = durable(marks.groupBy(*words, "shingles").agg(F.min("node").alias("node"), F.max("node").alias("most")))
    candidates = link_nodes(by_marks.select("node", *words, "shingles"), partial(_near_words_and_shingles, 4), len(words), block)
    shared = by_marks.where("node <> most").select(*words, "shingles", F.col("node").alias("dst"))
    candidates = candidates.unionByName(marks.join(shared, [*words, "shingles"]).select(F.col("node").alias("src"), "dst"))
    nodes = durable(marks.groupBy("node").agg(F.min("id").alias("least"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")))
    candidates = candidates.unionByName(band_links(nodes, block))
    one = nodes.join(components(candidates), "node").select("root", "node", F.col("least").alias("id"))
    sets = durable(rows.join(one, "id").select("root", "node", "t").mapInArrow(_sets_of, "root bigint, node bigint, n bigint, hashes binary"))
    total = F.sum("n")
    sizes = durable(sets.groupBy("root").agg(F.when(total > held, F.ceil(total * 2 / held)).otherwise(1).cast("int").alias("blocks")))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = sets.join(sizes, "root").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = F.xxhash64("root", F.least("own", "other"), F.greatest("own", "other"))
    links = dealt.select(pair.alias("key"), "node", "hashes").repartition(n, "key").sortWithinPartitions("key").mapInArrow(_similar, "src bigint, dst bigint")
    rooted = nodes.join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    leasts = durable(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    named = rooted.join(leasts, "root").select("node", "root", "component_id")
    return marks.select("id", "node").join(named, "node").select("id", "node", "root", "component_id")


def _with_node(batches: Iterator[pa.RecordBatch], at: int, name: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nodes = [_set_node(shingle_set(t.as_buffer().to_pybytes() if t.is_valid else b"")) for t in batch.column(at)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.array(nodes, np.uint64).view(np.int64))], names=[*batch.schema.names, name])


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those that have a group's smaller identifier beside them; see similar_groups.

    Rows that repeat an identifier are documents of their own: of those in one group the first by text stays. Rows without
    an identifier stay.
    """
    gone, again, node, own_id, of, root, nth = (unused(docs, c) for c in ("__gone", "__again", "__node", "__id", "__of", "__root", "__nth"))
    groups = durable(similar_groups(docs, id_col, text_col))
    by_id = durable(groups.groupBy("id").agg(F.min("component_id").alias("c"), F.count("*").alias("n")))
    out = docs.join(by_id.where("c <> id or n > 1").select(F.col("id").alias(gone)), F.col(id_col) == F.col(gone), "left_anti")
    twice = by_id.where("n > 1").select(F.col("id").alias(again))
    if twice.isEmpty():
        return out
    rows = docs.join(twice, F.col(id_col) == F.col(again), "left_semi")
    rows = rows.mapInArrow(partial(_with_node, at=docs.columns.index(text_col), name=node), StructType([*docs.schema.fields, StructField(node, LongType())]))
    own = groups.where("component_id = id").join(twice, F.col("id") == F.col(again), "left_semi").select(F.col("id").alias(own_id), F.col("node").alias(of), F.col("root").alias(root)).distinct()
    rows = rows.join(own, (F.col(id_col) == F.col(own_id)) & (F.col(node) == F.col(of)))
    once = rows.withColumn(nth, F.row_number().over(Window.partitionBy(id_col, root).orderBy(text_col))).where(F.col(nth) == 1).select(*docs.columns)
    return out.unionByName(once)
