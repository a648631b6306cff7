"""Repeated passages by a sparse suffix array: suffixes at minimiser positions only, neighbours compared, matches extended to both sides."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, durable, parts

#: Words of a passage at least, and words of the run that a minimiser is chosen by.
LENGTH, GRAM = 50, 20
#: Different suffixes of one run that a task compares, from any table's and up to any table's: between the two, as many as a task's share of all. The passages of a run with more are grouped by their words over all tasks.
BLOCK, MOST = 2_000, 50_000
_P = np.uint64(0x9E3779B97F4A7C15)
_MAX = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Words looked at together.
CHUNK = 400_000


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hashes of all words of all texts, and where each text's words end. Words are parted by ASCII white space."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    flat, ends = lists.flatten(), lists.offsets.to_numpy()[1:] - lists.offsets.to_numpy()[0]
    real = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    ends = np.r_[0, np.cumsum(real)][ends]
    coded = flat.filter(pa.array(real)).dictionary_encode()
    words = np.array([xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)
    return (words[coded.indices.to_numpy()] if len(words) else words), ends


def _rolling(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of size words, on the words' hashes; shorter than h by size - 1."""
    out = np.zeros(max(0, len(h) - size + 1), np.uint64)
    for i in range(size):
        out = out * _P + h[i : i + len(out)]
    return _mix(out)


def _sliding(h: np.ndarray, size: int, least) -> np.ndarray:
    """least (minimum or maximum) of every run of size values."""
    done, out = 1, h
    while done < size:
        step = min(done, size - done)
        out = least(out[: len(out) - step], out[step:])
        done += step
    return out


def least_runs(h: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all gram-word runs, and for each passage of length words the least of those in it; 0 where no passage of one text begins."""
    span = length - gram + 1
    starts = np.r_[0, ends[:-1]]
    text_end = np.repeat(ends, ends - starts)
    runs = _rolling(h, gram)
    at = np.arange(len(runs))
    runs[at + gram > text_end[: len(runs)]] = _MAX
    least = _sliding(runs, span, np.minimum)
    whole = np.arange(len(least)) + length <= text_end[: len(least)]
    return runs, np.where(whole, least, np.uint64(0))


def anchors(h: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the gram-word runs that are least in some passage of length words of their text; equal ones all count.

    Two equal passages have their least runs at the same distance from their beginnings.
    """
    span = length - gram + 1
    if len(h) < length:
        return np.array([], np.int64), np.array([], np.uint64)
    runs, least = least_runs(h, ends, length, gram)
    padded = np.r_[np.zeros(span - 1, np.uint64), least, np.zeros(span - 1, np.uint64)]
    greatest = _sliding(padded, span, np.maximum)[: len(runs)]
    chosen = np.flatnonzero((greatest == runs) & (runs != _MAX))
    return chosen, runs[chosen]


def _pieces(texts: pa.Array, chunk: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Runs of texts with about chunk words; a longer text is alone."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False) // 6 + 1
    begin = total = 0
    for i, n in enumerate(sizes):
        if i > begin and total + n > chunk:
            yield begin, i
            begin, total = i, 0
        total += int(n)
    if begin < len(sizes):
        yield begin, len(sizes)


def _anchors(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in _pieces(batch.column(1)):
            h, ends = word_hashes(batch.column(1)[a:b])
            at, runs = anchors(h, ends, length, gram)
            text = np.searchsorted(ends, at, side="right")
            place = at - np.r_[0, ends[:-1]][text]
            order = np.lexsort((place, runs, text))
            text, runs, place = text[order], runs[order], place[order]
            new = np.r_[True, (text[1:] != text[:-1]) | (runs[1:] != runs[:-1])] if len(text) else np.array([], bool)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[np.flatnonzero(new), len(text)].astype(np.int32)), pa.array(place.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(runs[new].view(np.int64)), batch.column(0)[a:b].take(pa.array(text[new])), lists], names=["gram", "id", "at"])


def _suffixes(batches: Iterator[pa.RecordBatch], length: int, gram: int, whole: bool = True) -> Iterator[pa.RecordBatch]:
    """(id, text, anchor places, row_no) to a row an anchor: its run's hash, the digest of left and right, id, place, row_no, left, right.

    right: the suffix, up to the length words from the anchor on, each followed by a space; left: up to the length - gram words before it, backwards, likewise. Without whole the two aren't given.
    """
    for batch in batches:
        for a, b in _pieces(batch.column(1), CHUNK // 8):
            texts = batch.column(1)[a:b]
            h, ends = word_hashes(texts)
            if len(h) < gram:
                continue
            starts = np.r_[0, ends[:-1]]
            runs = _rolling(h, gram)
            rows: list[tuple] = []
            for k, (text, places) in enumerate(zip(texts, batch.column(2)[a:b])):
                words = text.as_buffer().to_pybytes().split() if text.is_valid else []
                n = len(words)
                at = [p for p in places.as_py() if p + gram <= n]  # places of another row with this id may not be in this text
                if not at:
                    continue
                sizes = np.fromiter(map(len, words), np.int64, n) + 1
                begin = np.r_[0, np.cumsum(sizes)].tolist()
                total = begin[-1]
                onward, backward = b" ".join(words) + b" ", b" ".join(words[::-1]) + b" "
                for p in at:
                    left = backward[total - begin[p] : total - begin[max(0, p - length + gram)]]
                    right = onward[begin[p] : begin[min(n, p + length)]]
                    rows.append((int(starts[k]) + p, a + k, p, xxhash.xxh64_intdigest(left + b"\n" + right), left, right))
            if not rows:
                continue
            flat, row, at, digest, left, right = zip(*rows)
            columns = [pa.array(runs[np.array(flat)].view(np.int64)), pa.array(np.array(digest, np.uint64).view(np.int64)), batch.column(0).take(pa.array(row)), pa.array(at, pa.int32()), batch.column(3).take(pa.array(row))]
            columns += [pa.array(left, pa.binary()), pa.array(right, pa.binary())] if whole else []
            yield pa.RecordBatch.from_arrays(columns, names=["gram", "context", "id", "at", "row_no", "left", "right"][: len(columns)])


def _words_of(texts: pa.Array, width: int) -> np.ndarray:
    """The words of texts, each followed by a space, as numbers: a row a text, -1 where it has no more words."""
    lists = pc.split_pattern(pc.binary_slice(texts, 0, -1), " ")
    sizes = np.where(pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), 0, pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    flat = lists.filter(pa.array(sizes > 0)).flatten().dictionary_encode().indices.to_numpy()
    out = np.full((len(texts), width), -1, np.int32)
    row = np.repeat(np.arange(len(texts)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _common(words: np.ndarray) -> np.ndarray:
    """How many words each row has in common, from its beginning, with the row before; 0 for the first."""
    same = np.zeros(words.shape, bool)
    same[1:] = (words[1:] == words[:-1]) & (words[1:] >= 0)
    return np.logical_and.accumulate(same, axis=1).sum(1)


def matches(left: pa.Array, right: pa.Array, a: np.ndarray, b: np.ndarray, length: int, gram: int, ids: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For different suffixes, sorted, with the least and greatest place that each stands at: (least words to the left, greatest, least id) of the passages around each that stand at another place too; -1 without any.

    ids: the least id of each; without it the places are the ids.

    Neighbours' common words cut the suffixes into intervals that share their first words, and the left sides, sorted by
    themselves, into such that share their last words before the anchor. A passage that begins shift words to the left is
    shared by those in one interval of length - shift words to the right that are also in one of shift words to the left, so a
    third suffix between two of them hides nothing.
    """
    n, span, ids = len(a), length - gram, a if ids is None else ids
    after, before = _words_of(right, length), _words_of(left, max(span, 1))
    n_after, n_before = (after >= 0).sum(1), (before >= 0).sum(1)
    run = _common(after)
    order = np.lexsort(before.T[::-1])
    run_left = _common(before[order])
    low, high, first = np.full(n, -1), np.full(n, -1), np.full(n, np.iinfo(np.int64).max)
    for shift in range(span + 1):
        whole = np.flatnonzero((n_after >= length - shift) & (n_before >= shift))
        if not len(whole):
            continue
        interval = np.cumsum(run < length - shift)
        side = np.empty(n, np.int64)
        side[order] = np.cumsum(run_left < shift)
        _, key = np.unique(interval[whole] * (n + 1) + side[whole], return_inverse=True)
        least, most, least_id = (np.full(key.max() + 1, x) for x in (np.iinfo(np.int64).max, np.iinfo(np.int64).min, np.iinfo(np.int64).max))
        np.minimum.at(least, key, a[whole])
        np.maximum.at(most, key, b[whole])
        np.minimum.at(least_id, key, ids[whole])
        hit = least[key] < most[key]
        at = whole[hit]
        low[at] = np.where(low[at] < 0, shift, low[at])
        high[at] = shift
        first[at] = np.minimum(first[at], least_id[key][hit])
    return low, high, first


def _compared(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """(gram, context, left, right, a, b, id) sorted by gram and right, whole runs in one task, to (gram, context, low, high, first) of those with a match."""

    def out(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        left, right = (rows[c].chunk(0) for c in ("left", "right"))
        low, high, first = matches(left, right, rows["a"].to_numpy(), rows["b"].to_numpy(), length, gram, rows["id"].to_numpy())
        at = pa.array(np.flatnonzero(high >= 0))
        columns = [rows["gram"].chunk(0).take(at), rows["context"].chunk(0).take(at)]
        return pa.RecordBatch.from_arrays([*columns, *(pa.array(x).take(at) for x in (low.astype(np.int32), high.astype(np.int32), first))], names=["gram", "context", "low", "high", "first"])

    held: pa.Table | None = None
    for batch in batches:
        if not len(batch):
            continue
        rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        grams = rows["gram"].to_numpy()
        end = int(np.searchsorted(grams, grams[-1]))
        if end:
            yield out(rows[:end])
        held = rows[end:]
    if held is not None and len(held):
        yield out(held)


def _passages(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """(gram, context, left, right, a, b, id) to a row for each passage around the anchor: (gram, context, shift, passage, a, b, id); passage is the 128-bit digest of its words."""
    for batch in batches:
        rows: list[tuple] = []
        for k, (left, right) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
            before, after = left.split(), right.split()
            for shift in range(max(0, length - len(after)), min(length - gram, len(before)) + 1):
                rows.append((k, shift, xxhash.xxh3_128_digest(b" ".join([*before[:shift][::-1], *after[: length - shift]]))))
        row, shift, passage = zip(*rows) if rows else ((), (), ())
        row = pa.array(row, pa.int64())
        c = [batch.column(i).take(row) for i in (0, 1, 4, 5, 6)]
        yield pa.RecordBatch.from_arrays([c[0], c[1], pa.array(shift, pa.int32()), pa.array(passage, pa.binary()), *c[2:]], names=["gram", "context", "shift", "passage", "a", "b", "id"])


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, block: int | None = None, within: bool = False) -> DataFrame:
    """One row for each maximal stretch of words of a document that is covered by passages of length words standing in another document too: id, start_word, end_word (exclusive), first_id.

    first_id is the least id that has one of those passages; a stretch with first_id equal to its id is the copy to keep, or repeats what stands
    elsewhere in its own document. within: passages that only repeat within one document, overlapping or not, or in several
    rows of one id, are reported too.

    Of all suffixes only those at minimiser positions are kept: a position counts if its gram-word run has the least hash of
    some passage around it. Any passage standing twice has such a position at the same distance from its beginning, so a run
    that stands in one document only drops out. Of the others the suffix and what stands before it are taken, word for word;
    equal ones are one row before any exchange, so a passage on a third of all documents is one row a task. The suffixes are
    sorted, neighbours compared by their common words, and matches extended to the left; see matches. A run with more than
    block different suffixes (without: a task's share of all suffixes, between BLOCK and MOST) isn't gathered in one task: its passages
    are grouped by a 128-bit digest of their words, up to length - gram + 1 rows a suffix. By the share, runs that hold the same part of
    a larger table are treated the same, so these rows grow as the table does.

    Words are parted by ASCII white space and compared byte by byte. Null texts count as empty; null ids are left out, and
    rows with one id are one document. Texts of any length are read whole, pieces of a batch at a time. An empty table gives no rows.
    """
    if docs.schema[id_col].dataType.simpleString() not in ("bigint", "int", "smallint", "tinyint"):
        raise TypeError(f"{id_col} is to be an integer")
    n = parts(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).where("id is not null")
    anchored = durable(texts.mapInArrow(partial(_anchors, length=length, gram=gram), "gram bigint, id bigint, at array<int>"))
    several = F.sum(F.size("at")) > 1 if within else F.min("id") < F.max("id")
    twice = anchored.groupBy("gram").agg(several.alias("several")).where("several").select("gram")
    places = durable(anchored.join(twice, "gram").select("id", F.explode("at").alias("at")).groupBy("id").agg(F.collect_set("at").alias("places")))
    discard(anchored)
    placed = durable(texts.join(places, "id").select("id", "t", "places", F.monotonically_increasing_id().alias("row_no")))  # read twice
    discard(places)
    suffixes = placed.mapInArrow(partial(_suffixes, length=length, gram=gram), "gram bigint, context bigint, id bigint, at int, row_no bigint, left binary, right binary")
    place = F.xxhash64("row_no", "at") if within else F.col("id")
    different = durable(suffixes.groupBy("gram", "context", "left", "right").agg(F.min(place).alias("a"), F.max(place).alias("b"), F.min("id").alias("id")))
    runs = different.groupBy("gram").agg(F.count("*").alias("n"))
    block = block or max(BLOCK, min(MOST, different.count() // n))
    large = durable(runs.where(F.col("n") > block).select(F.col("gram").alias("large_gram")))
    hit = "gram bigint, context bigint, low int, high int, first bigint"
    compare = partial(_compared, length=length, gram=gram)
    if large.isEmpty():
        found = different.repartition(n, "gram").sortWithinPartitions("gram", "right").mapInArrow(compare, hit)
    else:
        # There is one large run for block rows at most; Spark knows the table's size and sends it to all tasks only if it is small.
        of_large = F.col("gram") == F.col("large_gram")
        found = different.join(large, of_large, "left_anti").repartition(n, "gram").sortWithinPartitions("gram", "right").mapInArrow(compare, hit)
        each = different.join(large, of_large, "left_semi").mapInArrow(partial(_passages, length=length, gram=gram), "gram bigint, context bigint, shift int, passage binary, a bigint, b bigint, id bigint")
        passage = ["gram", "shift", "passage"]
        shared = durable(each.groupBy(*passage).agg(F.min("a").alias("low"), F.max("b").alias("high"), F.min("id").alias("first")).where("low < high").select(*passage, "first"))
        found = found.unionByName(each.join(shared, passage).groupBy("gram", "context").agg(F.min("shift").alias("low"), F.max("shift").alias("high"), F.min("first").alias("first")))
    found = durable(found)
    discard(different)
    light = placed.mapInArrow(partial(_suffixes, length=length, gram=gram, whole=False), "gram bigint, context bigint, id bigint, at int, row_no bigint")
    # The passages around one anchor overlap, so they make one stretch.
    spans = light.join(found, ["gram", "context"]).groupBy("id", (F.col("at") - F.col("high")).alias("start"), (F.col("at") - F.col("low") + length).alias("end")).agg(F.min("first").alias("first"))
    own = Window.partitionBy("id").orderBy("start", "end")
    reached = F.max("end").over(own.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("new", (reached.isNull() | (F.col("start") > reached)).cast("int")).withColumn("nth", F.sum("new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    stretch = spans.groupBy("id", "nth").agg(F.min("start").cast("long").alias("start_word"), F.max("end").cast("long").alias("end_word"), F.min("first").alias("first_id"))
    return stretch.select(F.col("id").alias(id_col), "start_word", "end_word", "first_id")
