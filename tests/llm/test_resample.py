import hashlib
import math
import re
import zlib
from collections import Counter

from siltstone.llm import resample as m

DOCS = "doc_id bigint, text string, digest string, rank int, copies string"


def plain(docs, target, share=25, min_words=20, buckets=10_000):
    """The definition, row by row."""

    def features(text):
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda c: c[0].lower(), text or ""))
        return words, [zlib.crc32(f.encode()) % buckets for f in words + [f"{a} {b}" for a, b in zip(words, words[1:])]]

    own, wanted = Counter(), Counter()
    for _, t in docs:
        own.update(features(t)[1])
    for t in target:
        wanted.update(features(t)[1])
    all_own, all_wanted = sum(own.values()), sum(wanted.values())
    gain = lambda b: math.floor(1000 * math.log((wanted[b] + 1) * (all_own + buckets) / ((own[b] + 1) * (all_wanted + buckets))))
    out = []
    for i, t in docs:
        words, fs = features(t)
        weight = sum(map(gain, fs)) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(words)])
    able = sorted((r for r in out if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: share * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], DOCS)


LONG = " ".join(f"Wörd{i % 997} x" for i in range(40_000))
ROWS = [(i, f"Wanted words {i % 3} " * 12) for i in range(40)] + [(100 + i, "one Same text " * 10) for i in range(60)]
ROWS += [(200, None), (201, ""), (202, "...\n\t"), (203, LONG), (204, "lone"), (None, "no id at all " * 8), (0, "Wanted words 0 " * 12), (205, "İstanbul ÀÉ   ß" * 9)]
TARGET = ["wanted words", "WANTED words 1", None, ""]


def test_like_plain_python_with_hot_texts_nulls_and_long_ones(spark):
    target = spark.createDataFrame([(t, 1) for t in TARGET], "text string, doc_id int")
    assert rows_of(m.resample(frame(spark, ROWS).repartition(5), target)) == plain(ROWS, TARGET)


def test_empty_tables(spark):
    target = spark.createDataFrame([(t, 1) for t in TARGET], "text string, doc_id int")
    assert rows_of(m.resample(frame(spark, []), target)) == []
    assert rows_of(m.resample(frame(spark, ROWS[:50]), target.limit(0))) == plain(ROWS[:50], [])


def test_every_different_text_is_one_row_of_features(spark):
    features = m.distinct_features(frame(spark, ROWS)).collect()
    assert len(features) == len({t or "" for _, t in ROWS}) and sum(r.copies for r in features) == len(ROWS)


def test_ranks_run_through_all_ranges(spark):
    rows = spark.range(1000).selectExpr("id", "id % 7 AS score")
    got = sorted((r["rank"], r.score, r.id) for r in m.ranked(rows, 600, [rows.score.desc(), rows.id.asc()]).collect())
    want = sorted(((i % 7, i) for i in range(1000)), key=lambda x: (-x[0], x[1]))[:600]
    assert got == [(k + 1, s, i) for k, (s, i) in enumerate(want)]
