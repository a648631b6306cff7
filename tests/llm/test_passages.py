import random

import numpy as np
import pytest

from siltstone.llm import decontaminate, suffix_dedup

DOCS = "doc_id bigint, text string, gram int, passages string"


def brute_repeats(rows, length):
    where = {}
    texts = {}
    for i, t, *_ in rows:
        if i is not None:
            texts.setdefault(i, []).append((t or "").split())
    for i, ws in texts.items():
        for w in ws:
            for a in range(len(w) - length + 1):
                where.setdefault(tuple(w[a : a + length]), set()).add(i)
    out = []
    for i, ws in texts.items():
        hits = sorted({(a, min(where[tuple(w[a : a + length])])) for w in ws for a in range(len(w) - length + 1) if len(where[tuple(w[a : a + length])]) > 1})
        done = []
        for a, first in hits:
            if done and done[-1][1] >= a:
                done[-1] = (done[-1][0], max(done[-1][1], a + length), min(done[-1][2], first))
            else:
                done.append((a, a + length, first))
        out += [(i, *d) for d in done]
    return sorted(out)


@pytest.mark.parametrize("block", [suffix_dedup.BLOCK, 2])
def test_repeated_passages_like_brute_force(spark, block):
    rnd = random.Random(11)
    word = lambda: f"w{rnd.randrange(400)}"
    common = [[word() for _ in range(n)] for n in (12, 13, 20, 40, 11)]
    rows = []
    for i in range(60):
        w = [word() for _ in range(rnd.randrange(0, 50))]
        for _ in range(rnd.randrange(3)):
            p = rnd.choice(common)
            p = p[rnd.randrange(3) :]
            at = rnd.randrange(len(w) + 1)
            w[at:at] = p
        rows.append((i, " ".join(w), 1, "p"))
    rows += [(100, None, 1, "p"), (101, "", 1, "p"), (None, rows[0][1], 1, "p"), (102, "a " * 60, 1, "p"), (103, "b " * 200, 1, "p"), (104, "b " * 15, 1, "p"), (105, rows[3][1], 1, "p"), (106, "short one", 1, "p"), (106, rows[5][1] + " " + rows[3][1], 1, "p")]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    got = suffix_dedup.repeated_passages(docs, length=12, gram=5, block=block)
    assert sorted(map(tuple, got.collect())) == brute_repeats(rows, 12)


def brute_places(rows, length):
    """Stretches of passages that stand at more than one place: of one document, of several, or in rows of one id."""
    where, texts = {}, {}
    for n, (i, t, *_) in enumerate(rows):
        if i is not None:
            w = (t or "").split()
            texts.setdefault(i, []).append((n, w))
            for a in range(len(w) - length + 1):
                where.setdefault(tuple(w[a : a + length]), []).append((i, n, a))
    out = []
    for i, ws in texts.items():
        hits = sorted({(a, min(x[0] for x in where[tuple(w[a : a + length])])) for _, w in ws for a in range(len(w) - length + 1) if len(where[tuple(w[a : a + length])]) > 1})
        done = []
        for a, first in hits:
            if done and done[-1][1] >= a:
                done[-1] = (done[-1][0], max(done[-1][1], a + length), min(done[-1][2], first))
            else:
                done.append((a, a + length, first))
        out += [(i, *d) for d in done]
    return sorted(out)


@pytest.mark.parametrize("block", [2_000, 3])
def test_repeats_by_place_like_brute_force(spark, block):
    rnd = random.Random(13)
    text = lambda n: " ".join(f"w{rnd.randrange(500)}" for _ in range(n))
    rows = []
    for i in range(40):
        a, b = text(rnd.randrange(12, 40)), text(rnd.randrange(10, 14))
        rows.append((i, " ".join([text(5), a, text(7), a, b, text(3), b][: rnd.randrange(2, 8)]), 1, "p"))
    twin = text(30)
    rows += [(100, twin, 1, "p"), (100, twin, 1, "p"), (101, "c " * 40, 1, "p"), (102, "x y " * 9, 1, "p"), (103, rows[0][1] + " end", 1, "p"), (None, twin, 1, "p"), (104, None, 1, "p"), (105, "", 1, "p")]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    got = sorted(map(tuple, suffix_dedup.repeated_passages(docs, length=12, gram=5, block=block, within=True).collect()))
    assert got == brute_places(rows, 12)
    assert {100, 101} <= {r[0] for r in got}


def test_repeated_passages_empty(spark):
    assert suffix_dedup.repeated_passages(spark.createDataFrame([], DOCS)).count() == 0


def edit_distance_in(passage, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(passage, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def mutated(rnd, s, n):
    s = list(s)
    for _ in range(n):
        at = rnd.randrange(len(s))
        kind = rnd.randrange(3)
        if kind == 0:
            s[at] = rnd.choice("xyz")
        elif kind == 1:
            del s[at]
        else:
            s.insert(at, rnd.choice("xyz"))
    return "".join(s)


def test_leaks_like_brute_force(spark):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate((3, 5, 18, 22, 25, 60))] + [(50, None), (51, ""), (52, "2+2=4"), (53, text(2)[:12]), (54, text(6)[:21]), (55, text(8)[:30]), (None, text(20))]
    rows = []
    for i in range(90):
        body = text(rnd.randrange(0, 60))
        if i % 3 == 0:
            item = items[rnd.choice([0, 1, 2, 3, 4, 5, 9, 10, 11])][1]
            body += " " + mutated(rnd, item.upper() if i % 2 else item.replace(" ", "\n "), rnd.randrange(0, 14)) + " " + text(5)
        rows.append((i, body, 1, "p"))
    rows += [(200, None, 1, "p"), (201, "", 1, "p"), (202, items[4][1], 1, "p"), (203, items[5][1][40:230], 1, "p")]
    rows += [(204, "so 2+2=4.", 1, "p"), (205, "12+2=4", 1, "p"), (206, "2+2=4x", 1, "p"), (207, "2+2=4", 1, "p")]
    passages = decontaminate.Benchmark([x for x in items if x[0] is not None]).passages
    want = {}
    for i, body, *_ in rows:
        t = decontaminate.normal(body or "")
        want[i] = {int(item) for p in passages for item, code, k in zip(p.items, p.codes, p.budget) if edit_distance_in([chr(c) for c in code], t) <= k}
        assert all(k == len(code) // 10 for p in passages for code, k in zip(p.codes, p.budget))
        if i in (204, 207):
            want[i].add(52)
    docs = spark.createDataFrame(rows, DOCS)
    found = decontaminate.find_leaks(docs, spark.createDataFrame(items, "item_id bigint, text string"))
    got = {r.doc_id: {s.item_id for s in r["__spans"]} for r in found.collect()}
    assert got == want
    assert want[202] and want[203] and any(want[i] for i in range(90))
    blocks = decontaminate.find_leaks(docs, spark.createDataFrame(items, "item_id bigint, text string"), block_chars=150)
    assert {r.doc_id: {s.item_id for s in r["__spans"]} for r in blocks.collect()} == want


def test_leak_in_a_long_text_across_slices(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SLICE", 1_000)
    rnd = random.Random(6)
    item = " ".join("".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(20))
    passages = decontaminate.Benchmark([(1, item)])
    filler = " ".join("".join(rnd.choice("klmnopq") for _ in range(5)) for _ in range(1_200))
    for at in range(900, 1_200, 37):
        assert decontaminate.matches(filler[:at] + " " + item + " " + filler[at:], passages), at
    assert not decontaminate.matches(filler, passages)


def test_part_of_an_item_is_found_at_every_size():
    """125 characters of an item, wherever they begin in it, for items around every length where the passages change."""
    rnd = random.Random(7)
    whole = " ".join("".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(60))
    for n in (99, 100, 101, 130, 159, 160, 161, 199, 200, 201, 300):
        benchmark = decontaminate.Benchmark([(1, whole[:n].strip())])
        item = whole[:n].strip()
        for at in range(0, max(1, len(item) - 124), 7):
            assert decontaminate.matches("zzz " + item[at : at + 125] + " zzz", benchmark), (n, at)
        assert decontaminate.matches(mutated(rnd, item, len(item) // 10), benchmark) or n > 200
        assert not decontaminate.matches(whole[n + 1 :][:80], benchmark)


def test_spans_of_other_columns(spark):
    docs = spark.createDataFrame([(1, "so 2+2=4 it is", 3, 4, 5)], "doc_id bigint, text string, __text int, __spans int, __new int")
    found = decontaminate.find_leaks(docs, spark.createDataFrame([(7, "2+2=4")], "item_id bigint, text string")).first()
    assert (found["__text"], found["__new"]) == (3, 5) and found["__spans"][0].item_id == 7


def test_no_benchmark(spark):
    docs = spark.createDataFrame([(1, "text", 1, "p")], DOCS)
    assert decontaminate.find_leaks(docs, spark.createDataFrame([], "item_id bigint, text string")).first()["__spans"] == []


def test_matches_like_all_pairs():
    """Sorted neighbours against every pair of suffixes, on few words, so that others stand between partners."""
    import pyarrow as pa

    rnd = random.Random(4)
    length, gram = 8, 3
    rows = set()
    while len(rows) < 300:
        after = ["k", "l", "m", *(rnd.choice("ab") for _ in range(rnd.randrange(6)))]
        rows.add((" ".join(rnd.choice("ab") for _ in range(rnd.randrange(6))), " ".join(after)))
    rows = sorted(((x.split(), y.split()) for x, y in rows), key=lambda r: "".join(w + " " for w in r[1]))
    ids = [(rnd.randrange(9), rnd.randrange(9)) for _ in rows]
    a, b = np.array([min(x) for x in ids]), np.array([max(x) for x in ids])
    joined = [pa.array(["".join(w + " " for w in r[k]).encode() for r in rows], pa.binary()) for k in (0, 1)]
    got = list(zip(*(x.tolist() for x in suffix_dedup.matches(*joined, a, b, length, gram))))
    for (left, right), (low, high, first) in zip(rows, got):
        hits = []
        for shift in range(length - gram + 1):
            if len(left) >= shift and len(right) >= length - shift:
                same = [i for i, (x, y) in enumerate(rows) if x[:shift] == left[:shift] and len(x) >= shift and y[: length - shift] == right[: length - shift]]
                least, most = a[same].min(), b[same].max()
                if least < most:
                    hits.append((shift, least))
        assert (low, high) == ((min(hits)[0], max(hits)[0]) if hits else (-1, -1))
        assert not hits or first == min(f for _, f in hits)


def test_runs_are_large_by_their_share_of_the_table(spark, monkeypatch):
    """Without block, a run within a task's share of the suffixes is compared there, not blown up into its passages."""
    rnd = random.Random(17)
    word = lambda: f"w{rnd.randrange(9000)}"
    common = [[word() for _ in range(14)] for _ in range(10)]
    rows = [(i, " ".join([*(word() for _ in range(12)), *common[i % 10], *(word() for _ in range(12))]), 1, "p") for i in range(60)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 2)
    large, real = [], suffix_dedup.durable

    def kept(df):
        out = real(df)
        large.extend([out.count()] if df.columns == ["large_gram"] else [])
        return out

    monkeypatch.setattr(suffix_dedup, "durable", kept)
    got = suffix_dedup.repeated_passages(docs, length=12, gram=5)
    assert sorted(map(tuple, got.collect())) == brute_repeats(rows, 12) and large == [0]
