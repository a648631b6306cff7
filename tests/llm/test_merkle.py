import random
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from siltstone.llm import merkle as m

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, leaf string, g int, idx string, place string"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf_of(i, text, lang, source, n):
    return h(*map(field, (i, source, lang, n, text)))


def climb(nodes, f):
    """The root, and for each node its siblings before and after, level by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, place in enumerate(at):
            first = place // f * f
            paths[i].append(("".join(nodes[first:place]), "".join(nodes[place + 1 : first + f])))
        at = [p // f for p in at]
        nodes = [h(*nodes[i : i + f]) for i in range(0, len(nodes), f)]
    return nodes[0], paths


def plain(rows, f, changed=lambda i, text: text):
    by = {}
    for r in rows:
        by.setdefault((r[2] is not None, (r[2] or "").encode()), []).append(r)
    trees = []
    for g in sorted(by):
        own = sorted(by[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(*r)))
        trees.append((own, *climb([leaf_of(*r) for r in own], f)))
    root, above = climb([t[1] for t in trees], f)
    out = []
    for (own, subroot, paths), up in zip(trees, above):
        for r, path in zip(own, paths):
            other = fold = leaf_of(r[0], changed(r[0], r[1]), *r[2:])
            for a, b in path + up:
                fold = h(a, fold, b)
            assert fold == root or other != leaf_of(*r)
            out.append((r[0], leaf_of(*r), subroot, root, h(*[s for p in path + up for s in p]), fold, fold == root))
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", "z") for r in rows], DOCS)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def small_letters():
    return {"text": F.when(F.col("doc_id") % 3 == 0, F.translate("text", "AB", "ab")).otherwise(F.col("text"))}


def small(i, text):
    return text.replace("A", "a").replace("B", "b") if i is not None and i % 3 == 0 and text is not None else text


@pytest.mark.parametrize("fan_out", [8, 3, 2])
def test_like_plain_python(spark, fan_out):
    random.seed(fan_out)
    sizes = {"en": 150, "de": 65, "fr": 64, "é": 9, "x": 8, "y": 1, None: 3}
    rows = [(random.randrange(10**6), random.choice(["A text", "b", "", None, "B"]), lang, random.choice(["s", None]), random.choice([1, None])) for lang, n in sizes.items() for _ in range(n)]
    docs = frame(spark, rows).repartition(7)
    forest, out = m.merkle_manifest(docs, fan_out=fan_out, changed=small_letters(), part_rows=17)
    assert found(out) == plain(rows, fan_out, small)
    nodes = forest.nodes.where("level > 0").count()
    assert nodes == sum(sum(m.level_sizes(n, fan_out)[1:]) for n in sizes.values()), "each node above the leaves once"


def test_parts_end_anywhere(spark):
    """Partitions of every length, at every place of the tree."""
    rng = random.Random(5)
    for n in (1, 2, 7, 8, 9, 63, 64, 65, 200):
        leaves = [h(str(i)) for i in range(n)]
        for f in (2, 8):
            root, paths = climb(leaves, f)
            everything = m.inner_nodes(0, leaves, n, f)
            assert everything[len(m.level_sizes(n, f)) - 1, 0] == root
            for _ in range(12):
                a = rng.randrange(n)
                b = rng.randrange(a, n) + 1
                inside = m.inner_nodes(a, leaves[a:b], n, f)
                assert all(everything[k] == d for k, d in inside.items())
                needed = m.outside(a, b - a, n, f)
                assert not set(needed) & set(inside)
                assert m.paths_of(a, leaves[a:b], n, {k: everything[k] for k in needed}, f) == paths[a:b]


def test_nulls_repeats_long_texts_and_empty(spark):
    long = "Ä A\n" * 200_000
    rows = [(None, None, None, None, None), (3, long, None, "s", 5), (6, "A", "en", "s", 5), (6, "A", "en", "s", 5), (6, "B", "en", "s", 5), (None, "A", "en", "s", 5), (None, "", "en", None, 5)]
    _, out = m.merkle_manifest(frame(spark, rows), changed=small_letters(), part_rows=2)
    assert found(out) == plain(rows, 8, small)
    forest, none = m.merkle_manifest(frame(spark, []))
    assert none.count() == 0 and forest.nodes.count() == 0
    _, one = m.merkle_manifest(frame(spark, rows[2:3]))
    assert found(one) == plain(rows[2:3], 8)
