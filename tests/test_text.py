import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.functions import text as tx


def plain_tokens(text):
    out = []
    for run in re.split(r"[^A-Za-z0-9]+", text):
        if run:
            out.append(run.lower())
            out += [p.lower() for p in re.split(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", run) if p and p.lower() != run.lower()]
    return out


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="aBcD9_é. XYz", max_size=14), min_size=1, max_size=60))
def test_tokens(spark, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", tx.tokens(F.col("t")).alias("k")).collect()
    assert {r.i: r.k for r in rows} == {i: plain_tokens(t) for i, t in enumerate(texts)}


def one(spark, column, *values):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string").orderBy("i").select(column(F.col("t"))).collect()]


def test_tokens_of_an_interface(spark):
    assert one(spark, tx.tokens, "IDamageable", None, "") == [["idamageable", "i", "damageable"], [], []]


def test_signature_and_documentation(spark):
    code = ["def f(x: int,\n      y):\n    '''Says so.\n    More.'''\n    return 1", "public  void Go()\n{ x; }", "no end here", "", None]
    assert one(spark, tx.signature, *code) == ["def f(x: int, y)", "public void Go()", "no end here", "", ""]
    assert one(spark, tx.doc_line, *code, "/// About it\nfunc f()", 'x = """\n  Title\n"""') == ["Says so.", "", "", "", "", "About it", "Title"]


def test_globs(spark):
    paths = ["/a/b/test_x.py", "C:\\a\\x.py", "/a/b/[x].md", "/a/xy.cs"]
    pick = lambda g: one(spark, lambda c: tx.matches_glob(c, g), *paths)
    assert pick("*.py") == [True, True, False, False]
    assert pick("/a/*/test_?.py") == [True, False, False, False]
    assert pick("x[!z].cs") == [False, False, False, True] and pick("x[!y].cs") == [False, False, False, False]
    assert pick("[[]x].md") == [False, False, True, False]


def test_paths_and_urls(spark):
    assert one(spark, tx.extension, "a/B.PY", ".hidden", "a/b", "x.tar.gz") == [".py", "", "", ".gz"]
    assert one(spark, tx.language, "a.h", "b.swift", "c.zzz") == ["c", "swift", None]
    assert one(spark, tx.normal_url, "http://a.com/", "http://a.com", "http://a.com/x/#f", "http://a.com/x//?q=1") == ["http://a.com/", "http://a.com", "http://a.com/x", "http://a.com/x//?q=1"]
    assert one(spark, tx.page_file, "http://a.com/x y/z") == ["a.com_x_y_z.md"]
    assert len(one(spark, tx.page_file, "http://a.com/" + "x" * 200)[0]) == 80 + 1 + 10 + 3
    assert one(spark, tx.declared_symbols, "def alpha(x):\nclass Beta:\n  def me(self)") == [["Beta", "alpha"]]
    source = "pub struct Heap {}\ntrait Walk {}\nexport async function load_all() {}\nfunc Serve()\npublic static List<int> Sum(int x)\ndef get():\nclass ab:\nenum Color"
    assert one(spark, tx.declared_symbols, source, None) == [["Color", "Heap", "Serve", "Sum", "Walk", "load_all"], []]
    assert one(spark, tx.keywords, "Where is the Rate-limit logic of an x2 queue_len queue?", "", None) == [["rate-limit", "queue", "len"], [], None]
