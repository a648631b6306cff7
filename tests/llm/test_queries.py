import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from oracle import same_rows  # noqa: E402

import corpus_pipeline  # noqa: E402
from siltstone.llm import decontaminate, mixing, queries, toxicity  # noqa: E402
from siltstone.llm.common import table  # noqa: E402

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from test_simhash import similar_ids  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, name):
    same_rows(queries.QUERIES[name](spark, SF), queries.ORACLES[name], SF)


def test_pipeline_like_plain_python(spark):
    """The stages again, document by document in Python; near-duplicates by all pairs, the model and the mix by the operators."""
    docs = [r.asDict() for r in table(spark, SF, "documents").collect()]
    model = toxicity.train(table(spark, SF, "documents"), table(spark, SF, "labels"))
    docs = [d for d in docs if model.score(d["text"] or "")[0] < 0.5]
    pages = {}
    for d in docs:
        pages[d["source"]] = pages.get(d["source"], 0) + 1
    seen = {}
    for d in docs:
        for line in set((d["text"] or "").split("\n")) - {""}:
            seen[d["source"], line] = seen.get((d["source"], line), 0) + 1
    for d in docs:
        if d["text"] is not None and pages[d["source"]] >= 10:
            lines = d["text"].split("\n")
            kept = [x for x in lines if x == "" or seen[d["source"], x] <= 0.1 * pages[d["source"]]]
            if len(kept) < len(lines):
                d["text"] = "\n".join(kept)
                d["n_chars"] = len(d["text"])
    groups = similar_ids([(d["doc_id"], d["text"]) for d in docs])
    docs = [d for d in docs if groups[d["doc_id"]] == d["doc_id"]]
    passages = decontaminate.Benchmark([(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()])
    docs = [d for d in docs if not decontaminate.matches(d["text"] or "", passages)]
    frame = spark.createDataFrame([tuple(d[c] for c in corpus_pipeline.COLUMNS) for d in docs], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    want = {r.doc_id: (r["size"], r.taken) for r in mixing.mix_sources(frame).collect() if r.taken}
    out = corpus_pipeline.run(spark, SF)
    rows = out.collect()
    assert {r.doc_id: (r["size"], r.taken) for r in rows} == want
    assert {r.doc_id: (r.text, r.n_chars) for r in rows} == {d["doc_id"]: (d["text"], d["n_chars"]) for d in docs if d["doc_id"] in want}


def test_stages_take_odd_tables(spark):
    kind = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, taken int, spans string"
    odd = [(1, None, None, None, None, "s", 1, "p"), (2, "", "en", "a", 0, "s", 1, "p"), (None, "x y", "en", None, 3, "s", 1, "p"), (4, "x y", "en", "a", 3, "s", 1, "p"), (4, "x y", "en", "a", 3, "s", 1, "p")]
    for rows in (odd, []):
        docs = spark.createDataFrame(rows, kind)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            out.collect()
            assert name == "mixing" or out.columns == corpus_pipeline.COLUMNS
