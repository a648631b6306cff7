"""Toxicity by multiple-instance learning: sentences score, a noisy-or makes them a document's probability, documents' labels train them."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, durable, unused

SENTENCE = re.compile(r"[.!?\n]+")
WORD = re.compile(r"[^\W\d_]+")
#: Labelled documents used for fitting, at most: those with the least MD5 of their identifier. The bound of what the driver holds.
FIT_ROWS = 8_000
#: Lengths of the word beginnings that are features beside whole words: insults come inflected.
STEMS = (4, 5, 6)
#: A sentence without a known feature has this log-odds at most, so thousands of plain sentences stay harmless.
PLAIN = -12.0


def features_of(sentence: str) -> set[str]:
    """The words of a lower-case sentence, and with a final star their beginnings."""
    words = set(WORD.findall(sentence))
    return words | {w[:k] + "*" for k in STEMS for w in words if len(w) >= k}


@dataclass(frozen=True)
class Model:
    """A sentence's log-odds are bias plus the weights of its distinct words; leak is a document's probability without any sentence."""

    weights: dict[str, float]
    bias: float
    leak: float

    @cached_property
    def starts(self) -> frozenset[str]:
        return frozenset(w.rstrip("*")[:4] for w in self.weights)

    def sentences(self, text: str) -> Iterator[tuple[str, float]]:
        for s in SENTENCE.split(text.lower()):
            if s.strip():
                yield s, self.bias + sum(self.weights.get(w, 0.0) for w in features_of(s))

    def score(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """The document's probability, and (start, end, probability) of its sentences with a known feature, in the text's characters."""
        low = text.lower()
        sentences = sum(1 for s in SENTENCE.split(low) if s.strip())
        hit: list[tuple[float, int, int]] = []
        if not self.starts.isdisjoint({w[:4] for w in WORD.findall(low)}):
            at = 0
            for end in [*(m.span() for m in SENTENCE.finditer(text)), (len(text), len(text))]:
                found = self.weights.keys() & features_of(text[at : end[0]].lower())
                if found:
                    hit.append((self.bias + sum(self.weights[w] for w in sorted(found)), at, end[0]))
                at = end[1]
        left = math.log1p(-self.leak) - max(0, sentences - len(hit)) * math.log1p(math.exp(self.bias))
        left -= sum(math.log1p(math.exp(z)) if z < 30 else z for z, _, _ in hit)
        return -math.expm1(left), [(a, b, 1 / (1 + math.exp(-z)) if z > -700 else 0.0) for z, a, b in hit]


def held_out(id_col) -> F.Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, label, text) to a row for each distinct feature of each document."""
    for batch in batches:
        for label, t in zip(batch.column(1).to_pylist(), batch.column(2)):
            found = sorted(set().union(*(features_of(s) for s in SENTENCE.split((t.as_py() or "").lower()))))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([label] * len(found), pa.int32())], names=["feature", "label"])


def select_features(counts: DataFrame, n: int, toxic: int) -> list[str]:
    """Of counts(feature, seen, toxic) the features of toxic documents that chance doesn't explain: their likelihood ratio against chance is greater than the number of features looked at.

    Counts are of the fitted documents, which bounds what the driver gets; all features that pass are taken.
    """
    base = toxic / n
    k, m = F.col("toxic"), F.col("seen")
    rest = F.when(m > k, (m - k) * F.log((m - k) / m / (1 - base))).otherwise(0.0)
    least = math.log(max(counts.count(), 1))
    ranked = counts.where((k >= 2) & (k > m * base)).withColumn("ratio", F.round(k * F.log(k / m / base) + rest, 6)).where(F.col("ratio") > least)
    return [r.feature for r in ranked.select("feature", "ratio").orderBy(F.col("ratio").desc(), "feature").collect()]


def _hits(batches: Iterator[pa.RecordBatch], index: dict[str, int]) -> Iterator[pa.RecordBatch]:
    """(id, label, text) to (id, label, sentences without a selected feature, the selected features of each other sentence)."""
    for batch in batches:
        plain, hits = [], []
        for t in batch.column(2):
            own = [sorted(index[f] for f in index.keys() & features_of(s)) for s in SENTENCE.split((t.as_py() or "").lower()) if s.strip()]
            hits.append([h for h in own if h])
            plain.append(len(own) - len(hits[-1]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(plain, pa.int32()), pa.array(hits, pa.list_(pa.list_(pa.int32())))], names=["id", "label", "plain", "hits"])


def fit(words: list[str], bags: list[tuple[int, int, list[list[int]]]], rounds: int = 500, rate: float = 0.1, l1: float = 0.1) -> Model:
    """Likelihood ascent of the noisy-or by Adam, with an L1 penalty on the words' weights, which stay positive. Deterministic.

    bags: for each document its label, its sentences without a feature, the features of its other sentences. Without both labels the model is the labels' share as leak.
    """
    y = np.array([b[0] for b in bags], float)
    if not len(y) or y.sum() in (0, len(y)):
        return Model({}, PLAIN, min(0.999, max(0.001, float(y.mean()) if len(y) else 0.001)))
    plain = np.array([b[1] for b in bags], float)
    sent_doc = np.array([d for d, b in enumerate(bags) for _ in b[2]], np.int64)
    sizes = np.array([len(s) for b in bags for s in b[2]], np.int64)
    tok_sent = np.repeat(np.arange(len(sizes)), sizes)
    tok_word = np.array([w for b in bags for s in b[2] for w in s], np.int64)
    n_sent, n_words = len(sent_doc), len(words)
    # weights, bias, leak's log-odds
    # A sentence with as many features as the median one begins near even odds: far below them no label would move its weights.
    x = np.r_[np.full(n_words, -PLAIN / max(1.0, float(np.median(sizes)) if n_sent else 1.0)), PLAIN, math.log(0.03 / 0.97)]
    m, v = np.zeros_like(x), np.zeros_like(x)
    sig = lambda z: 1 / (1 + np.exp(-z))
    for t in range(1, rounds + 1):
        w, bias, leak = x[:n_words], x[-2], x[-1]
        z = bias + np.bincount(tok_sent, w[tok_word], n_sent)
        p = sig(z)
        kept = -np.logaddexp(0, z)  # log(1 - p)
        log_none = np.bincount(sent_doc, kept, len(y)) - plain * np.logaddexp(0, bias) - np.logaddexp(0, leak)
        none = np.exp(np.minimum(log_none, -1e-9))
        # d likelihood / d log_none: -none/(1-none) for toxic documents, 1 for others
        g = np.where(y > 0, -none / (1 - none), 1.0)
        gz = g[sent_doc] * -p
        grad = np.r_[np.bincount(tok_word, gz[tok_sent], n_words) - l1, gz.sum() - (g * plain).sum() * sig(bias), g.sum() * -sig(leak)]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        x = x + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        x[:n_words] = np.maximum(x[:n_words], 0)
        x[-2:] = np.minimum(x[-2:], [PLAIN, math.log(0.2 / 0.8)])
    weights = {w: float(a) for w, a in zip(words, x[:n_words]) if a > 0.05}
    return Model(weights, float(x[-2]), float(sig(x[-1])))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS) -> Model:
    """A model from the labelled documents that aren't held out, fit_rows of them at most.

    A document labelled more than once counts as toxic if one of the labels says so; of rows that repeat an identifier the
    first text counts. Null labels and ids are left out. The driver gets the selected features and where they stand, not texts.
    """
    known = labels.select(F.col(id_col).alias("k"), F.col(label_col).cast("int").alias("label")).dropna().where(~held_out(F.col("k"))).groupBy("k").agg(F.max("label").alias("label"))
    known = known.orderBy(F.md5(F.col("k").cast("string")), "k").limit(fit_rows)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    rows = durable(texts.join(F.broadcast(known), F.col("id") == F.col("k")).groupBy("id", (F.col("label") > 0).cast("int").alias("label")).agg(F.min("t").alias("t")))  # fit_rows rows of two numbers
    n, toxic = rows.agg(F.count("*"), F.sum("label")).first()
    words = []
    if n and 0 < toxic < n:
        counts = durable(rows.mapInArrow(_features, "feature string, label int").groupBy("feature").agg(F.count("*").alias("seen"), F.sum("label").alias("toxic")))
        words = select_features(counts, n, toxic)
        discard(counts)
    kind = rows.schema["id"].dataType.simpleString()
    hits = rows.mapInArrow(partial(_hits, index={w: i for i, w in enumerate(words)}), f"id {kind}, label int, plain int, hits array<array<int>>")
    got = sorted((r["id"], r["label"], r["plain"], r["hits"]) for r in hits.toLocalIterator())
    discard(rows)
    return fit(words, [x[1:] for x in got])


_SENTENCES = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def _scores(batches: Iterator[pa.RecordBatch], model: Model, at: float, text_col: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        scores, offending = [], []
        for t in batch.column(batch.schema.names.index(text_col)):
            score, hit = model.score(t.as_py() or "")
            scores.append(min(1.0, max(0.0, score)))
            most = max((p for _, _, p in hit), default=1.0)
            offending.append([{"start": a, "end": b, "score": p} for a, b, p in hit if score >= at and p >= min(at, most)])
        rest = [(c, n) for c, n in zip(batch.columns, batch.schema.names) if n != text_col]
        yield pa.RecordBatch.from_arrays([*(c for c, _ in rest), pa.array(scores, pa.float64()), pa.array(offending, _SENTENCES)], names=[*(n for _, n in rest), "__score", "__sentences"])


def score_texts(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """docs with __score, and __sentences: array of (start, end, score), in characters of the text, from 0.

    The sentences are those that score threshold or more in a document that does; where none alone does, the most toxic ones.
    Null text counts as empty and scores the model's leak; ids, languages and sources are not inputs. Whole texts of any
    length are read, one batch at a time. All rows and columns stay, but for columns of docs that are called __score or
    __sentences, which are replaced; an empty table gives an empty result.
    """
    docs = docs.drop("__score", "__sentences")
    read = unused(docs, "__text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", __score double, __sentences array<struct<start: bigint, end: bigint, score: double>>"
    return docs.withColumn(read, F.col(text_col)).mapInArrow(partial(_scores, model=model, at=threshold, text_col=read), schema)
