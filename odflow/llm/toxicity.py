"""Toxicity by multiple-instance learning.

A document is a bag of sentences and only the bag is labelled. A sentence's score is a logistic function of its words'
features (the word and its first 3 to 6 letters); the document's is their noisy-or, 1 - prod(1 - p). Weights are learned
from document labels by gradient steps on the bag likelihood, and the sentence scores then locate the offence. Sentences
without a feature that speaks for toxicity score 0.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odflow.llm.common import slices
from odflow.llm.language import held_out

_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"[.!?\n]+")


def word_features(word: str) -> tuple[str, ...]:
    return (word, *(word[:k] + "*" for k in range(3, min(6, len(word)) + 1)))


def bag_slope(p: np.ndarray, miss: np.ndarray, owner: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slope of minus the bags' log likelihood by each sentence's logit: p its score, miss the log of its bag's prod(1 - p)."""
    hit = np.maximum(1 - np.exp(miss), 1e-9)
    return np.where(y[owner] == 1, -(np.exp(miss) / hit)[owner] * p, p)


class Model:
    """weights: of features; bias: of a sentence."""

    def __init__(self, texts: list[str], labels: list[int], steps: int = 300, least: int = 4):
        bags = [[set(_WORD.findall(s)) for s in _SENTENCE.split(t.lower())] for t in texts]
        seen = {0: Counter(), 1: Counter()}
        for bag, y in zip(bags, labels):
            seen[y].update({f for words in bag for w in words for f in word_features(w)})
        total = Counter(labels)
        odds = {f: np.log((n + 0.1) / (total[1] + 0.2)) - np.log((seen[0][f] + 0.5) / (total[0] + 1.0)) for f, n in seen[1].items() if n >= least}
        chosen = sorted(f for f, v in odds.items() if v > 2.5)
        index = {f: i for i, f in enumerate(chosen)}
        sentence, feature, owner = [], [], []
        for d, bag in enumerate(bags):
            for words in bag:
                own = {index[f] for w in words for f in word_features(w) if f in index}
                if own:
                    sentence += [len(owner)] * len(own)
                    feature += sorted(own)
                    owner.append(d)
        sentence, feature, owner, y = (np.array(x, np.int64) for x in (sentence, feature, owner, labels))
        self.bias, weight = -4.0, np.array([0.7 * odds[f] for f in chosen])
        moment, size, bias_m, bias_s = np.zeros_like(weight), np.zeros_like(weight), 0.0, 0.0
        for t in range(1, steps + 1 if len(chosen) and len(owner) else 1):
            z = self.bias + np.bincount(sentence, weight[feature], len(owner))
            p = 1 / (1 + np.exp(-z))
            miss = np.bincount(owner, np.log1p(-np.minimum(p, 1 - 1e-9)), len(y))
            slope = bag_slope(p, miss, owner, y)
            grad = np.bincount(feature, slope[sentence], len(weight)) + 0.05 * (weight - 1.0)
            bias_g = slope.sum() + 0.05 * (self.bias + 4.0)
            moment, size = 0.9 * moment + 0.1 * grad, 0.99 * size + 0.01 * grad**2
            bias_m, bias_s = 0.9 * bias_m + 0.1 * bias_g, 0.99 * bias_s + 0.01 * bias_g**2
            rate = 0.05 / (1 - 0.9**t) * np.sqrt(1 - 0.99**t)
            weight = np.maximum(weight - rate * moment / (np.sqrt(size) + 1e-8), 0.0)
            self.bias = min(self.bias - rate * bias_m / (np.sqrt(bias_s) + 1e-8), -1.0)
        self.weights = {f: float(w) for f, w in zip(chosen, weight) if w > 0}

    def sentences(self, text: str, cache: dict | None = None) -> list[tuple[str, float]]:
        """Each sentence with its score; those without evidence score 0."""
        out = []
        for s in _SENTENCE.split(text):
            own = {f for w in set(_WORD.findall(s.lower())) for f in word_features(w) if f in self.weights}
            out.append((s, 1 / (1 + np.exp(-self.bias - sum(self.weights[f] for f in own))) if own else 0.0))
        return out


def fit(docs: DataFrame, labels: DataFrame, bound: int = 3000) -> Model:
    """From about ``bound`` labelled documents of each class at most, never held-out ones (that bound is the parameter).

    Rows of labels without a document, null labels and null texts are left out; a document labelled twice counts as toxic
    if one label says so.
    """
    marks = labels.filter(F.col("toxic").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    unit = F.xxhash64("doc_id", F.lit(5)).cast("double") / 2.0**64 + 0.5
    chosen = marks.filter(unit < F.when(F.col("toxic") == 1, min(1.0, bound / max(1, counts.get(1, 0)))).otherwise(min(1.0, bound / max(1, counts.get(0, 0)))))
    # at most about twice ``bound`` ids: small enough to broadcast, so that no text is shuffled
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").filter(F.col("text").isNotNull()).select("doc_id", "text", "toxic").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["text"]))
    return Model([r["text"] for r in rows], [int(r["toxic"] == 1) for r in rows])


def scores(docs: DataFrame, model: Model, threshold: float = 0.3, hold: int = 500_000) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_toxic_sentences, worst_sentence) of every row.

    Null and empty texts score 0. worst_sentence is the number of the sentence of highest score (the first of ties), null
    without evidence. Repeated rows each have a row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        model, speaks = shared.value, {}
        for batch in slices(batches, "text"):
            rows = []
            for text in batch.column("text").to_pylist():
                words = _WORD.findall(text.lower())
                hit = False
                for w in words:
                    got = speaks.get(w)
                    if got is None:
                        if len(speaks) >= hold:
                            speaks.clear()
                        got = speaks[w] = any(f in model.weights for f in word_features(w))
                    if got:
                        hit = True
                        break
                own = [p for _, p in model.sentences(text)] if hit else []
                total = 1.0 - float(np.prod([1.0 - p for p in own])) if own else 0.0
                rows.append((total, int(total >= threshold), sum(p >= threshold for p in own), int(np.argmax(own)) if total > 0 else None))
            kinds = (("score", pa.float64()), ("predicted", pa.int32()), ("n_toxic_sentences", pa.int64()), ("worst_sentence", pa.int64()))
            columns = [pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), *columns], ["doc_id", "held_out", *(k for k, _ in kinds)])

    kind = docs.schema["doc_id"].dataType.simpleString()
    source = docs.select("doc_id", held_out().alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    return source.mapInArrow(score, f"doc_id {kind}, held_out boolean, score double, predicted int, n_toxic_sentences long, worst_sentence long")
