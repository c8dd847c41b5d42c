"""Language identification by a string kernel.

A text is the set of its byte n-grams of lengths 1 to 4 (blended spectrum, presence), hashed to 16,384 places. The
kernel of two texts is the size of the common set over the geometric mean of both sizes. Nystroem: kernel values with
some landmark texts, whitened, are the features; one-versus-rest kernel ridge regression gives a weight for each
language. Scoring a batch is two matrix products.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odflow.llm.common import slices, string_bytes

PLACES = 1 << 14
#: Texts whose presence is held at once: 16 MB.
SLICE = 256
ORDERS = 4
_LETTER = regex.compile(r"\p{L}")
U = np.uint32


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """crc32 of the id as text leaves 2 when divided by 4; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def presence(body: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Texts x PLACES, 1.0 where an n-gram of the text falls."""
    n = len(ends) - 1
    out = np.zeros((n, PLACES), np.float32)
    if not len(body):
        return out
    low = body.astype(U)
    low[(body >= 65) & (body <= 90)] += U(32)
    row = np.repeat(np.arange(n, dtype=np.int64) * PLACES, np.diff(ends))
    left = np.repeat(ends[1:], np.diff(ends)) - np.arange(len(body))  # bytes to the end of the text
    flat, code = out.reshape(-1), np.zeros(len(body), U)
    for k in range(ORDERS):
        code[: len(code) - k] = code[: len(code) - k] * U(257) + low[k:] + U(1)
        place = (code * U(2654435761) + U(k * 40503)) >> U(18)
        whole = left > k
        flat[row[whole] + place[whole]] = 1.0
    return out


def _rows(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Presence of some texts and the root of each one's number of places."""
    packed = [t.encode() for t in texts]
    x = presence(np.frombuffer(b"".join(packed), np.uint8), np.cumsum([0, *map(len, packed)]))
    return x, np.sqrt(np.maximum(x.sum(axis=1), 1))


class Model:
    def __init__(self, texts: list[str], labels: list[str], landmarks: int = 128, ridge: float = 1e-3):
        self.classes = sorted(set(labels))
        seen: Counter = Counter()
        turn = []
        for i, y in enumerate(labels):
            turn.append((seen[y], y, i))
            seen[y] += 1
        # landmarks in turn from each language, in the sample's order, one of each at least
        order = [i for _, _, i in sorted(turn)[: max(landmarks, len(self.classes))]]
        at = [_rows([texts[i] for i in order[lo : lo + SLICE]]) for lo in range(0, len(order), SLICE)]
        self.landmarks = np.concatenate([x / size[:, None] for x, size in at]).T.copy()
        k = np.concatenate([(x @ self.landmarks) / size[:, None] for x, size in (_rows(texts[lo : lo + SLICE]) for lo in range(0, len(texts), SLICE))])
        value, vector = np.linalg.eigh(k[order].astype(np.float64))
        keep = value > 1e-6 * value.max()
        whiten = vector[:, keep] / np.sqrt(value[keep])
        features = np.c_[k @ whiten, np.ones(len(k))]
        target = np.where(np.array(labels)[:, None] == np.array(self.classes), 1.0, -1.0)
        gram = features.T @ features + ridge * len(k) * np.eye(features.shape[1])
        weight = np.linalg.solve(gram, features.T @ target)
        self.weight, self.bias = (whiten @ weight[:-1]).astype(np.float32), weight[-1].astype(np.float32)

    def scores(self, body: np.ndarray, ends: np.ndarray) -> np.ndarray:
        x = presence(body, ends)
        size = np.sqrt(np.maximum(x.sum(axis=1), 1))
        return ((x @ self.landmarks) / size[:, None]) @ self.weight + self.bias


def fit(docs: DataFrame, per_language: int = 250, most: int = 8000) -> Model | None:
    """From about ``per_language`` labelled texts of each language and ``most`` in all (these bounds are parameters), never held-out ones."""
    labelled = docs.select("doc_id", "lang", "text").filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    per_language = min(per_language, max(1, most // len(counts)))
    part = F.lit(0.0)
    for lang, n in sorted(counts.items()):  # a row a language
        part = F.when(F.col("lang") == lang, F.lit(min(1.0, per_language / n))).otherwise(part)
    order = F.xxhash64("doc_id", F.lit(8))
    rows = labelled.filter((order.cast("double") / 2.0**64 + 0.5) < part).select("lang", "text", order.alias("order")).collect()
    rows.sort(key=lambda r: (r["order"], r["text"]))
    return Model([r["text"] for r in rows], [r["lang"] for r in rows])


def predictions(docs: DataFrame, model: Model | None = None, per_language: int = 250) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row; the model is fitted on ``docs`` unless given.

    lang_pred is ``und`` with score 0 for null text, text without a letter, or when no row is labelled. score is the
    winner's share of exp(8 * regression value). Ties go to the language first by name. Repeated rows each have a row.
    """
    model = model or fit(docs, per_language)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches):
        model = shared.value
        for batch in slices(batches, "text", 1 << 20, 256):
            text = batch.column("text")
            names, score = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
            if model is not None and batch.num_rows:
                raw = model.scores(*string_bytes(text))
                best = raw.argmax(axis=1)
                share = np.exp(8.0 * (raw - raw.max(axis=1, keepdims=True)))
                share = 1.0 / share.sum(axis=1)
                for i, t in enumerate(text.to_pylist()):
                    if _LETTER.search(t):
                        names[i], score[i] = model.classes[best[i]], share[i]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    source = docs.select("doc_id", held_out().alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(predict, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
