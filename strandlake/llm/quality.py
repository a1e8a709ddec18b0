"""Quality classifier: hashed word n-gram logistic regression, fitted by FTRL-proximal.

Tokens are runs of word bytes (A-Z lower-cased) and runs of other visible ASCII bytes.
Each token and each pair of neighbours is hashed to one of 2^bits weights (a pair of
equal tokens to one weight, whatever the token); a feature's
value is its count over the root of the number of features.  A score is the logistic
of a sparse dot product.

The model is fitted on the driver on at most ``most`` labelled texts, of any length, that
have ``most`` times ``most_bytes`` bytes at most in all (documented bounds on the sample; a
quarter of them dealt evenly to the labels, taken by hash; the bias is set right for
labels that the sample has more of); the scoring reads all rows once, without a shuffle, with 2^bits weights (1 MB) shipped.

Edge cases.  Null and empty texts have no features and get the logistic of the bias.
Null labels are ignored, of several labels of an id the greatest counts.  With no
labelled row, scores are 0.5.  Repeated rows are each scored; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, WORD, bounded_sample, grams, map_texts, oversampled, per_text, run_hashes, runs, sigmoid, small_batches, split_of, text_buffer

BITS, SAMPLE, SAMPLE_BYTES, CUT = 18, 4000, 16384, 0.3
REPEAT = U64(0x5851F42D4C957F2D)  # one feature for all pairs of equal tokens
_CLASS = np.zeros(256, np.uint8)
_CLASS[0x21:0x7F] = 2
_CLASS[WORD > 0] = 1
_BYTE = np.where(WORD > 0, WORD, np.arange(256)).astype(np.uint8)


def features(raw: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of tokens and of pairs, each with n + 1 offsets."""
    starts, ends = runs(_CLASS[raw], offsets)
    h = run_hashes(_BYTE[raw], starts, ends)
    at = np.searchsorted(starts, offsets)
    pair, pair_at = grams(h, at, 2)
    second = np.arange(len(pair)) + np.repeat(at[:-1] - pair_at[:-1], np.diff(pair_at)) + 1
    pair[h[second] == h[second - 1]] = REPEAT
    shift = U64(64 - bits)
    return (h >> shift).astype(np.int64), at, (pair >> shift).astype(np.int64), pair_at


class Ftrl:
    """Follow-the-regularised-leader with a learning rate for each weight; the last is the bias."""

    def __init__(self, size: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.05, l2: float = 1.0):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, i) -> np.ndarray:
        z, n = self.z[i], self.n[i]
        free = np.asarray(i) == len(self.z) - 1
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        w = np.where(np.abs(z) <= self.l1, 0.0, w)
        return np.where(free, -z / ((self.beta + np.sqrt(n)) / self.alpha), w)

    def learn(self, i: np.ndarray, x: np.ndarray, y: float) -> None:
        w = self.weights(i)
        g = (sigmoid(w @ x) - y) * x
        n = self.n[i]
        self.z[i] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[i] = n + g * g


def fit(texts: list[str], labels: list[int], bits: int = BITS, epochs: int = 4) -> np.ndarray:
    """2^bits weights and the bias."""
    raw, offsets = text_buffer(pa.array(texts, pa.large_string()))
    one, at, two, pair_at = features(raw, offsets, bits)
    model = Ftrl(1 << bits)
    rows = []
    for i, y in enumerate(labels):
        idx, count = np.unique(np.concatenate([one[at[i] : at[i + 1]], two[pair_at[i] : pair_at[i + 1]]]), return_counts=True)
        x = count / np.sqrt(max(1, count.sum()))
        rows.append((np.append(idx, 1 << bits), np.append(x, 1.0), float(y)))
    for _ in range(epochs):
        for row in rows:
            model.learn(*row)
    return model.weights(np.arange((1 << bits) + 1)).astype(np.float32)


def score(weights: np.ndarray, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    bits = (len(weights) - 1).bit_length() - 1
    one, at, two, pair_at = features(raw, offsets, bits)
    w = weights.astype(np.float64)
    n = np.maximum(np.diff(at) + np.diff(pair_at), 1)
    return sigmoid((per_text(w[one], at) + per_text(w[two], pair_at)) / np.sqrt(n) + w[-1])


def labelled(labels: DataFrame, column: str, parts: int, out: int) -> DataFrame:
    """(doc_id, label), one row to an id, of the rows that may be learned from."""
    known = labels.filter(F.col(column).isNotNull() & (split_of(parts=parts) != out))
    return known.groupBy("doc_id").agg(F.max(F.col(column).cast("int")).alias("label"))


def score_quality(documents: DataFrame, labels: DataFrame, most: int = SAMPLE, most_bytes: int = SAMPLE_BYTES, cut: float = CUT) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``documents``."""
    small_batches(documents.sparkSession)
    sample, counts = bounded_sample(labelled(labels, "quality", 5, 0), documents, most, most_bytes)
    y = [r["label"] for r in sample]
    weights = fit([r["text"] for r in sample], y)
    weights[-1] -= oversampled(y, counts)
    shipped = documents.sparkSession.sparkContext.broadcast(weights)

    def work(batch: pa.RecordBatch) -> pa.Table:
        p = score(shipped.value, *text_buffer(batch["text"]))
        return pa.Table.from_arrays([batch["doc_id"].cast(pa.int64()), batch["held_out"], pa.array(p), pa.array((p >= cut).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = documents.select("doc_id", (split_of(parts=5) == 0).alias("held_out"), "text")
    return map_texts(rows, work, "doc_id long, held_out boolean, score double, predicted int")
