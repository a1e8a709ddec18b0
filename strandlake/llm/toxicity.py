"""Toxicity: a linear-chain conditional random field tags toxic words.

Tokens are words (A-Z lower-cased); a chain is a sentence, cut after ``longest``
tokens.  A token's features are the word, its first 4, 5, 6 and 7 bytes and its last 4,
hashed to 2^bits weights; two states (other, toxic) and their transitions have weights.
Forward-backward gives each token's marginal; a document's score is the logistic of a
few aggregates of its marginals, and words whose marginal reaches 0.5 are its offending
spans.

Fitting, on the driver, on at most ``most`` labelled texts, of any length, that have
``most`` times ``most_bytes`` bytes at most in all (documented bounds; a quarter of them
dealt evenly to the labels, taken by hash; near copies left out; the intercept is set
right for labels that the sample has more of).  Token labels
come from the document labels: a word, or a beginning of a word, marks toxic tokens
if it occurs in at least ``evidence`` toxic texts and at least 85 % of the texts that
have it are toxic; tokens with such a mark in toxic texts are labelled toxic.  The field
is then fitted by conditional likelihood, the aggregates by logistic regression on the
document labels.  Scoring reads all rows once, without a shuffle, with 2^bits weights
shipped.

Edge cases.  Null, empty and wordless texts have no tokens and get the score of no
evidence.  Null labels are ignored; of several labels of an id the greatest counts.
With no labelled row every score is 0.5; without toxic rows no token is toxic.  Unless
there are labelled texts of both kinds and marks of toxic ones, ``without_toxic`` keeps every row.  Repeated
rows are each scored; extra columns are ignored (``score``) or kept (``without_toxic``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import trim
from .common import U64, WORD, bounded_sample, carried, map_texts, oversampled, per_text, run_hashes, runs, sigmoid, slices, small_batches, split_of, text_buffer, without_near_copies
from .quality import labelled

BITS, LONGEST, SAMPLE, SAMPLE_BYTES, EVIDENCE, CUT = 18, 96, 2000, 4096, 5, 0.3
HEADS = (4, 5, 6, 7)
_BREAK = np.zeros(256, bool)
_BREAK[[0x0A, 0x21, 0x2E, 0x3F]] = True


class Tokens:
    """Words of some texts, their chains and hashed features."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, bits: int = BITS, longest: int = LONGEST):
        self.low = WORD[raw]
        self.starts, self.ends = runs((self.low != 0).astype(np.uint8), offsets)
        self.at, self.offsets, n = np.searchsorted(self.starts, offsets), offsets, len(self.starts)
        self.text = np.repeat(np.arange(len(offsets) - 1), np.diff(self.at))
        self.features = np.empty((2 + len(HEADS), n), np.int32)
        for i in range(len(self.features)):  # one kind at a time: a hash has twice a feature's size
            self.features[i] = self.keys(i) >> U64(64 - bits)
        breaks = np.concatenate([[0], np.cumsum(_BREAK[raw])])[self.starts] if n else np.zeros(0, np.int64)
        new = np.ones(n, bool)
        new[1:] = (breaks[1:] != breaks[:-1]) | (self.text[1:] != self.text[:-1])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, n))
        pieces = -(-size // longest)  # long sentences go in several chains
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = np.repeat(first, pieces) + nth * longest
        length = np.minimum(np.repeat(size, pieces) - nth * longest, longest)
        order = np.argsort(-length, kind="stable")
        self.begin, self.length = begin[order], length[order]

    def keys(self, kind: int) -> np.ndarray:
        """Hashes of each word (0), its beginnings (1 and on) or its end (the last)."""
        if kind == 0:
            return run_hashes(self.low, self.starts, self.ends)
        if kind <= len(HEADS):
            return run_hashes(self.low, self.starts, np.minimum(self.ends, self.starts + HEADS[kind - 1]), HEADS[kind - 1])
        return run_hashes(self.low, np.maximum(self.starts, self.ends - 4), self.ends, 7)


def forward_backward(e: np.ndarray, begin: np.ndarray, length: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of state 1 for each token, and summed marginals of state pairs.

    ``e``: log odds of state 1 from the features; ``t``: 2 x 2 transition weights.
    All chains advance together, longest first, so the active ones are a prefix.
    """
    m, x = np.exp(t), np.exp(np.clip(e, -30, 30))
    f, b = np.empty(len(e)), np.empty(len(e))  # normalised messages' share of state 1
    pairs = np.zeros((2, 2))
    if not len(begin):
        return f, pairs
    most = int(length[0])
    active = np.searchsorted(-length, -np.arange(1, most + 1), "right")  # chains with more than s tokens
    f[begin] = x[begin] / (1 + x[begin])
    for s in range(1, most):
        i = begin[: active[s]] + s
        p = f[i - 1]
        one = ((1 - p) * m[0, 1] + p * m[1, 1]) * x[i]
        f[i] = one / (one + (1 - p) * m[0, 0] + p * m[1, 0])
    b[begin + length - 1] = 0.5
    for s in range(most - 2, -1, -1):
        i = begin[: active[s + 1]] + s
        q1, q0 = b[i + 1] * x[i + 1], 1 - b[i + 1]
        one, zero = m[1, 0] * q0 + m[1, 1] * q1, m[0, 0] * q0 + m[0, 1] * q1
        b[i] = one / (one + zero)
        p = f[i]
        cells = [[(1 - p) * m[0, 0] * q0, (1 - p) * m[0, 1] * q1], [p * m[1, 0] * q0, p * m[1, 1] * q1]]
        total = cells[0][0] + cells[0][1] + cells[1][0] + cells[1][1]
        for a in (0, 1):
            for c in (0, 1):
                pairs[a, c] += (cells[a][c] / total).sum()
    one = f * b
    return one / (one + (1 - f) * (1 - b)), pairs


class Field:
    """Weights of the chain and of the documents' aggregates."""

    def __init__(self, bits: int = BITS):
        self.bits = bits
        self.w, self.bias, self.t = np.zeros(1 << bits), 0.0, np.zeros((2, 2))
        self.doc = np.zeros(4)
        self.learned = False

    def odds(self, x: Tokens) -> np.ndarray:
        """Each token's log odds from its features, one kind of feature at a time."""
        e = np.full(x.features.shape[1], float(self.bias))
        for f in x.features:
            e += self.w[f]
        return e

    def marginals(self, x: Tokens) -> np.ndarray:
        return forward_backward(self.odds(x), x.begin, x.length, self.t)[0]

    def fit_chain(self, x: Tokens, y: np.ndarray, steps: int = 30, rate: float = 0.5, l2: float = 1e-3) -> None:
        """Gradient ascent of the conditional likelihood, with a step size for each weight."""
        size = 1 << self.bits
        seen = np.zeros(len(y), bool)
        for s in range(1, int(x.length[0]) if len(x.length) else 0):
            seen[x.begin[: np.searchsorted(-x.length, -s, "left")] + s] = True
        follow = np.flatnonzero(seen)
        gold = np.zeros((2, 2))
        np.add.at(gold, (y[follow - 1], y[follow]), 1)
        observed = sum(np.bincount(f, y, size) for f in x.features)
        gw, gb, gt = np.full(size, 1e-6), 1e-6, np.full((2, 2), 1e-6)
        for _ in range(steps):
            p, pairs = forward_backward(self.odds(x), x.begin, x.length, self.t)
            g = observed - sum(np.bincount(f, p, size) for f in x.features) - l2 * self.w
            gw += g * g
            self.w += rate * g / np.sqrt(gw)
            d = float(y.sum() - p.sum())
            gb += d * d
            self.bias += rate * d / np.sqrt(gb)
            d = gold - pairs - l2 * self.t
            gt += d * d
            self.t += rate * d / np.sqrt(gt)

    def aggregates(self, x: Tokens, p: np.ndarray, faint: float = 0.2) -> np.ndarray:
        """Of each text: log of the expected toxic words, log odds of the likeliest, their share.

        Marginals under ``faint`` don't add up: a long text is not toxic for being long.
        """
        n = np.maximum(np.diff(x.at), 1)
        expected = np.maximum(per_text(np.where(p >= faint, p, 0.0), x.at), 0)
        top = np.zeros(len(n))
        np.maximum.at(top, x.text, p)
        odds = np.log(np.maximum(top, 1e-6)) - np.log(np.maximum(1 - top, 1e-6))
        return np.stack([np.log1p(expected), np.clip(odds, -8, 8) / 4, expected / n], 1)

    def fit_documents(self, a: np.ndarray, y: np.ndarray, steps: int = 300) -> None:
        """Logistic regression by Newton steps, lightly regularised."""
        z = np.column_stack([a, np.ones(len(a))])
        for _ in range(min(steps, 30)):
            p = sigmoid(z @ self.doc)
            g = z.T @ (y - p) - 0.1 * self.doc * [1, 1, 1, 0]
            h = (z * (p * (1 - p))[:, None]).T @ z + np.diag([0.1, 0.1, 0.1, 1e-3])
            self.doc += np.clip(np.linalg.solve(h, g), -2, 2)


def token_labels(x: Tokens, y: np.ndarray, evidence: int) -> np.ndarray:
    """1 for tokens of toxic texts that bear a mark of toxic texts."""
    out = np.zeros(len(x.text), np.int64)
    toxic = y[x.text] == 1
    for kind in range(1 + len(HEADS)):
        keys = x.keys(kind)
        order = np.lexsort((x.text, keys))
        k, t = keys[order], x.text[order]
        first = np.ones(len(k), bool)  # of a key in a text
        first[1:] = (k[1:] != k[:-1]) | (t[1:] != t[:-1])
        names, at = np.unique(k[first], return_inverse=True)
        bad = np.bincount(at, y[t[first]] == 1, len(names))
        every = np.bincount(at, minlength=len(names))
        marks = names[(bad >= evidence) & (bad >= 0.85 * every)]
        out |= np.isin(keys, marks) & toxic
    return out


def fit(texts: list[str], labels: list[int], bits: int = BITS, evidence: int = EVIDENCE, excess: float = 0.0) -> Field:
    """``excess``: of the log odds of a toxic text in the sample over those in all texts."""
    field = Field(bits)
    if not texts:
        return field
    raw, offsets = text_buffer(pa.array(texts, pa.large_string()))
    keep = without_near_copies(raw, offsets)
    raw, offsets = text_buffer(pa.array([texts[i] for i in keep], pa.large_string()))
    y = np.array([labels[i] for i in keep], np.int64)
    x = Tokens(raw, offsets, bits)
    marked = token_labels(x, y, evidence)
    field.learned = bool(marked.any()) and not y.all()
    field.fit_chain(x, marked)
    field.fit_documents(field.aggregates(x, field.marginals(x)), y)
    field.doc[-1] -= excess
    return field


def tag(field: Field, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[list[dict]]]:
    """Scores of texts, and their toxic words as byte offsets in the UTF-8 text."""
    x = Tokens(raw, offsets, field.bits)
    p = field.marginals(x)
    a = field.aggregates(x, p)
    score = sigmoid(np.column_stack([a, np.ones(len(a))]) @ field.doc)
    spans: list[list[dict]] = [[] for _ in score]
    for i in np.flatnonzero(p >= 0.5):
        doc = int(x.text[i])
        spans[doc].append({"lo": int(x.starts[i] - offsets[doc]), "hi": int(x.ends[i] - offsets[doc])})
    return np.round(score, 9), spans


_SPANS = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))


def fitted(documents: DataFrame, labels: DataFrame, most: int = SAMPLE, most_bytes: int = SAMPLE_BYTES, evidence: int = EVIDENCE) -> Field:
    """The field of a sample of the labelled texts."""
    sample, counts = bounded_sample(labelled(labels, "toxic", 4, 2), documents, most, most_bytes)
    y, texts = [r["label"] for r in sample], [r["text"] for r in sample]
    del sample
    field = fit(texts, y, evidence=evidence, excess=oversampled(y, counts))
    del texts
    trim()  # the driver would hold what fitting took until the application ends
    return field


def scored(documents: DataFrame, field: Field, extra: list[str]) -> DataFrame:
    """(doc_id, held_out, score, spans, ...) for each row of ``documents``."""
    shipped = documents.sparkSession.sparkContext.broadcast(field)

    def work(batch: pa.RecordBatch) -> pa.Table:
        raw, offsets = text_buffer(batch["text"])
        parts = [tag(shipped.value, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in slices(offsets)]
        score = np.concatenate([s for s, _ in parts]) if parts else np.zeros(0)
        spans = pa.array([x for _, s in parts for x in s], _SPANS)
        return pa.Table.from_arrays([batch["doc_id"].cast(pa.int64()), batch["_held"], pa.array(score), spans, *(batch[c] for c in extra)], names)

    names = ["doc_id", "held_out", "score", "spans", *extra]
    rows = documents.select("doc_id", (split_of() == 2).alias("_held"), "text", *[c for c in extra if c != "text"])
    schema = "doc_id long, held_out boolean, score double, spans array<struct<lo: bigint, hi: bigint>>"
    return map_texts(rows, work, schema + "".join(f", `{c}` {documents.schema[c].dataType.simpleString()}" for c in extra))


def score_toxicity(documents: DataFrame, labels: DataFrame, extra: list[str] | None = None, **options) -> DataFrame:
    """(doc_id, held_out, score, spans, ...) for each row of ``documents``; options of ``fitted``."""
    small_batches(documents.sparkSession)
    return scored(documents, fitted(documents, labels, **options), extra or [])


def without_toxic(documents: DataFrame, labels: DataFrame, cut: float = CUT, **options) -> DataFrame:
    """Rows of ``documents``, all columns, with a score below ``cut``; all if nothing could be learned."""
    small_batches(documents.sparkSession)
    field = fitted(documents, labels, **options)
    if not field.learned:
        return documents
    inner, others, back = carried(documents, "doc_id", "text")
    kept = scored(inner, field, ["text", *others])
    return back(kept.filter(F.col("score") < cut))
