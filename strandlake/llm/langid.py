"""Language identification: known words first, then shorter and shorter character n-grams.

A word is a run of a-z (A-Z lower-cased with Unicode rules beforehand) and non-ASCII
bytes.  A known word adds each language's log frequency of it.  For an unseen word the
longest character n-grams are tried, marks at its ends included; if none of its n-grams of
that length is known, those of n - 1 characters are, down to single ones.  The known ones add
their mean log frequency.  The greatest sum is the prediction; ``score`` is its
probability with the evidence of at most ``trust`` words.

Fitted on the driver on at most ``most`` texts, of any length, that have a language and
``most`` times ``most_bytes`` bytes at most in all (documented bounds on the sample, dealt
evenly to the languages, taken by hash); the tables
hold no more than what that sample has, and are shipped to all executors.  Scoring
reads all rows once, without a shuffle.

Edge cases.  Texts that are null or have no letter are ``und`` with score 0, so is
every text if there is nothing to learn from.  Ties go to the first language in
alphabetical order.  Repeated rows are each scored; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, bounded_sample, map_texts, run_hashes, runs, slices, small_batches, spaced, split_of, text_buffer

LONGEST, SAMPLE, SAMPLE_BYTES, TRUST = 5, 4000, 8192, 20
_LETTER = np.zeros(256, np.uint8)
_LETTER[0x61:0x7B] = np.arange(0x61, 0x7B)
_LETTER[0x80:] = np.arange(0x80, 0x100)


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Mapped bytes, starts and ends of words, and n + 1 word offsets."""
    raw, offsets = spaced(*text_buffer(pc.utf8_lower(column.cast(pa.large_string()))))
    mapped = _LETTER[raw]
    starts, ends = runs((mapped != 0).astype(np.uint8), np.concatenate([[0], offsets]))
    return mapped, starts, ends, np.searchsorted(starts, offsets)


def _parts(mapped: np.ndarray, starts: np.ndarray, ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the n-character parts of words with a mark at either end, and the word of each."""
    first = (mapped & 0xC0) != 0x80  # of a UTF-8 character; marks are the zero bytes around a word
    at = np.append(np.flatnonzero(first), len(mapped))
    nth = np.cumsum(first) - 1
    lo, hi = nth[starts - 1], nth[ends]
    count = np.maximum(hi - lo + 2 - n, 0)
    word = np.repeat(np.arange(len(starts)), count)
    pos = np.arange(len(word)) - np.repeat(np.cumsum(count) - count, count) + lo[word]
    return run_hashes(mapped, at[pos], at[pos + n], n), word


class Frequencies:
    """Log frequencies of keys in each language, with a tenth added to each count.

    The parts, pairs of keys and their languages, are counted one after the other.
    """

    def __init__(self, parts: Iterator[tuple[np.ndarray, np.ndarray]], languages: int):
        self.keys, count = np.zeros(0, U64), np.zeros((0, languages), np.int64)
        for keys, lang in parts:
            own, at = np.unique(keys, return_inverse=True)
            more = np.bincount(at * languages + lang, minlength=len(own) * languages).reshape(len(own), languages)
            every, at = np.unique(np.concatenate([self.keys, own]), return_inverse=True)
            total = np.zeros((len(every), languages), np.int64)
            total[at[: len(self.keys)]] = count
            total[at[len(self.keys) :]] += more
            self.keys, count = every, total
        self.log = np.log((count + 0.1) / (count.sum(0) + 0.1 * max(1, len(self.keys)))).astype(np.float32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, or -1."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)


class Model:
    def __init__(self, texts: list[str], langs: list[str]):
        self.names = sorted(set(langs))
        own = {x: i for i, x in enumerate(self.names)}
        spans = [(texts[i : i + 250], np.array([own[x] for x in langs[i : i + 250]], np.int64)) for i in range(0, len(texts), 250)]

        def words() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for part, lang in spans:
                mapped, starts, ends, at = _words(pa.array(part, pa.large_string()))
                yield run_hashes(mapped, starts, ends), np.repeat(lang, np.diff(at))

        def parts(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for part, lang in spans:
                mapped, starts, ends, at = _words(pa.array(part, pa.large_string()))
                keys, word = _parts(mapped, starts, ends, n)
                yield keys, np.repeat(lang, np.diff(at))[word]

        self.words = Frequencies(words(), len(self.names))
        self.parts = {n: Frequencies(parts(n), len(self.names)) for n in range(LONGEST, 0, -1)}

    def totals(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Sums of log frequencies for each text and language, and words that count."""
        mapped, starts, ends, at = _words(column)
        rows = self.words.find(run_hashes(mapped, starts, ends))
        value = np.zeros((len(starts), len(self.names)), np.float32)
        value[rows >= 0] = self.words.log[rows[rows >= 0]]
        open_ = np.flatnonzero(rows < 0)
        for n in range(LONGEST, 0, -1):
            if not len(open_):
                break
            keys, word = _parts(mapped, starts[open_], ends[open_], n)
            found = self.parts[n].find(keys)
            ok = found >= 0
            hits = np.bincount(word[ok], minlength=len(open_))
            for x in range(len(self.names)):
                sums = np.bincount(word[ok], self.parts[n].log[found[ok], x], minlength=len(open_))
                value[open_, x] = sums / np.maximum(hits, 1)
            open_ = open_[hits == 0]
        out = np.zeros((len(at), len(self.names)))
        total = np.concatenate([np.zeros((1, len(self.names))), np.cumsum(value, 0, dtype=np.float64)])
        out = total[at[1:]] - total[at[:-1]]
        return out, np.diff(at)


def predict(model: Model, column: pa.Array) -> tuple[list[str], np.ndarray]:
    letter = pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(zero_copy_only=False)
    names, score = ["und"] * len(column), np.zeros(len(column))
    if not model.names:
        return names, score
    total, n = model.totals(column)
    # 1e-6 steps: a sum's rounding must not depend on the other texts of the batch.
    mean = np.round(total / np.maximum(n, 1)[:, None], 6)
    best = mean.argmax(1)
    z = (mean - mean.max(1, keepdims=True)) * np.minimum(np.maximum(n, 1), TRUST)[:, None]
    p = 1.0 / np.exp(z).sum(1)
    for i in np.flatnonzero(letter):
        names[i] = model.names[best[i]]
    return names, np.where(letter, np.round(p, 6), 0.0)


def identify(documents: DataFrame, most: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of ``documents``."""
    small_batches(documents.sparkSession)
    known = documents.filter(F.col("lang").isNotNull() & (split_of() != 2)).select("doc_id", "text", F.col("lang").alias("label"))
    sample, _ = bounded_sample(known, None, most, most_bytes, even=1.0)
    shipped = documents.sparkSession.sparkContext.broadcast(Model([r["text"] for r in sample], [r["label"] for r in sample]))

    def work(batch: pa.RecordBatch) -> pa.Table:
        column = batch["text"].cast(pa.large_string())
        _, offsets = text_buffer(column)
        parts = [predict(shipped.value, column.slice(i, j - i)) for i, j in slices(offsets)]
        names = [x for p, _ in parts for x in p]
        score = np.concatenate([s for _, s in parts]) if parts else np.zeros(0)
        return pa.Table.from_arrays([batch["doc_id"].cast(pa.int64()), batch["held_out"], pa.array(names, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    rows = documents.select("doc_id", (split_of() == 2).alias("held_out"), "text")
    return map_texts(rows, work, "doc_id long, held_out boolean, lang_pred string, score double")
