"""SentencePiece encoding and decoding with N-best segmentations.

A text is normalised as the model files here ask for: a space in front, spaces written
as U+2581.  Its lattice has an edge for each vocabulary piece at each place, with the
piece's stored score; a character that is no piece has one edge, its UTF-8 bytes as
byte pieces, at ``unknown`` points below the lowest score of a character.  (A U+2581 in
the text itself is such a character, so decoding gives back every text exactly.)

N-best search.  Forward Viterbi gives the best score of reaching each place.  Backward
A* from the end uses it as an exact estimate of what is still to come, so it pops only
prefixes of answers, best first.  The search adds whole numbers (in doubles, exactly): scores
in steps of 1/64, and for each edge a hash below 1/1024 that orders equal scores the same way
everywhere.  So the order is exact where scores are whole, as in the vocabulary here, and
paths differ in less than a thousand edges of a chunk.  What is reported as a path's score
is the sum of its pieces' stored scores alone.  Stored scores at or below -1e8, which mark
pieces that are never merged to, count as twice the lowest other.

No piece holds a space mark behind another character or goes on after the end of a word
(this is looked up in the vocabulary, not assumed), and many characters occur in no longer
piece, so the lattice falls into chunks that every path passes between.  A
chunk's best path and its loss to the second best are kept in a bounded cache.  The N
best paths of a text differ from its best path only in the N - 1 chunks that lose
least (the earlier of equals); those alone are searched by A*, and their losses are
combined.  Of equal sums the one that departs from the best path earlier comes first.

The vocabulary is read on the driver from ``model``, a parameter, and shipped (some MB,
whatever the corpus).  Rows are independent: one pass, no shuffle, whole texts.

Edge cases.  A null or empty text has no pieces, one segmentation (the empty one) and
decodes to the empty text.  Texts with fewer than N segmentations return them all.
Repeated rows are each encoded; extra columns are carried or ignored as said below.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_texts, small_batches

MODEL, BEST, CACHE = "/opt/tokenizers/piece_bpe_32k.model", 4, 1_000_000
SPACE, OWN = "▁", "\udc81"  # OWN stands for a U+2581 of the text; no valid text holds it
_UNIT, _LOW, _PLACES = 1 << 22, (1 << 12) - 1, 16  # a point of score; an edge's hash, by its place modulo 16
_NONE, _ALONE = (None, None, None), float("inf")  # the loss where there is no second path


class Vocabulary:
    """Pieces, their ids and scores; what byte pieces and pieces decode to."""

    def __init__(self, pieces: list[tuple[str, int, float]], byte_ids: dict[int, int], size: int, unknown: float = 10.0):
        self.edges: dict[str, tuple[list[float], bytes]] = {}
        self.spell = [b""] * size
        self.byte_ids = byte_ids
        for b, i in byte_ids.items():
            self.spell[i] = bytes([b])
        lowest = min((s for _, _, s in pieces if s > -1e8), default=0.0)
        for text, i, score in pieces:
            self.edges[text] = self.weights(score if score > -1e8 else 2 * lowest, i), i.to_bytes(4, "little")
            self.spell[i] = text.replace(SPACE, " ").encode()
        self.lowest = lowest - unknown
        # Points of each id; a character that is no piece has its points at its first byte.
        self.points = np.zeros(size)
        for _, i, score in pieces:
            self.points[i] = score if score > -1e8 else 2 * lowest
        for b, i in byte_ids.items():
            self.points[i] = 0.0 if 0x80 <= b < 0xC0 else self.lowest
        if not byte_ids:
            self.points[0] = self.lowest
        longer = [t for t, _, _ in pieces if len(t) > 1]
        # A tree over characters: (deeper node, weights and ids of the piece that ends here), or None for each.
        self.tree: dict[str, tuple] = {}
        for text, piece in sorted(self.edges.items()):
            node = self.tree
            for c in text[:-1]:
                deeper, *own = node.get(c, _NONE)
                if deeper is None:
                    deeper = {}
                    node[c] = (deeper, *own)
                node = deeper
            node[text[-1]] = (node.get(text[-1], _NONE)[0], *piece)
        inner = {c for t in longer for c in t} | {SPACE}
        of = lambda chars: "[" + "".join(re.escape(c) for c in sorted(chars)) + "]" if chars else "(?!)"
        letters = {c for c in inner if c.isalpha()}
        word, other = of(inner - {SPACE}), of(inner - letters - {SPACE})
        if any(re.search(f"[^{SPACE}]{SPACE}", t) for t in longer):  # pieces cross spaces
            pattern = f"(?:{word}|{SPACE})+|."
        elif any(x in letters and y not in letters for t in longer for x, y in zip(t, t[1:])):  # or ends of words
            pattern = f"{SPACE}*{word}+|{SPACE}+|."
        else:
            pattern = f"{SPACE}*{other}*{of(letters)}+|{SPACE}*{other}+|{SPACE}+|."
        self.chunks = re.compile(pattern, re.DOTALL)

    @staticmethod
    def weights(score: float, i: int) -> list[float]:
        """The score as a whole number with a hash that orders equal scores, by place."""
        h = (i * 0x9E3779B1 ^ 0x5BD1E995) * 0x85EBCA6B >> 7
        return [float(round(score * 64) * (_UNIT // 64) + (h * (2 * p + 1) >> 5 & _LOW)) for p in range(_PLACES)]

    def edge(self, text: str, at: int = 0) -> tuple[float, bytes] | None:
        """Weight and ids of a piece, or of a character that is none, at a place of its chunk."""
        found = self.edges.get(text)
        if found is None and len(text) == 1:
            raw = (SPACE if text == OWN else text).encode("utf-8", "surrogatepass")
            ids = [self.byte_ids[b] for b in raw] if self.byte_ids else [0]
            found = self.weights(self.lowest, ids[-1]), b"".join(i.to_bytes(4, "little") for i in ids)
        return found and (found[0][at % _PLACES], found[1])


def load(model: str = MODEL) -> Vocabulary:
    """From a model file; on the driver."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    ids = range(sp.get_piece_size())
    byte_ids = {int(sp.id_to_piece(i)[3:5], 16): i for i in ids if sp.is_byte(i)}
    plain = [(sp.id_to_piece(i), i, sp.get_score(i)) for i in ids if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    return Vocabulary(plain, byte_ids, len(ids))


def lattice(v: Vocabulary, chunk: str) -> list[list[tuple[int, float, bytes]]]:
    """For each end: (start, weight, ids) of the edges that arrive there."""
    n = len(chunk)
    into: list[list[tuple[int, float, bytes]]] = [[] for _ in range(n + 1)]
    for a in range(n):
        into[a + 1].append((a, *v.edge(chunk[a], a)))
        node = v.tree.get(chunk[a], _NONE)[0]
        z = a + 1
        while node is not None and z < n:
            node, weights, ids = node.get(chunk[z], _NONE)
            z += 1
            if weights is not None:
                into[z].append((a, weights[a % _PLACES], ids))
    return into


def forward(into: list[list[tuple[int, float, bytes]]]) -> list[float]:
    """Viterbi: the best weight of reaching each place."""
    best = [0.0] * len(into)
    for z in range(1, len(into)):
        best[z] = max([best[a] + w for a, w, _ in into[z]])
    return best


def n_best(v: Vocabulary, chunk: str, n: int) -> list[tuple[float, bytes]]:
    """Weights and ids of the n best paths: backward A* under the forward Viterbi weights."""
    into = lattice(v, chunk)
    best = forward(into)
    tick, out = count(), []
    heap = [(-best[-1], next(tick), len(chunk), 0.0, None)]
    while heap and len(out) < n:
        total, _, at, behind, path = heapq.heappop(heap)
        if at == 0:
            ids = []
            while path is not None:
                ids.append(path[0])
                path = path[1]
            out.append((-total, b"".join(ids)))
            continue
        for a, w, ids in into[at]:
            heapq.heappush(heap, (-(best[a] + w + behind), next(tick), a, behind + w, (ids, path)))
    return out


def best_and_loss(v: Vocabulary, chunk: str) -> tuple[float, bytes, float]:
    """Weight and ids of the best path, and what the second best loses; _ALONE if there is none.

    The forward pass alone, with the two best weights of reaching each place.
    """
    n, root = len(chunk), v.tree
    best, second, back = [-_ALONE] * (n + 1), [-_ALONE] * (n + 1), [(0, b"")] * (n + 1)
    best[0] = 0.0
    for a in range(n):
        here, next_, place, z = best[a], second[a], a % _PLACES, a
        node, weights, ids = root.get(chunk[a], _NONE)
        if weights is None:  # a character that is no piece, but may begin one
            w, ids = v.edge(chunk[a], a)
            weights = [w] * _PLACES
        while True:
            z += 1
            if weights is not None:
                w = weights[place]
                value, old = here + w, best[z]
                if value > old:
                    best[z], back[z] = value, (a, ids)
                    w += next_
                    second[z] = old if old > w else w
                elif value > second[z]:
                    second[z] = value
            if node is None or z == n:
                break
            node, weights, ids = node.get(chunk[z], _NONE)
    ids_back, at = [], n
    while at:
        at, ids = back[at]
        ids_back.append(ids)
    return best[n], b"".join(reversed(ids_back)), best[n] - second[n]


class Cache(dict):
    """Best paths of chunks.  Two generations: what wasn't asked for while half of ``most``
    others were is forgotten."""

    def __init__(self, v: Vocabulary, older: dict):
        self.v, self.older = v, older

    def __missing__(self, chunk: str) -> tuple[float, bytes, float]:
        found = self.older.get(chunk) or best_and_loss(self.v, chunk)
        if len(chunk) <= 64:
            self[chunk] = found
        return found


class Encoder:
    def __init__(self, v: Vocabulary, n: int = BEST, cache: int = CACHE):
        self.v, self.n, self.most = v, n, cache
        self.cache = Cache(v, {})
        self.alternatives: dict[str, list[tuple[float, bytes]]] = {}

    def __reduce__(self):
        return Encoder, (self.v, self.n, self.most)

    def _others(self, chunk: str) -> list[tuple[float, bytes]]:
        found = self.alternatives.get(chunk)
        if found is None:
            found = n_best(self.v, chunk, self.n)
            if len(chunk) <= 64:
                if len(self.alternatives) >= self.most // 20:
                    self.alternatives.clear()
                self.alternatives[chunk] = found
        return found

    def encode(self, text: str | None) -> list[tuple[float, bytes]]:
        """(score, ids as 4-byte little-endian numbers) of the N best segmentations, best first."""
        if not text:
            return [(0.0, b"")]
        chunks = self.v.chunks.findall(SPACE + text.replace(SPACE, OWN).replace(" ", SPACE))
        _, path, losses = (list(x) for x in zip(*map(self.cache.__getitem__, chunks)))
        if len(self.cache) * 2 > self.most:
            self.cache.older = {}
            self.cache = Cache(self.v, self.cache)
        out = [b"".join(path)]
        places = []
        for _ in range(self.n - 1):
            least = min(losses)
            if least == _ALONE:
                break
            places.append(losses.index(least))
            losses[places[-1]] = _ALONE
        combined: list[tuple[float, tuple[int, ...]]] = [(0.0, ())]
        places.sort()
        for i in places:
            others = self._others(chunks[i])
            top = others[0][0]
            combined = heapq.nsmallest(self.n, ((loss + top - w, (*ranks, -r)) for loss, ranks in combined for r, (w, _) in enumerate(others)))
        for _, ranks in combined[1 : self.n]:
            other = list(path)
            for i, r in zip(places, ranks):
                if r:
                    other[i] = self._others(chunks[i])[-r][1]
            out.append(b"".join(other))
        return [(self.score(ids), ids) for ids in out]

    def score(self, ids: bytes) -> float:
        return round(float(self.v.points[np.frombuffer(ids, "<u4")].sum()), 6)

    def decode(self, ids: bytes) -> str:
        spell = self.v.spell
        raw = b"".join([spell[i] for i in np.frombuffer(ids, "<u4").tolist()])
        return raw[1:].decode("utf-8", "replace") if raw[:1] == b" " else raw.decode("utf-8", "replace")


def _shipped(spark, model: str, n: int, cache: int = CACHE):
    small_batches(spark)
    return spark.sparkContext.broadcast(Encoder(load(model), n, cache))


def encoded(documents: DataFrame, model: str = MODEL, n: int = BEST) -> DataFrame:
    """(doc_id, paths): each text's N best segmentations with scores, best first."""
    shipped = _shipped(documents.sparkSession, model, n)
    kind = pa.list_(pa.struct([("score", pa.float64()), ("ids", pa.list_(pa.int32()))]))

    def work(batch: pa.RecordBatch) -> pa.Table:
        encoder = shipped.value
        rows = [[{"score": s, "ids": np.frombuffer(ids, "<i4")} for s, ids in encoder.encode(t.as_py())] for t in batch["text"]]
        return pa.Table.from_arrays([batch["doc_id"].cast(pa.int64()), pa.array(rows, kind)], ["doc_id", "paths"])

    return map_texts(documents.select("doc_id", "text"), work, "doc_id long, paths array<struct<score: double, ids: array<int>>>")


def decoded(rows: DataFrame, ids: str = "ids", model: str = MODEL) -> DataFrame:
    """(doc_id, text): what lists of ids spell."""
    shipped = _shipped(rows.sparkSession, model, 1)

    def work(batch: pa.RecordBatch) -> pa.Table:
        texts = [shipped.value.decode(np.asarray(x.as_py() or [], "<u4").tobytes()) for x in batch[ids]]
        return pa.Table.from_arrays([batch["doc_id"].cast(pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])

    return map_texts(rows.select("doc_id", ids), work, "doc_id long, text string")


def encoding_digest(documents: DataFrame, model: str = MODEL, n: int = BEST, cache: int = CACHE) -> DataFrame:
    """Digests of each text's segmentations, and whether the best decodes to the text.

    ``cache`` bounds the chunks that a worker remembers, some 350 bytes each; only the
    speed depends on it.
    """
    shipped = _shipped(documents.sparkSession, model, n, cache)
    names = ["doc_id", "n_tokens", "n_paths", "best_score", "worst_score", "ids_sha256", "paths_sha256", "round_trip"]

    def one(encoder: Encoder, text: str | None) -> tuple:
        paths = encoder.encode(text)
        every = hashlib.sha256()
        for _, ids in paths:
            every.update(len(ids).to_bytes(8, "little") + ids)
        first = paths[0][1]
        return len(first) // 4, len(paths), paths[0][0], paths[-1][0], hashlib.sha256(first).hexdigest(), every.hexdigest(), encoder.decode(first) == (text or "")

    def work(batch: pa.RecordBatch) -> pa.Table:
        rows = [one(shipped.value, t.as_py()) for t in batch["text"]]
        columns = list(zip(*rows)) if rows else [[]] * 7
        types = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.string(), pa.string(), pa.bool_()]
        return pa.Table.from_arrays([batch["doc_id"].cast(pa.int64()), *(pa.array(c, t) for c, t in zip(columns, types))], names)

    return map_texts(documents.select("doc_id", "text"), work, "doc_id long, n_tokens long, n_paths long, best_score double, worst_score double, ids_sha256 string, paths_sha256 string, round_trip boolean")
