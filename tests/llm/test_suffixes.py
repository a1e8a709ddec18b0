"""Repeated strings against a brute-force version, and the merge against sorting."""

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandlake.llm import suffixes as S
from strandlake.llm.common import text_buffer


def brute(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        hit = np.zeros(len(r), bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                hit[i : i + length] = True
        kept = bytes(np.frombuffer(r, np.uint8)[~hit])
        edges = np.diff(np.concatenate([[0], hit.astype(int), [0]]))
        out.append((len(r), int(hit.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.binary(max_size=12), max_size=20), min_size=1, max_size=9))
def test_merge_is_sorting_with_common_prefixes(lists):
    runs = []
    for rows in lists:
        rows = sorted((k, (hashlib.md5(k).digest(), 3, 0, 4, k[::-1])) for k in rows)
        runs.append(S.Run.packed([(k, m) for k, m in rows]))
    assert [list(S.Run.read(r)) for r in runs] == [list(S.Run.read(r)) for r in runs]
    got = list(S.merged([S.Run.read(r) for r in runs]))
    assert [k for k, _, _ in got] == sorted(k for rows in lists for k in rows)
    for (a, _, _), (b, n, m) in zip(got, got[1:]):
        assert n == S.shared(a, b) and m[4] == b[::-1]


def test_known_prefixes_are_not_read_again(monkeypatch):
    """Bytes read by the merge stay far under those of a merge that compares from the start."""
    rng = np.random.default_rng(1)
    base = bytes(rng.integers(0, 4, 400, dtype=np.uint8))
    keys = sorted(base[:390] + bytes(rng.integers(0, 4, 10, dtype=np.uint8)) for _ in range(400))
    runs = [[(k, 0 if i == 0 else S.shared(keys[j * 50 + i - 1], k), None) for i, k in enumerate(keys[j * 50 : j * 50 + 50])] for j in range(8)]
    read = 0
    plain = S.shared

    def counting(a, b, at=0):
        nonlocal read
        n = plain(a, b, at)
        read += n - at
        return n

    monkeypatch.setattr(S, "shared", counting)
    assert len(list(S.merged([iter(r) for r in runs]))) == 400
    assert read < 400 * 20 + 8 * 400


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("ab", max_size=150), min_size=1, max_size=5), st.integers(0, 3))
def test_groups_cover_what_brute_force_covers(texts, seed):
    """Both ways of matching, on texts full of repeats; 16-byte strings, 4-byte anchors."""
    length, gram = 16, 4
    texts = [t for t in dict.fromkeys(texts)]
    raw, offsets = text_buffer(pa.array(texts, pa.large_string()))
    place, h, lo, hi = S.anchors(raw, offsets, length, gram)
    data = raw.tobytes()
    rows = []
    for p, key, a, z in zip(place.tolist(), h.tolist(), lo.tolist(), hi.tolist()):
        d = int(np.searchsorted(offsets, p, "right") - 1)
        rows.append((key.to_bytes(8, "big") + data[p : z + length], (d.to_bytes(16, "big"), p - int(offsets[d]), p - z, p - a, data[a:p][::-1])))
    rows.sort(key=lambda r: r[0])
    runs = [S.Run.packed(rows[i::3]) for i in range(3)]
    for pairs in (0, 10**6):
        spans = {}
        for digest, a, z in S.covered(S.merged([S.Run.read(r) for r in runs]), length, gram, pairs):
            spans.setdefault(int.from_bytes(digest, "big"), []).append((a, z))
        for d, (_, removed, n, _) in enumerate(brute(texts, length)):
            found = S.union(spans.get(d, []))
            assert (sum(b - a for a, b in found), len(found)) == (removed, n)


def test_long_texts_in_segments(monkeypatch):
    rng = np.random.default_rng(3)
    text = "".join(chr(97 + x) for x in rng.integers(0, 26, 9000))
    raw, offsets = text_buffer(pa.array(["x" * 500, text, ""], pa.large_string()))
    whole = S.anchors(raw, offsets)
    monkeypatch.setattr(S, "_SEGMENT", 1000)
    for a, b in zip(whole, S.anchors(raw, offsets)):
        assert np.array_equal(a, b)


def texts_with_repeats():
    rng = np.random.default_rng(5)
    word = lambda n: " ".join("".join(chr(97 + x) for x in rng.integers(0, 26, 5)) for _ in range(n))
    passage, other = word(90), word(140)
    out = [word(40) + passage + word(30), word(10) + passage, passage + "é" + other, other[5:] + word(3), word(200), "a" * 1200, "ab" * 500, word(64)[:399], word(80)[:400]]
    out += [out[4], out[4], out[8], None, "", None, "x"]
    base = word(300)
    for i in range(30):
        words = base.split()
        words[i * 9] = f"w{i}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("hot", [S.HOT, 3])
def test_query_against_brute_force(spark, rows, hot):
    texts = texts_with_repeats()
    docs = rows([(i if i % 7 else None, t, "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, spans string, digest int")
    got = Counter((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.without_repeats(docs, hot=hot).collect())
    assert got == Counter(brute(texts, S.LENGTH))


def test_joins_without_broadcast(spark, rows, monkeypatch):
    monkeypatch.setattr(S, "SHIP_BYTES", 0)
    texts = texts_with_repeats()
    docs = rows(list(enumerate(texts)), "doc_id long, text string")
    got = Counter((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.without_repeats(docs).collect())
    assert got == Counter(brute(texts, S.LENGTH))


def test_empty_table(spark, rows):
    assert S.without_repeats(rows([], "doc_id long, text string")).count() == 0
