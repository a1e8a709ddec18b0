"""Toxicity, quality, language, url filters and media columns."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest import EDGES
from hypothesis import given, settings
from hypothesis import strategies as st

from strandlake.llm import common, langid, media, quality, queries, toxicity, urls
from strandlake.llm.common import text_buffer

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return {t: common.table(spark, SF, t) for t in ("documents", "labels", "pages")}


# ---------------------------------------------------------------- hashes of runs


@settings(max_examples=50, deadline=None)
@given(st.lists(st.text("abAB1é .\n", max_size=30), min_size=1, max_size=6))
def test_words_don_t_depend_on_neighbours(texts):
    raw, offsets = text_buffer(pa.array(texts, pa.large_string()))
    h, s, e, at = common.words_of(raw, offsets)
    for i, t in enumerate(texts):
        alone = common.words_of(*text_buffer(pa.array([t], pa.large_string())))
        assert np.array_equal(h[at[i] : at[i + 1]], alone[0])
    seen = {}
    for x, a, z in zip(h.tolist(), s, e):
        assert seen.setdefault(x, common.WORD[raw[a:z]].tobytes()) == common.WORD[raw[a:z]].tobytes()


# ---------------------------------------------------------------- toxicity


def test_marginals_against_enumeration():
    rng = np.random.default_rng(0)
    t = rng.normal(size=(2, 2))
    e = rng.normal(size=9)
    begin, length = np.array([0, 5, 8]), np.array([5, 3, 1])
    got, pairs = toxicity.forward_backward(e, begin, length, t)
    want, expect = np.zeros(9), np.zeros((2, 2))
    for b, n in zip(begin, length):
        z, one, both = 0.0, np.zeros(n), np.zeros((2, 2))
        for states in np.ndindex(*([2] * n)):
            w = math.exp(sum(e[b + i] for i in range(n) if states[i]) + sum(t[x, y] for x, y in zip(states, states[1:])))
            z += w
            one += w * np.array(states)
            for x, y in zip(states, states[1:]):
                both[x, y] += w
        want[b : b + n], expect = one / z, expect + both / z
    assert np.allclose(got, want) and np.allclose(pairs, expect)


def test_toxicity_held_out(tables):
    out = toxicity.score_toxicity(tables["documents"], tables["labels"]).toPandas()
    both = out.merge(tables["labels"].toPandas(), on="doc_id")
    held = both[both.held_out]
    assert len(out) == 1000 and len(held) > 50
    assert ((held.score >= 0.3) == held.toxic).mean() > 0.93
    rows = tables["documents"].toPandas().set_index("doc_id").text
    some = out[out.spans.map(len) > 0].iloc[0]
    span = some.spans[0]
    assert rows[some.doc_id].encode()[span["lo"] : span["hi"]].decode().isalnum()


def test_learning_ignores_held_out_labels(spark, tables):
    from pyspark.sql import functions as F

    flipped = tables["labels"].withColumn("toxic", F.when(common.split_of() == 2, 1 - F.col("toxic")).otherwise(F.col("toxic"))).withColumn("quality", F.when(common.split_of(parts=5) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a = toxicity.score_toxicity(tables["documents"], tables["labels"]).select("doc_id", "score").collect()
    b = toxicity.score_toxicity(tables["documents"], flipped).select("doc_id", "score").collect()
    assert a == b
    assert quality.score_quality(tables["documents"], tables["labels"]).collect() == quality.score_quality(tables["documents"], flipped).collect()
    langs = tables["documents"].withColumn("lang", F.when(common.split_of() == 2, "xx").otherwise(F.col("lang")))
    assert langid.identify(tables["documents"]).collect() == langid.identify(langs).collect()


def test_chains_of_long_sentences():
    x = toxicity.Tokens(*text_buffer(pa.array(["a " * 300 + ". b c", "", "d"], pa.large_string())))
    assert sorted(x.length.tolist()) == [1, 2, 12, 96, 96, 96] and x.length.sum() == 303


# ---------------------------------------------------------------- quality


def test_quality_held_out(tables):
    out = quality.score_quality(tables["documents"], tables["labels"]).toPandas()
    both = out.merge(tables["labels"].toPandas(), on="doc_id")
    held = both[both.held_out]
    assert (held.predicted == held.quality).mean() > 0.93 and out.score.between(0, 1).all()
    assert all(h == (zlib.crc32(str(d).encode()) % 5 == 0) for d, h in zip(out.doc_id, out.held_out))


def test_ftrl_is_the_written_rule():
    m = quality.Ftrl(2, alpha=0.5, beta=1.0, l1=0.01, l2=0.3)
    z, n = [0.0] * 3, [0.0] * 3

    def w(i):
        if i < 2 and abs(z[i]) <= 0.01:
            return 0.0
        if i == 2:
            return -z[i] / ((1 + math.sqrt(n[i])) / 0.5)
        return -(z[i] - math.copysign(0.01, z[i])) / ((1 + math.sqrt(n[i])) / 0.5 + 0.3)

    rng = random.Random(1)
    for _ in range(30):
        x, y = [rng.random(), rng.random(), 1.0], rng.randrange(2)
        p = 1 / (1 + math.exp(-sum(w(i) * x[i] for i in range(3))))
        old = [w(i) for i in range(3)]
        for i in range(3):
            g = (p - y) * x[i]
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / 0.5 * old[i]
            n[i] += g * g
        m.learn(np.arange(3), np.array(x), float(y))
    assert np.allclose(m.z, z) and np.allclose(m.n, n)
    assert np.allclose(m.weights(np.arange(3)), [w(i) for i in range(3)])


# ---------------------------------------------------------------- language


def test_language_held_out(tables):
    out = langid.identify(tables["documents"]).toPandas()
    both = out.merge(tables["documents"].select("doc_id", "lang").toPandas(), on="doc_id")
    assert (both[both.held_out].lang_pred == both[both.held_out].lang).mean() > 0.97


def test_language_back_off():
    m = langid.Model(["haus haus baum schule", "maison arbre ecole eau"], ["de", "fr"])
    names, score = langid.predict(m, pa.array(["haus", "hausbaum", "eaux", "école EAU", "1234 ??", "", None, "шум"], pa.large_string()))
    assert names[:4] == ["de", "de", "fr", "fr"] and names[4:7] == ["und"] * 3 and list(score[4:7]) == [0, 0, 0] and names[7] in ("de", "fr")
    alone = [langid.predict(m, pa.array([t], pa.large_string())) for t in ("haus", "eaux")]
    assert [a[0][0] for a in alone] == ["de", "fr"] and alone[0][1][0] == score[0]
    # A word nobody knows is scored by its longest known parts alone.
    total, n = m.totals(pa.array(["hausx"], pa.large_string()))
    mapped, s, e, _ = langid._words(pa.array(["hausx"], pa.large_string()))
    keys, _ = langid._parts(mapped, s, e, 5)
    rows = m.parts[5].find(keys)
    assert np.allclose(total[0], m.parts[5].log[rows[rows >= 0]].mean(0)) and n[0] == 1


# ---------------------------------------------------------------- edges, all at once


def test_edges(spark, rows, edges):
    from pyspark.sql import functions as F

    labels = rows([(9, 1, 0), (9, 0, 1), (None, 1, 1), (1, None, None), (8, 1, 0)], "doc_id long, quality int, toxic int")
    n = len(EDGES)
    for lab in (labels, labels.limit(0)):
        assert quality.score_quality(edges, lab).filter("score between 0 and 1").count() == n
        assert toxicity.score_toxicity(edges, lab).filter("score between 0 and 1").count() == n
        kept = toxicity.without_toxic(edges, lab, cut=2.0)
        assert kept.columns == edges.columns and kept.count() == n
        assert quality.score_quality(edges.limit(0), lab).count() == toxicity.score_toxicity(edges.limit(0), lab).count() == 0
    assert langid.identify(edges).filter("lang_pred = 'und' and score = 0").count() == n
    known = edges.withColumn("lang", F.when(F.length("text") > 4, "aa"))
    assert set(r.lang_pred for r in langid.identify(known).collect()) <= {"und", "aa"}
    assert langid.identify(edges.limit(0)).count() == 0
    digest = media.media_digest(edges).collect()
    assert len(digest) == n and all(r.payload_bytes == max(64, -(-r.n_bytes // 64) * 64) for r in digest)
    assert media.media_digest(edges.limit(0)).count() == 0


# ---------------------------------------------------------------- urls


def brute_urls(rows, strength=4.0):
    """Rules, models, calibration and verdicts, one url at a time."""
    import re

    rules = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
    out, examples = [], []
    for page, url in rows:
        host = path = ""
        if url is not None and "://" in url:
            rest = url.split("://", 1)[1]
            host = re.split("[/?#]", rest, maxsplit=1)[0]
            path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
            host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [(len(r), r, v) for r, v in rules for h, p in [(r.split("/", 1)[0], "/" + r.split("/", 1)[1])] if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits)[1:] if fits else (None, None)
        text = re.sub("[^a-z0./:?=&#%_-]", "*", re.sub("[0-9]", "0", (url or "").lower()))
        text = "^" * (urls.ORDER - 1) + text + "$" if text else ""
        out.append([page, host, path, rule, verdict, text])
        if rule:
            examples.append((text, verdict == "allow"))
    held = [(t, a) for t, a in examples if zlib.crc32(t.encode()) % 5 == 0]
    counts = {True: defaultdict(int), False: defaultdict(int)}
    ctx = {True: defaultdict(int), False: defaultdict(int)}
    for t, a in examples:
        if zlib.crc32(t.encode()) % 5:
            for i in range(urls.ORDER - 1, len(t)):
                for k in range(1, urls.ORDER + 1):
                    counts[a][t[i - k + 1 : i + 1]] += 1
                    ctx[a][t[i - k + 1 : i]] += 1

    def p(a, g):
        lower = p(a, g[1:]) if len(g) > 1 else 1 / 40
        return (counts[a][g] + strength * lower) / (ctx[a][g[:-1]] + strength)

    def score(t):
        total = 0.0
        for i in range(urls.ORDER - 1, len(t)):
            for k in range(urls.ORDER, 0, -1):
                g = t[i - k + 1 : i + 1]
                if counts[True].get(g) or counts[False].get(g):
                    total += round(math.log(p(True, g)) - math.log(p(False, g)), 9)
                    break
        return total / max(1, len(t) - urls.ORDER + 1)

    by_text = {}
    for t, a in held:
        by_text[t] = by_text.get(t, False) or a
    ok, bad = [score(t) for t, a in by_text.items() if a], [score(t) for t, a in by_text.items() if not a]
    cut = 0.0
    if ok and bad:
        sa, sr = np.std(ok) + 1e-6, np.std(bad) + 1e-6
        cut = (np.mean(ok) * sr + np.mean(bad) * sa) / (sa + sr)
    return [(page, host, path, rule, verdict or ("allow" if (score(t) if t else 0.0) >= cut else "block")) for page, host, path, rule, verdict, t in out]


def test_urls_against_brute_force(spark, rows, tables):
    odd = [(None, "https://x.net/fr/1"), (1, None), (2, ""), (3, "no scheme.com/en/"), (4, "http://COM/"), (5, "http://a.com"), (6, "http://a.com?x=/"), (7, "a://b://c.com/"), (8, "http://www.example.com/en/"), (9, "http://x.www.example.com/en/q#/"), (10, "http://notexample.com/en/1"), (11, "http://É.NET/ES/1"), (12, "http://a.net/es/1\n2"), (13, "x" * 5000), (14, "http://a.org/en/1"), (14, "http://a.org/en/1")]
    data = [tuple(r) for r in tables["pages"].select("page_id", "url").collect()] + odd
    got = urls.judge_urls(rows(data, "page_id long, url string")).select("page_id", "host", "path", "rule", "verdict").collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute_urls(data), key=str)


def test_urls_edges(spark, rows):
    empty = rows([], "page_id long, url string, host int, verdict string")
    assert urls.judge_urls(empty).count() == 0
    none = urls.judge_urls(rows([(1, "http://a.org/x", 3), (2, None, 3)], "page_id long, url string, rule int")).collect()
    assert {r.verdict for r in none} == {"allow"}
    plan = urls.judge_urls(rows([(1, "http://a.org/x")], "page_id long, url string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# ---------------------------------------------------------------- media


class Writer:
    """A plain encoder for any coefficients: full Huffman tables, runs, end-of-band runs, restarts."""

    CODES = {s: (format(i, "08b")) for i, s in enumerate(range(255))}

    def __init__(self):
        self.bits = []

    def symbol(self, s):
        self.bits.append(self.CODES[s])

    def raw(self, v, n):
        if n:
            self.bits.append(format(v, f"0{n}b"))

    def signed(self, v):
        n = abs(v).bit_length()
        return n, (v if v > 0 else v + (1 << n) - 1)

    def done(self):
        b = "".join(self.bits)
        b += "1" * (-len(b) % 8)
        self.bits = []
        return bytes(int(b[i : i + 8], 2) for i in range(0, len(b), 8)).replace(b"\xff", b"\xff\x00")

    def ac_first(self, blocks, a, z, low):
        run = 0

        def flush():
            nonlocal run
            if run:
                n = run.bit_length() - 1
                self.symbol(n << 4)
                self.raw(run - (1 << n), n)
                run = 0

        for row in blocks:
            zeros, k = 0, a
            cut = [int(math.copysign(abs(int(x)) >> low, int(x))) for x in row]
            last = max([i for i in range(a, z + 1) if cut[i]], default=a - 1)
            while k <= last:
                if not cut[k]:
                    zeros += 1
                else:
                    flush()
                    while zeros > 15:
                        self.symbol(0xF0)
                        zeros -= 16
                    n, v = self.signed(cut[k])
                    self.symbol(zeros << 4 | n)
                    self.raw(v, n)
                    zeros = 0
                k += 1
            if last < z:
                run += 1
        flush()

    def ac_more(self, blocks, a, z, low):
        for row in blocks:
            mag = [abs(int(x)) >> low for x in row]
            last = max([i for i in range(a, z + 1) if mag[i] == 1], default=a - 1)
            zeros, pending, k = 0, [], a
            while k <= last:
                if mag[k] == 0:
                    zeros += 1
                    if zeros == 16:
                        self.symbol(0xF0)
                        self.bits += pending
                        zeros, pending = 0, []
                elif mag[k] > 1:
                    pending.append(str(mag[k] & 1))
                else:
                    self.symbol(zeros << 4 | 1)
                    self.raw(int(row[k] > 0), 1)
                    self.bits += pending
                    zeros, pending = 0, []
                k += 1
            if k <= z:
                self.symbol(0)
                self.bits += pending + [str(mag[i] & 1) for i in range(k, z + 1) if mag[i] > 1]


@pytest.mark.parametrize("sampling, restart", [((2, 2), 0), ((2, 1), 0), ((1, 1), 2), ((1, 2), 3)])
def test_any_progressive_stream(sampling, restart):
    """Sparse coefficients, odd sizes, sampling factors and restarts, by the bit-by-bit path."""
    rng = np.random.default_rng(sum(sampling) + restart)
    h, v = sampling
    width, height = 37, 21
    across, down = -(-width // (8 * h)), -(-height // (8 * v))
    shapes = [(down * v, across * h), (down, across), (down, across)]
    coef = [np.where(rng.random((a * b, 64)) < 0.2, rng.integers(-60, 61, (a * b, 64)), 0) for a, b in shapes]
    for c in coef:
        c[:, 0] = rng.integers(-500, 500, len(c))
    w = Writer()
    table = bytes([0] * 7 + [255] + [0] * 8) + bytes(range(255))
    frame = b"\x08" + height.to_bytes(2, "big") + width.to_bytes(2, "big") + b"\x03" + bytes([1, h << 4 | v, 0, 2, 0x11, 0, 3, 0x11, 0])
    out = [b"\xff\xd8", media._segment(0xDB, b"\x00" + bytes(range(1, 65))), media._segment(0xC2, frame), media._segment(0xC4, b"\x00" + table + b"\x10" + table)]
    if restart:
        out.append(media._segment(0xDD, restart.to_bytes(2, "big")))
    order = []
    for y in range(down):
        for x in range(across):
            order.append([(0, (y * v + j) * across * h + x * h + i) for j in range(v) for i in range(h)] + [(1, y * across + x), (2, y * across + x)])

    def pieces(units):
        return [units[i : i + restart] for i in range(0, len(units), restart)] if restart else [units]

    def scan(head, parts):
        data = b"".join(p + (bytes([0xFF, 0xD0 + i % 8]) if i + 1 < len(parts) else b"") for i, p in enumerate(parts))
        out.append(media._segment(0xDA, head) + data)

    every = bytes([3, 1, 0, 2, 0, 3, 0])
    parts = []
    for piece in pieces(order):
        last = [0, 0, 0]
        for unit in piece:
            for c, b in unit:
                x = int(coef[c][b, 0]) >> 1
                n, val = w.signed(x - last[c]) if x != last[c] else (0, 0)
                last[c] = x
                w.symbol(n)
                w.raw(val, n)
        parts.append(w.done())
    scan(every + bytes([0, 0, 0x01]), parts)
    alone = []
    for c in range(3):
        hh, vv = (h, v) if c == 0 else (1, 1)
        wide, high = -(-(-(-width * hh // h)) // 8), -(-(-(-height * vv // v)) // 8)
        alone.append([y * shapes[c][1] + x for y in range(high) for x in range(wide)])
    for a, z, high, low in ((1, 9, 0, 1), (10, 63, 0, 1), (1, 63, 1, 0)):
        for c in range(3):
            parts = []
            for piece in pieces(alone[c]):
                (w.ac_more if high else w.ac_first)(coef[c][piece], a, z, low)
                parts.append(w.done())
            scan(bytes([1, c + 1, 0, a, z, high << 4 | low]), parts)
    parts = []
    for piece in pieces(order):
        for unit in piece:
            for c, b in unit:
                w.raw(int(coef[c][b, 0]) & 1, 1)
        parts.append(w.done())
    scan(every + bytes([0, 0, 0x10]), parts)
    (image,) = media.decode(b"".join([*out, b"\xff\xd9"]))
    for c in range(3):
        assert np.array_equal(image.planes[c].coef[:, 0], coef[c][:, 0])
        assert np.array_equal(image.planes[c].coef[alone[c], 1:], coef[c][alone[c], 1:])
    t = image.tensor()
    assert t.shape == (height, width, 3) and t.dtype == np.uint8
    # One pixel by the definition of the transform, at full resolution.
    y, x = 13, 29
    value = []
    for c in range(3):
        hh, vv = (h, v) if c == 0 else (1, 1)
        yy, xx = y * vv // v, x * hh // h
        block = image.planes[c].coef[(yy // 8) * shapes[c][1] + xx // 8]
        total = 0.0
        for k in range(64):
            p, q = divmod(int(media.ZIGZAG[k]), 8)
            scale = (1 / math.sqrt(2) if p == 0 else 1) * (1 / math.sqrt(2) if q == 0 else 1) / 4
            total += scale * block[k] * (k + 1) * math.cos((2 * (yy % 8) + 1) * p * math.pi / 16) * math.cos((2 * (xx % 8) + 1) * q * math.pi / 16)
        value.append(min(255, max(0, round(total + 128))))
    r, b = value[0] + 1.402 * (value[2] - 128), value[0] + 1.772 * (value[1] - 128)
    assert abs(int(t[y, x, 0]) - min(255, max(0, r))) <= 2 and abs(int(t[y, x, 2]) - min(255, max(0, b))) <= 2


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000))
def test_payload_round_trip(raw):
    payload = media.payload_of(raw)
    assert b"".join(i.payload() for i in media.decode(media.encode(payload))) == payload


def test_fast_and_plain_paths_agree(monkeypatch):
    payload = media.payload_of(bytes(np.random.default_rng(1).integers(0, 256, 1500, dtype=np.uint8)))
    stream = media.encode(payload)
    fast = media.decode(stream)[0]
    plain_table = media.Huffman.__init__

    def slow(self, counts, symbols):
        plain_table(self, counts, symbols)
        self.only = 0

    monkeypatch.setattr(media.Huffman, "__init__", slow)
    media._huffman.cache_clear()
    slow_ = media.decode(stream)[0]
    media._huffman.cache_clear()
    assert all(np.array_equal(a.coef, b.coef) for a, b in zip(fast.planes, slow_.planes))


def test_several_frames(monkeypatch, spark, rows):
    monkeypatch.setattr(media, "FRAME", 640)
    payload = media.payload_of(b"many frames " * 300)
    images = media.decode(media.encode(payload))
    assert len(images) == -(-len(payload) // 640) and b"".join(i.payload() for i in images) == payload


def test_media_columns(spark, rows):
    docs = rows([(1, "hello"), (2, None), (3, "hello"), (4, "é" * 700)], "doc_id long, text string")
    stored = media.with_media(docs).persist()
    tensors = {r.doc_id: r for r in media.media_tensors(stored).collect()}
    assert all(len(r.rgb) == r.height * r.width * r.channels for r in tensors.values()) and tensors[1].rgb == tensors[3].rgb
    digest = {r.doc_id: r for r in media.media_digest(docs).collect()}
    for r in stored.collect():
        text = {1: "hello", 2: "", 3: "hello", 4: "é" * 700}[r.doc_id].encode()
        payload = media.payload_of(text)
        d = digest[r.doc_id]
        assert (d.n_bytes, d.payload_bytes, d.media_bytes) == (len(text), len(payload), len(r.media))
        assert d.payload_sha256 == hashlib.sha256(payload).hexdigest() and d.tail_crc32 == zlib.crc32(payload[-64:])
        assert d.media_sha256 == hashlib.sha256(bytes(r.media)).hexdigest()
    assert digest[1].feature == digest[3].feature


@pytest.mark.parametrize("broken", [b"\xff\xd8\xff\xd9x", b"abc", b"\xff\xd8\xff\xc0\x00\x04ab"])
def test_broken_streams_are_refused(broken):
    with pytest.raises((ValueError, IndexError)):
        media.decode(broken)


def test_all_registered():
    assert [sorted(n.split("_")[0] for n in queries.QUERIES)] == [sorted(f"op{i}" for i in range(1, 11))]
