"""Scores of the learned operators against plain-Python versions, and recall of near duplicates on a whole table."""

import itertools
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from strandlake.llm import langid, neardup, quality, queries, toxicity
from strandlake.llm.common import text_buffer

LANGS = {"en": "the cat sat on the mat and the dog ran to it", "de": "der hund läuft über die straße und die katze", "ru": "дом стоит на горе и кот спит", "fr": "l'été où le chat dort à côté"}
ASKED = ["the dog", "straßen über", "Дома горы", "zzz qq", "été the дом", "1234", "", "x" * 30, "côtés chats", "caterans"]


def plain_langid(train, texts):
    words_of = lambda t: re.findall("[a-z\u0080-\U0010ffff]+", t.lower())
    names = sorted({lang for _, lang in train})
    cut = lambda w, n: [("\0" + w + "\0")[i : i + n] for i in range(len(w) + 3 - n)]

    def table(of):
        counts = {x: Counter() for x in names}
        for t, lang in train:
            for w in words_of(t):
                counts[lang].update(of(w))
        keys = set().union(*counts.values())
        return {k: [math.log((counts[x][k] + 0.1) / (sum(counts[x].values()) + 0.1 * len(keys))) for x in names] for k in keys}

    known = table(lambda w: [w])
    parts = {n: table(lambda w, n=n: cut(w, n)) for n in range(1, 6)}
    out = []
    for t in texts:
        if not re.search(r"[^\W\d_]", t):
            out.append(("und", 0.0))
            continue
        total, words = [0.0] * len(names), words_of(t)
        for w in words:
            value = known.get(w)
            for n in range(5, 0, -1):
                if value is None:
                    found = [parts[n][g] for g in cut(w, n) if g in parts[n]]
                    value = [sum(x) / len(found) for x in zip(*found)] if found else None
            total = [a + b for a, b in zip(total, value or [0.0] * len(names))]
        mean = [round(x / max(1, len(words)), 6) for x in total]
        best = max(range(len(names)), key=lambda i: (mean[i], -i))
        out.append((names[best], 1 / sum(math.exp((m - mean[best]) * min(max(1, len(words)), 20)) for m in mean)))
    return out


def test_language_scores():
    train = [(t, lang) for lang, t in LANGS.items()] * 2
    model = langid.Model([t for t, _ in train], [lang for _, lang in train])
    names, scores = langid.predict(model, pa.array(ASKED, pa.large_string()))
    want = plain_langid(train, ASKED)
    assert names == [n for n, _ in want] and scores == pytest.approx([s for _, s in want], abs=2e-4)


def plain_quality(train, texts, epochs=4, alpha=0.5, beta=1.0, l1=0.05, l2=1.0):
    def features(t):
        tokens = [m[0] for m in re.finditer(r"[a-z0-9\u0080-\U0010ffff]+|[!-/:-@\[-`{-~]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))]
        pairs = ["same" if a == b else (a, b) for a, b in zip(tokens, tokens[1:])]
        return Counter(tokens) + Counter(map(str, pairs))

    z, n = defaultdict(float), defaultdict(float)

    def weight(k):
        rate = (beta + math.sqrt(n[k])) / alpha
        if k == "bias":
            return -z[k] / rate
        return 0.0 if abs(z[k]) <= l1 else -(z[k] - math.copysign(l1, z[k])) / (rate + l2)

    def row(t):
        f = features(t)
        return {k: c / math.sqrt(max(1, sum(f.values()))) for k, c in f.items()} | {"bias": 1.0}

    def p(x):
        return 1 / (1 + math.exp(-sum(weight(k) * v for k, v in x.items())))

    for _ in range(epochs):
        for t, y in train:
            x = row(t)
            error = p(x) - y
            steps = {k: (weight(k), error * v) for k, v in x.items()}
            for k, (w, g) in steps.items():
                z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / alpha * w
                n[k] += g * g
    return [p(row(t)) for t in texts]


def test_quality_scores():
    train = [("A fine text, with care.", 1), ("buy!!! buy!!! NOW buy", 0), ("well well well said", 1), ("click click $$$", 0), ("Été à la mer", 1), ("", 0)] * 3
    texts = [t for t, _ in train[:6]] + ["a fine mer", "buy now $$$", "nothing known"]
    weights = quality.fit([t for t, _ in train], [y for _, y in train])
    got = quality.score(weights, *text_buffer(pa.array(texts, pa.large_string())))
    assert got == pytest.approx(plain_quality(train, texts), abs=1e-4)


def test_toxicity_scores():
    toxic, clean = ["you utter clown go away. fine day", "what scum and clown talk! yes"], ["a fine day in the park. we go", "what a good talk about the day"]
    field = toxicity.fit((toxic + clean) * 6 + [f"{t} number{i}" for i in range(8) for t in toxic + clean], ([1, 1, 0, 0] * 14), evidence=3)
    texts = ["clown day", "fine talk. scum clown go", "", "we go to the park! clown", "a good day"]
    raw, offsets = text_buffer(pa.array(texts, pa.large_string()))
    x = toxicity.Tokens(raw, offsets, field.bits)
    e, p = field.odds(x), np.zeros(len(x.text))
    for a, n in zip(x.begin, x.length):  # every labelling of a chain
        total = 0.0
        for path in itertools.product((0, 1), repeat=int(n)):
            w = math.exp(sum(e[a + i] for i, s in enumerate(path) if s) + sum(field.t[s, q] for s, q in zip(path, path[1:])))
            total += w
            p[a : a + n] += w * np.array(path)
        p[a : a + n] /= total
    want = []
    for d in range(len(texts)):
        own = p[x.at[d] : x.at[d + 1]]
        expected, top = own[own >= 0.2].sum(), own.max(initial=0.0)
        odds = math.log(max(top, 1e-6)) - math.log(max(1 - top, 1e-6))
        z = np.array([math.log1p(expected), min(max(odds, -8), 8) / 4, expected / max(1, len(own)), 1.0]) @ field.doc
        want.append(1 / (1 + math.exp(-z)))
    score, spans = toxicity.tag(field, raw, offsets)
    assert score == pytest.approx(want, abs=1e-6) and score[0] > 0.5 > score[4]
    assert [sum(1 for q in p[x.at[d] : x.at[d + 1]] if q >= 0.5) for d in range(len(texts))] == [len(s) for s in spans]


def test_recall_of_near_duplicates_on_a_whole_table(spark):
    """All pairs of sf0.01 whose sets of 5-word shingles are 0.8 alike, by an inverted index."""
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()
    sets = {}
    for r in docs:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    where = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            where[g].append(i)
    both = Counter(p for ids in where.values() if len(ids) > 1 for p in itertools.combinations(sorted(ids), 2))
    alike = [(a, b) for (a, b), n in both.items() if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n)]
    found = {r.doc_id: r.class_id for r in queries.op9_near_duplicates(spark, d).collect()}
    assert len(alike) > 50 and sum(found[a] == found[b] for a, b in alike) >= 0.9 * len(alike)
    assert neardup.LEAST == 0.8
