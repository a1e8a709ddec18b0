"""Line dedup, decontamination, near duplicates and the pipeline on small tables."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from conftest import EDGES

import corpus_pipeline
from strandlake.llm import common, decontam, lines, neardup, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


# ---------------------------------------------------------------- lines


def brute_lines(rows, ratio, least):
    total, seen = {}, {}
    for _, text, host in rows:
        if text:
            total.setdefault(host or "", set()).add(text)
            for x in {x.strip(" \t\r\f\v") for x in text.split("\n")} - {""}:
                seen.setdefault((host or "", x), set()).add(text)
    bad = {k for k, v in seen.items() if len(v) >= least and len(v) > ratio * len(total[k[0]])}
    return [None if t is None else "\n".join(x for x in t.split("\n") if (h or "", x.strip(" \t\r\f\v")) not in bad) for _, t, h in rows]


def test_lines_against_brute_force(spark, rows, prose):
    rng = random.Random(1)
    common_lines = ["All rights reserved.", " share this ", "", "menu"]
    data = []
    for i in range(120):
        host = rng.choice(["a", "b", None, "big", "big"])
        body = [prose(i * 10 + j, 5) for j in range(3)]
        for x in common_lines:
            if rng.random() < 0.4:
                body.insert(rng.randrange(len(body)), x)
        data.append((i, "\n".join(body), host))
    data += [data[3]] * 40 + [(900, None, "a"), (901, "", "a"), (902, "menu", "lonely")]
    out = lines.without_boilerplate(rows(data, "doc_id long, text string, source string"), ratio=0.3, least=4)
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter((d[0], t) for d, t in zip(data, brute_lines(data, 0.3, 4)))


def test_lines_edges(edges):
    out = lines.without_boilerplate(edges, ratio=0.0, least=1)
    assert out.count() == len(EDGES) and set(edges.columns) <= set(out.columns)
    assert {r._line_n for r in out.filter("text is null or text = ''").filter("doc_id in (1, 2)").collect()} == {0}
    assert lines.without_boilerplate(edges.limit(0)).count() == 0


# ---------------------------------------------------------------- decontamination


def brute_hits(docs, items, window=10):
    out = []
    wins = {}
    for key, (item, text) in enumerate(items):
        w = words(text)
        n = min(len(w), window)
        for i in range(len(w) - n + 1 if w else 0):
            wins.setdefault(tuple(w[i : i + n]), set()).add(item)
    sizes = {len(x) for x in wins}
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in wins:
                    hit |= set(range(i, i + n))
                    found |= wins[tuple(w[i : i + n])]
        found -= {None}
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)))
    return out


def contaminated_tables(prose):
    items = [(i, prose(i, 25 + i)) for i in range(8)] + [(20, prose(3, 28)), (21, "Alpha  beta-GAMMA"), (22, "delta"), (23, None), (24, "?!"), (None, prose(77, 30)), (25, "na na na na na na na na na na na na na na")]
    docs = []
    for i in range(40):
        body = prose(1000 + i, 60).split()
        if i % 3 == 0:
            w = words(items[i % 8][1])
            a = i % 7
            body[20:20] = [x.upper() + "," for x in w[a : a + 9 + i % 5]]
        if i % 5 == 0:
            body[40:40] = ["alpha", "BETA", "gamma"]
        if i % 11 == 0:
            body += ["na"] * 40
        docs.append((i, " ".join(body)))
    docs += [(90, None), (91, ""), (92, "..."), (93, "delta"), (94, prose(77, 30)), (94, prose(77, 30)), (None, prose(2, 27) + " é")]
    return docs, items


@pytest.mark.parametrize("block", [decontam.BLOCK_BYTES, 200])
def test_hits_against_brute_force(spark, rows, prose, block):
    docs, items = contaminated_tables(prose)
    got = decontam.contamination(rows(docs, "doc_id long, text string"), rows(items, "item_id long, text string"), block_bytes=block)
    assert Counter(map(tuple, got.collect())) == Counter(brute_hits(docs, items))


def test_winnowing_keeps_a_gram_of_every_window():
    rng = np.random.default_rng(2)
    h = rng.integers(0, 50, 400).astype(np.uint64)
    _, pos = decontam.selected(h, np.array([0, 400]), 5, 10)
    kept = set(pos.tolist())
    assert all(any(p in kept for p in range(a, a + 6)) for a in range(391)) and len(kept) < 396


def test_decontaminated_rows(spark, rows, edges, prose):
    items = rows([(1, "word word word word word word word word word word")], "item_id long, text string")
    out = decontam.decontaminated(edges, items)
    assert out.columns == edges.columns and out.count() == len(EDGES) - 1
    assert decontam.decontaminated(edges, items.limit(0)).count() == len(EDGES)
    assert decontam.contamination(edges.limit(0), items).count() == 0


# ---------------------------------------------------------------- near duplicates


def brute_classes(texts, weight, least=0.8):
    raw, offsets = common.text_buffer(pa.array(texts, pa.large_string()))
    g, at = neardup.shingles(raw, offsets)
    lists = [g[a:z] for a, z in zip(at[:-1], at[1:])]
    lead = list(range(len(texts)))

    def find(x):
        while lead[x] != x:
            x = lead[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            same = texts[i] and texts[i] == texts[j]
            if same or (len(lists[i]) and len(lists[j]) and neardup.similarity(lists[i], lists[j], weight) >= least):
                lead[find(i)] = find(j)
    return [find(i) for i in range(len(texts))]


def copies(prose, edits):
    rng = random.Random(7)
    out = []
    for base in range(6):
        w = prose(base, 120 + base).split()
        for _ in range(25):
            x = list(w)
            for _ in range(rng.randrange(edits)):
                x[rng.randrange(len(x))] = rng.choice(("ra", "zz", "mi"))
            out.append(" ".join(x))
    out += [out[0], out[0].upper() + "!", "one two", "One two.", "one two three", None, "", None, "?", "?", "!"]
    out += [prose(200 + i, 30) + " " + prose(50, 25) for i in range(30)]  # a common passage
    return out


@pytest.mark.parametrize("edits, turns", [(6, 2), (9, 0), (12, 1)])
def test_classes_against_brute_force(spark, rows, prose, monkeypatch, edits, turns):
    monkeypatch.setattr(neardup, "TURNS", turns)
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 16)
    texts = copies(prose, edits)
    docs = rows(list(enumerate(texts)), "doc_id long, text string")
    weight = neardup.shares(docs)
    got = {r.doc_id: (r.class_id, r.class_size) for r in neardup.classes(docs).collect()}
    want = brute_classes(texts, weight)
    first, size = {}, Counter(want)
    for i, c in enumerate(want):
        first.setdefault(c, i)
    assert got == {i: (first[c], size[c]) for i, c in enumerate(want)}


def test_without_broadcast(spark, rows, prose, monkeypatch):
    texts = copies(prose, 8)
    docs = rows(list(enumerate(texts)), "doc_id long, text string")
    want = {r.doc_id: r.class_id for r in neardup.classes(docs).collect()}
    monkeypatch.setattr(neardup, "SHIP_BYTES", 0)
    assert {r.doc_id: r.class_id for r in neardup.classes(docs).collect()} == want


def test_matrix_and_pairs_agree(prose):
    texts = [t for t in copies(prose, 10) if t]
    raw, offsets = common.text_buffer(pa.array(texts, pa.large_string()))
    g, at = neardup.shingles(raw, offsets)
    lists = [g[a:z] for a, z in zip(at[:-1], at[1:]) if z > a]
    weight = np.linspace(1, 1.25, 1 << neardup.BUCKET_BITS).astype(np.float32)
    labels = [bytes([i // 250, i % 250]) for i in range(len(lists))]
    lead = list(range(len(lists)))

    def find(x):
        while lead[x] != x:
            x = lead[x]
        return x

    for i, j in neardup.links_within(labels, lists, weight, 0.8):
        assert neardup.similarity(lists[i], lists[j], weight) >= 0.8
        lead[find(i)] = find(j)
    for i in range(len(lists)):
        for j in range(i):
            if neardup.similarity(lists[i], lists[j], weight) >= 0.8:
                assert find(i) == find(j)


def test_samples_agree_as_often_as_texts_are_similar(prose):
    base = prose(1, 400).split()
    other = base[:360] + prose(2, 40).split()
    raw, offsets = common.text_buffer(pa.array([" ".join(base), " ".join(other)], pa.large_string()))
    g, at = neardup.shingles(raw, offsets)
    weight = np.ones(1 << neardup.BUCKET_BITS, np.float32)
    draws = neardup.Sampler(weight, 2000).draw(*neardup.counted(g, at))
    sim = neardup.similarity(g[at[0] : at[1]], g[at[1] : at[2]], weight)
    assert abs((draws[0] == draws[1]).mean() - sim) < 0.05


def test_near_duplicate_edges(spark, edges):
    out = neardup.classes(edges)
    assert out.count() == len(EDGES)
    kept = neardup.without_near_duplicates(edges)
    assert kept.columns == edges.columns
    assert kept.count() == len(EDGES) - 1 and kept.filter("doc_id = 5").count() == 1
    assert neardup.classes(edges.limit(0)).count() == 0


# ---------------------------------------------------------------- the pipeline


@pytest.fixture(scope="module")
def sf(tmp_path_factory):
    return "/root/testdata/sf0.001"


def test_pipeline_stages(spark, sf):
    docs = common.table(spark, sf, "documents")
    names = docs.columns
    before = docs.count()
    for i, (name, step) in enumerate(corpus_pipeline.STAGES):
        docs = common.stage(step(spark, docs, sf), f"test-{name}")
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == names, name
        assert docs.count() <= before
        before = docs.count()
    whole = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, sf).collect()}
    assert whole == {r.doc_id: r.ids_sha256 for r in docs.collect()} and len(whole) > 100


def test_pipeline_on_edges(spark, rows, edges, sf, tmp_path):
    for t in ("labels", "benchmark"):
        common.table(spark, sf, t).write.parquet(f"{tmp_path}/{t}.parquet")
    docs = edges.withColumn("n_chars", edges["n_chars"].cast("long"))
    for name, step in corpus_pipeline.STAGES:
        docs = step(spark, docs, str(tmp_path))
    assert docs.filter("round_trip").count() == docs.count() > 5


# ---------------------------------------------------------------- SQL


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    got, want = queries.QUERIES[name](spark, sf).toPandas(), con.execute(queries.ORACLE[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(map(tuple, got[columns].astype(str).values.tolist())) == sorted(map(tuple, want[columns].astype(str).values.tolist()))
