"""Samples that models are fitted on: whole, of all lengths, of every label."""

import numpy as np

from strandlake.llm import common, langid, quality, toxicity

DOCS, LABELS = "doc_id long, text string", "doc_id long, label int"


def test_quotas():
    assert common.quotas(np.array([3, 4]), 10, 0.25).tolist() == [3, 4]
    assert common.quotas(np.array([1000, 1000]), 10, 0.25).tolist() == [5, 5]
    few = common.quotas(np.array([1_000_000, 50]), 100, 0.25)
    assert few.sum() == 100 and few[1] >= 12
    assert common.quotas(np.array([1_000_000, 5, 300]), 100, 1.0).sum() == 100


def test_sample_is_full_if_most_ids_have_no_text(rows):
    docs = rows([(i, f"text {i}") for i in range(0, 2000, 50)] + [(7, None), (8, "")], DOCS)
    labels = rows([(i, int(i % 100 == 0)) for i in range(2000)], LABELS)
    sample, counts = common.bounded_sample(labels, docs, 30, 100)
    assert len(sample) == 30 and {r["label"] for r in sample} == {0, 1} and counts == {0: 20, 1: 20}


def test_sample_has_long_texts_within_the_bytes(rows):
    docs = rows([(i, f"{i} " + "x" * 5000) for i in range(40)], DOCS)
    labels = rows([(i, i % 2) for i in range(40)], LABELS)
    sample, _ = common.bounded_sample(labels, docs, 40, 1000)
    assert {r["label"] for r in sample} == {0, 1} and len(sample) >= 6
    assert sum(len(r["text"]) for r in sample) <= 40 * 1000 and all(len(r["text"]) > 5000 for r in sample)
    only, _ = common.bounded_sample(labels, docs, 2, 100)
    assert len(only) == 2 and all(0 < len(r["text"]) <= 100 for r in only)


def test_rare_labels_are_in_the_sample(rows):
    docs = rows([(i, f"text {i}") for i in range(5000)], DOCS)
    labels = rows([(i, int(i < 20)) for i in range(5000)], LABELS)
    sample, counts = common.bounded_sample(labels, docs, 100, 100)
    y = [r["label"] for r in sample]
    assert len(y) == 100 and sum(y) >= 12
    assert abs(common.oversampled(y, counts) - np.log(sum(y) / (100 - sum(y)) * 4980 / 20)) < 1e-9


def test_long_texts_are_learned_from(rows, prose):
    long = [(i, prose(i, 4000) + (" fiendish" * 40 if i % 2 else "")) for i in range(60)]
    docs = rows(long, DOCS)
    labels = rows([(i, i % 2, i % 2) for i in range(60)], "doc_id long, toxic int, quality int")
    bad = {r.doc_id: r.score >= 0.3 for r in toxicity.score_toxicity(docs, labels).collect()}
    good = {r.doc_id: r.predicted for r in quality.score_quality(docs, labels).collect()}
    assert sum(bad[i] == bool(i % 2) for i in range(60)) > 55 and sum(good[i] == i % 2 for i in range(60)) > 50
    langs = rows([(i, t.replace("ra", "sch") if i % 2 else t, "de" if i % 2 else "it") for i, t in long], DOCS + ", lang string")
    assert {r.lang_pred for r in langid.identify(langs).collect()} == {"de", "it"}


def test_toxicity_stage_keeps_all_if_nothing_is_learned(rows, prose):
    docs = rows([(i, prose(i, 20)) for i in range(12)], DOCS)
    for labels in ([], [(i, 1) for i in range(12)], [(i, i % 2) for i in range(3)]):
        assert toxicity.without_toxic(docs, rows(labels, "doc_id long, toxic int")).count() == 12
