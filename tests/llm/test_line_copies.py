"""Near copies on one host go through line dedup whole and near dedup keeps one."""

import corpus_pipeline


def test_near_copies_lose_no_lines(spark, rows, prose):
    body = [prose(j, 12) for j in range(30)]
    data = []
    for i in range(50):
        own = list(body)
        own[i % 30] = prose(500 + i, 12)
        data.append((i, "\n".join(["menu of the site", *own])))
    data += [(100 + i, "\n".join(["menu of the site", *(prose(1000 + 10 * i + j, 12) for j in range(8))])) for i in range(60)]
    docs = rows([(i, t, "host", len(t)) for i, t in data], "doc_id long, text string, source string, n_chars long")
    cleaned = corpus_pipeline.drop_lines(spark, docs, "")
    for r in cleaned.collect():
        assert r.text == dict(data)[r.doc_id].removeprefix("menu of the site\n") and r.n_chars == len(r.text)
    kept = {r.doc_id for r in corpus_pipeline.drop_copies(spark, cleaned, "").collect()}
    assert kept == {0} | set(range(100, 160))
