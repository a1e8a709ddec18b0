"""N-best segmentation against enumeration, and exact round trips."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandlake.llm import pieces


def vocabulary(extra=()):
    plain = ["▁", "a", "b", "c", "ab", "bc", "abc", "▁a", "▁ab", "ca", "aa", "▁▁", *extra]
    scores = [-9.0, -5.0, -5.5, -6.0, -7.0, -7.5, -9.25, -6.0, -8.0, -7.0, -8.0, -12.0, -10.0, -10.5]
    return pieces.Vocabulary([(p, 256 + i, s) for i, (p, s) in enumerate(zip(plain, scores))], {b: b for b in range(256)}, 300)


def every_path(v, s):
    """All segmentations of a normalised text, cut into the same chunks."""
    out = [(0.0, b"", ())]
    for chunk in v.chunks.findall(s):
        found = []

        def walk(at, w, ids, found=found, chunk=chunk):
            if at == len(chunk):
                found.append((w, ids))
                return
            for z in range(at + 1, len(chunk) + 1):
                edge = v.edge(chunk[at:z], at)
                if edge:
                    walk(z, w + edge[0], ids + edge[1])

        walk(0, 0.0, b"")
        found.sort(reverse=True)
        out = [(w + x, ids + y, (*ranks, -r)) for w, ids, ranks in out for r, (x, y) in enumerate(found)]
    return sorted(out, key=lambda p: (-p[0], p[2]))


@settings(max_examples=150, deadline=None)
@given(st.text("abc d▁\n", max_size=9))
def test_n_best_is_what_enumeration_gives(text):
    v = vocabulary(extra=("▁b",))
    for n in (1, 4, 7):
        got = pieces.Encoder(v, n).encode(text)
        want = every_path(v, pieces.SPACE + text.replace(pieces.SPACE, pieces.OWN).replace(" ", pieces.SPACE))[:n] if text else [(0, b"", ())]
        assert [ids for _, ids in got] == [ids for _, ids, _ in want]


def test_pieces_that_cross_spaces_keep_the_lattice_whole():
    v = vocabulary(extra=("a▁b", "b▁"))
    for text in ("a b", "ba b a", "b a b b"):
        got = pieces.Encoder(v, 5).encode(text)
        want = every_path(v, (pieces.SPACE + text).replace(" ", pieces.SPACE))[:5]
        assert [ids for _, ids in got] == [ids for _, ids, _ in want]


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=40))
def test_decoding_gives_back_any_text(text):
    e = pieces.Encoder(vocabulary(), 3)
    assert all(e.decode(ids) == text for _, ids in e.encode(text))


def test_public_model_and_edges(spark, rows):
    docs = rows([(1, "The thth of it.\n\nNo  ▁ \U0001f600"), (2, ""), (3, None), (4, "a" * 5000), (4, "a" * 5000)], "doc_id long, text string")
    out = {r.doc_id: r for r in pieces.encoding_digest(docs).collect()}
    assert all(r.round_trip for r in out.values())
    assert out[2].n_tokens == out[3].n_tokens == 0 and out[2].n_paths == 1
    assert out[1].n_paths == pieces.BEST
    both = pieces.encoded(docs, n=2)
    text = pieces.decoded(both.selectExpr("doc_id", "get(paths, 1).ids ids")).collect()
    assert {r.text for r in text if r.doc_id == 4} == {"a" * 5000}


def test_empty_table(spark, rows):
    assert pieces.encoding_digest(rows([], "doc_id long, text string, ids int")).count() == 0


def test_losses_match_a_star():
    v = vocabulary()
    for chunk in ("▁abca", "aabcabc", "cabc"):
        w, ids, loss = pieces.best_and_loss(v, chunk)
        two = pieces.n_best(v, chunk, 2)
        assert two[0] == (w, ids) and two[0][0] - two[1][0] == loss
    assert pieces.best_and_loss(v, "d")[2] == pieces._ALONE


@pytest.mark.parametrize("cache", [1, 2, 1000])
def test_a_small_cache_changes_nothing(cache):
    v = vocabulary()
    e, plain = pieces.Encoder(v, 4, cache), pieces.Encoder(v, 4)
    for text in ("ab ab abc ca", "c b a", "abcabc  ab"):
        assert e.encode(text) == plain.encode(text)
