"""Segmentation against brute force over all segmentations, and exact round trips."""
import math
import tracemalloc

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from reviewsieve.llm import pieces

WORDS = ["▁", "a", "b", "c", "ab", "bc", "abc", "▁a", "▁ab", "ca", "cab", "▁▁"]
VOCABULARY = [("", 0.0, False)] + [(f"<0x{b:02X}>", 0.0, True) for b in range(256)] + [
    (w, -float(k), False) for k, w in enumerate(WORDS)]


@pytest.fixture(scope="module")
def codec():
    return pieces.Codec(VOCABULARY)


def all_paths(codec, scores, text):
    """(score, ids) of every segmentation of the marked text; a character without a piece is spelled in bytes."""
    ids = {p: i for i, (p, _, byte) in enumerate(VOCABULARY) if p and not byte}
    marked = pieces.MARK + text.replace(" ", pieces.MARK)
    paths = {len(marked): [(0.0, [])]}
    for i in range(len(marked) - 1, -1, -1):
        here = []
        for j in range(i + 1, len(marked) + 1):
            piece = marked[i:j]
            if piece in ids:
                here += [(scores[ids[piece]] + s, [ids[piece], *p]) for s, p in paths[j]]
            elif j == i + 1:
                raw = [1 + b for b in piece.encode()]
                here += [(scores[1] * len(raw) + s, [*raw, *p]) for s, p in paths[j]]
        paths[i] = here
    return sorted(paths[0], key=lambda x: -x[0])


@settings(max_examples=60, deadline=None)
@given(st.text("abcx ", max_size=9))
def test_n_best_against_all_segmentations(text):
    codec, scores = pieces.Codec(VOCABULARY), pieces.piece_scores(VOCABULARY)
    expected = all_paths(codec, scores, text)
    got = codec.encode(text, 4)
    assert len(got) == min(4, len(expected))
    assert np.allclose([s for s, _ in got], [s for s, _ in expected[:4]])
    assert len({tuple(ids) for _, ids in got}) == len(got)
    by_ids = {tuple(ids): s for s, ids in expected}
    assert all(math.isclose(by_ids[tuple(ids.tolist())], s) for s, ids in got)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_round_trip(text):
    codec = pieces.Codec(VOCABULARY)
    found = codec.encode_packed(text, 3)
    assert codec.is_whole(text, found)
    assert all(codec.decode(ids) == text for _, ids in codec.encode(text, 3))


@settings(max_examples=40, deadline=None)
@given(st.text("abcx", max_size=9))
def test_long_parts_against_all_segmentations(text):
    codec = pieces.Codec(VOCABULARY)
    expected = all_paths(codec, pieces.piece_scores(VOCABULARY), text)[:4]
    got = codec.n_best(pieces.MARK + text, 4)
    assert np.allclose([s for s, _ in got], [s for s, _ in expected]) and len({ids for _, ids in got}) == len(got)


def best_ways(codec, part, n):
    """Scores of the n best segmentations, by the n best ways to each place."""
    ways = [[0.0], *([] for _ in part)]
    for i in range(len(part)):
        ways[i] = sorted(ways[i], reverse=True)[:n]
        children, j, spelled = codec.tree, i, True
        while j < len(part) and (node := children.get(part[j])) is not None:
            children, j = node[0], j + 1
            if node[2] is not None:
                spelled &= j > i + 1
                ways[j] += [w + node[1] for w in ways[i]]
        if spelled:
            ways[i + 1] += [w + codec.spelled(part[i])[0] for w in ways[i]]
    return sorted(ways[-1], reverse=True)[:n]


@pytest.mark.parametrize("n", [1, 3, 8])
def test_one_search_for_parts_of_any_length(n):
    codec, draw = pieces.Codec(pieces.read_pieces()), np.random.default_rng(n)
    for size in [2, 20, 63, 64, 65, 66, 80, 300, 3000]:
        for letters in ("abcdefghijklmnopqrstuvwxyz", "aeinrst", "a", "aA0+/é漢"):
            part = pieces.MARK + "".join(draw.choice(list(letters), size))
            got, expected = codec.n_best(part, n), best_ways(codec, part, n)
            assert len({ids for _, ids in got}) == len(expected) and np.allclose([s for s, _ in got], expected)
            assert all(codec.pieces_text(ids).decode() == part.replace(pieces.MARK, " ") for _, ids in got)


def test_many_segmentations_of_many_words():
    """n = 40 over a sentence: the n cheapest picks, without a table of all of them."""
    codec = pieces.Codec(pieces.read_pieces())
    text = "the quick brown fox jumps over twenty lazy dogs"
    found = codec.encode(text, 40)
    whole = "".join(codec.parts(text))
    assert len({tuple(ids) for _, ids in found}) == 40
    assert np.allclose([s for s, _ in found], best_ways(codec, whole, 40))


@pytest.mark.parametrize("text", ["".join(map(chr, np.random.default_rng(4).integers(97, 123, 200_000))), "a" * 200_000])
def test_long_text_without_spaces(text):
    codec = pieces.Codec(pieces.read_pieces())
    tracemalloc.start()
    found = codec.encode_packed(text, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert codec.is_whole(text, found) and len({ids for _, ids, _ in found}) == 3 and peak < 600 << 20
    assert not codec.known


def test_frames(spark):
    texts = [None, "", "the cat▁sat\n on  the mat", "é漢字🙂", "word " * 30_000, "the cat"]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, ids string")
    encoded = pieces.decode(pieces.best_ids(docs))
    assert {r.doc_id: r.decoded for r in encoded.collect()} == {k: t or "" for k, t in enumerate(texts)}
    rows = pieces.segmentation_digest(docs).select("doc_id", "digest.*").collect()
    assert all(r.round_trip and r.scores == sorted(r.scores, reverse=True) for r in rows)
    assert {r.doc_id: r.n_pieces for r in rows} == {r.doc_id: len(r.ids) for r in encoded.collect()}
    many = pieces.encode(docs.filter("doc_id = 5"), n=5).collect()[0].segmentations
    assert len(many) == 5 and len({tuple(m.ids) for m in many}) == 5
    assert pieces.best_ids(docs.limit(0)).count() == 0


def test_remembered_words_take_little_memory():
    """Two Python workers of an executor share what its JVM leaves; words that do not come again must not fill it."""
    import itertools
    import sys
    codec = pieces.Codec(VOCABULARY, cache=pieces.CACHE_BESIDE)
    words = ["".join(w) for w in itertools.product("abcd", repeat=9)][:150_000]
    for at in range(0, len(words), 1000):
        codec.encode(" ".join(words[at:at + 1000]))
    held = [(k, v) for memory in (codec.known, codec.older) for k, v in memory.items()]
    assert sum(sys.getsizeof(x) for k, v in held for x in (k, v, *v)) < 24 << 20
