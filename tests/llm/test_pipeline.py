"""The pipeline on a whole small table, stage by stage against plain versions."""
from test_near import brute_classes
from test_texts import brute_secrets

import corpus_pipeline
from reviewsieve.llm import langid, pieces
from reviewsieve.llm.common import words
from reviewsieve.session import materialize


def redacted(text):
    """Base secrets, overlapping ones as one, replaced by the mark."""
    out, at = [], 0
    for start, end, _ in brute_secrets(text):
        if start >= at:
            out += [text[at:start], "[SECRET]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def windows_hit(text, windows):
    """Words, and words inside an occurrence of a window."""
    w, hit = words(text), set()
    for size in {len(x) for x in windows}:
        for j in range(len(w) - size + 1):
            if tuple(w[j:j + size]) in windows:
                hit |= set(range(j, j + size))
    return len(w), len(hit)


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    model = langid.fit(docs)
    seen = {"start": docs}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = materialize(stage(spark, docs, sf), f"test-{name}")
        seen[name] = docs
        if name != "segmentation":
            assert docs.columns == before.columns
    kept = {name: {r.doc_id: r.text for r in df.collect()} for name, df in seen.items() if name != "segmentation"}

    with_letter = {k for k, r in rows.items() if r.text and any(c.isalpha() for c in r.text)}
    assert set(kept["language"]) <= with_letter
    for k in with_letter - set(kept["language"]):
        buckets, _, _ = langid.trigrams([rows[k].text])
        assert max(model.proportions(buckets).values()) < 0.5

    classes = brute_classes(sorted(kept["language"].items()))
    assert set(kept["near_duplicates"]) == {k for k, c in classes.items() if k == c}

    sequences = [words(text) for _, text in items]
    windows = {tuple(w[i:i + 13]) for w in sequences for i in range(max(1, len(w) - 12)) if w}
    clean = {}
    for k, text in kept["near_duplicates"].items():
        n, hit = windows_hit(text, windows)
        if not (hit and 20 * hit >= n):
            clean[k] = (text, hit)
    assert set(kept["decontamination"]) == set(clean)
    assert all(kept["decontamination"][k] == text for k, (text, hit) in clean.items() if not hit)

    for k, text in kept["decontamination"].items():
        found = kept["secret_scan"][k]
        assert found == redacted(text) or found.count("[SECRET]") > redacted(text).count("[SECRET]")

    codec = pieces.Codec(pieces.read_pieces())
    out = {r.doc_id: r.ids for r in seen["segmentation"].collect()}
    assert {k: codec.decode(ids) for k, ids in out.items()} == kept["secret_scan"]
    again = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, sf).collect()}
    assert again == out


def test_edge_rows(spark, sf):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "1234", "en", "s", 4), (None, "some words here to stay", "en", None, 5),
            (5, "some words here to stay", "en", "s", 5), (5, "some words here to stay", "en", "s", 5), (6, "w" * 200_000, "de", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for frame, expected in ((docs, [5, 6]), (docs.limit(0), [])):
        for _, stage in corpus_pipeline.STAGES:
            frame = materialize(stage(spark, frame, sf), "edge")
        assert sorted(r.doc_id for r in frame.collect()) == expected


def test_segmentation_gives_the_n_best(spark, sf):
    rows = [(1, "Unbelievable results, undoubtedly.", "en", "s", 34), (2, None, "en", "s", None), (3, "ab", "en", "s", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    codec = pieces.Codec(pieces.read_pieces())
    for row in corpus_pipeline.segmentation(spark, docs, sf).collect():
        text = rows[row.doc_id - 1][1] or ""
        found = [(s.score, list(s.ids)) for s in row.segmentations]
        assert found == [(score, ids.tolist()) for score, ids in codec.encode(text, pieces.N_BEST)]
        assert found[0][1] == row.ids and len(row.ids) == row.n_pieces
        assert all(codec.decode(ids) == text for _, ids in found)
        assert len(found) == pieces.N_BEST or not text
