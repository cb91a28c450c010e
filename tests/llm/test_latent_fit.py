"""The latent directions are fitted to all documents, and words are hashed in arrays as they are one by one."""

import random
import zlib

import numpy as np
import pytest

from cuewise.llm import decontamination as D


def test_features_of_texts_are_those_of_words(monkeypatch):
    texts = ["The Quick-brown  fox", None, "", " \n\t", "É" * 3, "x" * 64 + " " + "y" * 65 + " ab", "ÄÖ Straße İx 12-3 a.b\x7fq\x00z", "w " * 300, "z" * 500, "one"]
    want = [[zlib.crc32(w) % D.FEATURES for w in D.words_of(t)] for t in texts]
    for step in (40, 1 << 16):
        monkeypatch.setattr(D, "TEXT_STEP", step)
        ids, counts = D.Features().of_texts(texts)
        assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    assert D.Features().of_texts([])[0].tolist() == []


def passages(text, idf):
    """The TF-IDF passages of a text, one by one."""
    chunks = [D.Features().of(w[i : i + D.CHUNK]) for w in [D.words_of(text)] for i in range(0, len(w), D.CHUNK)]
    for i in range(max(1, len(chunks) - 1) if chunks else 0):
        row = np.bincount(np.concatenate(chunks[i : i + 2]), minlength=D.FEATURES) * idf.astype(np.float64)
        yield row / max(np.linalg.norm(row), 1e-9)


@pytest.mark.parametrize("part", [3, 1 << 13])
def test_every_document_counts_in_the_fit(spark, monkeypatch, part):
    """More documents than the 4,000 that a sample used to hold: the sums are those of all passages."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choices(words, k=rng.choice([1, 5, 16, 17, 40]))) for _ in range(4_500 if part > 3 else 60)] + [None, "", " ".join(rng.choices(words, k=1_000))]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    idf = D.inverse_frequencies(docs)
    x = np.array([p for t in texts for p in passages(t, idf)])
    basis = np.random.default_rng(2).standard_normal((D.FEATURES, 5)).astype(np.float32)
    if part == 3:  # in this process, as the bound is set here alone
        monkeypatch.setattr(D, "PART", part)
        held = type("Held", (), {"value": (idf, basis, False)})
        batches = D.hashed(docs).toArrow().to_batches()
        own = np.array(next(iter(D._sketch(held)(iter(batches)))).column("v").to_pylist())
    else:
        own = D._summed(D.hashed(docs), idf, basis, False)
        assert np.allclose(D._summed(D.hashed(docs), idf, basis, True), (x @ basis).T @ (x @ basis), rtol=1e-3, atol=1e-2)
    assert np.allclose(own, x.T @ (x @ basis), rtol=1e-3, atol=1e-3 * np.abs(own).max())


def test_candidates_left_out_could_not_match():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    items = [(k, [w.encode() for w in rng.choices(words, k=k)]) for k in (8, 15, 30, 64, 65, 90)]
    texts = [" ".join(rng.choices(words[: rng.choice([12, 60])], k=rng.choice([5, 40, 200]))) for _ in range(40)]
    index = D.Index(items, np.ones((D.FEATURES, 4), np.float32))
    for group, ids, counts in D._grouped(*D.Features().of_texts(texts)):
        chunks, row = D._chunks(ids, counts)
        place = np.arange(len(chunks)) - np.searchsorted(row, row)
        p, i = (x.ravel() for x in np.meshgrid(np.arange(len(chunks)), np.arange(len(items))))
        shown = index._may_show(chunks.ravel(), place, p, i)
        for a, b, s in zip(p.tolist(), i.tolist(), shown.tolist(), strict=True):
            own, item, at = D.words_of(texts[group[row[a]]]), items[b][1], int(place[a]) * D.CHUNK
            around = own[max(0, at - len(item)) : at + 2 * D.CHUNK + len(item)]
            assert s or index.verdict(item, around) is None
        assert 0 < shown.sum() < len(shown)


def test_the_pipeline_fits_all_documents(spark, monkeypatch):
    """Passages are white in directions that were fitted to all of them; a sample of 4,000 in 6,000 documents would give variances of about 1.5."""
    import corpus_pipeline

    rng = random.Random(5)
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(rng.choices(words, k=30)) for _ in range(6_000)]
    docs = spark.createDataFrame([(i, t, "en", "a") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").repartition(4)
    made, own = [], D._directions
    monkeypatch.setattr(D, "_directions", lambda *given: made.append(own(*given)) or made[-1])
    corpus_pipeline.drop_contaminated(spark, docs, "/root/testdata/sf0.001")
    idf = D.inverse_frequencies(docs)
    known = np.unique(D.Features().of([w.encode() for w in words]))
    x = np.array([p[known] for t in texts for p in passages(t, idf)])
    assert len(made) == 1 and np.allclose(made[0], D.latent_directions(docs, idf))
    seen = x @ (made[0] / np.where(idf > 0, idf, 1)[:, None])[known]
    assert np.allclose(seen.T @ seen, np.eye(seen.shape[1]), atol=0.01)
