"""Language identification, quality and pieces: against sequential computations and held-out labels."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from martwright.llm import langid, pieces, quality
from martwright.llm.base import vocabulary_file
from martwright.llm.lattice import vocabulary
from tests.llm.conftest import DE, EN, edge_rows

PATH = vocabulary_file(pieces.MODEL)


# ---- languages


@pytest.fixture(scope="module")
def two_languages(edge):
    return langid.train(edge, PATH)


def test_languages_are_told_apart(edge, clashing, two_languages):
    for docs in (edge, clashing):
        got = {(r.doc_id, r.lang_pred, round(r.score, 3)) for r in langid.identify(docs, two_languages).collect()}
        assert {(1, "en", 1.0), (2, "de", 1.0), (6, "en", 1.0), (3, "und", 0.0), (4, "und", 0.0), (5, "und", 0.0), (10, "und", 0.0)} <= got
    assert langid.identify(edge, two_languages).count() == len(edge_rows())


def test_word_probability_sums_all_segmentations(two_languages):
    vocab = vocabulary(PATH)
    for word in ["▁the", "▁katzed", "▁a", "▁日x😀"]:
        total = np.zeros(2)
        for cuts in itertools.product([0, 1], repeat=len(word) - 1):
            parts, last = [], 0
            for n, cut in enumerate([*cuts, 1], 1):
                if cut:
                    parts.append(word[last:n])
                    last = n
            p = np.ones(2)
            for part in parts:
                if part in vocab.id_of:
                    p = p * two_languages.pieces[vocab.id_of[part]]
                elif len(part) == 1:
                    p = p * np.prod(two_languages.pieces[vocab.fallback(part)], axis=0)
                else:
                    p = p * 0
            total += p
        assert langid.forward([word], two_languages)[0] == pytest.approx(np.log(total))


def test_long_words_do_not_underflow(two_languages):
    logs = langid.forward(["▁" + "zq" * 5000, "▁" + "the" * 20], two_languages)
    assert np.isfinite(logs).all()
    assert langid.Scorer(two_languages).score(["zq" * 5000, None, "", "x"])[0][1:3] == ["und", "und"]


@pytest.mark.parametrize("word", ["\u12a0\u1260\u1308\u12f0\u1200" * 3, "\U0001d41a\U0001d41b\U0001d41c\U0001d41d\U0001d41e" * 3])
def test_a_word_of_unseen_letters_does_not_decide_a_long_text(two_languages, word):
    rare = np.full_like(two_languages.pieces, 1e-12)  # what bytes unseen in learning have with much learned text
    seen = two_languages.pieces > two_languages.pieces.min(axis=0) * 1.5
    model = langid.LanguageModel(two_languages.languages, np.where(seen, two_languages.pieces, rare), PATH)
    assert np.isfinite(langid.forward(["▁" + word], model)).all()
    for text, lang in ((EN, "en"), (DE, "de")):
        names, scores = langid.Scorer(model).score([text * 50 + word])
        assert names == [lang] and scores == pytest.approx([1.0])


def test_words_of_unseen_letters_are_learned():
    pieces_ = np.full((vocabulary(PATH).size, 1), 1e-6)
    word = "▁" + "\U0001d41a" * 40
    counts = langid.expected_counts([word], np.array([2.0]), np.array([0]), pieces_, PATH)
    assert counts.sum() == pytest.approx(2 * (1 + 40 * 4))


def test_probabilities_add_up(two_languages):
    assert two_languages.pieces.sum(axis=0) == pytest.approx([1, 1])
    assert two_languages.pieces.min() > 0


def test_nothing_learned_and_nothing_to_score(none, edge, two_languages):
    model = langid.train(none, PATH)
    assert {r.lang_pred for r in langid.identify(edge, model).collect()} == {"und"}
    assert langid.identify(none, two_languages).count() == 0


# ---- quality


@pytest.fixture(scope="module")
def quality_data(spark):
    rng = random.Random(4)
    words = [w for w in (EN + DE).split()]
    rows = []
    for i in range(400):
        body = [rng.choice(words) for _ in range(rng.randint(20, 200))]
        good = i % 3 > 0
        rows.append((i, " ".join(body).capitalize() + "." if good else " ".join(w.upper() + "!!" for w in body), int(good)))
    return spark.createDataFrame(rows, "doc_id long, text string, quality int")


def test_quality_on_held_out_documents(quality_data):
    learned, kept = quality_data.where("doc_id % 4 > 0"), quality_data.where("doc_id % 4 = 0")
    model = quality.train(learned, learned.select("doc_id", "quality"))
    scored = quality.classify(kept, model, keep=("doc_id", "quality")).collect()
    assert np.mean([(r.score >= 0.5) == (r.quality == 1) for r in scored]) > 0.97


def test_quality_of_long_documents_is_fitted_on_all_their_chunks(spark):
    rng, words = random.Random(5), (EN + DE).split()
    rows = []
    for i in range(240):
        good, parts = i % 2, []
        for k in range(rng.choice([1, 3, 60])):
            body = [rng.choice(words) for _ in range(80)]
            junk = rng.random() < (0.1 if good else 0.9)  # good texts have some bad chunks: the more chunks, the surer
            parts.append(" ".join(w.upper() + "!!" for w in body) if junk else " ".join(body) + ".")
        rows.append((i, "\n".join(parts), good))
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = quality.train(docs, docs.select("doc_id", "quality"))
    scorer = quality.Scorer(model)
    seen = np.array([scorer.logits(t.encode()) for _, t, _ in rows])
    labels = np.array([g for _, _, g in rows])
    assert model.combine == pytest.approx(quality._logistic(seen, labels.astype(float), np.ones(len(labels))), rel=1e-3, abs=1e-3)
    long = np.array([len(t) > 10_000 for _, t, _ in rows])
    assert np.mean((scorer.score([t.encode() for _, t, _ in rows]) >= 0.5)[long] == labels[long]) > 0.97


def test_quality_edge_rows(edge, clashing, none, quality_data):
    model = quality.train(quality_data, quality_data.select("doc_id", "quality"))
    for docs in (edge, clashing):
        got = quality.classify(docs, model).collect()
        assert len(got) == len(edge_rows()) and all(0 <= r.score <= 1 for r in got)
        assert len({r.score for r in got if r.doc_id in (3, 4)}) == 1
        assert len({r.score for r in got if r.doc_id in (1, 8)}) == 1
    assert quality.classify(none, model).count() == 0


def test_quality_without_labels_or_with_one_class(edge, none, spark):
    nothing = spark.createDataFrame([(1, None)], "doc_id long, quality int")
    assert {r.score for r in quality.classify(edge, quality.train(edge, nothing)).collect()} == {0.5}
    ones = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    assert {r.score for r in quality.classify(edge, quality.train(edge, ones)).collect()} == {0.75}


@pytest.mark.parametrize("size", [0, 1, 511, 512, 513, 960, 961, 5000])
def test_chunks_cover_the_whole_text(size):
    covered = np.zeros(max(size, quality.CHUNK_BYTES), bool)
    for at in quality.starts(size):
        covered[at : at + quality.CHUNK_BYTES] = True
    assert covered.all()


def test_pair_tables_are_the_convolution():
    rng = np.random.default_rng(1)
    model = quality.QualityModel(rng.normal(size=(256, quality.VECTOR)), rng.normal(size=(quality.WIDTH, quality.VECTOR, quality.FILTERS)), rng.normal(size=quality.FILTERS), np.zeros(quality.FILTERS + 1), np.zeros(3))
    rows = rng.integers(0, 256, (3, quality.CHUNK_BYTES)).astype(np.uint8)
    places = quality.CHUNK_BYTES - quality.WIDTH + 1
    plain = np.array([[[sum(model.vectors[row[t + k]] @ model.filters[k, :, f] for k in range(quality.WIDTH)) for f in range(3)] for t in range(places)] for row in rows])
    expected = np.maximum(plain.max(axis=1) + model.offsets[:3], 0)
    assert quality.features(rows, model.pair_tables(), model.offsets)[:, :3] == pytest.approx(expected, abs=1e-3)


# ---- pieces


def sequential(text, vocab):
    """Ids by plain dynamic programming over the whole text."""
    w = pieces.normal(text)
    best, back = [0.0] + [-np.inf] * len(w), [0] * (len(w) + 1)
    for e in range(1, len(w) + 1):
        for k in range(1, min(vocab.longest, e) + 1):
            found = vocab.id_of.get(w[e - k : e])
            score = vocab.scores[found] if found is not None else vocab.fallback_score if k == 1 else -np.inf
            if best[e - k] + score >= best[e]:
                best[e], back[e] = best[e - k] + score, k
    out, e = [], len(w)
    while e:
        found = vocab.id_of.get(w[e - back[e] : e])
        out.append([found] if found is not None else vocab.fallback(w[e - 1]))
        e -= back[e]
    return [i for part in reversed(out) for i in part]


def odd_texts():
    rng = random.Random(2)
    mixed = ["".join(rng.choice(["a", "b", "the", " ", "  ", "ing", "é", "😀", "▁", "\n", "aaaa", "日"]) for _ in range(rng.randint(1, 120))) for _ in range(60)]
    return mixed + ["".join(rng.choice("aabeth") for _ in range(rng.randint(20, 300))) for _ in range(30)] + ["", "a", " ", EN * 5]


def test_encoding_is_the_best_segmentation():
    vocab = vocabulary(PATH)
    encoder = pieces.WordEncoder(vocab)
    for text in odd_texts():
        ids = np.frombuffer(encoder.encode([pieces.normal(text)])[0], "<i4").tolist()
        assert ids == sequential(text, vocab)
        assert pieces.decode_ids(ids, vocab)[1:] == text.replace("▁", " ")


@pytest.mark.parametrize("chunk", [17, 40, 100])
def test_chunked_encoding_is_the_sequential_one(spark, chunk):
    vocab = vocabulary(PATH)
    texts = odd_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    got = {}
    for r in pieces.encode(docs, PATH, chunk_chars=chunk).orderBy("doc_id", "chunk").collect():
        got.setdefault(r.doc_id, []).extend(r.ids)
    assert got == {i: sequential(t, vocab) for i, t in enumerate(texts)}


def test_scan_over_matrices_is_associative():
    rng = np.random.default_rng(0)
    m = rng.integers(-50, 0, (7, 4, 4)).astype(float)
    out = m[0]
    for k in range(1, 7):
        out = pieces.max_plus(out, m[k])
    assert (pieces.running_products(m)[-1] == out).all()


def test_round_trip_of_edge_rows(edge, clashing, none):
    for docs in (edge, clashing):
        for chunk in (1000, pieces.CHUNK_CHARS):
            got = pieces.encode_and_decode(docs, PATH, chunk_chars=chunk).collect()
            assert len(got) == len(edge_rows()) and all(r.round_trip for r in got)
    by_size = [{(r.doc_id, r.n_pieces, r.ids_digest) for r in pieces.encode_and_decode(edge, PATH, chunk_chars=c).collect()} for c in (500, 50_000)]
    assert by_size[0] == by_size[1]
    assert pieces.encode_and_decode(none, PATH).count() == 0


def test_chunks_are_traced_in_slices_of_bounded_size(spark, none, monkeypatch):
    """A worker holds no more than a slice of the chunks of a batch."""
    made, plain = [], type(none).mapInArrow
    monkeypatch.setattr(type(none), "mapInArrow", lambda self, fn, schema: made.append(fn) or plain(self, fn, schema))
    pieces.encode_giants(none, PATH, ("doc_id",))
    body, states = "▁ab" * 12_000, vocabulary(PATH).longest
    entry = [0.0] + [-np.inf] * (states - 1)
    rows = [{"doc_id": i, "row_key": i, "chunk": 0, "before": "", "body": body, "after": "", "entry": entry, "right": 0} for i in range(60)]
    out = list(made[-1](iter([pa.RecordBatch.from_pylist(rows)])))
    assert sum(b.num_rows for b in out) == 60
    assert max(b.num_rows for b in out) * len(body.encode()) <= pieces.BYTES_AT_ONCE


def test_repeated_rows_stay_apart(spark):
    docs = spark.createDataFrame([(1, EN * 10)] * 3, "doc_id long, text string")
    assert pieces.encode_and_decode(docs, PATH, chunk_chars=100).where(F.col("round_trip")).count() == 3
