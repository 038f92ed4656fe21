"""The pipeline's stages, each against what its operator says of its input."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from martwright.llm import mixing
from martwright.session import stage

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def staged(spark):
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), {}
    for name, step in pipeline.STAGES:
        out[name] = (docs, stage(step(spark, docs, FOLDER), name))
        docs = out[name][1]
    return out


def test_stages_keep_the_columns(staged):
    for name, (before, after) in staged.items():
        if name != "sentencepiece":
            assert after.columns == list(pipeline.COLUMNS)
    assert staged["language_id"][0].count() == 200


def test_language_stage_keeps_clean_documents(staged):
    before, after = staged["language_id"]
    assert after.count() >= 0.99 * before.count()


def test_quality_stage_follows_the_labels(spark, staged):
    before, after = staged["quality_filter"]
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    marked = before.join(labels, "doc_id").join(after.select("doc_id", F.lit(True).alias("kept")), "doc_id", "left").select("quality", F.coalesce("kept", F.lit(False)).alias("kept")).collect()
    assert sum(r.kept == (r.quality == 1) for r in marked) >= 0.95 * len(marked)


def brute_force_kept(rows):
    """Ids kept by comparing every pair's sets of five-word shingles; exact copies are linked too."""
    sets, root = {}, {}
    for key, text in rows:
        words = (text or "").encode().lower().split()
        sets[key] = {tuple(words[k : k + 5]) for k in range(max(len(words) - 4, 1))} if words else set()
        root[key] = key

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in sets:
        for b in sets:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted(k for k in root if root[k] == k)


def test_near_duplicate_stage_is_brute_force_jaccard(spark, staged):
    before, after = staged["near_duplicates"]
    assert sorted(r.doc_id for r in after.collect()) == brute_force_kept([(r.doc_id, r.text) for r in before.collect()])


def test_edited_copies_go_and_half_copies_stay(spark):
    rng = random.Random(3)
    words, rows = [f"w{i}" for i in range(3000)], []
    for i in range(40):
        body = [rng.choice(words) for _ in range(rng.randint(60, 400))]
        rows.append(body)
        for edits in (1, len(body) // 60, len(body) // 45, len(body) // 30, len(body) // 10):
            copy = list(body)
            for at in rng.sample(range(len(copy)), edits):
                copy[at] = rng.choice(words)
            rows.append(copy)
    docs = spark.createDataFrame([(i, " ".join(b), "en", "a", 1) for i, b in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = sorted(r.doc_id for r in pipeline.near_duplicates(spark, docs, FOLDER).collect())
    assert kept == brute_force_kept([(i, " ".join(b)) for i, b in enumerate(rows)])
    assert 40 < len(kept) < 0.6 * len(rows)


def test_mix_stage_emits_the_planned_copies(staged):
    before, after = staged["mix_sources"]
    planned = {r.doc_id: r.mix_copies for r in mixing.plan_copies(before, mixing.word_count(F.col("text"))).collect()}
    got = {r.doc_id: r["count"] for r in after.groupBy("doc_id").count().collect()}
    assert got == {k: v for k, v in planned.items() if v}


def test_last_stage_has_every_copy_and_decodes(staged):
    before, after = staged["sentencepiece"]
    assert after.count() == before.count() and after.where(~F.col("round_trip")).count() == 0


def test_run_gives_the_last_stage(spark, staged):
    columns = ["doc_id", "n_pieces", "ids_digest", "decoded_crc32"]
    got, expected = (sorted(tuple(r) for r in df.select(*columns).collect()) for df in (pipeline.run(spark, FOLDER), staged["sentencepiece"][1]))
    assert got == expected


@pytest.mark.parametrize("name", [n for n, _ in pipeline.STAGES])
def test_stages_take_edge_rows_and_nothing(spark, edge, none, name):
    step = dict(pipeline.STAGES)[name]
    assert step(spark, none, FOLDER).count() == 0
    kept = step(spark, edge, FOLDER)
    assert kept.count() > 0
