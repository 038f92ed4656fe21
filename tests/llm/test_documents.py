"""Token output, sharding, mixing, near-duplicates: against brute force, on edge rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from martwright.llm import components, mixing, sharding, simhash, tokens
from martwright.llm.base import QUERIES, vocabulary_file
from martwright.session import stage_path
from tests.llm.conftest import edge_rows


def rows_of(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


# ---- token ids


def written(spark, docs):
    path = stage_path(spark, "test_tokens")
    tokens.write_tokens(docs, path, vocabulary_file(tokens.TOKENIZER))
    return path


def test_tokens_round_trip_and_order(spark, edge, clashing):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(vocabulary_file(tokens.TOKENIZER))
    expected = Counter((d, tuple(plain.encode(t or "", add_special_tokens=False).ids + [0])) for d, t, *_ in edge_rows())
    for docs in (edge, clashing):
        back = tokens.read_tokens(spark, written(spark, docs)).orderBy("part", "row").collect()
        assert Counter((r.doc_id, tuple(r.ids)) for r in back) == expected
        ids = [-1 if r.doc_id is None else r.doc_id for r in back]
        assert ids == sorted(ids)


def test_token_digests(spark, edge):
    back = tokens.read_tokens(spark, written(spark, edge))
    ids = {(r.part, r.row): r.ids for r in back.collect()}
    for r in tokens.token_digests(back).collect():
        assert (r.n_tokens, r.ids_crc32) == (len(ids[r.part, r.row]), zlib.crc32(np.array(ids[r.part, r.row], "<u4").tobytes()))


def test_tokens_empty_table(spark, none):
    assert tokens.read_tokens(spark, written(spark, none)).count() == 0


def test_tokens_files_prune(spark, edge):
    found = tokens.read_tokens(spark, written(spark, edge)).where(F.col("doc_id") == 25)
    assert found.count() == 1
    assert "EqualTo(doc_id,25)" in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("text", ["it's  we'll\n\n x", "ªº½²a\x85\x1cb", "ß🙂日 <|endoftext|>", "a" * 500, "\t \t a", "don't'll"])
def test_cached_encoding_is_the_tokenizers(text):
    encoder = tokens.CachingEncoder(vocabulary_file(tokens.TOKENIZER))
    for _ in range(2):
        assert np.frombuffer(encoder.encode(text), "<i4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_a_part_is_looked_up_once_and_a_new_one_merged_once():
    encoder, looked_up = tokens.CachingEncoder(vocabulary_file(tokens.TOKENIZER)), []
    ids_of, encoder.ids_of = encoder.ids_of, lambda part: looked_up.append(part) or ids_of(part)
    text = "old new old newer " + "z" * 200
    assert np.frombuffer(encoder.encode(text), "<i4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert looked_up == ["old", " new", " old", " newer", " " + "z" * 200]
    assert set(ids_of.__self__) == {"old", " new", " old", " newer"}


def test_written_ids_are_read_once_for_their_order(spark, edge, tmp_path, monkeypatch):
    seen, in_order = [], tokens.in_order
    monkeypatch.setattr(tokens, "in_order", lambda df, *how: seen.append(df) or in_order(df, *how))
    edge.write.parquet(f"{tmp_path}/documents.parquet")
    rows = QUERIES["op1_token_ids"](spark, str(tmp_path)).collect()
    assert len(rows) == len(edge_rows()) and sum(r.n_tokens for r in rows) == max(r.start + r.n_tokens for r in rows)
    assert "MapInArrow" not in seen[0]._jdf.queryExecution().executedPlan().toString()


# ---- sharding


def brute_shards(rows, shards):
    sizes = defaultdict(int)
    for _, text, *_ in rows:
        sizes[hashlib.sha256((text or "").encode()).hexdigest()] += len((text or "").encode()) + 1
    order = sorted(sizes)

    def place(capacity):
        at, filled, out = 0, 0, {}
        for g in order:
            if filled + sizes[g] > capacity:
                at, filled = at + 1, 0
            filled += sizes[g]
            out[g] = at
        return out

    capacity = max(max(sizes.values()), -(-sum(sizes.values()) // shards))
    while max(place(capacity).values()) >= shards:
        capacity += 1
    return place(capacity)


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_shards_are_minimax(edge, clashing, shards):
    expected = brute_shards(edge_rows(), shards)
    for docs in (edge, clashing):
        got = sharding.shard_documents(docs, shards).collect()
        assert len(got) == len(edge_rows())
        digest = Counter((d, zlib.crc32((t or "").encode()), expected[hashlib.sha256((t or "").encode()).hexdigest()]) for d, t, *_ in edge_rows())
        assert Counter((r.doc_id, r.text_crc32, r.shard) for r in got) == digest
        slots = defaultdict(list)
        for r in got:
            slots[r.shard].append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_cuts_refine_to_the_exact_optimum(spark):
    rng = np.random.default_rng(5)
    sizes = rng.integers(1, 5000, 700)
    sizes[100] = 200_000
    ends = np.cumsum(sizes)
    df = spark.createDataFrame([(int(e),) for e in ends], "end long")

    def greedy(capacity):
        cuts, at = [], 0
        for _ in range(8):
            at = int(ends[np.searchsorted(ends, at + capacity, side="right") - 1]) if at + capacity >= ends[0] else at
            cuts.append(at)
        return cuts

    low, high = max(int(sizes.max()), -(-int(ends[-1]) // 8)), int(ends[-1])
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if greedy(middle)[-1] == ends[-1] else (middle + 1, high)
    assert sharding.minimax_cuts(df, "end", 8, int(ends[-1]), int(sizes.max()), cells=16) == greedy(low)


def test_shards_of_nothing(none):
    assert sharding.shard_documents(none).count() == 0


# ---- mixing


def brute_targets(sizes, share=1.5, ceiling=2.0):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, target, open_ = share * sum(sizes.values()), {}, set(order)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > ceiling * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in open_}
        for s in over:
            target[s] = ceiling * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def words(text):
    return len(re.findall("[^\\x20\\x09-\\x0D]+", text or ""))


def test_mixing_targets_and_copies(edge, clashing):
    sizes = Counter()
    for _, text, _, source, _ in edge_rows():
        sizes[source] += words(text)
    target = brute_targets(sizes)
    for docs in (edge, clashing):
        got = mixing.plan_copies(docs.drop("mix_size", "_rate"), mixing.word_count(F.col("text"))).collect()
        assert Counter((r.doc_id, r.text) for r in got) == Counter((d, t) for d, t, *_ in edge_rows())
        for r in got:
            assert r.mix_size == words(r.text) and r.mix_source_size == sizes[r.source]
            assert r.mix_target == pytest.approx(target[r.source])
            rate = target[r.source] / sizes[r.source] if sizes[r.source] else 0
            draw = int(hashlib.md5(f"mix:{'-' if r.doc_id is None else r.doc_id}".encode()).hexdigest()[:12], 16) / 2**48
            assert r.mix_copies == int(rate) + (draw < rate - int(rate)) <= 2


def test_mix_emits_the_planned_copies(edge, none):
    size = mixing.word_count(F.col("text"))
    planned = Counter()
    for r in mixing.plan_copies(edge, size).collect():
        planned[r.doc_id, r.text] += r.mix_copies
    assert Counter((r.doc_id, r.text) for r in mixing.mix(edge, size).collect()) == +planned
    assert mixing.mix(none, size).count() == 0


def test_mixed_words_come_near_targets(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("one two three").alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise("cold").alias("source"))
    for r in mixing.plan_copies(docs, mixing.word_count(F.col("text"))).groupBy("source").agg(F.sum(F.col("mix_size") * F.col("mix_copies")).alias("taken"), F.first("mix_target").alias("target")).collect():
        assert abs(r.taken - r.target) < 0.03 * r.target


# ---- near-duplicates


def plain_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\\x20\\x09-\\x0D]+", text)
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_fingerprints_and_components(spark, edge, clashing):
    rows = edge_rows()
    codes = [plain_fingerprint(r[1]) for r in rows]
    group = roots(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (codes[i] ^ codes[j]).bit_count() <= 3])
    least = {g: min((rows[i][0] for i in range(len(rows)) if group[i] == g and rows[i][0] is not None), default=None) for g in group}
    expected = Counter((r[0], c - (c >> 63 << 64), least[g]) for r, c, g in zip(rows, codes, group, strict=True))
    for docs in (edge, clashing):
        marked = simhash.fingerprints(docs)
        assert rows_of(marked.join(simhash.near_duplicates(marked), "fingerprint"), "doc_id", "fingerprint", "component_id") == expected


def test_no_fingerprints_of_nothing(none):
    marked = simhash.fingerprints(none)
    assert marked.join(simhash.near_duplicates(marked), "fingerprint").count() == 0


@pytest.mark.parametrize("seed", range(8))
def test_index_finds_every_group(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(2, 700))
    codes = rng.integers(0, 2**64, max(1, n // 40), dtype=np.uint64)[rng.integers(0, max(1, n // 40), n)]
    for _ in range(int(rng.integers(0, 7))):
        codes = codes ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
    codes = np.unique(codes)
    keys = rng.integers(0, 3, len(codes))
    near = [(i, j) for i in range(len(codes)) for j in range(i) if keys[i] == keys[j] and int(codes[i] ^ codes[j]).bit_count() <= 3]
    expected, got = roots(len(codes), near), simhash.bucket_groups(keys, codes)
    assert len({*zip(expected, got.tolist(), strict=True)}) == len(set(expected)) == len(set(got.tolist()))


def test_hot_buckets_are_dealt_again_without_losing_links(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**64, 30, dtype=np.uint64)[rng.integers(0, 30, 900)]
    for _ in range(3):
        base = base ^ (np.uint64(1) << rng.integers(0, 64, 900).astype(np.uint64))
    codes = np.unique(base)
    df = spark.createDataFrame([(int(c),) for c in codes.view(np.int64)], "fingerprint long")
    expected = roots(len(codes), [(i, j) for i in range(len(codes)) for j in range(i) if int(codes[i] ^ codes[j]).bit_count() <= 3])
    place = {int(c): i for i, c in enumerate(codes.view(np.int64))}
    for most in (2, 8, 4096):
        edges = [(place[r.u], place[r.v]) for r in simhash.links(df, most).collect()]
        got = roots(len(codes), edges)
        assert len({*zip(expected, got, strict=True)}) == len(set(expected)) == len(set(got))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(200, 200), (300, 299)]
    got = {r.u: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 160)} | {300: 299}
