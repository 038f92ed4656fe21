"""Operators 11 to 13: against their SQL, brute force on awkward rows, and what bounds them."""

import hashlib
import random
import re
import time
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from martwright.catalogue.base import TABLES
from martwright.llm import ORACLES, QUERIES, simhash, spelling, tensor, trie
from tools.check_oracle import compare

FOLDER = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not FOLDER.exists(), reason="benchmark tables are not here")
@pytest.mark.parametrize("key", sorted(ORACLES))
def test_query_equals_sql(spark, key):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    assert key in QUERIES and compare(spark, con, key, str(FOLDER))[0] == "ok"


# Near duplicates


def brute_components(rows, words_each, percent):
    """(doc_id, set size, smallest id reachable) per row, by comparing every pair."""
    sets, root = [], list(range(len(rows)))
    for _, text in rows:
        words = (text or "").encode().lower().split()
        sets.append({tuple(words[k : k + words_each]) for k in range(max(len(words) - words_each + 1, 1))} if words else set())

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    ids = {}
    for k, (key, _) in enumerate(rows):
        if key is not None:
            ids[find(k)] = min(key, ids.get(find(k), key))
    return sorted(((key, len(sets[k]), ids.get(find(k)) if sets[k] else key) for k, (key, _) in enumerate(rows)), key=str)


def run(docs, **how):
    return sorted((tuple(r) for r in tensor.near_duplicates(docs, **how).select("doc_id", "n_shingles", "component_id").collect()), key=str)


def edited_copies(seed=3, bases=30):
    rng, rows = random.Random(seed), []
    words = [f"w{i}" for i in range(2000)]
    for _ in range(bases):
        body = [rng.choice(words) for _ in range(rng.randint(4, 250))]
        rows.append(body)
        for edits in (1, 1 + len(body) // 60, 1 + len(body) // 40, 1 + len(body) // 25):
            copy = list(body)
            for at in rng.sample(range(len(copy)), min(edits, len(copy))):
                copy[at] = rng.choice(words)
            rows.append(copy)
    return [(i, " ".join(b)) for i, b in enumerate(rows)]


@pytest.mark.parametrize("how", [{}, {"words_each": 5, "percent": 80, "halves": 18, "fingerprints_first": True}])
def test_near_duplicates_are_brute_force(spark, edge, clashing, how):
    rows = edited_copies() + [(5000, None), (5001, ""), (5002, " \t"), (None, "w1 w2 w3 w4"), (None, "w1 w2 w3 w4"), (5003, "W1 w2 W3 w4"), (5004, "w1"), (5005, "w1 w2"), (5005, "w1 w2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    expected = brute_components(rows, how.get("words_each", 3), how.get("percent", 85))
    assert run(docs, **how) == expected
    more = docs.withColumns({c: F.lit(7) for c in ("code", "digest", "set", "root", "n", "key", "score", "halves", "row_key", "text_key", "u", "v")})
    assert run(more, **how) == expected
    assert run(edge) == run(clashing) == brute_components([(r.doc_id, r.text) for r in edge.collect()], 3, 85)


def test_no_documents_no_rows(none):
    assert run(none) == []


def test_documents_that_share_a_passage_are_not_paired(spark):
    """A passage of 60 words in 5000 documents of about 100: no two are similar, and no pair of them is ever compared."""
    rng = random.Random(1)
    passage = " ".join(f"licence{i}" for i in range(60))
    rows = [(i, f"{passage} " + " ".join(f"x{rng.randrange(10**6)}" for _ in range(rng.randint(30, 60)))) for i in range(5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    start = time.monotonic()
    assert tensor.near_duplicates(docs).where("component_id <> doc_id").count() == 0
    assert time.monotonic() - start < 60


def test_a_hub_ties_copies_that_are_not_similar_to_each_other(spark):
    """Each of 600 copies has two words of one text replaced: similar to the text, mostly not to each other."""
    rng = random.Random(2)
    base = [f"b{i}" for i in range(90)]
    rows = [(0, " ".join(base))]
    for i in range(600):
        copy = list(base)
        for at in rng.sample(range(90), 2):
            copy[at] = f"y{rng.randrange(10**6)}"
        rows.append((i + 1, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r.component_id for r in tensor.near_duplicates(docs).collect()} == {0}


def test_a_pair_is_made_once_however_many_shingles_it_shares(spark, monkeypatch):
    """Sets that share 80 of their 100 shingles meet under many of them; each pair leaves the join once, and one of 90 is not lost."""
    core, kinds = range(80), "code long, n long, set array<long>, halves array<long>, cells array<long>"
    bodies = [[*core, *(1000 + 20 * i + k for k in range(20))] for i in range(12)]
    bodies[1] = [*bodies[0][:90], *range(5000, 5010)]
    bodies[0] = [*bodies[0][:95], *range(6000, 6005)]
    cells = [np.bincount(np.array(b) % tensor.CELLS, minlength=tensor.CELLS).tolist() for b in bodies]
    sets = spark.createDataFrame([(i, 100, b, [], c) for i, (b, c) in enumerate(zip(bodies, cells, strict=True))], kinds)
    rows = spark.createDataFrame([(7, i, 1, i) for i in range(12)], "key long, code long, score long, root long")
    by_prefix, owned = tensor._prefix_buckets(rows, sets, 60)
    placed = by_prefix.withColumn("root", F.col("code"))
    monkeypatch.setattr(type(placed), "distinct", lambda self: self)
    made = [(r.u, r.v) for r in tensor._rest(placed, owned, sets, 60).collect()]
    similar = {(i, j) for j in range(12) for i in range(j) if len({*bodies[i]} & {*bodies[j]}) * 100 >= 60 * len({*bodies[i]} | {*bodies[j]})}
    assert (0, 1) in similar and similar <= set(made)
    assert len(made) == len(set(made))


def test_every_similar_pair_of_a_fingerprint_group_is_found(spark):
    """Chains of copies: neighbours are similar, others are not, and half bands of so many hashes find none of them."""
    rng, rows = random.Random(5), []
    for _ in range(4):
        body = [f"w{rng.randrange(10**6)}" for _ in range(1200)]
        for _ in range(12):
            rows.append((len(rows), " ".join(body)))
            for at in rng.sample(range(1200), 2):
                body[at] = f"w{rng.randrange(10**6)}"
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    marks = simhash.fingerprints(docs)
    group = {r.doc_id: r.component_id for r in marks.join(simhash.near_duplicates(marks), "fingerprint").collect()}
    found = {r.doc_id: r.component_id for r in tensor.near_duplicates(docs, percent=99, half_rows=1000, halves=1, fingerprints_first=True).collect()}
    sets = [{tuple(words[k : k + 3]) for k in range(1198)} for words in (text.split() for _, text in rows)]
    near = [(i, j) for j in range(len(rows)) for i in range(j) if group[i] == group[j] and 100 * len(sets[i] & sets[j]) >= 99 * len(sets[i] | sets[j])]
    assert len(near) >= 20
    assert [(i, j) for i, j in near if found[i] != found[j]] == []


def test_half_bands_cost_a_square_root_and_agree_by_similarity():
    rng = np.random.default_rng(0)
    factors = rng.integers(0, 1 << 32, (2, 2 * tensor.HALVES * tensor.HALF_ROWS), dtype=np.uint32) | np.uint32(1)
    assert factors.shape[1] == 84 and tensor.HALVES**2 * 2 * tensor.HALF_ROWS == 1176
    hits = 0
    for _ in range(200):
        every = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
        least = np.array([tensor.minimal_hashes(s, factors) for s in (every[:370], every[30:])])  # similarity 0.85
        a, b = tensor.half_bands(least, tensor.HALF_ROWS)
        hits += (a == b).sum()
    assert abs(hits / (200 * 2 * tensor.HALVES) - 0.85**3) < 0.02


def test_pairs_of_half_bands_miss_next_to_nothing():
    p = (tensor.LEAST_PERCENT / 100) ** tensor.HALF_ROWS
    assert 2 * (1 - p) ** tensor.HALVES < 5e-6
    assert tensor.least_agreement(85, 3, 14) >= 4


# Spelling


def brute_variants(counts):
    words = sorted(counts)

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    out = {}
    for w in words:
        others = [v for v in words if near(w, v)]
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form = best if best is not None and counts[best] >= 2 * counts[w] else None
        out[w] = (form, len(others))
    rows = []
    for w, (form, n_near) in out.items():
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        rows.append((w, form, root, counts[w], n_near, counts.get(form)))
    return sorted(rows)


def test_variants_are_brute_force(spark):
    rng = random.Random(5)
    counts = {"".join(rng.choice("abàé") for _ in range(rng.randint(1, 7))): rng.choice([3, 4, 8, 20, 50, 200]) for _ in range(700)}
    counts |= {"": 4, "a": 9, "aaaaaa": 3, "aaaaaaa": 9, "x" * 3000: 5, "x" * 3001: 30, "x" * 1500 + "y" + "x" * 1499: 11, "😀bc": 2, "😀bd": 4, "é": 3}
    rows = [*counts.items(), (None, 3), ("null-count", None)]
    df = spark.createDataFrame(rows, "word string, n long").withColumns({c: F.lit(1) for c in ("position", "p", "s", "place", "word_no", "best")}).repartition(3)
    got = sorted(tuple(r) for r in spelling.variants(df).select("word", "form", "root", "n", "n_near", "form_n").collect())
    assert got == brute_variants(counts)


def test_word_counts_follow_the_rule(spark, edge, none):
    counts = {}
    for r in edge.collect():
        for run_ in re.findall("[A-Za-zÀ-ÿ]+", r.text or ""):
            word = "".join(c.lower() if c.isascii() else c for c in run_)
            h = zlib.crc32(f"{'' if r.doc_id is None else r.doc_id}:{word}".encode())
            if h % 97 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] = counts.get(word, 0) + 1
    assert {r.word: r.n for r in spelling.word_counts(edge).collect()} == counts
    assert spelling.word_counts(none).count() == 0 and spelling.variants(spelling.word_counts(none)).count() == 0


def test_no_pair_holds_more_words_than_letters(spark):
    """Ten thousand words in which one letter varies: each left-out position is one entry of bounded size."""
    rows = [(k, f"stem{chr(224 + k % 20)}{'abcdefghij'[k // 20 % 10]}end") for k in range(200)]
    words = spark.createDataFrame(rows, "word_no long, word string")
    skips, _ = spelling.node_pairs(words)
    assert skips.groupBy("p", "s").count().agg(F.max("count")).first()[0] == 20


# Conversations


def brute_trie(rows):
    own = {}
    for conv, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", hashlib.sha256(f"{len(r[2] or '')}:{r[2] or ''}{r[3] or ''}".encode()).hexdigest())):
        own.setdefault(conv, []).append((role or "", text or ""))
    nodes, ends = {}, {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        path = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
        for d in range(len(path) + 1):
            nodes.setdefault(path[:d], []).append(c)
        ends.setdefault(path, []).append(c)
    out = []
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        children = [p for p in below if len(p) == len(path) + 1]
        leaves = [p for p in below if not any(len(q) > len(p) and q[: len(p)] == p for q in below)]
        saved = sum((len(nodes[p]) - 1) * (len(p[-1][1]) if p else 0) for p in below)
        out.append((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), len(children), len(leaves), saved,
                    hashlib.sha256(",".join(map(str, sorted(ends.get(path, [])))).encode()).hexdigest()))
    return sorted(out, key=str)


def trie_rows(df):
    return sorted((tuple(r) for r in trie.shared_opening_trie(df).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=str)


def test_trie_is_brute_force(spark):
    rng, rows = random.Random(4), []
    for c in [*range(0, 40), *range(100, 130), *range(205, 220), 305]:
        for turn in range(rng.randint(1, 11)):
            rows.append((c, turn, rng.choice(["user", "assistant"]), f"say {rng.randrange(2)}"))
    rows += [(500, None, None, None), (500, 1, "user", ""), (500, 1, "user", ""), (500, 1, "assistant", "naïve 😀"), (None, 1, "user", "lost"), (600, 0, "a", "b" * 50_000), (601, 0, "a", "b" * 50_000)]
    rows += [(700, t, "user", f"long {t}") for t in range(60)] + [(701, t, "user", f"long {t}") for t in range(60)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    assert trie_rows(df) == brute_trie(rows)
    assert trie_rows(df.withColumns({c: F.lit(1) for c in ("place", "digest", "node", "parent", "depth", "block", "w0", "position", "base", "h")})) == brute_trie(rows)
    assert trie_rows(df.where("conv_id < 0")) == []


def test_one_conversation_speaks_for_those_that_go_on_alike(spark):
    """A hundred conversations with the same 32 turns: turns are spelled out once, not a hundred times."""
    turns = spark.createDataFrame([(c, p, f"d{p}", 3) for c in range(100) for p in range(32)], "conv_id long, place long, digest string, n_chars long")
    found = trie.prefix_trie(turns, turns.select("conv_id").distinct())
    assert [tuple(r) for r in found.orderBy("depth").select("depth", "n_convs").collect()] == [(d, 100) for d in range(33)]
