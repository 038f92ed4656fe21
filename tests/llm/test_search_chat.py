"""Searches and chat formatting: against brute force, on edge rows."""

import operator
from collections import Counter
from contextlib import contextmanager

import numpy as np
import pytest
from pyspark.sql import functions as F

from martwright.llm import ann, chat, topk

VECTORS = "vec_id long, embedding array<float>, block string, position string, x string, list string"


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(v) for v in rng.normal(size=12)]) for i in range(1500)]
    rows += [(2000 + i, [0.5] * 12) for i in range(40)]
    rows += [(3000, None), (3001, [0.0] * 12), (3002, [float("nan")] + [1.0] * 11), (3003, [float("inf")] + [1.0] * 11), (3004, [None] + [1.0] * 11), (3005, [1.0, 2.0]), (3006, [])]
    return spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], VECTORS).repartition(3)


def usable_rows(vectors, zero):
    keep = [r for r in vectors.collect() if r.embedding is not None and len(r.embedding) == 12 and all(v is not None and np.isfinite(v) for v in r.embedding)]
    return sorted([(r.vec_id, np.array(r.embedding, float)) for r in keep if zero or any(r.embedding)], key=lambda r: r[0])


def test_topk_is_exact(vectors):
    rows = [(i, np.floor(1024 * v).astype(np.int64)) for i, v in usable_rows(vectors, True)]
    whole = F.transform("embedding", lambda x: F.floor(1024 * x.cast("double")).cast("long"))
    usable = vectors.where(topk.usable(F.col("embedding"))).withColumn("embedding", whole)
    expected = set()
    for i, q in rows:
        if i % 50 == 0:
            found = sorted(((-int(q @ v), j) for j, v in rows if j != i))[:10]
            expected |= {(i, n, j, -s) for n, (s, j) in enumerate(found, 1)}
    for lists in (1, 2, 5):
        got = topk.top_k(usable, F.col("vec_id") % 50 == 0, lists=lists, block_rows=200, query_rows=7).collect()
        assert {(r.query_id, r.rank, r.vec_id, r.score) for r in got} == expected and len(got) == len(expected)


def test_topk_small_and_empty(spark):
    few = spark.createDataFrame([(i, [i, -i]) for i in range(4)], "vec_id long, embedding array<long>")
    got = topk.top_k(few, F.col("vec_id") == 2).orderBy("rank").collect()
    assert [(r.rank, r.vec_id, r.score) for r in got] == [(1, 3, 12), (2, 1, 4), (3, 0, 0)]
    assert topk.top_k(few.where("false"), F.col("vec_id") == 2).count() == 0
    assert topk.top_k(few, F.lit(False)).count() == 0


def best_of(rows, asks, k=10):
    """Query, rank, id and score by brute force in Python's numbers; a repeated query's rows count together, missing ids come first among equals."""
    found = Counter()
    for query in {i for i, _ in rows if i is not None and asks(i)}:
        scores = [(-sum(map(operator.mul, v, w)), i is not None, i or 0, i) for j, v in rows if j == query for i, w in rows if i != query]
        found.update((query, n, i, -s) for n, (s, _, _, i) in enumerate(sorted(scores, key=lambda x: x[:3])[:k], 1))
    return found


@contextmanager
def settings(spark, **values):
    before = {k: spark.conf.get(f"spark.sql.{k}", None) for k in values}
    for k, v in values.items():
        spark.conf.set(f"spark.sql.{k}", v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(f"spark.sql.{k}") if v is None else spark.conf.set(f"spark.sql.{k}", v)


def test_topk_sends_no_repeated_rows_through_the_driver(spark):
    """A thousand queries are 0.3 MB and meet 40 blocks: 10 MB if they were broadcast once per block."""
    whole = np.random.default_rng(2).integers(-500, 500, size=(4000, 32))
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(whole.tolist())], "vec_id long, embedding array<long>").repartition(4)
    with settings(spark, maxBroadcastTableSize="4m", autoBroadcastJoinThreshold="10m"):
        got = topk.top_k(rows, F.col("vec_id") % 4 == 0, block_rows=100).collect()
    scores = whole[::4] @ whole.T
    scores[np.arange(1000), np.arange(1000) * 4] = -(10**12)
    best = np.argsort(-scores, axis=1, kind="stable")[:, :10]
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in got} == {(4 * q, n + 1, int(i), int(scores[q, i])) for q, b in enumerate(best) for n, i in enumerate(b)}
    assert len(got) == 10_000


@pytest.mark.parametrize("case", ["missing and repeated ids", "ties", "all magnitudes", "one id"])
def test_topk_on_odd_rows(spark, case):
    rng = np.random.default_rng(3)
    rows = [(i, v) for i, v in enumerate(rng.integers(-300, 300, size=(200, 7)).tolist())]
    if case == "missing and repeated ids":
        rows += rows[:15] + [(i % 40, v) for i, (_, v) in enumerate(rows[100:])] + [(None, [2 * x for x in v]) for _, v in rows[:30]]
    elif case == "ties":
        rows += [(1000 + i, [9] * 7) for i in range(150)] + [(20, [5] * 7), (30, [0] * 7), (40, [-5] * 7)]
    elif case == "all magnitudes":  # scores from a few digits to 18
        rows = [(i, [x * 10 ** (i % 7) for x in v]) for i, v in rows]
    else:
        rows = [(10, v) for _, v in rows]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<long>").repartition(3)
    with settings(spark, **{"execution.arrow.maxRecordsPerBatch": "9"}):
        got = topk.top_k(frame, F.col("vec_id") % 10 == 0, lists=3, block_rows=64, query_rows=5).collect()
    assert Counter(map(tuple, got)) == best_of(rows, lambda i: i % 10 == 0)


def test_ann_recall_and_exact_scores(vectors):
    rows = usable_rows(vectors, False)
    matrix = {i: v for i, v in rows}
    got = ann.nearest(vectors, F.col("vec_id") % 20 == 0).collect()
    by_query = {}
    for r in got:
        assert r.score == pytest.approx(float(matrix[r.query_id] @ matrix[r.vec_id]), abs=1e-12) and r.vec_id != r.query_id
        by_query.setdefault(r.query_id, []).append((r.rank, -r.score, r.vec_id))
    asked = [i for i, _ in rows if i % 20 == 0]
    hits = 0
    for i in asked:
        found = sorted(by_query[i])
        assert [f[0] for f in found] == list(range(1, 21)) and [f[1:] for f in found] == sorted(f[1:] for f in found)
        best = sorted(((-float(matrix[i] @ v), j) for j, v in rows if j != i))[:20]
        hits += len({f[2] for f in found} & {j for _, j in best})
    assert hits >= 0.9 * 20 * len(asked)


def test_ann_few_and_none(spark):
    few = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "vec_id long, embedding array<float>")
    assert [(r.vec_id, r.rank) for r in ann.nearest(few, F.col("vec_id") == 0).orderBy("rank").collect()] == [(1, 1), (2, 2), (3, 3), (4, 4)]
    assert ann.nearest(few.where("false"), F.lit(True)).count() == 0


def test_scan_keeps_the_nearest():
    rng = np.random.default_rng(2)
    rows, queries = rng.normal(size=(400, 33)), rng.normal(size=(5, 33))
    barred = np.zeros((5, 400), bool)
    barred[0, 3] = True
    q, c = ann.scan(queries, rows, barred, 10)
    pairs = set(zip(q.tolist(), c.tolist(), strict=True))
    assert (0, 3) not in pairs and len(pairs) < 5 * 400
    near = np.argsort(((queries[:, None] - rows[None]) ** 2).sum(axis=2), axis=1)
    hits = sum((n, j) in pairs for n in range(5) for j in [x for x in near[n] if not barred[n, x]][:10])
    assert hits >= 48


# ---- chat

MESSAGES = "conv_id long, turn long, role string, text string, row_key string, content string, root string"


def thread(spark):
    return spark.createDataFrame([(*r, "1", "2", "3") for r in [
        (1, 0, "user", "How do I sort a list?\nIt is long."),
        (1, 1, "assistant", "Use sorted.\n\nIt copies the list."),
        (1, 2, "user", "On Monday, A wrote:\n> It  copies THE list.\n\nCan it be in place?"),
        (1, 3, "user", "> How do I sort a list?\n> It is long.\nSame question here."),
        (1, 4, "assistant", "B wrote:\n> > It copies the list.\n> Can it be in place?\n\nYes, list.sort()."),
        (1, 5, "user", "> never said by anyone\nok"),
        (1, 6, "user", "> > It copies the list.\nonly the inner quote"),
        (2, 0, "user", "> Use sorted.\nanother conversation"),
        (2, 1, None, None), (None, 0, "user", "lonely"), (None, None, "user", "> lonely\nno turn"), (3, 0, "user", ""), (3, 0, "user", ""),
    ]], MESSAGES).repartition(3)


def test_quotes_link_replies(spark):
    got = chat.conversations(thread(spark)).collect()
    assert len(got) == 13
    one = {r.turn: r for r in got if r.conv_id == 1}
    assert {t: (r.parent_turn, r.root_turn, r.depth) for t, r in one.items()} == {
        0: (None, 0, 0), 1: (None, 1, 0), 2: (1, 1, 1), 3: (0, 0, 1), 4: (2, 1, 2), 5: (None, 5, 0), 6: (1, 1, 1)}
    assert [r.turn for r in sorted(one.values(), key=lambda r: r.position)] == [0, 3, 1, 2, 6, 4, 5]
    assert one[4].content == "Yes, list.sort()." and one[2].content == "Can it be in place?" and one[1].content == "Use sorted.\n\nIt copies the list."
    assert all(">" not in r.content for r in got)
    assert one[0].message == "<|user|>\nHow do I sort a list?\nIt is long.\n<|end|>\n"
    by_conversation = {}
    for r in got:
        by_conversation.setdefault(r.conv_id, []).append(r.position)
    assert all(sorted(p) == list(range(len(p))) for p in by_conversation.values())
    assert {r.parent_turn for r in got if r.conv_id != 1} == {None}


def test_partial_quotes_link_by_line(spark):
    rows = [(1, 0, "u", "first line of the text\nsecond line of the text\nthird"), (1, 1, "u", "> second line of the text\nyes")]
    got = chat.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {r.turn: r.parent_turn for r in got} == {0: None, 1: 0}


def test_long_chain_and_repeated_passage(spark):
    rows = [(1, 0, "u", "message number 0")] + [(1, i, "u", f"> message number {i - 1}\nmessage number {i}") for i in range(1, 40)]
    rows += [(2, i, "u", "> me too\nme too") for i in range(200)]
    got = chat.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert Counter(r.depth for r in got.where("conv_id = 1").collect()) == Counter(range(40))
    assert {r.parent_turn for r in got.where("conv_id = 2 AND turn > 0").collect()} == {0}


def test_chat_of_nothing(spark):
    assert chat.conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


@pytest.mark.parametrize(("text", "own", "quoted"), [
    (">a\r\n>> b\nc", "c", [(1, "a"), (2, "b")]), ("", "", []), (">", "", []), ("a > b", "a > b", []), (">\n> x\n>\n> y", "", [(1, "x"), (1, "y")])])
def test_parse(text, own, quoted):
    body, _, found = chat.parse(text)
    assert (body, found) == (own, quoted)
