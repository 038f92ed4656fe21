"""The sliding minute as a stream, call by call, against brute force."""

import random
from datetime import datetime, timedelta

from martwright.streaming import calls, sliding
from tests.conftest import as_set

START = datetime(2024, 1, 1)
SCHEMA = "ts timestamp, user_id string, extra int"


def _brute(events, limit):
    out = set()
    for user, ts in set(events):
        n = sum(1 for u, t in events if u == user and timedelta(0) <= ts - t < timedelta(seconds=60))
        out.add((user, ts, sum(1 for e in events if e == (user, ts)), n, n > limit))
    return out


def _run(spark, tmp_path, pieces, **options):
    for k, piece in enumerate(pieces):
        spark.createDataFrame([(t, u, 0) for u, t in piece], SCHEMA).coalesce(1).write.mode("append").option(
            "timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(str(tmp_path / "in"))
        stream = calls.read_calls(spark, str(tmp_path / "in"), SCHEMA)
        sliding.run_sliding_minute(stream, str(tmp_path / "out"), str(tmp_path / "mark"), **options).awaitTermination()
    found = calls.newest(spark.read.parquet(str(tmp_path / "out")), ["user_id", "ts"])
    return as_set(found, "user_id", "ts", "calls", "last_minute", "over_limit")


def test_every_call_counts_its_own_last_minute(spark, tmp_path):
    draw = random.Random(7)
    events = [(u, START + timedelta(seconds=draw.randrange(0, 400), microseconds=draw.choice([0, 1, 999_999]))) for u in ["hot"] * 90 + ["a", "b", None] * 10]
    events += [("edge", START + timedelta(seconds=s)) for s in (0, 60, 119, 120)] + [events[0]] * 3
    events.sort(key=lambda e: e[1])
    # Calls up to 30 seconds out of order, over the borders of batches.
    events.sort(key=lambda e: e[1] + timedelta(seconds=draw.randrange(0, 30)))
    cuts = [events[:40], events[40:41], events[41:90], events[90:]]
    assert _run(spark, tmp_path, cuts, limit=5) == _brute(events, 5)


def test_history_is_bounded_and_late_calls_are_told(spark, tmp_path):
    first = [("u", START + timedelta(seconds=s)) for s in range(0, 600, 10)]
    too_late, new = ("u", START + timedelta(seconds=100)), ("u", START + timedelta(seconds=601))
    got = _run(spark, tmp_path, [first, [too_late, new]], limit=5)
    assert got == _brute([*first, new], 5)
    kept = [p for p in (tmp_path / "mark_history").iterdir() if p.name.startswith("batch=")]
    assert spark.read.parquet(str(kept[-1])).count() <= 13 and len(kept) <= 2
    assert as_set(spark.read.parquet(str(tmp_path / "out_late")), "user_id", "ts", "calls") == {(*too_late, 1)}


def test_a_batch_run_again_tells_the_same(spark, tmp_path):
    events = [("u", START + timedelta(seconds=s)) for s in (0, 1, 50)]
    got = _run(spark, tmp_path, [events[:2], events[2:]], limit=5)
    again = spark.createDataFrame([(t, u, 0) for u, t in events[2:]], SCHEMA)
    sliding._add(again, 1, str(tmp_path / "out"), str(tmp_path / "mark_history"), "user_id", "ts", 5, 60_000_000)
    found = calls.newest(spark.read.parquet(str(tmp_path / "out")), ["user_id", "ts"])
    assert as_set(found, "user_id", "ts", "calls", "last_minute", "over_limit") == got == _brute(events, 5)
