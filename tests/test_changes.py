"""Runs over a feed: brute force, and runs that die at every point on the way."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from hyphae.operators.changes import ChangeLog, changed_per_run, deliveries
from hyphae.session import prepare


def test_p3_changed_per_run(spark):
    rng, t0 = random.Random(5), datetime(2025, 1, 1)
    at = lambda: t0 + timedelta(minutes=rng.randrange(200))
    runs = [(k, t0 + timedelta(minutes=17 * k), rng.choice(["ok", "ok", "failed"])) for k in range(12)]
    rng.shuffle(runs)
    feed = [(f"d{rng.randrange(30)}", rng.choice([None, at()]), rng.choice([at(), at(), None]), rng.choice([at(), t0 + timedelta(minutes=17 * rng.randrange(12))])) for _ in range(300)]
    want, seen = set(), {}
    for start, no in sorted((s, n) for n, s, status in runs if status == "ok"):
        state = {}
        for i, updated, created, landed in feed:
            if landed <= start:
                state[i] = max(state.get(i, datetime.min), updated or created or datetime.min)
        want |= {(no, i) for i, s in state.items() if i not in seen or s > seen[i]}
        seen = state
    f = prepare(spark).createDataFrame(feed, "id string, updated_at timestamp, created_at timestamp, landed_at timestamp")
    r = spark.createDataFrame(runs, "run_no int, started_at timestamp, status string")
    got = changed_per_run(f, r).collect()
    assert len(got) == len(want) and {tuple(x) for x in got} == want
    assert changed_per_run(f, r.where("status = 'none'")).count() == 0 and changed_per_run(f.limit(0), r).count() == 0


class Death(Exception):
    pass


@pytest.mark.parametrize("at", range(1, 7))
def test_a_run_that_dies_is_made_again(spark, tmp_path, at):
    t0 = datetime(2025, 1, 1)
    feed = [(f"d{k % 7}", t0 + timedelta(hours=k), None, t0 + timedelta(hours=k)) for k in range(30)]
    seen = deliveries(prepare(spark).createDataFrame(feed, "id string, updated_at timestamp, created_at timestamp, landed_at timestamp"))
    upto = lambda h: seen.where(F.col("landed") <= int((t0 + timedelta(hours=h)).timestamp() * 1e6))
    log = ChangeLog(spark, f"file://{tmp_path}/log")
    log.run(1, upto(4))
    calls = [0]

    class Dying(ChangeLog):
        def _count(self):
            calls[0] += 1
            if calls[0] == at:
                raise Death

        def _overwrite(self, *args):
            self._count()
            super()._overwrite(*args)

        def _write_mark(self, *args):
            self._count()
            super()._write_mark(*args)

    try:
        Dying(spark, f"file://{tmp_path}/log").run(2, upto(5))
    except Death:
        pass
    assert at > 4 or calls[0] == at
    log.run(2, upto(5))
    assert log.run(2, upto(5)) == []
    moved = log.run(3, upto(5))
    assert moved == []
    log.run(4, upto(6))
    got = sorted(tuple(r) for r in log.changes().collect())
    assert got == sorted([(1, f"d{k}") for k in range(5)] + [(2, "d5"), (4, "d6")])
