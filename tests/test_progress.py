import random

import pytest

from epochlake.operators.progress import EpochProgress, watermark


def test_one_channel():
    p, seen = EpochProgress(), []
    for step in (1, 2, "begin", 3, 4, "end", 5):
        getattr(p, step)("c") if isinstance(step, str) else p.switch(step)
        seen.append(p.informed)
    assert seen == [0, 1, 1, 1, 1, 3, 4]


def test_two_channels():
    p, seen = EpochProgress(), []
    for step in (1, 2, "begin 1", 3, 4, "begin 2", 5, 6, "end 1", 7, 8, "end 2", 9, 10):
        if isinstance(step, int):
            p.switch(step)
        else:
            action, channel = step.split()
            getattr(p, action)(channel)
        seen.append(p.informed)
    assert seen == [0, 1, 1, 1, 1, 1, 1, 1, 3, 3, 3, 7, 8, 9]


def test_recorded_needs_a_finished_session():
    p, informed, recorded = EpochProgress(), [], []
    for step in ("switch", "switch", "switch", "begin", "end", "switch", "switch"):
        p.switch(p.switched + 1) if step == "switch" else getattr(p, step)("c")
        informed.append(p.informed)
        recorded.append(p.recorded)
    assert informed == [0, 1, 2, 2, 2, 3, 4] and recorded == [0, 0, 0, 0, 0, 3, 3]


def test_refusals_and_callbacks():
    durable, recorded = [], []
    p = EpochProgress(durable.append, recorded.append)
    assert p.switch(2) and not p.switch(2) and not p.switch(1)
    p.begin("a")
    with pytest.raises(ValueError):
        p.begin("a")
    p.switch(5)
    p.abort("a")
    assert (durable, recorded) == ([1, 4], [])


def test_random_runs_keep_the_promises(spark):
    rng = random.Random(3)
    p, epoch, low = EpochProgress(), 0, 0
    for _ in range(300):
        channel = f"c{rng.randrange(5)}"
        if rng.random() < 0.4:
            epoch += rng.randrange(1, 3)
            p.switch(epoch)
        elif channel in p.working:
            p.end(channel)
        else:
            p.begin(channel)
        assert low <= p.informed < max(1, p.switched) and p.recorded <= p.informed
        assert all(e > p.informed for c, e in p.working.items() if e > p.finished.get(c, 0))
        low = p.informed
    rows = [(c, p.working.get(c, p.finished.get(c)), p.finished.get(c)) for c in {*p.working, *p.finished}]
    got = watermark(spark.createDataFrame(rows, "channel string, working long, finished long"), p.switched).first()
    assert got.informed <= p.informed and got.recorded <= got.informed


def test_no_channels(spark):
    empty = spark.createDataFrame([], "channel string, working long, finished long")
    assert tuple(watermark(empty, 4).first()) == (3, 0) and tuple(watermark(empty, 0).first()) == (0, 0)
