"""Keyed state over several batches: stopped and resumed, late and repeated messages, timers that end a state."""

from __future__ import annotations

import random
import tempfile
from collections import OrderedDict

import pytest
from pyspark.sql import functions as F

from tessella.streaming import messages

SHAPE = "user long, id long, at long, action string, reply string"
MOVES = {("AWAITING_ACCEPT", "go"): "IN_PROGRESS", ("IN_PROGRESS", "stop"): "COMPLETED", ("SILENT", "go"): "IN_PROGRESS"}
GAP, TTL = 100, 300


@pytest.fixture
def source(spark):
    """(folder, stream over it, add): a batch is a file of rows, in seconds."""
    at = tempfile.mkdtemp(prefix="spark-")
    spark.createDataFrame([], SHAPE).coalesce(1).write.mode("append").parquet(at)
    stream = spark.readStream.schema(SHAPE).option("maxFilesPerTrigger", 1).parquet(at).withColumn("ts", F.timestamp_seconds("at"))
    return stream, lambda rows: spark.createDataFrame(rows, SHAPE).coalesce(1).write.mode("append").parquet(at)


def plain_runs(rows: list[tuple], until: int) -> list[tuple]:
    """Statuses and silences of each user's messages in order, with silences that end before ``until``."""
    out, state = [], {}

    def pass_time(user, now):
        status, last = state.get(user, ("AWAITING_ACCEPT", None))
        if last is not None and status not in ("SILENT", "COMPLETED") and now - last > GAP:
            out.append((user, None, last + GAP, "SILENT"))
            status, last = "SILENT", last + GAP
        if last is not None and status in ("SILENT", "COMPLETED") and now - last > TTL:
            status, last = "AWAITING_ACCEPT", None
        state[user] = status, last

    for user, i, at, action, _ in sorted(rows, key=lambda r: r[2]):
        pass_time(user, at)
        status, last = state[user]
        status = MOVES.get((status, action), status)
        state[user] = status, at
        out.append((user, i, at, status))
    for user in list(state):
        pass_time(user, until)
    return sorted(out, key=str)


def test_runs_over_batches_and_a_restart(spark, source):
    stream, add = source
    rng = random.Random(9)
    rows, now = [], 1000
    batches = []
    for b in range(4):
        batch = []
        for _ in range(25):
            now += rng.choice([1, 20, 90, 400 if b % 2 else 30])
            batch.append((rng.randrange(4), len(rows) + len(batch), now, rng.choice(["go", "stop", "other"]), "r"))
        rows += batch
        batches.append(batch)
    states = messages.run_states(stream, "user", "id", "ts", "action", MOVES, GAP, TTL, "0 seconds")
    at = tempfile.mkdtemp(prefix="spark-")
    for batch in batches:
        add(batch)
        assert messages.drained(states, "runs", at).count() > 0
    add([(9, 999, now + 5000, "go", "r")])
    got = sorted([(r.user, r.id, r.at // 1_000_000, r.status) for r in messages.drained(states, "runs", at).collect()], key=str)
    assert got == plain_runs([*rows, (9, 999, now + 5000, "go", "r")], now + 5000)
    assert any(r[3] == "SILENT" for r in got) and any(r[3] == "COMPLETED" for r in got)


def test_state_is_gone_after_its_time(spark, source):
    stream, add = source
    states = messages.run_states(stream, "user", "id", "ts", "action", MOVES, GAP, TTL, "0 seconds")
    at = tempfile.mkdtemp(prefix="spark-")
    add([(k, k, 1000 + k, "go", "r") for k in range(20)])
    add([(100, 100, 5000, "go", "r")])
    messages.drained(states, "runs", at)
    left = spark.read.format("statestore").option("stateVarName", "run").load(f"{at}/state").count()
    assert left in (1, 21)  # 21 where the last batch's timers wait for the next one
    add([(100, 101, 5050, "go", "r")])
    messages.drained(states, "runs", at)
    assert spark.read.format("statestore").option("stateVarName", "run").load(f"{at}/state").count() == 1


def test_replies_are_remembered_over_batches(spark, source):
    stream, add = source
    rng = random.Random(2)
    batches = [[(rng.randrange(2), rng.randrange(6), 1000 * b + k, "", f"reply {b} {k}") for k in range(30)] for b in range(3)]
    replies, at = messages.remembered(stream, "user", "id", "ts", "reply", 4), tempfile.mkdtemp(prefix="spark-")
    for batch in batches:
        add(batch)
        found = messages.drained(replies, "seen", at)
    want, seen = [], {}
    for user, i, _, _, reply in (r for b in batches for r in b):
        known = seen.setdefault(user, OrderedDict())
        again = i in known
        if not again:
            known[i] = reply
            if len(known) > 4:
                known.popitem(last=False)
        want.append((user, i, again, known[i] if again else reply))
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert {w[2] for w in want} == {True, False}


@pytest.mark.parametrize("delay", ["0 seconds", "1000 seconds"])
def test_blocks_end(spark, source, delay):
    stream, add = source
    tries = [(1, k, 1000 + 10 * k, "bad", "") for k in range(8)] + [(1, 8, 1101, "good", ""), (1, 9, 1102, "bad", "")]
    others = [(2, 20, 1005, "bad", ""), (2, 21, 1006, "good", "")]
    outcomes = messages.blocked(stream.withColumn("failed", F.col("action") == "bad"), "user", "id", "ts", "failed", 5, 60, delay)
    at = tempfile.mkdtemp(prefix="spark-")
    for batch in (tries[:3] + others, tries[3:7], tries[7:]):
        add(batch)
        found = messages.drained(outcomes, "blocks", at)
    got = {r.id: r.outcome for r in found.collect()}
    assert got == {0: "failed", 1: "failed", 2: "failed", 3: "failed", 4: "failed", 5: "blocked", 6: "blocked", 7: "blocked", 8: "passed", 9: "failed", 20: "failed", 21: "passed"}


def test_sessions(spark, source):
    stream, add = source
    add([(1, 1, 0, "", ""), (1, 2, 600, "", ""), (1, 3, 5000, "", ""), (2, 4, 100, "", "")])
    add([(3, 5, 90_000, "", "")])  # ends all sessions before it
    got = sorted((r.user, r.start.timestamp(), r.messages) for r in messages.drained(messages.sessions(stream, "user", "ts"), "sessions").collect())
    assert got == [(1, 0, 2), (1, 5000, 1), (2, 100, 1)]
