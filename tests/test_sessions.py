"""Conversation memory by event time: shuffled micro-batches, late turns, silence."""

import datetime
import random

import pytest

from corpusmill.streaming import screen, sessions

SCHEMA = "conv_id bigint, turn bigint, question string, answer string, said_at timestamp"
START = datetime.datetime(2024, 1, 1)


@pytest.fixture
def store(spark):
    conf = {"spark.sql.streaming.stateStore.providerClass": sessions.STATE_STORE}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def exchange(conv, turn, minute=None):
    return conv, turn, f"q{turn}", f"a{turn}", START + datetime.timedelta(minutes=turn if minute is None else minute)


def run(spark, folder, batches, **options):
    """Each batch is one file of a stream and one micro-batch of its own; transcripts by (conversation, turn)."""
    source, out, progress = str(folder / "in"), str(folder / "out"), str(folder / "progress")
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").json(source)
        stream = spark.readStream.schema(SCHEMA).json(source)
        screen.write_batches(sessions.ordered_sessions(stream, "said_at", **options), out, progress).awaitTermination()
    read = spark.read.schema(sessions.OUT).option("recursiveFileLookup", "true").parquet(out)
    got = {(r.conv_id, r.turn): r.transcript for r in read.collect()}
    assert read.count() == len(got)
    return got


def said(turns):
    return "\n".join(f"User: q{n}\nAssistant: a{n}" for n in turns)


def test_shuffled_batches_give_the_ordered_result(spark, store, tmp_path):
    rng = random.Random(2)
    turns = [(c, n) for n in range(24) for c in (1, 2, 3)]
    # Every turn comes up to nine minutes late, which the delay allows for.
    arrivals = sorted(turns, key=lambda x: x[1] + rng.uniform(0, 9))
    batches = [[exchange(c, n) for c, n in arrivals[i:i + 18]] for i in range(0, len(arrivals), 18)] + [[exchange(9, 5000)]]
    got = run(spark, tmp_path, batches, delay="10 minutes", ttl="1 day", turns=3)
    assert {x: t for x, t in got.items() if x[0] != 9} == {(c, n): said(range(max(0, n - 3), n)) for c, n in turns}


def test_what_is_too_late_is_left_out(spark, store, tmp_path):
    batches = [[exchange(1, n) for n in (0, 1, 2)], [exchange(1, 60)], [exchange(1, 3), exchange(1, 61)], [exchange(9, 9000)]]
    got = run(spark, tmp_path, batches, delay="10 minutes", ttl="1 day", turns=3)
    assert got[1, 60] == said([0, 1, 2]) and got[1, 61] == said([1, 2, 60]) and (1, 3) not in got


def test_silent_conversations_leave_no_state(spark, store, tmp_path):
    batches = [[exchange(1, n) for n in range(4)] + [exchange(2, 0)], [exchange(2, n) for n in range(1, 100)], [exchange(1, 100), exchange(2, 100)], [exchange(9, 300)]]
    got = run(spark, tmp_path, batches[:2], delay="1 minute", ttl="60 minutes", turns=3)
    assert got[1, 3] == said([0, 1, 2])

    def remembered(name):
        state = spark.read.format("statestore").option("path", str(tmp_path / "progress")).option("stateVarName", name).load()
        return {r.key.conv_id for r in state.collect()}

    assert 1 not in remembered("memory") and 2 in remembered("memory") and 1 not in remembered("last")
    got = run(spark, tmp_path, batches[2:], delay="1 minute", ttl="60 minutes", turns=3)
    assert got[1, 100] == "" and got[2, 100] == said([97, 98, 99])
    assert remembered("memory") <= {9} and remembered("waiting") <= {9}


def test_personal_data_and_rows_without_a_time_stay_out(spark, store, tmp_path):
    rows = [exchange(1, 0), (1, 1, "call me on 9876543210", "no", START + datetime.timedelta(minutes=1)), (1, 2, "q2", "a2", None), exchange(1, 3), (None, 1, "q", "a", START)]
    got = run(spark, tmp_path, [rows, [exchange(9, 500)]], turns=3)
    assert {x: t for x, t in got.items() if x[0] == 1} == {(1, 0): "", (1, 3): said([0])}
