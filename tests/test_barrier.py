"""The barrier as a stream against the state after all events: late, repeated and early events, resumption, expiry."""

import datetime as dt
import random

import pytest

from sievemark.operators.conversation import compacted, group_states, stream_events, whole_exchanges
from sievemark.operators.relational import read_replaced, replaced
from sievemark.streaming.barrier import barriers

KIND = "group_id string, task string, kind string, ts timestamp, event_id long"
START = dt.datetime(2024, 1, 1)


def run(spark, tmp_path, batches, **options):
    src, out = tmp_path / "in", []
    src.mkdir()
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    events = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).json(str(src))
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, KIND).coalesce(1).write.mode("append").json(str(tmp_path / f"b{i}"))
        for f in (tmp_path / f"b{i}").glob("*.json"):
            f.rename(src / f"{i:03}.json")
    query = barriers(events, **options).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c")).foreachBatch(lambda df, n: out.extend((n, *r) for r in df.collect())).trigger(availableNow=True).start()
    query.awaitTermination()
    return out


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


def test_ready_once_all_are_done(spark, tmp_path):
    batches = [
        [("g", "a", "register", at(1), 1), ("g", "b", "register", at(1), 2), ("g", "a", "complete", at(2), 3), ("h", "z", "complete", at(1), 4)],
        [("g", "a", "complete", at(3), 5), ("g", "b", "fail", at(4), 6), ("g", "b", "fail", at(4), 6)],
        [("g", "", "complete", at(4), 7), ("g", "b", "register", at(1), 2)],  # repeated, and late
        [("g", "c", "register", at(5), 8)],
        [("g", "c", "complete", at(6), 9), ("g", None, "resume", at(7), 10)],
    ]
    got = [(n, *r[1:]) for n, *r in run(spark, tmp_path, batches) if r[0] == "g" and not r[-1]]
    assert got == [(0, 2, 1, 0, False, "running", False, False), (1, 2, 2, 1, False, "failed", True, False), (2, 2, 2, 1, False, "failed", True, False), (3, 3, 2, 1, False, "running", False, False), (4, 3, 3, 1, True, "resumed", False, False)]


def test_expiry(spark, tmp_path):
    batches = [[("g", "a", "register", at(1), 1)], [("x", "a", "register", at(1200), 2)], [("x", "a", "complete", at(1201), 3)], [("x", "a", "complete", at(1202), 4)]]
    got = run(spark, tmp_path, batches, late="10 minutes", idle_ms=3_600_000)
    assert [r[1:] for r in got if r[-1]] == [("g", 1, 0, 0, False, "running", False, True)]


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_of_arrival(spark, tmp_path, seed):
    r = random.Random(seed)
    rows = [(f"g{r.randrange(4)}", r.choice(["a", "b", "c", " ", None]), r.choice(["register", "complete", "complete", "fail"] + ["resume"] * (i > 70)), at(r.randrange(50)), i) for i in range(80)]
    arrived = rows + r.sample(rows, 20)
    r.shuffle(arrived)
    last = {}
    for x in run(spark, tmp_path, [arrived[i : i + 25] for i in range(0, 100, 25)], late="10 hours"):
        last[x[1]] = x[1:-1]
    want = group_states(spark.createDataFrame(rows, KIND), ["ts", "event_id"])
    assert last == {x.group_id: tuple(x[c] for c in ("group_id", "members", "completed", "failed", "resumed", "status", "ready")) for x in want.collect()}


TALK = "conv_id long, turn long, role string, text string, call_id string"


def test_exchanges_stay_whole(spark):
    rows = [(1, 1, "user", "u", None), (1, 2, "assistant", "", "a"), (1, 3, "tool", "r1", "a"), (1, 4, "assistant", "", "b"), (1, 5, "tool", "r2", "a"), (1, 6, "tool", "r3", "b"), (1, 7, "assistant", "x", None), (1, 8, "tool", "lost", "c"), (1, 9, "assistant", "", "d"), (1, 10, "tool", "r4", "d"), (1, 11, "assistant", "", "e")]
    df = spark.createDataFrame(rows, TALK)
    assert sorted((r["first"], r["last"]) for r in whole_exchanges(df).collect()) == [(2, 6), (9, 10)]
    for keep, least in ((8, 7), (6, 7), (5, 7), (2, 11), (1, 11)):
        out = compacted(df, keep=keep).orderBy("message_index").collect()
        assert out[0].role == "system" and out[0].text.startswith("[AUTO_COMPACTED")
        assert [r.text for r in out[1:]] == [x[3] for x in rows if x[1] >= least]
        assert [r.message_index for r in out] == list(range(len(out)))


def test_summaries_merge(spark):
    mark = "[AUTO_COMPACTED_CONVERSATION_SUMMARY]\n"
    rows = [(1, 0, "system", mark + "old facts", None), (1, 1, "user", "a\n b", None), (1, 2, "assistant", None, None), (1, 3, "system", mark + " more ", None), (1, 4, "user", "c", None), (2, 0, "system", mark + "alone", None), (2, 1, "user", "x", None)]
    out = {(r.conv_id, r.message_index): r.text for r in compacted(spark.createDataFrame(rows, TALK)).collect()}
    assert out[1, 0] == mark + "Goal:\n- Earlier context was compacted with a local fallback summary.\nConfirmed constraints:\n- Preserve the recent raw messages that follow this summary.\nKey facts:\nold facts\n\nmore\nActions already taken:\n- user: a b\n- assistant: \nOpen TODOs:\n- Review the preserved recent messages for the active task state."
    assert out[1, 1] == "c" and (1, 2) not in out and out[2, 0] == mark + "alone" and out[2, 1] == "x"


def test_event_lines(spark):
    text = 'event: a\ndata: {"x": 1}\ndata: 2\nevent: b\n\ndata:\ndata: {bad\ndata: "s"\r\nevent:c\nevent: d\n: no\ndata: [1]\nevent: e'
    want = [("a", '{"x": 1}'), ("message", "2"), ("message", '"s"'), ("d", "[1]")]
    for step in (1, 7, 1000):
        chunks = [("s", i, text[i : i + step]) for i in range(0, len(text), step)] + [("t", 1, "data: 1"), ("u", 1, None)]
        got = stream_events(spark.createDataFrame(chunks, "stream string, at long, text string")).orderBy("stream", "n").collect()
        assert [(r.event, r.data) for r in got if r.stream == "s"] == want and [(r.stream, r.n, r.event, r.data) for r in got if r.stream != "s"] == [("t", 1, "message", "1")]


def test_replaced(spark, tmp_path):
    path, kind = f"file://{tmp_path}/t", "k long, turn long, v string"
    replaced(path, spark.createDataFrame([(k, t, f"{k}-{t}") for k in range(40) for t in (5, 9)], kind), spark.range(40).withColumnRenamed("id", "k"), "k", "turn")
    for _ in range(2):
        replaced(path, spark.createDataFrame([(3, 8, "new"), (3, 2, "first"), (77, 1, "not asked for")], kind), spark.createDataFrame([(3,), (4,), (5,)], "k long"), "k", "turn")
        got = {(r.k, r.message_index): r.v for r in read_replaced(spark, path, "k").collect()}
        assert got == {(k, i): f"{k}-{t}" for k in range(40) if k not in (3, 4, 5) for i, t in enumerate((5, 9))} | {(3, 0): "first", (3, 1): "new"}
    # all of a folder's keys go
    replaced(path, spark.createDataFrame([], kind), spark.range(40).withColumnRenamed("id", "k"), "k", "turn")
    assert read_replaced(spark, path, "k").count() == 0
