"""The topic: batches, streams, starts, and each event once whatever is repeated."""

from __future__ import annotations

import json
import os
import threading

import pytest

from tallyhire.operators.notify import outbox, parse_mails, rejects
from tallyhire.sources import topic
from tallyhire.streaming import jobs as streams


def events(spark, *values):
    return spark.createDataFrame([(v, 1) for v in values], "value string, other int")


def values_of(spark, path):
    return [r["value"] for r in topic.read_topic(spark, path).orderBy("topic_offset").collect()]


def run(query):
    query.awaitTermination(120)
    assert query.exception() is None


def test_batches_append_whole(spark, tmp_path):
    path = str(tmp_path / "topic")
    assert values_of(spark, path) == []
    topic.publish(events(spark, "a", None, "c"), path)
    topic.publish(events(spark, "d").repartition(3), path)
    found = topic.read_topic(spark, path).orderBy("topic_offset").collect()
    assert [r["topic_offset"] for r in found] == [0, 1, 2, 3] and {r["value"] for r in found[:3]} == {"a", None, "c"} and found[3]["value"] == "d"
    with pytest.raises(Exception, match="assert_true|failed"):
        topic.publish(events(spark, "x", "bad").selectExpr("CASE WHEN value = 'bad' THEN raise_error('failed') ELSE value END AS value"), path)
    assert len(values_of(spark, path)) == 4


def test_entries_are_found_without_a_listing(tmp_path):
    log = topic.Log(str(tmp_path / "t"))
    for k in range(40):
        assert log.end() == k
        log.append([topic.Segment(f"s{k}", k)])
    assert [log.entry(k)["first"] for k in (0, 1, 2, 39)] == [0, 0, 1, 741]


def test_writers_at_once_lose_nothing(tmp_path):
    path = str(tmp_path / "t")
    work = lambda w: [topic.Log(path).append([topic.Segment(f"{w}-{k}", 1)], w, k) for k in range(15)]
    threads = [threading.Thread(target=work, args=(f"w{n}",)) for n in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    log = topic.Log(path)
    assert log.end() == 60 and log.entry(59)["batches"] == {f"w{n}": 14 for n in range(4)}
    assert {name for k in range(60) for name, _ in log.entry(k)["files"]} == {f"w{n}-{k}" for n in range(4) for k in range(15)}
    assert not log.append([topic.Segment("again", 1)], "w1", 14) and log.end() == 60


def test_starts(spark, tmp_path):
    path, out = str(tmp_path / "topic"), str(tmp_path / "out")
    topic.publish(events(spark, "old"), path)
    start = lambda starting: topic.subscribe(spark, path, starting).select("value").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / f"c_{starting}")).trigger(availableNow=True).start(f"{out}_{starting}")
    run(start("latest"))
    run(start("earliest"))
    topic.publish(events(spark, "new"), path)
    run(start("latest"))
    run(start("earliest"))
    assert [r[0] for r in spark.read.schema("value string").parquet(f"{out}_latest").collect()] == ["new"]
    assert sorted(r[0] for r in spark.read.parquet(f"{out}_earliest").collect()) == ["new", "old"]
    with pytest.raises(Exception, match="startingOffsets"):
        run(topic.subscribe(spark, path, "middle").writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c_middle")).trigger(availableNow=True).start())


def test_repeated_batch_is_written_once(spark, tmp_path):
    """A writer that is killed after its commit to the log, but before its checkpoint says so, repeats the batch."""
    source, path, check = str(tmp_path / "in"), str(tmp_path / "topic"), str(tmp_path / "check")
    stream = lambda: topic.publish_stream(spark.readStream.schema("value string, other int").parquet(source), path, "mails", check).trigger(availableNow=True).start()
    events(spark, "a", "b").write.parquet(source)
    run(stream())
    events(spark, "c").write.mode("append").parquet(source)
    run(stream())
    last = max(int(n) for n in os.listdir(f"{check}/commits") if n.isdigit())
    for name in (str(last), f".{last}.crc"):
        os.remove(f"{check}/commits/{name}") if os.path.exists(f"{check}/commits/{name}") else None
    events(spark, "d").write.mode("append").parquet(source)
    run(stream())
    assert sorted(values_of(spark, path)) == ["a", "b", "c", "d"]


def test_killed_reader_reads_the_same_again(spark, tmp_path):
    path, check = str(tmp_path / "topic"), str(tmp_path / "check")
    topic.publish(events(spark, *"abcdef").repartition(3), path)
    seen = []

    def once(batch, number):
        seen.append((number, sorted((r["topic_offset"], r["value"]) for r in batch.collect())))
        if len(seen) == 1:
            raise RuntimeError("killed")

    start = lambda: topic.subscribe(spark, path, "earliest").writeStream.foreachBatch(once).option("checkpointLocation", check).trigger(availableNow=True).start()
    with pytest.raises(Exception, match="killed"):
        start().awaitTermination(120)
    topic.publish(events(spark, "g"), path)
    run(start())
    run(start())  # one that begins with a repeated batch may end with it
    assert seen[0] == seen[1] and len(seen[0][1]) == 6
    assert sorted(row for _, rows in seen[1:] for row in rows)[6:] == [(6, "g")]


def test_mails_through_the_topic(spark, tmp_path):
    """What is published, good or not, comes out delivered or rejected as in one batch."""
    path, out = str(tmp_path / "topic"), str(tmp_path / "out")
    values = [json.dumps({"to": f"u{k}@x", "subject": "s", "html": "h"}) for k in range(20)] + ["{bad", "[]", None, json.dumps({"to": ""})]
    topic.publish(events(spark, *values[:12]), path)
    deliver = lambda: streams.deliver(topic.subscribe(spark, path, "earliest"), out, str(tmp_path / "c")).trigger(availableNow=True).start()
    run(deliver())
    topic.publish(events(spark, *values[12:]), path)
    run(deliver())
    parsed = parse_mails(events(spark, *values))
    assert sorted(r["to"] for r in spark.read.parquet(f"{out}/outbox").collect()) == sorted(r["to"] for r in outbox(parsed).collect())
    assert sorted(map(str, (r["reason"] for r in spark.read.parquet(f"{out}/mail_rejects").collect()))) == sorted(r["reason"] for r in rejects(parsed).collect())
