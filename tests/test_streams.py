"""Streams with timers in any batching, and the queue across restarts."""

import json
import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inkveil.plans import streams as P
from inkveil.streaming import queue as Q
from inkveil.streaming import timers as T
from inkveil.streaming.streams import run_to_end
from tests.compare import check

EVENTS = "key long, ts timestamp, ord long, kind string"


@pytest.mark.parametrize("name", ["stream_leases", "stream_retention", "stream_queue"])
def test_same_as_sql(spark, data, name):
    check(spark, data, P.QUERIES[name], P.ORACLE_SQL[name])


def said(machine, *events, until=None):
    s, out = None, []
    for at, kind in events:
        s, due = T.run_due(machine, s, at * 1000)
        s, more = machine.on(s, kind, at * 1000)
        out += due + more
    s, due = T.run_due(machine, s, until * 1000) if until else (s, [])
    return [(at // 1000, what, n) for at, what, n in out + due]


def test_leases():
    """Renewal keeps a lease, release shortens it, the receipt after the third is the last, a day ends all."""
    lease = T.Lease()
    assert said(lease, (0, "send"), (10, "receive"), (20, "receive"), until=1811) == [(0, "sent", 0), (10, "claimed", 1), (20, "held", 1), (1810, "returned", 1)]
    assert said(lease, (0, "send"), (10, "receive"), (1800, "renew"), (3599, "receive"), (3600, "receive"))[2:] == [(3599, "held", 1), (3600, "returned", 1), (3600, "claimed", 2)]
    assert said(lease, (0, "send"), (10, "receive"), (20, "release"), until=60)[2:] == [(20, "released", 1), (50, "returned", 1)]
    assert said(lease, (0, "send"), (10, "receive"), (20, "acknowledge"), (30, "receive"), (30, "acknowledge")) == [(0, "sent", 0), (10, "claimed", 1), (20, "done", 1)]
    many = said(lease, (0, "send"), *[(2000 * k, "receive") for k in range(1, 6)])
    assert [x[1:] for x in many if x[1] in ("claimed", "dead_letter")] == [("claimed", 1), ("claimed", 2), ("claimed", 3), ("dead_letter", 3)]
    assert said(lease, (0, "send"), (86399, "receive"), (86401, "receive"))[2:] == [(86400, "gone", 1)] and said(lease, (5, "renew"), (6, "receive")) == []


def test_retention():
    """An hour less five minutes, then a tombstone until the blobs are gone; deletion by the client comes first."""
    keep = T.Retention()
    assert said(keep, (0, "create"), (10, "cleaned"), until=3299) == []
    assert said(keep, (0, "create"), (4000, "cleaned")) == [(3300, "deleted", 0), (3600, "sweep", 1), (3900, "sweep", 2), (4000, "expired", 2)]
    assert said(keep, (0, "create"), (5, "delete"), (6, "delete"), (7, "cleaned"), (8, "create"), until=100) == [(5, "deleted", 0), (7, "expired", 0)]


@pytest.mark.parametrize("cuts", [1, 4])
def test_any_batching_gives_the_same(spark, tmp_path, cuts):
    rng, t, rows = random.Random(3), 1_700_000_000_000, []
    for k in range(300):
        t += rng.randint(1, 500_000)
        rows.append((rng.randrange(15), t, k, rng.choice(P.MESSAGE_KINDS)))
    state, want = {}, []
    for key, at, _, kind in rows:
        s, due = T.run_due(T.Lease(), state.get(key), at)
        state[key], more = T.Lease().on(s, kind, at)
        want += [(key, *x) for x in due + more]
    want += [(key, *x) for key, s in state.items() for x in T.run_due(T.Lease(), s, t - 1)[1]]
    for part in range(cuts):
        own = spark.createDataFrame(rows[part * len(rows) // cuts : (part + 1) * len(rows) // cuts], "key long, ms long, ord long, kind string")
        own.select("key", F.timestamp_millis("ms").alias("ts"), "ord", "kind").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(1.1)
    events = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    with T.rocksdb(spark):
        got = run_to_end(T.timed_stream(events, T.Lease()), "append").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def bodies(spark, *jobs):
    return spark.createDataFrame([(json.dumps({"schema_version": 1, "job_id": j, "task": "detect"}) if j else "odd\nbody",) for j in jobs], "body string")


def test_queue_loses_and_repeats_nothing(spark, tmp_path):
    """A batch that fails is given again, whole, after a restart; what was acknowledged is gone and does not come back."""
    path, seen, down = str(tmp_path / "queue"), [], {"fail": True}

    def take(batch, number):
        rows = batch.collect()
        if down["fail"]:
            raise RuntimeError("crash in mid-stream")
        seen.extend(((r.job_id or r.error_code), number) for r in rows)

    def run():
        query = Q.message_stream(spark, path).writeStream.foreachBatch(take).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        query.awaitTermination()

    Q.enqueue(bodies(spark, "a", "b", None), path)
    with pytest.raises(Exception, match="crash in mid-stream"):
        run()
    assert seen == [] and len(list((tmp_path / "queue" / "new").iterdir())) > 0
    Q.enqueue(bodies(spark, "c"), path)
    down["fail"] = False
    run()
    run()
    assert sorted(x for x, _ in seen) == ["a", "b", "c", "message_malformed"]
    Q.enqueue(bodies(spark, "d", "e"), path)
    run()
    assert sorted(x for x, _ in seen) == ["a", "b", "c", "d", "e", "message_malformed"]
    Q.enqueue(bodies(spark, "f"), path)
    run()
    left = {p.name for p in (tmp_path / "queue" / "new").iterdir()}
    given = {n for p in (tmp_path / "queue" / "batches").iterdir() for n in json.loads(p.read_text())}
    assert len(seen) == 7 and left <= given


def test_queue_folder_by_itself(tmp_path):
    """Lists are written down before they are handed out; a new reader gives the same; a commit deletes."""
    queue = Q.FolderQueue(str(tmp_path))
    reader = Q.QueueReader(str(tmp_path))
    assert reader.latestOffset() == {"batch": 0} and reader.partitions({"batch": 0}, {"batch": 0}) == []
    for name in ("m-2", "m-1"):
        queue.put(queue.new, name, f"body {name}\nmore\n".encode())
    assert reader.latestOffset() == {"batch": 1}
    queue.put(queue.new, "m-0", b"late\n")
    again = Q.QueueReader(str(tmp_path))
    (part,) = again.partitions({"batch": 0}, {"batch": 1})
    assert part.names == ["m-1", "m-2"] and [b.num_rows for b in again.read(part)] == [2, 2]
    assert again.latestOffset() == {"batch": 2} and again.latestOffset() == {"batch": 2}
    again.commit({"batch": 1})
    assert queue.names(queue.new) == ["m-0"] and [p.names for p in again.partitions({"batch": 1}, {"batch": 2})] == [["m-0"]]
    again.commit({"batch": 2})
    assert queue.names(queue.new) == [] and Q.QueueReader(str(tmp_path)).latestOffset() == {"batch": 2}


def test_queue_moves_in_small_pieces(spark, tmp_path, monkeypatch):
    """A task's messages go to many files, a file is read in blocks, and no batch of rows holds a whole file."""
    monkeypatch.setattr(Q, "FILE_BYTES", 1000)
    monkeypatch.setattr(Q, "TASK_BYTES", 2500)
    monkeypatch.setattr(Q, "BLOCK_BYTES", 7)
    sent = [f"é{k} " + "x" * (k % 5) for k in range(400)] + ["", None, "a\nb\rc", "y" * 5000]
    rows = [pa.RecordBatch.from_arrays([pa.array(sent[k : k + 20], pa.string())], names=["body"]) for k in range(0, len(sent), 20)]
    queue = Q.QueueWriter(str(tmp_path))
    told = queue.write(iter(rows))
    queue.commit([told, None, queue.write(iter([]))])
    assert len(told.names) > 3 and sum(1 for x in (tmp_path / "new").iterdir()) == len(told.names)
    reader = Q.QueueReader(str(tmp_path))
    parts = reader.partitions(reader.initialOffset(), reader.latestOffset())
    assert len(parts) > 2 and sorted(n for p in parts for n in p.names) == sorted(told.names)
    got = [(r["file"], r["line"], r["body"]) for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert sorted(x[2] for x in got) == sorted((b or "").replace("\n", " ").replace("\r", " ") for b in sent)
    for name in told.names:
        assert [x[1] for x in got if x[0] == name] == list(range(sum(x[0] == name for x in got)))
    assert max(b.num_rows for p in parts for b in reader.read(p)) < 20
