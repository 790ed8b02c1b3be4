"""Feeds, jobs and the queue of vehicles to be read again: restarts, repeats and failures."""

from __future__ import annotations

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gatewatch.sources import feed
from gatewatch.streaming import folds, jobs, requeue, streams


def lines(camera, first, n):
    t0 = datetime(2026, 10, 22, 10)
    return [json.dumps({"frame": i, "at": str(t0 + timedelta(seconds=i)), "track": i % 3, "object_type": "vehicle", "confidence": 0.5, "x1": 1.0 * camera}) + "\n" for i in range(first, first + n)]


def taken(spark, folder, out, **options):
    """Reads what is there now, going on from where the last call ended."""
    stream = spark.readStream.format("detection_feed").option("path", str(folder)).options(**options).load()
    writer = stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/progress")
    writer.trigger(availableNow=True).start().awaitTermination()
    return sorted((r["feed"], r["frame"]) for r in spark.read.parquet(f"{out}/rows").collect())


def test_feeds_go_on_after_restarts(spark, tmp_path):
    """Nothing is lost or repeated: half lines wait for their end, broken ones go, a feed that is gone is waited for or fails the stream."""
    feed.register(spark)
    folder, out = tmp_path / "feeds", tmp_path / "out"
    folder.mkdir()
    options = {"feeds": "cam1,cam2", "tries": 2, "pause": 0.01, "bytes_per_task": 500}
    (folder / "cam1.jsonl").write_text("".join(lines(1, 0, 20)) + lines(1, 20, 1)[0][:15])
    (folder / "cam2.jsonl").write_text("")
    want = [("cam1", i) for i in range(20)]
    assert taken(spark, folder, out, **options) == want
    assert taken(spark, folder, out, **options) == want  # nothing new
    with (folder / "cam1.jsonl").open("a") as f:
        f.write(lines(1, 20, 1)[0][15:] + "no json\n[1]\n" + "".join(lines(1, 21, 9)))
    (folder / "cam2.jsonl").write_text("".join(lines(2, 0, 40)))
    want = [("cam1", i) for i in range(30)] + [("cam2", i) for i in range(40)]
    assert taken(spark, folder, out, **options) == want
    (folder / "cam2.jsonl").rename(folder / "away")
    with (folder / "cam1.jsonl").open("a") as f:
        f.write("".join(lines(1, 30, 2)))
    want = sorted([*want, ("cam1", 30), ("cam1", 31)])
    assert taken(spark, folder, out, **options) == want  # the others go on
    with pytest.raises(Exception, match="cam3"):  # where a feed stands that was never seen isn't known
        taken(spark, folder, out, **options | {"feeds": "cam1,cam3"})
    (folder / "away").rename(folder / "cam2.jsonl")
    with (folder / "cam2.jsonl").open("a") as f:
        f.write("".join(lines(2, 40, 5)))
    assert taken(spark, folder, out, **options) == want + [("cam2", i) for i in range(40, 45)]
    batch = spark.read.format("detection_feed").option("path", str(folder)).option("bytes_per_task", 333).load()
    assert sorted((r["feed"], r["frame"]) for r in batch.collect()) == want + [("cam2", i) for i in range(40, 45)]
    assert batch.select(F.min("at"), F.max("x1"), F.max("y2")).first()[:] == (datetime(2026, 10, 22, 10), 2.0, None)


def test_a_feed_that_is_gone_stands_where_it_was(tmp_path):
    path = tmp_path / "cam.jsonl"
    path.write_text("a\nb\n")
    reader = feed.FeedStreamReader(None, {"path": str(tmp_path), "feeds": "cam", "tries": 1})
    assert reader.latestOffset() == {str(path): 4}
    path.unlink()
    with pytest.raises(FileNotFoundError):
        feed.FeedStreamReader(None, {"path": str(tmp_path), "feeds": "cam", "tries": 1}).latestOffset()
    assert reader.latestOffset() == {str(path): 4}
    path.write_text("a\nb\nc")
    assert reader.latestOffset() == {str(path): 4} and [(p.start, p.end) for p in reader.pieces("x", 0, 10)] == [(0, 10)]


def test_jobs(spark, tmp_path):
    """A finished job has rows and metrics; a failed one tells why; kinds are checked before anything starts."""
    path = f"{tmp_path}/in.parquet"
    for n in range(3):
        spark.range(n * 10, n * 10 + 10).coalesce(1).write.mode("append").parquet(path)
    read = lambda p: spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(p)
    known = jobs.Jobs(spark, f"{tmp_path}/jobs")
    try:
        with pytest.raises(ValueError, match="reads parquet"):
            known.submit(f"{tmp_path}/in.exe", read)
        good = known.submit(path, read, n=F.count("*"), top=F.max("id"))
        bad = known.submit(path, lambda p: read(p).select((F.col("id") / F.raise_error(F.concat(F.lit("no "), F.col("id")))).alias("x")))
        known.wait(good)
        known.wait(bad)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        import time

        for _ in range(100):
            if known.table().filter(F.col("job") == good).count() == 3:
                break
            time.sleep(0.1)
        rows = {r["job"]: r for r in known.statuses().collect()}
        assert (rows[good]["status"], rows[good]["batches"], rows[good]["rows"], rows[good]["error"]) == ("finished", 3, 30, None)
        assert rows[bad]["status"] == "failed" and rows[bad]["error"]
        assert sorted(r["id"] for r in known.result(good).collect()) == list(range(30))
        metrics = [(r["metrics"]["job.n"], int(r["metrics"]["job.top"])) for r in known.table().filter(F.col("job") == good).orderBy("batch").collect()]
        assert [m[0] for m in metrics] == ["10"] * 3 and sorted(m[1] for m in metrics) == [9, 19, 29]
        with pytest.raises(ValueError, match="is failed"):
            known.result(bad)
    finally:
        known.close()


RESULTS = "detection_id long, seq long, text string, ocr double, cached boolean, age double"


def plain_queue(waiting, batches, most=3):
    """One vehicle after the other, one reading after the other."""
    done = []
    for batch in batches:
        left = []
        for d, camera, key, retries in waiting:
            mine = sorted((r for r in batch if r[0] == d), key=lambda r: r[1])
            good = lambda r: r[2] in ("B 1234 CD", "D 77 X")
            best = next((r for r in mine if r[4] and good(r) and r[5] <= 600), None)
            if best is None:
                for r in mine:
                    if not r[4] and (good(r) or (r[3] >= 0.45 and len((r[2] or "").replace(" ", "")) >= 2)):
                        best = r
                        if good(r) and r[3] >= 0.70:
                            break
            if best is not None:
                done.append((d, key if (key or "").strip() else f"vehicle:{camera}:det_{d}", retries, best[2].replace(" ", ""), best[3], bool(best[4])))
            elif not mine:
                left.append((d, camera, key, retries))
            elif retries + 1 < most:
                left.append((d, camera, key, retries + 1))
        waiting = left
    return sorted(waiting, key=str), sorted(done)


def test_queue_against_a_walk_and_repeated_batches(spark, tmp_path):
    r = random.Random(1)
    waiting = [(d, d % 3, r.choice([None, " ", f"k{d}"]), r.choice([0, 0, 1])) for d in range(60)]
    batches = [[(d, s, r.choice(["B 1234 CD", "D 77 X", "OO", "X", None, ""]), r.choice([0.3, 0.5, 0.8]), r.choice([False, False, False, True, None]), r.choice([10.0, 900.0])) for d in r.sample(range(60), 30) for s in range(r.randrange(1, 4))] for _ in range(4)]
    queue = requeue.Queue(spark, f"{tmp_path}/queue")
    queue.start(spark.createDataFrame(waiting, requeue.WAITING))
    read = lambda: sorted((x["detection_id"], x["event_key"], x["retries"], x["plate"], x["ocr"], x["cached"]) for x in queue.read().collect())
    left = lambda: sorted((tuple(x) for x in queue.latest().collect()), key=str)
    for n, batch in enumerate(batches):
        df = spark.createDataFrame(batch, RESULTS)
        queue.apply(df, n)
        want = plain_queue(waiting, batches[: n + 1])
        assert (left(), read()) == want
        queue.apply(df, n)  # the batch comes again, as after a failure
        assert (left(), read()) == want
    assert want[0] and len(want[1]) > 20


def test_queue_as_a_stream(spark, tmp_path):
    """The sink takes micro-batches from a stream; a restart goes on with the next one."""
    queue = requeue.Queue(spark, f"{tmp_path}/queue")
    queue.start(spark.createDataFrame([(1, 1, None, 0), (2, 1, "k", 0), (3, 1, "k3", 2)], requeue.WAITING))
    batches = [[(1, 0, "X", 0.9, False, 0.0), (3, 0, None, 0.9, False, 0.0)], [(1, 0, "B 1234 CD", 0.5, None, 0.0)], [(2, 0, "D 77 X", 0.9, False, 0.0)]]
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, RESULTS).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
        stream = spark.readStream.schema(RESULTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        requeue.run(stream, queue, streams.each_batch)
    assert queue.latest().count() == 0  # the third was tried three times
    assert sorted((x["detection_id"], x["event_key"], x["retries"], x["plate"]) for x in queue.read().collect()) == [(1, "vehicle:1:det_1", 1, "B1234CD"), (2, "k", 0, "D77X")]


def test_no_results(spark, tmp_path):
    queue = requeue.Queue(spark, f"{tmp_path}/queue")
    queue.start(spark.createDataFrame([(1, 1, None, None)], requeue.WAITING))
    queue.apply(spark.createDataFrame([], RESULTS), 0)
    assert queue.latest().count() == 1 and queue.read().count() == 0
    assert folds.shared_folder(spark)


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from gatewatch.plans import lineage

    def session(master, folder):
        sc = SimpleNamespace(master=master, getConf=lambda: {"spark.checkpoint.dir": folder}, getCheckpointDir=lambda: None, setCheckpointDir=lambda _: None)
        return SimpleNamespace(sparkContext=sc)

    assert lineage.shared_folder(session("yarn", "hdfs:///shared")) == "hdfs:///shared"
    assert lineage.shared_folder(session("local[4]", None)).startswith("file:///")
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="shares"):
            lineage.shared_folder(session(master, None))
