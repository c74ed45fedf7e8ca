"""Streams that stop and go on, and frames that come in no order."""

import random
from datetime import datetime, timedelta

import pytest

from cadenza.plans import format_queries
from cadenza.sources import satellite, views
from cadenza.streaming import frames as streaming
from cadenza.streaming import pairing

START = datetime(2025, 6, 20)


def run(stream, folder):
    q = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return q


def test_files_are_read_once_whatever_stops_the_stream(spark, sf_dir, tmp_path):
    satellite.register(spark)
    folder = str(tmp_path / "in")
    (tmp_path / "in").mkdir()
    stream = lambda: spark.readStream.format("cadenza_frames").option("path", folder).option("settle", 0).load()
    read = lambda: spark.read.schema(satellite.SCHEMA).parquet(f"{tmp_path}/out")
    parts = [lambda k: k in (5, 6, 7, 8), lambda k: k in (1, 2), lambda k: False, lambda k: k in (9, 3)]  # older frames come later, and nothing
    for n, part in enumerate(parts):
        format_queries._write(spark, sf_dir, folder, lambda k, time, bt, part=part: format_queries._hdf5(k, time, bt) if part(k) else ())
        run(stream(), tmp_path)
        assert read().count() == (4, 6, 6, 8)[n]
    assert read().select("path").distinct().count() == 8
    # A batch that was planned but not done is done again with the same files: its commit is taken away.
    commits = tmp_path / "state" / "commits"
    last = max(p.name for p in commits.iterdir() if p.name.isdigit())
    (commits / last).unlink()
    (commits / f".{last}.crc").unlink()
    run(stream(), tmp_path)
    assert read().count() == 8 and views.SIDE == 8


def feed(spark, tmp_path, batches, **how):
    """The log of batches of rows (scene, minute, bt), each a file."""
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema("scene string, ts timestamp_ntz, bt double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for rows in batches:
        df = spark.createDataFrame([(s, START + timedelta(minutes=m), float(b)) for s, m, b in rows], "scene string, ts timestamp_ntz, bt double")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run(pairing.insert_frames(stream, **how), tmp_path)
    return spark.read.schema(pairing.LOG).parquet(f"{tmp_path}/out")


def plain(rows, factor):
    """The batch result: of several frames at one time the least is blended."""
    out = []
    for scene in {r[0] for r in rows}:
        own = sorted((m, b) for s, m, b in rows if s == scene)
        out += [(scene, m * 60.0, "observed", float(b)) for m, b in own]
        least = sorted({m: min(b for n, b in own if n == m) for m, _ in own}.items())
        for (m, a), (n, b) in zip(least, least[1:]):
            out += [(scene, m * 60.0 + (n - m) * 60.0 * k / factor, "interpolated", (1 - k / factor) * a + k / factor * b) for k in range(1, factor)]
    return sorted(out)


@pytest.mark.parametrize("factor", [2, 4])
def test_shuffled_arrivals_give_the_batch_result(spark, tmp_path, factor):
    draw = random.Random(factor)
    rows = [(s, m, draw.randrange(200, 300)) for s in ("a", "b") for m in range(0, 120, 4)] + [("a", 40, 150), ("a", 40, 350), ("c", 7, 250)]
    draw.shuffle(rows)
    log = feed(spark, tmp_path, [rows[:20], rows[20:45], rows[45:]], factor=factor, late_seconds=86_400)
    got = sorted((r["scene"], (r["ts"].replace(tzinfo=None) - START).total_seconds(), r["kind"], r["bt"]) for r in pairing.settled(log).collect())
    assert [r[:3] for r in got] == [r[:3] for r in plain(rows, factor)]
    assert all(abs(a[3] - b[3]) < 1e-9 for a, b in zip(got, plain(rows, factor)))
    assert log.filter("change = -1").count() > 0


def test_late_frames_are_counted_and_idle_scenes_expire(spark, tmp_path):
    batches = [[("a", 0, 250), ("a", 60, 260), ("b", 0, 200)], [("a", 10, 270), ("a", 50, 255)], [("a", 200, 280)], [("a", 400, 290)], [("a", 401, 291), ("b", 402, 210)]]
    log = feed(spark, tmp_path, batches, late_seconds=1800, idle_seconds=3600)
    rows = [(r["scene"], r["kind"], r["bt"]) for r in log.collect()]
    assert ("a", "late", 270.0) in rows and ("a", "observed", 255.0) in rows and sum(k == "late" for _, k, _ in rows) == 1
    assert ("b", "expired", None) in rows and not any(s == "b" and k == "interpolated" for s, k, _ in rows)
    settled = [(r["kind"], r["bt"]) for r in pairing.settled(log).filter("scene = 'a' and kind = 'interpolated'").collect()]
    assert ("interpolated", 255.0) not in settled and ("interpolated", 252.5) in settled and ("interpolated", 257.5) in settled


def test_a_batch_reads_and_writes_a_scene_once():
    from pyspark.sql import Row

    class Handle:
        calls, value = [], None

        def getValueState(self, name, schema):
            return self

        def get(self):
            self.calls.append("get")
            return self.value

        def update(self, value):
            self.calls.append("update")
            self.value = value

        def registerTimer(self, millis):
            self.calls.append("timer")

    own = pairing.Inserter(2, 10**12)
    own.init(Handle())
    rows = lambda minutes: iter([Row(micros=m * 60_000_000, bt=None if m == 7 else 200.0 + m) for m in minutes])
    first = list(own.handleInputRows(("a",), rows(range(50, 0, -2)), None))
    second = list(own.handleInputRows(("a",), rows([7, 3]), None))
    assert Handle.calls == ["get", "update", "timer", "get", "update"]  # the newest frame is the same
    assert len(first) == 25 + 24 and [r["change"] for r in second].count(-1) == 2
    assert [(r["kind"], r["bt"]) for r in second if r["change"] == 1] == [("observed", 203.0), ("observed", None), ("interpolated", 202.5), ("interpolated", 203.5), ("interpolated", None), ("interpolated", None)]


def test_pairs_of_many_frames_and_frames_without_time(spark, tmp_path):
    at = lambda m: None if m is None else START + timedelta(minutes=m)
    rows = [("a", at(m), 200.0 + m) for m in (8, 0, 4, 8)] + [("a", None, 999.0)] + [("b", at(3), 250.0), ("c", None, 251.0)]
    kind = "scene string, ts timestamp_ntz, bt double"
    spark.createDataFrame(rows, kind).write.parquet(str(tmp_path / "in"))
    run(streaming.pair_frames(spark.readStream.schema(kind).parquet(str(tmp_path / "in")), 4), tmp_path)
    got = spark.read.schema("scene string, ts timestamp, kind string, t double, bt double").parquet(f"{tmp_path}/out").collect()
    own = sorted((r["scene"], r["kind"], r["t"] or 0.0, (r["ts"].replace(tzinfo=None) - START).total_seconds() / 60 if r["ts"] else -1.0, r["bt"]) for r in got)
    assert [x for x in own if x[1] != "observed"] == [("a", "interpolated", t, m + 4 * t, 200 + m + 4 * t) for t in (0.25, 0.5, 0.75) for m in (0, 4)]
    assert [x[3:] for x in own if x[:2] == ("a", "observed")] == [(-1, 999), (0, 200), (4, 204), (8, 208)]
    assert [x[3:] for x in own if x[0] in "bc"] == [(3, 250), (-1, 251)]
