import random

import pytest
from pyspark.sql import functions as F

from orrery.operators.charts import Chart
from orrery.sources import wfdb
from orrery.streaming.monitor import monitor, ordered_monitor

CHART = Chart(h=2.0, k=0.5)


def stream(spark, folder, batches, schema):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def finish(df, folder):
    query = df.writeStream.format("parquet").option("checkpointLocation", f"{folder}/ck").option("path", f"{folder}/out").trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/out").collect()


ROWS = "record_id long, at long, order long, rr_ms double, last boolean"


def figures(rows):
    return sorted((r.record_id, r.idx, r.rr_ms, r.z, r.s_pos, r.s_neg, r.ewma, r.out_cusum, r.out_ewma) for r in rows if r.idx is not None)


@pytest.mark.parametrize("triggers", [1, 4, 7])
def test_shuffled_arrival_equals_order(spark, tmp_path, triggers):
    rng = random.Random(3)
    # ties in time are settled by their number; two records with different lengths
    rows = [(k, t // 2 * 10, t, rng.gauss(800, 50), False) for k, n in ((1, 60), (2, 35)) for t in range(n)]
    came = sorted(rows, key=lambda r: r[1] + rng.random() * 40)
    cut = [came[i * len(came) // triggers : (i + 1) * len(came) // triggers] for i in range(triggers)]
    cut.append([(1, 10_000, None, None, True), (2, 10_000, None, None, True)])
    got = finish(ordered_monitor(stream(spark, tmp_path / "a", cut, ROWS), 50, 10, CHART), tmp_path / "a")
    whole = "record_id long, ts long, order long, rr_ms double"
    want = finish(monitor(stream(spark, tmp_path / "b", [[r[:4] for r in rows]], whole), 10, CHART), tmp_path / "b")
    assert figures(got) == figures(want) and len(figures(got)) == 75
    assert not any(r.late for r in got)


def test_late_rows_are_listed_and_move_nothing(spark, tmp_path):
    inside = [(1, t * 10, t, 800.0 + t % 5, False) for t in range(20)]
    late = [(1, 15, 99, 5000.0, False), (1, None, 98, 6000.0, False)]
    nothing = [(1, 185, 97, None, False), (1, 186, 96, float("nan"), False)]
    cut = [inside, late + nothing, [(1, 190, 95, None, True)], [(1, 500, 94, 7000.0, False)]]
    got = finish(ordered_monitor(stream(spark, tmp_path, cut, ROWS), 30, 5, CHART), tmp_path)
    assert sorted((r.at if r.at is not None else -1, r.rr_ms) for r in got if r.late) == [(-1, 6000.0), (15, 5000.0), (500, 7000.0)]
    assert [r.rr_ms for r in sorted((r for r in got if not r.late), key=lambda r: r.idx)] == [r[3] for r in inside[5:]]
    assert all(r.z is None and r.idx is None for r in got if r.late)


def test_waiting_rows_stay_without_an_end(spark, tmp_path):
    got = finish(ordered_monitor(stream(spark, tmp_path, [[(1, t, t, 800.0, False) for t in range(20)]], ROWS), 5, 2, CHART), tmp_path)
    assert sorted(r.at for r in got) == list(range(2, 14))


def test_broken_records_are_rows_of_their_own(spark, tmp_path):
    words = b"".join(w.to_bytes(2, "little") for w in ((1 << 10) | 100, (28 << 10) | 3, 0))
    for name in ("a", "b", "c", "d"):
        (tmp_path / f"{name}.qrs").write_bytes(words if name != "d" else b"")
    (tmp_path / "a.hea").write_text("a 2 128 1000\n")
    (tmp_path / "b.hea").write_text("b 2 fast 1000\n")
    (tmp_path / "d.hea").write_text("d 2 128 1000\n")
    wfdb.register(spark)
    got = spark.read.format("wfdb").option("records_per_task", 1).load(str(tmp_path))
    assert got.rdd.getNumPartitions() == 4
    rows = sorted(got.collect(), key=lambda r: (r.record_id, r.beat_index or 0))
    assert [(r.record_id, r.beat_index, r.sample, r.fs) for r in rows] == [("a", 0, 100, 128), ("a", 1, 103, 128), ("b", None, None, None), ("c", None, None, None)]
    assert [r.error is None for r in rows] == [True, True, False, False] and "ValueError" in rows[2].error
    good = got.where("error IS NULL").drop("error")
    # the older reader stops at the broken header, so it is held to the sound record alone
    (tmp_path / "b.hea").unlink()
    assert sorted(good.where(F.col("record_id") == "a").collect()) == sorted(wfdb.read_beats(spark, str(tmp_path)).where("record_id = 'a'").collect())


def test_folder_without_records(spark, tmp_path):
    wfdb.register(spark)
    assert spark.read.format("wfdb").load(str(tmp_path)).count() == 0
