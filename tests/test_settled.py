import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumentrace.operators import tracking as tk
from lumentrace.streaming import settled

SCHEMA = "run string, channel double, scan int, rt double, mz double, intensity double, im double, t int"


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, settled.STORE)
    yield spark
    spark.conf.set(key, before)


def scans(channel, numbers, seed):
    """Drifting traces and noise; scan s is at second 10 s."""
    rng = np.random.default_rng(seed)
    rows = []
    for s in numbers:
        for base in (400.0, 400.004, 500.0, 650.0):
            if rng.random() < 0.8:
                rows.append(("r", channel, s, s / 60, base * (1 + rng.normal(0, 2e-6)), float(rng.uniform(1, 100)), 0.0, 10 * s))
        rows.append(("r", channel, s, s / 60, float(rng.uniform(300, 900)), 5.0, 0.0, 10 * s))
    return rows


def written(spark, folder, rows):
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("time", F.timestamp_seconds(F.col("t") + 1000)).drop("t")
    frame.coalesce(1).write.mode("append").parquet(folder)
    return frame.schema


def run(spark, tmp_path, parts, **settings):
    """One start of the query a part, from the same checkpoint."""
    got = []
    folder = str(tmp_path / "in")
    for rows in parts:
        schema = written(spark, folder, rows)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
        query = settled.track_settled(stream, **settings).writeStream.foreachBatch(lambda df, _: got.extend(df.collect())).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
    return got


def keys(rows):
    return sorted((-1 if r.channel is None else r.channel, r.scan_start, r.scan_end, round(r.mz, 9), round(r.intensity_sum, 6), tuple(r.profile)) for r in rows)


def test_split_and_late_scans_and_restarts_equal_the_batch(rocks, tmp_path):
    one, other = scans(-40.0, range(40), 1), scans(None, range(40), 2)
    rows = one + other
    rng = np.random.default_rng(0)
    # Peaks arrive up to 50 seconds late, so that most scans are split and many come after later ones.
    arrival = [r[-1] + rng.uniform(0, 50) for r in rows]
    order = [rows[i] for i in np.argsort(arrival)]
    parts = [order[i : i + 60] for i in range(0, len(order), 60)]
    last = [("r", 1.0, 0, 0.0, 300.0, 1.0, 0.0, 5000)]
    got = run(rocks, tmp_path, [*parts, last])
    frame = rocks.createDataFrame(rows, SCHEMA)
    expected = tk.track(frame).collect()
    assert len(expected) > 10 and keys(got) == keys(expected)


def test_scans_against_time_fail(rocks, tmp_path):
    with pytest.raises(Exception, match="scans must rise with time"):
        run(rocks, tmp_path, [scans(1.0, range(5, 9), 1), [("r", 2.0, 0, 0.0, 300.0, 1.0, 0.0, 300)], [("r", 1.0, 3, 0.0, 300.0, 1.0, 0.0, 400)]])


def test_state_is_plain(rocks, tmp_path):
    run(rocks, tmp_path, [scans(1.0, range(9), 1), scans(1.0, range(9, 11), 2)], delay="20 seconds")
    read = lambda name: rocks.read.format("statestore").option("stateVarName", name).load(str(tmp_path / "state"))
    assert {"at", "scan", "mz"} <= set(read("waiting").select("list_element.*").columns)
    assert read("progress").select("value.last").first()[0] >= 5
    assert pd.DataFrame(read("open").select("list_element.*").collect()).shape[0] > 0
