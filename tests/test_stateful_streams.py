import random
from datetime import datetime, timedelta

import pytest

from tidewell.operators.evaluation import fold_positions
from tidewell.streaming.state import fold, matched, running_positions, silent

T0 = datetime(2024, 1, 1)


def drain(df, mode, name, checkpoint):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return df.sparkSession.table(name).collect()


def test_running_positions_end_where_the_table_of_fills_does(spark, tmp_path):
    rng = random.Random(3)
    rows = [(f"{i:05}", rng.choice("AB"), float(rng.choice([-3, -1, 1, 2, 5])), round(rng.uniform(90, 110), 2)) for i in range(80)]
    schema = "o string, k string, q double, p double"
    for part in range(4):
        chunk = rows[part * 20 : part * 20 + 20] + rows[max(0, part * 20 - 5) : part * 20]
        spark.createDataFrame(chunk, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {}
    for r in drain(running_positions(live, key="k", order="o", quantity="q", price="p"), "update", "held", str(tmp_path / "cp")):
        if r["fills"] >= got.get(r["key"], {"fills": -1})["fills"]:
            got[r["key"]] = r
    for r in fold_positions(spark.createDataFrame(rows, schema), by=["k"], order="o", quantity="q", price="p").collect():
        mine = got[r["k"]]
        assert mine["fills"] == r["fills"]
        assert [mine[c] for c in ("quantity", "average_cost", "realised")] == pytest.approx([r[c] for c in ("quantity", "average_cost", "realised")], abs=1e-6)


def test_fold_turns_a_position_over():
    assert fold((0.0, 0.0, 0.0), 10, 150.0) == (10, 150.0, 0.0)
    assert fold((10, 150.0, 0.0), -3, 160.0) == (7, 150.0, 30.0)
    assert fold((7, 150.0, 30.0), -10, 140.0) == (-3, 140.0, -40.0)
    assert fold((-3, 140.0, -40.0), 3, 100.0) == (0.0, 0.0, 80.0)


def test_silent_sources(spark, tmp_path):
    schema = "k string, ts timestamp"
    for i, chunk in enumerate(([("a", 0), ("b", 0)], [("a", 120)], [("a", 400)], [("a", 430)])):
        spark.createDataFrame([(k, T0 + timedelta(seconds=s)) for k, s in chunk], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"f{i}"))
    live = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    got = drain(silent(live, key="k", at="ts"), "append", "quiet", str(tmp_path / "cp"))
    assert ("b", T0) in {(r["key"], r["last_at"]) for r in got}


def test_two_streams_are_matched_in_time(spark, tmp_path):
    left = spark.createDataFrame([(i, "x", T0 + timedelta(minutes=10 * i)) for i in range(6)], "i long, k string, a timestamp")
    right = spark.createDataFrame([(i, "x", T0 + timedelta(minutes=10 * i + 5)) for i in range(6)], "j long, k string, b timestamp")
    left.write.parquet(str(tmp_path / "l"))
    right.write.parquet(str(tmp_path / "r"))
    pairs = lambda a, b: matched(a, b, key="k", left_at="a", right_at="b", within="10 minutes").select("i", "j")
    want = sorted(tuple(r) for r in pairs(left, right).collect())
    live = pairs(spark.readStream.schema(left.schema).parquet(str(tmp_path / "l")), spark.readStream.schema(right.schema).parquet(str(tmp_path / "r")))
    assert want == [(i, i) for i in range(6)]
    assert sorted(tuple(r) for r in drain(live, "append", "pairs", str(tmp_path / "cp"))) == want
