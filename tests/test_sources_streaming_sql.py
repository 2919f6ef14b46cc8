import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewell.sources.pages import Failed, Retry, Throttle, cursor_pages, paged_table
from tidewell.sources.readers import bar_messages, columnar_table, csv_table, csv_text, json_table, to_number, to_time
from tidewell.sources.schemas import RAW, require
from tidewell.sources.writers import already_written, append_log, merge_table
from tidewell.sql_api import Refused, collect_within, conditions, ordering, query, relations
from tidewell.streaming.bars import canonicalize, once, sessions, with_status, windowed

T0 = datetime(2024, 1, 1)


def message(symbol, at, close, **more):
    return {"T": "b", "S": symbol, "t": at, "o": 1, "h": 2, "l": 1, "c": close, "v": 10} | more


def test_tolerant_parsing(spark):
    texts = {"2024-01-02": datetime(2024, 1, 2), "20240102": datetime(2024, 1, 2), "1704153600": datetime(2024, 1, 2), "1704153600000": datetime(2024, 1, 2), "2024-01-02T03:00:00Z": datetime(2024, 1, 2, 3), "soon": None, "": None, None: None}
    df = spark.createDataFrame([(k,) for k in texts], "x string").select("x", to_time("x").alias("t"))
    assert {r["x"]: r["t"] for r in df.collect()} == texts
    numbers = {"1.5": 1.5, "-2e3": -2000.0, "nan": None, "Infinity": None, "x": None, None: None}
    assert {r[0]: r[1] for r in spark.createDataFrame([(k,) for k in numbers], "x string").select("x", to_number("x")).collect()} == numbers


def test_bar_messages(spark):
    lines = [json.dumps([message("a ", "2024-01-01T00:00:00Z", 3), {"T": "q", "S": "a"}]), "not json", json.dumps([message("B", "bad", "x", vw=2.0)])]
    out = bar_messages(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert sorted((r["symbol"] or "", r["close"] or 0, r["vwap"] or 0, r["bad"] or "") for r in out) == [("", 0, 0, "not json"), ("A", 3.0, 0, ""), ("B", 0, 2.0, "")]
    states = {r["symbol"]: r["status"] for r in with_status(bar_messages(spark.createDataFrame([(lines[0],), (lines[2],)], "value string"))).collect()}
    assert states == {"A": "passed", "B": "failed"}


def test_files_keep_their_schema(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,v\n1,2.5\nx,oops\n")
    assert [(r["k"], r["v"]) for r in csv_table(spark, str(tmp_path / "a.csv"), "k long, v double").collect()] == [(1, 2.5), (None, None)]
    (tmp_path / "a.json").write_text('{"k": 1, "v": 2}\n{broken\n')
    assert sorted((r["k"] or 0, bool(r["_bad"])) for r in json_table(spark, str(tmp_path / "a.json"), "k long, v double").collect()) == [(0, True), (1, False)]
    df = spark.createDataFrame([(1, "a")], "k long, s string")
    df.write.orc(str(tmp_path / "o"))
    assert columnar_table(spark, str(tmp_path / "o"), "orc").collect() == df.collect()
    with pytest.raises(ValueError, match="missing columns: z"):
        require(df, ["k", "z"])
    assert spark.createDataFrame([], RAW["raw_fd_fundamentals"]).columns[0] == "fund_id"


def test_merge_table_is_idempotent_and_local(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([("a", 1, 1.0, "m1"), ("b", 1, 2.0, "m2")], "k string, o long, v double, m string")
    late = spark.createDataFrame([("a", 2, 5.0, "m1"), ("c", 1, 3.0, "m1")], rows.schema)
    for _ in range(2):
        assert merge_table(rows, path, by=["k"], order=["o"], partition="m") == 2
        assert merge_table(late, path, by=["k"], order=["o"], partition="m") == 1
        assert sorted((r["k"], r["v"]) for r in spark.read.parquet(path).collect()) == [("a", 5.0), ("b", 2.0), ("c", 3.0)]
    assert merge_table(rows.limit(0), path, by=["k"], order=["o"], partition="m") == 0


def test_stream_upserts_in_batches(spark, tmp_path):
    src, names = tmp_path / "in", {n: str(tmp_path / n) for n in ("table", "log", "bad", "cp")}
    src.mkdir()
    (src / "1.txt").write_text(json.dumps([message("A", "2024-01-01", 3), message("B", "2024-01-01", 4)]) + "\nnoise\n")
    run = lambda: canonicalize(spark.readStream.text(str(src)), names["table"], names["log"], names["bad"], names["cp"]).awaitTermination(60)
    assert run()
    (src / "2.txt").write_text(json.dumps([message("A", "2024-01-01", 9, v=20), message("C", "2024-02-01", 5), message("D", "2024-01-01", None)]) + "\n")
    assert run()
    got = spark.read.parquet(names["table"]).collect()
    assert sorted((r["symbol"], r["close"], r["month"]) for r in got) == [("A", 9.0, "2024-01"), ("B", 4.0, "2024-01"), ("C", 5.0, "2024-02")]
    assert spark.read.json(names["log"]).groupBy("status").count().where("status = 'failed'").first()["count"] == 1
    assert [r["bad"] for r in spark.read.json(names["bad"]).collect()] == ["noise"]


def test_windows_in_stream_equal_batch(spark, tmp_path):
    rows = [(i, T0 + timedelta(minutes=7 * i), "k", float(i)) for i in range(60)] + [(59, T0 + timedelta(minutes=413), "k", 59.0)]
    src = spark.createDataFrame(rows, "id long, ts timestamp, k string, v double")
    src.write.parquet(str(tmp_path / "e"))
    live = lambda: spark.readStream.schema(src.schema).parquet(str(tmp_path / "e"))

    def drained(df, name):
        df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start().awaitTermination(60)
        return spark.table(name).count()

    batch = windowed(src.dropDuplicates(["id"]), at="ts", key="k", value="v")
    assert batch.agg(F.sum("n")).first()[0] == 60
    assert drained(windowed(once(live(), at="ts", keys=["id"]), at="ts", key="k", value="v", late=None), "w1") >= batch.count() - 2
    assert sessions(src, at="ts", key="k").count() == 1


def test_guarded_sql(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k long, s string")
    tables = {"t": df}
    assert [r["k"] for r in collect_within(query(spark, "select k from t where s = :s", tables, args={"s": "b"}), 30)] == [2]
    assert query(spark, "with c as (select * from t) select count(*) n from c, t", tables).first()["n"] == 4
    assert query(spark, "select * from t", tables, rows=1).count() == 1
    assert relations(spark, "select * from a, b where x in (select y from d.c)") == {"a", "b", "d.c"}
    df.createOrReplaceTempView("secret")
    for bad in ("drop table t", "select * from secret", "select * from t, secret", "select (select max(k) from secret) from t", "insert into t select 1, 'x'", "select ((", "select ', secret as (' as z, k from secret", "select * from secret, (with secret as (select 1) select * from secret)",
        "select reflect('java.lang.System', 'exit', '1') from t", "with a as (select * from b), b as (select * from secret) select 1 from t", "select * from t where exists (select 1 from secret)", "with c as (select 1) insert into t select * from c", "select * from range(9)"):
        with pytest.raises(Refused):
            query(spark, bad, tables)
    spark.createDataFrame([(7,)], "k long").createOrReplaceTempView("t")
    assert query(spark, "with c as (select * from t), d as (select k from c) select max(k) as m from d", tables).first()["m"] == 2
    assert spark.table("t").first()["k"] == 7
    spark.catalog.dropTempView("t")
    assert query(spark, "select k from t order by k", tables).count() == 2 and not spark.catalog.tableExists("t")


def test_conditions_are_bound_and_columns_checked(spark):
    df = spark.createDataFrame([(1, "Abc"), (2, "xyz"), (3, "cab")], "k long, s string")
    allowed = {"k", "s"}
    text, args = conditions(at_least={"k": 1, "s": None}, among={"k": [1, 3]}, contains={"s": "BC' or 1=1"}, allowed=allowed)
    assert query(spark, f"select k from t where {text}", {"t": df}, args=args).count() == 0
    text, args = conditions(contains={"s": "AB"}, at_most={"k": 9}, allowed=allowed)
    assert [r["k"] for r in query(spark, f"select k from t where {text} order by {ordering('k desc', allowed, 'k')}", {"t": df}, args=args).collect()] == [3, 1]
    assert conditions(allowed=allowed) == ("true", {}) and conditions(among={"k": []}, allowed=allowed)[0] == "false"
    assert ordering("k; drop table t", allowed, "`s` asc") == "`s` asc" and ordering("k sideways", allowed, "d") == "d"
    with pytest.raises(Refused):
        conditions(equal={"z": 1}, allowed=allowed)


def test_pages_by_token_and_by_cursor(spark, tmp_path):
    def put(request, answer):
        name = "&".join(f"{k}={v}" for k, v in sorted(request.items()))
        (tmp_path / f"{name}.json").write_text(json.dumps(answer))

    put({"symbol": "A"}, {"bars": [{"c": 1}], "next": "t1"})
    put({"symbol": "A", "page": "t1"}, {"bars": [{"c": 2}, {"c": 3}], "next": "t2"})
    put({"symbol": "A", "page": "t2"}, {"bars": [], "next": "t1"})
    put({"symbol": "B"}, {"bars": None})
    out = paged_table(spark, str(tmp_path), ["A", "B"], items="bars", token="next", sends="page").collect()
    assert [(r["entity"], json.loads(r["item"])["c"]) for r in out] == [("A", 1), ("A", 2), ("A", 3)]
    items = [{"d": f"2024-01-{d:02}", "i": i} for i, d in enumerate((9, 8, 8, 7, 3, 3, 3, 2))]
    fetch = lambda r: {"x": [i for i in items if r["from"] <= i["d"] <= r["to"]][: r["limit"]]}
    got = list(cursor_pages(fetch, {}, items="x", dated="d", limit=3, since="2024-01-02", until="2024-01-31", first="from", last="to"))
    assert got == items


def test_retries_wait_and_give_up():
    waits, answers = [], [Failed(503), Failed(429, after=7.0), {"ok": 1}]

    def request():
        a = answers.pop(0)
        if isinstance(a, Failed):
            raise a
        return a

    assert Retry(sleep=waits.append)(request) == {"ok": 1} and waits == [0.5, 7.0]
    answers[:] = [Failed(404)]
    with pytest.raises(Failed):
        Retry(sleep=waits.append)(request)
    answers[:] = [Failed(500)] * 3
    with pytest.raises(Failed):
        Retry(times=2, sleep=waits.append)(request)
    clock, slept = iter([0.0, 0.1, 0.3]), []
    throttle = Throttle(0.2, now=lambda: next(clock), sleep=slept.append)
    throttle()
    throttle()
    assert slept == [pytest.approx(0.1)]


def test_csv_text_logs_and_first_writes(spark, tmp_path):
    df = spark.createDataFrame([("a", "1,2.5"), ("b", "x,3")], "k string, line string")
    assert [tuple(r) for r in csv_text(df, "line", "n long, v double").orderBy("k").collect()] == [("a", 1, 2.5), ("b", None, 3.0)]
    rows = spark.createDataFrame([("a", 1, 1.0, "m"), ("a", 2, 2.0, "m")], "k string, o long, v double, m string")
    merge_table(rows, str(tmp_path / "t"), by=["k"], order=["o"], partition="m")
    assert [r["v"] for r in spark.read.parquet(str(tmp_path / "t")).collect()] == [2.0]
    for _ in range(2):
        append_log(df.select("k"), str(tmp_path / "log"), 1)
    append_log(df.select("k"), str(tmp_path / "log"), 2)
    assert spark.read.json(str(tmp_path / "log")).count() == 4
    log = spark.createDataFrame([("r1", "bars")], "run_id string, domain string")
    assert already_written(log, "r1", "bars") and not already_written(log, "r1", "trades")
