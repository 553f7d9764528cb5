"""Sources, sinks, snapshots and streams."""

import zipfile

from pyspark.sql import functions as F

from tidewatch.operators import ordered, snapshots
from tidewatch.plans import series
from tidewatch.sources import readers, sinks
from tidewatch.streaming import feeds

SF = "/root/testdata/sf0.001"


def test_trades_from_xml(spark, tmp_path):
    item = "<item><aptNm>a</aptNm><dealAmount> {0}</dealAmount><dealYear>2026</dealYear><dealMonth>7</dealMonth><dealDay>3</dealDay><excluUseAr>84.5</excluUseAr><sggCd>11110</sggCd><cdealType>{1}</cdealType><cdealDay>{2}</cdealDay></item>"
    (tmp_path / "t.xml").write_text("<r><items>" + item.format("82,500", "O", "26.08.01") + item.format("5,000", " ", "") + item.format("0", "", "") + "</items></r>")
    rows = readers.trades(spark, str(tmp_path)).orderBy("deal_amount").collect()
    assert [(r.deal_amount, r.cancelled, str(r.cancel_date), r.deal_ym) for r in rows] == [(5000, False, "None", 202607), (82500, True, "2026-08-01", 202607)]


def test_statement_lines_keep_their_numbers(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"status":"000","list":[{"sj_div":"BS","account_nm":"a","thstrm_amount":"1,000"},{"sj_div":"SCE","account_nm":"b"},{"sj_div":"IS","account_nm":"c","thstrm_amount":"-"}]}')
    rows = readers.statement_lines(spark, str(tmp_path), "CFS").orderBy("line_no").collect()
    assert [(r.line_no, r.account_nm, r.thstrm_amount) for r in rows] == [(1, "a", 1000), (3, "c", None)]


def test_section_between_markers(spark, tmp_path):
    (tmp_path / "a.xml").write_text("x<TITLE>old</TITLE>y<TITLE>가</TITLE>START body <TITLE>next</TITLE>END tail")
    (tmp_path / "b.xml").write_text("nothing")
    (tmp_path / "c.xml").write_bytes("가START 나 END<TITLE>".encode("cp949"))
    (tmp_path / "d.xml").write_text("<TITLE>START" + "x" * 100)
    (tmp_path / "e.xml").write_text("END <TITLE>START x END")
    (tmp_path / "f.xml").write_text("")
    got = {r.path[-5:]: (r.section, r.truncated) for r in readers.sections(spark, str(tmp_path), "START", "END", 20).collect()}
    want = {"a.xml": "<TITLE>가</TITLE>START body ", "b.xml": None, "c.xml": "가START 나 ", "d.xml": "<TITLE>START" + "x" * 8, "e.xml": "<TITLE>START x "}
    assert got == {k: (v, k == "d.xml") for k, v in want.items()}


def test_documents_in_archives(spark, tmp_path):
    def archive(name, *entries):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            for entry, content in entries:
                z.writestr(entry, content)

    archive("101.zip", ("x.xml", b"other"), ("101_main.xml", "본문".encode()))
    archive("102.zip", ("x.xml", "본문".encode("cp949")), ("y.xml", b"second"))
    archive("103.zip", ("103.xml", b"x" * 1001))
    archive("104.zip")
    (tmp_path / "105.zip").write_bytes(b"no archive")
    got = {r.rcept_no: r.html for r in readers.documents(readers.bounded_zips(spark, str(tmp_path)), 1000).collect()}
    assert got == {"101": "본문", "102": "본문", "103": None, "104": None, "105": None}


def test_census_and_boundaries(spark, tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "1.json").write_text('{"errCd":0,"result":[{"adm_cd":"11010","adm_nm":"종로구","tot_family":"63,000","tot_ppltn":"N/A"}]}')
    (tmp_path / "c" / "2.json").write_text('{"errCd":-100,"errMsg":"none"}')
    assert [tuple(r) for r in readers.census_rows(spark, str(tmp_path / "c")).collect()] == [("11010", "종로구", 63000, None)]
    (tmp_path / "b").mkdir()
    shape = '{"type":"Point","coordinates":[1.5,2.5]}'
    (tmp_path / "b" / "1.json").write_text('{"features":[{"properties":{"adm_cd":"11010","adm_nm":"a"},"geometry":%s}]}' % shape)
    (tmp_path / "b" / "2.json").write_text('{"response":{"status":"OK","result":{"featureCollection":{"features":[{"properties":{"sig_cd":"11110","sig_kor_nm":"b","full_nm":"x b"},"geometry":%s}]}}}}' % shape)
    (tmp_path / "b" / "3.json").write_text('{"response":{"status":"NOT_FOUND"}}')
    got = sorted(tuple(r) for r in readers.boundaries(spark, str(tmp_path / "b")).collect())
    assert got == [("11010", "a", None, shape), ("11110", "b", "x b", shape)]


def test_days_of_a_stream_sum_to_months(spark):
    e = spark.createDataFrame([(1, "2024-01-31 23:00:00"), (1, "2024-01-31 10:00:00"), (1, "2024-02-01 00:00:00"), (2, None)], "k int, t string")
    got = {(r.k, r.month, str(r.day), r.n) for r in feeds.daily(e, ["k"], "t", "1 day").collect()}
    assert got == {(1, "202401", "2024-01-31", 2), (1, "202402", "2024-02-01", 1)}


def test_units_that_are_not_whole_stay_out(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "u string, x int")
    declared = spark.createDataFrame([("a", 2), ("b", 2), ("c", 0)], "u string, total long")
    before = spark.createDataFrame([("c", 5)], "u string, n long")
    assert {r.u for r in readers.whole_units(rows, declared, before, ["u"]).collect()} == {"a"}


def test_csv(spark, tmp_path):
    df = spark.createDataFrame([("=1+1", -5), ('a"b,c', 2), (None, None)], "name string, n int")
    lines = [r.line for r in sinks.csv_lines(df, [F.col("n").asc_nulls_last()]).collect()]
    assert lines == ["'=1+1,-5", '"a""b,c",2', ","]
    sinks.write_csv(df, [F.col("n")], str(tmp_path / "out"))
    text = next((tmp_path / "out").glob("part-*")).read_bytes()
    assert text.startswith(b"\xef\xbb\xbfname,n\r\n")


def test_units_are_replaced(spark, tmp_path):
    path = str(tmp_path / "t")
    snapshots.replace_units(spark.createDataFrame([(1, "a"), (2, "b")], "v int, u string"), path, ["u"])
    snapshots.replace_units(spark.createDataFrame([(3, "b")], "v int, u string"), path, ["u"])
    assert {(r.v, r.u) for r in spark.read.parquet(path).collect()} == {(1, "a"), (3, "b")}


def test_rule_versions(spark):
    r = spark.createDataFrame([("R", 1, "x"), ("S", 1, "y")], "rule string, version int, params string")
    w = spark.createDataFrame([("R", "z"), ("S", "y"), ("T", "t")], "rule string, params string")
    got = {(x.rule, x.version, x.params) for x in snapshots.next_version(r, w, "rule", ["params"]).collect()}
    assert got == {("R", 1, "x"), ("S", 1, "y"), ("R", 2, "z"), ("T", 1, "t")}


def test_sessions_of_a_stream_are_those_of_the_table(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet").where("event_type = 'error'").select("user_id", "ts")
    e.repartition(3).write.parquet(str(tmp_path / "in"))
    s = feeds.sessions(feeds.stream(spark, str(tmp_path / "in"), e.schema.simpleString()[7:-1].replace(":", " ")), ["user_id"], "ts", "6 hours", "60 days")
    q = s.writeStream.format("memory").queryName("sessions_test").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.user_id, r.first_ts, r.last_ts, r.n) for r in spark.table("sessions_test").collect()}
    want = {(r.user_id, r.first_ts, r.last_ts, r.n) for r in series.episodes_gap(spark, SF).collect()}
    assert got == want


def test_a_feed_is_merged_once(spark, tmp_path):
    df = spark.createDataFrame([(i % 3, i) for i in range(9)], "k int, v int")
    df.repartition(3).write.parquet(str(tmp_path / "in"))

    def merge(old, batch):
        new = batch.groupBy("k").agg(F.max("v").alias("v"))
        return new if old is None else old.unionByName(new).groupBy("k").agg(F.max("v").alias("v"))

    feed = feeds.stream(spark, str(tmp_path / "in"), "k int, v int", files=1)
    feeds.merge_batches(feed, str(tmp_path / "state"), str(tmp_path / "c"), merge).awaitTermination(120)
    last = max((tmp_path / "state").glob("v=*"), key=lambda p: int(p.name[2:]))
    assert {(r.k, r.v) for r in spark.read.parquet(str(last)).collect()} == {(0, 6), (1, 7), (2, 8)}
    assert {int(p.name[2:]) for p in (tmp_path / "state").glob("v=*")} == {1, 2}


def test_as_of_at_equal_times(spark):
    a = spark.createDataFrame([("k", 5, "l")], "k string, t int, x string")
    b = spark.createDataFrame([("k", 5, 50), ("k", 3, 30), ("k", 9, 90)], "k string, t int, v int")
    assert ordered.asof_floor(a, b, ["k"], "t", ["v"]).first().v == 50
    assert ordered.asof_floor(a, b, ["k"], "t", ["v"], strict=True).first().v == 30
    assert ordered.asof_next(a, b, ["k"], "t", ["v"]).first().v == 90
    assert ordered.asof_next(a, b, ["k"], "t", ["v"], strict=False).first().v == 50
