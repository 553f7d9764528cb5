"""Region names, landed JSON, amounts and upkeep on small scenarios with stated results."""

import json
from datetime import date
from decimal import Decimal

from pyspark.sql import functions as F

from tidewatch.functions import formats
from tidewatch.operators import region_names, upkeep
from tidewatch.sources import readers


def test_region_names(spark):
    regions = spark.createDataFrame(
        [("11010", "종로구", 2, "서울특별시"), ("31040", "안양시", 2, "경기도"), ("31010", "수원시", 2, "경기도"), ("31041", "안양시 만안구", 3, "경기도"), ("31011", "수원시 장안구", 3, "경기도"), ("29010", "세종시", 2, "세종특별자치시"), ("26110", "중구", 2, "부산광역시"), ("26111", "중구", 2, "부산광역시")],
        "region_cd string, name string, level int, province string",
    )
    provinces = spark.createDataFrame([("서울", "서울특별시"), ("경기", "경기도"), ("세종", "세종특별자치시"), ("부산", "부산광역시"), ("강원", "강원도")], "spelling string, province string")
    aliases = spark.createDataFrame([("종로", "종로구")], "name string, alias string")
    manual = spark.createDataFrame([("r", "부산 중구", "26110", "by hand"), ("R", "경기 화성시", None, "split up")], "source string, name string, region_cd string, note string")
    cases = {
        "a": ("서울", ["종로구"], ("NAME", "11010", None)),
        "b": ("서울", ["도심권", "종로"], ("NAME", "11010", None)),
        "c": ("경기", ["안양시", "만안구"], ("NAME", "31041", None)),
        "d": ("경기", ["만안구"], ("NAME", "31041", None)),
        "e": ("전국", [], ("AGGREGATE", None, region_names.WHOLE)),
        "f": ("화성", ["올림푸스시"], ("UNMAPPED", None, region_names.UNKNOWN_PROVINCE + ": 화성")),
        "g": ("경기", ["계"], ("AGGREGATE", None, region_names.PROVINCE)),
        "h": ("세종", ["소계"], ("NAME", "29010", None)),
        "i": ("경기", ["경부1권"], ("AGGREGATE", None, region_names.AREA)),
        "j": ("경기", ["없는시"], ("UNMAPPED", None, region_names.NOT_FOUND)),
        "k": ("경기", ["화성시"], ("UNMAPPED", None, "split up")),
        "l": ("강원", ["춘천시"], ("UNMAPPED", None, "기준 경계에 시도 없음: 강원")),
        "m": ("경기", None, ("AGGREGATE", None, region_names.PROVINCE)),
    }
    rows = [("R", k, p, t) for k, (p, t, _) in cases.items()] * 2 + [("R", "n", "부산", ["중구"]), ("other", "n", "부산", ["중구"])]
    codes = spark.createDataFrame(rows, "source string, source_code string, province string, tokens array<string>")
    got = {(r.source, r.source_code): (r.method, r.region_cd, r.note) for r in region_names.match_names(codes, regions, provinces, aliases, manual).collect()}
    assert len(got) == len(cases) + 2
    for k, (*_, want) in cases.items():
        assert got["R", k] == want, k
    assert got["R", "n"] == ("MANUAL", "26110", "by hand")
    assert got["other", "n"] == ("UNMAPPED", None, region_names.SEVERAL + ": 26110,26111")


def _land(tmp_path, name, *pages):
    folder = tmp_path / name
    folder.mkdir()
    for k, page in enumerate(pages):
        (folder / f"{k}.json").write_text(json.dumps(page, ensure_ascii=False))
    return str(folder)


def test_daily_bars(spark, tmp_path):
    row = lambda code, day, close: {"basDt": day, "srtnCd": code, "clpr": close, "trqu": "1,200"}
    page = lambda item: {"response": {"header": {"resultCode": "00"}, "body": {"items": {"item": item}, "totalCount": 1}}}
    path = _land(tmp_path, "bars", page([row("000720", "20250102", "31,500"), row("000725", "20250102", "9")]), page(row("000720", "20250103", "32000")), {"response": {"body": {"items": ""}}})
    got = sorted((r.stock_code, r.bas_dt, r.close, r.volume) for r in readers.daily_bars(spark, path, ["000720"]).collect())
    assert got == [("000720", date(2025, 1, 2), Decimal(31500), 1200), ("000720", date(2025, 1, 3), Decimal(32000), 1200)]
    assert readers.daily_bars(spark, path).count() == 3


def test_presale(spark, tmp_path):
    full = {"HOUSE_MANAGE_NO": "1", "PBLANC_NO": "2", "HOUSE_NM": "집", "HOUSE_SECD": "01", "RCRIT_PBLANC_DE": "2025-03-04", "RCEPT_BGNDE": "20250310", "TOT_SUPLY_HSHLDCO": "1,024", "SPECLT_RDN_EARTH_AT": "Y", "PARCPRC_ULS_AT": "N", "MVN_PREARNGE_YM": "202713"}
    path = _land(tmp_path, "notices", {"data": [full, {**full, "HOUSE_NM": " ", "SPECLT_RDN_EARTH_AT": "?", "RCRIT_PBLANC_DE": "bad", "MVN_PREARNGE_YM": "202712"}], "matchCount": 2}, {"data": [], "matchCount": 2})
    a, b = sorted(readers.presale_notices(spark, path).collect(), key=lambda r: len(r.lacking))
    assert (a.notice_date, a.receipt_from, a.households, a.overheated, a.price_cap, a.move_in_ym, a.lacking) == (date(2025, 3, 4), date(2025, 3, 10), 1024, True, False, None, [])
    assert (b.notice_date, b.overheated, b.move_in_ym, b.lacking) == (None, None, "202712", ["HOUSE_NM"])
    path = _land(tmp_path, "models", {"data": [{"HOUSE_MANAGE_NO": "1", "PBLANC_NO": "2", "MODEL_NO": "01", "SUPLY_AR": "84.99", "LTTOT_TOP_AMOUNT": "65,000"}]})
    (m,) = readers.presale_models(spark, path).collect()
    assert (m.top_price, m.area) == (Decimal(650_000_000), Decimal("84.9900"))


def test_statistics_and_price_index(spark, tmp_path):
    path = _land(tmp_path, "stats", [{"PRD_DE": "202501", "C1": "11", "C1_NM": "서울", "C2": "A", "C2_NM": "계", "C4": "x", "ITM_ID": "T1", "DT": "1,234.5"}, {"PRD_DE": "202501", "DT": "-"}])
    a, b = sorted(readers.statistic_rows(spark, path).collect(), key=lambda r: -len(r.codes))
    assert (a.codes, a.names, a.value) == (["11", "A"], ["서울", "계"], Decimal("1234.5000"))
    assert (b.codes, b.value, b.raw) == ([], None, "-")
    row = {"STATBL_ID": "S", "WRTTIME_IDTFR_ID": "202501", "CLS_ID": "1", "CLS_NM": "종로구", "CLS_FULLNM": "서울 > 도심권>종로구", "ITM_ID": "10001", "DTA_VAL": "99.1"}
    path = _land(tmp_path, "index", {"SttsApiTblData": [{"head": [{"list_total_count": 3}]}, {"row": [row, {**row, "CLS_NM": None}, {**row, "ITM_ID": "9"}]}]})
    (r,) = readers.price_index_rows(spark, path, ["10001"]).collect()
    assert (r.path, r.value) == (["서울", "도심권", "종로구"], Decimal("99.1000"))


def test_amounts_as_text(spark):
    values = [None, "0", "-0.001", "0.5", "10", "99.999", "100", "999.5", "12240500000", "-684400000000", "35000000", "2125000000000", "2000000000000"]
    d = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string").withColumn("v", F.col("v").cast("decimal(24,4)"))
    got = [tuple(r) for r in d.orderBy("k").select(formats.plain(F.col("v")), formats.won(F.col("v"))).collect()]
    assert [p for p, _ in got[:8]] == ["-", "0", "0", "0.5", "10", "100", "100", "1,000"]
    assert [w for _, w in got[8:]] == ["122억원", "-6,844억원", "3,500만원", "2조 1,250억원", "2조원"]
    assert got[0][1] == "-" and got[1][1] == "0원"


def test_purge_and_seed_with_nulls(spark):
    rows = spark.createDataFrame([(1,), (2,)], "id int")
    name = lambda s: spark.createDataFrame([(s,)], "source string")
    assert upkeep.purged(rows, name("a"), name("a")).count() == 2
    assert upkeep.purged(rows, name("a"), name("b")).count() == 0
    rules = spark.createDataFrame([("x", None, "USER"), ("y", "p", "SEED"), ("z", "p", "SEED")], "std string, section string, origin string")
    seed = spark.createDataFrame([("x", None), ("z", "p"), ("n", None)], "std string, section string")
    assert sorted(map(str, map(tuple, upkeep.sync_seed(rules, seed, ["std", "section"]).collect()))) == ["('n', None, 'SEED')", "('x', None, 'USER')", "('z', 'p', 'SEED')"]


def test_archives_are_bounded(spark, tmp_path):
    (tmp_path / "small.zip").write_bytes(b"x" * 10)
    (tmp_path / "large.zip").write_bytes(b"x" * 1000)
    assert [r.path.rsplit("/", 1)[1] for r in readers.bounded_zips(spark, str(tmp_path), 100).collect()] == ["small.zip"]


def test_members_of_a_consortium_are_trimmed(spark):
    d = spark.createDataFrame([("가건설 , 나건설/ 다건설 컨소시엄 외 2개사",)], "raw string")
    from tidewatch.functions import names

    r = d.select(names.consortium(F.col("raw")).alias("c")).first().c
    assert (r.names, r.extra, r.more) == (["가건설", "나건설", "다건설"], 2, False)
    d = spark.createDataFrame([("(주)가건설, 가건설 건설부문·나건설 등",)], "raw string")
    r = d.select(names.consortium(F.col("raw")).alias("c")).first().c
    assert (r.names, r.extra, r.more) == (["(주)가건설", "나건설"], 0, True)


def test_account_names_and_company_keys(spark):
    from tidewatch.functions import names

    want = {"Ⅰ. 유동 자산": "유동자산", "1) 현금": "현금", "（１） 현금": "（１）현금", "(가) 매출채권": "매출채권", "ⅳ.차입금 (주석 12,13)": "차입금", "I. 1. 자본": "1.자본", "재고자산（주 3）": "재고자산"}
    d = spark.createDataFrame([(k,) for k in want], "a string")
    assert {r.a: r.n for r in d.select("a", names.account_name(F.col("a")).alias("n")).collect()} == want
    keys = {"(주)가나 건설": "가나건설", "주식회사 A&B!": "ab", "「가나」·다": "가나다", "ＡＢＣ": "abc"}
    d = spark.createDataFrame([(k,) for k in keys], "a string")
    assert {r.a: r.n for r in d.select("a", names.corp_key(F.col("a")).alias("n")).collect()} == keys
    assert d.limit(1).select(names.builder_key(F.lit("가나건설 건설부문")).alias("n")).first().n == "가나건설"
