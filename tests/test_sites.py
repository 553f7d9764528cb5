"""Sites by the places in their addresses, and the markets around them."""

from tidewatch.operators import sites

PLACES = [("A", "역삼동", "12-3", "역삼탑"), ("A", "역삼동", "", "x"), ("A", "성수동1가", "5", "숲"), ("B", "화원읍 천내리", "산7", "산집"), ("B", "화원읍 명곡리", "1", "y"), ("B", "논공읍 천내리", "1", "z"), ("C", "대동리 윗말", "1", "w"), ("C", "염치읍 대동리", "9", "v")]


def test_locate(spark):
    places = spark.createDataFrame(PLACES, "lawd_cd string, umd_nm string, jibun string, apt_nm string")
    cases = {
        "서울 강남구 역삼동 12 - 3 일대": ("JIBUN", "A", "역삼동", "12-3", "역삼탑"),
        "서울 강남구 역삼동 99번지": ("UMD", "A", "역삼동", "99", None),
        "서울 강남구 역삼동": ("UMD", "A", "역삼동", None, None),
        "서울 성동구 성수동1가 5": ("JIBUN", "A", "성수동1가", "5", "숲"),
        "서울 강남구 없는동 3": ("UMD_NO_TRADE", None, None, None, None),
        "서울 강남구": ("NONE", None, None, None, None),
        "역삼동 ~ 성수동1가 구간": ("MULTI", None, None, None, None),
        "대구 달성군 화원읍 천내리 산 7": ("JIBUN", "B", "화원읍 천내리", "산7", "산집"),
        "대구 달성군 천내리 1": ("MULTI", None, None, None, None),
        "대구 달성군 화원읍 일원": ("UMD", "B", "화원읍", None, None),
        "화원읍 천내리 ~ 명곡리": ("UMD", "B", "화원읍", None, None),
        "하이테크밸리리리리 101동": ("NONE", None, None, None, None),
        "아산시 염치읍 대동리 9": ("JIBUN", "C", "염치읍 대동리", "9", "v"),
    }
    rows = [(i, t, ["A", "B", "C"]) for i, t in enumerate(cases)] + [(98, None, ["A"]), (99, "역삼동 1", None)]
    got = {r.id: tuple(r)[1:] for r in sites.locate(spark.createDataFrame(rows, "id long, text string, lawd_cds array<string>"), places).collect()}
    assert len(got) == len(rows)
    for i, (text, want) in enumerate(cases.items()):
        assert got[i] == want, text
    assert got[98][0] == "NONE" and got[99][0] == "UMD_NO_TRADE"


def test_markets(spark):
    where = spark.createDataFrame([("r", "B", "화원읍"), ("r", "B", "화원읍 천내리"), ("r", "B", None)], "region_cd string, lawd_cd string, umd string")
    anchors = spark.createDataFrame([("r", 202606)], "region_cd string, ym int")
    t = [("B", "화원읍 천내리", 202606, 100.0, 10.0, False), ("B", "화원읍 명곡리", 202507, 300.0, 10.0, False), ("B", "화원읍 명곡리", 202506, 160.0, 10.0, None), ("B", "화원읍 명곡리", 202606, 1.0, 1.0, True), ("B", "화원읍 명곡리", 202406, 1.0, 1.0, False), ("B", None, 202606, 1.0, 1.0, False)]
    trades = spark.createDataFrame(t, "lawd_cd string, umd_nm string, deal_ym int, deal_amount double, exclu_use_ar double, cancelled boolean")
    got = {r.umd: r for r in sites.markets(where, anchors, trades).collect()}
    town = got["화원읍"]
    assert (town.trades_12m, town.trades_before, town.cancels_12m, town.m2, town.m2_before) == (2, 1, 1, 20.0, 16.0)
    assert (town.trades_change, town.m2_change, town.cancel_rate) == (100.0, 25.0, 33.3)
    assert (got["화원읍 천내리"].trades_12m, got["화원읍 천내리"].m2_change) == (1, None)
