"""Project-finance exposure tables on small sections of invented companies."""

from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import pf_exposure as pf

DUE = ["3개월 이내", "3개월 초과 6개월 이내", "6개월 초과 12개월 이내", "1년 초과 2년 이내", "2년 초과 3년 이내", "3년 초과"]


def row(cells, tag="td"):
    return "<tr>" + "".join(f"<{tag}>{c}</{tag}>" if not isinstance(c, tuple) else f"<{tag} {c[1]}>{c[0]}</{tag}>" for c in cells) + "</tr>"


def summary(rows, due=DUE, unit="(단위: 백만원)", guarantee="보증금액", current="당기"):
    head = row([("구분", 'rowspan="2"'), ("종류", 'rowspan="2"'), ("보증한도", 'rowspan="2"'), (guarantee, 'rowspan="2"'), ("대출잔액", f'colspan="{len(due) + 2}"')], "th")
    return f"<p>{unit}</p><table>{head}{row([current, *due, '전기'], 'th')}{''.join(map(row, rows))}</table>"


def sites(rows):
    head = row(["사업지역", "사업장 구분", "PF 종류", "신용보강 종류", "보증한도", "보증금액", "채무자", "채무자 특수관계", "대출잔액", "만기일", "책임준공 약정금액"], "th")
    return f"<table>{head}{''.join(map(row, rows))}</table>"


def read(spark, *sections):
    found = pf.lines(spark.createDataFrame(list(enumerate(sections)), "id int, html string"), "id", "html")
    return found, [r.asDict() for r in pf.reports(found, "id").orderBy("id").collect()]


M = 1_000_000
A = ["정비사업", "본PF", "300", "200", "180", "10", "20", "30", "120", "-", "-", "90"]
B = ["기타사업", "브릿지론", "150", "100", "80", "-", "-", "40", "-", "40", "-", "70"]
SUM = [("합계", 'colspan="2"'), "450", "300", "260", "10", "20", "70", "120", "40", "-", "160"]


def test_scopes_and_the_companys_share(spark):
    """Consortium totals are not the company's; its share is."""
    section = f"<p>① 단독사업</p>{summary([A, B, SUM])}<p>② 컨소시엄 참여사업(전체분)</p>{summary([A, SUM])}<p>③ 컨소시엄 참여사업(회사분)</p>{summary([[*A[:3], '50', '40', '40', '-', '-', '-', '-', '-', '5']])}"
    text = "<p>당사는 PF와 관련하여 총 350백만원(전기말: 999백만원)의 신용보강을 제공하고 있습니다.</p>"
    found, (r,) = read(spark, text + section)
    scopes = {(x["scope"], x["total"], x["guarantee"]) for x in found.where("role = 'SUMMARY'").collect()}
    assert ("CONSORTIUM_ALL", True, D(300 * M)) in scopes and ("CONSORTIUM_SHARE", False, D(50 * M)) in scopes
    assert (r["status"], r["guarantee"], r["limit"], r["balance"], r["prior"]) == ("PARSED", 350 * M, 750 * M, 300 * M, 165 * M)
    assert (r["m3"], r["m6"], r["m12"], r["y2"], r["y3"], r["over3"]) == (50 * M, 20 * M, 70 * M, 120 * M, 40 * M, None)
    assert (r["due_within_12m"], r["bridge_guarantee"], r["bridge_balance"]) == (140 * M, 100 * M, 80 * M)
    assert (r["stated_total"], r["stated_match"], r["reconciled"], r["note"]) == (350 * M, True, None, None)


def test_sites_reconcile(spark):
    one = ["서울시 중구(*1)", "아파트", "본PF", "연대보증", "150", "200", "갑개발", "X", "180", "2027.01.31", "1,000"]
    two = ["부산시", "오피스텔", "브릿지론", "채무인수", "100", "100", "을개발", "O", "80", "2026.08.01", "-"]
    total = [("기타사업 계", 'colspan="4"'), "250", "100", "-", "-", "80", "-", "-"]
    both = f"<p>1) 정비사업 PF 보증 세부내역</p>{sites([one])}<p>2) 기타사업</p>{sites([two, total])}"
    again = f"<p>전기말 내역</p>{sites([[*one[:5], '190', *one[6:]]])}"
    related = f"<p>특수관계자에게 제공한 보증은 다음과 같습니다.</p>{sites([[*two[:6], '병개발', *two[7:]]])}"
    soc = f"<p>SOC 사업 관련 보증</p>{sites([[*two[:6], '정개발', *two[7:]]])}"
    found, (good, short, alone) = read(spark, summary([A, B, SUM]) + both + again + related + soc, summary([A, B, SUM]) + f"<p>SOC 사업은 제외합니다. 1) 정비사업</p>{sites([one])}", both)
    got = found.where("role = 'SITE' AND id = 0").orderBy("block_no", "row_no").collect()
    assert [(x.category, x.region, x.pf_type, x.enhancement, x.debtor, x.related, x.guarantee, x.balance, x.completion) for x in got] == [
        ("정비사업", "서울시 중구", "본PF", "연대보증", "갑개발", False, D(200 * M), D(180 * M), D(1000 * M)),
        ("기타사업", "부산시", "브릿지론", "채무인수", "을개발", True, D(100 * M), D(80 * M), None),
    ]
    assert (good["n_sites"], good["sites_guarantee"], good["reconciled"]) == (2, 300 * M, True)
    assert (short["n_sites"], short["sites_guarantee"], short["reconciled"]) == (1, 200 * M, False)
    assert (alone["status"], alone["guarantee"], alone["n_sites"], alone["reconciled"], alone["note"]) == ("PARSED", None, 2, None, "SITES_ONLY")


def test_sites_that_are_read_in_part_are_not_given(spark):
    other = sites([["부산시", "오피스텔", "브릿지론", "채무인수", "100", "100", "을개발", "O", "80", "2026.08.01", "-"]]).replace("대출잔액", "대출금액")
    found, (r,) = read(spark, sites([["서울시", "아파트", "본PF", "연대보증", "150", "200", "갑개발", "X", "180", "2027.01.31", "1"]]) + other)
    assert (r["status"], r["n_sites"]) == ("NO_STANDARD", 0)


def dues(spark, *cases):
    """Reports of one-row tables, given by their due columns and their cells behind the limit, guarantee and balance of 100."""
    return read(spark, *[summary([["기타사업", "본PF", "100", "100", "100", *cells, "-"]], names) for names, cells in cases])[1]


def test_due_columns_that_are_up_to_a_time(spark):
    names = ["3개월이내", "6개월이내", "1년이내", "2년이내"]
    fits, cumulative, overdue = dues(spark, (names, ["10", "20", "30", "40"]), (names, ["10", "30", "60", "100"]), (["만기경과", *names], ["5", "10", "20", "30", "40"]))
    assert (fits["m3"], fits["m6"], fits["m12"], fits["y2"], fits["due_within_12m"], fits["note"]) == (10 * M, 20 * M, 30 * M, 40 * M, 60 * M, None)
    assert (cumulative["m3"], cumulative["due_within_12m"], cumulative["note"]) == (None, None, "DUE_UNREAD")
    assert (overdue["due_within_12m"], overdue["note"]) == (None, "DUE_UNREAD")


def test_due_columns_that_join_or_lack_buckets(spark):
    joined, sparse, across, empty, later = dues(
        spark,
        (["6개월이내", "6개월초과12개월이내", "12개월초과"], ["45", "-", "55"]),
        (["3개월~6개월", "1년~2년"], ["30", "70"]),
        (["3년이내"], ["100"]),
        (DUE, ["-"] * 6),
        (DUE, ["-", "-", "-", "-", "100", "-"]),
    )
    assert (joined["m3"], joined["m6"], joined["m12"], joined["due_within_12m"], joined["note"]) == (None, None, None, 45 * M, "DUE_NOT_SPLIT")
    assert (sparse["m3"], sparse["m6"], sparse["y2"], sparse["due_within_12m"], sparse["note"]) == (None, 30 * M, 70 * M, 30 * M, None)
    assert (across["due_within_12m"], across["note"]) == (None, "DUE_UNREAD")
    assert (empty["due_within_12m"], empty["note"]) == (None, "DUE_EMPTY")
    assert later["due_within_12m"] == 0


def test_one_scope_without_due_columns_leaves_all_unknown(spark):
    sole = summary([["기타사업", "본PF", "100", "100", "100", "5", "95", "-"]], ["만기경과", "1년이내"])
    share = summary([["기타사업", "본PF", "50", "50", "50", "50", "-"]], ["1~2년"])
    _, (r,) = read(spark, f"<p>단독사업</p>{sole}<p>컨소시엄 참여사업(당사분)</p>{share}")
    assert (r["guarantee"], r["due_within_12m"], r["note"]) == (150 * M, None, "DUE_UNREAD")


def test_scopes_of_rows_and_subtotals(spark):
    names = ["3개월~6개월", "1년~2년"]
    whole = ["컨소시엄 전체분", "본PF", "100", "90", "90", "30", "60", "-"]
    own = ["당사분", "본PF", "40", "30", "30", "10", "20", "-"]
    alone = ["기타사업", "본PF", "70", "60", "60", "-", "60", "-"]
    _, (mixed, sub, second) = read(
        spark,
        "<p>단독사업</p>" + summary([alone, whole, own, [("합계", 'colspan="2"'), "210", "180", "180", "40", "140", "-"]], names),
        summary([alone, ["단독사업 계", "", "70", "60", "60", "-", "60", "-"]], names),
        summary([[("기타사업", 'rowspan="2"'), "본PF", "70", "60", "60", "-", "60", "-"], ["합 계", "70", "60", "60", "-", "60", "-"]], names),
    )
    assert (mixed["guarantee"], mixed["due_within_12m"]) == (90 * M, 10 * M)
    assert sub["guarantee"] == second["guarantee"] == 60 * M


def test_a_consortium_table_that_gives_the_companys_amounts(spark):
    section = f"<p>단독사업</p>{summary([A, B, SUM])}<p>&lt;컨소시엄 참여 사업(전체)&gt;</p>{summary([A], guarantee='보증금액(연결)')}"
    _, (r,) = read(spark, section)
    assert r["guarantee"] == 500 * M


def test_own_projects_and_separate_statements_are_left_out(spark):
    own = [["기타사업(주1)", *B[1:]] if k else A for k in (0, 1)]
    note = "<p>(주1) 기타사업은 당사가 시행하는 자체 사업으로 당사가 차주입니다.</p>"
    _, (r, first) = read(spark, summary([*own, SUM]) + note, f"<p>단독사업</p>{summary([A, B, SUM])}<p>■ 회사의 그 밖의 우발채무 등</p><p>단독사업</p>{summary([A, A, SUM])}")
    assert (r["guarantee"], r["balance"], r["due_within_12m"], r["bridge_guarantee"], r["note"]) == (200 * M, 180 * M, 60 * M, None, "OWN_PROJECTS_OFF")
    assert first["guarantee"] == 300 * M


def test_units_and_nothing_to_read(spark):
    old = "<table><tr><td>채무자</td><td>금액</td></tr><tr><td>1</td><td>2</td></tr></table>"
    _, out = read(spark, summary([A, B, SUM], unit="(단위 : 천원, 1 USD)"), "<p>PF와 관련하여 제공한 신용보강은 없습니다.</p>", "<p>해당사항 없음</p>", old, None, "")
    assert out[0]["guarantee"] == 300_000
    assert [r["status"] for r in out] == ["PARSED", "NONE", "NONE", "NO_STANDARD", "NO_STANDARD", "NO_STANDARD"]


def test_a_table_beyond_the_caps_is_left_out(spark):
    wide = "<table><tr>" + '<td colspan="1000">x</td>' * 3 + "</tr></table>"
    _, (r,) = read(spark, wide + summary([A, B, SUM]))
    assert r["guarantee"] == 300 * M


@pytest.mark.parametrize(
    ("text", "index", "want"),
    [
        ("단독사업 외 컨소시엄참여사업은 없습니다. 기타사업과 관련한 내역은 아래와 같습니다", 0, "SOLE"),
        ("② 컨소시엄 참여사업(전체분)", 1, "CONSORTIUM_ALL"),
        ("③ 컨소시엄 참여사업(연결회사분)", 2, "CONSORTIUM_SHARE"),
        ("이 중 단독 사업은 1백만원 컨소시움 참여 사업(전체)", 0, "CONSORTIUM_ALL"),
        ("", 1, "CONSORTIUM_ALL"),
        ("", 3, "CONSORTIUM_SHARE"),
    ],
)
def test_scope_of(spark, text, index, want):
    assert spark.range(1).select(pf.scope_of(F.lit(text), F.lit(index))).first()[0] == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("(*) 특수관계자에 대한 보증이 포함되어 있습니다. 3) 세부 내역 ① 정비사업", False),
        ("기타사업 관련 특수관계자에게 제공한 PF대출보증 내역은 아래와 같습니다.", True),
        ("중도금대출 및 SOC 관련 사항은 포함하지 않았습니다. (단위 : 백만원)", False),
        ("(4) 부동산 PF의 SOC 보증", True),
        ("책임준공 약정 현황은 다음과 같습니다", True),
    ],
)
def test_part_of_others(spark, text, want):
    assert spark.range(1).select(pf.part_of_others(F.lit(text))).first()[0] is want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("PF와 관련하여 보증금액 기준 총 2,000백만원(전기말: 3,000백만원)의 신용보강을 제공", 2_000 * M),
        ("프로젝트 파이낸싱(이하 'PF')과 관련한 총 1,623백만원의 신용보강", 1_623 * M),
        ("PF(대출)과 관련하여 14천원의 신용을 보강", 14_000),
        ("PF와 관련하여 제공한 신용보강은 없으며, 전기말 55,000백만원의 신용보강을 제공하였습니다.", None),
    ],
)
def test_stated_total(spark, text, want):
    assert spark.range(1).select(pf.stated_total(F.lit("".join(text.split())))).first()[0] == want
