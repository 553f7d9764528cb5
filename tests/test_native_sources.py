"""Data sources that read in chunks, and a list of pages that resumes."""

import io
import json
import random
import tracemalloc
import zipfile

import pytest

from tidewatch.sources import native, readers

START, END = 'AASSOCNOTE="A-1"', 'AASSOCNOTE="A-2"'


def plain(data, most):
    """The section of a whole text."""
    at = data.find(START)
    if at < 0:
        return None
    begin = max(0, data.rfind("<TITLE", 0, at + 5))
    stop = data.find(END, at + len(START))
    if stop >= 0:
        title = data.rfind("<TITLE", begin, stop)
        stop = title if title > begin else stop
    return data[begin:][: (stop - begin if stop >= 0 else len(data))][:most]


@pytest.mark.parametrize("chunk", [1, 2, 7, 16, 1000])
def test_sections_in_chunks_of_any_size(chunk):
    draw = random.Random(chunk)
    for _ in range(200):
        parts = ["x" * draw.randrange(9), "<TITLE", "<TITLE>가", START, END, "<TIT", START[:-1], END[:5], "나다"]
        data = "".join(draw.choice(parts) for _ in range(draw.randrange(12)))
        most = draw.choice([10_000, 10_000, 30])
        raw, want = data.encode(), plain(data, 10_000)
        found, _ = native.section(io.BytesIO(raw), START.encode(), END.encode(), most, 1 << 20, chunk)
        if most == 10_000:
            assert (bytes(found.held).decode() if found.found else None) == want
        elif found.truncated:
            assert len(found.held) <= most


def test_a_section_far_into_a_large_file_is_found_in_little_memory():
    class Large(io.RawIOBase):
        """100 MB before a section, made as they are read; the marker lies across the border of two chunks."""

        def __init__(self):
            self.at, self.body = 0, b"<TITLE>one</TITLE> " + START.encode() + b" body " + b"<TITLE>two</TITLE>" + END.encode()
            self.front = (100 << 20) - 30

        def read(self, n):
            out = b"y" * max(0, min(n, self.front - self.at))
            rest = self.at + len(out) - self.front
            out += self.body[rest : rest + n - len(out)]
            self.at += len(out)
            return out

    tracemalloc.start()
    found, read = native.section(Large(), START.encode(), END.encode(), 4 << 20, 120 << 20, 1 << 20)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert bytes(found.held) == b"<TITLE>one</TITLE> " + START.encode() + b" body " and read > 100 << 20
    assert peak < 16 << 20
    with pytest.raises(ValueError, match="no end"):
        native.section(Large(), START.encode(), END.encode(), 4 << 20, 50 << 20, 1 << 20)


def test_sections_of_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("one.xml", "nothing")
        z.writestr("two.xml", f"<TITLE>가 {START} 본문 <TITLE>{END}".encode("cp949"))
    (tmp_path / "b.zip").write_bytes(b"PK no archive")
    (tmp_path / "c.xml").write_text("y" * 3000 + START)
    native.register(spark)
    got = spark.read.format("tidewatch_sections").option("start", START).option("end", END).option("scan", 2000).option("chunk", 100).load(str(tmp_path)).collect()
    rows = {r.path[-5:]: (r.entry, r.section, r.error is not None) for r in got}
    assert rows["a.zip"] == ("two.xml", f"<TITLE>가 {START} 본문 ".encode("cp949"), False)
    assert rows["b.zip"] == (None, None, True) and rows["c.xml"] == (None, None, True)
    assert {r.path[-5:]: r.section for r in readers.sections(spark, str(tmp_path), START, END, scan=2000, chunk=100).collect()} == {"a.zip": f"<TITLE>가 {START} 본문 ", "b.zip": None, "c.xml": None}


def codes(n):
    return ("<?xml version='1.0' encoding='UTF-8'?><result>" + "".join(f"<list><corp_code>{i:08d}</corp_code><corp_name> 가나 {i} &amp; 다 </corp_name><stock_code> </stock_code><modify_date>20260{1 + i % 9}01</modify_date><other>x</other></list>" for i in range(n)) + "</result>").encode()


def test_companies_from_their_archive(spark, tmp_path):
    n = 119_447
    with zipfile.ZipFile(tmp_path / "codes.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("CORPCODE.xml", codes(n))
    got = readers.companies(spark, str(tmp_path))
    assert got.count() == n and got.select("corp_code").distinct().count() == n
    r = got.where("corp_code = '00000007'").first()
    assert (r.corp_name, r.stock_code, str(r.modify_date)) == ("가나 7 & 다", None, "2026-08-01")


def test_records_come_one_by_one_in_flat_memory():
    peaks = []
    for n in (2_000, 40_000):
        data = io.BytesIO(codes(n))
        tracemalloc.start()
        assert sum(1 for _ in native.records(data, "list", ["corp_code", "corp_name"])) == n
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 2 * peaks[0] + (1 << 20)


def test_document_types_are_refused():
    bomb = b'<!DOCTYPE r [<!ENTITY a "x">]><r><list><corp_code>&a;</corp_code></list></r>'
    with pytest.raises(ValueError, match="document type"):
        list(native.records(io.BytesIO(bomb), "list", ["corp_code"]))


def test_a_list_is_taken_by_pages_up_to_a_quota_and_goes_on(spark, tmp_path):
    (tmp_path / "pages").mkdir()

    def land(number, total, *receipts):
        rows = [{"rcept_no": f"{r:04d}", "report_nm": f"report {r}"} for r in receipts]
        (tmp_path / "pages" / f"{number}.json").write_text(json.dumps({"page_no": number, "total_page": total, "list": rows}))

    def run(quota=2):
        rows = native.listed(spark, str(tmp_path / "pages"), "rcept_no string, report_nm string", quota=quota)
        q = rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(once=True).start()
        q.awaitTermination()
        return sorted(r.rcept_no for r in spark.read.schema("rcept_no string, report_nm string").parquet(str(tmp_path / "out")).collect())

    names = lambda n: [f"{r:04d}" for r in range(1, n + 1)]
    land(1, 3, 1, 2, 3)
    land(2, 3, 4, 5, 6)
    land(3, 3, 7)
    assert run() == names(6)  # the quota ends the first run
    assert run() == names(7)
    assert run() == names(7)
    land(3, 4, 7, 8, 9)  # the list grew: the page that was not full, and a new one
    land(4, 4, 10)
    assert run(quota=100) == names(10)


def test_a_repeated_batch_names_the_same_pages(tmp_path):
    for n, rows in ((1, "ab"), (2, "cd")):
        (tmp_path / f"{n}.json").write_text(json.dumps({"total_page": 2, "list": [{"k": x} for x in rows]}))
    reader = native.PageReader({"path": str(tmp_path), "key": "k", "quota": "10"})
    rows, end = reader.read({"page": 1, "last": "a"})
    assert list(rows) == [(1, "a", None), (2, "", "d")] and end == {"page": 2, "last": "d"}
    (tmp_path / "2.json").write_text(json.dumps({"total_page": 2, "list": [{"k": x} for x in "cdef"]}))
    assert list(reader.readBetweenOffsets({"page": 1, "last": "a"}, end)) == [(1, "a", None), (2, "", "d")]
    assert list(reader.read(end)[0]) == [(2, "d", "f")]
