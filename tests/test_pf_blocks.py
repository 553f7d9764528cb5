"""Sections are read once and what holds for a table is worked out once."""

from tidewatch import plans
from tidewatch.operators import pf_exposure

PLAIN = "<p>총 <b>3</b> 백만원</p>tail<table class='a b'><tr><th rowspan='2' colspan=\"2\">x</th><td>1 > 0</td></tr><tr><td> y </td></tr></table><p>open<table><tr><td>only</td></tr></table> end"
OTHERS = ["", PLAIN.upper(), PLAIN + "&amp;", "<!-- <p>no</p> -->" + PLAIN, "<td>a < b</td>" + PLAIN, "<p a=1>x</p><br/>" + PLAIN, PLAIN + "<table", PLAIN + "<script>if (a<b) '<p>'</script>"]


def test_plain_tags_are_split_like_the_parser_reads_them():
    for html in [PLAIN, PLAIN * 3, *OTHERS]:
        quick, slow = pf_exposure._Blocks(), pf_exposure._Blocks()
        quick.read(html)
        slow.feed(html)
        slow.close()
        for x in (quick, slow):
            x.end_paragraph()
        assert (quick.blocks, quick.tables, "".join(quick.words)) == (slow.blocks, slow.tables, "".join(slow.words)), html


def test_a_table_is_judged_on_one_row(spark):
    df = plans.queries()["pf_sites"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().analyzed().toString()
    assert all(f"first({x}#" in plan for x in ("_names", "role", "_about", "_at", "_due", "_listed"))
