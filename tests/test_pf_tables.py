"""A table is one row until its lines are read."""

import random

from tidewatch.operators import filings, pf_exposure


def test_a_table_is_one_row_of_blocks(spark):
    html = "<p>a</p><table><tr><th>x</th><th>y</th></tr><tr><td>1</td><td> 2  3 </td></tr><tr><td>4</td></tr></table><table><tr><td>only</td></tr></table>"
    got = pf_exposure.blocks(spark.createDataFrame([(7, html), (8, None)], "k long, html string"), "k", "html").orderBy("k", "block_no").collect()
    assert [tuple(r) for r in got] == [
        (7, -1, False, "axy1234only", None), (7, 0, False, "a", None), (7, 1, True, None, [["x", "y"], ["1", "2 3"], ["4", None]]), (7, 2, False, "only", None), (8, -1, False, "", None),
    ]


def test_rows_below_the_last_span_need_no_expansion():
    draw = random.Random(3)
    for n in range(300):
        rows = [[[f" {r} {j} ", *((draw.randrange(1, 4), draw.randrange(1, 3)) if r < n % 4 else (1, 1)), False] for j in range(draw.randrange(4))] for r in range(draw.randrange(7))]
        assert pf_exposure._grid(rows) == [[c and c[0] for c in row] for row in filings._expand(rows)]
    assert pf_exposure._grid([[["x", 1, 1, False]] * (filings.MOST_COLUMNS + 1)] * 2) == []
