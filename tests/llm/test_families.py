"""Documents made from one form, whose posting lists are long."""

import random

import pytest

from tests.llm import brute
from tidewatch.llm import jaccard_join


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_variants_of_one_form(spark, monkeypatch, seed):
    """Variants above and below the threshold, by words replaced, dropped and added; lists count as long from 3 on."""
    monkeypatch.setattr(jaccard_join, "SHORT_LIST", 2)
    draw = random.Random(seed)
    base = [f"w{draw.randrange(900)}" for _ in range(150)]
    rows = []
    for doc in range(120):
        words = list(base)
        for at in sorted(draw.sample(range(len(words)), draw.randrange(9)), reverse=True):
            kind = draw.randrange(4)
            if kind < 2:
                words[at] = f"r{draw.randrange(2)}"
            elif kind == 2:
                del words[at]
            else:
                words.insert(at, f"r{draw.randrange(2)}")
        rows.append((doc, " ".join(words[draw.randrange(12) :])))
    rows += [(200 + k, rows[k][1]) for k in range(20)]
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.cluster(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == brute.jaccard(rows)
    assert len({c for _, c in found.values()}) > 1
