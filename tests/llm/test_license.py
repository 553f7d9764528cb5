"""License scans against plain versions, and licenses planted in prose."""

import random
from collections import defaultdict

import pytest

from tests.llm import brute
from tidewatch.llm import common, license_scan

SF = "/root/testdata/sf0.001"
PROSE = "morning river stone walked under bright windows while several people were talking about the harvest".split()


def prose(n, seed):
    return random.Random(seed).choices(PROSE, k=n)


def found(text):
    return {name: share for name, share, *_ in license_scan.Scanner(license_scan.TEMPLATES, license_scan.COVERAGE).scan(text)}


def test_longest_rising_and_alignment_equal_plain_ones():
    rng = random.Random(8)
    for _ in range(300):
        b = rng.sample(range(12), 12)
        pairs = list(enumerate(b))
        best = [1] * 12
        for i in range(12):
            best[i] = 1 + max((best[k] for k in range(i) if b[k] < b[i]), default=0)
        got = license_scan.longest_rising(pairs)
        assert len(got) == max(best) and all(p < q for p, q in zip([j for _, j in got], [j for _, j in got][1:]))
    for _ in range(300):
        a, b = ([rng.choice("abcdefghijklmnopq") for _ in range(rng.randint(0, 20))] for _ in range(2))
        got = license_scan.align(a, b)
        assert len(got) == len(brute.patience(a, b))
        assert license_scan.in_runs(got, 2) == brute.in_runs(got)


@pytest.mark.parametrize("name", sorted(license_scan.TEMPLATES))
def test_planted(name):
    template = license_scan.TEMPLATES[name].split()
    around = lambda words: " ".join([*prose(300, 1), *words, *prose(900, 2)])
    assert found(around(template))[name] == 1
    assert found(around([*template, *prose(40, 3), *template]))[name] == 1
    if len(template) < 20:
        return
    damaged = [w for i, w in enumerate(template) if i % 13 != 6]
    middle = len(template) // 2
    for words in (damaged, [*damaged, *damaged], [*template[:middle], *prose(700, 4), *template[middle:]]):
        assert found(around(words)).get(name, 0) >= license_scan.COVERAGE
    assert name not in found(around(template[: int(len(template) * 0.7)]))


def test_scattered_words_are_no_license():
    template = license_scan.TEMPLATES["mit"].split()
    assert not found(" ".join(x for w in template for x in [w, *prose(30, 5)]))
    assert license_scan.Scanner({"none": " - ", "one": "copyleft"}, 0.8).scan("all copyleft here") == [("one", 1.0, 1, 1)]


def test_whole_table(spark):
    docs = common.read(spark, SF, "documents")
    got = defaultdict(set)
    for r in license_scan.op10_license_scan(spark, SF).collect():
        got[r.doc_id].add(r.license)
    want = {r.doc_id: brute.licenses(r.text, license_scan.TEMPLATES) for r in docs.collect()}
    assert got == {d: names for d, names in want.items() if names} and got
