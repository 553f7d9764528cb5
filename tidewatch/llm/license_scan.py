"""License scans by patience alignment.

Words that occur once in the text and once in the template are anchors; the longest run of anchors in the
same order on both sides is kept, and the gaps between them are aligned in the same way. What share of
the template's words is matched, in runs of neighbours, is its coverage. A text is aligned as a whole, so
that words put in between do no harm, and stretch by stretch, so that a license that it holds twice, or
whose words it has elsewhere too, still has its anchors.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import common
from tidewatch.llm.license_texts import TEMPLATES

COVERAGE = 0.8
#: Matched words count in runs of so many at least, so that words scattered over a long text make no license.
RUN = 2
WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """Lower-case words without punctuation."""
    return WORD.findall(text.lower())


def align(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Matched places (in the text, in the template), ascending in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == template[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a == b or c == d:
            continue
        once = [{w for w, n in Counter(x).items() if n == 1} for x in (text[a:b], template[c:d])]
        both = once[0] & once[1]
        where = {w: i for i, w in enumerate(template[c:d], c) if w in both}
        anchors = longest_rising([(i, where[w]) for i, w in enumerate(text[a:b], a) if w in both])
        if not anchors:
            continue
        out += anchors
        for (i, j), (k, m) in zip([(a - 1, c - 1), *anchors], [*anchors, (b, d)], strict=True):
            todo.append((i + 1, k, j + 1, m))
    return sorted(out)


def in_runs(matched: list[tuple[int, int]], least: int) -> list[tuple[int, int]]:
    """Those matched places that are part of a run of neighbours on both sides, of some length at least."""
    out, run = [], []
    for pair in [*matched, None]:
        if run and pair != (run[-1][0] + 1, run[-1][1] + 1):
            out += run if len(run) >= least else []
            run = []
        if pair:
            run.append(pair)
    return out


def longest_rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence in which the second place rises too."""
    ends: list[int] = []
    last: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(ends, j)
        back[k] = last[at - 1] if at else -1
        ends[at : at + 1] = [j]
        last[at : at + 1] = [k]
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


class Scanner:
    """Templates, and for each the words of which a text that covers it must have one."""

    def __init__(self, templates: dict[str, str], coverage: float):
        self.coverage = coverage
        self.templates = {name: w for name, t in sorted(templates.items()) if (w := words(t))}
        self.counts = {name: Counter(t) for name, t in self.templates.items()}
        self.enough = {name: self.least(t) for name, t in self.templates.items()}
        self.needed: dict[str, set[str]] = {}
        for name, t in self.templates.items():
            # so many places may stay unmatched; whoever lacks every place of more words than that has too little
            spare, taken, places = len(t) - self.enough[name], set(), 0
            for w in sorted({*t}, key=lambda w: (-len(w), w)):
                if places > spare:
                    break
                taken.add(w)
                places += t.count(w)
            self.needed[name] = taken
        self.hints = sorted(set().union(*self.needed.values()))

    def least(self, template: list[str]) -> int:
        """Matched words that make the coverage."""
        n = 0
        while n < len(template) and n / len(template) < self.coverage:
            n += 1
        return n

    def scan(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """(template, coverage, first word, last word) of each template's best match that covers enough of it."""
        low = (text or "").lower()
        if not any(h in low for h in self.hints):
            return []
        have = WORD.findall(low)
        counts = Counter(have)
        found = []
        for name, template in self.templates.items():
            if sum(min(n, counts[w]) for w, n in self.counts[name].items()) < self.enough[name]:
                continue
            best = None
            for start, end in self.stretches(name, have):
                matched = in_runs(align(have[start:end], template), min(RUN, len(template)))
                if matched and len(matched) >= self.enough[name] and (best is None or len(matched) > best[0]):
                    best = len(matched), start + matched[0][0], start + matched[-1][0]
                    if best[0] == len(template):
                        break
            if best:
                found.append((name, best[0] / len(template), best[1], best[2]))
        return found

    def stretches(self, name: str, have: list[str]) -> list[tuple[int, int]]:
        """Parts of a text to align: around each place of a word that a match cannot do without, and then the whole."""
        template = self.templates[name]
        n, slack = len(template), len(template) // 4 + 1
        offsets: dict[str, list[int]] = {}
        for k, w in enumerate(template):
            if w in self.needed[name]:
                offsets.setdefault(w, []).append(k)
        starts = {max(0, i - k - slack) for i, w in enumerate(have) for k in offsets.get(w, ())}
        return [*((a, min(a + n + 2 * slack, len(have))) for a in sorted(starts)), (0, len(have))]


def scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, license, coverage, first_word, last_word): a row for each template that a text covers enough of.

    Whole texts are aligned, and so is, around each place of a word that a sufficient match cannot do
    without, a stretch as long as the template and a half; the best match counts. Null and empty texts
    match nothing, nor does a template without words. Repeated rows give repeated rows; a null doc_id
    stays null; of equal matches the first one counts. Empty tables give no rows and other columns are
    ignored.
    """
    common.prepare(docs.sparkSession)
    scanner = Scanner(templates or TEMPLATES, coverage)

    def run(batches):
        for batch in batches:
            rows = [(d, *f) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for f in scanner.scan(t)]
            kinds = [pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["doc_id", "license", "coverage", "first_word", "last_word"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, license string, coverage double, first_word long, last_word long")


def op10_license_scan(spark, sf_dir: str) -> DataFrame:
    """All documents scanned for license notices."""
    return scan(common.read(spark, sf_dir, "documents"))
