"""Project-finance exposure tables of filings: summaries by scope, sites, due buckets and two reconciliations.

Python reads a section once, into paragraphs and its outermost tables with spans repeated. All else is ordered windows: over the blocks, where
headings become column names, names become roles and the text before a table tells its scope, and then over the tables' lines, whose sums
tell whether due columns may be believed. Lines carry values, not the texts and names they come from. Everything of a document stays in one
partition, dealt once by its key.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators.filings import INPUT_CLASS, MOST_CELLS, MOST_COLUMNS, _expand, _Tables, number
from tidewatch.session import ship

#: Whose share a summary covers. A company's own exposure is SOLE and CONSORTIUM_SHARE.
SOLE, ALL, SHARE = "SOLE", "CONSORTIUM_ALL", "CONSORTIUM_SHARE"
#: What a cell says that gives its row a scope of its own. Fixed values.
ALL_CELLS = ["전체", "전체분", "컨소시엄전체", "컨소시엄전체분"]
SHARE_CELLS = ["당사분", "회사분", "연결회사분", "연결분", "지분", "부담분"]
#: Names that the columns of a summary and of a table of sites have among them. Fixed values.
SUMMARY_NAMES, SITE_NAMES = ["구분", "종류", "보증한도", "보증금액", "대출잔액"], ["사업지역", "신용보강", "보증금액"]
#: How a table of guarantees for related parties is announced, how one of completion commitments, and what says that a text leaves something out. Fixed values.
RELATED = ["특수관계자에게", "특수관계자에대한", "특수관계자의채무", "특수관계자에제공"]
COMPLETION = ["약정세부", "약정현황"]
LEFT_OUT = ["제외", "미포함", "불포함", "포함하지않", "포함되지않"]
#: What a cell of a row that is no site has among its words, whose amounts a column gives, and how a text says that there is nothing. Fixed values.
NO_SITE = ["조기상환조항", "기타사항", "소계", "합계", "단독사업계", "컨소시엄계"]
OWN_AMOUNTS = ["연결", "당사", "회사"]
NOTHING = ["없습니다", "없음", "제공하지않"]
#: Longest label of a sum.
SUM_LABEL = 21
#: The standard due buckets in months from now; the last one is open.
OPEN = 2**31 - 1
BUCKETS = {"m3": (0, 3), "m6": (3, 6), "m12": (6, 12), "y2": (12, 24), "y3": (24, 36), "over3": (36, OPEN)}
#: How far sums may be from what is stated, as a share of it.
TOLERANCE = 0.01
MONEY = "decimal(30,2)"
_TOTALS = ["limit", "guarantee", "balance", "prior", *BUCKETS, "w12"]


#: A tag of those that tables and texts are made of, with quoted attributes; whatever else begins with < is left to the parser.
_TAG = re.compile(r"""<(/?)(table|thead|tbody|tr|th|td|tu|te|p|span|div|br|b)((?: [a-z]+=(?:'[^'<>]*'|"[^"<>]*"))*)>""")
_ATTRIBUTE = re.compile(r"""([a-z]+)=(?:'([^']*)'|"([^"]*)")""")
#: A table of cells with such attributes and nothing else in them than text.
_ATTRIBUTES = r"""(?: [a-z]+=(?:'[^'<>]*'|"[^"<>]*"))*"""
_PLAIN_TABLE = re.compile(rf"<table{_ATTRIBUTES}>((?:<tr>(?:<t[hd]{_ATTRIBUTES}>[^<]*</t[hd]>)*+</tr>)*+)</table>")
_PLAIN_CELL = re.compile(rf"<t[hd]({_ATTRIBUTES})>([^<]*)<")
#: Documents whose blocks Python holds at a time.
_DOCUMENTS = 500


class _Blocks(_Tables):
    """Paragraphs outside tables and outermost tables, in order, and all of the text."""

    def __init__(self):
        super().__init__()
        self.blocks: list[tuple[str | None, int]] = []
        self.words: list[str] = []
        self.paragraph: list[str] | None = None

    def read(self, html: str) -> None:
        """All of a document; one of plain lower-case tags alone is split at them instead of parsed."""
        parts = _PLAIN_TABLE.split(html)
        outside = [_TAG.split(part) for part in parts[::2]]
        if "&" in html or any("<" in text for tags in outside for text in tags[::4]):
            self.feed(html)
            self.close()
            return
        for tags, rows in zip(outside, [*parts[1::2], None], strict=True):
            self.tags(tags)
            if rows is None:
                break
            if self.open:
                self.tags(_TAG.split(f"<table>{rows}</table>"))
                continue
            self.end_paragraph()
            self.blocks.append((None, len(self.tables)))
            found = [_PLAIN_CELL.findall(row) for row in rows.split("</tr>")[:-1]]
            self.words += [text for row in found for _, text in row]
            self.tables.append([[_plain_cell(attrs, text) for attrs, text in row] for row in found])

    def tags(self, parts: list[str]) -> None:
        """What ``_TAG`` splits a text into."""
        for text, end, tag, attrs in zip(parts[::4], parts[1::4], parts[2::4], parts[3::4]):  # noqa: B905  the text behind the last tag comes after
            if text:
                self.handle_data(text)
            if end:
                self.handle_endtag(tag)
            else:
                self.handle_starttag(tag, _read(attrs))
        if parts[-1]:
            self.handle_data(parts[-1])

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.end_paragraph()
            if not self.open:
                self.blocks.append((None, len(self.tables)))
        elif tag == "p" and not self.open:
            self.end_paragraph()
            self.paragraph = []
        super().handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag == "p":
            self.end_paragraph()
        super().handle_endtag(tag)

    def handle_data(self, data):
        self.words.append(data)
        if self.paragraph is not None:
            self.paragraph.append(data)
        super().handle_data(data)

    def end_paragraph(self):
        if self.paragraph is not None:
            self.blocks.append((" ".join("".join(self.paragraph).split()), -1))
        self.paragraph = None


def _read(attrs: str) -> list[tuple[str, str]]:
    return [(name, a or b) for name, a, b in _ATTRIBUTE.findall(attrs)] if attrs else []


def _plain_cell(attrs: str, text: str) -> list:
    """As ``_Tables`` has it."""
    if not attrs:
        return [text, 1, 1, False]
    have = dict(_read(attrs))
    span = [max(1, int(v)) if (v := have.get(k) or "").isdigit() else 1 for k in ("rowspan", "colspan")]
    return [text, *span, INPUT_CLASS in (have.get("class") or "").split()]


def _grid(rows: list[list[list]]) -> list[list[str | None]]:
    """The texts of a table's places; nothing beyond the caps. Only the rows down to where the last span ends are expanded place by place."""
    n, cells = 0, 0
    for r, row in enumerate(rows):
        for _, down, across, _ in row:
            if down > 1 or across > 1:
                down = min(down, len(rows) - r)
                n = max(n, r + down)
            cells += down * across
    top = _expand(rows[:n])
    if top is None or cells > MOST_CELLS or any(len(row) > MOST_COLUMNS for row in rows[n:]):
        return []
    grid = [[c and c[0] for c in row] for row in top] + [[" ".join(c[0].split()) for c in row] for row in rows[n:]]
    width = max(map(len, grid), default=0)
    return [row + [None] * (width - len(row)) for row in grid]


def blocks(documents: DataFrame, key: str, html: str) -> DataFrame:
    """(key, block_no, big, text, grid): block -1 is the whole text without blanks, then come paragraphs and tables, one row each.

    ``big`` marks tables of two rows or more, ``grid`` has their cells; a table of one row is a text, one beyond the caps is left out. Null
    and empty documents have block -1 alone.
    """
    ship(documents.sparkSession)
    kind = dict(documents.dtypes)[key]

    def read(batch):
        at, number_, texts, grids = [], [], [], []
        for i, h in enumerate(batch.column(1).to_pylist()):
            parser = _Blocks()
            parser.read(h or "")
            parser.end_paragraph()
            found = [(-1, "".join("".join(parser.words).split()), None)]
            for b, (text, t) in enumerate(parser.blocks):
                rows = _grid(parser.tables[t]) if text is None else None
                if rows and len(rows) == 1:
                    text, rows = " ".join(filter(None, rows[0])), None
                if rows or text is not None:
                    found.append((b, text, rows))
            at += [i] * len(found)
            for column, values in zip((number_, texts, grids), zip(*found, strict=True), strict=True):
                column += values
        columns = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(number_, pa.int32()), pa.array([g is not None for g in grids]), pa.array(texts, pa.string()), pa.array(grids, pa.list_(pa.list_(pa.string())))]
        return pa.RecordBatch.from_arrays(columns, [key, "block_no", "big", "text", "grid"])

    def run(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, _DOCUMENTS):
                yield read(batch.slice(first, _DOCUMENTS))

    return documents.select(key, html).mapInArrow(run, f"`{key}` {kind}, block_no int, big boolean, text string, grid array<array<string>>")


def squeezed(text: Column) -> Column:
    """A text without blanks and note marks; null is empty."""
    bare = F.translate(text, " \t\n\u000b\f\r\u00a0", "")
    return F.when(text.contains("*"), F.regexp_replace(bare, r"\(\*\d*\)", "")).otherwise(F.coalesce(bare, F.lit("")))


def _any(text: Column, words: list[str]) -> Column:
    """Whether a text has one of the words."""
    return reduce(or_, [text.contains(w) for w in words])


def _is_sum(label: Column) -> Column:
    """Whether a label, what is in brackets aside, is a short one that ends in the word for a sum."""
    bare = F.regexp_replace(label, r"\(.*", "")
    return bare.endswith("계") & (F.length(bare) <= SUM_LABEL)


def unit(text: Column) -> Column:
    """How many won the unit in a text stands for; millions where none is named."""
    named = F.regexp_extract(text, "단위[^)]*?(백만원|천원|억원|원)", 1)
    return F.when(named == "원", 1).when(named == "천원", 1_000).when(named == "억원", 100_000_000).otherwise(1_000_000).cast("decimal(9,0)")


def scope_of(text: Column, index: Column) -> Column:
    """The scope that the last words before a table name; else the first table is SOLE, the second ALL, the others SHARE."""
    flat = F.regexp_replace(F.regexp_replace(text, r"\s+", ""), "컨소시움", "컨소시엄")
    flat = F.regexp_replace(flat, "컨소시엄[가-힣]{0,14}없", "")
    tail = F.right(flat, F.lit(60))
    last, after = (F.regexp_extract(tail, "(?s).*(단독|컨소시엄)(.*)$", i) for i in (1, 2))
    own = after.rlike("회사분|당사분|지분|부담분") | ~after.contains("전체")
    by_place = F.when(index == 0, SOLE).when(index == 1, ALL).otherwise(SHARE)
    return F.when(last == "단독", SOLE).when((last != "") & own, SHARE).when((last != "") | tail.contains("전체"), ALL).otherwise(by_place)


def part_of_others(text: Column) -> Column:
    """Whether the words before a table say that it repeats a part of others (related parties), or is of another kind (infrastructure, completion)."""
    flat = F.regexp_replace(text, r"\s+", "")
    # a note that related parties are contained in the table above is no heading
    related = F.exists(F.split(F.right(flat, F.lit(200)), "[.]"), lambda x: _any(x, RELATED) & ~x.contains("포함"))
    near = F.right(flat, F.lit(150))
    outside = near.contains("SOC") & ~_any(near, LEFT_OUT)
    return related | outside | (near.contains("책임준공") & _any(near, COMPLETION))


def stated_total(flat: Column) -> Column:
    """The amount of credit enhancement that a text without blanks names for now, in won; null if it names none or the year before's alone."""
    pattern = F.lit("PF[^0-9전없]{0,30}?([0-9][0-9,]*)(백만원|천원|억원|원)(?:[(]전기[^)]*[)])?의신용(?:을)?보강")
    found = F.regexp_extract_all(flat, pattern, 1), F.regexp_extract_all(flat, pattern, 2)
    return (number(F.get(found[0], F.lit(0))) * unit(F.concat(F.lit("단위"), F.get(found[1], F.lit(0))))).cast(MONEY)


def due_columns(names: Column, first: Column) -> Column:
    """(i, lo, hi, named) of the columns from ``first`` on whose name is a time to maturity, lo and hi in months.

    "Up to" begins where the column before ends; ``named`` tells that both ends are written. hi is null where a name cannot be read.
    """
    segment = lambda name: F.element_at(F.filter(F.split(name, r"\|"), lambda s: s.rlike("[0-9](개월|월|년)")), -1)
    pattern = F.lit("([0-9]+)(개월|월|년)?")
    # one step after another, as each names what it is given more than once
    found = F.filter(F.transform(names, lambda name, i: F.when((i >= first) & name.rlike("[0-9](개월|월|년)"), F.struct(i.alias("i"), segment(name).alias("s")))), lambda x: x.isNotNull())
    found = F.transform(found, lambda x: F.struct(x["i"].alias("i"), x["s"].alias("s"), F.regexp_extract_all(x["s"], pattern, 1).alias("n"), F.regexp_extract_all(x["s"], pattern, 2).alias("u")))

    def read(x: Column) -> Column:
        s, n, u = x["s"], x["n"], x["u"]
        months = lambda k: F.get(n, F.lit(k)).cast("int") * F.when(F.coalesce(F.nullif(F.get(u, F.lit(k)), F.lit("")), F.get(u, F.lit(1))) == "년", 12).otherwise(1)
        two = (F.size(n) == 2) & s.rlike("초과|~|∼")
        upto, over = (F.size(n) == 1) & s.rlike("(이내|이하|미만)$"), (F.size(n) == 1) & s.rlike("(초과|이상)$")
        hi = F.when(two, months(1)).when(upto, months(0)).when(over, OPEN)
        return F.struct(x["i"].alias("i"), F.when(two | over, months(0)).alias("lo"), hi.alias("hi"), two.alias("named"))

    read_all = F.transform(found, read)
    before = lambda i: F.when(i == 0, 0).otherwise(F.get(read_all["hi"], i - 1))
    return F.transform(read_all, lambda x, i: F.struct(x["i"].alias("i"), F.coalesce(x["lo"], before(i)).alias("lo"), x["hi"].alias("hi"), x["named"].alias("named")))


def _first(names: Column, test) -> Column:
    """Place of the first name that passes; null if none does."""
    return F.get(F.filter(F.transform(names, lambda x, i: F.when(test(x), i)), lambda i: i.isNotNull()), F.lit(0))


def _cell(i: Column) -> Column:
    """The row's cell at a place; blanks and a lone dash are null."""
    text = F.trim(F.get("cells", i))
    return F.when((text != "") & (text != "-"), text)


def lines(documents: DataFrame, key: str, html: str) -> DataFrame:
    """What tables say, a row for each of their lines that counts, and one TEXT row for each document.

    Columns: key, block_no, row_no, role (SUMMARY, SITE, UNREAD or TEXT); of summaries scope, category, pf_type, limit, guarantee,
    balance, prior, m3, m6, m12, y2, y3, over3, w12, dated, total; of sites category, region, pf_type, enhancement, debtor, related, guarantee,
    balance, prior, completion. ``dated`` tells that the table's due columns are read; w12 is what is due in twelve months
    where its columns are not the standard ones. Amounts are in won. A summary of the separate statements that follows one of the
    consolidated statements, and sites that are listed again, are left out.
    """
    return _valued(_tables(blocks(documents, key, html).repartition(F.col(key)), key), key)


def _tables(rows: DataFrame, key: str) -> DataFrame:
    """(key, block_no, role, text, grid, _h, _names, _about, _at, _due): the text and each table with a role, what holds for a whole table worked out once."""
    c = F.col
    doc = Window.partitionBy(key).orderBy("block_no")
    before = doc.rangeBetween(Window.unboundedPreceding, -1)

    # headings: the first row below the top with two numbers or more ends them
    # a year, month or day, written in digits and dots
    dated = lambda x: x.rlike("^[0-9.]+$") & F.length(F.regexp_replace(x, "[.]", "")).between(4, 8)
    numeric = lambda x: F.translate(x, "(),%-", "").rlike(r"^[0-9]+(\.[0-9]+)?$") & ~dated(x)
    two = lambda row: F.size(F.filter(F.transform(row, squeezed), numeric)) >= 2
    # what comes behind the first such row is not looked at
    ends = F.aggregate(F.slice("grid", 2, F.size("grid")), F.struct(F.lit(0).alias("i"), F.lit(None).cast("int").alias("h")), lambda a, row: F.struct((a["i"] + 1).alias("i"), F.when(a["h"].isNotNull(), a["h"]).when(two(row), a["i"] + 1).alias("h")))
    rows = rows.withColumn("_h", ends["h"])
    rows = rows.withColumn("_heads", F.when(c("_h").isNotNull(), F.transform(F.slice("grid", F.lit(1), c("_h")), lambda row: F.transform(row, squeezed))))
    down = lambda i: F.filter(F.transform("_heads", lambda row: F.coalesce(F.get(row, i), F.lit(""))), lambda v: (v != "") & ~v.startswith("(단위"))
    distinct = lambda values: F.filter(F.transform(values, lambda v, k: F.when((k == 0) | (v != F.get(values, k - 1)), v)), lambda v: v.isNotNull())
    rows = rows.withColumn("_down", F.transform(F.get("_heads", F.lit(0)), lambda _, i: down(i)))
    rows = rows.withColumn("_names", F.transform("_down", lambda values: F.array_join(distinct(values), "|"))).drop("_heads", "_down")
    has = lambda words: F.forall(F.array(*map(F.lit, words)), lambda w: F.exists("_names", lambda n: n.contains(w)))
    site_like = has(SITE_NAMES)
    kind = F.when(has(SUMMARY_NAMES) & ~F.exists("_names", lambda n: n.contains("사업지역")), "SUMMARY").when(site_like & has(["대출잔액"]), "SITE").when(site_like, "UNREAD")
    rows = rows.withColumn("role", F.when(c("block_no") < 0, "TEXT").when(c("big"), kind))

    # a block of the separate statements ends what is read
    summaries = F.count_if(c("role") == "SUMMARY").over(before)
    rows = rows.withColumns({"_index": summaries, "_group": F.when(c("block_no") >= 0, F.count_if("big").over(before)).otherwise(-1)})
    rows = rows.withColumn("_ends", F.coalesce((c("_index") > 0) & ~c("big") & (c("block_no") >= 0) & F.regexp_replace("text", r"\s", "").contains("그밖의우발채무"), F.lit(False)))
    rows = rows.withColumn("_over", F.max("_ends").over(doc.rangeBetween(Window.unboundedPreceding, 0))).where("NOT _over")

    # what was written since the last table
    written = Window.partitionBy(key, "_group").orderBy("block_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("_said", F.collect_list(F.when(~c("big") & (c("block_no") >= 0), c("text"))).over(written))
    rows = rows.where("role IS NOT NULL").withColumn("_said", F.when(c("big"), F.array_join("_said", " ")))
    said = {
        "_unit": unit(F.concat_ws(" ", F.array_join(F.get("grid", F.lit(0)), " "), "_said")),
        "_scope": scope_of(c("_said"), c("_index")),
        "_other": part_of_others(c("_said")),
        "_kind": F.nullif(F.regexp_extract("_said", "(?s).*(정비사업|기타사업)", 1), F.lit("")),
    }
    rows = rows.withColumn("_about", F.when(c("big"), F.struct(*[x.alias(name) for name, x in said.items()]))).drop("_said")
    rows = rows.where("role != 'SITE' OR NOT _about._other")

    # roles of columns
    at = lambda test: _first(c("_names"), test)
    begins = lambda word: at(lambda n: n.startswith(word))
    balances = F.filter(F.transform("_names", lambda n, i: F.when(n.startswith("대출잔액") | n.contains("|대출잔액"), F.struct(i.alias("i"), n.rlike("[0-9]{1,2}(개월|월|년)").alias("due")))), lambda x: x.isNotNull())
    balances = F.filter(balances, lambda x: ~x["due"] | (c("role") == "SITE"))["i"]
    places = {
        "_limit": begins("보증한도"), "_guarantee": begins("보증금액"), "_balances": balances, "_overdue": at(lambda n: n.contains("만기경과")),
        "_region": begins("사업지역"), "_loan": begins("PF종류"), "_enhancement": begins("신용보강"), "_completion": begins("책임준공"),
        "_related": at(lambda n: n.startswith("채무자") & n.contains("특수관계")), "_debtor": at(lambda n: n.startswith("채무자") & ~n.contains("특수관계")),
    }
    rows = rows.withColumn("_at", F.when(c("big"), F.struct(*[x.alias(name) for name, x in places.items()])))
    taken = F.array(F.coalesce(_current(), F.lit(-1)), F.coalesce(_previous(), F.lit(-1)))
    columns = F.filter(due_columns(c("_names"), F.greatest(F.coalesce("_at._limit", F.lit(-1)), F.coalesce("_at._guarantee", F.lit(-1))) + 1), lambda x: ~F.array_contains(taken, x["i"]))
    rows = rows.withColumn("_due", F.when(c("role") == "SUMMARY", columns))
    # one row for each table, also where a key repeats
    return rows.groupBy(key, "block_no").agg(*[F.first(x, ignorenulls=True).alias(x) for x in ("role", "text", "grid", "_h", "_names", "_about", "_at", "_due")])


def _current() -> Column:
    return F.get("_at._balances", F.lit(0))


def _previous() -> Column:
    balances = F.col("_at._balances")
    return F.when(F.size(balances) > 1, F.when(F.col("role") == "SITE", F.get(balances, F.lit(1))).otherwise(F.element_at(balances, -1)))


def _valued(tables: DataFrame, key: str) -> DataFrame:
    """What the lines of ``_tables`` say.

    Columns that name both ends of the second and third bucket are taken as they are. Others ("up to ...") might be cumulative,
    or lack buckets: they are taken if they add up to the balance in every row that has one and nothing is overdue.
    """
    c = F.col
    summary, site = c("role") == "SUMMARY", c("role") == "SITE"
    table = Window.partitionBy(key, "block_no")

    # of each table
    within = lambda lo, hi: F.get(F.filter("_due", lambda x: (x["lo"] == lo) & (x["hi"] == hi)), F.lit(0))
    rising = F.forall(F.transform("_due", lambda x, i: (x["lo"] < x["hi"]) & ((x["lo"] >= 12) | (x["hi"] <= 12)) & ((i == 0) | (x["lo"] >= F.get(c("_due")["hi"], i - 1)))), lambda ok: F.coalesce(ok, F.lit(False)))
    # one table for the whole consortium whose heading says that the amounts are the company's
    named = F.regexp_replace(F.get("_names", c("_at._guarantee")), r"[()]", "")
    whose = reduce(or_, [named.startswith(f"보증금액{w}") for w in OWN_AMOUNTS])
    rows = tables.withColumns({
        "_place": F.struct(*[within(*months).alias(b) for b, months in BUCKETS.items()]), "_rising": (F.size("_due") > 0) & rising, "_whose": whose,
        "_labels": F.greatest(F.lit(1), F.coalesce("_at._limit", "_at._guarantee", F.lit(1))), "_current": _current(), "_previous": _previous(),
    })
    place = {b: c(f"_place.{b}") for b in BUCKETS}
    standard = place["m3"].isNotNull() & place["m6"].isNotNull() & place["m12"].isNotNull()
    rows = rows.withColumns({"_standard": standard, "_named": standard & place["m6"]["named"] & place["m12"]["named"]})
    numbered = F.slice(F.transform("grid", lambda row, i: F.struct(i.alias("row_no"), row.alias("cells"))), c("_h") + 1, F.size("grid"))
    kept = ["role", "text", "_about", "_at", "_due", "_place", "_rising", "_whose", "_labels", "_current", "_previous", "_standard", "_named"]
    rows = rows.select(key, "block_no", *kept, F.explode_outer(numbered).alias("_line"))
    rows = rows.select(key, "block_no", *kept, F.coalesce("_line.row_no", F.lit(0)).alias("row_no"), c("_line.cells").alias("cells"))

    # of each line; amounts are read once
    amounts = F.transform(_amounts(c("cells")), lambda x: (x * c("_about._unit")).cast(MONEY))
    rows = rows.withColumns({"_plain": F.transform("cells", squeezed), "_money": amounts})
    money = lambda i: F.get("_money", i)
    amounts = {"limit": money(c("_at._limit")), "guarantee": money(c("_at._guarantee")), "balance": money(c("_current")), "prior": money(c("_previous"))}
    nothing = F.lit(0).cast(MONEY)
    add = lambda which: F.aggregate(F.filter("_due", which), nothing, lambda a, x: (a + F.coalesce(money(x["i"]), nothing)).cast(MONEY))
    labels = F.slice("_plain", F.lit(1), c("_labels"))
    own = F.get(F.filter(labels, lambda x: x.isin(ALL_CELLS + SHARE_CELLS)), F.lit(0))
    first, second = (F.coalesce(F.get("_plain", F.lit(i)), F.lit("")) for i in (0, 1))
    first, second = (F.when(x == "-", "").otherwise(x) for x in (first, second))
    loan = F.get(F.filter(F.slice("cells", F.lit(2), F.greatest(F.lit(1), c("_labels") - 1)), lambda _, i: _any(F.get("_plain", i + 1), ["PF", "브릿지"])), F.lit(0))
    cell = lambda x: _cell(c(f"_at.{x}"))
    region, site_loan, related = cell("_region"), cell("_loan"), cell("_related")
    joined, where = F.array_join("_plain", ""), F.when(region.isNotNull(), F.get("_plain", c("_at._region"))).otherwise("")
    is_sum = _any(joined, NO_SITE) | (_is_sum(where) & (site_loan.isNull() | (squeezed(site_loan) == where)))
    usable = money(c("_at._guarantee")).isNotNull() & region.isNotNull() & ~F.translate(where, "(),%-", "").rlike(r"^[0-9]+(\.[0-9]+)?$")
    of_summary = lambda x: F.when(summary, x)
    of_site = lambda x: F.when(site, x)
    values = amounts | {
        "_all": of_summary(add(lambda x: F.lit(True))), "_w12": of_summary(F.when(~c("_standard"), add(lambda x: x["hi"] <= 12))), "_past": of_summary(money(c("_at._overdue"))),
        "scope": of_summary(F.when(own.isin(ALL_CELLS), ALL).when(own.isin(SHARE_CELLS), SHARE).otherwise(c("_about._scope"))), "_first": of_summary(first), "_second": of_summary(second),
        "pf_type": F.when(summary, F.coalesce(loan, _cell(F.lit(1)))).when(site, site_loan),
        "_site": of_site(usable & ~is_sum),
        "region": of_site(F.trim(F.regexp_replace(region, r"\((\*|주)\s*\d*\)", ""))), "enhancement": of_site(cell("_enhancement")), "debtor": of_site(cell("_debtor")),
        "related": of_site(F.when(related.isNotNull(), F.upper(related).isin("O", "○", "Y", "예", "해당"))), "completion": of_site(money(c("_at._completion"))),
    }
    due = {f"_{b}": money(place[b]["i"]) for b in BUCKETS}
    known = ["role", "text", "_standard", "_named", "_rising", "_whose"]
    rows = rows.select(key, "block_no", "row_no", *known, c("_about._scope").alias("_scope"), c("_about._kind").alias("_kind"), *[x.alias(name) for name, x in (values | due).items()])

    # of the lines of a table together
    total = F.coalesce(summary & c("_first").rlike("합계|총계"), F.lit(False))
    owed = F.coalesce(c("balance") != 0, F.lit(False))
    wrong = F.coalesce(c("_past") != 0, F.lit(False)) | (owed & (F.abs(c("_all") - c("balance")) > F.abs("balance") * TOLERANCE))
    rows = rows.withColumns({"total": total, "_owed": owed.cast("int"), "_wrong": wrong.cast("int"), "_other": (c("scope") != c("_scope")).cast("int")})
    rows = rows.withColumn("_part", F.when(summary & ~c("total") & (c("_first") != ""), F.regexp_replace(F.regexp_replace("_first", "소계", ""), "계", "")))
    listed = F.collect_list(F.when(c("_site"), F.struct("row_no", squeezed(c("debtor")).alias("debtor"), squeezed(c("region")).alias("region"))))
    rows = rows.withColumns({x: F.max(x).over(table) for x in ("_owed", "_wrong", "_other")} | {"_listed": listed.over(table)}).where(~site | c("_site"))
    adds_up = (c("_owed") == 1) & (c("_wrong") == 0) & c("_rising")
    in_order = table.orderBy("row_no")
    rows = rows.withColumns({"category": F.last("_part", ignorenulls=True).over(in_order.rowsBetween(Window.unboundedPreceding, 0)), "_top": F.row_number().over(in_order)})
    rows = rows.withColumns({
        "dated": F.coalesce(summary & (c("_named") | adds_up), F.lit(False)), "category": F.when(site, c("_kind")).when(summary & ~c("total"), c("category")),
        "pf_type": F.when(~summary | ~c("total"), c("pf_type")), "_mixed": F.coalesce(c("_other") == 1, F.lit(False)),
    })
    rows = rows.withColumns({b: F.when(c("dated"), c(f"_{b}")) for b in BUCKETS} | {"w12": F.when(c("dated"), c("_w12"))})

    # summaries without the rows that only repeat others
    subtotal = c("_first").contains("소계") | _is_sum(c("_first")) | c("_second").isin("계", "소계") | c("_second").rlike("합계|총계")
    empty = c("guarantee").isNull() & c("balance").isNull() & c("limit").isNull()
    rows = rows.where(~summary | ~((subtotal & ~c("total")) | (c("total") & c("_mixed")) | empty))
    shared = F.max((c("scope") == SHARE).cast("int")).over(Window.partitionBy(key))
    rows = rows.withColumn("_shared", F.coalesce(shared, F.lit(0)))
    rows = rows.withColumn("scope", F.when((c("_scope") == ALL) & c("_whose") & (c("_shared") == 0) & summary, SHARE).otherwise(c("scope")))

    # sites without tables that list the same sites again
    same = F.xxhash64(F.to_json(F.transform(F.array_sort("_listed"), lambda x: F.struct(x["debtor"].alias("col2"), x["region"].alias("col3")))))
    rows = rows.withColumn("_listed", F.when(site & (c("_top") == 1), same))
    rows = rows.withColumn("_listed", F.first("_listed", ignorenulls=True).over(in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    rows = rows.withColumn("_once", F.min("block_no").over(Window.partitionBy(key, "_listed"))).where(~site | (c("block_no") == c("_once")))
    said = ["scope", "category", "pf_type", "region", "enhancement", "debtor", "related", "completion", *_TOTALS, "dated", "total"]
    return rows.select(key, "block_no", "row_no", "role", "text", *said)


def _amounts(cells: Column) -> Column:
    """``filings.number`` of each cell without blanks. One step after another, as each names what it is given more than once."""
    bare = F.transform(cells, lambda x: F.translate(x, " \t\n\u000b\f\r,원%", ""))
    bare = F.transform(bare, lambda x: F.when(x.startswith("("), F.regexp_replace(x, r"^\((.*)\)$", "-$1")).otherwise(x))
    return F.transform(bare, lambda x: F.when(x.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), x).try_cast("decimal(28,4)"))


def reports(found: DataFrame, key: str) -> DataFrame:
    """One row for each document of ``lines``: status, what the company is exposed to, and whether it agrees with the sites and with the text.

    status: PARSED; NONE where the text says that there is no exposure; NO_STANDARD. Amounts are those of SOLE and CONSORTIUM_SHARE, of each the first table that has the
    scope: its total, or the sum of its rows if it has none; rows that a note calls the company's own projects are taken off. due_within_12m and
    the buckets are null unless the due columns of all these tables are read. sites_guarantee, n_sites and reconciled compare with the sites,
    stated_total and stated_match with the text; null if one side is not there. note says what to know of the due columns.
    """
    c = F.col
    scope = Window.partitionBy(key, "role", "scope")
    document = Window.partitionBy(key)
    # the first numbered note that soon speaks of own projects
    notes = F.filter(F.split("text", "[(]주"), lambda x: F.left(F.regexp_extract(x, "^[0-9]+[)]([^()]*)", 1), F.lit(44)).contains("자체사업"))
    mark = F.concat(F.lit("(주"), F.regexp_extract(F.get(notes, F.lit(0)), "^[0-9]+", 0), F.lit(")"))
    whole = {
        "_mark": F.first(F.when(c("role") == "TEXT", mark), ignorenulls=True).over(document),
        "_read": F.max(F.when(c("role") == "SUMMARY", 1).otherwise(0)).over(document),
        "_unread": F.max(F.when(c("role") == "UNREAD", 1).otherwise(0)).over(document),
        "_table": F.min("block_no").over(scope),
    }
    rows = found.withColumns(whole)
    rows = rows.withColumn("_last", F.min(F.when(c("total") & (c("block_no") == c("_table")), c("row_no"))).over(scope))
    summary = c("role") == "SUMMARY"
    mine = summary & (c("scope") != ALL) & (c("block_no") == c("_table")) & (c("row_no") <= F.coalesce("_last", c("row_no")))
    counted = mine & (c("row_no") == F.coalesce("_last", c("row_no")))
    own = mine & ~c("total") & c("_mark").isNotNull() & c("category").contains(c("_mark"))
    bridge = mine & ~c("total") & ~F.coalesce(own, F.lit(False)) & squeezed(c("pf_type")).contains("브릿지")
    site = (c("role") == "SITE") & ((c("_read") == 1) | (c("_unread") == 0))

    group = F.when(mine, c("scope")).when(site, "SITE").otherwise("TEXT")
    sums = [F.sum(F.when(counted, c(x))).alias(x) for x in _TOTALS] + [F.sum(F.when(own, c(x))).alias(f"_own_{x}") for x in _TOTALS]
    parts = rows.groupBy(key, group.alias("_part")).agg(
        *sums, F.bool_and(F.when(counted, c("dated"))).alias("_dated"), F.max(F.when(c("role") == "TEXT", c("text"))).alias("text"),
        F.sum(F.when(bridge, c("guarantee"))).alias("bridge_guarantee"), F.sum(F.when(bridge, c("balance"))).alias("bridge_balance"),
        F.sum(F.when(site, c("guarantee"))).alias("sites_guarantee"), F.count_if(site).alias("n_sites"), F.count_if(summary).alias("_n"),
    )
    near = lambda *columns: sum((F.coalesce(c(x), F.lit(0).cast(MONEY)) for x in columns[1:]), F.coalesce(c(columns[0]), F.lit(0).cast(MONEY)))
    none = lambda: F.coalesce(*BUCKETS).isNull()
    parts = parts.withColumn("_w", F.when(c("w12").isNotNull(), c("w12")).when(~none(), near("m3", "m6", "m12"))).withColumn("_own_w", F.coalesce("_own_w12", near("_own_m3", "_own_m6", "_own_m12")))
    scopes = c("_part").isin(SOLE, SHARE)
    total = lambda x: F.sum(F.when(scopes, c(x)))
    less = lambda x: total(x) - F.coalesce(total(f"_own_{x}"), F.lit(0))
    by_range = F.bool_or(scopes & c("w12").isNotNull())
    known = F.coalesce(F.bool_and(F.when(scopes, c("_dated"))), F.lit(False)) & ~(by_range & F.coalesce(F.bool_or(scopes & c("_w").isNull()), F.lit(False)))
    out = parts.groupBy(key).agg(
        *[less(x).cast(MONEY).alias(x) for x in ("limit", "guarantee", "balance", "prior")], *[F.when(known, less(x)).cast(MONEY).alias(x) for x in BUCKETS],
        F.when(known, F.sum(F.when(scopes, c("_w"))) - F.coalesce(F.sum(F.when(scopes, c("_own_w"))), F.lit(0))).cast(MONEY).alias("due_within_12m"), known.alias("_known"),
        *[F.sum(x).cast(MONEY).alias(x) for x in ("bridge_guarantee", "bridge_balance", "sites_guarantee")], F.sum("n_sites").alias("n_sites"), F.sum("_n").alias("n_summary"),
        F.max("text").alias("text"), F.coalesce(F.bool_or(c("_own_guarantee").isNotNull()), F.lit(False)).alias("_own"),
    )
    denied = F.exists(F.split("text", "[.]"), lambda x: x.contains("PF") & _any(x, ["신용보강", "보증"]) & _any(x, NOTHING))
    absent = (c("text").contains("해당사항없") & ~c("text").contains("신용보강")) | denied
    parsed = (c("n_summary") > 0) | (c("n_sites") > 0)
    reconciled = F.when(c("guarantee") != 0, F.abs(c("sites_guarantee") - c("guarantee")) <= F.abs("guarantee") * TOLERANCE)
    status = F.when(parsed, "PARSED").when(absent, "NONE").otherwise("NO_STANDARD")
    out = out.withColumns({"status": status, "reconciled": reconciled, "stated_total": F.when(parsed, stated_total(c("text")))})
    out = out.withColumn("stated_match", F.abs(c("guarantee") - c("stated_total")) <= F.abs("stated_total") * TOLERANCE)
    split = c("due_within_12m") == near("m3", "m6", "m12")
    note = F.when(c("_own"), "OWN_PROJECTS_OFF").when(c("n_summary") == 0, "SITES_ONLY").when(~c("_known"), "DUE_UNREAD").when(c("due_within_12m").isNull(), "DUE_EMPTY").when(~split, "DUE_NOT_SPLIT")
    out = out.withColumn("note", F.when(parsed, note))
    return out.select(key, "status", "limit", "guarantee", "balance", "prior", "bridge_guarantee", "bridge_balance", *BUCKETS, "due_within_12m", "n_sites", "sites_guarantee", "reconciled", "stated_total", "stated_match", "note")
