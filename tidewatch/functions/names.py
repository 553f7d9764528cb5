"""Names and titles: normal forms, keyword classes, lists of names."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Numbering in front of an account's name, references to notes, what a company's key leaves out.
_NUMBERING = r"^[(（]?([0-9]{1,2}|[IVX]{1,4}|[Ⅰ-Ⅻ]|[ⅰ-ⅻ]|[가-하])[.)）]"
_NOTE = r"[(（]주(석)?[0-9,.\s]*[)）]"
_COMPANY_FORM = r"\(주\)|㈜|주식회사"
_KEY_DROP = r"[\s\p{Punct}ㆍ·「」『』“”‘’]"
_DIVISION = r"\s*건설부문\s*$"


def account_name(name: Column) -> Column:
    """An account's name without white space, one numbering in front and references to notes."""
    bare = F.regexp_replace(F.regexp_replace(name, r"\s+", ""), _NUMBERING, "")
    return F.regexp_replace(bare, _NOTE, "")


def title(name: Column) -> Column:
    """A filing's title without bracketed prefixes and white space."""
    return F.regexp_replace(F.regexp_replace(name, r"^\s*(?:\[[^\]]*\]\s*)+", ""), r"\s+", "")


def _nfkc(name: Column) -> Column:
    """Compatibility form, which no built-in function gives."""

    def fold(names: pd.Series) -> pd.Series:
        return names.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))

    return F.pandas_udf(fold, "string", F.PandasUDFType.SCALAR)(name)


def corp_key(name: Column) -> Column:
    """Comparison key of a company's name: stripped, put into compatibility form, and stripped again."""
    return _stripped(_nfkc(_stripped(name)))


def builder_key(name: Column) -> Column:
    """``corp_key`` of a builder's name without the mark of its construction division."""
    return corp_key(F.regexp_replace(F.trim(name), _DIVISION, ""))


def _stripped(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), _COMPANY_FORM, ""), _KEY_DROP, "")


def first_keyword(text: Column, classes: Sequence[tuple[str, str]], neutral: Sequence[str] = ()) -> Column:
    """struct(event_type, keyword) of the first (class, keyword) that the text contains; neutral words come first and give null."""
    found = F.lit(None).cast("struct<event_type:string,keyword:string>")
    for kind, word in reversed(classes):
        found = F.when(F.contains(text, F.lit(word)), F.struct(F.lit(kind).alias("event_type"), F.lit(word).alias("keyword"))).otherwise(found)
    for word in neutral:
        found = F.when(~F.contains(text, F.lit(word)), found)
    return found


def credit_event(title: Column, include: Sequence[str], exclude: Sequence[str]) -> Column:
    """The first included word of a title, unless it has an excluded one or is a correction."""
    hit = F.lit(None).cast("string")
    for word in reversed(include):
        hit = F.when(F.contains(title, F.lit(word)), F.lit(word)).otherwise(hit)
    bad = F.contains(title, F.lit("정정"))
    for word in exclude:
        bad = bad | F.contains(title, F.lit(word))
    return F.when(~bad, hit)


def consortium(raw: Column) -> Column:
    """struct(names, extra, more) of a list of builders: ``… 외 N`` counts as extra, else a trailing ``등`` as more.

    Of names that are alike but for company forms, divisions, marks and case the first one stays.
    """
    cut = lambda x, n: F.rtrim(F.left(x, F.length(x) - n))
    key = lambda x: _stripped(F.regexp_replace(x, _DIVISION, ""))

    def counted(text: Column) -> Column:
        # how many others: a number behind the word for them, with or without a unit
        bare = F.rtrim(F.regexp_replace(text, "(개사|개|사)$", ""))
        return _let(bare, lambda bare: _let(F.regexp_extract(bare, "([0-9]{1,2})$", 1), lambda n: _let(cut(bare, F.length(n)), lambda before: read(text, n, before))))

    def read(text: Column, number_: Column, before: Column) -> Column:
        counted = (number_ != "") & before.endswith("외")
        more = ~counted & text.endswith(" 등")
        body = F.when(counted, cut(before, 1)).when(more, cut(text, 1)).otherwise(text)
        body = _let(body, lambda x: F.when(x.endswith("컨소시엄"), cut(x, 4)).otherwise(x))
        parts = F.transform(F.split(F.translate(body, "/、·ㆍ", ",,,,"), ","), lambda x: F.trim(x))
        extra = F.when(counted, number_.cast("int"))
        return F.struct(_let(parts, once).alias("names"), F.coalesce(extra, F.lit(0)).alias("extra"), F.coalesce(more, F.lit(False)).alias("more"))

    def once(parts: Column) -> Column:
        return _let(F.transform(parts, key), lambda keys: F.filter(parts, lambda _, i: (F.get(keys, i) != "") & (F.array_position(keys, F.get(keys, i)) == i + 1)))

    return _let(F.rtrim(F.regexp_replace(F.trim(raw), r"\s", " ")), counted)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def csv_safe(text: Column) -> Column:
    """Text that a spreadsheet will not take for a formula."""
    return F.when(F.substring(text, 1, 1).isin("=", "+", "-", "@", "\t", "\r"), F.concat(F.lit("'"), text)).otherwise(text)


def number(text: Column) -> Column:
    """``1,234`` as a decimal; anything that is no number is null."""
    bare = F.regexp_replace(F.trim(text), ",", "")
    return F.when(bare.rlike(r"^[+-]?[0-9]+(\.[0-9]+)?$"), bare).try_cast("decimal(38,4)")


def digits(text: Column, n: int) -> Column:
    """The digits of a text if there are exactly ``n``."""
    only = F.regexp_replace(text, r"\D", "")
    return F.when(F.length(only) == n, only)


def mask_key(text: Column) -> Column:
    """A message with values of key parameters hidden."""
    return F.regexp_replace(text, r"((?:crtfc_key|serviceKey|apiKey|key)=)[^&\s]+", "$1***")
