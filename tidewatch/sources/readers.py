"""Sources: landed XML, JSON and CSV files as typed rows, and completeness guards."""

from __future__ import annotations

import io
import zipfile
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import names
from tidewatch.sources import native

#: Fixed layout of a trade item: all text, cleaned below.
TRADE_XML = "aptNm string, buildYear string, cdealDay string, cdealType string, dealAmount string, dealDay string, dealMonth string, dealYear string, excluUseAr string, floor string, jibun string, sggCd string, umdNm string"
STATEMENT_JSON = "status string, message string, list array<struct<rcept_no:string,reprt_code:string,bsns_year:string,corp_code:string,sj_div:string,account_id:string,account_nm:string,thstrm_amount:string,thstrm_add_amount:string>>"


def companies(spark: SparkSession, path: str) -> DataFrame:
    """The code file, in its archive or unpacked: one company for each ``list`` element; blank stock codes are null.

    Records are read from a stream, one after another; a file with a document type is refused.
    """
    native.register(spark)
    x = spark.read.format("tidewatch_records").option("record", "list").schema("corp_code string, corp_name string, stock_code string, modify_date string").load(path)
    return x.select("corp_code", "corp_name", "stock_code", F.try_to_timestamp("modify_date", F.lit("yyyyMMdd")).cast("date").alias("modify_date"))


def statement_lines(spark: SparkSession, path: str, fs_div: str) -> DataFrame:
    """Statement lines with their number in the file; lines of changes in equity are left out after numbering."""
    j = spark.read.schema(STATEMENT_JSON).option("multiLine", True).json(path)
    lines = j.select(F.posexplode("list").alias("pos", "l")).select((F.col("pos") + 1).alias("line_no"), "l.*", F.lit(fs_div).alias("fs_div")).where("sj_div != 'SCE'")
    for c in ("thstrm_amount", "thstrm_add_amount"):
        lines = lines.withColumn(c, names.number(F.col(c)).cast("decimal(24,0)"))
    return lines


def trades(spark: SparkSession, path: str) -> DataFrame:
    """Apartment trades; amounts have thousands marks, cancelled ones an O and a two-digit-year date."""
    x = spark.read.format("xml").option("rowTag", "item").schema(TRADE_XML).load(path)
    t = x.select(*[F.trim(c).alias(c) for c in x.columns])
    n = lambda c: names.number(F.col(c))
    return t.select(
        F.col("sggCd").alias("lawd_cd"), (n("dealYear") * 100 + n("dealMonth")).cast("int").alias("deal_ym"),
        F.make_date(n("dealYear").cast("int"), n("dealMonth").cast("int"), n("dealDay").cast("int")).alias("deal_date"),
        F.col("umdNm").alias("umd_nm"), F.col("aptNm").alias("apt_nm"), "jibun", n("excluUseAr").cast("decimal(10,4)").alias("exclu_use_ar"), n("floor").cast("int").alias("floor"),
        n("buildYear").cast("int").alias("build_year"), n("dealAmount").cast("long").alias("deal_amount"), F.coalesce(F.col("cdealType") == "O", F.lit(False)).alias("cancelled"),
        F.try_to_timestamp("cdealDay", F.lit("yy.MM.dd")).cast("date").alias("cancel_date"),
    ).where("exclu_use_ar > 0 AND deal_amount > 0")


def dictionary(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV dictionary with comments; empty fields are null."""
    return spark.read.csv(path, schema=schema, header=True, comment="#", nullValue="", emptyValue=None)


def decoded(content: Column) -> Column:
    """Text of a binary: UTF-8, or MS949, as older forms have it, where it is no UTF-8.

    Only the latter go to a Python worker, row by row, so that long ones are not gathered in a batch.
    """
    valid = F.is_valid_utf8(content.cast("string"))
    legacy = F.udf(lambda b: None if b is None else bytes(b).decode("cp949", "replace"), "string", useArrow=False)
    return F.coalesce(F.when(valid, content.cast("string")), legacy(F.when(~valid, content)))


def sections(spark: SparkSession, path: str, start: str, end: str, most: int = 4_000_000, scan: int = 120 << 20, chunk: int = 1 << 20) -> DataFrame:
    """(path, section, truncated): of each file, or archive, what lies between two markers of ASCII characters.

    The section begins at the TITLE before the first marker and ends before the title of the next one. One that has not ended
    within ``most`` bytes and a chunk is cut after ``most``; without a first marker it is null, as it is where ``scan`` bytes do not reach its end. Files are read in
    chunks up to the end of their section, and only what is kept is ever decoded: a task holds ``most`` bytes and a chunk. Empty files give no row.
    """
    native.register(spark)
    f = spark.read.format("tidewatch_sections")
    for name, value in (("start", start), ("end", end), ("most", most), ("scan", scan), ("chunk", chunk)):
        f = f.option(name, value)
    return f.load(path).select("path", decoded(F.col("section")).alias("section"), "truncated")


def whole_units(rows: DataFrame, declared: DataFrame, previous: DataFrame, unit: list[str]) -> DataFrame:
    """``rows`` of the units that are whole: as many as declared (total), and not empty where there were some before.

    ``declared``: unit columns, total; ``previous``: unit columns, n.
    """
    have = rows.groupBy(*unit).agg(F.count("*").alias("_have"))
    d = declared.join(have, unit, "left").join(previous.withColumnRenamed("n", "_before"), unit, "left")
    bad = d.where((F.coalesce("_have", F.lit(0)) < F.col("total")) | ((F.col("total") == 0) & (F.coalesce("_before", F.lit(0)) > 0)))
    return rows.join(bad.select(*unit), unit, "left_anti")


def _texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, value) of whole text files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def _day(text) -> object:
    """A date written 20250131 or 2025-01-31; anything else is null."""
    return F.when(F.length(text) == 8, F.try_to_timestamp(text, F.lit("yyyyMMdd")).cast("date")).otherwise(F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date"))


def daily_bars(spark: SparkSession, path: str, codes: list[str] | None = None) -> DataFrame:
    """Daily stock bars from pages of JSON whose ``item`` is a list, or an object where there is one.

    The service searches by likeness, so rows of other codes are left out where ``codes`` are given.
    """
    row = "basDt string, srtnCd string, clpr string, mkp string, hipr string, lopr string, trqu string, fltRt string, lstgStCnt string, mrktTotAmt string"
    item = F.get_json_object("value", "$.response.body.items.item")
    listed = F.when(F.startswith(F.ltrim(item), F.lit("[")), item).otherwise(F.concat(F.lit("["), item, F.lit("]")))
    rows = _texts(spark, path).select(F.explode(F.from_json(listed, f"array<struct<{row.replace(' string', ':string')}>>")).alias("i")).select("i.*")
    if codes is not None:
        rows = rows.where(F.col("srtnCd").isin(codes))
    n = lambda c: names.number(F.col(c))
    return rows.select(_day(F.col("basDt")).alias("bas_dt"), F.col("srtnCd").alias("stock_code"), n("clpr").alias("close"), n("mkp").alias("open"), n("hipr").alias("high"), n("lopr").alias("low"), n("trqu").cast("long").alias("volume"), n("fltRt").alias("change_rate"), n("lstgStCnt").cast("long").alias("listed_shares"), n("mrktTotAmt").alias("market_cap"))


#: Fields that no presale notice may lack. Fixed values of the service.
NOTICE_NEEDS = ["HOUSE_MANAGE_NO", "PBLANC_NO", "HOUSE_NM", "HOUSE_SECD", "RCRIT_PBLANC_DE"]


def presale_notices(spark: SparkSession, path: str) -> DataFrame:
    """Presale notices from pages of JSON; ``lacking`` names required fields that a row has not, so that it can be refused.

    Flags are true, false or, where they are neither Y nor N, null; dates come in two spellings.
    """
    fields = [*NOTICE_NEEDS, "HSSPLY_ADRES", "TOT_SUPLY_HSHLDCO", "RCEPT_BGNDE", "RCEPT_ENDDE", "CNSTRCT_ENTRPS_NM", "BSNS_MBY_NM", "MVN_PREARNGE_YM", "SPECLT_RDN_EARTH_AT", "PARCPRC_ULS_AT"]
    kind = ",".join(f"{f}:string" for f in fields)
    d = _texts(spark, path).select(F.explode(F.from_json(F.get_json_object("value", "$.data"), f"array<struct<{kind}>>")).alias("n")).select("n.*")
    d = d.select(*[F.nullif(F.trim(f), F.lit("")).alias(f) for f in fields])
    flag = lambda c: F.when(F.col(c) == "Y", True).when(F.col(c) == "N", False)
    return d.select(
        F.col("HOUSE_MANAGE_NO").alias("house_no"), F.col("PBLANC_NO").alias("notice_no"), F.col("HOUSE_NM").alias("house_name"), F.col("HOUSE_SECD").alias("kind"), F.col("HSSPLY_ADRES").alias("address"),
        names.number(F.col("TOT_SUPLY_HSHLDCO")).cast("int").alias("households"), _day(F.col("RCRIT_PBLANC_DE")).alias("notice_date"), _day(F.col("RCEPT_BGNDE")).alias("receipt_from"), _day(F.col("RCEPT_ENDDE")).alias("receipt_to"),
        F.col("CNSTRCT_ENTRPS_NM").alias("builders"), F.col("BSNS_MBY_NM").alias("developer"), F.when(F.col("MVN_PREARNGE_YM").rlike("^20[0-9]{2}(0[1-9]|1[0-2])$"), F.col("MVN_PREARNGE_YM")).alias("move_in_ym"),
        flag("SPECLT_RDN_EARTH_AT").alias("overheated"), flag("PARCPRC_ULS_AT").alias("price_cap"),
        F.array_compact(F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in NOTICE_NEEDS])).alias("lacking"),
    )


def presale_models(spark: SparkSession, path: str) -> DataFrame:
    """Models of presale notices; the highest price comes in units of 10,000 won and leaves in won."""
    fields = ["HOUSE_MANAGE_NO", "PBLANC_NO", "MODEL_NO", "HOUSE_TY", "SUPLY_AR", "SUPLY_HSHLDCO", "LTTOT_TOP_AMOUNT"]
    kind = ",".join(f"{f}:string" for f in fields)
    d = _texts(spark, path).select(F.explode(F.from_json(F.get_json_object("value", "$.data"), f"array<struct<{kind}>>")).alias("n")).select("n.*")
    n = lambda c: names.number(F.col(c))
    return d.select(F.col("HOUSE_MANAGE_NO").alias("house_no"), F.col("PBLANC_NO").alias("notice_no"), F.col("MODEL_NO").alias("model_no"), F.col("HOUSE_TY").alias("model"), n("SUPLY_AR").alias("area"), n("SUPLY_HSHLDCO").cast("int").alias("households"), (n("LTTOT_TOP_AMOUNT") * 10_000).cast("decimal(38,0)").alias("top_price"))


def statistic_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the statistics service: up to eight classes as arrays of codes and names, ended by the first one that is not given."""
    pairs = ",".join(f"C{i}:string,C{i}_NM:string" for i in range(1, 9))
    d = _texts(spark, path).select(F.explode(F.from_json("value", f"array<struct<PRD_DE:string,ITM_ID:string,DT:string,UNIT_NM:string,{pairs}>>")).alias("r")).select("r.*")
    classes = F.array(*[F.struct(F.nullif(F.trim(f"C{i}"), F.lit("")).alias("code"), F.col(f"C{i}_NM").alias("name")) for i in range(1, 9)])
    d = d.withColumn("_c", classes).withColumn("_n", F.coalesce(F.nullif(F.array_position(F.transform("_c", lambda c: c["code"].isNull()), True), F.lit(0)) - 1, F.lit(8)).cast("int"))
    d = d.withColumn("_c", F.expr("slice(_c, 1, _n)"))
    return d.select(F.col("PRD_DE").alias("period"), F.col("_c.code").alias("codes"), F.col("_c.name").alias("names"), F.col("ITM_ID").alias("item"), names.number(F.col("DT")).alias("value"), F.col("DT").alias("raw"), F.col("UNIT_NM").alias("unit"))


def price_index_rows(spark: SparkSession, path: str, items: list[str] | None = None) -> DataFrame:
    """Rows of the price index with their place as a path; rows without a name are left out."""
    row = "STATBL_ID:string,WRTTIME_IDTFR_ID:string,CLS_ID:string,CLS_NM:string,CLS_FULLNM:string,ITM_ID:string,DTA_VAL:string,UI_NM:string"
    sections = F.from_json(F.get_json_object("value", "$.SttsApiTblData"), f"array<struct<row:array<struct<{row}>>>>")
    d = _texts(spark, path).select(F.explode(F.flatten(F.filter(F.transform(sections, lambda s: s["row"]), lambda r: r.isNotNull()))).alias("r")).select("r.*")
    d = d.where(F.col("CLS_NM").isNotNull() & (F.trim("CLS_NM") != ""))
    if items is not None:
        d = d.where(F.col("ITM_ID").isin(items))
    return d.select(F.col("STATBL_ID").alias("table_id"), F.col("WRTTIME_IDTFR_ID").alias("period"), F.col("CLS_ID").alias("code"), F.transform(F.split(F.coalesce("CLS_FULLNM", "CLS_NM"), ">"), lambda x: F.trim(x)).alias("path"), F.col("ITM_ID").alias("item"), names.number(F.col("DTA_VAL")).alias("value"), F.col("UI_NM").alias("unit"))


def bounded_zips(spark: SparkSession, path: str, most: int = 256 << 20) -> DataFrame:
    """(path, content) of landed archives of at most ``most`` bytes; larger ones are left out before they are read."""
    return spark.read.format("binaryFile").load(path).where(F.col("length") <= most).select("path", "content")


def documents(archives: DataFrame, most: int = 5 << 20) -> DataFrame:
    """(rcept_no, html) of landed archives (path, content) that are named by their receipt number.

    The document is the entry whose name begins with the receipt number, or else the first one. One that
    is larger than ``most`` bytes when unpacked, or an archive that cannot be read, gives null; no more
    than that is ever unpacked.
    """

    def unpack(name: str | None, content: bytes | None) -> bytes | None:
        try:
            with zipfile.ZipFile(io.BytesIO(content or b"")) as z:
                entries = [e for e in z.infolist() if not e.is_dir()]
                chosen = next((e for e in entries if name and e.filename.startswith(name)), entries[0] if entries else None)
                if chosen is None:
                    return None
                with z.open(chosen) as f:
                    data = f.read(most + 1)
                return data if len(data) <= most else None
        except (zipfile.BadZipFile, EOFError, NotImplementedError, zlib.error):
            return None

    named = archives.select(F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("rcept_no"), "content")
    return named.select("rcept_no", F.udf(unpack, "binary", useArrow=False)("rcept_no", "content").alias("_c")).select("rcept_no", decoded(F.col("_c")).alias("html"))


def census_rows(spark: SparkSession, path: str) -> DataFrame:
    """Households and people of each district; answers without a result give no rows."""
    kind = "array<struct<adm_cd:string,adm_nm:string,tot_family:string,tot_ppltn:string>>"
    r = _texts(spark, path).select(F.explode(F.from_json(F.get_json_object("value", "$.result"), kind)).alias("r")).select("r.*")
    return r.select("adm_cd", "adm_nm", names.number(F.col("tot_family")).cast("long").alias("households"), names.number(F.col("tot_ppltn")).cast("long").alias("people"))


def boundaries(spark: SparkSession, path: str) -> DataFrame:
    """(code, name, full_name, geometry as JSON text) of feature collections, bare or within a page of an answer."""
    value = F.coalesce(F.get_json_object("value", "$.response.result.featureCollection.features"), F.get_json_object("value", "$.features"))
    features = F.explode(F.from_json(value, "array<struct<properties:map<string,string>,geometry:string>>")).alias("f")
    f = _texts(spark, path).select(features).select("f.*")
    p = lambda *keys: F.coalesce(*[F.try_element_at("properties", F.lit(k)) for k in keys])
    return f.select(p("sig_cd", "adm_cd").alias("code"), p("sig_kor_nm", "adm_nm").alias("name"), p("full_nm").alias("full_name"), "geometry")
