"""Company-facts JSON, identifier lists and download status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from perennial.functions.columns import normalize_company_name, normalize_ticker

OBSERVATION = "struct<start:string,end:string,val:double,filed:string,form:string,accn:string>"
FACTS_SCHEMA = (
    "struct<cik:bigint,entityName:string,"
    f"facts:map<string,map<string,struct<units:map<string,array<{OBSERVATION}>>>>>>"
)
TICKER_MAP_SCHEMA = "map<string,struct<cik_str:bigint,ticker:string,title:string>>"


def parse_company_facts(documents: DataFrame, column: str = "value") -> DataFrame:
    """(cik, entityName, facts) from one JSON document per row; unreadable ones are dropped.

    The document is a generator's row: as a plain column it would be parsed again for every filter on it.
    """
    parsed = documents.select(F.inline(F.array(F.from_json(column, FACTS_SCHEMA))))
    return parsed.where(F.col("cik").isNotNull())


def quarantined_documents(documents: DataFrame, column: str = "value") -> DataFrame:
    """Documents that do not parse, with the reason."""
    parsed = documents.withColumn("_d", F.from_json(column, FACTS_SCHEMA))
    return parsed.where(F.col("_d.cik").isNull()).drop("_d").withColumn(
        "error", F.lit("unreadable company facts")
    )


def read_company_facts(
    spark: SparkSession, path: str, status: DataFrame | None = None
) -> DataFrame:
    """Read one JSON file per company; with ``status`` only companies marked successful."""
    facts = parse_company_facts(spark.read.text(path, wholetext=True))
    if status is None:
        return facts
    done = status.where(F.col("success")).select(F.col("cik").cast("bigint").alias("cik")).distinct()
    return facts.join(done, "cik", "left_semi")


def read_documents(spark: SparkSession, path: str, whole_files: bool = True) -> DataFrame:
    """(file, value): one JSON document per file, or per line."""
    lines = spark.read.option("wholetext", whole_files).text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), "value")


def parsed_documents(documents: DataFrame, status: DataFrame | None = None) -> DataFrame:
    """(file, cik, entity, doc) with the document as VARIANT; with ``status`` only companies marked
    successful.  Documents that do not parse or name no company are left out (see
    ``broken_documents``)."""
    doc = documents.select("file", F.try_parse_json("value").alias("doc")).select(
        "file",
        F.try_variant_get("doc", "$.cik", "bigint").alias("cik"),
        F.try_variant_get("doc", "$.entityName", "string").alias("entity"),
        "doc",
    )
    known = doc.where(F.col("cik").isNotNull())
    if status is None:
        return known
    done = status.where(F.col("success")).select(F.col("cik").cast("bigint").alias("cik")).distinct()
    return known.join(done, "cik", "left_semi")


def broken_documents(documents: DataFrame) -> DataFrame:
    """(file, value, error): documents that do not parse, or parse without a company."""
    doc = F.try_parse_json("value")
    error = F.when(doc.isNull(), F.lit("unreadable company facts")).when(
        F.try_variant_get(doc, "$.cik", "bigint").isNull(), F.lit("no company")
    )
    return documents.select("file", "value", error.alias("error")).where(F.col("error").isNotNull())


def download_worklist(resolution: DataFrame, status: DataFrame) -> DataFrame:
    """Distinct resolved companies that have no successful download yet."""
    wanted = resolution.where(F.col("cik").isNotNull()).select(F.col("cik").cast("bigint").alias("cik"))
    done = status.where(F.col("success")).select(F.col("cik").cast("bigint").alias("cik"))
    return wanted.distinct().join(done, "cik", "left_anti")


def download_status(resolution: DataFrame, landed: DataFrame) -> DataFrame:
    """(cik, success, error) for every resolved company, from the documents that have landed.

    ``landed`` is (cik, value); a company with several documents succeeds if one of them parses.
    """
    wanted = resolution.where(F.col("cik").isNotNull()).select(F.col("cik").cast("bigint").alias("cik"))
    readable = F.from_json("value", FACTS_SCHEMA)["cik"].isNotNull()
    seen = landed.groupBy(F.col("cik").cast("bigint").alias("cik")).agg(
        F.bool_or(readable).alias("_ok")
    )
    error = F.when(F.col("_ok").isNull(), F.lit("missing document")).when(
        ~F.col("_ok"), F.lit("unreadable company facts")
    )
    return wanted.distinct().join(seen, "cik", "left").select(
        "cik", F.coalesce("_ok", F.lit(False)).alias("success"), error.alias("error")
    )


def parse_ticker_map(documents: DataFrame, column: str = "value") -> DataFrame:
    """(ticker, cik, title) from the JSON object of listed companies; the last entry of a ticker wins."""
    entries = documents.select(
        F.explode(F.from_json(column, TICKER_MAP_SCHEMA)).alias("_i", "_e")
    ).select(
        F.col("_i").cast("bigint").alias("_i"),
        normalize_ticker(F.col("_e.ticker")).alias("ticker"),
        F.col("_e.cik_str").alias("cik"),
        F.col("_e.title").alias("title"),
    )
    return entries.groupBy("ticker").agg(
        F.max_by(F.struct("cik", "title"), "_i").alias("_last")
    ).select("ticker", "_last.cik", "_last.title")


def read_ticker_map(spark: SparkSession, path: str) -> DataFrame:
    return parse_ticker_map(spark.read.text(path, wholetext=True))


def cik_for_ticker(ticker_map: DataFrame, ticker: str) -> DataFrame:
    """The CIK of one ticker (no row when it is unknown)."""
    return ticker_map.where(F.col("ticker") == normalize_ticker(F.lit(ticker))).select("cik")


def _part(line: Column, pattern: str, group: int) -> Column:
    return F.trim(F.regexp_extract(line, pattern, group))


def parse_name_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """(name, normalized, cik) from ``NAME:CIK:`` lines, split from the right; distinct."""
    return named_lines(lines, column).where("corrupt IS NULL").drop("corrupt").distinct()


def named_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """(name, normalized, cik, corrupt): every line that is not blank; one without a name or number has
    itself as ``corrupt`` and nothing else."""
    line = F.trim(F.col(column))
    pattern = r"^(.*):([^:]*):[^:]*$"
    one_colon = r"^([^:]*):([^:]*)$"
    two = F.col("_line").rlike(pattern)
    name = F.when(two, _part(F.col("_line"), pattern, 1)).otherwise(
        _part(F.col("_line"), one_colon, 1)
    )
    cik = F.when(two, _part(F.col("_line"), pattern, 2)).otherwise(
        _part(F.col("_line"), one_colon, 2)
    )
    number = F.when(F.col("_cik").rlike("^[0-9]+$"), F.col("_cik").try_cast("bigint"))
    whole = F.col("_number").isNotNull() & (F.col("normalized") != "")
    return (
        lines.select(line.alias("_line"))
        .where(F.col("_line") != "")
        .select("_line", name.alias("name"), cik.alias("_cik"))
        .select("_line", "name", normalize_company_name("name").alias("normalized"), number.alias("_number"))
        .select(
            F.when(whole, F.col("name")).alias("name"),
            F.when(whole, F.col("normalized")).alias("normalized"),
            F.when(whole, F.col("_number")).alias("cik"),
            F.when(~whole, F.col("_line")).alias("corrupt"),
        )
    )


def read_lines(spark: SparkSession, path: str, encoding: str = "ISO-8859-1") -> DataFrame:
    """``value``: the lines of text files in a declared encoding."""
    return (
        spark.read.option("encoding", encoding)
        .option("sep", "\u0001")
        .option("quote", "")
        .schema("value string")
        .csv(path)
    )


def read_name_lines(spark: SparkSession, path: str) -> DataFrame:
    """The identifier list in Latin-1, one entry per line."""
    return parse_name_lines(read_lines(spark, path))
