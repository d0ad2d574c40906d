"""Raw flow and DNS records with optional keys, and traceroute text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from netledger.schemas import RAW_DNS, RAW_FLOW


_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


#: Text of a record that does not fit its schema.
CORRUPT = "corrupt_record"


def read_records(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON records with optional keys: the schema's columns, corrupt_record, and where the record lies (file, block).

    Reading stays permissive: a line that is no record, or has a value of another type, is kept whole in corrupt_record, so
    that nothing is lost at the scan. The columns of such a row are not to be used.
    """
    wide = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    read = spark.read.schema(wide).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)
    return read.select(
        "*", F.col("_metadata.file_name").alias("source_file"), F.col("_metadata.file_block_start").alias("block_start")
    )


def readable(records: DataFrame) -> DataFrame:
    return records.where(F.col(CORRUPT).isNull()).drop(CORRUPT, "source_file", "block_start")


def unreadable(records: DataFrame) -> DataFrame:
    return records.where(F.col(CORRUPT).isNotNull()).select("source_file", "block_start", CORRUPT)


def read_raw_flows(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """The readable records of one archive; a key that a record lacks reads as NULL (unreadable ones: see read_records)."""
    if fmt == "json":
        return readable(read_records(spark, path, RAW_FLOW))
    return spark.read.schema(RAW_FLOW).format(fmt).load(path)


def read_raw_dns(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    if fmt == "json":
        return readable(read_records(spark, path, RAW_DNS))
    return spark.read.schema(RAW_DNS).format(fmt).load(path)


def ingest_report(records: DataFrame, archive: str, number: str = "rec_id") -> DataFrame:
    """One row: records of an archive, how many are readable, how many of these lack a number, how many are unreadable."""
    return records.agg(
        F.lit(archive).alias("archive"), F.count("*").alias("records"), F.count_if(F.col(CORRUPT).isNull()).alias("readable"),
        F.count_if(F.col(CORRUPT).isNull() & F.col(number).isNull()).alias("without_number"),
        F.count_if(F.col(CORRUPT).isNotNull()).alias("unreadable"),
    )


def read_traceroutes(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: file name and full text (each file holds one trace, a few dozen lines)."""
    return spark.read.text(path, wholetext=True).select(
        F.input_file_name().alias("file"), F.col("value").alias("content")
    )


def parse_traceroutes(files: DataFrame, dataset: str = "Community Network") -> DataFrame:
    """(dataset, domain, hop, ip, latency, last_hop): mean of a hop's readable times.

    A token that is not a number lowers the divisor by one, and hops without any latency are dropped.
    """
    lines = F.filter(F.split("content", r"\r?\n"), lambda l: F.length(F.trim(l)) > 0)
    is_header = lambda l: l.startswith("traceroute to")
    header = F.element_at(F.filter("lines", is_header), -1)
    # Each step is a column of its own, so that no step is evaluated more than once per line.
    hops = (
        files.select("file", lines.alias("lines"))
        .select(F.size("lines").alias("n"), F.get(F.split(header, r"\s+"), F.lit(2)).alias("domain"),
                F.posexplode("lines").alias("pos", "line"))
        .where(~is_header(F.col("line")))
        .select("n", "domain", "pos", F.split(F.trim(F.regexp_replace("line", r" ms|[()]", "")), r"\s+").alias("tokens"))
    )
    times = F.concat(F.slice("tokens", 2, 1), F.slice("tokens", F.lit(4), F.greatest(F.size("tokens"), F.lit(1))))
    # Testing the text first is much cheaper than letting a cast fail on every host name and star.
    parsed = hops.withColumn("times", times).withColumn("readable", F.filter("times", lambda t: t.rlike(_NUMBER)))
    unreadable = F.size("times") - F.size("readable")
    total = F.aggregate("readable", F.lit(0.0), lambda a, t: a + t.cast("double"))
    return parsed.select(
        F.lit(dataset).alias("dataset"), "domain", F.get("tokens", F.lit(0)).cast("int").alias("hop"),
        F.get("tokens", F.lit(2)).alias("ip"),
        (total / F.greatest(F.size("readable") - unreadable, F.lit(1))).alias("latency"),
        (F.col("pos") == F.col("n") - 1).cast("int").alias("last_hop"),
    ).where(F.col("latency") > 0)


def traceroute_latency(files: DataFrame, prepared: DataFrame) -> DataFrame:
    """Own traces next to a prepared table of the same columns; the series name is "dataset, domain"."""
    columns = ["dataset", "domain", "hop", "ip", "latency", "last_hop"]
    both = prepared.select(*columns).unionByName(parse_traceroutes(files).select(*columns))
    return both.where(F.col("latency").isNotNull()).withColumn("unique_name", F.concat_ws(", ", "dataset", "domain"))
