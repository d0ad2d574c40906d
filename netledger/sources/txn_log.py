"""Transaction log: text lines "date time KIND fields…", separated by spaces, quoted with |."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from netledger.session import materialise

# Log keyword -> transaction kind.
KINDS = {
    "PURCHASE": "purchase",
    "USERTRANSFER": "user_transfer",
    "TOPUP": "admin_topup",
    "ADMINTRANSFER": "admin_transfer",
}


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, line_no): numbers follow the log (files by name, then position), however files are cut and packed.

    A task reads a piece of a file in order, so a row's place inside its piece is its place in the file. Numbers have
    gaps between pieces; only the table of pieces (one row per split of a file) is ordered as a whole.
    """
    read = materialise(spark.read.text(path).select(
        F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("place"),
    ), "lines")
    pieces = read.groupBy("file", "at").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    earlier = Window.orderBy("file", "at").rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.withColumn("start", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    return read.join(starts, ["file", "at"]).select(
        "line", (F.col("start") + F.col("place") - F.col("first")).alias("line_no")
    )


def strip_nul(lines: DataFrame, line: str = "line") -> DataFrame:
    """Remove NUL bytes and keep how many each line had."""
    clean = F.regexp_replace(line, "\\x00", "")
    return lines.withColumns({line: clean, "nul_count": F.length(line) - F.length(clean)})


def nul_report(lines: DataFrame, line: str = "line") -> DataFrame:
    stripped = strip_nul(lines, line)
    return stripped.agg(
        F.count_if(F.col("nul_count") > 0).alias("damaged_lines"),
        F.coalesce(F.sum("nul_count"), F.lit(0)).cast("bigint").alias("nul_bytes"),
    )


def _fields(line: Column) -> Column:
    """Fields of a line. A quoted run may hold spaces: those are protected while the line is split."""
    runs = F.split(line, r"\|")
    protected = F.transform(
        runs, lambda run, i: F.when(i % 2 == 1, F.replace(run, F.lit(" "), F.lit("\u0001"))).otherwise(run)
    )
    return F.transform(
        F.split(F.array_join(protected, ""), " "), lambda f: F.replace(f, F.lit("\u0001"), F.lit(" "))
    )


def parse(lines: DataFrame, line: str = "line") -> DataFrame:
    """Typed transactions plus reject_reason (NULL for good rows); nothing is dropped or raised here."""
    f = F.col("__f")
    at = lambda i: F.get(f, F.lit(i))
    keyword = at(2)
    kind = F.lit(None).cast("string")
    for word, name in KINDS.items():
        kind = F.when(keyword == word, F.lit(name)).otherwise(kind)
    transfer = keyword.isin("USERTRANSFER", "ADMINTRANSFER")
    # Transfers may lack an amount (counts as 0) or carry a fraction (rounded half to even).
    loose = F.when(at(5) == "", F.lit("0")).otherwise(at(5))
    rounded = F.when(loose.contains("."), F.bround(loose.try_cast("double"), 0).cast("bigint")).otherwise(
        loose.try_cast("bigint")
    )
    amount = (
        F.when(keyword == "USERTRANSFER", rounded)
        .when(keyword == "TOPUP", at(4).try_cast("bigint"))
        .otherwise(at(5).try_cast("bigint"))
    )
    ts = F.concat_ws(" ", at(0), at(1)).try_cast("timestamp_ntz")
    amount_bytes = F.when(keyword == "PURCHASE", at(4).try_cast("bigint"))
    parsed = lines.withColumn("__f", _fields(F.col(line))).withColumns(
        {
            "ts": ts,
            "kind": kind,
            "user_id": F.when(keyword != "TOPUP", at(3)),
            "dest_user_id": F.when(transfer, at(4)).when(keyword == "TOPUP", at(3)),
            "amount_bytes": amount_bytes,
            "amount_idr": amount,
        }
    )
    reason = (
        F.when(F.col("kind").isNull(), F.lit("unknown kind"))
        .when(F.col("ts").isNull(), F.lit("bad timestamp"))
        .when(F.col("amount_idr").isNull(), F.lit("bad amount"))
        .when((F.col("kind") == "purchase") & F.col("amount_bytes").isNull(), F.lit("bad amount"))
    )
    return parsed.withColumn("reject_reason", reason).drop("__f")


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("reject_reason").isNull()).drop("reject_reason")


def rejected(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("reject_reason").isNotNull())


def log_counts(lines: DataFrame, line: str = "line") -> DataFrame:
    """Lines per first-named user and purchases per price, long form (dimension, key, transactions)."""
    f = F.split(F.col(line), " ")
    pairs = F.array(
        F.struct(F.lit("user").alias("dimension"), F.get(f, F.lit(3)).alias("key")),
        F.struct(
            F.lit("price").alias("dimension"),
            F.when(F.get(f, F.lit(2)) == "PURCHASE", F.get(f, F.lit(5))).alias("key"),
        ),
    )
    return (
        lines.select(F.explode(pairs).alias("p")).select("p.*").where(F.col("key").isNotNull())
        .groupBy("dimension", "key").agg(F.count("*").alias("transactions"))
    )
