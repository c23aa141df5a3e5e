"""Raw CERT logs, the directory and the known-insider list, read from CSV."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The column lists of the public dataset, every column read as text.
LOG_COLUMNS = {
    "logon": ["id", "date", "user", "pc", "activity"],
    "device": ["id", "date", "user", "pc", "activity"],
    "file": ["id", "date", "user", "pc", "filename", "content"],
    "email": ["id", "date", "user", "pc", "to", "cc", "bcc", "from", "size", "attachments", "content"],
    "http": ["id", "date", "user", "pc", "url", "content"],
}
DIRECTORY_COLUMNS = [
    "employee_name", "user_id", "email", "role", "business_unit",
    "functional_unit", "department", "team", "supervisor",
]
ANSWER_COLUMNS = ["dataset", "scenario", "details", "user", "start", "end"]
VERSION = "r4.2"


def _csv(
    spark: SparkSession, path: str, columns: list[str], multiline: bool = False, nested: bool = False
) -> DataFrame:
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multiline)
        .option("recursiveFileLookup", nested)
        .csv(path)
    )


def parse_time(text):
    """``MM/dd/yyyy HH:mm:ss`` (or with a fraction) to a zone-free timestamp; anything else gives NULL."""
    pattern = r"^(\d{2})/(\d{2})/(\d{4}) (\d{2}:\d{2}:\d{2}(?:\.\d{1,6})?)$"
    iso = F.regexp_replace(text, pattern, "$3-$1-$2 $4")
    return F.when(text.rlike(pattern), iso.try_cast("timestamp_ntz"))


def read_log(
    spark: SparkSession, raw: str, log: str, version: str = VERSION, multiline: bool = False
) -> DataFrame:
    """One raw log of one dataset version, ``<raw>/cert-<version>/<log>.csv``.

    Every column stays text but ``ts``, parsed from ``date``. ``multiline`` is
    for files whose quoted text holds line breaks; Spark cannot split such a
    file, so it stays off for the large logs, which have none.
    """
    return _csv(spark, f"{raw}/cert-{version}/{log}.csv", LOG_COLUMNS[log], multiline).withColumn(
        "ts", parse_time(F.col("date"))
    )


def email_columns(email: DataFrame) -> DataFrame:
    """The email log with its recipients as a list, their number, and sizes as numbers."""
    every = F.concat_ws(";", "to", "cc", "bcc")
    recipients = F.filter(F.transform(F.split(every, ";"), lambda r: F.trim(r)), lambda r: r != "")
    return email.withColumns(
        {
            "recipients": recipients,
            "n_recipients": F.size(recipients),
            "size": F.col("size").try_cast("double"),
            "attachments": F.col("attachments").try_cast("int"),
        }
    )


def web_columns(http: DataFrame) -> DataFrame:
    """The web log with the host of each address in lower case; an unreadable address has none."""
    return http.withColumn("host", F.lower(F.try_parse_url("url", F.lit("HOST"))))


def read_directory(spark: SparkSession, raw: str, version: str = VERSION) -> DataFrame:
    """All directory snapshots. The file, or folder of files, ``YYYY-MM.csv`` is the month a row is valid from."""
    month = F.regexp_extract(F.col("_metadata.file_path"), r"(\d{4}-\d{2})(?:\.csv)?(?:/[^/]*)?$", 1)
    rows = _csv(spark, f"{raw}/cert-{version}/LDAP", DIRECTORY_COLUMNS, nested=True)
    return rows.select("*", month.alias("snapshot_month")).withColumn(
        "valid_from", F.to_date(F.concat("snapshot_month", F.lit("-01")))
    )


def read_answers(spark: SparkSession, raw: str, version: str = VERSION) -> DataFrame:
    """Known insiders of one dataset version: user_id, scenario, start, end."""
    rows = _csv(spark, f"{raw}/cert-{version}/answers/insiders.csv", ANSWER_COLUMNS)
    return keep_version(rows, version).select(
        F.col("user").alias("user_id"),
        F.col("scenario").try_cast("int").alias("scenario"),
        parse_time(F.col("start")).alias("start"),
        parse_time(F.col("end")).alias("end"),
    )


def keep_version(rows: DataFrame, version: str, column: str = "dataset") -> DataFrame:
    """Rows of one dataset version (``r4.2`` or ``4.2``); an error if there are none."""
    kept = rows.filter(F.col(column) == version.removeprefix("r"))
    if kept.isEmpty():
        raise ValueError(f"no rows of dataset version {version}")
    return kept


def profile(logs: dict[str, DataFrame], labelled_users: DataFrame | None = None) -> DataFrame:
    """Per log its rows, users, known insiders and first and last time.

    ``logs`` hold at least user_id and ts. Users are counted after one row per
    (log, user) is left, which is also the grain the insiders are joined at.
    """
    frames = [df.select(F.lit(name).alias("log"), "user_id", "ts") for name, df in logs.items()]
    per_user = (
        reduce(DataFrame.unionByName, frames)
        .groupBy("log", "user_id")
        .agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    )
    if labelled_users is None:
        per_user = per_user.withColumn("insider", F.lit(0))
    else:
        known = labelled_users.select("user_id").distinct().withColumn("insider", F.lit(1))
        per_user = per_user.join(known, "user_id", "left")
    return per_user.groupBy("log").agg(
        F.sum("n").alias("n_rows"),
        F.count("user_id").alias("n_users"),
        F.coalesce(F.sum("insider"), F.lit(0)).cast("bigint").alias("n_insiders"),
        F.min("first_ts").alias("first_ts"),
        F.max("last_ts").alias("last_ts"),
    )
