"""Readers of irregular sources, and writers. Paths may be globs in any store that Spark reads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.reshape import HOURS
from ..operators.windows import dedupe_keep
from ..shipping import saved


def _file_name() -> F.Column:
    return F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1)


def read_wide_hours(spark: SparkSession, path: str, fields: str, hours: Sequence[str] = HOURS) -> DataFrame:
    """CSV files, one an entity, of `fields` and a column for each hour. entity_id is the file's name up to " - ";
    hours that aren't numbers are NULL."""
    schema = f"{fields}, " + ", ".join(f"{h} string" for h in hours)
    raw = spark.read.schema(schema).option("header", True).csv(path)
    name = F.regexp_replace(F.url_decode(_file_name()), r"\.csv$", "")
    return raw.select(F.split_part(name, F.lit(" - "), F.lit(1)).alias("entity_id"), *raw.columns).withColumns({h: F.expr(f"try_cast({h} AS double)") for h in hours})


#: Fields of a line of a monitor's file at most.
FIELDS = 64


def _fields(line: str) -> F.Column:
    """The fields of a line of CSV: between its commas, or as the CSV parser says if it has a quote. The parser's record is
    bound once, so that no plan parses a line again for each field."""
    parsed = F.from_csv(line, F.lit(", ".join(f"c{i} string" for i in range(FIELDS))), {"mode": "PERMISSIVE"})
    quoted = F.transform(F.array(parsed), lambda c: F.array(*[c[f"c{i}"] for i in range(FIELDS)]))[0]
    return F.when(F.contains(F.col(line), F.lit('"')), quoted).otherwise(F.split(line, ","))


def monitor_headers(lines: DataFrame) -> DataFrame:
    """(file, names): the names, in lower case, of the columns of each file of lines (file, place, fields), from its header:
    its first line with the names date and time. Lines before it, whatever their number, are a preamble."""
    names = F.transform("fields", lambda c: F.lower(F.trim(c)))
    named = lines.withColumn("names", names).filter(F.array_contains("names", "date") & F.array_contains("names", "time"))
    return named.groupBy("file").agg(F.min_by("names", "place").alias("names"))


def read_monitor_table(spark: SparkSession, path: str | list[str], roles: dict[str, Sequence[str]], without: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """Hourly readings of any number of files with Date (dd/MM/yyyy) and Time (HH:mm, 01:00 to 24:00), each with columns of its
    own in an order of its own.

    roles: output column -> parts of headers. In each file the first column whose name has one of them is it, unless it
    also has a part listed in without; whatever the case. Where a file has no such column the role is NULL. Bad values and dates are
    NULL; lines whose date isn't d/M/y, headers and preambles among them, are no rows, and a file without a header has none.

    A file's header is a row of a saved table, joined back to its lines; if the table is small, Spark sees so and the lines aren't
    exchanged. Lines with quotes are read as FIELDS fields at most."""
    raw = spark.read.text(path).filter(F.trim("value") != "").withColumns({"file": F.col("_metadata.file_path"), "place": F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))})
    lower = F.lower("value")
    named = raw.filter(lower.contains("date") & lower.contains("time")).select("file", "place", _fields("value").alias("fields"))
    heads = monitor_headers(named)
    lines = raw.select("file", _fields("value").alias("fields"))

    def first(wanted) -> F.Column:
        """The number of the first column that is wanted, or NULL."""
        return F.try_element_at(F.filter(F.transform("names", lambda c, i: F.when(wanted(c), i)), lambda i: i.isNotNull()), F.lit(1))

    def role(name: str):
        has = lambda c, words: sum((c.contains(w.lower()).cast("int") for w in words), F.lit(0)) > 0
        return lambda c: c.isNotNull() & has(c, roles[name]) & ~has(c, (without or {}).get(name, ())) & ~c.isin("date", "time")

    heads = heads.withColumn("names", F.slice("names", 1, FIELDS)).select("file", first(lambda c: c == "date").alias("_at_date"), first(lambda c: c == "time").alias("_at_time"), *[first(role(r)).alias(f"_role_{r}") for r in roles])
    heads = saved(heads, "headers")
    value = lambda place: F.trim(F.get("fields", F.col(place)))
    rows = lines.join(heads, "file").filter(value("_at_date").rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"))
    return rows.select(
        F.to_date(F.try_to_timestamp(value("_at_date"), F.lit("d/M/yyyy"))).alias("date"),
        F.split_part(value("_at_time"), F.lit(":"), F.lit(1)).try_cast("int").alias("hour_ending"),
        *[value(f"_role_{r}").try_cast("double").alias(r) for r in roles],
    )


def read_daily_series(spark: SparkSession, products: dict[str, str]) -> DataFrame:
    """One value a day per product file (name -> path; columns year, month, day, value), full outer on date.

    If tmax and tmin are among them, temp is the mean of those that are there."""
    out = None
    for name, path in products.items():
        raw = spark.read.schema("year int, month int, day int, value string").option("header", True).csv(path)
        one = raw.select(F.make_date("year", "month", "day").alias("date"), F.expr("try_cast(value AS double)").alias(name)).filter("date IS NOT NULL")
        out = one if out is None else out.join(one, "date", "full")
    if {"tmax", "tmin"} <= set(products):
        there = F.col("tmax").isNotNull().cast("int") + F.col("tmin").isNotNull().cast("int")
        out = out.withColumn("temp", F.when(there > 0, (F.coalesce("tmax", F.lit(0.0)) + F.coalesce("tmin", F.lit(0.0))) / there))
    return out


def read_json_sites(spark: SparkSession, path: str, schema: str, lat: str, lon: str) -> DataFrame:
    """An array of objects; those without a place are left out."""
    return spark.read.schema(schema).option("multiLine", True).json(path).dropna(subset=[lat, lon])


def read_reference_subset(spark: SparkSession, path: str, schema: str, columns: Sequence[str], key: str, order: Sequence[str]) -> DataFrame:
    """Some columns of a CSV file, the first row of each key in the given order."""
    raw = spark.read.schema(schema).option("header", True).csv(path)
    return dedupe_keep(raw, [key], order).select(*columns)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def stack_tables(parts: Sequence[DataFrame], labels: Sequence[dict[str, str]]) -> DataFrame:
    """Union by name with label columns in front where a part doesn't have them; missing columns are NULL."""
    out = None
    for part, label in zip(parts, labels, strict=True):
        new = [F.lit(v).alias(k) for k, v in label.items() if k not in part.columns]
        one = part.select(*new, "*")
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def index_prediction_files(spark: SparkSession, path: str, pattern: str, names: Sequence[str], folders: int = 0) -> DataFrame:
    """Rows of Parquet files with what the groups of pattern find in their names, with so many folders before them.

    Names are taken apart once a file, in a saved table that is joined to the rows."""
    raw = spark.read.parquet(path)
    file = F.col("_metadata.file_path")
    found = raw.select(file.alias("_file")).distinct()
    name = F.substring_index("_file", "/", -1 - folders)
    index = saved(found.select("_file", *[F.regexp_extract(name, pattern, i + 1).alias(n) for i, n in enumerate(names)]), "files")
    return raw.withColumn("_file", file).join(index, "_file").select(*[index[n] for n in names], *[raw[c] for c in raw.columns])
