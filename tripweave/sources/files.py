"""File sources and sinks: csv, json, parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..schema import BASE_DAILY, TRIP_RAW
from ..session import one_row

_BY_SUFFIX = {".csv": "csv", ".json": "json", ".parquet": "parquet"}


def file_type(path: str) -> str:
    for suffix, kind in _BY_SUFFIX.items():
        if path.rstrip("/*").endswith(suffix):
            return kind
    raise ValueError(f"cannot tell the file type of {path}")


def trip_csv_headers(spark: SparkSession, pattern: str, schema: T.StructType = TRIP_RAW) -> DataFrame:
    """(source_file, path, header, good) of every non-empty file that matches a glob; good: its header names the columns.

    Only the first block of a file is looked at, and of a damaged one what can be read, as the header alone counts here.
    """
    lines = (
        spark.read.option("ignoreCorruptFiles", True).text(pattern)
        .where(F.col("_metadata.file_block_start") == 0)
        .select("value", F.col("_metadata.file_name").alias("source_file"), F.col("_metadata.file_path").alias("path"),
                F.monotonically_increasing_id().alias("pos"))
    )
    heads = lines.groupBy("source_file", "path").agg(F.min_by("value", "pos").alias("header"))
    names = F.transform(F.split("header", ","), lambda c: F.lower(F.btrim(F.btrim(c), F.lit('"\ufeff'))))
    want = F.array(*[F.lit(f.name.lower()) for f in schema.fields])
    path = F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B")))
    return heads.select("source_file", path.alias("path"), "header", (names == want).alias("good"))


def read_trip_csv(spark: SparkSession, pattern: str, schema: T.StructType = TRIP_RAW,
                  skip_bad_files: bool = False) -> DataFrame:
    """All CSV files that match a glob, as one table with ``source_file``.

    Header names are checked per file, blanks around them ignored.  A file with another header fails the read or, on
    request, is left out as a whole; ``trip_csv_headers`` reports which.  A file that is damaged further on always
    fails the read: it never gives part of its rows.  No match or no row is an error.
    """
    paths: str | list[str] = pattern
    if skip_bad_files:
        good = trip_csv_headers(spark, pattern, schema).where("good").select("path")
        paths = [row["path"] for row in good.collect()]  # file names, which the driver lists anyway
        if not paths:
            raise ValueError(f"no trip file with the wanted header in {pattern}")
    df = (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", False)
        .option("ignoreLeadingWhiteSpace", True)
        .option("ignoreTrailingWhiteSpace", True)
        .option("ignoreCorruptFiles", False)
        .csv(paths)
        .withColumn("source_file", F.col("_metadata.file_name"))
    )
    if df.isEmpty():
        raise ValueError(f"no trip rows could be loaded from {pattern}")
    return df


def read_single_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """One CSV with ``source_file`` as a literal; columns inferred when no schema is given."""
    rd = spark.read.option("header", True)
    rd = rd.schema(schema) if schema is not None else rd.option("inferSchema", True)
    return rd.csv(path).withColumn("source_file", F.lit(path.rstrip("/").rsplit("/", 1)[-1]))


def latest_path(spark: SparkSession, folder: str, pattern: str) -> str:
    """The lexicographically last data set of a folder; names carry the time stamp.

    Only file names are listed: the content column of the source is pruned.
    """
    names = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{folder}/{pattern}")
             .select(F.regexp_extract("path", "(.*" + folder.rstrip("/").rsplit("/", 1)[-1] + "/[^/]+)", 1).alias("p")))
    found = one_row(names.agg(F.max("p").alias("p")))["p"]
    if found is None:
        raise FileNotFoundError(f"{folder}/{pattern}")
    return found


def read_latest(spark: SparkSession, folder: str, pattern: str, schema: T.StructType | None = None) -> DataFrame:
    return read_any(spark, latest_path(spark, folder, pattern), schema)


def read_any(spark: SparkSession, path: str, schema: T.StructType | None = None, kind: str | None = None,
             multi_line: bool = False) -> DataFrame:
    """csv / json / parquet by suffix; json is one record per line unless ``multi_line``."""
    kind = kind or file_type(path)
    rd = spark.read
    if schema is not None:
        rd = rd.schema(schema)
    if kind == "csv":
        rd = rd.option("header", True)
        if schema is None:
            rd = rd.option("inferSchema", True)
    if kind == "json":
        rd = rd.option("multiLine", multi_line)
    return rd.format(kind).load(path)


def write_any(df: DataFrame, path: str, kind: str | None = None, partition_by: str | None = None,
              mode: str = "overwrite") -> str:
    """Write by suffix.  Rows are first clustered on the partition column, so
    that a date folder gets few files rather than one from every task."""
    kind = kind or file_type(path)
    if partition_by:
        # rebalance splits a hot partition value over several tasks
        df = df.hint("rebalance", partition_by)
    w = df.write.mode(mode).format(kind)
    if kind == "csv":
        w = w.option("header", True)
    if partition_by:
        w = w.partitionBy(partition_by)
    w.save(path)
    return path


def load_all_sources(spark: SparkSession, patterns: dict[str, str], schemas: dict[str, T.StructType]) -> dict[str, DataFrame]:
    """Lazy table per source; a source that cannot be opened is left out."""
    out = {}
    for name, pattern in patterns.items():
        try:
            out[name] = read_any(spark, pattern, schemas.get(name), "csv")
        except Exception as ex:  # an absent source must not stop the others
            if "PATH_NOT_FOUND" not in str(ex):
                raise
    return out


def read_base_daily(spark: SparkSession, path: str) -> DataFrame:
    """Daily activity per base: dates like 1/31/2015, any line end."""
    return spark.read.schema(BASE_DAILY).option("header", True).option("dateFormat", "M/d/yyyy").csv(path)


def catalog(spark: SparkSession, folder: str) -> DataFrame:
    """Per file: name, size, time, suffix; for CSV also header and row count."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
        .select("path", (F.col("length") / (1024.0 * 1024.0)).alias("size_mb"), F.col("modificationTime").alias("modified"),
                F.regexp_extract("path", "[^/]+$", 0).alias("file_name"))
        .withColumn("file_type", F.regexp_extract("file_name", r"(\.[A-Za-z0-9]+)$", 1))
    )
    lines = (
        spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").text(folder)
        .select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"),
                F.monotonically_increasing_id().alias("pos"))
    )
    # ids grow along a split, so the least one of the first block is the header line
    first = F.min_by("value", F.when(F.col("start") == 0, F.col("pos")))
    csv = lines.groupBy("path").agg((F.count("*") - 1).alias("n_rows"), first.alias("header"))
    csv = csv.withColumn("path", F.regexp_replace("path", "^file:/+", "/"))
    files = files.withColumn("path", F.regexp_replace("path", "^file:/+", "/"))
    return files.join(csv, "path", "left").select(
        "file_name", "size_mb", "modified", "file_type", F.split("header", ",").alias("columns"), "n_rows")
