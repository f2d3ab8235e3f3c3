"""Readers and writers: files in, tables out. All work through Spark's readers, so any store that it knows will do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.session import table


def read_csv(spark: SparkSession, path: str | list[str], schema: str | None = None, header: bool = True, delim: str = ",", quote: str = '"', null: str = "", union_by_name: bool = False, filename: bool = False, ignore_errors: bool = False, **options) -> DataFrame:
    """CSV with a given or inferred schema. ignore_errors drops rows that do not fit the schema."""
    mode = "DROPMALFORMED" if ignore_errors else "FAILFAST"
    opts = {"header": header, "sep": delim, "quote": quote, "escape": quote, "nullValue": null, "mode": mode, "multiLine": options.pop("multi_line", False), **options}

    def one(p) -> DataFrame:
        r = spark.read.options(**opts)
        return (r.schema(schema) if schema else r.option("inferSchema", True)).csv(p)

    if union_by_name and isinstance(path, list):
        out = one(path[0])
        for p in path[1:]:
            out = out.unionByName(one(p), allowMissingColumns=True)
    else:
        out = one(path)
    return out.withColumn("filename", F.col("_metadata.file_path")) if filename else out


def sniff_csv(spark: SparkSession, path: str, lines: int = 200) -> dict:
    """Delimiter, header, and inferred columns from the first lines of a CSV file."""
    head = [r.value for r in spark.read.text(path).limit(lines).collect()]
    best, delim = 0.0, ","
    for d in (",", "\t", ";", "|"):
        n = [h.count(d) for h in head if h]
        score = sum(x == n[0] for x in n) / len(n) * (n[0] > 0) * (1 + n[0] / 100) if n else 0
        if score > best:
            best, delim = score, d
    first = head[0].split(delim) if head else []
    number = lambda x: x.strip().lstrip("-").replace(".", "", 1).isdigit()
    header = bool(first) and not any(map(number, first)) and (len(head) == 1 or any(number(x) for h in head[1:] for x in h.split(delim)) or len(set(first)) == len(first))
    df = read_csv(spark, path, header=header, delim=delim)
    return {"delim": delim, "header": header, "columns": dict(df.dtypes)}


def read_parquet(spark: SparkSession, path: str | list[str], union_by_name: bool = False, filename: bool = False, hive_partitioning: bool = True) -> DataFrame:
    paths = [path] if isinstance(path, str) else path
    r = spark.read.option("mergeSchema", union_by_name)
    df = (r if hive_partitioning else r.option("recursiveFileLookup", True)).parquet(*paths)
    return df.withColumn("filename", F.col("_metadata.file_path")) if filename else df


def read_json(spark: SparkSession, path: str | list[str], schema: str | None = None, array: bool = False) -> DataFrame:
    """Lines of JSON objects, or (array) files of one array each."""
    r = spark.read.option("multiLine", array)
    return (r.schema(schema) if schema else r).json(path)


read_ndjson = read_json


def read_json_objects(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("value").alias("json"))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """A row for each file: filename, content, size, last_modified."""
    b = read_blob(spark, path)
    return b.withColumn("content", F.decode("content", "UTF-8"))


def read_blob(spark: SparkSession, path: str) -> DataFrame:
    b = spark.read.format("binaryFile").load(path)
    return b.select(F.col("path").alias("filename"), "content", F.col("length").alias("size"), F.col("modificationTime").alias("last_modified"))


def glob(spark: SparkSession, pattern: str) -> DataFrame:
    """Names of the files that match; contents are not read."""
    return spark.read.format("binaryFile").load(pattern).select(F.col("path").alias("file"))


def read_arrow(spark: SparkSession, data) -> DataFrame:
    return spark.createDataFrame(data)


def parquet_schema(spark: SparkSession, path: str) -> DataFrame:
    return spark.createDataFrame([(f.name, f.dataType.simpleString(), f.nullable) for f in spark.read.parquet(path).schema], "name string, type string, nullable boolean")


def parquet_files(spark: SparkSession, path: str) -> DataFrame:
    """Rows and bytes of each file."""
    return spark.read.parquet(path).groupBy(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes")).count()


def copy_to(df: DataFrame, path: str, format: str = "parquet", partition_by: list[str] = [], mode: str = "error", order: list = [], single_file: bool = False, rows_per_file: int | None = None, compression: str | None = None, **options) -> None:  # noqa: A002, B006
    """COPY TO: hive partitions, files in an order (range-partitioned; one file if asked for), bounded files."""
    if order:
        df = df.coalesce(1).sortWithinPartitions(*order) if single_file else df.repartitionByRange(*order).sortWithinPartitions(*order)
    elif single_file:
        df = df.coalesce(1)
    elif partition_by:
        df = df.repartition(*partition_by, F.pmod(F.spark_partition_id(), F.lit(8)))  # few files a partition, hot ones still on many tasks
    w = df.write.mode(mode).options(**options)
    if compression:
        w = w.option("compression", compression)
    if rows_per_file:
        w = w.option("maxRecordsPerFile", rows_per_file)
    if format == "csv":
        w = w.option("header", options.get("header", True)).option("escape", '"').option("emptyValue", "")
    (w.partitionBy(*partition_by) if partition_by else w).format(format).save(path)


def export_database(spark: SparkSession, path: str, database: str = "default", format: str = "parquet") -> list[str]:  # noqa: A002
    names = [t.name for t in spark.catalog.listTables(database) if t.tableType != "TEMPORARY"]
    for t in names:
        copy_to(spark.table(f"{database}.{t}"), f"{path}/{t}", format)
    return names


def import_database(spark: SparkSession, path: str, names: list[str], database: str = "default") -> None:
    for t in names:
        spark.read.parquet(f"{path}/{t}").write.saveAsTable(f"{database}.{t}")


def summary(df: DataFrame) -> DataFrame:
    """A row for each column: type, min, max, count, distinct count (approximate), share of nulls; one pass."""
    made = []
    for f in df.schema.fields:
        x = F.col(f"`{f.name}`")
        plain = f.dataType.typeName() not in ("array", "map", "struct", "variant")
        made.append(F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"), (F.min(x).cast("string") if plain else F.lit(None).cast("string")).alias("min"), (F.max(x).cast("string") if plain else F.lit(None).cast("string")).alias("max"), F.count(x).alias("count"), (F.approx_count_distinct(x) if plain else F.lit(None).cast("long")).alias("approx_unique"), F.round(100 * F.avg(x.isNull().cast("int")), 2).alias("null_percent")))
    return df.agg(F.array(*made).alias("s")).select(F.inline("s"))


def repeat_row(spark: SparkSession, n: int, *values) -> DataFrame:
    return spark.range(n).select(*(F.lit(v).alias(f"column{i}") for i, v in enumerate(values)))


def query_table(spark: SparkSession, sf_dir: str, *names: str, by_name: bool = False) -> DataFrame:
    """UNION ALL of tables by their names."""
    out = table(spark, sf_dir, names[0])
    for n in names[1:]:
        more = table(spark, sf_dir, n)
        out = out.unionByName(more, allowMissingColumns=True) if by_name else out.unionAll(more)
    return out


def tables(spark: SparkSession) -> DataFrame:
    """Tables and views of the session."""
    rows = [(t.name, t.tableType, t.isTemporary) for t in spark.catalog.listTables()]
    return spark.createDataFrame(rows, "name string, type string, temporary boolean")


def columns(spark: SparkSession, name: str) -> DataFrame:
    rows = [(name, c.name, i, c.dataType, c.nullable) for i, c in enumerate(spark.catalog.listColumns(name))]
    return spark.createDataFrame(rows, "table_name string, column_name string, place int, type string, nullable boolean")


def settings(spark: SparkSession) -> DataFrame:
    return spark.sql("SET -v").select(F.col("key").alias("name"), "value", F.col("meaning").alias("description"))
