"""Documents and files as tables: the members of JSON values, and what Parquet files say of themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.functions.documents import kind_of, path_of

FOOTER = "file_name string, row_group_id long, row_group_num_rows long, column_id int, path_in_schema string, type string, num_values long, stats_null_count long, stats_min string, stats_max string, compression string, total_compressed_size long, total_uncompressed_size long"


def members(df: DataFrame, value: str) -> DataFrame:
    """Each row with the members of its variant column `value`: __pos, __key (null in lists) and __value."""
    e = df.sparkSession.tvf.variant_explode(F.col(value).outer())
    return df.lateralJoin(e.select(F.col("pos").alias("__pos"), F.col("key").alias("__key"), F.col("value").alias("__value")))


def json_each(df: DataFrame, column: str, path: str = "$") -> DataFrame:
    """The columns of df with key, value (JSON text) and type of each member of the value at a path; null and scalar values have none."""
    v = F.try_variant_get(F.try_parse_json(F.col(column)), path_of(path), "variant")
    held = members(df.withColumn("__in", v), "__in")
    return held.select(*df.columns, F.coalesce("__key", F.col("__pos").cast("string")).alias("key"), F.to_json("__value").alias("value"), kind_of(F.col("__value")).alias("type"))


def json_tree(df: DataFrame, column: str, most_depth: int = 64) -> DataFrame:
    """The columns of df with key, value, type, fullkey and depth of every value in a document, itself included.

    A level at a time: each is the members of the one before, until none is left.
    """
    from tarnlake.stats.blocks import saved

    level = df.withColumn("__value", F.try_parse_json(F.col(column))).filter("__value IS NOT NULL").withColumn("key", F.lit(None).cast("string")).withColumn("fullkey", F.lit("$"))
    out = None
    for depth in range(most_depth):
        level = saved(level.select(*df.columns, "key", "fullkey", F.col("__value")), "json-level")
        if depth and level.isEmpty():
            return out
        one = level.select(*df.columns, "key", F.to_json("__value").alias("value"), kind_of(F.col("__value")).alias("type"), "fullkey", F.lit(depth).alias("depth"))
        out = one if out is None else out.unionAll(one)
        deep = level.filter(kind_of(F.col("__value")).isin("OBJECT", "ARRAY")).withColumnRenamed("__value", "__in").withColumnRenamed("fullkey", "__above").drop("key")
        step = F.when(F.col("__key").isNull(), F.concat(F.lit("["), F.col("__pos").cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("."), F.col("__key")))
        level = members(deep, "__in").withColumn("key", F.coalesce("__key", F.col("__pos").cast("string"))).withColumn("fullkey", F.concat("__above", step))
    raise RecursionError(f"values nested more than {most_depth} deep")


def _footers(spark: SparkSession, path: str):
    """(name, footer) of each Parquet file under a path, through the store that Spark reads it with; footers alone are read."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name in sorted(spark.read.parquet(path).inputFiles()):
        at = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(name))
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(at, conf))
        try:
            yield name, reader.getFooter()
        finally:
            reader.close()


def _each(listed) -> list:
    return [listed.get(i) for i in range(listed.size())]


def parquet_metadata(spark: SparkSession, path: str) -> DataFrame:
    """A row for each column of each row group of each file."""
    rows = []
    for name, footer in _footers(spark, path):
        for g, block in enumerate(_each(footer.getBlocks())):
            for i, c in enumerate(_each(block.getColumns())):
                s = c.getStatistics()
                known = s is not None and s.hasNonNullValue()
                rows.append((name, g, block.getRowCount(), i, c.getPath().toDotString(), c.getPrimitiveType().getPrimitiveTypeName().toString(), c.getValueCount(), s.getNumNulls() if s is not None and s.isNumNullsSet() else None, s.minAsString() if known else None, s.maxAsString() if known else None, c.getCodec().toString(), c.getTotalSize(), c.getTotalUncompressedSize()))
    return spark.createDataFrame(rows, FOOTER)


def parquet_file_metadata(spark: SparkSession, path: str) -> DataFrame:
    """A row for each file: who wrote it, its rows and row groups."""
    rows = []
    for name, footer in _footers(spark, path):
        blocks = _each(footer.getBlocks())
        rows.append((name, footer.getFileMetaData().getCreatedBy(), sum(b.getRowCount() for b in blocks), len(blocks)))
    return spark.createDataFrame(rows, "file_name string, created_by string, num_rows long, num_row_groups long")


def parquet_kv_metadata(spark: SparkSession, path: str) -> DataFrame:
    """A row for each key that a file keeps a text under."""
    rows = []
    for name, footer in _footers(spark, path):
        held = footer.getFileMetaData().getKeyValueMetaData()
        keys = held.keySet().toArray()
        rows += [(name, str(k), str(held.get(k))) for k in keys]
    return spark.createDataFrame(rows, "file_name string, key string, value string")


def test_all_types(spark: SparkSession) -> DataFrame:
    """A column of each type, with its least value, its largest, and a null."""
    kinds = {"boolean": ("false", "true"), "tinyint": ("-128", "127"), "smallint": ("-32768", "32767"), "int": ("-2147483648", "2147483647"), "bigint": ("-9223372036854775808", "9223372036854775807"), "float": ("-3.4028234663852886E38", "3.4028234663852886E38"), "double": ("-1.7976931348623157E308", "1.7976931348623157E308"), "decimal(38,10)": ("-9999999999999999999999999999.9999999999", "9999999999999999999999999999.9999999999"), "string": ("", "goo\u0000se"), "date": ("0001-01-01", "9999-12-31"), "timestamp_ntz": ("0001-01-01 00:00:00", "9999-12-31 23:59:59.999999")}
    name = lambda k: k.split("(")[0].replace(" ", "_")
    rows = [spark.range(1).select(*(F.lit(v[i]).cast(k).alias(name(k)) if i < 2 else F.lit(None).cast(k).alias(name(k)) for k, v in kinds.items())) for i in range(3)]
    return rows[0].unionAll(rows[1]).unionAll(rows[2])
