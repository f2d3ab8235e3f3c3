"""Statement forms: prepared statements, variables, settings, macros, user functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class Prepared:
    """A statement with named parameters (:name), run with values each time; values are bound, never pasted."""

    def __init__(self, spark: SparkSession, text: str):
        self.spark, self.text = spark, text

    def execute(self, **values) -> DataFrame:
        return self.spark.sql(self.text, args=values)


def set_variable(spark: SparkSession, name: str, kind: str, value) -> None:
    spark.sql(f"DECLARE OR REPLACE VARIABLE {name} {kind}")
    spark.sql(f"SET VAR {name} = :v", args={"v": value})


def scalar_macro(spark: SparkSession, name: str, params: str, returns: str, body: str) -> None:
    """A SQL function that Catalyst inlines."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {returns} RETURN {body}")


def table_macro(spark: SparkSession, name: str, params: str, returns: str, body: str) -> None:
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS TABLE ({returns}) RETURN {body}")


def reset(spark: SparkSession, name: str) -> None:
    spark.conf.unset(name)


def plan_text(df: DataFrame, mode: str = "formatted") -> str:
    """The plan that explain shows."""
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))


def set_option(spark: SparkSession, name: str, value) -> None:
    spark.conf.set(name, str(value))


def create_schema(spark: SparkSession, name: str, replace: bool = False) -> None:
    if replace:
        drop(spark, "SCHEMA", name, cascade=True)
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS `{name}`")


def drop(spark: SparkSession, kind: str, name: str, cascade: bool = False) -> None:
    """DROP TABLE, VIEW, SCHEMA, FUNCTION or TEMPORARY VARIABLE; what is not there is no error."""
    quoted = ".".join(f"`{x}`" for x in name.split("."))
    spark.sql(f"DROP {kind} IF EXISTS {quoted}{' CASCADE' if cascade and kind == 'SCHEMA' else ''}")


def analyze(spark: SparkSession, name: str, columns: list[str] | None = None) -> DataFrame:
    """ANALYZE a table of the catalog for the optimiser; its statistics as (name, value)."""
    spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS" + (f" FOR COLUMNS {', '.join(columns)}" if columns else ""))
    return spark.sql(f"DESCRIBE EXTENDED {name}").filter("col_name IN ('Statistics', 'Type', 'Provider')").selectExpr("col_name AS name", "data_type AS value")


def streamed(df: DataFrame, ahead: bool = True):
    """Rows one after the other, a partition at a time in memory (the next is fetched ahead), in the order of the plan."""
    yield from df.toLocalIterator(prefetchPartitions=ahead)


def explain_analyze(df: DataFrame) -> DataFrame:
    """Runs a query and tells, for each operator of its final plan, the rows that came out: (place, depth, operator, n_rows)."""
    plan = df._jdf.queryExecution().executedPlan()
    plan.execute().count()
    rows: list[tuple] = []

    def walk(node, depth: int) -> None:
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(node.executedPlan(), depth)
        held = node.metrics().get("numOutputRows")
        rows.append((len(rows), depth, name, held.get().value() if held.isDefined() else None))
        inside = node.plan() if name.endswith("QueryStage") else None
        for child in [inside] if inside is not None else [node.children().apply(i) for i in range(node.children().size())]:
            walk(child, depth + 1)

    walk(plan, 0)
    return df.sparkSession.createDataFrame(rows, "place int, depth int, operator string, n_rows long")
