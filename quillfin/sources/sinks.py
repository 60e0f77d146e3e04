"""Writers. Spark's commit protocol makes each write visible as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_series(series: DataFrame, folder: str) -> None:
    """A macro table partitioned by indicator, each overwritten partition replaced as a whole."""
    series.write.mode("overwrite").partitionBy("indicator").option("partitionOverwriteMode", "dynamic").parquet(folder)


def write_trades(trades: DataFrame, folder: str) -> None:
    """Insider trades laid out for their access path: by issuer, sorted by date within."""
    trades.repartition("issuer").sortWithinPartitions("issuer", "transaction_date").write.mode("overwrite").partitionBy("issuer").parquet(folder)


def export_json(sessions: DataFrame, folder: str) -> None:
    """One JSON line for each row."""
    sessions.select(F.to_json(F.struct(*sessions.columns)).alias("value")).write.mode("overwrite").text(folder)


def export_text(messages: DataFrame, folder: str) -> None:
    """A transcript line for each message (session_id, turn, role, content), in order within a session."""
    lines = messages.repartition("session_id").sortWithinPartitions("session_id", "turn")
    lines.select(F.concat_ws(" ", F.concat(F.lit("["), "role", F.lit("]")), "content").alias("value")).write.mode("overwrite").text(folder)


_PLANS = "org.apache.spark.sql.catalyst.plans.logical."
#: Nodes of a parsed plan that do more than read: commands (all DDL, writes, settings, caching), statements yet to become commands, scripts of several statements, external programs.
REFUSED = ("Command", "ParsedStatement", "CompoundPlanStatement", "ScriptTransformation")
#: Functions that call any Java method.
REFUSED_FUNCTIONS = {"reflect", "java_method", "try_reflect"}


def _each(seq):
    return [seq.apply(i) for i in range(seq.size())]


def read_only_sql(spark: SparkSession, sql: str, limit: int = 100) -> DataFrame:
    """A query's first rows. The parsed plan decides: a plan with any node of a REFUSED class, in subqueries and named parts too, is refused, and so is a relation of several name parts that the catalogue lacks, as such a name can be a format and a path."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    load = plan.getClass().getClassLoader().loadClass
    refused = [load(_PLANS + c) for c in REFUSED]
    is_plan, is_function = load(_PLANS + "LogicalPlan").isInstance, load("org.apache.spark.sql.catalyst.analysis.UnresolvedFunction").isInstance
    is_relation = load("org.apache.spark.sql.catalyst.analysis.UnresolvedRelation").isInstance
    holds_plan = load("org.apache.spark.sql.catalyst.expressions.PlanExpression").isInstance
    stack = [plan]
    while stack:
        node = stack.pop()
        if any(c.isInstance(node) for c in refused):
            raise PermissionError("only queries are allowed")
        if is_function(node) and str(node.nameParts().last()).lower() in REFUSED_FUNCTIONS:
            raise PermissionError("this function is not allowed")
        if is_relation(node) and node.multipartIdentifier().size() > 1:
            if not spark.catalog.tableExists(".".join("`" + str(p).replace("`", "``") + "`" for p in _each(node.multipartIdentifier()))):
                raise PermissionError("only tables of the catalogue can be read")
        if holds_plan(node):
            stack.append(node.plan())
        stack += _each(node.children()) + [x for x in _each(node.innerChildren()) if is_plan(x)]
        if is_plan(node):
            stack += _each(node.expressions())
    return spark.sql(sql).limit(limit)


def table_list(spark: SparkSession) -> DataFrame:
    """Tables and views of the current schema."""
    return spark.sql("SHOW TABLES").select(F.col("tableName").alias("table_name"), "isTemporary").orderBy("table_name")


def table_schema(df: DataFrame) -> DataFrame:
    """Columns and types of a table, in order."""
    spark = df.sparkSession
    return spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate(df.dtypes)], "place int, column string, type string")


def described(tables: dict[str, DataFrame], foreign_keys: DataFrame, sample: int = 5) -> DataFrame:
    """Of each table, a row for each column: place, type, the table and column that it refers to, and its values in the first few rows as JSON.

    foreign_keys: table, column, refers_to, refers_column, a catalogue kept beside the tables, as files have none.
    """
    out = None
    for name, df in tables.items():
        rows = df.limit(sample)
        values = rows.agg(*[F.to_json(F.collect_list(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("null")))).alias(c) for c in df.columns])
        # One row of arrays becomes a row for each column.
        pairs = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(c).alias("column"), F.lit(t).alias("type"), F.col(f"`{c}`").alias("sample")) for i, (c, t) in enumerate(df.dtypes)])
        part = values.select(F.lit(name).alias("table"), F.explode(pairs).alias("x")).select("table", "x.*")
        out = part if out is None else out.unionByName(part)
    return out.join(foreign_keys.select("table", "column", "refers_to", "refers_column"), ["table", "column"], "left")
