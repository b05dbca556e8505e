"""Sources and sinks: JSON lines, question lists, graph tables, reports."""

from __future__ import annotations

import tempfile

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom import schemas


def shared_folder(spark: SparkSession) -> str:
    """Where intermediate data go: the folder that ``spark.checkpoint.dir`` names, which driver and executors share.

    Without one, a session on this machine alone gets a temporary folder; on a cluster that is an error, since data in an
    executor's own folder would be lost with it.
    """
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir is not set: intermediate data need a folder that all executors share")
    return tempfile.mkdtemp(prefix="loom-")


def saved(df: DataFrame) -> DataFrame:
    """The rows, computed once and kept in the shared folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def read_jsonl(spark: SparkSession, path: str, schema: str, text: str | None = "text", limit: int | None = None, order: str | None = None) -> DataFrame:
    """Rows of JSON lines under a schema; blank lines and rows with an empty ``text`` are dropped.

    A missing path gives an empty table.  ``limit`` keeps the first rows by ``order``.
    """
    try:
        df = spark.read.schema(schema).json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        df = spark.createDataFrame([], schema)
    if text and text in df.columns:
        df = df.where(F.coalesce(F.col(text), F.lit("")) != "")
    if limit is not None:
        df = df.orderBy(order or df.columns[0]).limit(limit)
    return df


def write_rows(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Rows as Parquet or JSON lines (UTF-8)."""
    df.write.mode(mode).format(fmt).save(path)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of questions; a missing id becomes q and the position in the list, from 1."""
    wide = spark.read.option("multiLine", True).schema(schemas.QUESTIONS).json(path)
    text = spark.read.option("wholetext", True).text(path).select(F.trim("value").alias("value"))
    if text.where(~F.col("value").startswith("[")).limit(1).count():
        raise ValueError("questions must be a JSON list")
    kind = T.ArrayType(T.StructType.fromDDL(schemas.QUESTIONS))
    rows = text.select(F.posexplode(F.from_json("value", kind)).alias("pos", "q"))
    return rows.select(
        F.coalesce(F.col("q.id"), F.format_string("q%03d", F.col("pos") + 1)).alias("id"), *[f"q.{c}" for c in wide.columns if c != "id"]
    )


def _escaped(c: Column) -> Column:
    return F.regexp_replace(c, r'(["\\])', r"\\$1")


def write_graph(tables: dict[str, DataFrame], folder: str, fmt: str = "parquet") -> None:
    """The graph tables, as Parquet or ``psv``: pipe-separated, header, no quotes, backslash as escape."""
    for name, df in tables.items():
        out = f"{folder.rstrip('/')}/{name}"
        if fmt == "parquet":
            df.write.mode("overwrite").parquet(out)
        else:
            plain = df.select(*[_escaped(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])
            plain.write.mode("overwrite").csv(out, sep="|", header=True, quote="\u0000", escape="\\", emptyValue="", encoding="UTF-8", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def read_graph(spark: SparkSession, folder: str, fmt: str = "parquet") -> dict[str, DataFrame]:
    """The graph tables with their types."""
    out = {}
    for name, schema in schemas.GRAPH.items():
        path = f"{folder.rstrip('/')}/{name}"
        if fmt == "parquet":
            out[name] = spark.read.schema(schema).parquet(path)
            continue
        df = spark.read.schema(schema).csv(path, sep="|", header=True, quote="\u0000", escape="\u0000", emptyValue="", nullValue="\u0000")
        out[name] = df.select(
            *[F.regexp_replace(F.coalesce(c, F.lit("")), r'\\(["\\])', "$1").alias(c) if t == "string" else F.col(c) for c, t in df.dtypes]
        )
    return out


def write_report(df: DataFrame, path: str) -> None:
    """A report of one row as one JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def dedup_vertices(df: DataFrame, key: str, order: list[str] | None = None) -> DataFrame:
    """One row a key: the first by ``order`` (all other columns by default)."""
    by = [F.col(c) for c in (order or [c for c in df.columns if c != key])] or [F.lit(0)]
    return df.withColumn("loom_n", F.row_number().over(Window.partitionBy(key).orderBy(*by))).where("loom_n = 1").drop("loom_n")
