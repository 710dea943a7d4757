"""Session helpers: where intermediate tables live and how small tables are carried."""

from __future__ import annotations

import os
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Rows a fitted table (class counts, vocabulary, scaler, cut-offs) may have to be
#: carried by the driver. Larger ones stay distributed as a written table.
PIN_ROWS = 50_000
#: Bytes such a table may have; a few rows of long strings are written as well.
PIN_BYTES = 32 * 1024 * 1024


def local_session(app: str = "skewlens", cores: str = "8", memory: str = "12g") -> SparkSession:
    """Session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor reaches, taken from ``spark.checkpoint.dir``.

    Only a local-mode session may go without the setting: it then gets a fresh
    temporary folder, since driver and executors are one process.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = spark.conf.get("skewlens.local.dir", None)
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        configured = tempfile.mkdtemp(prefix="skewlens-")
        spark.conf.set("skewlens.local.dir", configured)
    return configured.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """New folder below the shared one, grouped by application so that the files of
    finished applications are easy to tell apart."""
    app = spark.sparkContext.applicationId
    return os.path.join(shared_dir(spark), "skewlens", app, f"{name}-{uuid.uuid4().hex[:12]}")


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, a lost
    executor costs a re-read, and the optimizer knows the size from then on."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_staged(spark: SparkSession) -> bool:
    """Delete everything this application staged; tables read from it are gone. True if
    there was anything."""
    folder = os.path.join(shared_dir(spark), "skewlens", spark.sparkContext.applicationId)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def pin(df: DataFrame, max_rows: int = PIN_ROWS, name: str = "pinned") -> DataFrame:
    """Evaluate a fitted table once.

    Up to ``max_rows`` rows and ``PIN_BYTES`` it becomes a local relation, whose exact size
    lets the optimizer decide on a broadcast by itself; beyond that it is staged as a table
    and joins on it are shuffled.
    """
    table = df.limit(max_rows + 1).toArrow()
    if table.num_rows > max_rows or table.nbytes > PIN_BYTES:
        return stage(df, name)
    return df.sparkSession.createDataFrame(table, schema=df.schema)


def bounded_rows(df: DataFrame, max_rows: int, what: str) -> list:
    """Rows of a table that must be small by nature (columns, classes of a matrix)."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"{what}: more than {max_rows} rows")
    return rows


def local_table(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A few rows from the driver as a local relation: no job, exact size."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType.fromDDL(ddl)
    arrow = to_arrow_schema(schema)
    columns = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(arrow)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=arrow), schema=schema)
