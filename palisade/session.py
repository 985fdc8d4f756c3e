"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# Settings the operators rely on; all can be set on a running session.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A task keeps a few files open, one a folder, and sorts its rows only beyond that.
    "spark.sql.maxConcurrentOutputFileWriters": "4",
    # The JVM never compiles longer methods; steps whose code is longer are run one by one instead of as one method.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(app: str = "palisade", cores: str = "8") -> SparkSession:
    """A session for tests and the bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", cores)
    )
    spark = configure(builder.getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only a local master may go without it: there one machine holds every task,
    so a temporary folder is shared by definition.
    """
    context = spark.sparkContext
    folder = (
        spark.conf.get("spark.checkpoint.dir", None)
        or context.getConf().get("spark.checkpoint.dir")
        or context.getCheckpointDir()
    )
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        folder = tempfile.mkdtemp(prefix="palisade-")
        context.setCheckpointDir(folder)
    return folder


def local_rows(spark: SparkSession, rows: list[tuple], schema: T.StructType) -> DataFrame:
    """A table of rows the driver has, of a size the planner knows, so that it can decide
    whether to broadcast it."""
    names = schema.names
    columns = [list(c) for c in zip(*rows)] or [[] for _ in names]
    arrow = to_arrow_schema(schema)
    arrays = [pa.array([_plain(v, f.dataType) for v in c], a.type) for c, f, a in zip(columns, schema, arrow)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=arrow), schema)


def _plain(value, kind: T.DataType):
    """Structs as dicts, as Arrow wants them."""
    if value is not None and isinstance(kind, T.ArrayType):
        return [_plain(v, kind.elementType) for v in value]
    if value is not None and isinstance(kind, T.StructType):
        return dict(zip(kind.names, value))
    return value


_WRITTEN: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read back.

    Cuts the lineage, so that several readers see the same rows and a lost executor
    costs no recomputation of what came before. Columnar, so each reader fetches only
    its columns.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    _WRITTEN.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that :func:`written` returned, once all that is made of them is written too."""
    for table in tables:
        path, spark = table.written_path, table.sparkSession
        if path in _WRITTEN:
            _WRITTEN.remove(path)
        delete_path(spark, path)


def written_so_far() -> set[str]:
    """The paths of the tables that :func:`written` made and nobody deleted."""
    return set(_WRITTEN)


def discard_since(before: set[str], spark: SparkSession, *kept: DataFrame) -> None:
    """Delete the tables written since ``before`` was taken, but for those that are kept."""
    stay = before | {table.written_path for table in kept}
    for path in [p for p in _WRITTEN if p not in stay]:
        _WRITTEN.remove(path)
        delete_path(spark, path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def drop_written(spark: SparkSession) -> int:
    """Delete the tables :func:`written` made in this process, once nothing reads them
    any more; returns how many there were."""
    count = len(_WRITTEN)
    while _WRITTEN:
        delete_path(spark, _WRITTEN.pop())
    return count


def ship_packages(spark: SparkSession, *folders: str) -> None:
    """Send Python packages to the executors, once per session.

    Functions that run in Python workers are pickled by module name, so workers
    need the module. A cluster that already installs the package can skip this.
    """
    marker = "spark.palisade.shipped"
    if spark.conf.get(marker, None):
        return
    target = os.path.join(tempfile.mkdtemp(prefix="palisade-code-"), "palisade_code.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for folder in folders:
            base = os.path.dirname(os.path.abspath(folder))
            for where, _, files in os.walk(folder):
                for name in files:
                    if name.endswith(".py"):
                        full = os.path.join(where, name)
                        archive.write(full, os.path.relpath(full, base))
    spark.sparkContext.addPyFile(target)
    spark.conf.set(marker, "true")
