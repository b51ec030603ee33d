"""Session settings and the shared scratch area used to cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

_CHECKPOINT_DIR = "spark.checkpoint.dir"

# Runtime settings the operators rely on.  Skewed sort-merge joins are split
# even where that costs the operator above its co-partitioning.
_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings; cluster sizing stays with whoever built the session."""
    for key, value in _SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_table(spark: SparkSession, rows: Sequence[Sequence], schema: T.StructType | str) -> DataFrame:
    """A few rows as a relation whose size Spark knows, so that joins can plan with it."""
    struct = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(struct)
    if len(columns) != len(struct):
        raise ValueError(f"rows have {len(columns)} fields, the schema {len(struct)}")
    kinds = to_arrow_schema(struct)
    arrays = [pa.array(c, kind) for c, kind in zip(columns, kinds.types, strict=True)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=kinds), struct)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session may go without the setting: it gets a temporary folder.
    On a cluster a folder of one machine would be lost with that machine, so a
    missing setting is an error there.
    """
    root = spark.conf.get(_CHECKPOINT_DIR, None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError(f"set {_CHECKPOINT_DIR} to a folder every executor can reach")
        root = tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set(_CHECKPOINT_DIR, root)
    return f"{root.rstrip('/')}/millrace-{_application(spark)}"


def scratch_path(spark: SparkSession, label: str = "copy") -> str:
    """A fresh path in the scratch area."""
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the scratch area and read it back.

    Unlike ``checkpoint()`` the copy is columnar, so later passes read only the
    columns they use; it also outlives the executors that wrote it.
    """
    spark = df.sparkSession
    path = scratch_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_row_tag(df: DataFrame, name: str) -> DataFrame:
    """Add a unique number that a retried task computes again for the same row.

    Rows read from files keep their order; rows that come out of a shuffle may not,
    so these are written down before they are numbered.
    """
    plan = df._jdf.queryExecution().executedPlan().toString()
    stable = materialize(df) if _SHUFFLE.search(plan) else df
    return stable.withColumn(name, F.monotonically_increasing_id())


_SHUFFLE = re.compile(r"\bExchange (hashpartitioning|rangepartitioning|RoundRobinPartitioning|SinglePartition)")


def release_scratch(spark: SparkSession) -> None:
    """Delete every scratch copy of this application (call when its results are written)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _application(spark: SparkSession) -> str:
    return spark.conf.get("spark.app.id", "session")
