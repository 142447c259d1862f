"""Session settings for local runs, and lineage cutting on shared storage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def local_session(cpus: int | str = 8, app: str = "hallkeeper", memory: str = "8g") -> SparkSession:
    """The session tests and the benchmark use; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder the cluster names in ``spark.checkpoint.dir``.

    Only a local master may fall back to a scratch folder of its own.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a shared folder")
            folder = tempfile.mkdtemp(prefix="run-checkpoints-", dir="/tmp")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder name on the shared storage."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back.

    Unlike ``checkpoint``, which carries over the plan's size estimates (they
    multiply with every join and explode over many rounds), the written table
    has the sizes of its files.
    """
    folder = new_folder(df.sparkSession, "cut")
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


class Journal:
    """Rows appended round by round to one folder of the shared storage, never rewritten.

    Each round is a folder of its own, so a round that is run again after a failure replaces only itself.
    """

    def __init__(self, spark: SparkSession, name: str, schema: str):
        self._spark, self._schema = spark, schema
        self._folder = new_folder(spark, name)
        # A round of its own, so that no round is written over while it is read.
        self.append(spark.createDataFrame([], schema), -1)

    def append(self, rows: DataFrame, number: int) -> DataFrame:
        """Add the rows of a round; gives them back as written."""
        types = StructType.fromDDL(self._schema)
        kept = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in types.fields])
        kept.write.mode("overwrite").parquet(f"{self._folder}/Round={number}")
        return self._spark.read.schema(self._schema).parquet(f"{self._folder}/Round={number}")

    def rows(self) -> DataFrame:
        """The rows of all rounds so far, with their Round."""
        return self._spark.read.schema(f"{self._schema}, Round int").parquet(self._folder)
