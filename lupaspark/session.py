"""Sessions, and the package on the executors."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors, once an application, so that their Python workers can import it wherever they run."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        home = Path(__file__).resolve().parent
        name = Path(tempfile.mkdtemp(prefix="lupaspark-")) / "lupaspark.zip"
        with zipfile.ZipFile(name, "w") as z:
            for f in sorted(home.rglob("*.py")):
                z.write(f, f.relative_to(home.parent))
        sc.addPyFile(str(name))
        _shipped.add(sc.applicationId)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str):
    """A given table; only the columns that a query selects are read."""
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, spark.checkpoint.dir. Where it is unset, one of our own if driver and executors are one machine, else an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lupaspark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/lupaspark/{tag}-{uuid.uuid4().hex}"


def grows(df: DataFrame) -> DataFrame:
    """One side of a join, whose rows grow with the input: both sides are sorted. By the size of its files, which compress well, Spark would take millions of rows for a small table and build it in the driver."""
    return df.hint("merge")


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder: lineage is cut, and a lost executor costs a task."""
    path = scratch(df.sparkSession, "step")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
