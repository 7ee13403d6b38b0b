"""Session helpers shared by the benchmark, the tests and the driver contract."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parents[1]


def build_session(cpus: int = 8, app: str = "tessera", **conf: str) -> SparkSession:
    """A local session with the settings the engine is tuned for (UTC, AQE, Arrow)."""
    settings = {
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("TESSERA_DRIVER_MEMORY", "8g"),
    } | conf
    spark = SparkSession.builder.master(f"local[{cpus}]").appName(app).config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return with_package(spark)


def with_package(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package: locally by path, on a cluster as an archive
    that Spark hands to each executor."""
    context = spark.sparkContext
    if is_local(spark):
        env = context.environment
        have = env.get("PYTHONPATH", "")
        if str(ROOT) not in have.split(os.pathsep):
            env["PYTHONPATH"] = os.pathsep.join(x for x in (str(ROOT), have) if x)
    elif not any(name.startswith("tessera-package") for name in context._python_includes):
        folder = context._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
        system = folder.getFileSystem(context._jsc.hadoopConfiguration())
        shared = context._jvm.org.apache.hadoop.fs.Path(folder, f"tessera-package-{context.applicationId}.zip")
        with tempfile.TemporaryDirectory() as own:
            archive = Path(own) / "package.zip"
            with zipfile.ZipFile(archive, "w") as out:
                for file in sorted((ROOT / "tessera").rglob("*.py")):
                    out.write(file, file.relative_to(ROOT))
            system.copyFromLocalFile(context._jvm.org.apache.hadoop.fs.Path(archive.as_uri()), shared)
        context.addPyFile(system.makeQualified(shared).toString())
    return spark


def is_local(spark: SparkSession) -> bool:
    return re.match(r"local(\[|$)", spark.sparkContext.master) is not None


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; an own one only in a local session where
    none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not is_local(spark):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "/tmp/checkpoints"
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path for a table of this application in the shared folder."""
    return f"{shared_dir(spark)}/tessera-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Write df to the shared folder and read it back, so that a lost executor costs
    no recomputation of what lies before it and statistics are those of the data.
    ``by``: columns that part the table into folders, the last columns of df."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path, partitionBy=list(by))
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that ``materialise`` wrote, once nothing reads it any more."""
    delete_folder(df.sparkSession, df._tessera_path)


def discard_tables(spark: SparkSession) -> None:
    """Delete all tables that operators wrote to the shared folder for this application;
    results that read them are void afterwards."""
    delete_folder(spark, f"{shared_dir(spark)}/tessera-{spark.sparkContext.applicationId}")


def delete_folder(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
