"""Session settings and the checkpoint folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("loomgraph")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors of a session, once, so that they can import it wherever they run."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="loomgraph-package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = Path(folder) / "loomgraph.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    context.addPyFile(str(archive))


_SHIPPED: set[str] = set()


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it in `spark.checkpoint.dir`.

    Unset, a local session (whose machine is the whole cluster, as in tests) gets a folder of its own that is deleted at the
    end; on a cluster it is an error.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir() if hasattr(context, "getCheckpointDir") else None
    if current:
        return current
    wanted = spark.conf.get("spark.checkpoint.dir", None)
    if not wanted:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        wanted = tempfile.mkdtemp(prefix="loomgraph-")
        atexit.register(shutil.rmtree, wanted, ignore_errors=True)
    context.setCheckpointDir(wanted)
    return wanted


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new place within the shared folder, for a table that a query writes."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def move_folder(spark: SparkSession, source: str, target: str) -> None:
    """source takes the place of target, on whatever file system holds them."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(source).getFileSystem(spark._jsc.hadoopConfiguration())
    old = f"{target}.old-{uuid.uuid4().hex}"
    replaced = fs.exists(path(target)) and fs.rename(path(target), path(old))
    if not fs.rename(path(source), path(target)):
        if replaced:
            fs.rename(path(old), path(target))
        raise RuntimeError(f"{source} could not be moved to {target}")
    if replaced:
        fs.delete(path(old), True)


def long_rows(spark: SparkSession) -> None:
    """Parquet writers of the session look at the size of what they hold after each row, not only after 100, which may be gigabytes."""
    spark.conf.set("parquet.page.size.row.check.min", "1")  # pages and row groups


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of df in the shared folder, so that a lost executor loses nothing."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
