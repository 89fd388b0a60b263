"""Where intermediate tables go, and the few session settings the operators rely on."""

from __future__ import annotations

import io
import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one where that is unset on one machine.

    On a cluster without that setting this raises, for executors would each write to their own disk.
    """
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tracelode-")
        sc.setCheckpointDir(at)
    return at.rstrip("/")


def own_dir(spark: SparkSession, kind: str) -> str:
    """This application's part of the shared folder, for ``tables`` or ``files``."""
    return f"{shared_dir(spark)}/tracelode/{spark.sparkContext.applicationId}/{kind}"


def materialise(df: DataFrame, name: str = "step") -> DataFrame:
    """Write df as a Parquet table into the shared folder and read it back.

    Cuts the lineage: a lost executor costs only a re-read of the table. Unlike checkpoint() the file is
    columnar and compressed, so later stages read only the columns they need.
    """
    spark = df.sparkSession
    path = f"{own_dir(spark, 'tables')}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete the tables that materialise() wrote in this application; call it when no DataFrame built on them is
    needed any more. Tables of other applications and files shipped to executors stay."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    path = hadoop.Path(own_dir(spark, "tables"))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def ship_package(spark: SparkSession) -> None:
    """Give the workers this package, once per session, unless they find it on PYTHONPATH or in the working folder."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    at_hand = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    sc = spark.sparkContext
    if root in at_hand or os.path.abspath(os.getcwd()) == root or sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    image = io.BytesIO()
    with zipfile.ZipFile(image, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(os.path.join(root, "tracelode")):
            for f in files:
                if f.endswith(".py"):
                    z.write(os.path.join(folder, f), os.path.relpath(os.path.join(folder, f), root))
    sc.addPyFile(write_shared(spark, f"package-{uuid.uuid4().hex[:12]}.zip", image.getvalue()))


_shipped: set[str] = set()


def write_shared(spark: SparkSession, name: str, data: bytes) -> str:
    """Write a small file into the shared folder, whatever its file system; returns its address."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{own_dir(spark, 'files')}/{name}")
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at)
    out.write(bytearray(data))
    out.close()
    return at.toString()
