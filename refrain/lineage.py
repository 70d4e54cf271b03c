"""Cutting lineage and materialising stages in storage the whole cluster can read."""

from __future__ import annotations

import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession, functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local master without that setting (tests) falls back to a temporary folder.
    """
    try:
        folder = spark.conf.get("spark.checkpoint.dir")
    except Exception:  # raised when the setting is absent
        folder = None
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="refrain-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint: survives executor loss, unlike a local one."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=eager)


def _exists(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, never reused folder for one run of a stage."""
    return f"{shared_dir(spark)}/refrain/{name}-{uuid.uuid4().hex}"


def side_by_side(jobs) -> list:
    """Results of independent calls that run Spark jobs of their own, made at one time; Spark shares out the cores."""
    jobs = list(jobs)
    with ThreadPoolExecutor(max(1, len(jobs))) as pool:
        return list(pool.map(lambda job: job(), jobs))


def fingerprint(spark: SparkSession, paths: list[str]) -> str:
    """What the files under ``paths`` look like from outside (names, sizes, times), as one short text; no file is read."""
    files = spark.read.format("binaryFile").load(paths).select("path", "length", F.unix_micros("modificationTime").alias("time"))
    r = files.agg(F.count("*").alias("n"), F.sum("length").alias("size"), F.bit_xor(F.xxhash64("path", "length", "time")).alias("mix")).first()
    return f"{r['n']}-{r['size'] or 0}-{(r['mix'] or 0) % (1 << 64):016x}"


def stored(spark: SparkSession, name: str, build) -> DataFrame:
    """The table of that name in the shared folder, built by ``build()`` where it does not stand yet; other applications find it too."""
    path = f"{shared_dir(spark)}/refrain/stored/{name}"
    return spark.read.parquet(path) if _exists(spark, f"{path}/_SUCCESS") else materialize(build(), path)


def materialize(df: DataFrame, path: str, force: bool = False, smoke: int | None = None,
                smoke_order: list[str] | None = None) -> DataFrame:
    """Write a stage once: skip when its table stands, rebuild on ``force``, subset on ``smoke``."""
    spark = df.sparkSession
    if force or not _exists(spark, f"{path}/_SUCCESS"):
        out = df
        if smoke is not None:
            out = out.orderBy(*(smoke_order or df.columns)).limit(smoke)
        out.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def materialize_folds(df: DataFrame, path: str, fold_col: str = "fold") -> DataFrame:
    """Resume per fold: only folds whose partition is missing get computed and written."""
    spark = df.sparkSession
    if _exists(spark, path):
        done = spark.read.parquet(path).select(fold_col).distinct()
        df = df.join(done, fold_col, "left_anti")
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
       .partitionBy(fold_col).parquet(path))
    return spark.read.parquet(path)
