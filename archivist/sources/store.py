"""Versioned tables: a new version is written beside the old one, then the pointer moves."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The generation of the library's tables; others are refused, not upgraded.
GENERATION = 11


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _file_system(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _file_system(spark, path)
    fs.delete(p, True)


def committed(spark: SparkSession, path: str, key: str) -> list[int]:
    """The numbers n of folders <key>=<n> under a path whose writes have ended."""
    fs, p = _file_system(spark, f"{path}/{key}=*/_SUCCESS")
    return sorted(int(f.getPath().getParent().getName().partition("=")[2]) for f in fs.globStatus(p) or [])


def scratch(spark: SparkSession) -> str:
    """A new folder name where driver and executors both see it: under spark.checkpoint.dir, or on one machine without it a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="archivist-")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


class Store:
    """Tables under a folder that Spark can read and write. The pointer is a small Parquet table of (table, version, at)."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _pointers(self) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.folder}/_pointers")
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER" in str(e):
                return None
            raise

    def version(self, table: str) -> str | None:
        p = self._pointers()
        if p is None:
            return None
        mine = F.col("table") == table
        last = p.agg(F.bool_or(F.col("generation") != GENERATION).alias("other"), F.max_by("version", F.when(mine, F.struct("at", "version"))).alias("version")).first()
        if last["other"]:
            raise ValueError("the library is of another generation")
        return last["version"]

    def read(self, table: str) -> DataFrame:
        version = self.version(table)
        if version is None:
            raise KeyError(table)
        return self.spark.read.parquet(f"{self.folder}/{table}/{version}")

    def stage(self, table: str, df: DataFrame) -> str:
        """Write a version that nobody reads yet."""
        version = uuid.uuid4().hex
        df.write.mode("errorifexists").parquet(f"{self.folder}/{table}/{version}")
        return version

    def staged(self, table: str, version: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{table}/{version}")

    def publish(self, versions: dict[str, str]) -> None:
        """Make staged versions the tables' own, all in one write."""
        rows = self.spark.createDataFrame([*versions.items()], "table string, version string")
        rows.withColumns({"at": F.current_timestamp(), "generation": F.lit(GENERATION)}).coalesce(1).write.mode("append").parquet(f"{self.folder}/_pointers")

    def write(self, table: str, df: DataFrame, if_exists: str = "replace") -> None:
        if if_exists == "error" and self.version(table) is not None:
            raise ValueError(f"{table} isn't empty")
        self.publish({table: self.stage(table, df)})

    def reset(self, phrase: str, tables: list[str], busy: bool = False) -> None:
        """Empty versions of the tables; refused without the phrase or while jobs run."""
        if phrase != "RESET" or busy:
            raise ValueError("not reset")
        for t in tables:
            self.write(t, self.read(t).limit(0))
