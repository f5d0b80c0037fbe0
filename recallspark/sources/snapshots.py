"""Immutable versions of a table with a manifest and a pointer that can be rolled back."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _put(spark: SparkSession, path: str, text: str) -> None:
    jvm, at, files = _files(spark, path)
    part = jvm.org.apache.hadoop.fs.Path(path + ".part")
    out = files.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    files.delete(at, False)
    if not files.rename(part, at):
        raise OSError(f"can't move into place: {path}")


def _get(spark: SparkSession, path: str) -> dict | None:
    _, at, files = _files(spark, path)
    if not files.exists(at):
        return None
    return json.loads("\n".join(r[0] for r in spark.read.text(path).collect()))


def digest(df: DataFrame) -> tuple[int, str]:
    """(rows, hash) that don't depend on the order of rows or partitions: one aggregate, nothing is sorted."""
    line = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    part = [F.conv(F.substring(line, 1 + 8 * k, 8), 16, 10).cast("decimal(20,0)") for k in range(4)]
    row = df.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(p), F.lit(0)).alias(f"h{k}") for k, p in enumerate(part)]).first()
    return row["n"], "-".join(f"{int(row[f'h{k}']) % (1 << 64):016x}" for k in range(4))


def create(df: DataFrame, root: str, version: str) -> dict:
    """Write a version and its manifest; an existing version is refused."""
    spark = df.sparkSession
    df.write.mode("errorifexists").parquet(f"{root}/{version}/data")
    n, value = digest(spark.read.parquet(f"{root}/{version}/data"))
    manifest = {"version": version, "rows": n, "digest": value, "schema": df.schema.simpleString()}
    _put(spark, f"{root}/{version}/manifest.json", json.dumps(manifest, sort_keys=True))
    return manifest


def verify(spark: SparkSession, root: str, version: str) -> bool:
    manifest = _get(spark, f"{root}/{version}/manifest.json")
    if manifest is None:
        return False
    return digest(spark.read.parquet(f"{root}/{version}/data")) == (manifest["rows"], manifest["digest"])


def activate(spark: SparkSession, root: str, version: str) -> None:
    """Point to a verified version; the one before is kept for rollback."""
    if not verify(spark, root, version):
        raise ValueError(f"{version} doesn't match its manifest")
    now = _get(spark, f"{root}/pointer.json") or {}
    _put(spark, f"{root}/pointer.json", json.dumps({"active": version, "previous": now.get("active")}))


def rollback(spark: SparkSession, root: str) -> str:
    now = _get(spark, f"{root}/pointer.json") or {}
    if not now.get("previous"):
        raise ValueError("there is no previous version")
    activate(spark, root, now["previous"])
    return now["previous"]


def read_active(spark: SparkSession, root: str) -> DataFrame:
    now = _get(spark, f"{root}/pointer.json")
    if now is None:
        raise ValueError("no version is active")
    return spark.read.parquet(f"{root}/{now['active']}/data")
