"""Helpers shared by the corpus operators: shared scratch tables and connected components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def key_name(key: str, added: tuple[str, ...]) -> str:
    """What a key is called in a result: its own name, or that with ``_key`` behind it where a column that is
    added has it, in whatever case."""
    return f"{key}_key" if key.lower() in {c.lower() for c in added} else key


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, spark.checkpoint.dir. Where that is unset a local session, as in tests,
    takes the folder of its warehouse; on a cluster it is an error."""
    conf = spark.sparkContext.getConf()
    if found := conf.get("spark.checkpoint.dir"):
        return found
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir is unset: intermediate tables need a folder that all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/scratch"


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, survives lost executors. The
    files go when the driver ends, or with :func:`drop`."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/steelyard-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    system, where = _file_system(spark, path)
    system.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def drop(df: DataFrame) -> None:
    """Delete the files of a table of :func:`materialize` that nothing reads any more."""
    system, where = _file_system(df.sparkSession, df._scratch)
    system.delete(where, True)


def runs(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Cut sorted frames into one frame for each run of equal keys, across the frames' borders."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        if not len(frame):
            continue
        k = frame[keys].to_numpy()
        edges = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1), len(frame)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            part = frame.iloc[a:b]
            if held and (held[-1][keys].iloc[-1].to_numpy() != part[keys].iloc[0].to_numpy()).any():
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
            held.append(part)
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)`` as rows ``(id, component)``, component = smallest id.

    Alternates the large-star and small-star contractions until no edge changes; each round is written
    to the shared folder. Groups are only aggregated to a minimum and joined back on their key with the
    hub's rows spread by the join itself, so no task gathers a component. Null ends and self-loops are
    ignored; ids without an edge do not appear.
    """
    es = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").selectExpr("greatest(a,b) AS a", "least(a,b) AS b").distinct()
    es = materialize(es, "cc")
    seen = None
    for _ in range(max_rounds):
        # large star: every larger neighbour of u is hung below the smallest of u and its neighbours
        both = es.select("a", "b").unionByName(es.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: every smaller neighbour of u, and u itself, is hung below the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        was, es = es, materialize(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "cc")
        drop(was)
        now = es.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = es.select(F.col("b").alias("id")).distinct().withColumn("component", F.col("id"))
    return es.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)
