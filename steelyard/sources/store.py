"""Reading and writing: batch replacement, CSV and JSON round trips, merges of catalogs, content ids."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder where all executors can write: in spark.checkpoint.dir, or where that is unset and the
    session is a local one, as in tests, in its warehouse. It goes when the driver ends."""
    home = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not home and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is unset: intermediate data need a folder that all executors share")
    path = f"{home or spark.conf.get('spark.sql.warehouse.dir')}/steelyard-{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def written_to(df: DataFrame, name: str) -> str:
    """Write ``df`` to a new folder of the shared one, whose path is returned."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: what is not determined stays as it came out."""
    return df.sparkSession.read.schema(df.schema).parquet(written_to(df, name))


def tasks(df: DataFrame, rows: int) -> int:
    """So many tasks that each gets about ``rows`` rows of ``df``, which is counted and should be cheap to count."""
    return df.count() // rows + 1


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """Deal ``df`` out, by ``keys`` or evenly, to :func:`tasks`. Their number follows the input, where that of files and of
    shuffles by default doesn't: a task's memory stays as the input grows, and much work on the rows of a small
    file has all cores."""
    return df.repartition(tasks(df, rows), *keys)


def content_id(prefix: str, *parts: Column, size: int = 12) -> Column:
    """A deterministic id from the parts, which a zero character keeps apart."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\x00", *parts), 256), 1, size))


def canonical_hash(value: Column) -> Column:
    """The hash of a map as JSON with sorted keys."""
    ordered = F.map_from_entries(F.array_sort(F.map_entries(value)))
    return F.sha2(F.to_json(ordered), 256)


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/\\]+$", 0)


def replace_batch(df: DataFrame, path: str, partition: str) -> None:
    """Replace whole partitions: those of the batch are overwritten, others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def append_pending(df: DataFrame, path: str) -> None:
    """Append sightings, each pending."""
    df.withColumn("resolution", F.lit("pending")).write.mode("append").parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_json(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def as_text(df: DataFrame) -> DataFrame:
    """Decimals as text, as results leave the engine, so no digit is lost in JSON."""
    return df.select(*[F.col(c).cast("string").alias(c) if t.startswith("decimal") else F.col(c) for c, t in df.dtypes])


def write_csv(df: DataFrame, path: str) -> None:
    """Write CSV with arrays and maps as JSON text."""
    flat = [F.to_json(F.col(f.name)).alias(f.name) if isinstance(f.dataType, (ArrayType, MapType, StructType)) else F.col(f.name) for f in df.schema.fields]
    df.select(*flat).write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", '""').csv(path)


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Read what :func:`write_csv` wrote; a value that doesn't fit its type is null."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    cols = []
    for f in schema.fields:
        if isinstance(f.dataType, (ArrayType, MapType, StructType)):
            cols.append(F.from_json(f.name, f.dataType).alias(f.name))
        else:
            cols.append(F.col(f.name).try_cast(f.dataType).alias(f.name))
    return raw.select(*cols)


def import_decided(rows: DataFrame, status: str = "status", pending: str = "pending") -> DataFrame:
    """Attestations to import: what is still pending isn't."""
    return rows.where(F.coalesce(F.col(status), F.lit(pending)) != pending)


def schema_difference(a: DataFrame, b: DataFrame) -> list[str]:
    """Columns that one of two tables lacks or types otherwise; merging asks for none."""
    x, y = dict(a.dtypes), dict(b.dtypes)
    return sorted(c for c in x.keys() | y.keys() if x.get(c) != y.get(c))


def merge(old: dict[str, DataFrame], new: dict[str, DataFrame], order: list[str], keys: dict[str, str], references: list[tuple[str, str, str]]) -> dict[str, DataFrame]:
    """Copy a catalog into another, table by table in order of reference; refuses if schemas differ, keys
    meet, or a reference would dangle. Nothing is returned unless everything fits."""
    for name in order:
        if diff := schema_difference(old[name], new[name]):
            raise ValueError(f"{name}: columns differ: {', '.join(diff)}")
        if not new[name].join(old[name].select(keys[name]), keys[name], "left_semi").isEmpty():
            raise ValueError(f"{name}: keys are there already")
    out = {name: old[name].unionByName(new[name]) for name in order}
    for child, column, parent in references:
        lost = out[child].where(F.col(column).isNotNull()).join(out[parent].select(F.col(keys[parent]).alias("_p")), F.col(column) == F.col("_p"), "left_anti")
        if not lost.isEmpty():
            raise ValueError(f"{child}.{column}: rows without a {parent}")
    return out


def replayed(requests: DataFrame, cassettes: DataFrame, body: str = "request") -> DataFrame:
    """Answers of recorded requests by the hash of their body; a request without a recording raises."""
    keyed = requests.withColumn("key", F.substring(F.sha2(F.col(body), 256), 1, 32))
    found = keyed.join(cassettes.select("key", "response"), "key", "left")
    return found.withColumn("response", F.when(F.col("response").isNull(), F.raise_error(F.concat(F.lit("no recording "), F.col("key"))).cast("string")).otherwise(F.col("response")))


def template(declared: DataFrame, recorded: DataFrame, key: list[str]) -> DataFrame:
    """What a reviewer fills in: all declared keys with what is recorded, the others as ``pending`` rows, which
    :func:`import_decided` leaves out again. ``recorded`` has a ``status``."""
    from steelyard.operators.grid import pad

    return pad(declared, recorded, key).drop("declared")


def q2_template(projects: DataFrame, recorded: DataFrame, scope: str = "consolidated") -> DataFrame:
    """Receivables by age: a row per project and declared year."""
    return template(projects.select("project_id", F.explode("fiscal_years").alias("period"), F.lit(scope).alias("scope")), recorded, ["project_id", "period", "scope"])


def r_template(projects: DataFrame, items: list[str], recorded: DataFrame) -> DataFrame:
    """Risk disclosures: a row per project, declared year and item of the checklist."""
    return template(projects.select("project_id", F.explode("fiscal_years").alias("period")).select("*", F.explode(F.array(*map(F.lit, items))).alias("item")), recorded, ["project_id", "period", "item"])


def p_template(claims: DataFrame, recorded: DataFrame) -> DataFrame:
    """Confirmations of claims: a row per claim, with its text beside it."""
    return template(claims.select("claim_id"), recorded, ["claim_id"]).join(claims.select("claim_id", "claim_text"), "claim_id", "left")
