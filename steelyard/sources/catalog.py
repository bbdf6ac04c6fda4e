"""Tables that change together: new parts are written aside, verified, and published by one manifest.

A catalog is a folder of parts and of numbered manifests. A manifest names, for each table, one folder for each bucket
of its partition column, and readers take the newest one, so they see the tables before a commit or after it and
never between. A commit writes the touched buckets anew and keeps the others' folders; nothing is overwritten. Of two
commits on the same manifest one wins, by the exclusive creation of the next number, and the other fails.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKET = "_bucket"


class Refused(ValueError):
    """What a commit was refused for; nothing has changed."""


@dataclass
class Change:
    """New rows of a table, and the partitions that they replace as a whole: those of ``replaced`` (rows with the
    partition column) go even where there is no new row for them. Without it rows are added."""

    rows: DataFrame
    replaced: DataFrame | None = None


@dataclass
class Catalog:
    """``key`` and ``partition`` name a table's columns; ``references`` are ``(child, column, parent)``. ``buckets`` bounds
    the folders of a table, and with them the manifest."""

    spark: SparkSession
    root: str
    key: dict[str, str]
    partition: dict[str, str]
    references: list[tuple[str, str, str]] = field(default_factory=list)
    buckets: int = 64

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    @property
    def _fs(self):
        return self._path().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The newest manifest's number, 0 for a new catalog."""
        home = self._path("manifests")
        if not self._fs.exists(home):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(home)]
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"schemas": {}, "parts": {}}
        stream = self._fs.open(self._path("manifests", f"{version:09d}.json"))
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """A table as it is in the newest manifest, or was in an older one."""
        return self._read(self.manifest(version), table)

    def _read(self, manifest: dict, table: str, buckets: list[int] | None = None) -> DataFrame:
        schema = manifest["schemas"][table]
        parts = [f"{self.root}/{p}" for b, p in sorted(manifest["parts"][table].items()) if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*parts) if parts else self.spark.createDataFrame([], schema)

    def _bucket(self, table: str):
        return F.pmod(F.xxhash64(F.col(self.partition[table])), F.lit(self.buckets)).cast("int")

    def commit(self, changes: dict[str, Change]) -> int:
        """Apply all changes or none, and return the new version. Refused where columns differ, a key comes twice,
        rows are lost in writing, or a reference has nothing to point to."""
        base = self.version()
        before = self.manifest(base)
        after = {"schemas": dict(before["schemas"]), "parts": {t: dict(p) for t, p in before["parts"].items()}}
        stage = f"data/{base + 1:09d}-{uuid.uuid4().hex[:8]}"
        try:
            for table, change in changes.items():
                self._stage(before, after, stage, table, change)
            for table in changes:
                twice = self._read(after, table).groupBy(self.key[table]).count().where("count > 1")
                if not twice.isEmpty():
                    raise Refused(f"{table}: a {self.key[table]} comes twice")
            for child, column, parent in self.references:
                if child in after["parts"] and {child, parent} & changes.keys():
                    self._check(after, child, column, parent)
            self._publish(base + 1, after)
        except Exception:
            self._fs.delete(self._path(stage), True)
            raise
        return base + 1

    def _stage(self, before: dict, after: dict, stage: str, table: str, change: Change) -> None:
        column, rows = self.partition[table], change.rows
        schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
        if table in before["schemas"]:
            if before["schemas"][table] != schema:
                raise Refused(f"{table}: columns differ")
        touched = rows.select(self._bucket(table).alias(BUCKET))
        if change.replaced is not None:
            touched = touched.unionByName(change.replaced.select(self._bucket(table).alias(BUCKET)))
        touched = sorted(r[0] for r in touched.distinct().collect())  # as many as there are buckets
        new = rows
        if table in before["schemas"]:
            old = self._read(before, table, touched)
            if change.replaced is not None:
                gone = change.replaced.select(F.col(column).alias("_gone")).distinct()
                old = old.join(gone, F.col(column).eqNullSafe(F.col("_gone")), "left_anti")
            new = old.unionByName(rows)
        need = new.count()
        path = f"{stage}/{table}"
        new.withColumn(BUCKET, self._bucket(table)).repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{self.root}/{path}")
        after["schemas"][table] = schema
        parts = after["parts"].setdefault(table, {})
        for b in touched:
            parts.pop(str(b), None)
            if self._fs.exists(self._path(path, f"{BUCKET}={b}")):
                parts[str(b)] = f"{path}/{BUCKET}={b}"
        found = self._read(after, table, touched).count()
        if found != need:
            raise Refused(f"{table}: {need} rows to write, {found} found")

    def _check(self, after: dict, child: str, column: str, parent: str) -> None:
        if parent not in after["parts"]:
            raise Refused(f"{child}.{column}: there is no {parent}")
        keys = self._read(after, parent).select(F.col(self.key[parent]).alias("_p"))
        lost = self._read(after, child).where(F.col(column).isNotNull()).join(keys, F.col(column) == F.col("_p"), "left_anti")
        if not lost.isEmpty():
            raise Refused(f"{child}.{column}: rows without a {parent}")

    def _publish(self, version: int, manifest: dict) -> None:
        """The manifest is whole before it has its name, and the name is claimed by one writer only."""
        name = f"{version:09d}"
        claim, aside = self._path("manifests", f"{name}.claim"), self._path("manifests", f"{name}-{uuid.uuid4().hex[:8]}.tmp")
        out = self._fs.create(aside, True)
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        out.close()
        try:
            self._fs.create(claim, False).close()
        except Exception as e:
            self._fs.delete(aside, False)
            raise Refused(f"version {version} was published by another commit") from e
        if not self._fs.rename(aside, self._path("manifests", f"{name}.json")):
            self._fs.delete(claim, False)
            raise Refused(f"version {version} could not be published")


def merge_into(catalog: Catalog, new: dict[str, DataFrame], order: list[str]) -> int:
    """Copy tables into a catalog in one commit. Refused if a table is missing, has other columns, or has rows already,
    for a second import would count facts twice."""
    there = catalog.manifest()
    for name in order:
        if name not in new:
            raise Refused(f"{name}: not in the data to import")
        if there["parts"].get(name):
            raise Refused(f"{name}: has rows already")
    return catalog.commit({name: Change(new[name]) for name in order})
