"""A graph on disk: nodes by layer and edges by type, published by a manifest.

Each commit writes the partitions that it touches to a folder of its own and then one manifest, a small JSON file that names the folder of every partition of
both tables. Readers take the latest manifest, so nodes and edges of a commit appear together or not at all; a commit that fails leaves
files that nothing names. Manifests are made by an exclusive rename, so that of two writers one fails. Partition values are folders, so a filter on layer or type
prunes the scan.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..operators.storage import placeholders, upsert

#: Key, partition column and united array columns of each table.
TABLES = {"nodes": (("id",), "layer", ("labels",)), "edges": (("src", "rel_type", "dst"), "rel_type", ())}
NULL = "__HIVE_DEFAULT_PARTITION__"


@dataclass
class Manifest:
    """version; parts: table -> partition value -> folder; schemas: table -> JSON; batches: stream -> its last batch."""

    version: int = 0
    parts: dict[str, dict[str, str]] = field(default_factory=lambda: {t: {} for t in TABLES})
    schemas: dict[str, str] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)


class GraphStore:
    """Nodes (id, layer, labels, ..) and edges (src, rel_type, dst, ..) under a path that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._files = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, text: str):
        return self._jvm.org.apache.hadoop.fs.Path(text)

    def manifest(self) -> Manifest:
        """What is published now."""
        folder = self._path(f"{self.path}/_manifests")
        names = [s.getPath().getName() for s in self._files.listStatus(folder)] if self._files.exists(folder) else []
        versions = sorted(n for n in names if n.endswith(".json") and not n.startswith("."))
        if not versions:
            return Manifest()
        stream = self._files.open(self._path(f"{self.path}/_manifests/{versions[-1]}"))
        try:
            return Manifest(**json.loads(bytes(stream.readAllBytes()).decode()))
        finally:
            stream.close()

    def _publish(self, manifest: Manifest) -> None:
        name = f"{self.path}/_manifests/{manifest.version:012d}.json"
        draft = self._path(f"{self.path}/_manifests/.{uuid.uuid4().hex}")
        out = self._files.create(draft, False)
        try:
            out.write(bytearray(json.dumps(vars(manifest)).encode()))
        finally:
            out.close()
        if self._files.exists(self._path(name)) or not self._files.rename(draft, self._path(name)):
            self._files.delete(draft, False)
            raise RuntimeError(f"version {manifest.version} has been published by another writer")

    def _read(self, table: str, manifest: Manifest) -> DataFrame | None:
        if table not in manifest.schemas:
            return None
        schema, column = StructType.fromJson(json.loads(manifest.schemas[table])), TABLES[table][1]
        folders = sorted(manifest.parts[table].values())
        if not folders:
            return self.spark.createDataFrame([], schema)
        kept = StructType([f for f in schema if f.name != column] + [StructField("commit", schema[column].dataType), schema[column]])
        rows = self.spark.read.schema(kept).option("basePath", f"{self.path}/{table}").parquet(*(f"{self.path}/{table}/{f}" for f in folders))
        return rows.select(*schema.names)

    def nodes(self, layer: str | None = None, status: str | None = None, manifest: Manifest | None = None) -> DataFrame:
        """Nodes, of one layer (only its folder is read) and one status where given."""
        return self._filtered("nodes", manifest, layer=layer, status=status)

    def edges(self, rel_type: str | None = None, src: str | None = None, dst: str | None = None, manifest: Manifest | None = None) -> DataFrame:
        """Edges, of one type (only its folder is read), source and target where given."""
        return self._filtered("edges", manifest, rel_type=rel_type, src=src, dst=dst)

    def _filtered(self, table: str, manifest: Manifest | None, **equal) -> DataFrame:
        rows = self._read(table, manifest or self.manifest())
        if rows is None:
            raise LookupError(f"no {table} have been written to {self.path}")
        for column, value in equal.items():
            rows = rows if value is None else rows.filter(F.col(column) == value)
        return rows

    def _values(self, rows: DataFrame, column: str) -> list[str]:
        """Partition values among the rows: layers, or types of edges."""
        return [NULL if r[0] is None else r[0] for r in rows.select(F.col(column).cast("string")).distinct().collect()]

    def _staged(self, table: str, new: DataFrame, manifest: Manifest, commit: str) -> tuple[dict[str, str], str]:
        """Folders of the table's partitions once ``new`` is upserted, written but not yet published, and the schema."""
        keys, column, arrays = TABLES[table]
        old, current = self._read(table, manifest), manifest.parts[table]
        if old is None:  # nothing to meet, so rows are folded once and not shuffled against an empty table
            touched, merged, schema = set(), _latest(new, keys, arrays), new.schema
        else:
            new, schema = new.select(*old.columns), old.schema
            touched = {*self._values(new, column), *self._values(old.join(new.select(*keys).distinct(), list(keys), "left_semi"), column)}
            value = F.coalesce(F.col(column).cast("string"), F.lit(NULL))
            merged = upsert(old.filter(value.isin(*touched)) if touched else old.limit(0), _latest(new, keys, arrays), list(keys), list(arrays))
        folder = f"{self.path}/{table}/commit={commit}"
        merged.repartition(F.col(column), F.pmod(F.xxhash64(*keys), F.lit(max(1, self.spark.sparkContext.defaultParallelism)))).write.partitionBy(column).option("compression", "zstd").parquet(folder)
        made = [s.getPath().getName() for s in self._files.listStatus(self._path(folder)) if s.isDirectory()]
        unescape = self._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
        parts = {v: f for v, f in current.items() if v not in touched} | {unescape(n.split("=", 1)[1]): f"commit={commit}/{n}" for n in made}
        return parts, schema.json()

    def commit(self, nodes: DataFrame | None = None, edges: DataFrame | None = None, batch: tuple[str, int] | None = None, bare: Mapping[str, object] | None = None, valid: Mapping[str, str] | None = None) -> Manifest:
        """Upsert nodes, then edges, and publish both together.

        Of one key new values win where they are not null, and labels are united; rows of one key within ``nodes`` or ``edges`` are folded the same way. Ends of edges without a node get one with the label Entity
        and the values of ``bare``. ``valid``: a SQL condition by table that every new row has to meet, or the whole commit fails. ``batch``: (stream, number); a number that the stream has published before changes nothing, so a replayed batch is
        there once. Any failure leaves what was published before.
        """
        manifest = self.manifest()
        if batch and manifest.batches.get(batch[0], -1) >= batch[1]:
            return manifest
        commit, following = uuid.uuid4().hex, Manifest(manifest.version + 1, dict(manifest.parts), dict(manifest.schemas), dict(manifest.batches))
        for table, rows in (("nodes", nodes), ("edges", edges)):
            if rows is not None:
                if valid and table in valid and not rows.filter(~F.coalesce(F.expr(valid[table]), F.lit(False))).isEmpty():
                    raise ValueError(f"{table} that do not meet: {valid[table]}")
                following.parts[table], following.schemas[table] = self._staged(table, rows, following, commit)
        known = self._read("nodes", following)
        if edges is not None and known is not None:
            lacking = placeholders(known, edges).withColumn("labels", F.array(F.lit("Entity"))).withColumns({c: F.lit(v) for c, v in (bare or {}).items()})
            lacking = lacking.select(*(F.col(f.name).cast(f.dataType) if f.name in lacking.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in known.schema))
            draft = f"{self.path}/_bare/{commit}"  # found once, for that reads all ends of edges
            lacking.write.option("compression", "zstd").parquet(draft)
            lacking = self.spark.read.schema(lacking.schema).parquet(draft)
            if not lacking.isEmpty():
                following.parts["nodes"], following.schemas["nodes"] = self._staged("nodes", lacking, following, f"{commit}-bare")
            self._files.delete(self._path(draft), True)
        if batch:
            following.batches[batch[0]] = batch[1]
        self._publish(following)
        return following


def _latest(rows: DataFrame, keys, arrays) -> DataFrame:
    """One row a key: the largest value of each column, the arrays united."""
    plain = [F.max(c).alias(c) for c in rows.columns if c not in keys and c not in arrays]
    united = [F.array_distinct(F.flatten(F.collect_set(c))).alias(c) for c in arrays]
    return rows.groupBy(*keys).agg(*plain, *united).select(*rows.columns)
