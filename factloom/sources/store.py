"""A snapshot store of documents, facts and relationships on plain Parquet.

A table is a set of immutable batches named in a manifest; a commit writes new files and then puts the new manifest in
place under the next version number, so readers see a whole version or the one before. Deletes add a tombstone batch of
document ids: a row is there if it was added after its document's last tombstone. A relationship counts for both of its
facts' documents, so one that was made before either document was deleted or replaced stays gone when the document
comes back. ``compact`` rewrites what is left.

A table is read in one scan of all its batches; a row's version is in its file's path. Paths can be in any store that
Spark writes; nothing touches the local file system directly. Two writers at a time need a store whose rename fails
when the target exists (HDFS); on others keep one writer a root.
"""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.schemas import DOCUMENTS, FACTS, RELATIONSHIPS

SCHEMAS = {"documents": DOCUMENTS, "facts": FACTS, "relationships": RELATIONSHIPS, "tombstones": "doc_id string, upto long"}
COLUMNS = {t: [c.split()[0] for c in s.split(", ")] for t, s in SCHEMAS.items()}


_own: list[str] = []


def scratch_root(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; a single-JVM session that leaves that out gets a folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="factloom-store-"))
            atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
        base = f"file://{_own[0]}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.root}/versions"))

    # Versions ---------------------------------------------------------------------------------------------------------

    def version(self) -> int:
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path(f"{self.root}/versions"))]
        return max([int(n.split(".")[0]) for n in names if n.endswith(".json")], default=0)

    def manifest(self, version: int | None = None) -> dict[str, list[list]]:
        """Per table a list of [batch path, version that added it]."""
        v = self.version() if version is None else version
        if v == 0:
            return {t: [] for t in SCHEMAS}
        stream = self._fs.open(self._path(f"{self.root}/versions/{v}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _publish(self, manifest: dict[str, list[list]], version: int) -> None:
        """Write the manifest aside and rename it: a rename fails when another writer was first."""
        draft = self._path(f"{self.root}/versions/.{uuid.uuid4().hex}")
        stream = self._fs.create(draft)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        target = self._path(f"{self.root}/versions/{version}.json")
        if self._fs.exists(target) or not self._fs.rename(draft, target):
            self._fs.delete(draft, False)
            raise RuntimeError(f"version {version} was committed by another writer")

    def stage(self, **batches: DataFrame) -> dict[str, str]:
        """Write batches of the next version without publishing them: the path of each table's batch."""
        version, paths = self.version() + 1, {}
        for table, rows in batches.items():
            paths[table] = f"{self.root}/{table}/{version:08d}-{uuid.uuid4().hex}"
            rows.select(*COLUMNS[table]).write.parquet(paths[table])
        return paths

    def publish(self, *staged: dict[str, str]) -> int:
        """Put staged batches of the next version in place, all at once."""
        manifest, version = self.manifest(), self.version() + 1
        for paths in staged:
            for table, path in paths.items():
                if not path.startswith(f"{self.root}/{table}/{version:08d}-"):
                    raise RuntimeError(f"version {version - 1} was committed by another writer")
                manifest[table].append([path, version])
        self._publish(manifest, version)
        return version

    def commit(self, **batches: DataFrame) -> int:
        """Append batches to tables in one version."""
        return self.publish(self.stage(**batches))

    def read(self, table: str, paths: list[str]) -> DataFrame:
        """The rows of some batches of a table, in one scan, with ``__v``, the version that added them."""
        rows = self.spark.read.schema(SCHEMAS[table])
        if not paths:
            return self.spark.createDataFrame([], SCHEMAS[table] + ", __v long")
        file = F.col("_metadata.file_path")
        version = F.regexp_extract(file, r"/([0-9]+)-[0-9a-f]{32}/[^/]*$", 1).cast("long")
        return rows.parquet(*paths).select(*COLUMNS[table], version.alias("__v"))

    # Tables -----------------------------------------------------------------------------------------------------------

    # ``staged`` are batches of the next version: with them a table reads as it will after they are published.

    def _batches(self, table: str, staged: list[dict[str, str]] | None = None) -> DataFrame:
        paths = [path for path, _ in self.manifest()[table]]
        return self.read(table, paths + [s[table] for s in staged or [] if table in s])

    def _alive(self, rows: DataFrame, doc_ids: list[str], staged: list[dict[str, str]] | None) -> DataFrame:
        """Rows added after the last tombstone of each document that ``doc_ids`` names."""
        dead = self._batches("tombstones", staged).groupBy("doc_id").agg(F.max("upto").alias("__upto"))
        for c in doc_ids:
            met = rows.join(dead.withColumnRenamed("doc_id", c), c, "left")
            rows = met.where("__upto IS NULL OR __v > __upto").drop("__upto")
        return rows

    def documents(self, staged: list[dict[str, str]] | None = None) -> DataFrame:
        return self._alive(self._batches("documents", staged), ["doc_id"], staged).select(*COLUMNS["documents"])

    def facts(self, staged: list[dict[str, str]] | None = None) -> DataFrame:
        return self._alive(self._batches("facts", staged), ["source_doc_id"], staged).select(*COLUMNS["facts"])

    def relationships(self, staged: list[dict[str, str]] | None = None) -> DataFrame:
        """Relationships whose two facts are there and were there when it was made."""
        rows = self._batches("relationships", staged)
        ends = self.facts(staged).select("id", "source_doc_id").distinct()
        for n in ("1", "2"):
            rows = rows.join(ends.toDF(f"fact_id_{n}", f"__doc_{n}"), f"fact_id_{n}")
        return self._alive(rows, ["__doc_1", "__doc_2"], staged).select(*COLUMNS["relationships"])

    # Changes ----------------------------------------------------------------------------------------------------------

    def tombstones(self, ids: DataFrame) -> DataFrame:
        """Tombstones, up to the present version, of the stored documents among ``ids`` (doc_id)."""
        stored = self.documents().select("doc_id").join(ids, "doc_id", "left_semi").distinct()
        return stored.withColumn("upto", F.lit(self.version()).cast("long"))

    def delete_document(self, doc_id: str) -> bool:
        """Remove a document, its facts and their relationships; False if there is none."""
        found = self.documents().where(F.col("doc_id") == doc_id)
        if found.isEmpty():
            return False
        self.commit(tombstones=self.tombstones(found.select("doc_id")))
        return True

    def reset(self) -> None:
        """Empty all tables."""
        self._publish({t: [] for t in SCHEMAS}, self.version() + 1)

    def compact(self) -> None:
        """Rewrite each table as one batch without dead rows; facts are clustered by subject."""
        manifest, version = {t: [] for t in SCHEMAS}, self.version() + 1
        tables = {"documents": self.documents(), "facts": self.facts(), "relationships": self.relationships()}
        for table, rows in tables.items():
            path = f"{self.root}/{table}/{version:08d}-{uuid.uuid4().hex}"
            if table == "facts":
                rows = rows.repartitionByRange("subject_normalized").sortWithinPartitions("subject_normalized", "attribute_normalized")
            rows.write.parquet(path)
            manifest[table] = [[path, version]]
        self._publish(manifest, version)
