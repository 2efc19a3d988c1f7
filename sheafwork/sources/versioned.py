"""A versioned parquet table: immutable files, one manifest per version, deletion vectors.

Layout under ``root``::

    data/<uuid>/part-*.parquet        immutable data files
    dv/<uuid>/part-*.parquet          (file, pos) rows deleted from data files
    _versions/<20 digits>.json        manifest of a version; created once, never changed

A commit writes its data first and then puts the next manifest in place by a rename that fails if
it exists. A job that dies before that leaves orphan files and no
version; two writers racing for one number cannot both win, on file systems whose rename is atomic (HDFS,
local ones; an object store needs a committer that gives this promise). Manifests name files, never
rows, so a diff of two versions costs the manifests' size and reading only what changed. A commit that deletes
rows writes one vector for the files it hits, with all their deleted rows; other files keep theirs.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheafwork.runtime import materialize, small_enough

FILE, POS, CHANGE = "_file", "_pos", "_change"
VECTOR = T.StructType([T.StructField(FILE, T.StringType()), T.StructField(POS, T.LongType())])


class ConcurrentCommit(RuntimeError):
    """Another writer has made this version first."""


@dataclass(frozen=True)
class Manifest:
    """One version: data files, and for each file the folder of its deletion vector, if any."""

    version: int
    files: dict[str, str | None] = field(default_factory=dict)
    properties: dict[str, str] = field(default_factory=dict)

    @staticmethod
    def empty() -> Manifest:
        return Manifest(0)

    @staticmethod
    def of_directory(spark: SparkSession, path: str, version: int = 1) -> Manifest:
        """A manifest over parquet files that exist already (a file or a folder)."""
        return Manifest(version, dict.fromkeys(sorted(spark.read.parquet(path).inputFiles())))


@dataclass(frozen=True)
class ManifestDiff:
    """What two manifests differ in: files only in the newer, only in the older, and with another deletion vector."""

    added: tuple[str, ...]
    removed: tuple[str, ...]
    redeleted: tuple[str, ...]


def diff(old: Manifest, new: Manifest) -> ManifestDiff:
    return ManifestDiff(
        tuple(f for f in new.files if f not in old.files),
        tuple(f for f in old.files if f not in new.files),
        tuple(f for f in new.files if f in old.files and old.files[f] != new.files[f]),
    )


def _parquet(spark: SparkSession, files: list[str], schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


def _vectors(spark: SparkSession, folders: set[str]) -> DataFrame:
    return spark.read.schema(VECTOR).parquet(*sorted(folders)) if folders else spark.createDataFrame([], VECTOR)


def _read(spark: SparkSession, m: Manifest, files: list[str], schema: T.StructType) -> DataFrame:
    """The rows of ``files`` in force. Only files with a deletion vector meet the vectors, which are broadcast while they are small."""
    clean, hit = [f for f in files if not m.files[f]], [f for f in files if m.files[f]]
    df = _parquet(spark, clean, schema)
    if not hit:
        return df
    at = _parquet(spark, hit, schema).select("*", F.col("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(POS))
    gone = _vectors(spark, {m.files[f] for f in hit}).distinct()
    live = at.join(small_enough(gone), [FILE, POS], "left_anti").drop(FILE, POS)
    return df.unionByName(live) if clean else live


def changed_rows(spark: SparkSession, old: Manifest, new: Manifest, schema: T.StructType) -> DataFrame:
    """Record deltas between two versions, with ``_change`` 'insert' or 'delete'.

    Reads only files that were added or removed and, of files whose deletion vector changed,
    the rows that the change hides or shows. A file in both versions with the same deletion
    vector is never opened. However many files have changed, the plan is one read of those added, one of
    those removed and one of those with another vector. ``_change`` replaces a column of that name.
    """
    d = diff(old, new)
    schema = T.StructType([f for f in schema if f.name != CHANGE])
    out = _read(spark, new, list(d.added), schema).withColumn(CHANGE, F.lit("insert"))
    if d.removed:
        out = out.unionByName(_read(spark, old, list(d.removed), schema).withColumn(CHANGE, F.lit("delete")))
    if d.redeleted:
        was, now = (_vectors(spark, {v for f in d.redeleted if (v := m.files[f])}).distinct() for m in (old, new))
        hidden = now.join(was, [FILE, POS], "left_anti").withColumn(CHANGE, F.lit("delete"))
        shown = was.join(now, [FILE, POS], "left_anti").withColumn(CHANGE, F.lit("insert"))
        rows = _parquet(spark, list(d.redeleted), schema).select("*", F.col("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(POS))
        out = out.unionByName(rows.join(small_enough(hidden.unionByName(shown)), [FILE, POS]).drop(FILE, POS))
    return out


class VersionedTable:
    """Reads and commits of one table under ``root``, through Hadoop's file system API."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, *parts: str):  # noqa: ANN202
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def version(self) -> int:
        """The newest committed version; 0 for a table without any."""
        at = self._path("_versions")
        if not self._fs.exists(at):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(at)]
        return max((int(n[:20]) for n in names if n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> Manifest:
        v = self.version() if version is None else version
        if v == 0:
            return Manifest.empty()
        stream = self._fs.open(self._path("_versions", f"{v:020d}.json"))
        try:
            said = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        x = json.loads(said)
        return Manifest(x["version"], x["files"], x["properties"] | {"__schema": x["schema"]})

    def schema(self, version: int | None = None) -> T.StructType:
        said = self.manifest(version).properties.get("__schema")
        if not said:
            raise ValueError(f"{self.root} has no version yet")
        return T.StructType.fromJson(json.loads(said))

    def read(self, version: int | None = None) -> DataFrame:
        m = self.manifest(version)
        return _read(self.spark, m, list(m.files), self.schema(version))

    def properties(self, version: int | None = None) -> dict[str, str]:
        return {k: v for k, v in self.manifest(version).properties.items() if k != "__schema"}

    def changes(self, since: int, to: int | None = None) -> DataFrame:
        """Record deltas after version ``since`` up to ``to`` (the newest by default)."""
        return changed_rows(self.spark, self.manifest(since), self.manifest(to), self.schema(to))

    def commit(
        self,
        add: DataFrame | None = None,
        delete_keys: DataFrame | None = None,
        overwrite: bool = False,
        properties: dict[str, str] | None = None,
        expected: int | None = None,
        base: int | None = None,
        remove: list[str] | None = None,
    ) -> int:
        """Make the next version and return its number.

        ``add``: rows to append. ``delete_keys``: rows whose values in its columns match are
        hidden by deletion vectors (null equals null). ``overwrite``: forget the files so
        far; ``remove``: forget these. ``properties`` are kept in the manifest beside those before them; this is
        where a consumer saves the source version it has processed, in the same commit as
        its output. ``expected``: the version this one must follow; ``base``: the version whose
        content it goes on from, the last one by default.
        """
        last = self.version()
        if expected is not None and expected != last:
            raise ConcurrentCommit(f"{self.root} is at version {last}, not {expected}")
        was = self.manifest(last if base is None else base)
        files: dict[str, str | None] = {} if overwrite else {f: v for f, v in was.files.items() if f not in (remove or [])}
        if delete_keys is not None and files:
            files = self._deleted(Manifest(was.version, files), delete_keys, self.schema(was.version))
        schema = was.properties.get("__schema")
        if add is not None:
            at = f"{self.root}/data/{uuid.uuid4().hex}"
            add.write.parquet(at)
            new = self.spark.read.schema(add.schema).parquet(at).inputFiles()
            files |= dict.fromkeys(sorted(new))
            schema = add.schema.json()
        keep = {k: v for k, v in was.properties.items() if k != "__schema"}
        body = {"version": last + 1, "files": files, "properties": keep | (properties or {}), "schema": schema}
        self._create(last + 1, json.dumps(body))
        return last + 1

    def compact(self) -> int:
        """Rewrite the files that have deletion vectors, without the deleted rows, as a new version; nothing to do gives the version there is."""
        last = self.version()
        m = self.manifest(last)
        hit = [f for f, v in m.files.items() if v]
        if not hit:
            return last
        return self.commit(add=_read(self.spark, m, hit, self.schema(last)), remove=hit, expected=last)

    def _deleted(self, was: Manifest, keys: DataFrame, schema: T.StructType) -> dict[str, str | None]:
        live = self.spark.read.schema(schema).parquet(*was.files)
        at = live.select(*keys.columns, F.col("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(POS)).alias("l")
        k = small_enough(materialize(keys.distinct(), "deleted-keys")).alias("k")
        same = [F.col(f"l.{c}").eqNullSafe(F.col(f"k.{c}")) for c in keys.columns]
        hit = at.join(k, on=_all(same), how="left_semi").select(FILE, POS)
        known = _vectors(self.spark, {v for v in was.files.values() if v})
        hit = materialize(hit.join(known, [FILE, POS], "left_anti"), "deleted-rows")
        touched = {r[0] for r in hit.select(FILE).distinct().collect()}  # a row per file, as the manifest has
        touched = {f for f in was.files if touched.intersection(_spellings(f))}
        if not touched:
            return was.files
        before = {v for f in touched if (v := was.files[f])}
        if before:
            names = self.spark.createDataFrame([(n,) for f in touched for n in _spellings(f)], f"{FILE} string")
            hit = hit.unionByName(_vectors(self.spark, before).join(small_enough(names), FILE, "left_semi")).distinct()
        folder = f"{self.root}/dv/{uuid.uuid4().hex}"
        hit.write.parquet(folder)
        return {f: folder if f in touched else v for f, v in was.files.items()}

    def _create(self, version: int, body: str) -> None:
        at = self._path("_versions", f"{version:020d}.json")
        self._fs.mkdirs(at.getParent())
        draft = self._path("_versions", f".{uuid.uuid4().hex}.draft")
        out = self._fs.create(draft, False)
        try:
            out.write(bytearray(body.encode()))
        finally:
            out.close()
        jvm = self._jvm
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            files.rename(files.makeQualified(draft), files.makeQualified(at), none)  # fails if the version exists
        except Exception as e:
            self._fs.delete(draft, False)
            raise ConcurrentCommit(f"version {version} of {self.root} is taken") from e


def _spellings(f: str) -> list[str]:
    """A local file's name as the listing and as the scan's metadata spell it."""
    bare = f.removeprefix("file:").lstrip("/")
    return [f"file:/{bare}", f"file:///{bare}"] if f.startswith("file:") else [f]


def _all(conditions):  # noqa: ANN001, ANN202
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out
