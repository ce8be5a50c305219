"""An index table at rest: versions, staged writes of only the buckets touched, one commit point.

A table is a folder. Rows lie in buckets by a hash of their source (a page's address, a
deck's file), so what replaces a source mostly meets its predecessors in one bucket.

    data/<write>/bucket=<b>/...     files, never changed once written
    versions/<number>.json          which write holds each bucket, and its rows

A change reads the buckets it touches, writes their new rows to a folder nobody reads, and
then commits: a whole manifest, written aside, is renamed to the next number, and the
rename refuses a name that is taken. So a reader sees one version or the next; a writer that dies
leaves the old version and an unread folder; of two writers that began at the same version
the second is refused and starts over. On HDFS and stores with an exclusive rename that is
atomic; a local file system looks before it renames.

Every version stays readable until `vacuum` removes folders that no kept version names.
"""

from __future__ import annotations

import json
import time
import uuid
from hashlib import md5
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from scriptorium.operators import index

#: rows, or (rows as they were read, other rows)
Changed = DataFrame | tuple[DataFrame, DataFrame]
BUCKETS = 64
DIGITS = 8
#: children of a node in the tree of digests
FAN = 8


class ConcurrentCommit(RuntimeError):
    """Another writer has committed since this change was begun."""


@dataclass(frozen=True)
class Manifest:
    """One version: where each bucket's rows lie, how many there are, and their digest."""

    version: int
    action: str
    buckets: int
    schema: str
    folders: dict[int, tuple[str, int, str]] = field(default_factory=dict)
    rewritten: tuple[int, ...] = ()

    @property
    def rows(self) -> int:
        return sum(n for _, n, _ in self.folders.values())

    def differing(self, other: Manifest) -> list[int]:
        """Buckets whose rows are not those of another version or table, told by the manifests alone.

        Buckets are the leaves of a tree of FAN: parents that agree are not opened.
        """
        if self.buckets != other.buckets:
            raise ValueError("tables of different numbers of buckets have no bucket in common")
        level = [[x.folders[b][2] if b in x.folders else "" for b in range(x.buckets)] for x in (self, other)]
        levels = [level]
        while len(level[0]) > 1:
            level = [[md5("|".join(x[at : at + FAN]).encode()).hexdigest() for at in range(0, len(x), FAN)] for x in level]
            levels.append(level)
        open_ = [0] if levels[-1][0] != levels[-1][1] else []
        for mine, theirs in levels[-2::-1]:
            below = [k for at in open_ for k in range(at * FAN, min((at + 1) * FAN, len(mine)))]
            open_ = [k for k in below if mine[k] != theirs[k]]
        return open_

    def to_json(self) -> str:
        folders = {str(b): list(x) for b, x in sorted(self.folders.items())}
        return json.dumps(self.__dict__ | {"folders": folders, "rewritten": list(self.rewritten)})

    @staticmethod
    def from_json(text: str) -> Manifest:
        held = json.loads(text)
        folders = {int(b): tuple(x) for b, x in held["folders"].items()}
        return Manifest(**held | {"folders": folders, "rewritten": tuple(held["rewritten"])})


def source() -> Column:
    """What a point was made of: a page's address or a deck's file, else the point itself."""
    return F.coalesce(F.when(F.col("kind") == "web", F.col("url")).otherwise(F.col("source_file")), F.col("point_id"))


def bucket_of(buckets: int) -> Column:
    return (F.conv(F.substring(F.md5(source()), 1, 7), 16, 10).cast("long") % buckets).cast("int")


class Folder:
    """The few file operations a commit needs, on whatever store the path names."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark._jvm, path.rstrip("/")
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self._at("").getFileSystem(self.conf)
        self.no_options = spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, name: str) -> list[str]:
        return [f.getPath().getName() for f in self.fs.listStatus(self._at(name))] if self.fs.exists(self._at(name)) else []

    def age(self, name: str) -> float:
        """Seconds since the folder last changed."""
        return time.time() - self.fs.getFileStatus(self._at(name)).getModificationTime() / 1000

    def remove(self, name: str) -> None:
        self.fs.delete(self._at(name), True)

    def create(self, name: str, text: str) -> bool:
        """Put a whole file under a name that is free; false where it is taken."""
        aside, at = self._at(f"{name}.{uuid.uuid4().hex}.staged"), self._at(name)
        out = self.fs.create(aside, False)
        out.write(bytearray(text.encode()))
        out.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), self.conf)
        try:
            context.rename(aside, at, self.no_options)
        except Py4JJavaError as error:
            self.fs.delete(aside, False)
            if "FileAlreadyExists" in error.java_exception.getClass().getName():
                return False
            raise
        return True


class Store:
    """A versioned table in one folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.folder = spark, path.rstrip("/"), Folder(spark, path)

    # ---- reading ------------------------------------------------------------------

    def versions(self) -> list[int]:
        return sorted(int(n[:DIGITS]) for n in self.folder.names("versions") if n == f"{n[:DIGITS]}.json")

    def manifest(self, version: int | None = None) -> Manifest:
        """A version, the last by default."""
        number = self.versions()[-1] if version is None else version
        text = self.spark.read.text(f"{self.path}/versions/{number:0{DIGITS}d}.json", wholetext=True).first()[0]
        return Manifest.from_json(text)

    def read(self, version: int | None = None, buckets: Iterable[int] | None = None, of: Manifest | None = None) -> DataFrame:
        """The rows of a version, or of some of its buckets: only their files are listed and read."""
        held = of or self.manifest(version)
        schema = T.StructType.fromJson(json.loads(held.schema))
        wanted = held.folders if buckets is None else [b for b in buckets if b in held.folders]
        paths = [f"{self.path}/data/{held.folders[b][0]}/bucket={b}" for b in wanted]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def compare(self, other: Store) -> tuple[DataFrame, list[int]]:
        """(point_id, verdict) of the points that only one table has or that differ, and the buckets read.

        Only buckets whose digests differ are read. A point that moved to another source's
        bucket differs in both.
        """
        mine, theirs = self.manifest(), other.manifest()
        buckets = mine.differing(theirs)
        digest = F.md5(F.to_json(F.struct("*"))).alias("digest")
        sides = [x.read(of=m, buckets=buckets).select("point_id", digest) for x, m in ((self, mine), (other, theirs))]
        found = index.diff_join(*sides, ["point_id"], "digest").where("verdict <> 'equal'")
        return found.select("point_id", "verdict"), buckets

    def history(self) -> DataFrame:
        """(version, action, buckets, rewritten, rows) of every version; one small file each."""
        held = [self.manifest(v) for v in self.versions()]
        rows = [(m.version, m.action, m.buckets, len(m.rewritten), m.rows) for m in held]
        return self.spark.createDataFrame(rows, "version long, action string, buckets long, rewritten long, rows long")

    # ---- writing ------------------------------------------------------------------

    def stage(self, rows: DataFrame, buckets: int, lying: DataFrame | None = None) -> dict[int, tuple[str, int, str]]:
        """Write rows to a new folder that no version names yet; a large bucket takes several files.

        `lying` are further rows, read from buckets of this table: their files hold few buckets each, so they
        are written by the tasks that read them and not dealt out again.
        """
        write = uuid.uuid4().hex
        placed = rows.withColumn("bucket", bucket_of(buckets)).hint("rebalance", "bucket")
        if lying is not None:
            placed = lying.select(*rows.columns).withColumn("bucket", bucket_of(buckets)).unionByName(placed)
        placed.write.partitionBy("bucket").parquet(f"{self.path}/data/{write}")
        if not any(n.startswith("bucket=") for n in self.folder.names(f"data/{write}")):
            return {}
        # the digest is a sum over rows, whatever files and order they lie in; a row a bucket
        row = F.conv(F.substring(F.md5(F.to_json(F.struct(*rows.columns))), 1, 15), 16, 10).cast("decimal(38,0)")
        held = self.spark.read.schema(T.StructType([*rows.schema.fields, T.StructField("bucket", T.IntegerType())]))
        held = held.parquet(f"{self.path}/data/{write}").groupBy("bucket")
        counted = held.agg(F.count("*").alias("n"), F.sum(row).cast("string").alias("digest")).collect()
        return {r["bucket"]: (write, r["n"], r["digest"]) for r in counted}

    def commit(self, base: Manifest | None, action: str, touched: Iterable[int], staged: dict[int, tuple[str, int, str]], schema: str, buckets: int) -> Manifest:
        """Make a staged write the next version; refused when `base` is no longer the last."""
        kept = {} if base is None else {b: x for b, x in base.folders.items() if b not in set(touched)}
        version = 1 if base is None else base.version + 1
        made = Manifest(version, action, buckets, schema, kept | staged, tuple(sorted(touched)))
        if not self.folder.create(f"versions/{version:0{DIGITS}d}.json", made.to_json()):
            raise ConcurrentCommit(f"{self.path} has a version {version} already: read it and start over")
        return made

    def create(self, rows: DataFrame, buckets: int = BUCKETS) -> Manifest:
        """Version 1."""
        staged = self.stage(rows, buckets)
        return self.commit(None, "create", staged, staged, rows.schema.json(), buckets)

    def rewrite(self, base: Manifest, action: str, touched: Iterable[int], change: Callable[[DataFrame], Changed]) -> Manifest:
        """Change the rows of the touched buckets and commit; no other file is read or written.

        `change` gives the rows, or a pair: rows that are as they were read, and the others.
        """
        touched = sorted(touched)
        after = change(self.read(of=base, buckets=touched)) if touched else None
        lying, after = after if isinstance(after, tuple) else (None, after)
        staged = {} if after is None else self.stage(after, base.buckets, lying)
        stray = set(staged) - set(touched)
        if stray:
            raise ValueError(f"rows of buckets {sorted(stray)} came out of a change that did not read them")
        return self.commit(base, action, touched, staged, base.schema, base.buckets)

    # ---- the index's operations ----------------------------------------------------

    def _buckets(self, rows: DataFrame, base: Manifest) -> set[int]:
        return {r[0] for r in rows.select(bucket_of(base.buckets)).distinct().collect()}  # numbers below `buckets`

    def _holding(self, batch: DataFrame, base: Manifest) -> set[int]:
        """Buckets of the batch's sources, and those that hold one of its ids under another source."""
        names = ["point_id", "kind", "url", "source_file"]  # only these columns are read
        moved = self.read(of=base).select(*names).join(batch.select("point_id").distinct(), "point_id", "left_semi")
        return self._buckets(batch.select(*names).unionByName(moved), base)

    def upsert(self, batch: DataFrame) -> Manifest:
        """Write by point id, the last write of an id wins."""
        base = self.manifest()
        return self.rewrite(base, "upsert", self._holding(batch, base), lambda rows: index.upsert_where_they_lie(rows, batch))

    def replace(self, batch: DataFrame) -> Manifest:
        """Upsert, then drop what the batch supersedes: the predecessors lie in its sources' buckets."""
        base = self.manifest()
        return self.rewrite(base, "replace", self._holding(batch, base), lambda rows: index.replace_where_they_lie(rows, batch))

    def _where(self, action: str, gone: Column, base: Manifest) -> Manifest:
        """Delete by predicate: buckets without such a row stay as they are."""
        held = self._buckets(self.read(of=base).where(gone), base)
        return self.rewrite(base, action, held, lambda rows: (rows.where(~gone), rows.limit(0)))

    def delete_run(self, run_id: str) -> Manifest:
        """Roll back one live run."""
        return self._where("delete run", index.of_run(run_id), self.manifest())

    def delete_material(self, sha256: str, course: str, year: str) -> Manifest:
        """Delete one deck of one edition."""
        return self._where("delete material", index.of_material(sha256, course, year), self.manifest())

    def sync(self, seen: DataFrame, failed: bool = False) -> Manifest:
        """Drop points of files that left an edition seen in a full run; nothing where a file failed."""
        base = self.manifest()
        if failed:
            return base
        names = ["point_id", "kind", "url", *index.SLIDES_KEY]
        rows = self.read(of=base).select(*names)
        kept = index.sync_editions(rows, seen).select("point_id", F.lit(True).alias("kept"))
        gone = rows.join(kept, "point_id", "left").where("kept is null")
        return self.rewrite(base, "sync", self._buckets(gone, base), lambda rows: index.sync_editions(rows, seen))

    # ---- old versions ---------------------------------------------------------------

    def unread(self, keep: int = 1) -> list[str]:
        """Write folders that none of the last `keep` versions names."""
        named = {w for v in self.versions()[-keep:] for w, *_ in self.manifest(v).folders.values()}
        return sorted(n for n in self.folder.names("data") if n not in named)

    def vacuum(self, keep: int, older_than: float) -> list[str]:
        """Remove the last `keep` versions' predecessors, and folders that none names and nobody has
        touched for `older_than` seconds: a writer that has not committed by then is taken for dead."""
        gone = [n for n in self.unread(keep) if self.folder.age(f"data/{n}") >= older_than]
        for version in self.versions()[:-keep]:
            self.folder.remove(f"versions/{version:0{DIGITS}d}.json")
        for name in gone:
            self.folder.remove(f"data/{name}")
        return gone
