"""Versioned table snapshots in key buckets, with optimistic commits (K5).

Layout under a root:

* ``data/<load>/bucket=<b>/``  Parquet files of one load, dealt by
  ``pmod(xxhash64(key), buckets)``; never changed once written
* ``versions/<n>.json``        manifest of version n: the version it was made
  from (``base``), key, number of buckets, schema, and for every bucket the
  folders that hold it; a version is the union of buckets that several loads
  wrote

A load reads and writes only the buckets that its keys fall into (copy on
write); all others are taken over by name. Publishing is one exclusive step:
the manifest is written aside and then moved to ``versions/<base + 1>.json``,
which fails if that name exists. So of two loads made from the same base one
raises ``Conflict`` and can be made again from the new base; no load is lost,
no reader sees a part of a load, and a writer that dies leaves only files that
no manifest names (``orphans``). Paths go through the Hadoop FileSystem API,
where a rename to an existing name fails; on a local disk a hard link does.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKET = "__bucket"
#: What a merge says of a row, and its values.
ACTION, ACTIONS = "action", ("insert", "update", "keep")


class Conflict(RuntimeError):
    """Another load has published the next version first."""


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _names(spark: SparkSession, folder: str) -> list[str]:
    fs, p = _path(spark, folder)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def _text(spark: SparkSession, path: str) -> str:
    """A small file of the driver's own making, whole."""
    fs, p = _path(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _publish(spark: SparkSession, aside: str, target: str) -> bool:
    """Gives the file the name ``target`` unless that name is taken, in one step."""
    fs, p = _path(spark, aside)
    to = spark._jvm.org.apache.hadoop.fs.Path(target)
    if fs.getScheme() != "file":
        try:
            return bool(fs.rename(p, to))
        except Exception as e:  # noqa: BLE001  some file systems raise where others return false
            if fs.exists(to):
                return False
            raise e
    local = lambda x: spark._jvm.java.io.File(fs.makeQualified(x).toUri().getPath()).toPath()
    try:
        spark._jvm.java.nio.file.Files.createLink(local(to), local(p))  # a rename would replace the file
    except Exception as e:  # noqa: BLE001
        if "FileAlreadyExistsException" in str(e):
            return False
        raise
    finally:
        fs.delete(p, False)
    return True


def _root(root: str) -> str:
    return root.rstrip("/")


def committed_versions(spark: SparkSession, root: str) -> list[int]:
    names = _names(spark, f"{_root(root)}/versions")
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def manifest_path(root: str, version: int) -> str:
    return f"{_root(root)}/versions/{version:06d}.json"


def manifest(spark: SparkSession, root: str, version: int | None = None) -> dict | None:
    """The manifest of a version, or of the newest one."""
    versions = committed_versions(spark, root)
    if version is None and not versions:
        return None
    return json.loads(_text(spark, manifest_path(root, versions[-1] if version is None else version)))


def _folders(m: dict, buckets=None) -> list[str]:
    wanted = m["files"] if buckets is None else [str(b) for b in buckets]
    return [f for b in wanted for f in m["files"].get(b, [])]


def _read(spark: SparkSession, root: str, m: dict, buckets=None) -> DataFrame:
    schema = StructType.fromJson(m["schema"])
    folders = [f"{_root(root)}/{f}" for f in _folders(m, buckets)]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def read_version(spark: SparkSession, root: str, version: int) -> DataFrame:
    return _read(spark, root, manifest(spark, root, version))


def read_current(spark: SparkSession, root: str) -> DataFrame | None:
    m = manifest(spark, root)
    return None if m is None else _read(spark, root, m)


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(buckets)).cast("int")


def _write_buckets(df: DataFrame, root: str, key: str | None, buckets: int, seen: Observation | None = None) -> dict[str, list[str]]:
    """Writes the rows dealt by bucket; {bucket: folders, relative to the
    root}. ``seen`` observes how many rows have which ``action``, in the stage
    that writes: there a task that runs again is counted once. The column is
    not written."""
    load = f"data/{uuid.uuid4().hex}"
    at = bucket_of(F.col(f"`{key}`"), buckets) if key else F.lit(0)
    # a salt lets a bucket be written by several tasks; AQE joins small ones
    dealt = df.withColumn(BUCKET, at).withColumn("__salt", F.pmod(F.xxhash64(F.struct(*[F.col(f"`{c}`") for c in df.columns])), F.lit(16)))
    dealt = dealt.repartition(BUCKET, "__salt") if key else dealt
    if seen is not None:
        counts = [F.count(F.when(F.col(ACTION) == a, 1)).alias(a) for a in ACTIONS]
        dealt = dealt.observe(seen, *counts, F.count(F.lit(1)).alias("rows_written")).drop(ACTION)
    dealt.drop("__salt").write.partitionBy(BUCKET).parquet(f"{_root(root)}/{load}")
    names = _names(df.sparkSession, f"{_root(root)}/{load}")
    return {n.split("=")[1]: [f"{load}/{n}"] for n in names if n.startswith(f"{BUCKET}=")}


def _commit(spark: SparkSession, root: str, m: dict) -> str:
    target = manifest_path(root, m["version"])
    aside = f"{_root(root)}/versions/.{uuid.uuid4().hex}"
    fs, p = _path(spark, aside)
    out = fs.create(p, False)
    try:
        out.write(bytearray(json.dumps(m).encode()))
    finally:
        out.close()
    if not _publish(spark, aside, target):
        raise Conflict(f"version {m['version']} of {root} was published by another load; base {m['base']} is not the newest")
    return target


def _latest(spark: SparkSession, root: str) -> int:
    versions = committed_versions(spark, root)
    return versions[-1] if versions else 0


def commit_snapshot(df: DataFrame, root: str, base: int | None = None, key: str | None = None, buckets: int = 1) -> str:
    """Writes ``df`` as the whole next version and returns its manifest's
    path. ``base``: the version that ``df`` was made from (default: the newest
    when the call begins); if another one has been published meanwhile,
    ``Conflict`` is raised and nothing changes for readers."""
    spark = df.sparkSession
    base = _latest(spark, root) if base is None else base
    files = _write_buckets(df, root, key, buckets)
    return _commit(spark, root, {"version": base + 1, "base": base, "key": key, "buckets": buckets, "schema": df.schema.jsonValue(),
                                 "files": files})


def commit_load(source: DataFrame, root: str, key: str, merge: Callable[[DataFrame, DataFrame], DataFrame],
                buckets: int = 256, base: int | None = None, empty: DataFrame | None = None,
                counts: dict | None = None) -> str:
    """Publishes the version in which ``merge(target rows, source)`` stands in
    for the buckets that keys of ``source`` fall into. All other buckets'
    files are taken over untouched and not read. ``source`` should be stored:
    it is read for its buckets, and again by the merge. ``empty``: rows
    without content of the target's schema, for a first load, which also
    fixes the number of buckets; it follows the size of the register, as a
    load rewrites a bucket at a time. ``counts`` is filled with the rows per
    ``action`` of the merge (which then has that column) and those written."""
    spark = source.sparkSession
    base = _latest(spark, root) if base is None else base
    m = manifest(spark, root, base) if base else None
    if m is None and empty is None:
        raise ValueError("a first load needs the target's schema")
    if m and (m["key"] or key) != key:
        raise ValueError(f"the register is dealt by {m['key']}, not by {key}")
    if m and not m["key"]:  # a snapshot that was not dealt yet is rewritten once
        plan, taken = merge(_read(spark, root, m), source), {}
    else:
        buckets = m["buckets"] if m else buckets
        touched = sorted(r[0] for r in source.filter(F.col(f"`{key}`").isNotNull()).select(
            bucket_of(F.col(f"`{key}`"), buckets).alias(BUCKET)).distinct().toLocalIterator())  # at most as many as buckets
        target = _read(spark, root, m, touched) if m else empty.limit(0)
        plan, taken = merge(target, source), {b: f for b, f in (m["files"] if m else {}).items() if int(b) not in set(touched)}
    kept = [c for c in plan.columns if counts is None or c != ACTION]
    if m and set(kept) != set(StructType.fromJson(m["schema"]).names) and taken:
        raise ValueError("a load that adds or drops columns has to rewrite the whole register: use commit_snapshot")
    seen = None if counts is None else Observation()
    files = _write_buckets(plan, root, key, buckets, seen)
    path = _commit(spark, root, {"version": base + 1, "base": base, "key": key, "buckets": buckets,
                                 "schema": plan.select(*[F.col(f"`{c}`") for c in kept]).schema.jsonValue(), "files": taken | files})
    if counts is not None:
        counts.update(seen.get)
    return path


def orphans(spark: SparkSession, root: str) -> list[str]:
    """Folders of loads that no manifest names: loads that lost a conflict or
    died, or, while it runs, one that is not published yet."""
    named = {f.split("/")[1] for v in committed_versions(spark, root) for f in _folders(manifest(spark, root, v))}
    return sorted(n for n in _names(spark, f"{_root(root)}/data") if n not in named)
