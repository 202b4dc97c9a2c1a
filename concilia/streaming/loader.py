"""Incremental loading of register exports with Structured Streaming.

The reference runs one batch per month; nothing in it is streaming. For a
continuous feed of export files, each micro-batch goes through the same
batch operators: read and repair the new files, map to the typed register, merge into
the current snapshot and publish a new version. ``merge_plan`` is
idempotent, so a micro-batch replayed after a failure gives the same
snapshot, and the stream's checkpoint (in the shared checkpoint folder)
records which files were consumed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import REGISTER_COLUMN_MAP
from ..operators.register import map_register, validate_register
from ..operators.upsert import merge_plan
from ..session import cut_lineage
from ..sinks.snapshot import commit_load
from ..sources.registers import read_register


def _files_stream(spark: SparkSession, source_dir: str) -> DataFrame:
    """New files, by name; their contents are not read here."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).load(source_dir).select("path")


def load_stream(spark: SparkSession, source_dir: str, target_root: str, header: list[str],
                column_map: tuple = REGISTER_COLUMN_MAP, key: str = "authorization_code",
                merge_at: int = 6, name: str = "register-loader", available_now: bool = True,
                checkpoint_location: str | None = None) -> StreamingQuery:
    """Start a stream that loads every new export file under ``source_dir``
    into the versioned register at ``target_root``. The stream's progress
    (files consumed) is kept with the target, under ``_checkpoints/``, on
    the same shared storage."""
    files = _files_stream(spark, source_dir)

    def apply_batch(batch: DataFrame, batch_id: int) -> None:
        if not batch.limit(1).take(1):
            return
        paths = [r["path"] for r in batch.select("path").distinct().toLocalIterator()]  # the files of one trigger
        mapped = map_register(read_register(spark, paths, header, merge_at), column_map)
        issues = validate_register(mapped).collect()  # at most one row per rule
        if issues:
            raise ValueError(f"batch {batch_id} is not loaded: {issues}")
        empty = mapped.limit(0).withColumn("created_at", F.current_timestamp()).withColumn("updated_at", F.current_timestamp())
        commit_load(cut_lineage(mapped), target_root, key, lambda old, new: merge_plan(old, new, key).drop("action"), empty=empty)

    ckpt = checkpoint_location or f"{target_root.rstrip('/')}/_checkpoints/{name}"
    writer = files.writeStream.foreachBatch(apply_batch).option("checkpointLocation", ckpt).queryName(name)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
