"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import re
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ..session import ensure_checkpoint_dir

#: White space as the contracts name it: space, tab, newline, vertical tab, form feed, return.
WS = " \t\n\x0b\x0c\r"
WS_CLASS = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path in the folder that driver and executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: later jobs
    neither compute it again nor depend on the executors that did, and a
    join on the result starts from a plain exchange that AQE can split."""
    path = scratch_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_file_order(df: DataFrame, name: str) -> DataFrame:
    """``df``, read from Parquet, with each row's position (0, 1, ...) in the
    order of the part files and of the rows in them: the order in which it was
    written. A scan itself packs files by size. One count per file is
    collected. A column of that name is replaced."""
    columns = [c for c in df.columns if c != name]
    file, row, before_file = (free_name(df, c) for c in ("__file", "__at", "__before"))
    at = df.select(*[F.col(f"`{c}`") for c in columns], F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(row))
    counts = {r[0]: r[1] for r in at.groupBy(file).agg(F.count(F.lit(1))).collect()}
    number = lambda f: int((re.findall(r"part-(\d+)", f) or [0])[-1])
    before, n = [], 0
    for f in sorted(counts, key=lambda f: (number(f), f)):
        before.append((f, n))
        n += counts[f]
    files = df.sparkSession.createDataFrame(before, f"{file} string, {before_file} long")
    return at.join(files, file).select(*[F.col(f"`{c}`") for c in columns], (F.col(before_file) + F.col(row)).alias(name))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or a longer one where ``df`` has a column of that name (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_row_key(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a key, in a new column of that (free) name, that is one
    row's alone and the same whenever ``df`` is evaluated: file and row index.
    What is no plain scan of files is written first."""
    def keyed(x: DataFrame) -> DataFrame:
        at = F.lpad(F.hex(F.col("_metadata.row_index")), 16, "0")
        return x.withColumn(name, F.concat(F.unhex(F.md5(F.col("_metadata.file_path").cast("binary"))), F.unhex(at)))

    if df._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation":
        try:
            return keyed(df)
        except AnalysisException:  # a relation without files, or of a format without row indexes
            pass
    return keyed(stored(df, "rows"))


def body(text_col: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def arrow_fields(schema: str) -> tuple[list, list]:
    """Names and Arrow types of a DDL schema."""
    parsed = StructType.fromDDL(schema)
    return parsed.names, [to_arrow_type(f.dataType) for f in parsed.fields]


def on_workers(df: DataFrame, run, schema: str) -> DataFrame:
    """``df.mapInArrow`` with this package on the Python workers' path (the
    same path as here; elsewhere it is shipped with --py-files)."""
    env = df.sparkSession.sparkContext.environment
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))
    return df.mapInArrow(run, schema)


def map_rows(df: DataFrame, make, schema: str) -> DataFrame:
    """``make(columns)`` maps the columns of one Arrow batch (lists) to the
    columns of ``schema`` (lists or arrays); one batch is in memory at a time."""
    def run(batches):
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                out = make(*[c.to_pylist() for c in b.columns])
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types)], names=names)

    names, types = arrow_fields(schema)
    return on_workers(df, run, schema)


def slices(texts: list[str], chars: int = 1 << 20):
    """``texts`` in runs of about ``chars`` code points, for work that holds all words of a run."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= chars:
            yield texts[at:i + 1]
            at, size = i + 1, 0
    if at < len(texts):
        yield texts[at:]


class Memo(dict):
    """A dictionary that forgets everything when it is full: bounded memory
    for work that repeats (one per worker process)."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit = limit

    def room(self, n: int) -> None:
        if len(self) + n > self.limit:
            self.clear()
