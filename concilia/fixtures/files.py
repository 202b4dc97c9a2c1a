"""Files for queries over archives and file metadata, written by tasks from
derived rows into the folder that driver and executors share."""

from __future__ import annotations

import zipfile

from pyspark.sql import DataFrame

from ..session import on_workers


def _local(uri: str) -> str:
    return "/" + uri[5:].lstrip("/") if uri.startswith("file:") else uri


def _out(root: str, name: str):
    path = f"{_local(root)}/{name}"
    if "://" not in path:
        return open(path, "wb")
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path)
    return store.open_output_stream(at)


def write_files(lines: DataFrame, root: str, archive: bool = False, member: str = "archivoVentas.csv") -> int:
    """Writes the lines (name, line), which lie in order within partitions and
    a name in one partition, as the files ``name``, or as a member of ZIP
    archives of that name; returns how many."""
    lines.sparkSession._jvm.org.apache.hadoop.fs.Path(root).getFileSystem(
        lines.sparkSession._jsc.hadoopConfiguration()).mkdirs(lines.sparkSession._jvm.org.apache.hadoop.fs.Path(root))

    def run(batches):
        import pyarrow as pa

        here, raw, box, out, done = None, None, None, None, []

        def close():
            if here is not None:
                if archive:
                    out.close()
                    box.close()
                raw.close()
                done.append(here)

        for b in batches:
            for name, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if name != here:
                    close()
                    here, raw = name, _out(root, name)
                    if archive:
                        box = zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED)
                        out = box.open(member, "w")
                    else:
                        out = raw
                if line is not None:
                    out.write(line.encode() + b"\n")
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(done)], names=["name"])

    return on_workers(lines.select("name", "line"), run, "name string").count()
