"""Reading tax-register exports.

* ``repair_lines``: the malformed-row repair of delimited text, as Column
  expressions over a DataFrame of raw lines (split, size, slice, join).
* ``read_register``: files -> lines (encoding chosen per file) -> records
  (``records``: quoted fields may hold line breaks) -> header removed ->
  repaired rows with an all-string schema; ``load_register`` also counts.
* ``read_zip_register``: ZIP archives as a data source, one task each, streamed.
* ``file_catalog`` / ``latest_snapshot``: file metadata without reading
  file contents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import col, strip
from ..session import cut_lineage
from .archives import read_archives
from .records import ESCAPE, QUOTE, has_mark, parsed, records

ENCODINGS = ("utf-8", "iso-8859-1")
#: Names of the encodings whose lines can be told apart by bytes: as Spark knows them.
KNOWN_ENCODINGS = {"utf-8": "UTF-8", "utf8": "UTF-8", "us-ascii": "US-ASCII", "ascii": "US-ASCII", "iso-8859-1": "ISO-8859-1",
                   "latin-1": "ISO-8859-1", "latin1": "ISO-8859-1"}
EXCLUDED_PREFIXES = ("inventory_", "processed_")


def repair_lines(lines: DataFrame, line_col: str, header: list[str], merge_at: int = 6,
                 sep: str = ",") -> DataFrame:
    """A line with quotes or escapes that has the right number of
    fields when these are honoured is read so. Any other line is split at
    every ``sep``; if that gives too many fields, the extras are merged back
    into field ``merge_at`` (0-based, the company name); a line with too few
    is marked 'skipped'. Adds ``repair_status`` (ok / fixed / skipped),
    ``n_fields`` and one string column per header field (NULL for skipped
    rows)."""
    n = len(header)
    text = strip(col(line_col))
    marked = text.contains(QUOTE) | text.contains(ESCAPE)
    parts = F.coalesce(F.when(marked, parsed(text, n, sep)), F.split(text, F.lit(sep), -1))
    return _repaired(lines, parts, header, merge_at, sep)


def repair_records(found: DataFrame, header: list[str], merge_at: int = 6, sep: str = ",") -> DataFrame:
    """``repair_lines`` of records (path, lines): a record of several lines
    that has the right number of fields, and nothing behind a closing quote
    but the next separator, is one row; the lines of any other one are taken
    one by one, as a stray quote must not swallow rows."""
    n = len(header)
    whole = F.array_join("lines", "\n")
    fields = F.when(F.size("lines") > 1, parsed(strip(whole), n, sep, strict=True))
    rows = found.select("path", F.col("lines"), whole.alias("__whole"), fields.alias("__fields"))
    line = "struct<line:string,fields:array<string>>"
    rows = rows.select("path", F.explode(F.when(
        F.col("__fields").isNotNull(), F.array(F.struct(F.col("__whole").alias("line"), F.col("__fields").alias("fields"))).cast(f"array<{line}>"))
        .otherwise(F.transform("lines", lambda x: F.struct(x.alias("line"), F.lit(None).cast("array<string>").alias("fields")))
                   .cast(f"array<{line}>"))).alias("__r"))
    text = strip(F.col("__r.line"))
    marked = text.contains(QUOTE) | text.contains(ESCAPE)
    parts = F.coalesce(F.col("__r.fields"), F.when(marked, parsed(text, n, sep)), F.split(text, F.lit(sep), -1))
    lines = rows.select(F.col("__r.line").alias("line"), "path", parts.alias("__p")).filter(text_of_line() != "")
    return _repaired(lines, F.col("__p"), header, merge_at, sep).drop("__p")


def text_of_line() -> Column:
    return strip(F.col("line"))


def _repaired(lines: DataFrame, parts: Column, header: list[str], merge_at: int, sep: str) -> DataFrame:
    n = len(header)
    staged = lines.select("*", parts.alias("__parts"))
    parts, size = F.col("__parts"), F.size("__parts")
    extra = size - F.lit(n)
    merged = F.concat(
        F.slice(parts, 1, merge_at),
        F.array(F.array_join(F.slice(parts, merge_at + 1, extra + 1), sep)),
        F.slice(parts, F.lit(merge_at + 2) + extra, F.lit(n)))
    fields = F.when(size == n, parts).when(size > n, merged)
    status = F.when(size == n, F.lit("ok")).when(size > n, F.lit("fixed")).otherwise(F.lit("skipped"))
    out = staged.select(*lines.columns, status.alias("repair_status"), size.alias("n_fields"), fields.alias("__f"))
    return out.select(*lines.columns, "repair_status", "n_fields",
                      *[F.col("__f")[i].alias(h) for i, h in enumerate(header)])


def repair_counts(repaired: DataFrame) -> DataFrame:
    """Rows per repair status (the fixed / skipped counters)."""
    return repaired.groupBy("repair_status").agg(F.count(F.lit(1)).cast("bigint").alias("n"))


def _spark_name(encoding: str) -> str:
    if encoding.lower() not in KNOWN_ENCODINGS:
        raise ValueError(f"encoding {encoding!r} is none of {sorted(KNOWN_ENCODINGS)}")
    return KNOWN_ENCODINGS[encoding.lower()]


def file_profile(spark: SparkSession, paths, encoding: str) -> DataFrame:
    """(path, undecodable, marked, head) per file read in an encoding: whether
    some bytes are none of it, whether a quote or an escape could join lines,
    and the first line. One aggregate, narrow rows."""
    name, raw = _spark_name(encoding), _raw_lines(spark, paths)
    bad = {"UTF-8": ~F.is_valid_utf8("value"), "US-ASCII": F.octet_length("value") != F.length(F.regexp_replace(
        F.decode(F.col("value").cast("binary"), "ISO-8859-1"), r"[^\x00-\x7f]+", "")), "ISO-8859-1": F.lit(False)}[name]
    lines = raw.select("path", "block", "at", bad.alias("bad"), _decoded_line(encoding).alias("line"))
    return lines.groupBy("path").agg(F.max("bad").alias("undecodable"), F.max(has_mark(F.col("line"))).alias("marked"),
                                     F.min_by(F.when(F.col("block") == 0, F.col("line")), F.struct("block", "at")).alias("head"))


def detect_encodings(spark: SparkSession, path: str, encodings: tuple = ENCODINGS) -> DataFrame:
    """Per file, the first encoding of ``encodings`` that decodes it, and what
    ``file_profile`` says of it. The encodings are tried in order, each on the
    files that all before it could not decode; a file in none of them raises."""
    left, out = path, None
    for enc in encodings:
        seen = cut_lineage(file_profile(spark, left, enc))
        good = seen.filter("NOT undecodable").withColumn("encoding", F.lit(enc))
        out = good if out is None else out.unionByName(good)
        left = [r["path"] for r in seen.filter("undecodable").select("path").toLocalIterator()]
        if not left:
            return out.select("path", "encoding", "marked", "head")
    raise ValueError(f"in none of the encodings {encodings}: {left[:5]}")


def _raw_lines(spark: SparkSession, paths) -> DataFrame:
    """(value, path, block, at): every line, blank ones too, its bytes as they are."""
    return spark.read.text(paths).select(
        "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"))


def _decoded_line(encoding: str) -> Column:
    name = _spark_name(encoding)
    return F.col("value") if name == "UTF-8" else F.decode(F.col("value").cast("binary"), "ISO-8859-1")


def _read_lines(spark: SparkSession, paths, encoding: str) -> DataFrame:
    return _raw_lines(spark, paths).select(_decoded_line(encoding).alias("line"), "path", "block", "at")


def _trimmed_fields(line: str) -> Column:
    return F.array_join(F.transform(F.split(strip(F.col(line)), ","), strip), ",")


def _one_header(first_lines: DataFrame) -> list[str]:
    """The header that all files share, from each file's first line; files
    with other columns, or the same in another order, raise."""
    heads = [r["head"] for r in first_lines.select(_trimmed_fields("line").alias("head")).distinct().limit(2).collect()]
    if not heads:
        raise FileNotFoundError("no file with a header line")
    if len(heads) > 1:
        raise ValueError(f"files have different headers: {heads}")
    return heads[0].split(",")


def read_register(spark: SparkSession, path: str, header: list[str] | None = None, merge_at: int = 6,
                  encodings: tuple = ENCODINGS, keep_skipped: bool = False) -> DataFrame:
    """Read every file under ``path`` as repaired register rows.

    The encoding is chosen per file; the driver only sees the list of
    (file, encoding) pairs. The header is the first line of every file; all
    files must have the same one, and lines equal to it are dropped. Quoted
    fields may hold line breaks (read as ``\\n``). ``keep_skipped`` keeps
    unusable lines; ``load_register`` counts them.
    """
    plan = detect_encodings(spark, path, encodings)
    groups: dict[str, list[str]] = {}
    joins = False
    for row in plan.select("path", "encoding", "marked").toLocalIterator():
        groups.setdefault(row["encoding"], []).append(row["path"])
        joins = joins or row["marked"]
    if not groups:
        raise FileNotFoundError(path)
    frames = [_read_lines(spark, ps, enc) for enc, ps in sorted(groups.items())]
    lines = frames[0]
    for f in frames[1:]:
        lines = lines.unionByName(f)
    found = _one_header(plan.select(F.col("head").alias("line")))
    header = header or found
    if joins:
        blocks = cut_lineage(lines.groupBy("path", "block").agg(
            F.min("at").alias("first"), F.max("at").alias("last"), F.max(has_mark(F.col("line"))).alias("marked")))
        out = repair_records(records(lines, blocks), header, merge_at)
    else:
        out = repair_lines(lines.filter(text_of_line() != "").drop("block", "at"), "line", header, merge_at)
    out = out.filter(_trimmed_fields("line") != F.lit(",".join(found)))
    return out if keep_skipped else out.filter(F.col("repair_status") != "skipped")


def load_register(spark: SparkSession, path: str, **options) -> tuple[DataFrame, DataFrame]:
    """(usable rows, rows per file and repair status): what a load takes and
    how many lines it repaired or had to skip. The skipped lines themselves
    are what ``read_register(keep_skipped=True)`` marks so."""
    rows = read_register(spark, path, **options, keep_skipped=True)
    name = F.element_at(F.split("path", "/"), -1)
    counts = rows.groupBy(name.alias("file"), "repair_status").agg(F.count(F.lit(1)).cast("bigint").alias("n"))
    return rows.filter(F.col("repair_status") != "skipped"), counts


def read_zip_register(spark: SparkSession, path: str, suffix: str = ".csv", merge_at: int = 6,
                      encodings: tuple = ENCODINGS, keep_skipped: bool = False) -> DataFrame:
    """First ``suffix`` member of every ZIP under ``path`` (by name), one
    task per archive, streamed (``archives``), then repaired like plain files.
    Line 0 of each member is its header; all must agree. An archive in none of
    the encodings raises. The driver lists the archives' names, like files'."""
    zips = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path")
    paths = sorted(r["path"] for r in zips.toLocalIterator())
    if not paths:
        raise FileNotFoundError(f"no archive under {path}")
    lines = read_archives(spark, paths, suffix, encodings).select("path", F.lit(0).cast("bigint").alias("block"),
                                                                  F.col("line_no").alias("at"), "line")
    blocks = cut_lineage(lines.groupBy("path", "block").agg(
        F.min("at").alias("first"), F.max("at").alias("last"), F.max(has_mark(F.col("line"))).alias("marked"),
        F.min_by("line", "at").alias("line")))
    header = _one_header(blocks.select("line"))
    out = repair_records(records(lines, blocks.drop("line")), header, merge_at)
    out = out.filter(_trimmed_fields("line") != F.lit(",".join(header)))
    return out if keep_skipped else out.filter(F.col("repair_status") != "skipped")


def _listed(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(path, length, modification time in ms) of the files under a path or
    pattern, empty ones too, which Spark's scans leave out; hidden ones are
    not listed. Metadata only, on the driver, as Spark lists inputs."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    out = []
    for top in fs.globStatus(at) or ():
        files = fs.listFiles(top.getPath(), True)
        while files.hasNext():
            f = files.next()
            if not f.getPath().getName().startswith(("_", ".")):
                out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return out


def file_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Name, size, size in MB (2 places), modification time and the
    exists-and-non-empty check; file contents are never read."""
    files = spark.createDataFrame(_listed(spark, path), "path string, length bigint, ms bigint")
    return files.select(
        "path", F.element_at(F.split("path", "/"), -1).alias("name"),
        F.col("length").alias("size_bytes"),
        F.round(F.col("length") / F.lit(1048576), 2).alias("size_mb"),
        F.timestamp_millis("ms").alias("modified"),
        (F.col("length") > 0).alias("usable"))


def latest_snapshot(files: DataFrame, name_col: str = "name", mtime_col: str = "modified",
                    exclude: tuple = EXCLUDED_PREFIXES) -> DataFrame:
    """The newest file whose name has none of the excluded prefixes
    (ties on time broken by name)."""
    keep: Column = F.lit(True)
    for p in exclude:
        keep = keep & ~col(name_col).contains(p)
    cand = files.filter(keep)
    return cand.orderBy(col(mtime_col).desc(), col(name_col).desc()).limit(1)
