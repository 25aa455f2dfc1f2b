"""Landed-file scans and sinks."""

from __future__ import annotations

import contextlib
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pliego.schemas import API_SCHEMA, NA_TOKENS


def null_tokens(df: DataFrame, tokens: list[str] = NA_TOKENS) -> DataFrame:
    """Q33: the text tokens pandas reads as missing become null."""
    cols = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: F.when(F.col(c).isin(tokens), F.lit(None)).otherwise(F.col(c)) for c in cols})


def scan_csv_text(spark: SparkSession, path: str, na_values: list[str] | None = NA_TOKENS,
                  multi_line: bool | None = None) -> DataFrame:
    """CSV with header -> all-string frame (no inference); the BOM in the
    header is handled by the reader.

    Quoted newlines make a file one task, so they are looked for: a scan of the
    lines, split like any text, finds whether a line leaves a quote open (an odd
    number of quotation marks). Only such files are read whole; others are split
    whatever their size. ``multi_line`` says it without the scan."""
    if multi_line is None:
        marks = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
        multi_line = not spark.read.text(path).where(marks % 2 == 1).isEmpty()
    df = (spark.read.option("header", "true").option("multiLine", str(multi_line).lower()).option("escape", '"')
          .option("inferSchema", "false").option("encoding", "UTF-8").csv(path))
    return null_tokens(df, na_values) if na_values else df


def _committed_folders(spark: SparkSession, folder: str) -> list[tuple[int, str]]:
    """(time, path) of the finished snapshots in a folder: subfolders with a ``_SUCCESS`` file, and its time."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    marks = fs.globStatus(path(path(folder), "*/_SUCCESS")) or []
    return [(m.getModificationTime(), m.getPath().getParent().toString()) for m in marks]


def latest_snapshot(spark: SparkSession, folder: str, fmt: str = "csv") -> DataFrame:
    """Rows of the newest snapshot in a folder (by modification time).

    A snapshot is a file, or a subfolder of many files that Spark wrote, as new
    as its ``_SUCCESS`` file; where there are such subfolders, files in other
    subfolders are unfinished and left out. Files are listed through the
    ``binaryFile`` source without selecting its content column, so only file
    metadata is read; one row (the newest path) reaches the driver, and only
    that snapshot is scanned."""
    folders = _committed_folders(spark, folder)
    listing = (spark.read.format("binaryFile").option("recursiveFileLookup", str(not folders).lower()).load(folder)
               .select("path", F.unix_millis("modificationTime").alias("time")))
    if folders:
        done = spark.createDataFrame(folders, "time long, path string").select("path", "time")
        top = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder).toUri().getPath().rstrip("/")
        # files of the folder itself
        listing = listing.filter(F.regexp_replace("path", "^[a-z0-9]+:(//[^/]*)?(?=/)|/[^/]*$", "") == top).unionByName(done)
    newest = listing.orderBy(F.desc("time"), F.desc("path")).select("path").first()
    if newest is None:
        return spark.createDataFrame([], T.StructType([]))
    if fmt == "csv":
        return scan_csv_text(spark, newest["path"])
    return spark.read.format(fmt).load(newest["path"])


# ---- bases: folders of whole versions ------------------------------------------

#: Versions that stay after a write: the new one and the one that readers may still have open.
KEEP_VERSIONS = 2


def _hadoop(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def version_folder(path: str, version: int) -> str:
    return f"{path.rstrip('/')}/v{version:08d}"


def base_versions(spark: SparkSession, path: str) -> list[int]:
    """Finished versions of the base at ``path``, oldest first: folders that Spark closed with ``_SUCCESS``."""
    fs, target = _hadoop(spark, f"{path.rstrip('/')}/v*/_SUCCESS")
    names = [m.getPath().getParent().getName() for m in fs.globStatus(target) or []]
    return sorted(int(n[1:]) for n in names if n[1:].isdigit())


class BaseIsBeingWritten(RuntimeError):
    """Another writer holds the base, or died while it did."""


@contextlib.contextmanager
def writing(spark: SparkSession, path: str, owner: str | None = None, takeover: bool = False):
    """The number of the next version, for one writer at a time.

    A file beside the versions names the writer. It goes when the writer ends, also by
    an error; one that died leaves it, and the same ``owner`` (a stream's batch that is
    run again) or ``takeover`` goes on from there."""
    owner = owner or uuid.uuid4().hex
    fs, mark = _hadoop(spark, f"{path.rstrip('/')}/_writer")
    try:
        out = fs.create(mark, False)
    except Py4JJavaError:
        if not fs.exists(mark):
            raise
        stream = fs.open(mark)
        held = bytes(stream.readAllBytes()).decode()
        stream.close()
        if held != owner and not takeover:
            raise BaseIsBeingWritten(f"{path} is held by {held}; if that writer died, write with takeover=True") from None
        out = fs.create(mark, True)
    out.write(bytearray(owner.encode()))
    out.close()
    try:
        yield max(base_versions(spark, path), default=0) + 1
    finally:
        fs.delete(mark, False)


def drop_old_versions(spark: SparkSession, path: str, *beside: str) -> None:
    """Remove all but the newest ``KEEP_VERSIONS`` finished versions, and what was left of writers that died before them.

    ``beside`` names further folders that hold one folder a version."""
    kept = base_versions(spark, path)[-KEEP_VERSIONS:]
    if not kept:
        return
    for top in (path, *beside):
        fs, target = _hadoop(spark, f"{top.rstrip('/')}/v*")
        for folder in fs.globStatus(target) or []:
            name = folder.getPath().getName()
            if name[1:].isdigit() and int(name[1:]) < kept[-1] and int(name[1:]) not in kept:
                fs.delete(folder.getPath(), True)


def scan_base(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """S3: the newest finished version of a base, Parquet or CSV by extension.

    A path without versions is read as it is (a base written by something else); a
    missing base is an empty frame, an unreadable one an error."""
    fs, target = _hadoop(spark, path)
    if not fs.exists(target):
        return spark.createDataFrame([], schema or T.StructType([]))
    known = base_versions(spark, path)
    if not known and fs.exists(_hadoop(spark, f"{path.rstrip('/')}/_writer")[1]):
        return spark.createDataFrame([], schema or T.StructType([]))   # its first version is being written
    folder = version_folder(path, known[-1]) if known else path
    return scan_csv_text(spark, folder) if path.endswith(".csv") else spark.read.parquet(folder)


def scan_api_dump(spark: SparkSession, path: str, schema: T.StructType = API_SCHEMA,
                  json_lines: bool = True) -> DataFrame:
    """Landed API pages -> the fixed columns, missing as null.

    ``json_lines`` reads one record per line (splittable); pass False for
    files holding one JSON array of records (read whole per file)."""
    return spark.read.schema(schema).option("multiLine", str(not json_lines).lower()).json(path)


def sink_csv(df: DataFrame, path: str) -> None:
    """CSV with header (Spark writes no BOM; readers here do not need one)."""
    df.write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def sink_base(df: DataFrame, path: str, takeover: bool = False) -> None:
    """The base's next version, Parquet or CSV by extension, in a new folder.

    Readers see it once Spark has closed it with ``_SUCCESS``; until then they see the
    version before, so ``df`` may come from the base itself, and a failed write loses
    nothing. One writer at a time; a second one is refused."""
    spark = df.sparkSession
    with writing(spark, path, takeover=takeover) as version:
        folder = version_folder(path, version)      # may hold files of a writer that died
        if path.endswith(".csv"):
            sink_csv(df, folder)
        else:
            df.write.mode("overwrite").parquet(folder)
        drop_old_versions(spark, path)


def sink_report_tables(sections: dict[str, DataFrame], path: str, fmt: str = "parquet") -> list[str]:
    """One table per study section."""
    written = []
    for name, df in sections.items():
        out = f"{path.rstrip('/')}/{name}"
        w = df.write.mode("overwrite")
        (w.option("header", "true").csv(out) if fmt == "csv" else w.parquet(out))
        written.append(out)
    return written
