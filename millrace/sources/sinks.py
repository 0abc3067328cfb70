"""Sinks: chunk files, manifest, checksums, rotation, object-store paths."""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

LEAST_ROTATION, PART_MB, GCS_STEP = 1_000_000, 5, 256 * 1024
MANIFEST = "_manifest.json"


def parse_uri(uri: str, scheme: str) -> tuple[str, str]:
    """bucket and prefix of scheme://bucket/prefix."""
    u = urlsplit(uri)
    if u.scheme != scheme or not u.netloc:
        raise ValueError(f"expected {scheme}://bucket/prefix, got {uri!r}")
    return u.netloc, u.path.strip("/")


def target_path(kind: str, config: dict) -> str:
    """Where Spark writes: local paths as they are, s3 and gs buckets through their Hadoop connectors."""
    path = config["path"]
    if kind == "s3":
        bucket, prefix = parse_uri(path, "s3")
        return f"s3a://{bucket}/{prefix}"
    if kind == "gcs":
        bucket, prefix = parse_uri(path, "gs")
        return f"gs://{bucket}/{prefix}"
    return path


def upload_settings(kind: str, config: dict) -> dict[str, str]:
    """Hadoop settings of an upload: part size of 5 MB or more, or chunks in steps of 256 KB."""
    if kind == "s3":
        return {"fs.s3a.multipart.size": f"{max(config.get('part_mb', 8), PART_MB)}M"}
    if kind == "gcs":
        return {"fs.gs.outputstream.upload.chunk.size": str(math.ceil(config.get("chunk_bytes", 8 << 20) / GCS_STEP) * GCS_STEP)}
    return {}


def file_name(pattern: str, obj: str, chunk_id: str, fmt: str) -> str:
    return pattern.format(object=obj, chunk_id=chunk_id, format=fmt)


def split_name(name: str) -> tuple[str, str]:
    """Stem and extension, dat without one."""
    stem, dot, ext = name.rpartition(".")
    return (stem, ext) if dot else (name, "dat")


def segment_name(name: str, number: int) -> str:
    stem, ext = split_name(name)
    return f"{stem}_part{number:03d}.{ext}"


def rows_per_segment(max_bytes: int, row_bytes: float) -> int:
    """Rows that keep a file near max_bytes; limits under a million bytes are refused."""
    if max_bytes < LEAST_ROTATION:
        raise ValueError(f"a file limit of at least {LEAST_ROTATION} bytes is needed")
    return max(1, int(max_bytes // max(row_bytes, 1)))


def write(df: DataFrame, path: str, fmt: str = "parquet", *, compression: str = "snappy", header: bool = True, sep: str = ",", null_value: str = "", encoding: str = "UTF-8", partition_by: str | None = None, max_bytes: int | None = None, row_bytes: float = 100.0) -> None:
    """Write rows under path; Spark's committer makes them visible only when all tasks have ended."""
    out = df.write.mode("overwrite")
    if partition_by:
        out = out.partitionBy(partition_by)
    if max_bytes:
        out = out.option("maxRecordsPerFile", rows_per_segment(max_bytes, row_bytes))
    if fmt == "csv":
        out.option("header", header).option("sep", sep).option("nullValue", null_value).option("encoding", encoding).csv(path)
    else:
        out.option("compression", compression).parquet(path)


#: Bytes of estimated rows that one file of a chunk should hold.
FILE_BYTES = 256 << 20


@dataclass(frozen=True)
class Written:
    """What became of a chunk: its files, in order, and the rows that went into them."""

    paths: tuple[str, ...]
    rows: int


def _files(fs, folder, wanted, below: str = "") -> list[tuple[str, object]]:
    """(folder below the root, path) of the files under folder whose names are wanted, in order; hidden folders don't count."""
    out = []
    for s in sorted(fs.listStatus(folder), key=lambda s: s.getPath().getName()):
        name = s.getPath().getName()
        if s.isDirectory():
            if not name.startswith((".", "_")):
                out += _files(fs, s.getPath(), wanted, f"{below}{name}/")
        elif wanted(name):
            out.append((below, s.getPath()))
    return out


def _is_part(name: str) -> bool:
    return name.startswith("part-")


def write_chunk(df: DataFrame, folder: str, name: str, fmt: str = "parquet", files: int = 1, **options) -> Written:
    """One chunk as a file of that name, or as numbered segments where it has several files.

    Rows are written by up to ``files`` tasks to a folder beside the target; every
    part file is then renamed, none is left behind, and only then the folder goes. Files of an earlier
    try of the same chunk are replaced. Rows are counted while they are written.
    """
    spark = df.sparkSession
    temp = f"{folder}/._{name}"
    seen = Observation()
    write(df.observe(seen, F.count(F.lit(1)).alias("rows")).coalesce(files), temp, fmt, **options)
    jvm = spark._jvm
    source, root = jvm.org.apache.hadoop.fs.Path(temp), jvm.org.apache.hadoop.fs.Path(folder)
    fs = source.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    stem, ext = split_name(name)
    earlier = re.compile(rf"{re.escape(stem)}(_part[0-9]{{3,}})?\.{re.escape(ext)}")
    for _, path in _files(fs, root, earlier.fullmatch):
        fs.delete(path, True)
    parts = _files(fs, source, _is_part)
    if not parts:  # a partitioned write of no rows
        fs.delete(source, True)
        return Written((), int(seen.get["rows"]))
    moved = []
    for number, (below, part) in enumerate(parts):
        if below:
            fs.mkdirs(jvm.org.apache.hadoop.fs.Path(f"{folder}/{below}"))
        target = jvm.org.apache.hadoop.fs.Path(f"{folder}/{below}{name if len(parts) == 1 else segment_name(name, number)}")
        fs.delete(target, True)
        if not fs.rename(part, target):
            raise OSError(f"could not move {part} to {target}")
        moved.append(target.toString())
    if _files(fs, source, _is_part):
        raise OSError(f"part files are left in {source}")
    fs.delete(source, True)
    return Written(tuple(moved), int(seen.get["rows"]))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path) -> (path, bytes, sha256), each file read in pieces."""
    for batch in batches:
        rows = []
        for uri in batch.column(0).to_pylist():
            fs, path = pafs.FileSystem.from_uri(uri)
            total, h = 0, hashlib.sha256()
            with fs.open_input_stream(path) as f:
                while piece := f.read(8 << 20):
                    total += len(piece)
                    h.update(piece)
            rows.append((uri, total, h.hexdigest()))
        cols = list(zip(*rows, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.string()), strict=True)], ["path", "bytes", "sha256"])


def inventory(spark: SparkSession, folder: str, fmt: str = "parquet", paths: list[str] | None = None) -> DataFrame:
    """path, bytes, sha256, n_rows of the data files under folder, or of those given.

    Local files are hashed in pieces by the tasks that read them, files of a store that only Spark reads as a whole.
    """
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{fmt}")
    source = paths or folder
    listed = reader.format("binaryFile").load(source).select("path")
    if folder.startswith("file:") or "://" not in folder:
        local = listed.select(F.regexp_replace("path", "^file:/+", "file:///").alias("path"))
        files = local.repartition(max(1, spark.sparkContext.defaultParallelism)).mapInArrow(_digests, "path string, bytes long, sha256 string")
    else:
        files = reader.format("binaryFile").load(source).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{fmt}")
    rows = reader.parquet(*(paths or [folder])) if fmt == "parquet" else reader.option("header", True).csv(source)
    counts = rows.select(F.col("_metadata.file_path").alias("path")).groupBy("path").agg(F.count(F.lit(1)).alias("n_rows"))
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    counts = counts.select(plain(F.col("path")).alias("_name"), "n_rows")
    return files.join(counts, plain(F.col("path")) == F.col("_name"), "left").select("path", "bytes", "sha256", F.coalesce("n_rows", F.lit(0)).alias("n_rows"))


def schema_hash(df: DataFrame) -> str:
    """Of the whole schema, so renames and type changes show."""
    return hashlib.sha256(df.schema.json().encode()).hexdigest()


def write_manifest(spark: SparkSession, folder: str, run_id: str, status: str, fmt: str = "parquet", schema: str | None = None, paths: list[str] | None = None) -> dict:
    """Put the list of the run's files (paths; all under folder where none are given) beside them, after the commit; one row a file."""
    files = [r.asDict() for r in inventory(spark, folder, fmt, paths).orderBy("path").collect()]
    body = {
        "run_id": run_id,
        "status": status,
        "created_at": datetime.now(timezone.utc).isoformat(),
        "schema_hash": schema,
        "file_count": len(files),
        "total_rows": sum(f["n_rows"] for f in files),
        "total_bytes": sum(f["bytes"] for f in files),
        "files": files,
    }
    jvm = spark._jvm
    temp, target = (jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}") for n in (f".{MANIFEST}.tmp", MANIFEST))
    fs = target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    out = fs.create(temp, True)
    out.write(bytearray(json.dumps(body, indent=1).encode()))
    out.close()
    fs.delete(target, True)
    fs.rename(temp, target)
    return body


def read_manifest(spark: SparkSession, folder: str) -> dict:
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{MANIFEST}")  # Spark's readers skip names that begin so
    stream = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).open(path)
    try:
        return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def verify_manifest(spark: SparkSession, folder: str, fmt: str = "parquet") -> list[str]:
    """Faults of the files against the manifest; none: empty."""
    known = {f["path"].rsplit("/", 1)[-1]: f for f in read_manifest(spark, folder)["files"]}
    there = {r["path"].rsplit("/", 1)[-1]: r for r in inventory(spark, folder, fmt).collect()}
    out = [f"{n} is missing" for n in sorted(set(known) - set(there))] + [f"{n} isn't listed" for n in sorted(set(there) - set(known))]
    return out + [f"{n} was changed" for n in sorted(set(known) & set(there)) if known[n]["sha256"] != there[n]["sha256"]]


def check_space(path: str, need_bytes: int, free_bytes: int | None = None) -> None:
    """Refuse a local target with less than 1.2 times the estimate free; a path whose space can't be told passes."""
    import shutil

    try:
        free = shutil.disk_usage(path).free if free_bytes is None else free_bytes
    except OSError:
        return
    if free < need_bytes * 1.2:
        raise RuntimeError(f"{need_bytes * 1.2:,.0f} bytes are needed at {path}, {free:,} are free")
