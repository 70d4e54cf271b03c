"""Prediction sink, payload digest and file audit."""

from __future__ import annotations

import hashlib
import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Files are read in ranges of so many bytes; the length is part of a file's digest.
CHUNK_BYTES = 64 << 20

# Ship the in-task helpers with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

DIGEST_WIDTH = 3
BUCKET_ROWS = 100_000


def write_predictions(records: DataFrame, path: str) -> None:
    """Records as JSON lines in session order, fields in column order."""
    records.orderBy("session_id", "turn_number").write.mode("overwrite").json(path)


def record_hashes(records: DataFrame) -> DataFrame:
    return records.select("session_id", F.sha2(F.to_json(F.struct(*records.columns)).cast("binary"), 256).alias("sha"))


def payload_hash(records: DataFrame) -> DataFrame:
    """Digest of all records, independent of partitioning.

    Record hashes are gathered in order per hash prefix, which is as long as the number of records asks for; the digests
    of the prefixes are hashed again, three hex digits shorter each time, until one is left. The first prefix has three
    digits up to 409.6 million records, six up to 1.7 trillion and so on, so the same records always give the same digest.
    """
    hashes = record_hashes(records)
    width = DIGEST_WIDTH
    while hashes.count() > BUCKET_ROWS * 16 ** width and width < 15:
        width += 3
    now = hashes.select("sha", F.col("sha").alias("d"))
    while width >= 0:
        now = (now.groupBy(F.substring("sha", 1, width).alias("b"))
               .agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sha", "d"))), lambda s: s["d"]), "").cast("binary"), 256)
                    .alias("d")).select(F.col("b").alias("sha"), "d"))
        width -= 3
    return now.select(F.col("d").alias("payload_sha"))


def _filesystem(path: str):
    """The file system of a path as Spark names it, and the path within it."""
    from pyarrow import fs
    if path.startswith(("file:", "/")):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def file_name(name):
    """A safe file name for any name: its SHA-256."""
    return F.sha2(name.cast("binary"), 256)


def write_files(rows: DataFrame, folder: str) -> None:
    """``rows(name, content)`` as one file a row, named by ``file_name``; a repeated task writes the same bytes again."""
    def write(batches):
        import uuid
        import pyarrow as pa
        for batch in batches:
            done = 0
            for name, content in zip(batch.column("file").to_pylist(), batch.column("content")):
                system, path = _filesystem(f"{folder}/{name}")
                if not done:
                    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
                own = f"{path}.{uuid.uuid4().hex}.part"  # a lost task leaves no half-written file under the name
                with system.open_output_stream(own) as f:
                    f.write(content.as_buffer())
                system.move(own, path)
                done += 1
            yield pa.RecordBatch.from_pydict({"n": pa.array([done], pa.int64())})

    named = rows.select(file_name(F.col("name")).alias("file"), F.coalesce(F.col("content").cast("binary"), F.lit(b"")).alias("content"))
    named.mapInArrow(write, "n long").agg(F.sum("n")).collect()


def tree_digest(chunks):
    """Digest of a file from the SHA-256 of its chunks, in order; a file of one chunk has the plain SHA-256."""
    return F.when(F.size(chunks) == 1, F.element_at(chunks, 1)).otherwise(F.sha2(F.array_join(chunks, "").cast("binary"), 256))


def bytes_digest(content, chunk_bytes: int = CHUNK_BYTES):
    """The digest a file with this content has (a column that fits in a row)."""
    octets = content.cast("binary")
    last = F.greatest(F.lit(0), F.ceil(F.octet_length(octets) / chunk_bytes).cast("int") - 1)
    chunk = lambda i: F.sha2(F.substring(octets, i * F.lit(chunk_bytes) + F.lit(1), F.lit(chunk_bytes)), 256)
    return tree_digest(F.transform(F.sequence(F.lit(0), last), chunk))


def hash_files(spark: SparkSession, folder: str) -> DataFrame:
    """``(name, sha)`` of every file below a folder: plain SHA-256 of files that fit in a row (2 GB)."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
            .select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha")))


def hash_files_in_chunks(spark: SparkSession, folder: str, chunk_bytes: int = CHUNK_BYTES, block: int = 4 << 20) -> DataFrame:
    """``(name, sha)`` of every file below a folder, of any size, on a file system that pyarrow knows.

    Spark only lists the files; every range of ``chunk_bytes`` is read by itself, ``block`` bytes at a time, so many tasks
    read a long file and none holds it whole. A file's digest is ``tree_digest``. Spark's listing leaves out empty files;
    ``empty_files`` finds those by name.
    """
    def digest(batches):
        import pyarrow as pa
        for batch in batches:
            out = []
            for path, start, size in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "size"))):
                system, inner = _filesystem(path)
                h = hashlib.sha256()
                with system.open_input_file(inner) as f:
                    f.seek(start)
                    while size > 0:
                        part = f.read(min(block, size))
                        if not part:
                            raise OSError(f"{path} is shorter than it was when it was listed")
                        h.update(part)
                        size -= len(part)
                out.append(h.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("start"), pa.array(out, pa.string())], names=["path", "start", "sha"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    last = F.greatest(F.lit(0), F.ceil(F.col("length") / chunk_bytes).cast("long") - 1)
    ranges = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("_i")).select(
        "path", (F.col("_i") * chunk_bytes).alias("start"), F.least(F.lit(chunk_bytes), F.col("length") - F.col("_i") * chunk_bytes).alias("size"))
    chunks = ranges.repartition("path", "start").mapInArrow(digest, "path string, start long, sha string")
    whole = chunks.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("start", "sha"))).alias("c"))
    return whole.select(F.element_at(F.split("path", "/"), -1).alias("name"), tree_digest(F.col("c.sha")).alias("sha"))


def empty_files(names: DataFrame, folder: str) -> DataFrame:
    """``(name, sha)`` of those ``names`` that are empty files in the folder."""
    def probe(batches):
        import pyarrow as pa
        for batch in batches:
            asked = [n for n in batch.column("name").to_pylist() if n is not None]
            paths = [_filesystem(f"{folder}/{n}") for n in asked]
            infos = paths[0][0].get_file_info([p for _, p in paths]) if paths else []
            found = [n for n, info in zip(asked, infos) if info.is_file and info.size == 0]
            yield pa.RecordBatch.from_pydict({"name": pa.array(found, pa.string()), "sha": pa.array([hashlib.sha256(b"").hexdigest()] * len(found), pa.string())})

    return names.select("name").mapInArrow(probe, "name string, sha string")


def compare_hashes(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Status per manifest row ``(name, sha256)``: OK, MISSING or BAD."""
    return manifest.join(files, "name", "left").select(
        "name", F.when(F.col("sha").isNull(), "MISSING").when(F.col("sha") != F.col("sha256"), "BAD")
        .otherwise("OK").alias("status"))


def audit(spark: SparkSession, folder: str, manifest: DataFrame, chunk_bytes: int | None = None) -> DataFrame:
    """Files of a folder against a manifest of plain digests, or of tree digests over chunks of ``chunk_bytes``."""
    if not chunk_bytes:
        return compare_hashes(hash_files(spark, folder), manifest)
    files = hash_files_in_chunks(spark, folder, chunk_bytes)
    listed = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
              .select(F.element_at(F.split("path", "/"), -1).alias("name")))
    unseen = manifest.select("name").distinct().join(listed, "name", "left_anti")
    return compare_hashes(files.unionByName(empty_files(unseen, folder)), manifest)
