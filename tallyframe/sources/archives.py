"""Zip archives as tables: one row a member, whole archives taken or refused."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions.paths import unsafe_reason
from tallyframe.storage import materialize

#: Members are passed on in batches of about so many bytes; a larger declared size than MOST is not inflated (a cell of a
#: table ends at 2 GiB).
BATCH, MOST = 8 << 20, 1 << 30


def _inflated(raw: bytes) -> Iterator[tuple[str | None, bytes | None, str | None]]:
    """(member, content, fault) of each file in an archive; one row without a member if it cannot be opened."""
    try:
        z = zipfile.ZipFile(io.BytesIO(raw))
    except (zipfile.BadZipFile, ValueError, OSError, NotImplementedError):
        yield None, None, "not_an_archive"
        return
    with z:
        for info in z.infolist():
            name = info.orig_filename
            if name.endswith("/"):
                continue
            if info.file_size > MOST:
                yield name, None, "too_large"
                continue
            try:
                yield name, z.read(info), None
            except (zipfile.BadZipFile, zlib.error, EOFError, RuntimeError, NotImplementedError, OSError, ValueError):
                yield name, None, "broken"


def members(archives: DataFrame, name: str, content: str) -> DataFrame:
    """archive, member, content, reason of each file in zip archives given as binary cells.

    reason: why the archive must not be taken because of this member: a path that could leave its folder, a member that
    does not inflate to its checksum, names that differ in case only or are repeated; null if there is nothing against
    it. An archive that cannot be opened (null, empty or other bytes) is one row without a member; one without files has
    no rows. A task holds one archive and some eight megabytes of what it inflates to, or one larger member.
    """
    kind = dict(archives.dtypes)[name]
    like = archives.select(F.col(name).alias("archive"), F.col(content).alias("content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows, size = [], 0
                for row in _inflated(batch.column(1)[i].as_py() or b""):
                    rows.append(row)
                    size += len(row[1] or b"")
                    if size >= BATCH:
                        yield out(batch.column(0), i, rows)
                        rows, size = [], 0
                if rows:
                    yield out(batch.column(0), i, rows)

    def out(archive: pa.Array, i: int, rows: list) -> pa.RecordBatch:
        member, cell, fault = (list(c) for c in zip(*rows, strict=True))
        whose = archive.take(pa.array([i] * len(rows)))
        return pa.RecordBatch.from_arrays([whose, pa.array(member, pa.string()), pa.array(cell, pa.binary()), pa.array(fault, pa.string())], ["archive", "member", "content", "fault"])

    found = like.mapInArrow(run, f"archive {kind}, member string, content binary, fault string")
    found = materialize(found, "members")
    twice = found.groupBy("archive", F.lower("member").alias("_lower")).count().where("count > 1 AND _lower IS NOT NULL").select(F.col("archive").alias("_archive"), "_lower")
    judged = found.join(twice, F.col("archive").eqNullSafe(F.col("_archive")) & (F.lower("member") == F.col("_lower")), "left")  # of names alone, and few
    reason = F.coalesce(F.col("fault"), unsafe_reason(F.col("member")), F.when(F.col("_lower").isNotNull(), "repeated"))
    return judged.select("archive", "member", "content", reason.alias("reason"))


def taken_and_refused(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(archive, member, content of the archives without any fault; archive, reason of the others), an archive being
    taken whole or not at all. reason is the first of its members' in order of name."""
    refused = found.where(F.col("reason").isNotNull()).groupBy("archive").agg(F.min("reason").alias("reason"))
    out = refused.select(F.col("archive").alias("_archive"))
    return found.join(out, F.col("archive").eqNullSafe(F.col("_archive")), "left_anti").select("archive", "member", "content"), refused


def ingest_archives(spark: SparkSession, path: str, target: str) -> DataFrame:
    """Writes the members of all sound archives under a path as a Parquet table, once: an existing target is an error.
    Gives archive, reason of the refused ones. Archives are read and inflated by the tasks, in parallel."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.zip").load(path)
    taken, refused = taken_and_refused(members(files, "path", "content"))
    taken.write.mode("error").parquet(target)
    return refused
