"""Source code of jobs: scripts by uri, and members of zip packages."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import job_id, s3_bucket, s3_key
from ..functions.paths import (
    RECORD_SUFFIX,
    is_authored_path,
    is_directory_entry,
    is_source_path,
)
from .inventory import script_uris
from .scratch import cut

if TYPE_CHECKING:
    import pandas as pd

# Fixed value: the only package type that holds readable code.
ZIP_PACKAGE = "Zip"

# Characters that end a line or count as white space in a RECORD file.
LINE_BREAKS = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x85\\u2028\\u2029]"
BLANK_ENDS = "^[\\s\\x1c-\\x1f\\x85\\p{Z}]+|[\\s\\x1c-\\x1f\\x85\\p{Z}]+$"


def as_text(content: Column) -> Column:
    """Bytes to text; malformed UTF-8 becomes the replacement character."""
    return F.make_valid_utf8(content.cast("string"))


def object_location(root: str, uri: Column) -> Column:
    """Where an object is landed: ``<root>/<bucket>/<key>``."""
    return F.concat_ws("/", F.lit(root.rstrip("/")), s3_bucket(uri), s3_key(uri))


def scan_objects(spark: SparkSession, root: str, names: str = "*.{py,sql}") -> DataFrame:
    """Landed objects below ``root`` whose names match: (location, content). Archives and other data are not opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", names).load(root)
    return files.select(F.regexp_replace("path", "^file:/+", "/").alias("location"), "content")


def script_files(glue_jobs: DataFrame, objects: DataFrame, root: str) -> DataFrame:
    """(job_id, path, contents) of each job's landed scripts; missing objects give no row."""
    wanted = (
        script_uris(glue_jobs)
        .where(is_source_path(F.col("uri")))
        .select(
            job_id(F.lit("glue"), F.col("name")).alias("job_id"), F.col("uri").alias("path"),
            object_location(root, F.col("uri")).alias("location"),
        )
    )
    return wanted.join(objects, "location").select(
        "job_id", "path", as_text(F.col("content")).alias("contents")
    )


def bad_uris(glue_jobs: DataFrame) -> DataFrame:
    """Script uris without a bucket or a key, which cannot be read."""
    uri = F.col("uri")
    return script_uris(glue_jobs).where(is_source_path(uri) & (s3_bucket(uri).isNull() | s3_key(uri).isNull()))


# Members handed to Spark together; one package's code is far smaller.
FLUSH_BYTES = 16 * 1024 * 1024


def unpacked(packages: DataFrame) -> DataFrame:
    """(name, path, content, reason) for zip packages (name, package_type, content).

    Python only opens the archives and hands on source and RECORD files in bounded batches. An archive that cannot be
    opened, or has no content, is one row with a ``reason``; so is each member that cannot be read. All other rows
    have none.
    """

    # Nested, so that executors need not have this package installed.
    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pandas as pd

        wanted = (".py", ".sql", RECORD_SUFFIX)
        columns = ["name", "path", "content", "reason"]
        broken = (zipfile.BadZipFile, zlib.error, EOFError, OSError, NotImplementedError, RuntimeError, ValueError)
        for batch in batches:
            rows, size = [], 0
            for name, content in zip(batch["name"], batch["content"], strict=True):
                try:
                    archive = zipfile.ZipFile(io.BytesIO(content or b""))
                except broken as error:
                    rows.append((name, None, None, f"no archive: {error}"))
                    continue
                for member in archive.namelist():
                    if not member.endswith(wanted):
                        continue
                    try:
                        rows.append((name, member, archive.read(member), None))
                        size += len(rows[-1][2])
                    except broken as error:
                        rows.append((name, member, None, f"unreadable member: {error}"))
                    if size > FLUSH_BYTES:
                        yield pd.DataFrame(rows, columns=columns)
                        rows, size = [], 0
            yield pd.DataFrame(rows, columns=columns)

    readable = packages.where(F.col("package_type") == ZIP_PACKAGE).select("name", "content")
    return readable.mapInPandas(members, "name string, path string, content binary, reason string")


def package_members(packages: DataFrame) -> DataFrame:
    """(name, path, contents) of the source and RECORD files of zip packages (name, package_type, content)."""
    members = unpacked(packages).where("reason IS NULL")
    return members.select("name", "path", as_text(F.col("content")).alias("contents"))


def package_rejects(packages: DataFrame) -> DataFrame:
    """(name, path, reason) of broken archives and of members that cannot be read."""
    return unpacked(packages).where("reason IS NOT NULL").select("name", "path", "reason")


def dependency_paths(members: DataFrame) -> DataFrame:
    """(name, path) of every member that an installed distribution's RECORD claims."""
    records = members.where(F.col("path").endswith(RECORD_SUFFIX))
    # Folder above the dist-info folder, with its slash; empty when that is the archive root.
    root = F.regexp_extract("path", r"(?s)^(.*/)[^/]*/[^/]*$", 1)
    lines = records.select(
        "name", root.alias("root"), F.explode(F.split("contents", LINE_BREAKS)).alias("line")
    )
    entry = F.regexp_replace(F.regexp_extract("line", r"(?s)^([^,]*)", 1), BLANK_ENDS, "")
    return (
        lines.select("name", "root", entry.alias("entry"))
        .where("entry <> ''")
        .select("name", F.concat("root", "entry").alias("path"))
        .distinct()
    )


def authored_members(members: DataFrame) -> DataFrame:
    """Members that developers wrote: no folders, dependencies, vendored files or tests."""
    path = F.col("path")
    own = members.where(~is_directory_entry(path) & is_source_path(path) & is_authored_path(path))
    return own.join(dependency_paths(members), ["name", "path"], "left_anti")


def package_files(packages: DataFrame) -> DataFrame:
    """(job_id, path, contents) of the authored files of function packages; archives are opened once."""
    return authored_members(cut(package_members(packages))).select(
        job_id(F.lit("lambda"), F.col("name")).alias("job_id"), "path", "contents"
    )


# Readers by source kind; each maps landed inputs to (job_id, path, contents).
FileReader = Callable[..., DataFrame]
FILE_READERS: dict[str, FileReader] = {"glue": script_files, "lambda": package_files}


def source_files(inputs: dict[str, tuple]) -> DataFrame:
    """Union of all readers, each called with its inputs: ``{kind: arguments}``."""
    parts = [FILE_READERS[kind](*arguments) for kind, arguments in inputs.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
