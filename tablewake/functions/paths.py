"""Predicates over source paths and names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# File names and folders that mark source, test and vendored files.
SOURCE_SUFFIXES = (".py", ".sql")
TEST_SUFFIXES = ("_test.py", "_test.sql")
TEST_FILENAMES = ("conftest.py",)
TEST_PREFIX = "test_"
TEST_DIRECTORIES = ("test", "tests")
VENDOR_DIRECTORIES = ("site-packages",)
VENDOR_ROOTS = ("bin", "lib", "lib64", "venv", "python")
METADATA_SUFFIXES = (".dist-info", ".egg-info")
RECORD_SUFFIX = ".dist-info/RECORD"
CACHE_DIRECTORY = "__pycache__"

# Name parts of the helper functions that deployment tooling adds to stacks.
DEFAULT_IGNORED_JOBS = "|".join(
    [
        "AWS679f53fac002430cb0da5",
        "BucketNotificationsHandler",
        "CustomCDKBucketDeploymen",
        "CustomDeleteExistingReco",
        "CustomS3AutoDeleteObjects",
        "CustomVpcRestrictDefaultSG",
        "LogRetention",
        "comamazonawscdkcustomres",
    ]
)


def ends_with_any(text: Column, suffixes: tuple[str, ...]) -> Column:
    return reduce(Column.__or__, [text.endswith(suffix) for suffix in suffixes])


def is_source_path(path: Column) -> Column:
    return ends_with_any(path, SOURCE_SUFFIXES)


def is_directory_entry(path: Column) -> Column:
    return path.endswith("/")


def is_authored_path(path: Column) -> Column:
    """True for files a developer wrote: no caches, hidden files, packages or tests."""
    parts = F.split(path, "/")
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    filename = F.element_at(parts, -1)
    hidden = F.exists(parts, lambda p: p.startswith(".") | (p == CACHE_DIRECTORY))
    packaged = F.exists(
        folders,
        lambda p: ends_with_any(p, METADATA_SUFFIXES)
        | p.isin(*VENDOR_DIRECTORIES)
        | p.isin(*TEST_DIRECTORIES),
    )
    vendored = (F.size(folders) > 0) & F.element_at(parts, 1).isin(*VENDOR_ROOTS)
    test_file = (
        filename.isin(*TEST_FILENAMES)
        | filename.startswith(TEST_PREFIX)
        | ends_with_any(filename, TEST_SUFFIXES)
    )
    return ~(hidden | packaged | vendored | test_file)


def is_ignored_job(name: Column, pattern: str | None = DEFAULT_IGNORED_JOBS) -> Column:
    """Regex search on the job name; an empty or missing pattern ignores nothing."""
    if not pattern:
        return F.lit(False)
    return F.coalesce(name, F.lit("")).rlike(pattern)


def is_ignored_table(database: Column, table: Column, pattern: str | None) -> Column:
    """Regex search on the bare name or, when the database is known, the qualified name."""
    if not pattern:
        return F.lit(False)
    qualified = F.concat(F.nullif(database, F.lit("")), F.lit("."), table)
    return table.rlike(pattern) | F.coalesce(qualified.rlike(pattern), F.lit(False))
