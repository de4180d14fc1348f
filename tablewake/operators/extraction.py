"""From source files to edges: cache keys, prompts, validation and the extractor itself."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXTRACTION = """struct<
    table_edges:array<struct<database:string,table:string,direction:string,is_dynamic:boolean,evidence:string>>,
    join_edges:array<struct<left_database:string,left_table:string,left_column:string,
        right_database:string,right_table:string,right_column:string,evidence:string>>>"""

# Texts that count as booleans besides true and false themselves.
TRUE_TEXTS = ("true", "t", "yes", "y", "on", "1")
FALSE_TEXTS = ("false", "f", "no", "n", "off", "0")

# Required members of the two edge kinds; text unless listed elsewhere.
TABLE_EDGE_TEXTS = ("table", "evidence")
JOIN_EDGE_TEXTS = ("left_table", "left_column", "right_table", "right_column", "evidence")

NUL = "\u0000"


def prompt_version(instructions: str, schema: str = EXTRACTION) -> str:
    """The version of a prompt: another instruction or another output schema makes jobs stale."""
    return hashlib.sha256(f"{instructions}{NUL}{schema}".encode()).hexdigest()[:16]


def cache_key(files: DataFrame, prompt_version: str, model: str) -> DataFrame:
    """(job_id, cache_key): SHA-256 over version, model and each file's path and content hash.

    Contents are hashed where they are read; only (path, hash) pairs are shuffled. The rule is the same for any number
    of files: a file falls into one of 256 buckets by the first byte of its path's hash, a bucket's digest is the hash
    of its files in path order, and the key is the hash of head, bucket names and digests in order of buckets. So the
    files of a large job meet in many tasks, and 256 digests in one.
    """
    hashed = files.select(
        "job_id", F.substring(F.sha2("path", 256), 1, 2).alias("bucket"),
        F.struct("path", F.sha2("contents", 256).alias("hash")).alias("file"),
    )
    line = F.transform("files", lambda f: F.concat(f["path"], F.lit(NUL), f["hash"], F.lit(NUL)))
    buckets = (
        hashed.groupBy("job_id", "bucket")
        .agg(F.array_sort(F.collect_list("file")).alias("files"))
        .select("job_id", F.concat("bucket", F.sha2(F.array_join(line, ""), 256)).alias("digest"))
    )
    merged = buckets.groupBy("job_id").agg(F.array_sort(F.collect_list("digest")).alias("digests"))
    head = F.lit(f"{prompt_version}{NUL}{model}{NUL}")
    return merged.select("job_id", F.sha2(F.concat(head, F.array_join("digests", "")), 256).alias("cache_key"))


def stale_jobs(fresh: DataFrame, cached: DataFrame) -> DataFrame:
    """Jobs whose fresh cache key is new or differs from the stored one, each once."""
    stored = cached.select("job_id", F.col("cache_key").alias("stored_key"))
    same = (fresh["job_id"] == stored["job_id"]) & fresh["cache_key"].eqNullSafe(stored["stored_key"])
    return fresh.join(stored, same, "left_anti").select("job_id", "cache_key").distinct()


# Characters of a file in one page of a prompt.
PAGE_CHARS = 1 << 20

#: The kinds of a prompt's pages, in order.
HEADER, FILE, RETRY = 0, 1, 2


def render_prompt(jobs: DataFrame, files: DataFrame, page_chars: int = PAGE_CHARS) -> DataFrame:
    """Prompts in pages: (job_id, name, kind, path, piece, content).

    A job's pages in the order of (kind, path, piece) joined together are its prompt: a header (kind 0, path ''), then its files in
    path order (kind 1), each a page, or several for a file longer than ``page_chars``. Jobs without files have no pages.
    No row holds more than a page, and nothing is grouped: a job may have any number of files.
    """
    header = F.concat(
        F.lit("job name: "), "name", F.lit("\njob type: "), "type", F.lit("\nruntime: "),
        F.coalesce(F.nullif("runtime", F.lit("")), F.lit("unknown")),
    )
    known = jobs.select(F.col("id").alias("job_id"), "name", header.alias("header"))
    heads = known.join(files.select("job_id"), "job_id", "left_semi").select(
        "job_id", "name", F.lit(HEADER).alias("kind"), F.lit("").alias("path"), F.lit(0).alias("piece"), F.col("header").alias("content")
    )
    last = F.greatest(F.lit(0), F.ceil(F.length("contents") / page_chars).cast("int") - 1)
    pieces = files.select("job_id", "path", "contents", last.alias("last"), F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    before = F.when(F.col("piece") == 0, F.concat(F.lit("\n\n<file path="), "path", F.lit(">\n"))).otherwise("")
    after = F.when(F.col("piece") == F.col("last"), "\n</file>").otherwise("")
    part = F.substring("contents", F.col("piece") * page_chars + 1, F.lit(page_chars))
    bodies = pieces.join(known.drop("header"), "job_id").select(
        "job_id", "name", F.lit(FILE).alias("kind"), "path", "piece", F.concat(before, part, after).alias("content")
    )
    return heads.unionByName(bodies)


def _text(value: Column, field: str) -> Column:
    """Member is present and a string."""
    return F.coalesce(F.schema_of_variant(F.try_variant_get(value, f"$.{field}", "variant")) == "STRING", F.lit(False))


def _optional_text(value: Column, field: str) -> Column:
    """Member is present, as a string or as null."""
    kind = F.schema_of_variant(F.try_variant_get(value, f"$.{field}", "variant"))
    return F.coalesce(kind.isin("STRING", "VOID"), F.lit(False))


def _boolean(value: Column, field: str) -> Column:
    member = F.try_variant_get(value, f"$.{field}", "variant")
    text = F.lower(member.try_cast("string"))
    kind = F.schema_of_variant(member)
    return F.coalesce(
        (kind == "BOOLEAN")
        | ((kind == "STRING") & text.isin(*TRUE_TEXTS, *FALSE_TEXTS))
        | (kind.startswith("BIGINT") & text.isin("0", "1")),
        F.lit(False),
    )


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for condition in conditions[1:]:
        out = out & condition
    return out


# Types of complete edges without further members, as text; other edges are asked member by member. Odd names are quoted in it.
PLAIN_TABLE_EDGES = tuple(
    f"OBJECT<database: {db}, direction: STRING, evidence: STRING, is_dynamic: BOOLEAN, table: STRING>" for db in ("STRING", "VOID")
)
PLAIN_JOIN_EDGES = tuple(
    f"OBJECT<evidence: STRING, left_column: STRING, left_database: {left}, left_table: STRING, "
    f"right_column: STRING, right_database: {right}, right_table: STRING>"
    for left in ("STRING", "VOID") for right in ("STRING", "VOID")
)


def _plain(value: Column, types: tuple[str, ...]) -> Column:
    return F.coalesce(F.schema_of_variant(value).isin(*types), F.lit(False))


def is_valid_extraction(text: Column, value: Column) -> Column:
    """Whether extractor output (its text and the parsed value) matches the schema.

    That is an object whose two lists, when present, hold complete edges with a direction of
    read or write. Unknown members are allowed. An edge is asked for its type once; only if that is not the plain one, its
    members are, each by itself. The type of a whole document would have to be merged from all its members.
    """
    is_object = value.isNotNull() & text.rlike(r"^[ \t\n\r]*\{")

    def edges_ok(field: str, test: Callable[[Column], Column]) -> Column:
        member = F.try_variant_get(value, f"$.{field}", "variant")
        items = F.try_variant_get(value, f"$.{field}", "array<variant>")
        return F.coalesce(F.forall(items, test), member.isNull())  # the member is copied out only if it is no list

    def table_edge(e: Column) -> Column:
        direction = F.try_variant_get(e, "$.direction", "string").isin("read", "write")
        typed = _all(
            [_text(e, f) for f in TABLE_EDGE_TEXTS]
            + [_optional_text(e, "database"), _text(e, "direction"), _boolean(e, "is_dynamic")]
        )
        return (_plain(e, PLAIN_TABLE_EDGES) | typed) & F.coalesce(direction, F.lit(False))

    def join_edge(e: Column) -> Column:
        return _plain(e, PLAIN_JOIN_EDGES) | _all(
            [_text(e, f) for f in JOIN_EDGE_TEXTS]
            + [_optional_text(e, "left_database"), _optional_text(e, "right_database")]
        )

    return is_object & edges_ok("table_edges", table_edge) & edges_ok("join_edges", join_edge)


def validated(extractions: DataFrame) -> DataFrame:
    """Add ``valid``. The text is parsed in a step of its own, so it is parsed once."""
    parsed = extractions.withColumn("parsed", F.try_parse_json("extraction"))
    valid = F.coalesce(is_valid_extraction(F.col("extraction"), F.col("parsed")), F.lit(False))
    return parsed.withColumn("valid", valid).drop("parsed")


def table_edges(extractions: DataFrame) -> DataFrame:
    """Valid extractions (job_id, extraction) to table edges."""
    # is_dynamic is read as text, because some texts count as booleans.
    loose = EXTRACTION.replace("is_dynamic:boolean", "is_dynamic:string")
    parsed = extractions.select("job_id", F.from_json("extraction", loose)["table_edges"].alias("e"))
    return parsed.selectExpr("job_id", "inline(e)").select(
        "job_id", F.col("database").alias("database_name"), F.col("table").alias("table_name"),
        "direction", F.lower("is_dynamic").isin(*TRUE_TEXTS).alias("is_dynamic"), "evidence",
    )


def join_edges(extractions: DataFrame) -> DataFrame:
    parsed = extractions.select("job_id", F.from_json("extraction", EXTRACTION)["join_edges"].alias("e"))
    return parsed.selectExpr("job_id", "inline(e)")


def anchored(edges: DataFrame, joins: DataFrame) -> DataFrame:
    """Join edges whose two tables both occur in the same job's table edges, by name."""
    known = edges.select("job_id", "table_name").distinct()
    left = known.selectExpr("job_id", "table_name AS left_table")
    right = known.selectExpr("job_id", "table_name AS right_table")
    return joins.join(left, ["job_id", "left_table"], "left_semi").join(
        right, ["job_id", "right_table"], "left_semi"
    ).select(*joins.columns)


# An extractor maps (job name, the pages of its prompt in order) to extraction JSON; it runs inside tasks.
Extractor = Callable[[str, Iterator[str]], str]

CALLED = "job_id string, name string, extraction string"


def on_whole_prompt(extractor: Callable[[str, str], str]) -> Extractor:
    """An extractor for a function of (job name, prompt) that needs the prompt in one piece."""

    def call(name: str, pages: Iterator[str]) -> str:
        return extractor(name, "".join(pages))

    return call


def _calls(extractor: Extractor) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str, str]]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.select(["job_id", "name", "content"]).columns), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (job_id, name), pages in groupby(rows(batches), key=itemgetter(0, 1)):
            answer = extractor(name, map(itemgetter(2), pages))
            yield pa.RecordBatch.from_pydict({"job_id": [job_id], "name": [name], "extraction": pa.array([answer], pa.string())})

    return run


def extract(pages: DataFrame, extractor: Extractor, partitions: int | None = None) -> DataFrame:
    """Call the extractor once per job: (job_id, name, extraction, valid).

    Jobs are spread over ``partitions`` (the session's shuffle partitions by default) and their pages sorted there, on disk if
    need be; a call reads its pages from an iterator, so a task holds a batch of pages and not a prompt. A lost task
    repeats few calls; a task makes one call at a time, so the cores of the executors bound the calls in flight. The
    caller must write the result before using it twice, or the calls are repeated.
    """
    spread = pages.repartition("job_id") if partitions is None else pages.repartition(partitions, "job_id")
    ordered = spread.sortWithinPartitions("job_id", "kind", "path", "piece")
    return validated(ordered.select("job_id", "name", "content").mapInArrow(_calls(extractor), CALLED))


def retry_prompts(pages: DataFrame, first: DataFrame) -> DataFrame:
    """Prompts of invalid outputs, with one more page: the output and a request for valid JSON."""
    failed = first.where("NOT valid")
    asked = F.concat(
        F.lit("\n\n"), F.coalesce("extraction", F.lit("")),
        F.lit("\n\nThat response does not match the schema. Respond again with only valid JSON."),
    )
    more = failed.select(
        "job_id", "name", F.lit(RETRY).alias("kind"), F.lit("").alias("path"), F.lit(0).alias("piece"), asked.alias("content")
    )
    return pages.join(failed.select("job_id"), "job_id", "left_semi").unionByName(more)


def one_per_job(outputs: DataFrame) -> DataFrame:
    """Outputs (job_id, name, extraction, valid) with those of one job merged: a row per job.

    Equal outputs count once. A job with one output keeps its text. Several valid ones become one document with the distinct
    edges of all of them, sorted; if one of several is invalid the job is, and shows the smallest invalid text.
    """
    loose = EXTRACTION.replace("is_dynamic:boolean", "is_dynamic:string")
    read = outputs.select("job_id", "name", "extraction", "valid").distinct()
    jobs = read.groupBy("job_id", "name").agg(
        F.count(F.lit(1)).alias("n"), F.min("extraction").alias("only"), F.bool_and("valid").alias("valid"),
        F.min(F.when(~F.col("valid"), F.col("extraction"))).alias("invalid"),
        F.collect_list(F.when(F.col("valid"), F.from_json("extraction", loose))).alias("documents"),
    )
    of = lambda field: F.flatten(F.filter(F.transform("documents", lambda d: d[field]), lambda edges: edges.isNotNull()))
    plain = F.transform(of("table_edges"), lambda e: e.withField("is_dynamic", F.lower(e["is_dynamic"]).isin(*TRUE_TEXTS)))
    every = F.struct(
        F.array_sort(F.array_distinct(plain)).alias("table_edges"), F.array_sort(F.array_distinct(of("join_edges"))).alias("join_edges")
    )
    merged = F.to_json(every, {"ignoreNullFields": "false"})
    text = F.when(F.col("n") == 1, F.col("only")).when(F.col("valid"), merged).otherwise(F.col("invalid"))
    return jobs.select("job_id", "name", text.alias("extraction"), "valid")


def fixture_extractions(jobs: DataFrame, fixtures: DataFrame) -> DataFrame:
    """Canned extractions by job name, one per job: (job_id, name, extraction, valid, reason).

    A job without one is invalid; ``reason`` says why a row is.
    """
    named = jobs.select(F.col("id").alias("job_id"), "name")
    found = one_per_job(validated(named.join(fixtures.select("name", "extraction"), "name")))
    missing = missing_fixtures(jobs, fixtures).select(
        "job_id", "name", F.lit(None).cast("string").alias("extraction"), F.lit(False).alias("valid"),
        F.concat(F.lit("no fixture named "), "name").alias("reason"),
    )
    broken = F.when(~F.col("valid"), F.lit("does not match the schema")).alias("reason")
    return found.select("job_id", "name", "extraction", "valid", broken).unionByName(missing)


def missing_fixtures(jobs: DataFrame, fixtures: DataFrame) -> DataFrame:
    """Jobs without a canned extraction: (job_id, name)."""
    rows = jobs.select(F.col("id").alias("job_id"), "name")
    return rows.join(fixtures.select("name"), "name", "left_anti").select("job_id", "name")


def rehomed(rows: DataFrame, old_jobs: DataFrame, new_jobs: DataFrame) -> DataFrame:
    """Rows with the id that their job has in the new catalog; rows of vanished jobs drop out."""
    old = old_jobs.selectExpr("id AS old_id", "type", "name")
    new = new_jobs.selectExpr("id AS new_id", "type", "name")
    ids = old.join(new, ["type", "name"]).select("old_id", "new_id")
    rest = [c for c in rows.columns if c != "job_id"]
    return rows.join(ids, rows["job_id"] == ids["old_id"]).select(
        F.col("new_id").alias("job_id"), *rest
    )
