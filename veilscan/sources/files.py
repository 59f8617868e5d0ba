"""The file source: listing, filters, decoding and DOCX text.

Files are filtered by name before they are opened. Trees that tasks can open are listed and read by ``listing``;
others by Spark's own file reader.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import masked, suffix
from ..functions.regexes import any_case_extension_glob, glob_regex
from ..schemas import ERROR, SKIP, SOURCE
from .docx import document_text, extracted
from .listing import contents, listed_files, opens
from .records import RECORD_COLUMNS, status_row, status_row_if_empty, union_all

PLUGIN = "filesystem"
# Extensions read as text, extensions with an extractor, and the default scan settings.
TEXT_EXTENSIONS = (".txt", ".csv", ".json", ".log", ".md", ".xml", ".yaml", ".yml")
DOCX = ".docx"
PDF = ".pdf"
UNEXTRACTED = (PDF, ".png", ".jpg", ".jpeg")
DEFAULT_EXTENSIONS = (*TEXT_EXTENSIONS, PDF, DOCX, ".png", ".jpg", ".jpeg")
DEFAULT_EXCLUDE_DIRS = (".git", ".idea", ".venv", "venv", "__pycache__", "node_modules", "dist", "build")
DEFAULT_EXCLUDE_GLOBS = ("*.pyc", "*.pyo", "*.DS_Store")


@dataclass(frozen=True)
class Location:
    """One configured place to scan."""

    name: str = "local_filesystem"
    input_paths: tuple[str, ...] = (".",)
    provider: str = "local"
    enabled: bool = True
    recursive: bool = True
    include_extensions: tuple[str, ...] = DEFAULT_EXTENSIONS
    exclude_dirs: tuple[str, ...] = DEFAULT_EXCLUDE_DIRS
    exclude_file_globs: tuple[str, ...] = DEFAULT_EXCLUDE_GLOBS
    max_file_size_mb: float = 20
    read_binary_files_as_text: bool = False


@dataclass(frozen=True)
class FileOutput:
    """What the records show of each file."""

    include_file_hash: bool = True
    mask_mode: str = "full"
    base_dirs: tuple[str, ...] = ()
    hash_salt: str = ""
    report_path: str | None = None


def extension_allowed(path: str, extensions: tuple[str, ...]) -> Column:
    """Lower-cased suffix in the list; an empty list allows all."""
    if not extensions:
        return F.lit(True)
    return F.expr(f"lower({suffix(path)})").isin([e.lower() for e in extensions])


def glob_excluded(path: str, globs: tuple[str, ...]) -> Column:
    """The base name or the whole path matches one of the globs."""
    name = F.expr(f"regexp_extract({path}, '([^/]*)$', 1)")
    hit = F.lit(False)
    for glob in globs:
        regex = glob_regex(glob)
        hit = hit | name.rlike(regex) | F.expr(path).rlike(regex)
    return hit


def dir_pruned(path: str, root: str, directories: tuple[str, ...]) -> Column:
    """A directory strictly below ``root`` on the way to the file has one of the names."""
    if not directories:
        return F.lit(False)
    below = F.expr(f"substring({path}, {len(root.rstrip('/')) + 2})")
    parents = F.split(F.regexp_replace(below, "[^/]*$", ""), "/")
    return F.arrays_overlap(parents, F.array(*[F.lit(d) for d in directories]))


def decoded(content: str, newlines: bool = True) -> str:
    """UTF-8 text with invalid bytes dropped, optionally with CRLF and CR as LF."""
    raw = f"cast({content} AS string)"
    # Valid input keeps any replacement character of its own.
    text = f"CASE WHEN is_valid_utf8({raw}) THEN {raw} ELSE replace(make_valid_utf8({raw}), '�', '') END"
    return f"regexp_replace({text}, '\\\\r\\\\n?', '\\n')" if newlines else text


def _listed(spark: SparkSession, location: Location, index: int, output: FileOutput) -> list[DataFrame]:
    """Candidate files per input path, not yet opened: path, size, extension and the size verdict."""
    frames = []
    for position, raw in enumerate(location.input_paths):
        root = re.sub("^file:/+", "/", raw)
        root = os.path.abspath(os.path.expanduser(root)) if "://" not in root else root
        def wanted(files: DataFrame, path: str, root: str = root) -> DataFrame:
            files = files.filter(extension_allowed(path, location.include_extensions))
            files = files.filter(~glob_excluded(path, location.exclude_file_globs))
            if output.report_path:
                own = os.path.abspath(output.report_path)
                files = files.filter((F.expr(path) != own) & ~F.expr(path).startswith(own.rstrip("/") + "/"))
            return files

        if opens(raw):
            found = wanted(listed_files(spark, raw, location.recursive, location.exclude_dirs), "path")
            part = contents(found, raw, int(location.max_file_size_mb * 1024 * 1024), document_text)
        elif (part := _by_spark(spark, root, location, wanted)) is None:
            continue
        frames.append(
            part.select(
                # a digest, so that no report says more of the path than its mask lets it
                F.concat(F.lit(f"{index}.{position}:"), F.sha2(F.concat(F.lit(f"{output.hash_salt}|"), "path"), 256)).alias("source_id"),
                "path",
                "size",
                "content",
                "extracted",
                "error",
                F.lit(location.name).alias("location"),
                F.lit(location.provider).alias("provider"),
            )
        )
    return frames


def _by_spark(spark: SparkSession, root: str, location: Location, wanted: Callable[[DataFrame, str], DataFrame]) -> DataFrame | None:
    """Files of a root that only Spark's own readers open, or None where there is nothing. Names that begin with `.` or `_` aren't listed here, pruned directories are listed and then left out, and a file that fails fails its job."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if location.include_extensions:
        reader = reader.option("pathGlobFilter", any_case_extension_glob(list(location.include_extensions)))
    path = "regexp_replace(url_decode(replace(_metadata.file_path, '+', '%2B')), '^file:/+', '/')"
    try:
        loaded = wanted(reader.load(root), path)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    if location.recursive:
        loaded = loaded.filter(~dir_pruned(path, root, location.exclude_dirs))
    else:
        top = F.lit(root.rstrip("/"))
        loaded = loaded.filter(F.expr(path).endswith(top) | F.expr(f"regexp_replace({path}, '/[^/]*$', '')").endswith(top))
    size, nothing = F.col("_metadata.file_size"), F.lit(None).cast("string")
    limit = int(location.max_file_size_mb * 1024 * 1024)
    document = F.expr(f"lower({suffix(path)})") == DOCX
    large = loaded.filter(size > limit).select(F.expr(path).alias("path"), size.alias("size"), F.lit(None).cast("binary").alias("content"), nothing.alias("extracted"), nothing.alias("error"))
    plain = loaded.filter((size <= limit) & ~document).select(F.expr(path).alias("path"), size.alias("size"), "content", nothing.alias("extracted"), nothing.alias("error"))
    documents = loaded.filter((size <= limit) & document).select(F.expr(path).alias("path"), size.alias("size"), "content", F.col("content").alias("_content"))
    read = extracted(documents.withColumnsRenamed({"content": "_kept", "_content": "content"}), "path string, size long, _kept binary, text string, error string")
    return union_all([plain, large, read.selectExpr("path", "size", "_kept AS content", "text AS extracted", "error")])


def _file_records(files: DataFrame, location: Location, output: FileOutput) -> DataFrame:
    """Skip rows for files over the size limit, source rows with text for the others, error rows for broken ones; one pass, each file opened once."""
    limit = int(location.max_file_size_mb * 1024 * 1024)
    kind = f"lower({suffix('path')})"
    other = f"CASE WHEN true THEN {decoded('content', newlines=False)} END" if location.read_binary_files_as_text else "''"
    texts = ", ".join(f"'{e}'" for e in TEXT_EXTENSIONS)
    never = ", ".join(f"'{e}'" for e in UNEXTRACTED)
    text = f"CASE WHEN {kind} = '{DOCX}' THEN extracted WHEN {kind} IN ({texts}) THEN {decoded('content')} WHEN {kind} IN ({never}) THEN '' ELSE {other} END"
    failed, large = F.col("error").isNotNull(), F.col("size") > limit
    # No PDF text can be had here, so such files are shown as skipped, not as scanned without findings.
    pdf = F.expr(kind) == PDF
    records = files.select(
        *_provenance(output),
        F.when(failed, ERROR).when(large | pdf, SKIP).otherwise(SOURCE).alias("record_type"),
        F.when(~failed & ~large, F.expr(text)).alias("text"),
        _hash(output).alias("content_hash"),
        F.when(failed, F.col("error"))
        .when(large, F.lit(f"File larger than max_file_size_mb ({location.max_file_size_mb})"))
        .when(pdf, F.lit("PDF text extraction is not available"))
        .alias("reason"),
    )
    return records.select(*RECORD_COLUMNS)


def _hash(output: FileOutput) -> Column:
    return F.sha2("content", 256) if output.include_file_hash else F.lit(None).cast("string")


def _provenance(output: FileOutput) -> list[Column]:
    metadata = F.struct(
        F.expr(f"lower({suffix('path')})").alias("extension"), "provider", "location", F.col("size").alias("file_size_bytes")
    )
    return [
        F.col("source_id"),
        F.lit(PLUGIN).alias("plugin_name"),
        F.lit("filesystem").alias("source_type"),
        F.expr(masked("path", output.mask_mode, list(output.base_dirs), output.hash_salt)).alias("source_path"),
        metadata.alias("metadata"),
    ]


def read_files(spark: SparkSession, locations: list[Location], output: FileOutput = FileOutput()) -> DataFrame:
    """All records of the enabled locations, with skip rows for what could not be scanned."""
    enabled = [loc for loc in locations if loc.enabled]
    if not enabled:
        reason = "No enabled filesystem locations configured."
        return status_row(spark, SKIP, PLUGIN, PLUGIN, "filesystem://", reason)
    listed, refused = [], []
    for index, location in enumerate(enabled):
        if location.provider.strip().lower() == "local":
            listed.extend((files, location) for files in _listed(spark, location, index, output))
        else:
            reason = f"Unsupported filesystem provider '{location.provider}'. Only provider=local is currently supported."
            refused.append(status_row(spark, SKIP, PLUGIN, PLUGIN, f"filesystem://{location.name}", reason))
    parts = [_file_records(files, location, output) for files, location in listed]
    if refused:
        return union_all([*refused, *parts])
    reason = "Filesystem locations are enabled but no files matched configured filters."
    if not parts:
        return status_row(spark, SKIP, PLUGIN, PLUGIN, "filesystem://", reason)
    # The emptiness test looks at the listing only, never at file contents.
    paths = union_all(files.select("source_id") for files, _ in listed)
    return union_all([*parts, status_row_if_empty(paths, SKIP, PLUGIN, PLUGIN, "filesystem://", reason)])
