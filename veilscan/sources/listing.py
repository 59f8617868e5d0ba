"""Listing and reading of file trees in tasks, on local paths and on every store that pyarrow opens.

Directories are found in rounds, a Spark job per level of the tree; excluded directories are never entered, and only directory names reach
the driver. Files are listed by the tasks that get their directories, names that Spark's own listing leaves out included, and read one by one,
so that a file that fails is a row with an error and not the end of the job.
"""

from __future__ import annotations

import os
import re
import stat
import sys
from collections.abc import Callable, Iterator
from functools import partial

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

# Workers get this module's code with the task and need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LISTED = "path string, size long, error string"
DIRECTORIES_PER_TASK = 64


def local_path(root: str) -> str | None:
    """The path of a local root in any spelling; None for other stores."""
    if "://" not in root and not root.startswith("file:"):
        return os.path.abspath(os.path.expanduser(root))
    return re.sub("^file:/+", "/", root) if root.startswith("file:") else None


def opens(root: str) -> bool:
    """Whether tasks can open the root: a local path that is there, or a store that pyarrow knows."""
    path = local_path(root)
    if path is not None:
        return os.path.exists(path)
    from pyarrow import ArrowException
    from pyarrow.fs import FileSystem, FileType

    try:
        store, inside = FileSystem.from_uri(root)
        return store.get_file_info(inside).type != FileType.NotFound
    except (ArrowException, OSError, ValueError, ImportError):
        return False


def _store(root: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(root)


def children(root: str, folder: str) -> tuple[list[str], list[tuple[str, int | None, str | None]]]:
    """Directories in a folder, and its files as (path, size, error). A folder that can't be listed has none. Links to directories are neither entered nor files; a link to nothing is a file with an error."""
    below: list[str] = []
    files: list[tuple[str, int | None, str | None]] = []
    if local_path(root) is None:
        from pyarrow.fs import FileSelector, FileType

        try:
            entries = _store(root)[0].get_file_info(FileSelector(folder))
        except OSError:
            return below, files
        for entry in entries:
            if entry.type == FileType.Directory:
                below.append(entry.path)
            else:
                files.append((entry.path, entry.size, None))
        return below, files
    try:
        entries = sorted(os.scandir(folder), key=lambda e: e.name)
    except OSError:
        return below, files
    for entry in entries:
        if entry.is_dir(follow_symlinks=False):
            below.append(entry.path)
        elif not entry.is_dir():
            files.append(file_row(entry.path))
    return below, files


def file_row(path: str) -> tuple[str, int | None, str | None]:
    """(path, size, error) of a local file; what isn't a regular file, such as a pipe, has an error and is never opened."""
    try:
        info = os.stat(path)
    except OSError as exc:
        return path, None, str(exc)
    return (path, info.st_size, None) if stat.S_ISREG(info.st_mode) else (path, None, f"Not a regular file: '{path}'")


def _subdirectories(frames: Iterator[pd.DataFrame], root: str, pruned: frozenset[str]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        found = [d for folder in frame["path"] for d in children(root, folder)[0] if d.rstrip("/").rsplit("/", 1)[-1] not in pruned]
        yield pd.DataFrame({"path": found}, dtype=object)


def _files(frames: Iterator[pd.DataFrame], root: str, flat: bool) -> Iterator[pd.DataFrame]:
    for frame in frames:
        found = [f for folder in frame["path"] for f in children(root, folder)[1]]
        found = [f for f in found if f[2] is None] if flat else found
        paths, sizes, errors = zip(*found, strict=True) if found else ((), (), ())
        yield pd.DataFrame({"path": pd.Series(paths, dtype=object), "size": pd.Series(sizes, dtype="Int64"), "error": pd.Series(errors, dtype=object)})


def directories(spark: SparkSession, root: str, start: str, pruned: tuple[str, ...]) -> list[str]:
    """The directory and all below it but the pruned ones, which aren't looked into."""
    every, level = [start], [start]
    while level:
        tasks = max(1, -(-len(level) // DIRECTORIES_PER_TASK))
        frame = spark.createDataFrame([(d,) for d in level], "path string").repartition(tasks)
        level = [r["path"] for r in frame.mapInPandas(partial(_subdirectories, root=root, pruned=frozenset(pruned)), "path string").collect()]
        every += level
    return every


def listed_files(spark: SparkSession, root: str, recursive: bool, pruned: tuple[str, ...]) -> DataFrame:
    """(path, size, error) of the files at a root that `opens`: of a directory's own files, and with `recursive` of those below it. Lazy but for the names of directories."""
    local = local_path(root)
    start = local if local is not None else _store(root)[1]
    if local is not None and not os.path.isdir(local):
        return spark.createDataFrame([file_row(local)], LISTED)
    if local is None:
        from pyarrow.fs import FileType

        info = _store(root)[0].get_file_info(start)
        if info.type != FileType.Directory:
            return spark.createDataFrame([(start, info.size, None)], LISTED)
    folders = directories(spark, root, start, pruned) if recursive else [start]
    frame = spark.createDataFrame([(d,) for d in folders], "path string").repartition(max(1, -(-len(folders) // DIRECTORIES_PER_TASK)))
    return frame.mapInPandas(partial(_files, root=root, flat=not recursive), LISTED)


READ = "path string, size long, content binary, extracted string, error string"


def _contents(frames: Iterator[pd.DataFrame], root: str, limit: int, extract: Callable[[str, bytes], str | None]) -> Iterator[pd.DataFrame]:
    store = None if local_path(root) is not None else _store(root)[0]
    for frame in frames:
        for path, size, error in zip(frame["path"], frame["size"], frame["error"], strict=True):
            content = extracted = None
            if not isinstance(error, str):
                error = None
                if size <= limit:
                    try:
                        with open(path, "rb") if store is None else store.open_input_stream(path) as handle:
                            content = handle.read()
                        extracted = extract(path, content)
                    except OSError as exc:
                        error = str(exc)
                    except Exception as exc:  # noqa: BLE001 - a broken document is a failed source, not a failed scan
                        error = f"{type(exc).__name__}: {exc}"
            row = {"path": [path], "size": pd.Series([None if pd.isna(size) else size], dtype="Int64"), "content": [content], "extracted": [extracted], "error": [error]}
            yield pd.DataFrame(row)


def contents(files: DataFrame, root: str, limit: int, extract: Callable[[str, bytes], str | None]) -> DataFrame:
    """(path, size, error) rows -> path, size, content, extracted, error. `extract` gives the text of files that need more than decoding; what it raises is the file's error. Files over the limit stay
    closed and have no content. Slim rows are dealt anew first, so that a full directory is no single task; into a stated number of tasks, since by their own size they would be put into one."""
    spark = files.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return files.repartition(tasks, "path").mapInPandas(partial(_contents, root=root, limit=limit, extract=extract), READ)
