"""A directory tree as tables: listing by levels, file contents, change stamps.

Spark's own file sources hide names that start with '_' or '.', which configuration uses
freely, so directories are listed inside tasks: one job per level of the tree, every
directory of a level in parallel. Skipped directories are never entered, and one that cannot
be read is left out.
"""

import os
import sys
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import StorageLevel, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Directories that are never entered.
SKIPPED_DIRS = (".git", ".terraform", "node_modules", ".idea", ".vscode")

_ENTRY = "module_dir string, name string, is_dir boolean, size long, modified double"
_ENTRY_ARROW = pa.schema([
    ("module_dir", pa.string()), ("name", pa.string()), ("is_dir", pa.bool_()),
    ("size", pa.int64()), ("modified", pa.float64()),
])


def _open(root: str):
    """(filesystem, path) of a local path or a URI."""
    return pafs.FileSystem.from_uri(root) if "://" in root else (pafs.LocalFileSystem(), os.path.abspath(root))


def _entries(fs, path, relative):
    """One directory's entries; links to directories are not followed on a local disk."""
    if isinstance(fs, pafs.LocalFileSystem):
        with os.scandir(path) as found:
            for e in found:
                try:
                    stat = e.stat()
                except OSError:
                    stat = e.stat(follow_symlinks=False)
                yield relative, e.name, e.is_dir(follow_symlinks=False), stat.st_size, stat.st_mtime
    else:
        for info in fs.get_file_info(pafs.FileSelector(path)):
            modified = info.mtime.timestamp() if info.mtime else 0.0
            yield relative, info.base_name, info.type == pafs.FileType.Directory, info.size or 0, modified


def _lister(root):
    def list_dirs(batches):
        fs, base = _open(root)
        for batch in batches:
            rows = []
            for relative in batch.column("module_dir").to_pylist():
                try:
                    rows.extend(_entries(fs, f"{base}/{relative}" if relative else base, relative))
                except OSError:
                    continue
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), _ENTRY_ARROW.types)] if rows
                else [pa.array([], t) for t in _ENTRY_ARROW.types], schema=_ENTRY_ARROW)

    return list_dirs


def path_exists(root: str) -> bool:
    fs, path = _open(root)
    return fs.get_file_info(path).type != pafs.FileType.NotFound


def stat(root: str, path: str) -> tuple[int, float]:
    """(size, modification time) of one file; zeros when it is missing."""
    fs, base = _open(root)
    info = fs.get_file_info(path if path.startswith("/") else f"{base}/{path}")
    return info.size or 0, info.mtime.timestamp() if info.mtime else 0.0


def _child(module_dir="module_dir", name="name"):
    return F.concat_ws("/", F.nullif(F.col(module_dir), F.lit("")), F.col(name))


@contextmanager
def listing(spark: SparkSession, root: str):
    """(module_dir, name, file, size, modified) of every file below root, skipped trees cut off.

    The frontier of a level is spread over the cluster before it is listed, so one directory
    with most of the tree below it only shares its task with others for one level. The levels
    are kept while the context is open.
    """
    level = spark.createDataFrame([("",)], "module_dir string")
    levels = []
    try:
        while True:
            found = level.mapInArrow(_lister(root), _ENTRY).persist(StorageLevel.MEMORY_AND_DISK)
            levels.append(found)
            below = found.filter(F.col("is_dir") & ~F.col("name").isin(*SKIPPED_DIRS))
            n = below.count()
            if n == 0:
                break
            tasks = min(n, spark.sparkContext.defaultParallelism * 4)
            level = below.select(_child().alias("module_dir")).repartition(tasks, "module_dir")
        files = levels[0]
        for more in levels[1:]:
            files = files.unionByName(more)
        yield files.filter("NOT is_dir").select(
            "module_dir", "name", _child().alias("file"), "size", "modified")
    finally:
        for found in levels:
            found.unpersist()


def configuration(files: DataFrame) -> DataFrame:
    return files.filter(F.col("name").endswith(".tf"))


def variable_dirs(files: DataFrame) -> DataFrame:
    """(module_dir) of directories that hold .tfvars files."""
    name = F.col("name")
    return files.filter(name.endswith(".tfvars") | name.endswith(".tfvars.json")).select("module_dir").distinct()


def read_text(files: DataFrame, root: str, path: str = "file") -> DataFrame:
    """files plus `content` and `error`, read inside tasks; relative paths start at root.

    A file that cannot be read has an error and no content.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StringType, StructField, StructType

    out = StructType(files.schema.fields + [StructField("content", StringType()), StructField("error", StringType())])
    schema = to_arrow_schema(out)

    def read(batches):
        fs, base = _open(root)
        for batch in batches:
            for row in batch.to_pylist():
                where = row[path] if row[path].startswith("/") else f"{base}/{row[path]}"
                try:
                    with fs.open_input_stream(where) as stream:
                        text, error = stream.read().decode("utf-8", "replace"), None
                except Exception as e:  # Arrow has errors of its own; each is this file's
                    text, error = None, f"{row[path]}: {getattr(e, 'strerror', None) or e}"
                yield pa.RecordBatch.from_pylist([{**row, "content": text, "error": error}], schema=schema)

    # Files are read where their paths hash to, not where a listing task left them.
    spread = files.repartition(path)
    return spread.mapInArrow(read, out)
