"""A long-lived view of one repository that rebuilds what has changed.

There is no event stream to follow: like the tool it replaces, the host polls. Two stamps are
kept apart because plans change far more often than configuration and cost far less to read.
"""

import contextlib
import os
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.counts import fingerprint
from ..plans.index import Index
from ..plans.load import load
from ..runtime import generation, sweep
from ..sources import overlay, tree


class Host:
    """Call current() before each question; it returns a coherent Index.

    A superseded Index stays readable while somebody refers to it. The tables of one that nobody
    refers to are deleted by the next call that rebuilds, or by close().
    """

    def __init__(self, spark: SparkSession, repo_root: str, plan: str = ""):
        self.spark, self.plan = spark, plan
        self.repo_root = repo_root if "://" in repo_root else os.path.abspath(repo_root)
        self.builds = self.overlay_builds = 0
        self._lock = threading.Lock()
        self._index = self._config_stamp = self._overlay_stamp = None

    def with_plan(self, spec: str) -> "Host":
        """`root=path` pairs, or a bare path with one root; '' restores discovery."""
        self.plan = spec
        return self

    def current(self) -> Index:
        """The index, rebuilding whichever half has gone stale."""
        with tree.listing(self.spark, self.repo_root) as files, self._lock:
            config_stamp = self._stamp(tree.configuration(files), size=False)
            stale = self._index is None or config_stamp != self._config_stamp
            if stale:
                try:
                    self._index = self._build(files)
                except Exception:
                    # A working snapshot is worth more than an error; the next call retries.
                    if self._index is not None:
                        return self._index
                    raise
                self._config_stamp = config_stamp
                self.builds += 1
            found = self._locate(files)
            overlay_stamp = self._stamp(found, size=True)
            if stale or overlay_stamp != self._overlay_stamp:
                facts = generation(self.spark)
                with _dropped_on_error(facts), facts.building():
                    read = self._overlay(found)
                self._index = self._index.with_overlay(read, facts)
                self._overlay_stamp = overlay_stamp
                self.overlay_builds += 1
                sweep()
            return self._index

    def close(self) -> None:
        """Let the snapshot go; the next current() builds a new one."""
        with self._lock:
            self._index = self._config_stamp = self._overlay_stamp = None
            sweep()

    def explicit_plan_error(self) -> Exception | None:
        """Why the plan specification cannot be used, for a caller to report."""
        if not self.plan or self._index is None:
            return None
        try:
            overlay.parse_explicit(self.plan, self._index.root_dirs)
        except overlay.AmbiguousStackError as e:
            return e
        return None

    def _build(self, files: DataFrame) -> Index:
        texts = tree.read_text(tree.configuration(files).select("module_dir", "file"), self.repo_root).persist()
        try:
            unread = texts.filter("error IS NOT NULL").select("file", F.lit(0).alias("ord"), "error")
            made = generation(self.spark)
            with _dropped_on_error(made), made.building():
                return Index(self.spark, load(texts.fillna("", ["content"]), unread))
        finally:
            texts.unpersist()

    @staticmethod
    def _stamp(files: DataFrame, size: bool):
        row = fingerprint(files, "modified", "size").first()
        return (row["newest"], row["n"], row["total"]) if size else (row["newest"], row["n"])

    def _locate(self, files: DataFrame) -> DataFrame:
        """(stack, path, pos, size, modified): explicit paths ahead of discovered ones."""
        if self.plan:
            try:
                pairs = overlay.parse_explicit(self.plan, self._index.root_dirs)
            except overlay.AmbiguousStackError:
                pairs = []
            # A command line names a handful of files, so their sizes are looked up here.
            rows = [(stack, path, i, *tree.stat(self.repo_root, path)) for i, (stack, path) in enumerate(pairs)]
            return self.spark.createDataFrame(rows, "stack string, path string, pos int, size long, modified double")
        listed = files.withColumn("path", F.col("file"))
        found = overlay.discover(listed, self._index.graph.roots)
        return found.join(listed.select("path", "size", "modified"), "path").withColumn("pos", F.lit(0))

    def _overlay(self, found: DataFrame):
        if found.isEmpty():
            return None
        read = tree.read_text(found.select("pos", "stack", "path"), self.repo_root, "path")
        full = F.when(F.col("path").startswith("/"), F.col("path")).otherwise(
            F.concat(F.lit(self.repo_root.rstrip("/") + "/"), "path"))
        return overlay.build(read.withColumn("source", full))


@contextlib.contextmanager
def _dropped_on_error(made: generation):
    """What a failed build has written goes with the next sweep."""
    try:
        yield
    except Exception:
        made.drop()
        raise
