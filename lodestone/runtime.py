"""Session defaults and the durable cut of long lineages."""

import contextlib
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot key even where that costs one more shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Checkpoint files go when nothing refers to them any more.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Python call sites are not recorded for every column; plans are built from many.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def session(app_name: str = "lodestone", **conf) -> SparkSession:
    """A session with adaptive execution on; settings of the cluster win."""
    builder = SparkSession.builder.appName(app_name)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder in spark.checkpoint.dir; make a temporary one in local mode only."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="lodestone-checkpoints-")
    sc.setCheckpointDir(folder)


# A side of at most this many short rows (keys and paths) is broadcast: tens of megabytes.
BROADCAST_ROWS = 50_000


def sized(df: DataFrame) -> tuple[DataFrame, int]:
    """(df, rows) of a table that `cut` made; marked for broadcast only if its counted size allows.

    Beyond the bound the plain DataFrame comes back and Spark shuffles both sides.
    """
    rows = df.count()
    return (F.broadcast(df) if rows <= BROADCAST_ROWS else df), rows


# The same for keys alone, by their measured bytes.
BROADCAST_BYTES = 32 << 20


def weighed(keys: DataFrame) -> DataFrame:
    """A kept table of short columns, marked for broadcast if its measured bytes, with some for each row, allow."""
    texts = [F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in keys.columns]
    total = keys.agg(F.sum(sum(texts, F.lit(16)).cast("long"))).first()[0] or 0
    return F.broadcast(keys) if total <= BROADCAST_BYTES else keys


def cut(df: DataFrame) -> DataFrame:
    """Compute a DataFrame once into the checkpoint folder and go on from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def keep(df: DataFrame, name: str, partition_by: str | None = None, group_bytes: int | None = None) -> DataFrame:
    """Write a table that many queries read into the checkpoint folder, and read it back.

    Unlike a checkpoint the table is columnar: a query reads only its columns, filters reach
    the files, and Spark knows the size when it chooses a join. The folder is the
    application's own, below spark.checkpoint.dir. Inside a `scope` or a `generation` the table goes with it.

    A sorted table that is looked up by key has small row groups (group_bytes), so that a pushed
    filter reads few of them; partition_by names a folder column that filters prune by.
    """
    return _keep(df, name, owner(), partition_by, group_bytes)


def _keep(df: DataFrame, name: str, within: "scope | generation | None", partition_by: str | None = None,
          group_bytes: int | None = None) -> DataFrame:
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    if within:
        within.folders.append(path)
    writer = df.write
    if group_bytes:
        # Pages have to be small as well: the writer looks at a group's size once a page.
        writer = writer.options(**{"parquet.block.size": group_bytes, "parquet.page.size": group_bytes // 8,
                                   "parquet.block.size.row.check.min": 100, "parquet.page.size.row.check.min": 100})
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._kept_at = path  # for scope.free
    return kept


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that `keep` made."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(conf).delete(at, True)


def numbered(df: DataFrame, order: list, name: str, columns: list | None = None) -> tuple[DataFrame, int]:
    """(df with `no`, rows): numbers from 0 without gaps in the global order.

    columns: what is kept of the rows, computed once they lie in order.

    A range partitioning sorts, the result is kept, and each partition's rows are counted; one
    number a partition is all that meets in one place. Rows that tie are numbered as they were kept.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = ranged.select(*columns) if columns else ranged
    ranged = keep(ranged.withColumn("_row", F.monotonically_increasing_id()), f"{name}-sorted")
    part = F.shiftright("_row", 33).cast("int")
    counted = {r["part"]: r["n"] for r in ranged.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
    before, total = [0] * (max(counted, default=0) + 1), 0
    for i in range(len(before)):
        before[i], total = total, total + counted.get(i, 0)
    row = F.col("_row").bitwiseAND(F.lit(2 ** 33 - 1))
    return ranged.withColumn("no", row + F.get(F.lit(before).cast("array<long>"), part)).drop("_row"), total


_scopes: list["scope | generation"] = []
_dropped: list["generation"] = []


class generation:
    """Kept tables of one snapshot, which outlive the block that wrote them.

    `building` makes it the owner of what is kept inside a block; `hold` counts an object among its
    holders. Once the last holder is gone the tables wait for the next `sweep`: nothing is deleted
    from inside garbage collection, which may interrupt any call.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folders, self._holders = spark, [], 0

    @contextlib.contextmanager
    def building(self):
        _scopes.append(self)
        try:
            yield self
        finally:
            _scopes.remove(self)

    def hold(self, holder) -> None:
        self._holders += 1
        weakref.finalize(holder, self._let_go).atexit = False

    def _let_go(self) -> None:
        self._holders -= 1
        if not self._holders:
            self.drop()

    def drop(self) -> None:
        _dropped.append(self)


def owner() -> "scope | generation | None":
    """What owns the tables kept at this moment."""
    return _scopes[-1] if _scopes else None


def owned_by(tables: "generation | None"):
    """A block whose kept tables belong to a generation, if there is one."""
    return tables.building() if tables else contextlib.nullcontext()


class _Nobody:
    """Owns nothing: tables kept meanwhile stay as long as the checkpoint folder."""

    def __init__(self):
        self.folders = []


@contextlib.contextmanager
def detached(tables: "generation | None"):
    """A block whose kept tables belong to a generation or to nobody, never to the scope around it."""
    holder = tables or _Nobody()
    _scopes.append(holder)
    try:
        yield
    finally:
        _scopes.remove(holder)


def sweep() -> None:
    """Delete the tables of dropped generations; those of a stopped session are left to its folder."""
    while _dropped:
        gone = _dropped.pop()
        if gone.spark.sparkContext._jsc is None:
            continue
        for path in gone.folders:
            remove(gone.spark, path)


class scope(contextlib.AbstractContextManager):
    """Kept tables that go when the block ends, and session settings that hold only inside it.

    What leaves the block is written by `result` and belongs to the block around it, if any.
    `free` deletes tables earlier, when their last reader has been written.
    """

    def __init__(self, spark: SparkSession, batch: int | None = None, conf: dict[str, str] | None = None):
        """batch: at most so many rows go to a Python worker at once; whole documents are large rows."""
        self.spark, self.folders = spark, []
        self.conf = dict(conf or {})
        if batch:
            name = "spark.sql.execution.arrow.maxRecordsPerBatch"
            self.conf[name] = str(min(batch, int(spark.conf.get(name)) or batch))

    def __enter__(self):
        self.before = {k: self.spark.conf.get(k, None) for k in self.conf}
        for k, v in self.conf.items():
            self.spark.conf.set(k, v)
        _scopes.append(self)
        return self

    def free(self, *tables: DataFrame) -> None:
        for df in tables:
            self.folders.remove(df._kept_at)
            remove(self.spark, df._kept_at)

    def result(self, df: DataFrame, name: str = "result", **layout) -> DataFrame:
        at = _scopes.index(self)
        return _keep(df, name, _scopes[at - 1] if at else None, **layout)

    def __exit__(self, *error):
        _scopes.remove(self)
        for path in self.folders:
            remove(self.spark, path)
        for k, v in self.before.items():
            self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)
