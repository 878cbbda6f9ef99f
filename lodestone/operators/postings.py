"""A kept inverted index: what a question reads is its own terms' lists.

Rows are numbered in the order in which equal scores are listed. A list is cut into blocks by ranges
of SPAN rows, so no list is ever one value, and a block carries the largest gain that one of its rows
can have. Blocks lie in folders by a hash of their key, sorted by key inside, in small row groups: a
pushed filter on the folder and the key reads only the question's lists.

A question reads its lists' block heads first. They give the document frequencies and, for each
range of rows, the most that a score there can be; ranges below the relevance floor are left out
before any entry is read. All others are scored, because the answer says how many rows are above
the floor.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import text as X
from ..runtime import keep, numbered, scope
from . import posted

#: Rows of a block's range, and folders.
SPAN = 1 << 12
BUCKETS = 16
#: Bytes of a row group of postings.
GROUP = 1 << 19

ORDER = ("module_dir", "address", "node_key", "node_seq")


def _bucket(key: Column) -> Column:
    return F.pmod(F.crc32(key.cast("binary")), F.lit(BUCKETS)).cast("int")  # as posted.blocks has it


def _exact() -> Column:
    """What a row is called, as keys apart from terms, with the credit for spelling it out."""
    named = [("address", S.ADDRESS_WEIGHT), ("name", S.NAME_WEIGHT), ("type", S.TYPE_WEIGHT)]
    return F.filter(F.array(*[F.struct(F.lit(c).alias("field"), F.lower(c).alias("key"), F.lit(w).alias("w"), F.array().cast("array<int>").alias("at"))
                              for c, w in named]), lambda x: x["key"] != "")


def _identity(terms: Column) -> Column:
    """Each term or pair of the identity with its places and the number of places; identities are short."""
    n = F.size(terms)
    two = X.pairs(terms)
    places = lambda k: F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: (
        (F.get(terms, i) == k) | F.coalesce(F.get(two, i) == k, F.lit(False)) | F.coalesce(F.get(two, i - 1) == k, F.lit(False))))
    return F.transform(F.array_distinct(F.concat(terms, two)), lambda k: F.struct(
        F.lit("identity").alias("field"), k.alias("key"), n.cast("double").alias("w"), places(k).alias("at")))


def _blocks(entries: DataFrame, keys: list, entry: list, peak: Column) -> DataFrame:
    """Block rows of entries (*keys, doc, ...), sorted by folder and key; a group has at most SPAN rows.

    A task holds whole ranges of rows (`_ranged`), so neither the counting of occurrences before this nor
    the grouping moves an entry, and a list that most rows are in is spread like its rows.
    """
    grouped = entries.groupBy("bucket", *keys, "span").agg(
        F.count("*").alias("n"), F.max(peak).alias("peak"), F.collect_list(F.struct(*entry)).alias("entries"))
    return grouped.sortWithinPartitions("bucket", "key", "span")


def _width(spark: SparkSession, n: int) -> int:
    return max(1, min(SPAN, -(-n // spark.sparkContext.defaultParallelism)))


def _ranged(rows: DataFrame, n: int) -> DataFrame:
    """Rows with their range, whole ranges to a task: a row moves once, as its terms, before they are posted.

    A small table has shorter ranges than SPAN, so that every core has some.
    """
    spark = rows.sparkSession
    width = _width(spark, n)
    tasks = max(1, min(-(-n // width), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return rows.withColumn("span", F.floor(F.col("doc") / width)).repartitionByRange(tasks, "span")


def _placed(entries: DataFrame) -> DataFrame:
    return entries.withColumn("bucket", _bucket(F.col("key")))


@dataclass(frozen=True)
class PostingIndex:
    """docs(doc, *ORDER): the rows by number. body and names: blocks of postings. n, average: the corpus."""

    docs: DataFrame
    body: DataFrame
    names: DataFrame
    n: int
    average: float

    @classmethod
    def build(cls, nodes: DataFrame) -> "PostingIndex":
        spark = nodes.sparkSession
        with scope(spark, batch=posted.ROWS) as kept:
            columns = [*ORDER, "kind", "type", "name", "source", "file", "deprecated", "doc", "body"]
            # The texts become terms on their way into order, so they move once and are not written.
            read = ["type", "name", X.tokens(S.node_text(F.col("doc"), F.col("body"))).alias("terms"), X.tokens(S.identity_text()).alias("identity"),
                    S.authority(F.col("kind"), F.col("file"), F.col("deprecated")).alias("authority")]
            rows = numbered(nodes.select(*columns), list(ORDER), "tokens", [*ORDER, *read])[0].withColumnRenamed("no", "doc")
            rows = rows.withColumn("length", X.fused_length(F.col("terms")))
            stats = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0.0)).alias("total")).first()
            average = max(1.0, stats["total"] / max(stats["n"], 1))
            body = posted.blocks(rows, _width(spark, stats["n"]), average, S.K1, S.B, X.FUSED_WEIGHT, BUCKETS)
            body = kept.result(body.sortWithinPartitions("bucket", "key", "span"), "postings", partition_by="bucket", group_bytes=GROUP)
            titles = _ranged(rows.select("doc", "authority", "address", "name", "type", "identity"), stats["n"])
            named = titles.select("doc", "span", "authority", F.explode(F.concat(_exact(), _identity(F.col("identity")))).alias("e"))
            named = _placed(named.select("doc", "span", "authority", "e.*"))
            names = _blocks(named, ["field", "key"], ["doc", "w", "at", "authority"], F.col("w"))
            names = kept.result(names, "names", partition_by="bucket", group_bytes=GROUP)
            docs = kept.result(rows.select("doc", *ORDER).sortWithinPartitions("doc"), "rows", group_bytes=GROUP)
        return cls(docs, body, names, stats["n"], average)

    def lookup(self, numbers: list[int]) -> DataFrame:
        """(doc, *ORDER) of a few rows; the numbers are literals, so the filter reaches the scan."""
        return self.docs.filter(F.col("doc").isin(numbers))

    def scores(self, query: str, floor: float = S.MIN_RELEVANCE_SCORE) -> DataFrame:
        """(doc, score) of rows that share a term or a name with the question. Rows left out score below the floor."""
        plain, both, spelled, folders = _asked(self.docs.sparkSession, query.strip())
        listed = F.col("bucket").isin(folders) & F.col("key").isin(both)  # literals: folders and row groups are pruned
        body = self.body.filter(listed)
        names = self.names.filter(listed & (F.col("field") == "identity"))
        whole = self.names.filter((F.col("bucket") == spelled[1]) & (F.col("key") == spelled[0]) & (F.col("field") != "identity"))
        df = {r["key"]: r["df"] for r in body.groupBy("key").agg(F.sum("n").cast("double").alias("df")).collect()}  # the question's terms
        dfs = [df.get(t, 0.0) for t in both]
        parts = [(body, "body", F.col("e.length"), F.array().cast("array<int>")), (names, "identity", F.lit(0.0), F.col("e.at")),
                 (whole, "exact", F.lit(0.0), F.array().cast("array<int>"))]
        spans = _spans([(b, f) for b, f, *_ in parts], both, dfs, len(plain), self.n, floor)
        found = None
        for blocks, field, length, at in parts:
            kept = blocks.join(spans, "span", "left_semi").select("key", F.explode("entries").alias("e"))
            rows = kept.select(F.lit(field).alias("field"), "key", "e.doc", "e.w", "e.authority", length.alias("length"), at.alias("at"))
            found = rows if found is None else found.unionByName(rows)
        of = lambda field: F.col("field") == field
        rows = found.groupBy("doc").agg(
            F.max("authority").alias("authority"), F.max("length").alias("length"),
            F.sum(F.when(of("exact"), F.col("w")).otherwise(0.0)).alias("exact"), F.max(F.when(of("identity"), F.col("w"))).alias("places"),
            F.size(F.array_distinct(F.flatten(F.collect_list("at")))).alias("hits"),  # one row's identity
            *[F.sum(F.when(of("body") & (F.col("key") == t), F.col("w")).otherwise(0.0)).alias(f"f{i}") for i, t in enumerate(both)])
        text = S.score_body([F.col(f"f{i}") for i in range(len(both))], dfs, len(plain), F.col("length"), self.n, self.average)
        covered = F.coalesce(F.col("hits") / F.col("places"), F.lit(0.0))
        score = (F.col("exact") + S.ADDRESS_PARTIAL_WEIGHT * covered + S.BODY_WEIGHT * text) * F.col("authority")
        return rows.select("doc", score.alias("score"))

    def every_score(self, query: str) -> DataFrame:
        """(*ORDER, score) of all rows."""
        scored = self.docs.join(self.scores(query, floor=0.0), "doc", "left")
        return scored.select(*ORDER, F.coalesce("score", F.lit(0.0)).alias("score"))


def _asked(spark: SparkSession, query: str):
    """(plain terms, plain and fused ones, the question spelled out and its folder, folders of the terms): one row, no data."""
    row = spark.sql("SELECT :q AS q", args={"q": query}).select(F.lower("q").alias("key"), X.tokens(F.col("q")).alias("plain"))
    row = row.withColumn("both", F.array_distinct(F.concat("plain", X.pairs(F.col("plain")))))
    row = row.select("key", F.array_distinct("plain").alias("plain"), "both", F.transform("both", _bucket).alias("folders"), _bucket(F.col("key")).alias("folder")).first()
    both = list(dict.fromkeys([*row["plain"], *row["both"]]))
    return row["plain"], both, (row["key"], row["folder"]), sorted(set(row["folders"]))


def _spans(parts, both, dfs, n_plain: int, n: int, floor: float) -> DataFrame:
    """(span): the ranges whose rows can reach the floor, by the block heads alone."""
    heads = None
    for blocks, field in parts:
        part = blocks.select("span", "key", "peak", F.lit(field).alias("field"))
        heads = part if heads is None else heads.unionByName(part)
    of = lambda field: F.col("field") == field
    per = heads.groupBy("span").agg(
        F.max(F.when(of("identity"), S.ADDRESS_PARTIAL_WEIGHT).otherwise(0.0)).alias("identity"),
        F.sum(F.when(of("exact"), F.col("peak")).otherwise(0.0)).alias("exact"),
        *[F.max(F.when(of("body") & (F.col("key") == t), F.col("peak"))).alias(f"p{i}") for i, t in enumerate(both)])
    most = S.body_bound([F.col(f"p{i}") for i in range(len(both))], dfs, n_plain, n)
    # A sum in another order may differ in its last digits.
    return per.filter(F.col("identity") + F.col("exact") + S.BODY_WEIGHT * most >= floor - 1e-9).select("span")
