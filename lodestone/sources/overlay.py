"""Plan and state JSON as instance rows.

Only addresses, keys and actions are decoded. Attribute values (before, after, values) are
never parsed into columns: they are large, sensitive and needed by no query.
"""

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import address as A
from ..runtime import cut, detached, generation, keep, owner
from ..schema import INSTANCES

# Overlay file names in order of preference, plans before states.
PLAN_PATTERNS = ("*.tfplan.json", "tfplan.json", "plan.json")
STATE_PATTERNS = ("*.tfstate.json", "tfstate.json", "state.json")

# How failures are worded.
NOT_A_DOCUMENT = ": not a terraform show -json document"
NEITHER = ": has neither resource_changes nor values; it is not a plan or state document"
NONE_FOUND = "no plan or state JSON found in any root module directory"
NOT_SUPPLIED = "no overlay was supplied"

_RESOURCE = "address STRING, mode STRING, type STRING, name STRING, index STRING"
_DOCUMENT = (
    "terraform_version STRING, values STRUCT<root_module: STRING>, resource_changes ARRAY<STRUCT<"
    "address: STRING, module_address: STRING, mode: STRING, type: STRING, name: STRING, index: STRING, "
    "action_reason: STRING, change: STRUCT<actions: ARRAY<STRING>>>>, broken STRING"
)
# A nested object read as STRING keeps its JSON text, so each level decodes only itself.
_MODULE = f"address STRING, resources ARRAY<STRUCT<{_RESOURCE.replace(' STRING', ': STRING')}>>, child_modules ARRAY<STRING>"


class AmbiguousStackError(ValueError):
    """A bare overlay path in a repository with several roots (or none)."""

    def __init__(self, spec: str, roots: list):
        # The wording is part of the interface.
        super().__init__(
            f"cannot tell which root module '{spec}' belongs to; this repository has "
            f"{len(roots)} roots ({', '.join(roots)}). Use --plan <root>=<path>."
        )


def parse_explicit(spec: str, roots: list) -> list[tuple[str, str]]:
    """(stack, path) pairs of `stack=path,...`; a bare path needs exactly one root."""
    found = []
    for part in filter(None, (p.strip() for p in spec.strip().split(","))):
        stack, equals, path = part.partition("=")
        if equals:
            found.append((stack.strip().strip("/"), path.strip()))
        elif len(roots) == 1:
            found.append((roots[0], part))
        else:
            raise AmbiguousStackError(part, roots)
    return found


def discover(listing: DataFrame, roots: DataFrame) -> DataFrame:
    """(stack, path): at most one overlay file of listing(module_dir, name, path) per root."""
    rank = F.lit(None).cast("int")
    for i, pattern in reversed(list(enumerate(PLAN_PATTERNS + STATE_PATTERNS))):
        name = F.col("name")
        hit = name.endswith(pattern[1:]) if pattern.startswith("*") else name == pattern
        rank = F.when(hit, i).otherwise(rank)
    return (
        listing.withColumn("rank", rank).filter(F.col("rank").isNotNull())
        .join(roots, "module_dir", "left_semi")
        .groupBy(F.col("module_dir").alias("stack"))
        .agg(F.min(F.struct("rank", "path")).alias("best"))
        .select("stack", "best.path")
    )


@dataclass(frozen=True)
class Overlay:
    """overlays(stack, source, kind, terraform_version), failures(source, reason), and the read documents.

    Instances are taken out of the documents and written when first asked for; `tables` owns them then.
    """

    overlays: DataFrame
    documents: DataFrame
    failures: DataFrame
    tables: generation | None = None

    @cached_property
    def instances(self) -> DataFrame:
        """Rows of schema.INSTANCES."""
        with detached(self.tables):
            resources = keep(plan_instances(self.documents).unionByName(state_instances(self.documents)), "resources")
            rows = resources.withColumn(
                "module_address", A.normalize_module_address(F.col("raw_module"))
            ).drop("raw_module").unionByName(module_instances(resources))
            return keep(rows.select(INSTANCES.fieldNames()), "instances")

    @cached_property
    def sources(self) -> list:
        """One small row per root module with an overlay, ordered by stack."""
        return self.overlays.orderBy("stack").collect()

    @cached_property
    def partial(self) -> list[str]:
        """Why overlay files could not be read, in reading order."""
        return [row["reason"] for row in self.failures.orderBy("pos", *[c for c in ("stack", "source") if c in self.failures.columns]).collect()]

    def is_available(self) -> bool:
        return not self.overlays.isEmpty()

    def unavailable_reason(self) -> str:
        if self.sources and self.partial:
            return f"{len(self.partial)} overlay file(s) could not be read: " + "; ".join(self.partial)
        if not self.sources:
            return "; ".join(self.partial) or NONE_FOUND
        return ""

    def stacks(self) -> list[str]:
        return [row["stack"] for row in self.sources]

    def _of(self, stack, field, absent):
        return next((row[field] for row in self.sources if row["stack"] == stack), absent)

    def source_for(self, stack: str) -> str:
        return self._of(stack, "source", "")

    def kind_for(self, stack: str) -> str:
        return self._of(stack, "kind", "none")

    def terraform_version_for(self, stack: str) -> str:
        return self._of(stack, "terraform_version", "")


def _resource_instances(df: DataFrame, resource: str, module_address, seq, actions=None, reason=None) -> DataFrame:
    r = F.col(resource)
    return df.select(
        "stack", F.coalesce(module_address, F.lit("")).alias("raw_module"),
        A.config_address(r["mode"], r["type"], r["name"]).alias("config_address"),
        F.coalesce(r["address"], F.lit("")).alias("address"),
        F.coalesce(r["index"], F.lit("")).alias("index_key"),
        (F.array().cast("array<string>") if actions is None
         else F.coalesce(actions, F.array().cast("array<string>"))).alias("actions"),
        (F.lit("") if reason is None else F.coalesce(reason, F.lit(""))).alias("action_reason"),
        seq.alias("inst_seq"),
    ).filter("config_address != ''")


def plan_instances(docs: DataFrame) -> DataFrame:
    rows = docs.filter("kind = 'plan'").select("stack", F.posexplode("doc.resource_changes").alias("i", "rc"))
    return _resource_instances(
        rows, "rc", F.col("rc.module_address"), F.lpad(F.col("i").cast("string"), 9, "0"),
        F.col("rc.change.actions"), F.col("rc.action_reason"),
    )


def state_instances(docs: DataFrame) -> DataFrame:
    """One round per level of nested modules; each level is a checkpointed table."""
    level = docs.filter("kind = 'state'").select(
        "stack", F.col("doc.values.root_module").alias("json"), F.lit("").alias("path")
    )
    found = None
    while True:
        level = cut(level.select("stack", "path", F.from_json("json", _MODULE).alias("m")).filter("m IS NOT NULL"))
        rows = level.select(
            "stack", "path", F.col("m.address").alias("module"), F.posexplode("m.resources").alias("i", "r")
        )
        part = _resource_instances(
            rows, "r", F.col("module"), F.concat("path", F.lpad(F.col("i").cast("string"), 9, "0"))
        )
        found = part if found is None else found.unionByName(part)
        level = level.select("stack", "path", F.posexplode("m.child_modules").alias("i", "json")).select(
            "stack", "json", F.concat("path", F.lit("m"), F.lpad(F.col("i").cast("string"), 9, "0")).alias("path")
        )
        if level.isEmpty():
            return found


def module_instances(resources: DataFrame) -> DataFrame:
    """The module calls that resource addresses imply, each instance once.

    Module paths are made distinct before they are taken apart: a module of a million
    resources is one path.
    """
    paths = resources.select("stack", "raw_module").filter("raw_module != ''").distinct()
    steps = paths.select("stack", A.module_segments(F.col("raw_module")).alias("s")).select(
        "stack", "s", F.posexplode("s").alias("i", "segment")
    )
    bases = F.transform(F.slice("s", F.lit(1), F.col("i")), A.segment_base)
    return steps.select(
        "stack", F.array_join(bases, ".").alias("module_address"),
        A.segment_base(F.col("segment")).alias("config_address"),
        F.array_join(F.slice("s", F.lit(1), F.col("i") + 1), ".").alias("address"),
        A.segment_key(F.col("segment")).alias("index_key"),
        F.array().cast("array<string>").alias("actions"), F.lit("").alias("action_reason"),
        F.lit("").alias("inst_seq"),
    ).distinct()


def build(documents: DataFrame) -> Overlay:
    """documents(pos, stack, source, content) to an overlay; broken files do not stop the others.

    An optional `error` says why a document could not be read at all.
    Where a stack is named twice, the last readable document counts.
    """
    parsed = documents.withColumn(
        "doc", F.from_json("content", _DOCUMENT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"})
    )
    kind = F.when(F.size("doc.resource_changes") > 0, "plan").when(F.col("doc.values").isNotNull(), "state")
    is_json = F.col("doc").isNotNull() & F.col("doc.broken").isNull()
    unread = F.col("error") if "error" in documents.columns else F.lit(None).cast("string")
    reason = (
        F.when(unread.isNotNull(), unread)
        .when(~is_json, F.concat("source", F.lit(NOT_A_DOCUMENT)))
        .when(kind.isNull(), F.concat("source", F.lit(NEITHER)))
    )
    docs = keep(parsed.select("pos", "stack", "source", "doc", kind.alias("kind"), reason.alias("reason")), "documents")
    failures = docs.filter("reason IS NOT NULL").select("pos", "source", "reason")
    good = docs.filter("reason IS NULL")
    last = good.groupBy("stack").agg(F.max("pos").alias("pos"))
    good = good.join(last, ["stack", "pos"])
    overlays = good.select(
        "stack", "source", "kind", F.coalesce("doc.terraform_version", F.lit("")).alias("terraform_version")
    )
    within = owner()
    return Overlay(overlays, good, failures, within if isinstance(within, generation) else None)
