"""Configuration addresses, traversals and paths as Spark columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Traversal roots that name the runtime, not a block.
BUILTIN_SCOPES = ("each", "count", "self", "path", "terraform")

# How an index step and a moved or wired pair are written.
INDEX_MARK = "[…]"
ARROW = " → "

_ID = r"[\p{L}_][\p{L}\p{Nd}_\-]*"
_DOT = r"\s*\.\s*"
_PLAIN = r"\A[A-Za-z_][A-Za-z0-9_\-]*+(?:\.[A-Za-z_][A-Za-z0-9_\-]*+)*+\z"
_INDEX_STEP = r'\s*\[\s*(?:"(?:[^"\\]|\\.)*"|[^\]"]*)\s*\]|\s*\.\s*\d+'


def node_key(module_dir: Column, address: Column) -> Column:
    return F.concat(module_dir, F.lit("|"), address)


def location(file: Column, line: Column) -> Column:
    return F.concat(file, F.lit(":"), line.cast("string"))


def root_name(raw: Column) -> Column:
    return F.regexp_extract(raw, f"^{_ID}", 0)


def attribute_step(raw: Column, i: int) -> Column:
    """Name of the i-th step after the root; NULL unless all steps up to it are attributes."""
    pattern = f"^{_ID}" + f"{_DOT}{_ID}" * (i - 1) + f"{_DOT}({_ID})"
    return F.nullif(F.regexp_extract(raw, pattern, 1), F.lit(""))


def is_plain(raw: Column) -> Column:
    """A traversal of ASCII names and dots alone. Its parts are found by their dots, without a pattern."""
    return raw.rlike(_PLAIN)


def _steps(raw: Column, n: int) -> Column:
    """The first n names of a plain traversal; NULL if it has fewer."""
    return F.when(F.substring_index(raw, ".", n - 1) != raw, F.substring_index(raw, ".", n))


def traversal_root(raw: Column, plain: Column) -> Column:
    return F.when(plain, F.substring_index(raw, ".", 1)).otherwise(root_name(raw))


def traversal_address(raw: Column, plain: Column | None = None) -> Column:
    """The address a traversal names, or NULL: data takes two steps, everything else one. plain: is_plain, if known."""
    root, first, second = root_name(raw), attribute_step(raw, 1), attribute_step(raw, 2)
    return F.when(
        is_plain(raw) if plain is None else plain, F.when(F.substring_index(raw, ".", 1) == "data", _steps(raw, 3)).otherwise(_steps(raw, 2))
    ).when(root == "data", F.concat(F.lit("data."), first, F.lit("."), second)).otherwise(
        F.concat(root, F.lit("."), first)
    )


def provider_address(raw: Column, plain: Column | None = None) -> Column:
    """The provider a traversal names; a bare word is the default provider."""
    return F.when(
        is_plain(raw) if plain is None else plain, F.concat(F.lit("provider."), F.substring_index(raw, ".", 2))
    ).otherwise(F.concat_ws(".", F.lit("provider"), root_name(raw), attribute_step(raw, 1)))


def traversal_text(raw: Column, plain: Column | None = None) -> Column:
    """The traversal as written, index steps shortened to a mark."""
    short = F.regexp_replace(F.regexp_replace(raw, _INDEX_STEP, INDEX_MARK), r"\s+", "")
    written = F.when(raw.rlike(r"[\[\s]|\.\d"), short).otherwise(raw)  # most have nothing to shorten
    return written if plain is None else F.when(plain, raw).otherwise(written)


def clean_path(path: Column) -> Column:
    """A relative path without '.', '..' and empty segments; '' is the repository root.

    Segments that climb above the root stay in front as '..'.
    """
    def step(done, part):
        last = F.try_element_at(done, F.lit(-1))
        return (
            F.when(part.isin("", "."), done)
            .when((part == "..") & (F.size(done) > 0) & (last != ".."), F.slice(done, F.lit(1), F.size(done) - 1))
            .otherwise(F.array_append(done, part))
        )

    empty = F.array().cast("array<string>")
    return F.array_join(F.aggregate(F.split(path, "/"), empty, step), "/")


def local_target(module_dir: Column, source: Column) -> Column:
    """Directory a local module source points at; NULL for remote sources and escapes."""
    is_local = source.startswith("./") | source.startswith("../")
    joined = clean_path(F.concat_ws("/", module_dir, source))
    return F.when(is_local & ~joined.startswith(".."), joined)


def base_name(path: Column) -> Column:
    """Last segment of a path."""
    return F.regexp_extract(F.regexp_replace(path, "(?<=.)/+$", ""), r"[^/]+$|^/$", 0)


# Addresses of expanded modules, as plan and state documents write them.
# Possessive throughout: a long key costs one step, not a stack of choices.
_KEY = r'\[(?:[^\]"]++|"[^"]*+")*+\]'
_PART = rf'[^.\["]*+(?:(?:{_KEY}|"[^"]*+")[^.\["]*+)*+'
_SEGMENT = rf"module\.{_PART}"


def module_segments(address: Column) -> Column:
    """`module.a[0].module.b["x.y"]` as its module segments; keys may contain dots.

    An address that is not a run of module segments has none. A trailing lone part is
    ignored.
    """
    shape = rf"^{_SEGMENT}(?:\.{_SEGMENT})*+(?:\.{_PART})?$"
    return F.when(
        address.rlike(shape), F.regexp_extract_all(address, F.lit(f"({_SEGMENT})(?=\\.|$)"), F.lit(1))
    ).otherwise(F.array().cast("array<string>"))


def segment_base(segment: Column) -> Column:
    """`module.fleet["eu"]` without its key."""
    return F.regexp_replace(segment, r"\[.*\][^\]]*$", "")


def segment_key(segment: Column) -> Column:
    """The instance key of a segment, quotes trimmed; '' without one."""
    return F.btrim(F.regexp_extract(segment, r"\[(.*)\]", 1), F.lit('"'))


def normalize_module_address(address: Column) -> Column:
    """A module address without instance keys: the form a static parse yields."""
    return F.array_join(F.transform(module_segments(address), segment_base), ".")


def config_address(mode: Column, type_name: Column, name: Column) -> Column:
    """The address as configuration writes it; '' when type or name is missing."""
    missing = (F.coalesce(type_name, F.lit("")) == "") | (F.coalesce(name, F.lit("")) == "")
    return (
        F.when(missing, "")
        .when(mode == "data", F.concat(F.lit("data."), type_name, F.lit("."), name))
        .otherwise(F.concat(type_name, F.lit("."), name))
    )
