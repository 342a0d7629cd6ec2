"""Paths, references and class names as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Namespaces that a reference may already have.
NAMESPACES = ["asset:", "material:", "widget:", "class:", "cpp_class:", "bp_func:", "datatable:", "materialfunction:"]


def to_asset_path(file: Column, content_root: str, mounts: dict[str, str] | None = None) -> Column:
    """The asset path of a file: below a mounted root ``/Mount/rest``, below the content root
    ``/Game/rest``; slashes turned, extension dropped. Other files stay as they are, slashes turned."""
    path = F.replace(file, F.lit("\\"), F.lit("/"))
    bare = F.regexp_replace(path, r"\.[^./]*$", "")
    out = path
    roots = [*(mounts or {}).items(), (content_root, "Game")]
    for root, mount in reversed(roots):
        root = root.replace("\\", "/").rstrip("/") + "/"
        out = F.when(path.startswith(root), F.concat(F.lit(f"/{mount}/"), F.substr(bare, F.lit(len(root) + 1)))).otherwise(out)
    return out


def normalize_object_path(path: Column) -> Column:
    """The package of an object path; text that is no path, and script paths, stay."""
    package = F.regexp_replace(F.regexp_replace(path, r"\.[^./]*$", ""), r"_C$", "")
    return F.when(~path.startswith("/") | path.startswith("/Script/"), path).otherwise(package)


def last_segment(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def normalize_inherits_target(token: Column) -> Column:
    """struct(normalized, bare_name) of a parent named in a question."""
    bare = F.btrim(token, F.lit(" ?\"'"))
    bare = F.regexp_replace(bare, r"^(?i)((class|asset):\s*)+", "")
    normalized = F.when(bare.startswith("/"), normalize_object_path(bare)).otherwise(bare)
    last = last_segment(normalized)
    name = F.when(~normalized.startswith("/Script/") & normalized.startswith("/"), F.regexp_replace(last, r"\.[^.]*$", "")).otherwise(F.element_at(F.split(last, r"\."), -1))
    return F.struct(normalized.alias("normalized"), F.regexp_replace(name, r"_C$", "").alias("bare_name"))


def module_of(path: Column) -> Column:
    """The folder below ``/Game``, ``Source`` or ``Plugins``; else Unknown."""
    game = F.regexp_extract(path, r"^/Game/([^/]+)/", 1)
    code = F.regexp_extract(path, r"(?:^|/)(?:Source|Plugins)/([^/]+)/", 1)
    return F.when(game != "", game).when(code != "", code).otherwise("Unknown")


def normalize_reference(ref: Column) -> Column:
    """A reference with its namespace: script paths under ``script:``, plain ones under ``asset:``."""
    known = F.lit(False)
    for n in NAMESPACES:
        known = known | ref.startswith(n)
    return F.when(known, ref).when(ref.startswith("/Script/"), F.concat(F.lit("script:"), ref)).otherwise(F.concat(F.lit("asset:"), ref))


#: A path of two segments at least.
PATH = r"/[A-Za-z0-9_]+(?:/[A-Za-z0-9_]+)+"


def extract_asset_path(value: Column) -> Column:
    """The first path in a value; null if it has none."""
    return F.nullif(F.regexp_extract(value, PATH, 0), F.lit(""))


def extract_class_name(value: Column) -> Column:
    """The class named by a tuple (``(/Script/Module, Class, )``) or a script path, else the last segment of a path."""
    pair = F.regexp_extract(value, r"\([\s,]*/Script/\w+\s*,\s*(\w+)\s*,", 1)
    script = F.regexp_extract(value, r"/Script/[A-Za-z0-9_]+\.([A-Za-z0-9_]+)", 1)
    return F.when(pair != "", pair).when(script != "", script).otherwise(F.nullif(F.regexp_replace(last_segment(F.regexp_extract(value, PATH, 0)), r"_C$", ""), F.lit("")))


def extract_all_refs(text: Column, own: Column) -> Column:
    """All other asset paths in a text, sorted; no script, file or one-segment paths."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(PATH), F.lit(0)))
    return F.array_sort(F.filter(found, lambda p: ~p.startswith("/Script/") & (p != own) & ~p.rlike("/(Plugins|Content|Source)/")))


def class_name_candidates(name: Column) -> Column:
    """The names under which a class may be declared, best first: as given, then with each prefix."""
    bare = F.regexp_replace(name, r"_C$", "")
    has = bare.rlike("^[UAFISET][A-Z]")
    return F.when(has, F.array(bare)).otherwise(F.array(bare, *[F.concat(F.lit(p), bare) for p in "UAFISET"]))
