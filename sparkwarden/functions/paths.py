"""Path and graph-identifier expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkwarden.functions import fixed_values as fv
from sparkwarden.functions.text import ColumnLike, col, one_of, strip, words


def parts(path: ColumnLike) -> Column:
    return F.filter(F.split(col(path), "/"), lambda p: (p != "") & (p != "."))


def file_name(path: ColumnLike) -> Column:
    return F.substring_index(col(path), "/", -1)


def suffix(path: ColumnLike) -> Column:
    """Last extension with its dot; a name that only starts with a dot has none."""
    return F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1)


def stem(path: ColumnLike) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]+$", "")


def any_part(path: ColumnLike, names: tuple[str, ...], lower: bool = False) -> Column:
    p = F.lower(col(path)) if lower else col(path)
    return F.arrays_overlap(parts(p), words(names))


def normalize_path(path: ColumnLike) -> Column:
    return F.regexp_replace(F.replace(col(path), F.lit("\\"), F.lit("/")), r"^\./", "")


def should_scan_file(path: ColumnLike) -> Column:
    return one_of(file_name(path), fv.SCAN_FILENAMES) | one_of(F.lower(suffix(path)), fv.SCAN_EXTENSIONS)


def should_skip_path(path: ColumnLike) -> Column:
    name = F.lower(file_name(path))
    by_name = F.lit(False)
    for prefix in fv.SKIP_NAME_PREFIXES:
        by_name = by_name | name.startswith(prefix)
    return any_part(path, fv.SKIP_PARTS) | by_name


def should_ignore_file(path: ColumnLike, strict: bool = False) -> Column:
    """Dependency, test, documentation and generated paths.

    The default keeps the fragment test, so ``latest/x`` counts as ``test/``; ``strict`` compares
    whole segments.
    """
    plain = F.lower(bare_path(F.replace(col(path), F.lit("\\"), F.lit("/"))))
    hit = F.arrays_overlap(parts(plain), words(fv.IGNORED_PARTS))
    fragments = "|".join(fv.IGNORED_FRAGMENTS)
    return hit | plain.rlike(f"(?:^|/)(?:{fragments})" if strict else fragments)


def is_nonruntime_path(path: ColumnLike) -> Column:
    name = F.lower(file_name(path))
    return (
        any_part(path, fv.NON_RUNTIME_PARTS, lower=True)
        | one_of(name, fv.NON_RUNTIME_FILENAMES)
        | one_of(F.lower(stem(path)), fv.NON_RUNTIME_STEMS)
        | name.rlike(r"(^|[._-])(test|spec)([._-]|$)")
    )


def is_runtime_likely_path(path: ColumnLike) -> Column:
    return any_part(path, fv.RUNTIME_PARTS, lower=True) | one_of(
        F.lower(file_name(path)), fv.RUNTIME_FILENAMES)


def benchmark_source_file(path: ColumnLike) -> Column:
    """Files the repository benchmark reads, of any size."""
    named = one_of(F.lower(suffix(path)), fv.SOURCE_EXTENSIONS) | file_name(path).isin(
        *fv.SOURCE_FILENAMES)
    return ~any_part(path, fv.SOURCE_SKIP_PARTS) & named


# --- identifiers: Label:path or Label:path:symbol -------------------------------------------

def bare_path(node_id: ColumnLike) -> Column:
    c = col(node_id)
    return F.when(c.startswith("File:"), F.substring(c, 6, 1 << 30)).otherwise(c)


def _is_symbol(node_id: Column) -> Column:
    return node_id.rlike(f"^({'|'.join(fv.SYMBOL_LABELS)}):")


def node_file_path(node_id: ColumnLike) -> Column:
    """Second piece of any identifier, NULL when there is no colon."""
    c = col(node_id)
    return F.when(c.contains(":"), F.split(c, ":", 3)[1])


def symbol_file_path(node_id: ColumnLike) -> Column:
    """File of a File/Function/Class/Method identifier, '' for every other label."""
    c = col(node_id)
    return F.when(c.startswith("File:"), bare_path(c)).when(
        _is_symbol(c), F.split(c, ":", 3)[1]).otherwise(F.lit(""))


def to_file_node_id(node_id: ColumnLike) -> Column:
    c = col(node_id)
    return F.when(c.startswith("File:"), c).when(
        _is_symbol(c), F.concat(F.lit("File:"), F.split(c, ":", 3)[1])).otherwise(c)


def extract_node_id(*candidates: ColumnLike) -> Column:
    """First non-empty of file_path, node_id, id, file as a File identifier ('' when none)."""
    raw = F.coalesce(*[F.nullif(col(c).cast("string"), F.lit("")) for c in candidates], F.lit(""))
    return F.when(_is_symbol(raw), to_file_node_id(raw)).when(
        raw != "", F.concat(F.lit("File:"), raw)).otherwise(F.lit(""))


def display_name(name: ColumnLike) -> Column:
    """Name without its arity suffix."""
    return F.substring_index(F.coalesce(col(name), F.lit("")), "#", 1)


def infer_repo_and_path(path: ColumnLike, repos: list[str]) -> Column:
    """Struct (repo, file_path), NULL when no segment names a known repository."""
    normal = normalize_path(path)
    pieces = F.split(normal, "/")
    flags = F.transform(pieces, lambda p: p.isin(*repos))
    at = F.array_position(flags, F.lit(True)).cast("int")
    rest = F.array_join(F.slice(pieces, at + 1, F.size(pieces)), "/")
    found = F.struct(F.element_at(pieces, F.greatest(at, F.lit(1))).alias("repo"), rest.alias("file_path"))
    if len(repos) == 1:
        only = F.struct(F.lit(repos[0]).alias("repo"), normal.alias("file_path"))
        return F.when(at > 0, found).otherwise(only)
    return F.when(at > 0, found)


def url_host(url: ColumnLike) -> Column:
    u = col(url)
    full = F.when(u.startswith("http://") | u.startswith("https://"), u).otherwise(
        F.concat(F.lit("http://"), u))
    return F.regexp_replace(F.lower(F.try_parse_url(full, F.lit("HOST"))), r"^www\.", "")


def url_id(url: ColumnLike) -> Column:
    """Unpadded URL-safe base64."""
    plain = F.base64(F.encode(col(url), "UTF-8"))
    return F.translate(F.regexp_replace(plain, r"[=\s]", ""), "+/", "-_")


def clean(text: ColumnLike) -> Column:
    return F.nullif(strip(text), F.lit(""))
