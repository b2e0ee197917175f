"""Identity keys of chunks: which rows count as the same in a deduplication."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kelpworks.functions.text import compact, normalize_text


def _key(*parts: Column) -> Column:
    return F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))


def chunk_index(whole: Column, local: Column) -> Column:
    """The index over all types, else that within the type; a local 0 is as good as none."""
    return F.coalesce(whole.cast("string"), F.nullif(local.cast("string"), F.lit("0")), F.lit(""))


def chunk_key(post: Column, prop: Column, planning: Column, kind: Column, index: Column) -> Column:
    """K1a."""
    return _key(post, prop, planning, kind, index)


def paged_key(planning: Column, kind: Column, index: Column, page: Column, content: Column, normal: bool = True) -> Column:
    """K1b; without `normal` K1c."""
    return _key(planning, kind, index, page, normalize_text(F.substring(content, 1, 120)) if normal else F.substring(content, 1, 80))


def short_key(planning: Column, kind: Column, index: Column) -> Column:
    """K1d."""
    return _key(planning, kind, index)


def content_key(key: Column, content: Column) -> Column:
    """K1e, from K1a."""
    return _key(key, normalize_text(F.substring(content, 1, 120)))


def body_key(planning: Column, kind: Column, index: Column, content: Column) -> Column:
    """K1f."""
    return _key(planning, kind, index, F.substring(normalize_text(content), 1, 280))


def structural_key(content: Column, page: Column, kind: Column) -> Column:
    """K1g."""
    return F.concat_ws("::", normalize_text(content), F.coalesce(page.cast("string"), F.lit("")), F.coalesce(kind, F.lit("")))


def listing_key(post: Column, prop: Column, content: Column) -> Column:
    """K1h."""
    return F.coalesce(F.concat(F.lit("post:"), post.cast("string")), F.concat(F.lit("property:"), prop.cast("string")), F.substring(content, 1, 80))


def content_digest(key: Column, content: Column) -> Column:
    """The key where there is one, else a digest of the content."""
    return F.coalesce(F.nullif(key, F.lit("")), F.sha1(F.coalesce(content, F.lit("")).cast("binary")))


__all__ = [n for n in dir() if n.endswith("_key")] + ["chunk_index", "content_digest", "compact"]
