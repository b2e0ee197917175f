"""Filters over metadata: a small tree of conditions, compiled to one predicate for every kind of search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fields that a filter may name, and those whose text is a number.
EQUAL = ("city", "district", "postType", "postStatus", "bedrooms", "postId", "planningDocumentId", "documentScope", "documentType", "dossierCode", "chunkType", "propertyId", "floorNumber")
NUMERIC = frozenset(("price", "area", "bedrooms", "floorNumber", "postId", "propertyId", "planningDocumentId", "planYear", "pageNumber", "chunkIndex", "globalChunkIndex"))
RANGES = {"priceMin": ("price", "$gte"), "priceMax": ("price", "$lte"), "areaMin": ("area", "$gte"), "areaMax": ("area", "$lte"), "floorMin": ("floorNumber", "$gte"), "floorMax": ("floorNumber", "$lte")}
IDENTITY = ("postId", "propertyId", "planningDocumentId")


def build_filter(filters: dict) -> dict:
    """{} for none, the bare condition for one, $and for more."""
    parts = [{k: {"$eq": filters[k]}} for k in EQUAL if filters.get(k) is not None]
    parts += [{name: {op: filters[k]}} for k, (name, op) in RANGES.items() if filters.get(k) is not None]
    if filters.get("planYear") is not None:
        parts.append({"planYear": {"$eq": filters["planYear"]}})
    if filters.get("chunkTypes"):
        parts.append({"chunkType": {"$in": list(filters["chunkTypes"])}})
    return conjunction(*parts)


def conjunction(*filters: dict) -> dict:
    """nested $and are one."""
    flat = [part for f in filters if f for part in (f["$and"] if set(f) == {"$and"} else [f])]
    return {} if not flat else flat[0] if len(flat) == 1 else {"$and": flat}


def names_one(tree: dict) -> bool:
    """whether a condition names one post, property or planning document."""
    return any(any(names_one(x) for x in v) if k in ("$and", "$or") else k in IDENTITY for k, v in tree.items())


def merged(*raw: dict) -> dict:
    """later values win, nested ones are merged; chunkTypes become a choice of chunkType."""
    out: dict = {}
    for r in raw:
        for k, v in (r or {}).items():
            out[k] = {**out[k], **v} if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    if kinds := out.pop("chunkTypes", None):
        out["chunkType"] = {"$in": list(kinds)}
    return out


def compiled(tree: dict, field=F.col) -> Column:
    """F1, F4 as one predicate: numbers compare as numbers, text without case or outer space. field: name to column."""
    parts = []
    for name, value in tree.items():
        if name in ("$and", "$or"):
            parts.append(reduce((lambda a, b: a & b) if name == "$and" else (lambda a, b: a | b), (compiled(x, field) for x in value)))
            continue
        number = name in NUMERIC
        left = field(name).cast("string").try_cast("double") if number else F.lower(F.coalesce(field(name).cast("string"), F.lit("")))
        fit = (lambda v: float(v)) if number else (lambda v: str(v).strip().lower())
        for op, v in (value if isinstance(value, dict) else {"$eq": value}).items():
            if v is None:
                continue
            match op:
                case "$eq":
                    parts.append(left == F.lit(fit(v)))
                case "$gte":
                    parts.append(left >= F.lit(fit(v)))
                case "$lte":
                    parts.append(left <= F.lit(fit(v)))
                case "$in":
                    parts.append(left.isin([fit(x) for x in v]))
                case _:
                    raise ValueError(f"unknown operator {op}")
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def any_contains(columns: list[Column], values: list[str]) -> Column:
    """one of the columns holds one of the values, without case; no wildcards."""
    return reduce(lambda a, b: a | b, (F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(v.strip().lower())) for c in columns for v in values if v.strip()), F.lit(False))
