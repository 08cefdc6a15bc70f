"""Column functions for answers of other services: JSON that may be wrapped, fenced or marked as failed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def dug(payload: Column, path: str, kind: str = "variant") -> Column:
    """The value at a dotted path of a variant, null where there is none or where it can't be of that kind."""
    return F.try_variant_get(payload, f"$.{path}", kind)


def first_present(payload: Column, *paths: str, kind: str = "string") -> Column:
    """The first path that has a value; 0 and false are values."""
    return F.coalesce(*(dug(payload, p, kind) for p in paths))


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def unwrapped(payload: Column, keys: Sequence[str]) -> Column:
    """The first child of these names that is an object, else the payload itself."""
    children = [dug(payload, k) for k in keys]
    return F.coalesce(*(F.when(_kind(c).startswith("OBJECT"), c) for c in children), payload)


def first_list(payload: Column, keys: Sequence[str], depth: int = 2) -> Column:
    """The first list under these names, looked for inside objects of these names too; an empty list where there is none."""

    def look(v: Column, left: int) -> list[Column]:
        found = []
        for k in keys:
            child = dug(v, k)
            found.append(F.when(_kind(child).startswith("ARRAY"), child))
            if left:
                # an empty list inside an object lets the search go on
                found += [F.when(_kind(child).startswith("OBJECT") & (F.to_json(x) != "[]"), x) for x in look(child, left - 1)]
        return found

    return F.coalesce(*look(payload, depth), F.parse_json(F.lit("[]")))


def failure(payload: Column) -> Column:
    """The error of a payload that says success: false, null for all others."""
    failed = dug(payload, "success", "boolean") == F.lit(False)
    return F.when(failed, F.coalesce(F.nullif(dug(payload, "error", "string"), F.lit("")), F.lit("no reason given")))


def checked(payload: Column) -> Column:
    """The payload; a failed one ends the query with its error."""
    return F.when(failure(payload).isNotNull(), F.raise_error(failure(payload)).cast("variant")).otherwise(payload)


def repaired(text: Column) -> Column:
    """The JSON in a text as a variant: the text itself, what a code fence holds, or what the outermost braces hold; null if none is JSON."""
    t = F.trim(text, F.lit(" \t\r\n"))
    inside = F.regexp_extract(t, r"(?s)^```(.*?)(?:```|\z)", 1)
    fenced = F.trim(F.regexp_replace(inside, "^json", ""), F.lit(" \t\r\n"))
    braced = F.regexp_extract(t, r"(?s)(\{.*\})", 1)
    return F.coalesce(F.try_parse_json(F.nullif(t, F.lit(""))), F.try_parse_json(F.nullif(fenced, F.lit(""))), F.try_parse_json(F.nullif(braced, F.lit(""))))
