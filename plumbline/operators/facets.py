"""Facet filters and live, disjunctive facet counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.index import RATING_BUCKETS

COLLAPSED = 8


def parse_filters(groups: list[list[str]] | None) -> dict[str, list[str]]:
    """``[["facet:value", ...], ...]`` to facet -> values.  Groups of one facet merge; items without a name are skipped."""
    out: dict[str, list[str]] = {}
    for group in groups or []:
        for item in group or []:
            name, colon, value = (item or "").partition(":")
            if colon and name:
                out.setdefault(name, []).append(value)
    return out


def selections(filters: Column) -> Column:
    """``parse_filters`` as an expression over an array<array<string>>: a map facet -> sorted distinct values."""
    items = F.filter(F.flatten(F.filter(F.coalesce(filters, F.array().cast("array<array<string>>")), lambda g: g.isNotNull())), lambda x: F.locate(":", x) > 1)
    name = lambda x: F.substring_index(x, ":", 1)
    names = F.array_sort(F.array_distinct(F.transform(items, name)))
    values = lambda n: F.transform(F.filter(items, lambda x: name(x) == n), lambda x: F.substring(x, F.length(name(x)) + 2, F.length(x)))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.array_sort(F.array_distinct(values(n)))))


def failed(facets: Column, selected: Column) -> Column:
    """The selected facets of which a document has none of the values; unknown facets always fail."""
    return F.filter(F.map_keys(selected), lambda f: ~F.coalesce(F.arrays_overlap(F.try_element_at(facets, f), F.try_element_at(selected, f)), F.lit(False)))


def filtered(matches: DataFrame, selected: str = "selected", facets: str = "facets") -> DataFrame:
    """The rows that pass every selected facet: any of its values, and all facets."""
    return matches.filter(F.size(failed(F.col(facets), F.col(selected))) == 0)


def facet_counts(matches: DataFrame, key: str, selected: str = "selected", facets: str = "facets", wanted: Column | None = None) -> DataFrame:
    """``(key, facet, value, n)`` of ``matches(key, selected, facets)``, one row per query and matching document.

    A value is counted under the filters of all other facets.  All facets are
    counted in one pass: a document with one failed facet still counts for that facet.
    ``wanted`` is a boolean over ``facet``.
    """
    missed = matches.select(key, facets, failed(F.col(facets), F.col(selected)).alias("__f")).filter(F.size("__f") <= 1)
    each = missed.select(key, "__f", F.explode(facets).alias("facet", "values"))
    each = each.filter((F.size("__f") == 0) | (F.get("__f", F.lit(0)) == F.col("facet")))
    if wanted is not None:
        each = each.filter(wanted)
    return each.select(key, "facet", F.explode("values").alias("value")).groupBy(key, "facet", "value").agg(F.count("*").alias("n"))


def with_selected(counts: DataFrame, chosen: DataFrame, known: DataFrame, key: str, wanted: Column | None = None) -> DataFrame:
    """``counts`` and the selected values ``chosen(key, selected)`` that exist, as ``known(facet, value)``, but count nothing."""
    asked = chosen.select(key, F.explode("selected").alias("facet", "values")).select(key, "facet", F.explode("values").alias("value")).distinct()
    if wanted is not None:
        asked = asked.filter(wanted)
    kept = asked.join(known.select("facet", "value").distinct(), ["facet", "value"], "left_semi")
    none = kept.join(counts, [key, "facet", "value"], "left_anti").select(key, "facet", "value", F.lit(0).cast("bigint").alias("n"))
    return counts.unionByName(none)


def display_order(facet: str, counts: dict[str, int], chosen: list[str], limit: int | None = COLLAPSED) -> list[tuple[str, int]]:
    """The values of a facet as they are shown, the first ``limit`` of them."""
    rows = list(counts.items())
    if facet == "decade":
        rows.sort(key=lambda x: x[0], reverse=True)
    elif facet == "rating":
        rows.sort(key=lambda x: RATING_BUCKETS.index(x[0]) if x[0] in RATING_BUCKETS else -1)
    else:
        rows.sort(key=lambda x: (x[0] not in chosen, -x[1], x[0]))
    return rows[:limit]
