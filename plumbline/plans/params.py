"""Requests: validation, canonical strings and the URL codec."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field
from urllib.parse import parse_qsl, quote, urlencode

FACET_NAMES = ("genre", "decade", "rating")
#: What a percent-encoded value keeps.
_KEPT = "!~*'()"


class InvalidParams(ValueError):
    pass


def _number(value: object, low: float) -> bool:
    return isinstance(value, int | float) and not isinstance(value, bool) and math.isfinite(value) and value >= low


def _texts(value: object) -> bool:
    return isinstance(value, list) and all(isinstance(x, str) for x in value)


_FIELDS = {
    "page": lambda v: _number(v, 0),
    "hitsPerPage": lambda v: _number(v, 1),
    "snippetLength": lambda v: _number(v, 1),
    "typoTolerance": lambda v: isinstance(v, bool),
    "facets": _texts,
    "facetFilters": lambda v: isinstance(v, list) and all(map(_texts, v)),
}


def is_query_params(value: object) -> bool:
    if not isinstance(value, dict) or not isinstance(value.get("query"), str):
        return False
    return all(check(value[name]) for name, check in _FIELDS.items() if name in value)


def parse_query_body(body: str) -> dict:
    """A JSON body to parameters; the query may be missing, anything malformed raises."""
    try:
        value = json.loads(body)
    except ValueError as e:
        raise InvalidParams(f"not JSON: {e}") from e
    if not isinstance(value, dict):
        raise InvalidParams("the body must be a JSON object")
    params = {"query": "", **value}
    if not is_query_params(params):
        raise InvalidParams("query must be a string, page a finite number from 0, sizes from 1, facets strings and facetFilters lists of strings")
    return params


def bounded_integer(value: object, fallback: int, low: int, high: int) -> int:
    return min(high, max(low, math.floor(value))) if _number(value, -math.inf) else fallback


def percent_encode(text: str) -> str:
    return quote(text, safe=_KEPT)


def serialize_params(params: dict, hits_per_page: int, page: int) -> str:
    """The parameters as they were applied, in a fixed order."""
    parts = [("query", percent_encode(params.get("query") or "")), ("hitsPerPage", hits_per_page), ("page", page)]
    if params.get("facetFilters"):
        parts.append(("facetFilters", percent_encode(json.dumps(params["facetFilters"], ensure_ascii=False, separators=(",", ":")))))
    if params.get("facets") is not None:
        parts.append(("facets", percent_encode(",".join(params["facets"]))))
    if params.get("typoTolerance") is False:
        parts.append(("typoTolerance", "false"))
    return "&".join(f"{k}={v}" for k, v in parts)


@dataclass
class SearchState:
    query: str = ""
    refinements: dict[str, list[str]] = field(default_factory=lambda: {n: [] for n in FACET_NAMES})
    page: int = 0
    explain: int | None = None


def _positive(text: str | None, low: float) -> int | None:
    """The floor of a number that is at least ``low``."""
    try:
        value = float((text or "").strip() or 0)
    except ValueError:
        return None
    return math.floor(value) if math.isfinite(value) and value >= low else None


def parse_search_params(search: str) -> SearchState:
    """URL to state: values may repeat and be comma-separated; garbage numbers are ignored."""
    pairs = parse_qsl(search.removeprefix("?"), keep_blank_values=True)
    first: dict[str, str] = {}
    for name, value in pairs:
        first.setdefault(name, value)
    chosen = {n: [p.strip() for k, v in pairs if k == n for p in v.split(",")] for n in FACET_NAMES}
    return SearchState(
        first.get("q", ""), {n: list(dict.fromkeys(filter(None, v))) for n, v in chosen.items()}, _positive(first.get("page"), 0) or 0, _positive(first.get("explain"), 1)
    )


def serialize_search_params(state: SearchState) -> str:
    pairs = [("q", state.query)] if state.query else []
    pairs += [(name, value) for name in FACET_NAMES for value in state.refinements[name]]
    if state.page > 0:
        pairs.append(("page", str(state.page)))
    return "?" + urlencode(pairs, safe="*") if pairs else ""


def to_facet_filters(refinements: dict[str, list[str]]) -> list[list[str]]:
    return [[f"{name}:{value}" for value in refinements[name]] for name in FACET_NAMES if refinements[name]]


def to_query_params(state: SearchState, hits_per_page: int = 20) -> dict:
    filters = to_facet_filters(state.refinements)
    params = {"query": state.query, "hitsPerPage": hits_per_page, "page": state.page, "facets": list(FACET_NAMES)}
    return params | ({"facetFilters": filters} if filters else {})


def toggle_refinement(refinements: dict[str, list[str]], facet: str, value: str) -> dict[str, list[str]]:
    now = refinements[facet]
    return refinements | {facet: [v for v in now if v != value] if value in now else [*now, value]}


def count_refinements(refinements: dict[str, list[str]]) -> int:
    return sum(len(refinements[name]) for name in FACET_NAMES)


def request_as_curl(params: dict, index: str = "records") -> str:
    body = json.dumps(params, ensure_ascii=False).replace("'", "'\\''")
    return f"curl -X POST http://localhost/1/indexes/{index}/query -H 'Content-Type: application/json' -d '{body}'"
