"""Messages to an engine: one initialisation, then queries answered by id, with errors that stay with their query."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field

from plumbline.plans.engine import SearchEngine
from plumbline.plans.params import InvalidParams, is_query_params


def _id(value: object) -> bool:
    return isinstance(value, int) and not isinstance(value, bool) and value >= 0


def is_request(message: object) -> bool:
    if not isinstance(message, dict):
        return False
    if message.get("type") == "init":
        return isinstance(message.get("url"), str)
    return message.get("type") == "query" and _id(message.get("id")) and is_query_params(message.get("params"))


_RESPONSE_FIELDS = {"hits": list, "nbHits": int, "page": int, "nbPages": int, "hitsPerPage": int, "query": str, "params": str, "facets": dict, "parsedQuery": list, "suggestions": list}


def is_hit(value: object) -> bool:
    if not isinstance(value, dict) or not isinstance(value.get("objectID"), str):
        return False
    return all(isinstance(value.get(k), dict) for k in ("_highlightResult", "_snippetResult", "_rankingInfo"))


def is_query_response(value: object) -> bool:
    return isinstance(value, dict) and all(isinstance(value.get(k), t) for k, t in _RESPONSE_FIELDS.items()) and all(map(is_hit, value["hits"]))


def is_response(message: object) -> bool:
    if not isinstance(message, dict):
        return False
    kind = message.get("type")
    if kind == "progress":
        return isinstance(message.get("phase"), str)
    if kind == "ready":
        return isinstance(message.get("stats"), dict)
    if kind == "error":
        return isinstance(message.get("message"), str) and ("id" not in message or _id(message["id"]))
    return kind == "result" and _id(message.get("id")) and is_query_response(message.get("response"))


def request_id(message: object) -> int | None:
    found = message.get("id") if isinstance(message, dict) else None
    return found if _id(found) else None


class SearchService:
    """Handles one message at a time; ``load`` makes the engine of a url."""

    def __init__(self, load: Callable[[str], SearchEngine]):
        self.load, self.engine = load, None

    def handle(self, message: object) -> Iterator[dict]:
        if not is_request(message):
            at = request_id(message)
            yield {"type": "error", "message": "malformed request"} | ({} if at is None else {"id": at})
        elif message["type"] == "init":
            yield from self._init(message["url"])
        else:
            yield self._query(message["id"], message["params"])

    def _init(self, url: str) -> Iterator[dict]:
        if self.engine is not None:
            yield {"type": "error", "message": "initialised already"}
            return
        yield {"type": "progress", "phase": "index"}
        try:
            self.engine = self.load(url)
            yield {"type": "ready", "stats": self.engine.stats()}
        except Exception as e:  # noqa: BLE001 - whatever fails is told to the client
            self.engine = None
            yield {"type": "error", "message": str(e)}

    def _query(self, at: int, params: dict) -> dict:
        if self.engine is None:
            return {"type": "error", "id": at, "message": "the index isn't ready"}
        try:
            return {"type": "result", "id": at, "response": self.engine.search(params).to_dict()}
        except Exception as e:  # noqa: BLE001
            return {"type": "error", "id": at, "message": str(e)}


@dataclass
class Answer:
    response: dict
    stale: bool


@dataclass
class SearchClient:
    """Sends queries to a service in threads; an answer is stale if its channel has asked again since."""

    service: SearchService
    threads: int = 4
    latest: dict[str, int] = field(default_factory=dict)
    closed: bool = False

    def __post_init__(self) -> None:
        self._ids, self._pool = itertools.count(1), ThreadPoolExecutor(self.threads)

    def query(self, params: dict, channel: str = "search") -> Future[Answer]:
        if self.closed:
            raise RuntimeError("the client is closed")
        if not is_query_params(params):
            raise InvalidParams("invalid query parameters")
        at = next(self._ids)
        self.latest[channel] = at
        return self._pool.submit(self._ask, at, params, channel)

    def _ask(self, at: int, params: dict, channel: str) -> Answer:
        (answer,) = self.service.handle({"type": "query", "id": at, "params": params})
        if not is_response(answer):
            raise RuntimeError("invalid response")
        if answer["type"] == "error":
            raise RuntimeError(answer["message"])
        return Answer(answer["response"], self.latest[channel] != at)

    def close(self) -> None:
        self.closed = True
        self._pool.shutdown(cancel_futures=True)
