import json

import pytest

from plumbline.plans import params
from plumbline.plans.service import SearchClient, SearchService, is_query_response, is_request, is_response
from plumbline.sources import dataset
from plumbline.sources.io import as_json, load_with_progress, read_json_records, read_or_generate, records_from_rows, summary, write_json_array
from plumbline.streaming.requests import answer_stream, latest_requests, read_requests, stale_answers


# Names of parameters and messages, and what the contract says of malformed ones.


def test_bodies():
    assert params.parse_query_body("{}") == {"query": ""}
    assert params.parse_query_body('{"query":"a","page":1,"facetFilters":[["genre:x"]]}')["page"] == 1
    bad = ["null", "[]", '"x"', "1", "{", '{"query":1}', '{"page":-1}', '{"page":"1"}', '{"page":1e309}', '{"page":true}', '{"hitsPerPage":0}', '{"snippetLength":0}', '{"typoTolerance":1}',
           '{"facets":"genre"}', '{"facets":[1]}', '{"facetFilters":["genre:x"]}', '{"facetFilters":[[1]]}', '{"page":null}']
    for body in bad:
        with pytest.raises(params.InvalidParams):
            params.parse_query_body(body)


def test_bounds_and_strings():
    assert [params.bounded_integer(v, 20, 1, 100) for v in (1.9, 0, 1e308, float("nan"), "7", None, True)] == [1, 1, 100, 20, 20, 20, 20]
    got = params.serialize_params({"query": "a b'é", "facetFilters": [["genre:x y"]], "facets": ["genre", "decade"], "typoTolerance": False}, 5, 2)
    assert got == "query=a%20b'%C3%A9&hitsPerPage=5&page=2&facetFilters=%5B%5B%22genre%3Ax%20y%22%5D%5D&facets=genre%2Cdecade&typoTolerance=false"


def test_urls():
    state = params.parse_search_params("?q=kettle&genre=Noir,Spy&genre=%20Spy%20&rating=8%E2%80%939&page=4.2&explain=7")
    assert (state.query, state.page, state.explain) == ("kettle", 4, 7)
    assert state.refinements == {"genre": ["Noir", "Spy"], "decade": [], "rating": ["8–9"]}
    assert params.parse_search_params("page=x&explain=0").page == 0 and params.parse_search_params("explain=0").explain is None
    again = params.parse_search_params(params.serialize_search_params(state))
    assert (again.query, again.refinements, again.page) == (state.query, state.refinements, 4)
    assert params.serialize_search_params(params.SearchState()) == "" and params.count_refinements(state.refinements) == 3
    asked = params.to_query_params(state)
    assert asked["facetFilters"] == [["genre:Noir", "genre:Spy"], ["rating:8–9"]] and params.is_query_params(asked)
    off = params.toggle_refinement(state.refinements, "genre", "Spy")
    assert off["genre"] == ["Noir"] and params.toggle_refinement(off, "genre", "War")["genre"] == ["Noir", "War"]
    assert "curl -X POST" in params.request_as_curl({"query": "it's"})


def test_service_and_client(spark):
    from plumbline.plans.engine import SearchEngine

    def load(url):
        if url == "bad":
            raise OSError("no such file")
        return SearchEngine.from_records(records_from_rows(spark, dataset.generate_records(1, 30)))

    service = SearchService(load)
    query = {"type": "query", "id": 1, "params": {"query": "the"}}
    assert is_request(query) and not is_request({"type": "query", "id": -1, "params": {"query": ""}}) and not is_request([])
    assert next(service.handle(query))["type"] == "error"
    assert [m["type"] for m in service.handle({"type": "init", "url": "bad"})] == ["progress", "error"]
    assert [m["type"] for m in service.handle({"type": "init", "url": "x"})] == ["progress", "ready"]
    assert next(service.handle({"type": "query", "id": 7, "params": {}})) == {"type": "error", "message": "malformed request", "id": 7}
    answer = next(service.handle(query))
    assert is_response(answer) and is_query_response(answer["response"]) and not is_response({"type": "result", "id": 1, "response": {}})
    client = SearchClient(service, threads=1)
    first, second, other = client.query({"query": "a"}), client.query({"query": "b"}), client.query({"query": "c"}, "playground")
    assert [f.result().stale for f in (first, second, other)][1:] == [False, False]
    with pytest.raises(params.InvalidParams):
        client.query({})
    client.close()
    with pytest.raises(RuntimeError):
        client.query({"query": "a"})


def test_dataset(spark, tmp_path):
    rows = dataset.generate_records(5, 400)
    assert rows == dataset.generate_records(5, 400) != dataset.generate_records(6, 400)
    assert len({r["id"] for r in rows}) == len({r["title"].lower() for r in rows}) == 400
    assert all(1850 <= r["year"] < 2030 and 0 <= r["rating"] <= 10 and r["popularity"] > 0 and 1 <= len(r["genres"]) <= 3 for r in rows)
    rng = dataset.Xoshiro(1)
    draws = [rng.random() for _ in range(20_000)]
    assert abs(sum(draws) / len(draws) - 0.5) < 0.01 and all(0 <= d < 1 for d in draws)
    # The first numbers of the public algorithm after the state 1, 2, 3, 4.
    rng._words = [1, 2, 3, 4]
    assert [rng._next() for _ in range(3)] == [11520, 0, 5927040]
    mix = dataset.query_mix(rows, 300)
    assert {q.kind for q in mix} == set(dataset.KINDS) and mix == dataset.query_mix(rows, 300)
    assert dataset.percentile([1, 2, 3, 4], 50) == 3 and dataset.percentile([1], 99) == 1
    df = records_from_rows(spark, rows)
    path = str(tmp_path / "records.json")
    write_json_array(df.drop("doc_ord"), path)
    assert json.load(open(path))[0] == rows[0]
    assert read_json_records(spark, path).count() == 400 and read_or_generate(spark, path, list).count() == 400 and read_or_generate(spark, "/none", lambda: rows[:3]).count() == 3
    told = []
    assert load_with_progress(df, lambda done, of: told.append((done, of)), 0.01).count() == 400 and told[-1][0] <= told[-1][1]
    with pytest.raises(Exception, match="divide|DIVIDE"):
        load_with_progress(df.selectExpr("1 / (year - year) x"), lambda done, of: None)
    one = summary(df).first()
    assert one.records == 400 and one.first_year == min(r["year"] for r in rows) and one.genres == len({g for r in rows for g in r["genres"]})
    assert json.loads(as_json(df.limit(1)).first()["json"])["id"] == "item-000000"


REQUESTS = "request_id bigint, channel string, query string, page double, hits_per_page double, typo_tolerance boolean, facet_filters array<array<string>>"


def test_latest_and_stale(spark):
    rows = [(1, "search", 0, 9), (2, "search", 1, 5), (3, "playground", 2, 6), (4, None, 0, 1), (5, "search", None, None)]
    df = spark.createDataFrame(rows, "request_id bigint, channel string, s int, a int").selectExpr(
        "request_id", "channel", "timestamp_seconds(s * 1000) sent_at", "timestamp_seconds(a * 1000) arrived_at"
    )
    assert {(r.channel, r.request_id) for r in latest_requests(df).collect()} == {("search", 5), ("playground", 3), (None, 4)}
    assert {r.request_id: r.stale for r in stale_answers(df).collect()} == {1: True, 2: False, 3: False, 4: False, 5: False}


def test_streamed_answers(spark, tmp_path):
    from plumbline.operators.index import build_index

    index = build_index(records_from_rows(spark, dataset.generate_records(1, 50)))
    rows = [(i, "search", q, 0.0, 5.0, True, None) for i, q in enumerate(["the", "and", "", "the"])]
    df = spark.createDataFrame(rows + rows[:1], REQUESTS)
    df.repartition(1).write.parquet(str(tmp_path / "in"))
    seen = {}
    stream = answer_stream(read_requests(spark, str(tmp_path / "in"), df.schema), index, lambda hits, epoch: seen.setdefault(epoch, hits.collect()), str(tmp_path / "state"))
    stream.awaitTermination()
    got = [r for hits in seen.values() for r in hits]
    assert {r.request_id for r in got} == {0, 1, 2, 3} and max(r.hit_pos for r in got) <= 4
