"""The HTTP server and client, and JSON of merges, joins and pivots."""

import json
import threading

import pytest

from latticeq.client import Client
from latticeq.engine import Engine
from latticeq.functions import all_, compare_parent, count_all, criterion, divide, eq, field, fields, gt, integer, min_, sum_
from latticeq.plans import model as M
from latticeq.plans.builder import from_
from latticeq.server import server
from latticeq.sources import codec

amount, least = sum_("amount", "amount"), min_("least", "amount")
ONE = from_("shop").where(criterion("amount", gt(1))).select(["region", "city"], [amount]).rollup("region", "city").build()
TWO = from_("shop").select(["region"], [least]).order_by("region", descending=True).build()
MERGE = M.MergeQuery([ONE, TWO], ["left"])
JOIN = M.JoinQuery(TWO, [(from_("shop").select(["region", "city"], [amount]).build(), "left", None)], criterion("amount", gt(2)), [(field("amount"), M.SimpleOrder(True))], 3)
PIVOT = M.PivotQuery(from_("shop").select(["region", "city"], [amount]).build(), fields("region"), fields("city"), minify=False)
MERGE_PIVOT = M.PivotQuery(M.MergeQuery([PIVOT.query, TWO], ["full"]), fields("region"), fields("city"), fields("city"))


@pytest.fixture(scope="module")
def client(spark):
    engine = Engine(spark)
    opened = []

    def shop():
        opened.append(1)
        return spark.createDataFrame([("north", "oslo", 4.0), ("north", "bergen", 3.0), ("south", "rome", 8.0), ("south", None, 2.0)], "region string, city string, amount double")

    engine.catalog.register_later("shop", shop)
    engine.catalog.register_later("unused", lambda: 1 / 0)
    assert not opened
    running = server(engine, 0)
    threading.Thread(target=running.serve_forever, daemon=True).start()
    yield Client(f"http://127.0.0.1:{running.server_port}", "ann"), engine
    assert len(opened) == 1
    running.shutdown()


@pytest.mark.parametrize("query", [ONE, MERGE, JOIN, PIVOT, MERGE_PIVOT], ids=["query", "merge", "join", "pivot", "merge pivot"])
def test_json_round_trip_and_answers(client, query):
    body = json.loads(json.dumps(codec.encode(query)))
    read = {M.MergeQuery: codec.merge, M.JoinQuery: codec.join, M.PivotQuery: codec.pivot}.get(type(query), codec.query)
    assert read(body) == query
    remote, engine = client
    answer = remote.run(query)
    if query is JOIN:
        assert answer["cells"] == [{"region": "south", "least": 2.0, "city": "rome", "amount": 8.0}, {"region": "north", "least": 3.0, "city": "oslo", "amount": 4.0}, {"region": "north", "least": 3.0, "city": "bergen", "amount": 3.0}]
    else:
        run = engine.pivot if isinstance(query, M.PivotQuery) else engine.merge if query is MERGE else engine.query
        assert answer["cells"] == run(query).cells() and len(answer["cells"]) > 4
    lines = remote.run(query, "text/csv").splitlines()
    assert len(lines) > 2 and remote.run(query, "text/plain").count("\n") >= len(lines)


def test_other_routes_and_errors(client):
    remote, _ = client
    ratio = compare_parent("ratio", "divide", amount, fields("region"))
    assert [x["expression"] for x in remote.expressions([divide("half", amount, integer(2)), ratio])] == ["sum(amount) / 2", "amount / amount(reference)"]
    with pytest.raises(RuntimeError, match="no table nowhere"):
        remote.run(from_("nowhere").select(["a"]).build())
    with pytest.raises(RuntimeError, match="query limit exceeded"):
        remote.run(M.MergeQuery([from_("shop").select(["region"], [amount]).limit(2).build(), TWO], ["full"]))
    with pytest.raises(RuntimeError, match="no route"):
        remote._send("other", {})


def test_nested_joins_and_filters_on_joined_tables(client, spark):
    _, engine = client
    engine.catalog.register("place", spark.createDataFrame([("oslo", "no"), ("rome", "it")], "town string, land string"))
    engine.catalog.register("land", spark.createDataFrame([("no", "Norway"), ("it", "Italy")], "code string, name string"))
    land = M.Join(M.Table("land"), "inner", criterion("place.land", "land.code"))
    q = from_("shop").join(M.Table("place", [land]), "left").on(all_(criterion("shop.city", "place.town"), criterion("shop.region", eq("south")))).select(["name"], [amount, count_all]).build()
    assert [tuple(r) for r in engine.frame(q).collect()] == [("Italy", 8.0, 1)]
