"""Queries on small tables with results worked out by hand or by plain Python."""

import itertools
import json
import random
from collections import defaultdict

import pytest

from latticeq import service
from latticeq.cache import FrameCache
from latticeq.engine import Engine, LimitExceeded
from latticeq.functions import (
    all_, any_, avg, compare_ancestors_total, compare_dimension, compare_grand_total, compare_group, compare_parent, compare_parent_of_axis, compare_period, count_all, count_distinct, criterion, decimal, divide,
    eq, expression, field, fields, gt, in_, integer, like, lit, max_, minus, multiply, not_, null, parametrized, plus, sum_, sum_if, total_count, vector,
)
from latticeq.operators.pivot import grouping_sets
from latticeq.plans import describe
from latticeq.plans import model as M
from latticeq.plans.builder import from_
from latticeq.sources import codec, render

SHOPS = [("north", "oslo", "tea", 4.0, 2), ("north", "oslo", "ink", 1.0, 1), ("north", "bergen", "tea", 3.0, 5), ("south", "rome", "tea", 8.0, 4), ("south", None, "ink", 2.0, 3)]
amount = sum_("amount", "amount")


@pytest.fixture(scope="module")
def engine(spark):
    e = Engine(spark)
    e.catalog.register("shop", spark.createDataFrame(SHOPS, "region string, city string, item string, amount double, n int"))
    e.catalog.register("plan", spark.createDataFrame([("v1", "a", 2, 10), ("v1", "b", 2, 6), ("v2", "a", 3, 7), ("v2", "b", 3, 5), ("v3", "a", 4, 5)], "version string, place string, price int, n int"))
    return e


def rows(result):
    return result.rows()


def test_conditions_and_having(engine):
    where = any_(all_(criterion("region", eq("north")), criterion("amount", gt(1))), criterion("city", null))
    q = from_("shop").where(where).select(["region"], [amount, count_all]).having(criterion(amount, gt(5))).build()
    assert rows(engine.query(q)) == [("north", 7.0, 2)]
    q = from_("shop").where(all_(criterion("item", not_(in_("ink"))), criterion("city", like("%o%")), criterion(lit(5), "n", ">"))).select([], [count_all]).build()
    assert rows(engine.query(q)) == [(2,)]
    with pytest.raises(ValueError):
        rows(engine.query(from_("shop").where(criterion("n", eq(object()))).select([], [count_all]).build()))


def test_rollup_labels_and_null_values_apart(engine):
    q = from_("shop").select(["region", "city"], [amount]).rollup("region", "city").build()
    assert rows(engine.query(q)) == [
        ("Grand Total", "Grand Total", 18.0), ("north", "Total", 8.0), ("north", "bergen", 3.0), ("north", "oslo", 5.0), ("south", "Total", 10.0), ("south", "rome", 8.0), ("south", None, 2.0),
    ]
    cells = engine.query(q).cells()
    assert cells[0] == {"amount": 18.0} and cells[-1] == {"region": "south", "city": None, "amount": 2.0}
    with pytest.raises(ValueError):
        engine.query(from_("shop").select(["region"], [amount]).rollup("item").build())


def test_order_limit_and_total_count(engine):
    q = from_("shop").select(["city"], [amount, total_count]).order_by("amount", descending=True).limit(2).build()
    assert rows(engine.query(q)) == [("rome", 8.0, 4), ("oslo", 5.0, 4)]
    q = from_("shop").select(["city"], [amount]).order_by_elements("city", ["rome", "oslo"]).build()
    assert [r[0] for r in rows(engine.query(q))] == ["rome", "oslo", "bergen", None]
    q = from_("shop").select(["city"], [amount]).order_by("city").build()
    assert [r[0] for r in rows(engine.query(q))] == [None, "bergen", "oslo", "rome"]
    with pytest.raises(LimitExceeded):
        engine.query(from_("shop").select(["city"], [amount]).limit(4).build(), strict_limit=True)


def test_arithmetic_rules(engine):
    a, b = sum_if("a", "amount", criterion("item", eq("tea"))), sum_if("b", "amount", criterion("item", eq("ink")))
    q = from_("shop").select(["city"], [plus("p", a, b), divide("d", a, minus("z", b, b)), multiply("k", integer(2), decimal(1.5))]).build()
    assert rows(engine.query(q)) == [("bergen", None, None, 3.0), ("oslo", 5.0, None, 3.0), ("rome", None, None, 3.0), (None, None, None, 3.0)]
    g = compare_grand_total("g", "divide", a)
    q = from_("shop").select(["city"], [plus("p", g, b)]).build()
    assert rows(engine.query(q)) == [("bergen", 0.2), ("oslo", pytest.approx(4 / 15 + 1)), ("rome", pytest.approx(8 / 15)), (None, 2.0)]


def test_sub_query_and_bucketing(engine):
    inner = from_("shop").select(["region", "city"], [amount]).build()
    assert rows(engine.query(from_(inner).select(["region"], [avg("mean", "amount")]).build())) == [("north", 4.0), ("south", 5.0)]
    with pytest.raises(ValueError):
        engine.query(from_(from_("shop").select(["city"], [compare_grand_total("g", "divide", amount)]).build()).select([], [count_all]).build())
    sizes = M.VirtualTable("sizes", ["size", "low", "high"], [("s", 0, 3), ("l", 3, 100)])
    on = all_(criterion("amount", "low", ">="), criterion("amount", "high", "<"))
    assert rows(engine.query(from_("shop").join(sizes).on(on).select(["size"], [count_all]).build())) == [("l", 3), ("s", 2)]


def test_parent_ratio_clears_filters_on_ancestors(engine):
    places = fields("region", "city")
    q = from_("shop").where(criterion("city", eq("oslo"))).select(places, [amount, compare_parent("r", "divide", amount, places), compare_ancestors_total("g", "divide", amount, places)]).build()
    assert rows(engine.query(q)) == [("north", "oslo", 5.0, 0.625, pytest.approx(5 / 18))]
    q = from_("shop").where(criterion("city", eq("oslo"))).select(places, [compare_parent("r", "divide", amount, places, clear_filters=False), compare_grand_total("g", "divide", amount)]).build()
    assert rows(engine.query(q)) == [("north", "oslo", 1.0, 1.0)]
    q = from_("shop").select(["region", "city"], [compare_parent("r", "divide", amount, places)]).rollup(*places).build()
    assert rows(engine.query(q))[:2] == [("Grand Total", "Grand Total", 1.0), ("north", "Total", pytest.approx(8 / 18))]


def test_group_and_dimension_comparisons(engine):
    revenue = expression("revenue", "sum(price * n)")
    own = field("version")
    g = M.Group("set", own, [("late", ["v3", "v2"]), ("all", ["v1", "v2", "v3"])])
    q = from_("plan").select([], [revenue, compare_group("d", "absolute_difference", revenue, {own: "s-1"}), compare_group("f", "absolute_difference", revenue, {own: "first"})], g).build()
    assert rows(engine.query(q)) == [("late", "v3", 20, 0, 0), ("late", "v2", 36, 16, 16), ("all", "v1", 32, 0, 0), ("all", "v2", 36, 4, 4), ("all", "v3", 20, -16, -12)]
    q = from_("plan").where(criterion("version", eq("v2"))).select(["version"], [revenue, compare_dimension("d", "absolute_difference", revenue, own, "v-1"), compare_dimension("n", "absolute_difference", revenue, own, "v+1")]).build()
    assert rows(engine.query(q)) == [("v2", 36, 4, 16)]
    q = from_("plan").select(["version"], [compare_dimension("d", "absolute_difference", revenue, own, "v-1", elements=["v3"])]).build()
    assert rows(engine.query(q)) == [("v1", 12), ("v2", 4), ("v3", 0)]
    with pytest.raises(ValueError):
        engine.query(from_("plan").select(["version"], [compare_dimension("d", "divide", revenue, own, "v*2")]).build())


@pytest.mark.parametrize(("kind", "per_year"), [(M.Semester, 2), (M.Quarter, 4), (M.Month, 12)])
def test_periods_against_plain_python(engine, spark, kind, per_year):
    rng = random.Random(per_year)
    data = [(rng.randint(2020, 2022), rng.randint(1, per_year), rng.randint(1, 9)) for _ in range(40)]
    engine.catalog.register("sales", spark.createDataFrame(data, "y int, p int, v int"))
    sums = defaultdict(int)
    for y, p, v in data:
        sums[y * per_year + p - 1] += v
    y, p, v = field("y"), field("p"), sum_("v", "v")
    for years, parts in ((0, -1), (-1, 0), (-1, 2)):
        moves = {y: f"y{years:+d}" if years else "y", p: f"p{parts:+d}" if parts else "p"}
        q = from_("sales").select([y, p], [v, compare_period("d", "absolute_difference", v, kind(p, y), moves)]).build()
        want = [(i // per_year, i % per_year + 1, s, s - sums[j] if (j := i + parts + years * per_year) in sums else None) for i, s in sorted(sums.items())]
        assert rows(engine.query(q)) == want
    with pytest.raises(ValueError):
        engine.query(from_("sales").select([y], [compare_period("d", "divide", v, kind(p, y), {y: "y-1"})]).build())


def test_merge_against_plain_python(engine, spark):
    rng = random.Random(5)
    left = [(rng.choice("abc"), rng.choice("xy"), rng.randint(1, 9)) for _ in range(8)]
    right = [(rng.choice("bcd"), rng.randint(1, 9)) for _ in range(8)]
    engine.catalog.register("l", spark.createDataFrame(left, "k string, s string, v int"))
    engine.catalog.register("r", spark.createDataFrame(right, "k string, w int"))
    a = from_("l").select(["k", "s"], [sum_("v", "v")]).rollup("k", "s").build()
    b = from_("r").select(["k"], [sum_("w", "w")]).rollup("k").build()
    one, two = defaultdict(int), defaultdict(int)
    for k, s, v in left:
        for key in ((None, None), (k, None), (k, s)):
            one[key] += v
    for k, w in right:
        two[None, None] += w
        two[k, None] += w
    for how in ("full", "left", "inner"):
        tops_l, tops_r = {k for k, _ in one}, {k for k, _ in two}
        want = set()
        for key in {*one, *two}:
            keep = how == "full" or (key in one and (how == "left" or key[0] in tops_r)) or (key not in one and key[0] in tops_l)
            if keep:
                label = ("Grand Total", "Grand Total") if key == (None, None) else (key[0], key[1] or "Total")
                want.add((*label, one.get(key), two.get(key)))
        assert set(rows(engine.merge(M.MergeQuery([a, b], [how])))) == want
    with pytest.raises(ValueError):
        engine.merge(M.MergeQuery([a, a], ["full"]))


def test_query_join(engine):
    a = from_("shop").select(["region"], [amount]).build()
    b = from_("shop").where(criterion("region", eq("south"))).select(["region", "item"], [sum_("n", "n")]).build()
    out = engine.join(M.JoinQuery(a, [(b, "left", None)], None, [(field("item"), M.SimpleOrder())]))
    assert out.columns == ["region", "item", "amount", "n"]
    assert [tuple(r) for r in out.collect()] == [("north", None, 8.0, None), ("south", "ink", 10.0, 3), ("south", "tea", 10.0, 4)]
    c = from_("plan").select([field("place").as_("region"), "version"], [sum_("n", "n")]).build()
    on = criterion("shop.region", field("plan.place").as_("region"), "<>")
    assert engine.join(M.JoinQuery(a, [(c, "inner", on)], criterion("amount", gt(9)))).count() == 5


def test_query_join_without_limit_gives_all_rows(spark):
    engine = Engine(spark, limit=None)
    engine.catalog.register("many", spark.range(10_050).withColumnRenamed("id", "k"))
    engine.catalog.register("more", spark.range(10_050).withColumnRenamed("id", "k"))
    sides = [from_(t).select(["k"], [sum_(f"{t}_sum", "k")]).build() for t in ("many", "more")]
    q = M.JoinQuery(sides[0], [(sides[1], "inner", None)])
    assert engine.join(q).count() == 10_050
    engine.limit = 10_000
    assert engine.join(q).count() == 10_000
    engine.limit = None
    assert engine.join(M.JoinQuery(sides[0], [(sides[1], "inner", None)], None, [(field("k"), M.SimpleOrder())], 7)).count() == 7


def scans(df):
    """How often each file table is scanned by the executed plan, and how many exchanges are reused."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return plan.count("FileScan"), plan.count("ReusedExchange")


def test_one_aggregation_for_all_readers(spark, tmp_path):
    spark.createDataFrame(SHOPS * 3, "region string, city string, item string, amount double, n int").write.parquet(f"{tmp_path}/shop")
    e = Engine(spark)
    e.catalog.load_file("shop", f"{tmp_path}/shop")
    place = fields("region", "city")
    parent, whole = compare_parent("p", "divide", amount, place), compare_ancestors_total("w", "divide", amount, place)
    # A second measure that no comparison reads must not make another aggregation of the readers' side.
    q = from_("shop").select(place, [amount, max_("top", "n"), parent, whole, compare_grand_total("g", "divide", amount)]).rollup(*place).build()
    assert scans(e.frame(q))[0] == 1
    assert scans(e.frame(from_("shop").select(["city"], [amount, total_count]).build())) == (1, 1)
    axes = from_("shop").select(["region", "item"], [amount, *[compare_parent_of_axis(a, "divide", amount, a) for a in ("row", "column")]]).build()
    assert scans(e.pivot(M.PivotQuery(axes, fields("region"), fields("item"))).frame)[0] == 1
    # Two: the rows' aggregation and the vectors', which has one dimension more.
    v = parametrized("v", "INCREMENTAL_VAR", value=field("amount"), date=field("item"), quantile=0.5, ancestors=place)
    assert scans(e.frame(from_("shop").select(place, [amount, v]).rollup(*place).build()))[0] == 2


def test_limits_are_told(engine, spark):
    told = []
    e = Engine(spark, limit=2, on_limit=told.append)
    e.catalog.register("shop", engine.catalog.table("shop"))
    assert len(rows(e.query(from_("shop").select(["region", "city"], [amount]).build()))) == 2 and told == [2]
    assert len(rows(e.query(from_("shop").select([], [amount]).build()))) == 1 and told == [2]
    e.query(from_("shop").select(["city"], [amount]).limit(3).build()).cells()
    assert told == [2, 3]
    sides = [from_("shop").select(["region", "item"], [m]).build() for m in (amount, max_("top", "n"))]
    merged = M.PivotQuery(M.MergeQuery(sides, ["full"]), fields("region"), fields("item"))
    assert len(rows(engine.pivot(merged, strict_limit=True))) == 9
    with pytest.raises(LimitExceeded):
        e.pivot(merged, strict_limit=True)


def test_joins_need_a_condition_unless_cross(engine):
    for how in ("inner", "left"):
        with pytest.raises(ValueError, match="no condition"):
            engine.query(M.Query(M.Table("shop", [M.Join(M.Table("plan"), how, None)]), fields("region"), [amount]))
    assert len(rows(engine.query(M.Query(M.Table("shop", [M.Join(M.Table("plan"), "cross", None)]), fields("region"), [amount])))) == 2


def test_service_answers_whatever_comes(engine):
    for route, body, status in (("query", "{no json", 400), ("query", b"", 400), ("query", "[]", 400), ("query", None, 400), ("expression", "{}", 200), ("nothing", "{}", 404)):
        assert service.handle(engine, route, body)[0] == status, (route, body)
    unknown = codec.encode(from_("shop").select(["nocolumn"], [amount]).build())
    status, answer = service.handle(engine, "query", json.dumps(unknown))
    assert status == 400 and "nocolumn" in answer["message"]
    failing = codec.encode(from_("shop").select(["region"], [expression("x", "sum(cast(item AS int))")]).build())
    assert service.handle(engine, "query", json.dumps(failing))[0] == 500


def test_cache_among_threads(spark):
    from concurrent.futures import ThreadPoolExecutor

    e = Engine(spark, cache=FrameCache(size=2))
    e.catalog.register("shop", spark.createDataFrame(SHOPS, "region string, city string, item string, amount double, n int"))
    asked = [from_("shop").select([c], [amount]).build() for c in ("region", "city", "item", "n")] * 6
    with ThreadPoolExecutor(8) as pool:
        assert list(pool.map(lambda q: rows(e.query(q)), asked)) == [rows(e.query(q)) for q in asked]
    assert e.cache.stats()["entries"] == 2 and e.cache.hits + e.cache.misses == 48


def test_pivot(engine):
    q = from_("shop").select(["region", "item"], [amount, compare_parent_of_axis("p", "divide", amount, "row")]).build()
    result = engine.pivot(M.PivotQuery(q, fields("region"), fields("item")))
    assert result.matrix() == [
        ["item", "Grand Total", "Grand Total", "ink", "ink", "tea", "tea"], ["region", "amount", "p", "amount", "p", "amount", "p"], ["Grand Total", 18.0, 1.0, 3.0, pytest.approx(1 / 6), 15.0, pytest.approx(5 / 6)],
        ["north", 8.0, 1.0, 1.0, 0.125, 7.0, 0.875], ["south", 10.0, 1.0, 2.0, 0.2, 8.0, 0.8],
    ]
    assert result.json()["rows"] == ["region"]
    for bad in (M.PivotQuery(q, fields("region"), []), M.PivotQuery(q, fields("region"), fields("item", "city"))):
        with pytest.raises(ValueError):
            engine.pivot(bad)


def test_pivot_grouping_sets():
    a, b, c, d = fields("a", "b", "c", "d")
    sets = {frozenset(s) for s in grouping_sets([a, b], [c, d], [])}
    assert sets == {frozenset((*r, *k)) for r in ((), (a,), (a, b)) for k in ((), (c,), (c, d))}
    hidden = {frozenset(s) for s in grouping_sets([a, b], [c, d], [b])}
    assert sets - hidden == {frozenset((a,)), frozenset((a, c)), frozenset((a, c, d))}


def test_vectors_and_value_at_risk(engine, spark):
    data = [(k, d, float(x)) for (k, d), x in zip(itertools.product("ab", range(1, 5)), (3, -1, 4, 1, -5, 9, 2, 6), strict=True)]
    engine.catalog.register("pnl", spark.createDataFrame(data, "k string, d int, x double"))
    by = {k: [x for kk, _, x in data if kk == k] for k in "ab"}
    by["Grand Total"] = [x + y for x, y in zip(by["a"], by["b"], strict=True)]
    x, d = field("x"), field("d")
    m = [vector("v", x, "sum", d), parametrized("var", "VAR", value=x, date=d, quantile=0.75, **{"return": "value"}), parametrized("day", "VAR", value=x, date=d, quantile=0.75, **{"return": "date"}), parametrized("inc", "INCREMENTAL_VAR", value=x, date=d, quantile=0.75, ancestors=[field("k")])]
    got = {r[0]: r[1:] for r in rows(engine.query(from_("pnl").select(["k"], m).rollup("k").build()))}
    for k, v in by.items():
        parent = by["Grand Total"]
        worst = sorted(v)[1]
        rest = [p - (c if k != "Grand Total" else p) for p, c in zip(parent, v, strict=True)]
        assert list(got[k][0]) == v and got[k][1] == -worst and got[k][2] == v.index(worst) + 1
        assert got[k][3] == -(sorted(parent)[1] - sorted(rest)[1])
    with pytest.raises(ValueError, match="Parameter 'value' was expected but not provided"):
        engine.query(from_("pnl").select(["k"], [parametrized("v", "VAR", date=d, quantile=0.5, **{"return": "value"})]).build())


def test_cache(spark):
    now = [0.0]
    e = Engine(spark, cache=FrameCache(size=2, ttl=10, clock=lambda: now[0]))
    e.catalog.register("shop", spark.createDataFrame(SHOPS, "region string, city string, item string, amount double, n int"))
    one = from_("shop").select(["region"], [amount])
    first = rows(e.query(one.build()))
    assert rows(e.query(one.build())) == first and e.cache.hits == 1
    more = from_("shop").select(["region"], [amount, max_("m", "n")]).build()
    assert [r[:2] for r in rows(e.query(more))] == first and e.cache.misses == 2
    rows(e.query(one.build()))
    assert e.cache.hits == 2
    now[0] = 11
    rows(e.query(one.build()))
    assert e.cache.evictions == 1
    rows(e.query(from_("shop").select(["region"], [amount]).parameter("cache", "NOT_USE").build()))
    assert e.cache.stats()["entries"] == 1
    e.cache.clear()
    assert e.cache.stats()["entries"] == 0


def test_codec_round_trip_and_service(engine):
    q = from_("shop").where(all_(criterion("region", in_("north", "south")), criterion("amount", "n", ">"))).select(["region", "item"], [amount, count_distinct("c", "city"), compare_grand_total("g", "divide", amount)]).rollup("region", "item").order_by("region", True).limit(9).build()
    body = json.loads(json.dumps(codec.encode(q)))
    assert codec.query(body) == q
    prefixed = json.loads(json.dumps(codec.encode(q)).replace('"@class": "', '"@class": "some.package.'))
    assert codec.query(prefixed).measures == q.measures
    status, answer = service.handle(engine, "/query", json.dumps(body))
    assert status == 200 and answer["columns"] == ["region", "item", "amount", "c", "g"]
    assert service.handle(engine, "query", body, "text/csv")[1].splitlines()[0] == "region,item,amount,c,g"
    assert service.handle(engine, "nowhere", body)[0] == 404
    assert service.handle(engine, "query", {**body, "table": {"name": "missing"}})[0] == 400
    assert "shop" in {s["name"] for s in service.handle(engine, "metadata")[1]["stores"]}
    assert {f.name for f in describe.dependencies(q)} == {"region", "item", "amount", "city", "n"}
    assert describe.formula(divide("d", amount, integer(2))) == "sum(amount) / 2"


def test_explain_and_write(engine, tmp_path):
    places = fields("region", "city")
    q = from_("shop").where(all_(criterion("city", eq("oslo")), criterion("n", "amount", "<"))).select(places, [amount, compare_parent("r", "divide", amount, places), compare_grand_total("g", "divide", amount)]).build()
    assert engine.explain(q).splitlines() == [
        "scope 1: (city = 'oslo' and n < amount)", "  by (region, city)", "  amount = sum(amount)", "scope 2: n < amount", "  by (region, city)", "  by (region)", "  by ()", "  amount = sum(amount)",
        "scope 3: (city = 'oslo' and n < amount)", "  by ()", "  amount = sum(amount)", "measures:", "  amount = sum(amount)", "  r = amount / amount(reference)", "  g = amount / amount(grand total)",
    ]
    engine.query(from_("shop").select(["region"], [amount]).build()).write(str(tmp_path / "out"), "csv", header=True)
    engine.catalog.load_csv("again", str(tmp_path / "out"), inferSchema=True)
    assert rows(engine.query(from_("again").select(["region"], [amount]).build())) == [("north", 8.0), ("south", 10.0)]


def test_rendering():
    assert render.csv(["a", "b"], [['x"y', 1], ["p,q", None]]) == 'a,b\nx""y,1\n"p,q",null'
    assert render.text(["a"], [[1], [22]]).splitlines()[3:5] == ["|  1 |", "| 22 |"]


def test_loaders(engine, tmp_path, spark):
    (tmp_path / "t.csv").write_text("a;b\n1;x\n2;y\n")
    engine.catalog.load_csv("csv", str(tmp_path / "t.csv"), delimiter=";")
    assert rows(engine.query(from_("csv").select(["a", "b"]).build())) == [("1", "x"), ("2", "y")]
    engine.catalog.create("new", "a long, b string")
    engine.catalog.load("new", [(1, "p")])
    engine.catalog.load("new", [(2, "q")])
    assert rows(engine.query(from_("new").select([], [sum_("s", "a")]).build())) == [(3,)]
    engine.query(from_("new").select(["b"], [count_all]).build()).frame.write.parquet(str(tmp_path / "p"))
    engine.catalog.load_file("again", str(tmp_path / "p"))
    assert engine.sql("SELECT count(*) AS n FROM again").first()["n"] == 2


def test_streaming(engine, spark, tmp_path):
    from latticeq.streaming import continuous

    spark.createDataFrame(SHOPS, "region string, city string, item string, amount double, n int").write.parquet(str(tmp_path / "in"))
    engine.catalog.register("stream", spark.readStream.schema("region string, city string, item string, amount double, n int").parquet(str(tmp_path / "in")))
    out = continuous(engine.catalog, from_("stream").where(criterion("n", gt(1))).select(["region"], [amount]).build())
    run = out.writeStream.format("memory").queryName("sums").outputMode("complete").start()
    run.processAllAvailable()
    run.stop()
    assert {tuple(r) for r in spark.table("sums").collect()} == {("north", 7.0), ("south", 10.0)}
    with pytest.raises(ValueError):
        continuous(engine.catalog, from_("stream").select(["region"], [compare_grand_total("g", "divide", amount)]).build())
