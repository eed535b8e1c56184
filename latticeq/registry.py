"""Registered queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .functions import (
    aggregate, all_, any_, any_value, avg, avg_if, call, compare_ancestors_total, compare_dimension, compare_grand_total, compare_group, compare_parent, compare_parent_of_axis,
    compare_period, compare_total_of_axis, contains, count, count_all, count_distinct, count_distinct_if, count_if, criterion, current_date, decimal, divide, eq, expression, field, fields, ge, gt, in_, integer,
    le, like, lit, lower, lt, max_, max_if, min_, min_if, minus, month, multiply, neq, not_, not_in, not_null, or_, parametrized, plus, quarter, sum_, sum_if, total_count, trim, upper, vector, year, null, and_,
    relative_difference, abs_, true, false,
)
from .plans import model as M
from .plans.builder import from_

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    e = Engine(spark, limit=None)
    for name in TABLES:
        e.catalog.register_later(name, lambda name=name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
    return e


def query(name: str, sql: str | None, **places: int):
    """Registers a function of the engine; ``places`` are the decimals that columns are rounded to."""

    def add(make: Callable[[Engine], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = make(engine(spark, sf_dir))
            return df.withColumns({c: F.round(F.col(c), n) for c, n in places.items()}) if places else df

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return make

    return add


qty, price, disc = fields("l_quantity", "l_extendedprice", "l_discount")
flag, status = fields("l_returnflag", "l_linestatus")
total_qty = sum_("qty", qty)


@query("agg_basic", """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) qty, round(avg(l_extendedprice), 4) price, count(l_discount) n, min(l_tax) lo, max(l_tax) hi, count(*) _contributors_count_
  FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""", qty=2, price=4)
def _(e):
    import datetime

    where = criterion("l_shipdate", le(datetime.datetime(1998, 9, 2)))
    return e.frame(from_("lineitem").where(where).select([flag, status], [total_qty, avg("price", price), count("n", disc), min_("lo", "l_tax"), max_("hi", "l_tax"), count_all]).build())


@query("scan_filter", """SELECT o_orderpriority, count(*) _contributors_count_ FROM orders WHERE (o_orderstatus IN ('F', 'P') AND o_totalprice > 1000 AND NOT o_orderpriority LIKE '5%') OR o_totalprice BETWEEN 10 AND 500 GROUP BY ALL""")
def _(e):
    one = all_(criterion("o_orderstatus", in_("F", "P")), criterion("o_totalprice", gt(1000)), criterion("o_orderpriority", not_(like("5%"))))
    return e.frame(from_("orders").where(any_(one, criterion("o_totalprice", and_(ge(10), le(500))))).select(["o_orderpriority"], [count_all]).build())


@query("predicates", """SELECT count(*) _contributors_count_ FROM lineitem WHERE l_returnflag NOT IN ('A') AND l_linestatus <> 'X' AND l_shipdate IS NOT NULL AND (l_quantity < 10 OR l_quantity > 40) AND l_tax < l_discount AND l_tax IS NOT NULL AND 5 < l_quantity""")
def _(e):
    where = all_(criterion(flag, not_in("A")), criterion(status, neq("X")), criterion("l_shipdate", not_null), criterion(qty, or_(lt(10), gt(40))), criterion("l_tax", "l_discount", "<"), criterion("l_tax", not_(null)), criterion(lit(5), qty, "<"))
    return e.frame(from_("lineitem").where(where).select([], [count_all]).build())


@query("discovery_distinct", "SELECT DISTINCT c_mktsegment, c_nationkey AS nation FROM customer")
def _(e):
    return e.frame(from_("customer").select(["c_mktsegment", field("c_nationkey").as_("nation")]).build())


@query("agg_if", """SELECT l_returnflag, sum(CASE WHEN l_linestatus = 'O' THEN l_quantity END) s, round(avg(CASE WHEN l_quantity >= 25 THEN l_extendedprice END), 4) a, count(CASE WHEN l_quantity >= 25 AND l_linestatus = 'F' THEN l_tax END) c,
  min(CASE WHEN l_linestatus = 'O' THEN l_tax END) lo, max(CASE WHEN l_linestatus = 'O' THEN l_tax END) hi FROM lineitem GROUP BY ALL""", a=4)
def _(e):
    open_, large = criterion(status, eq("O")), criterion(qty, ge(25))
    return e.frame(from_("lineitem").select([flag], [sum_if("s", qty, open_), avg_if("a", price, large), count_if("c", "l_tax", all_(large, criterion(status, eq("F")))), min_if("lo", "l_tax", open_), max_if("hi", "l_tax", open_)]).build())


@query("count_distinct", "SELECT l_returnflag, count(DISTINCT l_suppkey) n, count(DISTINCT CASE WHEN l_quantity > 40 THEN l_partkey END) m FROM lineitem GROUP BY ALL")
def _(e):
    return e.frame(from_("lineitem").select([flag], [count_distinct("n", "l_suppkey"), count_distinct_if("m", "l_partkey", criterion(qty, gt(40)))]).build())


@query("any_value", "SELECT n_nationkey, any_value(n_name) n, any_value(n_regionkey) r FROM nation GROUP BY ALL")
def _(e):
    return e.frame(from_("nation").select(["n_nationkey"], [any_value("n", "n_name"), aggregate("r", "n_regionkey", "any_value", distinct=True)]).build())


@query("stats_aggs", """SELECT l_returnflag, round(stddev_pop(l_quantity), 6) a, round(stddev_samp(l_quantity), 6) b, round(var_pop(l_quantity), 5) c, round(var_samp(l_quantity), 5) d, median(l_quantity) e, sum(DISTINCT l_quantity) f, round(corr(l_quantity, l_extendedprice), 6) g FROM lineitem GROUP BY ALL""", a=6, b=6, c=5, d=5, g=6)
def _(e):
    named = [aggregate(a, qty, f) for a, f in zip("abcde", ["stddev_pop", "stddev_samp", "var_pop", "var_samp", "median"], strict=True)]
    return e.frame(from_("lineitem").select([flag], [*named, aggregate("f", qty, "sum", distinct=True), expression("g", "corr(l_quantity, l_extendedprice)")]).build())


@query("field_arithmetic", """SELECT l_returnflag, round(sum(l_extendedprice * (1 - l_discount)), 2) revenue, round(sum(l_extendedprice / nullif(l_quantity, 0)), 2) unit, round(sum((l_extendedprice - l_tax) / nullif(l_tax, 0)), 1) rel FROM lineitem GROUP BY ALL""", revenue=2, unit=2, rel=1)
def _(e):
    net = multiply(price, minus(lit(1), disc))
    return e.frame(from_("lineitem").select([flag], [sum_("revenue", net), sum_("unit", divide(price, qty)), sum_("rel", relative_difference(price, field("l_tax")))]).build())


@query("expression_measure", "SELECT l_linestatus, round(sum(l_extendedprice * l_discount) / sum(l_quantity), 6) x, count(*) FILTER (WHERE l_tax > 0.05) y FROM lineitem GROUP BY ALL", x=6)
def _(e):
    return e.frame(from_("lineitem").select([status], [expression("x", "sum(l_extendedprice * l_discount) / sum(l_quantity)"), expression("y", "count(*) FILTER (WHERE l_tax > 0.05)")]).build())


@query("binary_measures", """SELECT l_returnflag, sum(l_quantity) qty, count(*) _contributors_count_, round(sum(l_quantity) / count(*), 6) per, round((sum(l_quantity) - count(*)) / count(*), 6) rel, sum(l_quantity) + count(*) plus, 2 * count(*) twice, CAST(1.5 * count(*) AS DOUBLE) more FROM lineitem GROUP BY ALL""", per=6, rel=6)
def _(e):
    m = [total_qty, count_all, divide("per", total_qty, count_all), relative_difference("rel", total_qty, count_all), plus("plus", total_qty, count_all), multiply("twice", integer(2), count_all), multiply("more", decimal(1.5), count_all)]
    return e.frame(from_("lineitem").select([flag], m).build())


@query("having", "SELECT l_suppkey, sum(l_quantity) qty FROM lineitem GROUP BY ALL HAVING sum(l_quantity) > 1000 AND (count(*) > 20 OR avg(l_tax) < 0.04)")
def _(e):
    keep = all_(criterion(total_qty, gt(1000)), any_(criterion(count_all, gt(20)), criterion(avg("t", "l_tax"), lt(0.04))))
    return e.frame(from_("lineitem").select(["l_suppkey"], [total_qty]).having(keep).build())


@query("join_inner", """SELECT r_name, n_name, count(*) _contributors_count_, round(sum(c_acctbal), 2) bal FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey AND r_name <> 'ASIA' GROUP BY ALL""", bal=2)
def _(e):
    q = from_("customer").join("nation").on(criterion("customer.c_nationkey", "nation.n_nationkey")).join("region").on(all_(criterion("nation.n_regionkey", "region.r_regionkey"), criterion("region.r_name", neq("ASIA"))))
    return e.frame(q.select(["r_name", "n_name"], [count_all, sum_("bal", "c_acctbal")]).build())


@query("join_left", "SELECT c_mktsegment, count(o_orderkey) orders, count(*) _contributors_count_ FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000 GROUP BY ALL")
def _(e):
    on = all_(criterion("customer.c_custkey", "orders.o_custkey"), criterion("orders.o_totalprice", gt(200000)))
    return e.frame(from_("customer").join("orders", "left").on(on).select(["c_mktsegment"], [count("orders", "o_orderkey"), count_all]).build())


@query("join_full", "SELECT r_name, n_name FROM region FULL JOIN nation ON r_regionkey = n_regionkey AND n_nationkey > 12 GROUP BY ALL")
def _(e):
    on = all_(criterion("region.r_regionkey", "nation.n_regionkey"), criterion("nation.n_nationkey", gt(12)))
    return e.frame(from_("region").join("nation", "full").on(on).select(["r_name", "n_name"]).build())


@query("join_cross", "SELECT a.r_name, count(*) _contributors_count_ FROM region a CROSS JOIN nation GROUP BY ALL")
def _(e):
    return e.frame(from_("region").join("nation", "cross").select(["r_name"], [count_all]).build())


BUCKETS = M.VirtualTable("sizes", ["bucket", "low", "high"], [("small", 0, 10), ("medium", 10, 30), ("large", 30, 1000)])


@query("join_theta_bucketing", """SELECT bucket, count(*) _contributors_count_, round(sum(p_retailprice), 2) v FROM part JOIN (VALUES ('small', 0, 10), ('medium', 10, 30), ('large', 30, 1000)) s(bucket, low, high) ON p_size + 1 >= low AND p_size < high GROUP BY ALL""", v=2)
def _(e):
    on = all_(criterion(plus("p_size", lit(1)), "sizes.low", ">="), criterion("p_size", "sizes.high", "<"))
    return e.frame(from_("part").join(BUCKETS).on(on).select(["bucket"], [count_all, sum_("v", "p_retailprice")]).build())


@query("virtual_from", "SELECT bucket, CAST(sum(high - low) AS BIGINT) w FROM (VALUES ('small', 0, 10), ('medium', 10, 30), ('large', 30, 1000)) s(bucket, low, high) GROUP BY ALL")
def _(e):
    return e.frame(from_(BUCKETS).select(["bucket"], [sum_("w", minus("high", "low"))]).build())


@query("subquery_avg_of_sum", "SELECT l_linestatus, round(avg(q), 6) mean, count(CASE WHEN q > 300 THEN q END) many FROM (SELECT l_suppkey, l_linestatus, sum(l_quantity) q FROM lineitem GROUP BY ALL) GROUP BY ALL", mean=6)
def _(e):
    inner = from_("lineitem").select(["l_suppkey", status], [sum_("q", qty)]).build()
    return e.frame(from_(inner).select([status], [avg("mean", "q"), count_if("many", "q", criterion("q", gt(300)))]).build())


@query("nested_subquery", "SELECT r_name, max(n) most FROM (SELECT n_regionkey, n_nationkey, count(c_custkey) n FROM (SELECT c_custkey, n_nationkey, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL) GROUP BY ALL) x JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def _(e):
    one = from_("customer").join("nation").on(criterion("customer.c_nationkey", "nation.n_nationkey")).select(["c_custkey", "n_nationkey", "n_regionkey"]).build()
    two = from_(one).select(["n_regionkey", "n_nationkey"], [count("n", "c_custkey")]).build()
    return e.frame(from_(two).join("region").on(criterion("n_regionkey", "region.r_regionkey")).select(["r_name"], [max_("most", "n")]).build())


@query("rollup_full", """SELECT CASE WHEN grouping(l_returnflag) = 1 AND grouping(l_linestatus) = 1 THEN 'Grand Total' WHEN grouping(l_returnflag) = 1 THEN 'Total' ELSE l_returnflag END l_returnflag,
  CASE WHEN grouping(l_returnflag) = 1 AND grouping(l_linestatus) = 1 THEN 'Grand Total' WHEN grouping(l_linestatus) = 1 THEN 'Total' ELSE l_linestatus END l_linestatus, sum(l_quantity) qty FROM lineitem GROUP BY ROLLUP (lineitem.l_returnflag, lineitem.l_linestatus)""")
def _(e):
    return e.frame(from_("lineitem").select([flag, status], [total_qty]).rollup(flag, status).build())


@query("rollup_partial", """SELECT r_name, CASE WHEN grouping(n_name) = 1 THEN 'Total' ELSE n_name END n_name, count(*) _contributors_count_ FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY region.r_name, ROLLUP (nation.n_name)""")
def _(e):
    return e.frame(from_("nation").join("region").on(criterion("nation.n_regionkey", "region.r_regionkey")).select(["r_name", "n_name"], [count_all]).rollup("n_name").build())


def _pivot_sql(hidden: str = "") -> str:
    return f"""SELECT CASE WHEN grouping(l_returnflag) = 1 THEN 'Grand Total' ELSE l_returnflag END l_returnflag, CASE WHEN grouping(l_shipyear) = 1 AND grouping(l_linestatus) = 1 THEN 'Grand Total' WHEN grouping(l_shipyear) = 1 THEN 'Total' ELSE CAST(l_shipyear AS VARCHAR) END "year(l_shipdate)",
  CASE WHEN grouping(l_shipyear) = 1 AND grouping(l_linestatus) = 1 THEN 'Grand Total' WHEN grouping(l_linestatus) = 1 THEN 'Total' ELSE l_linestatus END l_linestatus, sum(l_quantity) qty
  FROM (SELECT *, year(l_shipdate) l_shipyear FROM lineitem) t GROUP BY GROUPING SETS ({hidden or '(), (t.l_returnflag), (t.l_shipyear), (t.l_shipyear, t.l_linestatus), (t.l_returnflag, t.l_shipyear)'}, (t.l_returnflag, t.l_shipyear, t.l_linestatus))"""


def _pivot(e, hidden=()):
    q = from_("lineitem").select([flag, year("l_shipdate"), status], [total_qty]).build()
    return e.pivot(M.PivotQuery(q, [flag], [year("l_shipdate"), status], hidden)).frame


@query("grouping_sets_pivot", _pivot_sql())
def _(e):
    return _pivot(e)


@query("pivot_hidden_totals", _pivot_sql("(), (t.l_returnflag), (t.l_shipyear), (t.l_returnflag, t.l_shipyear)").replace("GROUPING SETS ((), (t.l_returnflag), (t.l_shipyear), (t.l_returnflag, t.l_shipyear), ", "GROUPING SETS ((t.l_returnflag, t.l_shipyear), (t.l_returnflag), "))
def _(e):
    return _pivot(e, [flag])


@query("pivot_axis_comparison", """WITH t AS (SELECT l_returnflag f, l_linestatus s, grouping(l_returnflag) gf, grouping(l_linestatus) gs, sum(l_quantity) q FROM lineitem GROUP BY GROUPING SETS ((), (l_returnflag), (l_linestatus), (l_returnflag, l_linestatus)))
  SELECT CASE WHEN t.gf = 1 THEN 'Grand Total' ELSE t.f END l_returnflag, CASE WHEN t.gs = 1 THEN 'Grand Total' ELSE t.s END l_linestatus, t.q qty, round(t.q / a.q, 9) along, round(t.q / b.q, 9) down
  FROM t JOIN t a ON a.gs = 1 AND a.gf = t.gf AND a.f IS NOT DISTINCT FROM t.f JOIN t b ON b.gf = 1 AND b.gs = t.gs AND b.s IS NOT DISTINCT FROM t.s""", along=9, down=9)
def _(e):
    m = [total_qty, compare_parent_of_axis("along", "divide", total_qty, "row"), compare_total_of_axis("down", "divide", total_qty, "column")]
    return e.pivot(M.PivotQuery(from_("lineitem").select([flag, status], m).build(), [flag], [status])).frame


@query("order_explicit", """SELECT o_orderpriority, count(*) _contributors_count_ FROM orders GROUP BY o_orderpriority ORDER BY CASE o_orderpriority WHEN '3-MEDIUM' THEN 0 WHEN '1-URGENT' THEN 1 ELSE 2 END, 1 LIMIT 3""")
def _(e):
    return e.frame(from_("orders").select(["o_orderpriority"], [count_all]).order_by_elements("o_orderpriority", ["3-MEDIUM", "1-URGENT"]).limit(3).build())


@query("order_by_measure", "SELECT l_suppkey, sum(l_quantity) qty, count(*) _contributors_count_ FROM lineitem GROUP BY ALL ORDER BY qty DESC NULLS FIRST, l_suppkey LIMIT 10")
def _(e):
    return e.frame(from_("lineitem").select(["l_suppkey"], [total_qty, count_all]).order_by("qty", descending=True).limit(10).build())


@query("order_by_hidden_column", "SELECT n_name, count(*) _contributors_count_ FROM nation GROUP BY n_name, n_regionkey ORDER BY n_regionkey DESC, n_name LIMIT 7")
def _(e):
    return e.frame(from_("nation").select(["n_name"], [count_all]).order_by("n_regionkey", descending=True, nulls_last=True).limit(7).build())


@query("limit_total_count", "SELECT * FROM (SELECT l_suppkey, sum(l_quantity) qty, count(*) OVER () _total_count_ FROM lineitem GROUP BY ALL HAVING count(*) > 10) ORDER BY l_suppkey LIMIT 5")
def _(e):
    return e.frame(from_("lineitem").select(["l_suppkey"], [total_qty, total_count]).having(criterion(count_all, gt(10))).limit(5).build())


PERIODS = {"year": 1, "semester": 2, "quarter": 4, "month": 12}


def _period(name: str, k: int, years: int, parts: int) -> None:
    part = {"semester": "CAST(floor((quarter(o_orderdate) + 1) / 2) AS INT)", "quarter": "quarter(o_orderdate)", "month": "month(o_orderdate)"}.get(name, "1")
    shown = "" if k == 1 else ", p"
    sql = f"""WITH t AS (SELECT CAST(year(o_orderdate) AS INT) y, CAST({part} AS INT) p, count(*) n FROM orders GROUP BY ALL)
      SELECT a.y{shown.replace(', p', ', a.p')}, a.n _contributors_count_, a.n - b.n diff FROM t a LEFT JOIN t b ON b.y * {k} + b.p = a.y * {k} + a.p + {parts + k * years}"""

    @query(f"period_{name}", sql)
    def _(e):
        o = e.catalog.table("orders")
        e.catalog.register("o", o.select(F.year("o_orderdate").alias("y"), F.expr(part).alias("p")))
        y, p = fields("y", "p")
        period = {"year": M.Year(y), "semester": M.Semester(p, y), "quarter": M.Quarter(p, y), "month": M.Month(p, y)}[name]
        moves = {y: f"y{years:+d}" if years else "y"} | ({p: f"p{parts:+d}" if parts else "p"} if k > 1 else {})
        return e.frame(from_("o").select([y] if k == 1 else [y, p], [count_all, compare_period("diff", "absolute_difference", count_all, period, moves)]).build())


for _name, _years, _parts in (("year", -1, 0), ("semester", 0, -1), ("quarter", 0, 1), ("month", -1, -3)):
    _period(_name, PERIODS[_name], _years, _parts)

PLACES = from_("customer").join("nation").on(criterion("customer.c_nationkey", "nation.n_nationkey")).join("region").on(criterion("nation.n_regionkey", "region.r_regionkey"))
ANCESTORS = fields("r_name", "n_name")
bal = sum_("bal", "c_acctbal")
_PLACES = "customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


def places(where=None):
    b = from_(PLACES.build().table)
    return b.where(where) if where else b


@query("parent_ratio", f"""WITH t AS (SELECT r_name, n_name, c_mktsegment, sum(c_acctbal) b FROM {_PLACES} GROUP BY ALL)
  SELECT r_name, n_name, c_mktsegment, round(b, 2) bal, round(b / sum(b) OVER (PARTITION BY r_name, c_mktsegment), 9) ratio FROM t WHERE n_name LIKE '%A%'""", bal=2, ratio=9)
def _(e):
    return e.frame(places(criterion("n_name", like("%A%"))).select([*ANCESTORS, "c_mktsegment"], [bal, compare_parent("ratio", "divide", bal, ANCESTORS)]).build())


@query("gt_along_ancestors", f"""WITH t AS (SELECT r_name, n_name, c_mktsegment, sum(c_acctbal) b FROM {_PLACES} GROUP BY ALL)
  SELECT r_name, n_name, c_mktsegment, round(b, 2) bal, round(b / sum(b) OVER (PARTITION BY c_mktsegment), 9) ratio FROM t""", bal=2, ratio=9)
def _(e):
    return e.frame(places().select([*ANCESTORS, "c_mktsegment"], [bal, compare_ancestors_total("ratio", "divide", bal, ANCESTORS)]).build())


@query("grand_total_ratio", f"""SELECT r_name, round(sum(c_acctbal), 2) bal, round(sum(c_acctbal) / sum(sum(c_acctbal)) OVER (), 9) ratio FROM {_PLACES} WHERE c_mktsegment = 'BUILDING' GROUP BY ALL""", bal=2, ratio=9)
def _(e):
    return e.frame(places(criterion("c_mktsegment", eq("BUILDING"))).select(["r_name"], [bal, compare_grand_total("ratio", "divide", bal)]).build())


@query("nested_comparison", f"""WITH t AS (SELECT r_name, n_name, sum(c_acctbal) b FROM {_PLACES} GROUP BY ALL), u AS (SELECT *, b / sum(b) OVER (PARTITION BY r_name) AS r FROM t)
  SELECT r_name, n_name, round(b / sum(b) OVER (PARTITION BY r_name) - b / sum(b) OVER (), 9) diff FROM t""", diff=9)
def _(e):
    one, two = compare_parent("p", "divide", bal, ANCESTORS), compare_grand_total("g", "divide", bal)
    return e.frame(places().select(ANCESTORS, [minus("diff", one, two)]).build())


GROUPS = M.Group("basket", flag, [("first", ["A", "N"]), ("all", ["N", "A", "R"])])


@query("group_comparison", """WITH t AS (SELECT l_returnflag f, l_linestatus s, sum(l_quantity) q FROM lineitem GROUP BY ALL), m(basket, f, p) AS (VALUES ('first', 'A', 0), ('first', 'N', 1), ('all', 'N', 0), ('all', 'A', 1), ('all', 'R', 2))
  SELECT m.basket, t.f l_returnflag, t.s l_linestatus, t.q qty, t.q - u.q diff FROM t JOIN m ON m.f = t.f LEFT JOIN m n ON n.basket = m.basket AND n.p = greatest(m.p - 1, 0) LEFT JOIN t u ON u.f = n.f AND u.s = t.s""")
def _(e):
    return e.frame(from_("lineitem").select([status], [total_qty, compare_group("diff", "absolute_difference", total_qty, {flag: "s-1"})], GROUPS).build())


_DIMENSION = """WITH t AS (SELECT o_orderpriority p, o_orderstatus s, count(*) n FROM orders GROUP BY ALL), v AS (SELECT p, lag(p, 1, p) OVER (ORDER BY p) prev, min(p) OVER () head FROM (SELECT DISTINCT p FROM t))
  SELECT t.p o_orderpriority, t.s o_orderstatus, t.n _contributors_count_, {x} FROM t JOIN v USING (p) LEFT JOIN t u ON u.p = v.{c} AND u.s = t.s"""


@query("dimension_prev", _DIMENSION.format(x="t.n - u.n diff", c="prev"))
def _(e):
    return e.frame(from_("orders").select(["o_orderpriority", "o_orderstatus"], [count_all, compare_dimension("diff", "absolute_difference", count_all, field("o_orderpriority"), "p-1")]).build())


@query("dimension_first", _DIMENSION.format(x="round(t.n / u.n, 9) ratio", c="head"), ratio=9)
def _(e):
    return e.frame(from_("orders").select(["o_orderpriority", "o_orderstatus"], [count_all, compare_dimension("ratio", "divide", count_all, field("o_orderpriority"), "first")]).build())


SALES = from_("customer").select(["c_nationkey", "c_mktsegment"], [count("customers", "c_custkey")]).rollup("c_nationkey", "c_mktsegment").build()
SUPPLY = from_("supplier").select([field("s_nationkey").as_("c_nationkey")], [count("suppliers", "s_suppkey")]).where(criterion("s_nationkey", gt(5))).rollup(field("s_nationkey").as_("c_nationkey")).build()


def _merge_sql(kind: str) -> str:
    keep = {"full": "TRUE", "left": "a.one IS NOT NULL OR EXISTS (SELECT 1 FROM a x WHERE x.k IS NOT DISTINCT FROM b.k AND x.gk = b.gk)", "inner": "CASE WHEN a.one IS NOT NULL THEN EXISTS (SELECT 1 FROM b x WHERE x.k IS NOT DISTINCT FROM a.k AND x.gk = a.gk) ELSE EXISTS (SELECT 1 FROM a x WHERE x.k IS NOT DISTINCT FROM b.k AND x.gk = b.gk) END"}[kind]
    return f"""WITH a AS (SELECT 1 AS one, c_nationkey k, c_mktsegment s, grouping(c_nationkey) gk, grouping(c_mktsegment) gs, count(c_custkey) n FROM customer GROUP BY ROLLUP (c_nationkey, c_mktsegment)),
      b AS (SELECT s_nationkey k, grouping(s_nationkey) gk, 1 AS gs, count(s_suppkey) n FROM supplier WHERE s_nationkey > 5 GROUP BY ROLLUP (s_nationkey)),
      m AS (SELECT coalesce(a.k, b.k) k, a.s, coalesce(a.gk, b.gk) gk, coalesce(a.gs, b.gs) gs, a.n customers, b.n suppliers FROM a FULL JOIN b ON a.k IS NOT DISTINCT FROM b.k AND a.gk = b.gk AND a.gs = b.gs WHERE {keep})
      SELECT CASE WHEN gk = 1 AND gs = 1 THEN 'Grand Total' WHEN gk = 1 THEN 'Total' ELSE CAST(k AS VARCHAR) END c_nationkey, CASE WHEN gk = 1 AND gs = 1 THEN 'Grand Total' WHEN gs = 1 THEN 'Total' ELSE s END c_mktsegment, customers, suppliers FROM m"""


for _kind in ("full", "left", "inner"):

    @query(f"merge_{_kind}", _merge_sql(_kind))
    def _(e, kind=_kind):
        return e.merge(M.MergeQuery([SALES, SUPPLY], [kind])).frame


@query("query_join", """WITH a AS (SELECT c_nationkey AS nation, count(*) customers FROM customer GROUP BY ALL), b AS (SELECT s_nationkey AS nation, sum(s_acctbal) bal FROM supplier GROUP BY ALL)
  SELECT nation, customers, round(bal, 2) bal FROM a JOIN b USING (nation) WHERE customers > 1 ORDER BY nation LIMIT 12""", bal=2)
def _(e):
    a = from_("customer").select([field("c_nationkey").as_("nation")], [count("customers", "c_custkey")]).build()
    b = from_("supplier").select([field("s_nationkey").as_("nation")], [sum_("bal", "s_acctbal")]).build()
    return e.join(M.JoinQuery(a, [(b, "inner", None)], criterion("customers", gt(1)), [(field("nation"), M.SimpleOrder())], 12))


def _days(e):
    e.catalog.register("ev", e.catalog.table("events").select("event_type", F.to_date("ts").alias("day"), "value"))
    return from_("ev")


@query("vector_agg", """WITH t AS (SELECT event_type, CAST(ts AS DATE) d, count(value) v FROM events GROUP BY ALL), g AS (SELECT d, sum(v) v FROM t GROUP BY ALL)
  SELECT event_type, array_to_string(list(v ORDER BY d), ',') AS days FROM t GROUP BY ALL UNION ALL SELECT 'Grand Total', array_to_string(list(v ORDER BY d), ',') FROM g""")
def _(e):
    q = _days(e).select(["event_type"], [vector("v", "value", "count", "day")]).rollup("event_type").build()
    return e.frame(q).select("event_type", F.array_join("v", ",").alias("days"))


@query("var", """WITH t AS (SELECT event_type, CAST(ts AS DATE) d, round(sum(value), 2) v FROM events GROUP BY ALL), s AS (SELECT event_type, list_sort(list(v)) l FROM t GROUP BY ALL)
  SELECT event_type, round(-l[1 + CAST(floor(len(l) * (1 - CAST(0.95 AS DOUBLE))) AS INT)], 2) loss FROM s""", loss=2)
def _(e):
    return e.frame(_days(e).select(["event_type"], [parametrized("loss", "VAR", value=field("value"), date=field("day"), quantile=0.95, **{"return": "value"})]).build())


@query("incremental_var", """WITH t AS (SELECT event_type e, CAST(ts AS DATE) d, count(value) v FROM events GROUP BY ALL), g AS (SELECT d, sum(v) v FROM t GROUP BY ALL), p AS (SELECT list_sort(list(v)) l, len(list(v)) n FROM g),
  w AS (SELECT k.e, list_sort(list(g.v - coalesce(t.v, 0))) l FROM (SELECT DISTINCT e FROM t) k CROSS JOIN g LEFT JOIN t ON t.e = k.e AND t.d = g.d GROUP BY ALL)
  SELECT e event_type, CAST(-(p.l[1 + CAST(floor(n * (1 - CAST(0.9 AS DOUBLE))) AS INT)] - w.l[1 + CAST(floor(n * (1 - CAST(0.9 AS DOUBLE))) AS INT)]) AS BIGINT) change FROM w CROSS JOIN p""")
def _(e):
    e.catalog.register("ev", e.catalog.table("events").select("event_type", F.to_date("ts").alias("day"), F.when(F.col("value").isNotNull(), 1).otherwise(0).cast("long").alias("one")))
    m = parametrized("change", "INCREMENTAL_VAR", value=field("one"), date=field("day"), quantile=0.9, ancestors=[field("event_type")])
    return e.frame(from_("ev").select(["event_type"], [m]).build())


@query("sql_functions", """SELECT upper(n_name) "upper(n_name)", lower(trim(r_name)) "lower(trim(r_name))", CAST(year(o_orderdate) AS INT) "year(o_orderdate)", CAST(quarter(o_orderdate) AS INT) q, CAST(month(o_orderdate) AS INT) m, count(*) _contributors_count_, min(abs(c_acctbal)) a, CAST(max(length(c_name)) AS INT) n
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE year(o_orderdate) >= 1996 GROUP BY ALL""")
def _(e):
    q = from_("orders").join("customer").on(criterion("orders.o_custkey", "customer.c_custkey")).join("nation").on(criterion("customer.c_nationkey", "nation.n_nationkey")).join("region").on(criterion("nation.n_regionkey", "region.r_regionkey"))
    columns = [upper("n_name"), lower(trim("r_name")), year("o_orderdate"), quarter("o_orderdate").as_("q"), month("o_orderdate").as_("m")]
    return e.frame(q.where(criterion(year("o_orderdate"), ge(1996))).select(columns, [count_all, min_("a", abs_("c_acctbal")), max_("n", call("length", "c_name"))]).build())


@query("array_contains", "SELECT label, count(*) _contributors_count_ FROM embeddings WHERE list_contains([CAST(label AS BIGINT), vec_id % 7], 3) GROUP BY ALL")
def _(e):
    e.catalog.register("tagged", e.catalog.table("embeddings").select("label", F.array(F.col("label").cast("long"), F.col("vec_id") % 7).alias("tags")))
    return e.frame(from_("tagged").where(criterion("tags", contains(3))).select(["label"], [count_all]).build())


@query("current_date", "SELECT r_name, count(*) _contributors_count_ FROM region WHERE current_date >= DATE '2024-01-01' GROUP BY ALL")
def _(e):
    import datetime

    where = all_(criterion(current_date(), not_null), criterion(current_date(), ge(datetime.date(2024, 1, 1))))
    return e.frame(from_("region").where(where).select(["r_name"], [count_all]).build())


@query("constant_conditions", "SELECT r_name, count(*) _contributors_count_ FROM region WHERE (true AND r_regionkey > 1) OR (false AND r_regionkey = 0) GROUP BY ALL")
def _(e):
    key = field("r_regionkey")
    where = any_(all_(criterion(key, true), criterion(key, gt(1))), all_(criterion(key, false), criterion(key, eq(0))))
    return e.frame(from_("region").where(where).select(["r_name"], [count_all]).build())


@query("listagg", "SELECT r_regionkey, string_agg(r_name, '') names FROM region GROUP BY ALL")
def _(e):
    return e.frame(from_("region").select(["r_regionkey"], [aggregate("names", "r_name", "listagg")]).build())


@query("ordered_rollup", """SELECT CASE WHEN grouping(l_returnflag) = 1 THEN 'Grand Total' ELSE l_returnflag END l_returnflag, round(sum(l_quantity), 2) qty FROM lineitem
  GROUP BY ROLLUP (l_returnflag) ORDER BY grouping(l_returnflag) DESC, l_returnflag DESC LIMIT 3""", qty=2)
def _(e):
    return e.frame(from_("lineitem").select([flag], [total_qty]).rollup(flag).order_by(flag, descending=True).limit(3).build())


@query("raw_sql", "SELECT l_linestatus, CAST(rank() OVER (ORDER BY sum(l_quantity) DESC) AS INT) r FROM lineitem GROUP BY ALL")
def _(e):
    return e.sql("SELECT l_linestatus, rank() OVER (ORDER BY sum(l_quantity) DESC) r FROM lineitem GROUP BY l_linestatus")


@query("more_aggregates", """SELECT l_returnflag, count_if(l_quantity > 30) many, bool_or(l_tax > 0.07) any_, round(covar_samp(l_quantity, l_extendedprice), 3) covar, mode(l_linestatus) usual, round(variance(l_quantity), 5) var FROM lineitem GROUP BY ALL""", covar=3, var=5)
def _(e):
    e.catalog.register("li", e.catalog.table("lineitem").withColumns({"big": F.col("l_quantity") > 30, "taxed": F.col("l_tax") > 0.07}))
    m = [aggregate("many", "big", "count_if"), aggregate("any_", "taxed", "bool_or"), expression("covar", "covar_samp(l_quantity, l_extendedprice)"), aggregate("usual", status, "mode"), aggregate("var", qty, "variance")]
    return e.frame(from_("li").select([flag], m).build())


@query("join_nested", f"SELECT r_name, o_orderstatus, count(*) _contributors_count_ FROM orders JOIN ({_PLACES}) ON o_custkey = c_custkey WHERE r_name <> 'AFRICA' GROUP BY ALL")
def _(e):
    # The joined table has joins of its own, which may use columns of all tables before them.
    nation = M.Join(M.Table("nation"), "inner", criterion("customer.c_nationkey", "nation.n_nationkey"))
    region = M.Join(M.Table("region"), "inner", criterion("nation.n_regionkey", "region.r_regionkey"))
    q = from_("orders").join(M.Table("customer", [nation, region])).on(criterion("orders.o_custkey", "customer.c_custkey"))
    return e.frame(q.where(criterion("region.r_name", neq("AFRICA"))).select(["r_name", "o_orderstatus"], [count_all]).build())


@query("parent_ratio_rollup", f"""WITH t AS (SELECT r_name r, n_name n, grouping(r_name) gr, grouping(n_name) gn, sum(c_acctbal) b FROM {_PLACES} GROUP BY ROLLUP (r_name, n_name))
  SELECT CASE WHEN t.gr = 1 THEN 'Grand Total' ELSE t.r END r_name, CASE WHEN t.gr = 1 THEN 'Grand Total' WHEN t.gn = 1 THEN 'Total' ELSE t.n END n_name, round(t.b / p.b, 9) ratio
  FROM t JOIN t p ON p.gn = 1 AND (CASE WHEN t.gn = 0 THEN p.gr = 0 AND p.r = t.r ELSE p.gr = 1 END)""", ratio=9)
def _(e):
    return e.frame(places().select(ANCESTORS, [compare_parent("ratio", "divide", bal, ANCESTORS)]).rollup(*ANCESTORS).build())


@query("custom_comparison", f"""WITH t AS (SELECT r_name, n_name, count(*) n FROM {_PLACES} GROUP BY ALL) SELECT r_name, n_name, CAST(sum(n) OVER (PARTITION BY r_name) % n AS BIGINT) AS rest FROM t""")
def _(e):
    m = compare_parent("rest", lambda own, parent: parent % own, count_all, ANCESTORS)
    return e.frame(places().select(ANCESTORS, [m]).build())


@query("group_comparison_first", """WITH t AS (SELECT l_returnflag f, sum(l_quantity) q FROM lineitem GROUP BY ALL), m(basket, f, p) AS (VALUES ('first', 'A', 0), ('first', 'N', 1), ('all', 'N', 0), ('all', 'A', 1), ('all', 'R', 2))
  SELECT m.basket, t.f l_returnflag, t.q qty, round(t.q / u.q, 9) ratio FROM t JOIN m ON m.f = t.f JOIN m n ON n.basket = m.basket AND n.p = 0 JOIN t u ON u.f = n.f""", ratio=9)
def _(e):
    return e.frame(from_("lineitem").select([], [total_qty, compare_group("ratio", "divide", total_qty, {flag: "first"})], GROUPS).build())


@query("dimension_next_filtered", """WITH t AS (SELECT o_orderpriority p, count(*) n FROM orders GROUP BY ALL), v AS (SELECT p, n, lead(n) OVER (ORDER BY p) nxt FROM t)
  SELECT p o_orderpriority, n _contributors_count_, n - nxt diff FROM v WHERE p IN ('2-HIGH', '5-LOW')""")
def _(e):
    m = compare_dimension("diff", "absolute_difference", count_all, field("o_orderpriority"), "p+1")
    return e.frame(from_("orders").where(criterion("o_orderpriority", in_("2-HIGH", "5-LOW"))).select(["o_orderpriority"], [count_all, m]).build())


@query("merge_pivot", """WITH a AS (SELECT c_nationkey k, c_mktsegment s, grouping(c_nationkey) gk, grouping(c_mktsegment) gs, count(c_custkey) n FROM customer GROUP BY GROUPING SETS ((), (c_nationkey), (c_mktsegment), (c_nationkey, c_mktsegment))),
  b AS (SELECT s_nationkey k, grouping(s_nationkey) gk, 1 AS gs, count(s_suppkey) n FROM supplier WHERE s_nationkey > 5 GROUP BY GROUPING SETS ((), (s_nationkey)))
  SELECT CASE WHEN coalesce(a.gk, b.gk) = 1 THEN 'Grand Total' ELSE CAST(coalesce(a.k, b.k) AS VARCHAR) END c_nationkey, CASE WHEN coalesce(a.gs, b.gs) = 1 THEN 'Grand Total' ELSE a.s END c_mktsegment, a.n customers, b.n suppliers
  FROM a FULL JOIN b ON a.k IS NOT DISTINCT FROM b.k AND a.gk = b.gk AND a.gs = b.gs""")
def _(e):
    plain = [M.Query(q.table, q.columns, q.measures, where=q.where) for q in (SALES, SUPPLY)]
    return e.pivot(M.PivotQuery(M.MergeQuery(plain, ["full"]), [field("c_nationkey")], [field("c_mktsegment")])).frame


def _ones(e):
    day, one = F.to_date("ts").alias("day"), F.when(F.col("value").isNotNull(), 1).otherwise(0).cast("long").alias("one")
    e.catalog.register("ev", e.catalog.table("events").select("event_type", (F.col("user_id") % 3).alias("part"), day, one))
    return from_("ev")


@query("vector_of_selected_axis", "SELECT event_type, CAST(ts AS DATE) AS day, count(value) v FROM events GROUP BY ALL")
def _(e):
    return e.frame(_ones(e).select(["event_type", "day"], [vector("v", "one", "sum", "day")]).build())


@query("var_date", """WITH t AS (SELECT event_type, CAST(ts AS DATE) d, count(value) v FROM events GROUP BY ALL), s AS (SELECT event_type, list_sort(list({'v': v, 'd': d})) l FROM t GROUP BY ALL)
  SELECT event_type, l[1 + CAST(floor(len(l) * (1 - CAST(0.8 AS DOUBLE))) AS INT)].d AS worst FROM s""")
def _(e):
    return e.frame(_ones(e).select(["event_type"], [parametrized("worst", "VAR", value=field("one"), date=field("day"), quantile=0.8, **{"return": "date"})]).build())


@query("overall_incremental_var", """WITH t AS (SELECT event_type e, user_id % 3 p, CAST(ts AS DATE) d, count(value) v FROM events GROUP BY ALL), g AS (SELECT d, sum(v) v FROM t GROUP BY ALL), a AS (SELECT list_sort(list(v)) l, len(list(v)) n FROM g),
  w AS (SELECT k.e, k.p, list_sort(list(g.v - coalesce(t.v, 0))) l FROM (SELECT DISTINCT e, p FROM t) k CROSS JOIN g LEFT JOIN t ON t.e = k.e AND t.p = k.p AND t.d = g.d GROUP BY ALL)
  SELECT e event_type, p AS part, CAST(-(a.l[1 + CAST(floor(n * (1 - CAST(0.9 AS DOUBLE))) AS INT)] - w.l[1 + CAST(floor(n * (1 - CAST(0.9 AS DOUBLE))) AS INT)]) AS BIGINT) change FROM w CROSS JOIN a""")
def _(e):
    m = parametrized("change", "OVERALL_INCREMENTAL_VAR", value=field("one"), date=field("day"), quantile=0.9, ancestors=fields("event_type", "part"))
    return e.frame(_ones(e).select(["event_type", "part"], [m]).build())
