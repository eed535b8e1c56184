"""Calculated measures over generated tables against plain Python that never groups, joins or shifts rows as the engine does.

Every cell is worked out on its own: a filter of the table's rows for the cell, and one for the cell it is compared with.
"""

import itertools
import math
import random

import pytest

from latticeq.engine import Engine
from latticeq.functions import (
    all_, compare_ancestors_total, compare_dimension, compare_grand_total, compare_group, compare_parent, compare_parent_of_axis, compare_period, criterion, eq, field, fields, gt, in_, max_, parametrized, sum_,
)
from latticeq.plans import model as M
from latticeq.plans.builder import from_

GT, T = "Grand Total", "Total"
SEAS = {"baltic": ["gdansk", "riga"], "adriatic": ["bari", "split", "rijeka"], "aral": [None]}
CARGO = ["grain", "salt", "timber"]


def landings(seed=41):
    """(sea, port, cargo, year, half, day, tons): some ports lack some cargoes and years."""
    rng = random.Random(seed)
    out = []
    for sea, ports in SEAS.items():
        for port, cargo, year, half in itertools.product(ports, CARGO, (2019, 2020, 2021), (1, 2)):
            for _ in range(rng.choice([0, 1, 1, 2])):
                out.append((sea, port, cargo, year, half, rng.randint(1, 9), rng.randint(1, 50)))
    return out


ROWS = landings()
NAMES = ("sea", "port", "cargo", "year", "half", "day", "tons")
PLACE = fields("sea", "port")
tons = sum_("tons", "tons")
ANY = object()


def total(rows=ROWS, **at):
    """The tons of the rows that have these values (ANY: all); None where there are no rows."""
    own = [r[-1] for r in rows if all(v is ANY or r[NAMES.index(k)] == v for k, v in at.items())]
    return sum(own) if own else None


def ratio(a, b):
    return None if a is None or b is None else a / b


def places(rows=ROWS):
    """The cells of a roll-up of sea and port: what is shown, and which rows it stands for."""
    yield (GT, GT), (ANY, ANY)
    for sea in sorted({r[0] for r in rows}):
        yield (sea, T), (sea, ANY)
        for port in sorted({r[1] for r in rows if r[0] == sea}, key=lambda p: (p is None, p or "")):
            yield (sea, port), (sea, port)


@pytest.fixture(scope="module")
def engine(spark):
    e = Engine(spark)
    e.catalog.register("landing", spark.createDataFrame(ROWS, "sea string, port string, cargo string, year int, half int, day int, tons int"))
    return e


def check(engine, q, want):
    got = engine.query(q).rows()
    assert len(got) == len(want) and [tuple(pytest.approx(x) if isinstance(x, float) else x for x in r) for r in want] == got


@pytest.mark.parametrize("cargo", [None, "salt"])
def test_shares_of_parents_and_totals(engine, cargo):
    rows = [r for r in ROWS if cargo is None or r[2] == cargo]
    at = lambda sea, port: total(rows, sea=sea, port=port)
    above = lambda sea, port: (sea, ANY) if port is not ANY else (ANY, ANY)
    want = [(*shown, at(*c), ratio(at(*c), at(*above(*c))), ratio(at(*c), at(ANY, ANY)), ratio(at(*c), at(ANY, ANY))) for shown, c in places(rows)]
    measures = [tons, compare_parent("parent", "divide", tons, PLACE), compare_ancestors_total("whole", "divide", tons, PLACE), compare_grand_total("share", "divide", tons)]
    q = from_("landing") if cargo is None else from_("landing").where(criterion("cargo", eq(cargo)))
    check(engine, q.select(PLACE, measures).rollup(*PLACE).build(), want)


def test_filters_on_ancestors_are_cleared_unless_kept(engine):
    where = all_(criterion("port", in_("riga", "split")), criterion("year", gt(2019)))
    later = [r for r in ROWS if r[3] > 2019]
    free, kept = compare_parent("free", "divide", tons, PLACE), compare_parent("kept", "divide", tons, PLACE, clear_filters=False)
    own = lambda sea, port: total(later, sea=sea, port=port)
    want = [(sea, port, own(sea, port), ratio(own(sea, port), own(sea, ANY)), None) for sea, port in (("adriatic", "split"), ("baltic", "riga"))]
    check(engine, from_("landing").where(where).select(PLACE, [tons, free]).build(), [r[:4] for r in want])
    check(engine, from_("landing").where(where).select(PLACE, [tons, kept]).build(), [(*r[:3], 1.0) for r in want])


@pytest.mark.parametrize("years", [0, 1])
@pytest.mark.parametrize("halves", [0, 1, 3])
def test_earlier_periods(engine, years, halves):
    moved = {k: f"{k[0]}-{n}" for k, n in (("year", years), ("half", halves)) if n}
    if not moved:
        return
    m = compare_period("change", "absolute_difference", tons, M.Semester(field("half"), field("year")), {field(k): v.replace("h", "s") for k, v in moved.items()})
    want = []
    for year, half in sorted({(r[3], r[4]) for r in ROWS}):
        y, h = divmod(2 * (year - years) + half - 1 - halves, 2)
        now, before = total(year=year, half=half), total(year=y, half=h + 1)
        want.append((year, half, now, None if before is None else now - before))
    check(engine, from_("landing").select(["year", "half"], [tons, m]).build(), want)


def test_steps_along_a_dimension_and_inside_groups(engine):
    order = ["timber", "grain", "salt"]
    for text, other in (("c-1", lambda i: max(i - 1, 0)), ("first", lambda i: 0), ("c+1", lambda i: i + 1)):
        m = compare_dimension("change", "absolute_difference", tons, field("cargo"), text, elements=order)
        want = [(c, total(cargo=c), total(cargo=c) - total(cargo=order[other(i)]) if other(i) < 3 else None) for i, c in enumerate(order)]
        check(engine, from_("landing").select(["cargo"], [tons, m]).order_by_elements("cargo", order).build(), want)
    groups = M.Group("mix", field("cargo"), [("dry", ["grain", "salt"]), ("all", ["salt", "timber", "grain"]), ("none", ["wool"])])
    m = compare_group("change", "absolute_difference", tons, {field("cargo"): "c-1"})
    want = [(g, c, total(cargo=c), total(cargo=c) - total(cargo=values[max(i - 1, 0)])) for g, values in groups.groups[:2] for i, c in enumerate(values)]
    check(engine, from_("landing").select([], [tons, m], groups).build(), want)


@pytest.mark.parametrize("how", ["full", "left", "inner"])
def test_drilling_across(engine, how):
    left = from_("landing").where(criterion("sea", in_("baltic", "adriatic"))).select(["sea"], [tons]).rollup("sea").build()
    right = from_("landing").where(criterion("sea", in_("baltic", "aral"))).select(["sea", "cargo"], [max_("most", "tons")]).rollup("sea", "cargo").build()
    a = {(GT, GT): sum(total(sea=s) for s in ("baltic", "adriatic"))} | {(s, T): total(sea=s) for s in ("baltic", "adriatic")}
    most = lambda seas, cargo: max(r[-1] for r in ROWS if r[0] in seas and cargo in (ANY, r[2]))
    b = {(GT, GT): most(("baltic", "aral"), ANY)}
    for s in ("baltic", "aral"):
        b[s, T] = most((s,), ANY)
        b |= {(s, c): most((s,), c) for c in CARGO if total(sea=s, cargo=c)}
    # Sides join on the dimension they share; the cargo of the left is its total.
    seas_a, seas_b = {k[0] for k in a}, {k[0] for k in b}
    kept = {"full": seas_a | seas_b, "left": seas_a, "inner": seas_a & seas_b}[how]
    keys = {k for k in {*a, *b} if k[0] in kept}
    order = lambda k: tuple((x != GT, x != T, x) for x in k)
    assert engine.merge(M.MergeQuery([left, right], [how])).rows() == [(*k, a.get(k), b.get(k)) for k in sorted(keys, key=order)]


def test_value_at_risk_and_its_increments(engine):
    def losses(sea, cargo):
        by_day = {d: total(sea=sea, cargo=cargo, day=d) for d in range(1, 10)}
        return {d: x for d, x in by_day.items() if x is not None}

    def at_risk(values):
        return sorted(values)[math.floor(len(values) * 0.25)]

    own = fields("sea", "cargo")
    given = {"value": field("tons"), "date": field("day"), "quantile": 0.75}
    m = [parametrized("loss", "VAR", **given, **{"return": "value"}), parametrized("inc", "INCREMENTAL_VAR", **given, ancestors=own)]
    want = []
    cells = [((GT, GT), (ANY, ANY), (ANY, ANY))]
    for sea in sorted(SEAS):
        cells.append(((sea, T), (sea, ANY), (ANY, ANY)))
        cells += [((sea, c), (sea, c), (sea, ANY)) for c in CARGO if total(sea=sea, cargo=c)]
    for shown, cell, parent in cells:
        mine, whole = losses(*cell), losses(*parent)
        without = [x - mine.get(d, 0) for d, x in whole.items()]
        want.append((*shown, -at_risk(mine.values()), -(at_risk(whole.values()) - at_risk(without))))
    assert engine.query(from_("landing").select(own, m).rollup(*own).build()).rows() == want


def test_shares_along_a_pivots_axes(engine):
    m = [compare_parent_of_axis(a, "divide", tons, a) for a in ("row", "column")]
    got = {r[:2]: r[2:] for r in engine.pivot(M.PivotQuery(from_("landing").select(["sea", "cargo"], [tons, *m]).build(), fields("sea"), fields("cargo"))).rows()}
    every = lambda x: ANY if x == GT else x
    cells = {(s, c): total(sea=every(s), cargo=every(c)) for s in [GT, *SEAS] for c in [GT, *CARGO]}
    assert set(got) == {k for k, x in cells.items() if x is not None}
    for (s, c), (own, along, down) in got.items():
        assert own == cells[s, c] and along == pytest.approx(own / cells[s, GT]) and down == pytest.approx(own / cells[GT, c])


def test_joined_queries(engine):
    by_sea = from_("landing").select(["landing.sea"], [tons]).build()
    by_port = from_("landing").where(criterion("port", in_("riga", "bari", "split"))).select([field("landing.sea").as_("at"), "landing.port"], [max_("most", "tons")]).build()
    for how in ("inner", "left"):
        q = M.JoinQuery(by_sea, [(by_port, how, criterion("landing.sea", M.AliasedField("at")))], None, [(field("landing.sea"), M.SimpleOrder()), (field("landing.port"), M.SimpleOrder())])
        want = []
        for sea in sorted(SEAS):
            ports = [p for p in ("bari", "riga", "split") if p in SEAS[sea]] or ([None] if how == "left" else [])
            want += [(sea, p, total(sea=sea), max((r[-1] for r in ROWS if r[1] == p), default=None) if p else None) for p in ports]
        got = engine.join(q)
        assert sorted(map(tuple, got.select("`landing.sea`", "`landing.port`", "tons", "most").collect()), key=str) == sorted(want, key=str)
