"""Sort keys: explicit orders first, then the column set's order, then all output columns left to right."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans import model as M


def _explicit(column: Column, values) -> Column:
    rank = F.lit(len(values))
    for i, v in reversed(list(enumerate(values))):
        rank = F.when(column.eqNullSafe(F.lit(v)), F.lit(i)).otherwise(rank)
    return rank


def order_keys(order, column: Column, total: Column | None) -> list[Column]:
    """Keys of one ordered column; totals stand before values, whatever the direction."""
    out = []
    real_null = column.isNull() & (total == 0) if total is not None else column.isNull()
    if isinstance(order, M.ExplicitOrder):
        out.append(F.when(real_null, 1).otherwise(0).asc())
    else:
        out.append(F.when(real_null, 1 if order.nulls_last else 0).otherwise(0 if order.nulls_last else 1).asc())
    if total is not None:
        out.append(total.desc())
    if isinstance(order, M.ExplicitOrder):
        return [*out, _explicit(column, order.values).asc(), column.asc()]
    return [*out, column.desc() if order.descending else column.asc()]


def keys(c, outputs: list[tuple[str, str]]) -> list[Column]:
    flag = lambda name: F.col(f"g{name[1:]}") if name[0] == "d" and name[1:].isdigit() else None
    by_name = dict(outputs)
    out: list[Column] = []
    done: set[str] = set()
    for f, order in c.query.orders:
        name = by_name.get(M.output_name(f))
        if name is None:
            i = c.index(f)
            if i is None:
                raise ValueError(f"can't order by {M.output_name(f)}")
            name = f"d{i}"
        if name not in done:
            done.add(name)
            out += order_keys(order, F.col(name), flag(name))
    if c.query.column_set is not None:
        out += [F.col("gpos").asc(), F.col("vpos").asc()]
        done |= {"cs", f"d{c.index(c.query.column_set.field)}"}
    for _, name in outputs:
        if name in done:
            continue
        done.add(name)
        total = flag(name)
        column = F.col(name)
        real_null = column.isNull() & (total == 0) if total is not None else column.isNull()
        out.append(F.when(real_null, 1).otherwise(0).asc())
        if total is not None:
            out.append(total.desc())
        out.append(column.asc())
    return out
