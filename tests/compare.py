"""Order-free comparison of two result tables, by way of Arrow, so that no value passes through pandas."""

import datetime
import decimal

import pyarrow as pa


def arrow(result):
    """An Arrow table of a Spark DataFrame or a DuckDB relation."""
    if hasattr(result, "toArrow"):
        return result.toArrow()
    found = result.arrow()
    return found.read_all() if hasattr(found, "read_all") else found


def _cell(x, floating):
    if x is None:
        return "NULL"
    if isinstance(x, (list, tuple)):
        return "[" + ", ".join(_cell(y, floating or isinstance(y, float)) for y in x) + "]"
    if isinstance(x, dict):
        return "{" + ", ".join(f"{k}: {_cell(x[k], floating)}" for k in sorted(x)) + "}"
    if isinstance(x, (bool, int)):
        return f"{float(x):.9g}" if floating else str(int(x))
    if isinstance(x, (float, decimal.Decimal)):
        return f"{float(x):.9g}" if floating or x != x or x != int(x) else str(int(x))
    if isinstance(x, datetime.datetime):
        return (x.astimezone(datetime.UTC).replace(tzinfo=None) if x.tzinfo else x).isoformat()
    return x.hex() if isinstance(x, bytes) else str(x)


def rows(table, floating):
    columns = [[_cell(x, name in floating) for x in table.column(name).to_pylist()] for name in sorted(table.column_names)]
    return sorted(zip(*columns, strict=True))


def same(a, b):
    a, b = arrow(a), arrow(b)
    assert sorted(a.column_names) == sorted(b.column_names)
    floating = {f.name for t in (a, b) for f in t.schema if pa.types.is_floating(f.type)}
    one, two = rows(a, floating), rows(b, floating)
    assert len(one) == len(two)
    assert [x for x, y in zip(one, two, strict=True) if x != y][:3] == [y for x, y in zip(one, two, strict=True) if x != y][:3]
