"""Row sets of Spark and DuckDB in one comparable form."""

import datetime
import decimal
import math


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if math.isnan(v) else float(f"{float(v):.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(repr(tuple(plain(r[i]) for i in order)) for r in values)


def same(df, relation):
    assert rows(df.columns, df.collect()) == rows(relation.columns, relation.fetchall())
