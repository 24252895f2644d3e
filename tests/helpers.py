"""Row comparison used by the tests."""

from __future__ import annotations

import datetime
import math


def plain(value):
    if isinstance(value, datetime.datetime):
        midnight = value.time() == datetime.time(0)
        return value.date().isoformat() if midnight else value.isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if type(value).__name__ == "Decimal":
        return float(value)
    return value


def _key(row):
    return tuple((v is None, "n" if isinstance(v, (int, float)) else str(type(v)),
                  0 if v is None else v) for v in row)


def sorted_rows(rows, columns):
    order = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(plain(row[i]) for i in order) for row in rows), key=_key)


def by_key(df, *keys):
    """{key: row dict} of a small result."""
    single = len(keys) == 1
    return {
        (row[keys[0]] if single else tuple(row[k] for k in keys)): row.asDict()
        for row in df.collect()
    }
