"""Order-insensitive comparison of a Spark result with a DuckDB result, by column name."""

import datetime
import decimal
import math


def norm(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return 0.0 if v == 0 else v
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def compare(df, con, sql):
    """None when equal, else a short description of the first difference."""
    got_cols = df.columns
    got = rows_of(got_cols, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want_cols = [d[0] for d in cur.description]
    want_types = {d[0]: str(d[1]) for d in cur.description}
    want = rows_of(want_cols, cur.fetchall())
    if sorted(got_cols) != sorted(want_cols):
        return f"columns {sorted(got_cols)} != {sorted(want_cols)}"
    bad = [f"{c}:{t}" for c, t in want_types.items() if "HUGEINT" in t or "DECIMAL" in t]
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    got_types = dict(df.dtypes)
    bad += [
        f"{c}: spark {t} duck {want_types[c]}"
        for c, t in got_types.items()
        if kinds.get(t) and kinds[t] != want_types[c].upper() and not ("HUGEINT" in want_types[c] or "DECIMAL" in want_types[c])
    ]
    if len(got) != len(want):
        extra = [r for r in got if r not in want][:2]
        missing = [r for r in want if r not in got][:2]
        return f"row count {len(got)} != {len(want)}; only spark {extra}; only sql {missing}"
    diff = [(g, w) for g, w in zip(got, want) if g != w]
    if diff:
        return f"{len(diff)} of {len(got)} rows differ, first {diff[0]} (columns {sorted(got_cols)})"
    if bad:
        return f"types: {bad}"
    if not got:
        return "empty result"
    return None
