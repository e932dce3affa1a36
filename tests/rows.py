"""Results as sorted lists, so that two engines can be compared."""

import math


def plain(v):
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return str(v) if hasattr(v, "isoformat") else v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(repr(plain(r[i])) for i in order) for r in rows))


def same(df, con, sql):
    got = df.collect()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, got) == rows_of(names, want)
    return len(got)
