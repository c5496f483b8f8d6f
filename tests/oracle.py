"""A query's rows against its SQL in DuckDB, whatever their order."""

from pathlib import Path


def canon(v):
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, float):
        return f"{v:.6g}"
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return str(sorted((k, canon(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(canon(x) for x in v) + "]"
    return str(v)


def compare(spark, data, query, sql):
    import duckdb

    con = duckdb.connect()
    for p in Path(data).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    df = query(spark, data)
    rows, cols = df.collect(), df.columns
    rel = con.sql(sql)
    names = [x[0] for x in rel.description]
    assert sorted(names) == sorted(cols)
    mine = sorted(canon([r[c] for c in sorted(cols)]) for r in rows)
    theirs = sorted(canon([r[names.index(c)] for c in sorted(cols)]) for r in rel.fetchall())
    assert mine == theirs
    return len(mine)
