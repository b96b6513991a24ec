"""Compare a Spark result with a DuckDB result as bags of rows."""

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connection(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def differences(a, b):
    """Text describing how two pandas frames differ; empty when they hold the same rows."""
    if sorted(a.columns) != sorted(b.columns):
        return f"columns {list(a.columns)} / {list(b.columns)}"
    if len(a) != len(b):
        return f"rows {len(a)} / {len(b)}"
    exact = [c for c in a.columns if a[c].dtype.kind != "f"]
    order = exact + [c for c in a.columns if c not in exact]
    frames = []
    for f in (a, b):
        f = f[order].copy()
        for c in order:
            if f[c].dtype.kind == "M":
                f[c] = f[c].astype("datetime64[us]")
        frames.append(f.sort_values(order, ignore_index=True))
    out = []
    for c in order:
        x, y = frames[0][c], frames[1][c]
        bad = ~((x == y) | (x.isna() & y.isna()))
        if bad.any():
            i = bad[bad].index[:3]
            out.append(f"{c}: {int(bad.sum())} rows, {x[i].tolist()} / {y[i].tolist()}")
    return "; ".join(out)
