import os

import duckdb


def rows(sf, table, columns):
    p = f"/root/testdata/{sf}/{table}.parquet"
    return duckdb.sql(f"select {columns} from '{p + '/*.parquet' if os.path.isdir(p) else p}'").fetchall()


def texts(sf):
    return [r[0] for r in rows(sf, "documents", "text")]
