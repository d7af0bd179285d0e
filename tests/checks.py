"""Comparison of a registered query with its SQL."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def rows(df):
    """Sorted rows as text, columns by name; floats to nine digits."""
    df = df[sorted(df.columns)]

    def text(v):
        if v is None or v != v:
            return "null"
        if isinstance(v, bool) or type(v).__name__ == "bool":
            return str(bool(v))
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    return sorted(tuple(text(v) for v in r) for r in df.itertuples(index=False, name=None))


def same(spark, entry, name, sf_dir):
    got = entry.queries()[name](spark, sf_dir).toPandas()
    want = duck(sf_dir).sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
