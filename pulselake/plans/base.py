"""Registration of queries with their SQL, both with plain column types."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def plain(df: DataFrame) -> DataFrame:
    """Dates and times as text, arrays joined by commas: types that every engine prints alike."""
    out = {}
    for name, kind in df.dtypes:
        if kind == "date":
            out[name] = F.date_format(name, "yyyy-MM-dd")
        elif kind.startswith("timestamp"):
            out[name] = F.date_format(name, "yyyy-MM-dd HH:mm:ss")
        elif kind.startswith("array"):
            out[name] = F.array_join(F.col(name).cast("array<string>"), ",")
    return df.withColumns(out) if out else df


class Registry:
    """Queries and oracles of one module."""

    def __init__(self):
        self.queries, self.oracles = {}, {}

    def __call__(self, name: str, sql: str | None = None, dates=(), times=(), lists=()):
        """Registers a query; dates, times and lists name the SQL's columns that are made plain."""
        casts = [f"strftime({c}, '%Y-%m-%d') AS {c}" for c in dates] + [f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {c}" for c in times] + [f"array_to_string({c}, ',') AS {c}" for c in lists]

        def keep(f):
            def run(spark, sf_dir):
                return plain(f(spark, sf_dir))

            run.__name__, run.__doc__ = name, f.__doc__
            self.queries[name] = run
            if sql:
                self.oracles[name] = f"SELECT * REPLACE ({', '.join(casts)}) FROM ({sql})" if casts else sql
            return f

        return keep
