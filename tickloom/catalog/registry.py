"""Registry of queries and the SQL text each is checked against."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.catalog.tables import STEP, compose, shown_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


#: Decimals of the columns a query names as ``fine``: returns, ratios and other small numbers.
FINE_DIGITS = 9


def rounded(df: DataFrame, digits: int, fine: Sequence[str] = ()) -> DataFrame:
    """Doubles at ``digits`` decimals (``fine`` ones at more), so both engines agree past their summation order.

    The step lies a little off one half: values exactly between two grid points are common (half
    a cent) and would fall either way with the order of a sum.
    """
    def shown(name: str):
        scale = float(10 ** (FINE_DIGITS if name in fine else digits))
        return (F.floor(F.col(name) * scale + STEP) / scale).alias(name)

    return df.select(*[shown(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in df.schema.fields])


def query(
    name: str, sql: str | None = None, uses: Sequence[str] = (), doubles: Sequence[str] = (), digits: int = 5, fine: Sequence[str] = ()
):
    """Register ``fn(spark, folder)``; ``doubles`` names the columns rounded on the SQL side, ``fine`` those compared to more decimals."""

    def register(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return rounded(fn(spark, folder), digits, fine)

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            body = compose(sql, uses)
            if doubles:
                shown = ", ".join(f'{shown_sql(c, FINE_DIGITS if c in fine else digits)} AS "{c}"' for c in doubles)
                body = f"SELECT * REPLACE ({shown}) FROM ({body}) AS result"
            ORACLES[name] = body
        return fn

    return register
