"""The price rules as Spark SQL scalar functions, for SQL users.

These are SQL-bodied temporary functions: the analyzer inlines the body, so
a call is an ordinary expression (constant folding, codegen), not a Python
UDF. Names carry a prefix so they never replace another definition.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from pinprice.functions.expr import MARGIN


def price_sql(buying_price: str, charge: str, margin: float = MARGIN) -> str:
    """The delivered price as SQL text; ``charge`` is a DOUBLE expression."""
    b = f"CAST({buying_price} AS DOUBLE)"
    return f"floor({b} + {margin!r}D * {b} + {charge} + 0.5D)"


def register_sql_functions(spark: SparkSession, prefix: str = "pinprice_") -> list[str]:
    """Create ``<prefix>round_half_up(x)`` and ``<prefix>delivered_price(b, charge)``."""
    defs = {
        f"{prefix}round_half_up": "(x DOUBLE) RETURNS BIGINT RETURN floor(x + 0.5D)",
        f"{prefix}delivered_price":
            f"(b DOUBLE, charge DOUBLE) RETURNS BIGINT RETURN {price_sql('b', 'charge')}",
    }
    for name, body in defs.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    return list(defs)
