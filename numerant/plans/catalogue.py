"""All queries of the library's own operators, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from numerant.operators.claims import order_blocks, order_claims, statements
from numerant.operators.figures import extract_figures
from numerant.operators.status import figure_statuses
from numerant.plans import calculations, claims, ledgers, store, texts
from numerant.sources.tables import table

MODULES = (texts, claims, calculations, ledgers, store)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements about orders, as text: figures are read from them, joined with what they cite, and get a status."""
    orders = table(spark, sf_dir, "orders")
    claims_made = order_claims(orders)
    figures = extract_figures(statements(claims_made), "figure_id").join(claims_made.select("figure_id", "block"), "figure_id")
    return figure_statuses(figures, order_blocks(orders)).groupBy("status").count()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
