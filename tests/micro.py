"""Hand-made micro tables (FIXTURES.md) for the tests."""
import datetime as dt

from covista.sources.tables import PAGEVIEWS_SCHEMA, PRODUCTS_SCHEMA

D = dt.date
T = dt.datetime


def views(spark, rows):
    """rows: (sku, visitor, user, timestamp, dwell)"""
    return spark.createDataFrame(rows, PAGEVIEWS_SCHEMA)


def products(spark, rows):
    """rows: (sku, subcat, subsubcat, first visible date, visible)"""
    return spark.createDataFrame(rows, PRODUCTS_SCHEMA)
