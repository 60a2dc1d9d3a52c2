"""Identifiers in a book-search response."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tomeweave.functions.text import let

ITEMS_TYPE = (
    "ARRAY<STRUCT<volumeInfo: STRUCT<industryIdentifiers: "
    "ARRAY<STRUCT<type: STRING, identifier: STRING>>>>>"
)
RESPONSE_SCHEMA = f"items {ITEMS_TYPE}"
ENOUGH = 6


def parse_response(body: Column) -> Column:
    return F.from_json(body, RESPONSE_SCHEMA)


def extract_identifiers(response: Column) -> Column:
    """Identifiers in item order, the long form before the short form of each item.

    Reading stops at the first item without identifiers and opens no item once ``ENOUGH``
    identifiers are held, so one more than that may come out.
    """

    def last_of(ids: Column, kind: str) -> Column:
        # Within an item the last entry of a type wins.
        return F.try_element_at(F.filter(ids, lambda x: x["type"] == kind), F.lit(-1))["identifier"]

    def step(state: Column, item: Column) -> Column:
        ids = item["volumeInfo"]["industryIdentifiers"]
        stop = state["done"] | ids.isNull() | (F.size(state["ids"]) >= ENOUGH)
        found = F.array_compact(F.array(last_of(ids, "ISBN_13"), last_of(ids, "ISBN_10")))
        return F.struct(
            F.when(stop, state["ids"]).otherwise(F.concat(state["ids"], found)).alias("ids"),
            stop.alias("done"),
        )

    start = F.struct(
        F.array().cast("array<string>").alias("ids"), F.lit(False).alias("done")
    )
    items = F.coalesce(response["items"], F.array().cast(ITEMS_TYPE))
    return let(items, lambda xs: F.aggregate(xs, start, step, lambda s: s["ids"]))


def safe_isbn_number(isbn: Column) -> Column:
    """The key as a number: NULL where a check digit is ``X``."""
    return isbn.try_cast("bigint")
