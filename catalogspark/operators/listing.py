"""Catalog listing: filter, stable order, paging, nested JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogspark.operators.offers import PAGE, WITH_NULLS, joined, policy_texts, quoted
from catalogspark.operators.paging import behind
from catalogspark.schema import DATASET_KEY, CatalogTables


def list_catalogs(
    catalogs: DataFrame, node_id: str | None = None, offset: int = 0, limit: int | None = None
) -> DataFrame:
    """By catalog id, then node; skip `offset`, then take `limit`."""
    df = catalogs if node_id is None else catalogs.filter(F.col("node_id") == node_id)
    order = ["catalog_id", "node_id"]
    if limit is None:
        return behind(df, offset, *order) if offset else df.orderBy(*order)
    return df.orderBy(*order).offset(offset).limit(limit)


def node_tables(tables: CatalogTables, node_id: str) -> CatalogTables:
    return tables.map(lambda _, df: df.filter(F.col("node_id") == node_id))


def catalog_json(tables: CatalogTables, page_size: int = PAGE) -> DataFrame:
    """(node_id, catalog_id, page, catalog): the catalog list as JSON, policies in
    their stored shape, in pages of list positions like the offers; services are
    paged the same way."""
    part = F.struct("idx", F.to_json(F.struct("format", "access_service")).alias("text"))
    parts = tables.distributions.groupBy(*DATASET_KEY).agg(
        joined(F.collect_list(part)).alias("distributions")
    )
    dataset = F.concat(
        F.lit('{"id":'), quoted("dataset_id"),
        F.lit(',"properties":'), F.to_json("properties"),
        F.lit(',"distributions":'), F.coalesce("distributions", F.lit("[]")),
        F.lit(',"policies":'), F.coalesce("has_policy", F.lit("[]")), F.lit("}"),
    )
    service = F.to_json(
        F.struct(F.col("service_id").alias("id"), "endpoint_url", "endpoint_description"), WITH_NULLS
    )
    page = F.floor(F.col("idx") / page_size).alias("page")
    items = (
        tables.datasets.join(parts, DATASET_KEY, "left")
        .join(policy_texts(tables, stored=True), DATASET_KEY, "left")
        .select("node_id", page, F.lit("d").alias("of"), "idx", dataset.alias("text"))
        .unionByName(
            tables.services.select("node_id", page, F.lit("s").alias("of"), "idx",
                                   service.alias("text"))
        )
    )
    of = lambda tag: joined(
        F.collect_list(F.when(F.col("of") == tag, F.struct("idx", "text")))
    )
    pages = items.groupBy("node_id", "page").agg(of("d").alias("datasets"), of("s").alias("services"))
    head = F.to_json(
        F.struct(
            F.col("catalog_id").alias("id"), F.col("node_id").alias("origin_node"),
            "participant_id", "properties",
        ),
        WITH_NULLS,
    )
    catalog = F.concat(
        F.substr(head, F.lit(1), F.length(head) - F.lit(1)),
        F.lit(',"datasets":'), F.coalesce("datasets", F.lit("[]")),
        F.lit(',"data_services":'), F.coalesce("services", F.lit("[]")), F.lit("}"),
    )
    return tables.catalogs.join(pages, "node_id", "left").select(
        "node_id", "catalog_id", F.coalesce("page", F.lit(0)).alias("page"),
        catalog.alias("catalog"),
    )
