"""Catalogs as offers: JSON-LD text assembled from the tables."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogspark.functions.odrl import candidates
from catalogspark.operators.policy import RULE, policy_sets
from catalogspark.schema import (
    DATASET_KEY,
    DCAT,
    MAX_CONSTRAINT_DEPTH,
    MAX_SERVED_GROUP_DEPTH,
    NS,
    ODRL,
    RULE_KINDS,
    CatalogTables,
    Namespace,
)

PAGE = 10_000  # datasets per offer row
WITH_NULLS = {"ignoreNullFields": "false"}


def quoted(column: Column | str) -> Column:
    """A string as a JSON string."""
    listed = F.to_json(F.array(column))
    return F.substr(listed, F.lit(2), F.length(listed) - F.lit(2))


def joined(items: Column) -> Column:
    """Texts collected as (order, text) structs -> one JSON array."""
    texts = F.transform(F.array_sort(items), lambda e: e["text"])
    return F.concat(F.lit("["), F.array_join(texts, ","), F.lit("]"))


def _constraint_texts(content: DataFrame, ns: Namespace, stored: bool = False) -> DataFrame:
    """(policy_set, rule, idx, text) of top-level constraints, folded bottom-up.
    As served, groups nested too deep become the marker and andSequence is `and`;
    as `stored`, every group keeps its name and its contents."""
    deepest = MAX_CONSTRAINT_DEPTH if stored else MAX_SERVED_GROUP_DEPTH
    names = ["left_operand", "operator", "right_operand"] if stored else [
        "leftOperand", "operator", "rightOperand"
    ]
    rows = content.filter(f"tag = 'constraint' and depth <= {deepest}")
    marker = {
        "leftOperand": "", "operator": ns.unmappable_operator,
        "rightOperand": "logical group nested beyond the served depth limit",
    }
    own = F.when(
        F.col("op") == "atomic",
        F.to_json(
            F.struct(*[F.col(c).alias(n) for c, n in zip(["left_operand", "operator", "right_operand"], names)])
        ),
    )
    if not stored:
        own = own.when(F.col("depth") >= deepest, F.lit(json.dumps(marker)))
    rows = rows.select("policy_set", *RULE, "path", "depth", "op", own.alias("text"))
    depth = rows.agg(F.max("depth")).first()[0] or 0
    key = F.when(F.col("op") == "andSequence", "and").otherwise(F.col("op"))
    if stored:
        key = F.concat(F.lit("odrl:"), F.col("op"))
    for level in range(depth, -1, -1):
        # Groups of this level have all their children by now.
        if level < depth:
            group = F.concat(F.lit('{"'), key, F.lit('":'), joined(F.col("nested")), F.lit("}"))
            rows = rows.withColumn(
                "text", F.when((F.col("depth") == level) & F.col("text").isNull(), group)
                .otherwise(F.col("text"))
            ).drop("nested")
        else:
            empty = F.concat(F.lit('{"'), key, F.lit('":[]}'))
            rows = rows.withColumn(
                "text", F.when((F.col("depth") == level) & F.col("text").isNull(), empty)
                .otherwise(F.col("text"))
            )
        if level == 0:
            break
        child = F.col("depth") == level
        place = F.struct(F.element_at("path", -1).alias("i"), "text")
        rows = (
            rows.withColumn(
                "at",
                F.when(child, F.slice("path", 1, F.size("path") - 1)).otherwise(F.col("path")),
            )
            .groupBy("policy_set", *RULE, "at")
            .agg(
                F.min("depth").alias("depth"),
                F.max(F.when(~child, F.col("op"))).alias("op"),
                F.max(F.when(~child, F.col("text"))).alias("text"),
                F.collect_list(F.when(child, place)).alias("nested"),
            )
            .withColumnRenamed("at", "path")
        )
    return rows.select("policy_set", *RULE, F.element_at("path", 1).alias("i"), "text")


def policy_texts(tables: CatalogTables, ns: Namespace = NS, stored: bool = False) -> DataFrame:
    """(node_id, dataset_id, has_policy): each dataset's policies as a JSON
    array, built once per distinct policy set, as offers serve them or as the
    catalog stores them."""
    sets = policy_sets(tables, with_labels=True)
    content = sets.content
    constraints = (
        _constraint_texts(content, ns, stored)
        .groupBy("policy_set", *RULE)
        .agg(joined(F.collect_list(F.struct("i", "text"))).alias("constraints"))
    )
    held = F.concat(F.lit(',"constraint":'), F.col("constraints"))
    if stored:
        held = F.concat(F.lit(',"constraints":'), F.coalesce("constraints", F.lit("[]")))
    rule = F.concat(
        F.lit('{"action":'), quoted("action"), F.coalesce(held, F.lit("")), F.lit("}"),
    )
    kinds = [
        F.collect_list(
            F.when(F.col("rule_kind") == k, F.struct(F.col("rule_idx").alias("i"), "text"))
        ).alias(k)
        for k in RULE_KINDS
    ]
    rules = (
        content.filter("tag = 'rule'")
        .join(constraints, ["policy_set", *RULE], "left")
        .select("policy_set", *RULE, rule.alias("text"))
        .groupBy("policy_set", "policy_idx")
        .agg(*kinds)
    )
    head = F.to_json(
        F.struct(
            F.col("kind").alias("@type"), F.col("policy_id").alias("@id"),
            F.col("assigner").alias("odrl:assigner"), F.col("assignee").alias("odrl:assignee"),
        )
    )
    tail = [
        F.when(F.size(k) > 0, F.concat(F.lit(f',"{k}":'), joined(F.col(k)))).otherwise("")
        for k in RULE_KINDS
    ]
    if stored:
        head = F.to_json(
            F.struct(F.col("policy_id").alias("id"), "kind", "assigner", "assignee"), WITH_NULLS
        )
        tail = [
            F.concat(F.lit(f',"{k}s":'), F.coalesce(joined(F.col(k)), F.lit("[]")))
            for k in RULE_KINDS
        ]
    body = F.concat(
        F.substr(head, F.lit(1), F.length(head) - F.lit(1)),
        *[F.coalesce(t, F.lit("")) for t in tail],
        F.lit("}"),
    )
    policies = (
        content.filter("tag = 'policy'")
        .join(rules, ["policy_set", "policy_idx"], "left")
        .select("policy_set", F.col("policy_idx").alias("i"), body.alias("text"))
        .groupBy("policy_set")
        .agg(joined(F.collect_list(F.struct("i", "text"))).alias("has_policy"))
    )
    return sets.members.join(policies, "policy_set").select(*DATASET_KEY, "has_policy")


def dataset_offers(tables: CatalogTables) -> DataFrame:
    """One row per dataset with the fields an offer shows."""
    first = tables.distributions.groupBy(*DATASET_KEY).agg(
        F.min_by("format", "idx").alias("contenttype")
    )
    prop = lambda k: F.try_element_at("properties", F.lit(k))
    creator = F.when(
        prop("creatorName").isNotNull(),
        F.struct(
            prop("creatorName").alias("name"),
            F.struct(F.coalesce(prop("thumbnail"), F.lit("")).alias("resource")).alias("thumbnail"),
        ),
    )
    # as long as datasets, like the policies' texts below
    return tables.datasets.join(first.hint("merge"), DATASET_KEY, "left").select(
        *DATASET_KEY,
        "idx",
        F.col("dataset_id").alias("name"),
        F.coalesce("contenttype", F.lit("")).alias("contenttype"),
        prop("title").alias("title"),
        prop("description").alias("description"),
        prop("version").alias("version"),
        creator.alias("creator"),
        F.when(prop("thumbnail").isNotNull(), F.struct(prop("thumbnail").alias("resource"))).alias(
            "thumbnail"
        ),
        F.when(F.size(candidates(prop("keywords"))) > 0, candidates(prop("keywords"))).alias(
            "keywords"
        ),
    )


def offer_headers(tables: CatalogTables) -> DataFrame:
    """One row per catalog that lists a service, with the first service."""
    first = tables.services.groupBy("node_id").agg(
        F.min_by(F.struct("service_id", "endpoint_url", "endpoint_description"), "idx").alias("s")
    )
    return tables.catalogs.join(first, "node_id").select(
        "node_id",
        "catalog_id",
        F.coalesce("participant_id", "node_id").alias("originator"),
        "s.service_id",
        "s.endpoint_url",
        F.coalesce("s.endpoint_description", F.lit("")).alias("endpoint_description"),
    )


def skipped_catalogs(tables: CatalogTables) -> DataFrame:
    """Catalogs left out of the offers: they list no service."""
    listed = tables.services.select("node_id").distinct()
    return tables.catalogs.join(listed, "node_id", "left_anti").select("node_id", "catalog_id")


def offers(tables: CatalogTables, page_size: int = PAGE, ns: Namespace = NS) -> DataFrame:
    """(node_id, catalog_id, page, offer): the offers as JSON.

    An offer holds at most `page_size` list positions of datasets; a larger
    catalog continues in further rows with the same header, so no row grows
    with the catalog and none of its datasets is left out.
    """
    fields = ["name", "contenttype", "title", "description", "version", "creator", "thumbnail",
              "keywords"]
    shown = F.to_json(
        F.struct(F.col("dataset_id").alias("@id"), F.lit("Dataset").alias("@type"), *fields)
    )
    item = F.concat(
        F.substr(shown, F.lit(1), F.length(shown) - F.lit(1)),
        F.lit(f',"{ODRL}hasPolicy":'),
        F.coalesce("has_policy", F.lit("[]")),
        F.lit("}"),
    )
    pages = (
        dataset_offers(tables)
        .join(policy_texts(tables, ns).hint("merge"), DATASET_KEY, "left")
        .select("node_id", F.floor(F.col("idx") / page_size).alias("page"),
                F.struct("idx", item.alias("text")).alias("item"))
        .groupBy("node_id", "page")
        .agg(joined(F.collect_list("item")).alias("datasets"))
    )
    head = F.to_json(
        F.struct(
            F.col("catalog_id").alias("@id"),
            F.lit("Catalog").alias("@type"),
            F.struct(
                F.col("service_id").alias("@id"),
                F.lit("DataService").alias("@type"),
                F.col("endpoint_description").alias(DCAT + "endpointDescription"),
                F.col("endpoint_url").alias(DCAT + "endpointURL"),
            ).alias(DCAT + "service"),
            F.struct(F.col("originator").alias("@id")).alias("participantId"),
            "originator",
        )
    )
    offer = F.concat(
        F.substr(head, F.lit(1), F.length(head) - F.lit(1)),
        F.coalesce(F.concat(F.lit(f',"{DCAT}dataset":'), F.col("datasets")), F.lit("")),
        F.lit("}"),
    )
    return (
        offer_headers(tables)
        .join(pages, "node_id", "left")
        .select("node_id", "catalog_id", F.coalesce("page", F.lit(0)).alias("page"),
                offer.alias("offer"))
    )


def requested_dataset(body: str) -> str | None:
    """The dataset id a request body filters by: the first `datasets.id` `=`
    entry; any other filter, and an unreadable body, mean no filter."""
    try:
        entries = json.loads(body)["filterExpression"]
        for e in entries:
            if e.get("operandLeft") == "datasets.id" and e.get("operator") == "=":
                return e.get("operandRight", "")
    except (ValueError, KeyError, TypeError, AttributeError):
        pass
    return None


def offers_with_dataset(
    tables: CatalogTables, dataset_id: str, page_size: int = PAGE, ns: Namespace = NS
) -> DataFrame:
    """The offers, all their pages, of catalogs that hold the dataset."""
    holders = catalogs_with_dataset(tables, dataset_id).select("node_id").distinct()
    keep = lambda _, df: df.join(holders, "node_id", "left_semi")
    return offers(tables.map(keep), page_size, ns)


def catalogs_with_dataset(tables: CatalogTables, dataset_id: str) -> DataFrame:
    """(node_id, catalog_id) of offers that hold the dataset, after policy filtering."""
    holders = tables.datasets.filter(F.col("dataset_id") == dataset_id).select("node_id")
    return offer_headers(tables).join(holders, "node_id", "left_semi").select(
        "node_id", "catalog_id"
    )
