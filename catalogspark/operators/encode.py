"""Catalog tables -> RDF quads, one named graph per node."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogspark.functions import iri
from catalogspark.schema import (
    DCAT,
    DCT,
    MAX_CONSTRAINT_DEPTH,
    NS,
    ODRL,
    RDF_TYPE,
    RULE_KEY,
    XSD_INTEGER,
    XSD_STRING,
    CatalogTables,
    Namespace,
)
from catalogspark.session import cut

SEGMENT = {"permission": "permissions", "prohibition": "prohibitions", "obligation": "obligations"}


def resource(s: Column, p: str | Column, o: Column | str) -> Column:
    """A quad whose object is an IRI."""
    return _quad(s, p, F.lit(o) if isinstance(o, str) else o, F.lit("iri"), F.lit(""))


def literal(s: Column, p: str | Column, o: Column, datatype: str = XSD_STRING) -> Column:
    return _quad(s, p, o.cast("string"), F.lit("literal"), F.lit(datatype))


def either(s: Column, p: str | Column, o: Column) -> Column:
    """An IRI object when the text reads as one, a plain literal otherwise."""
    named = iri.is_iri(o)
    return _quad(
        s, p, o, F.when(named, "iri").otherwise("literal"),
        F.when(named, "").otherwise(XSD_STRING),
    )


def _quad(s: Column, p: str | Column, o: Column, kind: Column, datatype: Column) -> Column:
    return F.struct(
        s.alias("s"),
        (F.lit(p) if isinstance(p, str) else p).alias("p"),
        o.alias("o"),
        kind.alias("o_kind"),
        datatype.alias("o_datatype"),
        F.lit("").alias("o_lang"),
    )


def _emit(df: DataFrame, *quads: Column, bags: tuple[Column, ...] = ()) -> DataFrame:
    """One pass over `df`; quads with no object are left out."""
    listed = F.array(*quads)
    if bags:
        # Two property keys can name one predicate; a quad set holds it once.
        listed = F.array_distinct(F.concat(listed, *bags))
    return (
        df.select("graph", F.explode(listed).alias("q"))
        .filter("q.o is not null")
        .select("graph", "q.*")
    )


def _properties(s: Column, ns: Namespace) -> Column:
    return F.transform(
        F.map_entries("properties"),
        lambda e: literal(s, iri.property_predicate(e["key"], ns), e["value"]),
    )


def refused_nodes(constraints: DataFrame) -> DataFrame:
    """Nodes holding a constraint nested past the bound: (node_id, error)."""
    return (
        constraints.groupBy("node_id")
        .agg(F.max("depth").alias("depth"))
        .filter(F.col("depth") > MAX_CONSTRAINT_DEPTH)
        .select(
            "node_id",
            F.lit(
                "constraint nested past the maximum supported logical constraint depth "
                f"({MAX_CONSTRAINT_DEPTH})"
            ).alias("error"),
        )
    )


def drop_refused(tables: CatalogTables) -> CatalogTables:
    """Leave out every table row of the refused nodes."""
    refused = cut(refused_nodes(tables.constraints).select("node_id"))  # read once for each table
    return tables.map(lambda _, df: df.join(refused, "node_id", "left_anti"))


def catalog_quads(tables: CatalogTables, ns: Namespace = NS) -> DataFrame:
    """The quads of catalogs, datasets, distributions and services."""
    graph = iri.node_iri(F.col("node_id"), ns)
    catalogs = tables.catalogs.withColumn("graph", graph).withColumn(
        "s", iri.catalog_iri(F.col("graph"), F.col("catalog_id"))
    )
    # one row a node, and seen to be few by the planner: else it is free to broadcast
    # datasets or services instead
    links = cut(catalogs.select("node_id", F.col("s").alias("catalog")))
    s = F.col("s")

    datasets = (
        tables.datasets.join(links, "node_id")
        .withColumn("graph", graph)
        .withColumn("s", iri.dataset_iri(F.col("graph"), F.col("dataset_id")))
    )
    dataset = iri.dataset_iri(F.col("graph"), F.col("dataset_id"))
    distributions = (
        tables.distributions.withColumn("graph", graph)
        .withColumn("parent", dataset)
        .withColumn("s", iri.child_iri(F.col("parent"), "distributions", F.col("idx")))
    )
    services = (
        tables.services.join(links, "node_id")
        .withColumn("graph", graph)
        .withColumn("s", iri.service_iri(F.col("graph"), F.col("service_id")))
    )
    index = literal(s, ns.sequence_index, F.col("idx"), XSD_INTEGER)
    return (
        _emit(
            catalogs,
            resource(s, RDF_TYPE, DCAT + "Catalog"),
            literal(s, ns.participant_id, F.col("participant_id")),
            bags=(_properties(s, ns),),
        )
        .unionByName(
            _emit(
                datasets,
                resource(F.col("catalog"), DCAT + "dataset", s),
                resource(s, RDF_TYPE, DCAT + "Dataset"),
                index,
                bags=(_properties(s, ns),),
            )
        )
        .unionByName(
            _emit(
                distributions,
                resource(F.col("parent"), DCAT + "distribution", s),
                resource(s, RDF_TYPE, DCAT + "Distribution"),
                index,
                literal(s, DCT + "format", F.col("format")),
                resource(
                    s, DCAT + "accessService",
                    iri.service_iri(F.col("graph"), F.col("access_service")),
                ),
            )
        )
        .unionByName(
            _emit(
                services,
                resource(F.col("catalog"), DCAT + "service", s),
                resource(s, RDF_TYPE, DCAT + "DataService"),
                index,
                either(s, DCAT + "endpointURL", F.col("endpoint_url")),
                literal(s, DCAT + "endpointDescription", F.col("endpoint_description")),
            )
        )
    )


def policy_quads(tables: CatalogTables, ns: Namespace = NS) -> DataFrame:
    """The quads of policies, rules and constraints."""
    graph = iri.node_iri(F.col("node_id"), ns)
    s = F.col("s")

    def with_policy(df: DataFrame) -> DataFrame:
        return df.withColumn("graph", graph).withColumn(
            "policy",
            iri.child_iri(
                iri.dataset_iri(F.col("graph"), F.col("dataset_id")), "policies",
                F.col("policy_idx"),
            ),
        )

    def with_rule(df: DataFrame) -> DataFrame:
        segment = F.concat(F.lit("/"), F.col("rule_kind"), F.lit("s/"))
        return with_policy(df).withColumn(
            "rule", iri.child_iri(F.col("policy"), segment, F.col("rule_idx"))
        )

    def below_rule(path: Column) -> Column:
        steps = F.transform(path, lambda i: F.concat(F.lit("/constraints/"), i.cast("string")))
        return F.concat(F.col("rule"), F.array_join(steps, ""))

    policies = with_policy(tables.policies).withColumn("s", F.col("policy"))
    rules = with_rule(tables.rules).withColumn("s", F.col("rule"))
    constraints = with_rule(tables.constraints).withColumn("s", below_rule(F.col("path")))
    own_index = F.element_at("path", -1)

    parent_path = F.slice("path", 1, F.size("path") - 1)
    groups = tables.constraints.filter(F.col("op") != "atomic").select(
        *RULE_KEY, F.col("path").alias("parent_path"), F.col("op").alias("parent_op")
    )
    nested = (
        constraints.filter(F.col("depth") > 0)
        .withColumn("parent_path", parent_path)
        .join(groups.hint("merge"), [*RULE_KEY, "parent_path"])  # as long as constraints
    )
    atomic = F.col("op") == "atomic"
    when = lambda q: F.when(atomic, q)
    return (
        _emit(
            policies,
            resource(
                iri.dataset_iri(F.col("graph"), F.col("dataset_id")), ODRL + "hasPolicy", s
            ),
            resource(s, RDF_TYPE, F.concat(F.lit(ODRL), F.col("kind"))),
            literal(s, ns.sequence_index, F.col("policy_idx"), XSD_INTEGER),
            literal(s, ns.policy_id, F.col("policy_id")),
            either(s, ODRL + "assigner", F.col("assigner")),
            either(s, ODRL + "assignee", F.col("assignee")),
        )
        .unionByName(
            _emit(
                rules,
                resource(F.col("policy"), F.concat(F.lit(ODRL), F.col("rule_kind")), s),
                literal(s, ns.sequence_index, F.col("rule_idx"), XSD_INTEGER),
                either(s, ODRL + "action", F.col("action")),
            )
        )
        .unionByName(
            _emit(
                constraints,
                F.when(F.col("depth") == 0, resource(F.col("rule"), ODRL + "constraint", s)),
                literal(s, ns.sequence_index, own_index, XSD_INTEGER),
                when(either(s, ODRL + "leftOperand", F.col("left_operand"))),
                when(either(s, ODRL + "operator", F.col("operator"))),
                when(literal(s, ODRL + "rightOperand", F.col("right_operand"))),
                F.when(
                    ~atomic, resource(s, ns.logical_operator, F.concat(F.lit(ODRL), F.col("op")))
                ),
            )
        )
        .unionByName(
            _emit(
                nested,
                resource(
                    below_rule(F.col("parent_path")),
                    F.concat(F.lit(ODRL), F.col("parent_op")),
                    s,
                ),
            )
        )
    )


def encode(tables: CatalogTables, ns: Namespace = NS) -> DataFrame:
    """All quads of the catalogs the store accepts.

    Given ids unique within a node, every quad is emitted once, so no
    de-duplicating shuffle is needed.
    """
    kept = drop_refused(tables)
    return catalog_quads(kept, ns).unionByName(policy_quads(kept, ns))
