"""IRI minting, decoding and ownership as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from catalogspark.schema import NS, Namespace

# Absolute-IRI approximation: a scheme, then no spaces, quotes, brackets or controls.
IRI_RE = r"""^[A-Za-z][A-Za-z0-9+.\-]*:[^\u0000- <>"{}|\\^`]*$"""


def encode_id(value: Column) -> Column:
    """Percent-encode everything outside A-Z a-z 0-9 - _ . ~ ."""
    form = F.url_encode(value)
    return F.replace(
        F.replace(F.replace(form, F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~")),
        F.lit("*"),
        F.lit("%2A"),
    )


def decode_id(value: Column) -> Column:
    """Inverse of encode_id; null when the encoding is broken."""
    return F.try_url_decode(F.replace(value, F.lit("+"), F.lit("%2B")))


def node_iri(node: Column, ns: Namespace = NS) -> Column:
    return F.concat(F.lit(ns.nodes), encode_id(node))


def catalog_iri(base: Column, catalog_id: Column) -> Column:
    return F.concat(base, F.lit("/catalogs/"), encode_id(catalog_id))


def dataset_iri(base: Column, dataset_id: Column) -> Column:
    return F.concat(base, F.lit("/datasets/"), encode_id(dataset_id))


def service_iri(base: Column, service_id: Column) -> Column:
    return F.concat(base, F.lit("/services/"), encode_id(service_id))


def child_iri(parent: Column, segment: str | Column, idx: Column) -> Column:
    segment = F.lit(f"/{segment}/") if isinstance(segment, str) else segment
    return F.concat(parent, segment, idx.cast("string"))


def strip_decode(iri: Column, prefix: Column) -> Column:
    """The id behind `prefix`, null when `iri` does not start with it."""
    return F.when(
        F.startswith(iri, prefix), decode_id(F.substr(iri, F.length(prefix) + F.lit(1)))
    )


def is_iri(value: Column) -> Column:
    return value.rlike(IRI_RE)


def property_predicate(key: Column, ns: Namespace = NS) -> Column:
    return F.when(is_iri(key), key).otherwise(
        F.concat(F.lit(ns.property_prefix), encode_id(key))
    )


def property_key(predicate: Column, ns: Namespace = NS) -> Column:
    rest = F.substr(predicate, F.lit(len(ns.property_prefix) + 1))
    return F.when(
        F.startswith(predicate, F.lit(ns.property_prefix)), F.coalesce(decode_id(rest), rest)
    ).otherwise(predicate)


def owning_resource(iri: Column, ns: Namespace = NS) -> Column:
    """The dataset or service `iri` belongs to; null when it is never gated.

    Anything under a node that is neither a catalog nor a dataset or service
    path owns itself, so no allow-list can open it.
    """
    slashes = ns.nodes.count("/")
    head = F.substring_index(iri, "/", slashes + 2)  # node/kind
    ends = lambda kind: F.endswith(head, F.lit(f"/{kind}"))
    deeper = F.octet_length(head) < F.octet_length(iri)
    none = F.lit(None).cast("string")
    return (
        F.when(~F.startswith(iri, F.lit(ns.nodes)), none)
        # most are one of these, and by prefixes alone nothing is split
        .when(deeper & (ends("datasets") | ends("services")), F.substring_index(iri, "/", slashes + 3))
        .when(~F.contains(F.substr(iri, F.lit(len(ns.nodes) + 1)), F.lit("/")) | ends("catalogs"), none)
        .otherwise(iri)
    )
