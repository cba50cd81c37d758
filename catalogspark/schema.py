"""Table schemas, namespaces and limits shared by every module."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

# Public vocabulary namespaces.
DCAT = "http://www.w3.org/ns/dcat#"
DCT = "http://purl.org/dc/terms/"
ODRL = "http://www.w3.org/ns/odrl/2/"
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
XSD_STRING = "http://www.w3.org/2001/XMLSchema#string"
XSD_INTEGER = "http://www.w3.org/2001/XMLSchema#integer"
RDF_LANG_STRING = "http://www.w3.org/1999/02/22-rdf-syntax-ns#langString"

# Limits and word lists of the catalog model.
MAX_CONSTRAINT_DEPTH = 64
MAX_SERVED_GROUP_DEPTH = 56
UNMAPPABLE_EXCERPT_MAX = 256
MAX_RESPONSE_BYTES = 16 * 1024 * 1024
DESCRIPTORS = ["title", "description", "version", "creatorName", "thumbnail", "keywords"]
RULE_KINDS = ["permission", "prohibition", "obligation"]
GROUP_OPS = ["xone", "or", "and", "andSequence"]  # reading precedence
OPERATORS = [
    "eq", "neq", "isAnyOf", "isAllOf", "isNoneOf", "isPartOf", "lt", "lteq", "gt", "gteq",
]
PER_TOKEN_CLAIMS = ["jti", "iat", "exp", "nbf"]


@dataclass(frozen=True)
class Namespace:
    """Where minted IRIs live. Point these at an existing deployment's values
    to run its saved graph queries unchanged."""

    nodes: str = "https://catalogspark.internal/nodes/"
    terms: str = "https://catalogspark.internal/ns#"
    unmappable_operator: str = "urn:catalogspark:unmappable"
    unmappable_action: str = "urn:catalogspark:unmappable-action"

    @property
    def property_prefix(self) -> str:
        return self.terms + "property/"

    @property
    def participant_id(self) -> str:
        return self.terms + "participantId"

    @property
    def sequence_index(self) -> str:
        return self.terms + "sequenceIndex"

    @property
    def logical_operator(self) -> str:
        return self.terms + "logicalOperator"

    @property
    def policy_id(self) -> str:
        return self.terms + "policyId"


NS = Namespace()

DATASET_KEY = ["node_id", "dataset_id"]
POLICY_KEY = DATASET_KEY + ["policy_idx"]
RULE_KEY = POLICY_KEY + ["rule_kind", "rule_idx"]

# DDL schemas.
PARTICIPANTS = (
    "node_id STRING, name STRING, catalog_request_url STRING, credential_protocol STRING, "
    "provider_did STRING, response_uri STRING"
)
RESPONSES = (
    "node_id STRING, cycle_id BIGINT, fetched_at TIMESTAMP, http_status INT, "
    "duration_ms BIGINT, body STRING"
)
CATALOGS = (
    "node_id STRING, catalog_id STRING, participant_id STRING, properties MAP<STRING,STRING>"
)
DATASETS = (
    "node_id STRING, dataset_id STRING, idx BIGINT, properties MAP<STRING,STRING>"
)
DISTRIBUTIONS = (
    "node_id STRING, dataset_id STRING, idx BIGINT, format STRING, access_service STRING"
)
SERVICES = (
    "node_id STRING, service_id STRING, idx BIGINT, endpoint_url STRING, "
    "endpoint_description STRING"
)
POLICIES = (
    "node_id STRING, dataset_id STRING, policy_idx BIGINT, policy_id STRING, kind STRING, "
    "assigner STRING, assignee STRING"
)
RULES = (
    "node_id STRING, dataset_id STRING, policy_idx BIGINT, rule_kind STRING, rule_idx BIGINT, "
    "action STRING"
)
CONSTRAINTS = (
    "node_id STRING, dataset_id STRING, policy_idx BIGINT, rule_kind STRING, rule_idx BIGINT, "
    "path ARRAY<BIGINT>, depth INT, op STRING, left_operand STRING, operator STRING, "
    "right_operand STRING"
)
QUADS = (
    "graph STRING, s STRING, p STRING, o STRING, o_kind STRING, o_datatype STRING, o_lang STRING"
)
CRAWL_LOG = (
    "node_id STRING, cycle_id BIGINT, finished_at TIMESTAMP, ok BOOLEAN, error STRING, "
    "duration_ms BIGINT"
)
CALLERS = "caller_id STRING, claims STRING"


@dataclass(frozen=True)
class CatalogTables:
    """The relational form of a set of catalogs. List order is the index
    columns' order; indexes need not be dense."""

    catalogs: DataFrame
    datasets: DataFrame
    distributions: DataFrame
    services: DataFrame
    policies: DataFrame
    rules: DataFrame
    constraints: DataFrame

    def map(self, fn) -> "CatalogTables":
        return CatalogTables(**{k: fn(k, v) for k, v in vars(self).items()})
