"""Catalog tables derived from the TPC-H-like driver tables.

Every table is a projection or a distinct over the whole inputs, so the work
grows with them. List positions are order-preserving numbers computed from the
keys, so no window over a node is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogspark.schema import CatalogTables
from catalogspark.session import cut

# The market segments of the customer table, in order.
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
BAYS = 10  # services per supplier that datasets use; one more is never used
AS_OF = "2026-01-01T00:00:00Z"


# Input schemas, given so that no scan is spent on inferring them.
SCHEMAS = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, "
    "c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, "
    "p_retailprice DOUBLE",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, "
    "l_returnflag STRING, l_linestatus STRING",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, "
    "value DOUBLE, props STRING",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[table]).parquet(f"{sf_dir}/{table}.parquet")


def participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "nation").selectExpr(
        "'nation-' || n_nationkey AS node_id",
        "IF(n_nationkey % 10 = 9, ' ', n_name) AS name",
        "'https://' || lower(n_name) || '.example/catalog' AS catalog_request_url",
        "element_at(array('none', 'dcp', 'oid4vp', 'basic'), n_nationkey % 4 + 1)"
        " AS credential_protocol",
        "IF(n_nationkey % 3 = 1, 'did:web:nation-' || n_nationkey, NULL) AS provider_did",
        "IF(n_nationkey % 5 = 1, 'https://' || lower(n_name) || '/vp', NULL) AS response_uri",
    )


def catalogs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        read(spark, sf_dir, "nation")
        .join(read(spark, sf_dir, "region"), F.expr("n_regionkey = r_regionkey"))
        .selectExpr(
            "'nation-' || n_nationkey AS node_id",
            "'catalog-' || n_regionkey AS catalog_id",
            "IF(n_nationkey % 3 = 1, 'did:web:nation-' || n_nationkey, NULL) AS participant_id",
            "map('region', r_name, 'http://purl.org/dc/terms/publisher', n_name) AS properties",
        )
    )


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who ships what: one row per line item with its supplier's nation."""
    supplier = read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    return read(spark, sf_dir, "lineitem").join(supplier, F.expr("l_suppkey = s_suppkey"))


SHIPPED = ["s_nationkey", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus"]


def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct ways in which a nation's suppliers ship a part."""
    return offers(spark, sf_dir).select(*SHIPPED).distinct()


def holdings(spark: SparkSession, sf_dir: str, offered: DataFrame) -> DataFrame:
    """One row per dataset: a nation and a part it ships, with the part's columns.
    The part table grows with the others and is small only as a file, so it is
    never broadcast; what a part is turned into is worked out from these rows."""
    part = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    held = offered.select("s_nationkey", "l_partkey").distinct()
    return held.join(part.hint("merge"), F.expr("l_partkey = p_partkey")).drop("l_partkey")


def _per_dataset(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.selectExpr(
        "'nation-' || s_nationkey AS node_id", "'part-' || p_partkey AS dataset_id", *columns
    )


DATASET_PROPERTIES = """
map_filter(map(
    'title', p_name,
    'version', string(p_size),
    'keywords', replace(p_name, ' ', ', '),
    'creatorName', IF(p_size % 2 = 0, p_brand, NULL),
    'thumbnail', IF(p_size % 4 = 0, 'https://img.example/' || p_partkey, NULL)
), (k, v) -> v IS NOT NULL)"""


def datasets(spark: SparkSession, sf_dir: str, held: DataFrame | None = None) -> DataFrame:
    held = holdings(spark, sf_dir, offers(spark, sf_dir)) if held is None else held
    return _per_dataset(held, "p_partkey AS idx", f"{DATASET_PROPERTIES} AS properties")


def services(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        read(spark, sf_dir, "supplier")
        .selectExpr("*", f"explode(sequence(0, {BAYS})) AS bay")
        .selectExpr(
            "'nation-' || s_nationkey AS node_id",
            "'supplier-' || s_suppkey || '-bay-' || bay AS service_id",
            f"s_suppkey * {BAYS + 1} + bay AS idx",
            "'https://supplier-' || s_suppkey || '.example/' || bay AS endpoint_url",
            "IF(s_acctbal >= 0, s_name, NULL) AS endpoint_description",
        )
    )


def distributions(ways: DataFrame) -> DataFrame:
    """Per dataset, one distribution per supplier, return flag and line status.
    Every seventh part points at a service nobody lists."""
    return (
        ways.selectExpr(
            "'nation-' || s_nationkey AS node_id",
            "'part-' || l_partkey AS dataset_id",
            "l_suppkey * 6 + 2 * CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END"
            " + IF(l_linestatus = 'F', 0, 1) AS idx",
            "l_returnflag || l_linestatus AS format",
            f"""IF(l_partkey % 7 = 0, 'ghost-' || l_suppkey,
                'supplier-' || l_suppkey || '-bay-' || l_partkey % {BAYS}) AS access_service""",
        )
    )


SEGMENT = f"element_at(array({', '.join(repr(s) for s in SEGMENTS)}), int(p_partkey % 5) + 1)"


def _constraint(path: str, op: str, left="NULL", operator="NULL", right="NULL") -> str:
    return f"""named_struct(
        'path', transform(array({path}), x -> bigint(x)), 'depth', size(array({path})) - 1,
        'op', '{op}', 'left_operand', string({left}), 'operator', string({operator}),
        'right_operand', string({right}))"""


def _rule(idx: int, kind: str, *constraints: str) -> str:
    return f"""named_struct(
        'policy_idx', bigint({idx}), 'rule_kind', '{kind}', 'rule_idx', bigint(0),
        'action', 'odrl:use', 'constraints', array_compact(array({', '.join(constraints)})))"""


def part_rules(variant: str = "") -> str:
    """The rules of one part's policies, as an array of structs.

    Policy 0 (unless p_size % 5 = 0) permits use by segment X, with an
    unknown-operator constraint for one brand, and for promo parts prohibits
    use to three nations. Policy 1 (when p_size % 3 = 0) permits use to exactly
    one of segment X or nation p_partkey % 5. `variant` adds to policy 0:
    'assignee' scopes it to ten customers, 'ordered' asks for a balance and a
    date; 'groups' asks for nested logical groups instead.
    """
    first = [
        _constraint("0", "atomic", "'segment'", "'eq'", SEGMENT),
        f"""IF(p_brand = 'Brand#13', {_constraint("1", "atomic", "'segment'", "'bogus'", "'x'")},
            NULL)""",
    ]
    if variant == "groups":
        first = [
            _constraint("0", "or"),
            _constraint("0, 0", "and"),
            _constraint("0, 0, 0", "atomic", "'segment'", "'eq'", SEGMENT),
            _constraint("0, 0, 1", "atomic", "'nation'", "'isNoneOf'", "'1,2 , 3'"),
            _constraint("0, 1", "andSequence"),
            _constraint("0, 1, 0", "atomic", "'nation'", "'eq'", "p_partkey % 25"),
            _constraint("0, 2", "xone"),
        ]
    if variant == "ordered":
        until = "IF(p_size % 2 = 0, '2027-01-01T00:00:00Z', '2026-01-01T01:00:00+02:00')"
        first += [
            _constraint("2", "atomic", "'balance'", "'gteq'", "p_size * 100"),
            _constraint("3", "atomic", "'dateTime'", "'lteq'", until),
        ]
    prohibited = _constraint("0", "atomic", "'nation'", "'isAnyOf'", "'1, 2,3'")
    either = [
        _constraint("0", "xone"),
        _constraint("0, 0", "atomic", "'segment'", "'eq'", SEGMENT),
        _constraint("0, 1", "atomic", "'odrl:nation'", "'odrl:eq'", "p_partkey % 5"),
    ]
    return f"""array_compact(array(
        IF(p_size % 5 <> 0, {_rule(0, "permission", *first)}, NULL),
        IF(p_size % 5 <> 0 AND p_type = 'PROMO', {_rule(0, "prohibition", prohibited)}, NULL),
        IF(p_size % 3 = 0, {_rule(1, "permission", *either)}, NULL)))"""


def policies(held: DataFrame, variant: str = "") -> DataFrame:
    assignee = "string(NULL)"
    if variant == "assignee":
        assignee = """IF(policy_idx = 0 AND p_size % 4 = 0,
            'Customer#00000000' || p_partkey % 10, NULL)"""
    rows = held.selectExpr(
        "*",
        """explode(array_compact(array(
            IF(p_size % 5 <> 0, bigint(0), NULL), IF(p_size % 3 = 0, bigint(1), NULL))))
            AS policy_idx""",
    )
    return _per_dataset(
        rows,
        "policy_idx",
        f"IF(policy_idx = 0, 'urn:policy:' || lower({SEGMENT}), NULL) AS policy_id",
        "IF(policy_idx = 0, 'Offer', 'Set') AS kind",
        "'did:web:nation-' || s_nationkey % 2 AS assigner",
        f"{assignee} AS assignee",
    )


def rules(held: DataFrame, variant: str = "") -> DataFrame:
    rows = held.selectExpr("s_nationkey", "p_partkey", f"inline({part_rules(variant)})")
    return _per_dataset(rows, "policy_idx", "rule_kind", "rule_idx", "action")


def constraints(held: DataFrame, variant: str = "") -> DataFrame:
    rows = held.selectExpr("s_nationkey", "p_partkey", f"inline({part_rules(variant)})").selectExpr(
        "s_nationkey", "p_partkey", "policy_idx", "rule_kind", "rule_idx", "inline(constraints)"
    )
    return _per_dataset(
        rows, "policy_idx", "rule_kind", "rule_idx", "path", "depth", "op",
        "left_operand", "operator", "right_operand",
    )


def tables(spark: SparkSession, sf_dir: str, variant: str = "") -> CatalogTables:
    """All tables of one query, over one reading of the line items."""
    ways = cut(shipped(spark, sf_dir))
    held = cut(holdings(spark, sf_dir, ways))
    return CatalogTables(
        catalogs=catalogs(spark, sf_dir),
        datasets=datasets(spark, sf_dir, held),
        distributions=distributions(ways),
        services=services(spark, sf_dir),
        policies=policies(held, variant),
        rules=rules(held, variant),
        constraints=constraints(held, variant),
    )


def callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One caller per customer, with decoded claims as JSON."""
    return read(spark, sf_dir, "customer").selectExpr(
        "c_name AS caller_id",
        """to_json(named_struct(
            'sub', c_name,
            'segment', c_mktsegment,
            'nation', array(string(c_nationkey)),
            'balance', string(c_acctbal),
            'scope', ' read  ' || IF(c_custkey % 3 = 0, 'catalog', 'offers'),
            'exp', 1767225600 + (c_custkey % 7 - 3) * 3600,
            'nbf', IF(c_custkey % 5 = 0, 1767225600 + (c_custkey % 11 - 5) * 600, NULL),
            'iss', IF(c_custkey % 13 <> 0, 'https://issuer.example', NULL),
            'aud', IF(c_custkey % 17 = 0, 'other', 'catalog'),
            'jti', 'token-' || c_custkey,
            'verified', true)) AS claims""",
    )


def crawl_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One crawl per event: the node is user_id % 25, cycles are hours."""
    return read(spark, sf_dir, "events").selectExpr(
        "'nation-' || user_id % 25 AS node_id",
        "bigint(floor(unix_timestamp(timestamp(ts)) / 3600)) AS cycle_id",
        "timestamp(ts) AS finished_at",
        "event_type <> 'error' AS ok",
        "IF(event_type = 'error', 'crawl failed: ' || props, NULL) AS error",
        "bigint(value * 10) AS duration_ms",
    )


def responses(spark: SparkSession, sf_dir: str, broken: bool = False) -> DataFrame:
    """Catalog documents rendered from the line items: one participant per
    supplier and block of 64 parts, so a document has at most 64 datasets of
    six distributions. With `broken`, some arrive cut off, late or with an error
    status.

    Each document lists its even parts directly and its odd parts in a nested
    catalog; keys use all three spellings and several JSON-LD shapes.
    """
    # Dealt by part once, for the grouping and the join; only short columns go on from
    # there, and documents are put together where they are grouped.
    held = (
        read(spark, sf_dir, "lineitem")
        .select("l_suppkey", "l_partkey", F.expr("l_returnflag || l_linestatus AS format"))
        .repartition("l_partkey")
        .groupBy("l_suppkey", "l_partkey")
        .agg(F.expr("sort_array(collect_set(format))").alias("formats"))
    )
    part = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    policy = """named_struct(
        '@id', IF(x.p_size % 2 = 0, 'urn:policy:' || x.p_size, NULL),
        '@type', IF(x.p_size % 3 = 0, 'Offer', 'Contract'),
        'assignee', IF(x.p_size % 7 = 0, x.p_brand, NULL),
        'permission', IF(x.p_size % 2 = 0, array(named_struct('action', 'use', 'constraint', array(
            named_struct('leftOperand', 'size', 'operator', 'lteq', 'rightOperand',
                named_struct('@value', double(x.p_size)))))), NULL),
        'odrl:permission', IF(x.p_size % 3 = 0, named_struct('action', 'odrl:read'), NULL),
        'http://www.w3.org/ns/odrl/2/prohibition', IF(x.p_type = 'PROMO', named_struct('action',
            'http://www.w3.org/ns/odrl/2/use', 'constraint',
            named_struct('xone', array(
                named_struct('leftOperand', 'brand', 'operator', 'eq', 'rightOperand', x.p_brand),
                named_struct('leftOperand', 'size', 'operator', 'eq',
                             'rightOperand', string(NULL))))), NULL))"""
    item = f"""named_struct(
        '@id', IF(x.p_partkey % 2 = 0, 'part-' || x.p_partkey, NULL),
        'id', IF(x.p_partkey % 2 = 1, 'part-' || x.p_partkey, NULL),
        'title', x.p_name, 'version', string(x.p_size), 'keywords', replace(x.p_name, ' ', ', '),
        'creatorName', IF(x.p_size % 2 = 0, x.p_brand, NULL),
        'distribution', transform(x.formats, f -> named_struct('format', f,
            'accessService', named_struct('@id', 'supplier-' || l_suppkey || '-' || f,
                                          'endpointURL', 'https://s.example/' || f))),
        'hasPolicy', IF(x.p_partkey % 4 = 0, {policy}, NULL),
        'odrl:hasPolicy', IF(x.p_partkey % 4 = 1, named_struct('@list', array({policy})), NULL))"""
    half = "transform(filter(held, x -> x.p_partkey % 2 = {}), x -> {})"
    docs = (
        held.join(part.hint("merge"), F.expr("l_partkey = p_partkey"))
        .selectExpr("l_suppkey", "l_partkey div 64 AS block", "struct(p_partkey, formats, p_name, p_brand, p_type, p_size) AS x")
        .groupBy("l_suppkey", "block")
        .agg(F.array_sort(F.collect_list("x")).alias("held"))
        .selectExpr("l_suppkey", "block", f"{half.format(0, item)} AS own", f"{half.format(1, item)} AS nested")
    )
    body = """to_json(named_struct(
        '@id', 'catalog-' || l_suppkey, 'participantId', 'did:web:s' || l_suppkey % 3,
        'dataset', own, 'catalog', array(named_struct('dataset', nested))))"""
    # Through explode, which filters over the body aren't pushed below: they would
    # render it again for every place that reads it.
    rendered = docs.selectExpr("l_suppkey", "block", f"explode(array({body})) AS body")
    return rendered.selectExpr(
        "'s' || l_suppkey || '-b' || block AS node_id",
        "bigint(1) AS cycle_id",
        "timestamp '2026-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, int(block), 0)"
        " AS fetched_at",
        f"IF({str(broken).lower()} AND l_suppkey % 20 = 7, 503, 200) AS http_status",
        f"bigint(IF({str(broken).lower()} AND block % 9 = 8, 60000, 20)) AS duration_ms",
        f"IF({str(broken).lower()} AND l_suppkey % 20 = 11, substr(body, 1, 40), body) AS body",
    )


def response_participants(documents: DataFrame) -> DataFrame:
    return documents.selectExpr(
        "node_id", "node_id AS name", "'https://' || node_id AS catalog_request_url",
        "'none' AS credential_protocol", "IF(node_id LIKE 's1%', 'did:web:s1', NULL) AS provider_did",
        "string(NULL) AS response_uri",
    ).distinct()


def event_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One small response per event, errors with status 500."""
    return read(spark, sf_dir, "events").selectExpr(
        "'nation-' || user_id % 25 AS node_id",
        "event_id AS cycle_id",
        "timestamp(ts) AS fetched_at",
        "IF(event_type = 'error', 500, 200) AS http_status",
        "bigint(value * 10) AS duration_ms",
        "props AS body",
    )


def catalog_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One catalog of one dataset per event, errors with status 500."""
    return event_responses(spark, sf_dir).selectExpr(
        "node_id", "cycle_id", "fetched_at", "http_status", "bigint(20) AS duration_ms",
        """to_json(named_struct('@id', 'catalog-' || cycle_id,
            'dataset', array(named_struct('@id', 'dataset-' || cycle_id % 7)))) AS body""",
    )


def place_quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """partOf edges: line items' suppliers in nations, nations in regions."""
    edge = lambda s, o: (
        "'urn:places' AS graph", f"{s} AS s", "'urn:partOf' AS p", f"{o} AS o",
        "'iri' AS o_kind", "'' AS o_datatype", "'' AS o_lang",
    )
    supplier = read(spark, sf_dir, "supplier").selectExpr(
        *edge("'urn:supplier:' || s_suppkey", "'urn:nation:' || s_nationkey")
    )
    nation = read(spark, sf_dir, "nation").selectExpr(
        *edge("'urn:nation:' || n_nationkey", "'urn:region:' || n_regionkey")
    )
    return supplier.unionByName(nation)


def trade_quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers of a nation: `returnedTo` from a customer to the
    supplier of a returned line, `acceptedBy` from a supplier to the customer who
    accepted one. The links run in circles."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag").filter("l_returnflag IN ('R', 'A')")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    supplier = read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    met = (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(supplier, (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey")))
        .select("o_custkey", "l_suppkey", "l_returnflag").distinct()
    )
    buyer, seller = "'urn:customer:' || o_custkey", "'urn:supplier:' || l_suppkey"
    back = "l_returnflag = 'R'"
    return met.selectExpr(
        "'urn:trade' AS graph", f"if({back}, {buyer}, {seller}) AS s", f"if({back}, 'urn:returnedTo', 'urn:acceptedBy') AS p",
        f"if({back}, {seller}, {buyer}) AS o", "'iri' AS o_kind", "'' AS o_datatype", "'' AS o_lang",
    )
