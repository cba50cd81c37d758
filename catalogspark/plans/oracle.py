"""The same answers in plain SQL over the driver tables."""

from __future__ import annotations

from catalogspark.schema import DCAT, DCT, NS, ODRL, RDF_TYPE, XSD_INTEGER, XSD_STRING

# Shared pieces ---------------------------------------------------------------

PARTS = """
seg(i, name) AS (VALUES (0,'AUTOMOBILE'),(1,'BUILDING'),(2,'FURNITURE'),(3,'HOUSEHOLD'),
                        (4,'MACHINERY')),
parts AS (
  SELECT p.*, s.name AS x, p_size % 5 <> 0 AS has0, p_size % 3 = 0 AS has1,
         p_brand = 'Brand#13' AS odd, p_type = 'PROMO' AS promo
  FROM part p JOIN seg s ON s.i = p.p_partkey % 5)"""

HOLDINGS = """
offers AS (SELECT * FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
holdings AS (SELECT DISTINCT s_nationkey, l_partkey FROM offers),
dists AS (
  SELECT DISTINCT s_nationkey, l_partkey, l_suppkey, l_returnflag || l_linestatus AS format,
    l_suppkey * 6 + 2 * CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END
      + CASE WHEN l_linestatus = 'F' THEN 0 ELSE 1 END AS idx,
    CASE WHEN l_partkey % 7 = 0 THEN 'ghost-' || l_suppkey
         ELSE 'supplier-' || l_suppkey || '-bay-' || l_partkey % 10 END AS access
  FROM offers),
servs AS (
  SELECT s_nationkey, s_suppkey, bay, 'supplier-' || s_suppkey || '-bay-' || bay AS sid,
    s_suppkey * 11 + bay AS idx, 'https://supplier-' || s_suppkey || '.example/' || bay AS url,
    CASE WHEN s_acctbal >= 0 THEN s_name END AS descr
  FROM supplier, range(0, 11) b(bay))"""

CLASSES = """
classes AS (SELECT DISTINCT c_mktsegment AS segment, c_nationkey AS nation FROM customer)"""

CALLER = "classes AS (SELECT 'BUILDING' AS segment, 7 AS nation)"

BROKER_BODY = """
outcomes AS (
  SELECT p.*, c.segment, c.nation,
    has0 AND odd AS bad0,
    has0 AND c.segment = x AND NOT (promo AND c.nation IN (1,2,3)) AS ok0,
    has1 AND ((c.segment = x) <> (c.nation = p_partkey % 5)) AS ok1
  FROM parts p CROSS JOIN classes c)"""

GROUPS_BODY = """
outcomes AS (
  SELECT p.*, c.segment, c.nation, false AS bad0,
    has0 AND ((c.segment = x AND c.nation NOT IN (1,2,3)) OR c.nation = p_partkey % 25)
      AND NOT (promo AND c.nation IN (1,2,3)) AS ok0,
    has1 AND ((c.segment = x) <> (c.nation = p_partkey % 5)) AS ok1
  FROM parts p CROSS JOIN classes c)"""

NONE = "NOT has0 AND NOT has1"
HIDE = f"CASE WHEN {NONE} THEN true WHEN bad0 THEN false ELSE ok0 OR ok1 END"
DENY = f"""CASE WHEN has0 AND promo AND nation IN (1,2,3) THEN false WHEN {NONE} THEN true
  ELSE has0 AND NOT odd AND segment = x END"""
BY_CLASS = """
SELECT segment, nation, 'nation-' || s_nationkey AS node_id, count(*)::BIGINT AS n_visible
FROM holdings JOIN decided ON l_partkey = p_partkey WHERE visible
GROUP BY ALL"""


def _decided(rule: str, body: str = BROKER_BODY, classes: str = CLASSES) -> str:
    return f"""WITH {PARTS}, {HOLDINGS}, {classes}, {body},
decided AS (SELECT *, {rule} AS visible FROM outcomes)"""


# The caller's visible datasets and services.
SHOWN = f"""{_decided(HIDE, classes=CALLER)},
shown AS (SELECT s_nationkey, l_partkey FROM holdings JOIN decided ON l_partkey = p_partkey
          WHERE visible),
used AS (SELECT s_nationkey, access, bool_or(sh.l_partkey IS NOT NULL) AS seen
         FROM dists LEFT JOIN shown sh USING (s_nationkey, l_partkey) GROUP BY ALL),
shown_servs AS (SELECT v.*, coalesce(u.seen, true) AS seen
                FROM servs v LEFT JOIN used u
                ON v.s_nationkey = u.s_nationkey AND v.sid = u.access)"""

# Quads ------------------------------------------------------------------------

N = NS.nodes


def _iri(s: str, p: str, o: str, source: str) -> str:
    return f"SELECT g, {s} AS s, {p} AS p, {o} AS o, 'iri' AS o_kind, '' AS o_datatype FROM {source}"


def _lit(s: str, p: str, o: str, source: str, datatype: str = XSD_STRING) -> str:
    return (
        f"SELECT g, {s} AS s, {p} AS p, CAST({o} AS VARCHAR) AS o, 'literal' AS o_kind, "
        f"'{datatype}' AS o_datatype FROM {source} WHERE {o} IS NOT NULL"
    )


def _either(s: str, p: str, o: str, source: str) -> str:
    """IRI-shaped texts (all of ours have a scheme and no blanks) are IRIs."""
    named = f"contains({o}, ':')"
    return (
        f"SELECT g, {s} AS s, {p} AS p, {o} AS o, "
        f"CASE WHEN {named} THEN 'iri' ELSE 'literal' END AS o_kind, "
        f"CASE WHEN {named} THEN '' ELSE '{XSD_STRING}' END AS o_datatype "
        f"FROM {source} WHERE {o} IS NOT NULL"
    )


def _q(value: str) -> str:
    return f"'{value}'"


SEQ = _q(NS.sequence_index)
PROP = NS.property_prefix
CATALOG_QUADS = f"""
cg AS (SELECT '{N}nation-' || n_nationkey AS g,
         '{N}nation-' || n_nationkey || '/catalogs/catalog-' || n_regionkey AS c, n_nationkey AS k,
         CASE WHEN n_nationkey % 3 = 1 THEN 'did:web:nation-' || n_nationkey END AS pid,
         n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
dg AS (SELECT g, c, g || '/datasets/part-' || l_partkey AS d, l_partkey, s_nationkey, part.*
       FROM holdings JOIN cg ON s_nationkey = k JOIN part ON l_partkey = p_partkey),
xg AS (SELECT g, g || '/datasets/part-' || l_partkey AS d, idx, format,
         g || '/datasets/part-' || l_partkey || '/distributions/' || idx AS x,
         g || '/services/' || access AS a FROM dists JOIN cg ON s_nationkey = k),
vg AS (SELECT g, c, g || '/services/' || sid AS v, idx, url, descr
       FROM servs JOIN cg ON s_nationkey = k),
catalog_quads AS (
{" UNION ALL ".join([
    _iri("c", _q(RDF_TYPE), _q(DCAT + "Catalog"), "cg"),
    _lit("c", _q(NS.participant_id), "pid", "cg"),
    _lit("c", _q(PROP + "region"), "r_name", "cg"),
    _lit("c", _q("http://purl.org/dc/terms/publisher"), "n_name", "cg"),
    _iri("c", _q(DCAT + "dataset"), "d", "dg"),
    _iri("d", _q(RDF_TYPE), _q(DCAT + "Dataset"), "dg"),
    _lit("d", SEQ, "l_partkey", "dg", XSD_INTEGER),
    _lit("d", _q(PROP + "title"), "p_name", "dg"),
    _lit("d", _q(PROP + "version"), "p_size", "dg"),
    _lit("d", _q(PROP + "keywords"), "replace(p_name, ' ', ', ')", "dg"),
    _lit("d", _q(PROP + "creatorName"), "(CASE WHEN p_size % 2 = 0 THEN p_brand END)", "dg"),
    _lit("d", _q(PROP + "thumbnail"),
         "(CASE WHEN p_size % 4 = 0 THEN 'https://img.example/' || l_partkey END)", "dg"),
    _iri("d", _q(DCAT + "distribution"), "x", "xg"),
    _iri("x", _q(RDF_TYPE), _q(DCAT + "Distribution"), "xg"),
    _lit("x", SEQ, "idx", "xg", XSD_INTEGER),
    _lit("x", _q(DCT + "format"), "format", "xg"),
    _iri("x", _q(DCAT + "accessService"), "a", "xg"),
    _iri("c", _q(DCAT + "service"), "v", "vg"),
    _iri("v", _q(RDF_TYPE), _q(DCAT + "DataService"), "vg"),
    _lit("v", SEQ, "idx", "vg", XSD_INTEGER),
    _iri("v", _q(DCAT + "endpointURL"), "url", "vg"),
    _lit("v", _q(DCAT + "endpointDescription"), "descr", "vg"),
])})"""

POLICY_QUADS = f"""
pg AS (SELECT dg.*, x, has0, has1, odd, promo, idx, d || '/policies/' || idx AS p
       FROM dg JOIN parts USING (p_partkey), range(0, 2) i(idx)
       WHERE (idx = 0 AND has0) OR (idx = 1 AND has1)),
rg AS (SELECT g, p, 'permission' AS kind, p || '/permissions/0' AS r, x, odd, idx, p_partkey FROM pg
       UNION ALL SELECT g, p, 'prohibition', p || '/prohibitions/0', x, odd, idx, p_partkey FROM pg
       WHERE idx = 0 AND promo),
kg AS (
  SELECT g, r, r || '/constraints/0' AS k, 0 AS i, 'segment' AS l, 'eq' AS op, x AS v
  FROM rg WHERE kind = 'permission' AND idx = 0
  UNION ALL SELECT g, r, r || '/constraints/1', 1, 'segment', 'bogus', 'x'
  FROM rg WHERE kind = 'permission' AND idx = 0 AND odd
  UNION ALL SELECT g, r, r || '/constraints/0', 0, 'nation', 'isAnyOf', '1, 2,3'
  FROM rg WHERE kind = 'prohibition'
  UNION ALL SELECT g, r, r || '/constraints/0', 0, NULL, NULL, NULL
  FROM rg WHERE kind = 'permission' AND idx = 1),
ng AS (
  SELECT g, r || '/constraints/0' AS up, r || '/constraints/0/constraints/0' AS k, 0 AS i,
         'segment' AS l, 'eq' AS op, x AS v FROM rg WHERE kind = 'permission' AND idx = 1
  UNION ALL
  SELECT g, r || '/constraints/0', r || '/constraints/0/constraints/1', 1, 'odrl:nation',
         'odrl:eq', CAST(p_partkey % 5 AS VARCHAR) FROM rg WHERE kind = 'permission' AND idx = 1),
ag AS (SELECT g, k, i, l, op, v FROM kg UNION ALL SELECT g, k, i, l, op, v FROM ng),
policy_quads AS (
{" UNION ALL ".join([
    _iri("d", _q(ODRL + "hasPolicy"), "p", "pg"),
    _iri("p", _q(RDF_TYPE),
         f"'{ODRL}' || CASE WHEN idx = 0 THEN 'Offer' ELSE 'Set' END", "pg"),
    _lit("p", SEQ, "idx", "pg", XSD_INTEGER),
    _lit("p", _q(NS.policy_id),
         "(CASE WHEN idx = 0 THEN 'urn:policy:' || lower(x) END)", "pg"),
    _either("p", _q(ODRL + "assigner"), "('did:web:nation-' || s_nationkey % 2)", "pg"),
    _iri("p", f"'{ODRL}' || kind", "r", "rg"),
    _lit("r", SEQ, "0", "rg", XSD_INTEGER),
    _either("r", _q(ODRL + "action"), "'odrl:use'", "rg"),
    _iri("r", _q(ODRL + "constraint"), "k", "kg"),
    _lit("k", SEQ, "i", "ag", XSD_INTEGER),
    _either("k", _q(ODRL + "leftOperand"), "l", "ag"),
    _either("k", _q(ODRL + "operator"), "op", "ag"),
    _lit("k", _q(ODRL + "rightOperand"), "v", "ag"),
    _iri("k", _q(NS.logical_operator), _q(ODRL + "xone"), "(SELECT * FROM kg WHERE l IS NULL)"),
    _iri("up", _q(ODRL + "xone"), "k", "ng"),
])})"""

BASE = f"WITH {PARTS}, {HOLDINGS}"
CATALOG = f"{BASE}, {CATALOG_QUADS}, quads AS (SELECT * FROM catalog_quads)"
FULL = f"""{BASE}, {CATALOG_QUADS}, {POLICY_QUADS},
quads AS (SELECT * FROM catalog_quads UNION ALL SELECT * FROM policy_quads)"""
OWNER = f"""CASE WHEN NOT regexp_matches({{0}}, '^{N}[^/]*/') THEN NULL
  WHEN regexp_matches({{0}}, '^{N}[^/]*/catalogs(/|$)') THEN NULL
  WHEN regexp_matches({{0}}, '^{N}[^/]*/(datasets|services)/')
  THEN regexp_extract({{0}}, '^({N}[^/]*/(datasets|services)/[^/]*)', 1) ELSE {{0}} END"""


def _objects(predicate: str, s: str = "s", o: str = "o") -> str:
    return f"(SELECT g, s AS {s}, o AS {o} FROM quads WHERE p = '{predicate}')"


def _typed(cls: str, s: str = "s") -> str:
    return f"(SELECT g, s AS {s} FROM quads WHERE p = '{RDF_TYPE}' AND o = '{cls}')"


# Documents ----------------------------------------------------------------------

DOCS = """
held AS (
  SELECT l_suppkey, l_partkey, l_partkey // 64 AS block,
         list_sort(list(DISTINCT l_returnflag || l_linestatus)) AS formats
  FROM lineitem GROUP BY ALL),
landed AS (
  SELECT h.*, p.*, 's' || l_suppkey || '-b' || block AS node_id, 'part-' || l_partkey AS dataset_id,
    CASE WHEN block % 9 = 8 THEN 'crawl timed out after 30000 ms'
         WHEN l_suppkey % 20 = 7 THEN 'returned HTTP 503'
         WHEN l_suppkey % 20 = 11 THEN 'malformed JSON response' END AS error
  FROM held h JOIN part p ON l_partkey = p_partkey),
good AS (SELECT * FROM landed),
pols AS (SELECT * FROM good WHERE l_partkey % 4 IN (0, 1)),
found_rules AS (
  SELECT node_id, dataset_id, 0::BIGINT AS policy_idx, 'permission' AS rule_kind,
    0::BIGINT AS rule_idx, 'odrl:use' AS action, p_size, p_brand, 'size' AS how
  FROM pols WHERE p_size % 2 = 0
  UNION ALL SELECT node_id, dataset_id, 0, 'permission', CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END,
    'odrl:read', p_size, p_brand, 'free' FROM pols WHERE p_size % 3 = 0
  UNION ALL SELECT node_id, dataset_id, 0, 'prohibition', 0, 'odrl:use', p_size, p_brand, 'xone'
  FROM pols WHERE p_type = 'PROMO'
  UNION ALL SELECT node_id, dataset_id, 0, 'obligation', 0, '%(action)s', p_size, p_brand, 'none'
  FROM pols WHERE p_size % 2 <> 0 AND p_size % 3 <> 0 AND p_type <> 'PROMO')""".replace(
    "%(action)s", NS.unmappable_action
)

MARK = NS.unmappable_operator
TRADE = """
WITH RECURSIVE met AS (
  SELECT DISTINCT 'urn:customer:' || o_custkey AS c, 'urn:supplier:' || l_suppkey AS v, l_returnflag AS flag
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN supplier ON l_suppkey = s_suppkey AND s_nationkey = c_nationkey WHERE l_returnflag IN ('R', 'A')),
edges AS (SELECT c AS a, v AS b FROM met WHERE flag = 'R' UNION SELECT v, c FROM met WHERE flag = 'A'),
nodes AS (SELECT a AS n FROM edges UNION SELECT b FROM edges),
reach(a, b) AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a)"""

ORACLES: dict[str, str] = {
    # Policy decisions
    "entitled_datasets_by_class": _decided(HIDE) + BY_CLASS,
    "entitled_deny_overrides": _decided(DENY) + BY_CLASS,
    "deny_reason_counts": _decided(DENY) + f""",
sized AS (SELECT l_partkey, count(*) AS n FROM holdings GROUP BY ALL)
SELECT segment, nation, visible,
  CASE WHEN has0 AND promo AND nation IN (1,2,3)
         THEN 'prohibition[0] of policy ''urn:policy:' || lower(x)
              || ''' matched: nation isAnyOf 1, 2,3'
       WHEN {NONE} THEN 'no permission rules declared on any attached policy; open by default'
       WHEN visible THEN 'permission[0] of policy ''urn:policy:' || lower(x)
            || ''' matched: segment eq ' || x
       ELSE 'permission rules exist but none matched the caller''s claims' END AS reason,
  sum(n)::BIGINT AS n
FROM decided JOIN sized ON l_partkey = p_partkey GROUP BY ALL""",
    "unmappable_skip": _decided(f"CASE WHEN {NONE} THEN true ELSE ok0 OR ok1 END") + BY_CLASS,
    "unmappable_drop_policy": _decided(
        f"CASE WHEN {NONE} THEN true ELSE (ok0 AND NOT bad0) OR ok1 END"
    ) + BY_CLASS,
    "unmappable_hide": _decided(HIDE) + BY_CLASS,
    "no_policy_closed": _decided("NOT bad0 AND (ok0 OR ok1)") + BY_CLASS,
    "nested_groups": _decided(HIDE, GROUPS_BODY) + BY_CLASS,
    "ordered_constraint": f"""WITH {PARTS}, {HOLDINGS},
classes AS (SELECT DISTINCT c_mktsegment AS segment,
              floor(c_acctbal / 1000)::BIGINT * 1000 AS balance FROM customer),
sized AS (SELECT l_partkey, count(*) AS n FROM holdings GROUP BY ALL)
SELECT segment, balance, sum(n)::BIGINT AS n_visible
FROM parts CROSS JOIN classes JOIN sized ON l_partkey = p_partkey
WHERE CASE WHEN {NONE} THEN true WHEN has0 AND odd THEN false
      ELSE has0 AND NOT promo AND segment = x AND balance >= p_size * 100 AND p_size % 2 = 0 END
GROUP BY ALL""",
    "assignee_scope": f"""WITH {PARTS}, {HOLDINGS},
sized AS (SELECT l_partkey, count(*) AS n FROM holdings GROUP BY ALL),
outcomes AS (
  SELECT p.*, c_name, has0 AND odd AS bad0,
    has0 AND c_mktsegment = x AND NOT (promo AND c_nationkey IN (1,2,3))
      AND (p_size % 4 <> 0 OR c_name = 'Customer#00000000' || p_partkey % 10) AS ok0,
    has1 AND ((c_mktsegment = x) <> (c_nationkey = p_partkey % 5)) AS ok1
  FROM parts p CROSS JOIN customer)
SELECT c_name AS caller_id, sum(n)::BIGINT AS n_visible
FROM outcomes JOIN sized ON l_partkey = p_partkey WHERE {HIDE} GROUP BY ALL""",
    # Claims
    "claim_classes": """
SELECT c_name AS caller_id,
  '{"aud":"' || CASE WHEN c_custkey % 17 = 0 THEN 'other' ELSE 'catalog' END
  || '","balance":"' || CAST(c_acctbal AS VARCHAR) || '"'
  || CASE WHEN c_custkey % 13 <> 0 THEN ',"iss":"https://issuer.example"' ELSE '' END
  || ',"nation":["' || c_nationkey || '"],"scope":["read","'
  || CASE WHEN c_custkey % 3 = 0 THEN 'catalog' ELSE 'offers' END
  || '"],"segment":"' || c_mktsegment || '","sub":"' || c_name || '"}' AS caller_key
FROM customer""",
    "scope_split": """
SELECT scope, count(*)::BIGINT AS n FROM (
  SELECT unnest(['read', CASE WHEN c_custkey % 3 = 0 THEN 'catalog' ELSE 'offers' END]) AS scope
  FROM customer) GROUP BY ALL""",
    "caller_admission": """
WITH reasons AS (
  SELECT c_name AS caller_id, CASE
    WHEN c_custkey % 7 - 3 < 0 THEN 'expired'
    WHEN c_custkey % 5 = 0 AND c_custkey % 11 - 5 > 0 THEN 'not yet valid'
    WHEN c_custkey % 13 = 0 THEN 'wrong issuer'
    WHEN c_custkey % 17 = 0 THEN 'wrong audience'
    WHEN c_custkey % 3 <> 0 THEN 'token is missing required scope ''catalog'''
    ELSE '' END AS reason FROM customer)
SELECT caller_id, reason,
  CASE WHEN reason = '' THEN 200 WHEN reason LIKE 'token%' THEN 403 ELSE 401 END AS status
FROM reasons""",
    # Visibility
    "visible_services": _decided(HIDE) + """,
uses AS (SELECT DISTINCT s_nationkey, access, l_partkey FROM dists WHERE l_partkey % 7 <> 0),
seen AS (SELECT DISTINCT segment, nation, access FROM uses JOIN decided ON l_partkey = p_partkey
         WHERE visible),
unused AS (SELECT sid FROM servs WHERE sid NOT IN (SELECT access FROM uses))
SELECT segment, nation, count(*)::BIGINT AS n_services FROM (
  SELECT * FROM seen UNION ALL SELECT segment, nation, sid FROM classes CROSS JOIN unused)
GROUP BY ALL""",
    "hidden_services": SHOWN + """
SELECT 'nation-' || s_nationkey AS node_id, sid AS service_id FROM shown_servs WHERE NOT seen""",
    "filtered_catalog_counts": SHOWN + """
SELECT 'nation-' || n_nationkey AS node_id, 'catalog-' || n_regionkey AS catalog_id,
  (SELECT count(*) FROM shown WHERE s_nationkey = n_nationkey)::BIGINT AS n_datasets,
  (SELECT count(*) FROM dists JOIN shown USING (s_nationkey, l_partkey)
   WHERE s_nationkey = n_nationkey)::BIGINT AS n_distributions,
  (SELECT count(*) FROM shown_servs WHERE seen AND s_nationkey = n_nationkey)::BIGINT AS n_services
FROM nation""",
    "allow_list": SHOWN + f"""
SELECT 'nation-' || s_nationkey AS node_id,
  '{N}nation-' || s_nationkey || '/datasets/part-' || l_partkey AS iri FROM shown
UNION ALL SELECT 'nation-' || s_nationkey,
  '{N}nation-' || s_nationkey || '/services/' || sid FROM shown_servs WHERE seen""",
    "owning_resource": FULL + f"""
SELECT {OWNER.format('s')} AS owner, count(*)::BIGINT AS n FROM quads GROUP BY ALL""",
    "visible_quad_counts": f"""{SHOWN}, {CATALOG_QUADS}, {POLICY_QUADS},
quads AS (SELECT * FROM catalog_quads UNION ALL SELECT * FROM policy_quads),
allowed AS (
  SELECT '{N}nation-' || s_nationkey || '/datasets/part-' || l_partkey AS iri FROM shown
  UNION SELECT '{N}nation-' || s_nationkey || '/services/' || sid FROM shown_servs WHERE seen),
owned AS (SELECT p, {OWNER.format('s')} AS os,
                 CASE WHEN o_kind = 'iri' THEN {OWNER.format('o')} END AS oo
          FROM quads WHERE p <> '{NS.sequence_index}')
SELECT p, count(*)::BIGINT AS n FROM owned
WHERE (os IS NULL OR os IN (SELECT iri FROM allowed))
  AND (oo IS NULL OR oo IN (SELECT iri FROM allowed)) GROUP BY ALL""",
    "visible_quads_by_class": f"""{_decided(HIDE)}, {CATALOG_QUADS}, {POLICY_QUADS},
quads AS (SELECT * FROM catalog_quads UNION ALL SELECT * FROM policy_quads),
seen AS (SELECT p_partkey, list_sort(list(segment || '/' || nation)) AS cs FROM decided WHERE visible GROUP BY ALL),
shown AS (SELECT s_nationkey, l_partkey, cs FROM holdings JOIN seen ON l_partkey = p_partkey),
uses AS (SELECT s_nationkey, access AS sid, list_sort(list_distinct(flatten(list(coalesce(cs, []))))) AS cs
         FROM (SELECT DISTINCT s_nationkey, access, l_partkey FROM dists) LEFT JOIN shown USING (s_nationkey, l_partkey)
         GROUP BY ALL),
everyone AS (SELECT list_sort(list(segment || '/' || nation)) AS cs FROM classes),
allowed AS (
  SELECT '{N}nation-' || s_nationkey || '/datasets/part-' || l_partkey AS iri, cs FROM shown
  UNION ALL SELECT '{N}nation-' || s_nationkey || '/services/' || sid, coalesce(uses.cs, everyone.cs)
  FROM servs LEFT JOIN uses USING (s_nationkey, sid), everyone),
owned AS (SELECT p, {OWNER.format('s')} AS os,
                 CASE WHEN o_kind = 'iri' THEN {OWNER.format('o')} END AS oo
          FROM quads WHERE p <> '{NS.sequence_index}'),
counted AS (
  SELECT p, CASE WHEN os IS NULL THEN everyone.cs ELSE coalesce(a.cs, []) END AS x,
    CASE WHEN oo IS NULL THEN everyone.cs ELSE coalesce(b.cs, []) END AS y, count(*) AS n
  FROM owned LEFT JOIN allowed a ON os = a.iri LEFT JOIN allowed b ON oo = b.iri, everyone GROUP BY ALL)
SELECT split_part(c, '/', 1) AS segment, CAST(split_part(c, '/', 2) AS INT) AS nation, p, sum(n)::BIGINT AS n
FROM (SELECT p, n, unnest(list_intersect(x, y)) AS c FROM counted) GROUP BY ALL""",
    # Quads
    "stored_quads": CATALOG + """
SELECT g AS graph, p, count(*)::BIGINT AS n, count(DISTINCT s || ' ' || o)::BIGINT AS n_pairs
FROM quads GROUP BY g, p""",
    "bindings_json": CATALOG + f"""
SELECT '{{"v":{{"type":"uri","value":"' || v || '"}},"u":{{"type":"uri","value":"' || u || '"}}'
  || CASE WHEN e IS NULL THEN '' ELSE ',"e":{{"type":"literal","value":"' || e || '"}}' END || '}}' AS value
FROM {_objects(DCAT + 'endpointURL', 'v', 'u')} a
LEFT JOIN {_objects(DCAT + 'endpointDescription', 'w', 'e')} b ON a.v = b.w""",
    "quad_counts_by_predicate": FULL + """
SELECT p, o_kind, o_datatype, count(*)::BIGINT AS n, count(DISTINCT s)::BIGINT AS n_subjects
FROM quads GROUP BY ALL""",
    "iri_mint": f"""WITH {HOLDINGS}
SELECT 'nation-' || s_nationkey AS node_id, 'part-' || l_partkey AS dataset_id, p_name AS decoded,
  '{N}nation-' || s_nationkey || '/datasets/' || replace(p_name, ' ', '%20') AS title_iri
FROM holdings JOIN part ON l_partkey = p_partkey""",
    "roundtrip_datasets": f"""{BASE},
per AS (SELECT s_nationkey, l_partkey, count(*) AS n FROM dists GROUP BY ALL)
SELECT 'nation-' || s_nationkey AS node_id, 'part-' || l_partkey AS dataset_id, l_partkey AS idx,
  p_name AS title, n::BIGINT AS n_distributions,
  (has0::INT + has1::INT)::BIGINT AS n_policies,
  (has0::INT + has1::INT + (has0 AND promo)::INT)::BIGINT AS n_rules,
  (has0::INT + (has0 AND odd)::INT + (has0 AND promo)::INT + 3 * has1::INT)::BIGINT
    AS n_constraints
FROM per JOIN parts ON l_partkey = p_partkey""",
    "ordered_turns": """
SELECT conv_id, arg_min(role, turn) AS first_role, arg_max(role, turn) AS last_role,
  count(turn)::BIGINT AS n_turns FROM conversations GROUP BY ALL""",
    # Graph patterns
    "bgp_dataset_service": CATALOG + f"""
SELECT u.u, count(*)::BIGINT AS n FROM {_typed(DCAT + 'Dataset')} d
JOIN {_objects(DCAT + 'distribution', o='x')} x USING (s)
JOIN {_objects(DCAT + 'accessService', 'x', 'v')} a USING (x)
JOIN {_objects(DCAT + 'endpointURL', 'v', 'u')} u USING (v) GROUP BY ALL""",
    "clustered_bgp": CATALOG + f"""
SELECT u, f, count(*)::BIGINT AS n, count(DISTINCT d.s)::BIGINT AS n_datasets FROM {_typed(DCAT + 'Dataset')} d
JOIN {_objects(DCAT + 'distribution', o='x')} x USING (s)
JOIN {_objects(DCT + 'format', 'x', 'f')} f USING (x)
JOIN {_objects(DCAT + 'accessService', 'x', 'v')} a USING (x)
JOIN (SELECT s AS v FROM {_typed(DCAT + 'DataService')} t) t USING (v)
JOIN {_objects(DCAT + 'endpointURL', 'v', 'u')} u USING (v) GROUP BY u, f""",
    "subject_shapes": CATALOG + """,
shapes AS (SELECT s, array_to_string(list_sort(list(DISTINCT p)), ' ') AS predicates, count(*) AS n FROM quads GROUP BY s)
SELECT predicates, count(*)::BIGINT AS n_subjects, sum(n)::BIGINT AS n_quads FROM shapes GROUP BY predicates""",
    "optional_twice": FULL + f""",
base AS (SELECT d, x, a, r FROM {_objects(ODRL + 'hasPolicy', 'd', 'x')} h
  LEFT JOIN {_objects(ODRL + 'assignee', 'x', 'a')} a USING (x) LEFT JOIN {_objects(ODRL + 'prohibition', 'x', 'r')} r USING (x))
SELECT coalesce(l.a, w.a) AS a, coalesce(l.r, w.r) IS NOT NULL AS prohibits, count(*)::BIGINT AS n
FROM base l JOIN base w ON l.x = w.x AND (l.a = w.a OR l.a IS NULL OR w.a IS NULL) AND (l.r = w.r OR l.r IS NULL OR w.r IS NULL)
GROUP BY ALL""",
    "optional_policy_count": FULL + f"""
SELECT s AS d, count(x)::BIGINT AS n FROM {_typed(DCAT + 'Dataset')} d
LEFT JOIN {_objects(ODRL + 'hasPolicy', o='x')} h USING (s) GROUP BY ALL""",
    "union_bindings": CATALOG + f"""
SELECT f, e, count(*)::BIGINT AS n FROM (
  SELECT o AS f, NULL AS e FROM quads WHERE p = '{DCT}format'
  UNION ALL SELECT NULL, o FROM quads WHERE p = '{DCAT}endpointDescription') GROUP BY ALL""",
    "minus_no_policy": FULL + f"""
SELECT t.s AS d FROM {_typed(DCAT + 'Dataset')} t
ANTI JOIN (SELECT DISTINCT s FROM quads WHERE p = '{ODRL}hasPolicy') q ON q.s = t.s""",
    "filter_strstarts": CATALOG + f"""
SELECT s, o AS u FROM quads WHERE p = '{DCAT}endpointURL'
  AND starts_with(o, 'https://supplier-1') AND o <> 'https://supplier-1.example/0'""",
    "values_join": CATALOG + f"""
SELECT o AS f, count(*)::BIGINT AS n FROM quads
WHERE p = '{DCT}format' AND o IN ('AF', 'NO') GROUP BY ALL""",
    "path_sequence": CATALOG + f"""
SELECT c, count(*)::BIGINT AS n FROM {_objects(DCAT + 'dataset', 'c', 'd')} a
JOIN {_objects(DCAT + 'distribution', 'd', 'x')} b USING (d) GROUP BY ALL""",
    "path_closure": """
WITH RECURSIVE edges AS (
  SELECT 'urn:supplier:' || s_suppkey AS a, 'urn:nation:' || s_nationkey AS b FROM supplier
  UNION SELECT 'urn:nation:' || n_nationkey, 'urn:region:' || n_regionkey FROM nation),
nodes AS (SELECT a FROM edges UNION SELECT b FROM edges),
reach(s, o) AS (SELECT a, a FROM nodes UNION SELECT s, b FROM reach JOIN edges ON o = a)
SELECT s, o FROM reach""",
    "path_components": TRADE + """
SELECT n AS node, least(n, coalesce(min(r.b), n)) AS least FROM nodes
LEFT JOIN reach r ON r.a = n AND EXISTS (SELECT 1 FROM reach q WHERE q.a = r.b AND q.b = r.a) GROUP BY n""",
    "path_plus": TRADE + """
SELECT n AS node, count(r.b)::BIGINT AS n FROM nodes LEFT JOIN reach r ON r.a = nodes.n GROUP BY nodes.n""",
    "path_reach_counts": CATALOG.replace("WITH", "WITH RECURSIVE", 1) + f""",
below AS (SELECT s AS a, o AS b FROM quads
          WHERE p IN ('{DCAT}dataset', '{DCAT}service', '{DCAT}distribution', '{DCAT}accessService')),
reach(a, b) AS (SELECT a, b FROM below UNION SELECT r.a, e.b FROM reach r JOIN below e ON r.b = e.a)
SELECT a AS node, count(*)::BIGINT AS n FROM reach GROUP BY a""",
    "path_to_one": """
SELECT 'urn:supplier:' || s_suppkey AS s FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 1
UNION ALL SELECT 'urn:nation:' || n_nationkey FROM nation WHERE n_regionkey = 1
UNION ALL SELECT 'urn:region:1'""",
    "path_optional": """
WITH edges AS (
  SELECT 'urn:supplier:' || s_suppkey AS s, 'urn:nation:' || s_nationkey AS o FROM supplier
  UNION SELECT 'urn:nation:' || n_nationkey, 'urn:region:' || n_regionkey FROM nation)
SELECT s, o FROM edges UNION SELECT s, s FROM edges UNION SELECT o, o FROM edges""",
    "path_inverse": CATALOG + f"""
SELECT o AS v, count(*)::BIGINT AS n FROM quads WHERE p = '{DCAT}accessService' GROUP BY ALL""",
    "path_alternative": CATALOG + f"""
SELECT s AS c, count(*)::BIGINT AS n FROM quads WHERE p IN ('{DCAT}dataset', '{DCAT}service') GROUP BY ALL""",
    "graph_scope": CATALOG + f"""
SELECT g, count(*)::BIGINT AS n FROM {_typed(DCAT + 'Dataset')} t GROUP BY ALL""",
    "named_graphs": CATALOG + f"SELECT DISTINCT g FROM {_typed(DCAT + 'Catalog')} t",
    "from_graphs": CATALOG + f"""
SELECT CASE WHEN g = '{N}nation-4' THEN 'named' ELSE 'default' END AS side, o AS f,
  count(*)::BIGINT AS n FROM quads WHERE p = '{DCT}format'
  AND g IN ('{N}nation-3', '{N}nation-4', '{N}nation-5') GROUP BY ALL""",
    "distinct_formats": CATALOG + f"SELECT DISTINCT o AS f FROM quads WHERE p = '{DCT}format'",
    "order_offset": CATALOG + f"""
SELECT s AS d, o AS t FROM quads WHERE p = '{PROP}title'
ORDER BY o, s DESC LIMIT 25 OFFSET 10""",
    "bind_having": CATALOG + f"""
SELECT upper(o) AS u, count(*)::BIGINT AS n FROM quads WHERE p = '{PROP}title'
GROUP BY ALL HAVING count(*) > 500""",
    "exists_policy": FULL + f"""
SELECT g, CASE WHEN EXISTS (SELECT 1 FROM quads q WHERE q.p = '{ODRL}hasPolicy' AND q.s = t.s)
  THEN 'yes' ELSE 'no' END AS has, count(*)::BIGINT AS n
FROM {_typed(DCAT + 'Dataset')} t GROUP BY ALL""",
    "literal_aggregates": CATALOG + f"""
SELECT t, sum(i)::BIGINT AS total, min(i) AS low, max(i) AS high,
  count(DISTINCT i)::BIGINT AS kinds, round(avg(i), 3) AS mean, t AS some,
  '{XSD_INTEGER}' AS total_type, 'http://www.w3.org/2001/XMLSchema#decimal' AS mean_type FROM (
  SELECT a.o AS t, CAST(b.o AS BIGINT) AS i FROM {_objects(PROP + 'title')} a
  JOIN {_objects(NS.sequence_index)} b USING (s)) GROUP BY t""",
    "optional_with_condition": CATALOG + f"""
SELECT f, count(*)::BIGINT AS n, count(v)::BIGINT AS bound FROM {_objects(DCT + 'format', 'x', 'f')} a
LEFT JOIN {_objects(DCAT + 'accessService', 'x', 'v')} b ON a.x = b.x AND f IN ('AF', 'NO') GROUP BY f""",
    "exists_with_condition": CATALOG + f"""
SELECT v, u FROM {_objects(DCAT + 'endpointURL', 'v', 'u')} a
SEMI JOIN {_objects(DCAT + 'endpointDescription', 'v', 'e')} b
  ON a.v = b.v AND ends_with(u, '/3') AND contains(e, 'Supplier')""",
    "term_functions": CATALOG + """
SELECT p, CASE WHEN o_kind = 'iri' THEN 'true' ELSE 'false' END AS iri,
  CASE WHEN o_datatype = '' THEN 'none' ELSE o_datatype END AS kind,
  CASE WHEN o_kind = 'literal' AND regexp_matches(o, '^red ') THEN 'true' ELSE 'false' END AS red,
  CASE WHEN contains(o, '/distributions/') THEN 'true' ELSE 'false' END AS at,
  count(*)::BIGINT AS n FROM quads GROUP BY ALL""",
    "ask_dataset": CATALOG + f"""
SELECT EXISTS (SELECT 1 FROM {_typed(DCAT + 'Dataset')} t) AS any_dataset,
  EXISTS (SELECT 1 FROM {_typed(DCAT + 'Nothing')} t) AS any_nothing""",
    "row_cap": CATALOG + f"""
SELECT s AS c, (SELECT count(*) FROM {_typed(DCAT + 'Dataset')} t) > 25 AS larger_refused
FROM {_typed(DCAT + 'Catalog')} t""",
    # Listing and offers
    "catalog_page": """
SELECT 'catalog-' || n_regionkey AS catalog_id, 'nation-' || n_nationkey AS node_id,
  CASE WHEN n_nationkey % 3 = 1 THEN 'did:web:nation-' || n_nationkey END AS participant_id
FROM nation ORDER BY 1, 2 LIMIT 12 OFFSET 5""",
    "offer_rows": f"""WITH {HOLDINGS},
firsts AS (SELECT s_nationkey, l_partkey, arg_min(format, idx) AS contenttype
           FROM dists GROUP BY ALL),
heads AS (SELECT s_nationkey, arg_min(sid, idx) AS service_id, arg_min(url, idx) AS endpoint_url,
            arg_min(coalesce(descr, ''), idx) AS endpoint_description FROM servs GROUP BY ALL)
SELECT 'nation-' || f.s_nationkey AS node_id, 'part-' || l_partkey AS dataset_id,
  'part-' || l_partkey AS name, contenttype, p_name AS title, CAST(p_size AS VARCHAR) AS version,
  CASE WHEN p_size % 2 = 0 THEN p_brand END AS creator,
  CASE WHEN p_size % 2 = 0 THEN
    CASE WHEN p_size % 4 = 0 THEN 'https://img.example/' || l_partkey ELSE '' END
    END AS creator_thumbnail,
  CASE WHEN p_size % 4 = 0 THEN 'https://img.example/' || l_partkey END AS thumbnail,
  replace(p_name, ' ', '|') AS keywords,
  CASE WHEN f.s_nationkey % 3 = 1 THEN 'did:web:nation-' || f.s_nationkey
       ELSE 'nation-' || f.s_nationkey END AS originator,
  service_id, endpoint_url, endpoint_description
FROM firsts f JOIN part ON l_partkey = p_partkey JOIN heads h ON f.s_nationkey = h.s_nationkey""",
    "keyword_split": f"""WITH {HOLDINGS}
SELECT keyword, count(*)::BIGINT AS n FROM (
  SELECT unnest(string_split(p_name, ' ')) AS keyword
  FROM holdings JOIN part ON l_partkey = p_partkey) GROUP BY ALL""",
    "policy_json": f"""{BASE},
texts AS (
  SELECT *, '{{"@type":"Offer","@id":"urn:policy:' || lower(x) || '","odrl:assigner":"did:web:nation-'
    || s_nationkey % 2 || '","permission":[{{"action":"odrl:use","constraint":[{{"or":[{{"and":['
    || '{{"leftOperand":"segment","operator":"eq","rightOperand":"' || x || '"}},'
    || '{{"leftOperand":"nation","operator":"isNoneOf","rightOperand":"1,2 , 3"}}]}},'
    || '{{"and":[{{"leftOperand":"nation","operator":"eq","rightOperand":"' || l_partkey % 25
    || '"}}]}},{{"xone":[]}}]}}]}}]' || CASE WHEN promo THEN ',"prohibition":[{{"action":"odrl:use",'
    || '"constraint":[{{"leftOperand":"nation","operator":"isAnyOf","rightOperand":"1, 2,3"}}]}}]'
    ELSE '' END || '}}' AS t0,
    '{{"@type":"Set","odrl:assigner":"did:web:nation-' || s_nationkey % 2
    || '","permission":[{{"action":"odrl:use","constraint":[{{"xone":['
    || '{{"leftOperand":"segment","operator":"eq","rightOperand":"' || x || '"}},'
    || '{{"leftOperand":"odrl:nation","operator":"odrl:eq","rightOperand":"' || l_partkey % 5
    || '"}}]}}]}}]}}' AS t1
  FROM holdings JOIN parts ON l_partkey = p_partkey WHERE has0 OR has1)
SELECT '[' || CASE WHEN has0 AND has1 THEN t0 || ',' || t1 WHEN has0 THEN t0 ELSE t1 END || ']'
  AS has_policy, count(*)::BIGINT AS n FROM texts GROUP BY ALL""",
    "offer_documents": f"""{BASE},
heads AS (SELECT s_nationkey, arg_min(sid, idx) AS service_id FROM servs GROUP BY ALL)
SELECT 'nation-' || h.s_nationkey AS node_id, l_partkey // 500 AS page,
  CASE WHEN h.s_nationkey % 3 = 1 THEN 'did:web:nation-' || h.s_nationkey
       ELSE 'nation-' || h.s_nationkey END AS originator,
  service_id, count(*)::BIGINT AS n_datasets, sum(has0::INT + has1::INT)::BIGINT AS n_policies
FROM holdings h JOIN parts ON l_partkey = p_partkey JOIN heads s ON h.s_nationkey = s.s_nationkey
GROUP BY ALL""",
    "offers_by_dataset_id": SHOWN + """
SELECT 'nation-' || n_nationkey AS node_id, 'catalog-' || n_regionkey AS catalog_id
FROM shown JOIN nation ON s_nationkey = n_nationkey WHERE l_partkey = 41""",
    # Ingest
    "response_failures": f"""WITH {DOCS}
SELECT DISTINCT node_id, error FROM landed WHERE error IS NOT NULL""",
    "parsed_datasets": f"""WITH {DOCS}
SELECT node_id, dataset_id, row_number() OVER (
    PARTITION BY node_id ORDER BY l_partkey % 2, l_partkey) - 1 AS idx,
  p_name AS title, CAST(p_size AS VARCHAR) AS version, replace(p_name, ' ', ', ') AS keywords,
  CASE WHEN p_size % 2 = 0 THEN p_brand END AS "creatorName" FROM good""",
    "parsed_services": f"""WITH {DOCS}
SELECT node_id, format, 'supplier-' || l_suppkey || '-' || format AS service_id,
  'https://s.example/' || format AS endpoint_url, count(*)::BIGINT AS n_uses
FROM (SELECT node_id, l_suppkey, unnest(formats) AS format FROM good) GROUP BY ALL""",
    "parsed_headers": f"""WITH {DOCS}
SELECT DISTINCT node_id, 'catalog-' || l_suppkey AS catalog_id,
  CASE WHEN node_id LIKE 's1%' THEN 'did:web:s1' END AS participant_id,
  'did:web:s' || l_suppkey % 3 AS declared,
  node_id LIKE 's1%' AND l_suppkey % 3 <> 1 AS mismatch FROM good""",
    "nested_federation": f"""WITH {DOCS}, levels AS (
  SELECT DISTINCT node_id, unnest([0, 1]) AS level FROM good)
SELECT level, count(*)::BIGINT AS n_catalogs,
  (SELECT count(*) FROM good WHERE l_partkey % 2 = level)::BIGINT AS n_datasets
FROM levels GROUP BY ALL""",
    "parsed_policies": f"""WITH {DOCS}
SELECT node_id, dataset_id, 0::BIGINT AS policy_idx,
  CASE WHEN p_size % 2 = 0 THEN 'urn:policy:' || p_size END AS policy_id,
  CASE WHEN p_size % 3 = 0 THEN 'Offer' ELSE 'Set' END AS kind,
  CASE WHEN p_size % 7 = 0 THEN p_brand END AS assignee FROM pols""",
    "alias_merge": f"""WITH {DOCS}
SELECT node_id, dataset_id, policy_idx, rule_kind, rule_idx, action FROM found_rules""",
    "scalar_render": f"""WITH {DOCS}
SELECT node_id, dataset_id, policy_idx, rule_kind, rule_idx, '0' AS path, 0 AS depth,
  CASE WHEN how = 'xone' THEN 'xone' ELSE 'atomic' END AS op,
  CASE how WHEN 'size' THEN 'size' WHEN 'none' THEN '' END AS left_operand,
  CASE how WHEN 'size' THEN 'lteq' WHEN 'none' THEN '{MARK}' END AS operator,
  CASE how WHEN 'size' THEN CAST(p_size AS VARCHAR)
    WHEN 'none' THEN CASE WHEN p_size % 7 = 0
      THEN '{{"@type":"Contract","assignee":"' || p_brand || '"}}' ELSE '{{"@type":"Contract"}}' END
    END AS right_operand
FROM found_rules WHERE how <> 'free'
UNION ALL SELECT node_id, dataset_id, policy_idx, rule_kind, rule_idx, '0/0', 1, 'atomic', 'brand',
  'eq', p_brand FROM found_rules WHERE how = 'xone'
UNION ALL SELECT node_id, dataset_id, policy_idx, rule_kind, rule_idx, '0/1', 1, 'atomic', '',
  '{MARK}', '{{"leftOperand":"size","operator":"eq"}}' FROM found_rules WHERE how = 'xone'""",
    "participant_checks": """
SELECT 'nation-' || n_nationkey AS node_id, violation FROM (
  SELECT n_nationkey, 'blank name' AS violation FROM nation WHERE n_nationkey % 10 = 9
  UNION ALL SELECT n_nationkey, 'unknown credential protocol' FROM nation WHERE n_nationkey % 4 = 3
  UNION ALL SELECT n_nationkey, 'missing provider_did' FROM nation
  WHERE n_nationkey % 4 = 1 AND n_nationkey % 3 <> 1
  UNION ALL SELECT n_nationkey, 'missing response_uri' FROM nation
  WHERE n_nationkey % 4 = 2 AND n_nationkey % 5 <> 1)""",
    # Snapshots
    "latest_snapshot": """
SELECT 'nation-' || user_id % 25 AS node_id, arg_max(event_id, (ts, event_id)) AS cycle_id,
  arg_max(props, (ts, event_id)) AS body
FROM events WHERE event_type <> 'error' AND CAST(value * 10 AS BIGINT) <= 30000 GROUP BY ALL""",
    "cycle_summary": """
SELECT floor(epoch(ts) / 3600)::BIGINT AS cycle_id, count(*)::BIGINT AS attempted,
  count(*) FILTER (event_type <> 'error')::BIGINT AS succeeded,
  count(*) FILTER (event_type = 'error')::BIGINT AS failed, max(epoch_us(ts)) AS last_finished
FROM events GROUP BY ALL""",
    "expired_nodes": """
SELECT 'nation-' || user_id % 25 AS node_id,
  max(epoch_us(ts)) FILTER (event_type <> 'error') AS last_success
FROM events GROUP BY ALL
HAVING epoch_us(TIMESTAMP '2024-01-31') / 1e6 - last_success / 1e6 > 10800""",
    "participant_status": """
WITH h AS (
  SELECT user_id % 25 AS k, max(ts) AS a, max(ts) FILTER (event_type <> 'error') AS s,
    arg_max(CASE WHEN event_type = 'error' THEN 'crawl failed: ' || props ELSE 'ok' END, ts) AS e
  FROM events GROUP BY ALL),
aged AS (SELECT *, epoch_us(TIMESTAMP '2024-01-31') / 1e6 - epoch_us(s) / 1e6 AS age FROM h)
SELECT 'nation-' || n_nationkey AS node_id, strftime(a, '%Y-%m-%dT%H:%M:%SZ') AS last_attempt,
  strftime(s, '%Y-%m-%dT%H:%M:%SZ') AS last_success, CASE WHEN e <> 'ok' THEN e END AS last_error,
  coalesce(age <= 10800, false) AS cached,
  CASE WHEN age <= 10800 THEN floor(greatest(age, 0))::BIGINT END AS catalog_age_secs
FROM nation LEFT JOIN aged ON k = n_nationkey""",
    "readiness": """
SELECT 'ready' AS status, count(DISTINCT floor(epoch(ts) / 3600))::BIGINT AS cycles_completed
FROM events""",
    "snapshot_diff": f"""
WITH rows AS (
  SELECT DISTINCT '{N}nation-' || s_nationkey AS graph,
    '{N}nation-' || s_nationkey || '/datasets/part-' || l_partkey AS s, l_returnflag AS o,
    l_linestatus AS side FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)
SELECT graph, s, o, CASE WHEN min(side) = 'F' THEN 'removed' ELSE 'added' END AS change
FROM rows GROUP BY graph, s, o HAVING count(*) = 1""",
    "store_diff": FULL + f"""
SELECT g AS graph, s, p, o, CASE WHEN k % 5 = 1 THEN 'added' ELSE 'removed' END AS change
FROM quads JOIN (SELECT g, k FROM cg) USING (g) WHERE p = '{PROP}title' AND k % 5 IN (1, 2)""",
    "deleted_nodes": f"""WITH {HOLDINGS}
SELECT 'nation-' || s_nationkey AS node_id, count(*)::BIGINT AS n_datasets FROM holdings
WHERE s_nationkey % 5 <> 2 GROUP BY s_nationkey
UNION ALL SELECT 'nation-' || n_nationkey, -1 FROM nation WHERE n_nationkey % 5 = 2""",
    "published_snapshot": f"""WITH {HOLDINGS}
SELECT 'nation-' || s_nationkey AS node_id, count(*)::BIGINT AS n_datasets, snapshot
FROM holdings, (VALUES ('first'), ('newest')) t(snapshot)
WHERE snapshot = 'first' OR s_nationkey <> 7 GROUP BY s_nationkey, snapshot""",
    "skipped_catalogs": """
SELECT 'nation-' || n_nationkey AS node_id, 'catalog-' || n_regionkey AS catalog_id FROM nation
WHERE n_nationkey % 4 = 0 OR n_nationkey NOT IN (SELECT s_nationkey FROM supplier)""",
    "landed_responses": """
SELECT 'nation-' || user_id % 25 AS node_id, event_type <> 'error' AS ok,
  CASE WHEN event_type = 'error' THEN 'returned HTTP 500' END AS error,
  count(*)::BIGINT AS n, max(event_id) AS last_cycle
FROM events GROUP BY ALL""",
    "completeness": """
SELECT 'customer-' || coalesce(c_custkey, user_id) AS dataset_id,
  CASE WHEN user_id IS NULL THEN 'missing' ELSE 'unexpected' END AS status
FROM customer FULL JOIN (SELECT DISTINCT user_id FROM events) ON user_id = c_custkey
WHERE user_id IS NULL OR c_custkey IS NULL""",
    # Streams
    "stream_cycle_health": """
SELECT epoch_us(time_bucket(INTERVAL '1 hour', ts)) AS start, count(*)::BIGINT AS attempted,
  count(*) FILTER (event_type <> 'error')::BIGINT AS succeeded,
  count(*) FILTER (event_type = 'error')::BIGINT AS failed
FROM events GROUP BY time_bucket(INTERVAL '1 hour', ts)
HAVING time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour'
  <= (SELECT max(ts) FROM events) - INTERVAL '10 minutes'""",
    "stream_all_intervals": """
SELECT epoch_us(time_bucket(INTERVAL '1 hour', ts)) AS start, count(*)::BIGINT AS attempted,
  count(*) FILTER (event_type <> 'error')::BIGINT AS succeeded,
  count(*) FILTER (event_type = 'error')::BIGINT AS failed
FROM events GROUP BY 1""",
    "stream_ingest": """
SELECT 'nation-' || user_id % 25 AS node_id, 'catalog-' || max_by(event_id, (ts, event_id)) AS catalog_id,
  'dataset-' || max_by(event_id, (ts, event_id)) % 7 AS dataset_id
FROM events WHERE event_type <> 'error' GROUP BY user_id % 25""",
    "stream_entitlement": f"""
WITH held AS (SELECT user_id % 25 AS k, max_by(event_id, (ts, event_id)) % 7 AS d
              FROM events WHERE event_type <> 'error' GROUP BY user_id % 25)
SELECT class_key, 'nation-' || k AS node_id, '{N}nation-' || k || '/datasets/dataset-' || d AS iri
FROM held, (VALUES ('AUTOMOBILE'), ('BUILDING'), ('FURNITURE'), ('HOUSEHOLD'), ('MACHINERY')) c(class_key)""",
    "stream_status": """
SELECT 'nation-' || user_id % 25 AS node_id, epoch_us(max(ts)) AS last_attempt,
  epoch_us(max(ts) FILTER (event_type <> 'error')) AS last_success,
  CASE WHEN max_by(event_type, (ts, event_id)) = 'error' THEN 'returned HTTP 500' END AS last_error,
  count(*)::BIGINT AS attempts
FROM events GROUP BY user_id % 25""",
    "stream_expiry": """
SELECT 'nation-' || user_id % 25 AS node_id,
  max(epoch_us(ts) // 1000) FILTER (event_type <> 'error') AS last_success_ms
FROM events GROUP BY ALL
HAVING last_success_ms + 20000 * 1000
  < (SELECT epoch_us(max(ts)) // 1000 FROM events) - 600000""",
}
ORACLES["stream_entitlement_deltas"] = ORACLES["stream_entitlement"].replace("AS iri", "AS iri, 1::BIGINT AS times")
ORACLES["refreshed_allow_list"] = ORACLES["allow_list"]
