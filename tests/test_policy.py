"""Decisions against a plain-Python evaluator over random policies."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from catalogspark.operators import claims as C
from catalogspark.operators.policy import PolicyConfig, entitle
from tests.build import Builder

AS_OF = "2026-01-01T00:00:00Z"
CLAIMS = {
    "none": {},
    "de": {"region": ["DE"], "role": ["a", "b"], "age": ["30"]},
    "fr": {"region": ["FR"], "age": ["9"], "sub": ["alice"]},
    "odd": {"region": ["", "x"], "sub": ["bob"], "age": ["n/a"]},
}
OPS = ["eq", "odrl:neq", "isAnyOf", "isAllOf", "isNoneOf", "isPartOf", "lt", "gteq", "weird"]


def compare(values, op, right):
    if values is None or op == "weird":
        return None
    op = op.removeprefix("odrl:")
    options = [x.strip() for x in right.split(",") if x.strip()]
    if op == "eq":
        return right in values
    if op == "neq":
        return right not in values
    if op in ("isAnyOf", "isPartOf"):
        return any(v in options for v in values)
    if op == "isNoneOf":
        return not any(v in options for v in values)
    if op == "isAllOf":
        return all(o in values for o in options)

    def one(v):
        try:
            a, b = float(v), float(right)
        except ValueError:
            return None
        return a < b if op == "lt" else a >= b

    got = [one(v) for v in values]
    return True if True in got else (None if None in got else False)


def value(c, claims):
    if isinstance(c, tuple):
        return compare(claims.get(c[0].removeprefix("odrl:")), c[1], c[2])
    (op, kids), = c.items()
    got = [value(k, claims) for k in kids]
    if op in ("and", "andSequence"):
        return False if False in got else (None if None in got else True)
    if op == "or":
        return True if True in got else (None if None in got else False)
    n = got.count(True)
    return False if n > 1 else (None if None in got else n == 1)


def strip(c):
    """Drop unmappable constraints inside groups."""
    if isinstance(c, tuple):
        return None if c[1] == "weird" else c
    (op, kids), = c.items()
    return {op: [k for k in map(strip, kids) if k is not None]}


def unmappable(policy):
    def bad(c):
        return c[1] == "weird" if isinstance(c, tuple) else any(map(bad, next(iter(c.values()))))

    kinds = ("permission", "prohibition", "obligation")
    return any(bad(c) for k in kinds for r in policy.get(k, ()) for c in r["constraints"])


def rule(r, claims):
    return value({"and": r["constraints"]}, claims)


def allows(policy, claims, cfg):
    who = policy.get("assignee")
    if who is not None and who not in claims.get("sub", ()):
        return False
    act = [r for r in policy.get("prohibition", ()) if r["action"] in ("use", "odrl:use")]
    if any(rule(r, claims) is not False for r in act):
        return False
    if not policy.get("permission"):
        return cfg.no_policy == "open"
    return any(
        rule(r, claims) is True for r in policy["permission"] if r["action"] in ("use", "odrl:use")
    )


def visible(policies, claims, cfg):
    if not policies:
        return cfg.no_policy == "open"
    bad = [unmappable(p) for p in policies]
    if cfg.unmappable == "hide_dataset" and cfg.strict and any(bad):
        return False
    for p, is_bad in zip(policies, bad):
        if is_bad and cfg.unmappable == "hide_dataset":
            return False
        if is_bad and cfg.unmappable == "drop_policy":
            continue
        if is_bad:
            p = {
                k: [{**r, "constraints": [c for c in map(strip, r["constraints"]) if c is not None]}
                    for r in v] if isinstance(v, list) else v
                for k, v in p.items()
            }
        if allows(p, claims, cfg):
            return True
    return False


def random_policies(rng):
    def constraint(depth):
        if depth < 3 and rng.random() < 0.3:
            op = rng.choice(["and", "or", "xone", "andSequence"])
            return {op: [constraint(depth + 1) for _ in range(rng.randint(0, 3))]}
        weights = [5, 3, 3, 2, 2, 2, 2, 2, 1]
        return (rng.choice(["region", "odrl:role", "age"]), rng.choices(OPS, weights)[0],
                rng.choice(["DE", "DE, FR", "a,b", "10", "", "x"]))

    def rules(n):
        return [
            {"action": rng.choice(["use", "odrl:use", "odrl:use", "read"]),
             "constraints": [constraint(0) for _ in range(rng.randint(0, 2))]}
            for _ in range(rng.randint(0, n))
        ]

    return [
        {"permission": rules(2), "prohibition": rules(1), "obligation": rules(1),
         "assignee": rng.choice([None, None, "alice", "carol"])}
        for _ in range(rng.randint(0, 3))
    ]


def classes(spark):
    return spark.createDataFrame(list(CLAIMS.items()), "class_key string, claims map<string,array<string>>")


@pytest.fixture(scope="module")
def case(spark):
    rng = random.Random(7)
    made = {f"d{i}": random_policies(rng) for i in range(120)}
    b = Builder(spark)
    b.catalog("n")
    for name, policies in made.items():
        b.dataset("n", name, policies=policies)
    return made, b.tables()


@pytest.mark.parametrize("cfg", [
    PolicyConfig(),
    PolicyConfig(strict=True, no_policy="closed"),
    PolicyConfig(unmappable="skip_constraint"),
    PolicyConfig(unmappable="drop_policy"),
], ids=["in_order", "strict_closed", "skip", "drop"])
def test_random_policies(spark, case, cfg):
    made, tables = case
    got = {(r.class_key, r.dataset_id) for r in entitle(tables, classes(spark), cfg).visible().collect()}
    want = {(k, d) for k, c in CLAIMS.items() for d, ps in made.items() if visible(ps, c, cfg)}
    assert got == want


def test_any_sub_value_opens_assigned_datasets(spark):
    claims = {"two": {"sub": ["a", "b"]}, "b": {"sub": ["b"]}, "other": {"sub": ["x", "y"]}, "none": {}}
    callers = spark.createDataFrame(list(claims.items()), "class_key string, claims map<string,array<string>>")
    free = {"action": "use", "constraints": []}
    for unrelated in ([], [{"action": "use", "constraints": [("sub", "eq", "q")]}]):
        b = Builder(spark)
        b.catalog("n")
        b.dataset("n", "scoped", policies=[{"permission": [free], "assignee": "b"}])
        b.dataset("n", "shared", policies=[{"permission": [free]}])
        b.dataset("n", "unrelated", policies=[{"permission": unrelated, "assignee": "z"}] if unrelated else [])
        got = {(r.class_key, r.dataset_id) for r in entitle(b.tables(), callers).visible().collect()}
        assert {k for k, d in got if d == "scoped"} == {"two", "b"}
        assert {k for k, d in got if d == "shared"} == set(claims)


def test_deny_overrides_reasons(spark):
    rule_ = lambda *cs, action="x": {"action": action, "constraints": list(cs)}
    b = Builder(spark)
    b.catalog("n")
    made = {
        "match": [{"id": "p", "permission": [rule_(("region", "eq", "DE"), ("age", "neq", "1"))]}],
        "prohibited": [{"permission": [rule_()]}, {"prohibition": [rule_(("role", "isAnyOf", " b ,z"))]}],
        "unsure": [{"permission": [rule_()], "prohibition": [rule_(("ghost", "eq", "1"))]}],
        "unknown op": [{"permission": [rule_(("age", "gteq", "3"))]}],
        "prefixed op": [{"permission": [rule_(("region", "odrl:eq", "DE"))]}],
        "second": [{"permission": [rule_(("region", "eq", "FR")), rule_(("role", "eq", "b"))]}],
        "open": [{"obligation": [rule_()]}],
        "none": [],
        "group": [{"permission": [rule_({"and": []})]}],
        "empty list": [{"permission": [rule_(("region", "isAnyOf", " , "))]}],
        "miss beats unsure": [{"prohibition": [rule_(("ghost", "eq", "1"), ("region", "eq", "FR"))]}],
    }
    for name, policies in made.items():
        b.dataset("n", name, policies=policies)
    out = entitle(b.tables(), classes(spark).filter("class_key = 'de'"), PolicyConfig(mode="deny_overrides"))
    rows = out.members.join(out.decisions, "policy_set").join(out.classes, ["operands", "projection"])
    got = {r.dataset_id: (r.visible, r.reason) for r in rows.collect()}
    none = "permission rules exist but none matched the caller's claims"
    open_ = "no permission rules declared on any attached policy; open by default"
    assert got == {
        "match": (True, "permission[0] of policy 'p' matched: region eq DE and age neq 1"),
        "prohibited": (False, "prohibition[0] of policy '<unnamed>' matched: role isAnyOf  b ,z"),
        "unsure": (False, "prohibition[0] of policy '<unnamed>' could not be evaluated, failing closed: ghost eq 1"),
        "unknown op": (False, none), "prefixed op": (False, none),
        "second": (True, "permission[1] of policy '<unnamed>' matched: role eq b"),
        "open": (True, open_), "none": (True, open_), "group": (False, none),
        "empty list": (False, none), "miss beats unsure": (True, open_),
    }


def test_claim_mapping(spark):
    body = ('{"s":"x","l":["a","b"],"mixed":["a",1],"n":3,"t":true,"o":{},"z":null,"scope":" r  w\\t",'
            '"jti":"1","exp":5,"e":[],"dateTime":"1999"}')
    callers = spark.createDataFrame([("a", body), ("b", body.replace('"jti":"1"', '"jti":"2"')),
                                     ("c", "not json"), ("d", '{"scope":["x y"]}')],
                                    "caller_id string, claims string")
    got = {r.caller_id: r for r in C.map_callers(callers, AS_OF).collect()}
    assert got["a"].caller_key == got["b"].caller_key
    assert got["a"].caller_key == '{"dateTime":"1999","e":[],"l":["a","b"],"s":"x","scope":["r","w"]}'
    assert got["a"].claims["dateTime"] == [AS_OF] and "n" not in got["a"].claims
    assert got["c"].caller_key == "{}" and got["d"].claims["scope"] == ["x y"]


def test_admission(spark):
    t = 1767225600
    cases = {
        "ok": ('{"exp":%d,"scope":"a read","iss":"i","aud":["x","me"]}' % (t + 5), 200),
        "leeway": ('{"exp":%d,"scope":"read","iss":"i","aud":"me"}' % (t - 30), 200),
        "expired": ('{"exp":%d,"scope":"read","iss":"i","aud":"me"}' % (t - 90), 401),
        "no exp": ('{"scope":"read","iss":"i","aud":"me"}', 401),
        "early": ('{"exp":%d,"nbf":%d,"scope":"read","iss":"i","aud":"me"}' % (t + 999, t + 90), 401),
        "no iss": ('{"exp":%d,"scope":"read","aud":"me"}' % (t + 5), 401),
        "aud": ('{"exp":%d,"scope":"read","iss":"i","aud":"you"}' % (t + 5), 401),
        "scope": ('{"exp":%d,"scope":"reader","iss":"i","aud":"me"}' % (t + 5), 403),
        "listed scope": ('{"exp":%d,"scope":["read"],"iss":"i","aud":"me"}' % (t + 5), 403),
    }
    callers = spark.createDataFrame([(k, v[0]) for k, v in cases.items()], "caller_id string, claims string")
    got = C.admit(callers, AS_OF, issuer="i", audience="me", required_scope="read").collect()
    assert {r.caller_id: r.status for r in got} == {k: v[1] for k, v in cases.items()}
    free = C.admit(callers, AS_OF).filter(F.col("status") == 200).collect()
    assert {r.caller_id for r in free} == set(cases) - {"expired", "no exp", "early"}
