from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from catalogspark import schema as S
from catalogspark.operators import listing, offers, snapshot, visibility
from catalogspark.operators.policy import entitle
from catalogspark.sources import participants as PC
from catalogspark.sources import responses as R
from catalogspark.streaming import harvest
from tests.build import Builder, canonical, permit

T0 = dt.datetime(2026, 1, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def members(spark, *nodes):
    return spark.createDataFrame([(n, n, "u", "none", None, None) for n in nodes], S.PARTICIPANTS)


@pytest.fixture(scope="module")
def log(spark):
    rows = [
        ("a", 1, at(0), True, None, 1), ("a", 2, at(10), False, "down", 1), ("a", 3, at(20), True, None, 1),
        ("b", 1, at(0), True, None, 1), ("b", 2, at(10), False, "e1", 1), ("b", 3, at(20), False, "e2", 1),
        ("c", 1, at(0), False, "never", 1),
    ]
    return spark.createDataFrame(rows, S.CRAWL_LOG)


def test_status_expiry_and_readiness(spark, log):
    as_of = "2026-01-01T00:30:00Z"
    status = snapshot.participant_status(members(spark, "a", "b", "c", "d"), log, as_of, 900)
    got = {r.node_id: (r.last_error, r.cached, r.catalog_age_secs) for r in status.collect()}
    assert got == {"a": (None, True, 600), "b": ("e2", False, None), "c": ("never", False, None),
                   "d": (None, False, None)}
    assert [r.node_id for r in snapshot.expired_nodes(log, as_of, 900).collect()] == ["b"]
    # Exactly at the limit is not older than it; a clock behind the log gives age 0.
    assert snapshot.expired_nodes(log, as_of, 1800).count() == 0
    early = snapshot.participant_status(members(spark, "a"), log, "2025-12-31T00:00:00Z", 900).first()
    assert early.catalog_age_secs == 0
    report = {r.id: json.loads(r.report) for r in snapshot.status_report(status).collect()}
    assert report["a"]["last_success"] == "2026-01-01T00:20:00Z" and report["d"]["last_attempt"] is None
    assert snapshot.readiness(log).first().asDict() == {"status": "ready", "cycles_completed": 3}
    none = log.limit(0)
    assert snapshot.readiness(none).first().status == "starting"
    assert snapshot.readiness(none, waits_for_first_cycle=False).first().status == "ready"
    cycles = {r.cycle_id: (r.attempted, r.succeeded, r.failed) for r in snapshot.cycle_summary(log).collect()}
    assert cycles == {1: (3, 2, 1), 2: (2, 0, 2), 3: (2, 1, 1)}
    first = [r.node_id for r in snapshot.cycle_outcomes(log, members(spark, "a", "b", "c")).collect()][:3]
    assert first == ["a", "b", "c"]


def catalogs(spark, **data):
    b = Builder(spark)
    for node, ids in data.items():
        b.catalog(node, f"cat-{node}")
        b.service(node, "s")
        for i in ids:
            b.dataset(node, i, [("json", "s")], [permit(("a", "eq", "1"))])
    return b.tables()


def test_replace_delete_publish(spark, tmp_path):
    old, new = catalogs(spark, a=["1", "2"], b=["3"]), catalogs(spark, a=["9"])
    merged = snapshot.replace_nodes(old, new)
    assert {r.dataset_id for r in merged.datasets.collect()} == {"9", "3"}
    gone, removed = snapshot.delete_nodes(merged, spark.createDataFrame([("b",), ("zz",)], "node_id string"))
    assert [r.node_id for r in removed.collect()] == ["b"] and gone.policies.count() == 1
    path = str(tmp_path / "snap")
    snapshot.publish(old, path, 1)
    snapshot.publish(merged, path, 2)
    assert canonical(snapshot.read_snapshot(spark, path, 1).datasets) == canonical(old.datasets)
    assert canonical(snapshot.read_snapshot(spark, path).constraints) == canonical(merged.constraints)
    lost = snapshot.completeness(merged.datasets, old.datasets).collect()
    assert {(r.dataset_id, r.status) for r in lost} == {("1", "missing"), ("2", "missing"), ("9", "unexpected")}


def test_participant_checks(spark):
    rows = [("a", "A", "u", "none", None, None), ("a", "A", "u", "dcp", None, None),
            (" ", "B", "u", "oid4vp", None, "r"), ("c", "", "u", "x", None, None),
            ("d", "D", "u", "dcp", "did:d", None)]
    got = PC.check_participants(spark.createDataFrame(rows, S.PARTICIPANTS), has_holder=False).collect()
    assert sorted((r.node_id, r.violation) for r in got) == sorted([
        ("a", "duplicate id"), ("a", "missing provider_did"), ("a", "missing holder"), (" ", "blank id"),
        (" ", "missing holder"), ("c", "blank name"), ("c", "unknown credential protocol"), ("d", "missing holder")])


def deep(n):
    c = ("x", "eq", 'q"1')
    for _ in range(n):
        c = {"andSequence": [c]}
    return c


def test_offers(spark, monkeypatch):
    monkeypatch.setattr(offers, "MAX_SERVED_GROUP_DEPTH", 2)
    b = Builder(spark)
    b.catalog("n", "cat", "did:p")
    b.service("n", "s1", "u1")
    b.service("n", "s2", "u2", "d")
    policy = {"id": "p", "kind": "Offer", "assignee": "bob", "permission": [
        {"constraints": [deep(1), {"xone": []}, deep(3)]}], "obligation": [{"action": "urn:z"}]}
    b.dataset("n", "d0", [("json", "s1"), ("csv", "s1")], [policy, {}], title="T", creatorName="C",
              keywords=" a, ,b")
    b.dataset("n", "d1", thumbnail="img")
    b.dataset("n", "d2")
    b.catalog("bare", "cat")
    b.dataset("bare", "x")
    b.catalog("empty", "cat2")
    b.service("empty", "e")
    tables = b.tables()
    rows = {(r.node_id, r.page): json.loads(r.offer) for r in offers.offers(tables, page_size=2).collect()}
    assert set(rows) == {("n", 0), ("n", 1), ("empty", 0)}
    head = rows["n", 0]
    first, second = head[S.DCAT + "dataset"]
    marker = {"leftOperand": "", "operator": S.NS.unmappable_operator,
              "rightOperand": "logical group nested beyond the served depth limit"}
    atom = {"leftOperand": "x", "operator": "eq", "rightOperand": 'q"1'}
    assert first == {
        "@id": "d0", "@type": "Dataset", "name": "d0", "contenttype": "json", "title": "T",
        "creator": {"name": "C", "thumbnail": {"resource": ""}}, "keywords": ["a", "b"],
        S.ODRL + "hasPolicy": [
            {"@type": "Offer", "@id": "p", "odrl:assignee": "bob", "permission": [
                {"action": "odrl:use", "constraint": [{"and": [atom]}, {"xone": []}, {"and": [{"and": [marker]}]}]}],
             "obligation": [{"action": "urn:z"}]}, {"@type": "Set"}]}
    assert second == {"@id": "d1", "@type": "Dataset", "name": "d1", "contenttype": "",
                      "thumbnail": {"resource": "img"}, S.ODRL + "hasPolicy": []}
    assert head[S.DCAT + "service"]["@id"] == "s1" and head["participantId"] == {"@id": "did:p"}
    assert [d["@id"] for d in rows["n", 1][S.DCAT + "dataset"]] == ["d2"]
    assert S.DCAT + "dataset" not in rows["empty", 0] and rows["empty", 0]["originator"] == "empty"
    assert [r.node_id for r in offers.skipped_catalogs(tables).collect()] == ["bare"]
    assert [r.node_id for r in offers.catalogs_with_dataset(tables, "d2").collect()] == ["n"]
    full = {(r.node_id, r.page): json.loads(r.catalog) for r in listing.catalog_json(tables).collect()}
    assert [d["id"] for d in full["n", 0]["datasets"]] == ["d0", "d1", "d2"]
    assert full["n", 0]["datasets"][0]["distributions"][1] == {"format": "csv", "access_service": "s1"}
    stored = lambda left, op, right: {"left_operand": left, "operator": op, "right_operand": right}
    none = {"id": None, "kind": "Set", "assigner": None, "assignee": None, "permissions": [], "prohibitions": [],
            "obligations": []}
    nested = {"odrl:andSequence": [stored("x", "eq", 'q"1')]}
    assert full["n", 0]["datasets"][0]["policies"] == [
        {"id": "p", "kind": "Offer", "assigner": None, "assignee": "bob", "permissions": [
            {"action": "odrl:use", "constraints": [
                nested, {"odrl:xone": []}, {"odrl:andSequence": [{"odrl:andSequence": [nested]}]}]}],
         "prohibitions": [], "obligations": [{"action": "urn:z", "constraints": []}]}, none]
    assert full["n", 0]["data_services"][0] == {"id": "s1", "endpoint_url": "u1", "endpoint_description": None}
    found = offers.offers_with_dataset(tables, "d2", page_size=2).collect()
    assert [r.offer for r in sorted(found, key=lambda r: r.page)] == [
        r.offer for r in sorted(offers.offers(tables, page_size=2).collect(), key=lambda r: r.page) if r.node_id == "n"]
    assert len(full["bare", 0]["datasets"]) == 1 and full["bare", 0]["data_services"] == []
    order = [(r.catalog_id, r.node_id) for r in listing.list_catalogs(tables.catalogs, offset=1).collect()]
    assert order == [("cat", "n"), ("cat2", "empty")]


def test_requested_dataset():
    entry = lambda left, op, right: {"operandLeft": left, "operator": op, "operandRight": right}
    body = {"filterExpression": [entry("x", "=", "no"), entry("datasets.id", "like", "no"),
                                 entry("datasets.id", "=", "yes"), entry("datasets.id", "=", "later")]}
    assert offers.requested_dataset(json.dumps(body)) == "yes"
    for bad in ("", "[]", "{", '{"filterExpression": 3}', "null"):
        assert offers.requested_dataset(bad) is None


def test_stream_keeps_the_last_good_catalog(spark, tmp_path):
    def land(batch, rows):
        spark.createDataFrame(rows, S.RESPONSES).write.parquet(str(tmp_path / "in" / f"b{batch}"))

    doc = lambda *ids: json.dumps({"dataset": [{"@id": i} for i in ids]})
    out = str(tmp_path / "out")
    run = harvest.upsert_batch(members(spark, "a", "b"), out, 1000, 1000)
    steps = [
        ([("a", 1, at(0), 200, 1, doc("1", "2")), ("b", 1, at(0), 200, 1, doc("3"))], {"1", "2", "3"}),
        ([("a", 3, at(9), 500, 1, "x"), ("b", 2, at(8), 200, 1, doc("4")), ("b", 4, at(9), 200, 1, doc("5"))],
         {"1", "2", "5"}),
        # fetched between the others and landed last; a crawl delivered again; an old first delivery
        ([("b", 3, at(5), 200, 1, doc("6")), ("a", 1, at(0), 200, 1, doc("1", "2")), ("a", 2, at(2), 200, 1, doc("7"))],
         {"7", "5"}),
    ]
    held = lambda path: {r.dataset_id for r in harvest.read_current(spark, path).datasets.collect()}
    for i, (rows, want) in enumerate(steps):
        land(i, rows)
        source = R.stream_responses(spark, str(tmp_path / "in" / "*"))
        harvest.start_ingest(source, run, str(tmp_path / "cp")).awaitTermination()
        assert held(out) == want
    log = harvest.read_log(spark, out).collect()
    assert sorted((r.node_id, r.cycle_id, r.ok) for r in log) == [
        ("a", 1, True), ("a", 2, True), ("a", 3, False), ("b", 1, True), ("b", 2, True), ("b", 3, True), ("b", 4, True)
    ]
    last = spark.createDataFrame([("a", 2, at(2), 200, 1, doc("7"))], S.RESPONSES)
    run(last.limit(0), 9)  # an empty batch
    assert held(out) == {"7", "5"}
    harvest.compact(spark, out, str(tmp_path / "next"))
    assert held(str(tmp_path / "next")) == {"7", "5"}
    harvest.expire_nodes(spark, out, str(at(9)), (at(9) - at(2)).total_seconds() - 1)
    assert held(out) == {"5"}
    run(spark.createDataFrame([("a", 8, at(20), 200, 1, doc("8"))], S.RESPONSES), 10)
    assert held(out) == {"8", "5"}
    harvest.remove_nodes(spark, out, members(spark, "b"))
    assert held(out) == {"8"}


def test_bodies_nested_too_deep_are_refused(spark):
    bodies = {"at the limit": "[" * 127 + "]" * 127, "past it": "[" * 128 + "]" * 128, "objects": '{"a":' * 128 + "1" + "}" * 128,
              "in text": '{"a":"' + "[" * 300 + '\\"]"}', "wide": "[" + ",".join(["[[]]"] * 400) + "]"}
    rows = [(k, 1, at(0), 200, 1, body) for k, body in bodies.items()]
    checked = R.check_responses(spark.createDataFrame(rows, S.RESPONSES)).collect()
    assert {r.node_id for r in checked if r.error} == {"past it", "objects"}


def test_live_status_matches_batch(spark, log, tmp_path):
    log.write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(S.CRAWL_LOG).parquet(str(tmp_path / "log"))
    query = harvest.live_status(stream).writeStream.outputMode("update").format("memory").queryName("live").start()
    query.processAllAvailable()
    query.stop()
    got = {r.node_id: r.last_error for r in spark.table("live").collect()}
    assert got == {"a": None, "b": "e2", "c": "never"}

def test_deltas_add_up_to_the_whole_list(spark, tmp_path):
    out, lists = str(tmp_path / "out"), str(tmp_path / "lists")
    doc = lambda *ids: json.dumps({"dataset": [{"@id": i} for i in ids]})
    classes = spark.createDataFrame([("x", {}), ("y", {})], "class_key string, claims map<string,array<string>>")
    run = harvest.upsert_batch(members(spark, "a", "b"), out, 1000, 1000, harvest.entitle_deltas(classes, out, lists))
    batch = lambda *rows: spark.createDataFrame(rows, S.RESPONSES)
    ids = lambda df: {(r.class_key, r.node_id, r.iri.rsplit("/", 1)[1]) for r in df.collect()}
    both = lambda *pairs: {(c, n, d) for c in "xy" for n, d in pairs}

    def state(want, changed, rebuilt=False):
        assert ids(harvest.read_allow_list(spark, lists)) == want
        deltas = harvest.read_deltas(spark, lists)
        assert {r.batch for r in deltas.collect()} == changed
        sums = deltas.groupBy("class_key", "node_id", "iri").agg(F.sum("change").alias("n"))
        assert {r.n for r in sums.collect()} <= {0, 1} and ids(sums.filter("n = 1")) == want
        if rebuilt:
            whole = harvest.read_current(spark, out)
            assert ids(visibility.allow_list(whole, entitle(whole, classes))) == want

    run(batch(("a", 1, at(0), 200, 1, doc("1", "2")), ("b", 1, at(0), 200, 1, doc("3"))), 0)
    state(both(("a", "1"), ("a", "2"), ("b", "3")), {0})
    run(batch(("a", 2, at(1), 200, 1, doc("2", "1"))), 1)  # the same content again
    run(batch(("a", 3, at(2), 500, 1, "x")), 2)  # nothing arrived
    state(both(("a", "1"), ("a", "2"), ("b", "3")), {0})
    for _ in range(2):  # a batch that runs again
        run(batch(("a", 4, at(3), 200, 1, doc("2", "4"))), 3)
        state(both(("a", "2"), ("a", "4"), ("b", "3")), {0, 3})
    harvest.remove_nodes(spark, out, members(spark, "b"))
    run(batch(("a", 5, at(4), 500, 1, "x")), 4)
    state(both(("a", "2"), ("a", "4")), {0, 3, 4})
    run(batch(("b", 9, at(9), 200, 1, doc("3"))), 5)
    state(both(("a", "2"), ("a", "4"), ("b", "3")), {0, 3, 4, 5}, rebuilt=True)


def test_reading_writes_nothing(spark, tmp_path):
    held = harvest.read_current(spark, str(tmp_path / "none"))
    assert held.catalogs.isEmpty() and harvest.read_log(spark, str(tmp_path / "none")).isEmpty()
    assert harvest.read_allow_list(spark, str(tmp_path / "none")).isEmpty()
    assert not (tmp_path / "none").exists()
