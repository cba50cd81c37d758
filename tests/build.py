"""Small hand-written catalogs for tests."""

from __future__ import annotations

from catalogspark import schema as S
from catalogspark.schema import CatalogTables


class Builder:
    """Collects rows and turns them into CatalogTables."""

    def __init__(self, spark):
        self.spark = spark
        self.rows = {k: [] for k in CatalogTables.__dataclass_fields__}

    def catalog(self, node, catalog_id="cat", participant_id=None, **properties):
        self.rows["catalogs"].append((node, catalog_id, participant_id, properties))

    def service(self, node, service_id, url="https://s.example/", description=None):
        idx = sum(r[0] == node for r in self.rows["services"])
        self.rows["services"].append((node, service_id, idx, url, description))

    def dataset(self, node, dataset_id, distributions=(), policies=(), **properties):
        idx = sum(r[0] == node for r in self.rows["datasets"])
        self.rows["datasets"].append((node, dataset_id, idx, properties))
        for i, (fmt, service) in enumerate(distributions):
            self.rows["distributions"].append((node, dataset_id, i, fmt, service))
        for i, policy in enumerate(policies):
            self._policy(node, dataset_id, i, policy)

    def _policy(self, node, dataset_id, idx, policy):
        key = (node, dataset_id, idx)
        self.rows["policies"].append(
            key + (policy.get("id"), policy.get("kind", "Set"), policy.get("assigner"),
                   policy.get("assignee"))
        )
        for kind in S.RULE_KINDS:
            for r, rule in enumerate(policy.get(kind, ())):
                rule_key = key + (kind, r)
                self.rows["rules"].append(rule_key + (rule.get("action", "odrl:use"),))
                for c, constraint in enumerate(rule.get("constraints", ())):
                    self._constraint(rule_key, [c], constraint)

    def _constraint(self, key, path, constraint):
        if isinstance(constraint, tuple):
            row = key + (path, len(path) - 1, "atomic") + constraint
            self.rows["constraints"].append(row)
            return
        (op, nested), = constraint.items()
        self.rows["constraints"].append(key + (path, len(path) - 1, op, None, None, None))
        for i, child in enumerate(nested):
            self._constraint(key, path + [i], child)

    def tables(self) -> CatalogTables:
        return CatalogTables(
            **{
                name: self.spark.createDataFrame(rows, getattr(S, name.upper()))
                for name, rows in self.rows.items()
            }
        )


def permit(*constraints, action="odrl:use"):
    return {"permission": [{"action": action, "constraints": list(constraints)}]}


def canonical(df):
    """Rows of a DataFrame, maps and structs included, as a sorted list of text."""
    import json

    names = sorted(df.columns)
    return sorted(
        json.dumps([row.asDict(True)[n] for n in names], default=str, sort_keys=True)
        for row in df.collect()
    )
