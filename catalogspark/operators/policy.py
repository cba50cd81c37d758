"""Policy evaluation over distinct policy sets and distinct caller projections.

A dataset's policies are reduced to a content key (its policy set), a caller's
claims to the operands a policy set names (its projection). Decisions are made
once per (policy set, projection) and joined back with equi-joins, so nothing
is ever evaluated per dataset and caller.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogspark.functions import odrl
from catalogspark.schema import (
    DATASET_KEY,
    MAX_CONSTRAINT_DEPTH,
    CatalogTables,
)
from catalogspark.session import cut

NO_POLICIES = "none"  # policy set of a dataset without policies
ALWAYS = "always"  # policy set of what every class may see
PAIR = ["policy_set", "operands", "projection"]
RULE = ["policy_idx", "rule_kind", "rule_idx"]
LABELS = ["policy_id", "kind", "assigner"]  # policy fields that decide nothing
STANDALONE_OPERATORS = ["eq", "neq", "isAnyOf"]
OPEN_REASON = "no permission rules declared on any attached policy; open by default"


@dataclass(frozen=True)
class PolicyConfig:
    """`unmappable`: skip_constraint, drop_policy or hide_dataset.
    `no_policy`: open or closed. `strict`: an unmappable policy hides the
    dataset even when an earlier policy allows it. `mode`: `broker`
    (alternative policies in order) or `deny_overrides` (all rules flattened)."""

    action: str = "use"
    unmappable: str = "hide_dataset"
    no_policy: str = "open"
    strict: bool = False
    mode: str = "broker"

    def __post_init__(self) -> None:
        if self.unmappable not in ("skip_constraint", "drop_policy", "hide_dataset"):
            raise ValueError(f"unknown unmappable action {self.unmappable!r}")
        if self.no_policy not in ("open", "closed"):
            raise ValueError(f"unknown no-policy visibility {self.no_policy!r}")
        if self.mode not in ("broker", "deny_overrides"):
            raise ValueError(f"unknown decision mode {self.mode!r}")


@dataclass(frozen=True)
class PolicySets:
    """`members`: (node_id, dataset_id, policy_set). `content`: one
    representative's policy, rule and constraint rows per policy set."""

    members: DataFrame
    content: DataFrame


@dataclass(frozen=True)
class Entitlements:
    """`callers`: (class_key, caller_group), classes whose claims no policy tells
    apart being one group; `groups`: (caller_group, operands, projection);
    `decisions`: (policy_set, operands, projection, visible); `members`: (node_id,
    dataset_id, policy_set)."""

    members: DataFrame
    callers: DataFrame
    groups: DataFrame
    decisions: DataFrame

    @property
    def classes(self) -> DataFrame:
        """(class_key, operands, projection)."""
        return self.groups.join(self.callers, "caller_group").drop("caller_group")

    def expand(self, resources: DataFrame, *key: str) -> DataFrame:
        """(class_key, *key) for resources given with the policy sets that open
        them. Classes come last, so all joins before are per caller group."""
        allowed = self.decisions.filter("visible").select("policy_set", "operands", "projection")
        opened = resources.join(allowed, "policy_set").select(*key, "operands", "projection")
        if resources is not self.members:
            opened = opened.distinct()
        found = opened.join(self.groups, ["operands", "projection"]).select("caller_group", *key)
        if resources is not self.members:
            found = found.distinct()
        return found.join(self.callers.hint("merge"), "caller_group").select("class_key", *key)

    def visible(self) -> DataFrame:
        """(class_key, node_id, dataset_id) of everything each class may see."""
        return self.expand(self.members, *DATASET_KEY)

    def count_by_class(self, *groups: str) -> DataFrame:
        """Visible datasets per class and group, counted per policy set first."""
        sizes = self.members.groupBy(*groups, "policy_set").agg(F.count("*").alias("n"))
        allowed = self.decisions.filter("visible").drop("visible")
        return (
            sizes.join(allowed, "policy_set")
            .groupBy(*groups, "operands", "projection")
            .agg(F.sum("n").alias("n"))
            .join(self.groups, ["operands", "projection"])
            .groupBy("caller_group", *groups)
            .agg(F.sum("n").alias("n_visible"))
            .join(self.callers.hint("merge"), "caller_group")  # as many as classes
            .select("class_key", *groups, "n_visible")
        )


def policy_rows(tables: CatalogTables) -> DataFrame:
    """Policies, rules and constraints as one table of tagged rows."""
    text, number = F.lit(None).cast("string"), F.lit(-1).cast("bigint")
    root = F.array().cast("array<bigint>")
    blank = {
        "rule_kind": F.lit(""), "rule_idx": number, "path": root, "depth": F.lit(0),
        "op": text, "left_operand": text, "operator": text, "right_operand": text,
        "action": text, "assignee": text, "policy_id": text, "kind": text, "assigner": text,
    }

    def rows(df: DataFrame, tag: str) -> DataFrame:
        return df.select(
            *DATASET_KEY,
            F.lit(tag).alias("tag"),
            "policy_idx",
            *[F.col(k) if k in df.columns else v.alias(k) for k, v in blank.items()],
        )

    return (
        rows(tables.policies, "policy")
        .unionByName(rows(tables.rules, "rule"))
        .unionByName(rows(tables.constraints, "constraint"))
    )


def policy_set_keys(rows: DataFrame, with_labels: bool = False) -> DataFrame:
    """(node_id, dataset_id, policy_set) for every dataset that has policies.

    Row digests are folded in two steps, first per block of 32 neighbouring
    positions and then per dataset, so one dataset with very many rules or
    constraints spreads over tasks. Labels do not change a decision and are
    part of the key only `with_labels`.
    """
    place = F.concat(F.array("policy_idx", "rule_idx"), F.col("path"))
    step = lambda i: F.shiftright(F.greatest(i, F.lit(0)), 5).cast("string")
    block = F.when(F.array_max(place) < 32, F.lit("0")).otherwise(
        F.regexp_replace(F.array_join(F.transform(place, step), "/"), "(/0)+$", "")
    )
    hashed = [
        c for c in rows.columns
        if c not in DATASET_KEY and (with_labels or c not in LABELS)
    ]
    fold = F.sha2(F.array_join(F.sort_array(F.collect_list("digest")), ""), 256)
    return (
        rows.select(
            *DATASET_KEY,
            F.sha2(F.to_json(F.struct(*hashed)), 256).alias("digest"),
            block.alias("block"),
        )
        .groupBy(*DATASET_KEY, "block")
        .agg(fold.alias("digest"))
        .groupBy(*DATASET_KEY)
        .agg(fold.alias("policy_set"))
    )


def policy_sets(tables: CatalogTables, with_labels: bool = False) -> PolicySets:
    """Reduce every dataset's policies to a content key."""
    rows = policy_rows(tables)
    members = cut(
        tables.datasets.select(*DATASET_KEY)
        .join(policy_set_keys(rows, with_labels).hint("merge"), DATASET_KEY, "left")  # as long as datasets
        .select(*DATASET_KEY, F.coalesce("policy_set", F.lit(NO_POLICIES)).alias("policy_set"))
    )
    chosen = cut(  # few, and seen to be few by the planner
        members.filter(F.col("policy_set") != NO_POLICIES)
        .groupBy("policy_set")
        .agg(F.min(F.struct(*DATASET_KEY)).alias("chosen"))
        .select("policy_set", "chosen.*")
    )
    return PolicySets(members, cut(rows.join(chosen, DATASET_KEY).drop(*DATASET_KEY)))


def _map_content(sets: PolicySets, cfg: PolicyConfig) -> DataFrame:
    """Content rows with `operand`, `name` (the bare operator) and `unmappable`."""
    rows = sets.content
    constraint = F.col("tag") == "constraint"
    if cfg.mode == "deny_overrides":
        # The standalone function reads names exactly as written, and a group
        # is one constraint it cannot evaluate.
        rows = rows.filter("depth = 0").withColumn("op", F.when(constraint, F.lit("atomic")))
        name = F.when(F.col("operator").isin(STANDALONE_OPERATORS), F.col("operator"))
        operand = F.col("left_operand")
        unmappable = F.lit(False)
    else:
        name = odrl.operator_name(F.col("operator"))
        operand = odrl.operand_name(F.col("left_operand"))
        unmappable = constraint & (
            (F.col("depth") > MAX_CONSTRAINT_DEPTH) | ((F.col("op") == "atomic") & name.isNull())
        )
    mapped = rows.select(
        "policy_set", "tag", *RULE, "path", "depth", "op",
        operand.alias("operand"), name.alias("name"), "right_operand",
        "action", "assignee", unmappable.alias("unmappable"),
    )
    if cfg.unmappable == "skip_constraint":
        mapped = mapped.filter(~F.col("unmappable"))
    return mapped


def _held(classes: DataFrame, content: DataFrame, asked: DataFrame) -> DataFrame:
    """(class_key, operand, values): the claims that some policy asks for. Where
    policies only name assignees, a caller's `sub` values matter as far as they
    are among these."""
    held = classes.select("class_key", F.explode("claims").alias("operand", "values")).join(
        asked.select("operand").distinct(), "operand", "left_semi"
    )
    if not content.filter("operand = 'sub'").isEmpty():
        return held
    named = content.filter("assignee is not null").select(F.col("assignee").alias("sub")).distinct()
    subs = (
        held.filter("operand = 'sub'")
        .select("class_key", "operand", F.explode("values").alias("sub"))
        .join(named, "sub", "left_semi")
        .groupBy("class_key", "operand")
        .agg(F.array_sort(F.collect_set("sub")).alias("values"))
    )
    return held.filter("operand <> 'sub'").unionByName(subs.select(*held.columns))


def _project(classes: DataFrame, content: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """-> (policy_set, operands), (class_key, caller_group) and (caller_group,
    operands, projection, known).

    `operands` are the claim names a policy set asks for and some class holds.
    Groups meet operand lists by equality of operands; every list also has a
    blank one that every group holds, which gives the empty projections.
    """
    asks = F.when(F.col("name").isNotNull(), F.col("operand")).when(
        F.col("assignee").isNotNull(), F.lit("sub")
    )
    asked = content.select("policy_set", asks.alias("operand")).distinct()
    known = classes.select(F.explode(F.map_keys("claims")).alias("operand")).distinct()
    per_set = cut(
        asked.join(known.withColumn("held", F.lit(True)), "operand", "left")
        .groupBy("policy_set")
        .agg(F.array_sort(F.collect_set(F.when(F.col("held"), F.col("operand")))).alias("names"))
    )
    claim = F.struct(F.col("operand").alias("key"), F.col("values").alias("value"))
    kept = _held(classes, content, asked).groupBy("class_key").agg(
        F.array_sort(F.collect_list(claim)).alias("kept")
    )
    none = F.array().cast("array<struct<key:string,value:array<string>>>")
    grouped = cut(
        classes.select("class_key")
        .join(kept.hint("merge"), "class_key", "left")  # as many as classes
        .withColumn("kept", F.coalesce("kept", none))
        .withColumn("caller_group", F.sha2(F.to_json("kept"), 256))
    )
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blank = F.array(F.struct(F.lit(None).cast("string").alias("key"), F.lit(None).cast("array<string>").alias("value")))
    groups = (
        grouped.groupBy("caller_group").agg(F.first("kept").alias("kept"))
        .select(
            "caller_group", F.pmod(F.xxhash64("caller_group"), F.lit(parts)).alias("part"),
            F.explode(F.concat("kept", blank)).alias("claim"),
        )
    )
    empty = classes.sparkSession.range(1).select(F.array().cast("array<string>").alias("names"))
    lists = per_set.select("names").unionByName(empty).distinct()  # empty: datasets without policies
    lists = lists.select(
        F.to_json("names").alias("operands"),
        F.explode(F.concat("names", F.array(F.lit(None).cast("string")))).alias("name"),
    ).withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint"))))
    met = F.array_sort(F.collect_list(F.when(F.col("name").isNotNull(), F.col("claim"))))
    projected = (
        groups.join(
            lists.withColumnRenamed("part", "spread"),
            F.col("claim.key").eqNullSafe(F.col("name")) & (F.col("part") == F.col("spread")),
        )
        .groupBy("caller_group", "operands")
        .agg(met.alias("kept"))
        .select(
            "caller_group", "operands", F.to_json("kept").alias("projection"),
            F.map_from_entries("kept").alias("known"),
        )
    )
    return (
        per_set.select("policy_set", F.to_json("names").alias("operands")),
        grouped.select("class_key", "caller_group"),
        cut(projected),
    )


def _pairs(per_set: DataFrame, projections: DataFrame) -> DataFrame:
    """(policy_set, operands, projection, known): what must be decided. One operand
    list that many policy sets and projections share is a skewed join, which
    adaptive execution splits."""
    distinct = projections.groupBy("operands", "projection").agg(F.first("known").alias("known"))
    return per_set.join(distinct, "operands").select(*PAIR, "known")


def _group_value(op: Column, n_true: Column, n_false: Column, n_null: Column) -> Column:
    unknown = F.lit(None).cast("boolean")
    return (
        F.when(
            op.isin("and", "andSequence"),
            F.when(n_false > 0, F.lit(False)).when(n_null > 0, unknown).otherwise(F.lit(True)),
        )
        .when(
            op == "or",
            F.when(n_true > 0, F.lit(True)).when(n_null > 0, unknown).otherwise(F.lit(False)),
        )
        .when(
            op == "xone",
            F.when(n_true > 1, F.lit(False)).when(n_null > 0, unknown).otherwise(n_true == 1),
        )
    )


def _evaluate(content: DataFrame, pairs: DataFrame) -> DataFrame:
    """Content rows joined with the pairs that need them, each with `value`:
    a constraint's three-valued outcome, a policy's assignee scope."""
    claim = lambda name: F.try_element_at("known", name)
    value = (
        F.when(
            F.col("op") == "atomic",
            odrl.compare(claim(F.col("operand")), F.col("name"), F.col("right_operand")),
        )
        .when(F.col("tag") == "constraint", _group_value(F.col("op"), *[F.lit(0)] * 3))
        .when(
            F.col("tag") == "policy",
            F.col("assignee").isNull()
            | F.coalesce(F.array_contains(claim(F.lit("sub")), F.col("assignee")), F.lit(False)),
        )
    )
    return content.join(pairs, "policy_set").select(
        *PAIR, *RULE, "tag", "path", "depth", "op", "action", "unmappable", value.alias("value")
    )


def _fold_groups(rows: DataFrame, depth: int) -> DataFrame:
    """Fold logical groups bottom-up, one aggregation per level of the data.
    Rows of a level are grouped onto their parent, all others onto themselves."""
    keys = [*PAIR, *RULE, "tag"]
    for level in range(depth, 0, -1):
        child = F.col("depth") == level
        value = F.when(child, F.col("value"))
        target = F.when(child, F.slice("path", 1, F.size("path") - 1)).otherwise(F.col("path"))
        rows = (
            rows.withColumn("path", target)
            .groupBy(*keys, "path")
            .agg(
                F.min("depth").alias("depth"),
                F.max(F.when(~child, F.col("op"))).alias("op"),
                F.max("action").alias("action"),
                F.bool_or("unmappable").alias("unmappable"),
                F.max(F.when(~child, F.col("value"))).alias("own"),
                F.count_if(child & value).alias("n_true"),
                F.count_if(child & ~value).alias("n_false"),
                F.count_if(child & value.isNull()).alias("n_null"),
            )
            .withColumn(
                "value",
                F.when(
                    (F.col("tag") == "constraint") & (F.col("op") != "atomic"),
                    _group_value(
                        F.col("op"), F.col("n_true"), F.col("n_false"), F.col("n_null")
                    ),
                ).otherwise(F.col("own")),
            )
            .drop("own", "n_true", "n_false", "n_null")
        )
        if (depth - level) % 8 == 7:
            rows = cut(rows)
    return rows


def _rules(content: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per pair and rule (and one row per policy itself): `value` is true for a
    match, false for a miss, null when it cannot be evaluated."""
    depth = min(content.agg(F.max("depth")).first()[0] or 0, MAX_CONSTRAINT_DEPTH + 1)
    rows = _fold_groups(_evaluate(content, pairs), depth)
    own = F.col("tag") == "constraint"
    n_false = F.count_if(own & ~F.col("value"))
    n_null = F.count_if(own & F.col("value").isNull())
    return rows.groupBy(*PAIR, *RULE).agg(
        F.max("action").alias("action"),
        F.bool_or("unmappable").alias("unmappable"),
        F.max(F.when(F.col("tag") == "policy", F.col("value"))).alias("scoped"),
        F.when(n_false > 0, F.lit(False))
        .when(n_null > 0, F.lit(None).cast("boolean"))
        .otherwise(F.lit(True))
        .alias("value"),
    )


def _broker(rules: DataFrame, cfg: PolicyConfig) -> DataFrame:
    """Alternative policies in order; obligations never decide."""
    covers = odrl.normalize_action(F.col("action")) == odrl.normalize_action(F.lit(cfg.action))
    permission = F.col("rule_kind") == "permission"
    prohibits = (F.col("rule_kind") == "prohibition") & covers & F.coalesce("value", F.lit(True))
    permits = permission & covers & F.coalesce("value", F.lit(False))
    false, index = F.lit(False), F.col("policy_idx")
    policies = rules.groupBy(*PAIR, "policy_idx").agg(
        F.max("scoped").alias("scoped"),
        F.bool_or("unmappable").alias("bad"),
        (
            ~F.coalesce(F.bool_or(prohibits), false)
            & F.when(F.bool_or(permission), F.coalesce(F.bool_or(permits), false)).otherwise(
                F.lit(cfg.no_policy == "open")
            )
        ).alias("allows"),
    )
    first_allow = F.min(F.when(F.col("scoped") & F.col("allows") & ~F.col("bad"), index))
    first_bad = F.min(F.when(F.col("bad"), index))
    visible = first_allow.isNotNull()
    if cfg.unmappable == "hide_dataset":
        hidden = first_bad.isNotNull() if cfg.strict else first_bad < first_allow
        visible = visible & ~F.coalesce(hidden, false)
    return policies.groupBy(*PAIR).agg(visible.alias("visible"))


def _describe(content: DataFrame) -> DataFrame:
    """Each rule's label and trace: its constraints in order, or `unconditional`."""
    text = F.concat_ws(" ", "left_operand", "operator", "right_operand")
    step = F.when(F.col("tag") == "constraint", F.struct("path", text.alias("text")))
    steps = F.transform(F.array_sort(F.collect_list(step)), lambda e: e["text"])
    labels = content.filter("tag = 'policy'").select("policy_set", "policy_idx", "policy_id")
    return (
        content.filter("tag <> 'policy' and depth = 0")
        .groupBy("policy_set", *RULE)
        .agg(steps.alias("steps"))
        .join(labels, ["policy_set", "policy_idx"])
        .select(
            "policy_set",
            *RULE,
            F.coalesce("policy_id", F.lit("<unnamed>")).alias("label"),
            F.when(F.size("steps") == 0, "unconditional")
            .otherwise(F.array_join("steps", " and "))
            .alias("trace"),
        )
    )


def _deny_overrides(rules: DataFrame, content: DataFrame) -> DataFrame:
    """All rules of all policies flattened; the first deciding rule is named."""
    value, kind = F.col("value"), F.col("rule_kind")
    place = F.struct(*RULE, value.isNull().alias("unsure"))
    denies = (kind == "prohibition") & F.coalesce(value, F.lit(True))
    allows = (kind == "permission") & F.coalesce(value, F.lit(False))
    decided = (
        rules.groupBy(*PAIR)
        .agg(
            F.min(F.when(denies, place)).alias("denied_by"),
            F.bool_or(kind == "permission").alias("any_permission"),
            F.min(F.when(allows, place)).alias("allowed_by"),
        )
        .withColumn("by", F.coalesce("denied_by", "allowed_by"))
        .select("*", *[F.col(f"by.{c}").alias(c) for c in [*RULE, "unsure"]])
    )
    verdict = F.when(F.col("unsure"), "could not be evaluated, failing closed").otherwise("matched")
    named = F.concat(
        F.col("rule_kind"), F.lit("["), F.col("rule_idx").cast("string"), F.lit("] of policy '"),
        F.col("label"), F.lit("' "), verdict, F.lit(": "), F.col("trace"),
    )
    denied, decides = F.col("denied_by").isNotNull(), F.col("by").isNotNull()
    reason = (
        F.when(denied, named)
        .when(~F.col("any_permission"), F.lit(OPEN_REASON))
        .when(decides, named)
        .otherwise(F.lit("permission rules exist but none matched the caller's claims"))
    )
    allowed = ~denied & (~F.col("any_permission") | decides)
    return decided.join(_describe(content), ["policy_set", *RULE], "left").select(
        *PAIR, allowed.alias("visible"), reason.alias("reason")
    )


def entitle(
    tables: CatalogTables, classes: DataFrame, cfg: PolicyConfig = PolicyConfig()
) -> Entitlements:
    """Decide which datasets each class of caller may see.

    `classes`: (class_key, claims MAP<STRING, ARRAY<STRING>>), one row per class.
    """
    standalone = cfg.mode == "deny_overrides"
    sets = policy_sets(tables, with_labels=standalone)
    content = _map_content(sets, cfg)
    per_set, callers, projections = _project(classes, content)
    rules = _rules(content, _pairs(per_set, projections))
    decisions = _deny_overrides(rules, sets.content) if standalone else _broker(rules, cfg)

    open_ = standalone or cfg.no_policy == "open"
    bare = F.array(
        *[
            F.struct(
                F.lit(name).alias("policy_set"),
                F.lit("[]").alias("operands"),
                F.lit("[]").alias("projection"),
                F.lit(seen).alias("visible"),
                F.lit(OPEN_REASON).alias("reason"),
            )
            for name, seen in ((NO_POLICIES, open_), (ALWAYS, True))
        ]
    )
    none = projections.sparkSession.range(1).select(F.inline(bare))
    return Entitlements(
        members=sets.members,
        callers=callers,
        groups=projections.drop("known"),
        decisions=decisions.unionByName(none.select(decisions.columns)),
    )

