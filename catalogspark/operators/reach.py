"""Reachability over directed edges as labels instead of pairs.

Nodes that reach each other are one component. The components form an acyclic
graph; a spanning forest numbers them so that the components below one are a span
of places, and what other edges add is carried upwards as further spans. A node
reaches the nodes whose component's place is in a span of its own component: a
table of members, one of places and one of spans, instead of all pairs.

Rounds go on until nothing changes, each over tables written to the shared folder;
none looks at single nodes. These tables are short as files and long as rows, so they
are joined by merges, never broadcast. Trimming, colours and levels take about as many rounds
as the longest path between components has steps.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogspark.session import cut

#: Rounds that peel off nodes without a way in or out, before components are searched.
PEELS = 8


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def running(df: DataFrame, value: str, *order: str) -> DataFrame:
    """`df` with `before`, the sum of `value` over all rows before it in the order.
    Ranges are added up each for itself; a number a range reaches the driver."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = cut(placed.withColumn("_part", F.shiftright("_at", 33)))
    total, bases = 0, []
    for row in placed.groupBy("_part").agg(F.sum(value).alias("n")).orderBy("_part").collect():
        bases.append((row["_part"], total))
        total += row.n
    base = spark.createDataFrame(bases, "_part long, _base long")
    own = F.expr(f"sum(`{value}`) over (partition by _part order by _at rows between unbounded preceding and current row)")
    summed = placed.withColumn("_sum", own).join(F.broadcast(base), "_part")  # as many rows as ranges
    return summed.withColumn("before", (F.col("_base") + F.col("_sum") - F.col(value)).cast("long")).drop(
        "_at", "_part", "_sum", "_base"
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes that lie on a cycle of `edges` (a, b) with
    another node; component is the smallest node of those that reach each other.

    Colours spread forwards until each node has the smallest node that reaches it;
    those of a colour that reach its own node backwards are a component and leave.
    """
    live = cut(edges.filter("a <> b").distinct())
    found, left = [], live.count()
    while left:
        for _ in range(PEELS):
            ins, outs = live.select(F.col("b").alias("a")).distinct(), live.select(F.col("a").alias("b")).distinct()
            live = cut(live.join(ins.hint("merge"), "a", "left_semi").join(outs.hint("merge"), "b", "left_semi").select("a", "b"))
            before, left = left, live.count()
            if left == before or not left:
                break
        if not left:
            break
        color = live.select(F.col("a").alias("node")).union(live.select("b")).distinct().withColumn("color", F.col("node"))
        color = fresh = cut(color)
        while not fresh.isEmpty():
            step = live.join(fresh.withColumnRenamed("node", "a").hint("merge"), "a").groupBy(F.col("b").alias("node")).agg(F.min("color").alias("new"))
            moved = cut(color.join(step.hint("merge"), "node", "left").withColumn("fresh", F.coalesce(F.col("new") < F.col("color"), F.lit(False))).select(
                "node", F.when(F.col("fresh"), F.col("new")).otherwise(F.col("color")).alias("color"), "fresh"
            ))
            color, fresh = moved.select("node", "color"), moved.filter("fresh").select("node", "color")
        inner = (
            live.join(color.select(F.col("node").alias("a"), F.col("color").alias("ca")).hint("merge"), "a")
            .join(color.select(F.col("node").alias("b"), F.col("color").alias("cb")).hint("merge"), "b").filter("ca = cb")
        )
        inner = cut(inner.select("a", "b"))
        front = cut(color.filter("node = color"))
        parts = [front]
        while not front.isEmpty():
            step = inner.join(front.withColumnRenamed("node", "b").hint("merge"), "b").select(F.col("a").alias("node"), "color").distinct()
            for part in parts:
                step = step.join(part.hint("merge"), "node", "left_anti")
            front = cut(step)
            parts.append(front)
            if len(parts) > 6:
                parts = [cut(_union(parts))]
        own = cut(_union(parts))
        found.append(own.withColumnRenamed("color", "component"))
        gone = own.select("node")
        live = cut(
            live.join(gone.withColumnRenamed("node", "a").hint("merge"), "a", "left_anti")
            .join(gone.withColumnRenamed("node", "b").hint("merge"), "b", "left_anti").select("a", "b")
        )
        left = live.count()
    if not found:
        return edges.sparkSession.createDataFrame([], "node long, component long")
    named = _union(found)
    # a component of one node isn't on a cycle
    several = named.groupBy("component").agg(F.min("node").alias("least"), F.count("*").alias("n")).filter("n > 1")
    return cut(named.join(several.hint("merge"), "component").select("node", F.col("least").alias("component")))


@dataclass(frozen=True)
class Reach:
    """members (node, component, cyclic): every node, its component, and whether it
    reaches itself; places (component, place): a number from 0 each; spans
    (component, low, high): the places a component reaches, its own among them, in
    spans that don't overlap."""

    members: DataFrame
    places: DataFrame
    spans: DataFrame

    def counts(self, zero: bool = True) -> DataFrame:
        """(node, n): how many nodes each node reaches, found by the sums of members
        before the ends of its spans. `zero`: by no step, too."""
        size = self.members.groupBy("component").agg(F.count("*").alias("size"))
        sums = cut(running(self.places.join(size.hint("merge"), "component").select("place", "size"), "size", "place"))
        low = sums.select(F.col("place").alias("low"), F.col("before").alias("from"))
        high = sums.select(F.col("place").alias("high"), (F.col("before") + F.col("size")).alias("to"))
        reached = self.spans.join(low.hint("merge"), "low").join(high.hint("merge"), "high").groupBy("component").agg(F.sum(F.col("to") - F.col("from")).alias("n"))
        n = F.col("n") if zero else F.when(F.col("cyclic"), F.col("n")).otherwise(F.col("n") - 1)
        return self.members.join(reached.hint("merge"), "component").select("node", n.cast("long").alias("n"))

    def reaches(self, pairs: DataFrame, zero: bool = True) -> DataFrame:
        """Those of the pairs (a, b) of which a reaches b."""
        a = self.members.select(F.col("node").alias("a"), F.col("component").alias("_ca"), "cyclic")
        b = self.members.join(self.places, "component").select(F.col("node").alias("b"), "place")
        met = pairs.join(a, "a").join(b, "b").join(self.spans, F.col("_ca") == F.col("component"))
        met = met.filter(F.col("place").between(F.col("low"), F.col("high")))
        if not zero:
            met = met.filter((F.col("a") != F.col("b")) | F.col("cyclic"))
        return met.select(*pairs.columns)

    def pairs(self, zero: bool = True, starts: DataFrame | None = None) -> DataFrame:
        """(a, b) for all that reach each other: as many rows as there are pairs.
        `starts` (node) limits a."""
        members = self.members if starts is None else self.members.join(starts.select("node").distinct(), "node", "left_semi")
        spelled = self.spans.join(members.select("component").distinct(), "component", "left_semi")
        spelled = spelled.select("component", F.explode(F.sequence("low", "high")).alias("place"))
        ends = self.places.join(self.members, "component").select("place", F.col("node").alias("b"))
        own = members.select(F.col("node").alias("a"), "component", "cyclic")
        out = own.join(spelled, "component").join(ends, "place")
        if not zero:
            out = out.filter((F.col("a") != F.col("b")) | F.col("cyclic"))
        return out.select("a", "b")

    def least_members(self) -> DataFrame:
        """(node, least): nodes that reach each other share the smallest of them."""
        least = self.members.groupBy("component").agg(F.min("node").alias("least"))
        return self.members.join(least, "component").select("node", "least")


def _hash(node: Column) -> Column:
    return F.xxhash64(node)


def _ids(edges: DataFrame, nodes: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """-> (node, id) of all nodes, and the edges between ids. A node's id is its hash;
    where any two nodes share one, all are numbered instead and joined to the edges."""
    held = F.col("a").isNotNull() & F.col("b").isNotNull()
    edges = cut(edges.select("a", "b").filter(held).withColumns({"ia": _hash(F.col("a")), "ib": _hash(F.col("b"))}), "zstd")
    ends = edges.select(F.col("a").alias("node"), F.col("ia").alias("id")).union(edges.select("b", "ib"))
    if nodes is not None:
        ends = ends.union(nodes.filter(F.col("node").isNotNull()).select("node", _hash(F.col("node"))))
    named = cut(ends.distinct(), "zstd")
    if named.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        return named, cut(edges.select(F.col("ia").alias("a"), F.col("ib").alias("b")).distinct())
    named = cut(named.select("node").withColumn("id", F.monotonically_increasing_id()))
    short = (
        edges.select("a", "b").distinct()
        .join(named.select(F.col("node").alias("a"), F.col("id").alias("ia")), "a")
        .join(named.select(F.col("node").alias("b"), F.col("id").alias("ib")), "b")
    )
    return named, cut(short.select(F.col("ia").alias("a"), F.col("ib").alias("b")))


def reach(edges: DataFrame, nodes: DataFrame | None = None) -> Reach:
    """Labels of the edges (a, b), of any one type that can be ordered. `nodes`
    (node) may add some without edges. Repeated edges are one, null ends none."""
    named, short = _ids(edges, nodes)
    joint = components(short).withColumnRenamed("node", "id")
    loops = short.filter("a = b").select(F.col("a").alias("id"), F.lit(True).alias("_loop"))
    if joint.isEmpty() and loops.isEmpty():  # every node is a component
        return _labels(named.select("node", F.col("id").alias("component"), F.lit(False).alias("cyclic")), short)
    members = cut(
        named.join(joint.hint("merge"), "id", "left").join(loops.hint("merge"), "id", "left").select(
            "node", "id", F.coalesce("component", "id").alias("component"),
            (F.col("component").isNotNull() | F.col("_loop").isNotNull()).alias("cyclic"),
        )
    )
    to = members.select("id", "component")
    acyclic = cut(
        short.join(to.select(F.col("id").alias("a"), F.col("component").alias("ca")).hint("merge"), "a")
        .join(to.select(F.col("id").alias("b"), F.col("component").alias("cb")).hint("merge"), "b")
        .filter("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()
    )
    return _labels(members.drop("id"), acyclic)


def _labels(members: DataFrame, acyclic: DataFrame) -> Reach:
    """Labels of the members, with the edges between their components."""
    spans = cut(_numbered(acyclic, members.select("component").distinct()))
    return Reach(members, cut(spans.select("component", F.col("low").alias("place"))), _all_spans(spans, acyclic))


def _numbered(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(component, low, high) of each component in a forest that takes one edge into
    each: its own place and the last one below it."""
    parent = edges.groupBy(F.col("b").alias("component")).agg(F.min("a").alias("parent"))
    tree = cut(nodes.join(parent.hint("merge"), "component", "left"))
    levels = [cut(tree.filter("parent is null").select("component", F.lit(None).cast("long").alias("parent")))]
    while not levels[-1].isEmpty():
        above = levels[-1].select(F.col("component").alias("parent"))
        levels.append(cut(tree.join(above.hint("merge"), "parent").select("component", "parent")))
    levels.pop()
    sizes, below = [], None
    for level in reversed(levels):
        sized = level.withColumn("size", F.lit(1).cast("long"))
        if below is not None:
            sums = below.groupBy(F.col("parent").alias("component")).agg(F.sum("size").alias("more"))
            sized = level.join(sums.hint("merge"), "component", "left").select(
                "component", "parent", (F.lit(1) + F.coalesce("more", F.lit(0))).cast("long").alias("size")
            )
        below = cut(sized)
        sizes.append(below)
    if not sizes:
        return nodes.select("component", F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("high")).limit(0)
    # siblings stand one behind the other: places before a node, less those before its first sibling
    order = running(_union(sizes).withColumn("_root", F.col("parent").isNotNull()), "size", "_root", "parent", "component")
    order = cut(order.drop("_root"))
    first = order.filter("parent is not null").groupBy("parent").agg(F.min("before").alias("first"))
    shift = order.join(first.hint("merge"), "parent", "left").select("component", "parent", "size", "before", "first")
    shift = cut(shift)
    done = [cut(shift.filter("parent is null").select("component", "size", F.col("before").alias("low")))]
    for _ in levels[1:]:
        above = done[-1].select(F.col("component").alias("parent"), F.col("low").alias("base"))
        done.append(cut(shift.join(above.hint("merge"), "parent").select(
            "component", "size", (F.col("base") + 1 + F.col("before") - F.col("first")).alias("low")
        )))
    return _union(done).select("component", "low", (F.col("low") + F.col("size") - 1).alias("high"))


def _within(alias: str) -> Column:
    return (F.col(f"{alias}.low") <= F.col("n.low")) & (F.col(f"{alias}.high") >= F.col("n.high"))


def _all_spans(own: DataFrame, edges: DataFrame) -> DataFrame:
    """The forest's spans and those that edges outside the forest bring, carried
    against the edges until none is new. Spans hold each other or are apart."""
    parts, fresh = [own], own
    while True:
        carried = edges.join(fresh.withColumnRenamed("component", "b").hint("merge"), "b").select(F.col("a").alias("component"), "low", "high").distinct()
        for part in parts:
            met = (F.col("n.component") == F.col("p.component")) & _within("p")
            carried = carried.alias("n").join(part.hint("merge").alias("p"), met, "left_anti")
        fresh = cut(carried.select("component", "low", "high"))
        if fresh.isEmpty():
            break
        parts.append(fresh)
        if len(parts) > 6:
            parts = [cut(_union(parts))]
    if parts == [own]:
        return own
    reached = F.expr("max(high) over (partition by component order by low, high desc rows between unbounded preceding and 1 preceding)")
    return cut(
        _union(parts).distinct().withColumn("_reached", reached)
        .filter("_reached is null or _reached < high").select("component", "low", "high")
    )
