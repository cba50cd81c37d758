"""Graph patterns over quads: each step returns a DataFrame of solutions.

A variable is a column holding a term struct (value, kind, datatype, lang); an
unbound variable is null. Names written '?x' are variables, other strings IRIs,
`text()` makes literals.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogspark.operators.bgp import solve
from catalogspark.operators.paging import behind
from catalogspark.operators.reach import Reach, reach
from catalogspark.schema import DCAT, RDF_TYPE, XSD_INTEGER, XSD_STRING
from catalogspark.session import cut
from catalogspark.sources.quads import predicate_part

TERM = "struct<value:string,kind:string,datatype:string,lang:string>"
XSD_DOUBLE = "http://www.w3.org/2001/XMLSchema#double"
XSD_FLOAT = "http://www.w3.org/2001/XMLSchema#float"
XSD_DECIMAL = "http://www.w3.org/2001/XMLSchema#decimal"
NUMERIC = [
    f"http://www.w3.org/2001/XMLSchema#{t}"
    for t in ("integer", "decimal", "double", "float", "int", "long")
]

#: More solutions than this are never broadcast where they are counted.
LONG = 100_000


class TooManyRows(ValueError):
    """A result larger than its row cap; results are never cut silently."""


class UnboundedProduct(ValueError):
    """Two patterns that share no variable, neither being inline values."""


@dataclass(frozen=True)
class Literal:
    value: str
    datatype: str = XSD_STRING
    lang: str = ""


def text(value: str, datatype: str = XSD_STRING, lang: str = "") -> Literal:
    return Literal(value, datatype, lang)


def iri_term(value: Column) -> Column:
    return F.struct(
        value.alias("value"), F.lit("iri").alias("kind"), F.lit("").alias("datatype"),
        F.lit("").alias("lang"),
    )


def literal_term(value: Column, datatype: str = XSD_STRING) -> Column:
    """A computed literal; no value leaves the variable unbound."""
    term = F.struct(
        value.cast("string").alias("value"), F.lit("literal").alias("kind"),
        F.lit(datatype).alias("datatype"), F.lit("").alias("lang"),
    )
    return F.when(value.isNotNull(), term)


def constant(term: str | Literal) -> Column:
    if isinstance(term, Literal):
        return F.struct(
            F.lit(term.value).alias("value"), F.lit("literal").alias("kind"),
            F.lit(term.datatype).alias("datatype"), F.lit(term.lang).alias("lang"),
        )
    return iri_term(F.lit(term))


def _is_var(term) -> bool:
    return isinstance(term, str) and term.startswith("?")


# Scalar functions over a variable; an error is null, and null fails a filter.


def str_(var: str) -> Column:
    return F.col(f"`{var}`.value")


def number(var: str) -> Column:
    """The value of a numeric literal; anything else is an error."""
    return F.when(
        F.col(f"`{var}`.datatype").isin(NUMERIC), F.col(f"`{var}`.value").try_cast("double")
    )


def as_number(var: str) -> Column:
    """xsd:double(?var): also reads plain literals."""
    literal = F.col(f"`{var}`.kind") == "literal"
    return F.when(literal, F.col(f"`{var}`.value").try_cast("double"))


def order_key(var: str) -> Column:
    """SPARQL order: unbound, IRIs, numbers by value, other literals by text."""
    return F.when(
        F.col(var).isNotNull(),
        F.struct(
            F.col(f"`{var}`.kind").alias("kind"),
            number(var).isNull().alias("plain"),
            number(var).alias("number"),
            str_(var).alias("text"),
        ),
    )


def lang(var: str) -> Column:
    return F.when(F.col(f"`{var}`.kind") == "literal", F.col(f"`{var}`.lang"))


def datatype(var: str) -> Column:
    return F.when(F.col(f"`{var}`.kind") == "literal", F.col(f"`{var}`.datatype"))


def is_iri(var: str) -> Column:
    return F.col(f"`{var}`.kind") == "iri"


def is_literal(var: str) -> Column:
    return F.col(f"`{var}`.kind") == "literal"


def bound(var: str) -> Column:
    return F.col(var).isNotNull()


def str_starts(var: str, prefix: str) -> Column:
    return F.startswith(str_(var), F.lit(prefix))


def contains(var: str, part: str) -> Column:
    return F.contains(str_(var), F.lit(part))


def regex(var: str, pattern: str, flags: str = "") -> Column:
    if set(flags) - set("ismx"):
        raise ValueError(f"unknown regular expression flags {flags!r}")
    marks = flags
    return F.when(is_literal(var), str_(var).rlike(f"(?{marks}){pattern}" if marks else pattern))


def is_in(var: str, *terms: str | Literal) -> Column:
    """Term equality as written, with no numeric canonicalisation."""
    return reduce(lambda a, b: a | b, [F.col(var) == constant(t) for t in terms])


def same_term(a: str, b: str | Literal) -> Column:
    return F.col(a) == (F.col(b[1:]) if _is_var(b) else constant(b))


@dataclass(frozen=True)
class Solutions:
    """`df` has one column per variable; `maybe` lists those that may be unbound;
    `inline` rows are written out in the query; `order` is how they are sorted."""

    df: DataFrame
    maybe: frozenset[str] = field(default_factory=frozenset)
    inline: bool = False
    order: tuple[Column, ...] = ()

    @property
    def vars(self) -> list[str]:
        return list(self.df.columns)

    # Joins ---------------------------------------------------------------

    def _shared(self, other: Solutions) -> list[str]:
        return [v for v in self.vars if v in other.vars]

    def _split(self, shared: list[str]) -> list[tuple[list[str], DataFrame]]:
        """(bound variables, rows) for each way the shared variables are bound that
        occurs, so that compatibility is an equality again. Rows whose shared
        variables may be unbound are written once, with a mask of those bound. Long
        ones are not broadcast, however small their columns are as files."""
        loose = [v for v in shared if v in self.maybe]
        if not loose:
            return [(shared, self.df)]
        mask = reduce(lambda a, b: a + b, [F.when(F.col(v).isNotNull(), 1 << i).otherwise(0) for i, v in enumerate(loose)])
        written = cut(self.df.withColumn("_mask", mask))
        found = sorted(tuple(row) for row in written.groupBy("_mask").count().collect()) or [(0, 0)]

        def rows(mask: int, n: int) -> DataFrame:
            held = written.filter(F.col("_mask") == mask).drop("_mask")
            return held.hint("merge") if n > LONG else held

        return [([v for v in shared if v not in loose or m >> loose.index(v) & 1], rows(m, n)) for m, n in found]

    def join(self, other: Solutions) -> Solutions:
        """Every pair of compatible solutions. Patterns that share no variable are
        refused, whatever their sizes, unless one side is inline values. Where
        they share variables, solutions that leave all of them unbound are
        compatible with everything; such rows meet in salted parts. There are as
        many joins as pairs of masks that occur."""
        shared = self._shared(other)
        return self._joined(other, self._split(shared), other._split(shared))

    def _joined(self, other: Solutions, mine: list, theirs: list) -> Solutions:
        shared = self._shared(other)
        if not shared and not (self.inline or other.inline):
            raise UnboundedProduct("the patterns share no variable; bind one side first")
        maybe = (self.maybe | other.maybe) - {
            v for v in shared if v not in self.maybe or v not in other.maybe
        }
        parts = []
        for left_bound, left in mine:
            for right_bound, right in theirs:
                on = [v for v in left_bound if v in right_bound]
                # A variable only one side binds comes from that side.
                left_ = left.drop(*[v for v in shared if v not in left_bound])
                right_ = right.drop(*[v for v in shared if v in left_bound and v not in on])
                right_ = right_.drop(*[v for v in shared if v not in left_bound and v not in right_bound])
                out = left_.join(right_, on) if on else _product(left_, right_)
                parts.append(out)
        df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        names = self.vars + [v for v in other.vars if v not in shared]
        missing = [v for v in names if v not in df.columns]  # bound in no part
        df = df.withColumns({v: F.lit(None).cast(TERM) for v in missing}) if missing else df
        return Solutions(df.select(names), maybe)

    def _met(self, other: Solutions, condition: Column) -> tuple[Solutions, DataFrame]:
        """The solutions numbered, and the compatible pairs that fulfil a condition
        over the variables of both sides, unbound ones among them."""
        named = Solutions(cut(self.df.withColumn("_id", F.monotonically_increasing_id())), self.maybe)
        return named, named.join(other).df.filter(condition)

    def optional(self, other: Solutions, condition: Column | None = None) -> Solutions:
        """`condition` is a filter inside the optional group."""
        shared = self._shared(other)
        if condition is not None:
            named, met = self._met(other, condition)
            missed = named.df.join(met.select("_id").distinct(), "_id", "left_anti")
            df = met.unionByName(missed, allowMissingColumns=True).drop("_id")
            return Solutions(df, self.maybe | other.maybe | set(other.vars) - set(shared))
        added = [v for v in other.vars if v not in shared]
        simple = shared and not any(v in self.maybe or v in other.maybe for v in shared)
        if simple:
            df = self.df.join(other.df, shared, "left").select(self.vars + added)
        else:
            mine, theirs = self._split(shared), other._split(shared)
            unmatched = self._without(other, True, mine, theirs)
            df = self._joined(other, mine, theirs).df.unionByName(unmatched, allowMissingColumns=True)
        return Solutions(df, self.maybe | other.maybe | set(added))

    def _without(self, other: Solutions, disjoint_matches: bool, mine=None, theirs=None) -> DataFrame:
        """Solutions with no compatible one in `other`. Sides that bind no
        variable in common match only if `disjoint_matches`."""
        shared = self._shared(other)
        theirs = other._split(shared) if theirs is None else theirs
        parts = []
        for ours, left in self._split(shared) if mine is None else mine:
            for bound_, right in theirs:
                on = [v for v in ours if v in bound_]
                if on:
                    left = left.join(right.select(on).distinct(), on, "left_anti")
                elif disjoint_matches and not right.isEmpty():
                    left = left.limit(0)
            parts.append(left.select(self.vars))
        return reduce(lambda a, b: a.unionByName(b), parts)

    def minus(self, other: Solutions) -> Solutions:
        if not self._shared(other):
            return self
        return Solutions(self._without(other, disjoint_matches=False), self.maybe)

    def exists(self, other: Solutions, condition: Column | None = None) -> Solutions:
        """`condition` is a filter inside the group, over the variables of both."""
        shared = self._shared(other)
        if condition is not None:
            named, met = self._met(other, condition)
            found = named.df.join(met.select("_id").distinct(), "_id", "left_semi")
            return Solutions(found.drop("_id"), self.maybe)
        if not shared:
            return self if not other.df.isEmpty() else Solutions(self.df.limit(0), self.maybe)
        if any(v in self.maybe or v in other.maybe for v in shared):
            keys = Solutions(other.df.select(shared).distinct(), other.maybe & set(shared))
            named = Solutions(
                self.df.withColumn("_id", F.monotonically_increasing_id()), self.maybe
            )
            named = Solutions(cut(named.df), named.maybe)
            hit = named.join(keys).df.select("_id").distinct()
            return Solutions(named.df.join(hit, "_id", "left_semi").drop("_id"), self.maybe)
        return Solutions(
            self.df.join(other.df, shared, "left_semi").select(self.vars), self.maybe
        )

    def not_exists(self, other: Solutions, condition: Column | None = None) -> Solutions:
        if condition is not None:
            named, met = self._met(other, condition)
            lost = named.df.join(met.select("_id").distinct(), "_id", "left_anti")
            return Solutions(lost.drop("_id"), self.maybe)
        return Solutions(self._without(other, disjoint_matches=True), self.maybe)

    def union(self, other: Solutions) -> Solutions:
        one_sided = set(self.vars) ^ set(other.vars)
        df = self.df.unionByName(other.df, allowMissingColumns=True)
        return Solutions(df, self.maybe | other.maybe | one_sided)

    def values(self, names: list[str], rows: list[tuple]) -> Solutions:
        """Join with inline bindings; None is an undefined value."""
        return self.join(inline_values(self.df.sparkSession, names, rows))

    # Rows and columns ----------------------------------------------------

    def filter(self, condition: Column) -> Solutions:
        return Solutions(self.df.filter(condition), self.maybe)

    def bind(self, name: str, term: Column) -> Solutions:
        return Solutions(self.df.withColumn(name, term), self.maybe | {name})

    def select(self, *names: str) -> Solutions:
        return Solutions(self.df.select(*names), self.maybe & set(names))

    def distinct(self) -> Solutions:
        return Solutions(self.df.distinct(), self.maybe)

    def order_by(self, *columns: Column) -> Solutions:
        return Solutions(self.df.orderBy(*columns), self.maybe, order=columns)

    def slice(self, offset: int = 0, limit: int | None = None) -> Solutions:
        if offset and limit is None:
            return Solutions(behind(self.df, offset, *(self.order or self.vars)), self.maybe)
        df = self.df.offset(offset) if offset else self.df
        return Solutions(df if limit is None else df.limit(limit), self.maybe)

    def group_by(self, *names: str, **aggregates: Column) -> Solutions:
        columns = [column.alias(name) for name, column in aggregates.items()]
        df = self.df.groupBy(*names).agg(*columns)
        return Solutions(df, (self.maybe & set(names)) | set(aggregates))

    def ask(self) -> bool:
        return not self.df.isEmpty()

    def capped(self, max_rows: int) -> Solutions:
        """The same solutions, or an error when there are more than `max_rows`."""
        if self.df.limit(max_rows + 1).count() > max_rows:
            raise TooManyRows(f"the query returned more than {max_rows} rows")
        return self

    def values_of(self, *names: str) -> DataFrame:
        """Plain string columns of the variables' lexical values."""
        return self.df.select(*[str_(n).alias(n) for n in names or self.vars])


# Aggregates ----------------------------------------------------------------


def count_all() -> Column:
    return literal_term(F.count(F.lit(1)), XSD_INTEGER)


def count(var: str, distinct: bool = False) -> Column:
    return literal_term(F.count_distinct(var) if distinct else F.count(var), XSD_INTEGER)


def _plain(value: Column) -> Column:
    """A decimal without trailing zeros."""
    return F.regexp_replace(value.cast("decimal(38,18)").cast("string"), r"\.?0+$", "")


def _typed(var: str, decimals: Column, doubles: Column, integers: Column | None) -> Column:
    """An aggregate over numbers in the type SPARQL gives it: integers stay
    integers where `integers` says so, any double makes it a double, and one value
    that is no number an error. Integers and decimals are added exactly."""
    errors = F.count_if(F.col(var).isNotNull() & number(var).isNull())
    kind = F.col(f"`{var}`.datatype")
    floating = F.count_if(kind.isin(XSD_DOUBLE, XSD_FLOAT))
    broken = F.count_if(kind == XSD_DECIMAL)
    zero = literal_term(F.lit("0"), XSD_INTEGER)
    exact = literal_term(_plain(decimals), XSD_DECIMAL)
    if integers is not None:
        exact = F.when(broken == 0, literal_term(integers, XSD_INTEGER)).otherwise(exact)
    return F.when(F.count(var) == 0, zero).when(
        errors == 0, F.when(floating > 0, literal_term(doubles, XSD_DOUBLE)).otherwise(exact)
    )


def _exact(var: str, kind: str) -> Column:
    return F.when(number(var).isNotNull(), F.col(f"`{var}`.value").try_cast(kind))


def sum_(var: str) -> Column:
    return _typed(
        var, F.try_sum(_exact(var, "decimal(38,18)")), F.sum(number(var)),
        F.try_sum(_exact(var, "decimal(38,0)")),
    )


def avg(var: str) -> Column:
    total = F.try_sum(_exact(var, "decimal(38,18)"))
    mean = F.when(F.count(var) > 0, F.try_divide(total, F.count(var).cast("decimal(20,0)")))
    return _typed(var, mean, F.avg(number(var)), None)


def min_(var: str) -> Column:
    return F.min_by(F.col(var), order_key(var))


def max_(var: str) -> Column:
    return F.max_by(F.col(var), order_key(var))


def sample(var: str) -> Column:
    return F.any_value(F.col(var), True)


def group_concat(var: str, separator: str = " ") -> Column:
    return literal_term(F.array_join(F.sort_array(F.collect_list(str_(var))), separator))


# Leaves --------------------------------------------------------------------


def inline_values(spark, names: list[str], rows: list[tuple]) -> Solutions:
    def term(value):
        if value is None:
            return None
        if isinstance(value, Literal):
            return (value.value, "literal", value.datatype, value.lang)
        return (value, "iri", "", "")

    schema = ", ".join(f"`{n}` {TERM}" for n in names)
    df = spark.createDataFrame([tuple(term(v) for v in row) for row in rows], schema)
    maybe = {n for i, n in enumerate(names) if any(row[i] is None for row in rows)}
    return Solutions(df, frozenset(maybe), inline=True)


def _product(left: DataFrame, right: DataFrame) -> DataFrame:
    """All pairs, as an equality of parts: the left rows are dealt out and the
    right ones copied to every part."""
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = left.withColumn("_part", F.pmod(F.xxhash64(*left.columns), F.lit(parts)))
    every = F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint"))
    return dealt.join(right.withColumn("_part", F.explode(every)), "_part").drop("_part")


@dataclass(frozen=True)
class Graph:
    """A queryable set of quads. Without `default` the default graph is the
    union of all graphs; `distinct_triples` when foreign graphs may repeat them.
    `sets` are the stored characteristic sets of the quads, if there are any."""

    quads: DataFrame
    default: tuple[str, ...] | None = None
    named: tuple[str, ...] | None = None
    distinct_triples: bool = False
    sets: DataFrame | None = None

    def over(self, default: list[str] = (), named: list[str] = ()) -> Graph:
        """An explicit dataset: FROM `default`, FROM NAMED `named`."""
        return Graph(self.quads, tuple(default), tuple(named), self.distinct_triples, self.sets)

    def match(self, s, p, o, g=None) -> Solutions:
        """One triple pattern; `g` scopes it to a graph or binds the graph."""
        df = self.quads
        if isinstance(p, str) and not _is_var(p) and "p_part" in df.columns:
            df = df.filter(F.col("p_part") == predicate_part(p))
        if g is None:
            if self.default is not None:
                df = df.filter(F.col("graph").isin(*self.default))
            if self.distinct_triples or (self.default and len(self.default) > 1):
                df = df.dropDuplicates(["s", "p", "o", "o_kind", "o_datatype", "o_lang"])
        elif self.named is not None:
            df = df.filter(F.col("graph").isin(*self.named))
        object_ = F.struct(
            F.col("o").alias("value"), F.col("o_kind").alias("kind"),
            F.col("o_datatype").alias("datatype"), F.col("o_lang").alias("lang"),
        )
        places = [(s, "s"), (p, "p"), (o, "o")] + ([(g, "graph")] if g is not None else [])
        out: dict[str, Column] = {}
        for term, column in places:
            if isinstance(term, Literal):
                if column != "o":
                    return Solutions(df.limit(0).select())
                df = df.filter(
                    (F.col("o_kind") == "literal") & (F.col("o") == term.value)
                    & (F.col("o_datatype") == term.datatype) & (F.col("o_lang") == term.lang)
                )
            elif not _is_var(term):
                df = df.filter(F.col(column) == term)
                if column == "o":
                    df = df.filter(F.col("o_kind") == "iri")
            else:
                value = object_ if column == "o" else iri_term(F.col(column))
                name = term[1:]
                if name in out:
                    df = df.filter(out[name] == value)
                else:
                    out[name] = value
        return Solutions(df.select(*[c.alias(n) for n, c in out.items()]))

    def rows(self, p: str, o: str | Literal | None = None, g: str | None = None) -> DataFrame:
        """The quads of one predicate, of one object if given, in the default graph
        or the graph `g`."""
        df = self.quads
        if "p_part" in df.columns:  # the layout by predicate: read its folder alone
            df = df.filter(F.col("p_part") == predicate_part(p))
        df = df.filter(F.col("p") == p)
        if isinstance(o, Literal):
            df = df.filter(
                (F.col("o_kind") == "literal") & (F.col("o") == o.value)
                & (F.col("o_datatype") == o.datatype) & (F.col("o_lang") == o.lang)
            )
        elif o is not None:
            df = df.filter((F.col("o") == o) & (F.col("o_kind") == "iri"))
        if g is not None:
            if self.named is not None:
                df = df.filter(F.col("graph").isin(*self.named))
            return df.filter(F.col("graph") == g)
        if self.default is not None:
            df = df.filter(F.col("graph").isin(*self.default))
        if self.distinct_triples or (self.default and len(self.default) > 1):
            df = df.dropDuplicates(["s", "p", "o", "o_kind", "o_datatype", "o_lang"])
        return df

    @staticmethod
    def object_term() -> Column:
        return F.struct(
            F.col("o").alias("value"), F.col("o_kind").alias("kind"),
            F.col("o_datatype").alias("datatype"), F.col("o_lang").alias("lang"),
        )

    def patterns(self, *triples: tuple) -> Solutions:
        """A basic graph pattern: the join of its triples on shared variables, the
        triples of one subject as one star, the rarest star first where `sets`
        tells."""

        def refuse():
            raise UnboundedProduct("the patterns share no variable; bind one side first")

        return Solutions(solve(self, triples, iri_term, refuse))

    def graphs(self, var: str = "?g") -> Solutions:
        """The named graphs that hold a catalog."""
        found = self.match("?_s", RDF_TYPE, DCAT + "Catalog", g=var)
        return found.select(var[1:]).distinct()

    # Property paths ------------------------------------------------------

    def _edges(self, path) -> DataFrame:
        """(a, b) terms linked by a path: an IRI, ('^', p), ('|', p, q...),
        ('/', p, q...) or ('?', p)."""
        if isinstance(path, str):
            return self.match("?a", path, "?b").df
        kind, *parts = path
        if kind == "^":
            return self._edges(parts[0]).select(F.col("b").alias("a"), F.col("a").alias("b"))
        if kind == "|":
            plain = list(dict.fromkeys(p for p in parts if isinstance(p, str)))  # from one reading
            found = [self._edges(p) for i, p in enumerate(parts) if p not in plain or p in parts[:i]]
            if plain:
                df = self.quads.filter(F.col("p").isin(plain))
                if "p_part" in df.columns:
                    df = df.filter(F.col("p_part").isin([predicate_part(p) for p in plain]))
                found.append(replace(self, quads=df).match("?a", "?_p", "?b").df.select("a", "b"))
            return reduce(lambda x, y: x.unionByName(y), found)
        if kind == "/":
            out = self._edges(parts[0])
            for part in parts[1:]:
                step = self._edges(part).select(F.col("a").alias("_m"), F.col("b").alias("_e"))
                out = out.withColumnRenamed("b", "_m").join(step, "_m").select(
                    "a", F.col("_e").alias("b")
                )
            return out
        if kind == "?":
            return self._edges(parts[0]).unionByName(self._loops()).distinct()
        raise ValueError(f"unknown path {kind!r}")

    def _loops(self) -> DataFrame:
        """Every node of the graph linked to itself."""
        subjects = self.match("?a", "?_p", "?_o").df.select("a")
        objects = self.match("?_s", "?_p", "?a").df.select("a")
        nodes = subjects.unionByName(objects).distinct()
        return nodes.select("a", F.col("a").alias("b"))

    def path(self, s, path, o) -> Solutions:
        """A path without repetition between two terms or variables."""
        return _ends(self._edges(path), s, o)

    def reach(self, path, isolated: bool = True) -> Reach:
        """What each node of the graph reaches along `path`, as labels: components
        of nodes that reach each other, their places, and the spans of places that
        each reaches. Pairs are spelled out by its `pairs` alone. Without `isolated`,
        nodes that no edge of the path ends at are left out: they reach nothing."""
        return reach(self._edges(path), self._loops().select(F.col("a").alias("node")) if isolated else None)

    def closure(self, s, path, o, zero: bool = True, starts: DataFrame | None = None) -> Solutions:
        """`path*` (or `path+` without `zero`): reachable pairs, each once.

        With an end given, semi-naive rounds from it, as many as the longest path
        has steps; `starts` (one column `a`) gives many beginnings. With free ends
        the pairs are spelled out from the labels of `reach`, which answers most
        questions without them.
        """
        if _is_var(s) and not _is_var(o) and starts is None:
            return self.closure(o, ("^", path), s, zero)
        if _is_var(s) and starts is None:
            return _ends(self.reach(path).pairs(zero), s, o)
        edges = cut(self._edges(path).distinct())
        if not _is_var(s):
            own = edges.sparkSession.range(1).select(constant(s).alias("a"))
            starts = own if starts is None else starts.select("a").join(own, "a", "left_semi")
        starts = starts.select("a").distinct()
        hop = edges.select(F.col("a").alias("_m"), F.col("b").alias("_e"))
        if zero:
            seen = cut(starts.select("a", F.col("a").alias("b")))
        else:
            seen = cut(starts.join(edges, "a").select("a", "b").distinct())
        frontier = seen
        parts = [seen]
        while True:
            step = (
                frontier.withColumnRenamed("b", "_m").join(hop, "_m")
                .select("a", F.col("_e").alias("b")).distinct()
            )
            for part in parts:
                step = step.join(part, ["a", "b"], "left_anti")
            frontier = cut(step)
            if frontier.isEmpty():
                break
            parts.append(frontier)
            if len(parts) > 6:
                parts = [cut(reduce(lambda x, y: x.unionByName(y), parts))]
        return _ends(reduce(lambda x, y: x.unionByName(y), parts), s, o)


def _ends(pairs: DataFrame, s, o) -> Solutions:
    out: dict[str, Column] = {}
    for term, column in ((s, "a"), (o, "b")):
        if _is_var(term):
            if term[1:] in out:
                pairs = pairs.filter(F.col("a") == F.col("b"))
            else:
                out[term[1:]] = F.col(column)
        else:
            pairs = pairs.filter(F.col(column) == constant(term))
    return Solutions(pairs.select(*[c.alias(n) for n, c in out.items()]))
