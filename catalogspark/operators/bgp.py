"""Basic graph patterns by stars: the triples of one subject are one relation.

A star's triples are joined on the plain subject column, so over the layout that
is bucketed by subject none of them is shuffled, and over other layouts each once.
Stars are linked by the terms they share, from the one with the fewest subjects
on; how many a star has is read from the stored characteristic sets, which count
the subjects of each set of predicates.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogspark.operators.keys import HASH, hashed, join_hashed

def characteristic_sets(quads: DataFrame) -> DataFrame:
    """(predicates, n_subjects, n_quads): the sets of predicates that subjects have."""
    # once by subject: one exchange, and none over the layout bucketed by it
    by_subject = hashed(quads.select("s", "p"), ["s"]).groupBy(HASH, "s").agg(F.sort_array(F.collect_set("p")).alias("predicates"), F.count("*").alias("n"))
    return by_subject.groupBy("predicates").agg(F.count("*").alias("n_subjects"), F.sum("n").cast("long").alias("n_quads"))


@dataclass
class Star:
    """Triples (predicate, object) of the subject variable `subject`."""

    subject: str
    graph: str | None
    triples: list[tuple] = field(default_factory=list)

    @property
    def predicates(self) -> list[str]:
        return sorted({p for p, _ in self.triples})


def _is_var(term) -> bool:
    return isinstance(term, str) and term.startswith("?")


def stars(triples: tuple[tuple, ...]) -> tuple[list[Star], list[tuple]]:
    """The stars of a pattern, and the triples that belong to none: those with a
    variable for their predicate or graph, or a fixed subject."""
    found: dict[tuple, Star] = {}
    rest = []
    for triple in triples:
        s, p, o, g = (*triple, None)[:4]
        if not _is_var(s) or _is_var(p) or _is_var(g) or not isinstance(p, str):
            rest.append(triple)
        else:
            found.setdefault((s, g), Star(s, g)).triples.append((p, o))
    return list(found.values()), rest


def sizes(sets: DataFrame | None, found: list[Star]) -> list[int]:
    """Subjects of each star, by one pass over the characteristic sets; without
    them stars keep their order."""
    if sets is None or not found:
        return list(range(len(found)))
    have = [F.forall(F.array(*map(F.lit, star.predicates)), lambda p: F.array_contains("predicates", p)) for star in found]
    row = sets.agg(*[F.coalesce(F.sum(F.when(h, F.col("n_subjects"))), F.lit(0)).alias(f"n{i}") for i, h in enumerate(have)]).first()
    return [row[i] for i in range(len(found))]


def star_rows(graph, star: Star) -> DataFrame:
    """(_subject, a term column for each object variable): the star's solutions. Files
    of one predicate are small beside their rows, so none is broadcast."""
    out, names = None, []
    subject = F.col("s").alias("_subject")
    # fixed objects first: they leave the fewest subjects
    for p, o in sorted(star.triples, key=lambda t: _is_var(t[1])):
        rows = graph.rows(p, o if not _is_var(o) else None, star.graph)
        name = None
        if not _is_var(o):
            rows = rows.select(subject)
        elif o == star.subject:
            rows = rows.filter((F.col("o") == F.col("s")) & (F.col("o_kind") == "iri")).select(subject)
        else:
            name = o[1:]
            rows = rows.select(subject, graph.object_term().alias("_object" if name in names else name))
        out = rows if out is None else out.join(rows.hint("merge"), "_subject")
        if name in names:
            out = out.filter(F.col(name) == F.col("_object")).drop("_object")
        elif name:
            names.append(name)
    return out


def _iri(term: Column) -> Column:
    return F.when(term.kind == "iri", term.value)


def solve(graph, triples: tuple[tuple, ...], iri_term, refuse) -> DataFrame:
    """All solutions of the triples, a term column for each variable. `iri_term`
    makes a term of a subject; `refuse` is called where no variable is shared."""
    found, rest = stars(triples)
    order = sizes(graph.sets, found)
    todo = [star for _, star in sorted(zip(order, found), key=lambda x: x[0])]
    out: DataFrame | None = None
    names: list[str] = []

    def add(rows: DataFrame, new: list[str]) -> None:
        nonlocal out
        out = rows
        names.extend(n for n in new if n not in names)

    def plain(star: Star) -> DataFrame:
        rows = star_rows(graph, star)
        return rows.withColumn(star.subject[1:], iri_term(F.col("_subject"))).drop("_subject")

    waiting: list = [*todo, *rest]
    while waiting:
        best, how = None, ""
        for item in waiting:
            if out is None:
                best, how = item, "first"
                break
            own = _names(item)
            if isinstance(item, Star) and item.subject[1:] in names:
                best, how = item, "subject"
                break
            if best is None and any(n in names for n in own):
                best, how = item, "shared"
        if best is None:
            refuse()
        waiting.remove(best)
        own = _names(best)
        if how == "subject":
            # joined on the plain subject, so a bucketed star isn't shuffled
            rows = star_rows(graph, best)
            again = [n for n in rows.columns if n in names]
            rows = rows.withColumnsRenamed({n: f"_again_{n}" for n in again})
            joined = out.withColumn("_at", _iri(F.col(best.subject[1:]))).join(rows.hint("merge"), F.col("_at") == F.col("_subject"))
            for n in again:
                joined = joined.filter(F.col(n) == F.col(f"_again_{n}"))
            add(joined.drop("_at", "_subject", *[f"_again_{n}" for n in again]), own)
            continue
        rows = plain(best) if isinstance(best, Star) else graph.match(*best).df
        shared = [n for n in own if n in names]
        add(rows if how == "first" else join_hashed(out, rows.hint("merge"), shared), own)
    return out.select(*_names([term for triple in triples for term in triple]))


def _names(item) -> list[str]:
    terms = [item.subject, *[o for _, o in item.triples]] if isinstance(item, Star) else item
    out: list[str] = []
    for term in terms:
        if _is_var(term) and term[1:] not in out:
            out.append(term[1:])
    return out

