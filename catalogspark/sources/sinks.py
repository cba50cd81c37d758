"""Results as JSON text: query bindings, booleans, catalogs and offers."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogspark.operators.pattern import Solutions, TooManyRows
from catalogspark.schema import XSD_STRING


def _term(var: str) -> Column:
    c = lambda f: F.col(f"`{var}`.{f}")
    kind = F.when(c("kind") == "iri", "uri").otherwise("literal")
    tagged = c("lang") != ""
    plain = c("datatype").isin("", XSD_STRING) | tagged
    return F.when(
        F.col(var).isNotNull(),
        F.struct(
            kind.alias("type"),
            c("value").alias("value"),
            F.when(tagged, c("lang")).alias("xml:lang"),
            F.when(~plain, c("datatype")).alias("datatype"),
        ),
    )


def bindings(solutions: Solutions) -> DataFrame:
    """One W3C binding object per solution; unbound variables are left out."""
    body = F.struct(*[_term(v).alias(v) for v in solutions.vars])
    return solutions.df.select(F.to_json(body).alias("value"))


def bindings_head(solutions: Solutions) -> str:
    return json.dumps({"vars": solutions.vars})


def ask_json(answer: bool) -> str:
    return json.dumps({"head": {}, "boolean": answer})


def results_json(solutions: Solutions, max_rows: int) -> str:
    """The whole result document; more than `max_rows` solutions is an error,
    so at most that many rows reach the driver."""
    rows = [r.value for r in bindings(solutions).limit(max_rows + 1).collect()]
    if len(rows) > max_rows:
        raise TooManyRows(f"more than {max_rows} solutions")
    return (
        f'{{"head":{bindings_head(solutions)},"results":{{"bindings":[{",".join(rows)}]}}}}'
    )


def write_lines(df: DataFrame, path: str, column: str = "value", mode: str = "overwrite") -> None:
    """One JSON text per line, written by all tasks."""
    df.select(F.col(column).alias("value")).write.mode(mode).text(path)
