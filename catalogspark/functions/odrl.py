"""ODRL spelling rules and the three-valued atomic comparison."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from catalogspark.schema import ODRL, OPERATORS


def normalize_action(action: Column) -> Column:
    """`use`, `odrl:use` and the full IRI all become `odrl:use`."""
    return (
        F.when(action == "", F.lit(""))
        .when(
            F.startswith(action, F.lit(ODRL)),
            F.concat(F.lit("odrl:"), F.substr(action, F.lit(len(ODRL) + 1))),
        )
        .when(F.contains(action, F.lit(":")), action)
        .otherwise(F.concat(F.lit("odrl:"), action))
    )


def operator_name(operator: Column) -> Column:
    """The bare operator name, null when the operator is not one we evaluate."""
    bare = F.regexp_replace(operator, "^odrl:", "")
    return F.when(bare.isin(OPERATORS), bare)


def operand_name(operand: Column) -> Column:
    return (
        F.when(F.startswith(operand, F.lit(ODRL)), F.substr(operand, F.lit(len(ODRL) + 1)))
        .when(F.startswith(operand, F.lit("odrl:")), F.substr(operand, F.lit(6)))
        .otherwise(operand)
    )


def trim_all(value: Column) -> Column:
    """Trim Unicode white space on both sides."""
    return F.regexp_replace(value, r"(?U)^\s+|\s+$", "")


def candidates(right: Column) -> Column:
    """The trimmed, non-empty entries of a comma-separated operand."""
    return F.filter(F.transform(F.split(right, ","), trim_all), lambda x: x != "")


def as_number(value: Column) -> Column:
    """Plain decimal notation, with or without an exponent; no suffixes or names."""
    plain = value.rlike("^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$")
    return F.when(plain, value.try_cast("double"))


def as_moment(value: Column) -> Column:
    """A date-time; one without a zone is in UTC, whatever the session's zone."""
    zoned = value.rlike("(Z|z|[+-][0-9]{2}:?[0-9]{2}|UTC|GMT)$") & F.contains(value, F.lit(":"))
    dated = value.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}")
    utc = F.when(F.contains(value, F.lit(":")), F.concat(value, F.lit("Z"))).otherwise(
        F.concat(value, F.lit("T00:00:00Z"))
    )
    return F.when(dated, F.when(zoned, value).otherwise(utc).try_cast("timestamp"))


def ordered(values: Column, right: Column, compare) -> Column:
    """`compare` over numbers, else over date-times; null when neither reads."""

    def one(value: Column) -> Column:
        number, bound = as_number(value), as_number(right)
        moment, limit = as_moment(value), as_moment(right)
        return F.when(number.isNotNull() & bound.isNotNull(), compare(number, bound)).when(
            moment.isNotNull() & limit.isNotNull(), compare(moment, limit)
        )

    return F.exists(values, one)


def compare(values: Column, operator: Column, right: Column) -> Column:
    """true = match, false = miss, null = cannot be evaluated.

    `values` is the caller's claim (null when absent), `operator` a bare name.
    """
    options = candidates(right)
    held = F.arrays_overlap(values, options)
    return F.when(values.isNull(), F.lit(None).cast("boolean")).otherwise(
        F.when(operator == "eq", F.array_contains(values, right))
        .when(operator == "neq", ~F.array_contains(values, right))
        .when(operator.isin("isAnyOf", "isPartOf"), held)
        .when(operator == "isNoneOf", ~held)
        .when(operator == "isAllOf", F.size(F.array_except(options, values)) == 0)
        .when(operator == "lt", ordered(values, right, lambda a, b: a < b))
        .when(operator == "lteq", ordered(values, right, lambda a, b: a <= b))
        .when(operator == "gt", ordered(values, right, lambda a, b: a > b))
        .when(operator == "gteq", ordered(values, right, lambda a, b: a >= b))
    )
