"""Caller claims: mapping, keys, context, admission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogspark.schema import PER_TOKEN_CLAIMS


def _as_map(claims: Column) -> Column:
    return F.try_variant_get(F.try_parse_json(claims), "$", "map<string,variant>")


def _text(value: Column) -> Column:
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def _ascii_words(value: Column) -> Column:
    return F.filter(F.split(value, "[ \\t\\n\\f\\r]+"), lambda w: w != "")


def claim_map(claims: Column) -> Column:
    """Decoded claims JSON -> MAP<name, STRUCT<values ARRAY<STRING>, multi>>.

    A string is a single value, an all-string array several; a string `scope`
    is split on white space; everything else is dropped.
    """

    def read(entry: Column) -> Column:
        value = entry["value"]
        text = _text(value)
        items = F.try_variant_get(value, "$", "array<variant>")
        all_text = F.forall(items, lambda i: F.schema_of_variant(i) == "STRING")
        listed = F.transform(items, lambda i: F.try_variant_get(i, "$", "string"))
        none = F.lit(None).cast("struct<values:array<string>,multi:boolean>")
        mapped = (
            F.when(
                text.isNotNull() & (entry["key"] == "scope"),
                F.struct(_ascii_words(text).alias("values"), F.lit(True).alias("multi")),
            )
            .when(
                text.isNotNull(),
                F.struct(F.array(text).alias("values"), F.lit(False).alias("multi")),
            )
            .when(
                items.isNotNull() & all_text,
                F.struct(listed.alias("values"), F.lit(True).alias("multi")),
            )
            .otherwise(none)
        )
        return F.struct(entry["key"].alias("key"), mapped.alias("value"))

    entries = F.transform(F.map_entries(_as_map(claims)), read)
    kept = F.filter(entries, lambda e: e["value"].isNotNull())
    return F.coalesce(
        F.map_from_entries(kept),
        F.from_json(F.lit("{}"), "map<string,struct<values:array<string>,multi:boolean>>"),
    )


def claim_values(mapped: Column) -> Column:
    """MAP<name, ARRAY<STRING>>, the form constraints are evaluated against."""
    return F.transform_values(mapped, lambda _, v: v["values"])


def caller_key(mapped: Column) -> Column:
    """Claims that can decide something, in name order, as canonical JSON:
    callers that share it share every decision."""
    lasting = F.array_sort(
        F.filter(F.map_entries(mapped), lambda e: ~e["key"].isin(PER_TOKEN_CLAIMS))
    )
    quoted = F.transform(
        lasting,
        lambda e: F.concat(
            _json_string(e["key"]),
            F.lit(":"),
            F.when(e["value"]["multi"], F.to_json(e["value"]["values"])).otherwise(
                _json_string(F.get(e["value"]["values"], F.lit(0)))
            ),
        ),
    )
    return F.concat(F.lit("{"), F.array_join(quoted, ","), F.lit("}"))


def _json_string(value: Column) -> Column:
    listed = F.to_json(F.array(value))
    return F.substr(listed, F.lit(2), F.length(listed) - F.lit(2))


def with_context(values: Column, as_of: str) -> Column:
    """Add the evaluation time as `dateTime`; a caller cannot set its own."""
    own = F.map_filter(values, lambda k, _: k != "dateTime")
    return F.map_concat(own, F.create_map(F.lit("dateTime"), F.array(F.lit(as_of))))


def map_callers(callers: DataFrame, as_of: str) -> DataFrame:
    """callers(caller_id, claims) -> (caller_id, caller_key, sub, claims MAP)."""
    mapped = callers.select("caller_id", claim_map(F.col("claims")).alias("mapped"))
    return mapped.select(
        "caller_id",
        caller_key(F.col("mapped")).alias("caller_key"),
        with_context(claim_values(F.col("mapped")), as_of).alias("claims"),
    )


def admit(
    callers: DataFrame,
    as_of: str,
    issuer: str | None = None,
    audience: str | None = None,
    required_scope: str | None = None,
    leeway_secs: int = 60,
) -> DataFrame:
    """Decide which decoded tokens may call at all: (caller_id, status, reason).

    200 admitted; 401 for a token that is expired, not yet valid, or of the
    wrong or no issuer or audience; 403 for a valid one without the scope.
    """
    claims = _as_map(F.col("claims"))
    read = callers.select("caller_id", claims.alias("c"))
    now = F.unix_timestamp(F.lit(as_of).cast("timestamp"))
    number = lambda k: F.try_variant_get(F.col("c")[k], "$", "double")
    text = lambda k: _text(F.col("c")[k])
    one_or_list = lambda k: F.coalesce(
        F.when(text(k).isNotNull(), F.array(text(k))),
        F.try_variant_get(F.col("c")[k], "$", "array<string>"),
    )
    # admission splits at any Unicode white space, claim mapping at ASCII blanks
    scope = F.filter(F.split(text("scope"), r"(?U)\s+"), lambda w: w != "")

    reason = F.when(number("exp").isNull(), "missing exp").when(
        number("exp") < now - leeway_secs, "expired"
    )
    reason = reason.when(
        number("nbf").isNotNull() & (number("nbf") > now + leeway_secs), "not yet valid"
    )
    if issuer is not None:
        reason = reason.when(
            ~F.coalesce(F.array_contains(one_or_list("iss"), issuer), F.lit(False)),
            "wrong issuer",
        )
    if audience is not None:
        reason = reason.when(
            ~F.coalesce(F.array_contains(one_or_list("aud"), audience), F.lit(False)),
            "wrong audience",
        )
    status = F.when(reason.isNotNull(), 401)
    if required_scope is not None:
        missing = ~F.coalesce(F.array_contains(scope, required_scope), F.lit(False))
        status = status.when(missing, 403)
        reason = reason.when(
            missing, F.lit(f"token is missing required scope '{required_scope}'")
        )
    return read.select(
        "caller_id",
        F.coalesce(status, F.lit(200)).alias("status"),
        F.coalesce(reason, F.lit("")).alias("reason"),
    )
