"""Checks of the participants table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROTOCOLS = ["none", "dcp", "oid4vp"]


def check_participants(participants: DataFrame, has_holder: bool = True) -> DataFrame:
    """(node_id, violation): every row breaking a rule; no rows means valid."""
    protocol = F.col("credential_protocol")

    def blank(column: str) -> Column:
        return F.coalesce(F.trim(F.col(column)) == "", F.lit(True))

    rules = [
        (blank("node_id"), "blank id"),
        (blank("name"), "blank name"),
        (~F.coalesce(protocol.isin(PROTOCOLS), F.lit(False)), "unknown credential protocol"),
        ((protocol == "dcp") & F.col("provider_did").isNull(), "missing provider_did"),
        ((protocol == "oid4vp") & F.col("response_uri").isNull(), "missing response_uri"),
        (protocol.isin("dcp", "oid4vp") & F.lit(not has_holder), "missing holder"),
    ]
    broken = F.array_compact(F.array(*[F.when(bad, F.lit(text)) for bad, text in rules]))
    single = participants.select("node_id", F.explode(broken).alias("violation"))
    repeated = (
        participants.groupBy("node_id").count().filter("count > 1")
        .select("node_id", F.lit("duplicate id").alias("violation"))
    )
    return single.unionByName(repeated)
