"""Who may see what: tenants, grants, row policies, test sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def of_tenant(rows: DataFrame, sources: DataFrame, user: str | None, admin: bool = False) -> DataFrame:
    """Rows (with ``source_id``) of the sources that ``user`` owns; all for an admin, none for an unknown user."""
    if admin:
        return rows
    return rows.join(sources.where(F.col("user_id").eqNullSafe(F.lit(user)) & F.col("user_id").isNotNull()).select(F.col("id").alias("source_id")), "source_id", "left_semi")


def accessible(sources: DataFrame, user_grants: DataFrame, role_grants: DataFrame, roles: DataFrame, now, action: str = "can_read") -> DataFrame:
    """``user_id, source_id``: unexpired grants of an action, direct or through a role.

    ``user_grants``: user_id, source_id, expires, action columns; ``role_grants``: the same by role; ``roles``: user_id, role.
    """
    live = lambda g: g.where(F.col(action) & (F.col("expires").isNull() | (F.col("expires") > now)))
    direct = live(user_grants).select("user_id", "source_id")
    by_role = live(role_grants).join(roles, "role").select("user_id", "source_id")
    return direct.union(by_role).distinct().join(sources.select(F.col("id").alias("source_id")), "source_id", "left_semi").select("user_id", "source_id")


def secured(rows: DataFrame, grants: DataFrame, user: str, key: str = "source_id") -> DataFrame:
    """``rows`` under the row policy of ``user``: only those of a granted source."""
    return rows.join(grants.where(F.col("user_id") == user).select(F.col("source_id").alias(key)), key, "left_semi")
