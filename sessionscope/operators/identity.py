"""J1 identity resolution.

Reference semantics: LEFT JOIN users ON same tenant AND
``(u.user_id = webuserid OR (webuserid IS NULL AND u.erp_id = webcustomerid))``.
ERP ids are shared by several users, so rows fan out.

An OR-condition join would be a nested-loop join in Spark. It is rewritten as an
exactly equivalent equi-join: each event carries one key (``U:<webuserid>`` when
present, else ``E:<webcustomerid>``) and each user is listed under both of its keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionscope.operators.skew import spread_null_key

USER_COLUMNS = ("user_id", "customer_name", "email", "phone", "office_phone")


def event_user_key(webuserid: Column, webcustomerid: Column) -> Column:
    return F.when(webuserid.isNotNull(), F.concat(F.lit("U:"), webuserid)) \
            .otherwise(F.concat(F.lit("E:"), webcustomerid))


def users_by_key(users: DataFrame) -> DataFrame:
    """Every user under its two lookup keys (NULL ids give NULL keys and never match)."""
    return users.select(
        F.col("tenant_id").alias("_u_tenant"),
        F.explode(F.array(F.concat(F.lit("U:"), F.col("user_id")),
                          F.concat(F.lit("E:"), F.col("buying_company_erp_id")))).alias("_u_key"),
        F.col("user_id"),
        F.col("buying_company_name").alias("customer_name"),
        F.col("email"),
        F.col("cell_phone").alias("phone"),
        F.col("office_phone"),
    ).filter(F.col("_u_key").isNotNull())


def resolve_users(df: DataFrame, users: DataFrame,
                  webuserid: str = "user_prop_webuserid",
                  webcustomerid: str = "user_prop_webcustomerid",
                  salt: list[str] | None = None) -> DataFrame:
    """Left-join customer attributes (user_id, customer_name, email, phone, office_phone)."""
    key = event_user_key(F.col(webuserid), F.col(webcustomerid))
    salt_cols = [F.col(c) for c in (salt or df.columns)]
    left = df.withColumn("_e_key", spread_null_key(key, *salt_cols))
    u = users_by_key(users)
    out = left.join(u, (left["tenant_id"] == u["_u_tenant"]) & (left["_e_key"] == u["_u_key"]), "left")
    return out.drop("_e_key", "_u_key", "_u_tenant")
