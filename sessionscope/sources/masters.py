"""Master data: users from the customer master (I9), locations from a landed file
with header aliases (I10), tenant id normalisation (I12)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Accepted header aliases of location files and the schema kept.
LOCATION_HEADER_ALIASES = {
    "WAREHOUSE_ID": "warehouse_id",
    "WAREHOUSE_CODE": "warehouse_code",
    "WAREHOUSE_NAME": "warehouse_name",
    "LOCATION_NAME": "warehouse_name",
    "CITY": "city",
    "STATE": "state",
    "PROVINCE": "state",
    "COUNTRY": "country",
    "ADDRESS1": "address1",
    "ADDRESS": "address1",
    "ADDRESS2": "address2",
    "ZIP_CODE": "zip",
    "POSTAL_CODE": "zip",
    "ZIP": "zip",
}
LOCATION_COLUMNS = ["warehouse_id", "warehouse_code", "warehouse_name", "city", "state", "country",
                    "address1", "address2", "zip"]
LOCATION_STRING_FIELDS = ["warehouse_id", "warehouse_code", "zip"]


def extract_users(master: DataFrame) -> DataFrame:
    """rename/cast the customer master; keep rows with a user id; NaN -> NULL. A tenant_id
    column is carried through, so the same user id in two tenants stays two users."""
    def clean(c: str) -> Column:
        col = F.col(c)
        return F.when(col.cast("string") != "NaN", col)
    return master.filter(F.col("USER_ID").isNotNull()).select(
        *[F.col(c) for c in ("tenant_id",) if c in master.columns],
        clean("USER_ID").cast("string").alias("user_id"),
        clean("Name").alias("user_name"),
        clean("CUSTOMER_NAME").alias("buying_company_name"),
        clean("CUSTOMER_ERP_ID").cast("string").alias("buying_company_erp_id"),
        clean("EMAIL").alias("email"),
        clean("OFFICE_PHONE").alias("office_phone"),
        clean("CELL_PHONE").alias("cell_phone"),
    )


def read_location_file(spark, path: str, file_format: str = "csv") -> DataFrame:
    """I10 on a landed file: CSV (header row, all text) or Parquet."""
    reader = spark.read.option("header", True) if file_format == "csv" else spark.read
    return normalize_locations(reader.format(file_format).load(path))


def normalize_locations(df: DataFrame) -> DataFrame:
    """Keep the known columns present -- under their own name, or a header alias; where a file has
    several headers for one column, the last in the fixed order above that has a value in the row, and the
    column under its own name before all -- id/code/zip as text with ``"nan"`` -> NULL, drop rows without a
    non-blank warehouse_id. Headers are matched exactly; unknown columns are dropped."""
    headers = {c: [c] for c in LOCATION_COLUMNS if c in df.columns}
    for header, column in reversed(LOCATION_HEADER_ALIASES.items()):
        if header in df.columns:
            headers.setdefault(column, []).append(header)

    def value(column: str) -> Column:
        if column not in LOCATION_STRING_FIELDS:
            return F.coalesce(*[F.col(h) for h in headers[column]])
        texts = [F.col(h).cast("string") for h in headers[column]]
        return F.coalesce(*[F.when(x != "nan", x) for x in texts])

    out = df.select(*[value(c).alias(c) for c in LOCATION_COLUMNS if c in headers])
    if "warehouse_id" in headers:
        out = out.filter(F.col("warehouse_id").isNotNull() & (F.trim(F.col("warehouse_id")) != ""))
    return out


_UUID_HEX = "^[0-9a-fA-F]{32}$"


def _dashed(hex32: Column) -> Column:
    return F.concat_ws("-", F.substring(hex32, 1, 8), F.substring(hex32, 9, 4), F.substring(hex32, 13, 4),
                       F.substring(hex32, 17, 4), F.substring(hex32, 21, 12))


def normalize_tenant_id(c: Column) -> Column:
    """A valid UUID (braces, ``urn:uuid:`` prefix and dashes tolerated) in canonical
    lower-case form; any other text -> the UUID made of the MD5 bytes of its UTF-8 text. NULL stays NULL."""
    h = F.regexp_replace(F.regexp_replace(c, "urn:", ""), "uuid:", "")
    h = F.regexp_replace(F.regexp_replace(h, r"^[{}]+|[{}]+$", ""), "-", "")
    return F.when(c.isNotNull(), F.when(h.rlike(_UUID_HEX), _dashed(F.lower(h))).otherwise(_dashed(F.md5(c))))
