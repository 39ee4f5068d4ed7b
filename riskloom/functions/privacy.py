"""Masking of network addresses and payment tokens, and the idempotency digest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fields that are never shown. --------------------------------------------------------
SECRET_FIELDS = ["password", "secret", "cvv", "pan", "ssn", "pin"]
DEFAULT_SALT = "fraud-salt"
# ---------------------------------------------------------------------------------------------------


def mask_ip(ip: Column) -> Column:
    v4 = r"^(\d{1,3}\.\d{1,3})\.\d{1,3}\.\d{1,3}$"
    return (
        F.when(ip.isNull() | (ip == "") | (ip == "unknown"), "0.0.0.0")
        .when(ip.rlike(v4), F.concat(F.regexp_extract(ip, v4, 1), F.lit(".***.***")))
        .when(F.contains(ip, F.lit(":")), F.concat(F.substring_index(ip, ":", 1), F.lit(":****:****")))
        .otherwise("***.***.***.***")
    )


def mask_token(token: Column) -> Column:
    clean = F.trim(token)
    return (
        F.when(token.isNull() | (token == ""), "TOKEN-****")
        .when(F.length(clean) <= 4, "****")
        .otherwise(F.concat(F.lit("****-****-****-"), F.right(clean, F.lit(4))))
    )


def sanitize(df: DataFrame) -> DataFrame:
    """Mask what the schema shows to be sensitive; other columns pass unchanged."""
    out = []
    for name in df.columns:
        column = F.col(name)
        if name == "ip_address":
            column = mask_ip(column)
        elif name == "payment_method":
            column = F.when(F.contains(F.lower(column), F.lit("token")), mask_token(column)).otherwise(column)
        elif name in SECRET_FIELDS:
            column = F.lit("[REDACTED]")
        out.append(column.alias(name))
    return df.select(*out)


def idempotency_key(customer_id: Column, amount: Column, timestamp: Column, salt: str = DEFAULT_SALT) -> Column:
    """sha256 of customer, two-decimal amount, timestamp text and salt."""
    return F.sha2(F.concat_ws("|", customer_id, amount.cast("decimal(20,2)").cast("string"), timestamp, F.lit(salt)), 256)
