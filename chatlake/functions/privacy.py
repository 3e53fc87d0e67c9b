"""Masking of secrets and hashing of personal fields."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names of fields that hold secrets.
SECRET_FIELDS = [
    "app_secret",
    "app_key",
    "password",
    "token",
    "api_key",
    "access_token",
    "refresh_token",
    "session_id",
    "secret",
    "api_secret",
]


def mask_secret(text: Column, shown: int = 4) -> Column:
    masked = F.concat(F.left(text, F.lit(shown)), F.lit("***"))
    return F.when(F.length(text) <= shown, "***").otherwise(masked)


def hash_pii(text: Column, size: int = 8) -> Column:
    return F.left(F.sha2(text, 256), F.lit(size))


def sanitize(df: DataFrame, pii_fields: Iterable[str] = ()) -> DataFrame:
    """Mask text columns with secret names; replace personal text columns by ``<name>_hash``."""
    personal = set(pii_fields)
    columns = []
    for field in df.schema.fields:
        value = F.col(f"`{field.name}`")
        is_text = isinstance(field.dataType, T.StringType)
        if is_text and field.name.lower() in SECRET_FIELDS:
            columns.append(mask_secret(value).alias(field.name))
        elif is_text and field.name in personal:
            columns.append(hash_pii(value).alias(f"{field.name}_hash"))
        else:
            columns.append(value)
    return df.select(*columns)


def sanitize_map(values: Column, pii_fields: Iterable[str] = ()) -> Column:
    """The same for a map of text: secrets masked, personal keys renamed and hashed."""
    personal = list(pii_fields)

    def is_secret(key: Column) -> Column:
        return F.lower(key).isin(SECRET_FIELDS)

    def is_personal(key: Column) -> Column:
        return key.isin(personal) & ~is_secret(key) if personal else F.lit(False)

    cleaned = F.transform_values(
        values,
        lambda key, value: F.when(is_secret(key), mask_secret(value))
        .when(is_personal(key), hash_pii(value))
        .otherwise(value),
    )
    return F.transform_keys(
        cleaned,
        lambda key, _: F.when(is_personal(key), F.concat(key, F.lit("_hash"))).otherwise(key),
    )
