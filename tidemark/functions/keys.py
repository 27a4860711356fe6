"""Hash keys and landing-zone object keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import sqltext as sx
from tidemark.functions.text import col_

#: Fixed value: text standing in for null inside a surrogate key.
SURROGATE_NULL = "_dbt_utils_surrogate_key_null_"
#: Landing object key layout <prefix>/<YYYYMMDDTHHMMSSZ>_<hash8>.csv
KEY_TS_FORMAT = "yyyyMMdd'T'HHmmss'Z'"
KEY_PATTERN = r"^(.*/)?(\d{8}T\d{6}Z)_([0-9a-f]{8})\.csv$"
SHORT_HASH_LENGTH = 8


def surrogate_key(*cols: str | Column) -> Column:
    """md5 of the '-'-joined text of each column, nulls replaced by a sentinel."""
    parts = [F.coalesce(col_(c).cast("string"), F.lit(SURROGATE_NULL)) for c in cols]
    joined = parts[0] if len(parts) == 1 else F.concat_ws("-", *parts)
    return F.md5(joined)


def surrogate_key_sql(*cols: str) -> str:
    """SQL text of :func:`surrogate_key` over column names (or SQL text)."""
    parts = [f"coalesce(CAST({sx.ref(c)} AS STRING), {sx.lit(SURROGATE_NULL)})" for c in cols]
    joined = parts[0] if len(parts) == 1 else f"concat_ws('-', {', '.join(parts)})"
    return f"md5({joined})"


def short_hash_sql(h: str) -> str:
    h = sx.ref(h)
    return (f"CASE WHEN length({h}) >= {SHORT_HASH_LENGTH} THEN substring({h}, 1, {SHORT_HASH_LENGTH}) "
            f"ELSE raise_error(concat('hash shorter than 8 characters: ', {h})) END")


def build_object_key_sql(prefix: str, snapshot_ts: str, file_hash: str) -> str:
    """Key text for a literal ``prefix`` and timestamp / hash columns (or SQL text)."""
    p = sx.lit(prefix)
    return (f"concat(regexp_replace({p}, {sx.lit(r'^/+|/+$')}, ''), '/', "
            f"date_format({sx.ref(snapshot_ts)}, {sx.lit(KEY_TS_FORMAT)}), '_', "
            f"{short_hash_sql(file_hash)}, '.csv')")


def short_hash(c: str | Column) -> Column:
    """First 8 characters of a full hash; a shorter value is an error."""
    h = col_(c)
    return F.when(
        F.length(h) >= SHORT_HASH_LENGTH, F.substring(h, 1, SHORT_HASH_LENGTH)
    ).otherwise(F.raise_error(F.concat(F.lit("hash shorter than 8 characters: "), h)))


def build_object_key(prefix: str | Column, snapshot_ts: str | Column, file_hash: str | Column) -> Column:
    p = F.regexp_replace(col_(prefix) if not isinstance(prefix, str) else F.lit(prefix), r"^/+|/+$", "")
    return F.concat(
        p, F.lit("/"), F.date_format(col_(snapshot_ts), KEY_TS_FORMAT), F.lit("_"),
        short_hash(file_hash), F.lit(".csv"),
    )


def key_is_valid(key: str | Column) -> Column:
    return col_(key).rlike(KEY_PATTERN)


def key_snapshot_ts(key: str | Column) -> Column:
    """Snapshot timestamp encoded in a key; null when the key does not parse."""
    stamp = F.regexp_extract(col_(key), KEY_PATTERN, 2)
    return F.when(
        key_is_valid(key), F.try_to_timestamp(stamp, F.lit(KEY_TS_FORMAT))
    )


def key_hash8(key: str | Column) -> Column:
    return F.when(key_is_valid(key), F.regexp_extract(col_(key), KEY_PATTERN, 3))


def key_prefix(key: str | Column) -> Column:
    return F.when(key_is_valid(key), F.regexp_extract(col_(key), KEY_PATTERN, 1))
