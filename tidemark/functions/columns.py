"""Column functions used across the library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def host_rewrite(url: Column, host: str) -> Column:
    """Replace the host of http and https URLs; other values, and all where the host is empty, stay."""
    # fixed value: scheme, host and rest of a URL
    return F.regexp_replace(url, r"^(https?://)[^/]+(/.*)?$", f"$1{host.replace('$', '')}$2") if host else url


def object_id_time(oid: Column) -> Column:
    """Creation time that the first 8 hexadecimal digits of an id hold."""
    return F.timestamp_seconds(F.conv(F.substring(oid, 1, 8), 16, 10).cast("long"))


def human_bytes(n: Column) -> Column:
    unit = F.when(n < 1024, F.format_string("%d B", n.cast("long")))
    for k, name in ((1, "KB"), (2, "MB"), (3, "GB"), (4, "TB")):
        unit = unit.when(n < 1024 ** (k + 1), F.format_string(f"%.1f {name}", n / 1024**k)) if k < 4 else unit.otherwise(F.format_string(f"%.1f {name}", n / 1024**k))
    return unit


# The limits of the classes of hours and volumes.
def time_of_day(ts: Column) -> Column:
    h = F.hour(ts)
    return F.when(h.between(6, 11), "morning").when(h.between(12, 17), "afternoon").when(h.between(18, 21), "evening").otherwise("night")


def day_kind(ts: Column) -> Column:
    return F.when(F.dayofweek(ts).isin(1, 7), "weekend").otherwise("weekday")


def volume_class(n: Column) -> Column:
    return F.when(n < 5, "low").when(n > 20, "high").otherwise("medium")


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def micros(ts: Column) -> Column:
    """Microseconds since 1970, a numeric order for range frames."""
    return F.unix_micros(ts.cast("timestamp"))


def protect(df: DataFrame, columns: list[str], key: str, key_id: str, keep: list[str]) -> DataFrame:
    """Columns as one AES-GCM payload beside the columns of `keep` and the id of the key."""
    whole = F.to_json(F.struct(*columns))
    return df.select(*keep, F.lit(key_id).alias("key_id"), F.base64(F.aes_encrypt(whole.cast("binary"), F.lit(key.encode()), F.lit("GCM"))).alias("payload"))


def reveal(df: DataFrame, schema: str, key: str) -> DataFrame:
    """The inverse of protect(); a payload that is too short or was changed is an error."""
    text = F.aes_decrypt(F.unbase64("payload"), F.lit(key.encode()), F.lit("GCM")).cast("string")
    return df.withColumn("d", F.from_json(text, schema)).select(*[c for c in df.columns if c not in ("key_id", "payload")], "d.*")
