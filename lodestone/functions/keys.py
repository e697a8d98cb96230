"""Keys, instants and digests as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: The blanks that do not count at the ends of a key.
OUTER_BLANKS = " \t\r\n "


def plain_key(c: Column) -> Column:
    """A key without outer blanks and in lower case; keys that differ only in these are the same."""
    return F.lower(F.btrim(c, F.lit(OUTER_BLANKS)))


def require_utc() -> None:
    """Fails where the session's zone is not UTC: times without a zone mean UTC, and Spark reads them in the session's zone."""
    spark = SparkSession.getActiveSession()
    zone = spark.conf.get("spark.sql.session.timeZone") if spark else "UTC"
    if zone not in ("UTC", "Etc/UTC", "Z", "GMT", "Etc/GMT", "+00:00", "UTC+00:00"):
        raise ValueError(f"spark.sql.session.timeZone is {zone}: times without a zone mean UTC, set it to UTC")


def instant_us(c: Column) -> Column:
    """Microseconds since 1970 UTC of an ISO 8601 text in any offset; null if it names no instant.

    Text without an offset means UTC, as the session's zone must be.
    """
    require_utc()
    return F.unix_micros(c.try_cast("timestamp"))


def micros(c: Column) -> Column:
    """Microseconds since 1970 UTC of a timestamp with or without zone; one without zone means UTC."""
    require_utc()
    return F.unix_micros(c.cast("timestamp"))


def canonical_instant(c: Column) -> Column:
    """The canonical text of an instant: YYYY-MM-DDTHH:MM:SS.ffffffZ; null if c names none."""
    require_utc()
    return F.date_format(c.try_cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def cas_key(sha256: Column) -> Column:
    """The content-addressed key of a digest."""
    return F.concat(F.lit("cas/v1/sha256/"), F.substring(sha256, 1, 2), F.lit("/"), F.substring(sha256, 3, 1 << 20))


def is_digest(c: Column) -> Column:
    """Whether c is 64 lower-case hexadecimal digits; false for null."""
    return F.coalesce(c.rlike("^[0-9a-f]{64}$"), F.lit(False))


def uuid5(namespace: str, name: Column) -> Column:
    """The UUID version 5 (RFC 9562) of name in a namespace given as UUID text, from SHA-1 in the JVM."""
    import uuid

    raw = F.lit(bytearray(uuid.UUID(namespace).bytes))
    h = F.sha1(F.concat(raw, F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat_ws(
        "-",
        F.substring(h, 1, 8),
        F.substring(h, 9, 4),
        F.concat(F.lit("5"), F.substring(h, 14, 3)),
        F.concat(variant, F.substring(h, 18, 3)),
        F.substring(h, 21, 12),
    )
