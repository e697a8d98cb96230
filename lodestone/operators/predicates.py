"""Predicates over records of objects and over log events: filters of many optional parts, and JSON values compared with their types.

Each part that is not given is no condition; the parts that are given are joined by AND as plain columns, so that what the scan can
take of them reaches it. Null satisfies no condition.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys of an object's metadata that are for the engine alone.
INTERNAL_KEYS = ["content_identity", "document_extraction", "etag", "mime_detection", "mtime", "path", "sample_len", "version_id"]


def all_of(*parts: Column | None) -> Column:
    """The conjunction of those parts that are given; true if none is. A null part is false."""
    out = F.lit(True)
    for p in parts:
        if p is not None:
            out = out & F.coalesce(p, F.lit(False))
    return out


def json_scalar_equals(json: Column, path: str, value: bool | int | float | str | None) -> Column:
    """Whether the JSON text has at path a scalar of the same type and value: true is not 1, 1 is not 1.0, "1" is not 1, null is null.

    Text that is no JSON, and a path that is not there, are equal to nothing.
    """
    v = F.try_variant_get(F.try_parse_json(json), path, "variant")
    kind, text = F.schema_of_variant(v), v.cast("string")
    if value is None:
        same = kind == "VOID"
    elif isinstance(value, bool):
        same = (kind == "BOOLEAN") & (text == str(value).lower())
    elif isinstance(value, int):
        same = (kind == "BIGINT") & (text == str(value))
    elif isinstance(value, float):  # a number written with a point or an exponent
        same = (kind.startswith("DECIMAL") | (kind == "DOUBLE")) & (v.cast("double") == value)
    else:
        same = (kind == "STRING") & (text == value)
    return F.coalesce(same, F.lit(False))


def is_text(json: Column) -> Column:
    """Whether every escape of a JSON text names a character: no NUL and no half of a surrogate pair; false for null."""
    escapes = F.regexp_replace(json, r"\\\\", "")  # a backslash that is itself escaped begins no escape
    pairs = F.regexp_replace(escapes, r"(?i)\\ud[89ab][0-9a-f]{2}\\ud[c-f][0-9a-f]{2}", "")
    return F.coalesce(~pairs.rlike(r"(?i)\\u(0000|d[89a-f][0-9a-f]{2})"), F.lit(False))


def map_equals(m: Column, wanted: dict[str, str]) -> Column | None:
    """Whether a map of texts has each wanted key with just that value."""
    return all_of(*[m[k] == v for k, v in wanted.items()]) if wanted else None


def one_of(c: Column, values: list | None) -> Column | None:
    """Whether c is one of the values; no condition if values is None, false for an empty list."""
    return None if values is None else c.isin(values) if values else F.lit(False)


def objects(bucket: str | None = None, key_prefix: str | None = None, tier: str | None = None, mime: str | None = None, size: Column | int | None = None, content_sha256: Column | str | None = None, object_metadata: dict[str, str] | None = None, document_metadata: dict[str, str] | None = None, names: dict[str, str] | None = None) -> Column:
    """The filter of a question: eight optional parts over the columns bucket, key, tier, mime, size, content_sha256, object_metadata (map)
    and document_metadata (struct); names tells other names of columns."""
    c = lambda n: F.col((names or {}).get(n, n))
    document = [F.col(f"{(names or {}).get('document_metadata', 'document_metadata')}.{k}") == v for k, v in (document_metadata or {}).items()]
    return all_of(
        None if bucket is None else c("bucket") == bucket,
        c("key").startswith(key_prefix) if key_prefix else None,
        None if tier is None else c("tier") == tier,
        None if mime is None else c("mime") == mime,
        None if size is None else c("size") == size,
        None if content_sha256 is None else (c("content_sha256") == content_sha256) & c("content_sha256").rlike("^[0-9a-f]{64}$"),
        map_equals(c("object_metadata"), object_metadata or {}),
        *document,
    )


def vectors(buckets: list | None = None, keys: list | None = None, key_prefix: str | None = None, tiers: list | None = None, mimes: list | None = None, metadata: dict[str, str] | None = None, names: dict[str, str] | None = None) -> Column:
    """The filter of a vector search: lists of buckets, keys, tiers and MIME types, a key prefix, and metadata as a JSON text or a map of texts."""
    c = lambda n: F.col((names or {}).get(n, n))
    return all_of(one_of(c("bucket"), buckets), one_of(c("key"), keys), c("key").startswith(key_prefix) if key_prefix else None, one_of(c("tier"), tiers), one_of(c("mime"), mimes), map_equals(c("metadata"), metadata or {}))


def events(equal: dict[str, object] | None = None, types: list[str] | None = None, outcomes: list[str] | None = None, since: Column | None = None, until: Column | None = None, behind: tuple[Column, Column] | None = None, time: str = "occurred_at", identity: str = "event_id", type_column: str = "event_type", outcome_column: str = "outcome") -> Column:
    """The filter of an event log: equality over any columns, lists of types and outcomes, since <= time < until, and strictly older than behind,
    a (time, identity)."""
    older = None if behind is None else (F.col(time) < behind[0]) | ((F.col(time) == behind[0]) & (F.col(identity) < behind[1]))
    return all_of(*[F.col(k) == v for k, v in (equal or {}).items()], one_of(F.col(type_column), types), one_of(F.col(outcome_column), outcomes), None if since is None else F.col(time) >= since, None if until is None else F.col(time) < until, older)


def content_is_current(identity_sha256: Column, identity_size: Column, sha256: Column, size: Column) -> Column:
    """Whether a content identity is that of the object as it is: a digest of 64 small hexadecimal digits, equal to the object's, of its size."""
    return all_of(identity_sha256.rlike("^[0-9a-f]{64}$"), identity_sha256 == sha256, identity_size == size)


def extraction_is_current(e: Column, size: Column, mime: Column, schema_version: int, normalization_version: int) -> Column:
    """Whether an extraction (a struct: status, failure_code, source_size, source_mime, schema_version, normalization_version, parser_name,
    parser_version, runtime_version, text, text_bytes) is one of the object as it is."""
    named = [F.length(e[n]) > 0 for n in ("parser_name", "parser_version", "runtime_version")]
    return all_of(e["status"] == "succeeded", e["failure_code"].isNull(), e["source_size"] == size, e["source_mime"] == mime, e["schema_version"] == schema_version, e["normalization_version"] == normalization_version, *named, F.octet_length(e["text"]) == e["text_bytes"])


def plain_path(c: Column) -> Column:
    """A bucket, key or prefix in the form in which scopes are compared: composed, folded to small letters, / for every stroke, none doubled
    or at the ends, no dot steps. ASCII stays in the JVM."""

    @F.pandas_udf("string")
    def folded(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else unicodedata.normalize("NFC", unicodedata.normalize("NFC", v).casefold()))

    t = F.when(c.rlike(r"^\p{ASCII}*$"), F.lower(c)).otherwise(folded(c))
    steps = F.filter(F.split(F.regexp_replace(t, r"\\", "/"), "/"), lambda s: (s != "") & (s != "."))
    return F.array_join(steps, "/")


def scan_is_authoritative(jobs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, verdict of what a scan may say of each key with jobs (keys, order, state, terminal): live while any job runs, superseded where
    the latest one completed, failed where it failed, so that its target is no evidence."""
    x = jobs.groupBy(*keys).agg(F.bool_or(~F.col("terminal")).alias("live"), F.max(F.struct("order", "state")).alias("last"))
    return x.select(*keys, F.when(F.col("live"), "live").when(F.col("last.state") == "completed", "superseded").when(F.col("last.state") == "failed", "failed").otherwise("free").alias("verdict"))
