"""Names, types and identities as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extension and media type.
MEDIA = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "csv": "text/csv", "json": "application/json", "html": "text/html", "txt": "text/plain"}


def safe_stem(name: Column, default: str = "signal") -> Column:
    """Runs outside [A-Za-z0-9._-] become _, ends are trimmed of _."""
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(name, r"[^A-Za-z0-9._-]+", "_"), r"^_+|_+$", ""), F.lit("")), F.lit(default))


def clean_file_name(name: Column, default: str = "upload") -> Column:
    """Reserved characters become -, white space one blank; trimmed, at most 160 characters."""
    spaced = F.regexp_replace(F.regexp_replace(name, r'[<>:"/\\|?*]', "-"), r"\s+", " ")
    return F.coalesce(F.nullif(F.substring(F.trim(spaced), 1, 160), F.lit("")), F.lit(default))


def media_type(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    out = F.lit("application/octet-stream")
    for k, v in MEDIA.items():
        out = F.when(ext == k, v).otherwise(out)
    return out


def identity(*parts: Column) -> Column:
    """sha256 of the parts joined by a colon."""
    return F.sha2(F.concat_ws(":", *(p.cast("string") for p in parts)), 256)


def ancestry(ids: Column) -> Column:
    """Distinct sorted parents of ids that join parents by +."""
    return F.array_sort(F.array_distinct(F.flatten(F.transform(ids, lambda i: F.split(i, r"\+")))))


def signature(keys: dict[str, Column]) -> Column:
    """Canonical JSON over fixed keys in order; a missing value is null."""
    return F.to_json(F.struct(*(v.alias(k) for k, v in sorted(keys.items()))), {"ignoreNullFields": "false"})
