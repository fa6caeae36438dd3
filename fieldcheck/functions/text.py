"""Secret, redaction and failure-log rules as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and marker texts the audit rules are defined by.
PRIVATE_KEY = "-----BEGIN PRIVATE KEY-----"
ASSIGNED_SECRET = (
    r"(?i)(?:api[_-]?key|access[_-]?token|password|secret)"
    r"\s*[\"']?\s*[:=]\s*[\"']([^\"'\r\n]{8,})[\"']"
)
SENSITIVE_KEY = r"(?i)(^|_)(api_?key|key|token|secret|password|authorization)($|_)"
LAUNCH_MARKERS = ("no such file or directory", "permission denied", "exec format error")
BINARY_MARKERS = (
    "library not loaded",
    "symbol not found",
    "wrong architecture",
    "numpy.dtype size changed",
)
PROVIDER_MARKERS = (
    "http 502",
    "http error 502",
    "bad gateway",
    "service unavailable",
    "connectionerror",
    "connection refused",
    "connection reset",
    "temporary failure in name resolution",
    "name or service not known",
    "invalid api key",
    "http error 401",
    "401 client error",
    "http error 403",
    "403 client error",
)
POLICY_MARKERS = (
    "evaluation output policy differs from the generation-visible pipeline policy",
    "shared public output policy hash mismatch",
    "family_pipeline_interface.v3 requires a zarr output policy",
)


def any_of(text: Column, needles: Sequence[str]) -> Column:
    out = F.lit(False)
    for needle in needles:
        out = out | text.contains(needle)
    return out


# Suffixes of files that are scanned as text, and names of store metadata, scanned as well.
TEXT_SUFFIXES = (".cfg", ".env", ".ini", ".json", ".log", ".md", ".py", ".sh", ".toml", ".txt", ".yaml", ".yml")
STORE_METADATA = (".zattrs", ".zgroup", ".zmetadata", "zarr.json")


def is_scanned(path: Column) -> Column:
    """Whether a path is one of a text, by its suffix, or of a store's metadata, by its name."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.lower(F.regexp_extract(name, r"[^.](\.[A-Za-z0-9]+)$", 1)).isin(*TEXT_SUFFIXES) | name.isin(*STORE_METADATA)


def secret_reason(text: Column, known: Sequence[str]) -> Column:
    """First rule that holds; the text itself is never returned."""
    return (
        F.when(any_of(text, known), "known_environment_secret")
        .when(text.contains(PRIVATE_KEY), "private_key_material")
        .when(text.rlike(ASSIGNED_SECRET), "assigned_secret_like_value")
        .otherwise("clean")
    )


def longest_first(values: Sequence[str]) -> list[str]:
    return sorted(set(values), key=lambda v: (-len(v), v))


def redacted(text: Column, secrets: Sequence[str], mask: str = "<redacted>") -> Column:
    for secret in longest_first(secrets):
        text = F.replace(text, F.lit(secret), F.lit(mask))
    return text


def redaction_count(text: Column, secrets: Sequence[str], mask: str = "<redacted>") -> Column:
    """Replacements made, from the length lost at each step."""
    total = F.lit(0)
    for secret in longest_first(secrets):
        without = F.replace(text, F.lit(secret), F.lit(""))
        total = total + ((F.length(text) - F.length(without)) / len(secret)).cast("long")
        text = F.replace(text, F.lit(secret), F.lit(mask))
    return total


def failure_class(log: Column, launched: Column, timed_out: Column, runs_pytest: Column) -> Column:
    """Owner of a failed run by ordered markers in its log."""
    text = F.lower(log)
    absent = F.regexp_extract(text, r"no module named ['\"]?([a-zA-Z0-9_.-]+)", 1)
    return (
        F.when(~launched & ~timed_out & any_of(text, LAUNCH_MARKERS), "harness")
        .when((F.split_part(absent, F.lit("."), F.lit(1)) == "pytest") & runs_pytest, "environment")
        .when(any_of(text, BINARY_MARKERS), "environment")
        .when(any_of(text, PROVIDER_MARKERS), "provider")
        .when(any_of(text, POLICY_MARKERS), "policy")
        .otherwise("candidate")
    )
