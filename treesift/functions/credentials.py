"""Judging keys and values: is this text a credential somebody committed?

Two families. The tool-server checks ask for a credential word in the key *and* a secret-shaped
value. The configuration checks (dotenv, image, compose, source) ask for a credential-named key
and any value that is not evidently a placeholder, and grade the value. Thresholds that no public
test pins are marked as chosen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from treesift.functions.text import strip

# Words that make a tool-server environment key a credential.
KEY_WORDS = (
    "key",
    "keys",
    "token",
    "tokens",
    "secret",
    "secrets",
    "password",
    "passwords",
    "passwd",
    "pwd",
    "credential",
    "credentials",
    "apikey",
)
# Vendor prefixes of live secrets.
SECRET_PREFIXES = ("sk-", "sk_live_", "ghp_", "gho_", "github_pat_", "AKIA", "xox", "AIza")
# Placeholder words of the tool-server check.
PLACEHOLDERS = ("changeme", "xxx", "todo", "example")
HIGH_ENTROPY_RUN = 24

# Chosen values for the configuration checks.
CREDENTIAL_NAME = r"(?i)(password|passwd|pwd|secret|token|credential|api[_-]?key|access[_-]?key|private[_-]?key)"
PROVIDER_KEY = r"^sk-[A-Za-z0-9_-]{16,}$"
PROVIDER_PLACEHOLDER = (
    r"(?i)(your[-_]|replace|placeholder|example|dummy|change[-_]?me|insert|redacted|scrubbed|masked|xxxx)"
)
VALUE_PLACEHOLDER = (
    r"(?i)^(change[-_]?me|todo|xxx+|example|placeholder|dummy|replace[-_]?me|your[-_].*|\[?redacted\]?"
    r"|\[?scrubbed\]?|\[?masked\]?|none|null|nil|true|false|yes|no|on|off"
    r"|local|dev|development|test|testing|staging|prod|production|env|auto|default|disabled|enabled)$"
)
VALUE_REFERENCE = r"^(\$.*|\{\{.*\}\}|<.*>|%.*%)$"
VALUE_PATH = r"^(~|\.{1,2})?/"
VALUE_NUMBER = r"^[0-9]+(\.[0-9]+)?$"


def key_words(key: Column) -> Column:
    """Lower-case words of an identifier, split at ``_``, ``-``, blanks and camel humps."""
    humps = F.regexp_replace(key, r"(?<=\p{Ll})(?=\p{Lu})", "_")
    return F.filter(F.split(F.lower(humps), r"[_\- ]+"), lambda w: w != "")


def key_suggests_secret(key: Column) -> Column:
    return F.arrays_overlap(key_words(key), F.array(*[F.lit(w) for w in KEY_WORDS]))


def is_placeholder(value: Column) -> Column:
    v = strip(value)
    return (
        (v == "")
        | v.rlike(r"^\$\{.*\}$")
        | v.rlike(r"^\$[A-Za-z0-9_]+$")
        | v.rlike(r"^<.*>$")
        | F.lower(v).isin(*PLACEHOLDERS)
        | F.lower(v).rlike(r"^x+$")
    )


def has_entropy_run(value: Column) -> Column:
    """A run of 24 or more word characters that mixes letters and digits."""
    run = rf"[A-Za-z0-9_-]{{{HIGH_ENTROPY_RUN},}}"
    runs = F.regexp_extract_all(value, F.lit(f"({run})"), F.lit(1))
    return F.exists(runs, lambda r: r.rlike("[0-9]") & r.rlike("[A-Za-z]"))


def looks_secret(value: Column) -> Column:
    v = strip(value)
    prefixed = F.lit(False)
    for prefix in SECRET_PREFIXES:
        prefixed = prefixed | v.startswith(prefix)
    return prefixed | has_entropy_run(v)


def is_plausible_secret(key: Column, value: Column) -> Column:
    return key_suggests_secret(key) & ~is_placeholder(value) & looks_secret(value)


def is_provider_key(value: Column) -> Column:
    return value.rlike(PROVIDER_KEY) & ~value.rlike(PROVIDER_PLACEHOLDER)


def is_credential_key(key: Column) -> Column:
    return key.rlike(CREDENTIAL_NAME)


def is_hardcoded_value(value: Column) -> Column:
    v = strip(value)
    return (
        (v != "")
        & ~v.rlike(VALUE_REFERENCE)
        & ~v.rlike(VALUE_PLACEHOLDER)
        & ~v.rlike(VALUE_PATH)
        & ~v.rlike(VALUE_NUMBER)
    )


def credential_severity(value: Column) -> Column:
    """Generated-looking values are critical, human passwords high."""
    return F.when(looks_secret(value), F.lit("critical")).otherwise(F.lit("high"))
