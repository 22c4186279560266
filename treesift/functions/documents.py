"""JSON, YAML and TOML texts as one canonical JSON string.

The only Python in the configuration analysers: everything that reads the document afterwards is
a JVM expression over the JSON (``parse_json``, ``variant_get``). NULL in, NULL out, so callers
pass the text of claimed files only and the other rows cost nothing.
"""

from __future__ import annotations

import json
import re
import tomllib

import pandas as pd
import yaml
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treesift.functions.paths import file_name


class _Loader(getattr(yaml, "CSafeLoader", yaml.SafeLoader)):
    """YAML 1.2 scalars: only true/false are booleans, and timestamps stay text."""


_Loader.yaml_implicit_resolvers = {
    first: [
        (tag, pattern)
        for tag, pattern in resolvers
        if tag not in ("tag:yaml.org,2002:bool", "tag:yaml.org,2002:timestamp")
    ]
    for first, resolvers in _Loader.yaml_implicit_resolvers.items()
}
_Loader.add_implicit_resolver(
    "tag:yaml.org,2002:bool", re.compile(r"^(?:true|True|TRUE|false|False|FALSE)$"), list("tTfF")
)

_READERS = {
    "json": json.loads,
    "yaml": lambda text: yaml.load(text, Loader=_Loader),
    "toml": tomllib.loads,
}


@F.pandas_udf(T.StringType())
def _canonical(kinds: pd.Series, texts: pd.Series) -> pd.Series:
    def one(kind: str | None, text: str | None) -> str | None:
        if kind is None or text is None:
            return None
        try:
            return json.dumps(_READERS[kind](text), default=str)
        except (ValueError, yaml.YAMLError, RecursionError):
            return None

    return pd.Series([one(k, t) for k, t in zip(kinds, texts, strict=True)], dtype=object)


def document_format(path: Column) -> Column:
    extension = F.lower(F.substring_index(file_name(path), ".", -1))
    return (
        F.when(extension == "json", "json")
        .when(extension.isin("yaml", "yml"), "yaml")
        .when(extension == "toml", "toml")
    )


def canonical_json(kind: Column, text: Column) -> Column:
    """The document as JSON text, or NULL when it does not parse (or was not asked for).

    JSON that the engine itself parses stays as it is; Python reads YAML and TOML, and JSON with
    repeated members or constants that only Python accepts.
    """
    # The engine's reader stops after the first value. In a list, a mark behind the text that the text cannot
    # foresee shows that it is one value and nothing follows: one parse.
    mark = F.concat(F.lit("m"), F.xxhash64(text).cast("string"))
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"'), mark, F.lit('"]')))
    follows = F.try_variant_get(listed, "$[1]", "string") == mark
    alone = F.coalesce(follows, F.lit(False)) & F.try_variant_get(listed, "$[2]", "variant").isNull()
    native = F.when((kind == "json") & alone, text)
    # Neither kind nor text of native rows travel to Python.
    rest = native.isNull()
    return F.coalesce(native, _canonical(F.when(rest, kind), F.when(rest, text)))


def member(document: Column, path: str, kind: str = "string") -> Column:
    """A member of a variant, or NULL when it is missing or of another shape."""
    return F.try_variant_get(document, path, kind)


def is_string(document: Column) -> Column:
    return F.coalesce(F.schema_of_variant(document) == "STRING", F.lit(False))
