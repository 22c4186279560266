"""Hidden characters in agent instruction files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from treesift import rulebook
from treesift.functions.text import column_at, hidden_characters, let, line_at, snippet
from treesift.model import finding, only_if


def findings(path: Column, text: Column) -> Column:
    """One finding per file, at the first hidden character."""

    def report(hit: Column) -> Column:
        line = line_at(text, hit["offset"])
        return only_if(
            hit.isNotNull(),
            finding(
                rulebook.HIDDEN_UNICODE,
                file=path,
                line=line,
                column=column_at(text, hit["offset"]),
                snippet=snippet(text, line),
                description=F.format_string(
                    "%d hidden character(s), the first being %s. "
                    + rulebook.HIDDEN_UNICODE.description,
                    hit["count"],
                    hit["name"],
                ),
            ),
        )

    return let(hidden_characters(text), report)
