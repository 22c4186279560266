"""Position arithmetic on whole texts, as JVM-side column expressions.

Offsets are 1-based and count characters. They come from ``locate``/``split``/``length``, which
count code points; ``regexp_instr`` counts UTF-16 units and is not used for positions.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from treesift.model import literal

NEWLINE = "\n"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``.

    A plain Python variable would paste the whole expression at every use, and lambda-based
    expressions are not shared by the code generator; a lambda's own variable is.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def newline_count(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(NEWLINE), F.lit("")))


def line_at(text: Column, offset: Column) -> Column:
    """1-based line of a character offset."""
    return (newline_count(F.left(text, offset - 1)) + 1).cast("bigint")


def column_at(text: Column, offset: Column) -> Column:
    """1-based column of a character offset, counting characters."""
    tail = F.substring_index(F.left(text, offset - 1), NEWLINE, -1)
    return (F.length(tail) + 1).cast("bigint")


def regex_offset(text: Column, pattern: str) -> Column:
    """Offset of the first match, or NULL; correct beyond the basic multilingual plane."""
    before = F.get(F.split(text, pattern, 2), F.lit(0))
    return F.when(F.regexp_like(text, F.lit(pattern)), F.length(before) + 1)


def strip(text: Column) -> Column:
    """Trim all white space, not only blanks."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def lines(text: Column) -> Column:
    """Lines without their ends; a final line end does not open another line."""
    body = F.regexp_replace(text, r"\r?\n\z", "")
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(
        F.split(body, r"\r?\n")
    )


def snippet(text: Column, line: Column | int) -> Column:
    """The text of a line, trimmed; empty when there is no such line."""
    upto = F.call_function("substring_index", text, F.lit(NEWLINE), literal(line).cast("int"))
    part = F.substring_index(upto, NEWLINE, -1)
    return F.when(newline_count(text) + 1 >= literal(line), strip(part)).otherwise(F.lit(""))


def find_from(needle: Column, text: Column, start: Column | int) -> Column:
    return F.call_function("locate", needle, text, literal(start).cast("int"))


def locate_line(text: Column, needle: Column | str) -> Column:
    """Line of the first occurrence of ``needle``, or 1 when it does not occur."""
    offset = find_from(literal(needle), text, 1)
    return F.when(offset > 0, line_at(text, offset)).otherwise(F.lit(1)).cast("bigint")


def locate_line_after(text: Column, anchor: Column, needle: Column | str) -> Column:
    """Line of the first ``needle`` on or after the first line holding ``anchor``."""
    before_anchor = F.left(text, F.greatest(find_from(anchor, text, 1) - 1, F.lit(0)))
    tail_length = F.length(F.substring_index(before_anchor, NEWLINE, -1))
    line_start = F.length(before_anchor) - tail_length + 1
    offset = find_from(literal(needle), text, line_start)
    return (
        F.when(offset > 0, line_at(text, offset))
        .otherwise(locate_line(text, needle))
        .cast("bigint")
    )


def utf8(content: Column) -> Column:
    """Bytes as text, or NULL when they are not valid UTF-8."""
    return F.try_validate_utf8(content.cast("string"))


# The generated-file test.
GENERATED_MIN_BYTES = 1024
GENERATED_MEAN_LINE_BYTES = 500


def generated_measurement(content: Column) -> Column:
    """``struct(mean, size)`` when the bytes read like generated code, else NULL.

    The mean is bytes per line over the whole file. Invalid UTF-8 is never called generated.
    """
    size = F.octet_length(content)
    as_text = content.cast("string")
    whole = F.is_valid_utf8(as_text)
    mean = F.expr("0").cast("bigint") + F.floor(size / (newline_count(as_text) + 1))
    return F.when(
        (size >= GENERATED_MIN_BYTES) & whole & (mean >= GENERATED_MEAN_LINE_BYTES),
        F.struct(mean.cast("bigint").alias("mean"), size.cast("bigint").alias("size")),
    )


def generated_reason(measurement: Column) -> Column:
    return F.format_string(
        "minified, %d bytes per line on average over %d bytes",
        measurement["mean"],
        measurement["size"],
    )


# Invisible code points. The class holds the real characters, because an escape
# would be consumed by SQL string parsing on the way to the regex engine.
HIDDEN_NAMES = {
    "\u200b": "U+200B ZERO WIDTH SPACE",
    "\u200c": "U+200C ZERO WIDTH NON-JOINER",
    "\u200d": "U+200D ZERO WIDTH JOINER",
    "\u2063": "U+2063 INVISIBLE SEPARATOR",
    "\ufeff": "U+FEFF ZERO WIDTH NO-BREAK SPACE",
    "\u202a": "U+202A LEFT-TO-RIGHT EMBEDDING",
    "\u202b": "U+202B RIGHT-TO-LEFT EMBEDDING",
    "\u202c": "U+202C POP DIRECTIONAL FORMATTING",
    "\u202d": "U+202D LEFT-TO-RIGHT OVERRIDE",
    "\u202e": "U+202E RIGHT-TO-LEFT OVERRIDE",
}
HIDDEN_TAG_NAME = "a Unicode tag character (U+E0001-U+E007F)"
HIDDEN_CLASS = "[\u200b\u200c\u200d\u2063\ufeff\u202a-\u202e\U000e0001-\U000e007f]"


def hidden_characters(text: Column) -> Column:
    """``struct(count, offset, name)`` of invisible characters, or NULL when there are none.

    A byte-order mark that opens the text is an encoding mark, so it is masked, which also keeps
    every column number unchanged.
    """

    def describe(body: Column) -> Column:
        return let(F.regexp_substr(body, F.lit(HIDDEN_CLASS)), lambda first: found(body, first))

    def found(body: Column, first: Column) -> Column:
        name = F.lit(HIDDEN_TAG_NAME)
        for character, label in HIDDEN_NAMES.items():
            name = F.when(first == character, F.lit(label)).otherwise(name)
        return F.when(
            first.isNotNull(),
            F.struct(
                F.regexp_count(body, F.lit(HIDDEN_CLASS)).cast("bigint").alias("count"),
                # The first occurrence of the first hidden character is where it all starts.
                find_from(first, body, 1).cast("bigint").alias("offset"),
                name.alias("name"),
            ),
        )

    # Most texts hold none: one scan decides, before anything is copied.
    return F.when(
        text.rlike(HIDDEN_CLASS), let(F.regexp_replace(text, "^\ufeff", "x"), describe)
    )


def phrase_pattern(phrase: str) -> str:
    """A phrase as a regex: case is ignored and any run of white space matches a blank."""
    words = [_quote(word) for word in phrase.split()]
    return "(?i)" + r"(?U:\s+)".join(words)


def _quote(word: str) -> str:
    return "".join(ch if ch.isalnum() else "\\" + ch for ch in word)


def phrase_scan(text: Column, phrases: tuple[str, ...]) -> Column:
    """``struct(count, offset, phrase)`` over a phrase list, or NULL when none occurs.

    Counts every phrase separately, so overlapping phrases each count; the phrase reported is the
    earliest in the text and, at one offset, the earliest in the list. One alternation decides
    whether the per-phrase work happens at all.
    """
    patterns = [phrase_pattern(p) for p in phrases]
    any_phrase = "(?i)" + "|".join(p.removeprefix("(?i)") for p in patterns)
    # A plain search for the longest word of each phrase is far cheaper than the alternation and
    # never misses: a text without the word cannot hold the phrase.
    words = sorted({max(phrase.split(), key=len).strip(":") for phrase in phrases})
    likely = let(
        F.lower(text),
        lambda lowered: functools.reduce(
            lambda a, b: a | b, [lowered.contains(word) for word in words]
        ),
    )
    count = sum((F.regexp_count(text, F.lit(p)) for p in patterns), F.lit(0))
    hits = F.array(
        *[
            F.struct(
                regex_offset(text, pattern).alias("offset"),
                F.lit(index).alias("index"),
                F.lit(phrase).alias("phrase"),
            )
            for index, (pattern, phrase) in enumerate(zip(patterns, phrases, strict=True))
        ]
    )
    earliest = F.array_min(F.filter(hits, lambda h: h["offset"].isNotNull()))
    return F.when(
        likely & F.regexp_like(text, F.lit(any_phrase)),
        F.struct(
            count.cast("bigint").alias("count"),
            earliest["offset"].cast("bigint").alias("offset"),
            earliest["phrase"].alias("phrase"),
        ),
    )


def contains_identifier(text: Column, names: tuple[str, ...]) -> Column:
    """Whether any of the names occurs as a whole identifier."""
    body = "|".join(_quote(n) for n in names)
    return F.regexp_like(text, F.lit(rf"(?<!\w)(?:{body})(?!\w)"))
