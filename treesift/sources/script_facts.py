"""JavaScript and TypeScript texts as fact rows: calls, constructions, constants, strings.

A tolerant token reader, scoped to what the rules look at: it knows comments, the three quotes,
template holes, regular expressions and brackets. Brackets without a partner make a text unparseable,
unless their line has tags or a slash: there they can be text or part of a pattern.
"""

from __future__ import annotations

import bisect
import re
from pyspark.sql import DataFrame

from treesift.sources.batches import rows_from_texts

ARGUMENT = (
    "struct<text:string,kind:string,quote:string,content:string,hole:string,keys:array<string>,"
    "last_key:string,guarded:boolean>"
)
FACTS = (
    "path string, fact string, line bigint, col bigint, name string, snippet string,"
    f" args array<{ARGUMENT}>, messages array<string>"
)
COLUMNS = ["path", "fact", "line", "col", "name", "snippet", "args", "messages"]

_TOKEN = re.compile(
    r"""(?P<space>\s+|//[^\n]*|/\*.*?\*/)
    |(?P<word>[A-Za-z_$#][\w$]*)
    |(?P<number>\d[\w.]*)
    |(?P<string>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
    |(?P<punct>=>|\?\.(?!\d)|\.\.\.|[()\[\]{}]|.)""",
    re.S | re.X,
)
# The same token with the white space and comments before it; what they have taken they keep.
_NEXT = re.compile(
    r"""(?:\s++|//[^\n]*+|/\*.*?\*/)*+(?:
    (?P<word>[A-Za-z_$#][\w$]*+)
    |(?P<string>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
    |(?P<number>\d[\w.]*+)
    |(?P<aside>[`/])
    |(?P<punct>=>|\?\.(?!\d)|\.\.\.|.))""",
    re.S | re.X,
)
_ASIDE = _NEXT.groupindex["aside"]
_KINDS = [None, *_NEXT.groupindex]
_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_BEFORE_REGEX = set("(,=:[!&|?{};+-*%<>~^") | {"return", "typeof", "case", "=>", "in", "of", ""}
_NO_CALLEE = {"new", "if", "for", "while", "switch", "catch", "return", "typeof", "function", "await", "with", "super"}
Wanted = dict[str, re.Pattern]
_CLOSE = {")": "(", "]": "[", "}": "{"}


_STRAY = "\0"
_OPEN = frozenset(_CLOSE.values())
_BRACKETS = _OPEN | _CLOSE.keys()
_HEADS = frozenset(["(", "{", "const"])
# Text between tags holds none of these but as its ends.
_ENDS_TEXT = frozenset("<>{};")


class _Unbalanced(ValueError):
    pass


def _template(text: str, start: int) -> tuple[int, list[tuple[int, int]]]:
    """End of a template literal and the spans of its holes."""
    at, holes = start + 1, []
    while at < len(text):
        if text[at] == "\\":
            at += 2
        elif text[at] == "`":
            return at + 1, holes
        elif text.startswith("${", at):
            end = _hole_end(text, at + 2)
            holes.append((at + 2, end))
            at = end + 1
        else:
            at += 1
    raise _Unbalanced


def _hole_end(text: str, at: int) -> int:
    depth = 0
    while at < len(text):
        ch = text[at]
        if ch == "`":
            at, _ = _template(text, at)
            continue
        if ch in "\"'":
            found = _TOKEN.match(text, at)
            at = found.end()
            continue
        if ch == "}" and depth == 0:
            return at
        depth += (ch == "{") - (ch == "}")
        at += 1
    raise _Unbalanced


def _tokens(text: str, start: int, end: int) -> tuple[list[tuple[str, int, int]], list[str]]:
    """``(kind, start, end)`` without white space and comments, and the text of each."""
    out, words, at = [], [], start
    while at < end:
        # Runs of plain tokens are read in one loop; it ends at a mark that needs a look at what is before or after it.
        for found in iter(_NEXT.scanner(text, at).match, None):
            group = found.lastindex
            s, e = found.span(group)
            if s >= end:
                return out, words
            if group == _ASIDE:
                break
            out.append((_KINDS[group], s, e))
            words.append(found[group])
        else:
            break
        kind, at = "punct", s + 1
        if text[s] == "`":
            try:
                kind, at = "template", _template(text, s)[0]
            except _Unbalanced:  # text between tags, say: a mark like any other
                pass
        elif (words[-1] if words else "") in _BEFORE_REGEX and not text.startswith("/*", s):
            found = _REGEX.match(text, s)
            if found:
                kind, at = "regex", found.end()
        out.append((kind, s, at))
        words.append(text[s:at])
    return out, words


class _Script:
    def __init__(self, text: str, wanted: Wanted | None):
        self.text = text
        self.wanted = wanted
        self.breaks = [m.start() for m in re.finditer("\n", text)]
        self.out: list[dict] = []
        self.lines: set[int] = set()  # rows with facts
        self.broken = False
        self.messages: set[str] = set()
        self.read(0, len(text))

    def read(self, start: int, end: int) -> None:
        tokens, words = _tokens(self.text, start, end)
        partner: dict[int, int] = {}
        stack: list[int] = []
        waiting = dict.fromkeys(_OPEN, 0)  # openers in the stack by kind
        ends = [i for i, word in enumerate(words) if word in _ENDS_TEXT]
        view = (tokens, words, partner)
        for i in [i for i, word in enumerate(words) if word in _BRACKETS]:
            word = words[i]
            if word in _OPEN:
                stack.append(i)
                waiting[word] += 1
            else:
                # A closer pairs with its nearest opener. Openers above that one, and closers without
                # any, can be text between tags, or a pattern read as a division.
                opener = _CLOSE[word]
                if waiting[opener]:
                    while words[stack[-1]] != opener:
                        waiting[words[stack[-1]]] -= 1
                        self.stray(view, ends, stack.pop())
                    waiting[opener] -= 1
                    partner[i] = stack[-1]
                    partner[stack.pop()] = i
                else:
                    self.stray(view, ends, i)
        for i in stack:
            self.stray(view, ends, i)
        for i, word in enumerate(words):
            if word in _HEADS:
                if word == "(":
                    if i:
                        self.call(view, i)
                elif word == "{":
                    self.message(view, i)
                else:
                    self.constant(view, i)
            elif word[0] in "\"'" and tokens[i][0] == "string":
                if self.wants("string", word[1:-1]):
                    self.add("string", tokens[i][1], None, [self.value(view, i, i + 1)])
            elif word[0] == "`" and tokens[i][0] == "template" and "${" in word:
                for hole in _template(self.text, tokens[i][1])[1]:
                    self.read(*hole)

    def stray(self, view, ends: list[int], i: int) -> None:
        """A bracket without a partner: text between tags, or a pattern on a line with a slash, else a broken file."""
        tokens, words, _ = view
        between = self.between_tags(words, ends, i)
        words[i] = _STRAY
        row = bisect.bisect_left(self.breaks, tokens[i][1])
        line = self.text[self.breaks[row - 1] + 1 if row else 0 : self.breaks[row] if row < len(self.breaks) else None]
        self.broken = self.broken or not (between or "/" in line or ("<" in line and ">" in line))

    def between_tags(self, words: list[str], ends: list[int], i: int) -> bool:
        """Whether a tag or an expression in braces ends before the token and one begins after it, with nothing
        but text between, and one of both is a tag."""
        at = bisect.bisect_left(ends, i)
        after = at + (at < len(ends) and ends[at] == i)
        if not at or after == len(ends):
            return False
        first, last = ends[at - 1], ends[after]
        opens = words[last] == "<" and last + 1 < len(words) and (words[last + 1] in ("/", ">") or words[last + 1][0].isalpha())
        closes = words[first] == ">" and first > 0 and words[first - 1] != "="
        return (closes and words[last] == "{") or (opens and words[first] == "}") or (closes and opens)

    def wants(self, fact: str, shown: str) -> bool:
        return self.wanted is None or (fact in self.wanted and self.wanted[fact].search(shown) is not None)

    def add(self, fact: str, at: int, name: str | None, args: list[dict]) -> None:
        row = bisect.bisect_left(self.breaks, at)
        before = self.breaks[row - 1] if row else -1
        self.lines.add(row)
        self.out.append(
            {
                "fact": fact,
                "line": row + 1,
                "col": at - before,
                "name": name,
                "snippet": None,
                "args": args,
            }
        )

    def line_rows(self) -> list[dict]:
        """The text of each line with facts, once; facts carry its number only."""
        ends = [*self.breaks, len(self.text)]
        rows = []
        for row in sorted(self.lines):
            start = self.breaks[row - 1] + 1 if row else 0
            shown = self.text[start : ends[row]].strip()
            rows.append(dict.fromkeys(COLUMNS) | {"fact": "line", "line": row + 1, "snippet": shown})
        return rows

    def call(self, view, i: int) -> None:
        tokens, words, partner = view
        start = i
        while start:
            before = start - 1
            if words[before] in (")", "]"):
                start = partner[before]
            elif tokens[before][0] == "word" and words[before] not in _NO_CALLEE:
                start = before
            else:
                break
            if start and words[start - 1] in (".", "?."):
                start -= 1
            elif words[start] in ("(", "["):
                continue
            else:
                break
        if start == i or (start and words[start - 1] == "function"):
            return
        name = self.text[tokens[start][1] : tokens[i - 1][2]]
        new = start > 0 and words[start - 1] == "new"
        if not self.wants("new" if new else "call", name):
            return
        args = [self.value(view, a, b) for a, b in self.split(view, i)]
        at = tokens[start - 1][1] if new else tokens[start][1]
        self.add("new" if new else "call", at, name, args)

    def split(self, view, opening: int) -> list[tuple[int, int]]:
        """Token spans between the top-level commas of a bracket pair."""
        _, words, partner = view
        spans, i, first = [], opening + 1, opening + 1
        while i < partner[opening]:
            if words[i] in ("(", "[", "{"):
                i = partner[i]
            elif words[i] == ",":
                spans.append((first, i))
                first = i + 1
            i += 1
        return [*spans, (first, i)] if i > first else spans

    def value(self, view, a: int, b: int) -> dict:
        tokens, words, partner = view
        kind, s, _ = tokens[a]
        out = {
            "text": self.text[s : tokens[b - 1][2]],
            "kind": None,
            "quote": None,
            "content": None,
            "hole": None,
            "keys": [],
            "last_key": None,
            "guarded": False,
        }
        if b == a + 1 and kind == "string":
            out["kind"], out["quote"], out["content"] = "string", words[a][0], words[a][1:-1]
        elif b == a + 1 and kind == "template":
            holes = _template(self.text, s)[1] if "${" in words[a] else []
            out["kind"], out["quote"] = "template", "`"
            if holes:
                out["hole"] = self.text[slice(*holes[0])].strip()
            else:
                out["content"] = words[a][1:-1]
        elif words[a] == "{" and partner[a] == b - 1:
            spans = self.split(view, a)
            keyed = [(x, y) for x, y in spans if y - x > 2 and words[x + 1] == ":"]
            out |= {"kind": "object", "keys": [words[x].strip("\"'") for x, _ in keyed]}
            if keyed and keyed[-1] == spans[-1]:
                x, y = keyed[-1]
                out |= {"last_key": words[x].strip("\"'")} | self.handler(view, x + 2, y)
        return out

    def handler(self, view, a: int, b: int) -> dict:
        """Whether an arrow function with a block body opens with a guard that more follows."""
        _, words, partner = view
        a += words[a] == "async"
        if words[a] != "(" or words[partner[a] + 1 : partner[a] + 3] != ["=>", "{"]:
            return {"last_key": None}
        body = partner[a] + 2
        if partner[body] != b - 1 or partner[body] == body + 1:
            return {"last_key": None}
        i = body + 1
        if words[i] != "if" or words[i + 2] != "!":
            return {"guarded": False}
        i = partner[i + 1] + 1
        if words[i] == "{":
            i = partner[i] + 1
        elif words[i] in ("throw", "return"):
            while i < partner[body] and words[i] != ";":
                i = partner[i] + 1 if words[i] in ("(", "[", "{") else i + 1
            i += 1
        else:
            return {"guarded": False}
        return {"guarded": i < partner[body]}

    def constant(self, view, i: int) -> None:
        tokens, words, partner = view
        if i + 3 >= len(words) or tokens[i + 1][0] != "word" or words[i + 2] != "=":
            return
        kind, s, e = tokens[i + 3]
        if kind in ("string", "template"):
            follow = words[i + 4] if i + 4 < len(words) else ";"
            newline = i + 4 >= len(words) or "\n" in self.text[e : tokens[i + 4][1]]
            if not self.wants("const", words[i + 1]):
                return
            if follow == ";" or (newline and follow not in ("+", ".", "?", "[", "(")):
                self.add("const", tokens[i][1], words[i + 1], [self.value(view, i + 3, i + 4)])
        elif words[i + 3 : i + 5] == ["tool", "("] and self.wants("tool", words[i + 1]):
            args = [self.value(view, a, b) for a, b in self.split(view, i + 4)]
            self.add("tool", tokens[i][1], words[i + 1], args)

    def message(self, view, i: int) -> None:
        """The content of a two-key object whose role is the user."""
        tokens, words, partner = view
        pairs = {}
        for a, b in self.split(view, i):
            if b - a < 3 or words[a + 1] != ":":
                return
            pairs[words[a]] = self.text[tokens[a + 2][1] : tokens[b - 1][2]]
        if set(pairs) == {"role", "content"} and pairs["role"] in ('"user"', "'user'"):
            self.messages.add(pairs["content"])


def facts_of(text: str, wanted: Wanted | None = None) -> list[dict]:
    try:
        script = _Script(text, wanted)
    except (_Unbalanced, RecursionError, IndexError):
        return [dict.fromkeys(COLUMNS) | {"fact": "unparseable"}]
    messages = sorted(script.messages)
    if script.broken:
        return [dict.fromkeys(COLUMNS) | {"fact": "unparseable"}]
    rows = [row | {"messages": messages if row["fact"] == "const" else []} for row in script.out]
    return rows + script.line_rows()


def facts(files: DataFrame, wanted: dict[str, str] | None = None) -> DataFrame:
    """Facts of script files (columns ``path`` and ``text``), one narrow pass over the texts.

    A fact names its line by number; the line's text is a row of its own (``fact`` is ``line``), so that the rows
    of a file are no larger than its text, however many facts share a line.

    With ``wanted``, of each kind only facts are built whose name (of a string: its content) the kind's pattern finds.
    """
    if wanted is None:
        return rows_from_texts(files, facts_of, FACTS)

    def read(text: str) -> list[dict]:
        # A worker compiles each pattern once and keeps it.
        return facts_of(text, {fact: re.compile(pattern) for fact, pattern in wanted.items()})

    return rows_from_texts(files, read, FACTS)
