"""What a sliced value is made of: closed, quoted, constant, from outside, and from where.

A slice is a set of leaves with the steps between leaf and value. Every property is a test that
no leaf violates, written as one pattern over the leaf's steps: steps the property passes through
are stripped from the outside, and what is then found first decides.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Callees and attributes with a meaning of their own.
CLOSED_ATTRIBUTES = ("__name__", "__class__", "__qualname__", "__module__")
SHELL_QUOTE = ("shlex.quote", "shlex.join")
CLOSED_WRAPPERS = ("Path", "pathlib.Path", "str")
PATH_FUNCTIONS = (
    "os.path.dirname",
    "os.path.abspath",
    "os.path.realpath",
    "os.path.normpath",
    "os.path.join",
    "os.getcwd",
    "Path",
    "pathlib.Path",
    "str",
)
TEMPORARY = (
    "tempfile.mkdtemp",
    "tempfile.gettempdir",
    "tempfile.mkstemp",
    "tempfile.TemporaryDirectory",
)
STDIN_READS = ("sys.stdin.read", "input")

# Callees that produce untrusted values. Qualified names match as whole dotted
# tails, bare names only without a dot, methods only as the last segment after a dot.
SOURCES = {
    "model_output": {
        "qualified": (
            "chat.completions.create",
            "chat.completions.parse",
            "completions.create",
            "responses.create",
            "responses.parse",
            "ChatCompletion.create",
            "ChatCompletion.acreate",
            "Completion.create",
            "messages.create",
            "messages.stream",
            "beta.messages.create",
            "models.generate_content",
            "GenerativeModel.generate_content",
            "chat.complete",
            "chat.stream",
            "client.invoke_model",
            "ollama.chat",
            "ollama.generate",
            "InferenceClient.text_generation",
        ),
        "bare": ("generateText", "streamText", "generateObject", "streamObject"),
        "method": ("invoke", "ainvoke", "apredict", "predict_messages", "apredict_messages"),
    },
    "retrieved_context": {
        "qualified": ("as_retriever.invoke", "query_engine.query"),
        "bare": (),
        "method": (
            "similarity_search",
            "similarity_search_with_score",
            "max_marginal_relevance_search",
            "get_relevant_documents",
            "aget_relevant_documents",
        ),
    },
    "http_request": {
        "qualified": (
            "request.get_json",
            "request.args.get",
            "request.form.get",
            "request.values.get",
            "request.headers.get",
            "request.json",
            "request.body",
        ),
        "bare": ("input",),
        "method": (),
    },
    "file_read": {
        "qualified": (
            "json.load",
            "json.loads",
            "csv.reader",
            "csv.DictReader",
            "yaml.safe_load",
            "tomllib.load",
            "fs.readFileSync",
        ),
        "bare": (),
        "method": ("read_text", "readlines"),
    },
    "network_read": {
        "qualified": (
            "requests.get",
            "requests.post",
            "requests.request",
            "httpx.get",
            "httpx.post",
            "urllib.request.urlopen",
            "session.get",
        ),
        "bare": ("urlopen",),
        "method": (),
    },
    "tool_output": {"qualified": (), "bare": (), "method": ("call_tool", "read_resource")},
}

# Callees an untrusted value must not reach.
SINKS = {
    "shell_execution": {
        "qualified": (
            "os.system",
            "os.popen",
            "os.execv",
            "os.spawnl",
            "subprocess.run",
            "subprocess.call",
            "subprocess.check_call",
            "subprocess.check_output",
            "subprocess.getoutput",
            "subprocess.Popen",
            "child_process.exec",
            "child_process.execSync",
            "child_process.spawn",
        ),
        "bare": ("execSync", "system"),
        "method": (),
    },
    "deserialization": {
        "qualified": (
            "pickle.load",
            "pickle.loads",
            "cPickle.loads",
            "dill.load",
            "dill.loads",
            "marshal.loads",
            "joblib.load",
            "torch.load",
            "yaml.load",
            "yaml.unsafe_load",
        ),
        "bare": (),
        "method": (),
    },
    "file_path": {
        "qualified": ("os.remove", "os.unlink", "shutil.rmtree"),
        "bare": ("open",),
        "method": (),
    },
    "network_url": {
        "qualified": ("requests.get", "requests.post", "httpx.get", "urllib.request.urlopen"),
        "bare": ("urlopen",),
        "method": (),
    },
    "code_execution": {
        "qualified": (),
        "bare": ("eval", "exec", "compile", "execfile", "Function"),
        "method": (),
    },
    "sql_execution": {
        "qualified": (),
        "bare": (),
        "method": ("execute", "executemany", "executescript", "execute_query"),
    },
}
SINK_LEAVES = tuple(
    sorted(
        {
            name.rsplit(".", 1)[-1]
            for tiers in SINKS.values()
            for names in tiers.values()
            for name in names
        }
    )
)
# Last decorator segments that make a function reachable from outside.
ENTRY_DECORATORS = (
    "tool",
    "function_tool",
    "route",
    "get",
    "post",
    "put",
    "patch",
    "delete",
    "websocket",
    "command",
    "resource",
    "prompt",
    "call_tool",
    "api_route",
    "tool_plain",
    "kernel_function",
    "on",
)


def _any(names: tuple[str, ...]) -> str:
    return "(?:" + "|".join(re.escape(n) for n in names) + ")"


def classify(callee: Column, catalogue: dict) -> Column:
    """The catalogue kind of a callee; a qualified entry beats a bare name or a method."""
    loose, qualified = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, tiers in catalogue.items():
        if tiers["bare"]:
            loose = F.when(callee.rlike(f"^{_any(tiers['bare'])}$"), F.lit(kind)).otherwise(loose)
        if tiers["method"]:
            loose = F.when(callee.rlike(rf"\.{_any(tiers['method'])}$"), F.lit(kind)).otherwise(loose)
        if tiers["qualified"]:
            qualified = F.when(
                callee.rlike(rf"(?:^|\.){_any(tiers['qualified'])}$"), F.lit(kind)
            ).otherwise(qualified)
    return F.coalesce(qualified, loose)


def source_kind(callee: Column) -> Column:
    return classify(callee, SOURCES)


def sink_kind(callee: Column) -> Column:
    return classify(callee, SINKS)


_STEP = r"(?:\.\w+|\[\]) "
_LEAF = r"(?:parameter|name|unknown|global)"


def _trail(atom: Column) -> Column:
    """Steps from the outside in, then the leaf: ``.attr arg:f/1 literal:``."""
    return F.concat_ws(
        " ", F.array_join(atom["via"], " "), F.concat(atom["kind"], F.lit(":"), atom["name"])
    )


def _none_violates(value: Column, pattern: str) -> Column:
    return F.size(value["atoms"]).cast("int").__gt__(0) & ~F.exists(
        value["atoms"], lambda a: F.ltrim(_trail(a)).rlike(pattern)
    )


def is_closed(value: Column) -> Column:
    """Nothing in the value can come from outside the file."""
    through = _any(CLOSED_WRAPPERS + TEMPORARY)
    closed_attribute = _any(CLOSED_ATTRIBUTES)
    step = rf"(?:(?!\.name self:tempfile\.NamedTemporaryFile/)(?!\.{closed_attribute} ){_STEP}|arg:{through}/\d+ )"
    return _none_violates(
        value, rf"^{step}*(?:self:(?!(?:type|{through[3:-1]})/)\S+ |{_LEAF}:)"
    )


def is_shell_quoted(value: Column) -> Column:
    """Every part that is not literal is quoted for a shell."""
    return _none_violates(
        value, rf"^(?:{_STEP})*(?:self:(?!{_any(SHELL_QUOTE)}/)\S+ |{_LEAF}:)"
    )


def is_constant_path(value: Column) -> Column:
    """A path built from literals, the file's own location, and temporary folders."""
    functions = _any(PATH_FUNCTIONS + TEMPORARY)
    method = r"\S*\.(?:(?:resolve|absolute)/0|(?:with_name|with_suffix)/1)"
    step = (
        rf"(?:(?!\.name self:tempfile\.NamedTemporaryFile/){_STEP}|arg:{functions}/\d+ "
        rf"|(?:recv|arg):{method} )"
    )
    return _none_violates(
        value, rf"^{step}*(?:self:(?!{functions}/)(?!{method} )\S+ |{_LEAF}:)"
    )


def is_stdin(value: Column) -> Column:
    """Everything that is not literal was read from standard input."""
    reads_json = F.exists(value["atoms"], lambda a: _trail(a).rlike(r"arg:json\.load/1 \.stdin name:sys$"))
    plain = _none_violates(value, rf"^(?:{_STEP})*(?:self:(?!{_any(STDIN_READS)}/)\S+ |{_LEAF}:)")
    through_json = _none_violates(
        value, rf"^(?:{_STEP})*(?:self:(?!{_any((*STDIN_READS, 'json.load'))}/)\S+ |{_LEAF}:)"
    )
    return plain | (reads_json & through_json)


def is_cli_argument(value: Column, decorators: Column) -> Column:
    """Everything that is not literal is the operator's own command line."""
    parser = F.exists(
        value["atoms"],
        lambda a: _trail(a).rlike(r"recv:\S+\.parse_(?:known_)?args/\d+ self:argparse\.ArgumentParser/"),
    )
    command = F.exists(
        F.coalesce(decorators, F.array().cast("array<string>")),
        lambda d: d.rlike(r"^(?:click\.(?:command|option|argument)|typer\.Typer\.command)\b"),
    )
    functions = _any(PATH_FUNCTIONS)
    step = rf"(?:{_STEP}|arg:{functions}/\d+ )*"

    def passes(parse_args: bool, parameters: bool) -> Column:
        allowed = rf"(?!{functions}/[1-9])" + (r"(?!\S+\.parse_(?:known_)?args/)" if parse_args else "")
        leaf = "(?:name|unknown)" if parameters else "(?:parameter|name|unknown)"
        return _none_violates(value, rf"^{step}(?:self:{allowed}\S+ |{leaf}:)")

    return (
        passes(False, False)
        | (parser & passes(True, False))
        | (command & passes(False, True))
        | (parser & command & passes(True, True))
    )


def origin(value: Column) -> Column:
    """The one thing a value comes from: ``call:<callee>``, ``parameter:<name>``, … or NULL.

    Literals are neutral; two different origins, or branches that disagree, leave it unknown.
    """
    outer = F.transform(
        value["atoms"],
        lambda a: F.regexp_replace(F.ltrim(_trail(a)), rf"^(?:{_STEP})*", ""),
    )
    named = F.transform(
        F.filter(outer, lambda o: ~o.rlike("^(?:arg|recv):|^literal:")),
        lambda o: F.when(
            o.startswith("self:"),
            F.concat(F.lit("call:"), F.regexp_extract(o, r"^self:(\S*)/\d+", 1)),
        ).otherwise(o),
    )
    distinct = F.array_distinct(named)
    return F.when((F.size(distinct) == 1) & ~value["conflict"], F.get(distinct, F.lit(0)))


def origin_callee(value_origin: Column) -> Column:
    return F.when(value_origin.startswith("call:"), F.substring_index(value_origin, "call:", -1))


def is_guarded(value: Column) -> Column:
    """Every name the value depends on was checked against a closed set on the way here."""

    def proven(name: Column) -> Column:
        return F.exists(value["guards"], lambda g: (g["name"] == name) & is_closed(g))

    return (F.size(value["names"]) > 0) & F.forall(value["names"], proven)


def is_entry_point(name: Column, decorators: Column) -> Column:
    """A request handler, tool or command by its name or by a decorator's last segment."""
    decorated = F.exists(
        F.coalesce(decorators, F.array().cast("array<string>")),
        lambda d: F.regexp_extract(d, r"([^.(]*)(?:\(.*)?$", 1).isin(*ENTRY_DECORATORS),
    )
    return F.coalesce(name.rlike("^do_[A-Z]"), F.lit(False)) | decorated
