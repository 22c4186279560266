"""Detection rules on Python facts.

Every rule is a condition on one fact row, evaluated for all rules in a single projection. Only
the few matches go on to the relational part: values returned by functions of the same file,
wrappers around sinks, and calls made from entry points, each a join on (path, function).
"""

from __future__ import annotations

import operator
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treesift.functions import credentials as cred
from treesift.functions.paths import is_test_path
from treesift.model import CONFIDENCES, KINDS, SEVERITIES, Rule, string_array
from treesift.operators import provenance as flow
from treesift.sources.batches import of_every_path, once_a_path
from treesift.sources.python_facts import ARGUMENT

OUTSIDE = ("http_request", "tool_output", "retrieved_context", "network_read", "file_read")


# What the rules below look at: facts by kind, with what must be found in them, see
# :meth:`treesift.sources.python_facts._File.facts`. It may find more than the rules do; a rule whose facts it does not
# find would see nothing.
_CALLS = (
    "eval|exec|system|popen|run|call|check_call|check_output|Popen|open|execute|load_local|from_llm|load|get|getenv"
    "|create_pandas_dataframe_agent|create_csv_agent|RequestsToolkit|RequestsGetTool|RequestsPostTool|JsonPlusSerializer"
    "|from_math_prompt|from_colored_object_prompt|ShellToolMiddleware|invoke|ainvoke|stream"
)
_CLASSES = "LLMMathChain|LLMSymbolicMathChain|PandasQueryEngine|PandasAstREPLTool|PALChain"


class Flow(NamedTuple):
    """How a match depends on where its value comes from."""

    sources: tuple[str, ...] = ()
    unguarded: bool = False
    unproven: str | None = None  # names that make an untraced value an observation
    builtin: bool = False
    passthrough: bool = False


class Match(NamedTuple):
    rule: Rule
    condition: Column
    value: Column | None = None
    flow: Flow | None = None
    report_in_tests: bool = False
    at_start: bool = False  # report where the decorated definition starts


# Patterns a captured text must (or must not) contain.
MODEL_NAMES = "(?i)(response|reply|completion|message|content|choices|output|generated)"
CURSOR_NAMES = "(?i)(cursor|cur|db|conn|connection)"
PROMPT_NAMES = "(?i)(system|prompt|instruction|persona|template)"
USER_NAMES = "(?i)(user|request|query|input|raw|message)"
OVERRIDE_NAMES = "(?i)(override|overridden|custom_instructions|force_prompt)"
STATE_CHANGING_VERBS = (
    "(?i)^(delete|drop|remove|transfer|withdraw|wire|drain|revoke|terminate|shutdown|sell_all"
    "|liquidate|send_funds|execute_trade|purge|wipe|create|update|edit|modify|insert|cancel|approve"
    "|reject|install|uninstall|register|grant|subscribe|schedule|submit|publish|deploy|charge"
    "|refund|send)"
)
_LITERAL_RUN = r"""(("([^"\\]|\\.)*")|('([^'\\]|\\.)*'))"""
SQL_SAFE_TEXT = rf"^\s*(select|insert|update)\(|^\s*{_LITERAL_RUN}(\s*{_LITERAL_RUN})*\s*$"
SQL_BUILT_TEXT = r"""(^f["']|["']\s*\+\s*\w|\w\s*\+\s*["']|%\s*\()"""
SQL_SCHEMA_TEXT = (
    r"""(?i)^f["']\s*(PRAGMA|ALTER\s+TABLE|CREATE\s+TABLE|DROP\s+TABLE|CREATE\s+INDEX|DROP\s+INDEX)\b[^"']*["']$"""
)
PATH_BUILT_TEXT = r"""(os\.path\.join\(|^f["']|["']\s*\+\s*\w|\w\s*\+\s*["'])"""
PATH_LITERAL_TEXT = rf"^os\.path\.join\(\s*{_LITERAL_RUN}(\s*,\s*{_LITERAL_RUN})*\s*\)$"
KEY_TEXT = "sk-[A-Za-z0-9_-]{16,}"
EMBEDDED_CREDENTIAL = (
    r"(:\/\/[^\s/:@]+:[^\s/@]+@)"
    "|((?i:secret|token|password|api[_-]?key|private[_-]?key)[-_][0-9a-f]{12,})"
)
LOCAL_DSN = r"(?i)://[^\s/@]*:[^\s/@]*@(localhost|127\.0\.0\.1)([:/]|$)"
# Chosen values: shapes of tokens and keys. Template syntax never matches the bearer shape.
TOKEN_TEXT = r"^eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}$"
ACCESS_KEY_TEXT = r"^AKIA(?![A-Z0-9]*EXAMPLE$)[A-Z0-9]{16}$"
BEARER_TEXT = r"^Bearer\s+[A-Za-z0-9._~+/-]{16,}=*$"
HIDDEN_MARKERS = "(?i)(<important>|<hidden>|do not mention|do not tell the user|present it as if)"
OVERRIDE_PHRASES = (
    "(?i)(ignore (previous|prior|all) instructions|disregard (prior|previous)"
    "|override (your|the) (instructions|system prompt)|bypass (the|your) (safety|restriction))"
)
HISTORY_NAMES = "(?i)(history|memory|chat|conversation|messages|context)"
MEMORY_NAMES = "(?i)(memory|chain|conversation)"
MEMORY_METHODS = ("predict", "run", "save_context", "load_memory_variables")
ROUTE_METHODS = ("get", "post", "put", "patch", "delete", "route")
GRAPH_METHODS = ("invoke", "ainvoke", "stream")
SHELL_FUNCTIONS = ("run", "call", "check_call", "check_output", "Popen")

_ASSIGNED = f"(?i){PROMPT_NAMES[4:]}|{cred.CREDENTIAL_NAME[4:]}|{KEY_TEXT}"
WANTED = {
    "call": rf"\b(?:{_CALLS}|{_CLASSES})$|\.chat\.completions\.create$",
    "string": r"://[^/:@]+:[^/@]+@|(?i:secret|token|password|api[_-]?key|private[_-]?key)[-_][0-9a-f]{12}|^(?:eyJ|AKIA|Bearer\s|\*$)",
    "assign": _ASSIGNED,
    "augassign": _ASSIGNED,
    "function": r"\.execute",
    "return": None,
    "import": f"^(?:{_CLASSES})$",
}

EXECUTED = "Run only fixed operations: parse the value into a constrained set of commands."
PARAMETERISE = "Use bind parameters; never build query text from values."
SHELL = "Call the program with an argument list and no shell."
CONFIRM = "Check a confirmation or an authorization before the tool acts."
REMOVE = "Remove the import and use of the class."


def _rule(rule_id, title, kind, severity, confidence, categories, description, remediation) -> Rule:
    return Rule(
        rule_id, title, kind, severity, confidence, tuple(categories.split()), description, remediation
    )


def _c(name: str) -> Column:
    return F.col(name)


def _arg(index: int) -> Column:
    return F.get(_c("args"), F.lit(index))


def _positional(index: int) -> Column:
    return (F.size("args") > index) & _arg(index)["name"].isNull()


def _is_call(pattern: str) -> Column:
    return (_c("fact") == "call") & _c("text").rlike(pattern)


def _only(count: int) -> Column:
    return F.size("args") == count


def _has_keyword(name: str, text: str | None = None) -> Column:
    return F.exists(
        "args",
        lambda a: a["name"].eqNullSafe(name) & (F.lit(True) if text is None else a["text"] == text),
    )


def _flag(name: str) -> Column:
    return _has_keyword(name, "True")


def _plain_string(argument: Column, *quotes: str) -> Column:
    return (argument["kind"] == "string") & argument["quote"].isin(*quotes)


def _shell_true() -> Column:
    return _arg(1)["name"].eqNullSafe("shell") & (_arg(1)["text"] == "True")


def _cursor_call() -> Column:
    return (
        (_c("fact") == "call")
        & (_c("name") == "execute")
        & _c("receiver").rlike(CURSOR_NAMES)
        & _only(1)
        & _positional(0)
    )


def _tool_docstring(pattern: str) -> Column:
    return (
        (_c("fact") == "function")
        & (_c("quote") == '"""')
        & (F.size("statements") > 1)
        & (F.size("fn_decorators") == 1)
        & F.get("fn_decorators", F.lit(0)).isin("tool", "tool()", "mcp.tool()")
        & _c("text").rlike(pattern)
    )


def _inside(pattern: str) -> Column:
    """The function, or one around it, carries exactly one decorator and it looks like this."""
    return F.exists(
        "outer", lambda d: (F.size(d) == 1) & F.get(d, F.lit(0)).rlike(pattern)
    )


def _no_guard() -> Column:
    """No top-level guard statement that further statements follow."""
    ahead = F.slice("statements", F.lit(1), F.greatest(F.size("statements") - 1, F.lit(0)))
    return ~F.exists(ahead, lambda s: s["kind"] == "guard")


def _pairs() -> Column:
    """Neighbouring top-level statements as ``struct(0, 1)``."""
    return F.arrays_zip(
        F.slice("statements", F.lit(1), F.greatest(F.size("statements") - 1, F.lit(0))).alias("a"),
        F.slice("statements", F.lit(2), F.size("statements")).alias("b"),
    )


def _query_then_execute() -> Column:
    return F.exists(
        _pairs(),
        lambda p: (p["a"]["kind"] == "assign")
        & (p["a"]["value"] == "fstring")
        & p["a"]["quote"].isin('"', "'")
        & (p["b"]["kind"] == "expr")
        & p["b"]["callee"].endswith(".execute")
        & F.regexp_replace(p["b"]["callee"], r"\.execute$", "").rlike(CURSOR_NAMES)
        & (p["b"]["first"] == p["a"]["target"]),
    )


def _receiver_of(callee: Column, methods: tuple[str, ...]) -> Column:
    """The bare name a method of the list is called on, or NULL."""
    shape = rf"^(\w+)\.(?:{'|'.join(methods)})$"
    return F.when(callee.rlike(shape), F.regexp_extract(callee, shape, 1))


def _history_appended() -> Column:
    """A history-like name is appended to before the last statement, and not bound before that."""
    body = F.slice("statements", F.lit(1), F.greatest(F.size("statements") - 1, F.lit(0)))

    def appended(s: Column, i: Column) -> Column:
        name = F.when(s["kind"] == "expr", _receiver_of(s["callee"], ("append",)))
        earlier = F.slice("statements", F.lit(1), i)
        bound = F.exists(earlier, lambda e: (e["kind"] == "assign") & (e["target"] == name))
        return F.coalesce(name.rlike(HISTORY_NAMES), F.lit(False)) & ~F.coalesce(bound, F.lit(False))

    return F.exists(F.transform(body, appended), lambda x: x)


def _shared_memory() -> Column:
    def used(s: Column, i: Column) -> Column:
        name = F.when(
            s["kind"].isin("expr", "assign", "return"), _receiver_of(s["callee"], MEMORY_METHODS)
        )
        earlier = F.slice("statements", F.lit(1), i)
        built = F.exists(
            earlier,
            lambda e: (e["target"] == name) & (e["callee"] == "ConversationBufferMemory"),
        )
        return F.coalesce(name.rlike(MEMORY_NAMES), F.lit(False)) & ~F.coalesce(built, F.lit(False))

    return F.exists(F.transform("statements", used), lambda x: x)


def _imports_or_calls(names: tuple[str, ...], factories: tuple[str, ...]) -> Column:
    body, makers = "|".join(names), "|".join(factories)
    factory = rf"(\.({makers}))?" if factories else ""
    imported = (_c("fact") == "import") & _c("name").isin(*names)
    return imported | _is_call(rf"^({body}){factory}$")


def _prompt_parts(*shapes: str) -> Column:
    return (
        _c("fact").isin("assign", "augassign")
        & _c("callee").isin(*shapes)
        & _c("name").rlike(PROMPT_NAMES)
        & ~F.array_contains("messages", _c("name"))
    )


def credential_literal(name: Column, value: Column) -> Column:
    """A credential-shaped name over a literal that is neither a placeholder nor prose."""
    return cred.is_credential_key(name) & cred.is_hardcoded_value(value) & ~value.rlike(r"\s")


def rules() -> list[Match]:
    """All Python rules. Ids, titles, levels and categories are fixed values."""
    call, first = _c("fact") == "call", _arg(0)
    code = _is_call("^(eval|exec)$") & ~_plain_string(first, '"')
    shell_call = _is_call(rf"^subprocess\.({'|'.join(SHELL_FUNCTIONS)})$") & _positional(0) & _shell_true()
    open_call = _is_call("^open$") & _positional(0)
    override_shape = (
        (_prompt_parts("fstring") & (_c("fact") == "assign") & (F.size("args") >= 2))
        | (_prompt_parts("or") & (F.size("args") == 2))
        | (_prompt_parts("add") & (_c("fact") == "assign") & (first["text"] == _c("name")))
        | (
            (_c("fact") == "augassign")
            & _c("name").rlike(PROMPT_NAMES)
            & ~F.array_contains("messages", _c("name"))
        )
    )
    overriding = F.when(_c("callee") == "add", F.when(_c("fact") == "assign", _arg(1)).otherwise(first)).otherwise(first)
    route = rf"^\w+(\.\w+)*\.({'|'.join(ROUTE_METHODS)})\(.*\)$"
    destructive = (
        r"^.+\.tool\(annotations=(ToolAnnotations\((.*,)?destructiveHint=True\)"
        r"|\{(.*,)?\"destructiveHint\":True\})\)$"
    )
    thread = F.when(F.exists("args", lambda a: a["name"].isNotNull()), F.try_element_at(F.filter("args", lambda a: a["name"].eqNullSafe("config")), F.lit(1))).otherwise(F.try_element_at(F.col("args"), F.lit(-1)))
    return [
        Match(
            _rule("BAS-LLM10-001", "Model output executed as code", "defect", "critical", "high", "LLM10 ZT4", "A value from a model call is executed as code.", EXECUTED),
            code & _only(1) & _positional(0),
            first,
            Flow(("model_output",), unguarded=True, builtin=True),
        ),
        Match(
            _rule("BAS-LLM10-002", "Model output executed as a shell command", "defect", "critical", "high", "LLM10", "A value that may carry a model reply reaches a shell.", SHELL),
            (_is_call(r"^os\.system$") & _only(1) & _positional(0))
            | (_is_call(r"^subprocess\.(run|call|Popen)$") & _only(2) & _positional(0) & _shell_true()),
            first,
            Flow(("model_output",), unguarded=True, unproven=MODEL_NAMES),
        ),
        Match(
            _rule("BAS-LLM10-003", "Model output concatenated into a SQL query", "defect", "critical", "high", "LLM10", "A query is built from a value that may carry a model reply.", PARAMETERISE),
            _cursor_call()
            & ~_plain_string(first, '"""', "'''")
            & (first["kind"] != "call_of_string")
            & ~first["text"].rlike(SQL_SAFE_TEXT),
            first,
            Flow(("model_output",), unguarded=True, unproven=MODEL_NAMES),
        ),
        Match(
            _rule("BAS-LLM10-008", "Model output reaches SQL through a local variable", "defect", "critical", "high", "LLM10", "A query traces back to a model call.", PARAMETERISE),
            _cursor_call(),
            first,
            Flow(("model_output",)),
        ),
        Match(
            _rule("BAS-LLM10-009", "Non-literal command run through a shell, regardless of any allowlist/denylist check", "defect", "critical", "high", "LLM10", "A command that is not a fixed literal reaches a shell.", SHELL),
            ((_is_call(r"^os\.(system|popen)$") & _only(1) & _positional(0)) | shell_call)
            & ~_plain_string(first, '"', "'")
            & ~flow.is_closed(first)
            & ~flow.is_shell_quoted(first)
            & ~flow.is_stdin(first)
            & ~flow.is_cli_argument(first, _c("fn_decorators")),
            first,
            Flow(passthrough=True),
        ),
        Match(
            _rule("BAS-LLM10-012", "File opened at an unresolved path built by joining or interpolating a non-literal value", "defect", "high", "medium", "LLM10", "A path built inline is opened without being resolved first.", "Resolve the path and check that it stays under its root."),
            open_call
            & ~F.coalesce(first["callee"].isin("os.path.realpath", "os.path.abspath", "safe_join", "werkzeug.utils.safe_join"), F.lit(False))
            & first["text"].rlike(PATH_BUILT_TEXT)
            & ~first["text"].rlike(PATH_LITERAL_TEXT)
            & ~flow.is_constant_path(first)
            & ~flow.is_cli_argument(first, _c("fn_decorators")),
        ),
        Match(
            _rule("BAS-LLM10-017", "Unparameterized query built by interpolation reaches SQL execution", "defect", "critical", "high", "LLM10", "A query is built by interpolation and executed without bind parameters.", PARAMETERISE),
            _cursor_call()
            & (first["kind"] != "string")
            & first["text"].rlike(SQL_BUILT_TEXT)
            & ~first["text"].rlike(SQL_SCHEMA_TEXT),
        ),
        Match(
            _rule("BAS-LLM10-018", "Unparameterized query assigned to a local variable then executed", "defect", "critical", "high", "LLM10", "An interpolated query is executed by the very next statement.", PARAMETERISE),
            (_c("fact") == "function") & _query_then_execute(),
        ),
        Match(
            _rule("BAS-LLM01-002", "Hidden instruction block in a tool's own description", "defect", "high", "high", "LLM01", "A tool description addresses the model behind the user's back.", "Describe only what the tool does and when to call it."),
            _tool_docstring(HIDDEN_MARKERS),
            at_start=True,
        ),
        Match(
            _rule("BAS-LLM01-003", "Suspicious instruction-override phrase in a tool's own description", "observation", "low", "low", "LLM01", "A tool description contains instruction-override wording.", "Review the wording of the description."),
            _tool_docstring(OVERRIDE_PHRASES),
            at_start=True,
        ),
        Match(
            _rule("BAS-ZT4-001", "Raw user input folded directly into a system prompt", "defect", "high", "high", "LLM01 ZT4", "Untrusted input is interpolated into the instruction text.", "Pass untrusted input as a message of its own."),
            _prompt_parts("fstring") & (_c("fact") == "assign") & (F.size("args") >= 1),
            first,
            Flow(OUTSIDE, unguarded=True, unproven=USER_NAMES),
        ),
        Match(
            _rule("BAS-ZT1-001", "Hardcoded API key", "defect", "critical", "high", "ZT1", "A provider key is a literal in source.", "Load the key from the environment and rotate it."),
            (_c("fact") == "assign") & (_c("callee") == "string") & _c("quote").isin('"', "'") & _c("text").rlike(f"^{KEY_TEXT}$"),
            report_in_tests=True,
        ),
        Match(
            _rule("BAS-LLM08-001", "Secret embedded inside a prompt template", "defect", "critical", "high", "LLM08", "A credential is part of the text the model reads.", "Keep credentials out of the context window."),
            (_c("fact") == "assign") & (_c("callee") == "string") & (_c("quote") == '"') & _c("name").rlike(PROMPT_NAMES) & _c("text").rlike(f"(?i){KEY_TEXT}"),
        ),
        Match(
            _rule("BAS-LLM03-001", "Unauthorized agent tool exposed without a confirmation guard", "observation", "high", "medium", "LLM03", "A state-changing tool acts without a guard.", CONFIRM),
            (_c("fact") == "function") & _c("name").rlike(STATE_CHANGING_VERBS) & _no_guard() & _inside(r"^tool(\(\))?$"),
        ),
        Match(
            _rule("BAS-LLM06-001", "LLM call has no token ceiling", "observation", "low", "medium", "LLM06", "Nothing in the repository bounds the cost of one call.", "Set max_tokens, or document what bounds the call."),
            _is_call(r"\.chat\.completions\.create$") & F.regexp_replace("text", r"\.chat\.completions\.create$", "").rlike("(?i)(client|llm|openai|gpt)") & ~_has_keyword("max_tokens"),
        ),
        Match(
            _rule("BAS-ZT1-002", "Hardcoded credential in a collection literal", "defect", "critical", "high", "ZT1", "A literal embeds a password or a live token.", "Load the credential from the environment and rotate it."),
            (_c("fact") == "string") & (_c("quote") == '"') & _c("text").rlike(EMBEDDED_CREDENTIAL) & ~_c("text").rlike(LOCAL_DSN),
        ),
        Match(
            _rule("BAS-LLM10-004", "eval() or exec() run on a non-literal expression", "defect", "high", "medium", "LLM10", "Code that is not a fixed literal is executed.", EXECUTED),
            code & F.size("args").between(1, 3) & F.forall("args", lambda a: a["name"].isNull()),
            first,
            Flow(unguarded=True, builtin=True),
        ),
        Match(
            _rule("BAS-ZT4-002", "System prompt built from a caller-supplied override", "defect", "high", "high", "LLM01 ZT4", "A caller-supplied value replaces or extends the instructions.", "Keep the base instructions fixed and out of the caller's reach."),
            override_shape,
            overriding,
            Flow(OUTSIDE, unguarded=True, unproven=OVERRIDE_NAMES),
        ),
        Match(
            _rule("BAS-ZT2-001", "Wildcard tool grant in agent-construction code", "defect", "high", "high", "ZT2", "An agent is granted every tool, present and future.", "List the tools the agent needs."),
            (_c("fact") == "string") & (_c("text") == "*") & F.exists("keywords", lambda k: k.rlike(r"\|allowed_tools\|\*\|([2-9]|\d{2,})$")),
        ),
        Match(
            _rule("BAS-LLM03-010", "allow_dangerous_code=True on a LangChain data-agent factory", "defect", "critical", "high", "LLM03", "The data agent may run arbitrary code.", "Remove the flag unless the deployment is sandboxed."),
            _is_call("^create_(pandas_dataframe|csv)_agent$") & _flag("allow_dangerous_code"),
        ),
        Match(
            _rule("BAS-LLM03-011", "allow_dangerous_deserialization=True on a vectorstore loader", "defect", "critical", "high", "LLM03", "Loading the store may execute code.", "Rebuild the store from its documents instead."),
            _is_call(r"\.load_local$") & _flag("allow_dangerous_deserialization"),
        ),
        Match(
            _rule("BAS-LLM03-012", "allow_dangerous_requests=True on a LangChain graph/HTTP tool", "defect", "critical", "high", "LLM03", "The tool may send any request the model asks for.", "Restrict the requests instead of disabling the check."),
            _is_call(r"^(GraphCypherQAChain\.from_llm|RequestsToolkit|RequestsGetTool|RequestsPostTool)$") & _flag("allow_dangerous_requests"),
        ),
        Match(
            _rule("BAS-LLM10-010", "torch.load without weights_only=True", "defect", "high", "medium", "LLM10", "Loading the checkpoint may execute code.", "Pass weights_only=True."),
            _is_call(r"^torch\.load$") & ~_flag("weights_only"),
        ),
        Match(
            _rule("BAS-LLM10-011", "yaml.load without a safe loader", "defect", "high", "high", "LLM10", "Parsing may construct arbitrary objects.", "Use yaml.safe_load."),
            _is_call(r"^yaml\.load$")
            & ~F.exists("args", lambda a: a["name"].eqNullSafe("Loader") & a["text"].rlike("(?i)safe") & ~a["text"].isin("UnsafeLoader", "yaml.UnsafeLoader")),
        ),
        Match(
            _rule("BAS-LLM10-013", "Import/use of LLMMathChain or LLMSymbolicMathChain", "defect", "high", "high", "LLM10", "The chain evaluates model output.", REMOVE),
            _imports_or_calls(("LLMMathChain", "LLMSymbolicMathChain"), ("from_llm",)),
        ),
        Match(
            _rule("BAS-LLM10-014", "Import/use of PandasQueryEngine or PandasAstREPLTool", "defect", "high", "high", "LLM10", "The engine runs model-written code.", REMOVE),
            _imports_or_calls(("PandasQueryEngine", "PandasAstREPLTool"), ()),
        ),
        Match(
            _rule("BAS-LLM10-015", "Import/use of PALChain", "defect", "critical", "high", "LLM10", "The chain executes model-written programs.", REMOVE),
            _imports_or_calls(("PALChain",), ("from_math_prompt", "from_colored_object_prompt")),
        ),
        Match(
            _rule("BAS-LLM10-016", "LangGraph checkpoint/cache serializer with pickle_fallback=True", "defect", "high", "high", "LLM10", "Reading a checkpoint may execute code.", "Remove the fallback."),
            _is_call("^JsonPlusSerializer$") & _flag("pickle_fallback"),
        ),
        Match(
            _rule("BAS-ZT5-001", "Module-level chat history mutated inside a per-request handler", "observation", "high", "medium", "ZT5", "One user's conversation may reach another.", "Key the history by session."),
            (_c("fact") == "function") & _history_appended() & _inside(route),
        ),
        Match(
            _rule("BAS-ZT5-003", "Singleton conversation memory referenced (not reconstructed) in a handler", "observation", "high", "medium", "ZT5", "One buffer holds every user's conversation.", "Construct the memory per session."),
            (_c("fact") == "function") & _shared_memory() & _inside(route),
        ),
        Match(
            _rule("BAS-ZT5-004", "LangGraph graph invoked with a hardcoded literal thread_id", "observation", "medium", "medium", "ZT5", "Every caller shares one checkpoint thread.", "Derive thread_id from the session."),
            call & _c("name").isin(*GRAPH_METHODS) & _c("receiver").isNotNull() & (thread["kind"] == "dict") & thread["content"].isNotNull(),
        ),
        Match(
            _rule("BAS-ZT2-010", "ShellToolMiddleware instantiated with no execution policy", "observation", "medium", "medium", "ZT2", "The agent gets the host's shell.", "Pass a sandboxed execution policy."),
            _is_call(r"(^|\.)ShellToolMiddleware$") & _only(0),
        ),
        Match(
            _rule("BAS-LLM03-030", "MCP tool declared destructive is invoked with no confirmation guard", "defect", "high", "medium", "LLM03", "A tool declared destructive acts without a guard.", CONFIRM),
            (_c("fact") == "function") & _no_guard() & _inside(destructive),
        ),
        *credential_rules(),
    ]


def credential_rules() -> list[Match]:
    """Credential literals known from published behaviour; their wording and severity are chosen."""
    string, first = _c("fact") == "string", _arg(0)
    rotate = "Load the value from the environment and rotate it."
    last_name = F.regexp_extract(_c("name"), r"(\w+)\W*$", 1)
    default = F.get(_c("args"), F.lit(1))
    return [
        Match(
            _rule("BAS-ZT1-010", "Hardcoded credential assigned to a credential-named variable", "defect", "critical", "high", "ZT1", "A credential-named variable holds a literal.", rotate),
            (_c("fact") == "assign") & (_c("callee") == "string") & credential_literal(last_name, _c("text")),
        ),
        Match(
            _rule("BAS-ZT1-018", "Hardcoded JSON web token", "defect", "critical", "high", "ZT1", "A literal is a signed token.", rotate),
            string & _c("text").rlike(TOKEN_TEXT),
        ),
        Match(
            _rule("BAS-ZT1-019", "Hardcoded AWS access key id", "defect", "critical", "high", "ZT1", "A literal is an access key id.", rotate),
            string & _c("text").rlike(ACCESS_KEY_TEXT),
        ),
        Match(
            _rule("BAS-ZT1-020", "Credential-shaped default for an environment lookup", "defect", "high", "high", "ZT1", "The fallback of an environment lookup is a credential.", "Fail when the variable is missing."),
            _is_call(r"^os\.(environ\.get|getenv)$")
            & (first["kind"] == "string")
            & (default["kind"] == "string")
            & credential_literal(first["content"], default["content"]),
        ),
        Match(
            _rule("BAS-LLM02-004", "Hardcoded bearer token", "defect", "high", "high", "LLM02", "An authorization header carries a literal token.", rotate),
            string & _c("text").rlike(BEARER_TEXT),
        ),
    ]


RULE_ROW = (
    "index int, rule_id string, title string, kind string, severity string, confidence string,"
    " categories array<string>, description string, remediation string, report_in_tests boolean,"
    " has_flow boolean, sources array<string>, unguarded boolean, unproven string,"
    " passthrough boolean"
)


def rule_table(spark: SparkSession, table: list[Match]) -> DataFrame:
    """The rules' metadata and flow clauses as rows; as many as there are rules."""
    rows = []
    for index, match in enumerate(table):
        spec = match.flow or Flow()
        rule = match.rule
        rows.append(
            (
                index,
                *rule[:5],
                list(rule.categories),
                rule.description,
                rule.remediation,
                match.report_in_tests,
                match.flow is not None,
                list(spec.sources),
                spec.unguarded,
                spec.unproven,
                spec.passthrough,
            )
        )
    return spark.createDataFrame(rows, RULE_ROW)


def candidates(facts: DataFrame, table: list[Match]) -> DataFrame:
    """Every rule's matches in one narrow pass over the facts.

    The pass gives the numbers of the rules that match; the value each of them is about is taken for matches only.
    """
    blocked = F.coalesce("shadowed", F.lit(False))
    values: dict[str, tuple[Column, list[int]]] = {}

    def number(index: int, match: Match) -> Column:
        condition = match.condition
        if match.flow and match.flow.builtin:
            condition = condition & ~blocked
        if match.value is not None:
            values.setdefault(str(match.value), (match.value, []))[1].append(index)
        return F.when(condition, F.lit(index)).otherwise(F.lit(-1))

    matched = F.array_remove(F.array(*[number(i, m) for i, m in enumerate(table)]), -1)
    place = ("line", "col", "snippet")
    found = facts.where("fact NOT IN ('unparseable', 'return')").select("*", F.explode(matched).alias("index"))
    value = F.lit(None).cast(ARGUMENT)
    for taken, indexes in values.values():
        value = F.when(F.col("index").isin(indexes), taken).otherwise(value)
    at_start = F.col("index").isin([i for i, m in enumerate(table) if m.at_start])
    return found.select(
        "path",
        "fn",
        "fn_decorators",
        *[F.when(at_start, F.col(f"start_{c}")).otherwise(F.col(c)).alias(c) for c in place],
        "index",
        value.alias("value"),
    )


def source_returns(facts: DataFrame) -> DataFrame:
    """Functions, defined once in their file, that return values of exactly one source kind."""
    # Step by step: the kind asks for the callee, and the callee for the origin, many times over.
    returns = facts.where("fact = 'return' AND fn_unique").select("path", "fn", flow.origin(_arg(0)).alias("origin"))
    called = returns.select("path", "fn", flow.origin_callee(F.col("origin")).alias("callee"))
    kinds = called.groupBy("path", "fn").agg(F.collect_set(flow.source_kind(F.col("callee"))).alias("kinds"))
    return kinds.where(F.size("kinds") == 1).select(
        "path", F.col("fn").alias("callee"), F.get("kinds", F.lit(0)).alias("returned")
    )


def wrapper_sinks(facts: DataFrame) -> DataFrame:
    """Functions that pass a parameter of theirs straight into a sink: kind and position."""
    calls = facts.where("fact = 'call' AND fn_unique AND NOT coalesce(shadowed, false)").where(
        F.col("name").isin(*flow.SINK_LEAVES)
    )
    passed = calls.select(
        "path",
        "fn",
        "fn_params",
        flow.sink_kind(F.col("callee")).alias("sink"),
        F.explode(
            F.filter("args", lambda a: flow.origin(a) == F.concat(F.lit("parameter:"), a["text"]))
        ).alias("a"),
    ).where("sink IS NOT NULL")
    return passed.select(
        "path",
        F.col("fn").alias("callee"),
        "sink",
        (F.array_position("fn_params", F.col("a.text")) - 1).cast("int").alias("position"),
    ).distinct()


def entry_point_forwards(facts: DataFrame) -> DataFrame:
    """Local functions an entry point calls with a value that is not closed."""
    calls = facts.where(
        (F.col("fact") == "call")
        & F.col("local")
        & flow.is_entry_point(F.col("fn"), F.col("fn_decorators"))
        & F.col("callee").rlike(r"^(?:(?:self|cls)\.)?\w+$")
        & F.exists("args", lambda a: ~flow.is_closed(a))
    )
    return calls.select("path", F.col("name").alias("fn")).distinct()


def wrapped_calls(facts: DataFrame, sink: str) -> DataFrame:
    """Calls of wrapper functions with the argument that ends up in the sink."""
    wrappers = wrapper_sinks(facts).where(F.col("sink") == sink)
    # Only calls of functions the file defines can match; nothing else is shuffled.
    calls = facts.where("fact = 'call' AND local AND size(args) > 0").select(
        "path", "name", "line", "col", "snippet", "args", "fn", "fn_decorators", "callee"
    ).where(F.col("callee").rlike(r"^(?:(?:self|cls)\.)?\w+$"))
    joined = calls.drop("callee").join(
        wrappers, (calls["path"] == wrappers["path"]) & (F.col("name") == wrappers["callee"])
    ).drop(wrappers["path"])
    return joined.select(
        "path",
        "fn",
        "fn_decorators",
        "line",
        "col",
        "snippet",
        F.get("args", F.col("position")).alias("value"),
    ).where("value IS NOT NULL AND value.name IS NULL")


def findings(facts: DataFrame, extra: list[Match] | None = None, members: DataFrame | None = None) -> DataFrame:
    """Findings of all Python rules, and of rules the caller adds, one per location.

    With ``members``, facts are those of :func:`treesift.sources.batches.distinct_texts`: rules are judged once for
    each text, and what is found at a place is merged there, once as in tests and once as elsewhere, before it is
    reported for every path that has the text. Only paths that come with several texts are merged again.
    """
    table = [*rules(), *(extra or [])]
    if extra:
        from treesift.operators.rule_checks import validate

        validate(table)
    wrapped = wrapped_calls(facts, "code_execution").withColumn("index", F.lit(0))
    found = candidates(facts, table).unionByName(wrapped)
    # One row per rule, a fixed number whatever the data.
    described = found.join(F.broadcast(rule_table(facts.sparkSession, table)), "index")
    ranked = _ranked(_judged(described, facts), table)
    if members is None:
        return _shaped(_merged(ranked.withColumn("quiet", is_test_path(F.col("path"))), table), table)
    # A line of a text has one snippet.
    texts = ranked.groupBy("path", "line", "col", "snippet").agg(F.min("plain").alias("plain"), F.min("tests").alias("tests"), *_bits(table))
    one, several = (m.withColumn("quiet", is_test_path(F.col("path"))) for m in once_a_path(members))
    whole = of_every_path(texts, one).withColumn("rank", _rank())
    return _shaped(whole.drop("plain", "tests").unionByName(_merged(of_every_path(texts, several), table)), table)


def _judged(found: DataFrame, facts: DataFrame) -> DataFrame:
    """Drop what the flow clause drops; mark what is unproven or merely passed through.

    Order matters: a closed or guarded value is dropped first, then the source decides; a value
    whose source cannot be traced stays, as an observation, when its text bears a suspicious name.
    """
    value = F.col("value")
    traced = found.select("*", flow.origin(value).alias("origin")).withColumn(
        "origin_callee", flow.origin_callee(F.col("origin"))
    )
    hop = source_returns(facts).withColumnRenamed("path", "h_path")
    joined = traced.withColumn("direct", flow.source_kind(F.col("origin_callee"))).join(
        hop,
        (F.col("path") == F.col("h_path"))
        & (F.col("origin_callee") == F.col("callee"))
        & F.col("direct").isNull(),
        "left",
    )
    source = F.coalesce("direct", "returned")
    safe = F.col("has_flow") & (
        flow.is_closed(value) | (F.col("unguarded") & flow.is_guarded(value))
    )
    verdict = (
        F.when(F.coalesce(safe, F.lit(False)), "drop")
        .when(F.size("sources") == 0, "proven")
        .when(F.array_contains(F.col("sources"), source), "proven")
        .when(source.isNull() & F.regexp_like(value["text"], F.col("unproven")), "unproven")
        .otherwise("drop")
    )
    passed = (
        F.col("passthrough")
        & value["bare"]
        & F.col("origin").startswith("parameter:")
        & ~flow.is_entry_point(F.col("fn"), F.col("fn_decorators"))
    )
    judged = joined.select(
        "*", verdict.alias("verdict"), F.coalesce(passed, F.lit(False)).alias("passed")
    ).where("verdict <> 'drop'")
    forwarded = entry_point_forwards(facts).select(
        F.col("path").alias("e_path"), F.col("fn").alias("e_fn")
    )
    return judged.join(
        forwarded,
        (F.col("path") == F.col("e_path")) & (F.col("fn") == F.col("e_fn")) & F.col("passed"),
        "left",
    )


# How a match came out: as its rule says, passed on by a function no entry point calls, or with its origin unknown.
PROVEN, PASSED, UNPROVEN = range(3)
_WORD = 63


def _outcomes(table: list[Match], tests: bool) -> list[tuple[str, str]]:
    """Kind and confidence of every rule's outcomes, three by three, in tests or elsewhere."""
    return [
        (
            "observation" if how != PROVEN or (tests and not match.report_in_tests) else match.rule.kind,
            "low" if how == UNPROVEN else match.rule.confidence,
        )
        for match in table
        for how in (PROVEN, PASSED, UNPROVEN)
    ]


def _best_first(table: list[Match], tests: bool) -> list[int]:
    """Outcomes by number, best first, as :func:`treesift.plans.report.merge_same_location` has it."""
    outcomes = _outcomes(table, tests)

    def rank(number: int) -> tuple:
        kind, confidence = outcomes[number]
        rule = table[number // 3].rule
        return KINDS.index(kind), -SEVERITIES.index(rule.severity), -CONFIDENCES.index(confidence), rule.rule_id

    return sorted(range(len(outcomes)), key=rank)


def _of(values: list, number: Column) -> Column:
    """The value with this number; the list is a constant of the plan."""
    return F.get(F.array(*[F.lit(value) if isinstance(value, (str, int)) else value for value in values]), number)


def _rank() -> Column:
    return F.when(F.col("quiet"), F.col("tests")).otherwise(F.col("plain"))


def _words(table: list[Match]) -> list[str]:
    return [f"rules_{word}" for word in range(-(-len(table) // _WORD))]


def _bits(table: list[Match]) -> list[Column]:
    return [F.bit_or(word).alias(word) for word in _words(table)]


def _ranked(judged: DataFrame, table: list[Match]) -> DataFrame:
    """Matches as numbers: the place of their outcome among all, outside tests and in them, and a bit for the rule.

    Rows are small until what is found at a place is one row, and hold numbers, which merge without sorting.
    """
    how = F.when(F.col("verdict") == "unproven", UNPROVEN).when(F.col("passed") & F.col("e_fn").isNull(), PASSED).otherwise(PROVEN)
    numbered = judged.select("path", "line", "col", "snippet", "index", (F.col("index") * 3 + how).alias("outcome"))
    places = {name: _best_first(table, tests) for name, tests in (("plain", False), ("tests", True))}
    bits = [
        F.when(F.floor(F.col("index") / _WORD) == i, F.expr(f"shiftleft(1L, index % {_WORD})")).otherwise(F.lit(0).cast("bigint")).alias(word)
        for i, word in enumerate(_words(table))
    ]
    ranks = [_of([order.index(n) for n in range(len(order))], F.col("outcome")).alias(name) for name, order in places.items()]
    return numbered.select("path", "line", "col", "snippet", *ranks, *bits)


def _merged(ranked: DataFrame, table: list[Match]) -> DataFrame:
    """The best outcome at each location of a path, with a bit for every rule found there."""
    first = F.min(F.struct(_rank().alias("rank"), "snippet")).alias("first")
    merged = ranked.groupBy("path", "quiet", "line", "col").agg(first, *_bits(table))
    return merged.select("path", "line", "col", "first.snippet", *_words(table), "quiet", "first.rank")


def _shaped(merged: DataFrame, table: list[Match]) -> DataFrame:
    """Findings from the numbers of their best outcome; the other rules found there are secondary ids."""
    number, quiet = F.col("number"), F.col("quiet")
    outcome = F.when(quiet, _of(_best_first(table, True), F.col("rank"))).otherwise(_of(_best_first(table, False), F.col("rank")))
    numbered = merged.withColumn("number", outcome).withColumn("index", F.floor(F.col("number") / 3).cast("int"))
    note = " The value's origin was not traced."
    told = [m.rule.description + (note if how == UNPROVEN else "") for m in table for how in (PROVEN, PASSED, UNPROVEN)]

    def of_rule(name: str) -> Column:
        return _of([getattr(match.rule, name) for match in table], F.col("index"))

    ids = sorted((match.rule.rule_id, i) for i, match in enumerate(table))
    found = [F.when(F.expr(f"(shiftright(rules_{i // _WORD}, {i % _WORD}) & 1) = 1 AND index <> {i}"), F.lit(name)) for name, i in ids]
    alone = reduce(operator.add, [F.bit_count(word) for word in _words(table)]) == 1
    return numbered.select(
        of_rule("rule_id").alias("rule_id"),
        of_rule("title").alias("title"),
        F.when(quiet, _of([k for k, _ in _outcomes(table, True)], number))
        .otherwise(_of([k for k, _ in _outcomes(table, False)], number))
        .alias("kind"),
        of_rule("severity").alias("severity"),
        _of([confidence for _, confidence in _outcomes(table, False)], number).alias("confidence"),
        _of([string_array(match.rule.categories) for match in table], F.col("index")).alias("categories"),
        F.struct(
            F.col("path").alias("file"),
            F.col("line").cast("bigint").alias("line"),
            F.col("col").cast("bigint").alias("column"),
        ).alias("location"),
        "snippet",
        _of(told, number).alias("description"),
        of_rule("remediation").alias("remediation"),
        F.when(alone, string_array(())).otherwise(F.array_compact(F.array(*found))).alias("secondary_rule_ids"),
        string_array(()).alias("references"),
    )
