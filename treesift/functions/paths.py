"""Predicates on a relative path: which analyser claims it, and whether it is test code.

All of them look at the path alone, so they run before any content is read.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File names and extensions each analyser claims.
LANGUAGE_EXTENSIONS = {
    "python": ("py",),
    "javascript": ("js", "mjs", "cjs", "jsx"),
    "typescript": ("ts", "mts", "cts"),
    "tsx": ("tsx",),
}
MCP_NAMES = (
    "mcp.json",
    ".mcp.json",
    "mcp_config.json",
    "claude_desktop_config.json",
    "mcp.yaml",
    "mcp.yml",
    ".mcp.yaml",
    ".mcp.yml",
    "mcp_config.yaml",
    "mcp_config.yml",
    "claude_desktop_config.yaml",
    "claude_desktop_config.yml",
    "mcp.toml",
    ".mcp.toml",
    "mcp_config.toml",
    "claude_desktop_config.toml",
)
MANIFEST_NAMES = ("requirements.txt", "pyproject.toml", "package.json", "Cargo.toml")
INSTRUCTION_NAMES = ("skill.md", "agents.md", "claude.md", ".cursorrules")
COMPOSE_PATTERN = r"^(docker-)?compose(\..*)?\.(yml|yaml)$"
DOCKERFILE_EXCLUDED_EXTENSIONS = (
    "dockerignore",
    "md",
    "txt",
    "json",
    "yaml",
    "yml",
    "toml",
    "lock",
    "log",
)
TEST_DIRECTORIES = ("test", "tests", "spec", "specs", "__tests__", "__mocks__", "testdata")
DOTENV_SAMPLE_SUFFIXES = ("example", "sample", "template", "dist")
ALWAYS_SKIPPED_DIRECTORIES = (".git", ".hg", ".svn", "node_modules")


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def directories(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.slice(parts, 1, F.size(parts) - 1)


def language(path: Column) -> Column:
    """Grammar of a source file, or NULL. Extensions are case-sensitive; a bare dot-name has none."""
    extension = F.regexp_extract(file_name(path), r"^.+\.([^.]+)$", 1)
    expr = F.lit(None).cast("string")
    for name, extensions in LANGUAGE_EXTENSIONS.items():
        expr = F.when(extension.isin(*extensions), F.lit(name)).otherwise(expr)
    return expr


def is_mcp_config(path: Column) -> Column:
    return file_name(path).isin(*MCP_NAMES)


def is_manifest(path: Column) -> Column:
    return file_name(path).isin(*MANIFEST_NAMES)


def is_compose(path: Column) -> Column:
    return F.lower(file_name(path)).rlike(COMPOSE_PATTERN)


def is_dockerfile(path: Column) -> Column:
    name = F.lower(file_name(path))
    extension = F.substring_index(name, ".", -1)
    return (
        (name == "dockerfile")
        | name.endswith(".dockerfile")
        | (name.rlike(r"^dockerfile[.-]") & ~extension.isin(*DOCKERFILE_EXCLUDED_EXTENSIONS))
    )


def is_instruction_file(path: Column) -> Column:
    name = F.lower(file_name(path))
    return name.isin(*INSTRUCTION_NAMES) | name.endswith(".prompt") | is_mcp_config(path)


def is_skill(path: Column) -> Column:
    return F.lower(file_name(path)) == "skill.md"


def is_dotenv(path: Column) -> Column:
    name = file_name(path)
    return (name == ".env") | name.startswith(".env.")


def is_dotenv_sample(path: Column) -> Column:
    return F.lower(F.substring_index(file_name(path), ".", -1)).isin(*DOTENV_SAMPLE_SUFFIXES)


def analysers(path: Column) -> Column:
    """Names of the analysers that claim a path; empty means the content is never read."""
    claims = {
        "rules": language(path).isNotNull(),
        "mcp": is_mcp_config(path),
        "container": is_compose(path) | is_dockerfile(path),
        "instruction": is_instruction_file(path),
        "skill": is_skill(path),
        "dotenv": is_dotenv(path),
        "manifest": is_manifest(path),
    }
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in claims.items()]))


def is_test_path(path: Column) -> Column:
    """Test code by directory name, by ``conftest.py``, or by the stem's affix."""
    name = F.lower(file_name(path))
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    in_directory = F.lower(path).rlike(rf"(^|/)({'|'.join(TEST_DIRECTORIES)})/")
    return (
        in_directory
        | (name == "conftest.py")
        | stem.startswith("test_")
        | stem.endswith("_test")
        | stem.rlike(r"\.(test|spec)$")
    )


def skipped_directory(path: Column) -> Column:
    names = F.array(*[F.lit(n) for n in ALWAYS_SKIPPED_DIRECTORIES])
    return F.arrays_overlap(F.split(path, "/"), names)
