"""Metadata of the rules whose matching is written out in the operators.

Ids, titles, kinds, severities, confidences and categories are fixed values: they are what a
report says and what a fingerprint is computed from. Descriptions are this project's own words.
"""

from __future__ import annotations

from treesift.model import Rule

HIDDEN_UNICODE = Rule(
    "BAS-LLM01-001",
    "Hidden Unicode characters in an agent instruction file",
    "defect",
    "critical",
    "high",
    ("LLM01",),
    "Invisible characters reach the agent but not the human reviewer.",
    "Delete the hidden characters and review how they got in.",
)
SKILL_FRONTMATTER = Rule(
    "BAS-SKILL-001",
    "SKILL.md frontmatter is not spec-valid",
    "observation",
    "low",
    "high",
    (),
    "Required frontmatter fields are missing.",
    "Open the file with a YAML block that sets name and description.",
)
SKILL_INJECTION = Rule(
    "BAS-SKILL-002",
    "SKILL.md contains instruction-override language",
    "defect",
    "critical",
    "high",
    ("LLM01",),
    "The skill text tries to override the agent's instructions.",
    "Remove the phrase, or move examples of attacks out of the skill text.",
)
SKILL_SKIP_CONFIRMATION = Rule(
    "BAS-SKILL-003",
    "SKILL.md tells the agent to skip confirmation before acting",
    "defect",
    "high",
    "medium",
    ("LLM03",),
    "The skill text tells the agent not to ask before it acts.",
    "Remove the phrase, or limit it to the actions it is safe for.",
)
DOTENV_PROVIDER_KEY = Rule(
    "BAS-ZT1-021",
    "Provider API key committed to a .env file",
    "defect",
    "critical",
    "high",
    ("ZT1",),
    "A provider key is stored as a literal in a committed environment file.",
    "Remove the literal, inject it at run time, and rotate the key.",
)
DOTENV_CREDENTIAL = Rule(
    "BAS-ZT1-022",
    "Hardcoded credential committed to a .env file",
    "defect",
    "high",
    "high",
    ("ZT1",),
    "A credential is stored as a literal in a committed environment file.",
    "Remove the literal, inject it at run time, and rotate the credential.",
)
IMAGE_ROOT = Rule(
    "BAS-INFRA-001",
    "Container image runs as root",
    "defect",
    "high",
    "high",
    ("ZT3",),
    "The final build stage runs as root, and so does every tool the agent starts.",
    "Create an unprivileged user and end the final stage with it.",
)
IMAGE_NO_USER = IMAGE_ROOT._replace(
    title="Container image declares no unprivileged user",
    kind="observation",
    severity="low",
    description="The final build stage sets no user; unless something outside does, it is root.",
    remediation="Add an unprivileged user to the final stage if nothing else sets one.",
)
IMAGE_PROVIDER_KEY = Rule(
    "BAS-INFRA-002",
    "Provider API key baked into the container image",
    "defect",
    "critical",
    "high",
    ("ZT1",),
    "A provider key is part of the image definition and travels with every pull.",
    "Inject the key at run time and rotate it.",
)
SOCKET_MOUNT = Rule(
    "BAS-INFRA-003",
    "Service mounts the Docker socket",
    "defect",
    "critical",
    "high",
    ("ZT3",),
    "The service controls the container daemon, and with it the host.",
    "Remove the mount, or put a scoped proxy in front of the daemon.",
)
PRIVILEGED = Rule(
    "BAS-INFRA-004",
    "Service runs privileged",
    "defect",
    "critical",
    "high",
    ("ZT3",),
    "Privileged mode removes the restrictions that make a container a boundary.",
    "Grant only the capabilities or devices the service needs.",
)
HOST_NETWORK = Rule(
    "BAS-INFRA-005",
    "Service shares the host network namespace",
    "observation",
    "low",
    "high",
    ("ZT3",),
    "The service reaches every port bound on the host, loopback included.",
    "Use a private network and publish only the ports it serves.",
)
DEPLOYMENT_CREDENTIAL = Rule(
    "BAS-INFRA-006",
    "Hardcoded credential in deployment configuration",
    "defect",
    "high",
    "high",
    ("ZT1",),
    "A credential is stored as a literal in deployment configuration.",
    "Read it from the environment or a secret manager, and rotate it.",
)
HOST_PID = HOST_NETWORK._replace(
    rule_id="BAS-INFRA-010",
    title="Service shares the host PID namespace",
    description="Every process of the host is visible from inside the container.",
    remediation="Remove the setting if the service need not see host processes.",
)
MCP_MALFORMED = Rule(
    "BAS-MCP-000",
    "MCP configuration file is not valid",
    "defect",
    "medium",
    "high",
    ("ZT3",),
    "The tool-server configuration is malformed, so nothing in it was checked.",
    "Correct the file's syntax.",
)
MCP_FILESYSTEM = Rule(
    "BAS-MCP-001",
    "MCP server granted root or broad filesystem access",
    "defect",
    "high",
    "high",
    ("ZT3",),
    "The server is given the filesystem root or a whole home directory.",
    "Narrow the argument to the directory the server needs.",
)
MCP_PLAIN_HTTP = Rule(
    "BAS-MCP-002",
    "MCP server reached over unauthenticated plaintext HTTP",
    "defect",
    "high",
    "medium",
    ("ZT1",),
    "The server is reached over http without an authentication header.",
    "Use https and add authentication.",
)
MCP_LOCAL_HTTP = MCP_PLAIN_HTTP._replace(
    title="MCP server reached over unauthenticated local HTTP",
    kind="observation",
    severity="low",
    description="The server is reached over http on this machine only.",
    remediation="Add authentication before pointing it at a shared host.",
)
MCP_WILDCARD = Rule(
    "BAS-MCP-003",
    "MCP server granted a wildcard tool grant",
    "defect",
    "high",
    "high",
    ("ZT2",),
    "Every tool of the server is granted, including those added later.",
    "List the tools the server is expected to use.",
)
MCP_CREDENTIAL = Rule(
    "BAS-MCP-004",
    "Hardcoded credential in MCP server environment",
    "defect",
    "critical",
    "high",
    ("ZT1",),
    "A live credential is committed in the server's environment block.",
    "Reference the environment instead of the value, and rotate it.",
)
MCP_UNPINNED = Rule(
    "BAS-MCP-005",
    "MCP server is launched without a version pin",
    "defect",
    "high",
    "high",
    ("LLM04",),
    "The launcher resolves whatever version the registry serves at start-up.",
    "Pin the package to an exact version.",
)
MCP_GLOBAL_APPROVE = Rule(
    "BAS-LLM03-020",
    "MCP client config auto-approves every tool call",
    "observation",
    "medium",
    "high",
    ("LLM03",),
    "Every tool call of every declared server is trusted without confirmation.",
    "List the tools that are safe to approve automatically.",
)
MCP_SERVER_APPROVE = MCP_GLOBAL_APPROVE._replace(
    title="MCP server auto-approves every tool call",
    description="Every tool call of this server is trusted without confirmation.",
)
UNBOUNDED_AGENT_PIN = Rule(
    "BAS-LLM04-001",
    "dependency has no upper-bounded version pin",
    "observation",
    "low",
    "high",
    ("LLM04",),
    "An agent package is declared without an upper version bound.",
    "Pin the package to a version or to a bounded range.",
)
ADVISORY = Rule(
    "BAS-CVE-001",
    "dependency is affected by a published advisory",
    "defect",
    "low",
    "high",
    ("LLM04",),
    "A pinned dependency has published advisories.",
    "Upgrade the dependency.",
)
