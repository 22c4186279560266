"""Fixed small tables: categories, compliance controls, skip reasons. At most a few dozen rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Id, name, layer, ring, section rank, observation only.
CATEGORIES = (
    ("LLM01", "Prompt Injection", "entry", None, 0, False),
    ("LLM02", "Sensitive Information Disclosure", "impact", None, 2, False),
    ("LLM03", "Excessive Agency", "cross_layer", None, 3, False),
    ("LLM04", "Supply Chain", "entry", None, 0, False),
    ("LLM06", "Unbounded Consumption", "impact", None, 2, True),
    ("LLM08", "Hidden Context Exposure", "amplifier", None, 1, False),
    ("LLM09", "Vector and Embedding Weaknesses", "amplifier", None, 1, True),
    ("LLM10", "Improper Output Handling", "cross_layer", None, 3, False),
    ("ZT1", "Identity and Credentials", "defense", "machinery", 4, False),
    ("ZT2", "Least Agency and Access", "defense", "machinery", 4, False),
    ("ZT3", "Isolation and Runtime", "defense", "perimeter", 4, False),
    ("ZT4", "I/O and Prompt Defenses", "defense", "perimeter", 4, False),
    ("ZT5", "Memory and Context", "defense", "machinery", 4, True),
    ("ZT6", "Observability and Logging", "defense", "impact_mitigation", 4, True),
)
SECTIONS = ("entry", "amplifier", "impact", "cross_layer", "defense")
CROSS_LAYER_RANK = 3

# Frameworks in output order.
FRAMEWORKS = (
    ("eu-ai-act", "EU AI Act"),
    ("nist-ai-rmf", "NIST AI RMF 1.0"),
    ("nist-genai", "NIST Generative AI Profile"),
)

# Framework, control id, short title, categories it is relevant to; in the source
# documents' own order.
CONTROLS = (
    ("eu-ai-act", "Art. 12", "Record-keeping", ("ZT6",)),
    ("eu-ai-act", "Art. 14", "Human oversight", ("LLM03", "ZT2")),
    (
        "eu-ai-act",
        "Art. 15",
        "Accuracy, robustness and cybersecurity",
        ("LLM01", "LLM02", "LLM04", "LLM08", "LLM09", "LLM10", "ZT1", "ZT3", "ZT4", "ZT5"),
    ),
    ("nist-ai-rmf", "MAP 3.5", "Human oversight processes", ("LLM03", "ZT2")),
    ("nist-ai-rmf", "MAP 4.1", "Third-party component risks", ("LLM04",)),
    ("nist-ai-rmf", "MEASURE 2.4", "Monitoring in production", ("ZT6",)),
    (
        "nist-ai-rmf",
        "MEASURE 2.7",
        "Security and resilience",
        (
            "LLM01",
            "LLM02",
            "LLM03",
            "LLM04",
            "LLM06",
            "LLM08",
            "LLM09",
            "LLM10",
            "ZT1",
            "ZT2",
            "ZT3",
            "ZT4",
            "ZT5",
        ),
    ),
    ("nist-ai-rmf", "MEASURE 2.10", "Privacy risk", ("LLM02", "LLM09", "ZT5")),
    ("nist-ai-rmf", "MANAGE 3.1", "Third-party resource monitoring", ("LLM04",)),
    ("nist-ai-rmf", "MANAGE 4.1", "Post-deployment monitoring", ("ZT6",)),
    ("nist-genai", "Data Privacy", "Leakage of personal or sensitive data", ("LLM02", "LLM09", "ZT5")),
    (
        "nist-genai",
        "Information Security",
        "Offensive capability and attack surface",
        (
            "LLM01",
            "LLM02",
            "LLM03",
            "LLM04",
            "LLM06",
            "LLM08",
            "LLM09",
            "LLM10",
            "ZT1",
            "ZT2",
            "ZT3",
            "ZT4",
            "ZT5",
        ),
    ),
    (
        "nist-genai",
        "Value Chain and Component Integration",
        "Third-party component integration",
        ("LLM04",),
    ),
)

# Skip reasons in declared order with the sentence for one and for several.
SKIP_REASONS = (
    (
        "excluded",
        "1 path was excluded by a pattern given on the command line:",
        "%d paths were excluded by a pattern given on the command line:",
    ),
    (
        "ignore_file",
        "1 ignore file was honoured, so paths matching its patterns were not scanned:",
        "%d ignore files were honoured, so paths matching their patterns were not scanned:",
    ),
    (
        "generated",
        "1 file was not parsed because its bytes say it is generated:",
        "%d files were not parsed because their bytes say they are generated:",
    ),
    (
        "unreadable",
        "1 file could not be read, or is not valid UTF-8:",
        "%d files could not be read, or are not valid UTF-8:",
    ),
    ("unparseable", "1 file could not be parsed:", "%d files could not be parsed:"),
    (
        "unpinned",
        "1 dependency has an unpinned version and could not be matched to CVEs:",
        "%d dependencies have unpinned versions and could not be matched to CVEs:",
    ),
    (
        "unstated",
        "1 path was not covered, for a reason this report did not record:",
        "%d paths were not covered, for reasons this report did not record:",
    ),
)


def categories(spark: SparkSession) -> DataFrame:
    schema = "id string, name string, layer string, ring string, section_rank int, observation_only boolean"
    return spark.createDataFrame(list(CATEGORIES), schema)


def controls(spark: SparkSession) -> DataFrame:
    """One row per control: framework, its position, and the categories it is relevant to."""
    ranks = {name: index for index, (name, _) in enumerate(FRAMEWORKS)}
    rows = [
        (framework, ranks[framework], control, index, title, list(category_ids))
        for index, (framework, control, title, category_ids) in enumerate(CONTROLS)
    ]
    schema = (
        "framework string, framework_rank int, control string, control_rank int, title string,"
        " categories array<string>"
    )
    return spark.createDataFrame(rows, schema)
