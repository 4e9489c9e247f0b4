"""Title rules: role category and seniority level."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bind, optional_string, strip

# --- Fixed values -----------------------------------------------------------------------------
MANAGER = "manager"
ML_ENGINEER = "machine_learning_engineer"
DATA_SCIENTIST = "data_scientist"
SOFTWARE_ENGINEER = "software_engineer"
CATEGORIES = (MANAGER, ML_ENGINEER, DATA_SCIENTIST, SOFTWARE_ENGINEER)

LEVELS = (
    "intern", "junior", "mid", "senior", "staff", "principal", "distinguished", "fellow", "director", "unknown",
)

NOT_PEOPLE_MANAGER = [
    r"\bprogram manager\b",
    r"\bproduct manager\b",
    r"\bproject manager\b",
    r"\btechnical program manager\b",
    r"\bprogram management\b",
]
PEOPLE_MANAGER = [
    r"\bengineering manager\b",
    r"\bsoftware engineering manager\b",
    r"\bsoftware development manager\b",
    r"\bmachine learning manager\b",
    r"\bdata science manager\b",
    r"\bresearch scientist manager\b",
    r"\bmanager,\s*software engineering\b",
    r"\bmanager,\s*machine learning\b",
    r"\bmanager,\s*data science\b",
]
ROLE_PATTERNS = {
    ML_ENGINEER: [
        r"\bmachine learning engineer\b",
        r"\bmachine learning infrastructure engineer\b",
        r"\bmachine learning\b.*\bengineer\b",
        r"\bengineer\b.*\bmachine learning\b",
    ],
    DATA_SCIENTIST: [r"\bapplied scientist\b", r"\bresearch scientist\b", r"\bdata scientist\b"],
    SOFTWARE_ENGINEER: [
        r"\bsoftware engineer\b",
        r"\bsoftware development engineer\b",
        r"\bsoftware dev engineer\b",
        r"\bsoftware developer\b",
        r"\bdeveloper,\s*software\b",
        r"\bdata engineer\b",
        r"\bbackend engineer\b",
        r"\bfrontend engineer\b",
        r"\bfront end engineer\b",
        r"\bfull stack engineer\b",
        r"\bfull-stack engineer\b",
        r"\bembedded software engineer\b",
        r"\bfirmware engineer\b",
    ],
}
GENERIC_LEVEL_PATTERNS = [
    ("fellow", [r"\bfellow\b"]),
    ("director", [r"\bdirector\b"]),
    ("distinguished", [r"\bdistinguished\b"]),
    ("principal", [r"\bprincipal\b"]),
    ("staff", [r"\bstaff\b"]),
    ("senior", [r"\bsenior\b", r"\bsr\.?\b"]),
    ("intern", [r"\bintern(ship)?\b", r"\bco[\s-]?op\b", r"\bapprentice(ship)?\b"]),
    ("junior", [r"\bjunior\b", r"\bjr\.?\b", r"\bentry[\s-]?level\b", r"\bnew[\s-]?grad\b"]),
    ("mid", [r"\bmid(?:[\s-]?level)?\b", r"\bintermediate\b"]),
]
COMPANY_LEVEL_PATTERNS = {
    "amazon": [("junior", r"\b(?:1|i)\b"), ("mid", r"\b(?:2|ii)\b"), ("senior", r"\b(?:3|iii)\b")],
    "google": [("junior", r"\b(?:2|ii)\b"), ("mid", r"\b(?:3|iii)\b"), ("senior", r"\b(?:4|iv)\b")],
    "microsoft": [
        ("principal", r"\bic\s*(?:5|6|7)\b"),
        ("junior", r"\bic\s*2\b"),
        ("mid", r"\bic\s*3\b"),
        ("senior", r"\bic\s*4\b"),
        ("junior", r"\b(?:1|i)\b"),
        ("mid", r"\b(?:2|ii)\b"),
        ("senior", r"\b(?:3|iii)\b"),
    ],
    "netflix": [
        ("junior", r"(?<!/)\bl\s*3\b(?!\s*/)"),
        ("mid", r"(?<!/)\bl\s*4\b(?!\s*/)"),
        ("senior", r"(?<!/)\bl\s*5\b(?!\s*/)"),
    ],
}
# ----------------------------------------------------------------------------------------------

_FLAGS = "(?iuU)"


def _any(x: Column, patterns: list[str]) -> Column:
    """One alternation, so a title is scanned once per rule."""
    return x.rlike(_FLAGS + "|".join(f"(?:{p})" for p in patterns))


def classify_title(title: Column) -> Column:
    """Role category of a title, NULL when no rule applies. A program or product manager is not a people manager."""

    def rules(t: Column) -> Column:
        rule = F.when(_any(t, PEOPLE_MANAGER) & ~_any(t, NOT_PEOPLE_MANAGER), F.lit(MANAGER))
        for category, patterns in ROLE_PATTERNS.items():
            rule = rule.when(_any(t, patterns), F.lit(category))
        return rule

    return bind(strip(F.coalesce(title, F.lit(""))), rules)


def title_level(title: Column, company: Column) -> Column:
    """Seniority of a title: words that hold everywhere, then the company's own grades, else ``mid``."""

    def rules(x: Column) -> Column:
        t, owner = x["title"], x["company"]
        (first, patterns), *rest = GENERIC_LEVEL_PATTERNS
        rule = F.when(_any(t, patterns), F.lit(first))
        for level, patterns in rest:
            rule = rule.when(_any(t, patterns), F.lit(level))
        for name, grades in COMPANY_LEVEL_PATTERNS.items():
            for level, pattern in grades:
                rule = rule.when((owner == name) & _any(t, [pattern]), F.lit(level))
        return rule.otherwise(F.lit("mid"))

    return bind(
        F.struct(
            strip(F.coalesce(title, F.lit(""))).alias("title"),
            F.lower(strip(F.coalesce(company, F.lit("")))).alias("company"),
        ),
        rules,
    )


def resolve_level(given: Column, title: Column, company: Column) -> Column:
    """Keep an upstream level that is known, else derive it from the title."""
    value = F.lower(optional_string(given))
    return F.when(value.isin(list(LEVELS)), value).otherwise(title_level(title, company))
