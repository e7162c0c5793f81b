"""Default rule tables.

Rules are data: every operator takes them as an argument, so a deployment can
pass its own. The defaults below are fixed values chosen for this library.

Patterns use explicit character classes in place of ``\\s``, ``\\w`` and ``.`` so
that a pattern means the same on CRLF logs and on non-ASCII text.
"""

from __future__ import annotations

from dataclasses import dataclass, field

PATH_CHARS = r"[\p{L}\p{N}_./\-]"


@dataclass(frozen=True)
class ExtractRule:
    """A regular expression applied to a whole log.

    ``groups`` is the number of capturing groups: 0 yields the whole match, 1
    the group, 2 or more the text of a tuple of the groups.
    """

    family: str
    pattern: str
    groups: int = 0


@dataclass(frozen=True)
class TypeRule:
    failure_type: str
    phrases: tuple[str, ...]


@dataclass(frozen=True)
class IssueTemplate:
    title: str
    risk_level: str
    priority: int
    estimated_effort: str


@dataclass(frozen=True)
class RiskRules:
    error_patterns: tuple[str, ...]
    file_patterns: tuple[str, ...]
    log_phrases: tuple[str, ...] = ()
    #: Regular expressions for lower-cased logs.
    log_patterns: tuple[str, ...] = ()


@dataclass(frozen=True)
class Override:
    pattern: str
    risk_level: str


@dataclass(frozen=True)
class Team:
    team: str
    patterns: tuple[str, ...]


# --- fixed values: extraction -------------------------------------------------

ERROR_RULES: tuple[ExtractRule, ...] = (
    ExtractRule("test", r"FAILED[ \t]+([^ \t\r\n:]+)::([^ \t\r\n]+)", 2),
    ExtractRule("test", r"AssertionError:[ \t]*([^\r\n]+)", 1),
    ExtractRule("test", r"[0-9]+ tests? failed"),
    ExtractRule("lint", r":[ \t]+([A-Z]{1,3}[0-9]{3,4})[ \t]+([^\r\n]+)", 2),
    ExtractRule("lint", r"would reformat[ \t\r\n]+([^ \t\r\n]+)", 1),
    ExtractRule("build", r"(?m:^)[ \t]*error:[ \t]+([^\r\n]+)", 1),
    ExtractRule("build", r"No module named ['\"]?([^'\"\r\n]+)", 1),
    ExtractRule("build", r"exit code [1-9][0-9]*"),
    ExtractRule("security", r"(CVE-[0-9]{4}-[0-9]{4,7})", 1),
    ExtractRule("security", r"vulnerabilit(?:y|ies) found[^\r\n]*"),
)

# A path is only tried from the first character of an unbroken run (or where the
# previous match ended), which keeps long blobs linear instead of quadratic.
FILE_RULES: tuple[ExtractRule, ...] = (
    ExtractRule(
        "path_line",
        rf"(?:(?<!{PATH_CHARS})|\G)({PATH_CHARS}+\.[A-Za-z0-9]{{1,6}}):[0-9]+",
        1,
    ),
    ExtractRule("frame", r"File \"([^\"\r\n]+)\", line [0-9]+", 1),
    ExtractRule(
        "quoted",
        r"['\"]([\p{L}\p{N}_.\-]*/[\p{L}\p{N}_./\-]*\.[A-Za-z0-9]{1,6})['\"]",
        1,
    ),
    ExtractRule("in_file", r"in file ([^ \t\r\n:'\"]+)", 1),
)

FILE_NOISE: tuple[str, ...] = ("/tmp/", "node_modules/", "site-packages/", "/.cache/")

UNKNOWN = "unknown"

TYPE_RULES: tuple[TypeRule, ...] = (
    TypeRule("linting", ("style problem", "would reformat", "lint error")),
    TypeRule("test_failure", ("assertionerror", "test failed", "tests failed")),
    TypeRule("infrastructure", ("timed out", "no space left", "runner lost")),
    TypeRule("security", ("cve-", "vulnerabilit", "security advisory")),
    TypeRule("dependency", ("no module named", "could not resolve", "version conflict")),
    TypeRule("database", ("operationalerror", "deadlock detected", "migration failed")),
)

# --- fixed values: issues -----------------------------------------------------

BASE_LABEL = "ci-failure"
TITLE_PHRASE = "CI failure"
NEWCOMER_LABEL = "good first issue"
SENIOR_ASSIGNEE = "senior-engineer"

TEMPLATES: dict[str, IssueTemplate] = {
    "linting": IssueTemplate("Code style checks report problems", "safe", 30, "under 1 hour"),
    "test_failure": IssueTemplate("Automated tests break on CI", "tactical", 60, "half a day"),
    "infrastructure": IssueTemplate("Build machines or network unreliable", "strategic", 80, "2 to 3 days"),
    "security": IssueTemplate("Security scanner blocks the build", "strategic", 90, "1 to 2 days"),
}
DEFAULT_TEMPLATE = IssueTemplate("CI failure needs investigation", "tactical", 50, "1 day")

RISK_TAGS: dict[str, str] = {"safe": "[SAFE]", "tactical": "[TACTICAL]", "strategic": "[STRATEGIC]"}
DEFAULT_TAG = "[REVIEW]"
RISK_LEVELS: tuple[str, ...] = ("safe", "tactical", "strategic")

# --- fixed values: risk -------------------------------------------------------

SAFE_RULES = RiskRules(
    error_patterns=(
        r"'[a-z]{1,3}[0-9]{3,4}'",
        r"imported but unused",
        r"line too long",
        r"trailing whitespace",
        r"missing docstring",
        r"unused variable",
    ),
    file_patterns=(r"\.md$", r"\.rst$", r"\.css$", r"(^|/)docs/", r"helpers?\.", r"\.editorconfig$"),
    log_phrases=("ruff --fix", "black .", "isort .", "prettier --write"),
    log_patterns=(r"style problems?, try",),
)
STRATEGIC_RULES = RiskRules(
    error_patterns=(
        r"cve-[0-9]{4}-",
        r"vulnerabilit",
        r"permission denied",
        r"data loss",
        r"deadlock",
        r"out of memory",
        r"no space left",
    ),
    file_patterns=(
        r"(^|/)migrations?/",
        r"\.sql$",
        r"(^|/)auth",
        r"(^|/)deploy/",
        r"Dockerfile",
        r"\.tf$",
        r"payment",
    ),
    log_phrases=("production", "credential", "migration", "rollback", "database", "outage"),
)
TACTICAL_RULES = RiskRules(
    error_patterns=(r"expected [0-9]+", r"keyerror", r"typeerror", r"tests? failed"),
    file_patterns=(r"(^|/)tests?/", r"test_[^/]*\.", r"requirements[^/]*\.txt$"),
)
AUTOFIX_PHRASES: tuple[str, ...] = ("line too long", "imported but unused", "trailing whitespace")

STRATEGIC_THRESHOLD = 0.3
SAFE_THRESHOLD = 0.7

# (name, file pattern) in the order in which they are reported
BLAST_FAMILIES: tuple[tuple[str, str], ...] = (
    ("data store", r"(^|/)migrations?/|\.sql$"),
    ("deployment", r"(^|/)deploy/|Dockerfile|\.ya?ml$"),
    ("sign-in", r"(^|/)auth"),
    ("test suite", r"(^|/)tests?/"),
)
DEFAULT_BLAST = "contained"
#: What is said of groups that are not strategic.
LEVEL_BLAST: dict[str, str] = {"safe": "no running code", "tactical": "one component"}
#: Families that the reasoning for strategic groups names.
NAMED_FAMILIES: tuple[str, ...] = ("data store", "sign-in")
DOCUMENT_FILES = r"\.(md|rst|txt)$|(^|/)docs/"
#: Strategic score from which the reasoning for tactical groups mentions it.
RAISED_SCORE = 0.1

#: What varies between occurrences of one error, in the order of masking; for both engines of regular expressions.
VARIABLE_PARTS: tuple[tuple[str, str], ...] = (
    (r"[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2})?)?", "<when>"),
    (r"\b[0-9]{2}:[0-9]{2}:[0-9]{2}\b", "<when>"),
    (r"0x[0-9a-fA-F]+", "<address>"),
    (r"/[^ \t\r\n]*/", "/.../"),
    (r":[0-9]+", ":<n>"),
)

OVERRIDES: tuple[Override, ...] = (
    Override("deploy/*", "strategic"),
    Override("*/module_1*.py", "safe"),
    Override("tests/*", "tactical"),
)
TEAMS: tuple[Team, ...] = (
    Team("platform", ("deploy/*", "*.yaml")),
    Team("data", ("*.sql",)),
    Team("quality", ("tests/*",)),
    Team("core", ("src/*", "*/src/*")),
)

# --- fixed values: similarity -------------------------------------------------

STOP_WORDS: tuple[str, ...] = (
    "a", "an", "and", "are", "at", "by", "for", "from", "in", "is", "of", "on", "the", "to",
)


@dataclass(frozen=True)
class Weights:
    title: float = 0.30
    labels: float = 0.25
    risk: float = 0.20
    body: float = 0.15
    failure_type: float = 0.10


WEIGHTS = Weights()
DUPLICATE_THRESHOLD = 0.8
EXACT_THRESHOLD = 0.95
CANDIDATE_CAP = 20
MIN_TERM_CHARS = 3

# --- fixed values: structured responses ---------------------------------------

REQUIRED_KEYS: tuple[str, ...] = (
    "title", "risk_level", "priority", "estimated_effort", "required_expertise",
)
OPTIONAL_KEYS: tuple[str, ...] = (
    "risk_reason", "root_cause", "impact", "suggested_fix", "verification", "prevention",
)
#: Keys whose values are lists of texts.
LIST_KEYS: tuple[str, ...] = ("commands", "related_files")


@dataclass(frozen=True)
class RuleSet:
    """All rule tables of one deployment."""

    errors: tuple[ExtractRule, ...] = ERROR_RULES
    files: tuple[ExtractRule, ...] = FILE_RULES
    noise: tuple[str, ...] = FILE_NOISE
    types: tuple[TypeRule, ...] = TYPE_RULES
    templates: dict[str, IssueTemplate] = field(default_factory=lambda: dict(TEMPLATES))
    default_template: IssueTemplate = DEFAULT_TEMPLATE
    safe: RiskRules = SAFE_RULES
    strategic: RiskRules = STRATEGIC_RULES
    tactical: RiskRules = TACTICAL_RULES
    autofix: tuple[str, ...] = AUTOFIX_PHRASES
    blast: tuple[tuple[str, str], ...] = BLAST_FAMILIES
    overrides: tuple[Override, ...] = OVERRIDES
    teams: tuple[Team, ...] = TEAMS
    variable_parts: tuple[tuple[str, str], ...] = VARIABLE_PARTS
    level_blast: dict[str, str] = field(default_factory=lambda: dict(LEVEL_BLAST))
    document_files: str = DOCUMENT_FILES
    strategic_threshold: float = STRATEGIC_THRESHOLD
    safe_threshold: float = SAFE_THRESHOLD


#: Rules for running text and web pages: addresses, links and licence lines instead of errors, paths instead of files.
TEXT_RULES = RuleSet(
    errors=(
        ExtractRule("link", r"https?://[^ \t\r\n\"'<>]+"),
        ExtractRule("mail", r"\b[a-z0-9._%+-]{1,64}@[a-z0-9-]{1,63}\.[a-z0-9.-]{1,63}"),
        ExtractRule("licence", r"licen[sc]e[^\r\n<]*"),
        ExtractRule("version", r"version [0-9]+(?:\.[0-9]+)*"),
    ),
    files=(ExtractRule("path", r"(?:href|src)=\"(/[^\"\r\n]*)\"", 1),),
    noise=(),
    types=(
        TypeRule("page", ("<!doctype html", "<html")),
        TypeRule("licence", ("all rights reserved", "licensed under", "redistributions of")),
        TypeRule("contact", ("@mail", "+1 (")),
        TypeRule("list", (" | ",)),
    ),
)

DEFAULT_RULES = RuleSet()
