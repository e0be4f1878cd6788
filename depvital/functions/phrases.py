"""Word lists and patterns of the end-of-life text rules."""

from __future__ import annotations

# --- fixed values: phrase catalogue by tier -----------------------------------
STRONG_PHRASES = (
    "no longer maintained",
    "this project has been discontinued",
    "no longer supported",
    "deprecated permanently",
    "superseded by",
    "replaced by",
    "retired",
    "decommissioned",
    "development halted",
    "end of maintenance",
    "maintenance ended",
)
REEVALUATE_PHRASES = (
    "deprecated",
    "end of life",
    "end-of-life",
    "end of support",
    "end-of-support",
    "unmaintained",
    "abandoned",
    "discontinued",
    "sunset",
    "no further development",
    "no further updates",
    "will not be updated",
)
SNIPPET_PHRASES = (
    "deprecation",
    "deprecating",
    " eol",
    "eol ",
    " eol.",
    " eol,",
    "unmaintain",
    "no longer updated",
    "archived",
    "this repository is archived",
    "migrated to",
    "moved to",
    "renamed to",
    "maintenance mode",
    "maintenance-mode",
    "will be deprecated",
    "relocated",
    "relocation",
    "final release",
    "sunsetting",
    "project sunset",
    "obsolete",
    "obsoleted",
    "read-only mode",
    "minimal maintenance",
    "limited maintenance",
    "maintenance updates only",
    "bugfix only",
    "community driven",
    "community maintained",
    "successor is",
    "consolidated into",
    "integrated into",
    "will be removed",
    "will be retired",
    "will be sunset",
    "support until",
    "security fixes until",
)
PHRASE_TIERS = {"strong": STRONG_PHRASES, "reevaluate": REEVALUATE_PHRASES, "snippet": SNIPPET_PHRASES}

# strong phrases that count only next to a mention of the project itself
AMBIGUOUS_PHRASES = (
    "no longer supported",
    "no longer maintained",
    "no further development",
    "no further updates",
    "will not be updated",
)
DOCUMENT_NEGATIVES = ("not deprecated", "still maintained")
REGISTRY_NEGATIVES = ("will be deprecated",)
SENTENCE_NEGATIVES = ("actively maintained", "actively developed", "under active development", "still active")

# --- fixed values: patterns ----------------------------------------------------
_EOL = r"(end[\s-]?of[\s-]?life|eol)"
_THING = r"(project|artifact|library|module|package|component|release|version)"
_DATE = r"(\d{4}[-/]\d{2}[-/]\d{2}|\w+\s+\d{1,2},?\s+\d{4})"
# (label, pattern, group that holds a date or 0)
CONTEXTUAL_PATTERNS = (
    (
        "verb + end-of-life/eol",
        r"\b(has\s+(reached|entered)|reaches|entered|is|are|becomes|becoming|will\s+(be|reach|enter)"
        r"|was|were|has\s+been|have\s+been)\s+" + _EOL + r"\b",
        0,
    ),
    ("end-of-life for/of this project", r"\b" + _EOL + r"\s+(for|of|on)\s+(this|the)\s+" + _THING + r"\b", 0),
    ("end-of-life near project/package", r"\b" + _EOL + r"\b(?:\W+\w+){0,4}\s+\b" + _THING + r"\b", 0),
    ("moved into read-only mode", r"(?i)moved\s+into\s+read-only\s+mode", 0),
    (
        "will be retired/removed on DATE",
        r"(?i)\bwill\s+be\s+(removed|retired|sunset|sunsetted)\s+(on|by)\s+" + _DATE,
        3,
    ),
    ("support continues/provided until DATE", r"(?i)\bsupport\s+(continues|provided)\s+until\s+" + _DATE, 2),
    ("security fixes until DATE", r"(?i)\bsecurity\s+fixes\s+until\s+" + _DATE, 1),
    ("after DATE no support/updates", r"(?i)\bafter\s+" + _DATE + r"\s+(no|without)\s+(support|updates)", 1),
)
_STATE = r"(is )?(now )?(deprecated|unmaintained|abandoned|dead|sunset|sunsetted|decommissioned|obsoleted)"
README_EXPLICIT = (
    r"(?i)\b(this (project|package|repository|repo) " + _STATE + r"|sunsetting this (project|package|repository)"
    r"|consider this (project|package|repository|repo) (obsolete|archived|deprecated)"
    r"|no longer (maintained|supported)|reached end of life|final release)\b"
)
REGISTRY_EXPLICIT = (
    r"(?i)\b(this (project|package) " + _STATE + r"|no longer (maintained|supported)"
    r"|reached end of life|final release)\b"
)
MESSAGE_EXPLICIT = r"(?i)\b(this (project|package) " + _STATE + r"|final release)\b"
EXPLICIT_LABEL = "this project/package is deprecated/..."
COMPONENT_ANYWHERE = r"(?i)deprecated (argument|parameter|function|method|class|module)"
COMPONENT_AT_START = r"(?i)^\s*deprecated\s+(argument|parameter|function|method|class|module)\b"
PLATFORM_VERSION = (
    r"^(python|node(?:\.js)?|nodejs|ruby|java|go|golang|php|perl|rust|dotnet|\.net|c#|c\+\+|scala|kotlin|swift"
    r"|elixir|erlang|haskell)\s+[0-9]"
)
CHANGELOG_HEADING = (
    r"(?im)^\s{0,3}(?:#{1,6}\s*)?(?:change\s*log|changelog|release\s+notes|history|version\s+history)\s*:?\s*$"
)
CHANGELOG_MIN_PRELUDE = 200

_NAME = r"([A-Za-z0-9][A-Za-z0-9._-]+)"
_SCOPED = r"(@?[A-Za-z0-9][A-Za-z0-9._@/\-]*)"
# (pattern, group of the name), tried in order
REGISTRY_SUCCESSORS = (
    (r"(?i)deprecated[^\.\n]*?use\s+" + _NAME + r"\s+instead", 1),
    (r"(?i)use\s+" + _NAME + r"\s+instead", 1),
    (r"(?i)replaced\s+(by|with)\s+" + _NAME, 2),
    (r"(?i)superseded\s+by\s+" + _NAME, 1),
    (r"(?i)moved\s+to\s+" + _NAME, 1),
    (r"(?i)successor\s+is\s+" + _NAME, 1),
    (r"(?i)consolidated\s+into\s+" + _NAME, 1),
    (r"(?i)integrated\s+into\s+" + _NAME, 1),
)
README_SUCCESSORS = (
    (r"(?i)deprecated[^\.\n]*?use\s+" + _SCOPED + r"\s+instead", 1),
    (r"(?i)use\s+" + _SCOPED + r"\s+instead", 1),
    (r"(?i)replaced\s+(by|with)\s+" + _SCOPED, 2),
    (r"(?i)superseded\s+by\s+" + _SCOPED, 1),
    (r"(?i)moved\s+to\s+" + _SCOPED, 1),
    (r"(?i)renamed\s+to\s+" + _SCOPED, 1),
    (r"(?i)successor\s+is\s+" + _SCOPED, 1),
    (r"(?i)consolidated\s+into\s+" + _SCOPED, 1),
    (r"(?i)integrated\s+into\s+" + _SCOPED, 1),
    (r"(?i)(\w[\w._@/-]*)\s+supersedes", 1),
)
MESSAGE_SUCCESSORS = (
    (r"(?i)replaced\s+(by|with)\s+" + _SCOPED, 2),
    (r"(?i)superseded\s+by\s+" + _SCOPED, 1),
    (r"(?i)moved\s+to\s+" + _SCOPED, 1),
    (r"(?i)use\s+" + _SCOPED + r"\s+instead", 1),
    (r"(?i)successor\s+is\s+" + _SCOPED, 1),
    (r"(?i)consolidated\s+into\s+" + _SCOPED, 1),
    (r"(?i)integrated\s+into\s+" + _SCOPED, 1),
)
SUCCESSOR_WINDOW_CHARS = 400
SUCCESSOR_WINDOW_NEWLINES = 3
SUCCESSOR_TRIM = ".,;:()[]{} "
NPM_SUCCESSOR_PHRASES = ("use ", "moved to ", "replaced by ")
NPM_NAME = r"^(?:@[-a-z0-9_.]+/)?[A-Za-z0-9][A-Za-z0-9._-]*$"
NPM_TRIM = ".,;:!?()[]{}"
