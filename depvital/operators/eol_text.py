"""End-of-life announcements in text.

Detection is a column expression: a document is read whole and never leaves its row, so a corpus is
scanned without a shuffle. One cheap trigger test guards the sentence work, which only the few documents
with a trigger phrase reach.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depvital.functions import phrases as P
from depvital.functions.binding import let

_SPACE = " \t\n\r\x0b\x0c"


@dataclass(frozen=True)
class Profile:
    """What differs between registry descriptions, READMEs and short messages."""

    explicit: str
    successors: tuple[tuple[str, int], ...]
    negatives: tuple[str, ...]
    tokens: tuple[str, ...]
    drops_self: bool
    trims_changelog: bool


PROFILES = {
    "registry": Profile(
        P.REGISTRY_EXPLICIT,
        P.REGISTRY_SUCCESSORS,
        P.DOCUMENT_NEGATIVES + P.REGISTRY_NEGATIVES,
        ("this project", "this package"),
        drops_self=True,
        trims_changelog=True,
    ),
    "readme": Profile(
        P.README_EXPLICIT,
        P.README_SUCCESSORS,
        P.DOCUMENT_NEGATIVES,
        ("this project", "this package", "this repository", "this repo"),
        drops_self=True,
        trims_changelog=False,
    ),
    "message": Profile(
        P.MESSAGE_EXPLICIT,
        P.MESSAGE_SUCCESSORS,
        P.DOCUMENT_NEGATIVES,
        ("this project", "this package"),
        drops_self=False,
        trims_changelog=False,
    ),
}

# what a sentence must contain for a strong or contextual hit: cheap substrings first, then one pattern
_HINTS = (*P.STRONG_PHRASES, "eol", "life", "read-only", "will", "until", "after")
_EXPLICIT_HINTS = (
    "this project", "this package", "this repo", "no longer maintained", "no longer supported", "reached end of life",
    "final release",
)
_TRIGGER = "|".join(
    [re.escape(p) for p in P.STRONG_PHRASES]
    + [r"\beol\b", r"end[\s-]?of[\s-]?life", r"read-only\s+mode", r"will\s+be\s+(removed|retired|sunset)"]
    + [r"(?:support\s+(?:continues|provided)|security\s+fixes)\s+until", r"\bafter\s+[\w-]"]
)


def _any_of(text: Column, words: Iterable[str]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | text.contains(word)
    return found


def _has_token(lowered: Column, profile: Profile, name: Column) -> Column:
    return _any_of(lowered, profile.tokens) | ((name != "") & lowered.contains(name))


def _cut(text: Column) -> Column:
    return F.btrim(text, F.lit(_SPACE))


def split_sentences(text: Column) -> Column:
    """Non-blank pieces that end after . ! ? or a line break, in order."""
    pieces = F.split(F.regexp_replace(text, r"([.!?\n])", "$1\x1f"), "\x1f")
    return F.filter(F.transform(pieces, _cut), lambda s: s != "")


def successor_in(text: Column, patterns: Iterable[tuple[str, int]]) -> Column:
    """Name after the first pattern that yields one; NULL when none does."""
    found = []
    for pattern, group in patterns:
        name = F.btrim(F.regexp_extract(text, pattern, group), F.lit(P.SUCCESSOR_TRIM))
        found.append(F.when(name != "", name))
    return F.coalesce(*found)


def announced_date(text: Column) -> Column:
    """Date of the first date-bearing pattern; NULL when there is none."""
    found = []
    for _, pattern, group in P.CONTEXTUAL_PATTERNS:
        if group:
            date = _cut(F.regexp_extract(text, pattern, group))
            found.append(F.when(date != "", date))
    return F.coalesce(*found)


def _hit(kind: Column | str, phrase: Column, date: Column | None = None) -> Column:
    return F.struct(
        (kind if isinstance(kind, Column) else F.lit(kind)).alias("kind"),
        phrase.alias("phrase"),
        (date if date is not None else F.lit(None).cast("string")).alias("date"),
    )


def _strong_phrase(lowered: Column, token: Column) -> Column:
    """First catalogue phrase in the sentence; ambiguous ones need a mention of the project."""
    catalogue = F.array(*[F.lit(p) for p in P.STRONG_PHRASES])
    fits = F.filter(
        catalogue, lambda p: F.contains(lowered, p) & (token | ~p.isin(*P.AMBIGUOUS_PHRASES))
    )
    return F.get(fits, F.lit(0))


def _contextual_index(lowered: Column) -> Column:
    chain = None
    for i, (_, pattern, _) in enumerate(P.CONTEXTUAL_PATTERNS):
        test = lowered.rlike(pattern)
        chain = F.when(test, i) if chain is None else chain.when(test, i)
    return chain


def _date_of(sentence: Column, index: Column) -> Column:
    chain = None
    for i, (_, pattern, group) in enumerate(P.CONTEXTUAL_PATTERNS):
        if group:
            date = _cut(F.regexp_extract(sentence, pattern, group))
            chain = F.when(index == i, date) if chain is None else chain.when(index == i, date)
    return F.nullif(chain, F.lit(""))


def _sentence_hit(sentence: Column, lowered: Column, profile: Profile, name: Column) -> Column:
    """Strong phrase, else contextual pattern, of one sentence; NULL when it has neither."""
    contextual = let(
        _contextual_index(lowered),
        lambda i: F.when(i.isNotNull(), _hit("contextual", F.lit("end of life"), _date_of(sentence, i))),
    )
    found = let(
        _strong_phrase(lowered, _has_token(lowered, profile, name)),
        lambda p: F.when(p.isNotNull(), _hit("strong", p)).otherwise(contextual),
    )
    return F.when(~_any_of(lowered, P.SENTENCE_NEGATIVES), found)


def _first_hit(body: Column, lowered: Column, profile: Profile, name: Column) -> Column:
    """Hit of the first sentence that has one. Patterns only see sentences with a hint in them."""
    # the kind of mark does not matter to the patterns, so a plain split at one character will do
    pieces = lambda text: F.split(F.translate(text, "!?\n", "..."), r"\.")

    def judge(sentences: Column) -> Column:
        hits = F.transform(
            pieces(lowered),
            lambda ls, i: F.when(
                _any_of(ls, _HINTS) & ls.rlike(_TRIGGER), _sentence_hit(F.get(sentences, i), ls, profile, name)
            ),
        )
        return F.get(F.filter(hits, lambda h: h.isNotNull()), F.lit(0))

    return let(pieces(body), judge)


_LEADING_COMPONENTS = (
    r"(?i)^(?:(?=deprecated\s+(?:argument|parameter|function|method|class|module)\b)[^.!?\n]*[.!?\n]\s*)+"
)


def _detect(text: Column, profile: Profile, name: Column) -> Column:
    """Core pass over one text: component sentences at the start are passed over, explicit wording wins,
    then the first sentence with a strong or contextual hit."""

    def judge(body: Column, lowered: Column) -> Column:
        scoped = ~body.rlike(P.COMPONENT_ANYWHERE) | lowered.contains("this project") | lowered.contains("this package")
        explicit = F.when(_any_of(lowered, _EXPLICIT_HINTS), F.regexp_extract(body, profile.explicit, 0)).otherwise("")
        found = let(
            explicit,
            lambda phrase: F.when((phrase != "") & scoped, _hit("explicit", phrase)).otherwise(
                _first_hit(body, lowered, profile, name)
            ),
        )
        return F.when((body != "") & ~body.rlike(P.COMPONENT_AT_START), found)

    cut = _cut(F.regexp_replace(text, _LEADING_COMPONENTS, ""))
    return let(cut, lambda body: let(F.lower(body), lambda lowered: judge(body, lowered)))


def _explicit_anywhere(text: Column, lowered: Column, profile: Profile) -> Column:
    scoped = ~text.rlike(P.COMPONENT_ANYWHERE) | (
        (lowered.contains("this project") | lowered.contains("this package")) & ~text.rlike(P.COMPONENT_AT_START)
    )
    found = F.when(_any_of(lowered, _EXPLICIT_HINTS), F.regexp_extract(text, profile.explicit, 0)).otherwise("")
    return let(found, lambda phrase: F.when((phrase != "") & scoped, _hit("explicit", phrase)))


def before_changelog(text: Column) -> Column:
    """Text before the first changelog heading, unless the heading comes within the first 200 characters."""
    at = F.regexp_instr(text, F.lit(P.CHANGELOG_HEADING))
    return F.when(at > P.CHANGELOG_MIN_PRELUDE, _cut(F.substring(text, F.lit(1), at - 1))).otherwise(text)


def _sentence_around(lowered: Column, phrase: Column) -> Column:
    """Sentence of the phrase's first occurrence; empty when the phrase does not occur."""
    ends = "!?\n"
    at = F.position(phrase, lowered)
    before = F.substring_index(F.translate(F.substring(lowered, F.lit(1), at - 1), ends, "..."), ".", -1)
    rest = F.substring(lowered, at + F.length(phrase), F.length(lowered))
    after = F.substring_index(F.translate(rest, ends, "..."), ".", 1)
    return F.when(at > 0, _cut(F.concat(before, phrase, after))).otherwise("")


def _window_after(text: Column, lowered: Column, phrase: Column) -> Column:
    at = F.position(phrase, lowered)
    window = F.substring(text, at, F.lit(P.SUCCESSOR_WINDOW_CHARS))
    return F.when(at > 0, F.substring_index(window, "\n", P.SUCCESSOR_WINDOW_NEWLINES + 1)).otherwise("")


def eol_announcement(text: Column, name: Column, profile: str) -> Column:
    """Struct (kind, phrase, successor, date) of the announcement in a text; NULL where there is none."""
    rules = PROFILES[profile]
    raw = F.coalesce(text, F.lit(""))
    own_name = F.lower(F.coalesce(name, F.lit("")))

    def judge(doc: Column, lowered: Column, hit: Column, phrase: Column, sentence: Column) -> Column:
        kind = hit["kind"]
        ambiguous = phrase.isin(*P.AMBIGUOUS_PHRASES)
        token = _has_token(sentence, rules, own_name)
        platform = sentence.rlike(P.PLATFORM_VERSION) & ~token
        kept = (
            hit.isNotNull()
            & ~_any_of(sentence, P.SENTENCE_NEGATIVES)
            & ~((kind == "explicit") & ambiguous & ~token)
            & ~(kind.isin("explicit", "strong") & ambiguous & platform)
        )
        successor = successor_in(_window_after(doc, lowered, phrase), rules.successors)
        if rules.drops_self:
            found = successor
            successor = let(found, lambda s: F.when((own_name == "") | (F.lower(s) != own_name), s))
        return F.when(
            kept,
            F.struct(
                kind.alias("kind"),
                hit["phrase"].alias("phrase"),
                successor.alias("successor"),
                F.coalesce(hit["date"], announced_date(doc)).alias("date"),
            ),
        )

    def with_hit(doc: Column, lowered: Column) -> Column:
        core = _detect(before_changelog(doc) if rules.trims_changelog else doc, rules, own_name)
        if rules.trims_changelog:
            core = F.coalesce(_explicit_anywhere(doc, lowered, rules), core)
        return let(
            core,
            lambda hit: let(
                F.lower(hit["phrase"]),
                lambda phrase: let(
                    _sentence_around(lowered, phrase), lambda sentence: judge(doc, lowered, hit, phrase, sentence)
                ),
            ),
        )


    def guarded(doc: Column, lowered: Column) -> Column:
        hinted = _any_of(lowered, _HINTS) | _any_of(lowered, _EXPLICIT_HINTS)
        return F.when(hinted & ~_any_of(lowered, rules.negatives), with_hit(doc, lowered))

    return let(_cut(raw), lambda doc: let(F.lower(doc), lambda lowered: guarded(doc, lowered)))


def detect_eol(docs: DataFrame, profile: str, text: str = "text", name: str = "name") -> DataFrame:
    """Add eol_kind, eol_phrase, eol_successor and eol_date; all NULL where nothing is announced."""
    found = docs.withColumn("_eol", eol_announcement(F.col(text), F.col(name), profile))
    return found.withColumns(
        {f"eol_{field}": F.col(f"_eol.{field}") for field in ("kind", "phrase", "successor", "date")}
    ).drop("_eol")


def phrase_hits(docs: DataFrame, tiers: Iterable[str] = ("strong",), key: str = "doc_id") -> DataFrame:
    """(document, tier, phrase) rows for every catalogue phrase a document contains."""
    lowered = F.lower("text")
    entries = [(tier, phrase) for tier in tiers for phrase in P.PHRASE_TIERS[tier]]
    found = F.array(
        *[
            F.when(F.col("_lower").contains(phrase), F.struct(F.lit(tier).alias("tier"), F.lit(phrase).alias("phrase")))
            for tier, phrase in entries
        ]
    )
    return (
        docs.select(key, lowered.alias("_lower"))
        .select(key, F.explode(F.filter(found, lambda h: h.isNotNull())).alias("hit"))
        .select(key, "hit.*")
    )


def phrase_stats(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Number of documents per catalogue phrase and per labelled pattern; zero rows are listed too."""
    checks = [(tier, p, F.col("_lower").contains(p)) for tier, ps in P.PHRASE_TIERS.items() for p in ps]
    checks += [("contextual", label, F.col("_lower").rlike(pattern)) for label, pattern, _ in P.CONTEXTUAL_PATTERNS]
    checks.append(("explicit", P.EXPLICIT_LABEL, F.col("text").rlike(P.README_EXPLICIT)))
    counted = docs.withColumn("_lower", F.lower("text")).agg(
        *[F.count_if(test).alias(f"c{i}") for i, (_, _, test) in enumerate(checks)]
    )
    rows = F.array(
        *[
            F.struct(F.lit(tier).alias("tier"), F.lit(label).alias("phrase"), F.col(f"c{i}").alias("documents"))
            for i, (tier, label, _) in enumerate(checks)
        ]
    )
    return counted.select(F.explode(rows).alias("r")).select("r.*")


def npm_successor(message: Column, name: Column, full_name: Column) -> Column:
    """Package named after use / moved to / replaced by; a reference to the package itself is dropped."""
    found = []
    for phrase in P.NPM_SUCCESSOR_PHRASES:
        word = F.btrim(F.regexp_extract(message, f"(?i){phrase}\\s*(\\S+)", 1), F.lit(P.NPM_TRIM))
        found.append(F.when(word.rlike(P.NPM_NAME), word))
    candidate = F.coalesce(*found)
    own = (F.lower(candidate) == F.lower(name)) | (F.lower(candidate) == F.lower(full_name))
    return F.when(~F.coalesce(own, F.lit(False)), candidate)


SUMMARY_LIMIT = 200


def normalize_summary(text: Column) -> Column:
    """One line, whitespace collapsed, at most 200 characters with an ellipsis; NULL when blank."""
    line = F.btrim(F.regexp_replace(text, r"(?U)\s+", " "))
    short = F.concat(F.rtrim(F.substring(line, 1, SUMMARY_LIMIT - 1)), F.lit("…"))
    return F.when(line != "", F.when(F.length(line) <= SUMMARY_LIMIT, line).otherwise(short))


def first_sentence(text: Column) -> Column:
    """First paragraph up to . ! ? before whitespace or the end, unless a digit comes before the mark."""
    paragraph = _cut(F.regexp_substr(F.concat(_cut(text), F.lit("\n\n")), F.lit(r"(?s)^.*?(?=\n[ \t\r]*\n)")))
    sentence = F.regexp_extract(paragraph, r"(?s)^(.*?(?<!\d)[.!?])(?:\s|$)", 1)
    return F.when(sentence != "", _cut(sentence)).otherwise(paragraph)


def summaries(docs: DataFrame) -> DataFrame:
    """Package summary over description of repository over description of project, each on one line.

    ``docs`` has key, ecosystem, project_description, repo_description, package_summary.
    """
    package = F.when(F.col("ecosystem") == "pypi", normalize_summary(F.col("package_summary")))
    return docs.select(
        "key",
        F.coalesce(
            package,
            normalize_summary(F.col("repo_description")),
            normalize_summary(F.col("project_description")),
        ).alias("summary"),
        first_sentence(F.col("repo_description")).alias("first_sentence"),
    )
