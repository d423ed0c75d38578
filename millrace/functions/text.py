"""Text functions: columns in, columns out, all built from JVM-side expressions."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Language keywords that say nothing in a match.
CODE_WORDS = """public private protected static final void class interface enum import package return new this null true
false int long double float char byte short boolean string extends implements throws throw try catch finally if else for
while do switch case break continue default abstract synchronized instanceof super override""".split()
# What marks a statement's kind, the first kind whose words occur wins.
BEHAVIOUR_WORDS = {
    "NEGATIVE": ["reject", "deny", "denied", "invalid", "missing", "no match", "no-match", "not create", "not modify", "not expose"],
    "BOUNDARY": ["exactly", "greater than", "less than", "below", "at least", "after five", "after 5", "threshold", "expire", "larger than"],
    "STATE": ["remain locked", "state", "persist", "associated", "reset", "remain unchanged"],
}
# Patterns of measurable constraints, in the order in which they are listed.
CONSTRAINTS = (
    r"\bp\d{2}\b",
    r"\b\d+(?:\.\d+)?\s*percent\b",
    r"\b\d+(?:\.\d+)?\s*%\b",
    r"\b\d+(?:\.\d+)?\s*milliseconds?\b",
    r"\b\d+(?:\.\d+)?\s*seconds?\b",
    r"\b\d+(?:\.\d+)?\s*minutes?\b",
    r"\b\d+(?:\.\d+)?\s*hours?\b",
    r"\b\d+\s+concurrent\s+users?\b",
    r"\b(?:\d+|one|two|three|four|five|six|seven|eight|nine|ten)\s+(?:consecutive\s+)?(?:failed\s+)?(?:authentication\s+)?attempts?\b",
    r"\b\d+(?:\.\d+)?\s*MB\b",
)


def collapse(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"[ \t\n\r\f\x0B]+", " "))


def normalize(text: Column) -> Column:
    """Lower case, collapsed white space, without the quotes around the whole."""
    return F.lower(F.regexp_replace(collapse(text), "^\"(.*)\"$", "$1"))


def text_key(text: Column) -> Column:
    """ASCII letters and digits of the text in lower case: equal keys mean the same text."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def content_hash(*parts: Column) -> Column:
    """SHA-256 of the collapsed parts, joined by NUL."""
    return F.sha2(F.concat_ws("\0", *map(collapse, parts)), 256)


def tokens(text: Column, stop: Sequence[str] = ()) -> Column:
    """Distinct tokens of letters and digits in lower case, without stop words."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0))
    return F.array_except(found, F.array(*map(F.lit, stop))) if stop else found


def identifier_words(text: Column, stop: Sequence[str] = CODE_WORDS) -> Column:
    """Words inside camelCase and snake_case names, without single letters and language keywords."""
    split = F.regexp_replace(F.regexp_replace(text, "([a-z])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    words = F.transform(F.regexp_extract_all(split, F.lit("[A-Za-z]+"), 0), F.lower)
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*stop))


# Page directives, tags and script marks, import and package lines, a comment in front, what makes it legal.
DIRECTIVE, TAG, SCRIPT_MARK = r"(?s)<%@.*?%>", "<[a-zA-Z/!][^>]*>", "<%[=!-]?|%>"
HEADER_LINE = r"(?m)^\s*(?:import|package)\s+[^\n]*$"
FIRST_COMMENT = r"(?s)\A\s*/\*(?!\*)(.*?)\*/"
LEGAL = "(?i)copyright|licen[sc]e"


def strip_boilerplate(code: Column) -> Column:
    """Source text without import and package lines, page directives and tags, and a leading licence comment."""
    paged = code
    for pattern in (DIRECTIVE, TAG, SCRIPT_MARK):
        paged = F.regexp_replace(paged, pattern, " ")
    bare = F.regexp_replace(F.when(F.contains(F.substring(code, 1, 2000), F.lit("<%")), paged).otherwise(code), HEADER_LINE, "")
    head = F.regexp_extract(bare, FIRST_COMMENT, 0)
    return F.trim(F.regexp_replace(F.when(head.rlike(LEGAL), F.substring(bare, F.length(head) + 1, F.length(bare))).otherwise(bare), r"\n{3,}", "\n\n"))


def words_of(text: Column) -> Column:
    return F.filter(F.split(collapse(text), " "), lambda w: w != "")


def chunks(text: Column, size: int, overlap: int | None = None) -> Column:
    """Overlapping windows of ``size`` words; the text itself if it fits into one."""
    step = max(1, size - (size // 4 if overlap is None else overlap))
    # the words are bound once: written out in the inner function they would be split again for every window
    many = F.element_at(F.transform(F.array(words_of(text)), lambda w: F.when(F.size(w) > size, F.transform(F.sequence(F.lit(1), F.size(w), F.lit(step)), lambda i: F.array_join(F.slice(w, i, size), " ")))), 1)
    return F.coalesce(many, F.when(text.isNotNull(), F.array(text)))


def sentences(text: Column) -> Column:
    """Parts that end at ., ! or ? before a capital, a digit or an opening quote or bracket."""
    return F.filter(F.split(text, "(?<=[.!?])\\s+(?=[A-Z0-9\"“(\\[])"), lambda s: F.trim(s) != "")


def any_word(words: Sequence[str]) -> str:
    """Pattern of any of the words as a whole word, the longest first; captures the word in group 2."""
    return "(?i)(^|[^a-z0-9])(" + "|".join(re.escape(w) for w in sorted(words, key=lambda w: (-len(w), w))) + ")([^a-z0-9]|$)"


def weak_words(text: Column, words: Sequence[str]) -> tuple[Column, Column]:
    """Whether a weak word occurs (``defect`` or ``ok``) and the first that does."""
    pattern = any_word(words)
    return F.when(text.rlike(pattern), "defect").otherwise("ok"), F.lower(F.regexp_extract(text, pattern, 2))


def cue_type(text: Column, quality: str, function: str) -> tuple[Column, Column]:
    """``NFR`` or ``FR`` if cues of one kind only occur, else ``unknown``; and the first cue."""
    nfr, fr = text.rlike(quality), text.rlike(function)
    kind = F.when(nfr & ~fr, "NFR").when(fr & ~nfr, "FR").otherwise("unknown")
    cue = F.when(nfr & ~fr, F.lower(F.regexp_extract(text, quality, 0))).when(fr & ~nfr, F.lower(F.regexp_extract(text, function, 0))).otherwise("")
    return kind, cue


def rule_labels(text: Column, rules: Mapping[str, str]) -> Column:
    """Names of all rules whose pattern occurs, in the rules' order."""
    return F.filter(F.array(*(F.when(text.rlike(p), F.lit(n)) for n, p in rules.items())), lambda x: x.isNotNull())


def behaviour(text: Column, words: Mapping[str, Sequence[str]] = BEHAVIOUR_WORDS) -> Column:
    low, out = F.lower(text), F.lit("POSITIVE")
    for kind, found in reversed(list(words.items())):
        hit = F.lit(False)
        for w in found:
            hit |= F.contains(low, F.lit(w))
        out = F.when(hit, kind).otherwise(out)
    return out


def constraints(text: Column, patterns: Sequence[str] = CONSTRAINTS) -> Column:
    """Distinct matches of all patterns, pattern after pattern."""
    return F.array_distinct(F.flatten(F.array(*(F.regexp_extract_all(text, F.lit(f"(?i){p}"), 0) for p in patterns))))


def atomic_parts(text: Column, modals: Sequence[str], verbs: Sequence[str]) -> Column:
    """Parts of a criterion: one, or two where a second clause follows ``and`` after the modal verb.

    Each is a struct (text, start, end, confidence, review): the second part gets the subject and the modal again.
    """
    clean = collapse(text)
    modal_at = F.regexp_instr(clean, F.lit(rf"(?i)\b(?:{'|'.join(modals)})\b"))
    modal = F.regexp_extract(clean, rf"(?i)\b({'|'.join(modals)})\b", 1)
    after = F.when(modal_at > 0, F.substring(clean, modal_at + F.length(modal), F.length(clean))).otherwise("")
    joint = F.regexp_extract(after, rf"(?i)\s+and\s+(?=(?:{'|'.join(verbs)})\b)", 0)
    at = F.regexp_instr(after, F.lit(rf"(?i)\s+and\s+(?=(?:{'|'.join(verbs)})\b)"))
    cut = modal_at + F.length(modal) - 1 + at - 1
    ended = lambda s: F.when(s.rlike(r"[.!?]$"), s).otherwise(F.concat(s, F.lit(".")))
    part = lambda t, s, e, c, r: F.struct(t.alias("text"), s.cast("int").alias("start"), e.cast("int").alias("end"), F.lit(c).alias("confidence"), F.lit(r).cast("string").alias("review"))
    left = F.trim(F.substring(clean, F.lit(1), cut))
    right_at = cut + F.length(joint)
    right = F.trim(F.substring(clean, right_at + 1, F.length(clean)))
    again = F.trim(F.concat_ws(" ", F.trim(F.substring(clean, F.lit(1), modal_at - 1)), modal, right))
    whole = F.length(clean)
    return (
        F.when(modal_at == 0, F.array(part(clean, F.lit(0), whole, 0.80, "no modal verb")))
        .when(at == 0, F.array(part(ended(clean), F.lit(0), whole, 0.96, None)))
        .otherwise(F.array(part(ended(left), F.lit(0), cut, 0.92, None), part(ended(again), right_at, whole, 0.88, None)))
    )


def package_name(source: Column) -> Column:
    return F.regexp_extract(source, r"(?m)^\s*package\s+([\w.]+)\s*;", 1)


def imports(source: Column, static: bool = False, wildcard: bool = False) -> Column:
    """Imported names; whether static and wildcard imports count is up to the caller, as analyses differ in it."""
    name = r"[\w.*]+" if wildcard else r"[\w.]+"
    return F.regexp_extract_all(source, F.lit(rf"(?m)^\s*import\s+{'(?:static\\s+)?' if static else ''}({name})\s*;"), 1)


def declared_types(source: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(source, F.lit(r"\b(?:class|interface|enum|record)\s+([A-Za-z_]\w*)"), 1))


def package_of_path(path: Column) -> Column:
    """Package from a source path: what follows the last ``java`` folder, else ``source`` or ``src``."""
    folders = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))

    def after(name: str) -> Column:
        back = F.array_position(F.reverse(folders), F.lit(name))
        start = F.size(folders) - back + 2
        return F.when(back > 0, F.array_join(F.slice(folders, start.cast("int"), F.greatest(F.size(folders) - start + 1, F.lit(0)).cast("int")), "."))

    found = F.coalesce(after("java"), after("source"), after("src"))
    return F.when(found.isNull(), "unresolved").when(found == "", "default").otherwise(found)


def line_class(line: Column) -> Column:
    """What a line is: blank, page number, heading number, bullet, capitals, or text."""
    t = F.trim(line)
    letters = F.regexp_replace(t, "[^A-Za-z]", "")
    return (
        F.when(t == "", "blank")
        .when(t.rlike("^(?i)(page )?[0-9]+( of [0-9]+)?$"), "page_number")
        .when(t.rlike(r"^[0-9]+(\.[0-9]+)*\.? "), "numbered")
        .when(t.rlike(r"^[-*•] "), "bullet")
        .when((F.length(letters) > 3) & (letters == F.upper(letters)), "capitals")
        .otherwise("text")
    )


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """Every match of ``pattern``, none of which may be empty: structs (at, whole, text) of the place, from 0, the match
    and its group.

    A match begins where the parts before it, split at the pattern, and the matches before it end.
    """
    length = lambda parts: F.aggregate(parts, F.lit(0), lambda n, p: n + F.length(p))

    def placed(parts: Column) -> Column:
        at = lambda i: length(F.slice(parts["between"], F.lit(1), i + 1)) + length(F.slice(parts["whole"], F.lit(1), i))
        return F.transform(parts["group"], lambda m, i: F.struct(at(i).alias("at"), F.get(parts["whole"], i).alias("whole"), m.alias("text")))

    # the parts are bound once: written out in the inner function they would be cut again for every match
    found = (F.regexp_extract_all(text, F.lit(pattern), g) for g in (0, group))
    parts = F.struct(F.split(text, pattern, -1).alias("between"), *(f.alias(n) for f, n in zip(found, ("whole", "group"))))
    return F.when(text.isNotNull(), F.element_at(F.transform(F.array(parts), placed), 1))


def jaccard(a: Column, b: Column, empty: float = 0.0) -> Column:
    """Jaccard similarity of two arrays of distinct values."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(empty)).otherwise(F.size(F.array_intersect(a, b)) / union)


def grounded(quote: Column, text: Column, least: int = 8) -> Column:
    """Whether every piece of a quote (split at dots of omission) of ``least`` squashed characters is in the text."""
    pieces = F.filter(F.transform(F.split(quote, r"\.\.\.|…"), text_key), lambda p: F.length(p) >= least)
    return (F.size(pieces) > 0) & F.forall(pieces, lambda p: F.contains(text_key(text), p))
