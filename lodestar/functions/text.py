"""Column expressions over identifiers and prose."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The English stop words of the standard analyzer.
STOP_WORDS = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()
# Phrases that mark text as an attempt to steer a reader that is a model.
SUSPICIOUS = [r"ignore\s+previous\s+instructions?", r"you\s+are\s+now\b", r"\bsystem\s+prompt\b", r"forget\s+everything", r"\bact\s+as\b", r"\bdisregard\b"]


def camel_parts(token: str) -> list[str]:
    """The camel-case parts of a token: a capital behind a small letter begins one, and a capital behind a capital if a small letter follows."""
    kind = ["U" if "A" <= c <= "Z" else "l" if "a" <= c <= "z" else "-" for c in token] + ["-"]
    cuts = [i for i in range(1, len(token)) if kind[i] == "U" and (kind[i - 1] == "l" or (kind[i - 1] == "U" and kind[i + 1] == "l"))]
    return [token[a:b] for a, b in zip([0, *cuts], [*cuts, len(token)])]


def camel_tokens(text: Column) -> Column:
    """Lower-cased tokens between white space, each followed by its camel-case parts (see camel_parts) if it has several."""
    def expand(token: Column) -> Column:
        # tokens have no space, so one can mark where a part begins
        spaced = F.regexp_replace(F.regexp_replace(token, "([A-Z])([A-Z][a-z])", "$1 $2"), "([a-z])([A-Z])", "$1 $2")
        parts = F.split(spaced, " ")
        return F.when(F.size(parts) > 1, F.concat(F.array(token), parts)).otherwise(F.array(token))

    tokens = F.filter(F.split(F.coalesce(text, F.lit("")), "[ \\t\\r\\n]+"), lambda t: t != "")
    return F.transform(F.flatten(F.transform(tokens, expand)), F.lower)


def standard_tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits, _ and ' without stop words; repeats stay."""
    tokens = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[\\p{L}\\p{N}_']+"), F.lit(0))
    return F.filter(tokens, lambda t: ~t.isin(STOP_WORDS))


def marked(text: Column) -> Column:
    """text with each suspicious phrase wrapped, pattern after pattern; null gives an empty string."""
    return reduce(lambda c, p: F.regexp_replace(c, f"(?i)({p})", "[SUSPICIOUS: $1]"), SUSPICIOUS, F.coalesce(text, F.lit("")))


def is_suspicious(text: Column) -> Column:
    """Whether marking would change text (wrapping never makes or breaks another phrase's match)."""
    return F.coalesce(reduce(lambda a, p: a | text.rlike(f"(?i){p}"), SUSPICIOUS, F.lit(False)), F.lit(False))


def redacted(text: Column, patterns: list[str]) -> Column:
    return reduce(lambda c, p: F.regexp_replace(c, f"(?i){p}", "[REDACTED]"), patterns, text)


def last_segment(text: Column) -> Column:
    """What follows the last dot."""
    return F.element_at(F.split(text, r"\."), -1)


def namespace_of(fqn: Column) -> Column:
    """A fully qualified name up to its last dot, or (global)."""
    return F.when(F.coalesce(fqn.contains("."), F.lit(False)), F.regexp_replace(fqn, r"\.[^.]*$", "")).otherwise("(global)")


def base_name(path: Column) -> Column:
    """A path's file name without its extension."""
    return F.regexp_replace(F.element_at(F.split(path, r"[/\\]"), -1), r"\.[^.]*$", "")


def is_test_file(path: Column, suffixes: tuple[str, ...] = ("Test", "Tests", "Fixture", "Spec", "Specs", "Steps")) -> Column:
    """Whether a source file is a test by its base name; names that begin with Base never are."""
    name = F.lower(base_name(path))
    ends = reduce(lambda a, s: a | name.endswith(s.lower()), suffixes, F.lit(False))
    return ends & ~name.startswith("base")


def is_test_project(name: Column) -> Column:
    return F.lower(name).rlike(r"\.(tests|test|specs)$")
