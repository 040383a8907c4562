"""Terms of queries, detections by pattern, and small functions on labels and numbers."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as L
from .text import SPACE, normalize, stem, stem_word, words

WORD = "[A-Za-z0-9_]"
EDGE = f"(?:(?<!{WORD})(?={WORD})|(?<={WORD})(?!{WORD}))"
#: White space as the reference language has it, NBSP and vertical tab included.
BLANK = SPACE[:-1]


def edge(before: str, after: str) -> str:
    """A boundary; where a letter or digit stands next to it for certain, only the other side is looked at."""
    if re.match(r"[A-Za-z0-9_](?![?*{])", after):
        return f"(?<!{WORD})"
    if re.search(r"(?:^|[^\\])[A-Za-z0-9_]$", before):
        return f"(?!{WORD})"
    return EDGE


def java(pattern: str) -> str:
    """A pattern of the lexicon for Spark's engine: boundaries of ASCII words, any case."""
    inside = BLANK[1:-1]
    out, in_class, i = "", False, 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == r"\b":
            out, i = out + edge(pattern[:i], pattern[i + 2 :]), i + 2
        elif two == r"\s":
            out, i = out + (inside if in_class else BLANK), i + 2
        elif two[0] == "\\":
            out, i = out + two, i + 2
        else:
            in_class = (in_class or two[0] == "[") and two[0] != "]"
            out, i = out + two[0], i + 1
    return f"(?i){out}"


def opening(pattern: str) -> str:
    """Small letters that every match of a pattern begins with, in any case; empty where none are certain."""
    flat = pattern
    while (inner := re.sub(r"\([^()]*\)", "", flat)) != flat:
        flat = inner
    said = re.match(r"(?:\\b|\^)?([a-z]+(?: [a-z]+)*)([?*{]?)", pattern)
    return "" if "|" in flat or not said else said[1][:-1] if said[2] else said[1]


def matches(text: Column, patterns: Iterable[str]) -> Column:
    """Whether any of the lexicon's patterns is found; null text has none. A pattern is tried only where its opening stands in the text."""

    def found(t: Column, low: Column) -> Column:
        known = [(opening(p), p) for p in patterns]
        tests = [low.contains(o) & t.rlike(java(p)) for o, p in known if o]
        others = [java(p) for o, p in known if not o]
        return reduce(lambda a, b: a | b, [*tests, *([t.rlike("|".join(f"(?:{p})" for p in others))] if others else [])])

    patterns = list(patterns)
    if not any(map(opening, patterns)):
        return F.coalesce(text, F.lit("")).rlike("|".join(f"(?:{java(p)})" for p in patterns))
    return let(F.coalesce(text, F.lit("")), lambda t: let(F.lower(t), lambda low: found(t, low)))


def mentions(text: Column, phrases: Iterable[str]) -> Column:
    low, out = F.lower(F.coalesce(text, F.lit(""))), F.lit(False)
    for p in phrases:
        out = out | low.contains(p)
    return out


def captured(text: Column, pattern: str) -> Column:
    """The first group of the pattern's first match, white space collapsed; null where there is none."""
    return F.nullif(normalize(F.regexp_extract(F.coalesce(text, F.lit("")), java(pattern), 1)), F.lit(""))


def _without_operators(query: Column) -> Column:
    return F.regexp_replace(F.coalesce(query, F.lit("")), java(r"\b(and|or|not|near)\b"), " ")


def _is_generic(term: Column) -> Column:
    return stem(term).isin(*L.GENERIC_TERMS)


def search_terms(query: Column) -> Column:
    """Distinct terms of a full-text query, each followed by its aliases; generic ones are left out."""
    table = F.create_map(*[x for k, v in L.ALIASES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    kept = lambda t: (F.length(t) > 2) & ~_is_generic(t)
    direct = F.filter(words(_without_operators(query)), kept)
    none = F.array().cast("array<string>")
    wide = F.flatten(F.transform(direct, lambda t: F.concat(F.array(t), F.coalesce(F.try_element_at(table, t), none))))
    return F.array_distinct(F.filter(wide, kept))


def raw_search_terms(query: Column) -> Column:
    """Terms for a search of raw sessions: distinct stems, each followed by its stemmed aliases; generic ones are left out."""
    table = F.create_map(*[x for k, v in L.RAW_ALIASES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    none = F.array().cast("array<string>")
    wide = F.flatten(F.transform(direct_terms(query), lambda t: F.concat(F.array(t), F.transform(F.coalesce(F.try_element_at(table, t), none), stem))))
    return F.array_distinct(F.filter(wide, lambda t: (F.length(t) > 2) & ~t.isin(*L.GENERIC_TERMS)))


def direct_terms(query: Column) -> Column:
    """Stemmed terms of a query, repeats kept, without aliases and generic ones."""
    stems = F.transform(words(_without_operators(query)), stem_word)
    return F.filter(stems, lambda t: (F.length(t) > 2) & ~t.isin(*L.GENERIC_TERMS))


def content_terms(query: Column) -> Column:
    """What a question about a time is about: its direct terms less those that frame it."""
    return F.filter(direct_terms(query), lambda t: ~t.isin(*L.TEMPORAL_SCAFFOLD_TERMS))


def entity_terms(query: Column) -> Column:
    """Distinct stems of names of code: in back ticks, file names, and words of several capitals with their parts."""
    text = F.coalesce(query, F.lit(""))
    bare = lambda t: F.lower(F.regexp_replace(t, "[^A-Za-z0-9]", ""))
    quoted = F.transform(F.regexp_extract_all(text, F.lit("`([^`]+)`"), 1), lambda t: bare(F.regexp_replace(t, r"(?i)\.[a-z]+$", "")))
    files = F.transform(F.regexp_extract_all(text, F.lit(java(r"\b([\w-]+)\.(?:mjs|cjs|js|ts|tsx|json|md|yaml|yml)\b")), 1), bare)
    camel = F.regexp_extract_all(text, F.lit(rf"{EDGE}([A-Za-z][a-z]+(?:[A-Z][a-z]+)+){EDGE}"), 1)
    parts = F.flatten(F.transform(camel, lambda t: F.concat(F.array(F.lower(t)), F.split(F.lower(F.trim(F.regexp_replace(t, "([A-Z])", " $1"))), " +"))))
    long = F.filter(F.concat(quoted, files, parts), lambda t: F.length(t) > 2)
    return F.array_distinct(F.filter(F.transform(long, stem), lambda t: (F.length(t) > 2) & ~t.isin(*L.GENERIC_TERMS)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.transform(F.array(value), body)[0]


def assistant_name(text: Column) -> Column:
    """The name that a text gives the assistant, its first letter large; null where there is none.

    All patterns within a text hold ``call`` or ``name``; those at its beginning end within 64 signs of it.
    """

    def sought(said: Column, low: Column, p: str) -> Column:
        if p.startswith("^"):
            return F.regexp_extract(F.substring(said, 1, 64), java(p), 1)
        return F.when(low.contains("name" if "name" in p else "call"), F.regexp_extract(said, java(p), 1)).otherwise("")

    def named(said: Column) -> Column:
        each = let(F.lower(said), lambda low: F.array(*[sought(said, low, p) for p in L.ASSISTANT_NAMES]))
        found = F.transform(each, lambda n: F.regexp_replace(n, "[^A-Za-z0-9_-]", ""))
        fine = F.filter(found, lambda n: (n != "") & ~F.lower(n).isin(*L.NO_NAMES))
        return F.get(F.transform(fine, lambda n: F.concat(F.upper(F.substring(n, 1, 1)), F.substring(n, 2, 64))), F.lit(0))

    return let(normalize(text), named)


def user_name(text: Column) -> Column:
    """The one capitalised word that a short message gives as its writer's name; null where there is none."""

    def named(said: Column) -> Column:
        without = normalize(F.regexp_replace(F.regexp_replace(said, java(L.GREETINGS[0]), ""), java(L.GREETINGS[1]), ""))
        found = F.flatten(F.transform(F.array(said, without), lambda v: F.array(*[normalize(F.regexp_extract(v, java(p), 1)) for p in L.USER_NAMES])))
        fine = F.filter(found, lambda n: n.rlike(r"^\p{Lu}[\p{L}'’-]*$") & ~F.lower(n).isin(*L.NO_USER_NAMES))
        return F.when(F.length(said) <= 80, F.get(fine, F.lit(0)))

    return let(normalize(text), named)


def meaningful(text: Column) -> Column:
    """A summary less what only opens it; null where it says nothing of the work."""
    plain = normalize(text)
    plain = F.regexp_replace(plain, java(r"^(researching|planning|implementing)\s*:\s*"), "")
    plain = F.regexp_replace(plain, java(r"^(please|ok(?:ay)?|hey)\s+"), "")
    return F.when((plain != "") & ~matches(plain, (L.NOISE_SUMMARIES[0], *L.NOISE_SUMMARIES[2:])), plain)


def canonical_text(text: Column) -> Column:
    plain = F.regexp_replace(F.lower(normalize(text)), "['’\"]", "")
    return normalize(F.regexp_replace(plain, r"[^a-z0-9\s-]", " "))


def canonical_key(type_: Column, content: Column) -> Column:
    """What rows of one meaning share, for the types that have it; null for others."""
    kind, text = F.lower(normalize(type_)), canonical_text(content)
    named = captured(normalize(content), r"preferred name is\s+(.+?)[.!?]*$")
    one_name = F.when(named.rlike(r"^\p{Lu}[\p{L}'’-]*$"), canonical_text(named))
    of_text = kind.isin("assistant_goal", "recurring_mistake", "workstream_overlay")
    return F.when(kind == "user_identity", F.concat(F.lit("user_identity:"), one_name)).when(of_text & (text != ""), F.concat_ws(":", kind, text))


def is_noise(summary: Column) -> Column:
    """Placeholders, generic work and tool calls: summaries that tell nothing."""
    return matches(normalize(summary), L.NOISE_SUMMARIES)


def uncorrected(text: Column) -> Column:
    """A correcting turn less the words that say that it corrects."""
    out = normalize(text)
    for p in L.CORRECTION_LEADS:
        out = F.regexp_replace(out, java(p), "")
    return F.trim(out)


def themes(summary: Column, repository: Column) -> Column:
    """The last two parts of the repository's name and the first five long words, eight at most."""
    parts = lambda t: F.split(F.regexp_replace(F.lower(normalize(t)), r"[^a-z0-9\s/-]", " "), r"\s+")
    of = lambda ws: F.slice(F.filter(ws, lambda w: F.length(w) > 4), 1, 5)
    # where the text's beginning, less its last and maybe cut word, has all five, the rest is not cut to words
    whole = F.coalesce(summary, F.lit(""))
    first = let(parts(F.substring(whole, 1, 500)), lambda ws: of(F.slice(ws, 1, F.greatest(F.size(ws) - 1, F.lit(0)))))
    long = let(first, lambda five: F.when(F.size(five) == 5, five).otherwise(of(parts(whole))))
    bits = F.filter(F.split(F.coalesce(repository, F.lit("")), "[/:_-]"), lambda b: b != "")
    last = F.slice(bits, F.greatest(F.size(bits) - 1, F.lit(1)), 2)
    return F.slice(F.array_distinct(F.concat(last, long)), 1, 8)


def significance(files: Column, refs: Column, checkpoint: Column, summary: Column) -> Column:
    score = 3 + F.least(files, F.lit(3)) + F.least(refs, F.lit(2)) + checkpoint.cast("int") + summary.cast("int")
    return F.greatest(F.lit(1), F.least(F.lit(10), score))


def clamped(value: Column, low: int, high: int, fallback: int) -> Column:
    """Rounded half up and bounded; null and NaN give the fallback."""
    fine = value.isNotNull() & ~F.isnan(value.cast("double"))
    return F.when(fine, F.greatest(F.lit(low), F.least(F.lit(high), F.floor(value.cast("double") + 0.5)))).otherwise(F.lit(fallback)).cast("long")


def elapsed_minutes(since: Column, now: Column) -> Column:
    return F.greatest(F.lit(0), F.floor((F.unix_millis(now) - F.unix_millis(since)) / 60000)).cast("long")


def listed(items: Column) -> Column:
    """Items in a sentence: ``a``, ``a and b``, ``a, b, and c``."""
    n = F.size(items)
    many = F.concat(F.array_join(F.slice(items, 1, F.greatest(n - 1, F.lit(1))), ", "), F.lit(", and "), F.element_at(items, -1))
    return F.when(n == 0, "").when(n == 1, items[0]).when(n == 2, F.array_join(items, " and ")).otherwise(many)


def human_label(label: Column) -> Column:
    """``someName`` and ``some_name`` as words."""
    return F.lower(normalize(F.regexp_replace(F.regexp_replace(label, "([a-z0-9])([A-Z])", "$1 $2"), "[_-]+", " ")))


def comparison_text(text: Column) -> Column:
    return normalize(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))


def confidence(score: Column, margin: Column) -> tuple[Column, Column]:
    """Confidence of a routing decision, to two places, and its label."""
    value = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (score + margin) / 24)) * 100 + 0.5) / 100
    return value, F.when(value >= 0.75, "high").when(value >= 0.45, "medium").otherwise("low")


def unique(values: Column, most: int) -> Column:
    """The first distinct non-empty values, white space collapsed."""
    return F.slice(F.array_distinct(F.filter(F.transform(values, normalize), lambda v: v != "")), 1, most)


def merged_tags(mine: Column, theirs: Column) -> Column:
    """Tags of both, each once, in order."""
    every = F.split(F.trim(F.concat_ws(" ", mine, theirs)), r"\s+")
    return F.array_join(F.array_distinct(F.filter(every, lambda t: t != "")), " ")
