"""Column functions on text: normalising, terms, dates, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[ \t\n\x0B\f\r\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]+"
#: The same signs one by one, and those runs of them that are not one space already.
BLANKS = " \t\n\x0b\f\r\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
UNEVEN = rf"(?![!-~])(?:{SPACE[:-1]}{{2,}}|{SPACE[:-1].replace('[ ', '[')})"
#: Headings of sections that the engine itself puts before a prompt.
HEADINGS = (
    "Relevant Day Summary", "Relevant Prior Work", "Relevant Commitments, Preferences, And Identity", "Cross-Repo Examples", "Cross-Repo Hints",
    "Transferable Cross-Repo Preferences", "Active Workstream",
)
WEEKDAYS = ("sunday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday")


def normalize(text: Column) -> Column:
    """Runs of white space as one space, none at either end; null as empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), UNEVEN, " "))


def has_text(text: Column) -> Column:
    """Whether anything but white space is in a text."""
    return F.coalesce(text, F.lit("")).rlike("[^" + SPACE[1:-1])


def stem(term: Column) -> Column:
    """The stem of any term: cleaned to a word once, then :func:`stem_word`."""
    return F.transform(F.array(F.regexp_replace(F.lower(term), "[^a-z0-9]+", "")), stem_word)[0]


def stem_word(t: Column) -> Column:
    """The first of: -ies to -y, no -ing, no -ed, no -s, where enough letters remain, of a word of a-z and 0-9."""
    n = F.length(t)
    return (
        F.when((n > 4) & t.endswith("ies"), F.concat(F.substring(t, 1, n - 3), F.lit("y")))
        .when((n > 5) & t.endswith("ing"), F.substring(t, 1, n - 3))
        .when((n > 4) & t.endswith("ed"), F.substring(t, 1, n - 2))
        .when((n > 4) & t.endswith("s"), F.substring(t, 1, n - 1))
        .otherwise(t)
    )


def words(text: Column) -> Column:
    """Lower-cased runs of a-z and 0-9, in order."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    """How many :func:`words` a text has, without cutting it to them."""
    return F.regexp_count(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"))


def tokens(text: Column) -> Column:
    """Distinct stemmed words of more than two letters, in order."""
    return F.array_distinct(F.filter(F.transform(words(text), stem_word), lambda w: F.length(w) > 2))


def estimated_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / 4).cast("long")


def truncated(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.rtrim(F.substring(text, 1, most - 1)), F.lit("…"))).otherwise(text)


def slug(text: Column, most: int = 60) -> Column:
    dashed = F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-")
    return F.substring(F.regexp_replace(dashed, "^-+|-+$", ""), 1, most)


def last_segments(path: Column, count: int = 2) -> Column:
    return F.substring_index(path, "/", -count)


def hashed_pick(text: Column, pool: int) -> Column:
    """Index into a pool of so many by the running hash 31 h + code, modulo 2^31 - 1."""
    signs = F.filter(F.split(text, ""), lambda c: c != "")
    total = F.aggregate(signs, F.lit(0).cast("long"), lambda h, c: (h * 31 + F.ascii(c)) % 2147483647)
    return (total % pool).cast("long")


def without_blocks(text: Column, tags: tuple[str, ...]) -> Column:
    """The text less everything between an opening and a closing tag of one of the names."""
    for tag in tags:
        text = F.regexp_replace(text, f"(?is)<{tag}[^>]*>.*?</{tag}>", "")
    return text


def before_headings(text: Column) -> Column:
    """The text up to the earliest line that is one of the injected sections' headings."""
    return F.regexp_replace(text, rf"(?ms)^## (?:{'|'.join(HEADINGS)})(?=[\n\r\u2028\u2029]|\z).*\z", "")


#: Blocks of recalled context that the engine itself puts into a message. Fixed values.
INJECTED_BLOCKS = ("hindsight_memories", "relevant_memories", "lore_context")


def without_injected(text: Column) -> Column:
    """The text less what the engine itself added: a line's end for each block, nothing from the first injected heading on."""
    text = F.coalesce(text, F.lit(""))
    for tag in INJECTED_BLOCKS:
        text = F.regexp_replace(text, rf"(?is)<{tag}(?![A-Za-z0-9_])[^>]*>.*?</{tag}>", "\n")
    short = F.regexp_replace(before_headings(text), r"\n{3,}", "\n\n")
    return F.regexp_replace(short, rf"\A{SPACE}|{SPACE}\z", "")


def inferred_date(text: Column, today: Column) -> Column:
    """The day a prompt speaks of: an ISO date, today, yesterday, a month and day, or a weekday; else null."""
    low = F.lower(F.coalesce(text, F.lit("")))
    iso = F.try_to_date(F.nullif(F.regexp_extract(low, r"\b([0-9]{4}-[0-9]{2}-[0-9]{2})\b", 1), F.lit("")))
    months = "january|february|march|april|may|june|july|august|september|october|november|december"
    month = F.nullif(F.regexp_extract(low, rf"\b({months})\s+([0-9]{{1,2}})(?:st|nd|rd|th)?\b", 1), F.lit(""))
    day = F.nullif(F.regexp_extract(low, rf"\b({months})\s+([0-9]{{1,2}})(?:st|nd|rd|th)?\b", 2), F.lit("")).cast("int")
    number = F.array_position(F.array(*[F.lit(m) for m in months.split("|")]), month).cast("int")
    this_year = F.date_add(F.make_date(F.year(today), number, F.lit(1)), day - 1)
    last_year = F.date_add(F.make_date(F.year(today) - 1, number, F.lit(1)), day - 1)
    named = F.when(day.between(1, 31), F.when(this_year > today, last_year).otherwise(this_year))
    weekday = F.lit(None).cast("date")
    for target in reversed(range(7)):
        back = F.pmod(F.dayofweek(today) - 1 - target, F.lit(7))
        back = F.when((back == 0) & ~low.contains(f"this {WEEKDAYS[target]}"), 7).otherwise(back)
        weekday = F.when(low.contains(WEEKDAYS[target]), F.date_sub(today, back)).otherwise(weekday)
    return (
        F.when(iso.isNotNull(), iso)
        .when(low.rlike(r"\btoday\b|\bthis (morning|afternoon|evening)\b"), today)
        .when(low.rlike(r"\byesterday\b|\blast night\b"), F.date_sub(today, 1))
        .when(named.isNotNull(), named)
        .otherwise(weekday)
    )
