"""License scan: ordered signature rules behind a keyword prefilter, on DataFrame functions alone.

A text is normalised to its words, parted by one space. Its whole words and the keywords found in it choose the rules
to try: the words are looked up in one pass, so that few keywords are sought in each text. Each match
becomes an interval of word positions, and a match whose interval lies within that of a match of an earlier rule
is suppressed. Every row is worked on where it is read: there is no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import only_first
from .license_rules import Rule, base_rules, rules

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of matched signature text from which a scan is certain.
SURE_WORDS = 12


def _spaces(s: Column) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))


def _table(found: list[Rule]) -> Column:
    return F.array(*[F.struct(F.lit(r.priority).alias("priority"), F.lit(r.anchor).alias("anchor"), F.lit(r.keyword).alias("keyword"), F.lit(r.pattern).alias("pattern"), F.lit(r.label).alias("label")) for r in found])


SPAN = "struct<priority:int,label:string,start:int,end:int>"
NO_SPANS = f"cast(array() as array<{SPAN}>)"
#: Entries that one fold gathers: folds copy what they have gathered at every step, so long lists are folded in parts.
PART = 256


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.transform(F.array(value), body)[0]


def _parts(entries: Column) -> Column:
    """The list in parts of ``PART`` entries."""
    n = F.ceil(F.size(entries) / PART).cast("int")
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.expr("cast(array() as array<int>)"))
    return F.transform(at, lambda k: F.slice(entries, k * PART + 1, F.lit(PART)))


def _span(rule: Column, start: Column, end: Column) -> Column:
    return F.struct(rule["priority"].alias("priority"), rule["label"].alias("label"), start.alias("start"), end.alias("end"))


def _spans(text: Column, rule: Column) -> Column:
    """Matches of one rule as (priority, label, start, end) in words: what lies between matches counts the words."""
    matches = F.regexp_extract_all(text, rule["pattern"], F.lit(0))
    between = F.split(text, rule["pattern"], -1)

    def step(state: Column, pair: Column) -> Column:
        first = state["seen"] + pair["before"] - 1
        last = first + pair["match"] + 1
        return F.struct(last.alias("seen"), F.concat(state["spans"], F.array(_span(rule, first, last))).alias("spans"))

    def shifted(parts: Column) -> Column:
        """Spans of all parts, each part moved by the words of those before it."""
        before = F.aggregate(
            parts, F.expr("named_struct('seen', 0, 'at', cast(array() as array<int>))"),
            lambda s, p: F.struct((s["seen"] + p["seen"]).alias("seen"), F.concat(s["at"], F.array(s["seen"])).alias("at")), lambda s: s["at"],
        )
        return F.flatten(F.zip_with(parts, before, lambda p, at: F.transform(p["spans"], lambda x: _span(x, x["start"] + at, x["end"] + at))))

    def of(found: Column) -> Column:
        pairs = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda b, m: F.struct(_spaces(b).alias("before"), _spaces(m).alias("match")))
        folded = _let(pairs, lambda p: F.transform(_parts(p), lambda part: F.aggregate(part, F.expr(f"named_struct('seen', 0, 'spans', {NO_SPANS})"), step)))
        return _let(folded, shifted)

    return _let(matches, of)


def _judged(found: Column) -> Column:
    """``kept`` and ``gone``: detections in the order of their places, and those that lie within one of an earlier rule.

    One sweep: whatever holds a detection comes before it, and has not ended where it starts.
    """
    placed = F.array_sort(F.transform(found, lambda d: F.struct(d["start"].alias("at"), (-d["end"]).alias("till"), d["priority"].alias("rank"), d.alias("d"))))
    still_open = lambda open_, x: F.filter(open_, lambda e: e["end"] > x["at"])

    def step(state: Column, x: Column) -> Column:
        def judged(open_: Column) -> Column:
            within = F.exists(open_, lambda e: (e["priority"] < x["rank"]) & (x["d"]["end"] <= e["end"]))
            more = lambda name, taken: F.when(taken, F.concat(state[name], F.array(x["d"]))).otherwise(state[name]).alias(name)
            return F.struct(F.concat(open_, F.array(x["d"])).alias("open"), more("kept", ~within), more("gone", within))

        return _let(still_open(state["open"], x), judged)

    def swept(parts: Column) -> Column:
        """Each part swept from what is open where it begins."""
        after = lambda open_, part: F.aggregate(part, open_, lambda o, x: F.concat(still_open(o, x), F.array(x["d"])))
        opens = F.aggregate(
            parts, F.expr(f"named_struct('open', {NO_SPANS}, 'at', cast(array() as array<array<{SPAN}>>))"),
            lambda s, part: F.struct(after(s["open"], part).alias("open"), F.concat(s["at"], F.array(s["open"])).alias("at")), lambda s: s["at"],
        )
        none = F.expr(NO_SPANS)
        return F.zip_with(parts, opens, lambda part, open_: F.aggregate(part, F.struct(open_.alias("open"), none.alias("kept"), none.alias("gone")), step))

    def whole(done: Column) -> Column:
        return F.struct(_all_of(done, "kept").alias("kept"), _all_of(done, "gone").alias("gone"))

    return _let(_let(_let(placed, _parts), swept), whole)


def _all_of(parts: Column, name: str) -> Column:
    return F.flatten(F.transform(parts, lambda p: p[name]))


def _detections(text: Column, anchors: Column, found: list[Rule]) -> Column:
    """Detections of all rules whose anchor is among ``anchors`` and whose keyword the text holds."""

    def tries(r: Column) -> Column:
        near = (r["anchor"] == "") | F.array_contains(anchors, r["anchor"])
        return near & F.contains(text, r["keyword"]) & F.regexp_like(text, r["pattern"])

    tried = F.filter(_table(found), tries)
    return F.flatten(F.transform(tried, lambda r: _spans(text, r)))


def scan_licenses(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_words, base (all places of the base phrases), kept and suppressed detections of every row.

    Detections are structs (priority, label, start, end), in words from 0, end exclusive. A null text counts as
    empty: no words and no detections. Repeated rows and null ids are rows like others; an empty table gives no
    rows; other columns are ignored.
    """
    every, base = rules(), base_rules()
    anchors = F.array(*[F.lit(a) for a in sorted({r.anchor for r in every + base if r.anchor})])
    words = F.trim(F.regexp_replace(F.translate(F.coalesce(F.col("text"), F.lit("")), UPPER, LOWER), NO_WORD, " "))
    rows = only_first(docs, doc_id, text).toDF("doc_id", "text").select("doc_id", words.alias("words"))
    gated = rows.select(
        "doc_id",
        F.when(F.col("words") == "", F.lit(0)).otherwise(_spaces(F.col("words")) + 1).cast("long").alias("n_words"),
        F.concat(F.lit(" "), "words", F.lit(" ")).alias("words"),
    ).withColumn("anchors", F.array_intersect(F.split("words", " "), anchors))
    tried = gated.select(
        "doc_id",
        "n_words",
        _detections(F.col("words"), F.col("anchors"), base).alias("base"),
        _detections(F.col("words"), F.col("anchors"), every).alias("found"),
    )

    judged = tried.select("doc_id", "n_words", "base", _judged(F.col("found")).alias("j"))
    return judged.select("doc_id", "n_words", "base", F.col("j.kept").alias("kept"), F.col("j.gone").alias("suppressed"))


def license_digest(scan: DataFrame) -> DataFrame:
    """The contract's columns from :func:`scan_licenses`; score is the matched words over ``SURE_WORDS``, 1 at most."""

    def labels(c: Column) -> Column:
        return F.array_sort(F.array_distinct(F.transform(c, lambda d: d["label"])))

    every = F.concat("base", "kept")
    matched = F.aggregate(every, F.lit(0), lambda s, d: s + d["end"] - d["start"])
    starts = F.transform("base", lambda d: d["start"].cast("long"))
    return scan.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(labels(F.col("base")), ",").alias("base_labels"),
        F.array_join(labels(every), ",").alias("labels"),
        F.least(F.lit(1.0), matched / F.lit(float(SURE_WORDS))).alias("score"),
        F.size("suppressed").cast("long").alias("n_suppressed"),
    )
