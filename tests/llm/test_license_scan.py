import random
import re

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from mnemark.llm import license_scan
from mnemark.llm.license_rules import base_rules, rules
from mnemark.llm.license_scan import SURE_WORDS, license_digest, scan_licenses

TEXTS = [
    None, "", "!!", "no notice here", "CC-BY cc by, Cc/By 4.0", "ALL RIGHTS RESERVED. all rights\nreserved",
    "Licensed under the Apache License, Version 2.0. Copyright (c) 2020 X. GNU General Public License v3 or later.",
    "SPDX-License-Identifier: MIT and the MIT License", "ÀLL RIGHTS RESERVED É all rights reservedÉ", "x " * 5000 + "cc by " * 300,
    "Creative Commons Attribution-ShareAlike 4.0 and Attribution ShareAlike 4.0; tous droits réservés",
]


def brute(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    joined = " " + " ".join(words) + " "

    def spans(found):
        out = []
        for r in found:
            if r.keyword in joined:
                for m in re.finditer(r.pattern, joined):
                    first = joined[: m.start()].count(" ") - 1
                    out.append((r.priority, r.label, first, first + m[0].count(" ") + 1))
        return out

    base, every = spans(base_rules()), spans(rules())
    kept = [d for d in every if not any(e[0] < d[0] and e[2] <= d[2] and d[3] <= e[3] for e in every)]
    starts = [d[2] for d in base]
    return (
        len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({d[1] for d in base})),
        ",".join(sorted({d[1] for d in base + kept})), min(1.0, sum(d[3] - d[2] for d in base + kept) / SURE_WORDS), len(every) - len(kept),
    )


def test_scan_matches_brute_force(spark):
    docs = spark.createDataFrame([Row(doc_id=i, text=t, labels="clash", words="w") for i, t in enumerate(TEXTS)] + [Row(doc_id=None, text="cc by", labels="", words="")], "doc_id long, text string, labels string, words string")
    got = {r[0]: tuple(r[1:]) for r in license_digest(scan_licenses(docs)).collect()}
    for i, t in enumerate(TEXTS):
        assert got[i] == brute(t), t and t[:60]
    assert got[None][1] == 1
    assert license_digest(scan_licenses(docs.limit(0))).count() == 0


def test_there_are_hundreds_of_rules_and_all_compile():
    assert len(rules()) > 200
    assert all(re.compile(r.pattern) for r in rules())


def test_a_text_of_very_many_hits_is_scanned_in_seconds(spark):
    """Time follows the hits: 60,000 in one text beside one of three; spans go through several parts."""
    import time

    rows = [(1, "cc by " * 60_000 + "general public license"), (2, "cc by cc by, all rights reserved")]
    began = time.perf_counter()
    got = {r.doc_id: r for r in license_digest(scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert time.perf_counter() - began < 60
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].n_words) == (60_001, 0, 120_000, 120_003)
    assert (got[2].n_base, got[2].base_labels) == (3, "cc-by,reserved")


@pytest.mark.parametrize("part", [1, 3, 256])
def test_what_lies_within_an_earlier_rules_span_goes(spark, monkeypatch, part):
    """One sweep over random spans, in parts of any size, against every pair of them."""
    monkeypatch.setattr(license_scan, "PART", part)
    rnd = random.Random(part)
    rows = []
    for k in range(40):
        spans = []
        for _ in range(rnd.randrange(0, 30)):
            start = rnd.randrange(0, 25)
            spans.append((rnd.randrange(-2, 4), rnd.choice("ab"), start, start + rnd.randrange(1, 8)))
        rows.append((k, spans))
    frame = spark.createDataFrame(rows, f"k int, found array<{license_scan.SPAN}>")
    for r in frame.select("k", license_scan._judged(F.col("found")).alias("j")).collect():
        spans = rows[r.k][1]
        gone = [d for d in spans if any(e[0] < d[0] and e[2] <= d[2] and d[3] <= e[3] for e in spans)]
        assert sorted(map(tuple, r.j.gone)) == sorted(gone)
        assert sorted(map(tuple, r.j.kept)) == sorted(d for d in spans if d not in gone)
