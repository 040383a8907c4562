"""Every license rule lets its own examples through its gate."""

from re import _parser as parser

import pytest

from mnemark.llm.license_rules import rules
from mnemark.llm.license_scan import scan_licenses


def example(pattern, last):
    """A text that the pattern matches: first choices and fewest repeats, or last choices and one more."""

    def said(parts):
        out = ""
        for op, arg in parts:
            name = str(op)
            if name == "LITERAL":
                out += chr(arg)
            elif name == "IN":
                kind, value = arg[-1 if last else 0]
                out += chr(value if str(kind) == "LITERAL" else value[0])
            elif name == "BRANCH":
                out += said(arg[1][-1 if last else 0])
            elif name == "SUBPATTERN":
                out += said(arg[3])
            elif name == "MAX_REPEAT":
                out += said(arg[2]) * min(arg[0] + last, arg[1])
            else:
                assert name == "ASSERT", name
        return out

    return said(parser.parse(pattern))


@pytest.mark.parametrize("last", [0, 1])
def test_examples_pass_their_gates(last):
    for r in rules():
        text = f" {example(r.pattern, last)} "
        assert r.keyword and r.keyword in text and (not r.anchor or r.anchor in text.split()), (r, text)


def test_phrases_alone_are_found(spark):
    texts = ["ASL 2.0", "PSF License Agreement", "Responsible AI License", "The Software shall be used for Good, not Evil"]
    rows = scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [{d.label for d in r.kept} for r in sorted(rows)] == [{"apache-2.0"}, {"psf-2.0"}, {"rail"}, {"json"}]
