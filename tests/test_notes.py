"""Notes in small cases: front matter, sections, rules, bullets, leads, skills, and files read whole."""

import pytest
from pyspark.sql import functions as F

from mnemark.sources import notes as T


def one(spark, f, text):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("r")).first().r


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        (None, []), ("", []), ("1. before\n## Learned Rules\n1. a\n x\n 2.  b \n## Next\n3. c", ["1. a", "2.  b"]), ("## Learned Rules \n1.a\n1. b\n## Learned Rules\n2. c", ["1. b", "2. c"]),
        ("## learned rules\n1. a", []), ("## Learned Rules\n" + "\n".join(f"{k}. r" for k in range(20)), [f"{k}. r" for k in range(12, 20)]), ("### Learned Rules\n1. a", []),
        ("## Learned Rules\n1. a\n### deeper\n2. b\r\n", ["1. a", "2. b"]),
    ],
)
def test_learned_rules(spark, text, expected):
    assert one(spark, lambda t: T.learned_rules(t, 8), text) == expected


def test_profiles(spark):
    shared, scoped = "## Learned Rules\n1. keep it\n2.  small", [("a.md", "## Learned Rules\n" + "\n".join(f"{k}. r{k}" for k in range(6))), ("b.md", "none")]
    frame = spark.createDataFrame([(shared, scoped), ("", scoped), (shared, []), (None, [])], "s string, f array<struct<file:string,text:string>>")
    got = [r.p for r in frame.select(T.procedural_profile(F.col("s"), F.col("f")).alias("p")).collect()]
    own, rest = "## Procedural Memory\n\n- keep it\n- small", "## Relevant File-Scoped Rules\n\n### a.md\n- r2\n- r3\n- r4\n- r5"
    assert got == [f"{own}\n\n{rest}", rest, own, ""]
    files = lambda t: one(spark, T.instruction_files, t)
    assert files("fix App.TSX and x.yml") == ["typescript.instructions.md", "yaml.instructions.md"] and files(None) == [] and files("main.tfvars") == ["terraform.instructions.md"]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("---\ntask_id: T1 \nstatus: a: b\nstatus: c\n---\n# x\n## GOAL\n\ngo  on\nnow\n### current_state\nthen\n# end\nz", ("T1", "c", "go on now", "then")),
        ("---\ntask_id: T1\n## goal\nno end", ("", "", "no end", "")), ("#### goal\nx", ("", "", "", "")), (None, ("", "", "", "")),
        ("# goal\n" + "y" * 400, ("", "", "y" * 300, "")), (" ---\na: b\n---\n", ("", "", "", "")),
    ],
)
def test_plans(spark, text, expected):
    assert tuple(one(spark, T.plan, text)) == expected


def test_workspaces(spark):
    got = one(spark, T.workspace, "repository: a:b\nno colon\n branch : x\nbranch:y \n: empty key\nsummary:\n")
    assert tuple(got) == ("a:b", "y", None, "") and tuple(one(spark, T.workspace, None)) == (None,) * 4


def test_bullets_and_leads(spark):
    body = "# T\n\nLead one\nlead two\n- item\n## Use: this-skill when!\n- first\n  goes on\nnot mine\n    nor\n - second\n## Other\n- third"
    assert one(spark, lambda t: T.bullets(t, "use this skill when"), body) == ["first goes on nor", "second"]
    assert one(spark, T.lead_paragraph, body) == "Lead one lead two"
    assert one(spark, lambda t: T.bullets(t, "none"), body) == [] and one(spark, T.lead_paragraph, "# a\n- b\n\n") == ""


def test_skills_and_their_errors(spark):
    good = one(spark, T.skill, "---\nname: my-skill\ndescription: \"does a lot of things\"\n---\nIt helps.\n\n## Do not use this skill when\n- never")
    assert (good.name, good.description, good.avoid_when, good.use_when, good.summary, good.errors) == ("my-skill", "does a lot of things", ["never"], [], "It helps.", [])
    bad = one(spark, T.skill, "---\nname: a b\ndescription: short\n---\n")
    assert bad.errors == ["Invalid name: Name must contain only alphanumeric characters, hyphens, and underscores", "Invalid description: Description should be at least 10 characters (currently 5)"]
    assert one(spark, T.skill, None).errors == ["Invalid name: Name must not be empty", "Invalid description: Description must not be empty"]


def test_files_are_read_whole_and_long_texts_cost_their_lines(spark, tmp_path):
    long = "## Learned Rules\n" + "\n".join(f"{k}. rule" for k in range(30_000))
    (tmp_path / "a.md").write_text(long)
    (tmp_path / "b.md").write_text("x: y\n")
    got = {r.path.rsplit("/", 1)[1]: r for r in T.read_notes(spark, f"file://{tmp_path}/*.md").select("path", F.length("text").alias("n"), T.learned_rules(F.col("text"), 2).alias("rules")).collect()}
    assert got["a.md"].n == len(long) and got["a.md"].rules == ["29998. rule", "29999. rule"] and got["b.md"].rules == []


def test_a_long_note_is_read_by_few_lines(spark):
    """Lines without the key, a colon or a heading's signs cost a look alone: 300,000 lines take seconds."""
    text = "branch: a\n" + "word of prose that goes on and on \n" * 300_000 + " branch : b:c \n"
    rows = spark.createDataFrame([(text,)], "t string")
    assert rows.select(T.keyed_value(T.lines_of(F.col("t")), "branch").alias("b")).first().b == "b:c"
    assert rows.select(T.trimmed(F.lit("　x\u0085  ")).alias("x")).first().x == "x\u0085"
