"""Readers of notes: front matter, sections, numbered rules, bullets and lead paragraphs of whole texts, as column functions.

Files come by ``read_notes`` as one row each. Every function reads a text's lines once; a list is cut at places that are found first,
so a long text costs its lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.terms import comparison_text, let, matches
from ..functions.text import BLANKS, SPACE, normalize

# The heading of learned rules, and which prompts speak of which file of instructions.
LEARNED_RULES = "## Learned Rules"
INSTRUCTION_FILES = (
    ("javascript.instructions.md", (r"\.m?js\b", r"javascript")), ("typescript.instructions.md", (r"\.tsx?\b", r"typescript")), ("json.instructions.md", (r"\.jsonc?\b", r"json")),
    ("yaml.instructions.md", (r"\.ya?ml\b", r"yaml")), ("github-workflows.instructions.md", (r"\.github\/workflows\/", r"workflow")),
    ("lua.instructions.md", (r"\.lua\b", r"lua", r"neovim")), ("terraform.instructions.md", (r"\.tf(vars)?\b", r"terraform", r"\bhcl\b")),
)
NO_TEXTS = "cast(array() as array<string>)"


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    """path and text of every file that ``path`` (a folder or a pattern) names."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def trimmed(text: Column) -> Column:
    return F.trim(text, F.lit(BLANKS))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def first_where(lines: Column, rule, start: Column | int = 0) -> Column:
    """The first place, from 0, at or after ``start`` where the rule holds; null if none."""
    return F.array_min(F.transform(lines, lambda x, i: F.when((i >= start) & rule(x), i)))


def between(lines: Column, first: Column, end: Column) -> Column:
    """Lines from place ``first`` up to ``end``, or to the last where ``end`` is null; none where ``first`` is null."""
    size = F.greatest(F.coalesce(end, F.size(lines)) - first, F.lit(0))
    return F.when(first.isNull(), F.expr(NO_TEXTS)).otherwise(F.slice(lines, F.coalesce(first, F.lit(0)) + 1, F.coalesce(size, F.lit(0))))


def stretch(lines: Column, begins, ends, skip: int = 1) -> Column:
    """Lines from ``skip`` places behind the first that begins it up to the next that ends it."""
    return let(first_where(lines, begins) + skip, lambda start: between(lines, start, first_where(lines, ends, F.coalesce(start, F.lit(0)))))


def keyed_value(lines: Column, key: str) -> Column:
    """What the last line ``key: value`` says, cut at its first colon and trimmed; null where there is none."""
    found = F.filter(lines, lambda x: x.contains(":") & x.contains(key) & (trimmed(F.substring_index(x, ":", 1)) == key))
    return let(found, lambda f: F.get(F.transform(F.slice(f, F.greatest(F.size(f), F.lit(1)), F.lit(1)), lambda x: trimmed(F.regexp_replace(x, r"^[^:]*:", ""))), F.lit(0)))


def workspace(text: Column) -> Column:
    """repository, branch, updated_at and summary of a flat ``key: value`` file; null where it does not tell them."""
    return let(lines_of(text), lambda lines: F.struct(*[keyed_value(lines, k).alias(k) for k in ("repository", "branch", "updated_at", "summary")]))


def front_matter(text: Column) -> Column:
    """The lines between the two ``---`` that a text begins with; none where it has none."""
    return F.when(F.coalesce(text, F.lit("")).rlike(r"(?s)\A---\s*\n.*?\n---\s*\n"), lines_of(F.regexp_extract(text, r"(?s)\A---\s*\n(.*?)\n---\s*\n", 1))).otherwise(F.expr(NO_TEXTS))


def section(text: Column, heading: str) -> Column:
    """What stands below a heading of one to three signs, whatever its case, up to the next such heading, white space collapsed."""
    return normalize(F.regexp_extract(F.coalesce(text, F.lit("")), rf"(?imd)^#{{1,3}}\s+{heading}\s*$([\s\S]*?)(?=^#{{1,3}}\s|\z)", 1))


def plan(text: Column) -> Column:
    """task_id, status, goal and current_state of a plan, the last two 300 signs at most."""
    keys = let(front_matter(text), lambda lines: F.struct(*[F.coalesce(normalize(keyed_value(lines, k)), F.lit("")).alias(k) for k in ("task_id", "status")]))
    return F.struct(keys["task_id"].alias("task_id"), keys["status"].alias("status"), *[F.substring(section(text, k), 1, 300).alias(k) for k in ("goal", "current_state")])


def learned_rules(text: Column, most: int) -> Column:
    """The last ``most`` numbered lines below the heading of learned rules, up to the next heading of two signs."""

    def of(lines: Column) -> Column:
        below = stretch(lines, lambda x: x == LEARNED_RULES, lambda x: x.startswith("## ") & (x != LEARNED_RULES))
        rules = F.filter(below, lambda x: x.rlike(rf"^\d+\.{SPACE[:-1]}"))
        return let(rules, lambda r: F.slice(r, F.greatest(F.size(r) - most + 1, F.lit(1)), F.lit(most)))

    return let(F.transform(lines_of(text), trimmed), of)


def instruction_files(prompt: Column) -> Column:
    """Files of instructions that a prompt speaks of."""
    named = F.array(*[F.when(matches(prompt, patterns), F.lit(name)) for name, patterns in INSTRUCTION_FILES])
    return F.filter(named, lambda x: x.isNotNull())


def procedural_profile(shared: Column, scoped: Column) -> Column:
    """The last eight learned rules of the shared file, then the last four of each chosen file; empty where there is none.

    ``scoped`` is a list of (file, text) in the order in which they are told.
    """
    plain = lambda rules: F.transform(rules, lambda r: F.concat(F.lit("- "), F.regexp_replace(r, rf"^\d+\.(?:{SPACE})?", "")))
    own = let(learned_rules(shared, 8), lambda r: F.when(F.size(r) > 0, F.concat(F.array(F.lit("## Procedural Memory"), F.lit("")), plain(r))).otherwise(F.expr(NO_TEXTS)))
    each = F.transform(scoped, lambda f: let(learned_rules(f["text"], 4), lambda r: F.when(F.size(r) > 0, F.concat(F.array(F.concat(F.lit("### "), f["file"])), plain(r))).otherwise(F.expr(NO_TEXTS))))
    told = let(F.flatten(each), lambda r: F.when(F.size(r) > 0, F.concat(F.array(F.lit("## Relevant File-Scoped Rules"), F.lit("")), r)).otherwise(F.expr(NO_TEXTS)))
    both = let(F.struct(own.alias("own"), told.alias("told")), lambda x: F.concat(x["own"], F.when((F.size(x["own"]) > 0) & (F.size(x["told"]) > 0), F.array(F.lit(""))).otherwise(F.expr(NO_TEXTS)), x["told"]))
    return F.array_join(both, "\n")


def bullets(body: Column, heading: str) -> Column:
    """The items of the section of that name, each with the indented lines that go on with it."""
    item = rf"^(?:{SPACE})?-{SPACE}"

    def told(lines: Column) -> Column:
        at = F.filter(F.transform(lines, lambda x, i: F.when(x.contains("-") & x.rlike(item), i)), lambda i: i.isNotNull())

        def whole(first: Column, end: Column) -> Column:
            rest = F.filter(between(lines, first + 1, end), lambda x: x.rlike(rf"^{SPACE[:-1]}{{2,}}[^ \t]"))
            return normalize(F.array_join(F.concat(F.array(F.regexp_replace(F.get(lines, first), item, "")), rest), " "))

        return let(at, lambda a: F.transform(a, lambda first, k: whole(first, F.get(a, k + 1))))

    def of(lines: Column) -> Column:
        is_heading = lambda x: x.contains("##") & trimmed(x).rlike(rf"^##{SPACE[:-1]}")
        named = lambda x: is_heading(x) & (comparison_text(F.regexp_replace(trimmed(x), r"^#+\s*", "")) == F.lit(heading.lower()))
        return let(stretch(lines, named, is_heading), told)

    return let(lines_of(body), of)


def lead_paragraph(body: Column) -> Column:
    """The first lines that are neither blank nor heading nor item, up to one that is, white space collapsed."""
    stops = lambda x: (x == "") | x.startswith("#") | ((x.startswith("-") | x.startswith("*")) & x.rlike(rf"^[-*]{SPACE[:-1]}"))

    def of(lines: Column) -> Column:
        first = lambda x: ~stops(x)
        return normalize(F.array_join(stretch(lines, first, stops, 0), " "))

    return let(F.transform(lines_of(body), trimmed), of)


def skill(text: Column) -> Column:
    """name, description, use_when, avoid_when, summary and errors of a skill's file, with its front matter taken off."""
    body = trimmed(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?s)\A---\s*\n.*?\n---\s*(?:\n|\z)", ""))
    bare = lambda v: F.regexp_replace(F.coalesce(v, F.lit("")), r"""(?s)^(["'])(.*)\1$""", "$2")

    def told(x: Column) -> Column:
        name, about = x["name"], x["about"]
        wrong_name = F.when(trimmed(name) == "", "Name must not be empty").when(~trimmed(name).rlike(r"^[a-zA-Z0-9_-]+$"), "Name must contain only alphanumeric characters, hyphens, and underscores")
        n = F.length(trimmed(about))
        wrong_about = F.when(n == 0, "Description must not be empty").when(n < 10, F.concat(F.lit("Description should be at least 10 characters (currently "), n.cast("string"), F.lit(")")))
        errors = F.filter(F.array(F.concat(F.lit("Invalid name: "), wrong_name), F.concat(F.lit("Invalid description: "), wrong_about)), lambda e: e.isNotNull())
        return F.struct(
            name.alias("name"), about.alias("description"), bullets(x["body"], "use this skill when").alias("use_when"), bullets(x["body"], "do not use this skill when").alias("avoid_when"),
            lead_paragraph(x["body"]).alias("summary"), errors.alias("errors"),
        )

    def named(x: Column) -> Column:
        head = lambda key: bare(keyed_value(x["head"], key))
        return let(F.struct(head("name").alias("name"), head("description").alias("about"), x["body"].alias("body")), told)

    return let(F.struct(front_matter(text).alias("head"), body.alias("body")), named)
