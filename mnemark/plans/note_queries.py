"""Registered queries on notes: plans, rules, workspaces and skills, as files made of the driver's documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import bindings as S
from ..sources import notes as T
from .memory_queries import NORMAL, registered
from .prompt_queries import any_of

#: A note around a document's text, by parts; ``{t}`` is the text, ``{k}`` its number.
NOTE = (
    "---\ntask_id: T{k}\nstatus: open: {k}\nname: skill {k}\ndescription: '{k}'\n---\n", "# About\n\nLead of {k}\ngoes on\n\n## Goal\n", "{t}", "\n## Use this skill when\n- first {k}\n  goes  on\n- ", "{t}",
    "\n\n    more\n## Learned Rules\n 1. keep {k}\nno rule\n2. and ", "{t}", "\n10.\ttab\n3.no\n### Current_State  \nstate of {k}\n## End\n4. not this\nbranch: b{k}\nrepository:  r:{k} \n",
)


def note(spark, sf_dir):
    """Documents as notes; every third lacks the front matter, every fifth the sections behind the first."""
    k = F.col("doc_id")
    fill = lambda part: F.replace(F.replace(F.lit(part), F.lit("{k}"), k.cast("string")), F.lit("{t}"), F.coalesce("text", F.lit("")))
    parts = [fill(p) for p in NOTE]
    head = F.when(k % 3 != 0, parts[0]).otherwise(F.lit(""))
    rest = F.when(k % 5 != 0, F.concat(*parts[3:])).otherwise(F.lit(""))
    return S.table(spark, sf_dir, "documents").where("doc_id is not null").select("doc_id", F.concat(head, *parts[1:3], rest).alias("note"))


def sql_part(part: str) -> str:
    return "replace(replace('" + part.replace("'", "''").replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '") + "', '{k}', doc_id::varchar), '{t}', coalesce(text, ''))"


NOTES = f"""notes AS (SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN {sql_part(NOTE[0])} ELSE '' END || {' || '.join(map(sql_part, NOTE[1:3]))} || CASE WHEN doc_id % 5 <> 0 THEN {' || '.join(map(sql_part, NOTE[3:]))} ELSE '' END AS note FROM documents WHERE doc_id IS NOT NULL),
lines AS (SELECT doc_id, unnest(string_split(note, chr(10))) AS line, generate_subscripts(string_split(note, chr(10)), 1) AS n FROM notes)"""


def section_sql(heading: str) -> str:
    """The lines after the first heading of that name and before the next heading."""
    return f"""SELECT doc_id, string_agg(line, chr(10) ORDER BY n) AS body FROM lines JOIN (SELECT doc_id, min(n) AS a FROM lines WHERE regexp_matches(line, '^#{{1,3}}\\s+{heading}\\s*$', 'i') GROUP BY 1) USING (doc_id)
 WHERE n > a AND n < coalesce((SELECT min(x.n) FROM lines x WHERE x.doc_id = lines.doc_id AND x.n > a AND regexp_matches(x.line, '^#{{1,3}}\\s')), 1 << 30) GROUP BY 1"""


@registered("S10_plans", f"""WITH {NOTES}, goals AS ({section_sql('goal')}), states AS ({section_sql('current_state')})
SELECT n.doc_id, CASE WHEN n.doc_id % 3 <> 0 THEN 'T' || n.doc_id ELSE '' END AS task_id, CASE WHEN n.doc_id % 3 <> 0 THEN 'open: ' || n.doc_id ELSE '' END AS status, md5(left({NORMAL.format('g.body')}, 300)) AS goal, left({NORMAL.format('s.body')}, 300) AS current_state
FROM notes n LEFT JOIN goals g USING (doc_id) LEFT JOIN states s USING (doc_id)""")
def plans(spark, sf_dir):
    rows = note(spark, sf_dir).select("doc_id", T.plan(F.col("note")).alias("p")).select("doc_id", "p.*")
    return rows.withColumn("goal", F.md5("goal"))


@registered("S14_learned_rules", f"""WITH {NOTES}, l AS (SELECT doc_id, n, trim(line, ' ' || chr(9) || chr(13)) AS line FROM lines), a AS (SELECT doc_id, min(n) AS a FROM l WHERE line = '## Learned Rules' GROUP BY 1),
z AS (SELECT doc_id, min(n) AS z FROM l JOIN a USING (doc_id) WHERE n > a AND starts_with(line, '## ') AND line <> '## Learned Rules' GROUP BY 1),
r AS (SELECT doc_id, n, line FROM l JOIN a USING (doc_id) LEFT JOIN z USING (doc_id) WHERE n > a AND n < coalesce(z, 1 << 30) AND regexp_matches(line, '^[0-9]+\\.\\s') QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC) <= 8),
t AS (SELECT doc_id, string_agg('- ' || regexp_replace(line, '^[0-9]+\\.\\s*', ''), chr(10) ORDER BY n) AS rules FROM r GROUP BY 1)
SELECT doc_id, md5(coalesce('## Procedural Memory' || chr(10) || chr(10) || rules, '')) AS profile FROM notes LEFT JOIN t USING (doc_id)""")
def learned_rules(spark, sf_dir):
    none = F.expr("cast(array() as array<struct<file:string,text:string>>)")
    return note(spark, sf_dir).select("doc_id", F.md5(T.procedural_profile(F.col("note"), none)).alias("profile"))


FILES_SQL = ", ".join(f"CASE WHEN {any_of('text', patterns)} THEN '{name}' END" for name, patterns in T.INSTRUCTION_FILES)


@registered("S15_instruction_files", f"SELECT page_id, array_to_string(list_filter([{FILES_SQL.replace('text,', 'html,')}], lambda x: x IS NOT NULL), ' ') AS files FROM pages")
def instruction_files(spark, sf_dir):
    return S.table(spark, sf_dir, "pages").select("page_id", F.array_join(T.instruction_files(F.col("html")), " ").alias("files"))


@registered("S8_workspaces", f"""WITH {NOTES}, v AS (SELECT doc_id, n, trim(regexp_extract(line, '^([^:]*):', 1)) AS key, trim(regexp_replace(line, '^[^:]*:', ''), ' ' || chr(9) || chr(13)) AS value FROM lines WHERE contains(line, ':')),
x AS (SELECT doc_id, arg_max(value, n) FILTER (key = 'repository') AS repository, arg_max(value, n) FILTER (key = 'branch') AS branch, arg_max(value, n) FILTER (key = 'status') AS status FROM v GROUP BY 1)
SELECT n.doc_id, repository, branch, status FROM notes n LEFT JOIN x USING (doc_id)""")
def workspaces(spark, sf_dir):
    rows = note(spark, sf_dir).select("doc_id", T.workspace(F.col("note")).alias("w"), T.keyed_value(T.lines_of(F.col("note")), "status").alias("status"))
    return rows.select("doc_id", "w.repository", "w.branch", "status")


@registered("S16_skills", f"""WITH {NOTES}, body AS (SELECT doc_id, trim(CASE WHEN doc_id % 3 <> 0 THEN substr(note, instr(note, chr(10) || '---' || chr(10)) + 5) ELSE note END) AS b FROM notes),
bl AS (SELECT doc_id, unnest(string_split(b, chr(10))) AS line, generate_subscripts(string_split(b, chr(10)), 1) AS n FROM body),
a AS (SELECT doc_id, min(n) AS a FROM bl WHERE trim(line) = '## Use this skill when' GROUP BY 1),
z AS (SELECT doc_id, min(n) AS z FROM bl JOIN a USING (doc_id) WHERE n > a AND regexp_matches(trim(line), '^##\\s') GROUP BY 1),
s AS (SELECT doc_id, n, line, regexp_matches(line, '^\\s*-\\s+') AS starts FROM bl JOIN a USING (doc_id) JOIN z USING (doc_id) WHERE n > a AND n < z),
g AS (SELECT *, sum(starts::int) OVER (PARTITION BY doc_id ORDER BY n) AS item FROM s WHERE starts OR regexp_matches(line, '^\\s\\s+\\S')),
i AS (SELECT doc_id, item, {NORMAL.format("string_agg(regexp_replace(line, '^\\s*-\\s+', ''), ' ' ORDER BY n)")} AS t FROM g WHERE item > 0 GROUP BY 1, 2),
u AS (SELECT doc_id, string_agg(t, chr(10) ORDER BY item) AS use_when FROM i GROUP BY 1)
SELECT n.doc_id, md5(coalesce(use_when, '')) AS use_when, 'Lead of ' || n.doc_id || ' goes on' AS summary,
 CASE WHEN n.doc_id % 3 <> 0 THEN 'Invalid name: Name must contain only alphanumeric characters, hyphens, and underscores' ELSE 'Invalid name: Name must not be empty' END || '; Invalid description: ' ||
 CASE WHEN n.doc_id % 3 <> 0 THEN 'Description should be at least 10 characters (currently ' || length(n.doc_id::varchar) || ')' ELSE 'Description must not be empty' END AS errors FROM notes n LEFT JOIN u USING (doc_id)""")
def skills(spark, sf_dir):
    rows = note(spark, sf_dir).select("doc_id", T.skill(F.col("note")).alias("s"))
    return rows.select("doc_id", F.md5(F.array_join("s.use_when", "\n")).alias("use_when"), "s.summary", F.array_join("s.errors", "; ").alias("errors"))
