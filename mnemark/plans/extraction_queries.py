"""Registered queries on what sessions' records tell: outlines, digests, identities and all memories of a session."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import terms as X
from ..functions import text as T
from ..operators import extraction as E
from ..operators import raw_search as R
from ..sources import bindings as S
from .listing_queries import RAW_ALIAS_MAP
from .memory_queries import NORMAL, SQL, STEM, WORDS, registered
from .prompt_queries import DIRECT, GENERIC, any_of, list_of, q
from .session_queries import TURNS, newest_sql, turns

OUTLINED = "replace(replace(coalesce({0}, ''), '. ', '.' || chr(10) || '  - '), ', ', ':' || chr(10) || '    ')"
ROWS = f"""
sessions AS (SELECT DISTINCT conv_id AS session_id, CASE WHEN conv_id % 3 <> 0 THEN 'org/repo-' || conv_id % 7 END AS repository, CASE WHEN conv_id % 2 = 0 THEN '/home/u' || conv_id % 4 END AS cwd,
  CASE WHEN conv_id % 5 < 2 THEN 'main' END AS branch,
  CASE conv_id % 4 WHEN 0 THEN 'Session ' || lpad(conv_id::varchar, 8, '0') WHEN 1 THEN 'please review change ' || conv_id END AS summary,
  TIMESTAMP '2024-01-01 00:00:00' + to_hours(conv_id % 700) AS updated_at FROM conversations),
checkpoints AS (SELECT doc_id // 10 AS session_id, doc_id % 10 AS checkpoint_number, CASE doc_id % 4 WHEN 0 THEN 'Session 0a1b2c3d' WHEN 2 THEN 'Planning: ' || left(coalesce(text, ''), 60) END AS title,
  CASE WHEN doc_id % 7 < 3 THEN coalesce(text, '') END AS overview, CASE WHEN doc_id % 3 = 0 THEN {OUTLINED.format('text')} END AS history,
  CASE WHEN doc_id % 5 <> 2 THEN {OUTLINED.format('text')} END AS work_done,
  CASE WHEN doc_id % 2 = 1 THEN 'Prompt scope audit:' || chr(10) || '  1. error in ' || {OUTLINED.format('text')} END AS technical_details,
  CASE WHEN doc_id % 3 <> 1 THEN '- build failed: ' || {OUTLINED.format('text')} END AS next_steps FROM documents),
files AS (SELECT page_id // 4 AS session_id, regexp_replace(url, '^[a-z]+://', '') AS file_path, page_id % 97 AS first_seen_at FROM pages),
refs AS (SELECT event_id % 211 AS session_id, event_type AS ref_type, user_id::varchar AS ref_value, ts AS created_at FROM events)
"""
WORTH = f"""(CASE WHEN regexp_matches({{0}}, '[`_/]') THEN 2 ELSE 0 END + CASE WHEN length({{0}}) BETWEEN 24 AND 220 THEN 1 ELSE 0 END + CASE WHEN {any_of('{0}', [L.OUTLINE_WORDS])} THEN 3 ELSE 0 END
 - CASE WHEN {any_of('{0}', [L.OUTLINE_ACTORS])} THEN 2 ELSE 0 END - CASE WHEN {any_of('{0}', [L.OUTLINE_TITLES])} THEN 3 ELSE 0 END)"""


def outline_sql(name: str, source: str, most: str = "most") -> str:
    """``name``(id, kind, place, item) of the best lines; ``source`` has id, kind, most, text. A heading stands above a line while none of its level or above came between."""
    bare = r"regexp_replace(line, '^([-*]\s*|[0-9]+[.)]\s*)+', '')"
    return f"""
{name}_lines AS (SELECT id, kind, most, pos, (length(line) - length(ltrim(line, ' ' || chr(9) || chr(13)))) // 2 AS level, {NORMAL.format(bare)} AS t
  FROM (SELECT id, kind, most, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM {source})),
{name}_full AS (SELECT *, row_number() OVER (PARTITION BY id, kind ORDER BY pos) AS n FROM {name}_lines WHERE t <> ''),
{name}_levels AS (SELECT DISTINCT id, kind, level FROM {name}_full WHERE t LIKE '%:'),
{name}_last AS (SELECT f.id, f.kind, f.n, l.level,
   max(CASE WHEN f.level <= l.level THEN f.n END) OVER (PARTITION BY f.id, f.kind, l.level ORDER BY f.n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS spot, f.level AS own
   FROM {name}_full f JOIN {name}_levels l USING (id, kind)),
{name}_above AS (SELECT a.id, a.kind, a.n, string_agg(regexp_replace(h.t, ':$', ''), ': ' ORDER BY a.level) AS above FROM {name}_last a JOIN {name}_full h ON h.id = a.id AND h.kind = a.kind AND h.n = a.spot
   WHERE a.level < a.own AND h.level = a.level AND h.t LIKE '%:' GROUP BY 1, 2, 3),
{name}_items AS (SELECT f.id, f.kind, f.most, f.n, coalesce(above || ': ', '') || f.t AS item FROM {name}_full f LEFT JOIN {name}_above USING (id, kind, n) WHERE f.t NOT LIKE '%:'),
{name}_once AS (SELECT id, kind, most, item, n, {WORTH.format('item')} AS worth FROM {name}_items QUALIFY row_number() OVER (PARTITION BY id, kind, lower(item) ORDER BY n) = 1),
{name} AS (SELECT id, kind, item, row_number() OVER (PARTITION BY id, kind ORDER BY worth DESC, n) AS place FROM {name}_once QUALIFY place <= {most})"""


@registered("R19_outlines", f"""WITH src AS (SELECT doc_id AS id, 'text' AS kind, 12 AS most, {OUTLINED.format('text')} AS text FROM documents), {outline_sql('o', 'src')}
SELECT d.doc_id, count(item) AS n, md5(coalesce(string_agg(item, chr(10) ORDER BY place), '')) AS items FROM documents d LEFT JOIN o ON o.id = d.doc_id GROUP BY d.doc_id""")
def outlines(spark, sf_dir):
    found = S.table(spark, sf_dir, "documents").select("doc_id", E.outline(S.outlined(F.col("text"))).alias("o"))
    return found.select("doc_id", F.size("o").cast("long").alias("n"), F.md5(F.array_join("o", "\n")).alias("items"))


#: (list, order, field, limit of its outline) of the lists of a checkpoint, and how long each list may be.
LISTS = (
    ("actions", 1, "work_done", 10), ("actions", 2, "history", 6), ("decisions", 1, "technical_details", 12), ("decisions", 2, "work_done", 8),
    ("decisions", 3, "overview", 6), ("open_items", 1, "next_steps", 10),
)
MOST = {"actions": 12, "decisions": 14, "open_items": 10}
ITEMS = f"""
latest AS (SELECT * FROM checkpoints QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY checkpoint_number DESC) = 1),
fields AS ({' UNION ALL '.join(f"SELECT session_id AS id, '{k}{i}' AS kind, {most} AS most, coalesce({field}, '') AS text FROM latest" for k, i, field, most in LISTS)}),
{outline_sql('o', 'fields')},
paths AS (SELECT session_id, v, row_number() OVER (PARTITION BY session_id ORDER BY spot, v) AS place FROM (SELECT session_id, {NORMAL.format('file_path')} AS v, min(first_seen_at) AS spot FROM files GROUP BY 1, 2) WHERE v <> '' QUALIFY place <= 12),
every AS (SELECT id AS session_id, regexp_replace(kind, '[0-9]$', '') AS list, right(kind, 1)::int AS part, place, item FROM o UNION ALL SELECT session_id, 'actions', 9, place, v FROM paths),
once AS (SELECT session_id, list, item, min((part, place)) AS spot FROM every GROUP BY 1, 2, 3),
placed AS (SELECT *, row_number() OVER (PARTITION BY session_id, list ORDER BY spot) AS place FROM once QUALIFY place <= CASE list {' '.join(f"WHEN '{k}' THEN {n}" for k, n in MOST.items())} END),
items AS (SELECT session_id, {', '.join(f"coalesce(list(item ORDER BY place) FILTER (list = '{k}'), []) AS {k}" for k in MOST)}
  FROM (SELECT session_id FROM latest UNION SELECT session_id FROM files) LEFT JOIN placed USING (session_id) GROUP BY 1)
"""


def checkpoint_items_of(spark, sf_dir):
    return E.checkpoint_items(S.checkpoints(spark, sf_dir), S.session_files(spark, sf_dir))


@registered("C4h_checkpoint_items", f"""WITH {ROWS}, {ITEMS} SELECT session_id, {', '.join(f"array_to_string({k}, chr(10)) AS {k}" for k in MOST)} FROM items""")
def checkpoint_items(spark, sf_dir):
    return checkpoint_items_of(spark, sf_dir).select("session_id", *[F.array_join(k, "\n").alias(k) for k in MOST])


def meaningful_sql(column: str) -> str:
    plain = f"regexp_replace(regexp_replace({NORMAL.format(column)}, '^(researching|planning|implementing)\\s*:\\s*', '', 'i'), '^(please|ok(?:ay)?|hey)\\s+', '', 'i')"
    return f"CASE WHEN {plain} <> '' AND NOT {any_of(plain, (L.NOISE_SUMMARIES[0], *L.NOISE_SUMMARIES[2:]))} THEN {plain} END"


def cut(column: str, most: int) -> str:
    return f"CASE WHEN length({column}) > {most} THEN rtrim(left({column}, {most - 1})) || '…' ELSE {column} END"


PREFERENCES = SQL["C4a_stated_preferences"]
DIGESTS = f"""
outer_turns AS (SELECT session_id, arg_min(coalesce(user_message, ''), turn_index) AS first_message, arg_max(coalesce(assistant_response, ''), turn_index) AS last_answer FROM turns GROUP BY 1),
short_paths AS (SELECT session_id, string_agg(v, ', ' ORDER BY place) AS paths FROM (
  SELECT session_id, v, row_number() OVER (PARTITION BY session_id ORDER BY spot, v) AS place FROM (
   SELECT session_id, {NORMAL.format("array_to_string(list_slice(string_split(file_path, '/'), -2, -1), '/')")} AS v, min(first_seen_at) AS spot FROM files GROUP BY 1, 2) WHERE v <> '' QUALIFY place <= 3) GROUP BY 1),
labels AS (SELECT session_id, string_agg(v, ', ' ORDER BY place) AS labels FROM (
  SELECT session_id, v, row_number() OVER (PARTITION BY session_id ORDER BY spot, v) AS place FROM (SELECT session_id, ref_type || ':' || ref_value AS v, min(created_at) AS spot FROM refs GROUP BY 1, 2) QUALIFY place <= 2) GROUP BY 1),
learned AS (SELECT session_id, list(content ORDER BY turn_index) AS learnings FROM ({PREFERENCES}) GROUP BY 1),
n_files AS (SELECT session_id, least(count(*), 3) AS n_files FROM files GROUP BY 1),
n_refs AS (SELECT session_id, least(count(*), 2) AS n_refs FROM refs GROUP BY 1),
joined AS (SELECT s.*, l.session_id IS NOT NULL AS has_checkpoint, coalesce(i.actions, []) AS actions, coalesce(i.decisions, []) AS decisions, coalesce(i.open_items, []) AS open_items, coalesce(learnings, []) AS learnings,
  coalesce(n_files, 0) AS n_files, coalesce(n_refs, 0) AS n_refs, paths, labels,
  coalesce({meaningful_sql('l.title')}, {meaningful_sql('s.summary')}, {meaningful_sql('first_message')}, {meaningful_sql('l.overview')}, {meaningful_sql('l.work_done')}, {meaningful_sql('last_answer')}) AS seed
  FROM sessions s LEFT JOIN latest l USING (session_id) LEFT JOIN items i USING (session_id) LEFT JOIN outer_turns USING (session_id) LEFT JOIN short_paths USING (session_id)
  LEFT JOIN labels USING (session_id) LEFT JOIN learned USING (session_id) LEFT JOIN n_files USING (session_id) LEFT JOIN n_refs USING (session_id)),
chosen AS (SELECT *, list_concat(decisions[1:2], actions[1:2], open_items[1:1]) AS c FROM joined),
high AS (SELECT *, list_filter(c, lambda x, i: list_position(c, x) = i)[1:2] AS h FROM chosen),
detailed AS (SELECT *, array_to_string(list_concat(h, CASE WHEN paths IS NULL THEN [] ELSE ['files: ' || paths] END, CASE WHEN labels IS NULL THEN [] ELSE ['refs: ' || labels] END), ' | ') AS details,
  'Worked in ' || coalesce(nullif(repository, ''), nullif(cwd, ''), 'local workspace') || coalesce(' on ' || nullif(branch, ''), '') AS place FROM high),
told AS (SELECT *, CASE WHEN seed IS NOT NULL THEN seed || CASE WHEN details <> '' THEN ' — ' || details ELSE '' END WHEN details <> '' THEN place || ' — ' || details END AS long FROM detailed),
digests AS (SELECT * EXCLUDE (summary), coalesce(summary, '') <> '' AS has_summary, CASE WHEN long IS NULL THEN place || ' (' || session_id || ')' ELSE {cut(NORMAL.format('long'), 220)} END AS summary FROM told),
about AS (SELECT *, {NORMAL.format("array_to_string(list_concat([summary], actions[1:3], decisions[1:2], open_items[1:2]), ' ')")} AS a FROM digests),
themed AS (SELECT *, list_concat(list_slice(list_filter(regexp_split_to_array(coalesce(repository, ''), '[/:_-]'), lambda b: b <> ''), -2, -1),
  list_filter(regexp_split_to_array(regexp_replace(lower(a), '[^a-z0-9 /-]', ' ', 'g'), ' +'), lambda w: length(w) > 4)[1:5]) AS th FROM about)
"""


@registered("C4g_digests", f"""WITH {TURNS}, {ROWS}, {ITEMS}, {DIGESTS}
SELECT session_id, summary, CAST(3 + n_files + n_refs + has_checkpoint::int + has_summary::int AS BIGINT) AS significance, array_to_string(list_filter(th, lambda x, i: list_position(th, x) = i)[1:8], ' ') AS themes,
 array_to_string(learnings, chr(10)) AS learnings, CAST(updated_at AS DATE) AS date_key FROM themed""")
def digests(spark, sf_dir):
    rows = E.digests(S.sessions(spark, sf_dir), S.checkpoints(spark, sf_dir), S.session_files(spark, sf_dir), S.session_refs(spark, sf_dir), turns(spark, sf_dir))
    return rows.select("session_id", "summary", F.col("significance").cast("long").alias("significance"), F.array_join("themes", " ").alias("themes"), F.array_join("learnings", "\n").alias("learnings"), "date_key")


def assistant_sql(column: str) -> str:
    found = [f"regexp_replace(regexp_extract({column}, '{q(p)}', 1, 'i'), '[^A-Za-z0-9_-]', '', 'g')" for p in L.ASSISTANT_NAMES]
    fine = ", ".join(f"CASE WHEN {f} <> '' AND NOT list_contains({list_of(L.NO_NAMES)}, lower({f})) THEN upper(left({f}, 1)) || substr({f}, 2) END" for f in found)
    return f"coalesce({fine})"


def user_sql(column: str) -> str:
    without = f"trim(regexp_replace(regexp_replace({column}, '{q(L.GREETINGS[0])}', '', 'i'), '{q(L.GREETINGS[1])}', '', 'i'))"
    found = [f"trim(regexp_extract({c}, '{q(p)}', 1, 'i'))" for c in (column, without) for p in L.USER_NAMES]
    fine = ", ".join(f"CASE WHEN regexp_matches({f}, '^\\p{{Lu}}[\\p{{L}}''’-]*$') AND NOT list_contains({list_of(L.NO_USER_NAMES)}, lower({f})) THEN {f} END" for f in found)
    return f"CASE WHEN length({column}) <= 80 THEN coalesce({fine}) END"


NAMED = newest_sql("iw", 12, 1 << 30)
IDENTITIES = f"""{NAMED}, named AS (SELECT session_id, turn_index, {assistant_sql('m')} AS a, {user_sql('m')} AS u FROM iw),
identities AS (SELECT session_id, turn_index, 'assistant_identity' AS type, 'The user calls the assistant ' || a || '.' AS content, 0.99 AS confidence FROM named WHERE a IS NOT NULL
 UNION ALL SELECT session_id, min(turn_index), 'user_identity', 'The user''s preferred name is ' || arg_min(u, (turn_index, u)) || '.', 0.99 FROM named WHERE u IS NOT NULL GROUP BY session_id, lower(u))"""


#: Short messages that give names, or seem to; other turns keep theirs.
GIVEN = ("Hi Atlas, my name is Maria!", "I’m José.", "call yourself juno please", "I'm back", "Hello, call me Ng", "hey there!", "my name is Anna Lee", "I am O’Neil")
INTRODUCED = TURNS.rstrip() + f""",
introduced AS (SELECT session_id, turn_index, coalesce(({list_of(GIVEN)})[1 + (session_id * 3 + turn_index) % 16], user_message) AS user_message, assistant_response FROM turns)"""


@registered("C4c_identities", f"WITH {INTRODUCED}, {IDENTITIES.replace('FROM turns', 'FROM introduced')} SELECT * FROM identities")
def identities(spark, sf_dir):
    given = F.get(F.array(*map(F.lit, GIVEN)), ((F.col("session_id") * 3 + F.col("turn_index")) % 16).cast("int"))
    return E.identities(turns(spark, sf_dir).withColumn("user_message", F.coalesce(given, "user_message")))


FAILING = f"""iwg AS (SELECT * FROM turns QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY turn_index DESC, user_message) <= 16),
ie AS (SELECT session_id, 0 AS list, turn_index, 0 AS side, {NORMAL.format('user_message')} AS m FROM iwg UNION ALL SELECT session_id, 0, turn_index, 1, {NORMAL.format('assistant_response')} FROM iwg
 UNION ALL SELECT session_id, {' '.join(['CASE list'] + [f"WHEN '{k}' THEN {i}" for i, k in enumerate(MOST, 1)])} END, NULL, place, item FROM placed),
ifail AS (SELECT session_id, min((list, coalesce(turn_index, -1), side)) AS spot, {cut('m', 140)} AS t FROM ie WHERE m <> '' AND length(m) <= 280 AND {any_of('m', L.FAILURES)} AND NOT {any_of('m', L.RESOLUTIONS)} GROUP BY session_id, t),
ikept AS (SELECT * FROM ifail QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY spot, t) <= 4),
igoals AS (SELECT session_id, nullif(arg_max(spot[2], (spot, t)), -1) AS turn_index, string_agg(t, ' ' ORDER BY spot, t) AS c FROM ikept GROUP BY 1 HAVING count(*) >= 2)"""
GOAL_OF = f"'Current assistant goal: ' || CASE {' '.join(f'''WHEN {any_of('c', [p])} THEN '{goal}' ''' for p, goal in L.FAILURE_GOALS)} ELSE '{L.OTHER_FAILURE_GOAL}' END"


@registered("C4_session_memories", f"""WITH {TURNS}, {ROWS}, {ITEMS}, {IDENTITIES}, {FAILING},
goals AS ({SQL['C4d_stated_goals']}), mistakes AS ({SQL['C4d_stated_mistakes']}), implied AS ({SQL['C4e_implied_mistakes']}), preferences AS ({PREFERENCES})
SELECT * FROM identities UNION ALL SELECT * FROM goals UNION ALL SELECT * FROM mistakes UNION ALL SELECT * FROM preferences
UNION ALL SELECT session_id, turn_index, 'assistant_goal', {GOAL_OF}, 0.82 FROM igoals WHERE session_id NOT IN (SELECT session_id FROM goals)
UNION ALL SELECT * FROM implied WHERE session_id NOT IN (SELECT session_id FROM mistakes)
UNION ALL SELECT session_id, NULL, 'open_loop', item, 0.8 FROM placed WHERE list = 'open_items'""")
def session_memories(spark, sf_dir):
    rows = E.session_memories(turns(spark, sf_dir), checkpoint_items_of(spark, sf_dir))
    return rows.withColumn("confidence", F.col("confidence").cast("decimal(3,2)"))  # the SQL's type


#: Blocks and headings put around texts, by their number.
AROUND = ("<relevant_memories k='1'>old\nthings</relevant_memories>", "<LORE_CONTEXT>x</lore_context>\n\n\n", "<hindsight_memories>never closed ", "<memory>kept</memory>\n", "")
BEHIND = ("\n## Cross-Repo Hints\nnot kept", "\n## cross-repo hints\nkept", "")


@registered("X19_injected_context", rf"""WITH t AS (SELECT doc_id, ({list_of(AROUND)})[1 + doc_id % {len(AROUND)}] || coalesce(text, '') || ({list_of(BEHIND)})[1 + doc_id % {len(BEHIND)}] AS x FROM documents),
b AS (SELECT doc_id, {''.join(f"regexp_replace(" for _ in T.INJECTED_BLOCKS)}x{''.join(rf", '<{t}\b[^>]*>.*?</{t}>', chr(10), 'gis')" for t in T.INJECTED_BLOCKS)} AS x FROM t),
c AS (SELECT doc_id, regexp_replace(x, '(?ms)^## (?:{'|'.join(T.HEADINGS)})$.*\z', '') AS x FROM b)
SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(x, '\n{{3,}}', chr(10) || chr(10), 'g'), '\A\s+', ''), '\s+\z', '')) AS body FROM c""")
def injected_context(spark, sf_dir):
    pick = lambda values: F.array(*map(F.lit, values))[(F.col("doc_id") % len(values)).cast("int")]
    text = F.concat(pick(AROUND), F.coalesce("text", F.lit("")), pick(BEHIND))
    return S.table(spark, sf_dir, "documents").select("doc_id", F.md5(T.without_injected(text)).alias("body"))


INDEX = """
entries AS (SELECT conv_id * 1000 + turn AS entry_id, conv_id AS session_id, text AS content, 'turn' AS source_type FROM conversations
 UNION ALL SELECT -1 - 2 * doc_id, doc_id // 10, text, 'checkpoint_overview' FROM documents UNION ALL SELECT -2 - 2 * page_id, page_id // 4, url, 'file' FROM pages)
"""
RAW_FOUND = f"""
asking AS (SELECT conv_id * 1000 + turn AS query_id, text FROM conversations WHERE role = 'user' UNION ALL SELECT -1 - item_id, text FROM benchmark),
rt AS (SELECT query_id, unnest({DIRECT.format("text")}) AS w FROM asking),
ra AS (SELECT query_id, w AS term FROM rt UNION SELECT query_id, {STEM.format('x')} FROM (SELECT query_id, regexp_replace(lower(unnest({RAW_ALIAS_MAP}[w])), '[^a-z0-9]+', '', 'g') AS x FROM rt)),
raw_terms AS (SELECT DISTINCT query_id, term FROM ra WHERE length(term) > 2 AND NOT list_contains({GENERIC}, term)),
raw_sizes AS (SELECT query_id, count(*) AS n FROM raw_terms GROUP BY 1),
raw_words AS (SELECT DISTINCT entry_id, term FROM (SELECT entry_id, unnest({WORDS.format('content')}) AS term FROM entries) WHERE term IN (SELECT term FROM raw_terms)),
raw_stems AS (SELECT DISTINCT entry_id, {STEM.format('w')} AS term FROM (SELECT entry_id, unnest({WORDS.format('content')}) AS w FROM entries)),
raw_met AS (SELECT t.query_id, w.entry_id FROM raw_terms t JOIN raw_words w USING (term) JOIN raw_sizes s USING (query_id) GROUP BY 1, 2, s.n HAVING count(*) = s.n),
raw_found AS (SELECT m.query_id, m.entry_id, count(s.term) AS n_stems FROM raw_met m JOIN raw_terms t USING (query_id) LEFT JOIN raw_stems s ON s.entry_id = m.entry_id AND s.term = t.term AND length(s.term) > 2 GROUP BY 1, 2),
raw_told AS (SELECT * FROM raw_found JOIN entries USING (entry_id) JOIN sessions USING (session_id))
"""


def raw_tables(spark, sf_dir):
    queries = S.raw_prompts(spark, sf_dir).select("query_id", X.raw_search_terms(F.col("text")).alias("terms"))
    return S.search_index(spark, sf_dir), S.sessions(spark, sf_dir), queries


@registered("S9_raw_search", f"""WITH {ROWS}, {INDEX}, {RAW_FOUND} SELECT query_id, entry_id, session_id, source_type, repository, branch FROM raw_told
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY entry_id) <= 5""")
def raw_search(spark, sf_dir):
    return R.search_index(*raw_tables(spark, sf_dir))


@registered("R14_relevant_sessions", f"""WITH {ROWS}, {INDEX}, {RAW_FOUND},
scored AS (SELECT *, n_stems + CASE WHEN starts_with(source_type, 'checkpoint_') THEN 1.5 WHEN source_type = 'turn' THEN 0.5 ELSE 0 END AS score FROM raw_told WHERE n_stems > 0),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY query_id, session_id ORDER BY score DESC, entry_id) = 1)
SELECT query_id, session_id, repository, branch, updated_at, score::double AS score, source_type, left({NORMAL.format('content')}, 220) AS excerpt FROM best
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, updated_at DESC, session_id) <= 5""")
def relevant_sessions(spark, sf_dir):
    return R.relevant_sessions(*raw_tables(spark, sf_dir))
