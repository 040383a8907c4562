"""Registered queries on prompts and memories' texts: terms, names, keys, scopes and needs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import terms as X
from ..functions import text as T
from ..operators import ranking as R
from ..operators import rules as C
from ..sources import bindings as S
from .memory_queries import EPISODE, MEMORY, NORMAL, STEM, WORDS, bm25_sql, registered

#: Openings that make invented prose speak as prompts and memories do; each text has one, by its number.
LEADS = (
    "Hey Juno, what did we do yesterday in this repo only about `QueryNormalizer.mjs`? ", "Remember the rollback snapshots and keep a friendly tone. ",
    "Call yourself Atlas and reuse the CI migration playbook ", "Hello there! ", "sev1 outage: no jokes please, root cause of db-writer.ts ",
    "you keep breaking package.json on this branch ", "Use the name please_no or NOT the recall audit ", "We can solve this together as a teammate; feel free to add a little humour. ",
    "today ", "",
)


def q(text: str) -> str:
    return text.replace("'", "''")


def any_of(column: str, patterns) -> str:
    """The same patterns in SQL, where the engine's own boundaries are those of ASCII words."""
    return f"regexp_matches(coalesce({column}, ''), '{q('|'.join(f'(?:{p})' for p in patterns))}', 'i')"


def one_of(column: str, phrases) -> str:
    return "(" + " OR ".join(f"contains(lower(coalesce({column}, '')), '{q(p)}')" for p in phrases) + ")"


def list_of(values) -> str:
    return "[" + ", ".join(f"'{q(v)}'" for v in values) + "]"


def leads(k: str, number: str = "10") -> str:
    return f"({list_of(LEADS)})[1 + {k} % {number}]"


def led(k, text):
    return F.concat(F.array(*map(F.lit, LEADS))[(k % len(LEADS)).cast("int")], F.coalesce(text, F.lit("")))


GENERIC = list_of(L.GENERIC_TERMS)
BARE = f"list_filter(regexp_split_to_array(lower(regexp_replace(coalesce({{0}}, ''), '\\b(and|or|not|near)\\b', ' ', 'gi')), '[^a-z0-9]+'), lambda w: length(w) > 0)"
ALIAS_MAP = "MAP {" + ", ".join(f"'{k}': {list_of(v)}" for k, v in L.ALIASES.items()) + "}"
KEPT = f"length({{0}}) > 2 AND NOT list_contains({GENERIC}, {STEM.format('{0}')})"
DIRECT = f"list_filter(list_transform({BARE}, lambda w: {STEM.format('w')}), lambda t: length(t) > 2 AND NOT list_contains({GENERIC}, t))"


@registered("X4_query_terms", f"""WITH t AS (SELECT item_id, {leads('item_id')} || coalesce(text, '') AS txt FROM benchmark),
d AS (SELECT item_id, unnest(list_filter({BARE.format('txt')}, lambda w: {KEPT.format('w')})) AS w FROM t),
e AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, w AS term FROM d UNION ALL SELECT item_id, unnest({ALIAS_MAP}[w]) FROM d) WHERE {KEPT.format('term')}),
s AS (SELECT item_id, string_agg(term, ' ' ORDER BY term) AS terms FROM e GROUP BY 1)
SELECT item_id, coalesce(terms, '') AS terms, array_to_string({DIRECT.format('txt')}, ' ') AS direct,
 array_to_string(list_filter({DIRECT.format('txt')}, lambda t: NOT list_contains({list_of(L.TEMPORAL_SCAFFOLD_TERMS)}, t)), ' ') AS content FROM t LEFT JOIN s USING (item_id)""")
def query_terms(spark, sf_dir):
    text = led(F.col("item_id"), F.col("text"))
    return S.table(spark, sf_dir, "benchmark").select(
        "item_id", F.array_join(F.array_sort(X.search_terms(text)), " ").alias("terms"), F.array_join(X.direct_terms(text), " ").alias("direct"), F.array_join(X.content_terms(text), " ").alias("content")
    )


@registered("X9_entity_terms", f"""WITH t AS (SELECT doc_id, {leads('doc_id')} || coalesce(text, '') AS txt FROM documents),
c AS (SELECT doc_id, unnest(regexp_extract_all(txt, '\\b([A-Za-z][a-z]+(?:[A-Z][a-z]+)+)\\b', 1)) AS w FROM t),
p AS (SELECT doc_id, lower(regexp_replace(regexp_replace(w, '\\.[a-zA-Z]+$', ''), '[^A-Za-z0-9]', '', 'g')) AS w FROM (SELECT doc_id, unnest(regexp_extract_all(txt, '`([^`]+)`', 1)) AS w FROM t)
 UNION ALL SELECT doc_id, lower(regexp_replace(w, '[^A-Za-z0-9]', '', 'g')) FROM (SELECT doc_id, unnest(regexp_extract_all(txt, '(?i)\\b([\\w-]+)\\.(?:mjs|cjs|js|ts|tsx|json|md|yaml|yml)\\b', 1)) AS w FROM t)
 UNION ALL SELECT doc_id, lower(w) FROM c UNION ALL SELECT doc_id, unnest(string_split(lower(trim(regexp_replace(w, '([A-Z])', ' \\1', 'g'))), ' ')) FROM c),
e AS (SELECT DISTINCT doc_id, {STEM.format('w')} AS term FROM p WHERE length(w) > 2)
SELECT doc_id, string_agg(term, ' ' ORDER BY term) AS entities FROM e WHERE length(term) > 2 AND NOT list_contains({GENERIC}, term) GROUP BY 1""")
def entity_terms(spark, sf_dir):
    rows = S.table(spark, sf_dir, "documents").select("doc_id", X.entity_terms(led(F.col("doc_id"), F.col("text"))).alias("e"))
    return rows.where(F.size("e") > 0).select("doc_id", F.array_join(F.array_sort("e"), " ").alias("entities"))


def name_sql(column: str) -> str:
    """The first pattern that gives a name, as nested cases."""
    out = "NULL"
    for p in reversed(L.ASSISTANT_NAMES):
        raw = f"regexp_replace(regexp_extract({column}, '{q(p)}', 1, 'i'), '[^A-Za-z0-9_-]', '', 'g')"
        out = f"CASE WHEN {raw} <> '' AND NOT list_contains({list_of(L.NO_NAMES)}, lower({raw})) THEN upper(left({raw}, 1)) || substring({raw}, 2) ELSE {out} END"
    return out


SAID = f"""said AS (SELECT id, type, repository, content AS plain, type || ' ' || {leads('id')} || coalesce(content, '') || ' ' || coalesce(tags, '') AS txt FROM memory)"""


@registered("C2_memory_scope", f"""WITH {MEMORY}, {SAID}, f AS (SELECT *, {name_sql(NORMAL.format('txt'))} AS name, {any_of('txt', L.REPO_SPECIFIC)} AS local, {any_of('txt', L.TRANSFERABLE)} AS moves, {any_of('txt', L.GLOBAL_PREFERENCE)} AS general FROM said)
SELECT id, CASE WHEN type = 'interaction_style' OR name IS NOT NULL THEN 'global' WHEN type IN ('open_loop', 'blocker', 'commitment') THEN 'repo' WHEN type = 'directive' THEN 'global'
 WHEN type IN ('user_preference', 'rejected_approach') THEN CASE WHEN local THEN 'repo' WHEN moves AND NOT general THEN 'transferable' ELSE 'global' END
 WHEN type = 'recurring_mistake' THEN 'global' WHEN type = 'assistant_goal' THEN CASE WHEN local THEN 'repo' WHEN moves THEN 'transferable' ELSE 'global' END
 WHEN moves THEN 'transferable' WHEN repository IS NULL THEN 'global' ELSE 'repo' END AS scope, name FROM f""")
def memory_scope(spark, sf_dir):
    text = F.concat_ws(" ", "type", led(F.col("id"), F.col("content")), F.coalesce("tags", F.lit("")))
    rows = S.memory(spark, sf_dir).select("id", "type", "repository", text.alias("text")).withColumn("name", X.assistant_name(F.col("text")))
    scope = C.memory_scope(F.col("type"), F.col("text"), F.col("repository"), F.lit(None).cast("string"), F.col("name"))
    return rows.select("id", scope.alias("scope"), "name")


@registered("C3_episode_scope", f"""SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'global' WHEN doc_id % 4 = 0 THEN 'repo' WHEN {any_of(leads('doc_id') + " || coalesce(text, '')", L.TRANSFERABLE)} THEN 'transferable' ELSE 'repo' END AS scope,
 CASE WHEN doc_id % 6 <> 0 THEN coalesce(source, 'none') END AS repository FROM documents""")
def episode_scope(spark, sf_dir):
    k = F.col("doc_id")
    items = F.when(k % 4 == 0, F.array(F.lit("open"))).otherwise(F.array().cast("array<string>"))
    scope = C.episode_scope(items, led(k, F.col("text")), F.when(k % 6 == 0, " Global"))
    return S.table(spark, sf_dir, "documents").select("doc_id", scope.alias("scope"), C.effective_repository(scope, F.col("source"), F.lit(None), F.lit("none")).alias("repository"))


@registered("X13_canonical_keys", f"""WITH {MEMORY}, c AS (SELECT id, type, trim(regexp_replace(regexp_replace(regexp_replace(lower({NORMAL.format(leads('id') + " || coalesce(content, '')")}), '[''’"]', '', 'g'), '[^a-z0-9\\s-]', ' ', 'g'), '\\s+', ' ', 'g')) AS k FROM memory)
SELECT id, CASE WHEN type IN ('assistant_goal', 'recurring_mistake') AND k <> '' THEN md5(type || ':' || k) END AS key FROM c""")
def canonical_keys(spark, sf_dir):
    return S.memory(spark, sf_dir).select("id", F.md5(X.canonical_key(F.col("type"), led(F.col("id"), F.col("content")))).alias("key"))


STYLES = (*L.TONE, *L.COLLEAGUE_STYLE, *L.COLLABORATIVE_STYLE, *L.LIGHT_HUMOUR, *L.NO_JOKES, *L.ADDRESSING)


def stripped_sql(text: str) -> str:
    out = NORMAL.format(text)
    for p in L.FRAMES:
        out = f"regexp_replace({out}, '{p}', '', 'i')"
    for p in STYLES:
        out = f"regexp_replace({out}, '{q(p)}', ' ', 'gi')"
    return out


@registered("C1_prompt_need", f"""WITH t AS (SELECT item_id, trim({leads('item_id')} || coalesce(text, '')) AS txt FROM benchmark),
g AS (SELECT *, {stripped_sql('txt')} AS left_over, lower(regexp_extract(txt, '^([a-z][a-z0-9_-]{{2,20}})[,:]\\s', 1, 'i')) AS direct, lower(regexp_extract(txt, '^(?:hi|hello|hey)\\s+([a-z][a-z0-9_-]{{2,20}})(?:[!?,.]|\\s|$)', 1, 'i')) AS greeted FROM t),
f AS (SELECT *, (direct <> '' AND NOT list_contains({list_of(L.NO_ADDRESS)}, direct)) OR (greeted <> '' AND NOT list_contains({list_of(L.NO_ADDRESS)}, greeted)) OR {name_sql(NORMAL.format('txt'))} IS NOT NULL AS addressed,
 {one_of('txt', L.CONSISTENCY_SIGNALS)} AS continuity, {one_of('txt', L.TRANSFER_SIGNALS)} AS examples, {one_of('txt', L.TEMPORAL_SIGNALS)} AS time, {any_of('txt', STYLES)} AS style,
 {any_of('txt', (*L.COLLEAGUE_STYLE, *L.COLLABORATIVE_STYLE, *L.LIGHT_HUMOUR, *L.NO_JOKES))} AS explicit_style, {any_of('txt', L.SERIOUS)} AS serious,
 {any_of('txt', L.NO_JOKES)} OR (NOT {any_of('txt', L.LIGHT_HUMOUR)} AND {any_of('txt', L.SERIOUS)}) AS no_humour, {any_of('txt', L.LOCAL_SCOPE)} AS local_only,
 len(list_filter(regexp_split_to_array(regexp_replace(lower(left_over), '[^a-z0-9\\s./_-]', ' ', 'g'), '\\s+'), lambda w: length(w) > 3 AND NOT list_contains({list_of((*L.TASK_STOP_WORDS, *L.PHATIC_TERMS))}, w) AND w <> lower(coalesce({name_sql(NORMAL.format('left_over'))}, '')))) > 0 AS has_task FROM g),
h AS (SELECT *, time AND (NOT addressed OR continuity OR examples OR has_task) AS temporal FROM f),
i AS (SELECT *, addressed AND NOT temporal AND NOT continuity AND NOT examples AND NOT style AND NOT has_task AS identity_only FROM h)
SELECT item_id, addressed, continuity, examples, style, explicit_style, serious, no_humour, temporal, identity_only, temporal OR addressed OR continuity OR style OR examples AS needs_lookup,
 NOT identity_only AND (temporal OR continuity OR has_task) AS local_context, examples OR (temporal AND NOT local_only) AS cross_repository FROM i""")
def prompt_need(spark, sf_dir):
    rows = S.table(spark, sf_dir, "benchmark").select("item_id", led(F.col("item_id"), F.col("text")).alias("txt"))
    return C.prompt_need(rows, "txt").drop("txt")


@registered("C11_risk_tiers", """WITH a AS (SELECT p_partkey, p_partkey % 4 AS m, p_partkey % 5 AS r, p_partkey % 6 AS w, p_partkey % 7 AS t FROM part),
s AS (SELECT p_partkey, CAST(([0, 1, 2, 4])[1 + m] + ([0, 1, 2, 4, 0])[1 + r] + ([0, 1, 2, 3, 4, 0])[1 + w] + ([0, 1, 2, 3, 2, 2, 2])[1 + t] AS INT) AS score FROM a)
SELECT CASE WHEN score >= 12 THEN 'critical' WHEN score >= 8 THEN 'high' WHEN score >= 4 THEN 'moderate' ELSE 'low' END AS tier, count(*) AS n, max(score) AS most FROM s GROUP BY 1""")
def risk_tiers(spark, sf_dir):
    pick = lambda table, m: F.get(F.array(*map(F.lit, table)), (F.col("p_partkey") % m).cast("int"))
    actions = S.table(spark, sf_dir, "part").select(
        pick(L.MUTABILITY, 4).alias("mutability"), pick(L.REVERSIBILITY, 5).alias("reversibility"), pick(L.REACH, 6).alias("reach"), pick(L.TRUST, 7).alias("trust")
    )
    return C.risk(actions).groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("most"))


@registered("X23_session_labels", f"""WITH t AS (SELECT doc_id, {NORMAL.format('text')} AS s, source, n_chars FROM documents),
u AS (SELECT *, list_slice(list_filter(regexp_split_to_array(regexp_replace(lower(s), '[^a-z0-9\\s/-]', ' ', 'g'), '\\s+'), lambda w: length(w) > 4), 1, 5) AS w, 'org/' || coalesce(source, '') AS repo FROM t),
v AS (SELECT *, list_filter(regexp_split_to_array(repo, '[/:_-]'), lambda b: b <> '') AS bits FROM u),
x AS (SELECT *, list_concat(list_slice(bits, greatest(len(bits) - 1, 1), len(bits)), w) AS every FROM v)
SELECT doc_id, array_to_string(list_slice(list_transform(list_filter(list_zip(every, range(1, len(every) + 1)), lambda p: list_position(every, p[1]) = p[2]), lambda p: p[1]), 1, 8), ' ') AS themes,
 greatest(1, least(10, 3 + least(doc_id % 5, 3) + least(doc_id % 4, 2) + CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN s <> '' THEN 1 ELSE 0 END)) AS significance,
 CASE WHEN n_chars IS NULL THEN 7 ELSE greatest(5, least(900, CAST(floor(n_chars / 3.0 + 0.5) AS BIGINT))) END AS bounded,
 md5(trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g'))) AS comparable,
 round(floor(greatest(0.0, least(1.0, (doc_id % 20 + doc_id % 9) / 24.0)) * 100 + 0.5) / 100, 2) AS confidence,
 CASE WHEN doc_id % 4 = 0 THEN '' WHEN doc_id % 4 = 1 THEN 'a' WHEN doc_id % 4 = 2 THEN 'a and b' ELSE 'a, b, and c' END AS listed, {any_of('s', L.NOISE_SUMMARIES)} AS noise FROM x""")
def session_labels(spark, sf_dir):
    k, s = F.col("doc_id"), F.col("text")
    value, _ = X.confidence(k % 20, k % 9)
    items = F.slice(F.array(F.lit("a"), F.lit("b"), F.lit("c")), 1, (k % 4).cast("int"))
    return S.table(spark, sf_dir, "documents").select(
        "doc_id", F.array_join(X.themes(s, F.concat(F.lit("org/"), F.coalesce("source", F.lit("")))), " ").alias("themes"),
        X.significance(k % 5, k % 4, k % 2 == 0, T.has_text(s)).cast("long").alias("significance"), X.clamped(F.col("n_chars") / 3.0, 5, 900, 7).alias("bounded"),
        F.md5(X.comparison_text(s)).alias("comparable"), F.round(value, 2).alias("confidence"), X.listed(items).alias("listed"), X.is_noise(s).alias("noise"),
    )


def noise_sql(column: str, patterns) -> str:
    return any_of(NORMAL.format(column), patterns)


ASKED = f"""
texts AS (SELECT item_id AS query_id, text AS txt FROM benchmark),
raw_direct AS (SELECT query_id, unnest(list_distinct({DIRECT.format('txt')})) AS term FROM texts),
raw_wide AS (SELECT query_id, unnest(list_filter({BARE.format('txt')}, lambda w: {KEPT.format('w')})) AS w FROM texts),
wide AS (SELECT DISTINCT query_id, term FROM (SELECT query_id, w AS term FROM raw_wide UNION ALL SELECT query_id, unnest({ALIAS_MAP}[w]) FROM raw_wide) WHERE {KEPT.format('term')}),
camel AS (SELECT query_id, unnest(regexp_extract_all(txt, '\\b([A-Za-z][a-z]+(?:[A-Z][a-z]+)+)\\b', 1)) AS w FROM texts),
named AS (SELECT query_id, lower(regexp_replace(regexp_replace(w, '\\.[a-zA-Z]+$', ''), '[^A-Za-z0-9]', '', 'g')) AS w FROM (SELECT query_id, unnest(regexp_extract_all(txt, '`([^`]+)`', 1)) AS w FROM texts)
 UNION ALL SELECT query_id, lower(regexp_replace(w, '[^A-Za-z0-9]', '', 'g')) FROM (SELECT query_id, unnest(regexp_extract_all(txt, '(?i)\\b([\\w-]+)\\.(?:mjs|cjs|js|ts|tsx|json|md|yaml|yml)\\b', 1)) AS w FROM texts)
 UNION ALL SELECT query_id, lower(w) FROM camel UNION ALL SELECT query_id, unnest(string_split(lower(trim(regexp_replace(w, '([A-Z])', ' \\1', 'g'))), ' ')) FROM camel),
entity AS (SELECT DISTINCT query_id, {STEM.format('w')} AS term FROM named WHERE length(w) > 2 AND length({STEM.format('w')}) > 2 AND NOT list_contains({GENERIC}, {STEM.format('w')})),
primaries AS (SELECT * FROM raw_direct UNION SELECT * FROM entity),
counting AS (SELECT * FROM wide UNION SELECT * FROM entity),
asked AS (SELECT * FROM raw_direct UNION SELECT * FROM wide WHERE query_id NOT IN (SELECT query_id FROM raw_direct)),
sizes AS (SELECT query_id, count(*) AS terms FROM asked GROUP BY 1)
"""


def asked(spark, sf_dir):
    t = F.col("text")
    rows = S.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), X.direct_terms(t).alias("direct"), X.search_terms(t).alias("wide"), X.entity_terms(t).alias("entity"))
    lexical = F.when(F.size("direct") > 0, F.array_distinct("direct")).otherwise(F.col("wide"))
    return rows.select("query_id", lexical.alias("lexical"), F.array_union("wide", "entity").alias("terms"), F.array_union("direct", "entity").alias("primary"))


@registered("R9_relevant_episodes", f"""WITH {EPISODE}, {ASKED}, {bm25_sql('episode', 'session_id', 'summary')},
lexical AS (SELECT query_id, doc AS session_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, significance DESC, updated DESC, doc) - 1 AS lexical FROM hits JOIN episode ON doc = session_id QUALIFY lexical < 10),
newest AS (SELECT session_id, row_number() OVER (ORDER BY updated DESC, significance DESC, session_id) - 1 AS recency FROM episode QUALIFY recency < 40),
raw AS (SELECT query_id, count(*) AS n_exact FROM lexical GROUP BY 1),
pool AS (SELECT coalesce(l.query_id, r.query_id) AS query_id, coalesce(l.session_id, r.session_id) AS session_id, lexical, recency FROM lexical l FULL JOIN (SELECT item_id AS query_id, session_id, recency FROM benchmark, newest) r ON l.query_id = r.query_id AND l.session_id = r.session_id),
facts AS (SELECT session_id, summary, significance, updated, {noise_sql('summary', L.NOISE_SUMMARIES[1:2])} AS generic, CASE WHEN {NORMAL.format('summary')} = '' THEN CAST(session_id AS VARCHAR) ELSE lower({NORMAL.format('summary')}) END AS s FROM episode
 WHERE session_id IN (SELECT session_id FROM pool) AND NOT {noise_sql('summary', (*L.NOISE_SUMMARIES[:1], *L.NOISE_SUMMARIES[2:]))}),
kept AS (SELECT query_id, session_id, lexical, recency, significance, updated, generic FROM pool JOIN facts USING (session_id) QUALIFY row_number() OVER (PARTITION BY query_id, s ORDER BY lexical NULLS LAST, recency, session_id) = 1),
size AS (SELECT query_id, count(*) AS n_pool FROM kept GROUP BY 1),
toks AS (SELECT DISTINCT session_id, {STEM.format('t')} AS term FROM (SELECT session_id, unnest({WORDS.format('summary')}) AS t FROM facts)),
held AS (SELECT query_id, session_id, t.term, (query_id, t.term) IN (SELECT (query_id, term) FROM primaries) AS first FROM kept k JOIN toks t USING (session_id) JOIN counting c USING (query_id, term) WHERE length(t.term) > 2),
pdf AS (SELECT query_id, term, count(*) AS df FROM held GROUP BY 1, 2),
sums AS (SELECT query_id, session_id, sum(1 + (n_pool - df) / CAST(n_pool AS DOUBLE)) AS w, count(*) AS matched, count(*) FILTER (first) AS p FROM held JOIN pdf USING (query_id, term) JOIN size USING (query_id) GROUP BY 1, 2),
fused AS (SELECT k.*, matched, round(w + 0.35 * matched + 1.25 * p + CASE WHEN lexical IS NOT NULL THEN 2.0 ELSE 0.0 END + CASE WHEN generic THEN 0.0 ELSE 0.5 END + least(significance / 10.0, 1.0)
  + 30 * (1.0 / (60 + coalesce(lexical, n_exact, 0)) + 1.0 / (60 + coalesce(recency, (SELECT count(*) FROM newest)))), 6) AS score FROM kept k JOIN sums USING (query_id, session_id) LEFT JOIN raw USING (query_id) WHERE p > 0 OR matched > 1),
preferred AS (SELECT * FROM fused QUALIFY NOT generic OR NOT bool_or(NOT generic) OVER (PARTITION BY query_id))
SELECT query_id, session_id, score, matched FROM preferred QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, significance DESC, updated DESC, session_id) <= 5""")
def relevant_episodes(spark, sf_dir):
    return R.relevant_episodes(S.episode(spark, sf_dir), asked(spark, sf_dir), limit=5)


@registered("R3_memory_search", f"""WITH {MEMORY}, {ASKED.replace('asked AS (SELECT * FROM raw_direct UNION SELECT * FROM wide WHERE query_id NOT IN (SELECT query_id FROM raw_direct))', 'asked AS (SELECT * FROM wide)')}, {bm25_sql('memory', 'id', 'content')},
best AS (SELECT * FROM (SELECT query_id, m.*, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, confidence DESC, updated_at DESC, id) AS pos
  FROM hits JOIN memory m ON doc = id WHERE superseded_by IS NULL AND (scope = 'global' OR repository = 'src3')) WHERE pos <= 8),
kept AS (SELECT *, row_number() OVER (PARTITION BY query_id, type, lower({NORMAL.format('content')}), scope, coalesce(repository, '') ORDER BY score DESC, confidence DESC, updated_at DESC, id) AS k FROM best)
SELECT query_id, id, score, confidence FROM kept WHERE k = 1""")
def memory_search(spark, sf_dir):
    wide = S.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), X.search_terms(F.col("text")).alias("terms"))
    return R.search_memory(S.memory(spark, sf_dir), wide, limit=8, repository="src3")
