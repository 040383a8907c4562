"""Registered queries on sessions: their turns, and the memories that rules take from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..operators import sessions as N
from ..sources import bindings as S
from .memory_queries import NORMAL, registered
from .prompt_queries import any_of, list_of, q

#: Openings of the invented talk, by session and turn.
TALK = (
    "", "I prefer small commits in ", "never rename ", "please keep a friendly tone like a colleague ", "help me understand the whole of ", "you keep dropping the tests of ",
    "no, that should be the other one: ", "the build failed with an error in ", "actually use the older reader instead ", "the migration is broken, restore ",
    "could you add a little humour and use my name sparingly ",
)
MESSAGE = f"({list_of(TALK)})[1 + (conv_id + turn) % {len(TALK)}] || coalesce(text, '')"
TURNS = f"""
said AS (SELECT conv_id AS session_id, turn AS turn_index, role, {MESSAGE} AS message FROM conversations),
turns AS (SELECT session_id, turn_index, max(message) FILTER (role = 'user') AS user_message, max(message) FILTER (role <> 'user') AS assistant_response FROM said GROUP BY 1, 2)
"""


def turns(spark, sf_dir):
    """Invented talk as turns, each message behind an opening that makes some of them speak as people do."""
    opening = F.array(*map(F.lit, TALK))[((F.col("conv_id") + F.col("turn")) % len(TALK)).cast("int")]
    message = F.concat(opening, F.coalesce("text", F.lit("")))
    said = S.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("turn_index"), "role", message.alias("message"))
    mine = F.col("role") == "user"
    return said.groupBy("session_id", "turn_index").agg(F.max(F.when(mine, F.col("message"))).alias("user_message"), F.max(F.when(~mine, F.col("message"))).alias("assistant_response"))


def newest_sql(name: str, count: int, most: int) -> str:
    return f"""{name} AS (SELECT session_id, turn_index, {NORMAL.format('user_message')} AS m FROM turns QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY turn_index DESC, user_message) <= {count}),
{name}s AS (SELECT * FROM {name} WHERE m <> '' AND length(m) <= {most})"""


def group_sql(pattern: str) -> str:
    return f"{NORMAL.format(f'''regexp_extract(m, '{q(pattern)}', 1, 'i')''')}"


@registered("S7_session_turns", f"""WITH {TURNS} SELECT session_id, turn_index, row_number() OVER (PARTITION BY session_id ORDER BY turn_index) - 1 AS position, md5(coalesce(user_message, '')) AS user_message, md5(coalesce(assistant_response, '')) AS assistant_response FROM turns""")
def session_turns(spark, sf_dir):
    rows = N.numbered(turns(spark, sf_dir), "session_id", "turn_index")
    return rows.select("session_id", "turn_index", "position", *[F.md5(F.coalesce(c, F.lit(""))).alias(c) for c in ("user_message", "assistant_response")])


STYLED = f"{any_of('m', L.STYLE_REQUESTS)} AND ({' OR '.join(any_of('m', p) for p in (L.AS_COLLEAGUE, L.AS_FRIEND, L.AS_PARTNER, L.WITH_HUMOUR, L.WITHOUT_HUMOUR, L.BY_NAME))})"


@registered("C4a_stated_preferences", f"""WITH {TURNS}, {newest_sql('w', 12, 240)}, k AS (SELECT *, {STYLED} AS style FROM ws)
SELECT session_id, turn_index, CASE WHEN style THEN 'interaction_style' WHEN {any_of('m', [L.PREFERENCE])} THEN 'user_preference' ELSE 'rejected_approach' END AS type,
 CASE WHEN style THEN 'Interaction style preference: ' ELSE '' END || m AS content, CASE WHEN style THEN 0.92 ELSE 0.95 END AS confidence
FROM k WHERE style OR {any_of('m', [L.PREFERENCE, L.REJECTION])}""")
def stated_preferences(spark, sf_dir):
    return N.stated_preferences(turns(spark, sf_dir))


@registered("C4b_interaction_style", f"""WITH {TURNS}, m AS (SELECT session_id, turn_index, {NORMAL.format('user_message')} AS m FROM turns)
SELECT session_id, turn_index, CASE WHEN {any_of('m', L.AS_COLLEAGUE)} THEN 'colleague' WHEN {any_of('m', L.AS_PARTNER)} THEN 'collaborative' ELSE 'friendly' END AS voice,
 CASE WHEN {any_of('m', L.AS_FRIEND)} THEN 'warm' ELSE 'balanced' END AS warmth, CASE WHEN {any_of('m', L.WITHOUT_HUMOUR)} OR NOT {any_of('m', L.WITH_HUMOUR)} THEN 'none' ELSE 'light' END AS humour,
 CASE WHEN {any_of('m', L.WITHOUT_HUMOUR)} OR NOT {any_of('m', L.WITH_HUMOUR)} THEN 'never' WHEN {any_of('m', L.OFTEN_HUMOUR)} THEN 'frequent' ELSE 'occasional' END AS frequency,
 {any_of('m', (*L.AS_PARTNER, *L.AS_COLLEAGUE))} AS collaborative, {any_of('m', L.BY_NAME)} AS by_name FROM m WHERE {STYLED}""")
def interaction_style(spark, sf_dir):
    rows = turns(spark, sf_dir).select("session_id", "turn_index", N.interaction_style(N.clean(F.col("user_message"))).alias("p"))
    return rows.where("p is not null").select("session_id", "turn_index", "p.*")


def captured_sql(kind: str, pattern: str, lead: str, count: int, most: int, least: int, confidence: float) -> str:
    return f"""WITH {TURNS}, {newest_sql('w', count, most)}, c AS (SELECT session_id, turn_index, {group_sql(pattern)} AS found FROM ws)
SELECT session_id, min(turn_index) AS turn_index, '{kind}' AS type, '{lead}' || arg_min(found, (turn_index, found)) AS content, {confidence} AS confidence FROM c WHERE length(found) >= {least} GROUP BY session_id, lower(found)"""


@registered("C4d_stated_goals", captured_sql("assistant_goal", L.GOAL, "Current assistant goal: ", 12, 240, 10, 0.85))
def stated_goals(spark, sf_dir):
    return N.stated_goals(turns(spark, sf_dir))


@registered("C4d_stated_mistakes", captured_sql("recurring_mistake", L.MISTAKE, "Recurring mistake to avoid: ", 20, 260, 8, 0.9))
def stated_mistakes(spark, sf_dir):
    return N.stated_mistakes(turns(spark, sf_dir))


def uncorrected_sql(column: str) -> str:
    for p in L.CORRECTION_LEADS:
        column = f"regexp_replace({column}, '{q(p)}', '', 'i')"
    return f"trim({column})"


@registered("C4e_implied_mistakes", f"""WITH {TURNS}, {newest_sql('w', 20, 280)} SELECT session_id, max(turn_index) AS turn_index, 'recurring_mistake' AS type, 'Recurring mistake to avoid: {L.IMPLICIT_MISTAKE}.' AS content, 0.93 AS confidence
FROM ws WHERE {any_of('m', L.CORRECTIONS)} AND length({uncorrected_sql('m')}) >= 12 GROUP BY 1 HAVING count(*) >= 2""")
def implied_mistakes(spark, sf_dir):
    return N.implied_mistakes(turns(spark, sf_dir))


@registered("C4f_implied_goals", f"""WITH {TURNS}, w AS (SELECT * FROM turns QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY turn_index DESC, user_message) <= 16),
e AS (SELECT session_id, turn_index, 0 AS side, {NORMAL.format('user_message')} AS m FROM w UNION ALL SELECT session_id, turn_index, 1, {NORMAL.format('assistant_response')} FROM w),
f AS (SELECT session_id, min((turn_index, side)) AS spot, CASE WHEN length(m) > 140 THEN rtrim(left(m, 139)) || '…' ELSE m END AS t FROM e WHERE m <> '' AND length(m) <= 280 AND {any_of('m', L.FAILURES)} AND NOT {any_of('m', L.RESOLUTIONS)} GROUP BY session_id, t),
k AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY spot, t) <= 4),
g AS (SELECT session_id, arg_max(spot[1], (spot, t)) AS turn_index, string_agg(t, ' ' ORDER BY spot, t) AS c FROM k GROUP BY 1 HAVING count(*) >= 2)
SELECT session_id, turn_index, 'assistant_goal' AS type, 'Current assistant goal: ' || CASE {' '.join(f"WHEN {any_of('c', [p])} THEN '{goal}'" for p, goal in L.FAILURE_GOALS)} ELSE '{L.OTHER_FAILURE_GOAL}' END AS content, 0.82 AS confidence FROM g""")
def implied_goals(spark, sf_dir):
    return N.implied_goals(turns(spark, sf_dir))
