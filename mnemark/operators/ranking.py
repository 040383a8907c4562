"""Retrieval and ranking: BM25, reciprocal-rank fusion, ordered dedup, budgets, pages and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import lexicon as L
from ..functions.terms import matches
from ..functions.text import estimated_tokens, normalize, tokens, word_count, words

K1, B = 1.2, 0.75


def first_of(df: DataFrame, by: list[str], order: list[Column], count: int = 1) -> DataFrame:
    at = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("_at", at).where(F.col("_at") <= count).drop("_at")


def newest(rows: DataFrame, by: list[str], order: list[Column], count: int, salts: int = 32) -> DataFrame:
    """The first ``count`` rows of each group: of each of its salted parts first, then of these."""
    salt = F.pmod(F.xxhash64(*rows.columns), F.lit(salts))
    return first_of(first_of(rows.withColumn("_salt", salt), [*by, "_salt"], order, count).drop("_salt"), by, order, count)


def bm25(docs: DataFrame, queries: DataFrame, doc: str, text: str, query: str) -> DataFrame:
    """query, doc, score of the documents that hold all of a query's terms; the larger score the better.

    ``queries`` has (query, terms). Only postings of the queries' terms are kept, so the shuffle follows matches. A
    query's document frequencies and the corpus statistics cover all rows of ``docs``. Only documents that hold a query's
    rarest term can hold all its terms, so that no others meet the rest of them.
    """
    asked = queries.select(query, F.explode(F.array_distinct("terms")).alias("term"))
    wanted = asked.select("term").distinct()
    corpus = docs.agg(F.count(F.lit(1)).alias("n"), F.avg(word_count(F.col(text))).alias("avgdl"))

    def postings_of(rows: DataFrame) -> DataFrame:
        each = rows.select(doc, words(F.col(text)).alias("w")).select(doc, F.size("w").alias("dl"), "w")
        held = each.select(doc, "dl", F.explode_outer("w").alias("term")).join(wanted, "term", "left_semi")
        counted = held.groupBy(doc, "term").agg(F.count(F.lit(1)).alias("tf"), F.max("dl").alias("dl"))
        # true of every row: all uses look at the same columns, so that postings are made and shuffled once
        return counted.where("tf > 0 and dl > 0")

    # documents without an id count, together, as one, and are no hits
    postings, nameless = postings_of(docs.where(F.col(doc).isNotNull())), postings_of(docs.where(F.col(doc).isNull()))
    df = postings.select("term").unionAll(nameless.select("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    terms = asked.join(df, "term")
    # one row for each query, and one row of statistics
    rarest = first_of(terms, [query], [F.col("df"), F.col("term")]).select(query, "term")
    likely = postings.join(F.broadcast(rarest), "term").select(query, doc)
    sought = likely.join(terms, query).crossJoin(F.broadcast(corpus))
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    sizes = asked.groupBy(query).agg(F.count(F.lit(1)).alias("terms"))
    scored = postings.join(sought, [doc, "term"]).groupBy(query, doc).agg(F.round(F.sum(part), 6).alias("score"), F.count(F.lit(1)).alias("held"))
    return scored.join(sizes, query).where("held = terms").select(query, doc, "score")


def eligible(repository: str | None, include_other: bool = False) -> Column:
    if include_other:
        return F.lit(True)
    own = F.col("scope") == "global"
    return own | (F.col("repository") == repository) if repository else own


def search_memory(memory: DataFrame, queries: DataFrame, limit: int = 8, repository: str | None = None, include_other: bool = False) -> DataFrame:
    """Live, eligible memories that hold all terms, best ``limit`` of each query, then one of equal content."""
    key = F.sha2(F.concat_ws("\u0001", "type", F.lower(normalize(F.col("content"))), "scope", F.coalesce("repository", F.lit(""))), 256)
    # a memory's text is told by its key before the join, so that no text is shuffled or sorted
    live = memory.where("superseded_by is null").where(eligible(repository, include_other)).select("id", "confidence", "updated_at", key.alias("_key"))
    hits = bm25(memory, queries, "id", "content", "query_id").join(live, "id")
    keyed = first_of(hits, ["query_id"], [F.desc("score"), F.desc("confidence"), F.desc("updated_at"), F.col("id")], limit)
    kept = first_of(keyed, ["query_id", "_key"], [F.desc("score"), F.desc("confidence"), F.desc("updated_at"), F.col("id")])
    return kept.select("query_id", "id", "score", "confidence")


def excluded(summary: Column) -> Column:
    """Why an episode is no candidate, or null."""
    text = normalize(summary)
    return F.when(matches(text, L.NOISE_SUMMARIES[:1]), "placeholder_summary").when(matches(text, L.NOISE_SUMMARIES[2:]), "tool_invocation_summary")


def relevant_episodes(episodes: DataFrame, queries: DataFrame, limit: int = 5, repository: str | None = None) -> DataFrame:
    """query_id, session_id, score, matched: hybrid ranking over a lexical and a recency pool, ranks fused.

    ``queries`` has query_id, lexical (terms that a lexical hit holds, all of them), terms (those that count) and primary
    (those of ``terms`` that count more). Only what is global or of ``repository`` is looked at, where one is named. A
    candidate needs a primary term or two of any. Terms weigh by their rarity in the pool;
    summaries that are equal but for case and white space count once, lexical hits first; generic ones give way to others.
    """
    most_exact, most_recent = max(2 * limit, 8), max(8 * limit, 24)
    everywhere, episodes = episodes, episodes.where(eligible(repository, repository is None))
    asked_for = queries.select("query_id", F.col("lexical").alias("terms"))
    light = episodes.select("session_id", "significance", "updated")
    hits = bm25(everywhere, asked_for, "session_id", "summary", "query_id").join(light, "session_id")
    order = [F.desc("score"), F.desc("significance"), F.desc("updated"), F.col("session_id")]
    exact = first_of(hits, ["query_id"], order, most_exact)
    ranked = exact.select("query_id", "session_id", (F.row_number().over(Window.partitionBy("query_id").orderBy(*order)) - 1).alias("lexical"))
    newest_ = episodes.orderBy(F.desc("updated"), F.desc("significance"), "session_id").limit(most_recent).select(F.struct("updated", "significance", (-F.col("session_id")).alias("s"), "session_id").alias("e"))
    # a fixed number of rows, numbered once and given to every query
    listed = newest_.agg(F.reverse(F.array_sort(F.collect_list("e"))).alias("l")).select(F.posexplode("l").alias("recency", "e")).select("recency", F.col("e.session_id").alias("session_id"))
    recent = queries.select("query_id").crossJoin(F.broadcast(listed))
    of_query = Window.partitionBy("query_id")  # a pool has 10 rows a result at most
    pool = ranked.join(recent, ["query_id", "session_id"], "full").withColumn("n_exact", F.count("lexical").over(of_query)).withColumn("n_recent", F.count("recency").over(of_query))
    # a pool's ids, 10 a result of each query at most, are small beside the texts, which are neither shuffled nor sorted
    texts = episodes.join(F.broadcast(pool.select("session_id").distinct()), "session_id", "left_semi").withColumn("_why", excluded(F.col("summary"))).where("_why is null")
    key = F.coalesce(F.nullif(F.md5(F.lower(normalize(F.col("summary")))), F.md5(F.lit(""))), F.col("session_id").cast("string"))
    asked = queries.select("query_id", F.explode(F.array_distinct("terms")).alias("term"), "primary").select("query_id", "term", F.array_contains("primary", F.col("term")).alias("first"))
    # every text of the pools is cut to terms once, however many queries look at it
    facts = texts.select("session_id", "significance", "updated", key.alias("_s"), matches(normalize(F.col("summary")), L.NOISE_SUMMARIES[1:2]).alias("generic"), tokens(F.col("summary")).alias("tokens"))
    kept = first_of(pool.join(facts, "session_id"), ["query_id", "_s"], [F.col("lexical").asc_nulls_last(), F.col("recency"), F.col("session_id")])
    each = kept.withColumn("n_pool", F.count(F.lit(1)).over(of_query)).select("*", F.explode("tokens").alias("term")).drop("tokens", "_s").join(asked, ["query_id", "term"])
    weight = 1 + (F.col("n_pool") - F.count(F.lit(1)).over(Window.partitionBy("query_id", "term"))) / F.col("n_pool")
    own = ["query_id", "session_id", "lexical", "recency", "n_exact", "n_recent", "significance", "updated", "generic"]
    sums = each.withColumn("weight", weight).groupBy(*own).agg(F.sum("weight").alias("w"), F.count(F.lit(1)).alias("matched"), F.count_if("first").alias("primary"))
    rrf = 1 / (60 + F.coalesce("lexical", "n_exact")) + 1 / (60 + F.coalesce("recency", "n_recent"))
    term_score = F.col("w") + 0.35 * F.col("matched") + 1.25 * F.col("primary") + F.when(F.col("lexical").isNotNull(), 2.0).otherwise(0.0) + F.when(F.col("generic"), 0.0).otherwise(0.5) + F.least(F.col("significance") / 10, F.lit(1.0))
    scored = sums.where("primary > 0 or matched > 1").withColumn("score", F.round(term_score + 30 * rrf, 6))
    preferred = scored.withColumn("_some", F.bool_or(~F.col("generic")).over(of_query)).where(~F.col("_some") | ~F.col("generic"))
    return first_of(preferred, ["query_id"], [F.desc("score"), F.desc("significance"), F.desc("updated"), F.col("session_id")], limit).select("query_id", "session_id", "score", "matched")


def packed(items: DataFrame, group: str, order: list[Column], text: str, budget: int) -> DataFrame:
    """The items of each group, in order, until the first that would exceed the budget; empty ones cost nothing.

    An item costs one at least, so no group can take more than its first ``budget`` items: only these are summed.
    """
    spent = F.sum("cost").over(Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    costed = items.where(F.length(F.trim(text)) > 0).withColumn("cost", estimated_tokens(F.col(text)))
    return newest(costed, [group], order, budget).withColumn("spent", spent).where(F.col("spent") <= budget)


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def after(df: DataFrame, stamp: str, key: str, cursor: tuple, limit: int) -> DataFrame:
    """The next page by keyset: rows before the cursor, newest first."""
    at, of = F.lit(cursor[0]), F.lit(cursor[1])
    return df.where((F.col(stamp) < at) | ((F.col(stamp) == at) & (F.col(key) < of))).orderBy(F.desc(stamp), F.desc(key)).limit(limit)


def retained(df: DataFrame, by: str, stamp: str, key: str, since: Column, per_group: int, overall: int) -> DataFrame:
    """Rows not older than ``since``: the newest of each group, then the newest of these overall."""
    kept = first_of(df.where(F.col(stamp) >= since), [by], [F.desc(stamp), F.desc(key)], per_group)
    return kept.orderBy(F.desc(stamp), F.desc(key)).limit(overall)


def rotating(df: DataFrame, position: str, size: int, cursor: int, limit: int) -> DataFrame:
    return df.where(F.pmod(F.col(position) - cursor, F.lit(size)) < limit)
