"""Search of the raw session log: entries that hold all of a query's terms, and the best entry of each session.

``index`` has entry_id (unique), session_id, content and source_type; ``sessions`` has session_id, repository, branch and
updated_at; ``queries`` has query_id and terms (stems, see ``terms.raw_search_terms``). Entries are read once, in place: in each
block of them every term has a bit for each entry that holds it, and a query's entries are those whose bits all its terms have.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.terms import let
from ..functions.text import normalize
from .ranking import first_of

#: Queries that are sent to all tasks at once at most, of so many terms on average; for more the entries are read again.
IN_PLAN, LONG = 200_000, 32
#: Rows of sessions that are sent to all tasks at most; beyond it they are joined by a shuffle.
SESSIONS = 1_000_000
#: Entries of a block, and the most queries and terms whose bits are put together at a time.
BLOCK, QUERIES, TERMS = 4096, 512, 32_768
EXCERPT, BEGINNING = 220, 1000
#: Which of a block's matches (block, place of the query, place of the entry, stems) may be among the best of all.
Pick = Callable[[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def stemmed(t: str) -> str:
    """``text.stem_word`` of one word."""
    n = len(t)
    if n > 4 and t.endswith("ies"):
        return t[:-3] + "y"
    return t[:-3] if n > 5 and t.endswith("ing") else t[:-2] if n > 4 and t.endswith("ed") else t[:-1] if n > 4 and t.endswith("s") else t


def _asked(rows: pa.Table) -> dict:
    """Queries by the numbers of their terms; ``other`` are those terms that are not their own stems, ``forms`` words that have these as stems."""
    lists = rows.column("terms").combine_chunks()
    flat = lists.flatten()
    names = pc.unique(flat)
    of = pc.index_in(flat, names).to_numpy(zero_copy_only=False).astype(np.int32)
    ends = np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]
    words = names.to_pylist()
    own = np.array([stemmed(t) == t and len(t) > 2 for t in words], bool)
    forms = [(w, k) for k, t in enumerate(words) if not own[k] and len(t) > 2 for w in (t + "s", t + "ed", t + "ing", t[:-1] + "ies") if stemmed(w) == t]
    return {"ids": rows.column("query_id").combine_chunks(), "of": of, "ends": ends, "names": words, "own": own, "forms": forms}


def _bits(term: np.ndarray, entry: np.ndarray, terms: int, entries: int) -> np.ndarray:
    """For each term a row of bits, one for each entry."""
    width = -(-entries // 64)
    bits = np.zeros(terms * width, np.uint64)
    np.bitwise_or.at(bits, term * width + (entry >> 6), np.uint64(1) << (entry & 63).astype(np.uint64))
    return bits.reshape(terms, width)


def _met(batch: pa.RecordBatch, asked: dict, known: dict[str, int], forms: dict[str, int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places of queries and of entries that hold all their terms, and the number of terms among the entries' stems."""
    held, formed = [], []
    for text in batch.column("content").to_pylist():
        words = set(re.findall("[a-z0-9]+", text or ""))
        held.append([known[w] for w in known.keys() & words])
        formed.append([forms[w] for w in forms.keys() & words] if forms else [])
    flat = lambda lists: (np.array([x for some in lists for x in some], np.int64), np.repeat(np.arange(len(lists)), list(map(len, lists))))
    term, entry = flat(held)
    there = np.zeros(len(known), bool)
    there[term] = True
    ends, of, own = asked["ends"], asked["of"], asked["own"]
    # queries all of whose terms are somewhere in the block
    alive = np.flatnonzero(np.logical_and.reduceat(there[of], ends[:-1]))
    sizes = np.diff(ends)[alive]
    needed = np.zeros(len(known), bool)
    needed[of[np.repeat(ends[alive] - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())]] = True
    place = np.cumsum(needed) - 1
    bits = _bits(place[term[needed[term]]], entry[needed[term]], int(needed.sum()), len(batch))
    term, entry = flat(formed)
    also = _bits(term, entry, len(known) if forms else 0, len(batch))
    i = 0
    while i < len(alive):
        j = min(i + QUERIES, i + max(1, int(np.searchsorted(np.cumsum(sizes[i : i + QUERIES]), TERMS, side="right"))))
        some, n = alive[i:j], sizes[i:j]
        first = np.r_[0, np.cumsum(n)[:-1]]
        terms = of[np.repeat(ends[some] - first, n) + np.arange(n.sum())]
        every = np.bitwise_and.reduceat(bits[place[terms]], first, axis=0)
        q, e = np.nonzero(np.unpackbits(every.view(np.uint8), axis=1, bitorder="little"))
        stems = np.add.reduceat(own[terms].astype(np.int64), first)[q]
        for k in np.flatnonzero(~own[terms]) if forms else ():
            asks = np.searchsorted(first, k, side="right") - 1
            mine = slice(*np.searchsorted(q, [asks, asks + 1]))
            stems[mine] += (also[terms[k], e[mine] >> 6] >> (e[mine] & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64)
        yield some[q], e, stems
        i = j


def _found(entries: DataFrame, queries: DataFrame, pick: Pick | None = None) -> DataFrame:
    """query_id, entry_id, n_stems of the matches in ``entries`` (entry_id, content and what ``pick`` asks for)."""
    terms = F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms")
    asked = queries.where(F.col("query_id").isNotNull() & (F.size("terms") > 0)).groupBy("query_id").agg(terms)
    n, size = asked.agg(F.count(F.lit(1)), F.sum(F.size("terms"))).first()
    slices = max(1, -(-n // max(IN_PLAN, 1)), -(-(size or 0) // max(LONG * IN_PLAN, 1)))
    fields = [asked.schema["query_id"].simpleString(), entries.schema["entry_id"].simpleString(), "n_stems:int"]
    low = entries.where("entry_id is not null").withColumn("content", F.lower("content"))

    def of_slice(k: int) -> DataFrame:
        mine = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(slices)) == k) if slices > 1 else asked
        rows = mine.toArrow()
        sent = entries.sparkSession.sparkContext.broadcast(_asked(rows)) if rows.num_rows else None

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if sent is None:
                return
            asks = sent.value
            known, forms = {t: i for i, t in enumerate(asks["names"])}, dict(asks["forms"])
            for whole in it:
                for i in range(0, whole.num_rows, BLOCK):
                    batch = whole.slice(i, BLOCK)
                    batch = batch.take(pc.sort_indices(batch.column("entry_id")))
                    for q, e, stems in _met(batch, asks, known, forms):
                        if pick:
                            kept = pick(batch, q, e, stems)
                            q, e, stems = q[kept], e[kept], stems[kept]
                        columns = [asks["ids"].take(pa.array(q)), batch.column("entry_id").take(pa.array(e)), pa.array(stems.astype(np.int32))]
                        yield pa.RecordBatch.from_arrays(columns, ["query_id", "entry_id", "n_stems"])

        return low.mapInArrow(run, ", ".join(fields))

    return reduce(DataFrame.unionByName, map(of_slice, range(slices)))


def matches(index: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, entry_id, n_stems: entries whose words hold all terms, with the number of terms among their stems. Entries are not shuffled."""
    return _found(index.select("entry_id", "content"), queries)


def _first_each(key: np.ndarray, limit: int) -> np.ndarray:
    """Which are among the first ``limit`` of their key; equal keys stand together."""
    at = np.arange(len(key))
    return at - np.maximum.accumulate(np.where(np.r_[True, key[1:] != key[:-1]][: len(key)], at, 0)) < limit


def _of_known(index: DataFrame, sessions: DataFrame, repository: str | None) -> DataFrame:
    """The entries of known sessions (of one repository, if asked), with ``updated_at``."""
    known = (sessions.where(F.col("repository") == repository) if repository else sessions).select("session_id", "updated_at")
    return index.join(F.broadcast(known) if known.limit(SESSIONS + 1).count() <= SESSIONS else known, "session_id")


def _told(found: DataFrame, index: DataFrame, sessions: DataFrame, repository: str | None) -> DataFrame:
    light = found.join(index.select("entry_id", "session_id", "source_type"), "entry_id").join(sessions.select("session_id", "repository", "branch", "updated_at"), "session_id")
    return light.where(F.col("repository") == repository) if repository else light


def search_index(index: DataFrame, sessions: DataFrame, queries: DataFrame, limit: int = 5, repository: str | None = None) -> DataFrame:
    """The first ``limit`` entries, by entry_id, that hold all of a query's terms, of sessions that are known (of one repository, if asked)."""
    entries = _of_known(index, sessions, repository).select("entry_id", "content")
    found = _found(entries, queries, lambda batch, q, e, stems: _first_each(q, limit))  # entries of a block are in order
    found = first_of(_told(found, index, sessions, repository), ["query_id"], [F.col("entry_id")], limit)
    return found.select("query_id", "entry_id", "session_id", "source_type", "repository", "branch")


def excerpt(content: Column) -> Column:
    """The first signs of the normalised text; where its beginning has enough of them, the rest is not looked at."""
    whole = F.substring(normalize(content), 1, EXCERPT)
    return let(normalize(F.substring(content, 1, BEGINNING)), lambda t: F.when(F.length(t) > EXCERPT, F.substring(t, 1, EXCERPT)).otherwise(whole))


def relevant_sessions(index: DataFrame, sessions: DataFrame, queries: DataFrame, limit: int = 5, repository: str | None = None) -> DataFrame:
    """The best ``limit`` sessions of a query, each by its best entry; scores count stems, and checkpoints before turns count more.

    Of a session's entries of one score the first is taken. Each block of entries tells its own best, so that matches are never gathered.
    Only ids and scores are ranked; the chosen meet excerpts, never whole texts.
    """
    boost = F.when(F.col("source_type").startswith("checkpoint_"), 1.5).when(F.col("source_type") == "turn", 0.5).otherwise(0.0)

    def best_of(batch: pa.RecordBatch, q: np.ndarray, e: np.ndarray, stems: np.ndarray) -> np.ndarray:
        place = lambda c, order: pc.rank(batch.column(c), sort_keys=order, null_placement="at_end", tiebreaker="dense").to_numpy().astype(np.int64)[e]
        score, late, session = stems + batch.column("boost").to_numpy()[e], place("updated_at", "descending"), place("session_id", "ascending")
        order = np.lexsort((e, session, late, -score, q))
        order = order[stems[order] > 0]
        first = np.sort(np.unique(q[order] * (BLOCK + 1) + session[order], return_index=True)[1])
        order = order[first]
        return order[_first_each(q[order], limit)]

    entries = _of_known(index.withColumn("boost", boost), sessions, repository).select("entry_id", "content", "session_id", "updated_at", "boost")
    found = _found(entries, queries, best_of)
    scored = _told(found, index, sessions, repository).withColumn("score", F.col("n_stems") + boost)
    entry = F.struct("score", (-F.col("entry_id")).alias("early"), "entry_id", "source_type", "repository", "branch", "updated_at")
    best = scored.groupBy("query_id", "session_id").agg(F.max(entry).alias("e")).select("query_id", "session_id", "e.*")
    chosen = first_of(best, ["query_id"], [F.desc("score"), F.desc("updated_at"), F.col("session_id")], limit)
    texts = index.select("entry_id", excerpt(F.col("content")).alias("excerpt"))
    return chosen.join(texts, "entry_id").select("query_id", "session_id", "repository", "branch", "updated_at", "score", "source_type", "excerpt")
