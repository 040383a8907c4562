import hashlib
import random
import zlib

import pytest

from mnemark.llm import common, trie

SCHEMA = "conv_id long, turn long, role string, text string, n string, depth string, part string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    own = {}
    for c, t, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0)):
        own.setdefault(c, []).append((role or "", text or ""))
    full = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        full[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = {}
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    out = []
    for node, convs in members.items():
        under = [m for m in members if m[: len(node)] == node]
        leaves = [m for m in under if not any(x[:-1] == m and x for x in members)]
        saved = sum((len(members[m]) - 1) * len(m[-1][1]) for m in under if m)
        ends = ",".join(map(str, sorted(c for c in convs if full[c] == node)))
        parent = min(members[node[:-1]]) if node else None
        children = sum(1 for m in members if len(m) == len(node) + 1 and m[: len(node)] == node)
        out.append((min(convs), len(node), parent, len(convs), children, len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def run(spark, rows, parts=1):
    frame = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(parts)
    return sorted(map(tuple, trie.prefix_trie(frame).select(*COLUMNS).collect()), key=repr)


def talks(seed=1):
    rnd = random.Random(seed)
    say = lambda: (rnd.choice(["user", "assistant", None]), rnd.choice(["hello", "héllo 😀", "", None, "x" * 9, "bye"]))
    rows = []
    for c in [*range(0, 60), *range(100, 140), *range(250, 270), -3, -250, -200, 7_000_000_000]:
        start = [("user", "hello")] * 2 if c % 3 == 0 else []
        rows += [(c, t, *x) for t, x in enumerate(start + [say() for _ in range(rnd.randrange(0, 9))])]
    rows += [(300, t, "user", "same") for t in range(40)] + [(c, t, "user", "same") for c in range(301, 330) for t in range(3)]
    rows += [(None, 1, "user", "lost"), (330, None, "user", "first"), (330, 1, None, None), (331, 5, "user", "twice"), (331, 5, "user", "twice"), (599, 0, "user", "no base")]
    return rows


@pytest.mark.parametrize("share", [1000, 3])
def test_nodes_equal_brute_force(spark, monkeypatch, share):
    monkeypatch.setattr(common, "HOT_SHARE", share)
    monkeypatch.setattr(trie, "CHUNK", 4)
    rows = talks()
    random.Random(2).shuffle(rows)
    assert run(spark, rows, 3) == brute(rows)


def test_an_empty_table_has_no_root_and_a_turnless_conversation_only_that(spark):
    assert run(spark, []) == []
    assert run(spark, [(None, 1, "user", "x")]) == []
    alone = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6)
    assert run(spark, [(alone, 1, "user", "x")]) == brute([(alone, 1, "user", "x")])


def test_a_long_conversation_is_cut_amid(spark):
    rows = [(500, t, "user", f"turn {t % 7}") for t in range(1500)] + [(501, t, "user", "other") for t in range(8)]
    got = run(spark, rows, 4)
    assert max(r[1] for r in got) == 1500 and len(got) > 1500
    root = next(r for r in got if r[1] == 0)
    assert root[3] == 2 and root[5] == 2
