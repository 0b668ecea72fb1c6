"""The prefix trie against a plain walk over all prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from reelframe.llm import prefixes


def walked(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(turns)] for c, turns in own.items()}
    members = defaultdict(list)
    ends = defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 6
        s = tuple(own.get(c - c % 100, [])[:h] + own[c][h:])
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
        ends[s].append(c)
    kids = defaultdict(list)
    for s in members:
        if s:
            kids[s[:-1]].append(s)
    total = {}
    for s in sorted(members, key=len, reverse=True):
        leaves, saved = (sum(total[k][i] for k in kids[s]) for i in (0, 1))
        total[s] = (leaves + (not kids[s]), saved + (len(members[s]) - 1) * (len(s[-1][1]) if s else 0))
    sha = lambda cs: hashlib.sha256(",".join(map(str, cs)).encode()).hexdigest()
    return {(m[0], len(s), members[s[:-1]][0] if s else None, len(m), len(kids[s]), *total[s], sha(ends[s])) for s, m in members.items()}


def check(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, d int, node string").repartition(3)
    got = [tuple(r) for r in prefixes.trie(df).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()]
    want = walked(rows)
    assert len(got) == len(want) and set(got) == want


@pytest.mark.parametrize("seed", [1, 2])
def test_random_conversations(spark, seed):
    """Few words, so that prefixes are shared; turns without number, tied, null and repeated; bases that are absent."""
    rnd = random.Random(seed)
    rows = [(None, 1, "user", "a")]
    for c in [*range(0 if seed == 1 else 40, 60), *range(200, 230), 345]:
        for turn in range(rnd.choice([1, 2, 3, 5, 7, 8, 9])):
            rows.append((c, rnd.choice([turn, turn, turn, None, 2]), rnd.choice(["u", "u", "u", None, "s"]), rnd.choice(["a", "a", "a", "ü🙂", "", None])))
    check(spark, rows + rows[:4])


def test_copies_and_a_long_one(spark):
    """One conversation that many repeat, one first turn that most share, one with very many turns."""
    rows = [(c, t, "user", f"same {t}") for c in range(300) for t in range(3)]
    rows += [(c, t, "user", "hello" if t == 0 else f"{c} {t}") for c in range(1000, 1040) for t in range(4)]
    rows += [(5000, t, "user", f"turn {t}") for t in range(70)] + [(5001, t, "user", f"turn {t}") for t in range(66)]
    check(spark, rows)


def test_odd_tables(spark):
    df = spark.createDataFrame([(1, 0, "u", "a")], "conv_id long, turn long, role string, text string")
    assert prefixes.trie(df.limit(0)).collect() == []
    # crc32("1") % 6 turns would come from an absent conversation, so the only one is dropped: a root alone
    lent = zlib.crc32(b"1") % 6
    got = prefixes.trie(df).collect()
    assert lent > 0 and [(r.conv_id, r.depth, r.n_convs, r.n_leaves, r.ends_sha256) for r in got] == [(1, 0, 1, 1, hashlib.sha256(b"1").hexdigest())]
