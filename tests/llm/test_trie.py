"""The trie of prefixes against one built turn by turn: odd rows, long and equal
conversations, very many ends in one node, every width and size of shard."""

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash

from shelfmark.llm import trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, k int, pos int, depth int, conv string"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, "c") for r in rows], SCHEMA)


def conversations(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        role, text = role or "", text or ""
        tie = xxhash.xxh64_intdigest(text, xxhash.xxh64_intdigest(role, 42))
        tie -= (tie >> 63) << 64
        own[c].append(((turn is not None, turn or 0), role, tie, text))
    return {c: [(r, t) for _, r, _, t in sorted(x)] for c, x in own.items()}


def rebuilt(own):
    result = {}
    for c, turns in own.items():
        h = 0 if c is None else zlib.crc32(str(c).encode()) % 9
        base = None if c is None else c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5))
        head = own.get(base, []) if c is not None else []
        result[c] = tuple(head[:h] + turns[h:])
    return result


def brute(rows):
    convs = rebuilt(conversations(rows))
    if not convs:
        return Counter()
    nodes = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes[turns[:d]].append(c)

    def least(members):
        return min((c for c in members if c is not None), default=None)

    children = Counter(x[:-1] for x in nodes if x)
    leaves, saved = Counter(), Counter()
    for x, members in nodes.items():
        last = len(x[-1][1].encode()) if x else 0
        for d in range(len(x) + 1):
            leaves[x[:d]] += not children[x]
            saved[x[:d]] += (len(members) - 1) * last
    result = Counter()
    for x, members in nodes.items():
        ends = sorted(c for c in members if c is not None and len(convs[c]) == len(x))
        digest = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        parent = least(nodes[x[:-1]]) if x else None
        result[least(members), len(x), parent, len(members), children[x], leaves[x], saved[x], digest] += 1
    return result


def odd_rows():
    rows = [
        (None, None, None, None), (None, 1, "user", "x"), (0, None, "user", "a"), (0, 0, "b", "bé"),
        (0, 0, "a", "c"), (0, 0, "a", "c"), (0, 1, None, "漢字"), (5, 0, "user", "a"), (-7, 0, "user", "a"),
        (-5, 0, "user", "a"), (-5, 1, "user", "b"), (6, 0, "user", ""), (6, 1, "", ""), (7, 3, "us", "erq"),
        (8, 3, "user", "q"), (2**62, 0, "user", "a"),
    ]
    # copies of conversations, single turns, and common first turns
    for c in range(20, 120):
        for k in range(c % 13):
            rows.append((c, k, "user" if k % 2 else "assistant", f"t{k * (c // 30)}"))
    return rows


@pytest.mark.parametrize("width,shard", [(1, 40), (2, 20), (5, 100), (64, 1 << 19)])
def test_odd_rows(spark, width, shard):
    rows = odd_rows()
    got = trie.conversation_trie(table(spark, rows), width, shard)
    assert Counter(map(tuple, got.collect())) == brute(rows)


def test_long_conversations_and_their_copies(spark):
    rows = []
    for c in (1000, 2000, 3001):  # two go on alike, the third parts from them late
        rows += [(c, k, "user", f"turn {k}" if c < 3000 or k < 250 else f"own {k}") for k in range(300)]
    rows += [(c, k, "user", f"turn {k}") for c in range(4000, 4040) for k in range(9 + c % 9)]
    want = brute(rows)
    for width, shard in ((4, 200), (64, 1 << 19)):
        got = trie.conversation_trie(table(spark, rows), width, shard)
        assert Counter(map(tuple, got.collect())) == want


def test_many_conversations_end_in_one_node(spark):
    rows = [(c, 0, "user", "x" if c % 3 else "y") for c in range(0, 9000, 5)]
    rows += [(c, 0, "user", "never taken") for c in range(1, 6000, 5)]
    got = trie.conversation_trie(table(spark, rows), shard=500)
    assert Counter(map(tuple, got.collect())) == brute(rows)


def test_turns_are_numbered_across_ranges(spark):
    rows = [(1, k, "user", f"{k}") for k in range(3000)] + [(2, 0, "u", "a"), (0, 0, "u", "a")]
    got = trie.numbered_turns(table(spark, rows).repartition(7)).collect()
    assert sorted((r.conv, r.k) for r in got) == sorted((c, k) for c, k, _, _ in rows)
    size = {k: len(t) for c, k, _, t in rows if c == 1}
    assert all(r.bytes == size[r.k] for r in got if r.conv == 1)


def test_a_very_long_text_and_an_empty_table(spark):
    rows = [(1, 0, "user", "ä" * 2_000_000), (1, 1, "a", "b"), (3, 0, "user", "c")]
    got = trie.conversation_trie(table(spark, rows))
    assert Counter(map(tuple, got.collect())) == brute(rows)
    assert trie.conversation_trie(table(spark, rows).where("false")).count() == 0
