"""The prefix trie: against SQL and a plain trie, with hot conversations and turns over many ranges."""

import hashlib
import math
import zlib

import numpy as np
import pytest
from compare import connect, rows

from skyweave.llm import prefix_trie, queries
from skyweave.llm.ranges import PRIME, running, segment_starts, times
from skyweave.llm.sql import ORACLES

SMALL = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"
RNG = np.random.default_rng(11)


@pytest.fixture
def many_ranges(spark, monkeypatch):
    """Ranges stay apart, and the list of the tour is contracted down to a few items."""
    monkeypatch.setattr(prefix_trie, "LIST_ITEMS", 100)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def plain(table: list, shared: bool = True) -> list:
    turns: dict = {}
    for c, t, role, text in table:
        if c is not None:
            turns.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(v)] for c, v in turns.items()}
    whole = {}
    for c, own in turns.items():
        base, h = c - int(math.fmod(c, 5)), zlib.crc32(str(c).encode()) % 9
        whole[c] = turns.get(base, [])[:h] + own[h:] if shared and base != c else own
    nodes: dict = {}
    for c, q in whole.items():
        for d in range(len(q) + 1):
            nodes.setdefault(tuple(q[:d]), []).append(c)
    children: dict = {}
    for p in nodes:
        children.setdefault(p[:-1], []).append(p) if p else None
    below: dict = {}
    for p in sorted(nodes, key=len, reverse=True):
        under = [below[q] for q in children.get(p, [])]
        own = (len(nodes[p]) - 1) * len(p[-1][1].encode()) if p else 0
        below[p] = (sum(x[0] for x in under) or 1, sum(x[1] for x in under) + own)
    out = []
    for p, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(whole[c]) == len(p))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(children.get(p, [])), *below[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(table, **how) -> list:
    return sorted(map(tuple, prefix_trie.prefix_trie(table, **how).drop("enter", "exit").collect()), key=str)


ODD = [(None, 1, "user", "x"), (0, None, None, None), (0, None, "", "tie b"), (0, None, "", "tie a"), (0, 2, "user", "x"), (0, 2, "user", "x"), (-3, 1, "user", "x"), (-3, 2, "user", "y"), (1, 1, "a", "b"), (7, 5, "user", "é" * 3000), (7, 6, "user" * 40, "long role"), (7, 6, "user" * 40, "long rolf"), (9, -1, "", ""), (9, 0, "", ""), (12, 0, "ab", "c"), (13, 0, "a", "bc")]


def test_against_sql(spark):
    got, want = queries.QUERIES["op11_prefix_trie"](spark, SMALL).toPandas(), connect(SMALL).execute(ORACLES["op11_prefix_trie"]).df()
    assert rows(got) == rows(want)


@pytest.mark.parametrize("shared", [True, False])
def test_odd_rows(spark, many_ranges, shared):
    table = spark.createDataFrame([(*r, None, 1, "k") for r in ODD], SCHEMA + ", place long, key_1 int, bytes string")
    assert found(table, shared=shared) == plain(ODD, shared)
    assert found(table.limit(0)) == [] and prefix_trie.prefix_trie(table.limit(0)).columns == prefix_trie.prefix_trie(table).columns


def test_hot_conversation_turn_and_copies(spark, many_ranges):
    """One conversation holds a third of the rows, one first turn begins most of the others, and whole copies repeat."""
    table = [(40, t, "user", f"turn {t % 7}") for t in range(600)] + [(41, t, "user", f"turn {t % 7}") for t in range(590)] + [(45, t, "user", f"turn {t % 7}") for t in range(300)]
    for c in range(100, 260):
        first = "hello" if c % 8 else f"own {c}"
        table += [(c, 0, "user", first)] + [(c, t, "user", str(RNG.integers(3))) for t in range(1, int(RNG.integers(1, 12)))]
    table += [(c, t, "user", "copy") for c in range(1000, 1080) for t in range(3)]
    frame = spark.createDataFrame(table, SCHEMA).repartition(5)
    assert found(frame) == plain(table)


def test_the_tour_visits_each_arc_once(spark, many_ranges):
    table = [(c, t, "user", str(RNG.integers(2))) for c in range(60) for t in range(int(RNG.integers(1, 7)))]
    nodes = prefix_trie.prefix_trie(spark.createDataFrame(table, SCHEMA)).collect()
    assert sorted(x for r in nodes for x in (r.enter, r.exit)) == list(range(2 * len(nodes)))
    by_id = {(r.conv_id, r.depth): r for r in nodes}
    for r in nodes:
        if r.depth:
            up = by_id[r.parent_conv_id, r.depth - 1]
            assert up.enter < r.enter < r.exit < up.exit
        assert sum(r.enter <= x.enter and x.exit <= r.exit and not x.n_children for x in nodes) == r.n_leaves


@pytest.mark.parametrize("shift", [0, 1000, 3000])
def test_list_is_ranked(spark, many_ranges, shift):
    """Whatever the coin of the last item shows: it stays in the list."""
    order = (RNG.permutation(300) + shift).tolist()
    arcs = dict(zip(order, RNG.integers(0, 9, 300).tolist()))
    items = [(a, b, arcs[a]) for a, b in zip(order, [*order[1:], None])]
    got = dict(map(tuple, prefix_trie.list_positions(spark.createDataFrame(items, "id long, next long, arcs long")).collect()))
    total, want = 0, {}
    for a in order:
        want[a], total = total, total + arcs[a]
    assert got == want


def test_sums_modulo_a_prime():
    a, b = (RNG.integers(0, PRIME, 500, dtype=np.uint64) for _ in range(2))
    a[:2] = b[1:3] = PRIME - 1
    assert times(a, b).tolist() == [int(x) * int(y) % PRIME for x, y in zip(a, b)]
    segment = np.sort(RNG.integers(0, 9, 500))
    got = running(a, segment_starts(segment)).tolist()
    assert got == [sum(map(int, a[: i + 1][segment[: i + 1] == segment[i]])) % PRIME for i in range(500)]
    base = prefix_trie.BASES[0]
    assert prefix_trie.powers(base, np.array([0, 1, 4095, 4096, 70_000])).tolist() == [pow(base, n, PRIME) for n in (0, 1, 4095, 4096, 70_000)]
