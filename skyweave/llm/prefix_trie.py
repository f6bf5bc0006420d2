"""Prefix trie of conversations by the Euler-tour technique.

A node stands for the first d turns that some conversations share. Turns are placed in their conversations by sorted
ranges (`ranges.scanned`), which also sum up two polynomial hashes of the turns so far; what a conversation takes over
from another one's beginning is put before its own turns by shifting these sums, so a beginning is never copied. Equal
prefixes meet by (depth, hashes).

A node is owned by its smallest member; the nodes that a conversation owns are a run down to its last turn. The tour
enters and exits every node, children in order of their owners. Arcs that follow one another inside a run need no
pointers: the list that is ranked has an item for the stretch of enters (and first exits) of a run, and one for the exits
from each place where other runs branch off. It is ranked by random-mate contraction: each round splices out about a
quarter, until at most LIST_ITEMS are left, which one task walks; then the rounds are undone. Every arc has its position
from its item. Prefix sums of leaves and savings over the arcs in order of position, range by range, give those of a
subtree as the difference between a node's exit and its enter.

Cases: turns are ordered by turn (null first), then role and text; a null role or text is empty; rows without conv_id
belong to no conversation; repeated rows are turns of their own; an empty table has no root; other columns are ignored.
A conversation may hold most of the turns, a node most of the conversations: no step gathers either, but the digest of
the conversations that end at one node is streamed by one task, as SHA-256 goes over them in order.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import numbered
from .ranges import PRIME, before, reduced, running, scanned, segment_starts, times
from .words import stored

#: Conversations c share the beginning of c - c % FAMILY, in so many turns: crc32(c) % TAKEN.
FAMILY, TAKEN = 5, 9
#: Bases of the two hashes: fixed, below PRIME.
BASES = (0x0D6E8FEB86659FD9, 0x1B4C1D7E27D4EB2F)
#: Items that one task walks.
LIST_ITEMS = 32_768
_tables: dict[int, np.ndarray] = {}


def _table(base: int, n: int) -> np.ndarray:
    """base**i modulo PRIME for i < n at least."""
    t = _tables.get(base, np.ones(1, np.uint64))
    while len(t) < n:
        t = np.r_[t, times(t, np.full(len(t), pow(base, len(t), PRIME), np.uint64))]
    _tables[base] = t
    return t


def powers(base: int, exponents: np.ndarray) -> np.ndarray:
    low, high = exponents & 4095, exponents >> 12
    return times(_table(base, 4096)[low], _table(pow(base, 4096, PRIME), int(high.max(initial=0)) + 1)[high])


def _own_turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Place in the conversation and hashes up to each turn, before and after it, as if the range were the first."""
    names = ["conv_id", "place", "bytes", "before_1", "before_2", "hash_1", "hash_2", "_sum"]
    last, count, sums = None, 0, [0, 0]
    for batch in batches:
        if not batch.num_rows:
            continue
        conv = batch.column("conv_id").to_numpy()
        start = segment_starts(conv)
        place = np.arange(len(conv)) - start
        goes_on = conv == last
        place[goes_on] += count
        out: list[list[np.ndarray]] = [[], []]
        for lane, base in enumerate(BASES):
            term = times(reduced(batch.column(f"turn_{lane + 1}").to_numpy().view(np.uint64)), powers(base, place))
            total = running(term, start)
            total[goes_on] = reduced(total[goes_on] + np.uint64(sums[lane]))
            out[0].append(reduced(total + np.uint64(PRIME) - term))
            out[1].append(total)
            sums[lane] = int(total[-1])
        last, count = conv[-1], int(place[-1]) + 1
        columns = [conv, place, batch.column("bytes").to_numpy(), *(x.astype(np.int64) for x in out[0] + out[1]), np.zeros(len(conv), bool)]
        yield pa.record_batch([pa.array(c) for c in columns], names)
    if last is not None:
        yield pa.record_batch([pa.array([x], pa.int64()) for x in (last, count, 0, 0, 0, *sums)] + [pa.array([True])], names)


def _product(a: Column, b: Column) -> Column:
    """Modulo PRIME; a product of two such numbers has 37 digits at most."""
    return ((a.cast("decimal(19,0)") * b.cast("decimal(19,0)")) % F.lit(PRIME).cast("decimal(19,0)")).cast("long")


def _moved(x: Column, by: Column, power: Column) -> Column:
    return (by + _product(x, power)) % PRIME


def placed_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, bytes, before_1, before_2, hash_1, hash_2) of each turn, place from 0."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    content = {f"turn_{k}": F.xxhash64(F.lit(k), "role", "text") for k in (1, 2)}
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    rows = rows.withColumns(content | {"bytes": F.octet_length("text").cast("long")})
    # bounds of ranges go to the driver: they hold the beginnings of long strings, in an order that agrees with the whole
    begin = [F.substring("role", 1, 64), F.when(F.length("role") <= 64, F.substring("text", 1, 32)).otherwise("")]
    longs = "conv_id long, place long, bytes long, before_1 long, before_2 long, hash_1 long, hash_2 long"
    local, ends = scanned(rows, ["conv_id", "turn", *begin], ["conv_id", "turn", "role", "text"], _own_turns, longs, "turns")
    carried, last, count, sums = [], None, 0, [0, 0]
    for r in ends:
        steps = [pow(b, count, PRIME) for b in BASES]
        carried.append((r["_range"], last, count, *sums, *steps))
        same = r.conv_id == last
        sums = [((s if same else 0) + (p if same else 1) * h) % PRIME for s, p, h in zip(sums, steps, (r.hash_1, r.hash_2))]
        last, count = r.conv_id, (count if same else 0) + r.place
    joined = before(local, carried, "_conv long, _count long, _sum_1 long, _sum_2 long, _power_1 long, _power_2 long")
    goes_on = F.col("conv_id") == F.col("_conv")
    whole = {f"{n}_{k}": F.when(goes_on, _moved(F.col(f"{n}_{k}"), F.col(f"_sum_{k}"), F.col(f"_power_{k}"))).otherwise(F.col(f"{n}_{k}")) for n in ("before", "hash") for k in (1, 2)}
    place = F.when(goes_on, F.col("place") + F.col("_count")).otherwise(F.col("place"))
    return joined.withColumns(whole | {"place": place}).select("conv_id", "place", "bytes", "before_1", "before_2", "hash_1", "hash_2")


def rebuilt_conversations(turns: DataFrame, shared: bool) -> DataFrame:
    """A row a conversation: how many turns it takes over and leaves out, the hashes that its own are moved by, its end,
    and (`shares`) how many others take over its first turns. Of a conversation at most TAKEN - 1 turns are gathered."""
    head = F.when(F.col("place") < TAKEN - 1, F.struct("place", "hash_1", "hash_2"))
    convs = stored(turns.groupBy("conv_id").agg((F.max("place") + 1).alias("n"), F.array_sort(F.collect_list(head)).alias("heads"), F.max(F.struct("place", "hash_1", "hash_2")).alias("end")), "conversations")
    base = F.col("conv_id") - F.col("conv_id") % FAMILY if shared else F.col("conv_id")
    bases = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"), F.col("heads").alias("base_heads"))
    joined = convs.withColumn("base", base).join(bases, "base", "left")
    own = F.col("conv_id") == F.col("base")
    left_out = F.when(own, 0).otherwise(F.crc32(F.col("conv_id").cast("string").cast("binary")) % TAKEN)
    joined = joined.withColumn("left_out", left_out).withColumn("taken", F.when(own, 0).otherwise(F.least("left_out", F.coalesce("base_n", F.lit(0)))))
    nth = lambda heads, n, k: F.coalesce(F.get(heads, (F.col(n) - 1).cast("int"))[f"hash_{k}"], F.lit(0))
    joined = joined.withColumns({f"from_{k}": F.when(F.col("taken") > 0, nth(F.col("base_heads"), "taken", k)).otherwise(0) for k in (1, 2)})
    joined = joined.withColumns({f"without_{k}": F.when(F.col("left_out") > 0, nth(F.col("heads"), "left_out", k)).otherwise(0) for k in (1, 2)})
    kept = F.greatest(F.col("n") - F.col("left_out"), F.lit(0))
    ends = {f"end_{k}": F.when(kept > 0, _rebased(F.col(f"end.hash_{k}"), k)).otherwise(F.col(f"from_{k}")) for k in (1, 2)}
    joined = joined.withColumns(ends | {"length": F.col("taken") + kept})
    takers = joined.filter("taken > 0").select(F.col("base").alias("conv_id"), F.explode(F.sequence(F.lit(1), F.col("taken"))).alias("depth"), F.col("conv_id").alias("taker"))
    shares = takers.groupBy("conv_id", "depth").agg(F.count("*").alias("takers"), F.min("taker").alias("least")).groupBy("conv_id").agg(F.collect_list(F.struct("depth", "takers", "least")).alias("shares"))
    numbers = ["conv_id", "left_out", "taken", "from_1", "from_2", "without_1", "without_2", "end_1", "end_2", "length"]
    return stored(joined.select(*numbers).join(shares, "conv_id", "left"), "rebuilt")


def _rebased(x: Column, lane: int) -> Column:
    """Hashes of own turns, less those left out, moved behind those taken over."""
    fewer = F.col("left_out") - F.col("taken")
    inverse = F.array(*(F.lit(pow(BASES[lane - 1], -i, PRIME)) for i in range(TAKEN)))
    rest = (x + PRIME - F.col(f"without_{lane}")) % PRIME
    moved = F.when(fewer == 0, rest).otherwise(_product(rest, F.get(inverse, fewer.cast("int"))))
    return (moved + F.col(f"from_{lane}")) % PRIME


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the comma-joined conv_ids of each node, which come in order; the ids are never held together."""
    key, digest = None, None
    for batch in batches:
        out, columns = [], [batch.column(c).to_numpy() for c in ("depth", "key_1", "key_2")]
        conv = batch.column("conv_id").to_numpy()
        new = np.zeros(len(conv), bool)
        new[:1] = True
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        cuts = [*np.flatnonzero(new).tolist(), len(conv)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            now = tuple(int(c[a]) for c in columns)
            if now != key:
                if key is not None:
                    out.append((*key, digest.digest()))
                key, digest, lead = now, hashlib.sha256(), ""
            else:
                lead = ","
            digest.update((lead + ",".join(map(str, conv[a:b].tolist()))).encode())
        yield _as_ends(out)
    if key is not None:
        yield _as_ends([(*key, digest.digest())])


def _as_ends(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["depth", "key_1", "key_2", "ends"])


def trie_nodes(conversations: DataFrame, shared: bool) -> DataFrame:
    """(depth, key_1, key_2, up_1, up_2, conv_id, n_convs, bytes, ends): each distinct prefix once; up: its parent's key."""
    turns = placed_turns(conversations)
    rebuilt = rebuilt_conversations(turns, shared)
    rows = turns.join(rebuilt, "conv_id").filter("place >= left_out").withColumn("depth", F.col("place") + 1 - F.col("left_out") + F.col("taken"))
    share = F.get(F.filter("shares", lambda s: s["depth"] == F.col("depth")), F.lit(0))
    rows = rows.withColumn("share", share).select(
        "depth",
        *(_rebased(F.col(f"hash_{k}"), k).alias(f"key_{k}") for k in (1, 2)),
        *(_rebased(F.col(f"before_{k}"), k).alias(f"up_{k}") for k in (1, 2)),
        F.least("conv_id", F.col("share.least")).alias("conv_id"),
        (1 + F.coalesce("share.takers", F.lit(0))).alias("members"),
        "bytes",
    )
    key = ["depth", "key_1", "key_2"]
    nodes = rows.groupBy(*key).agg(F.min("up_1").alias("up_1"), F.min("up_2").alias("up_2"), F.min("conv_id").alias("conv_id"), F.sum("members").alias("n_convs"), F.max("bytes").alias("bytes"))
    zero = F.lit(0).cast("long")
    root = rebuilt.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    root = root.select(*(zero.alias(c) for c in (*key, "up_1", "up_2")), "conv_id", "n_convs", zero.alias("bytes"))
    ending = rebuilt.select(F.col("length").alias("depth"), F.col("end_1").alias("key_1"), F.col("end_2").alias("key_2"), "conv_id")
    ends = ending.repartition(*key).sortWithinPartitions(*key, "conv_id").mapInArrow(_digests, "depth long, key_1 long, key_2 long, ends binary")
    return stored(nodes.unionByName(root).join(ends, key, "left"), "nodes")


def _walk(items: pd.DataFrame) -> pd.DataFrame:
    """Arcs before each item, from the one that follows none."""
    items = items.sort_values("id")
    ids, arcs, following = items["id"].to_numpy(), items["arcs"].tolist(), items["next"]
    to = np.where(following.isna(), -1, np.searchsorted(ids, following.fillna(0).to_numpy().astype(np.int64))).tolist()
    at = next(iter(set(range(len(ids))) - set(to)))
    position, total, left = np.zeros(len(ids), np.int64), 0, len(ids)
    while at >= 0:
        if not left:
            raise ValueError("the list comes back to an item")
        position[at] = total
        total, left = total + arcs[at], left - 1
        at = to[at]
    return pd.DataFrame({"id": ids, "position": position})


def list_positions(items: DataFrame) -> DataFrame:
    """(id, position) of a list of (id, next, arcs): how many arcs stand before each item.

    A round splices an item out if its coin shows 1 and that of the item before it 0; coins are hashes of the id."""
    left, undo, rounds = stored(items.select("id", "next", "arcs"), "list"), [], 0
    while left.count() > LIST_ITEMS:
        coin = lambda c: F.xxhash64(F.col(c), F.lit(rounds)) % 2 != 0  # noqa: B023, E731
        tails, heads = left.filter(coin("id")), left.filter(~coin("id"))
        takes = F.col("next").isNotNull() & coin("next")  # a hash of NULL is no NULL
        taking = heads.filter(takes).select(F.col("id").alias("taker"), F.col("next").alias("id"), F.col("arcs").alias("ahead"))
        met = stored(tails.join(taking, "id", "left").unionByName(heads.filter(~takes), allowMissingColumns=True), "contracted")
        gone = F.col("taker").isNotNull()
        undo.append(met.filter(gone).select("id", "taker", "ahead"))
        left = stored(met.select(F.when(gone, F.col("taker")).otherwise(F.col("id")).alias("id"), "next", F.when(gone, F.col("arcs") + F.col("ahead")).otherwise(F.col("arcs")).alias("arcs")), "list")
        rounds += 1
    ranked = left.withColumn("list", F.lit(0)).groupBy("list").applyInPandas(_walk, "id long, position long")
    for gone in reversed(undo):
        ranked = stored(ranked, "ranked")
        back = gone.join(ranked.select(F.col("id").alias("taker"), "position"), "taker").select("id", (F.col("position") + F.col("ahead")).alias("position"))
        ranked = ranked.unionByName(back)
    return stored(ranked, "ranked")


def tour_items(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The list of the tour: an item a run (run, id, next, arcs, top, bottom, parent), and one a place where runs branch
    off (run, id, next, arcs, at, branches)."""
    runs = stored(nodes.groupBy("conv_id").agg(F.min(F.struct("depth", "up_1", "up_2")).alias("top"), F.max("depth").alias("bottom")), "runs")
    tops = runs.filter("top.depth > 0").select(F.col("conv_id").alias("run"), (F.col("top.depth") - 1).alias("at"), F.col("top.up_1").alias("key_1"), F.col("top.up_2").alias("key_2"))
    owners = nodes.select(F.col("depth").alias("at"), "key_1", "key_2", F.col("conv_id").alias("parent"))
    branches = tops.join(owners, ["at", "key_1", "key_2"]).select("parent", "at", "run", (-F.col("at")).alias("up_from"))
    branches = stored(numbered(branches, "parent", "up_from", "run").select("number", "parent", "at", "run"), "branches")
    following = branches.select((F.col("number") - 1).alias("number"), F.col("parent").alias("next_parent"), F.col("at").alias("next_at"))
    pairs = branches.join(following, "number", "left")
    stays = F.coalesce(F.col("next_parent") == F.col("parent"), F.lit(False))
    sibling = stays & F.coalesce(F.col("next_at") == F.col("at"), F.lit(False))
    pairs = stored(pairs.withColumns({"stays": stays, "after": 2 * F.col("number") + F.when(sibling, 2).otherwise(1)}), "pairs")
    first = branches.groupBy(F.col("parent").alias("run")).agg(F.min("number").alias("first"), F.max("at").alias("first_at"))
    own = pairs.select("run", "number", "parent", "after")
    whole = runs.select(F.col("conv_id").alias("run"), F.col("top.depth").alias("top"), "bottom").join(own, "run", "left").join(first, "run", "left")
    height = F.col("bottom") - F.col("top") + 1
    enters = stored(
        whole.select(
            "run", "top", "bottom", "parent", "after",
            F.coalesce(2 * F.col("number"), F.lit(-2)).alias("id"),
            F.coalesce(2 * F.col("first"), F.col("after")).alias("next"),
            (height + F.coalesce(F.col("bottom") - F.col("first_at"), height)).alias("arcs"),
        ),
        "enters",
    )
    places = pairs.groupBy(F.col("parent").alias("run"), "at").agg(F.count("*").alias("branches"), F.max(F.struct("number", "stays", "next_at")).alias("last"))
    places = places.select("run", "at", "branches", F.col("last.number").alias("number"), F.col("last.stays").alias("stays"), F.col("last.next_at").alias("next_at"))
    inner = places.filter("stays").select("run", "at", "branches", (2 * F.col("number") + 1).alias("id"), (2 * F.col("number") + 2).alias("next"), (F.col("at") - F.col("next_at")).alias("arcs"))
    outer = places.filter("not stays").join(enters.select("run", "top", "after"), "run")
    outer = outer.select("run", "at", "branches", (2 * F.col("number") + 1).alias("id"), F.col("after").alias("next"), (F.col("at") - F.col("top") + 1).alias("arcs"))
    return enters.drop("after"), stored(inner.unionByName(outer), "places")


#: What the rows of a run say of the nodes below them, and the places of those that the first one alone says.
_SAID, _FIRST = ("enter_from", "top", "bottom", "parent", "exit_from", "at", "branches"), 4


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes with what the last row of their run (kind 0), and of a place in it (kind 1), before them has said."""
    carry: list = [None] * len(_SAID)
    names = ["conv_id", "depth", "n_convs", "bytes", "ends", *_SAID, "_sum"]
    some = False
    for batch in batches:
        if not batch.num_rows:
            continue
        some, kind = True, batch.column("kind").to_numpy()
        out, index = [], np.arange(1, len(kind) + 1)
        by_run, by_any = (np.maximum.accumulate(np.where(kind <= k, index, 0)) for k in (0, 1))
        for i, name in enumerate(_SAID):
            values = pa.concat_arrays([pa.array([carry[i]], pa.int64()), batch.column(name)])
            filled = values.take(pa.array(by_run if i < _FIRST else by_any))
            carry[i] = filled[-1].as_py()
            out.append(filled)
        keep = pa.array(kind == 2)
        kept = [batch.column(c).filter(keep) for c in names[:5]] + [c.filter(keep) for c in out]
        yield pa.record_batch([*kept, pa.array(np.zeros(len(kept[0]), bool))], names)
    if some:
        yield pa.record_batch([*(pa.array([0], pa.int64()) for _ in range(4)), pa.array([None], pa.binary()), *(pa.array([c], pa.int64()) for c in carry), pa.array([True])], names)


def tour(nodes: DataFrame) -> DataFrame:
    """Nodes with the positions of their two arcs: (conv_id, depth, parent_conv_id, n_convs, n_children, leaf, saved, ends,
    enter, exit)."""
    enters, places = tour_items(nodes)
    positions = list_positions(enters.select("id", "next", "arcs").unionByName(places.select("id", "next", "arcs")))
    height = F.col("bottom") - F.col("top") + 1
    first = enters.join(positions, "id").select(F.col("run").alias("conv_id"), F.col("bottom").alias("depth"), F.lit(0).alias("kind"), (F.col("position") - F.col("top")).alias("enter_from"), "top", "bottom", "parent", (F.col("position") + height + F.col("bottom")).alias("exit_from"), F.lit(-1).cast("long").alias("at"), F.lit(0).cast("long").alias("branches"))
    later = places.join(positions, "id").select(F.col("run").alias("conv_id"), F.col("at").alias("depth"), F.lit(1).alias("kind"), (F.col("position") + F.col("at")).alias("exit_from"), "at", "branches")
    own = nodes.select("conv_id", "depth", F.lit(2).alias("kind"), "n_convs", "bytes", "ends")
    rows = own.unionByName(first, allowMissingColumns=True).unionByName(later, allowMissingColumns=True)
    schema = "conv_id long, depth long, n_convs long, bytes long, ends binary, " + ", ".join(f"{s} long" for s in _SAID)
    order = ["conv_id", F.desc("depth"), "kind"]
    local, ends = scanned(rows, order, order, _told, schema, "told")
    carried, known = [], [None] * len(_SAID)
    for r in ends:
        carried.append((r["_range"], *known))
        known = [b if (b := r[s]) is not None else a for a, s in zip(known, _SAID)]
        if r["top"] == 0:
            known[3] = r["parent"]  # the root's run has no parent
    told = before(local, carried, ", ".join(f"_{s} long" for s in _SAID))
    starts = F.col("top").isNull()  # the run's first row was in a range before
    own_run = {s: F.when(starts, F.col(f"_{s}")).otherwise(F.col(s)) for s in _SAID[:_FIRST]}
    told = told.withColumns(own_run | {s: F.coalesce(s, f"_{s}") for s in _SAID[_FIRST:]})
    children = (F.col("depth") < F.col("bottom")).cast("long") + F.when(F.col("at") == F.col("depth"), F.col("branches")).otherwise(0)
    return told.select(
        "conv_id", "depth",
        F.when(F.col("depth") > F.col("top"), F.col("conv_id")).otherwise(F.col("parent")).alias("parent_conv_id"),
        "n_convs", children.alias("n_children"), (children == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"), "ends",
        (F.col("enter_from") + F.col("depth")).alias("enter"), (F.col("exit_from") - F.col("depth")).alias("exit"),
    )


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Prefix sums over arcs; a node's are exit less enter, its own part in."""
    names = ["node", "exits", "leaves", "saved", "_sum"]
    totals, some = [0, 0], False
    for batch in batches:
        if not batch.num_rows:
            continue
        some, out = True, []
        exits = batch.column("exits").to_numpy(zero_copy_only=False)
        for i, name in enumerate(names[2:4]):
            own = batch.column(name).to_numpy()
            sums = np.cumsum(own) + totals[i]
            totals[i] = int(sums[-1])
            out.append(pa.array(np.where(exits, sums, own - sums)))
        yield pa.record_batch([batch.column("node"), batch.column("exits"), *out, pa.array(np.zeros(len(exits), bool))], names)
    if some:
        yield pa.record_batch([pa.array([0], pa.int64()), pa.array([True]), *(pa.array([t], pa.int64()) for t in totals), pa.array([True])], names)


def subtree_sums(toured: DataFrame) -> DataFrame:
    """(enter, n_leaves, saved_tokens) of each node's subtree."""
    zero = F.lit(0).cast("long")
    enters = toured.select(F.col("enter").alias("position"), F.col("enter").alias("node"), F.lit(False).alias("exits"), F.col("leaf").alias("leaves"), "saved")
    exits = toured.select(F.col("exit").alias("position"), F.col("enter").alias("node"), F.lit(True).alias("exits"), zero.alias("leaves"), zero.alias("saved"))
    local, ends = scanned(enters.unionByName(exits), ["position"], ["position"], _summed, "node long, exits boolean, leaves long, saved long", "arcs")
    carried, leaves, saved = [], 0, 0
    for r in ends:
        carried.append((r["_range"], leaves, saved))
        leaves, saved = leaves + r.leaves, saved + r.saved
    sums = before(local, carried, "_leaves long, _saved long")
    signed = lambda c: F.sum(F.col(c) + F.when(F.col("exits"), F.col(f"_{c}")).otherwise(-F.col(f"_{c}")))
    return sums.groupBy(F.col("node").alias("enter")).agg(signed("leaves").alias("n_leaves"), signed("saved").alias("saved_tokens"))


def prefix_trie(conversations: DataFrame, shared: bool = True) -> DataFrame:
    """A row a node: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, enter, exit).

    With `shared`, conversations first take over beginnings of others (FAMILY, TAKEN); else they are taken as they are."""
    nodes = trie_nodes(conversations, shared)
    if nodes.isEmpty():
        longs = ", ".join(f"{c} long" for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"))
        return conversations.sparkSession.createDataFrame([], f"{longs}, ends_sha256 string, enter long, exit long")
    toured = stored(tour(nodes), "tour")
    none = F.unhex(F.lit(hashlib.sha256(b"").hexdigest()))
    digest = F.lower(F.hex(F.coalesce("ends", none)))
    return toured.join(subtree_sums(toured), "enter").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", digest.alias("ends_sha256"), "enter", "exit")
