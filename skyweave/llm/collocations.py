"""Phrase collocations by vertical partitioning of truncated suffix trees.

A text is cut into pieces and these into words; every place of a piece starts a suffix of up to LONGEST words. Prefixes
of suffixes are counted a level at a time, as far as they are frequent: words first, then pairs of frequent words. The
suffixes behind frequent pairs, cut where the next pair is not frequent, are what subtrees are built from. They are
aggregated, with counts. Prefixes that have more of them than a task is to hold get longer, those that have fewer share a
group up to that budget; of each group the subtree is built by itself: its sorted suffixes are the leaves, and a node's
count is the total of the leaves below it. Counts above a lengthened prefix are totals of its rows.

Which words and pairs may be frequent is looked up in bit tables (broadcast; TABLE_BITS bounds them): a fuller table lets
more through, and never less. Words are known by 64-bit hashes of language and word; should two words of a corpus share
one, all is done again under another seed. Scores are quotients of whole numbers of up to 38 digits.

Cases: a null text has no words, a null language is `und`; repeated rows count each time; ties go by fewer words left of
the cut, then by phrase in byte order; an empty table gives an empty result; other columns are ignored. A word, pair or
passage may be everywhere: it is counted in each task before it is shuffled.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import before, scanned
from .words import SPACES, Words, mix, slices, stored

LONGEST = 5
#: Fixed numbers of the report: least occurrences, share (of 100) that a longer phrase holds to replace a shorter one, and
#: phrases of a language.
LEAST, REPLACES, TOP = 100, 100, 2000
#: Aggregated suffixes that the subtree of a group is built from, about: a group holds less than twice as many.
GROUP_ROWS = 200_000
#: Bytes of text whose words are combined at once.
COMBINED_BYTES = 4_000_000
#: Most bits of a table, as a power of 2 (32 MB); smaller ones hold SPARSE bits for each frequent item.
TABLE_BITS, SPARSE = 28, 32
#: Parts of a language that are ranked apart before the whole.
PARTS = 64
#: Fixed separators of pieces.
BREAKS = np.zeros(256, bool)
BREAKS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
KEY = [f"w{i}" for i in range(1, LONGEST + 1)]
LONGS = ", ".join(f"{k} long" for k in KEY)


class Texts:
    """Words of some texts: hashes, and how many words from each on are of its piece."""

    def __init__(self, batch: pa.RecordBatch, seed: int):
        self.words = words = Words(batch.column("text"), lower=True, separators=BREAKS | SPACES)
        languages = mix(batch.column("lang_hash").to_numpy().view(np.uint64) + np.uint64(seed))
        self.hashes = mix(words.hashes() ^ languages[words.row])
        self.hashes[self.hashes == 0] = 1  # 0 stands for no word
        piece = np.cumsum(BREAKS[words.data])[words.start] + words.row
        ends = np.flatnonzero(np.r_[piece[1:] != piece[:-1], True]) + 1 if len(piece) else piece
        self.room = np.repeat(ends, np.diff(np.r_[0, ends])) - np.arange(len(piece))


def texts(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[tuple[Texts, pa.RecordBatch]]:
    for batch in batches:
        for a, b in slices(batch.column("text"), COMBINED_BYTES):
            part = batch.slice(a, b - a)
            yield Texts(part, seed), part


def combined(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct row of some columns stands, and how many rows are like it."""
    key = columns[0] if len(columns) == 1 else mixed(columns)
    order = np.argsort(key, kind="stable")
    new = np.zeros(len(order), bool)
    new[:1] = True
    new[1:] = key[order[1:]] != key[order[:-1]]
    different = np.zeros(len(order), bool)
    for c in columns:
        different[1:] |= c[order[1:]] != c[order[:-1]]
    if (different & ~new).any():  # two rows of one hash: by the columns themselves
        order = np.lexsort(columns[::-1])
        new = np.zeros(len(order), bool)
        new[:1] = True
        for c in columns:
            new[1:] |= c[order[1:]] != c[order[:-1]]
    first = np.flatnonzero(new)
    return order[first], np.diff(np.r_[first, len(order)])


def mixed(columns: list[np.ndarray]) -> np.ndarray:
    key = columns[0]
    for c in columns[1:]:
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) ^ c)
    return key


def _as_rows(columns: list[np.ndarray]) -> pa.RecordBatch:
    pick, n = combined(columns)
    arrays = [pa.array(c[pick].view(np.int64)) for c in columns]
    return pa.record_batch([*arrays, pa.array(n.astype(np.int64))], [*KEY[: len(columns)], "n"])


class Table:
    """A set of hashes as two bits each."""

    def __init__(self, bits: np.ndarray, size: int):
        self.bits, self.size = bits, size

    def may_hold(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), bool)
        for at in (hashes >> np.uint64(64 - self.size), hashes & np.uint64((1 << self.size) - 1)):
            at = at.astype(np.int64)
            found &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return found


def table_of(frequent: DataFrame, key: Column) -> Table:
    """The table of all keys; put together by Spark in blocks of 4 KB, of which there are no more than TABLE_BITS allow."""
    n = frequent.count()
    size = min(TABLE_BITS, max(16, int(n * SPARSE).bit_length()))
    rows = frequent.select(key.alias("key"))
    high, low = F.shiftrightunsigned("key", 64 - size), F.col("key").bitwiseAND(F.lit((1 << size) - 1))
    bits = rows.select(F.explode(F.array(high, low)).alias("bit"))
    blocks = bits.groupBy(F.bitmap_bucket_number(F.col("bit") + 1).alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("bit") + 1)).alias("bits")).collect()
    out = np.zeros(1 << size >> 3, np.uint8)
    for r in blocks:  # blocks are numbered from 1
        part = np.frombuffer(r.bits, np.uint8)
        at = (r.block - 1) * 4096
        out[at : at + len(part)] = part[: len(out) - at]
    return Table(out, size)


def word_counts(rows: DataFrame) -> tuple[DataFrame, int]:
    """(w1, lang, word, n) of all words, and the seed under which no two share a hash."""
    seed = 0
    while True:

        def count(batches: Iterator[pa.RecordBatch], seed: int = seed) -> Iterator[pa.RecordBatch]:
            for some, part in texts(batches, seed):
                pick, n = combined([some.hashes])
                words = pa.array([w.decode("utf-8", "replace") for w in some.words.texts(pick)], pa.string())
                lang = part.column("lang").take(pa.array(some.words.row[pick]))
                yield pa.record_batch([pa.array(some.hashes[pick].view(np.int64)), lang, words, pa.array(n.astype(np.int64))], ["w1", "lang", "word", "n"])

        counted = rows.mapInArrow(count, "w1 long, lang string, word string, n long")
        counts = stored(counted.groupBy("w1", "lang", "word").agg(F.sum("n").alias("n")), "words")
        if counts.groupBy("w1").agg(F.count("*").alias("k")).filter("k > 1").isEmpty():
            return counts, seed
        seed += 1


def frequent_phrases(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Words (w1, lang, word, n), totals (lang, total), and phrases (w1 to w5, f) of two words or more, with 0 for none."""
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    rows = docs.filter("text is not null").select(lang.alias("lang"), F.xxhash64(lang).alias("lang_hash"), "text")
    words, seed = word_counts(rows)
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    frequent = stored(words.filter(F.col("n") >= least), "frequent-words")
    spark = docs.sparkSession
    single = spark.sparkContext.broadcast(table_of(frequent, F.col("w1")))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, _ in texts(batches, seed):
            known = single.value.may_hold(some.hashes)
            at = np.flatnonzero(known[:-1] & known[1:] & (some.room[:-1] > 1))
            yield _as_rows([some.hashes[at], some.hashes[at + 1]])

    two = rows.mapInArrow(pairs, "w1 long, w2 long, n long").groupBy("w1", "w2").agg(F.sum("n").alias("f")).filter(F.col("f") >= least)
    two = stored(two, "frequent-pairs")
    keys = two.select("w1", "w2").mapInArrow(_pair_keys, "key long")
    double = spark.sparkContext.broadcast(table_of(keys, F.col("key")))

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, _ in texts(batches, seed):
            h = some.hashes
            if len(h) < 2:
                continue
            linked = double.value.may_hold(mixed([h[:-1], h[1:]])) & (some.room[:-1] > 1)
            length = np.ones(len(h), np.int64)  # of the suffix at each place, as far as its pairs are linked
            for _ in range(LONGEST - 1):
                length[:-1] = np.where(linked, np.minimum(length[1:] + 1, LONGEST), 1)
            at = np.flatnonzero(length >= 3)
            padded = np.r_[h, np.zeros(LONGEST, np.uint64)]
            yield _as_rows([np.where(length[at] > k, padded[at + k], np.uint64(0)) for k in range(LONGEST)])

    leaves = stored(rows.mapInArrow(suffixes, f"{LONGS}, n long").groupBy(*KEY).agg(F.sum("n").alias("n")), "suffixes")
    none = [F.lit(0).cast("long").alias(k) for k in KEY]
    longer = subtree_counts(leaves, least)
    return frequent, totals, stored(two.select("w1", "w2", *none[2:], "f").unionByName(longer), "phrases")


def _pair_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.record_batch([pa.array(mixed([batch.column(c).to_numpy().view(np.uint64) for c in ("w1", "w2")]).view(np.int64))], ["key"])


def _loads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Prefixes with how many rows those before them have."""
    total, some, names = 0, False, [*KEY, "depth", "load", "_sum"]
    for batch in batches:
        if batch.num_rows:
            some, n = True, batch.column("rows").to_numpy()
            sums = np.cumsum(n) + total - n
            total = int(sums[-1] + n[-1])
            yield pa.record_batch([*(batch.column(k) for k in names[:-2]), pa.array(sums), pa.array(np.zeros(len(n), bool))], names)
    if some:
        yield pa.record_batch([*(pa.array([0], pa.int64()) for _ in KEY), pa.array([0], pa.int32()), pa.array([total], pa.int64()), pa.array([True])], names)


def prefix_groups(leaves: DataFrame) -> tuple[DataFrame, DataFrame | None, list[int]]:
    """Prefixes of at most GROUP_ROWS leaves dealt to groups (w1 to w5, depth, group), the counts of phrases above them
    (w1 to w5, f), and the depths that prefixes have. No prefix begins another."""
    zero = F.lit(0).cast("long")
    prefixes, above, rest, depths = None, None, leaves, []
    for depth in range(2, LONGEST + 1):
        own, ends = KEY[:depth], [zero.alias(k) for k in KEY[depth:]]
        counted = stored(rest.groupBy(*own).agg(F.count("*").alias("rows"), F.sum("n").alias("f")), "prefixes")
        fits, heavy = counted.filter(F.col("rows") <= GROUP_ROWS), counted.filter(F.col("rows") > GROUP_ROWS)
        fits = fits.select(*own, *ends, F.lit(depth).alias("depth"), "rows")
        prefixes = fits if prefixes is None else prefixes.unionByName(fits)
        depths.append(depth)
        if heavy.isEmpty():
            break
        if depth > 2:  # pairs are counted already
            top = heavy.select(*own, *ends, "f")
            above = top if above is None else above.unionByName(top)
        rest = rest.join(heavy.select(*own), own, "left_semi")
    schema = f"{LONGS}, depth int, load long"
    local, ends = scanned(prefixes, KEY, [*KEY, "depth"], _loads, schema, "loads")
    carried, total = [], 0
    for r in ends:
        carried.append((r["_range"], total))
        total += r.load
    group = F.floor((F.col("load") + F.col("_before")) / GROUP_ROWS)
    return stored(before(local, carried, "_before long").select(*KEY, "depth", group.alias("group")), "groups"), above, depths


def subtree_counts(leaves: DataFrame, least: int) -> DataFrame:
    """(w1 to w5, f) of the phrases of three words or more, from suffixes (w1 to w5, n) that are all distinct."""
    groups, above, depths = prefix_groups(leaves)
    dealt = None
    for depth in depths:
        own = KEY[:depth]
        found = leaves.join(groups.filter(F.col("depth") == depth).select(*own, "depth", "group"), own).select("group", "depth", *KEY, "n")
        dealt = found if dealt is None else dealt.unionByName(found)

    def build(table: pa.Table) -> pa.Table:
        """The nodes of a group's subtree, no higher than the prefixes that it is cut at."""
        columns = [table.column(k).to_numpy() for k in KEY]
        order = np.lexsort(columns[::-1])
        columns = [c[order] for c in columns]
        n, cut = table.column("n").to_numpy()[order], table.column("depth").to_numpy()[order]
        out, new = [], np.zeros(len(order), bool)
        new[:1] = True
        for depth in range(1, LONGEST + 1):
            word = columns[depth - 1]
            new[1:] |= word[1:] != word[:-1]
            if depth < 3:
                continue
            first = np.flatnonzero(new)
            total = np.add.reduceat(n, first)
            keep = (total >= least) & (word[first] != 0) & (cut[first] <= depth)
            at = first[keep]
            out.append([*(c[at] if k < depth else np.zeros(len(at), np.int64) for k, c in enumerate(columns)), total[keep]])
        return pa.table({name: np.concatenate([x[i] for x in out]) for i, name in enumerate([*KEY, "f"])})

    below = dealt.groupBy("group").applyInArrow(build, f"{LONGS}, f long")
    return below if above is None else below.unionByName(above.filter(F.col("f") >= least))


def _part(whole: Column, start: Column | int, length: Column | int) -> list[Column]:
    """The key of some words of a phrase: its words and zeros."""
    at = [F.lit(i) for i in range(LONGEST)]
    return [F.when(i < length, F.coalesce(F.get(whole, i + start), F.lit(0))).otherwise(0).alias(k) for i, k in zip(at, KEY)]


def without_replaced(phrases: DataFrame, replaces: int = REPLACES) -> DataFrame:
    """Phrases that no longer one stands for. One word more is enough to look at: of the phrases between a phrase and a
    longer one none is rarer than the longer one, and each is a candidate."""
    words = F.array(*KEY)
    longer = phrases.filter("w3 <> 0").withColumn("length", _length())
    shorter = F.explode(F.array(*(F.struct(*_part(words, at, F.col("length") - 1)) for at in (0, 1)))).alias("part")
    most = longer.select(shorter, F.col("f").alias("longer_f")).groupBy(*(F.col(f"part.{k}").alias(k) for k in KEY)).agg(F.max("longer_f").alias("longer_f"))
    joined = phrases.join(most, KEY, "left")
    return joined.filter(F.col("longer_f").isNull() | (100 * F.col("longer_f") < replaces * F.col("f"))).drop("longer_f")


def _length() -> Column:
    return sum((F.when(F.col(k) != 0, 1).otherwise(0) for k in KEY[1:]), F.lit(1))


def scored(kept: DataFrame, phrases: DataFrame, frequent: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the kept phrases: of all cuts in two that with the lowest score."""
    words = F.array(*KEY)
    counts = phrases.unionByName(frequent.select("w1", *(F.lit(0).cast("long").alias(k) for k in KEY[1:]), F.col("n").alias("f")))
    counts = counts.select(*(F.col(k).alias(f"part_{k}") for k in KEY), F.col("f").alias("part_f"))
    cuts = kept.withColumn("length", _length()).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("length") - 1)))
    sides = F.explode(F.array(F.struct(F.lit(True).alias("left"), *_part(words, 0, F.col("k"))), F.struct(F.lit(False).alias("left"), *_part(words, F.col("k"), F.col("length") - F.col("k"))))).alias("part")
    parts = cuts.select(*KEY, "f", "k", sides).select(*KEY, "f", "k", "part.left", *(F.col(f"part.{k}").alias(f"part_{k}") for k in KEY))
    found = parts.join(counts, [f"part_{k}" for k in KEY]).groupBy(*KEY, "f", "k").agg(F.max(F.when(F.col("left"), F.col("part_f"))).alias("l"), F.max(F.when(~F.col("left"), F.col("part_f"))).alias("r"))
    languages = frequent.select("w1", "lang").join(totals, "lang")
    whole = lambda c: f"cast({c} as decimal(19,0))"
    score = F.expr(f"(1000BD * {whole('f')} * {whole('total')}) div ({whole('l')} * {whole('r')})")
    best = found.join(languages, "w1").withColumn("score", score).groupBy(*KEY, "f", "lang", "total").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    named = kept.select(*KEY, F.posexplode(F.filter(words, lambda w: w != 0)).alias("place", "word_hash")).join(frequent.select(F.col("w1").alias("word_hash"), "word"), "word_hash")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda x: x["word"]), " ")
    return best.join(named.groupBy(*KEY).agg(text.alias("phrase")), KEY).select("lang", "phrase", F.col("f").alias("a"), "best.l", "best.r", F.col("total").alias("n"), "best.score", F.pmod(F.xxhash64(*KEY), F.lit(PARTS)).alias("part"))


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first `top` phrases of each language."""
    frequent, totals, phrases = frequent_phrases(docs, least)
    table = stored(scored(without_replaced(phrases), phrases, frequent, totals), "scored")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    leaders = table.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = leaders.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
