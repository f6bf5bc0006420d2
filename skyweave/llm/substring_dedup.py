"""Substring dedup by matching statistics against suffix automata of reference shards.

Broadcasting automata of a whole corpus to every document costs (shards x documents) and has no size bound, so the
reference is dealt instead: every window of WINDOW words carries a minimiser (its smallest hash of SEED words), equal
windows have equal minimisers, and only minimisers of two documents or more can lie in a repeated window. The
stretches around those meet by minimiser (whole copies of a text with a smaller doc_id need not take part: all their
windows are repeated, and the first copy stands for them); there, in order of doc_id, each stretch is streamed through a suffix
automaton of the earlier ones and then added to it. Words are compared as such; hashes only bring them together.

Cases: null or empty text has no words and stays empty; texts under WINDOW words stay whole; rows that repeat a doc_id
do not remove each other (only a smaller doc_id does); a null doc_id counts as the largest; other columns are ignored.
"""

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .words import Words, chunked, slices, stored, window_hash, window_starts

WINDOW, SEED = 13, 5
#: Documents a chunk; chunks are the unit in which texts are dealt and candidates pre-aggregated.
CHUNK_DOCS = 512
#: A minimiser of more chunks than this meets by whole windows instead, which splits its stretches over many tasks.
HOT_CHUNKS = 64
NO_ID = np.iinfo(np.int64).max
#: Chunk, row in the chunk, first word in the text, and doc_id of a stretch.
PLACE = struct.Struct("<iiiq")


class SuffixAutomaton:
    """Of a growing set of word sequences; each state knows the first document that brought it."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.doc = [-1], [0], [-1]

    def _state(self, length: int, moves: dict, link: int, doc: int) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        self.doc.append(doc)
        return len(self.length) - 1

    def _split(self, p: int, word: bytes, q: int) -> int:
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q], self.doc[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def add(self, words: list[bytes], doc: int) -> None:
        last = 0
        for word in words:
            q = self.next[last].get(word)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, word, q)
                continue
            new = self._state(self.length[last] + 1, {}, 0, doc)
            p, last = last, new
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][word]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)

    def first_docs(self, words: list[bytes], k: int, other: int) -> list[int]:
        """For each window of k words, the first document that has it (`other` if none), by matching statistics."""
        out, state, matched = [], 0, 0
        for i, word in enumerate(words):
            while state and word not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if word in self.next[state]:
                state = self.next[state][word]
                matched += 1
            if i >= k - 1:
                at = state
                while matched >= k and self.length[self.link[at]] >= k:
                    at = self.link[at]
                out.append(self.doc[at] if matched >= k else other)
        return out


def in_order(table: pa.Table) -> pa.Table:
    """The chunk's rows in an order that does not depend on how they arrived, so that row numbers can be kept."""
    ids = table.column("doc_id").combine_chunks().fill_null(NO_ID)
    table = table.select(["text"]).append_column("doc_id", ids)
    return table.sort_by([("doc_id", "ascending"), ("text", "ascending")]).combine_chunks()


def is_copy(docs: pa.Table, copies: pa.Table) -> list[bool]:
    """Which rows of a chunk in order are whole copies of a text with a smaller doc_id."""
    known = set(zip(copies.column("copy_id").to_pylist(), copies.column("digest").to_pylist()))
    ids = {i for i, _ in known}
    rows = zip(docs.column("doc_id").to_pylist(), docs.column("text"))
    return [i in ids and (i, hashlib.sha256((t.as_py() or "").encode()).hexdigest()) in known for i, t in rows]


def first_copies(docs: pa.Table, copies: pa.Table) -> pa.Table:
    """The chunk's rows in order, later copies without their text."""
    docs = in_order(docs)
    later = is_copy(docs, copies)
    if not any(later):
        return docs
    text = docs.column("text").combine_chunks()
    return docs.set_column(docs.column_names.index("text"), "text", pc.if_else(pa.array(later), pa.scalar(None, text.type), text))


def minimised(table: pa.Table) -> Iterator[tuple]:
    """Of each slice of a chunk: its words, first row, doc_ids, word hashes, window starts, and their minimisers."""
    text, docs = table.column("text").combine_chunks(), table.column("doc_id").to_numpy()
    for a, b in slices(text):
        words = Words(text.slice(a, b - a))
        starts = window_starts(words, WINDOW)
        if not len(starts):
            continue
        hashes = words.hashes()
        seeds = np.full(len(hashes), np.iinfo(np.uint64).max, np.uint64)
        full = window_starts(words, SEED)
        seeds[full] = window_hash(hashes, full, SEED)
        best, at = seeds[starts], starts.copy()
        for j in range(1, WINDOW - SEED + 1):
            less = seeds[starts + j] < best
            best[less] = seeds[starts + j][less]
            at[less] = starts[less] + j
        yield words, a, docs[a:b], hashes, starts, best, at


def _chunk_minimisers(table: pa.Table, copies: pa.Table) -> pa.Table:
    chunk, parts = table.column("chunk")[0].as_py() if table.num_rows else 0, []
    for words, _, docs, _, starts, best, at in minimised(first_copies(table, copies)):
        once = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        parts.append((best[once], docs[words.row[starts[once]]]))
    key = np.concatenate([p[0] for p in parts] or [np.zeros(0, np.uint64)])
    doc = np.concatenate([p[1] for p in parts] or [np.zeros(0, np.int64)])
    order = np.argsort(key, kind="stable")
    key, doc = key[order], doc[order]
    runs = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, int)
    low, high = (np.minimum.reduceat(doc, runs), np.maximum.reduceat(doc, runs)) if len(runs) else (doc, doc)
    return pa.table({"chunk": np.full(len(runs), chunk, np.int32), "minimiser": key[runs].view(np.int64), "low": low, "high": high})


def _stretches(docs: pa.Table, notes: pa.Table) -> pa.Table:
    """The stretches of a chunk around repeated minimisers, equal ones merged, with all places where they stand."""
    out: dict[str, list] = {k: [] for k in ("key", "doc", "stretch", "places")}
    chunk = docs.column("chunk")[0].as_py() if docs.num_rows else 0
    repeated = notes.filter(pc.is_valid(notes.column("minimiser")))
    if docs.num_rows and repeated.num_rows:
        wanted = repeated.column("minimiser").to_numpy().view(np.uint64)
        order = np.argsort(wanted)
        wanted, hot = wanted[order], repeated.column("hot").to_numpy(zero_copy_only=False)[order]
        seen: dict[tuple, list] = {}
        for words, row0, ids, hashes, starts, best, at in minimised(first_copies(docs, notes)):
            place = np.minimum(np.searchsorted(wanted, best), len(wanted) - 1)
            keep = wanted[place] == best
            starts, best, at, hot_here = starts[keep], best[keep], at[keep], hot[place[keep]]
            if not len(starts):
                continue
            fresh = np.r_[True, (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)] | hot_here
            heads = np.flatnonzero(fresh)
            tails = np.r_[heads[1:], len(starts)] - 1
            key = best[heads]
            alone = hot_here[heads]
            if alone.any():
                key[alone] = window_hash(hashes, starts[heads[alone]], WINDOW)
            raw = words.data.tobytes()
            rows = words.row[starts[heads]]
            spot = starts[heads] - words.first[rows]
            for k, a, b, r, s, d in zip(key.view(np.int64).tolist(), words.start[starts[heads]].tolist(), words.end[starts[tails] + WINDOW - 1].tolist(), (rows + row0).tolist(), spot.tolist(), ids[rows].tolist()):
                seen.setdefault((k, b" ".join(raw[a:b].split())), []).append((chunk, r, s, d))
        for (k, stretch), places in seen.items():
            out["key"].append(k)
            out["doc"].append(min(p[3] for p in places))
            out["stretch"].append(stretch)
            out["places"].append(b"".join(PLACE.pack(*p) for p in places))
    return pa.table([pa.array(out["key"], pa.int64()), pa.array(out["doc"], pa.int64()), pa.array(out["stretch"], pa.binary()), pa.array(out["places"], pa.binary())], ["key", "doc", "stretch", "places"])


def _covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams the stretches of each key, by doc_id, through the automaton of those before."""
    now, known, automaton = None, {}, None
    for batch in batches:
        chunks, places, masks = [], [], []
        columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
        for key, doc, stretch, at in zip(*columns):
            if key != now:
                now, known, automaton = key, {}, None
            first = known.get(stretch)
            if first is None:
                words = stretch.split()
                if known and automaton is None:  # a key with a single stretch needs none
                    automaton = SuffixAutomaton()
                    for old, docs_of in known.items():
                        automaton.add(old.split(), docs_of[0])
                first = known[stretch] = (doc, automaton.first_docs(words, WINDOW, doc) if automaton else [doc] * (len(words) - WINDOW + 1))
                if automaton:
                    automaton.add(words, doc)
            for chunk, row, start, own in PLACE.iter_unpack(at):
                mask = sum(1 << j for j, d in enumerate(first[1]) if d < own)
                if mask:
                    chunks.append(chunk)
                    places.append((row << 32) + start)
                    masks.append(mask)
        yield pa.record_batch([pa.array(chunks, pa.int32()), pa.array(places, pa.int64()), pa.array(masks, pa.int32())], ["chunk", "place", "mask"])


def _kept(docs: pa.Table, covers: pa.Table) -> pa.Table:
    docs = in_order(docs)
    later = is_copy(docs, covers)
    covers = covers.filter(pc.is_valid(covers.column("place")))
    place, mask = covers.column("place").to_numpy(), covers.column("mask").to_numpy()
    order = np.argsort(place)
    place, mask = place[order], mask[order]
    row = place >> 32
    bounds = np.searchsorted(row, np.arange(docs.num_rows + 1))
    texts, counts, removed = [], [], []
    for i, text in enumerate(docs.column("text").to_pylist()):
        words = (text or "").encode().split()
        counts.append(len(words))
        gone = np.zeros(len(words) + 1, np.int32)
        for p, m in zip((place[bounds[i] : bounds[i + 1]] & 0xFFFFFFFF).tolist(), mask[bounds[i] : bounds[i + 1]].tolist()):
            for j in range(WINDOW):
                if m >> j & 1:
                    gone[p + j] += 1
                    gone[p + j + WINDOW] -= 1
        if later[i]:
            words = [] if len(words) >= WINDOW else words
        elif bounds[i] < bounds[i + 1]:
            keep = np.cumsum(gone[:-1]) == 0
            words = [w for w, k in zip(words, keep.tolist()) if k]
        removed.append(counts[-1] - len(words))
        texts.append(b" ".join(words).decode())
    ids = docs.column("doc_id").to_numpy()
    return pa.table([pa.array(ids, mask=ids == NO_ID), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(removed, pa.int64())], ["doc_id", "text", "n_words", "n_removed"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text, n_words, n_removed): texts without the words of windows that start in a smaller doc_id too."""
    texts = chunked(docs, CHUNK_DOCS)
    copies = stored(_copies(texts), "copies")
    found = texts.groupBy("chunk").cogroup(copies.groupBy("chunk")).applyInArrow(_chunk_minimisers, "chunk int, minimiser long, low long, high long")
    same = Window.partitionBy("minimiser")  # a row a chunk at most; a join to counts would need them stored or found twice
    repeated = (
        found.select("chunk", "minimiser", F.min("low").over(same).alias("low"), F.max("high").over(same).alias("high"), F.count("*").over(same).alias("n"))
        .filter("low < high")
        .select("chunk", "minimiser", (F.col("n") > HOT_CHUNKS).alias("hot"))
    )
    notes = repeated.unionByName(copies, allowMissingColumns=True)
    stretches = texts.groupBy("chunk").cogroup(notes.groupBy("chunk")).applyInArrow(_stretches, "key long, doc long, stretch binary, places binary")
    covers = stretches.repartition("key").sortWithinPartitions("key", "doc").mapInArrow(_covered, "chunk int, place long, mask int")
    covers = covers.unionByName(copies, allowMissingColumns=True)
    return texts.groupBy("chunk").cogroup(covers.groupBy("chunk")).applyInArrow(_kept, "doc_id long, text string, n_words long, n_removed long")


def _copies(texts: DataFrame) -> DataFrame:
    """(chunk, copy_id, digest) of texts that a smaller doc_id has too; a group's least is aggregated before the join."""
    digests = stored(texts.filter("text is not null").select("chunk", F.coalesce("doc_id", F.lit(NO_ID)).alias("copy_id"), F.sha2("text", 256).alias("digest")), "digests")
    firsts = digests.groupBy("digest").agg(F.min("copy_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    return digests.join(firsts, "digest").filter("copy_id > first").select("chunk", "copy_id", "digest")
