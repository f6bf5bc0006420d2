"""Language-model scoring by logistic context mixing over the bits of texts.

A text is read as its lower-cased words, a space after each, and one end byte. A byte is a walk through a binary code
(of the byte before it, short for what often follows), and each bit of the walk is predicted from the text before it:
hashed contexts of the last ORDERS bytes (across words) and of the word so far hold counts of zeros and ones over all
training texts; the word that last followed the same two words in the same text is one more predictor. Their logits,
damped where little was seen, are mixed with weights that a gate picks by the bit's place in the walk and the byte's in
the word. The weights at the start of a text come from one Newton step over all bits of all training texts, in which every
bit is predicted without its own count; bytes of the same contexts are looked at once and count as often as they come.
From there each text
refines its weights by its own errors as it is read (AdaGrad over blocks that double up to BLOCK_MOST bytes; a block is
predicted with the weights from before it). Each bit's two probabilities add up to one; the total is the score.

Texts are dealt in chunks of about CHUNK_BYTES, whatever their ids. Context tables are of fixed size (PREDICTORS *
2**SLOT_BITS slots at most) and are broadcast. Exact word counts (n_known, base_score) grow with the texts: each chunk
sends the hash and count of its distinct words to buckets of the hash range, as packed arrays, and gets the totals back.

Cases: null or empty texts consist of the end alone; a null doc_id is held out; with no training texts a text is
predicted from itself alone and the base score is 0; repeated rows each get a row; other columns are ignored.
"""

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import BYTE_VALUES, Words, distinct, slices, sorted_by, span_hash, stored

#: Contexts by their bytes, and the word so far (its last seven bytes and its length).
ORDERS = (3, 4, 6)
PREDICTORS, SLOT_BITS = len(ORDERS) + 1, 20
#: Mixer inputs: the contexts, the word that last followed, and a constant.
INPUTS, MATCH, CONSTANT = PREDICTORS + 2, PREDICTORS, PREDICTORS + 1
PLACES, DEPTHS = 4, 8
GATES = PLACES * DEPTHS
#: Weights before the Newton step, step of the refinement, and the logit of a matching word.
START, STEP, MATCH_LOGIT = np.array([0.35] * PREDICTORS + [1.0, 0.0]), np.float32(0.04), np.float32(2.0)
#: Start weights are learned from one word in so many, that is from all. Grains of a logit in scoring and in learning.
LEARN_EVERY, GRAIN, FINE = 1, 12, 3_072
BLOCK_LEAST, BLOCK_MOST = 16, 1024
CHUNK_BYTES, PART_BYTES, LEARN_BYTES, PIECE = 4_000_000, 400_000, 500_000, 16_384
#: Blocks in which context tables are summed, and bytes of text for each task that counts bits.
TABLE_BLOCKS, TASK_BYTES = 64, 256_000_000
SPACE, END, PADS = 0x20, 0xFF, 8
#: Multipliers of hashes, odd and without pattern.
SPREAD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(True))


# --- the bytes of texts and their contexts --------------------------------------------------------------------------


class Texts:
    """Texts as one stream of bytes: PADS zeros before each, then its words with a space each, and the end byte."""

    def __init__(self, data: np.ndarray, size: np.ndarray):
        self.data, self.size = data, size.astype(np.int64)
        self.begin = np.cumsum(self.size) - self.size

    @classmethod
    def of(cls, words: Words) -> "Texts":
        sizes = words.end - words.start
        size = np.diff(np.r_[0, np.cumsum(sizes + 1)][words.first]) + PADS + 1
        data = np.zeros(int(size.sum()), np.uint8)
        put = np.cumsum(sizes + 1) - (sizes + 1) + words.row * (PADS + 1) + PADS
        data[put + sizes] = SPACE
        data[np.cumsum(size) - 1] = END
        inside = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        data[np.repeat(put, sizes) + inside] = words.data[np.repeat(words.start, sizes) + inside]
        return cls(data, size)

    def parts(self, most: int) -> Iterator[tuple[int, "Texts"]]:
        """Whole texts of about `most` bytes, and the number of the first."""
        row, ends = 0, np.cumsum(self.size)
        while row < len(self.size):
            stop = max(row + 1, int(np.searchsorted(ends, self.begin[row] + most, "right")))
            yield row, Texts(self.data[self.begin[row] : ends[stop - 1]], self.size[row:stop])
            row = stop

    def word_hashes(self, n_words: np.ndarray) -> np.ndarray:
        space, first = np.flatnonzero(self.data == SPACE), np.cumsum(n_words) - n_words
        start = np.r_[0, space[:-1] + 1][: len(space)]
        start[first[n_words > 0]] = (self.begin + PADS)[n_words > 0]
        return span_hash(BYTE_VALUES[self.data], start, space)

    def prepare(self, bits: int) -> None:
        """The slot of each context before each byte, the start of its word, and its place in there."""
        n, data = len(self.data), self.data
        before = np.ndarray((n,), "<u8", np.r_[np.zeros(8, np.uint8), data], strides=(1,))  # the last byte is the highest
        start = np.zeros(n, bool)
        start[1:] = data[:-1] == SPACE
        start[self.begin + PADS] = True
        at = np.arange(n)
        self.own = np.maximum.accumulate(np.where(start, at, 0))
        self.place, self.word, self.slots = np.empty(n, np.uint8), np.empty(n, np.uint64), [np.empty(n, np.int64) for _ in range(PREDICTORS)]
        shift = np.uint64(64 - bits)
        for low in range(0, n, PIECE):  # arrays of a piece stay in the cache
            piece = slice(low, low + PIECE)
            last, length = before[piece].copy(), at[piece] - self.own[piece]
            self.place[piece] = np.minimum(length, PLACES - 1)
            word = ((last >> np.uint64(1)) >> (63 - 8 * np.minimum(length, 7)).view(np.uint64)) * SPREAD[0]
            word ^= length.view(np.uint64) * SPREAD[1]
            self.word[piece] = word
            for k, o in enumerate(ORDERS):
                self.slots[k][piece] = ((last >> np.uint64(64 - 8 * o)) * SPREAD[2] >> shift).view(np.int64)
            self.slots[-1][piece] = ((word ^ (word >> np.uint64(29))) * SPREAD[3] >> shift).view(np.int64)

    def expected(self) -> np.ndarray:
        """The next byte of the word that last followed the two words before, while it agrees; -1 if there is none."""
        out = np.full(len(self.data), -1, np.int64)
        real = np.ones(len(self.data), bool)
        real[(self.begin[:, None] + np.arange(PADS)).ravel()] = False
        starts = np.flatnonzero(real & (self.own == np.arange(len(self.data))))  # of words, and each end byte
        text = np.searchsorted(self.begin, starts, "right") - 1
        i = np.flatnonzero((np.arange(len(starts)) >= 2) & (text == np.r_[-1, -1, text[:-2]]))
        one, two = self.word[starts[i] - 1], self.word[starts[i - 1] - 1]
        key = ((one * SPREAD[0]) ^ (two * SPREAD[1]) ^ (text[i].astype(np.uint64) * SPREAD[3])) * SPREAD[2]
        order = sorted_by(key)
        here, last = i[order[1:]], i[order[:-1]]
        same = (key[order[1:]] == key[order[:-1]]) & (text[here] == text[last])
        here, last = here[same], last[same]
        size = np.r_[starts[1:], len(self.data)][here] - starts[here]
        size = np.where(self.data[starts[here]] == END, 1, size)
        inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        place = np.repeat(starts[here], size) + inside
        guess = self.data[np.repeat(starts[last], size) + inside]
        wrong = (guess != self.data[place]).astype(np.int64)
        so_far = np.cumsum(wrong) - wrong
        agreed = so_far == np.repeat(so_far[np.cumsum(size) - size], size)
        out[place[agreed]] = guess[agreed]
        return out


# --- the code of bytes ----------------------------------------------------------------------------------------------


def walks(weights: np.ndarray) -> list[list[int]]:
    """Of each byte the walk through a Huffman tree over the weights: 2 * node + bit at each step."""
    heap = [(w, i) for i, w in enumerate(weights.tolist())]
    heapq.heapify(heap)
    sides = []
    while len(heap) > 1:
        (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
        sides.append((i, j))
        heapq.heappush(heap, (a + b, 255 + len(sides)))
    out: list = [None] * 256
    work = [(254, [])]
    while work:
        node, walk = work.pop()
        for bit, child in enumerate(sides[node]):
            if child < 256:
                out[child] = [*walk, 2 * node + bit]
            else:
                work.append((child - 256, [*walk, 2 * node + bit]))
    return out


class Code:
    """A binary code of bytes for each byte before; `pairs`: how often each byte follows each in the training texts."""

    def __init__(self, pairs: np.ndarray, bits: int):
        pairs = pairs.reshape(256, 256).astype(float)
        any_before = (pairs.sum(0) + 1) / (pairs.sum() + 256)
        length, steps, depth = [], [], []
        alike = walks(any_before)
        for before in range(256):
            total = pairs[before].sum()
            found = walks(np.maximum(0.98 * pairs[before] / total + 0.02 * any_before, 1e-9)) if total else alike
            for walk in found:
                length.append(len(walk))
                steps += walk
                depth += range(len(walk))
        self.bits = bits
        self.length = np.array(length, np.int16)  # 48 at most, as weights have a ratio under 10**9
        self.first = np.cumsum(self.length, dtype=np.int64) - self.length
        step, depth = np.array(steps, np.int64), np.array(depth)
        node = 254 - (step >> 1)  # heavy ones first: the slots of a context's first steps lie near one another in memory
        self.step = node << 16 | np.minimum(depth, DEPTHS - 1) * PLACES << 8 | depth << 1 | step & 1  # see `parted`
        self.flag = node << 1 | step & 1
        self.whole = np.add.reduceat((step & 1) << (47 - depth), self.first)

    def steps(self, before: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How many steps each byte has, all steps one after another, and whose they are."""
        key = before.astype(np.int64) << 8 | data
        length = self.length[key].astype(np.int64)
        ends = np.cumsum(length)
        owner = np.repeat(np.arange(len(key)), length)
        index = (self.first[key] - (ends - length))[owner]
        index += np.arange(len(index))
        return length, self.step[index], owner

    def by_depth(self, pairs: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int, int]]]:
        """An order of pairs (before << 8 | byte) by kind (under 4), longest walks first, and (kind, depth, from, to): which
        of a kind have a step at each depth."""
        group = (kind * 64 + (48 - self.length[pairs])).astype(np.uint8)
        many, depths, start = np.bincount(group, minlength=256).reshape(4, 64), [], 0
        for k in range(4):
            there = np.cumsum(many[k])
            depths += [(k, depth, start, start + int(there[47 - depth])) for depth in range(48) if there[47 - depth]]
            start += int(there[-1])
        return np.argsort(group, kind="stable"), depths

    def common(self, before: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many steps the walks of two bytes share."""
        i, j = before.astype(np.int64) << 8 | a, before.astype(np.int64) << 8 | b
        _, top = np.frexp((self.whole[i] ^ self.whole[j]).astype(float))
        return np.where(a == b, self.length[i], 48 - top).astype(np.int8)


def logits(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    n = zeros + ones
    return np.log((ones + 0.1) / (zeros + 0.1)) * (n / (n + 1.5))


def grained(counts: np.ndarray) -> np.ndarray:
    """The logits of all slots as whole numbers of 1 / GRAIN, so that a predictor's table is small."""
    return np.clip(np.round(logits(counts[:, 0::2], counts[:, 1::2]) * GRAIN), -127, 127).astype(np.int8)


def lone(counts: np.ndarray) -> np.ndarray:
    """The logits towards each bit, once that bit is taken from the counts, as whole 1 / FINE: of 2 * slot + bit."""
    zeros, ones, out, most = counts[:, 0::2], counts[:, 1::2], np.empty(counts.shape, np.int16), 127 * FINE // GRAIN
    for o in range(len(counts)):
        out[o, 0::2] = np.clip(np.round(logits(ones[o], np.maximum(zeros[o] - 1, 0)) * FINE), -most, most)
        out[o, 1::2] = np.clip(np.round(logits(zeros[o], np.maximum(ones[o] - 1, 0)) * FINE), -most, most)
    return out


#: What a unit of each input is: a grain of a context's logit, the side that a matching word takes, and the constant.
SCALES = np.array([1 / GRAIN] * PREDICTORS + [MATCH_LOGIT, 1], np.float32)


def _learning(texts: Texts, train: np.ndarray, bits: int) -> Iterator[tuple[Texts, np.ndarray, np.ndarray]]:
    """Training texts by parts, prepared, with the places of their bytes and each one's pair with the byte before."""
    for row, part in texts.parts(LEARN_BYTES):
        use = np.repeat(train[row : row + len(part.size)], part.size)
        if use.any():
            use[(part.begin[:, None] + np.arange(PADS)).ravel()] = False
            part.prepare(bits)
            at = np.flatnonzero(use)
            yield part, at, part.data[at - 1].astype(np.int64) << 8 | part.data[at]


def _runs(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where equal keys that follow one another begin, and how many they are."""
    first = np.flatnonzero(np.r_[True, found[1:] != found[:-1]])
    return first, np.diff(np.r_[first, len(found)])


def tally(texts: Texts, train: np.ndarray, code: Code, tables: np.ndarray) -> None:
    """Adds the bits of training texts to the counts of their slots: tables[predictor, 2 * slot + bit]."""
    for part, at, pair in _learning(texts, train, code.bits):
        for o in range(PREDICTORS):
            key = part.slots[o][at] << 16 | pair
            key.sort()
            first, many = _runs(key)
            order, depths = code.by_depth(key[first] & 0xFFFF, np.zeros(len(first), np.int64))
            key, many = key[first][order], many.astype(tables.dtype)[order]
            begin, slot = code.first[key & 0xFFFF], key >> 16 << 1
            for _, depth, _, n in depths:
                np.add.at(tables[o], slot[:n] ^ code.flag[begin[:n] + depth], many[:n])


def slopes(texts: Texts, train: np.ndarray, code: Code, table: np.ndarray) -> np.ndarray:
    """The gradient and the curvature of the likelihood at the start weights, of each gate, over all training bits; table:
    `lone`. Bytes whose slots, place, pair and guess are the same are looked at once."""
    total = np.zeros((GATES, INPUTS * (INPUTS + 1)))
    for part, at, pair in _learning(texts, train, code.bits):
        one = (part.slots[0][at] << code.bits | part.slots[1][at]) << code.bits | part.slots[2][at]
        two = ((part.slots[3][at] << 2 | part.place[at]) << 9 | part.expected()[at] + 1) << 16 | pair
        key = one.view(np.uint64) * SPREAD[0] ^ two.view(np.uint64) * SPREAD[1]
        key = (key ^ key >> np.uint64(29)) * SPREAD[3]
        order = sorted_by(key)
        first, many = _runs(key[order])
        often = np.zeros(len(at))
        often[order[first]] = many
        some = np.flatnonzero(often)  # in the texts' order, near one another in memory
        pair, kind, at = pair[some], part.place[at[some]], at[some]
        order, depths = code.by_depth(pair, kind)
        at, pair, often, guess = at[order], pair[order], often[some][order], (two[some][order] >> 16 & 511) - 1
        begin, shared = code.first[pair], code.common(pair >> 8, pair & 255, np.maximum(guess, 0))
        shared[guess < 0] = -1
        flags = [code.flag[begin[a:b] + depth] for _, depth, a, b in depths]
        found = np.empty((PREDICTORS, sum(map(len, flags))), np.int16)
        for o in range(PREDICTORS):  # a table at a time stays in the cache
            slot, done = part.slots[o][at] << 1, 0
            for flag, (_, _, a, b) in zip(flags, depths):
                np.take(table[o], slot[a:b] ^ flag, out=found[o, done : done + b - a], mode="clip")
                done += b - a
        done = 0
        for flag, (place, depth, a, b) in zip(flags, depths):
            gate = min(depth, DEPTHS - 1) * PLACES + place
            for low in range(a, b, PIECE):  # arrays of a piece stay in the cache
                high = min(low + PIECE, b)
                x = np.empty((INPUTS, high - low))
                np.multiply(found[:, done : done + high - low], 1 / FINE, out=x[:PREDICTORS])
                np.multiply((shared[low:high] > depth).astype(np.int8) - (shared[low:high] == depth), MATCH_LOGIT, out=x[MATCH])
                x[CONSTANT] = (flag[low - a : high - a] & 1) * 2 - 1
                p = 1 / (1 + np.exp(-(START @ x)))
                left = (1 - p) * often[low:high]
                total[gate, :INPUTS] += x @ left
                total[gate, INPUTS:] += (x * (p * left) @ x.T).ravel()
                done += high - low
    return total


def start_weights(total: np.ndarray) -> np.ndarray:
    """One Newton step from START; rounded, so that the order in which sums were added is forgotten."""
    curve = total[:, INPUTS:].reshape(GATES, INPUTS, INPUTS) + np.eye(INPUTS)
    return np.round(START + np.linalg.solve(curve, total[:, :INPUTS, None])[:, :, 0], 6).astype(np.float32)


def blocks_to(longest: int) -> list[int]:
    """The ends of blocks, from 0 on."""
    ends, size = [0], BLOCK_LEAST
    while ends[-1] < longest:
        ends.append(ends[-1] + size)
        if len(ends) > 2:
            size = min(BLOCK_MOST, 2 * size)
    return ends


def mixed(texts: Texts, code: Code, table: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """log10 of the probability of each text; `table`: what `grained` makes of the counts."""
    out = []
    for _, part in texts.parts(PART_BYTES):
        part.prepare(code.bits)
        out.append(_mixed(part, code, table, weights))
    return np.concatenate(out) if out else np.zeros(0)


def _inputs(s: Texts, code: Code, table: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of bytes the ends of their steps; of each step its inputs towards its bit (see SCALES) and its gate."""
    before, data, guess = s.data[at - 1], s.data[at], s.expected()[at]
    shared, some = np.full(len(at), -1, np.int8), np.flatnonzero(guess >= 0)
    shared[some] = code.common(before[some], data[some], guess[some])
    place, stop = s.place[at].astype(np.uint8), np.cumsum(code.length[before.astype(np.int64) << 8 | data], dtype=np.int64)
    x, gates, done = np.empty((INPUTS, int(stop[-1])), np.int8), np.empty(int(stop[-1]), np.uint8), 0
    for low in range(0, len(at), PIECE):  # arrays of a piece stay in the cache
        piece = slice(low, low + PIECE)
        _, step, owner = code.steps(before[piece], data[piece])
        own, node, slot = slice(done, done + len(step)), step >> 16, np.empty(len(step), np.int64)
        sign = ((step & 1) * 2 - 1).astype(np.int8)
        for o in range(PREDICTORS):
            np.take(s.slots[o][at[piece]], owner, out=slot, mode="clip")
            slot ^= node
            np.take(table[o], slot, out=x[o, own], mode="clip")
        x[:PREDICTORS, own] *= sign
        agreed, depth = shared[piece][owner], (step >> 1).astype(np.int8) & 127
        x[MATCH, own] = (agreed > depth).astype(np.int8) - (agreed == depth)  # agrees, goes apart, gone
        x[CONSTANT, own] = sign
        gates[own] = (step >> 8).astype(np.uint8) + place[piece][owner]
        done += len(step)
    return stop, x, gates


def _mixed(s: Texts, code: Code, table: np.ndarray, weights: np.ndarray) -> np.ndarray:
    room = s.size - PADS
    ends = blocks_to(int(room.max()))
    inside = np.arange(int(room.sum())) - np.repeat(np.cumsum(room) - room, room)
    block = np.repeat(np.arange(len(ends) - 1), np.diff(ends)).astype(np.uint16 if len(ends) <= 1 << 16 else np.int64)[inside]
    at = np.repeat(s.begin + PADS, room) + inside
    stop, inputs, gates = _inputs(s, code, table, at[np.argsort(block, kind="stable")])  # a block's bytes together
    moved = np.zeros((INPUTS, len(room)), np.float32)
    seen, cost, stop, done = np.full(moved.shape, 0.1, np.float32), np.zeros(len(room)), np.r_[0, stop], 0
    for low, high in zip(ends[:-1], ends[1:]):
        who = np.flatnonzero(room > low)
        last = done + np.cumsum(np.minimum(room[who], high) - low)
        cuts = stop[np.r_[done, last]]
        steps, begin, mine, done = np.diff(cuts), cuts[:-1] - cuts[0], slice(cuts[0], cuts[-1]), int(last[-1])
        gate = np.repeat(np.arange(len(who)) * GATES, steps)
        gate += gates[mine]
        own = ((weights.T[:, None, :] + moved[:, who, None]) * SCALES[:, None, None]).reshape(INPUTS, -1)
        x, z, w = inputs[:, mine].astype(np.float32), np.zeros(len(gate), np.float32), np.empty(len(gate), np.float32)
        for o in range(INPUTS):
            np.take(own[o], gate, out=w, mode="clip")
            w *= x[o]
            z -= w
        np.clip(z, -30, 30, out=z)
        np.exp(z, out=z)  # one against the bit's odds
        w = z + 1
        z /= w
        cost[who] += np.add.reduceat(np.log(w, out=w), begin, dtype=np.float64)
        x *= z
        slope = np.add.reduceat(x, begin, axis=1) * SCALES[:, None]
        seen[:, who] += slope * slope
        moved[:, who] += STEP * slope / np.sqrt(seen[:, who])
    return -cost / np.log(10)


# --- Spark ----------------------------------------------------------------------------------------------------------

CHUNK = "chunk long, bytes long, doc_ids array<long>, held array<boolean>, n_words array<long>, n_bytes array<long>, sizes array<long>, data binary, pairs binary, train_tokens long, train_texts long, hashes binary, counts binary"


def _packed(values: np.ndarray) -> bytes:
    return pa.compress(values.tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: pa.Scalar, size: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data.as_buffer(), decompressed_size=size, codec="zstd"), np.uint8)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole texts of about CHUNK_BYTES as one row, with their distinct words and counts of pairs of bytes."""
    chunk = TaskContext.get().partitionId() << 32
    for batch in batches:
        held_all = batch.column("held_out").to_numpy(zero_copy_only=False)
        for a, b in slices(batch.column("text"), CHUNK_BYTES):
            held, column, parts = held_all[a:b], batch.column("text").slice(a, b - a), []
            pairs = np.zeros(1 << 16, np.int64)
            for c, d in slices(column, PART_BYTES):
                words = Words(column.slice(c, d - c), lower=True)
                texts = Texts.of(words)
                use = np.repeat(~held[c:d], texts.size)
                use[(texts.begin[:, None] + np.arange(PADS)).ravel()] = False
                at = np.flatnonzero(use)
                pairs += np.bincount(texts.data[at - 1].astype(np.int64) << 8 | texts.data[at], minlength=1 << 16)
                parts.append((texts.data, texts.size, words.counts, np.diff(words.offsets), words.hashes(), ~held[c + words.row]))
            data, size, n_words, n_bytes, hashed, train = map(np.concatenate, zip(*parts))
            hashes, which = distinct(hashed)
            counts = np.bincount(which, train, len(hashes)).astype("<u4")
            lists = [pa.array([x], t) for x, t in ((batch.column("doc_id").slice(a, b - a).to_pylist(), pa.list_(pa.int64())), (held, pa.list_(pa.bool_())), (n_words, pa.list_(pa.int64())), (n_bytes, pa.list_(pa.int64())), (size, pa.list_(pa.int64())))]
            rest = [_packed(data), _packed(pairs.astype("<u4")), int(counts.sum()), int((~held).sum()), hashes.astype("<u8").tobytes(), counts.tobytes()]
            types = [pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.record_batch([pa.array([chunk]), pa.array([len(data)]), *lists, *(pa.array([x], t) for x, t in zip(rest, types))], [x.split()[0] for x in CHUNK.split(", ")])
            chunk += 1


def _sum_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << 16, np.int64)
    for batch in batches:
        for pairs in batch.column("pairs"):
            total += _unpacked(pairs, 4 << 16).view("<u4")
    yield pa.record_batch([pa.array([_packed(total)], pa.binary())], ["pairs"])


def _texts_of(batch: pa.RecordBatch) -> Iterator[tuple[Texts, np.ndarray]]:
    for size, held, sizes, data in zip(batch.column("bytes").to_pylist(), batch.column("held"), batch.column("sizes"), batch.column("data")):
        yield Texts(_unpacked(data, size), sizes.values.to_numpy()), ~held.values.to_numpy(zero_copy_only=False)


def _tally(code):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = np.zeros((PREDICTORS, 2 << code.value.bits), np.int32)  # a task has far fewer bits
        for batch in batches:
            for texts, train in _texts_of(batch):
                tally(texts, train, code.value, tables)
        yield pa.record_batch([pa.array(range(TABLE_BLOCKS), pa.int32()), pa.array([x.astype("<u4").tobytes() for x in np.split(tables.ravel(), TABLE_BLOCKS)], pa.binary())], ["block", "counts"])

    return run


def _sum_blocks(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(b.as_buffer(), "<u4").astype(float) for b in table.column("counts"))
    return pa.table({"block": table.column("block").slice(0, 1), "counts": pa.array([total.astype("<f4").tobytes()], pa.binary())})


def _slopes(code, table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((GATES, INPUTS * (INPUTS + 1)))
        for batch in batches:
            for texts, train in _texts_of(batch):
                total += slopes(texts, train, code.value, table.value)
        yield pa.record_batch([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], ["i", "value"])

    return run


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Equal stretches of the hash range, so that buckets in order hold hashes in order."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _requests(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, hashes, counts in zip(batch.column("chunk").to_pylist(), batch.column("hashes"), batch.column("counts")):
                h, c = np.frombuffer(hashes.as_buffer(), "<u8"), np.frombuffer(counts.as_buffer(), "<u4")
                bucket = _bucket(h, buckets)
                cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]][: len(h)])
                spans = list(zip(cuts.tolist(), [*cuts[1:].tolist(), len(h)]))
                yield pa.record_batch([pa.array(bucket[cuts]), pa.array(np.full(len(cuts), chunk, np.int64)), pa.array([h[a:b].tobytes() for a, b in spans], pa.binary()), pa.array([c[a:b].tobytes() for a, b in spans], pa.binary())], ["bucket", "chunk", "hashes", "counts"])

    return run


def _totals(table: pa.Table) -> pa.Table:
    """To each chunk of a bucket the totals of its words; with chunk -1 the number of distinct training words."""
    hashes = [np.frombuffer(x.as_buffer(), "<u8") for x in table.column("hashes")]
    counts = np.concatenate([np.frombuffer(x.as_buffer(), "<u4") for x in table.column("counts")])
    known, which = distinct(np.concatenate(hashes))
    total = np.bincount(which, counts, len(known)).astype("<u8")
    answers = np.split(total[which], np.cumsum([len(h) for h in hashes])[:-1])
    small = total.max(initial=0) >> np.uint64(32) == 0
    chunks = [*table.column("chunk").to_pylist(), -1]
    packed = [*(a.astype("<u4").tobytes() if small else a.tobytes() for a in answers), None]
    n = len(chunks)
    return pa.table({"chunk": chunks, "bucket": [table.column("bucket")[0].as_py()] * n, "width": pa.array([4 if small else 8] * n, pa.int32()), "totals": pa.array(packed, pa.binary()), "distinct": [0] * (n - 1) + [int((total > 0).sum())]})


def _scores(code, table, weights, facts: dict):
    base_of = lambda c: np.log10((c + 1) / (facts["n"] + facts["v"] + 1))
    names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "bits_per_byte"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (texts, train) in enumerate(_texts_of(batch)):
                n_words, n_bytes = (batch.column(c)[k].values.to_numpy() for c in ("n_words", "n_bytes"))
                first = np.r_[0, np.cumsum(n_words)]
                _, which = distinct(np.concatenate([part.word_hashes(n_words[row : row + len(part.size)]) for row, part in texts.parts(PART_BYTES)]))
                answers = batch.column("answers")[k].as_py() or []
                parts = [np.frombuffer(a["totals"], "<u4" if a["width"] == 4 else "<u8") for a in answers]
                c = np.concatenate(parts).astype(float)[which] if parts else np.zeros(0)
                total = lambda x: np.diff(np.r_[0, np.cumsum(x)][first])
                score = mixed(texts, code.value, table.value, weights)
                values = [batch.column("doc_ids")[k].values, pa.array(~train), pa.array(n_words + 1), pa.array((total(c > 0) + (facts["end"] > 0)).astype(np.int64)), pa.array(total(base_of(c)) + base_of(facts["end"])), pa.array(score), pa.array(-score * np.log2(10) / np.maximum(n_bytes, 1))]
                yield pa.record_batch(values, names)

    return run


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte), scores as log10."""
    context = docs.sparkSession.sparkContext
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out(F.col("doc_id")).alias("held_out"))
    chunks = stored(marked.mapInArrow(_chunks, CHUNK), "chunks")
    size, n_chunks, tokens, end = chunks.agg(F.sum("bytes"), F.count("*"), F.sum("train_tokens"), F.sum("train_texts")).first()
    tasks = max(2 * context.defaultParallelism, -(-(size or 0) // TASK_BYTES))

    pairs = chunks.select("pairs").coalesce(64).mapInArrow(_sum_pairs, "pairs binary").collect()
    total = sum((np.frombuffer(pa.decompress(r.pairs, decompressed_size=8 << 16, codec="zstd"), "<i8") for r in pairs), np.zeros(1 << 16, np.int64))
    code = context.broadcast(Code(total, min(SLOT_BITS, max(12, int(size or 0).bit_length()))))
    streams = chunks.select("bytes", "held", "sizes", "data").coalesce(tasks)
    blocks = streams.mapInArrow(_tally(code), "block int, counts binary").groupBy("block").applyInArrow(_sum_blocks, "block int, counts binary").collect()
    counts = np.zeros((PREDICTORS, 2 << code.value.bits), np.float32)
    if blocks:
        counts = np.concatenate([np.frombuffer(r.counts, "<f4") for r in sorted(blocks, key=lambda r: r.block)]).reshape(PREDICTORS, -1)
    shared = context.broadcast(lone(counts))
    sums = dict(streams.mapInArrow(_slopes(code, shared), "i int, value double").groupBy("i").agg(F.sum("value")).collect())
    weights = start_weights(np.array([sums.get(i, 0.0) for i in range(GATES * INPUTS * (INPUTS + 1))]).reshape(GATES, -1))
    table = context.broadcast(grained(counts))
    shared.destroy()

    buckets = max(16, n_chunks // 8)
    wanted = chunks.select("chunk", "hashes", "counts").mapInArrow(_requests(buckets), "bucket long, chunk long, hashes binary, counts binary")
    answers = stored(wanted.groupBy("bucket").applyInArrow(_totals, "chunk long, bucket long, width int, totals binary, distinct long"), "totals")
    n_distinct = answers.filter("chunk < 0").agg(F.sum("distinct")).first()[0] or 0
    facts = {"n": (tokens or 0) + (end or 0), "v": n_distinct + bool(end), "end": end or 0}
    own = answers.filter("chunk >= 0").groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("bucket", "width", "totals"))).alias("answers"))
    texts = chunks.select("chunk", "bytes", "doc_ids", "held", "n_words", "n_bytes", "sizes", "data").join(own, "chunk", "left")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, bits_per_byte double"
    scored = texts.mapInArrow(_scores(code, table, weights, facts), schema)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(facts["n"]).cast("long").alias("train_tokens"), "base_score", "score", "bits_per_byte")
