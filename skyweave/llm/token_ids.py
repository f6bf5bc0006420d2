"""Token ids of whole texts by a public tokenizer, each distinct piece being encoded once.

The byte-level pattern never joins a non-space to a space after it, so a text may be cut before a space that a
non-space follows without any change of its ids, and such pieces may be put together in any order and encoded as one
text; the byte lengths of the ids tell where each piece ends. Lead bytes of multi-byte spaces are left uncut. A name
of a special token in a text is that token, as the tokenizer has it; a tokenizer with such names over a space, or that
take spaces beside them, is refused.
"""

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa

from .words import BYTE_VALUES, grouped, span_hash, text_bytes

CUT_BEFORE = np.zeros(256, bool)
CUT_BEFORE[0x21:0x7F] = True
CUT_BEFORE[0x80:0xF8] = True
CUT_BEFORE[[0xC2, 0xE1, 0xE2, 0xE3]] = False
#: Pieces that a worker remembers; beyond that it keeps those that it met again in a later slice, if these leave room.
CACHE_PIECES = 400_000
JOINED_BYTES = 20_000


class PieceEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if any(" " in t.content or t.lstrip or t.rstrip for t in self.tokenizer.get_added_tokens_decoder().values()):
            raise ValueError("a special token's name may be cut")
        vocabulary = self.tokenizer.get_vocab()
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)  # a token's characters stand for one byte each
        self.bytes_of[list(vocabulary.values())] = [len(t) for t in vocabulary]
        self.forget()

    def forget(self) -> None:
        self.hashes, self.begin, self.size, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.again = np.zeros(0, bool)

    def forget_rare(self) -> None:
        """Keeps the pieces met again since they were learned or last kept."""
        keep = self.again
        size = self.size[keep]
        begin = np.cumsum(size) - size
        self.ids = self.ids[np.repeat(self.begin[keep] - begin, size) + np.arange(size.sum())]
        self.hashes, self.begin, self.size, self.again = self.hashes[keep], begin, size, np.zeros(len(size), bool)

    def _encode(self, texts: list[bytes]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]

    def _fresh(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces that may be joined, and how many each has."""
        sizes = np.array([len(p) for p in pieces], np.int64)
        ends = np.cumsum(sizes)
        cuts = np.unique(np.searchsorted(ends, np.arange(JOINED_BYTES, ends[-1] + JOINED_BYTES, JOINED_BYTES)) + 1)
        bounds = [0, *np.minimum(cuts, len(pieces)).tolist()]
        joined = [b"".join(pieces[a:b]) for a, b in zip(bounds[:-1], bounds[1:]) if b > a]
        ids = np.concatenate(self._encode(joined))
        token_ends = np.cumsum(self.bytes_of[ids])
        upto = np.searchsorted(token_ends, ends) + 1
        if (token_ends[upto - 1] != ends).any():
            raise ValueError("the tokenizer joined two pieces")
        return ids, np.diff(np.r_[0, upto])

    def learn(self, hashes: np.ndarray, pieces: list[bytes]) -> None:
        loose = np.array([not (len(p) > 1 and p[0] == 0x20 and CUT_BEFORE[p[1]]) for p in pieces])
        order = np.r_[np.flatnonzero(~loose), np.flatnonzero(loose)]
        parts, sizes = [self.ids], []
        if (~loose).any():
            ids, size = self._fresh([pieces[i] for i in np.flatnonzero(~loose).tolist()])
            parts.append(ids)
            sizes.append(size)
        if loose.any():
            alone = self._encode([pieces[i] for i in np.flatnonzero(loose).tolist()])
            parts += alone
            sizes.append(np.array([len(a) for a in alone], np.int64))
        size = np.concatenate(sizes)
        begin = len(self.ids) + np.cumsum(size) - size
        self.ids = np.concatenate(parts)
        by_hash = np.argsort(order)  # hashes come sorted
        place = np.searchsorted(self.hashes, hashes)
        known = ((self.hashes, hashes), (self.begin, begin[by_hash]), (self.size, size[by_hash]), (self.again, False))
        self.hashes, self.begin, self.size, self.again = (np.insert(old, place, new) for old, new in known)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = text_bytes(column)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        head = np.zeros(len(data) + 1, bool)
        head[:-2] = (data[:-1] == 0x20) & CUT_BEFORE[data[1:]]
        head[offsets[offsets > 0] - 1] = False  # the last byte of a text stays with its piece
        head[offsets] = True
        head[-1] = False
        starts = np.flatnonzero(head)
        ends = np.r_[starts[1:], len(data)]
        hashes, pick, which = grouped(span_hash(BYTE_VALUES[data], starts, ends))
        if len(self.hashes) + len(hashes) > CACHE_PIECES:
            self.forget_rare()
            if len(self.hashes) + len(hashes) > CACHE_PIECES:
                self.forget()
        at = np.searchsorted(self.hashes, hashes)
        known = self.hashes[np.minimum(at, len(self.hashes) - 1)] == hashes if len(self.hashes) else np.zeros(len(hashes), bool)
        self.again[at[known]] = True
        new = np.flatnonzero(~known)
        if len(new):
            raw = data.tobytes()
            self.learn(hashes[new], [raw[a:b] for a, b in zip(starts[pick[new]].tolist(), ends[pick[new]].tolist())])
            at = np.searchsorted(self.hashes, hashes)
        begin, lengths = self.begin[at][which], self.size[at][which]
        total = np.r_[0, np.cumsum(lengths)]
        ids = self.ids[np.repeat(begin - total[:-1], lengths) + np.arange(total[-1])]
        return ids, total[np.searchsorted(starts, offsets)]


@lru_cache(1)
def encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def encode(column: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids (uint32) of all rows one after another, and the len + 1 offsets of the rows. Null: no ids."""
    return encoder(path).encode(column)
