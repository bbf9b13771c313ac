"""Token ids of whole texts by a public byte-level BPE tokenizer, inside Spark tasks.

The tokenizers library gives every id. Its merges never cross the cuts of the vocabulary's pre-tokenizer, so a text may be
cut at some of these and each distinct piece (told apart by two 64-bit hashes) encoded once for a task: a text's ids are the ids
of its pieces in a row.
Strings of added tokens are found first, as the library does: each is a piece of its own, and no other piece holds one.
"""

from __future__ import annotations

import os
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from graphloom.llm.common import flat, ragged, slices, sums_by_place

#: Spark's tasks are the parallel units; the library's own threads would only contend with them.
os.environ["TOKENIZERS_PARALLELISM"] = "false"

VOCABULARY = "byte_bpe_50k.json"
END_ID = 0
#: Bytes of text that are encoded at once, and distinct pieces a task remembers.
STEP, REMEMBERED = 1 << 21, 1 << 20
#: Bytes of the longest piece that is remembered, and ids that are held for all of them.
LONG, HELD_IDS = 256, 1 << 23
#: The characters by which byte-level vocabularies write bytes that aren't printable (the others stand for themselves).
_HIDDEN = [*range(33), *range(127, 161), 173]
_WRITTEN = {b: chr(256 + i) for i, b in enumerate(_HIDDEN)}
_HIGH = str.maketrans({chr(b): c for b, c in _WRITTEN.items()})
#: Letters below U+0250 that aren't in the range of Latin letters.
_SIGNS = {"\u00aa", "\u00b5", "\u00ba"}


class PieceEncoder:
    """Encodes texts; remembers the ids of pieces. One for a task; its memory is bounded by REMEMBERED pieces and HELD_IDS ids, and what STEP bytes of text add."""

    def __init__(self, vocabulary: str = VOCABULARY, remembered: int = REMEMBERED):
        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(vocabulary))
        longest = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self._adds = re.compile(b"|".join(re.escape(x.encode()) for x in longest)) if longest else None
        self.remembered = remembered
        self._forget()

    def _forget(self) -> None:
        self._slot: dict[int, int] = {}
        self._check = np.zeros(1 << 12, np.uint64)
        self._begin, self._length = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self._ids, self._used, self._slots = np.zeros(1 << 14, np.uint32), 0, 0

    @staticmethod
    def _room(a: np.ndarray, n: int) -> np.ndarray:
        return a if len(a) >= n else np.concatenate([a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype)])

    def _added_at(self, raw: np.ndarray, begins: np.ndarray) -> list[tuple[int, int]]:
        """Where added tokens' strings begin and end, each within one text."""
        if self._adds is None or not self._adds.search(whole := raw.tobytes()):
            return []
        return [m.span() for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True) for m in self._adds.finditer(whole, a, b)]

    @staticmethod
    def _cuts(raw: np.ndarray, begins: np.ndarray, added: list[tuple[int, int]]) -> np.ndarray:
        """Where pieces begin: at each text; at both ends of added tokens' strings and nowhere inside; at a space or newline after a visible character; after a single newline;
        at ASCII punctuation after a letter of ASCII or Latin-1. The pre-tokenizer cuts at all of these. Characters whose first byte
        may belong to a white space outside ASCII don't count as visible."""
        cut = np.zeros(len(raw) + 1, bool)
        if len(raw) > 3:
            visible = raw > 32
            visible[1:] &= raw[:-1] != 0xC2
            visible[2:] &= (raw[:-2] < 0xE1) | (raw[:-2] > 0xE3)
            gap = (raw == 32) | (raw == 10)
            cut[1:-1] = gap[1:] & visible[:-1] & (raw[:-1] != 127)
            cut[2:-1] |= (raw[1:-1] == 10) & cut[1:-2] & (raw[2:] > 32) & (raw[2:] < 127)
            low = raw | 32
            letter = (low >= 97) & (low <= 122)
            mark = (raw > 32) & (raw < 127) & ~letter & ~((raw >= 48) & (raw <= 57)) & (raw != 39)
            letter[1:] |= (raw[:-1] == 0xC3) & (raw[1:] != 0x97) & (raw[1:] != 0xB7)
            cut[1:-1] |= mark[1:] & letter[:-1]
        for a, b in added:
            cut[a + 1 : b] = False
            cut[[a, b]] = True
        cut[begins[:-1][begins[:-1] < begins[1:]]] = True
        cut[-1] = False
        return np.flatnonzero(cut)

    def _merged(self, piece: str) -> list[int] | None:
        """The ids of Latin letters with or without a space before them: one pre-token, which the model takes as it is."""
        word = piece[1:] if piece[0] == " " else piece
        if not word.isalpha():
            return None
        if word.isascii():
            written = piece.replace(" ", _WRITTEN[32])
        elif max(word) < "\u0250" and not _SIGNS & set(word):
            written = piece.encode().decode("latin-1").translate(_HIGH)
        else:
            return None
        return [t.id for t in self.tokenizer.model.tokenize(written)]

    def _learn(self, pieces: list[bytes], keys: list[int], checks: np.ndarray) -> np.ndarray:
        """The slots of new pieces; those without a key get a slot too, but aren't found again."""
        texts = [x.decode() for x in pieces]
        found: list = [self._merged(x) for x in texts]
        rest = [i for i, x in enumerate(found) if x is None]
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False), strict=True):
            found[i] = e.ids
        first, lengths = self._slots, np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter((i for x in found for i in x), np.uint32, int(lengths.sum()))
        end = self._slots = first + len(found)
        self._begin, self._length, self._check = (self._room(x, end) for x in (self._begin, self._length, self._check))
        self._ids = self._room(self._ids, self._used + len(ids))
        self._begin[first:end] = self._used + np.cumsum(lengths) - lengths
        self._length[first:end] = lengths
        self._check[first : first + len(checks)] = checks
        self._ids[self._used : self._used + len(ids)] = ids
        self._used += len(ids)
        # long pieces (texts without spaces) hardly come again, and their ids would fill the memory
        if max(map(len, pieces), default=0) > LONG:
            self._slot.update((k, first + i) for i, k in enumerate(keys) if len(pieces[i]) <= LONG)
        else:
            self._slot.update(zip(keys, range(first, first + len(keys)), strict=True))
        return np.arange(first, end)

    def encode_flat(self, raw: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and how many each text has."""
        if self._slots > self.remembered or self._used > HELD_IDS:
            self._forget()
        begin = self._cuts(raw, begins, self._added_at(raw, begins))
        if not len(begin):
            return np.empty(0, np.uint32), np.zeros(len(begins) - 1, np.int64)
        end = np.append(begin[1:], len(raw))
        one, two = sums_by_place(raw, begin)
        texts = lambda which: [raw[a:b].tobytes() for a, b in zip(begin[which].tolist(), end[which].tolist(), strict=True)]
        distinct, at, which = np.unique(one, return_index=True, return_inverse=True)
        keys = distinct.tolist()
        slots = np.fromiter((self._slot.get(k, -1) for k in keys), np.int64, len(keys))
        if len(new := np.flatnonzero(slots < 0)):
            slots[new] = self._learn(texts(at[new]), [keys[i] for i in new.tolist()], two[at[new]])
        slot = slots[which]
        if len(other := np.flatnonzero(self._check[slot] != two)):  # another piece has the same first hash
            slot[other] = self._learn(texts(other), [], np.empty(0, np.uint64))
        lengths = self._length[slot]
        before = np.concatenate([[0], np.cumsum(lengths)])
        counts = np.diff(before[np.searchsorted(begin, begins)])
        return self._ids[ragged(self._begin[slot], lengths)], counts


def encoded(texts: pa.Array, encoder: PieceEncoder, step: int = STEP):
    """(index of the first text, ids in a row, ids of each text) for slices of the texts, each text with END_ID last."""
    raw, begins = flat(texts)
    for low, high in slices(begins, step):
        own = begins[low : high + 1]
        ids, counts = encoder.encode_flat(raw[own[0] : own[-1]], own - own[0])
        out = np.full(len(ids) + len(counts), END_ID, np.uint32)
        out[ragged(np.cumsum(counts) - counts + np.arange(len(counts)), counts)] = ids
        yield low, out, counts + 1
