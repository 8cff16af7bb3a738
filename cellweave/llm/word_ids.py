"""Subword ids of texts by the words: those of a word and the white space before it are made once and then found by hash.

GPT2_LIKE ends a match wherever a word is followed by white space, and what it makes of a word and the white space before it
depends on nothing else. That does not hold where a word has a white space of its own, outside ASCII: such texts are encoded whole.
"""

from __future__ import annotations

import contextlib
import re
from collections.abc import Iterator, Sequence

import numpy as np

from cellweave.llm.byte_bpe import GPT2_LIKE
from cellweave.llm.common import spaced_hashes

MARK = b" \xff "  # the end in bytes: a word that no UTF-8 text has
END = np.uint64(0)  # stands for the end among word hashes
TOGETHER = 16  # texts whose words are hashed at once
SLOTS = 21  # bits of a hash that lead to its slot
MOST = 1 << 20  # words that are known at once
HELD = 1 << 20  # words that wait to be counted
SIZE_BITS = 28  # that hold how many ids a unit has

_LOWER = bytes(x + 32 if 65 <= x < 91 else x for x in range(256))
_BLANK = re.compile("[" + "".join(map(chr, (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))) + "]")


def encoder(ranks: dict[bytes, int], pattern: str):
    import tiktoken

    return tiktoken.Encoding("subwords", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _longer(x: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
    """x, with more after its used part."""
    if used + len(more) > len(x):
        x = np.append(x[:used], np.zeros(used + 2 * len(more), x.dtype))
    x[used : used + len(more)] = more
    return x


def _pieces(raw: np.ndarray, first: np.ndarray, size: np.ndarray, gap: int) -> np.ndarray:
    """Stretches of raw, one after another, with room for gap items after each (which repeat the last ones)."""
    room = size + gap
    after = np.cumsum(room)
    at = np.repeat(first - after + room, room) + np.arange(int(after[-1]))
    return raw.take(at, mode="clip")


class WordIds:
    """Encodes texts, A-Z lower-cased, and counts the words and ids of some.

    A unit is a word and the white space before it. Units stand in a table of open addresses: in a unit's slot are its hash,
    the hash of its word, and where its ids begin (times 2^SIZE_BITS) and how many they are; none for an odd one, of which
    nothing is known by itself.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.pattern = ranks, pattern
        self.encoder, self.end, self.by_word = encoder(ranks, pattern), len(ranks), pattern == GPT2_LIKE
        self.kind = np.dtype(np.uint16 if self.end < 1 << 16 else np.uint32)
        self.line = ranks.get(b"\n", -1)
        self.pieces = np.zeros(self.end + 1, np.int64)
        self.done: list[tuple[np.ndarray, np.ndarray]] = []
        self._clear(0)

    def _clear(self, room: int) -> None:
        """Nothing is known; there is room for so many units at least, with a quarter of the slots left free."""
        self.bits = max(SLOTS, (4 * room // 3).bit_length())
        self.units, self.words = np.zeros((2, 1 << self.bits), np.uint64)
        self.where, self.n = np.zeros((2, 1 << self.bits), np.int64)
        self.ids, self.used, self.size = np.zeros(0, self.kind), 0, 0
        self.held: list[np.ndarray] = []
        self.waiting = 0

    @property
    def full(self) -> bool:
        return self.size > MOST or self.used > 8 * MOST or bool(self.done)

    def _find(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The slots of units, where they are known, and the numbers of those that are not."""
        slot = (units >> np.uint64(64 - self.bits)).astype(np.int64)
        there = self.units.take(slot)
        rest = np.flatnonzero(there != units)
        there = there.take(rest)
        new = [rest[there == 0]]
        rest = rest[there != 0]
        while len(rest):
            slot[rest] = at = (slot.take(rest) + 1) & ((1 << self.bits) - 1)
            there = self.units.take(at)
            new.append(rest[there == 0])
            rest = rest[(there != 0) & (there != units.take(rest))]
        return slot, np.concatenate(new)

    def _add(self, units: np.ndarray) -> np.ndarray:
        """The slots of different units, of which none was there."""
        slot, rest = (units >> np.uint64(64 - self.bits)).astype(np.int64), np.arange(len(units))
        while len(rest):
            at = slot.take(rest)
            free = self.units.take(at) == 0
            self.units[at[free]] = units[rest[free]]  # of several in a slot, one stays
            rest = rest[self.units.take(at) != units.take(rest)]
            slot[rest] = (slot.take(rest) + 1) & ((1 << self.bits) - 1)
        self.size += len(units)
        return slot

    def _encoded(self, text: bytes) -> np.ndarray:
        return self.encoder.encode_to_numpy(text.decode(), disallowed_special=()).astype(self.kind)

    def _learn(self, units: np.ndarray, words: np.ndarray, low: bytes, first: np.ndarray, start: np.ndarray, stop: np.ndarray) -> None:
        """Units by their hashes; each is low[first:stop], its word begins at start and has the hash in words."""
        raw = np.frombuffer(low, np.uint8)
        marked, gap = raw.take(start) == MARK[1], start - first
        sizes, ids = np.zeros(len(units), np.int64), []
        odd = np.full(len(units), not self.by_word) & ~marked
        if self.by_word and (i := np.flatnonzero(~marked)).size:
            text = _pieces(raw, start[i], stop[i] - start[i], 0)
            if text.max() > 127 and _BLANK.search(text.tobytes().decode()):
                odd[i] = [bool(_BLANK.search(low[a:b].decode())) for a, b in zip(start[i].tolist(), stop[i].tolist())]
        usual = ~odd & ~marked
        blank, line = usual & ((gap == 0) | (gap == 1) & (raw.take(first) == 32)), usual & (gap == 1) & (raw.take(first) == 10)
        order = []
        if len(i := np.flatnonzero(blank)):  # no word has a line feed, so that its id parts them
            text = _pieces(raw, first[i], stop[i] - first[i], 1)
            text[np.cumsum(stop[i] - first[i] + 1) - 1] = 10
            got = self._encoded(text.tobytes())
            cuts = np.flatnonzero(got == self.line)
            sizes[i] = np.diff(cuts, prepend=-1) - 1
            ids.append(got[got != self.line])
            order.append(i)
        if len(i := np.flatnonzero(line)):
            got = self._encoded(_pieces(raw, first[i], stop[i] - first[i], 0).tobytes())
            sizes[i] = np.diff(np.flatnonzero(got == self.line), append=len(got))
            ids.append(got)
            order.append(i)
        for i in np.flatnonzero(marked | usual & ~blank & ~line).tolist():
            a, b = int(first[i]), int(stop[i])
            got = np.append(self._encoded(low[a : b - 2]), self.kind.type(self.end)) if marked[i] else self._encoded(low[a:b])
            sizes[i] = len(got)
            ids.append(got)
            order.append(np.array([i]))
        where = np.zeros(len(units), np.int64)
        if order:
            there = np.concatenate(order)
            own = sizes[there]
            where[there] = (self.used + np.cumsum(own) - own << SIZE_BITS) + own
            more = np.concatenate(ids)
            self.ids = _longer(self.ids, self.used, more)
            self.used += len(more)
        slot = self._add(units)
        self.where[slot] = where
        self.words[slot] = np.where(marked, END, words)

    def encode(self, texts: Sequence[bytes], counted: Sequence[bool]) -> list[bytes]:
        """The ids of each text and the end, as bytes. Those counted say so."""
        out: list[bytes] = []
        for at in range(0, len(texts), TOGETHER):
            own, count = texts[at : at + TOGETHER], np.array(counted[at : at + TOGETHER], bool)
            joined = b"".join([y for x in own for y in (x, MARK)])
            units, words, first, start, stop = spaced_hashes(joined, MARK[1])
            units[units == 0] = 1
            slot, new = self._find(units)
            if 4 * (self.size + len(new)) > 3 << self.bits:
                self._finish()
                self._clear(len(np.unique(units)))
                slot, new = self._find(units)
            if len(new):
                different, i = np.unique(units.take(new), return_index=True)
                i = new.take(i)
                self._learn(different, words(i), joined.translate(_LOWER), first.take(i), start.take(i), stop.take(i))
                slot[new] = self._find(units.take(new))[0]
            where = self.where.take(slot)
            sizes = where & ((1 << SIZE_BITS) - 1)
            ends = np.flatnonzero(np.frombuffer(joined, np.uint8).take(start) == MARK[1]) + 1
            after = np.cumsum(sizes)
            data = _pieces(self.ids, where >> SIZE_BITS, sizes, 0).tobytes()
            cuts = [0, *(after[ends - 1] * self.kind.itemsize).tolist()]
            made = [data[a:b] for a, b in zip(cuts, cuts[1:])]
            if not sizes.all():
                for i in np.unique(np.searchsorted(ends, np.flatnonzero(sizes == 0), side="right")).tolist():
                    ids = np.append(self._encoded(own[i].translate(_LOWER)), self.kind.type(self.end))
                    if count[i]:  # its own ids are counted, in the place of those of its words
                        self.pieces += np.bincount(ids, minlength=self.end + 1) - np.bincount(np.frombuffer(made[i], self.kind), minlength=self.end + 1)
                    made[i] = ids.tobytes()
            out += made
            self.held.append(slot if count.all() else slot[np.repeat(count, np.diff(ends, prepend=0))])
            self.waiting += len(self.held[-1])
            if self.waiting > HELD:
                self._count()
        return out

    def _count(self) -> None:
        if self.waiting:
            self.n += np.bincount(np.concatenate(self.held), minlength=1 << self.bits)
        self.held, self.waiting = [], 0

    def _finish(self) -> None:
        """What is counted goes to done, by word."""
        self._count()
        came = np.flatnonzero(self.n)
        words, n, where = self.words.take(came), self.n.take(came), self.where.take(came)
        if len(came):
            sizes = where & ((1 << SIZE_BITS) - 1)
            self.pieces += np.bincount(_pieces(self.ids, where >> SIZE_BITS, sizes, 0), np.repeat(n, sizes), self.end + 1).astype(np.int64)
            self.done.append((words, n))
        self.n[:] = 0

    def take_words(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the different words counted and how often each came; afterwards none is counted, and none known if full."""
        self._finish()
        words, n = (np.concatenate([x[i] for x in self.done] or [np.zeros(0, kind)]) for i, kind in enumerate((np.uint64, np.int64)))
        self.done = []
        if len(words):
            order = np.argsort(words)
            words, n = words.take(order), n.take(order)
            edge = np.flatnonzero(np.append(True, words[1:] != words[:-1]))
            words, n = words.take(edge), np.add.reduceat(n, edge)
        if self.full:
            self._clear(0)
        return words, n


_KEPT: list[WordIds] = []


@contextlib.contextmanager
def kept(ranks: dict[bytes, int], pattern: str) -> Iterator[WordIds]:
    """A WordIds that has counted nothing. The worker keeps it for its next task, which so knows the words of this one."""
    known = _KEPT.pop() if _KEPT else None
    if known is None or known.pattern != pattern or known.ranks != ranks:
        known = WordIds(ranks, pattern)
    known.pieces[:] = 0
    yield known
    _KEPT[:] = [known]  # not after an error, which may leave half of a change


def forget() -> None:
    """Nothing is kept for later tasks."""
    _KEPT.clear()
