"""Exact division of texts into chunks that tokenizers treat alone, and a bounded store of what each chunk gave.

Byte-level pre-tokenizers never let a match run over "a character that is not white space, then one space
or newline", and no piece of the sentencepiece vocabularies in use holds a space after its first character.
Texts may therefore be cut before each single space and newline, and equal chunks give equal tokens. Texts
with runs of white space go through a pattern that keeps each run whole.
"""

from __future__ import annotations

import re

import numpy as np

RUNS = re.compile(r"[ \n]*[^ \n]+|[ \n]+\Z")
#: White space other than spaces and newlines; none of it is printable to str.isprintable().
WIDE = re.compile("[\\t\\r\\x0b\\x0c\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")


def chunks(text: str) -> list[str]:
    """The chunks of a text; they concatenate to it."""
    if not text:
        return []
    spaced = text.replace("\n", " \n")
    if "  " in spaced or spaced[-1] in " \n" or spaced[0] in " \n" or not (text.replace("\n", "").isprintable() or not WIDE.search(text)):
        return cut_runs(text)
    parts = spaced.split(" ")
    return [parts[0], *[p if p[0] == "\n" else " " + p for p in parts[1:]]]


def cut_runs(text: str) -> list[str]:
    """As chunks(), with runs of white space kept whole, each with what follows it."""
    return RUNS.findall(text) if text.strip() else [text]


def _byte_table(*groups: tuple[int, ...]) -> np.ndarray:
    table = np.zeros(256, np.uint8)
    for bit, group in enumerate(groups):
        table[list(group)] |= 1 << bit
    return table


_PUNCTUATION = tuple(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
_LETTERS = (*range(65, 91), *range(97, 123))
#: Bits: 0 a space or newline; 1 ASCII white space of any kind; 2 may begin white space beyond ASCII; 3 ASCII
#: punctuation; 4 an ASCII letter.
_KINDS = _byte_table((32, 10), (*range(9, 14), *range(28, 33)), (0xC2, 0xE1, 0xE2, 0xE3), _PUNCTUATION, _LETTERS)


def cut_places(data: np.ndarray, marks: bool = True) -> np.ndarray:
    """True where UTF-8 bytes may be cut: before a single space or newline with other characters on both sides
    and, with marks, before ASCII punctuation that follows a letter of ASCII or Latin-1."""
    kinds = _KINDS[data]
    cut = (kinds & 1).astype(bool)
    white = kinds & 2
    wide = kinds & 4
    cut[:-1] &= (white[1:] | wide[1:]) == 0
    cut[-1:] = False
    cut[1:] &= white[:-1] == 0
    # a character of white space beyond ASCII may end just before: two bytes from C2, three from E1 to E3
    high = data >= 0x80
    cut[2:] &= ~((data[:-2] == 0xC2) & high[1:-1])
    cut[3:] &= ~((wide[:-3] > 0) & high[2:-1] & high[1:-2])
    if marks:
        letter = (kinds & 16) > 0
        letter[1:] |= (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        cut[1:] |= letter[:-1] & ((kinds[1:] & 8) > 0)
    cut[:1] = False
    return cut


#: Bytes of a chunk that its name holds; longer chunks are named by a number of their own.
NAMED = 16
_WORD_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [2**64 - 1] * 9, np.uint64)
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xFF51AFD7ED558CCD))


def words_at(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The first 16 bytes of each run as two little-endian words, zero beyond its end; data has 16 bytes to spare."""
    words = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))
    short = np.minimum(lengths, NAMED)
    out = np.empty((2, len(starts)), np.uint64)
    out[0] = words[starts] & _WORD_MASKS[np.minimum(short, 8)]
    out[1] = 0
    more = np.flatnonzero(short > 8)
    out[1, more] = words[starts[more] + 8] & _WORD_MASKS[short[more] - 8]
    return out


class ChunkPool:
    """Ids of chunks by their exact bytes; encodes the chunks that it lacks.

    Chunks are cut, named and looked up in numpy for a whole slice of texts at once. A name is three integers:
    for up to 16 bytes the bytes themselves and their number, for more a number that a dictionary gives these very
    bytes. So unlike chunks never share a name, whatever they hold. The size is bounded: when full, the chunks
    met most often stay, half of the limits at most.
    """

    def __init__(self, encode_new, whole: tuple[bytes, ...] = (), limit: int = 300_000, limit_ids: int = 2_500_000):
        """whole: strings that must not be cut; a slice that holds one is cut at white space alone."""
        self.encode_new, self.whole, self.limit, self.limit_ids = encode_new, whole, limit, limit_ids
        self.numbers: dict[bytes, int] = {}
        self.long_bytes = self.next_number = 0
        self.reset(1 << 16)

    def reset(self, slots: int):
        self.slots = slots
        self.table = np.full(slots, -1, np.int32)
        self.flat, self.lengths, self.starts, self.met = np.empty(1 << 16, np.int32), *np.zeros((3, 1 << 14), np.int64)
        self.names = np.zeros((3, 1 << 14), np.uint64)
        self.used = self.held = 0

    def full(self) -> bool:
        return self.used > self.limit or self.held + self.long_bytes // 4 > self.limit_ids

    def thin(self):
        """Keep what was met twice or more, the most often first, up to half of the limits."""
        met, lengths, names = self.met[: self.used].copy(), self.lengths[: self.used].copy(), self.names[:, : self.used].copy()
        sizes = lengths + np.where(names[2] > NAMED, names[2] // np.uint64(4), np.uint64(0)).astype(np.int64)
        stay = np.argsort(-met, kind="stable")
        stay = stay[(met[stay] > 1) & (np.cumsum(sizes[stay]) <= self.limit_ids // 2)][: self.limit // 2]
        flat = self.take(stay)
        left = set(names[0, stay[names[2, stay] > NAMED]].tolist())
        self.numbers = {k: n for k, n in self.numbers.items() if n in left}
        self.long_bytes = sum(map(len, self.numbers))
        self.reset(self.slots)
        self.put(names[:, stay], flat, lengths[stay])
        self.met[: self.used] = met[stay] // 2

    def take(self, place: np.ndarray) -> np.ndarray:
        """The ids at the places, one after the other."""
        lengths = self.lengths[place]
        ends = np.cumsum(lengths)
        pick = np.repeat(self.starts[place] - ends + lengths, lengths)
        pick += np.arange(len(pick))
        return self.flat[pick]

    @staticmethod
    def mixed(names: np.ndarray) -> np.ndarray:
        """One integer for each name, to place it in the table; unlike names may share it."""
        x = (names[1] + names[2]) * _MIX[1]
        x ^= x >> np.uint64(31)
        x = (x + names[0]) * _MIX[2]
        x ^= x >> np.uint64(29)
        return x * _MIX[0]

    def slot(self, mix: np.ndarray) -> np.ndarray:
        return (mix >> np.uint64(64 - (self.slots.bit_length() - 1))).astype(np.int64)

    def unlike(self, place: np.ndarray, names: np.ndarray) -> np.ndarray:
        """Whether the chunks at the places have other names."""
        return (self.names[0][place] != names[0]) | (self.names[1][place] != names[1]) | (self.names[2][place] != names[2])

    def find(self, names: np.ndarray, mix: np.ndarray) -> np.ndarray:
        """Places of the chunks with these names; -1 for those that the pool lacks."""
        slot = self.slot(mix)
        place = self.table[slot]
        on = np.flatnonzero((place >= 0) & self.unlike(place, names))
        while len(on):
            slot[on] = (slot[on] + 1) & (self.slots - 1)
            place[on] = there = self.table[slot[on]]
            on = on[(there >= 0) & self.unlike(there, names[:, on])]
        return place

    def enter(self, first: int) -> None:
        """Put the places from `first` on into the table."""
        place = np.arange(first, self.used)
        slot = self.slot(self.mixed(self.names[:, first : self.used]))
        while len(place):
            free = np.flatnonzero(self.table[slot] < 0)
            self.table[slot[free]] = place[free]
            left = self.table[slot] != place
            place, slot = place[left], (slot[left] + 1) & (self.slots - 1)

    def put(self, names: np.ndarray, flat: np.ndarray, lengths: np.ndarray) -> None:
        n = len(lengths)
        if (need := self.held + len(flat)) > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.held], np.empty(max(need, 2 * self.held) - self.held, np.int32)])
        if (need := self.used + n) > len(self.lengths):
            more = np.zeros(max(need, 2 * self.used) - self.used, np.int64)
            self.lengths, self.starts, self.met = (np.concatenate([x[: self.used], more]) for x in (self.lengths, self.starts, self.met))
            self.names = np.concatenate([self.names[:, : self.used], np.zeros((3, len(more)), np.uint64)], axis=1)
        self.flat[self.held : self.held + len(flat)] = flat
        at = slice(self.used, self.used + n)
        self.lengths[at], self.names[:, at], self.met[at] = lengths, names, 0
        self.starts[at] = self.held + np.cumsum(lengths) - lengths
        self.held += len(flat)
        first, self.used = self.used, self.used + n
        if 2 * self.used > self.slots:
            self.slots = 1 << (4 * self.used).bit_length()
            self.table = np.full(self.slots, -1, np.int32)
            first = 0
        self.enter(first)

    def name(self, data: np.ndarray, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The names of runs of bytes: equal for equal bytes and for no others."""
        sizes = ends - starts
        out = np.empty((3, len(starts)), np.uint64)
        out[:2] = words_at(np.concatenate([data, np.zeros(NAMED, np.uint8)]), starts, sizes)
        out[2] = sizes
        for k in np.flatnonzero(sizes > NAMED).tolist():
            chunk = raw[starts[k] : ends[k]]
            if (number := self.numbers.get(chunk)) is None:
                self.numbers[chunk] = number = self.next_number
                self.next_number += 1
                self.long_bytes += len(chunk)
            out[0, k], out[1, k] = number, 0
        return out

    def encode_bytes(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts data[offsets[i]:offsets[i + 1]], and how many each text has."""
        if self.full():
            self.thin()
        if not len(data):
            return np.empty(0, np.int32), np.zeros(len(offsets) - 1, np.int64)
        raw = data.tobytes()
        begins = cut_places(data, marks=not any(w in raw for w in self.whole))
        begins[offsets[:-1][offsets[:-1] < len(data)]] = True
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(data))
        names = self.name(data, raw, starts, ends)
        mix = self.mixed(names)
        place = self.find(names, mix)
        while len(lacks := np.flatnonzero(place < 0)):
            # the first of each mix: unlike chunks that share one wait for the next turn
            first = lacks[np.unique(mix[lacks], return_index=True)[1]]
            new = [raw[a:b].decode() for a, b in zip(starts[first].tolist(), ends[first].tolist())]
            self.put(names[:, first], *self.encode_new(new))
            place[lacks] = self.find(names[:, lacks], mix[lacks])
        np.add.at(self.met, place, 1)
        before = np.concatenate([[0], np.cumsum(self.lengths[place])])
        return self.take(place), np.diff(before[np.searchsorted(starts, offsets)])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw = [t.encode() for t in texts]
        offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))])
        return self.encode_bytes(np.frombuffer(b"".join(raw), np.uint8), offsets)

    def encode_array(self, column, limit: int):
        """encode() for a string array (null: empty) in slices of about `limit` bytes; a longer text comes alone."""
        column = column.fill_null("") if column.null_count else column
        if not len(column):
            return
        wide = str(column.type) == "large_string"
        buffers = column.buffers()
        offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        data = np.frombuffer(buffers[2] or b"", np.uint8)
        k = 0
        while k < len(column):
            to = max(k + 1, int(np.searchsorted(offsets, offsets[k] + limit, side="right")) - 1)
            yield self.encode_bytes(data[offsets[k] : offsets[to]], offsets[k : to + 1] - offsets[k])
            k = to
