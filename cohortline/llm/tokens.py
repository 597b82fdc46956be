"""Token ids of texts from the files of public tokenizers, by the tokenizers library.

A byte-level pre-tokenizer always parts words where a space follows a character that isn't white space, so a text's
ids are those of its units: its parts at such places. Units of nothing but letters, stops, commas and single line feeds are
parted once more, where letters begin or end. Pieces of at most 24 bytes recur: each worker process keeps their ids, within a
bound, in a hash table of numpy arrays that holds the bytes themselves, and looks up the pieces of many texts at a time.
The library is asked for the others. A null text is an empty text. Long texts are taken some units at a time.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np

from cohortline.llm.text import mix, per_process

PART, BATCH = 200_000, 1_000_000  # characters; a batch has one part at least
SLOTS, KEPT_UNITS, KEPT_IDS = 1 << 21, 1_000_000, 8_000_000  # bounds of what is kept when a batch begins
WIDTH = 24  # bytes of a kept piece
_CUT = re.compile(r"(?<=[!-~])(?= [!-~])")
#: White space before a space, which goes with it; a superset of what pre-tokenizers take for white space.
_JOINED = [chr(c) + " " for c in range(0x3001) if chr(c).isspace()]


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load(path: str):
    """The tokenizer of a ``.json`` file, once per worker process, on one thread."""

    def make():
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        return Tokenizer.from_file(path)

    return per_process(f"tokenizer {path}", make)


_OTHER, _LETTER, _SIGN, _FEED, _SPACE = range(5)
_KINDS = np.zeros(256, dtype=np.uint8)
_KINDS[[*range(65, 91), *range(97, 123)]] = _LETTER
_KINDS[[ord("."), ord(",")]] = _SIGN
_KINDS[ord("\n")], _KINDS[ord(" ")] = _FEED, _SPACE
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[*range(9, 14), *range(28, 33)]] = True
_WHITE_TAIL = np.zeros(256, dtype=bool)  # last bytes of other white space in UTF-8
_WHITE_TAIL[[chr(c).encode()[-1] for c in range(128, 0x3001) if chr(c).isspace()]] = True
_MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=np.uint64)


def _before(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The value before each one; nothing comes before those at ``starts``."""
    out = np.empty_like(values)
    out[1:] = values[:-1]
    out[starts] = 0
    return out


def _cut(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where the pieces of texts begin; ``starts`` has the places where texts of one byte or more do."""
    kind = _KINDS[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)  # Latin letters of two bytes, but for the signs of times and division
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
    kind[lead] = kind[lead + 1] = _LETTER
    white, last = _WHITE[data], _before(data, starts)
    doubled = white & _WHITE[last]
    at = np.flatnonzero((data == 32) & ~doubled)
    at = at[~_WHITE_TAIL[last[at]] | (last[at] < 128) | ((last[at] >= 128) & (kind[at - 1] == _LETTER))]
    first = np.zeros(len(data), dtype=bool)
    first[at] = True
    first[starts] = True
    unit = np.cumsum(first, dtype=np.int32) - 1
    odd = np.zeros(int(unit[-1]) + 1, dtype=bool)
    odd[unit[(kind == _OTHER) | doubled]] = True
    letter = kind == _LETTER
    edge = np.flatnonzero((letter != _before(letter, starts)) & (last != 32) & ~first)
    first[edge[~odd[unit[edge]]]] = True
    return np.flatnonzero(first)


class Units:
    """The ids of texts, by the pieces that were met before."""

    def __init__(self, path: str):
        self.whole = load(path)
        self.model = self.whole.model
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in the vocabulary
        rest = (c for c in range(256) if c not in plain)
        self.letters = {c: 256 + i for i, c in enumerate(rest)}
        self._clear()

    def _clear(self) -> None:
        self.slots = np.full(SLOTS, -1, dtype=np.int32)
        self.n, self.used = 0, 0
        self.keys = np.empty((1 << 14, 3), dtype=np.uint64)
        self.at = np.empty(1 << 14, dtype=np.int64)  # place in the pool of ids
        self.size = np.empty(1 << 14, dtype=np.int32)
        self.pool = np.empty(1 << 16, dtype=np.uint32)

    def _library(self, pieces: list[str]) -> list[list[int]]:
        """Ids of each piece; those of letters straight from the merges, as the pre-tokenizer leaves them whole."""
        out: list = [None] * len(pieces)
        others = []
        tokenize = self.model.tokenize
        for i, piece in enumerate(pieces):
            stem = piece[1:] if piece[:1] == " " else piece
            if not stem.isalpha() or max(stem) >= "\u0250":
                others.append(i)
            elif stem.isascii():
                out[i] = [t.id for t in tokenize(piece.replace(" ", "\u0120"))]
            else:
                out[i] = [t.id for t in tokenize(piece.encode().decode("latin-1").translate(self.letters))]
        for i, e in zip(others, self.whole.encode_batch_fast([pieces[i] for i in others], add_special_tokens=False), strict=True):
            out[i] = e.ids
        return out

    def _stored(self, lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """Place and size of each list of ids, put at the end of the pool."""
        sizes = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
        end = self.used + int(sizes.sum())
        if end > len(self.pool):
            self.pool = np.concatenate([self.pool[:self.used], np.empty(2 * end - self.used, dtype=np.uint32)])
        self.pool[self.used:end] = [i for ids in lists for i in ids]
        places = self.used + np.cumsum(sizes) - sizes
        self.used = end
        return places, sizes

    def _find(self, keys: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The entry of each key, -1 if there is none."""
        found = np.full(len(keys), -1, dtype=np.int64)
        todo = np.arange(len(keys))
        slot = (h >> np.uint64(40)).astype(np.int64) % SLOTS
        while len(todo):
            e = self.slots[slot]
            some = e >= 0
            todo, slot, e = todo[some], slot[some], e[some]
            same = (self.keys[e] == keys[todo]).all(axis=1)
            found[todo[same]] = e[same]
            todo, slot = todo[~same], (slot[~same] + 1) % SLOTS
        return found

    def _add(self, keys: np.ndarray, h: np.ndarray, lists: list[list[int]]) -> np.ndarray:
        """Keep new keys, which differ from each other, with their ids; returns their entries."""
        n = self.n + len(keys)
        if n > len(self.at):
            spare = 2 * n - len(self.at)
            self.keys = np.concatenate([self.keys, np.empty((spare, 3), dtype=np.uint64)])
            self.at = np.concatenate([self.at, np.empty(spare, dtype=np.int64)])
            self.size = np.concatenate([self.size, np.empty(spare, dtype=np.int32)])
        entries = np.arange(self.n, n)
        self.keys[entries] = keys
        self.at[entries], self.size[entries] = self._stored(lists)
        todo, slot = entries, (h >> np.uint64(40)).astype(np.int64) % SLOTS
        while len(todo):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = todo[free]  # of several, one gets the slot
            left = self.slots[slot] != todo
            todo, slot = todo[left], (slot[left] + 1) % SLOTS
        self.n = n
        return entries

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if self.n > KEPT_UNITS or self.used > KEPT_IDS:
            self._clear()
        coded = [t.encode() for t in texts]
        ends = np.cumsum([len(c) for c in coded])
        begins = np.concatenate([[0], ends[:-1]])
        n = int(ends[-1])
        if not n:
            return [np.zeros(0, dtype="<u4") for _ in texts]
        raw = b"".join(coded)
        padded = np.frombuffer(raw + bytes(WIDTH + 8), dtype=np.uint8)
        first = _cut(padded[:n], begins[begins < ends])
        sizes = np.diff(first, append=n)
        places, lengths = np.zeros(len(first), dtype=np.int64), np.zeros(len(first), dtype=np.int64)
        short = (sizes <= WIDTH) & (padded[first + sizes - 1] != 0)  # zero bytes fill up the keys
        at = np.flatnonzero(short)
        eight = np.ndarray((n + WIDTH,), dtype="<u8", buffer=padded, strides=(1,))
        keys = np.stack([eight[first[at] + 8 * i] & _MASKS[np.clip(sizes[at] - 8 * i, 0, 8)] for i in range(3)], axis=1)
        h = mix(keys[:, 0] ^ mix(keys[:, 1] ^ mix(keys[:, 2])))
        entry = self._find(keys, h)
        new = np.flatnonzero(entry < 0)
        apart = np.flatnonzero(~short)
        if len(new):
            _, one, group = np.unique(h[new], return_index=True, return_inverse=True)
            one = new[one]
            same = (keys[one[group]] == keys[new]).all(axis=1)
            apart = np.concatenate([apart, at[new[~same]]])  # other pieces of one hash
            lists = self._library([raw[p:p + s].decode() for p, s in zip(first[at[one]].tolist(), sizes[at[one]].tolist())])
            entry[new[same]] = self._add(keys[one], h[one], lists)[group[same]]
        known = entry >= 0
        places[at[known]], lengths[at[known]] = self.at[entry[known]], self.size[entry[known]]
        if len(apart):
            kept = self.used
            places[apart], lengths[apart] = self._stored(self._library([raw[p:p + s].decode() for p, s in zip(first[apart].tolist(), sizes[apart].tolist())]))
            self.used = kept  # only this batch needs them
        done = np.concatenate([[0], np.cumsum(lengths)])
        ids = self.pool[np.repeat(places - done[:-1], lengths) + np.arange(done[-1])]
        cuts = done[np.searchsorted(first, np.append(begins, n))]
        return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


def parts(text: str, size: int = PART) -> Iterator[str]:
    at = 0
    while len(text) - at > size:
        cut = _CUT.search(text, at + size)
        if not cut:
            break
        yield text[at:cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def has_joined(text: str) -> bool:
    return text.startswith(" ") or any(j in text for j in _JOINED)


def units(text: str) -> list[str]:
    """The units of a text; joined, they give it."""
    first, *rest = text.split(" ")
    if not has_joined(text):
        return [first, *(" " + r for r in rest)]
    out = [first]
    for r in rest:
        if not out[-1] or out[-1][-1].isspace():  # white space before a space goes with it
            out[-1] += " " + r
        else:
            out.append(" " + r)
    return out


def encode(path: str, texts: Iterator[str | None]) -> Iterator[np.ndarray]:
    """The ids of each text as unsigned 32-bit numbers, without special tokens added."""
    known = per_process(f"units {path}", lambda: Units(path))
    batch, of, size = [], [], 0  # parts, and the number of parts of each text; the last text may go on

    def coded() -> Iterator[np.ndarray]:
        ids = iter(known.encode(batch)) if batch else iter(())
        for n in of:
            found = [next(ids) for _ in range(n)]
            yield found[0] if n == 1 else np.concatenate(found)

    for text in texts:
        before: list[np.ndarray] = []
        pieces = 0
        for part in parts(text or ""):
            if size and size + len(part) > BATCH:
                if pieces:  # a long text is coded on the way
                    of.append(pieces)
                *whole, last = coded()
                yield from whole
                if pieces:
                    before.append(last)
                else:
                    yield last
                batch, of, size, pieces = [], [], 0, 0
            batch.append(part)
            size, pieces = size + len(part), pieces + 1
        of.append(pieces)
        if before:
            *whole, last = coded()
            yield from whole
            yield np.concatenate([*before, last])
            batch, of, size = [], [], 0
    yield from coded()
