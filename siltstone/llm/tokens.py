"""Word-level BPE ids for whole blocks of texts.

The vocabulary file (``tokenizers`` JSON, BPE with word ends) splits every text
at white space and at changes of class (letters, each digit, the rest), so a
text's ids are its parts' ids end to end. Blocks are lower-cased and split by
byte masks in numpy, parts are numbered by Arrow, and each distinct part is
encoded once: all parts' symbol rows are merged together in numpy, best-ranked
pair first. Parts met before are looked up in a table of at most ``MAX_KNOWN``.
Whatever this fast path does not cover (long parts, letters outside the Latin
blocks, odd blanks, special tokens) goes to the library's own encoder, so ids
always equal its ids.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from .common import blocks

#: Parts of more bytes, and words with code points above the next bound, go to the library's encoder.
MAX_WORD = 48
_LAST_PLAIN = 0x24F
#: Parts (and bytes of ids for each) that are kept for later blocks.
MAX_KNOWN = 200_000
BLOCK_BYTES = 2_000_000
#: Parts that are merged at once.
GRID_ROWS = 16_384
_BLANK, _LETTER, _DIGIT, _MARK, _ODD = range(5)
_NEVER = 2**30


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Class and lower-case form of the code points of up to two bytes below U+0280."""
    kind, low = np.full(0x280, _ODD, dtype=np.uint8), np.arange(0x280)
    for code in range(_LAST_PLAIN + 1):
        c = chr(code)
        if len(c.lower()) > 1 or ord(c.lower()) > 0x7FF or code < 0x80 and not c.isprintable() and not c.isspace():
            continue
        low[code] = ord(c.lower())
        kind[code] = _BLANK if c.isspace() else _LETTER if regex.match(r"\p{L}", c) else _DIGIT if regex.match(r"\p{N}", c) else _MARK
    return kind, low


_KIND_OF, _LOW_OF = _tables()
#: By byte; those of longer characters are odd until looked at.
_KIND = np.concatenate((_KIND_OF[:128], np.full(128, _ODD, np.uint8)))
_LOW = np.concatenate((_LOW_OF[:128], np.arange(128, 256))).astype(np.uint8)
#: Three-byte blanks at which words end, and three-byte characters whose texts only the library may split.
_WIDE_BLANKS = np.array([0x1680, *range(0x2000, 0x200B), 0x205F, 0x3000])
_WIDE_ODD = np.array([*range(0x200B, 0x2010), *range(0x2028, 0x2030), 0xFEFF])


class WordBpe:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        spec = json.loads(open(path, encoding="utf-8").read())
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        suffix = spec["model"]["end_of_word_suffix"]
        letters = _byte_letters()
        self.inner = np.array([vocab[c] for c in letters], dtype=np.int64)
        self.final = np.array([vocab[c + suffix] for c in letters], dtype=np.int64)
        self._index(vocab, [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges])
        self._forget()

    def _forget(self) -> None:
        self.known, self.ids = pa.array([], pa.binary()), np.zeros(0, np.uint32)
        self.starts, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _index(self, vocab: dict[str, int], merges: list[tuple[str, str]]) -> None:
        """An open-addressing table in numpy: (left id, right id) to rank and merged id."""
        left = np.array([vocab[a] for a, _ in merges], dtype=np.uint64)
        right = np.array([vocab[b] for _, b in merges], dtype=np.uint64)
        made = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        keys = (left << np.uint64(20)) | right
        self.bits = int(len(keys) * 4).bit_length()
        self.keys = np.full(1 << self.bits, 2**63, dtype=np.uint64)
        self.rank = np.full(1 << self.bits, 2**30, dtype=np.int64)
        self.made = np.zeros(1 << self.bits, dtype=np.int64)
        todo, slot, self.probes = np.arange(len(keys)), self._slot(keys), 0
        while len(todo):
            self.probes += 1
            free = self.keys[slot] == 2**63
            first = np.zeros(len(todo), dtype=bool)
            first[np.unique(slot, return_index=True)[1]] = True
            take = free & first
            at, who = slot[take], todo[take]
            self.keys[at], self.rank[at], self.made[at] = keys[who], who, made[who]
            todo, slot = todo[~take], (slot[~take] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _look(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Table slot of each pair, -1 if the pair never merges."""
        keys = (left.astype(np.uint64) << np.uint64(20)) | right.astype(np.uint64)
        slot, found = self._slot(keys), np.full(len(keys), -1, dtype=np.int64)
        open_ = np.arange(len(keys))
        for _ in range(self.probes):
            here = self.keys[slot[open_]]
            hit = here == keys[open_]
            found[open_[hit]] = slot[open_[hit]]
            open_ = open_[~hit & (here != 2**63)]
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
        return found

    def _merge(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all parts (``data[begin : begin + size]``) end to end, and how many each has."""
        width, count = int(size.max()), len(size)
        flat = ragged(data, begin, size)
        grid = np.full((count, width + 1), -1, dtype=np.int32)
        grid[np.arange(width + 1) < size[:, None]] = self.inner[flat]
        grid[np.arange(count), size - 1] = self.final[flat[np.cumsum(size) - 1]]
        rank = np.full((count, width), _NEVER, dtype=np.int32)
        rows, cols = np.nonzero(grid[:, 1:] >= 0)
        slots = self._look(grid[rows, cols], grid[rows, cols + 1])
        rank[rows, cols] = np.where(slots >= 0, self.rank[slots], _NEVER)
        out = np.full((count, width), -1, dtype=np.int32)
        live, span = np.arange(count), np.arange(width + 1)
        # Each round merges the best pair, leftmost first, in every part that still has one.
        while len(live):
            at = rank.argmin(axis=1)
            row = np.arange(len(live))
            going = rank[row, at] < _NEVER
            if not going.all():
                stop = ~going
                out[live[stop], : grid.shape[1] - 1] = grid[stop, :-1]
                live, grid, rank, at = live[going], grid[going], rank[going], at[going]
                row = np.arange(len(live))
                if not len(live):
                    break
            made = self.made[self._look(grid[row, at], grid[row, at + 1])]
            later = span[: grid.shape[1] - 1] > at[:, None]  # drop column at + 1
            grid = np.where(later, grid[:, 1:], grid[:, :-1])
            grid[row, at] = made
            rank = np.where(later[:, : rank.shape[1] - 1], rank[:, 1:], rank[:, :-1])
            # The pair with the left neighbour, then the one with the right.
            for side, has in ((at - 1, at > 0), (at, grid[row, np.minimum(at + 1, grid.shape[1] - 1)] >= 0)):
                where, col = row[has], side[has]
                slots = self._look(grid[where, col], grid[where, col + 1])
                rank[where, col] = np.where(slots >= 0, self.rank[slots], _NEVER)
            gone = ~has
            inside = gone & (at < rank.shape[1])
            rank[row[inside], at[inside]] = _NEVER
        good = out >= 0
        return out[good].astype(np.uint32), good.sum(axis=1)

    def _encode_parts(self, parts: pa.BinaryArray, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all parts end to end, and how many each has; the library encodes those that are ``odd`` or long."""
        _, offsets, data = parts.buffers()
        ends = np.frombuffer(offsets, np.int32)[parts.offset : parts.offset + len(parts) + 1].astype(np.int64)
        size = np.diff(ends)
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        odd = odd | (size > MAX_WORD)
        plain = np.flatnonzero(~odd)
        order, made = plain[np.argsort(size[plain], kind="stable")], []
        counts = np.zeros(len(parts), dtype=np.int64)
        for lo in range(0, len(order), GRID_ROWS):  # of like length: the grids stay narrow
            chunk = order[lo : lo + GRID_ROWS]
            ids, counts[chunk] = self._merge(data, ends[chunk], size[chunk])
            made.append(ids)
        slow = np.flatnonzero(odd)
        for e, i in zip(self.library.encode_batch([parts[int(i)].as_py().decode() for i in slow], add_special_tokens=False), slow):
            counts[i] = len(e.ids)
            made.append(np.array(e.ids, dtype=np.uint32))
        order = np.concatenate((order, slow))
        starts = np.zeros(len(parts), dtype=np.int64)
        starts[order] = np.cumsum(counts[order]) - counts[order]
        return ragged(np.concatenate(made) if made else np.zeros(0, np.uint32), starts, counts), counts

    def _numbers(self, parts: pa.BinaryArray, odd: np.ndarray) -> np.ndarray:
        """The place in the table of known parts of each of ``parts`` (distinct); new ones are encoded and added."""
        place = pc.index_in(parts, value_set=self.known)
        new = np.asarray(place.is_null())
        place = np.array(place.fill_null(0), dtype=np.int64)
        if new.any():
            fresh = parts.filter(pa.array(new))
            ids, counts = self._encode_parts(fresh, odd[new])
            place[new] = len(self.known) + np.arange(len(counts))
            self.starts = np.concatenate((self.starts, len(self.ids) + np.cumsum(counts) - counts))
            self.known, self.ids = pa.concat_arrays([self.known, fresh]), np.concatenate((self.ids, ids))
            self.counts = np.concatenate((self.counts, counts))
        return place

    def _split(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of a block: where parts start, the lower-case bytes of all parts end to end, their ends there, parts that are odd words, texts that are odd."""
        n = len(data)
        kind, low = _KIND[data], _LOW[data]
        lead = np.flatnonzero((data >= 0xC2) & (data <= 0xC9))
        code = (data[lead] & 0x1F).astype(np.int64) << 6 | data[lead + 1] & 0x3F
        kind[lead] = kind[lead + 1] = _KIND_OF[code]
        low[lead], low[lead + 1] = 0xC0 | _LOW_OF[code] >> 6, 0x80 | _LOW_OF[code] & 0x3F
        wide = np.flatnonzero((data >= 0xE1) & (data <= 0xEF))
        wide_code = (data[wide] & 0x0F).astype(np.int64) << 12 | (data[wide + 1] & 0x3F).astype(np.int64) << 6 | data[wide + 2] & 0x3F
        for k in range(3):
            kind[wide[np.isin(wide_code, _WIDE_BLANKS)] + k] = _BLANK
        special = np.flatnonzero((data[:-1] == ord("<")) & (data[1:] == ord("|")))
        strange = (np.flatnonzero((data >= 0x1C) & (data <= 0x1F)), lead[code == 0x85], wide[np.isin(wide_code, _WIDE_ODD)], special)
        odd_texts = np.unique(np.searchsorted(offsets, np.concatenate(strange), side="right") - 1)
        for i in odd_texts:
            kind[offsets[i] : offsets[i + 1]] = _BLANK

        first = np.zeros(n + 1, dtype=bool)  # of a text
        first[offsets] = True
        solid = kind != _BLANK
        new = np.ones(n, dtype=bool)
        new[1:] = kind[1:] != kind[:-1]
        new |= (kind == _DIGIT) | first[:-1]
        new &= solid & ((data & 0xC0) != 0x80)
        # Words with an odd character stay whole, as they are written.
        whole = np.zeros(n, dtype=bool)
        odd_words = np.flatnonzero(kind == _ODD)
        if len(odd_words):
            before, after = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
            before[1:], after[:-1] = solid[:-1], solid[1:]
            starts, ends = np.flatnonzero(solid & (~before | first[:-1])), np.flatnonzero(solid & (~after | first[1:])) + 1
            word = np.unique(np.searchsorted(starts, odd_words, side="right") - 1)
            odd_words = starts[word]
            turn = np.zeros(n + 1, dtype=np.int32)
            turn[odd_words] += 1
            turn[ends[word]] -= 1
            whole = np.cumsum(turn[:-1]) > 0
            low[whole] = data[whole]
            new[whole] = False
            new[odd_words] = True
        # 's 't 'm 'd 're 've 'll: the mark takes letters that follow.
        mark = np.flatnonzero(new[:-1] & (low[:-1] == ord("'")) & ~whole[:-1] & (kind[1:] == _LETTER) & ~first[1:-1])
        one = np.isin(low[mark + 1], list(b"stmd"))
        second = np.where((mark + 2 < n) & ~first[np.minimum(mark + 2, n)], low[np.minimum(mark + 2, n - 1)], 0)
        two = np.isin(low[mark + 1].astype(np.int64) << 8 | second, [int.from_bytes(x) for x in (b"re", b"ve", b"ll")])
        mark, end = mark[one | two], (mark + 2 + two)[one | two]
        new[mark + 1] = False
        end = end[end < n]
        new[end[(kind[end] == _LETTER) & ~first[end]]] = True

        starts = np.flatnonzero(new)
        ends = np.append(np.cumsum(solid, dtype=np.int32)[starts] - 1, np.count_nonzero(solid)).astype(np.int32)
        return starts, low[solid], ends, np.searchsorted(starts, odd_words), odd_texts

    def encode_block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (``data[offsets[i] : offsets[i + 1]]``, UTF-8) end to end, and how many each has."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        begin, low, ends, odd_parts, odd_texts = self._split(data, offsets)
        parts = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(ends), pa.py_buffer(low)]).dictionary_encode()
        part = np.asarray(parts.indices)
        odd = np.zeros(len(parts.dictionary), dtype=bool)
        odd[part[odd_parts]] = True
        number = self._numbers(parts.dictionary, odd)
        part = number[part]
        flat = ragged(self.ids, self.starts[part], self.counts[part])
        run = np.concatenate(([0], np.cumsum(self.counts[part])))
        counts = np.diff(run[np.searchsorted(begin, offsets)])
        if len(self.known) > MAX_KNOWN or self.known.nbytes + self.ids.nbytes > 32 * MAX_KNOWN:
            self._forget()
        if len(odd_texts):  # texts that only the library may split
            starts = np.cumsum(counts) - counts
            slow = [self.library.encode(data[offsets[i] : offsets[i + 1]].tobytes().decode(), add_special_tokens=False).ids for i in odd_texts]
            counts[odd_texts] = list(map(len, slow))
            starts[odd_texts] = len(flat) + np.cumsum(counts[odd_texts]) - counts[odd_texts]
            flat = ragged(np.concatenate((flat, np.array([x for ids in slow for x in ids], dtype=np.uint32))), starts, counts)
        return flat, counts

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and how many each has: the library's, with ``add_special_tokens=False``."""
        made = [self.encode_block(b.data, b.offsets) for b in blocks(pa.array(texts, pa.large_string()), BLOCK_BYTES)]
        return tuple(np.concatenate(x) for x in zip(*made)) if made else (np.zeros(0, np.uint32), np.zeros(0, np.int64))


def ragged(flat: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``flat[s : s + c]`` of each start and count, end to end."""
    shift = np.repeat(starts - (np.cumsum(counts) - counts), counts)
    return flat[shift + np.arange(len(shift))]


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]
