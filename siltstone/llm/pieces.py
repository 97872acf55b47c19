"""Encoding to and decoding from SentencePiece vocabularies by shared-prefix Viterbi.

A text gets a leading blank, and blanks mark words (pieces write them as U+2581).
No piece reaches past the start of a word, so the best segmentation of a text
is that of its marked words. The distinct words of a block are sorted, which
lays their trie out in depth-first order: each word keeps the forward scores of
the prefix that it shares with the word before and computes only the rest. An
automaton over the pieces names, at each node, the pieces that end there.
Scores are those of the model file; on ties the longer last piece wins.
Characters without a piece cost ``UNKNOWN_PENALTY`` more than the worst piece
and are written as byte pieces, so decoding returns the exact text.

Edge cases: null or empty text has no ids and decodes to the empty text; line
feeds, runs of blanks and U+2581 itself survive the round trip; repeated rows
get equal ids; null ids are kept; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import blocks, texts_of
from .tokens import ragged

UNKNOWN_PENALTY = 10.0
MARK = "▁"
BLOCK_BYTES = 4_000_000
#: Words whose ids a Python worker keeps from block to block.
KEPT_WORDS = 120_000
_WORD = re.compile(r"\n| +(?=\n|\Z)| *[^ \n]+")
#: Characters of a word that are compared with the word before; what is shared beyond them is solved again.
_COMPARED = 32


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _shared(words: list[str]) -> list[int]:
    """How many leading characters each word shares with the one before, of the first ``_COMPARED``."""
    points = np.array(words, dtype=f"U{_COMPARED}").view(np.uint32).reshape(len(words), _COMPARED)
    apart = np.ones((len(words), _COMPARED + 1), dtype=bool)
    apart[1:, :-1] = (points[1:] != points[:-1]) | (points[1:] == 0)
    apart[:1, 0] = True
    return apart.argmax(axis=1).tolist()


class PieceModel:
    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        self.scores: dict[str, tuple[float, int]] = {}
        self.bytes_of: list[bytes] = []
        self.byte_ids = [-1] * 256
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value] = i
                self.bytes_of.append(bytes([value]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.bytes_of.append(b"")
            else:
                raw = piece.replace(MARK, " ")
                self.scores[raw] = (model.get_score(i), i)
                self.bytes_of.append(raw.encode())
        if min(self.byte_ids) < 0:
            raise ValueError("the vocabulary has no byte pieces")
        if any("\n" in p or re.search(r"[^ ] ", p) for p in self.scores):
            raise ValueError("a piece reaches over a word's start or a line feed")
        self._index()
        self.unknown = min(s for s, _ in self.scores.values()) - UNKNOWN_PENALTY
        self.kept: dict[str, np.ndarray] = {}

    def _index(self) -> None:
        """For each prefix of a piece (a state): its next states, its longest proper suffix that is a state, and the pieces that end there, longest first."""
        self.next: list[dict[str, int]] = [{}]
        ends: list[tuple] = [()]
        for piece, (score, i) in self.scores.items():
            state = 0
            for char in piece:
                if char not in self.next[state]:
                    self.next[state][char] = len(self.next)
                    self.next.append({})
                    ends.append(())
                state = self.next[state][char]
            ends[state] = ((len(piece), score, i),)
        self.suffix, self.ends = [0] * len(ends), ends
        todo = list(self.next[0].values())
        for state in todo:  # breadth first: suffixes are shorter, so they are complete
            ends[state] += ends[self.suffix[state]]
            for char, below in self.next[state].items():
                self.suffix[below] = self._step(self.suffix[state], char)
                todo.append(below)

    def _step(self, state: int, char: str) -> int:
        while char not in self.next[state]:
            if not state:
                return 0
            state = self.suffix[state]
        return self.next[state][char]

    def viterbi(self, words: list[str]) -> list[list[int]]:
        """Best ids of each word; ``words`` are distinct and sorted, so neighbours share prefixes."""
        below, ends, step, scores, unknown = self.next, self.ends, self._step, self.scores, self.unknown
        best: list[float] = [0.0]
        back: list[tuple[int, float, int]] = [(0, 0.0, 0)]  # per prefix: its last piece
        states = [0]
        out = []
        for word, shared in zip(words, _shared(words)):
            del best[shared + 1 :], back[shared + 1 :], states[shared + 1 :]
            state = states[-1]
            for end in range(shared + 1, len(word) + 1):
                char = word[end - 1]
                found = below[state].get(char)
                state = step(state, char) if found is None else found
                top, last = -1e300, None
                for piece in ends[state]:
                    value = best[end - piece[0]] + piece[1]
                    if value > top:
                        top, last = value, piece
                if char not in scores and best[-1] + unknown > top:
                    top, last = best[-1] + unknown, (1, unknown, -1)
                best.append(top)
                back.append(last)
                states.append(state)
            ids: list[int] = []
            end = len(word)
            while end:
                size, _, piece = back[end]
                if piece < 0:
                    ids += [self.byte_ids[b] for b in reversed(word[end - 1].encode())]
                else:
                    ids.append(piece)
                end -= size
            ids.reverse()
            out.append(ids)
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and how many each has."""
        split = [_WORD.findall(" " + t) if t else [] for t in texts]
        ends = np.cumsum([len(words) for words in split])
        number = {w: i for i, w in enumerate(dict.fromkeys(chain.from_iterable(split)))}
        used = np.fromiter(map(number.__getitem__, chain.from_iterable(split)), dtype=np.int64, count=int(ends[-1]) if len(ends) else 0)
        if len(self.kept) > KEPT_WORDS:
            self.kept = {}
        fresh = sorted(number.keys() - self.kept.keys())
        made = dict(zip(fresh, self.viterbi(fresh)))
        ids = [made[w] if w in made else self.kept[w] for w in number]
        size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        flat = np.fromiter(chain.from_iterable(ids), dtype=np.uint32, count=int(size.sum()))
        often = np.bincount(used, minlength=len(number)) > 1
        for word, again in zip(number, often):
            if again and word in made:
                self.kept[word] = made[word]
        run = np.concatenate(([0], np.cumsum(size[used])))
        return ragged(flat, (np.cumsum(size) - size)[used], size[used]), np.diff(run[np.concatenate(([0], ends))])

    def decode(self, ids: np.ndarray) -> str:
        names = self.bytes_of
        return b"".join([names[i] for i in ids.tolist()])[1:].decode()


@lru_cache(maxsize=2)
def _model(path: str) -> PieceModel:
    return PieceModel(path)


def encode_pieces(docs: DataFrame, model: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids``: ids as little-endian unsigned 32-bit numbers."""
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _model(path)
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            for block in blocks(texts, BLOCK_BYTES):
                ids, counts = pieces.encode(texts.slice(block.rows.start, block.n).to_pylist())
                ends = np.concatenate(([0], np.cumsum(counts))) * 4
                column = pa.Array.from_buffers(pa.large_binary(), block.n, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(ids.astype("<u4"))])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.rows.start, block.n), pa.array(counts), column.cast(pa.binary())], ["doc_id", "n_tokens", "ids"])

    return texts_of(docs).mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode_pieces(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids, text`` from :func:`encode_pieces`."""
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _model(path)
        for batch in batches:
            texts = [pieces.decode(np.frombuffer(b.as_buffer(), dtype="<u4")) if b.is_valid else None for b in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids", "text"])

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids binary, text string")
