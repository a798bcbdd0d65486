"""Exact SentencePiece encoding and decoding for merge-type models.

A sequence of pieces is what merging gives if and only if each two neighbours are: merging their joined text gives just
those two. So a text is encoded without merging it: at each position the longest piece that fits its left neighbour is
tried (an Aho-Corasick automaton finds it, and a table names the next shorter one; the fit of two pieces comes from merging
their few characters once), and on a dead end the encoder steps back. A bit per position marks those where no piece led
on; each prefix has one encoding, so a position that failed need not be tried again and the work is linear.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SPACE = "▁"
#: Memory for what was seen lately, in bytes: three quarters for the ids of chunks, the rest for fits of pairs of pieces,
#: half of each for what is in use and half for the generation before.
HELD = 192 << 20
_ENTRY, _PAIR = 240, 170  # bytes of a chunk's entry besides its characters and ids, and of a pair's
FLUSH_IDS = 1 << 18
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6


def _each_invalid_byte(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�", error.start + 1


codecs.register_error("flowloom_each_byte", _each_invalid_byte)


class Pieces(dict):
    """A merge-type model. As a dictionary, it holds the ids of chunks of text seen lately."""

    def __init__(self, model: bytes, memory: int = HELD):
        from sentencepiece import sentencepiece_model_pb2 as proto

        super().__init__()
        self.held, self.older = 0, {}
        self.most_chunks, self.most_pairs = memory * 3 // 8, memory // 8 // _PAIR
        parsed = proto.ModelProto()
        parsed.ParseFromString(model)
        rules = parsed.normalizer_spec
        kinds = {p.type for p in parsed.pieces}
        if parsed.trainer_spec.model_type != parsed.trainer_spec.BPE or not parsed.trainer_spec.byte_fallback \
                or rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces \
                or parsed.trainer_spec.treat_whitespace_as_suffix or kinds - {_NORMAL, _UNKNOWN, _CONTROL, _BYTE}:
            raise ValueError("only merge-type models with byte fallback and plain text rules are supported")
        self.prefix = rules.add_dummy_prefix
        self.scores = {p.piece: p.score for p in parsed.pieces if p.type == _NORMAL}
        self.ids = {p.piece: i for i, p in enumerate(parsed.pieces) if p.type == _NORMAL}
        self.byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(parsed.pieces) if p.type == _BYTE}
        self.end_id = next(i for i, p in enumerate(parsed.pieces) if p.type == _CONTROL and p.piece == "</s>")
        self.bytes_of = [
            bytes([int(p.piece[3:5], 16)]) if p.type == _BYTE else b"" if p.type == _CONTROL
            else b" \xe2\x81\x87 " if p.type == _UNKNOWN else p.piece.replace(SPACE, " ").encode() for p in parsed.pieces]
        self.controls = {i for i, p in enumerate(parsed.pieces) if p.type == _CONTROL}
        self.leads = {i for i, p in enumerate(parsed.pieces) if p.type == _NORMAL and p.piece.startswith(SPACE)}
        self.fits: dict[tuple[str, str], bool] = {}
        self.older_fits: dict[tuple[str, str], bool] = {}
        self.matches = ahocorasick.Automaton()
        usable = {piece for piece in self.scores if self.merge(piece) == [piece]}
        for piece in usable:
            self.matches.add_word(piece, len(piece))
        self.matches.make_automaton()
        # the next candidate at a place: the longest piece that begins a piece; a single character always may
        self.shorter = {p: next((p[:n] for n in range(len(p) - 1, 1, -1) if p[:n] in usable), p[0])
                        for p in usable if len(p) > 1}
        inner = sorted({c for p in self.scores if len(p) > 1 for c in p} - {SPACE})
        whole = any(SPACE in p.lstrip(SPACE) for p in self.scores)
        word = f"[{re.escape(''.join(inner))}]"
        # no piece reaches over the end of a chunk, so chunks are encoded one by one; in memory they keep plain spaces
        self.chunks = re.compile("(?s).+" if whole or not inner else f" *{word}+| +|(?s:.)").findall
        self.same = {p: p for p in self.scores}.get

    def merge(self, text: str) -> list[str]:
        """Merging as defined: the best-scored joined pair first, the leftmost of equals."""
        parts, scores = list(text), self.scores.get
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = scores(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fit(self, left: str, right: str) -> bool:
        """Whether merging the two together leaves them as they are."""
        pair = (left, right)
        known = self.fits.get(pair)
        if known is None:
            known = self.older_fits.get(pair)
            if known is None:
                known = self.merge(left + right) == [left, right]
            if len(self.fits) >= self.most_pairs:  # what is still in use comes over from the older generation
                self.older_fits = dict(self.fits)
                self.fits.clear()
            self.fits[pair] = known
        return known

    def split(self, chunk: str) -> list[str]:
        """The pieces of a chunk, unknown characters as themselves."""
        size, at, left, known, same = len(chunk), 0, None, self.fits.get, self.same
        taken: list[str] = []
        if size == 1:
            return [chunk]
        # the longest matches one after the other, as long as they fit
        for end, length in self.matches.iter_long(chunk):
            if end + 1 - length != at:
                break
            piece = same(chunk[at:end + 1])  # one object for each piece
            if left is not None:
                fits = known((left, piece))
                if not (self.fit(left, piece) if fits is None else fits):
                    break
            taken.append(piece)
            left, at = piece, end + 1
        if at == size:
            return taken
        # from there on with shorter pieces and steps back
        failed, shorter, begins = bytearray(size // 8 + 1), self.shorter.get, -1

        def longest(at: int) -> str:
            nonlocal begins
            if at >= begins:
                end, length = next(self.matches.iter_long(chunk, at, size), (size, 0))
                begins = end + 1 - length
                if begins == at:
                    return same(chunk[at:end + 1])
            return same(chunk[at], chunk[at])

        piece = longest(at)
        while True:
            while piece is not None:
                end = at + len(piece)
                if end == size or not failed[end >> 3] >> (end & 7) & 1:
                    fits = True if left is None else known((left, piece))
                    if self.fit(left, piece) if fits is None else fits:
                        break
                piece = shorter(piece)
            if piece is not None:
                taken.append(piece)
                left, at = piece, end
                if at == size:
                    return taken
                piece = longest(at)
            else:
                failed[at >> 3] |= 1 << (at & 7)
                if not taken:
                    raise AssertionError("no encoding")  # can't happen: merging always gives one
                last = taken.pop()
                at -= len(last)
                begins = -1
                left = taken[-1] if taken else None
                piece = shorter(last)

    def __missing__(self, chunk: str) -> tuple[int, ...]:
        known = self.older.get(chunk)
        if known is None:
            known = self._ids(chunk)
        if len(chunk) <= 64:
            if self.held >= self.most_chunks:  # what is still in use comes over from the older generation
                self.older, self.held = dict(self), 0
                self.clear()
            self.held += _ENTRY + 2 * len(chunk) + 8 * len(known)
            self[chunk] = known
        return known

    def _ids(self, chunk: str) -> tuple[int, ...]:
        out: list[int] = []
        for piece in self.split(chunk.replace(" ", SPACE)):
            known = self.ids.get(piece)
            if known is not None:
                out.append(known)
            else:
                out += [self.byte_ids[b] for b in piece.encode("utf-8", "replace")]
        return tuple(out)

    def encode(self, text: str, end: bool = False) -> np.ndarray:
        """The ids of a text, with the end id last if asked for."""
        marked = (" " if self.prefix else "") + text.replace(SPACE, " ") if text else ""
        ids = chain.from_iterable(map(self.__getitem__, self.chunks(marked)))
        return np.fromiter(chain(ids, (self.end_id,)) if end else ids, dtype=np.int32)

    def decode(self, ids: list[int]) -> str:
        """The text of ids: control ids have none, stretches of bytes are read as UTF-8, the added first space goes."""
        parts, start, stop = [], 0, len(ids)
        while stop and ids[stop - 1] in self.controls:
            stop -= 1
        if not self.controls.isdisjoint(ids[:stop]):  # bytes on either side of a control id don't combine
            for i in range(stop):
                if ids[i] in self.controls:
                    parts.append(ids[start:i])
                    start = i + 1
        parts.append(ids[start:stop])
        texts = [b"".join(map(self.bytes_of.__getitem__, p)).decode("utf-8", "flowloom_each_byte") for p in parts]
        first = next((p[0] for p in parts if p), None)
        text = "".join(texts)
        return text[1:] if self.prefix and first in self.leads else text


@lru_cache(2)
def load(model: bytes, memory: int = HELD) -> Pieces:
    """The model, built once in each process."""
    return Pieces(model, memory)


def read_model(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def encode_documents(documents: DataFrame, model: bytes, end: bool = True, decode: bool = False,
                     memory: int = HELD) -> DataFrame:
    """The ids of ``documents`` (doc_id, text): doc_id, ids, and with ``decode`` the text decoded from the ids.

    NULL text is empty. Both directions run in one worker with one model, which remembers ``memory`` bytes of what it saw.
    """
    held = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(held.value, memory)

        def out(keys: list, arrays: list[np.ndarray]) -> pa.RecordBatch:
            offsets = np.zeros(len(arrays) + 1, dtype=np.int32)
            np.cumsum([len(a) for a in arrays], out=offsets[1:])
            made = {"doc_id": pa.array(keys, pa.int64()),
                    "ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays)))}
            if decode:
                made["decoded"] = pa.array([pieces.decode(a.tolist()) for a in arrays], pa.string())
            return pa.record_batch(made)

        for batch in batches:
            keys, arrays, count = [], [], 0
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = pieces.encode(text.as_py() or "", end)
                keys.append(key)
                arrays.append(ids)
                count += len(ids)
                if count > FLUSH_IDS:
                    yield out(keys, arrays)
                    keys, arrays, count = [], [], 0
            if keys:
                yield out(keys, arrays)

    return documents.select("doc_id", "text").mapInArrow(
        run, "doc_id long, ids array<int>" + (", decoded string" if decode else ""))


def decoded(ids: Column | str, model: bytes) -> Column:
    """The text of a column of ids."""

    @F.pandas_udf(StringType())
    def run(values: pd.Series) -> pd.Series:
        pieces = load(model)
        return pd.Series([None if v is None else pieces.decode(v.tolist()) for v in values], dtype=object)

    return run(ids)
