"""Cost-balanced packing of tokenised documents into sequences of one length.

Each document costs ``linear * n + quadratic * n * n`` (attention grows with the
square of what is attended to). Documents are taken in descending order and each
goes to the sequence of lowest cost that still has room for it. The number of
sequences is the least that holds all tokens, so a document that fits nowhere
whole is cut: its head fills the cheapest sequence with any room left and the
rest is placed in turn. Documents of a sequence length or more give whole
sequences first.

Packing happens inside each task over windows of ``window_tokens`` tokens, so no
row is shuffled, memory is bounded by the window (plus one document), and a
window leaves less than one sequence of padding.

Defined results: a null or empty text is the closing id alone; null ids and
repeated rows are packed like any other row; an empty table gives no pieces.
Columns besides the id and the text are not read.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortwise.llm.bpe import byte_alphabet
from cohortwise.llm.common import Memo, memory_returned, whole_text

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

#: A space starts a new unit when a visible character follows. White space of any kind and control characters don't count as visible.
_INVISIBLE = r"\s\x00-\x20\x7f-\xa0 ᠎ -‏ -  -⁯　﻿"
_AWKWARD = re.compile(f" [{_INVISIBLE}]")
_UNIT_START = re.compile(f" (?=[^{_INVISIBLE}])")
#: Characters whose kind no version of Unicode disputes, and the pre-tokenizer's pieces among them.
_ORDINARY = re.compile("[\n -~¡-ɏ]+").fullmatch
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall


@dataclass(frozen=True)
class Packing:
    """Sequence length, cost weights of a document of n tokens, closing id, and tokens packed together."""

    capacity: int = 2048
    linear: float = 1.0
    quadratic: float = 1.0 / 2048
    closing_id: int = 1
    window_tokens: int = 1 << 21


class UnitEncoder:
    """Ids of whole texts by the tokenizers library as little-endian unsigned 32-bit bytes.

    The byte-level pre-tokenizer never joins what stands before a space and a
    visible character with what follows, so a text is the sequence of its
    space-separated units; units repeat, and their ids are remembered. Units of
    ordinary characters are cut into pieces as the pre-tokenizer does, and the
    library's merge model encodes a piece once; all others go through the whole
    tokenizer. ``remembered`` bounds each of two generations of remembered units.
    """

    def __init__(self, path: str, remembered: int = 500_000):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.no_truncation()
        self._tokenizer.no_padding()
        self._tokenize = self._tokenizer.model.tokenize
        self._letters = dict(enumerate(byte_alphabet()))
        self._piece = Memo(lambda pieces: map(self._piece_ids, pieces), remembered // 5)
        self._spaced = Memo(self._unit_ids, remembered)

    def _ids(self, texts: list[str]) -> list[bytes]:
        found = self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", x.ids).tobytes() for x in found]

    def _piece_ids(self, piece: str) -> bytes:
        word = piece.encode().decode("latin-1").translate(self._letters)  # one character for each byte
        return array("I", [t.id for t in self._tokenize(word)]).tobytes()

    def _unit_ids(self, units: list[str]) -> list[bytes]:
        piece, known, out, rest = self._piece, self._spaced.get, [], []
        for unit in units:
            if unit.isascii() and unit.isalpha():
                out.append(self._piece_ids(" " + unit))  # asked for once: the unit's own entry is the memo
            elif not _ORDINARY(unit):
                rest.append(len(out))
                out.append(b"")
            elif unit.isalpha():
                out.append(self._piece_ids(" " + unit))
            elif unit[:-1].isalpha() and unit[-1] in ",.":
                out.append((known(unit[:-1]) or piece[" " + unit[:-1]]) + piece[unit[-1]])
            else:
                out.append(b"".join([piece[x] for x in _PIECES(" " + unit)]))
        for at, ids in zip(rest, self._ids([" " + units[at] for at in rest])):
            out[at] = ids
        return out

    def __call__(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The ids of each text; unknown units of about a million characters are encoded at once."""
        held, size = [], 0
        for text in texts:
            held.append(text)
            size += len(text)
            if size >= 1_000_000:
                yield from self._together(held)
                held, size = [], 0
        yield from self._together(held)

    def _together(self, texts: list[str]) -> list[bytes]:
        split, known, unknown = [], [], set()
        for text in texts:
            if "<|" in text:  # may hold the name of a special token, which takes in no neighbouring space
                units = [text]
            else:
                units = _UNIT_START.split(text) if _AWKWARD.search(text) else text.split(" ")
            parts = list(map(self._spaced.get, units))
            parts[0] = b""
            if None in parts:
                unknown.update(unit for unit, part in zip(units, parts) if part is None)
            split.append(units)
            known.append(parts)
        self._spaced.ensure(unknown)
        heads = self._ids([units[0] for units in split])
        out = []
        for head, units, parts in zip(heads, split, known):
            if None in parts:
                parts = [self._spaced[unit] if part is None else part for unit, part in zip(units, parts)]
            out.append(head + b"".join(parts))
        return out


@lru_cache(maxsize=1)
def unit_encoder(path: str, remembered: int) -> UnitEncoder:
    """The encoder of this Python worker; later tasks find its memo filled."""
    return UnitEncoder(path, remembered)


def assign(lengths: list[int], spec: Packing) -> list[tuple[int, int, int, int, int]]:
    """``(document, start, length, sequence, offset)`` of all pieces of one window; sequences count from 0."""
    pieces, small, sequences = [], [], 0
    for document, n in enumerate(lengths):
        whole = n // spec.capacity
        for k in range(whole):
            pieces.append((document, k * spec.capacity, spec.capacity, sequences, 0))
            sequences += 1
        if n % spec.capacity:
            small.append((n % spec.capacity, document, whole * spec.capacity))
    bins = -(-sum(n for n, _, _ in small) // spec.capacity)
    room, cost = np.full(bins, spec.capacity), np.zeros(bins)
    for n, document, start in sorted(small, key=lambda x: (-x[0], x[1])):
        while n:
            fits = room >= n
            at = int(np.where(fits if fits.any() else room > 0, cost, np.inf).argmin())
            part = min(n, int(room[at]))
            pieces.append((document, start, part, sequences + at, spec.capacity - int(room[at])))
            room[at] -= part
            cost[at] += spec.linear * part + spec.quadratic * part * part
            n, start = n - part, start + part
    return pieces


def pack(documents: DataFrame, tokenizer_path: str, spec: Packing = Packing(), id_column: str = "doc_id", text_column: str = "text", with_ids: bool = False, remembered: int = 500_000, lasting: bool = True) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence, and a checksum of its ids.

    ``with_ids`` adds the ids themselves (``ids array<int>``). ``sequence_id`` is unique over the whole result.
    ``remembered`` is the encoder's bound: fewer units take less memory and more time, the ids are the same.
    The encoder stays in the worker for later tasks; unless ``lasting`` it goes with its task, and its memory to the system.
    """
    schema = PIECES + (", ids array<int>" if with_ids else "")

    columns = [(name, pa.list_(pa.int32()) if kind == "array<int>" else pa.int64()) for name, kind in (x.split() for x in schema.split(", "))]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, closing = (unit_encoder if lasting else UnitEncoder)(tokenizer_path, remembered), np.asarray([spec.closing_id], dtype="<u4").tobytes()
        first = TaskContext.get().partitionId() << 40
        held, names, texts = 0, [], []

        def window() -> pa.RecordBatch:
            nonlocal first
            lengths, rows = [len(x) // 4 for x in texts], []
            for document, start, n, sequence, offset in assign(lengths, spec):
                ids = memoryview(texts[document])[4 * start : 4 * (start + n)]
                row = (names[document], start, n, zlib.crc32(ids), lengths[document], first + sequence, offset)
                rows.append((*row, np.frombuffer(ids, "<u4").astype("int32")) if with_ids else row)
            first = max(row[5] for row in rows) + 1
            names.clear()
            texts.clear()
            return pa.RecordBatch.from_arrays([pa.array(values, kind) for values, (_, kind) in zip(zip(*rows), columns)], names=[name for name, _ in columns])

        for batch in batches:
            for name, ids in zip(batch.column("doc_id"), encode(text.as_py() for text in batch.column("text"))):
                names.append(name.as_py())
                texts.append(ids + closing)
                held += len(texts[-1]) // 4
                if held >= spec.window_tokens:
                    yield window()
                    held = 0
        if names:
            yield window()

    narrow = documents.select(F.col(id_column).cast("long").alias("doc_id"), whole_text(text_column).alias("text"))
    return narrow.mapInArrow(packed if lasting else memory_returned(packed), schema)
