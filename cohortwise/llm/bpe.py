"""Exact byte-pair encoding by backtracking, and decoding through an offset table.

A sequence of tokens is the encoding of a word exactly when each neighbouring
pair would stay apart if the two were merged alone. So the encoder goes left to
right, takes the longest token that an Aho-Corasick automaton finds at the
position, and keeps it if the pair with the token before is compatible; else it
tries the next shorter prefix token, and steps back when none is left. Positions
that proved useless are marked, so each is given up once and the work is linear
in the length of the word.

Two tokens stay apart when, following the merges that build the right edge of
the first and the left edge of the second in order of rank, no merge across the
border would come first. Answers are kept in a pair table.

Decoding takes slices of one string that holds all tokens, found by an offset
table.

Defined results: a null or empty text has no ids and decodes to the empty
string; null document ids and repeated rows are kept as they are; an empty table
gives an empty result. Columns besides the id and the text are not read.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortwise.llm.common import Memo, whole_text

#: Added to the code of a word's last symbol, so that word ends are symbols of their own.
_WORD_END = 0x1000


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = [b for b in range(256) if b not in set(kept)]
    letters = {b: chr(b) for b in kept} | {b: chr(0x100 + i) for i, b in enumerate(moved)}
    return [letters[b] for b in range(256)]


class MergeTable:
    """Vocabulary, automaton and pair compatibility of one merge list."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], suffix: str = ""):
        import ahocorasick

        def symbols(token: str) -> str:
            body = token.removesuffix(suffix) if suffix else token
            return body[:-1] + chr(ord(body[-1]) + _WORD_END) if suffix and body != token and body else token

        ids = {symbols(token): i for token, i in vocabulary.items()}
        self.length = {i: len(text) for text, i in ids.items()}
        self._rank: dict[tuple[int, int], int] = {}
        self._parts: dict[int, tuple[int, int, int]] = {}
        for rank, (left, right) in enumerate(merges):
            a, b = symbols(left), symbols(right)
            self._rank[ids[a], ids[b]] = rank
            self._parts.setdefault(ids[a + b], (ids[a], ids[b], rank))
        usable = {text: i for text, i in ids.items() if len(text) == 1 or i in self._parts}
        self.shorter = {}
        for text, i in usable.items():
            self.shorter[i] = next((usable[text[:n]] for n in range(len(text) - 1, 0, -1) if text[:n] in usable), None)
        self._automaton = ahocorasick.Automaton()
        for text, i in usable.items():
            self._automaton.add_word(text, i)
        self._automaton.make_automaton()
        self._apart = Memo(lambda pairs: [self._stay_apart(*pair) for pair in pairs])

    def _edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """The tokens that stand at an edge of ``token`` while it is built, each with the rank of the merge that takes it in."""
        path, taken_in = [], float("inf")
        while True:
            path.append((token, taken_in))
            if token not in self._parts:
                return path[::-1]
            taken_in = self._parts[token][2]
            token = self._parts[token][side]

    def _stay_apart(self, first: int, second: int) -> bool:
        lefts, rights, i, j = self._edge(first, 1), self._edge(second, 0), 0, 0
        while True:
            (left, left_ends), (right, right_ends) = lefts[i], rights[j]
            across = self._rank.get((left, right))
            # among equal ranks the leftmost merge comes first
            if across is not None and across < left_ends and across <= right_ends:
                return False
            if left_ends == right_ends == float("inf"):
                return True
            if left_ends <= right_ends:
                i += 1
            if right_ends <= left_ends:
                j += 1

    def encode(self, word: str) -> list[int]:
        """Ids of one word given in the byte alphabet with its last symbol marked."""
        size, length, shorter, search = len(word), self.length, self.shorter, self._automaton.iter_long
        open_at, out, at = [True] * (size + 1), [], 0
        # every symbol is a token, so the leftmost longest match begins where the search does
        token = next(search(word))[1] if size else None
        while token is not None:
            end = at + length[token]
            if open_at[end] and (not out or self._apart[out[-1], token]):
                out.append(token)
                at = end
                token = next(search(word, at))[1] if at < size else None
                continue
            token = shorter[token]
            if token is None:
                open_at[at] = False
                if not out:
                    raise ValueError(f"no encoding of {word!r}")
                token = out.pop()  # its end is closed now, so a shorter one follows
                at -= length[token]
        return out


def mark_word_end(word: str) -> str:
    return word[:-1] + chr(ord(word[-1]) + _WORD_END)


class WordBpe:
    """Encoder and decoder for a tokenizer file with word ends: composed, lower case, white space dropped."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self._table = MergeTable(model["vocab"], merges, model["end_of_word_suffix"] or "")
        self._special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special_at = regex.compile("|".join(map(regex.escape, sorted(self._special, key=len, reverse=True))))
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self._words = regex.compile(pattern).findall
        self._visible = regex.compile(r"[^\t-\r \x85\xa0  -     　]+").findall
        self._odd_separator = regex.compile("[\x1c-\x1f]").search
        self._alphabet = byte_alphabet()
        self._word_ids = Memo(lambda words: map(self._encode_word, words), 200_000)
        self._chunk = Memo(lambda chunks: map(self._encode_chunk, chunks), 200_000)
        tokens = sorted((i, t) for t, i in (model["vocab"] | self._special).items())
        self._offset = [(0, 0)] * (tokens[-1][0] + 1)
        self._buffer = "".join(t for _, t in tokens)
        at = 0
        for i, t in tokens:
            self._offset[i] = at, (at := at + len(t))

    def _encode_word(self, word: str) -> list[int]:
        return self._table.encode(mark_word_end("".join(self._alphabet[b] for b in word.encode())))

    def chunk_ids(self, chunk: str) -> list[int]:
        """Ids of a text without white space and special tokens."""
        if not chunk.isascii():
            chunk = unicodedata.normalize("NFC", chunk)
        lowered = chunk.lower() if chunk.isascii() else "".join(c.lower() for c in chunk)
        return [i for word in self._words(lowered) for i in self._word_ids[word]]

    def decode(self, ids: list[int]) -> str:
        """The tokens' strings, one space between them (the file names no decoder)."""
        return " ".join([self._buffer[a:b] for a, b in map(self._offset.__getitem__, ids)])

    def _encode_chunk(self, chunk: str) -> tuple[str, str]:
        ids = self.chunk_ids(chunk)
        return " ".join(map(str, ids)), self.decode(ids)

    def _chunks(self, text: str) -> Iterator[tuple[str, str]]:
        chunks = self._visible(text) if self._odd_separator(text) else text.split()
        self._chunk.ensure(set(chunks))
        return map(self._chunk.__getitem__, chunks)

    def parts(self, text: str) -> list[tuple[str, str]]:
        """``(ids as text, decoded)`` of the consecutive parts of a text; both join with one space."""
        if "<|" not in text:
            return list(self._chunks(text))
        out, at = [], 0
        for m in self._special_at.finditer(text):
            out += self._chunks(text[at : m.start()])
            out.append((str(self._special[m[0]]), m[0]))
            at = m.end()
        return out + list(self._chunks(text[at:]))

    def encode(self, text: str) -> list[int]:
        return [int(i) for ids, _ in self.parts(text) for i in ids.split()]


@lru_cache(maxsize=1)
def word_bpe(path: str) -> WordBpe:
    """The coder of this Python worker; later tasks find its memos filled."""
    return WordBpe(path)


def encode_documents(documents: DataFrame, tokenizer_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_id, ids, decoded)``: the ids of each whole text and what they decode to."""
    return _by_document(documents, tokenizer_path, id_column, text_column, "doc_id long, ids array<int>, decoded string", lambda ids, text: ([int(i) for i in ids.split()], text))


def encode_digests(documents: DataFrame, tokenizer_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``: the same encoding, as digests made in the task."""

    def digests(ids: str, text: str) -> tuple[int, str, str]:
        return ids.count(" ") + bool(ids), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()

    return _by_document(documents, tokenizer_path, id_column, text_column, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", digests)


def _by_document(documents, tokenizer_path, id_column, text_column, schema, shape) -> DataFrame:
    kinds = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
    columns = [(name, kinds[kind]) for name, kind in (x.split() for x in schema.split(", "))]

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_bpe(tokenizer_path)
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                # a chunk without any word has no ids
                parts = [p for p in coder.parts(text.as_py()) if p[0]]
                rows.append(shape(" ".join([p[0] for p in parts]), " ".join([p[1] for p in parts])))
            values = [batch.column("doc_id"), *(pa.array([row[k] for row in rows], kind) for k, (_, kind) in enumerate(columns[1:]))]
            yield pa.RecordBatch.from_arrays(values, names=[name for name, _ in columns])

    narrow = documents.select(F.col(id_column).cast("long").alias("doc_id"), whole_text(text_column).alias("text"))
    return narrow.mapInArrow(encoded, schema)
