"""Encoding with a public byte-level BPE vocabulary by a lazily determinised finite-state transducer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Where the public vocabularies lie; a parameter of all functions.
VOCABULARIES = "/opt/tokenizers"
#: The pattern that splits a text before the merges (a fixed value of the vocabulary). \p{White_Space} stands for \s,
#: which other engines define without the four separators U+001C to U+001F.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""
#: Sizes at which the memos start anew. They bound memory and change no result.
MAX_STATES, MAX_WORDS, MAX_WORD_BYTES = 200_000, 400_000, 64
_SLICE = 100_000


class Transducer:
    """Bytes in, token ids out.

    A state is the set of ways in which the bytes read so far may go on: for each start of a token that is still open,
    the node of the vocabulary's trie and the tokens before it that aren't out yet. Of any prefix there is exactly one
    encoding by merges: its last token is the one that forms a valid pair with the token before. So a step moves each
    open token along the trie, closes at most one of them, and puts out the tokens that all remaining ways share; the
    lookahead is bounded by the longest token. States and steps are made when first met (subset construction with
    residual strings) and forgotten together when there are MAX_STATES.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.next: dict[int, int] = {}
        self.token: list[int] = [-1]
        for t, i in ranks.items():
            node = 0
            for b in t:
                key = node << 8 | b
                to = self.next.get(key)
                if to is None:
                    to = self.next[key] = len(self.token)
                    self.token.append(-1)
                node = to
            self.token[node] = i
        self.pairs: dict[tuple[int, int], bool] = {}
        self._forget()

    def _forget(self) -> None:
        start = ((0, ()),)
        self.states: list[tuple] = [start]
        self.number: dict[tuple, int] = {start: 0}
        self.steps: list[dict[int, tuple[int, tuple[int, ...]]]] = [{}]

    def merged(self, text: bytes) -> list[int]:
        """The encoding of a short text by merging the pair of least rank, again and again."""
        parts = [bytes([b]) for b in text]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def valid(self, a: int, b: int) -> bool:
        """Whether a and b stay apart: the encoding of their bytes is this pair."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) > 4 * MAX_STATES:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merged(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return known

    def _step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        live, closed = [], None
        for node, kept in self.states[state]:
            to = self.next.get(node << 8 | byte)
            if to is None:
                continue
            live.append((to, kept))
            t = self.token[to]
            if t >= 0 and closed is None and (not kept or self.valid(kept[-1], t)):
                closed = (*kept, t)
        live.append((0, closed))
        n = min(len(kept) for _, kept in live) - 1
        out = 0
        first = live[0][1]
        while out < n and all(kept[out] == first[out] for _, kept in live):
            out += 1
        if out:
            live = [(node, kept[out:]) for node, kept in live]
        made = tuple(live)
        to = self.number.get(made)
        if to is None:
            to = self.number[made] = len(self.states)
            self.states.append(made)
            self.steps.append({})
        hit = self.steps[state][byte] = (to, first[:out])
        return hit

    def encode(self, word: bytes) -> list[int]:
        """The ids of one word of the splitting pattern, of any length."""
        if len(self.states) > MAX_STATES:
            self._forget()
        out: list[int] = []
        state, steps = 0, self.steps
        for n, byte in enumerate(word):
            hit = steps[state].get(byte)
            if hit is None:
                if len(self.states) > 2 * MAX_STATES:  # within one huge word: keep only where we are
                    here = self.states[state]
                    self._forget()
                    steps = self.steps
                    state = self.number.setdefault(here, len(self.states))
                    if state == len(self.states):
                        self.states.append(here)
                        self.steps.append({})
                hit = self._step(state, byte)
            state = hit[0]
            if hit[1]:
                out.extend(hit[1])
        if word:
            out.extend(next(kept for node, kept in self.states[state] if node == 0))
        return out


class Encoder(dict):
    """Text to ids. As a dict it holds words already met, as the bytes of their ids."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, "rb") as f:
            self.machine = Transducer({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})
        self.split = regex.compile(PATTERN)

    def __missing__(self, word: str) -> bytes:
        b = word.encode("utf-8")
        ids = np.array(self.machine.encode(b), dtype=np.int32).tobytes()
        if len(b) <= MAX_WORD_BYTES:
            if len(self) >= MAX_WORDS:
                self.clear()
            self[word] = ids
        return ids

    def raw(self, text: str | None) -> bytes:
        """The ids as 4-byte integers; nothing for an empty or null text. Long texts are read in slices of words."""
        if not text:
            return b""
        if len(text) < 1 << 18:
            return b"".join(map(self.__getitem__, self.split.findall(text)))
        words = (m.group() for m in self.split.finditer(text))
        return b"".join(iter(lambda: b"".join(map(self.__getitem__, islice(words, _SLICE))), b""))

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.raw(text), dtype=np.int32).tolist()


class Utf8:
    """An incremental UTF-8 reader: bytes in pieces of any size, text out as soon as a character is complete.

    state holds the bytes of an open character and the range that its next byte may have; a byte that can't follow
    closes the open bytes as one U+FFFD and is read anew, as the Unicode standard recommends.
    """

    def __init__(self):
        self.open, self.need, self.low, self.high = bytearray(), 0, 0x80, 0xBF

    def feed(self, data: bytes) -> str:
        out: list[str] = []
        for b in data:
            if self.need:
                if self.low <= b <= self.high:
                    self.open.append(b)
                    self.need -= 1
                    self.low, self.high = 0x80, 0xBF
                    if not self.need:
                        out.append(self.open.decode("utf-8"))
                        self.open.clear()
                    continue
                out.append("�")
                self.open.clear()
                self.need, self.low, self.high = 0, 0x80, 0xBF
            if b < 0x80:
                out.append(chr(b))
            elif 0xC2 <= b <= 0xF4:
                self.open.append(b)
                self.need = 1 + (b >= 0xE0) + (b >= 0xF0)
                self.low = {0xE0: 0xA0, 0xF0: 0x90}.get(b, 0x80)
                self.high = {0xED: 0x9F, 0xF4: 0x8F}.get(b, 0xBF)
            else:
                out.append("�")
        return "".join(out)

    def end(self) -> str:
        rest = "�" if self.open else ""
        self.__init__()
        return rest


_ENCODERS: dict[str, Encoder] = {}


def encoder(name: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> Encoder:
    """One encoder for each vocabulary and process; Python workers are used again, and so is it."""
    path = os.path.join(folder, f"{name}.tiktoken")
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def decode_stream(ids: Iterator[int], name: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> Iterator[str]:
    """The text of a stream of ids, piece by piece; characters may be spread over several ids."""
    table, reader = encoder(name, folder).machine.bytes_of, Utf8()
    for i in ids:
        if piece := reader.feed(table[i]):
            yield piece
    if rest := reader.end():
        yield rest


def encode_corpus(documents: DataFrame, name: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """doc_id and ids (array<int>) of each row's text, without special tokens; the strings of special tokens are ordinary
    text. An empty text and a null text give an empty list; every row gives one row, repeated ones too. No shuffle: texts
    are encoded where they lie, in Arrow batches; each Python worker keeps its transducer between tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(name, folder)
        for b in batches:
            parts = [enc.raw(t) for t in b.column(1).to_pylist()]
            ends = np.zeros(len(parts) + 1, dtype=np.int64)
            np.cumsum([len(p) // 4 for p in parts], out=ends[1:])
            at = 0
            while at < len(parts):  # a batch of Arrow lists holds at most 2^31 ids
                to = max(at + 1, int(np.searchsorted(ends, ends[at] + (1 << 28), side="right")) - 1)
                ids = pa.array(np.frombuffer(b"".join(parts[at:to]), dtype=np.int32))
                lists = pa.ListArray.from_arrays(pa.array((ends[at : to + 1] - ends[at]).astype(np.int32)), ids)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, to - at), lists], names=["doc_id", "ids"])
                at = to

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, ids array<int>")


def round_trip(documents: DataFrame, name: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """Rows, characters, ids and rows whose decoded ids aren't the text again (none), for each lang."""
    import pandas as pd
    from pyspark.sql import functions as F

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(name, folder)
        for b in batches:
            ids = [enc.encode(t if isinstance(t, str) else None) for t in b["text"]]
            lost = ["".join(decode_stream(iter(i), name, folder)) != (t if isinstance(t, str) else "") for i, t in zip(ids, b["text"])]
            yield pd.DataFrame({"lang": b["lang"], "n_chars": [len(t) if isinstance(t, str) else 0 for t in b["text"]], "n_ids": [len(i) for i in ids], "lost": [int(x) for x in lost]})

    out = documents.select("lang", "text").mapInPandas(run, "lang string, n_chars bigint, n_ids bigint, lost bigint")
    return out.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"), F.sum("n_chars").alias("chars"), F.sum("n_ids").alias("ids"), F.sum("lost").alias("lost"))
