"""Evaluation texts leaking into training text: pigeonhole pieces, Myers bit-parallel verification, exact check."""

from __future__ import annotations

import re
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metascope.runtime import scratch

#: A leak is this many words of an item in a row; with a budget, up to so many words changed, left out or put in.
WINDOW, BUDGET = 12, 1
#: Items are searched in blocks of about this many words: the bound of what each task gets besides its documents.
BLOCK_WORDS = 2_000_000
#: Texts of more characters are read in parts of PART_WORDS words that share more words than any item has.
LONG_TEXT, PART_WORDS = 4_000_000, 500_000
_WORD = re.compile(r"[^\W_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    """Runs of letters and digits, in lower case. The dotted capital I, whose small form has a mark apart, doesn't end a run."""
    if not text:
        return []
    return _WORD.findall(text.lower()) if "\u0130" not in text else [w.lower() for w in _WORD.findall(text)]


def myers(pattern: list, text: list, most: int) -> int:
    """The least number of words to change, leave out or put in that makes `pattern` occur in `text`, or most + 1 if it is
    more: Myers' bit-parallel columns, one bit for each word of the pattern."""
    m = len(pattern)
    if not m:
        return 0
    full, last = (1 << m) - 1, 1 << (m - 1)
    peq: dict = {}
    for i, w in enumerate(pattern):
        peq[w] = peq.get(w, 0) | 1 << i
    pv, mv, score, best = full, 0, m, min(m, most + 1)
    for w in text:
        eq = peq.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        if ph & last:
            score += 1
        elif mh & last:
            score -= 1
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv = mh | (~(xv | ph) & full)
        mv = ph & xv
        if score < best:
            best = score
            if not best:
                break
    return best


@dataclass
class Block:
    """An index of some items: their words as numbers, and their pieces.

    The pigeonhole: a window of `window` words with at most `budget` edits keeps one of budget + 1 disjoint pieces whole.
    Pieces begin at every multiple of their length within the item; with length (window + 1) // (budget + 2) each
    window, wherever it begins, holds budget + 1 of them.
    """

    items: list[tuple[int, list[str]]]
    window: int = WINDOW
    budget: int = BUDGET

    def __post_init__(self):
        self.size = max(1, (self.window + 1) // (self.budget + 2))
        self.number: dict[str, int] = {}
        flat, start, codes, item_of, offset = [], [], [], [], []
        pad = [-2] * (self.window + self.budget)
        flat += pad
        for k, (_, ws) in enumerate(self.items):
            start.append(len(flat))
            nums = [self.number.setdefault(w, len(self.number)) for w in ws]
            flat += nums + pad
            for o in range(0, len(nums) - self.size + 1, self.size):
                codes.append(start[-1] + o)
                item_of.append(k)
                offset.append(o)
        self.flat, self.start = np.array(flat, dtype=np.int32), np.array(start, dtype=np.int64)
        at = np.array(codes, dtype=np.int64)
        code = self.codes(self.flat)[at] if len(at) else np.array([], dtype=np.uint64)
        order = np.argsort(code, kind="stable")
        self.code, self.item_of, self.offset = code[order], np.array(item_of, dtype=np.int64)[order], np.array(offset, dtype=np.int64)[order]

    def codes(self, nums: np.ndarray) -> np.ndarray:
        """A number for each run of `size` words; different runs may share one, which the verification sees."""
        n = max(0, len(nums) - self.size + 1)
        out = np.zeros(n, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for i in range(self.size):
                out = out * _MIX + nums[i : i + n].astype(np.uint64) + np.uint64(1)
                out ^= out >> np.uint64(29)
        return out

    def search(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, int]]:
        """(text's index, item_id, distance of the best window, most words in a row) of each text and item that has a
        window within the budget. Long texts are searched by themselves, part by part."""
        long = [k for k, t in enumerate(texts) if t and len(t) > LONG_TEXT]
        yield from self._search([None if k in long else t for k, t in enumerate(texts)] if long else texts)
        for k in long:
            best: dict[int, tuple[int, int]] = {}
            for part in self._parts(texts[k]):
                for _, i, d, n in self._search([part]):
                    old = best.get(i, (d, n))
                    best[i] = (min(d, old[0]), max(n, old[1]))
            yield from ((k, i, d, n) for i, (d, n) in best.items())

    def _parts(self, text: str) -> Iterator[str]:
        starts = [m.start() for n, m in enumerate(_WORD.finditer(text)) if n % PART_WORDS == 0]
        share = max((len(ws) for _, ws in self.items), default=0) + self.window + self.budget
        for a, b in zip(starts, [*starts[1:], len(text)]):
            end = next((m.end() for m in islice(_WORD.finditer(text, b), share, share + 1)), len(text))
            yield text[a:end]

    def _search(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, int]]:
        get, pad = self.number.get, np.full(self.window + self.budget, -1, dtype=np.int32)
        parts, begin, n = [pad], [], len(pad)
        for t in texts:
            ws = words(t)
            begin.append(n)
            parts += [np.fromiter((get(w, -1) for w in ws), dtype=np.int32, count=len(ws)), pad]
            n += len(ws) + len(pad)
        doc, begin = np.concatenate(parts), np.array(begin, dtype=np.int64)
        known = doc >= 0
        whole = np.ones(max(0, len(doc) - self.size + 1), dtype=bool)
        for i in range(self.size):
            whole &= known[i : i + len(whole)]
        at = np.flatnonzero(whole)
        if not len(at) or not len(self.code):
            return
        code = self.codes(doc)[at]
        left, right = np.searchsorted(self.code, code, "left"), np.searchsorted(self.code, code, "right")
        hit = right > left
        at, left, count = at[hit], left[hit], (right - left)[hit]
        seen: dict[tuple[int, int], tuple[int, int]] = {}
        done = 0
        while done < len(at):  # hits in parts, so that a text full of common pieces can't fill the memory
            to = max(done + 1, int(np.searchsorted(np.cumsum(count[done:]), 200_000)) + done)
            c = count[done:to]
            entry = np.repeat(left[done:to], c) + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
            self._verify(doc, begin, np.repeat(at[done:to], c), entry, seen)
            done = to
        for (k, i), (distance, run) in seen.items():
            yield k, self.items[i][0], distance, run

    def _verify(self, doc, begin, at, entry, seen) -> None:
        w, k, s = self.window, self.budget, self.size
        item, off = self.item_of[entry], self.offset[entry]
        place = self.start[item] + off
        span = np.arange(-(w - s), w)
        near = np.zeros((len(at), len(span)), dtype=bool)
        there = self.flat[np.clip(place[:, None] + span, 0, len(self.flat) - 1)]
        for d in range(-k, k + 1):
            near |= doc[np.clip(at[:, None] + span + d, 0, len(doc) - 1)] == there
        sums = np.cumsum(np.pad(near, ((0, 0), (1, 0))), axis=1)
        hopeful = np.flatnonzero((sums[:, w:] - sums[:, :-w]).max(axis=1) >= w - k)  # words of some window that are near the diagonal
        for h in hopeful:
            p, o, i = int(at[h]), int(off[h]), int(item[h])
            text = int(np.searchsorted(begin, p, "right")) - 1
            best, run = seen.get((text, i), (k + 1, 0))
            if best == 0 and run >= w and near[h].all():
                continue
            nums = self.flat[self.start[i] : self.start[i] + len(self.items[i][1])].tolist()
            lo, hi = max(int(begin[text]), p - (w - s) - k), p + w + k
            part = doc[lo:hi].tolist()
            for a in range(max(0, o + s - w), min(o, len(nums) - w) + 1):
                if best:
                    best = min(best, myers(nums[a : a + w], part, k))
            a = b = 0
            while o - a - 1 >= 0 and doc[p - a - 1] == nums[o - a - 1]:
                a += 1
            while o + b < len(nums) and p + b < len(doc) and doc[p + b] == nums[o + b]:
                b += 1
            if best <= k:
                seen[text, i] = (best, max(run, a + b))


def write_blocks(items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> tuple[str, int]:
    """The items in blocks of about block_words words, made in the executors and written to the shared folder; the folder and
    the number of blocks. Items under `window` words can't leak and are left out; an item that comes twice counts once.
    Of the items only a number comes to the driver."""
    rows = items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").filter("item_id is not null and text is not null").distinct()
    most = rows.agg(F.sum(F.expr("(length(text) + 1) div 2")).alias("n")).first()["n"] or 0  # no text has more words
    count = max(1, -(-most // block_words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = [(k, i, ws) for k, i, t in zip(*(c.to_pylist() for c in b.columns)) if len(ws := words(t)) >= window]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in kept], kind) for c, kind in enumerate((pa.int32(), pa.int64(), pa.list_(pa.string())))], names=["block", "item_id", "words"])

    folder = scratch(items.sparkSession, "items")
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(count)).cast("int").alias("block")
    rows.select(block, "item_id", "text").mapInArrow(run, "block int, item_id bigint, words array<string>").repartition("block").write.partitionBy("block").parquet(folder)
    return folder, count


#: Blocks that a worker keeps; the words of documents that are searched for one block before the next is read.
_KEPT: OrderedDict[tuple, Block | None] = OrderedDict()
KEPT_BLOCKS, PASS_CHARS = 2, 64_000_000


def _block(folder: str, number: int, window: int, budget: int) -> Block | None:
    """A block as a worker needs it, read from the shared folder; None for one without items."""
    key = (folder, number, window, budget)
    if key not in _KEPT:
        while len(_KEPT) >= KEPT_BLOCKS:
            _KEPT.popitem(last=False)
        place = folder[5:].replace("//", "/") if folder.startswith("file:") else folder
        files, path = fs.FileSystem.from_uri(place) if "://" in place else (fs.LocalFileSystem(), place)
        path = f"{path}/block={number}"
        there = files.get_file_info(path).type != fs.FileType.NotFound
        t = pq.read_table(path, filesystem=files, partitioning=None).to_pydict() if there else {"item_id": []}
        _KEPT[key] = Block(sorted(zip(t["item_id"], t["words"])), window, budget) if t["item_id"] else None
    _KEPT.move_to_end(key)
    return _KEPT[key]


def find_leaks(documents: DataFrame, items: DataFrame, window: int = WINDOW, budget: int = BUDGET, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, item_id, distance, words_in_row of each document and item that leaked into it.

    distance: edits of the nearest window of `window` words (0 to budget). words_in_row: the item's words that stand in
    the document in a row, without letter case and whatever stands between them, through the places where a piece was
    hit. Null and empty texts give no rows; short items never leak; repeated documents and items count once. Every word
    of every document is read, in one scan: documents are neither shuffled nor collected. The items never come to the
    driver; tasks read them from the shared folder in blocks of about block_words words, a few at a time, and search for
    each block all documents of a pass before they read the next.
    """
    schema = "doc_id bigint, item_id bigint, distance int, words_in_row int"
    folder, count = write_blocks(items, window, block_words)

    def found(ids: list, texts: list) -> pa.RecordBatch:
        rows = [(ids[k], i, d, n) for b in range(count) if (block := _block(folder, b, window, budget)) is not None for k, i, d, n in block.search(texts)]
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)], names=["doc_id", "item_id", "distance", "words_in_row"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, chars = [], [], 0
        for b in batches:
            ids += b.column(0).to_pylist()
            texts += b.column(1).to_pylist()
            chars += b.column(1).nbytes
            if count == 1 or chars > PASS_CHARS:  # one block is always at hand; of more, each is read once in a pass
                yield found(ids, texts)
                ids, texts, chars = [], [], 0
        if ids:
            yield found(ids, texts)

    out = documents.select("doc_id", "text").filter("text is not null").mapInArrow(run, schema)
    return out.groupBy("doc_id", "item_id").agg(F.min("distance").alias("distance"), F.max("words_in_row").alias("words_in_row"))


def exact_leaks(leaks: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents that hold at least `window` words of an item in a row: doc_id, item_id."""
    return leaks.filter(F.col("words_in_row") >= window).select("doc_id", "item_id").distinct()
