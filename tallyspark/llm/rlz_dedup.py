"""Substring dedup by Relative Lempel-Ziv parsing over words.

The corpus is its own reference, cut into blocks; a word's address in it is (block, number within the block).  Documents
are parsed from the left.  At a position, the index names a place elsewhere where the next ``width`` words stand: the next
one in the own block (behind the last one comes the first), else the first one in the next block that has any.  The
match is extended word by word against that block's words, as long as both agree, and the parse jumps to its end.  There
the index is asked again for the windows over the boundary (those that begin inside the factor just closed, and the one at
its end); the one that reaches furthest makes the next factor, which begins at the boundary.  Where none does, the parse
goes on at the next word with a match.  So factors don't overlap, each can't be extended at its source, and their words
are just those of all windows that occur elsewhere: the duplicate spans.  A factor is the longest one of the places the
index names, not of all places in the corpus.

Index, in rounds in which every block is looked up against all others:

1. Anchors: of every window of ``width`` words, the smallest ``K``-gram hash.  Equal windows have equal anchors, so only
   windows behind an anchor that occurs twice (about 2 / (width - K + 2) anchors a word are sent) can be duplicates.
2. Windows behind shared anchors: the hash of all their words and their address; the answer is the address of an equal
   window in the next block.  As each block is sent on to the next one, no block answers for a passage that all have.
3. Extensions: where neighbouring windows were found at places that don't follow each other, the words behind go to the
   block that has the first place, which answers how many of them it has.

Each round a block sends a shard (or block) one row with its distinct values and gets one answer a value; a passage in a
third of all documents is one entry a block.  No block, shard or group of copies needs more than its share of memory.

Defined results: a null or empty text has no words and an empty kept text; texts of fewer than ``width`` words are kept;
rows with the same text are duplicates of each other, also rows that repeat entirely (one entry with a count; such a row
is its own source); null and repeated doc_ids are ids like others; windows are judged on the input.  Columns other than
doc_id and text are left out; an empty table gives an empty table.  Texts of any length are read whole, in parts that end
between words.  Windows are compared by 64-bit hashes of all their words, under a 64-bit hash of an anchor that they share.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import ANSWER, SENT, cut_words, block_rows, block_words, corpus_blocks, count_in_shards, give_memory_back, grams, joined_answers, parts_of_texts, repeated, runs_gathered, sent_rows, sliding_min, utf8

WIDTH, K = 35, 12
#: Blocks for each shard of the hash space.
SHARE = 2
_whole = lambda v, _: v.tobytes()
_read = lambda b: np.frombuffer(b, np.uint64)


@dataclass
class Words:
    """A block's words and anchors."""

    doc: np.ndarray
    bounds: np.ndarray
    hashes: np.ndarray
    #: how often the table has each document's row
    times: np.ndarray
    #: first word of every window inside one document, the run of windows under one anchor that it is in, runs' anchors
    windows: np.ndarray
    run: np.ndarray
    anchors: np.ndarray
    anchor_times: np.ndarray
    width: int

    @classmethod
    def of(cls, table: pa.Table, width: int, k: int) -> Words:
        doc, hashes, bounds = block_words(table)
        times = table.column("times").to_numpy()
        n = len(hashes) - width + 1
        if n <= 0:
            none = np.zeros(0, np.int64)
            return cls(doc, bounds, hashes, times, none, none, np.zeros(0, np.uint64), none, width)
        g = grams(hashes, k)
        low = sliding_min(g, width - k + 1)
        inside = doc[:n] == doc[width - 1 :]
        new = np.ones(n, bool)
        new[1:] = (low[1:] != low[:-1]) | (g[width - k + 1 :] == low[1:]) | ~inside[:-1]
        new &= inside
        windows = np.flatnonzero(inside).astype(np.int32)
        return cls(doc, bounds, hashes, times, windows, (np.cumsum(new, dtype=np.int32) - 1)[windows], low[new], times[doc[:n][new]], width)

    @cached_property
    def distinct_anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct anchors, which of them each run has, and how often each occurs."""
        values, inverse = np.unique(self.anchors, return_inverse=True)
        return values, inverse, np.bincount(inverse, self.anchor_times, len(values))

    def candidates(self, answers: np.ndarray) -> Candidates:
        """Windows under shared anchors."""
        at = self.windows[(answers > 0)[self.distinct_anchors[1]][self.run]].astype(np.int64)
        values, first, inverse = np.unique(grams(self.hashes, self.width)[at], return_index=True, return_inverse=True)
        return Candidates(at, values, at[first], inverse, np.bincount(inverse, self.times[self.doc[at]], len(values)))


@dataclass
class Candidates:
    """First words of windows, ascending; distinct hashes, the first place of each, which of them each window has, and how
    often each occurs."""

    at: np.ndarray
    values: np.ndarray
    first: np.ndarray
    inverse: np.ndarray
    times: np.ndarray


@dataclass
class Found:
    """Windows that occur elsewhere: first words (ascending) and the address of another place of each."""

    at: np.ndarray
    block: np.ndarray
    place: np.ndarray
    #: last window of the stretch in which windows and places move together, and last window before one without a place
    last: np.ndarray
    run_end: np.ndarray

    @classmethod
    def of(cls, block: int, words: Words, c: Candidates, answers: np.ndarray) -> Found:
        found = answers[c.inverse]
        n = len(c.at)
        # places in the own block: the next window with the same hash, cyclically
        order = np.argsort(c.inverse, kind="stable")
        same = c.inverse[order]
        opens = np.flatnonzero(np.r_[True, same[1:] != same[:-1]][:n])
        size = np.diff(np.r_[opens, n])
        following = np.arange(1, n + 1)
        following[opens + size - 1] = opens
        place = np.empty(n, np.int64)
        place[order] = c.at[order[following]] if n else 0
        own = (c.times[c.inverse] > 1)
        hit = own | (found["hit"] > 0)
        source = np.where(own, block, found["block"].astype(np.int64))[hit]
        place = np.where(own, place, found["place"].astype(np.int64))[hit]
        at = c.at[hit]
        near = (at[1:] == at[:-1] + 1) & (words.doc[at[1:]] == words.doc[at[:-1]])
        along = near & (source[1:] == source[:-1]) & (place[1:] == place[:-1] + 1)
        return cls(at, source, place, _last_of(at, along), _last_of(at, near))

    def open_ends(self) -> np.ndarray:
        """Windows (indices, one a stretch) whose match may go on although the next window was found elsewhere; by block."""
        heads = np.flatnonzero((self.at == self.last) & (self.last < self.run_end))
        return heads[np.argsort(self.block[heads], kind="stable")]

    def sought(self, ends: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Words behind the match of each open end, as many as can go on, and their numbers."""
        size = self.run_end[ends] - self.at[ends]
        return size, runs_gathered(words.hashes, self.at[ends] + words.width, size)


def _last_of(at: np.ndarray, goes_on: np.ndarray) -> np.ndarray:
    ends = np.flatnonzero(np.r_[~goes_on, True][: len(at)])
    return at[ends[np.searchsorted(ends, np.arange(len(at)))]] if len(at) else at


def agreement(words: np.ndarray, places: np.ndarray, sizes: np.ndarray, sought: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many words of each sought list (sizes, one behind the other) stand at its place, up to its document's end."""
    begin = np.cumsum(sizes) - sizes
    of = np.repeat(np.arange(len(sizes)), sizes)
    at = places[of] + np.arange(len(of)) - begin[of]
    end = bounds[np.searchsorted(bounds, places - 1, side="right")]
    wrong = (at >= end[of]) | (words[np.minimum(at, len(words) - 1)] != sought)
    first = np.where(wrong, np.arange(len(of)) - begin[of], sizes[of])
    return np.minimum.reduceat(first, begin) if len(sizes) else sizes


def parse(at: list[int], reach: list[int], width: int) -> list[tuple[int, int, int]]:
    """Greedy factors (first word, end, index of the window that gives the source) of one document, from its windows with
    a place elsewhere and how far the match of each goes."""
    out = []
    i, p, before = 0, -1, -1
    while True:
        k = max(range(bisect_left(at, max(before + 1, p - width + 1)), bisect_right(at, p)), key=lambda j: (reach[j], -j), default=-1)
        if k >= 0 and reach[k] > p:
            out.append((p, reach[k], k))
            before, p = p, reach[k]
            continue
        i = bisect_right(at, p)
        if i == len(at):
            return out
        p, before = at[i], at[i] - 1


_SENT = SENT + ", places binary"
_ADDRESS = np.dtype([("hit", "u1"), ("block", "<u4"), ("place", "<u4")])


def find_sources(sent: DataFrame) -> DataFrame:
    """Answers to every block: nine bytes a value, whether it occurs elsewhere and its address in the next block that has it."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_memory_back()
        t = pa.Table.from_batches(list(batches))
        values = [_read(x.as_buffer()) for x in t.column("sent")]
        sizes = [len(v) for v in values]
        value = np.concatenate(values)
        times = np.concatenate([np.frombuffer(x.as_buffer(), np.uint8) for x in t.column("times")])
        place = np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in t.column("places")])
        block = np.repeat(t.column("block").to_numpy().astype(np.uint32), sizes)
        order = np.lexsort((block, value))
        ordered = value[order]
        opens = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
        size = np.diff(np.r_[opens, len(order)])
        following = np.arange(1, len(order) + 1)
        following[opens + size - 1] = opens
        source = order[following]
        out = np.zeros(len(order), _ADDRESS)
        out["hit"][order] = np.repeat(size > 1, size) | (times[order] > 1)
        out["block"][order], out["place"][order] = block[source], place[source]
        out[out["hit"] == 0] = np.zeros(1, out.dtype)
        answers = [a.tobytes() for a in np.split(out, np.cumsum(sizes)[:-1])]
        yield pa.RecordBatch.from_arrays([t.column("block").combine_chunks(), pa.array([key[0].as_py()] * len(answers), pa.int32()), pa.array(answers, pa.binary())], ["block", "shard", "answer"])

    return sent.groupBy("shard").applyInArrow(run, ANSWER)


_ASKED = "block int, asks int, places binary, sizes binary, words binary"
_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_FACTOR = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("source_block", pa.int32()), ("source_word", pa.int32()), ("parsed", pa.int32())]))


def dedup_substrings(docs: DataFrame, width: int = WIDTH, k: int = K) -> DataFrame:
    """doc_id, n_words, n_removed, spans (first word and end of every removed stretch), factors, kept (text), text_sha256 (of
    the input text, which tells rows of one doc_id apart).

    A factor covers the words from ``parsed`` to ``end``; its match with the words at its source begins at ``start``, which is
    before ``parsed`` for one that was found over a boundary.  A match has ``width`` words at least."""
    blocks, n_blocks = corpus_blocks(docs)
    shards = -(-n_blocks // SHARE)

    def send_anchors(table: pa.Table) -> pa.Table:
        block, rows = block_rows(table)
        values, _, times = Words.of(rows, width, k).distinct_anchors
        return pa.Table.from_batches([sent_rows(block, values, times, shards, _whole)])

    def send_windows(table: pa.Table, replies: pa.Table) -> pa.Table:
        block, rows = block_rows(table)
        c = Words.of(rows, width, k).candidates(joined_answers(replies))
        sent = sent_rows(block, c.values, c.times, shards, _whole)
        sizes = np.array([len(x.as_buffer()) // 8 for x in sent.column("sent")], np.int64)
        places = [p.tobytes() for p in np.split(c.first.astype(np.uint32), np.cumsum(sizes)[:-1])] if len(sizes) else []
        return pa.Table.from_batches([sent]).append_column("places", pa.array(places, pa.binary()))

    def looked_up(table: pa.Table, replies: pa.Table) -> tuple[int, pa.Table, Words, Found]:
        block, rows = block_rows(table)
        words = Words.of(rows, width, k)
        shard = replies.column("shard")
        c = words.candidates(joined_answers(replies.filter(pc.less(shard, shards))))
        answers = joined_answers(replies.filter(pc.and_(pc.greater_equal(shard, shards), pc.less(shard, 2 * shards))))
        return block, rows, words, Found.of(block, words, c, answers.view(_ADDRESS))

    def ask_on(table: pa.Table, replies: pa.Table) -> pa.Table:
        block, _, words, found = looked_up(table, replies)
        ends = found.open_ends()
        ends = ends[found.block[ends] != block]
        out: list[list] = [[], [], [], []]
        for part in np.split(ends, np.flatnonzero(np.diff(found.block[ends])) + 1) if len(ends) else []:
            size, sought = found.sought(part, words)
            for column, x in zip(out, (int(found.block[part[0]]), (found.place[part] + width).astype(np.uint32).tobytes(), size.astype(np.uint32).tobytes(), sought.tobytes())):
                column.append(x)
        return pa.table([pa.array(out[0], pa.int32()), pa.array([block] * len(out[0]), pa.int32()), *(pa.array(c, pa.binary()) for c in out[1:])], ["block", "asks", "places", "sizes", "words"])

    def extend(table: pa.Table, asked: pa.Table) -> pa.Table:
        answers = []
        if asked.num_rows:
            block, rows = block_rows(table)
            _, hashes, bounds = block_words(rows)
            for p, n, w in zip(asked.column("places"), asked.column("sizes"), asked.column("words"), strict=True):
                places, sizes = np.frombuffer(p.as_buffer(), np.uint32).astype(np.int64), np.frombuffer(n.as_buffer(), np.uint32).astype(np.int64)
                answers.append(agreement(hashes, places, sizes, _read(w.as_buffer()), bounds).astype(np.uint32).tobytes())
        source = [2 * shards + b for b in asked.column("block").to_pylist()]
        return pa.table([asked.column("asks"), pa.array(source, pa.int32()), pa.array(answers, pa.binary())], ["block", "shard", "answer"])

    def remove(table: pa.Table, replies: pa.Table) -> pa.Table:
        block, rows, words, found = looked_up(table, replies)
        ends = found.open_ends()
        more = np.zeros(len(ends), np.int64)
        own = found.block[ends] == block
        more[~own] = joined_answers(replies.filter(pc.greater_equal(replies.column("shard"), 2 * shards))).view(np.uint32)
        if own.any():
            mine = ends[own]
            more[own] = agreement(words.hashes, found.place[mine] + width, *found.sought(mine, words), words.bounds)
        beyond = np.zeros(len(found.at), np.int64)
        beyond[ends] = more
        reach = found.last + width + beyond[np.searchsorted(found.at, found.last)]
        cuts = np.searchsorted(found.at, words.bounds)
        raw, offsets = utf8(rows.column("text"))
        raw = memoryview(raw)
        n_removed, spans, factors, kept, digests = [], [], [], [], []
        for i in range(rows.num_rows):
            a, own_rows = int(words.bounds[i]), slice(cuts[i], cuts[i + 1])
            text = bytes(raw[offsets[i] : offsets[i + 1]])
            digests.append(hashlib.sha256(text).hexdigest())
            at, to, block_of, place_of = ((x[own_rows] - y).tolist() for x, y in ((found.at, a), (reach, a), (found.block, 0), (found.place, 0)))
            parsed = parse(at, to, width)
            merged: list[dict] = []
            for p, q, _ in parsed:
                if merged and p <= merged[-1]["end"]:
                    merged[-1]["end"] = q
                else:
                    merged.append({"start": p, "end": q})
            factors.append([{"start": at[j], "end": q, "source_block": block_of[j], "source_word": place_of[j], "parsed": p} for p, q, j in parsed])
            spans.append(merged)
            n_removed.append(sum(m["end"] - m["start"] for m in merged))
            kept.append(without_spans(text, merged))
        return pa.table([rows.column("doc_id"), pa.array(np.diff(words.bounds), pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, _SPAN), pa.array(factors, _FACTOR), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(digests, pa.string()), rows.column("times")],
                        ["doc_id", "n_words", "n_removed", "spans", "factors", "kept", "text_sha256", "_times"])

    by_block = blocks.groupBy("block")
    first = count_in_shards(by_block.applyInArrow(send_anchors, SENT), _read)
    second = find_sources(by_block.cogroup(first.groupBy("block")).applyInArrow(send_windows, _SENT)).withColumn("shard", F.col("shard") + shards)
    replies = first.unionByName(second)
    asked = by_block.cogroup(replies.groupBy("block")).applyInArrow(ask_on, _ASKED)
    third = by_block.cogroup(asked.groupBy("block")).applyInArrow(extend, ANSWER)
    done = by_block.cogroup(replies.unionByName(third).groupBy("block")).applyInArrow(
        remove, "doc_id long, n_words long, n_removed long, spans array<struct<start:int,end:int>>, factors array<struct<start:int,end:int,source_block:int,source_word:int,parsed:int>>, kept string, text_sha256 string, _times long")
    return repeated(done, "_times")


def without_spans(text: bytes, spans: list[dict]) -> bytes:
    """The words of a text that no span covers, joined by one space."""
    out, n, todo = [], 0, 0
    for part, _, _, _ in parts_of_texts(np.frombuffer(text, np.uint8), np.array([0, len(text)]), cut_words):
        words = part.tobytes().split()
        end, last = n + len(words), n
        keep: list[bytes] = []
        while todo < len(spans) and spans[todo]["start"] < end:
            keep += words[last - n : max(last, spans[todo]["start"]) - n]
            last = min(spans[todo]["end"], end)
            if spans[todo]["end"] > end:
                break
            todo += 1
        keep += words[last - n :]
        n = end
        if keep:
            out.append(b" ".join(keep))
    return b" ".join(out)
