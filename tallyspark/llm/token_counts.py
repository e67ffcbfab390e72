"""Token counts by a map-side two-tier lookup.

Tier 1: a compact table of the frequent pre-tokens' token counts is broadcast: 64-bit hashes by open addressing, bytes and
counts, looked up for all pre-tokens of a batch at once; an entry counts only if its bytes are the pre-token's.  Tier 2: misses go to a cache in the worker, and new
ones to the tokenizer, once each.  No pre-token is shuffled: every partition counts its own texts.

A pre-token is a run of spaces with the run of other characters behind it (the model's pieces hold the space mark only in
front, so counts of pre-tokens add up to the text's, for models that split by white space and add a dummy prefix without
further normalisation; others are refused).

The frequent table is fitted on a random sample of rows with about ``SAMPLE_BYTES`` of text, a documented bound: the sample's
texts are dealt to ``SAMPLE_PARTS`` tasks, of which each sends its ``top`` most frequent pre-tokens to the driver.  The table
changes speed, never results.

Defined results: null and empty texts have 0 tokens; special strings inside texts are ordinary text; texts are counted
whole, whatever their length, in parts that end before a run of spaces; repeated rows each count; an empty table gives an
empty table; an input column with the name of an output column gives way to it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import _BYTE, WORKER_CACHES, HashTable, cut_at, mix, parts_of_texts, runs_gathered, sums_of_runs, utf8, without

#: Entries of the broadcast table: a fixed bound, about 1 MB.
TOP = 16_384
#: Bytes of text that the table is fitted on, and tasks that count them.
SAMPLE_BYTES, SAMPLE_PARTS = 32 << 20, 8
CACHE = 200_000
_MARK = "▁"


class PieceCounter:
    """Token counts of pre-tokens under one SentencePiece model, with a bounded cache."""

    def __init__(self, path: str, cache: int = CACHE):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        spec = sentencepiece_model_pb2.ModelProto()
        spec.ParseFromString(self.model.serialized_model_proto())
        norm = spec.normalizer_spec
        inside = any(_MARK in p.piece.lstrip(_MARK) for p in spec.pieces)
        if norm.name != "identity" or not norm.add_dummy_prefix or norm.remove_extra_whitespaces or not norm.escape_whitespaces or inside or spec.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError(f"pre-tokens of {path} do not add up")
        # a space mark alone: the model gives nothing for an empty text, so it cannot be asked
        self.lone = 1 if self.model.piece_to_id(_MARK) != self.model.unk_id() else len(_MARK.encode())
        self.cache: dict[bytes, int] = {}
        self.size = cache

    def counts(self, pre_tokens: list[bytes]) -> list[int]:
        """Counts of pre-tokens, each given without its first space mark (the model puts it back)."""
        cache = self.cache
        new = [p for p in dict.fromkeys(pre_tokens) if p not in cache]
        if new:
            if len(cache) + len(new) > self.size:
                cache.clear()
                new = list(dict.fromkeys(pre_tokens))
            found = self.model.encode([p.decode("utf-8") for p in new], num_threads=1)
            cache.update((p, len(ids) if p else self.lone) for p, ids in zip(new, found, strict=True))
        return [cache[p] for p in pre_tokens]


@lru_cache(maxsize=2)
def piece_counter(path: str) -> PieceCounter:
    return PieceCounter(path)


WORKER_CACHES.append(piece_counter.cache_clear)


def pieces(raw: np.ndarray, offsets: np.ndarray, goes_on: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pre-tokens of concatenated texts: first byte behind the spaces, end, text, space marks in front (with the dummy prefix,
    but for a part that goes on with a text), hash of the bytes.  Trailing spaces are a pre-token of their own, with no
    bytes behind its marks."""
    other = raw != 0x20
    begin = offsets[:-1][offsets[:-1] < len(raw)]
    first, last = other.copy(), other.copy()
    first[1:] &= ~other[:-1]
    first[begin] = other[begin]
    last[:-1] &= ~other[1:] | first[1:]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    lengths = np.diff(offsets)
    space_end = np.flatnonzero((lengths > 0) & (raw[np.maximum(offsets[1:] - 1, 0)] == 0x20)) if len(raw) else np.zeros(0, np.int64)
    starts, ends = np.concatenate([starts, offsets[1:][space_end]]), np.concatenate([ends, offsets[1:][space_end]])
    docs = np.searchsorted(offsets, starts, side="right") - 1
    docs[len(docs) - len(space_end) :] = space_end
    order = np.lexsort((starts, docs))
    starts, ends, docs = starts[order], ends[order], docs[order]
    before = np.empty(len(ends), np.int64)
    before[1:] = ends[:-1]
    head = np.ones(len(docs), bool)
    head[1:] = docs[1:] != docs[:-1]
    before[head] = offsets[:-1][docs[head]]
    marks = starts - before + (head & ~goes_on[docs])
    return starts, ends, docs, marks, mix(sums_of_runs(_BYTE[raw], starts, ends) + (ends - starts).astype(np.uint64))


#: A text may be cut in front of a space that follows another byte.
_cut = cut_at(lambda w: (w == 0x20) & np.r_[False, w[:-1] != 0x20])


def _parts(column: pa.Array) -> Iterator[tuple[np.ndarray, ...]]:
    mark = np.frombuffer(_MARK.encode(), np.uint8)
    raw, offsets = utf8(column)
    if (raw == mark[0]).any() and _MARK.encode() in raw.tobytes():  # the mark in a text is a space to the model
        raw, offsets = utf8(pc.replace_substring(column.fill_null(""), _MARK, " "))
    return parts_of_texts(raw, offsets, _cut)


def frequent_pre_tokens(docs: DataFrame, text: str = "text", top: int = TOP, sample_bytes: int = SAMPLE_BYTES) -> list[bytes]:
    """The most frequent pre-tokens of a sample of rows with about ``sample_bytes`` of text, counted in ``SAMPLE_PARTS`` tasks
    of which each sends its ``top`` ones to the driver."""
    total = docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    sample = docs.select(text).where(F.rand(7) < F.lit(sample_bytes / max(1, total))).repartition(SAMPLE_PARTS)

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for raw, offsets, _, goes_on in _parts(b.column(0)):
                starts, ends, _, marks, hashes = pieces(raw, offsets, goes_on)
                plain = marks == 1
                _, first, n = np.unique(hashes[plain], return_index=True, return_counts=True)
                s, e, view = starts[plain][first].tolist(), ends[plain][first].tolist(), raw.tobytes()
                for i, j, k in zip(s, e, n.tolist(), strict=True):
                    seen[view[i:j]] += k
            if len(seen) > 16 * top:
                seen = Counter(dict(seen.most_common(top)))
        best = seen.most_common(top)
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in best], pa.binary()), pa.array([v for _, v in best], pa.int64())], ["piece", "n"])

    seen: Counter = Counter()
    for piece, n in sample.mapInArrow(summary, "piece binary, n long").collect():
        seen[bytes(piece)] += n
    return [k for k, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:top]]


def same_bytes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, entry: np.ndarray, known: np.ndarray, known_starts: np.ndarray, known_ends: np.ndarray) -> np.ndarray:
    """Whether each pre-token has the bytes of the entry found by its hash (-1: none was found)."""
    out = entry >= 0
    at, size = np.flatnonzero(out), ends - starts
    equal = size[at] == (known_ends - known_starts)[entry[at]]
    out[at[~equal]] = False
    at = at[equal & (size[at] > 0)]
    if len(at):
        differ = runs_gathered(raw, starts[at], size[at]) != runs_gathered(known, known_starts[entry[at]], size[at])
        out[at[np.logical_or.reduceat(differ, np.cumsum(size[at]) - size[at])]] = False
    return out


def count_tokens(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None, frequent: list[bytes] | None = None) -> DataFrame:
    """``keep`` columns (all others by default) with n_bytes (UTF-8) and n_tokens of each text."""
    keep = without([c for c in docs.columns if c != text] if keep is None else keep, ["n_bytes", "n_tokens"])
    schema = docs.select(*keep).schema.add("n_bytes", "long").add("n_tokens", "long")
    frequent = frequent_pre_tokens(docs, text) if frequent is None else frequent
    raw = np.frombuffer(b"".join(frequent), np.uint8)
    ends = np.cumsum([len(p) for p in frequent]).astype(np.int64)
    starts = ends - np.array([len(p) for p in frequent], np.int64)
    hashes = mix(sums_of_runs(_BYTE[raw], starts, ends) + (ends - starts).astype(np.uint64))
    table = HashTable(max(1, len(frequent)))
    table.add(hashes, np.arange(len(frequent), dtype=np.int32))
    shared = docs.sparkSession.sparkContext.broadcast((table, np.array(PieceCounter(path).counts(frequent), np.int64), raw, starts, ends))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (table, counts, *known), worker = shared.value, piece_counter(path)
        for b in batches:
            total = np.zeros(b.num_rows, np.int64)
            for raw, offsets, text_of, goes_on in _parts(b.column(text)):
                starts, ends, at, marks, hashes = pieces(raw, offsets, goes_on)
                entry = np.where(marks == 1, table.find(hashes), -1).astype(np.int64)
                entry[~same_bytes(raw, starts, ends, entry, *known)] = -1
                found = np.where(entry >= 0, counts[entry], -1) if len(counts) else entry
                miss = np.flatnonzero(found < 0)
                view = raw.tobytes()
                found[miss] = worker.counts([b" " * (m - 1) + view[i:j] for i, j, m in zip(starts[miss].tolist(), ends[miss].tolist(), marks[miss].tolist(), strict=True)])
                np.add.at(total, text_of, np.bincount(at, found, len(offsets) - 1).astype(np.int64))
            sizes = pc.coalesce(pc.binary_length(b.column(text)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), sizes, pa.array(total)], [*keep, "n_bytes", "n_tokens"])

    return docs.select(*keep, text).mapInArrow(run, schema)
