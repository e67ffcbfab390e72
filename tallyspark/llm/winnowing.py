"""Document fingerprints by winnowing.

Rolling hashes of all k-grams of code points, the minimum of every window of w consecutive hashes, the rightmost one
among equal minima, each selected position kept once.  Any passage of at least w + k - 1 code points that two texts share
contributes the same fingerprint to both, and the positions say where.

Defined results: null counts as empty; an empty text has no fingerprint (the empty string), a text shorter than k is one
gram; two texts without fingerprints are alike (1.0), one with and one without are not (0.0); likeness is the Jaccard
index of the sets of fingerprint hashes.  The next document follows by ascending doc_id (null first), then text; rows that
repeat follow each other; the last is followed by the first; a single document follows itself; an empty table gives an
empty table.  Texts of any length are read whole, long ones in stretches that overlap by a window.  An input column named
fingerprint gives way to the output's; the comparison reads doc_id and text only.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import _Q, block_count, mix, packed, repeated, sliding_min, sums_of_runs, unpack, without

#: Code points of a gram, and grams of a window: passages of 48 code points are sure to be found.
K, W = 16, 33
#: Code points that are hashed at a time.
STEP = 1 << 18
#: Ranges of documents beyond which they are larger than blocks, by how much they then are; sampled keys for each; code points
#: of a text that ranges are told apart by within one doc_id.
MANY, LARGER, SAMPLED, PREFIX = 4096, 8, 64, 64


def winnow(points: np.ndarray, offsets: np.ndarray, k: int = K, w: int = W) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints of concatenated texts (code points): document index, position in its text, hash; by position."""
    lengths = np.diff(offsets)
    n_grams = np.where(lengths >= k, lengths - k + 1, np.minimum(lengths, 1))
    total = int(n_grams.sum())
    if not total:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(lengths)), n_grams)
    base = np.concatenate([[0], np.cumsum(n_grams)])
    at = np.arange(total) - base[doc]
    start = offsets[doc] + at
    hashes = mix(sums_of_runs(mix(points.astype(np.uint64)), start, np.minimum(start + k, offsets[doc + 1]), _Q))
    # windows: inside one text; a text with fewer than w grams is one window
    full = n_grams >= w
    pick = np.zeros(total, bool)
    if total >= w:
        low = sliding_min(hashes, w)
        inside = doc[: len(low)] == doc[w - 1 :]
        # the rightmost minimum moves when the minimum changes or an equal hash enters
        new = np.ones(len(low), bool)
        new[1:] = (low[1:] != low[:-1]) | (hashes[w:] == low[1:]) | ~inside[:-1]
        opening = np.flatnonzero(new & inside)
        if len(opening):
            run_low = low[opening]
            # an equal hash that enters is itself the rightmost minimum; otherwise look for it in the window
            entered = hashes[opening + w - 1] == run_low
            pick[opening[entered] + w - 1] = True
            for part in np.array_split(opening[~entered], max(1, len(opening) // 4096)):
                window = np.lib.stride_tricks.sliding_window_view(hashes, w)[part][:, ::-1]
                pick[part + w - 1 - np.argmax(window == low[part][:, None], axis=1)] = True
    for d in np.flatnonzero((n_grams > 0) & ~full):
        h = hashes[base[d] : base[d + 1]]
        pick[base[d + 1] - 1 - int(np.argmin(h[::-1]))] = True
    chosen = np.flatnonzero(pick)
    return doc[chosen], at[chosen], hashes[chosen]


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(t) for t in texts], np.int64)
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), np.concatenate([[0], np.cumsum(lengths)])


def _entries(at: np.ndarray, hashes: np.ndarray) -> str:
    return ",".join([f"{h:016x}@{p}" for h, p in zip(hashes.tolist(), at.tolist(), strict=True)])


def long_fingerprint(text: str, k: int, w: int, step: int = STEP) -> tuple[str, np.ndarray]:
    """``fingerprints`` of one text, in stretches of about ``step`` windows."""
    parts, sets, last = [], [], -1
    for begin in range(0, max(1, len(text) - k - w + 2), step):
        _, at, hashes = winnow(*_points([text[begin : begin + step + w + k - 2]]), k, w)
        at = at + begin
        at, hashes = at[at > last], hashes[at > last]  # the first one may be known from the stretch before
        if len(at):
            last = int(at[-1])
            parts.append(_entries(at, hashes))
            sets.append(np.unique(hashes))
    return ",".join(parts), np.unique(np.concatenate(sets)) if sets else np.zeros(0, np.uint64)


def fingerprints(texts: list[str], k: int = K, w: int = W) -> tuple[list[str], list[np.ndarray]]:
    """Of each text: ``hash@position`` entries (16 hex digits, decimal) joined by commas, and the distinct hashes."""
    prints: list[str] = []
    sets: list[np.ndarray] = []
    for i, j in _slices([len(t) for t in texts]):
        if j == i + 1 and len(texts[i]) > 2 * STEP:
            one, own = long_fingerprint(texts[i], k, w)
            prints.append(one), sets.append(own)
            continue
        doc, at, hashes = winnow(*_points(texts[i:j]), k, w)
        cuts = np.searchsorted(doc, np.arange(j - i + 1))
        prints += [_entries(at[a:b], hashes[a:b]) for a, b in zip(cuts, cuts[1:])]
        sets += [np.unique(hashes[a:b]) for a, b in zip(cuts, cuts[1:])]
    return prints, sets


def _slices(lengths: list[int], most: int = STEP) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``most`` code points together (a longer text alone)."""
    i = 0
    while i < len(lengths):
        j, n = i + 1, lengths[i]
        while j < len(lengths) and n + lengths[j] <= most:
            n += lengths[j]
            j += 1
        yield i, j
        i = j


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def fingerprint_documents(docs: DataFrame, k: int = K, w: int = W, text: str = "text") -> DataFrame:
    """``docs`` with a column ``fingerprint`` of each text: a map without shuffle."""
    keep = without(docs.columns, ["fingerprint"])
    schema = docs.select(*keep).schema.add("fingerprint", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = fingerprints([t or "" for t in b.column(text).to_pylist()], k, w)[0]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], [f.name for f in schema])

    return docs.select(*keep).mapInArrow(run, schema)


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as many first code points of the following text (all, if it has fewer)."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


class Ranges:
    """Ranges of documents by (doc_id, first code points of the text), null ids first: each begins with a key of the table."""

    def __init__(self, marks: list[tuple[int | None, str]], first: tuple[int | None, str]):
        self.first = first
        self.none = sorted({p for d, p in marks if d is None and (d, p) != first})
        known = sorted({(d, p) for d, p in marks if d is not None and (d, p) != first})
        self.ids, self.prefixes = np.array([d for d, _ in known], np.int64), [p for _, p in known]

    def __len__(self) -> int:
        return len(self.none) + len(self.prefixes) + 1

    def place(self, ids: pa.Array, prefixes: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The range of each row, and the one that it follows as its successor if it opens a range (-1: none)."""
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        values = ids.fill_null(0).to_numpy(zero_copy_only=False)
        low, high = np.searchsorted(self.ids, values), np.searchsorted(self.ids, values, side="right")
        at = np.where(known, len(self.none) + high, 0)
        opens = np.full(len(at), -1, np.int64)
        first_id = self.first[0]
        look = np.flatnonzero(np.where(known, (low < high) | (values == (0 if first_id is None else first_id)), True))
        for i, p in zip(look.tolist(), prefixes.take(pa.array(look)).to_pylist(), strict=True):
            if known[i]:
                k = bisect_right(self.prefixes, p, int(low[i]), int(high[i]))
                at[i] = len(self.none) + k
                if k > low[i] and self.prefixes[k - 1] == p:
                    opens[i] = at[i] - 1
            else:
                at[i] = k = bisect_right(self.none, p)
                if k and self.none[k - 1] == p:
                    opens[i] = k - 1
            if (int(values[i]) if known[i] else None, p) == self.first:
                opens[i] = len(self) - 1
        return at, opens


def ranges_of(docs: DataFrame) -> Ranges | None:
    """Ranges of about equal numbers of bytes.  Rows are sampled in proportion to their size, about ``SAMPLED`` a range, and sorted
    in Spark; a sampled row stands for the bytes that its chance was taken from, and a range begins where those of the ranges
    before are full.  The driver gets one key a range.  None for an empty table."""
    n = block_count(docs)
    n = max(min(n, MANY), n // LARGER)
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("double")
    keys = docs.select("doc_id", F.coalesce(F.substring("text", 1, PREFIX), F.lit("")).alias("p"), size.alias("size"))
    total, least = keys.agg(F.sum("size"), F.min(F.struct(F.col("doc_id").isNotNull().alias("k"), "doc_id", "p"))).first()
    if total is None:
        return None
    marks = []
    if n > 1:
        step = total / n

        def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            done = step / 2
            for b in batches:
                ends = done + np.cumsum(b.column(2).to_numpy())
                before = np.r_[done, ends[:-1]]
                yield b.take(pa.array(np.flatnonzero(ends // step > before // step))).select(["doc_id", "p"])
                done = ends[-1] if len(ends) else done

        stands = F.greatest("size", F.lit(step / SAMPLED))
        sample = keys.where(F.rand(11) * step < F.col("size") * SAMPLED).withColumn("size", stands).orderBy(F.asc_nulls_first("doc_id"), "p")
        marks = [(d, p) for d, p in sample.mapInArrow(full, "doc_id long, p string").collect()]
    return Ranges(marks, (least["doc_id"], least["p"]))


def followed(docs: DataFrame) -> DataFrame:
    """Rows of (doc_id, text) dealt into ranges of ascending keys, packed as (block, payload) with the columns ``guard`` and
    ``times`` (equal rows).

    The rows that open a range also go to the range before it, marked ``guard``, so that every row meets its successor in
    its own task.  Rows that share a doc_id and the first ``PREFIX`` code points share a range."""
    ranges = ranges_of(docs)
    shared = docs.sparkSession.sparkContext.broadcast(ranges)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prefixes = pc.utf8_slice_codeunits(b.column("text").fill_null(""), 0, PREFIX)
            at, opens = shared.value.place(b.column("doc_id"), prefixes)
            again = np.flatnonzero(opens >= 0)
            rows = np.concatenate([np.arange(len(at)), again])
            guard = np.repeat([False, True], [len(at), len(again)])
            part = b.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([at, opens[again]]), pa.int32()), pa.array(guard), *part.columns], ["block", "guard", *part.schema.names])

    return packed(docs.mapInArrow(place, "block int, guard boolean, doc_id long, text string"), "block", "times")


def compare_with_edits(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """Of each document (doc_id, text): n_chars, edited_sha256, fingerprint and edited_fingerprint, near_edited and near_next."""
    rows = followed(docs.select(F.col("doc_id").cast("long"), "text"))
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, _times long"

    def run(key: tuple, groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = unpack(pa.chunked_array([g.column("payload") for g in groups]))
        t = t.set_column(t.schema.get_field_index("text"), "text", t.column("text").fill_null(""))
        order = pc.sort_indices(t, [("guard", "ascending"), ("doc_id", "ascending"), ("text", "ascending")], null_placement="at_start")
        t = t.take(order)
        n = int(pc.sum(pc.invert(t.column("guard"))).as_py() or 0)
        size = pc.utf8_length(t.column("text")).to_pylist()[: n + 1]
        total = len(size)
        for a, b in _slices(size[:n]):
            own = t.slice(a, min(b + 1, total) - a)  # with the row behind
            ids, texts, times = own.column("doc_id").to_pylist(), own.column("text").to_pylist(), own.column("times").to_pylist()
            prints, sets = fingerprints(texts, k, w)
            out: list[tuple] = []
            for j in range(b - a):
                # all but the last of equal rows are followed by one of them
                for other, count in ((j, times[j] - 1), (j + 1, 1)):
                    if count:
                        out.append((j, min(other, len(texts) - 1), count))
            changed = [edited(texts[j], texts[o]) for j, o, _ in out]
            prints_e, sets_e = fingerprints(changed, k, w)
            yield pa.RecordBatch.from_arrays([
                pa.array([ids[j] for j, _, _ in out], pa.int64()), pa.array([len(texts[j]) for j, _, _ in out], pa.int64()),
                pa.array([hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in changed]), pa.array([prints[j] for j, _, _ in out]), pa.array(prints_e),
                pa.array([likeness(sets[j], e) for (j, _, _), e in zip(out, sets_e, strict=True)]), pa.array([likeness(sets[j], sets[o]) for j, o, _ in out]), pa.array([c for _, _, c in out], pa.int64())],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "_times"])

    return repeated(rows.groupBy("block").applyInArrow(run, schema), "_times")
