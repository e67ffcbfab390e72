"""Shared helpers: corpus blocks, shard exchange, vectorised word hashing and hash tables.

A *block* is a fixed-size share of the corpus, dealt by a hash of document id and text, so that no source, no null or
repeated id and no group of copies makes a block large; rows that repeat entirely are one entry a map batch, with a
count.  A *shard* is a share of the hash space; a block sends a shard one binary row with all of its hashes in that
shard, so that frequent values cost one entry per block and shards stay even whatever the text looks like.
"""

from __future__ import annotations

import contextlib
import ctypes
import itertools
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Raw text bytes in a block: bounds a Python worker's memory, so the number of blocks grows with the data.
BLOCK_BYTES = 8 << 20
WORD = r"[^\x20\x09-\x0D]+"


@lru_cache(maxsize=1)
def give_memory_back() -> None:
    """Called by functions that run in Python workers: large arrays go back to the system when they are freed.  Workers
    live through many stages, and by default glibc and Arrow's pool would keep each at the largest size that it ever had."""
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD: fixed, not raised by use
        libc.mallopt(-1, 4 << 20)  # M_TRIM_THRESHOLD
    except (OSError, AttributeError):
        pass


#: What drops the tables that a worker keeps between tasks (vocabularies, caches).  Operators that hold whole blocks call
#: them, as a worker that ran another operator before would hold both.
WORKER_CACHES: list[Callable[[], None]] = []


def drop_caches() -> None:
    for drop in WORKER_CACHES:
        drop()


U64 = np.uint64
_SEP = np.zeros(256, bool)
_SEP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_RNG = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | U64(1)
_BYTE_WORD = np.where(_SEP, U64(0), _BYTE)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BYTE_WORD_LOWER = _BYTE_WORD[_LOWER]
_P, _Q = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95


def without(columns: list[str], new: list[str]) -> list[str]:
    """``columns`` but those with the name of a new one: an input column gives way to an output of its name."""
    return [c for c in columns if c.lower() not in {n.lower() for n in new}]


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, with underscores in front until no column has them."""
    taken = {c.lower() for c in columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


def working_dir(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``.  Where the session names none, a local session gets one under /tmp, and
    one on a cluster is refused, as its executors don't share a local folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file:///tmp/tallyspark-checkpoints"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


#: Lists of written folders, innermost last.
_recorded: list[list[str]] = []


@contextlib.contextmanager
def recording() -> Iterator[list[str]]:
    """The folders that ``written`` makes inside, in their order."""
    paths: list[str] = []
    _recorded.append(paths)
    try:
        yield paths
    finally:
        _recorded.remove(paths)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage and survives lost executors.  It stays until whoever
    reads results made from it deletes it (``delete_folders``)."""
    path = working_dir(df.sparkSession)
    df.write.parquet(path)
    for paths in _recorded[-1:]:
        paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete_folders(spark: SparkSession, paths: list[str]) -> None:
    """Deletes folders of any file system that Spark knows."""
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def block_count(df: DataFrame, text: str = "text", block_bytes: int = BLOCK_BYTES) -> int:
    """Blocks of about ``block_bytes`` raw text each; at least one."""
    total = df.agg(F.sum(F.octet_length(F.col(text)).cast("long") + 16)).first()[0] or 0
    return max(1, -(-int(total) // block_bytes))


def block_of(blocks: int, *keys: str | Column) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(blocks)).cast("int").alias("block")


def _ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack(payloads: pa.ChunkedArray | pa.Array, order: list[str] | None = None) -> pa.Table | None:
    """The rows of packed payloads, in a reproducible order."""
    give_memory_back()
    tables = [pa.ipc.open_stream(p.as_buffer()).read_all() for p in payloads]
    if not tables:
        return None
    out = pa.concat_tables(tables).combine_chunks()
    return out.take(pc.sort_indices(out, [(c, "ascending") for c in order])) if order else out


def packed(df: DataFrame, key: str, times: str | None = None) -> DataFrame:
    """Rows of ``df`` as (key, payload): each batch's rows of one key compressed together, which shuffles a fraction of the
    bytes of plain rows.  With ``times``, rows that repeat in a batch are one row, and that column counts them."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_memory_back()
        for b in batches:
            if not b.num_rows:
                continue
            keys = b.column(key).to_numpy(zero_copy_only=False)
            rest = b.select([n for n in b.schema.names if n != key])
            order = np.argsort(keys, kind="stable")
            if times:
                once, n = distinct_rows(rest)
                rest = rest.append_column(times, pa.array(n, pa.int64()))
                order = order[once[order]]
            cuts = np.flatnonzero(np.diff(keys[order])) + 1
            ks, payloads = [], []
            for part in np.split(order, cuts):
                ks.append(keys[part[0]])
                payloads.append(_ipc(rest.take(pa.array(part))))
            yield pa.RecordBatch.from_arrays([pa.array(ks, pa.int32()), pa.array(payloads, pa.binary())], ["key", "payload"])

    return df.mapInArrow(pack, "key int, payload binary").withColumnRenamed("key", key)


def distinct_rows(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are the first of their kind, and for those how many there are (columns of any type, compared by value)."""
    codes = np.zeros(rows.num_rows, np.int64)
    for c in rows.columns:
        coded = c.dictionary_encode(null_encoding="encode")
        coded = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        _, codes = np.unique(codes * (int(coded.max(initial=0)) + 1) + coded, return_inverse=True)
    _, first, n = np.unique(codes, return_index=True, return_counts=True)
    once, times = np.zeros(rows.num_rows, bool), np.ones(rows.num_rows, np.int64)
    once[first], times[first] = True, n
    return once, times


#: Rows that one row of a count is written out as at a time.
PIECE = 10_000


def repeated(df: DataFrame, times: str) -> DataFrame:
    """Each row as often as its column ``times`` (a positive long) says, without that column.  Counts are cut into pieces,
    so no array is longer than ``PIECE``."""
    a, b, c = unused(df.columns, "_a", "_b", "_c")
    rest = [F.col(x) for x in df.columns if x != times]
    step = lambda low, high, n: F.explode(F.sequence(low, high - 1, F.lit(n).cast("long")))
    big = df.select(*rest, times, step(F.lit(0).cast("long"), F.col(times), PIECE * PIECE).alias(a))
    mid = big.select(*rest, times, a, step(F.col(a), F.least(F.col(times), F.col(a) + PIECE * PIECE), PIECE).alias(b))
    return mid.select(*rest, step(F.col(b), F.least(F.col(times), F.col(a) + PIECE * PIECE, F.col(b) + PIECE), 1).alias(c)).drop(c)


def slices(offsets: np.ndarray, most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Ranges of documents with about ``most`` bytes together (a longer document alone)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def utf8(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without copies of single values, and the n + 1 offsets; null counts as empty."""
    give_memory_back()
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(a, pa.ChunkedArray):
        a = pa.concat_arrays(a.chunks) if a.num_chunks else pa.array([], pa.string())
    if a.null_count:
        a = a.fill_null("" if pa.types.is_string(a.type) or pa.types.is_large_string(a.type) else b"")
    a = a.cast(pa.large_binary())
    if not len(a):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = a.buffers()
    offsets = np.frombuffer(off, np.int64)[a.offset : a.offset + len(a) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


#: Bytes that vectorised passes take at a time; longer texts are cut where the pass allows it.
STEP = 1 << 19


def parts_of_texts(raw: np.ndarray, offsets: np.ndarray, cut, most: int = STEP) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts in parts of about ``most`` bytes together: bytes, offsets of the parts, each part's text, whether it goes on
    with a text that an earlier part began.  A text longer than ``most`` is cut at ``cut(raw, low, high)``: a position
    behind low, at most high where there is one, at which the pass over both sides gives what it gives over the whole
    (the length of raw if there is none)."""
    for i, j in slices(offsets, most):
        a, b = int(offsets[i]), int(offsets[j])
        if b - a <= 2 * most:
            yield raw[a:b], offsets[i : j + 1] - a, np.arange(i, j), np.zeros(j - i, bool)
            continue
        own, at = raw[a:b], 0
        while at < len(own):
            end = len(own) if len(own) - at <= 2 * most else int(cut(own, at, at + most))
            yield own[at:end], np.array([0, end - at], np.int64), np.array([i]), np.array([at > 0])
            at = end


def cut_at(allowed):
    """A ``cut`` for ``parts_of_texts`` from ``allowed(window)``: for each byte of a window but the first, whether the text may
    be cut in front of it (decided by that byte and those next to it)."""

    def cut(raw: np.ndarray, low: int, high: int) -> int:
        step, end = high - low, high
        begin = low
        while begin < len(raw):
            found = np.flatnonzero(allowed(raw[begin:end])[1:])
            if len(found):
                return begin + 1 + int(found[-1] if begin == low else found[0])
            begin, end = end - 1, min(end + step, len(raw))
            if begin >= len(raw) - 1:
                break
        return len(raw)

    return cut


def runs_gathered(source: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """source[first:first + size] of each pair, one behind the other."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return source[np.arange(total) + np.repeat(first - (ends - size), size)]


class HashTable:
    """Open addressing over scrambled 64-bit keys: slot = the key's top bits, then the next ones; a quarter full at most."""

    def __init__(self, most_entries: int):
        bits = max(4, int(4 * most_entries - 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
        self.entries = 0

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Distinct keys that the table doesn't hold yet."""
        self.entries += len(keys)
        at = (keys >> self.shift).astype(np.int64)
        while len(keys):
            _, first = np.unique(at, return_index=True)
            first = first[self.values[at[first]] < 0]
            self.keys[at[first]], self.values[at[first]] = keys[first], values[first]
            left = np.ones(len(keys), bool)
            left[first] = False
            keys, values, at = keys[left], values[left], (at[left] + 1) & self.mask

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, -1 where the table doesn't hold it."""
        at = (keys >> self.shift).astype(np.int64)
        out = self.values[at]
        look = np.flatnonzero((self.keys[at] != keys) & (out >= 0))
        while len(look):
            at[look] = (at[look] + 1) & self.mask
            out[look] = self.values[at[look]]
            look = look[(self.keys[at[look]] != keys[look]) & (out[look] >= 0)]
        return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values, which leaves no arithmetic structure."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 .. n of an odd base and of its inverse modulo 2^64, kept per worker for usual sizes."""
    have = _powers.get(base)
    if have is None or len(have[0]) <= n:
        size = -(-(n + 1) // (1 << 16)) << 16
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.empty(size, np.uint64)
            p[0], done = 1, 1
            while done < size:
                step = min(done, size - done)
                p[done : done + step] = p[:step] * U64(pow(b, done, 1 << 64))
                done += step
            out.append(p)
        have = (out[0], out[1])
        if size <= 1 << 20:
            _powers[base] = have
    return have


def sums_of_runs(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _P) -> np.ndarray:
    """Polynomial hash of values[start:end] for each pair, all at once through prefix sums modulo 2^64."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    p, q = _power(base, len(values) + 1)
    acc = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * p[: len(values)], out=acc[1:])
    return (acc[ends] - acc[starts]) * q[starts]


def words(raw: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of concatenated UTF-8 texts: first byte, end byte, document index and hash.

    ``lower`` folds A-Z first.  Texts never share a word although nothing separates them in ``raw``."""
    word = ~_SEP[raw]
    first = word.copy()
    first[1:] &= ~word[:-1]
    begin = offsets[:-1][offsets[:-1] < len(raw)]
    first[begin] = word[begin]
    last = word.copy()
    last[:-1] &= ~word[1:] | first[1:]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    docs = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, docs, mix(sums_of_runs((_BYTE_WORD_LOWER if lower else _BYTE_WORD)[raw], starts, ends) + (ends - starts).astype(np.uint64))


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive word hashes (n - k + 1 values, none where n < k)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    for i in range(0, n, 1 << 16):  # in pieces, so that the tables of powers stay small
        at = np.arange(min(1 << 16, n - i))
        out[i : i + len(at)] = mix(sums_of_runs(hashes[i : i + len(at) + k - 1], at, at + k, _Q))
    return out


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values, by doubling."""
    out, have = x, 1
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def by_shard(values: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of ascending values, and the shards' bounds in it; shards are equal ranges of the 64-bit space."""
    order = np.argsort(values, kind="stable")
    width = (1 << 64) // shards + 1
    marks = np.array([i * width for i in range(1, shards)], np.uint64)
    return order, np.concatenate([[0], np.searchsorted(values[order], marks), [len(values)]]).astype(np.int64)


def ranked(df: DataFrame, group: list[str], order: list[str], rank: str, per_task: int = 50_000) -> DataFrame:
    """Gapless rank from 0 (long column ``rank``) of rows within ``group``, ordered by a hash of ``order`` and then by it.

    No task holds a group: equal rows are counted first, a group is cut into hashed chunks of about ``per_task`` rows at
    most, and each chunk starts where the counts of those before it end.  ``df`` must have these columns alone; equal
    rows get consecutive ranks.  Nulls are values like others."""
    cols = group + order
    chunks = max(1, -(-df.count() // per_task))
    counted = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n")).withColumn("_chunk", F.pmod(F.xxhash64(*order), F.lit(chunks)))
    inner = Window.partitionBy(*group, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.groupBy(*group, "_chunk").agg(F.sum("_n").alias("_t"))
    starts = starts.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_chunk").alias("_c"), F.coalesce(F.sum("_t").over(outer), F.lit(0)).alias("_start"))
    on = F.col("_chunk") == F.col("_c")
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    out = counted.withColumn("_before", F.coalesce(F.sum("_n").over(inner), F.lit(0))).join(starts, on)
    first = F.col("_start") + F.col("_before")
    big = out.select(*cols, first.alias("_first"), (first + F.col("_n")).alias("_end"))
    # equal rows are written out in pieces, which are dealt anew: first those of PIECE squared, then those of PIECE
    step = lambda a, b, n: F.explode(F.sequence(a, b - 1, F.lit(n).cast("long")))
    big = big.select(*cols, "_end", step(F.col("_first"), F.col("_end"), PIECE * PIECE).alias("_a"))
    mid = big.select(*cols, F.least("_end", F.col("_a") + PIECE * PIECE).alias("_end"), step(F.col("_a"), F.least("_end", F.col("_a") + PIECE * PIECE), PIECE).alias("_b"))
    mid = mid.repartition(*cols, "_b")
    return mid.select(*cols, step(F.col("_b"), F.least("_end", F.col("_b") + PIECE), 1).alias(rank))


def batches_of(rows: Iterator[tuple], schema: pa.Schema, size: int = 256) -> Iterator[pa.RecordBatch]:
    it = iter(rows)
    while part := list(itertools.islice(it, size)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), schema, strict=True)], schema=schema)


def corpus_blocks(docs: DataFrame, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """(block, payload) rows of the table's (doc_id, text, times), and the number of blocks; ``times`` counts equal rows."""
    blocks = block_count(docs, text, block_bytes)
    rows = docs.select(block_of(blocks, key, text), F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return packed(rows, "block", "times"), blocks


def block_rows(table: pa.Table) -> tuple[int, pa.Table]:
    """A block's number and its distinct rows (doc_id, text, times), by id and text."""
    drop_caches()
    rows = unpack(table.column("payload"), ["doc_id", "text"])
    again = np.ones(max(0, rows.num_rows - 1), bool)
    for c in ("doc_id", "text"):
        left, right = rows.column(c).slice(0, len(again)), rows.column(c).slice(1)
        same = pc.or_(pc.fill_null(pc.equal(left, right), False), pc.and_(pc.is_null(left), pc.is_null(right)))
        again &= same.to_numpy()
    first = np.flatnonzero(np.r_[True, ~again][: rows.num_rows])
    times = np.add.reduceat(rows.column("times").to_numpy(), first) if len(first) else np.zeros(0, np.int64)
    return table.column("block")[0].as_py(), rows.select(["doc_id", "text"]).take(pa.array(first)).append_column("times", pa.array(times))


#: A text may be cut in front of an ASCII separator that follows another byte.
cut_words = cut_at(lambda w: _SEP[w] & ~np.r_[True, _SEP[w][:-1]])


def block_words(table: pa.Table, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of a block's texts, in parts that bound memory: document index, hash, and bounds of each document's words."""
    raw, offsets = utf8(table.column("text"))
    docs, hashes = [], []
    for own, at, text, _ in parts_of_texts(raw, offsets, cut_words):
        _, _, d, h = words(own, at, lower)
        docs.append(text[d].astype(np.int32))
        hashes.append(h)
    doc = np.concatenate(docs) if docs else np.zeros(0, np.int32)
    return doc, np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), np.searchsorted(doc, np.arange(len(offsets)))


#: What a block sends a shard (values in ascending order, one entry each, with how often the block has it, 255 at most)
#: and what comes back (one byte for each entry, in the same order).
SENT, ANSWER = "shard int, block int, sent binary, times binary", "block int, shard int, answer binary"


def sent_rows(block: int, values: np.ndarray, times: np.ndarray, shards: int, coded) -> pa.RecordBatch:
    """Distinct ascending values as one row a shard; ``coded(values, shard)`` gives the bytes."""
    width = (1 << 64) // shards + 1
    marks = np.array([i * width for i in range(1, shards)], np.uint64)
    at = np.concatenate([[0], np.searchsorted(values, marks), [len(values)]]).astype(np.int64)
    full = [s for s in range(shards) if at[s] < at[s + 1]]
    times = np.minimum(times, 255).astype(np.uint8)
    return pa.RecordBatch.from_arrays([
        pa.array(full, pa.int32()), pa.array([block] * len(full), pa.int32()),
        pa.array([coded(values[at[s] : at[s + 1]], s) for s in full], pa.binary()), pa.array([times[at[s] : at[s + 1]].tobytes() for s in full], pa.binary())],
        ["shard", "block", "sent", "times"])


def count_in_shards(sent: DataFrame, decode) -> DataFrame:
    """Answers to every block: the class of each value's count over all blocks (0: once; c: up to 2^c times, 63 at most).

    A shard gets one row a block, whatever the values' frequencies; counts of a block stop at 255 there, which keeps
    the classes comparable for all blocks."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_memory_back()
        t = pa.Table.from_batches(list(batches))
        values = [decode(x.as_buffer()) for x in t.column("sent")]
        times = [np.frombuffer(x.as_buffer(), np.uint8) for x in t.column("times")]
        _, inverse = np.unique(np.concatenate(values), return_inverse=True)
        total = np.bincount(inverse, np.concatenate(times))
        level = np.minimum(np.ceil(np.log2(total)), 63).astype(np.uint8)[inverse]
        cuts = np.cumsum([len(v) for v in values])[:-1]
        answers = [a.tobytes() for a in np.split(level, cuts)]
        yield pa.RecordBatch.from_arrays([t.column("block").combine_chunks(), pa.array([key[0].as_py()] * len(answers), pa.int32()), pa.array(answers, pa.binary())], ["block", "shard", "answer"])

    return sent.groupBy("shard").applyInArrow(run, ANSWER)


def joined_answers(replies: pa.Table) -> np.ndarray:
    """A block's answers in the order of its values: shards are ascending ranges."""
    order = np.argsort(replies.column("shard").to_numpy(), kind="stable")
    rows = replies.column("answer").take(pa.array(order))
    return np.frombuffer(b"".join(x.as_py() for x in rows), np.uint8)


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of the edges (a, b): the smallest node that paths reach.

    Labels spread along edges and through the labels themselves, each round written to the shared folder; rounds grow
    with the logarithm of the longest path in practice."""
    edges = edges.where("a <> b")
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label"))
    labels = written(labels)
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("m"))
        spread = labels.join(near, F.col("node") == F.col("a")).select("node", F.least("label", "m").alias("label"), F.col("label").alias("was"))
        hop = labels.select(F.col("node").alias("via"), F.col("label").alias("further"))
        new = written(spread.join(hop, F.col("label") == F.col("via")).select("node", F.least("label", "further").alias("label"), "was"))
        labels = new.select("node", "label")
        if new.where("label <> was").isEmpty():
            return labels
