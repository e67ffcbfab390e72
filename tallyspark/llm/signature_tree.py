"""N-gram Jaccard join by signature trees.

A document's set holds its distinct word shingles; two documents link when the Jaccard index of their sets is at least
``threshold`` percent, and the components of all links are the classes of near copies.

Candidates, exactly: with shingles in one global order, rare ones first, two linked sets share a shingle within each
other's first n - ceil(threshold * n) + 1 ones.  How rare a shingle is gets counted over the whole corpus in shards of
the hash space (a shard gets one row a block).  A set with too few shingles that anyone else has is out at once, and
shingles that only one document has can't be shared, so what is left to compare are documents that consist of material
found elsewhere.  Those that share such a shingle, directly or over others, are a family.

Families are joined by trees: nodes hold the OR of their documents' token bitmaps, the range of their sizes and the
largest number of tokens that bitmaps hide by collisions.  A tree has a branch for each power of two of the sizes, whose
bitmaps have ``SPARE`` bits a token, and in a branch documents lie in the order of their smallest tokens, so that near
copies are neighbours and the bitmaps above them stay sparse.  A traversal of two trees at once drops a pair of nodes
whose largest possible overlap, min(size, common bits + hidden tokens), is below what the threshold needs (of bitmaps of
two widths, the wider one is folded), and a pair whose documents are all in one component already; pairs of documents that
are left are compared exactly, those of nodes with few tokens in all by one matrix product.  Larger families are cut into chunks by size and joined chunk against chunk, so no task
holds a family; documents with identical sets are one entry a block.

That is all components need.  For the join itself (``near_copy_links``, ``link_pairs``) the traversal keeps pairs within
one component: every pair of distinct sets that passes is found, and counts for as many links as rows stand behind its
sets.  Equal sets are one entry of the whole corpus there.

Defined results: a document without words has an empty set and no links; with fewer words than a shingle, the whole
sequence is its one shingle; null text counts as empty; rows that share a doc_id are one node, whose links add up (a null
doc_id is one such node, and the last to name a component); rows that repeat entirely are one entry with a count, and all
come out; an empty table gives an empty table.  Only doc_id and text are read, texts of any length whole, in parts that end
between words.  Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import SENT, block_rows, block_words, components, corpus_blocks, count_in_shards, give_memory_back, grams, joined_answers, mix, ranked, repeated, sent_rows, written

SHINGLE, THRESHOLD = 5, 80
#: Bits of a signature for each token of its document, documents of a leaf, documents of a node that may be compared at once
#: and how many times the tokens of one document such a node has at most, shingles of a family's chunk.
SPARE, LEAF, WIDE, DENSE, CHUNK_TOKENS = 128, 4, 64, 4, 1 << 20
#: Stands for a null doc_id among nodes.
NO_ID = (1 << 63) - 1


def shingle_sets(table: pa.Table, width: int = SHINGLE) -> list[np.ndarray]:
    """Ascending distinct shingle hashes of every text of a block."""
    _, hashes, bounds = block_words(table, lower=True)
    g = grams(hashes, width)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= width:
            s = np.sort(g[a : b - width + 1])
            out.append(s[np.r_[True, s[1:] != s[:-1]]])
        else:
            out.append(grams(hashes[a:b], b - a) + np.uint64(b - a) if b > a else np.zeros(0, np.uint64))
    return out


def _code(shards: int):
    """Three bytes of a value within its shard: enough to tell almost all apart; a false match only costs a comparison."""
    width = (1 << 64) // shards + 1
    drop = np.uint64(max(0, (width - 1).bit_length() - 24))

    def code(values: np.ndarray, shard: int) -> bytes:
        return ((values - np.uint64(shard * width)) >> drop).astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()

    return code


def _decode(raw) -> np.ndarray:
    out = np.zeros((len(raw) // 3, 4), np.uint8)
    out[:, :3] = np.frombuffer(raw, np.uint8).reshape(-1, 3)
    return out.view("<u4").ravel()


def required(n: int, m: int, threshold: int) -> int:
    """Least intersection of sets of n and m tokens that link: 100 * i >= threshold * (n + m - i)."""
    return -(-threshold * (n + m) // (100 + threshold))


class Forest:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        a, b = self.find(i), self.find(j)
        self.up[max(a, b)] = min(a, b)
        return a != b


class Node(NamedTuple):
    #: None where so many bits are set that they bound nothing
    bitmap: np.ndarray | None
    low: int
    high: int
    hidden: int


class SignatureTree:
    """Binary trees over documents, one for each power of two of the sizes: each node covers a range of them."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray, members: np.ndarray):
        sizes, members = np.asarray(sizes), np.asarray(members)
        # another order of tokens than the one bits are taken from
        low = [sorted(np.partition(mix(s), min(3, len(s) - 1))[:4].tolist()) for s in sets]
        level = [int(n).bit_length() for n in sizes]
        order = sorted(range(len(sets)), key=lambda i: (level[i], low[i], int(members[i])))
        self.sets, self.sizes, self.members = [sets[i] for i in order], sizes[order], members[order]
        self.nodes: dict[tuple[int, int], Node] = {}
        levels = np.array([level[i] for i in order])
        cuts = [0, *(np.flatnonzero(np.diff(levels)) + 1).tolist(), len(order)]
        self.roots = [(x, y) for x, y in zip(cuts, cuts[1:]) if x < y]
        for x, y in self.roots:
            self._build(x, y)

    def _leaf(self, a: int, b: int) -> tuple[np.ndarray, int]:
        """Bitmap of a few documents, and the most tokens of one that share a bit with another one of it (tokens that nobody
        else has are in no stored set)."""
        bits = max(6, (SPARE - 1).bit_length() + int(self.sizes[a]).bit_length())
        out, hidden = np.zeros(1 << bits - 3, np.uint8), 0
        for s in self.sets[a:b]:
            at = np.unique(s >> np.uint64(64 - bits)).astype(np.int64)
            np.bitwise_or.at(out, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
            hidden = max(hidden, len(s) - len(at))
        return out.view(np.uint64), hidden

    def _build(self, a: int, b: int) -> tuple[np.ndarray | None, int]:
        if b - a <= LEAF:
            bitmap, hidden = self._leaf(a, b)
        else:
            m = (a + b) // 2
            (left, h), (right, k) = self._build(a, m), self._build(m, b)
            bitmap, hidden = None if left is None or right is None else left | right, max(h, k)
            if bitmap is not None and int(np.bitwise_count(bitmap).sum()) > 16 * len(bitmap):
                bitmap = None
        self.nodes[a, b] = Node(bitmap, int(self.sizes[a:b].min()), int(self.sizes[a:b].max()), hidden)
        return bitmap, hidden


def folded(bitmap: np.ndarray, words: int) -> np.ndarray:
    """A bitmap over the leading bits of tokens, with fewer of them."""
    have = bitmap
    while len(have) > words:
        # one leading bit less: neighbouring bits become one
        pair = (have | (have >> np.uint64(1))) & np.uint64(0x5555555555555555)
        for shift, mask in ((1, 0x3333333333333333), (2, 0x0F0F0F0F0F0F0F0F), (4, 0x00FF00FF00FF00FF), (8, 0x0000FFFF0000FFFF), (16, 0x00000000FFFFFFFF)):
            pair = (pair | (pair >> np.uint64(shift))) & np.uint64(mask)
        have = pair[::2] | (pair[1::2] << np.uint64(32))
    return have


def most_in_common(p: np.ndarray | None, hidden_p: int, q: np.ndarray | None, hidden_q: int) -> int:
    """Bound on the overlap of a document under each of two bitmaps."""
    if p is None or q is None:
        return 1 << 60
    if len(p) == len(q):
        return int(np.bitwise_count(p & q).sum()) + min(hidden_p, hidden_q)
    small, hidden = (p, hidden_p) if len(p) < len(q) else (q, hidden_q)
    return int(np.bitwise_count(folded(p, len(small)) & folded(q, len(small))).sum()) + hidden


def _all_one(forest: Forest, x: np.ndarray, y: np.ndarray) -> bool:
    root = forest.find(int(x[0]))
    return all(forest.find(int(i)) == root for part in (x, y) for i in part)


class Leaf:
    """Sets of a few documents as a matrix over their tokens."""

    def __init__(self, sets: list[np.ndarray]):
        every = np.concatenate(sets)
        self.tokens, at = np.unique(every, return_inverse=True)
        self.matrix = np.zeros((len(sets), len(self.tokens)), np.float32)
        self.matrix[np.repeat(np.arange(len(sets)), [len(s) for s in sets]), at] = 1

    def common(self, other: Leaf) -> np.ndarray:
        """Sizes of the intersections of each own set with each of the other's."""
        _, i, j = np.intersect1d(self.tokens, other.tokens, assume_unique=True, return_indices=True)
        return np.rint(self.matrix[:, i] @ other.matrix[:, j].T).astype(np.int64)


def _at_once(tree: SignatureTree, r: tuple[int, int], known: dict[tuple[int, int], Leaf | None]) -> bool:
    """Whether a node's documents are so few and alike that one matrix over their tokens compares them."""
    if r not in known:
        sets = tree.sets[r[0] : r[1]]
        few = len(sets) <= WIDE and (len(sets) <= LEAF or len(np.unique(np.concatenate(sets))) <= DENSE * max(len(s) for s in sets))
        known[r] = Leaf(sets) if few else None
    return known[r] is not None


def dual_join(left: SignatureTree, right: SignatureTree, forest: Forest, threshold: int, found=None, seen: Counter | None = None) -> list[tuple[int, int]]:
    """Links that join components, of a document of each tree (the same tree twice: within it).  ``members`` are positions
    in the forest.  All links between the trees' documents are implied by the components afterwards.

    With ``found`` no pair is skipped for being in one component: it is called with arrays of the members (x, y) of all
    pairs that link, a few at a time and each pair once.  ``seen`` counts node pairs: visited, dropped by their sizes, by
    their bitmaps, for being in one component, and leaf pairs compared; also pairs of documents compared."""
    links: list[tuple[int, int]] = []
    seen = Counter() if seen is None else seen
    leaves: dict[tuple[int, int], Leaf | None] = {}
    others: dict[tuple[int, int], Leaf | None] = {}
    same = left is right
    todo = [(p, q) for p in left.roots for q in right.roots if not same or p <= q]
    while todo:
        p, q = todo.pop()
        a, b = left.nodes[p], right.nodes[q]
        seen["visited"] += 1
        if 100 * a.high < threshold * b.low or 100 * b.high < threshold * a.low:
            seen["sizes"] += 1
            continue
        if min(a.high, b.high, most_in_common(a.bitmap, a.hidden, b.bitmap, b.hidden)) < required(a.low, b.low, threshold):
            seen["bitmaps"] += 1
            continue
        if not found and _all_one(forest, left.members[p[0] : p[1]], right.members[q[0] : q[1]]):
            seen["components"] += 1
            continue
        big_p, big_q = p[1] - p[0] > LEAF, q[1] - q[0] > LEAF
        if (big_p or big_q) and not (_at_once(left, p, leaves) and _at_once(right, q, leaves if same else others)):
            split = lambda r, big: [(r[0], (r[0] + r[1]) // 2), ((r[0] + r[1]) // 2, r[1])] if big else [r]
            pairs = [(x, y) for x in split(p, big_p) for y in split(q, big_q) if not same or x <= y]
            todo += sorted(pairs, key=lambda t: t[0] == t[1])  # a node with itself first: components grow early
            continue
        seen["leaves"] += 1
        mine, theirs = leaves, leaves if same else others
        for tree, r, known in ((left, p, mine), (right, q, theirs)):
            if known.get(r) is None:
                known[r] = Leaf(tree.sets[r[0] : r[1]])
        total = left.sizes[p[0] : p[1], None] + right.sizes[None, q[0] : q[1]]
        seen["documents"] += total.size
        passed = (100 + threshold) * mine[p].common(theirs[q]) >= threshold * total
        x, y = np.nonzero(np.triu(passed, 1) if same and p == q else passed)
        x, y = left.members[x + p[0]], right.members[y + q[0]]
        if found and len(x):
            found(x, y)
        links += [(i, j) for i, j in zip(x.tolist(), y.tolist()) if forest.join(i, j)]
    return links


_PREPARED = "node long, doc_id long, n_shingles long, same_as long, shared binary, prefix array<long>, set_id long, times long"


def prepare(docs: DataFrame, width: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """Every document with its set's size; candidates also with ``same_as`` (the first document of their block that has
    the same set), which alone gets ``shared`` (its tokens that others have) and ``prefix`` (those to meet partners by).  Equal sets have the same ``set_id``."""
    blocks, shards = corpus_blocks(docs)

    def send(table: pa.Table) -> pa.Table:
        block, rows = block_rows(table)
        sets = shingle_sets(rows, width)
        values, inverse = np.unique(np.concatenate(sets), return_inverse=True)
        times = np.bincount(inverse, np.repeat(rows.column("times").to_numpy(), [len(x) for x in sets]), len(values))
        return pa.Table.from_batches([sent_rows(block, values, times, shards, _code(shards))])

    def pick(table: pa.Table, replies: pa.Table) -> pa.Table:
        _, rows = block_rows(table)
        sets = shingle_sets(rows, width)
        everything = np.concatenate(sets)
        values = np.unique(everything)
        level = joined_answers(replies)[np.searchsorted(values, everything)] if len(values) else np.zeros(0, np.uint8)
        ids = rows.column("doc_id").fill_null(NO_ID).to_pylist()
        at, first, same, shared, prefix, set_id = 0, {}, [], [], [], []
        for i, s in zip(ids, sets, strict=True):
            own, at = level[at : at + len(s)], at + len(s)
            n = len(s)
            if not n or 100 * int((own > 0).sum()) < threshold * n:
                same.append(None), shared.append(None), prefix.append(None), set_id.append(None)
                continue
            key = s.tobytes()
            if key in first:
                same.append(first[key][0]), shared.append(None), prefix.append(None), set_id.append(first[key][1])
                continue
            # the set itself is a token too, by which equal sets meet
            whole = mix(np.array([n], np.uint64) + np.bitwise_xor.reduce(mix(s), keepdims=True) * np.uint64(3))
            first[key] = i, int(whole.view(np.int64)[0])
            set_id.append(first[key][1])
            order = np.lexsort((s, own))[: n - -(-threshold * n // 100) + 1]
            same.append(i), shared.append(s[own > 0].tobytes()), prefix.append(np.concatenate([s[order][own[order] > 0], whole]).view(np.int64).tolist())
        return pa.table([pa.array(ids, pa.int64()), rows.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(same, pa.int64()), pa.array(shared, pa.binary()), pa.array(prefix, pa.list_(pa.int64())), pa.array(set_id, pa.int64()), rows.column("times")],
                        ["node", "doc_id", "n_shingles", "same_as", "shared", "prefix", "set_id", "times"])

    answers = count_in_shards(blocks.groupBy("block").applyInArrow(send, SENT), _decode)
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(pick, _PREPARED)


def family_tasks(prepared: DataFrame, threshold: int, chunk_tokens: int) -> DataFrame:
    """Rows (task, label, i, j, side, node, n_shingles, shared, and copies where there are any): what each tree join reads.

    Families up to ``chunk_tokens`` share tasks; larger ones are cut by size into chunks, of which those whose sizes can
    link meet two by two."""
    tokens = prepared.where("prefix is not null").select("node", F.explode("prefix").alias("token")).distinct()
    hubs = tokens.groupBy("token").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub < last").select("token", "hub")
    families = components(tokens.join(hubs, "token").select(F.col("node").alias("a"), F.col("hub").alias("b")))
    own = ["shared", *(c for c in prepared.columns if c == "copies")]
    members = prepared.where("shared is not null").select("node", "n_shingles", *own)
    total = members.agg(F.sum(F.length("shared"))).first()[0] or 0
    buckets = max(1, -(-int(total) // (2 * 8 * chunk_tokens)))
    placed = written(ranked(families.join(members.select("node", "n_shingles").distinct(), "node").select("label", "n_shingles", "node"), ["label", "n_shingles"], ["node"], "at"))
    before = Window.partitionBy("label").orderBy("n_shingles").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("label", "n_shingles").agg(F.sum("n_shingles").alias("_t")).select("label", "n_shingles", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("start"))
    placed = placed.join(starts, ["label", "n_shingles"]).withColumn("chunk", F.expr(f"(start + at * n_shingles) div {chunk_tokens}"))
    chunks = placed.groupBy("label", "chunk").agg(F.min("n_shingles").alias("low"), F.max("n_shingles").alias("high"))
    i, j = chunks.alias("i"), chunks.alias("j")
    pairs = i.join(j, (F.col("i.label") == F.col("j.label")) & (F.col("i.chunk") <= F.col("j.chunk")) & (F.lit(100) * F.col("i.high") >= F.lit(threshold) * F.col("j.low")))
    pairs = pairs.select(F.col("i.label").alias("label"), F.col("i.chunk").alias("i"), F.col("j.chunk").alias("j"))
    alone = F.pmod(F.xxhash64("label"), F.lit(buckets))
    pairs = pairs.withColumn("task", F.when((F.col("j") == 0), alone).otherwise(buckets + F.pmod(F.xxhash64("label", "i", "j"), F.lit(1 << 40))))
    sides = F.when(F.col("i") == F.col("j"), F.array(F.struct(F.col("i").alias("chunk"), F.lit(0).alias("side")))).otherwise(
        F.array(F.struct(F.col("i").alias("chunk"), F.lit(0).alias("side")), F.struct(F.col("j").alias("chunk"), F.lit(1).alias("side"))))
    needs = pairs.select("task", "label", "i", "j", F.explode(sides).alias("s")).select("task", "label", "i", "j", F.col("s.chunk").alias("chunk"), F.col("s.side").alias("side"))
    return placed.select("label", "chunk", "node", "n_shingles").join(needs, ["label", "chunk"]).join(members, ["node", "n_shingles"]).select("task", "label", "i", "j", "side", "node", "n_shingles", *own)


def _joins(table: pa.Table):
    """(nodes, copies, left tree, right tree) of each chunk pair of a task; members of the trees are positions in nodes."""
    give_memory_back()
    label, i, j, side = (table.column(c).to_numpy() for c in ("label", "i", "j", "side"))
    node, size, shared = table.column("node").to_numpy(), table.column("n_shingles").to_numpy(), table.column("shared")
    copies = table.column("copies").to_numpy() if "copies" in table.column_names else np.ones(len(node), np.int64)
    order = np.lexsort((side, j, i, label))
    cuts = np.flatnonzero((np.diff(label[order]) != 0) | (np.diff(i[order]) != 0) | (np.diff(j[order]) != 0)) + 1
    for rows in np.split(order, cuts):
        sets = [np.frombuffer(shared[int(r)].as_buffer(), np.uint64) for r in rows]
        ids, one, at = np.unique(node[rows], return_index=True, return_inverse=True)
        trees = []
        for s in (0, 1):
            own = np.flatnonzero(side[rows] == s)
            trees.append(SignatureTree([sets[k] for k in own], size[rows][own], at[own]) if len(own) else None)
        yield ids, copies[rows][one], trees[0], trees[1] or trees[0]


def family_links(prepared: DataFrame, threshold: int = THRESHOLD, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """Links (a, b) that connect all linked candidates: within families, by signature trees."""

    def run(table: pa.Table) -> pa.Table:
        a, b = [], []
        for ids, _, left, right in _joins(table):
            for x, y in dual_join(left, right, Forest(len(ids)), threshold):
                a.append(int(ids[x])), b.append(int(ids[y]))
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return family_tasks(prepared, threshold, chunk_tokens).groupBy("task").applyInArrow(run, "a long, b long")


def distinct_sets(prepared: DataFrame) -> DataFrame:
    """One row a distinct set of candidates: ``node`` (its set_id), ``first`` (the smallest node that has it), ``copies``
    (rows that have it), n_shingles, shared and prefix."""
    known = prepared.where("set_id is not null")
    g = known.groupBy(F.col("set_id").alias("_s")).agg(F.sum("times").alias("copies"), F.min(F.when(F.col("shared").isNotNull(), F.col("node"))).alias("first"))
    one = known.where("shared is not null").join(g, (F.col("set_id") == F.col("_s")) & (F.col("node") == F.col("first")))
    # blocks that hold the same id (or none) with the same set have a row each
    return one.select(F.col("set_id").alias("node"), "first", "copies", "n_shingles", "shared", "prefix").dropDuplicates(["node"])


def link_pairs(sets: DataFrame, threshold: int = THRESHOLD, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """Every pair (a, b) of distinct sets that link, once, by their set_ids; ``sets`` are those of ``distinct_sets``.

    The pairs of a group of different near copies grow with its square."""

    def run(table: pa.Table) -> pa.Table:
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for ids, _, left, right in _joins(table):
            dual_join(left, right, Forest(len(ids)), threshold, lambda x, y, ids=ids: (a.append(np.minimum(ids[x], ids[y])), b.append(np.maximum(ids[x], ids[y]))))
        return pa.table([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return family_tasks(sets, threshold, chunk_tokens).groupBy("task").applyInArrow(run, "a long, b long")


def weighted_links(sets: DataFrame, threshold: int = THRESHOLD, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """All pairs of ``link_pairs``, added up in the tasks: rows (a, null, n) with the rows n behind sets that link with a,
    and rows (a, b, null) of pairs that connect the components."""

    def run(table: pa.Table) -> pa.Table:
        a, b, n = [], [], []
        for ids, copies, left, right in _joins(table):
            weight = np.zeros(len(ids), np.int64)

            def found(x, y, weight=weight, copies=copies):
                np.add.at(weight, x, copies[y])
                np.add.at(weight, y, copies[x])

            for x, y in dual_join(left, right, Forest(len(ids)), threshold, found):
                a.append(int(ids[x])), b.append(int(ids[y])), n.append(None)
            for x in np.flatnonzero(weight).tolist():
                a.append(int(ids[x])), b.append(None), n.append(int(weight[x]))
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], ["a", "b", "n"])

    return family_tasks(sets, threshold, chunk_tokens).groupBy("task").applyInArrow(run, "a long, b long, n long")


def near_copy_links(docs: DataFrame, width: int = SHINGLE, threshold: int = THRESHOLD, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """The columns of ``near_copies``, with components taken from all links, and n_links: how many other rows link with a
    row, those of equal sets and of its own doc_id among them."""
    prepared = written(prepare(docs, width, threshold))
    sets = written(distinct_sets(prepared))
    links = written(weighted_links(sets, threshold, chunk_tokens))
    others = links.where("b is null").groupBy(F.col("a").alias("_a")).agg(F.sum("n").alias("n"))
    counted = sets.join(others, F.col("node") == F.col("_a"), "left").select(F.col("node").alias("_set"), "first", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    # one row a node and set, whatever the blocks that hold it
    entries = written(prepared.where("shared is not null").select("node", "set_id").distinct().join(counted, F.col("set_id") == F.col("_set")).select(F.col("node").alias("_node"), "_set", "first", "n_links"))
    name = sets.select(F.col("node").alias("_k"), "first")
    pairs = links.where("b is not null").select("a", "b").join(name.select(F.col("_k").alias("_ka"), F.col("first").alias("fa")), F.col("a") == F.col("_ka")).join(name.select(F.col("_k").alias("_kb"), F.col("first").alias("fb")), F.col("b") == F.col("_kb"))
    edges = pairs.select(F.col("fa").alias("a"), F.col("fb").alias("b")).unionByName(entries.select(F.col("_node").alias("a"), F.col("first").alias("b")))
    counts = entries.select("_node", "_set", "n_links")
    out = _labelled(prepared, edges, "set_id").join(counts, (F.col("_own") == F.col("_node")) & (F.col("set_id") == F.col("_set")), "left")
    return repeated(out.select("doc_id", "n_shingles", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "times"), "times")


def _labelled(prepared: DataFrame, edges: DataFrame, *more: str) -> DataFrame:
    found = components(edges).select(F.col("node").alias("_first"), "label")
    own = F.coalesce("same_as", "node")
    out = prepared.select("doc_id", "n_shingles", own.alias("_own"), "times", *more).join(found, F.col("_own") == F.col("_first"), "left")
    label = F.when(F.col("n_shingles") == 0, F.coalesce("doc_id", F.lit(NO_ID))).otherwise(F.coalesce("label", "_own"))
    return out.select("doc_id", "n_shingles", F.when(label != NO_ID, label).alias("component_id"), "_own", "times", *more)


def near_copies(docs: DataFrame, width: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links reach) of every document."""
    prepared = written(prepare(docs, width, threshold))
    return repeated(_labelled(prepared, family_links(prepared, threshold)).drop("_own"), "times")
