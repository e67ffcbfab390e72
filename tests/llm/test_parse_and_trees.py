"""The greedy parse against a plain one, and what signature trees drop."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_llm_operators import brute_dedup, sha, words

from tallyspark.llm import common, rlz_dedup, signature_tree


# ---- the parse

def brute_parse(block, words, doc_of, times, width, firsts, n_blocks):
    """Greedy factors of a block's documents by comparing words: (document, parsed, end, source block, source word)."""
    own, out = {}, []
    inside = [i for i in range(len(words) - width + 1) if doc_of[i] == doc_of[i + width - 1]]
    for i in inside:
        own.setdefault(tuple(words[i : i + width]), []).append(i)

    def source(q):
        w = tuple(words[q : q + width])
        here = own[w]
        if len(here) > 1 or times[doc_of[q]] > 1:
            return block, here[(here.index(q) + 1) % len(here)]
        for step in range(1, n_blocks):
            other = (block + step) % n_blocks
            if w in firsts[other]["first"]:
                return other, firsts[other]["first"][w]
        return None

    def reach(q):
        b, at = source(q)
        there, n = firsts[b], 0
        while q + n < len(words) and doc_of[q + n] == doc_of[q] and at + n < len(there["words"]) and there["doc"][at + n] == there["doc"][at] and there["words"][at + n] == words[q + n]:
            n += 1
        return q + n

    for d in sorted(set(doc_of)):
        mine = [i for i in inside if doc_of[i] == d and source(i)]
        p = before = -1
        while True:
            over = [q for q in mine if max(before + 1, p - width + 1) <= q <= p]
            best = max(over, key=lambda q: (reach(q), -q), default=None)
            if best is None or reach(best) <= p:
                p = min((q for q in mine if q > p), default=None)
                if p is None:
                    break
                best, before = p, p - 1
            b, at = source(best)
            out.append((d, p, reach(best), b, at, best))
            before, p = p, reach(best)
    return out


@pytest.mark.parametrize("block_bytes", [1 << 20, 3_000])
def test_factors_equal_a_plain_parse(spark, monkeypatch, block_bytes):
    rnd, width = random.Random(6), 6
    line = lambda: [rnd.choice("abcdefgh") + rnd.choice("xyz") for _ in range(rnd.randrange(4, 30))]
    lines = [line() for _ in range(12)]
    rows = [(i % 40, " ".join(w for _ in range(rnd.randrange(6)) for w in (rnd.choice(lines)[rnd.randrange(3) :] if rnd.random() < 0.7 else line()))) for i in range(90)]
    rows += [(100, " ".join(lines[0] * 4)), (101, " ".join(f"u{i}" for i in range(20)))] + [(102, " ".join(f"v{i}" for i in range(20)))] * 3 + [(None, None), (None, " ".join(lines[1] + lines[2]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    monkeypatch.setattr(rlz_dedup, "corpus_blocks", lambda d: common.corpus_blocks(d, block_bytes=block_bytes))
    blocks, n = common.corpus_blocks(docs, block_bytes=block_bytes)
    tables = {}
    for b in range(n):
        payloads = [bytes(r.payload) for r in blocks.where(F.col("block") == b).collect()]
        table = common.block_rows(pa.table({"block": pa.array([b] * len(payloads), pa.int32()), "payload": pa.array(payloads, pa.binary())}))[1].to_pylist() if payloads else []
        ws = [w for r in table for w in words(r["text"])]
        doc = [i for i, r in enumerate(table) for _ in words(r["text"])]
        first = {}
        for i in range(len(ws) - width, -1, -1):
            if doc[i] == doc[i + width - 1]:
                first[tuple(ws[i : i + width])] = i
        tables[b] = {"rows": table, "words": ws, "doc": doc, "first": first}
    want = []
    for b in range(n):
        t = tables[b]
        start = {d: t["doc"].index(d) for d in set(t["doc"])}
        by_doc = {}
        for d, p, q, sb, sw, m in brute_parse(b, t["words"], t["doc"], [r["times"] for r in t["rows"]], width, tables, n):
            by_doc.setdefault(d, []).append((m - start[d], q - start[d], sb, sw, p - start[d]))
        for d, r in enumerate(t["rows"]):
            want += [repr((r["doc_id"], sha((r["text"] or "").encode()), by_doc.get(d, [])))] * r["times"]
    done = rlz_dedup.dedup_substrings(docs, width, 4).collect()
    assert sorted(repr((r.doc_id, r.text_sha256, [tuple(f) for f in r.factors])) for r in done) == sorted(want)
    assert sorted((repr(r.doc_id), r.n_words, r.n_removed, sha(r.kept.encode())) for r in done) == sorted((repr(d), *rest) for d, *rest in brute_dedup(rows, width))
    assert sum(len(r.factors) for r in done) > 60
    for r in done:
        assert all(a.end <= b.parsed for a, b in zip(r.factors, r.factors[1:]))
        assert sum(f.end - f.parsed for f in r.factors) == r.n_removed


def test_unrelated_sets_are_dropped_above_the_leaves():
    rng = np.random.default_rng(1)
    for n in (100, 300, 1500, 4000):
        sets = [np.unique(rng.integers(0, 2**64, n, dtype=np.uint64)) for _ in range(200)]
        seen, tree = Counter(), signature_tree.SignatureTree(sets, np.array([len(s) for s in sets]), np.arange(200))
        assert signature_tree.dual_join(tree, tree, signature_tree.Forest(200), 80, seen=seen) == []
        assert seen["documents"] < 200 * signature_tree.LEAF and seen["leaves"] <= 64  # only leaves with themselves
        assert seen["visited"] < 2000


def test_folded_bitmaps_bound_overlaps():
    rng = np.random.default_rng(2)
    for _ in range(50):
        a = np.unique(rng.integers(0, 2**64, int(rng.integers(1, 900)), dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < rng.random()], rng.integers(0, 2**64, int(rng.integers(1, 900)), dtype=np.uint64)]))
        x, y = (signature_tree.SignatureTree([s], np.array([len(s)]), np.array([0])) for s in (a, b))
        p, q = x.nodes[0, 1], y.nodes[0, 1]
        bound = signature_tree.most_in_common(p.bitmap, p.hidden, q.bitmap, q.hidden)
        assert len(np.intersect1d(a, b)) <= bound <= len(np.intersect1d(a, b)) + min(len(a), len(b)) // 4 + 4
        narrow = signature_tree.folded(p.bitmap, max(1, len(p.bitmap) // 4))
        bits = 6 + len(narrow).bit_length() - 1
        assert set(np.flatnonzero(np.unpackbits(narrow.view(np.uint8), bitorder="little")).tolist()) == set((a >> np.uint64(64 - bits)).tolist())
