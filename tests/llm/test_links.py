"""All links of the n-gram Jaccard join, against brute force."""

import itertools
import random
from collections import Counter

import numpy as np
import pytest
from test_llm_operators import brute_components, corpus

from tallyspark.llm import common, signature_tree


def shingles(text):
    ws = (text or "").encode().lower().split()
    return frozenset(tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))) if ws else frozenset()


def linked(a, b):
    return bool(a) and bool(b) and 100 * len(a & b) >= 80 * len(a | b)


def family():
    rnd, base, rows = random.Random(9), [f"w{i}" for i in range(120)], []
    for i in range(150):
        own = list(base)
        for _ in range(rnd.randrange(0, 6)):
            own[rnd.randrange(len(own))] = f"x{rnd.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    return rows


def test_dual_join_finds_every_pair_once():
    rng, sets = np.random.default_rng(4), []
    for _ in range(90):
        if sets and rng.random() < 0.8:
            s = sets[rng.integers(len(sets))]
            s = np.unique(np.concatenate([s[rng.random(len(s)) > 0.05], rng.integers(0, 2**63, 3, dtype=np.uint64)]))
        else:
            s = np.unique(rng.integers(0, 2**63, int(rng.integers(1, 300)), dtype=np.uint64))
        sets.append(s)
    want = {(a, b) for a, b in itertools.combinations(range(90), 2) if linked(set(sets[a].tolist()), set(sets[b].tolist()))}
    tree = lambda at: signature_tree.SignatureTree([sets[i] for i in at], np.array([len(sets[i]) for i in at]), np.array(at))
    whole, even, odd = tree(range(90)), tree(range(0, 90, 2)), tree(range(1, 90, 2))
    for left, right, mine in ((whole, whole, want), (even, odd, {p for p in want if sum(p) % 2})):
        got, forest = [], signature_tree.Forest(90)
        spanning = signature_tree.dual_join(left, right, forest, 80, lambda x, y: got.extend(zip(x.tolist(), y.tolist())))
        assert sorted(tuple(sorted(p)) for p in got) == sorted(mine) and len(spanning) < len(mine)


@pytest.mark.parametrize("rows", [family(), [r[:2] for r in corpus()]], ids=["family", "corpus"])
def test_links_are_counted_and_paired_exactly(spark, rows, monkeypatch):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(signature_tree, "corpus_blocks", lambda d: common.corpus_blocks(d, block_bytes=8_000))
    sets = [shingles(t) for _, t in rows]
    n = [sum(linked(a, b) for k, b in enumerate(sets) if k != i) for i, a in enumerate(sets)]
    got = signature_tree.near_copy_links(docs, chunk_tokens=1500).collect()
    assert Counter((r.doc_id, r.n_shingles, r.n_links) for r in got) == Counter((i, len(s), k) for (i, _), s, k in zip(rows, sets, n))
    assert sorted(repr((r.doc_id, r.n_shingles, r.component_id)) for r in got) == sorted(map(repr, brute_components(rows)))
    distinct = set(sets)
    pairs = signature_tree.link_pairs(signature_tree.distinct_sets(common.written(signature_tree.prepare(docs))), 80, 1500).collect()
    assert len(pairs) == len(set(pairs)) == sum(linked(a, b) for a, b in itertools.combinations(distinct, 2))


def test_rows_of_one_id_in_many_blocks(spark, monkeypatch):
    """One doc_id (and none) with one set of shingles in texts that differ by letter case, so that blocks share it."""
    base = " ".join(f"w{i}" for i in range(30))
    cases = [base, base.upper(), base.title(), base.replace("w1", "W1")]
    near = base.replace("w29", "w29 more")
    rows = [(5, t) for t in cases] + [(None, t) for t in cases] + [(None, base)] * 2 + [(7, near), (7, near), (8, near.upper()), (9, "of its own " * 9), (9, "OF its own " * 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(signature_tree, "corpus_blocks", lambda d: common.corpus_blocks(d, block_bytes=400))
    sets = [shingles(t) for _, t in rows]
    n = [sum(linked(a, b) for k, b in enumerate(sets) if k != i) for i, a in enumerate(sets)]
    got = signature_tree.near_copy_links(docs).collect()
    assert Counter((r.doc_id, r.n_shingles, r.n_links) for r in got) == Counter((i, len(s), k) for (i, _), s, k in zip(rows, sets, n))
    assert len(signature_tree.link_pairs(signature_tree.distinct_sets(common.written(signature_tree.prepare(docs)))).collect()) == 1
