"""Phrase mining by weighted automata: against plain counts."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from test_llm_operators import tricky

from tallyspark.llm import phrase_automata as P


def plain_grams(rows, longest):
    """Counts of (lang, word, ...) of all contiguous words inside pieces."""
    out = Counter()
    for text, lang in rows:
        folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", folded):
            words = [w.encode() for w in re.findall("[^ \t]+", piece)]
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    out["und" if lang is None else lang, *words[i : i + k]] += 1
    return out


def plain_phrases(rows, longest=3, least=10, inside=50, top=2000):
    f = plain_grams(rows, longest)
    n = Counter()
    for g, c in f.items():
        n[g[0]] += c if len(g) == 2 else 0
    found = {g: c for g, c in f.items() if len(g) > 2 and c >= least}
    out = []
    for g, a in found.items():
        holds = lambda h: h[0] == g[0] and len(h) > len(g) and any(h[i : i + len(g) - 1] == g[1:] for i in range(1, len(h)))  # noqa: B023, E731
        if any(100 * c >= inside * a and holds(h) for h, c in found.items()):
            continue
        s = [(10**6 * a * a // (f[g[: k + 1]] * f[(g[0], *g[k + 1 :])]), k, f[g[: k + 1]], f[(g[0], *g[k + 1 :])]) for k in range(1, len(g) - 1)]
        score, _, left, right = min(s)
        out.append((g[0], b" ".join(g[1:]), a, left, right, n[g[0]], score))
    rank, ranked = Counter(), []
    for x in sorted(out, key=lambda x: (x[0], -x[6], -x[2], x[1])):
        rank[x[0]] += 1
        if rank[x[0]] <= top:
            ranked.append((x[0], rank[x[0]], x[1].decode(), *x[2:]))
    return ranked


def random_rows(n, seed, langs=("en", "de", None)):
    rng = np.random.default_rng(seed)
    vocabulary = ["The", "the", "of", "a", "Über", "zu", "x\x01", "\x00", "é", "日本", "END"]
    weights = np.array([6, 6, 5, 4, 3, 3, 1, 1, 2, 1, 1]) / 33
    glue = [" ", "  ", "\t", ". ", ",", "\n", " ! ", "\r\n", " ;: "]
    parts = np.array([12, 2, 1, 2, 1, 1, 1, 1, 1]) / 22
    return [("".join(str(x) for w in zip(rng.choice(vocabulary, k, p=weights), rng.choice(glue, k, p=parts)) for x in w), langs[int(rng.integers(len(langs)))]) for k in rng.integers(0, 120, n)]


def tries(rows, longest=3):
    return list(P.shard_tries(iter([pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array(["und" if r[1] is None else r[1] for r in rows], pa.string())], ["text", "lang"])]), longest))


def grams_of(trie):
    return {p: n for level, w in zip(trie.paths(), trie.weight) for p, n in zip(level, w.tolist()) if n}


@pytest.mark.parametrize("longest", [1, 2, 3, 4])
def test_shards_count_whole_texts(monkeypatch, longest):
    rows = random_rows(60, 1) + [(t, "en") for t in tricky()] + [("...  \t", "de"), ("a b " * 900, "de")]
    monkeypatch.setattr(P, "SHARD_WORDS", 100)  # shards end inside texts, which are cut at any separator
    plain_parts = P.parts_of_texts
    for step in (1 << 19, 40, 7):
        monkeypatch.setattr(P, "parts_of_texts", lambda raw, offsets, cut: plain_parts(raw, offsets, cut, step))  # noqa: B023
        found = tries(rows, longest)
        assert len(found) > 5 or step > 1000
        total = Counter()
        for t in found:
            total.update(grams_of(t))
        assert total == plain_grams(rows, longest)
        assert grams_of(P.union([P.Transducer.minimal(t) for t in found])) == total


def test_transducers_are_minimal_and_reversible():
    grams = {("en", b"a", b"x"): 1, ("en", b"b", b"x"): 1, ("en", b"c", b"x"): 2, ("de", b"a", b"x"): 1, ("de", b"a"): 5, ("en", b"d"): 1 << 60}
    t = P.trie_of(grams, 3)
    made = P.Transducer.minimal(t)
    assert grams_of(made.unfolded()) == grams
    # "x" leads to one state for each of the two weights, and en a, en b are one state
    assert len(made.weight[1]) == 2 and len(made.weight[0]) == 4
    again = P.Transducer.unpacked(made.packed())
    assert grams_of(again.unfolded()) == grams and again.words == made.words
    empty = P.Transducer.unpacked(P.Transducer.minimal(P.trie_of({}, 3)).packed())
    assert grams_of(empty.unfolded()) == {} and grams_of(P.union([empty, made])) == grams


def test_equal_hashes_of_different_states_stay_apart(monkeypatch):
    grams = plain_grams(random_rows(20, 4), 3)
    monkeypatch.setattr(P, "mix", lambda x: x & np.uint64(3))
    assert grams_of(P.Transducer.minimal(P.trie_of(grams, 3)).unfolded()) == grams


def test_stretches_part_the_n_grams_at_every_kind_of_bound():
    grams = plain_grams(random_rows(40, 2), 3)
    every = sorted(grams)
    rng = np.random.default_rng(5)
    bounds = sorted({every[i] for i in rng.integers(0, len(every), 25)} | {("aa", b"z"), ("de", b"the", b"nowhere"), ("en", b"th"), ("zz", b"", b"a", b"b"), ("en", b"the", b"the", b"thf")})
    parts = list(P.stretches(P.trie_of(grams, 3), bounds))
    assert len(parts) > 20
    seen = {}
    for r, t in parts:
        low, high = ([("",), *bounds][r], [*bounds, ("~",)][r])
        own = grams_of(t)
        assert all(low <= g < high for g in own) and not set(own) & set(seen)
        seen.update(own)
    assert seen == grams


def test_union_adds_beyond_doubles_and_lookups_compose():
    big = (1 << 60) + 1
    a, b = ({("en", b"a"): big, ("en", b"a", b"b"): 3}, {("en", b"a"): 1, ("en", b"c"): 2, ("fr", b"a", b"b"): 1})
    t = P.union([P.Transducer.minimal(P.trie_of(x, 3)) for x in (a, b)])
    assert grams_of(t) == {("en", b"a"): big + 1, ("en", b"a", b"b"): 3, ("en", b"c"): 2, ("fr", b"a", b"b"): 1}
    asked = P.trie_of({("en", b"a", b"b"): 1, ("en", b"x"): 1, ("it", b"a"): 1, ("fr", b"a", b"b"): 1}, 2)
    at = P.composed(asked, t)
    found = {p: int(t.weight[k][i]) if i >= 0 else None for k, level in enumerate(asked.paths()) for p, i in zip(level, at[k].tolist())}
    assert found == {("en", b"a"): big + 1, ("en", b"x"): None, ("fr", b"a"): 0, ("it", b"a"): None, ("en", b"a", b"b"): 3, ("fr", b"a", b"b"): 1}


def test_lowest_score_is_exact_and_ties_go_to_the_first_cut():
    a = 5 * 10**9 + 1
    assert P.lowest_score(a, [(a, a), (a + 1, a)]) == (999_999, a + 1, a)
    assert P.lowest_score(10, [(20, 20), (20, 20), (10, 40)]) == (250_000, 20, 20)


@pytest.mark.parametrize("entries", [10**6, 150])
def test_phrases_equal_a_plain_version(spark, monkeypatch, entries):
    monkeypatch.setattr(P, "RANGE_ENTRIES", entries)
    monkeypatch.setattr(P, "SAMPLE_BYTES", 1000)
    monkeypatch.setattr(P, "RANGE_SAMPLE", 400)
    rows = random_rows(150, 7) + [(t, "en") for t in tricky()] + [(None, "en"), ("one line that all have", "de")] * 30 + [("", None)]
    df = spark.createDataFrame([(t, x, 1, "own") for t, x in rows], "text string, lang string, rank int, n string").repartition(5)
    got = [tuple(r) for r in P.mine_phrases(df).collect()]
    want = plain_phrases(rows)
    assert sorted(got) == sorted(want) and len(want) > 50
    if entries < 1000:
        assert len(P.boundaries(df.select("text", "lang").fillna("und", ["lang"]), 3)) > 3


def test_options_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(P, "RANGE_ENTRIES", 200)
    monkeypatch.setattr(P, "SAMPLE_BYTES", 2000)
    rows = random_rows(80, 9, ("en",))
    df = spark.createDataFrame(rows, "body string, tongue string")
    got = P.mine_phrases(df, "body", "tongue", longest=4, least=3, inside=70, top=12).collect()
    assert sorted(map(tuple, got)) == sorted(plain_phrases(rows, 4, 3, 70, 12))
    none = P.mine_phrases(df.limit(0), "body", "tongue")
    assert none.collect() == [] and none.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert P.mine_phrases(spark.createDataFrame([(None, None), ("", "x"), ("only", "x")], "text string, lang string")).collect() == []
