"""Vector codes and byte-level BPE through the library: against plain versions."""

import base64
import hashlib
import math

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from test_llm_operators import tricky

from tallyspark.llm import anchor_codes, bpe_codec, library_bpe

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


# ---- vector codes

def plain_codes(rows, parts, entries, rounds):
    """Codes and errors of (id, vector) rows in their order, and the codebooks, by comparing every part with every entry."""
    kept = sorted((r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    ints = [[math.floor(256 * x) for x in v] for _, v in kept]
    w = len(ints[0]) // parts
    cut = [[v[p * w : p * w + w] for p in range(parts)] for v in ints]
    books = [[list(v[p]) for v in cut[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for step in range(rounds + 1):
        codes = [[min(range(len(books[p])), key=lambda e: (far(v[p], books[p][e]), e)) for p in range(parts)] for v in cut]
        if step == rounds:
            break
        for p in range(parts):
            for e in range(len(books[p])):
                own = [v[p] for v, c in zip(cut, codes) if c[p] == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own)]
    return [(i, c, sum(far(v[p], books[p][c[p]]) for p in range(parts))) for (i, _), v, c in zip(kept, cut, codes)], books


@pytest.mark.parametrize("spread", [1, 20, 600])
def test_forest_owners_equal_brute_force(spread):
    rng = np.random.default_rng(spread)
    values = rng.integers(-spread, spread + 1, (900, 12))
    values[300:600] = values[5]  # a vector that fills the block is one point
    f, place = anchor_codes.forest(values, 3)
    assert f.count[f.roots].tolist() == [900] * 3 and (f.high - f.low)[f.left < 0].max() <= anchor_codes.LEAF
    for left, right, low, high, total in zip(f.left, f.right, f.low, f.high, f.total):
        if left >= 0:
            assert (f.low[left], f.high[left], f.high[right]) == (low, f.low[right], high) and (f.total[left] + f.total[right] == total).all()
    books = values[rng.integers(0, 900, 32)].reshape(32, 3, 4).transpose(1, 0, 2).copy()  # equal entries among them
    got = anchor_codes.owners(f, books)
    for p in range(3):
        own = values[:, p * 4 : p * 4 + 4]
        want = ((own[:, None] - books[p]) ** 2).sum(-1).argmin(1)
        sums = np.zeros((32, 4), np.int64)
        np.add.at(sums, want, own)
        assert (got.entry[place[p]] == want).all() and (got.sums[p] == sums).all() and (got.counts[p] == np.bincount(want, minlength=32)).all()


def test_descent_owns_balls_and_skips_comparisons():
    rng = np.random.default_rng(1)
    centres = rng.integers(-5000, 5000, (32, 8))
    values = centres[rng.integers(0, 32, 4000)] + rng.integers(-20, 21, (4000, 8))
    f, _ = anchor_codes.forest(values, 2)
    got = anchor_codes.owners(f, centres.reshape(32, 2, 4).transpose(1, 0, 2).copy())
    assert got.owned > 0.9 * len(f.points) and got.compared < 0.1 * 32 * len(f.points)


@pytest.mark.parametrize("block", [1 << 18, 700])
def test_codes_equal_a_plain_version(spark, monkeypatch, block):
    monkeypatch.setattr(anchor_codes, "BLOCK_VALUES", block)
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(0, 0.3, 12).round(2).tolist()) for i in range(300)]
    rows += [(7, rows[3][1]), (7, rows[3][1]), (None, rows[9][1]), (None, None), (-5, [0.5] * 11 + [math.nan]), (-6, [0.5] * 11 + [None]), (-7, [math.inf] + [0.0] * 11)] + [(1000 + i, rows[0][1]) for i in range(200)]
    df = spark.createDataFrame([(i, v, i % 3 if i else None, "kept") for i, v in rows], "vec_id long, embedding array<float>, label int, codes string")
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    want, books = plain_codes(rows, 4, 16, 2)
    coded, got = anchor_codes.quantize(df, parts=4, entries=16)
    assert got.tolist() == books and coded.columns == ["vec_id", "label", "codes", "error"]
    assert sorted(((r.vec_id, list(r.codes), r.error) for r in coded.collect()), key=repr) == sorted(want, key=repr)
    labels = {}
    for i, _, e in want:
        key = i % 3 if i else None
        labels[key] = labels.get(key, 0) + e
    assert {(r.label, r.label_error) for r in anchor_codes.with_label_error(coded).collect()} == set(labels.items())


def test_code_tables_that_are_empty_small_or_uneven(spark):
    empty = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    coded, books = anchor_codes.quantize(empty)
    assert coded.collect() == [] and books.size == 0 and coded.columns == ["vec_id", "codes", "error"]
    few, books = anchor_codes.quantize(spark.createDataFrame([(2, [1.0] * 16), (1, [0.5] * 16)], "vec_id long, embedding array<double>"))
    assert books.shape == (16, 2, 1) and [(r.vec_id, r.codes[0], r.error) for r in few.orderBy("vec_id").collect()] == [(1, 0, 0), (2, 1, 0)]
    with pytest.raises(ValueError, match="equal parts"):
        anchor_codes.quantize(spark.createDataFrame([(1, [1.0] * 15)], "vec_id long, embedding array<float>"))
    mixed, books = anchor_codes.quantize(spark.createDataFrame([(1, [1.0] * 16), (2, [1.0] * 32), (3, []), (4, [2.0] * 16)], "vec_id long, embedding array<float>"))
    assert sorted(r.vec_id for r in mixed.collect()) == [1, 4] and books.shape == (16, 2, 1)


# ---- byte-level BPE through the library

def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}, special_tokens={})


def test_character_classes_are_the_libraries():
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    kinds = bpe_codec._kinds()
    for kind, pattern in ((bpe_codec._LETTER, r"\p{L}"), (bpe_codec._NUMBER, r"\p{N}"), (bpe_codec._SPACE, r"\s")):
        only = tiktoken.Encoding("one", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        found = np.zeros(0x110000, bool)
        found[list(map(ord, bytes(only.encode_ordinary(every)).decode()))] = True
        assert (found == (kinds == kind)).all()


def hard_texts():
    rng = np.random.default_rng(11)
    letters = list("abe nst'\n\t 1é日本語🙂ſא́ 　<|>") + ["ing ", "the", "  ", "'ll", "\U0001e6c0"]
    return ["".join(rng.choice(letters, n)) for n in (1, 5, 40, 400, 3000)] + ["a" * 3000, " " * 700, "日" * 500, "<|endoftext|> x", "naïve 🙂🙃 end"]


def test_library_ids_equal_tiktoken(spark):
    want = reference()
    texts = [t or "" for t in tricky()] + hard_texts()
    c = library_bpe.LibraryCodec(RANKS, cache=50)  # a table that is emptied again and again
    assert c.encode_batch(texts) == [want.encode_ordinary(t) for t in texts]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(-1, None, None), (3, texts[3], "x")], "doc_id long, text string, ids string")
    rows = library_bpe.round_trip(df, RANKS).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        ids = want.encode_ordinary(texts[r.doc_id] if r.doc_id >= 0 else "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(want.decode_bytes(ids)).hexdigest())
    encoded = library_bpe.encode_documents(df, RANKS)
    assert encoded.columns == ["doc_id", "ids"]
    assert {r.doc_id: r.decoded for r in library_bpe.decode_documents(encoded, RANKS).collect()} == {-1: ""} | dict(enumerate(texts))
    assert library_bpe.round_trip(df.limit(0), RANKS).collect() == []


def test_long_texts_are_cut_between_pre_tokens(monkeypatch):
    monkeypatch.setattr(bpe_codec, "STEP", 200)
    c, want = library_bpe.LibraryCodec(RANKS), reference()
    texts = ["".join(hard_texts()[:5]), "x" * 900 + " y " * 300]
    assert c.encode_batch(texts) == [want.encode_ordinary(t) for t in texts]


def test_tokens_that_merges_never_reach():
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"abcd": 257, b"bc": 258, b"abc": 259}
    assert library_bpe.pair_of(b"abcd", ranks) is None and library_bpe.pair_of(b"abc", ranks) == (b"ab", b"c")


def test_offsets_equal_the_library(spark, monkeypatch):
    monkeypatch.setattr(bpe_codec, "STEP", 300)
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    c = library_bpe.LibraryCodec(RANKS)
    ranks = library_bpe.read_ranks(RANKS)
    merges = [(c.written(a), c.written(b)) for t, _ in sorted(ranks.items(), key=lambda x: x[1]) if len(t) > 1 for a, b in [library_bpe.pair_of(t, ranks)]]
    whole = Tokenizer(models.BPE(vocab={c.written(t): i for t, i in ranks.items()}, merges=merges, ignore_merges=True))
    whole.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(public_tokenizers.PATTERN), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    texts = hard_texts()
    df = spark.createDataFrame(list(enumerate(texts)) + [(-1, None)], "doc_id long, text string")
    got = {r.doc_id: [tuple(t) for t in r.tokens] for r in library_bpe.encode_with_offsets(df, RANKS).collect()}
    assert got.pop(-1) == []
    for i, t in enumerate(texts):
        e = whole.encode(t, add_special_tokens=False)
        assert got[i] == [(k, *s) for k, s in zip(e.ids, e.offsets)], i


def test_split_characters_decode(spark):
    c = library_bpe.LibraryCodec(RANKS)
    ids = next(x for x in (c.encode_batch([ch])[0] for ch in "🙃𝔘𐍈") if len(x) > 1)
    df = spark.createDataFrame([(1, ids), (2, ids[:-1]), (3, []), (4, None)], "id long, ids array<int>")
    got = {r.id: r.decoded for r in library_bpe.decode_documents(df, RANKS).collect()}
    assert len(got[1]) == 1 and got[1] != "�" and set(got[2]) == {"�"} and got[3] == got[4] == ""
    assert isinstance(c.spans(np.array(ids, np.int32), np.array([len(ids)]))[0], np.ndarray) and pa.array(ids).type == pa.int64()
