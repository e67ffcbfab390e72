"""The training-data operators against brute force, exact round trips and held-out accuracy, on small tables."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyspark.llm import bpe_codec, chat_format, entropy_mix, flac_media, mixture_langid, queries, rendezvous, rlz_dedup, signature_tree, token_counts, winnowing
from tallyspark.llm import common

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
Q = queries.queries()


def sha(b):
    return hashlib.sha256(b).hexdigest()


def words(text):
    return (text or "").encode().split()


def corpus():
    """Small but awkward: nulls, empty texts, ties, repeated rows, shared passages, near copies, long words, all scripts."""
    rnd = random.Random(5)
    vocabulary = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(1, 7))) for _ in range(400)]
    text = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    passage, other = text(60), text(40)
    base = text(200)
    near = base.split(" ")
    near[100] = "changed"
    texts = [None, "", " \t\n", "one", "two words", "Two WORDS", base, base, " ".join(near), base.upper(), text(50) + " " + passage + "\n" + text(30), passage, "x " + passage + " y " + other,
             other + " tail", "a " * 500, "a " * 90, "\x1f\x85odd\xa0space " + text(40), "日本語 テキスト 😀" * 40, text(3000), passage + " " + passage, text(34), text(35), " ".join(base.split(" ")[:170])]
    rows = [(i, t, ["en", "de", None][i % 3], ["s1", "s2", None, ""][i % 4], len(t) if t else 0) for i, t in enumerate(texts)]
    return [*rows, rows[6], (None, base, None, None, 3), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame(corpus(), SCHEMA).repartition(3).write.parquet(f"{d}/documents.parquet")
    chats = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (2, 0, None, None), (2, 1, "assistant", None), (3, 0, "sys\ntem [INST] %0A", "[INST] x"), (3, 1, "assistant", "<s>y</s>"),
             (4, 0, "user", "<\\s>[\\INST] literal"), (4, 1, "assistant", "\\<\\\\s> <"), (None, 0, "user", "z"), (5, 0, "assistant", "")]
    spark.createDataFrame(chats, "conv_id long, turn long, role string, text string").write.parquet(f"{d}/conversations.parquet")
    return d


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("none"))
    spark.createDataFrame([], SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{d}/conversations.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    return d


def documents(spark, folder):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]


# ---- brute force

def brute_dedup(docs, width=35):
    seen = {}
    for _, t in docs:
        w = words(t)
        for i in range(len(w) - width + 1):
            k = b" ".join(w[i : i + width])
            seen[k] = seen.get(k, 0) + 1
    out = []
    for d, t in docs:
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if seen[b" ".join(w[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        out.append((d, len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone) if not g))))
    return out


def brute_sets(docs):
    out = []
    for _, t in docs:
        w = (t or "").encode().lower().split()
        out.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    return out


def brute_components(docs):
    sets, ids = brute_sets(docs), [d for d, _ in docs]
    up = {d: d for d in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(range(len(docs)), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            p, q = sorted((find(ids[a]), find(ids[b])), key=lambda v: 10**9 if v is None else v)
            up[q] = p
    return [(d, len(s), find(d) if s else d) for (d, _), s in zip(docs, sets)]


@pytest.mark.parametrize("where", ["folder", "sf"])
def test_dedup_is_exact(spark, request, where):
    d = request.getfixturevalue(where)
    got = [tuple(r) for r in Q["op1_rlz_dedup"](spark, d).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute_dedup(documents(spark, d))))


def test_dedup_over_many_blocks_and_shards(spark, sf, monkeypatch):
    monkeypatch.setattr(rlz_dedup, "corpus_blocks", lambda docs: common.corpus_blocks(docs, block_bytes=20_000))
    done = rlz_dedup.dedup_substrings(spark.read.parquet(f"{sf}/documents.parquet"))
    got = [tuple(r) for r in done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect()]
    assert sorted(got) == sorted(brute_dedup(documents(spark, sf)))
    for r in done.where("n_removed > 0").collect():
        assert sum(s.end - s.start for s in r.spans) == r.n_removed
        assert all(f.end - f.start >= rlz_dedup.WIDTH for f in r.factors)


def test_factors_read_the_same_at_their_source(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    reference = [w for _, t in sorted((r.doc_id, r.text or "") for r in docs.collect()) for w in words(t)]  # one block
    n = 0
    for r in rlz_dedup.dedup_substrings(docs).join(docs.select("doc_id", "text"), "doc_id").collect():
        for f in r.factors:
            assert words(r.text)[f.start : f.end] == reference[f.source_word : f.source_word + f.end - f.start]
            n += 1
    assert n > 10


@pytest.mark.parametrize("where", ["folder", "sf"])
def test_jaccard_components_are_exact(spark, request, where):
    d = request.getfixturevalue(where)
    got = [tuple(r) for r in Q["op4_signature_tree"](spark, d).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute_components(documents(spark, d))))


def test_jaccard_of_one_large_family_in_chunks(spark, monkeypatch):
    rnd = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(120):
        own = list(base)
        for _ in range(rnd.randrange(0, 4)):
            own[rnd.randrange(len(own))] = f"x{rnd.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(signature_tree, "corpus_blocks", lambda d: common.corpus_blocks(d, block_bytes=8_000))
    prepared = common.written(signature_tree.prepare(docs))
    tasks = signature_tree.family_tasks(prepared, 80, 1500).select("task", "i", "j").distinct().count()
    assert tasks > 10
    links = signature_tree.family_links
    monkeypatch.setattr(signature_tree, "family_links", lambda prepared, threshold: links(prepared, threshold, 1500))
    assert sorted(map(tuple, signature_tree.near_copies(docs).collect())) == brute_components(rows)


def test_signature_tree_bounds_never_lose_a_link():
    rng = np.random.default_rng(3)
    sets = []
    for _ in range(60):
        if sets and rng.random() < 0.7:
            s = sets[rng.integers(len(sets))].copy()
            drop = rng.random(len(s)) < rng.choice([0.02, 0.1, 0.2])
            s = np.unique(np.concatenate([s[~drop], rng.integers(0, 2**63, int(drop.sum()), dtype=np.uint64)]))
        else:
            s = np.unique(rng.integers(0, 2**63, int(rng.integers(1, 300)), dtype=np.uint64))
        sets.append(s)
    tree, forest, brute = signature_tree.SignatureTree(sets, np.array([len(s) for s in sets]), np.arange(60)), signature_tree.Forest(60), signature_tree.Forest(60)
    signature_tree.dual_join(tree, tree, forest, 80)
    for a, b in itertools.combinations(range(60), 2):
        n = len(np.intersect1d(sets[a], sets[b]))
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            brute.join(a, b)
    assert [forest.find(i) for i in range(60)] == [brute.find(i) for i in range(60)]


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.label for r in common.components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


# ---- media

@pytest.mark.parametrize("where", ["folder", "sf"])
def test_media_round_trip(spark, request, where):
    d = request.getfixturevalue(where)
    got = {}
    for r in Q["op2_flac_media"](spark, d).collect():
        got.setdefault(r.doc_id, []).append(r)
    for i, t in documents(spark, d):
        raw = (t or "").encode()
        payload = raw + b"\0" * ((-len(raw)) % 64 if raw else 64)
        want = (len(raw), len(payload), sha(payload), zlib.crc32(payload[-64:]))
        assert want in [(r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got[i]]


def samples():
    rng = np.random.default_rng(1)
    wave = (np.sin(np.arange(9000) / 15) * 100 + 128).astype(np.uint8).tobytes()
    return [b"\0" * 64, bytes(range(256)) * 4, rng.integers(0, 256, 10000, np.uint8).tobytes(), wave, b"\x00\xff" * 3000, b"\x80" * 8192 + b"x" * 64, b"the quick brown fox " * 500, b"z"]


def test_flac_round_trip_seek_and_damage():
    payloads = samples()
    streams = flac_media.encode(payloads)
    assert [b"".join(b.pcm for b in blocks) for blocks in flac_media.decode(streams)] == payloads
    part = flac_media.decode([streams[3]], [(5000, 5001)])[0]
    assert len(part) == 1 and part[0].sample == 4096 and part[0].pcm == payloads[3][4096:8192]
    for at in (-1, -20):
        bad = bytearray(streams[3])
        bad[at] ^= 1
        with pytest.raises(flac_media.FlacError):
            flac_media.decode([bytes(bad)])
    assert len(streams[3]) < 0.7 * len(payloads[3])  # the predictors are used


def _frame(bits, n, number=0):
    body = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    head = flac_media._frame_header(number, n)
    raw = np.frombuffer(head + body, np.uint8)
    return head + body + int(flac_media.crc16_many(raw, np.array([0]), np.array([len(raw)]))[0]).to_bytes(2, "big")


def test_flac_decodes_what_the_encoder_never_writes():
    """Rice partitions, an escaped partition, five-bit parameters and a fixed predictor of order 3, by hand."""
    values = np.array([3, 5, 8, 9, 9, 7, 4, 4], np.int64)
    residual = values - 0
    for order in range(3):
        residual = np.diff(values, n=order + 1, prepend=np.zeros(order + 1, np.int64))
    z = lambda v: (v << 1) ^ (v >> 63)
    rice = lambda v, k: "0" * (int(z(v)) >> k) + "1" + (f"{int(z(v)) & ((1 << k) - 1):0{k}b}" if k else "")
    bits = "0" + f"{8 + 3:06b}" + "0" + "".join(f"{int(v) & 255:08b}" for v in values[:3])
    bits += "01" + "0001" + "00010" + rice(residual[3], 2) + "11111" + "00110" + "".join(f"{int(v) & 63:06b}" for v in residual[4:])
    frame = _frame(bits, 8)
    md5 = hashlib.md5(values.astype(np.int8).tobytes()).digest()
    info = (16).to_bytes(2, "big") * 2 + len(frame).to_bytes(3, "big") * 2 + ((8000 << 44) | (7 << 36) | 8).to_bytes(8, "big") + md5
    seek = bytes(16) + (8).to_bytes(2, "big")
    stream = b"fLaC\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(seek).to_bytes(3, "big") + seek + frame
    assert np.frombuffer(flac_media.decode([stream])[0][0].pcm, np.uint8).astype(int).tolist() == (values + 128).tolist()


# ---- fingerprints

def test_winnowing_matches_its_definition():
    rnd = random.Random(2)
    texts = ["".join(rnd.choice("ab ") for _ in range(rnd.randrange(60))) for _ in range(200)] + ["", "a", "a" * 30]
    k, w = 4, 6
    doc, at, _ = winnowing.winnow(*winnowing._points(texts), k, w)
    d1, a1, h1 = winnowing.winnow(*winnowing._points(texts), k, 1)
    every = {(d, p): h for d, p, h in zip(d1.tolist(), a1.tolist(), h1.tolist())}
    for d, t in enumerate(texts):
        n = 0 if not t else max(1, len(t) - k + 1)
        h = [every[d, i] for i in range(n)]
        want = set()
        for i in range(max(1, n - w + 1) if n else 0):
            window = h[i : i + w]
            want.add(i + max(j for j, x in enumerate(window) if x == min(window)))
        assert {p for dd, p in zip(doc.tolist(), at.tolist()) if dd == d} == want


def test_shared_passages_share_a_fingerprint():
    rnd = random.Random(3)
    text = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    passage = text(winnowing.K + winnowing.W - 1)
    _, (a, b, c) = winnowing.fingerprints([text(500) + passage + text(70), passage + text(300), text(600)])
    assert len(np.intersect1d(a, b)) and not len(np.intersect1d(a, c))


@pytest.mark.parametrize("where", ["folder", "sf"])
def test_edits_and_next_documents(spark, request, where, monkeypatch):
    d = request.getfixturevalue(where)
    if where == "sf":
        monkeypatch.setattr(winnowing, "block_count", lambda docs: common.block_count(docs, block_bytes=40_000))
    docs = sorted(documents(spark, d), key=lambda r: (-1 if r[0] is None else r[0], r[1] or ""))
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_chars, r.edited_sha256) for r in Q["op3_winnowing"](spark, d).collect())
    want = []
    for i, (k, t) in enumerate(docs):
        t, nxt = t or "", docs[(i + 1) % len(docs)][1] or ""
        half = len(t) // 2
        want.append((k is not None, k or 0, len(t), sha((t[: len(t) - half] + nxt[:half]).encode())))
    assert got == sorted(want)
    for r in Q["op3_winnowing"](spark, d).collect():
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1


# ---- languages

def test_language_on_held_out_documents(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "text")
    got = Q["op5_mixture_langid"](spark, "/root/testdata/sf0.01").join(docs, "doc_id").where("held_out and lang is not null and length(text) > 20").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert got > 0.97


def test_language_edge_cases(spark, folder):
    rows = Q["op5_mixture_langid"](spark, folder).collect()
    assert len(rows) == len(corpus())
    for r in rows:
        assert 0 <= r.score <= 1 and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    assert {r.lang_pred for r in rows if r.doc_id in (0, 1, 2)} == {"und"}


def test_mixture_of_two_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = mixture_langid.fit(docs)
    text = {r.lang: r.text for r in docs.where("length(text) between 2000 and 4000").groupBy("lang").agg(F.min("text").alias("text")).collect()}
    shares = mixture_langid.infer(model, [text["de"] + " " + text["fr"], text["es"]])
    assert {model.languages[i] for i in np.flatnonzero(shares[0])} == {"de", "fr"}
    assert [model.languages[i] for i in np.flatnonzero(shares[1])] == ["es"]


# ---- mixing

def brute_targets(sizes):
    order = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    weight, fixed, left = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, {}, 1.5 * sum(sizes.values())
    while True:
        open_ = [s for s in order if s not in fixed]
        rest = left - sum(fixed.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 2.0 * sizes[s] for s in over}


@pytest.mark.parametrize("where", ["folder", "sf"])
def test_mix_meets_its_targets(spark, request, where):
    d = request.getfixturevalue(where)
    docs = [(r.doc_id, r.source, len(words(r.text))) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    sizes = {}
    for _, s, n in docs:
        sizes[s] = sizes.get(s, 0) + n
    want = brute_targets(sizes)
    rows = Q["op6_entropy_mix"](spark, d).collect()
    assert sorted(map(repr, [(r.doc_id, r.size) for r in rows])) == sorted(map(repr, [(i, n) for i, _, n in docs]))
    assert sorted(Q["op6_entropy_mix"](spark, d).collect(), key=repr) == sorted(rows, key=repr)
    by_total = {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size and (not r.size or r.taken % r.size == 0)
        by_total.setdefault((r.source_size, r.target), []).append(r.taken)
    for (size, target), taken in by_total.items():
        assert any(size == sizes[s] and abs(target - want[s]) < 1e-6 * (1 + want[s]) for s in sizes)
        if where == "sf":
            assert abs(sum(taken) - target) <= 0.02 * target + 30


def test_mixed_documents_keep_all_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("copies", F.lit(9))
    out = entropy_mix.mix_documents(docs)
    assert out.columns == docs.columns
    taken = Q["op6_entropy_mix"](spark, folder).agg(F.sum("copies")).first()[0]
    assert out.count() == taken


# ---- tokens

def tricky():
    rnd = random.Random(1)
    own = ["", " ", "   ", "a  b   ", "\n\n x\t\t y ", "<|endoftext|>x<|endoftext|>", "日本語 😀😀  ▁▁x", "  lead", "▁a", "<s></s> [INST]", "don't I'll we've", " x  　", "a" * 3000, "ab" * 2000, "\x00\x01\x1c \x85"]
    return own + ["".join(rnd.choice("ab c\ndéZ19'.,<|>▁ ") for _ in range(rnd.randrange(80))) for _ in range(800)] + [t for _, t, *_ in corpus() if t]


def test_bpe_equals_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, codec, texts = Tokenizer.from_file(path), bpe_codec.BpeCodec(path, cache=500), tricky()
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    got = [ids for i in range(0, len(texts), 50) for ids in codec.encode_batch(texts[i : i + 50])]
    assert got == want
    counts = np.array([len(x) for x in got])
    raw, at = codec.decode_flat(np.array([i for x in got for i in x], np.int64), counts)
    assert [raw[a:b].tobytes().decode() for a, b in zip(at, at[1:])] == texts


def test_pair_table_agrees_with_plain_merging():
    import public_tokenizers

    codec, rnd = bpe_codec.codec(public_tokenizers.path("byte_bpe_50k.json")), random.Random(4)

    def merge(raw):
        parts = [codec.id_of[bytes([b])] for b in raw]
        while True:
            ranked = [(codec.merge_rank[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in codec.merge_rank]
            if not ranked:
                return parts
            _, i = min(ranked)
            parts[i : i + 2] = [codec.id_of[codec.piece[parts[i]] + codec.piece[parts[i + 1]]]]

    for _ in range(1500):
        a, b = rnd.randrange(50256), rnd.randrange(50256)
        if merge(codec.piece[a]) == [a] and merge(codec.piece[b]) == [b]:
            assert codec.compatible(a, b) == (merge(codec.piece[a] + codec.piece[b]) == [a, b])


def test_bpe_query_and_columns(spark, folder):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    want = sorted(repr((d, len(ids), sha(",".join(map(str, ids)).encode()), sha((t or "").encode()))) for d, t in documents(spark, folder) for ids in [library.encode(t or "", add_special_tokens=False).ids])
    assert sorted(repr(tuple(r)) for r in Q["op7_bpe_codec"](spark, folder).collect()) == want
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("decoded2", F.lit("x"))
    back = bpe_codec.decode_documents(bpe_codec.encode_documents(docs, path), path)
    assert back.columns == ["doc_id", "lang", "source", "n_chars", "decoded2", "decoded"]
    assert sorted(repr((r.doc_id, r.decoded)) for r in back.collect()) == sorted(repr((d, t or "")) for d, t in documents(spark, folder))
    assert bpe_codec.encode_documents(docs.withColumn("ids", F.lit(1)), path).schema["ids"].dataType.simpleString() == "array<int>"


def test_token_counts_equal_the_library(spark):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    texts = tricky()
    want = [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode(texts)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "doc_id long, text string").repartition(4)
    for frequent in (None, []):
        got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(docs, path, frequent=frequent).collect()}
        assert got == {i: (len(t.encode()), n) for i, (t, n) in enumerate(zip(texts, want))} | {-1: (0, 0)}


# ---- chats and shards

@pytest.mark.parametrize("where", ["folder", "sf"])
def test_chats_round_trip(spark, request, where):
    d = request.getfixturevalue(where)
    rows = [(r.conv_id, r.turn, r.role or "", r.text or "") for r in spark.read.parquet(f"{d}/conversations.parquet").collect()]
    said = "</s>[INST] ok [/INST]"
    rows += [(-7, 0, "user", said), (-7, 1, "assistant", said)]
    want = []
    for c in {r[0] for r in rows}:
        own = sorted(r[1:] for r in rows if r[0] == c)
        loss = "".join(t for _, r, t in own if r == "assistant")
        want.append((c, len(own), sha("".join(f"{r}\n{t}\n" for _, r, t in own).encode()), len(loss), sha(loss.encode())))
    got = [tuple(r)[:5] for r in Q["op9_chat_format"](spark, d).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_only_conflicting_chats_are_escaped(spark, folder):
    got = {r.conv_id: (r.escaped, r.formatted) for r in chat_format.format_chats(spark.read.parquet(f"{folder}/conversations.parquet")).collect()}
    assert [c for c, (e, _) in sorted(got.items(), key=repr) if e] == [3, 4]
    assert got[1][1] == "[INST] user\na [/INST][INST] user\na [/INST]<s>b</s>"
    assert "<s>y</s>" not in got[3][1]


def test_shards(spark, folder, sf):
    for d in (folder, sf):
        rows = Q["op10_rendezvous"](spark, d).collect()
        docs = documents(spark, d)
        assert sorted(repr((r.doc_id, r.size, r.text_crc32)) for r in rows) == sorted(repr((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))) for i, t in docs)
        for s in range(8):
            assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
        assert all(r.grown_shard in (r.shard, 8) for r in rows)
        where = {}
        assert all(where.setdefault(r.doc_id, r.shard) == r.shard for r in rows)


def test_weighted_shards_follow_their_weights(spark):
    df = rendezvous.assign_shards(spark.range(20000).withColumnRenamed("id", "k"), "k", [3.0, 1.0, 0.0])
    n = {r["shard"]: r["count"] for r in df.groupBy("shard").count().collect()}
    assert set(n) == {0, 1} and abs(n[0] / 20000 - 0.75) < 0.02


@pytest.mark.parametrize("name", [n for n in Q if n != "op9_chat_format"])
def test_empty_tables(spark, empty, name):
    assert Q[name](spark, empty).collect() == []


# ---- pipeline

def test_pipeline_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = common.written(corpus_pipeline.language_id(spark, docs, sf))
    assert kept.columns == docs.columns and kept.count() >= 0.95 * docs.where("length(text) > 20").count()
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    first = {c for _, _, c in brute_components(rows)}
    unique = common.written(corpus_pipeline.near_copies(spark, kept, sf))
    assert {r.doc_id for r in unique.collect()} == first
    rows = [(r.doc_id, r.text) for r in unique.collect()]
    brute = {d: (n, gone, h) for d, n, gone, h in brute_dedup(rows)}
    cut = common.written(corpus_pipeline.repeated_passages(spark, unique, sf))
    texts = dict(rows)
    left = {r.doc_id: r.text for r in cut.collect()}
    assert set(left) == {d for d, (n, gone, _) in brute.items() if gone < n or not gone}
    for d, t in left.items():
        assert t == texts[d] if not brute[d][1] else sha(t.encode()) == brute[d][2]
    mixed = common.written(corpus_pipeline.mixture(spark, cut, sf))
    assert mixed.columns == docs.columns
    n = sum(len(words(t)) for t in left.values())
    assert abs(sum(len(words(r.text)) for r in mixed.collect()) - 1.5 * n) < 0.02 * n
    out = corpus_pipeline.tokens(spark, mixed, sf)
    assert sorted(r.decoded_sha256 for r in out.collect()) == sorted(sha(r.text.encode()) for r in mixed.collect())


def test_pipeline_on_odd_and_empty_tables(spark, folder, empty):
    assert corpus_pipeline.run(spark, folder).count() > 0
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_packed_rows_come_back(spark):
    df = spark.createDataFrame([(i % 3, i, None if i % 5 == 0 else str(i)) for i in range(50)], "block int, doc_id long, text string")
    rows = [r for p in common.packed(df, "block").collect() for r in common.unpack(pa.chunked_array([pa.array([bytes(p.payload)], pa.binary())])).to_pylist()]
    assert sorted(r["doc_id"] for r in rows) == list(range(50))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    cur = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    df = Q[name](spark, sf)
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(repr, cur.fetchall())) == sorted(repr(tuple(r)) for r in df.select(*names).collect())


def test_pcm_blocks_are_seekable(spark):
    text = "".join(chr(33 + i % 90) for i in range(20000))
    stored = flac_media.to_media(spark.createDataFrame([(1, text, "x"), (2, None, "y"), (3, "short", "z")], "doc_id long, text string, source string"))
    rows = flac_media.pcm_blocks(stored).orderBy("doc_id", "sample").collect()
    assert b"".join(bytes(r.pcm) for r in rows if r.doc_id == 1) == flac_media.padded(text.encode())
    assert [r.sample for r in rows if r.doc_id == 1] == [0, 4096, 8192, 12288, 16384] and rows[0].source == "x"
    part = flac_media.pcm_blocks(stored, first=5000, end=9000).orderBy("doc_id", "sample").collect()
    assert [(r.doc_id, r.sample) for r in part] == [(1, 4096), (1, 8192)]


def test_clashing_extra_columns_give_way_or_stay(spark, folder):
    import public_tokenizers

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for c in ("Score", "lang_pred", "fingerprint", "n_bytes", "media", "n_tokens", "shard", "kept", "_kept", "_id", "_gone", "_h", "spans", "component_id", "block", "payload"):
        docs = docs.withColumn(c, F.lit("own"))
    n = docs.count()
    model = mixture_langid.fit(docs)
    assert mixture_langid.identify(docs, model).count() == n
    assert winnowing.fingerprint_documents(docs).where("fingerprint = 'own'").isEmpty()
    assert flac_media.read_media(flac_media.to_media(docs)).count() == n
    assert token_counts.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model")).count() == n
    assert rendezvous.assign_shards(docs, "doc_id", [1.0, 1.0]).schema["shard"].dataType.simpleString() == "int"
    assert rlz_dedup.dedup_substrings(docs).count() == signature_tree.near_copies(docs).count() == n
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = common.written(stage(spark, docs, folder))
        assert out.columns == docs.columns and out.where("_kept <> 'own' or Score <> 'own'").isEmpty()
        docs = out


def test_entries_count_only_for_their_own_bytes():
    texts = [b"abc", b"abd", b"ab", b"", b"zz"]
    raw, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([3, 3, 2, 0, 2])
    starts = ends - [3, 3, 2, 0, 2]
    known = np.frombuffer(b"abdab", np.uint8), np.array([0, 3, 5]), np.array([3, 5, 5])
    assert token_counts.same_bytes(raw, starts, ends, np.array([0, 0, 1, 2, -1]), *known).tolist() == [False, True, True, True, False]


def test_pipeline_keeps_rows_of_one_id_that_do_not_link(spark):
    import corpus_pipeline

    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, "one text of its own here"), (1, "quite another text under the same id"), (1, text), (2, text.upper()), (3, text + " end"), (None, text), (4, ""), (4, None), (5, "x y"), (5, "x y")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_copies(spark, docs, "").collect()]
    count = lambda x: sum(t == x for _, t in got)
    assert count(rows[0][1]) == count(rows[1][1]) == count("x y") == 1 and (None, text) in got and (4, "") in got and (4, None) in got
    assert sum(shingled(t) for i, t in got if i is not None) == 1


def shingled(text):
    return bool(text) and text.lower().startswith("w0 w1 ")
