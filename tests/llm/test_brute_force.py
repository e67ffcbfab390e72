"""Results that SQL cannot express, against plain versions; hot rows and very long texts."""

import json
import math
import os
import subprocess
import sys
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from test_llm_operators import Q, brute_dedup, brute_targets, corpus, documents, folder, samples, sha, tricky, words  # noqa: F401

from tallyspark.llm import common, entropy_mix, flac_media, mixture_langid, rendezvous, rlz_dedup, signature_tree, winnowing


# ---- fingerprints

def plain_fingerprint(text, k, w):
    """(position, gram) of the rightmost smallest gram of every window, with the module's gram hashes."""
    grams = [text[i : i + k] for i in range(len(text) - k + 1)] if len(text) >= k else [text] * bool(text)
    hashes = [gram_hash(g) for g in grams]
    chosen = set()
    for i in range(max(1, len(grams) - w + 1) if grams else 0):
        window = hashes[i : i + w]
        chosen.add(i + max(j for j, h in enumerate(window) if h == min(window)))
    return ",".join(f"{hashes[p]:016x}@{p}" for p in sorted(chosen)), {hashes[p] for p in chosen}


def scramble(x):
    mask = (1 << 64) - 1
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
    x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
    return x ^ x >> 31


def gram_hash(gram):
    return scramble(sum(scramble(ord(c)) * pow(common._Q, i, 1 << 64) for i, c in enumerate(gram)) & (1 << 64) - 1)


def test_fingerprint_query_equals_a_plain_version(spark, folder, monkeypatch):  # noqa: F811
    monkeypatch.setattr(winnowing, "block_count", lambda docs: common.block_count(docs, block_bytes=4_000))
    monkeypatch.setattr(winnowing, "SAMPLED", 2)
    docs = sorted(documents(spark, folder), key=lambda r: (-1 if r[0] is None else r[0], r[1] or ""))
    want = []
    for i, (d, t) in enumerate(docs):
        t, after = t or "", docs[(i + 1) % len(docs)][1] or ""
        half = len(t) // 2
        changed = t[: len(t) - half] + after[:half]
        (p, a), (p_e, b), (_, c) = (plain_fingerprint(x, winnowing.K, winnowing.W) for x in (t, changed, after))
        like = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        want.append((d, len(t), sha(changed.encode()), p, p_e, like(a, b), like(a, c)))
    got = [tuple(r) for r in Q["op3_winnowing"](spark, folder).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_ranges_are_cut_by_bytes(spark):
    """Texts of 100 kB beside many short ones: no range holds more than twice its share."""
    rows = spark.range(24_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 300, F.repeat(F.lit("long text "), 10_000)).otherwise("short").alias("text"))
    ranges = winnowing.ranges_of(rows.repartition(7))
    held = {}
    for d, t in rows.collect():
        (at,), _ = ranges.place(pa.array([d]), pa.array([t[:64]]))
        held[at] = held.get(at, 0) + len(t) + 16
    assert len(held) == len(ranges) >= 3 and max(held.values()) <= 2 * common.BLOCK_BYTES


def test_half_edited_texts_stay_near(spark):
    rng = np.random.default_rng(5)
    rows = [(i, "".join(rng.choice(list("abcdefghij "), 110))) for i in range(60)]
    got = winnowing.compare_with_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert min(r.near_edited for r in got) > 0 and max(r.near_next for r in got) == 0


def test_long_fingerprints_in_stretches():
    text = "".join(t for t in tricky() if t) * 3
    for step in (100, 777, 1 << 20):
        one, own = winnowing.long_fingerprint(text, 5, 9, step)
        assert one == winnowing.fingerprints([text], 5, 9)[0][0] and set(own.tolist()) == {int(e.split("@")[0], 16) for e in one.split(",")}


# ---- media

def test_media_columns(spark, folder):  # noqa: F811
    by_text, got = {}, {}
    for r in Q["op2_flac_media"](spark, folder).collect():
        got.setdefault(r.doc_id, []).append(r)
    for d, t in documents(spark, folder):
        payload = flac_media.padded((t or "").encode())
        r = next(r for r in got[d] if r.payload_sha256 == sha(payload))
        x = [b - 128 for b in payload]
        crossings = sum((a < 0) != (b < 0) for a, b in zip(x, x[1:]))
        assert r.feature == f"n={len(x)};mean={sum(x) / len(x):.4f};rms={math.sqrt(sum(v * v for v in x) / len(x)):.4f};peak={max(map(abs, x))};crossings={crossings}"
        stream = flac_media.encode([payload])[0]
        assert (r.media_bytes, r.media_sha256, r.tail_crc32) == (len(stream), sha(stream), zlib.crc32(payload[-64:]))
        assert [(b.sample, b.samples) for b in r.blocks] == [(i, min(4096, len(payload) - i)) for i in range(0, len(payload), 4096)]
        same = by_text.setdefault(t or "", r)
        assert same[2:] == r[2:]


def test_streams_without_a_seek_table():
    streams = flac_media.encode(samples())
    for stream, payload in zip(streams, samples()):
        at, kept = 4, []
        while True:
            size, kind = int.from_bytes(stream[at + 1 : at + 4], "big"), stream[at] & 0x7F
            if kind != 3:
                kept.append(bytes([kind]) + stream[at + 1 : at + 4 + size])
            last, at = stream[at] & 0x80, at + 4 + size
            if last:
                break
        kept[-1] = bytes([kept[-1][0] | 0x80]) + kept[-1][1:]
        bare = b"fLaC" + b"".join(kept) + stream[at:]
        assert b"".join(b.pcm for b in flac_media.decode([bare])[0]) == payload


# ---- languages

def test_inference_equals_plain_expectation_maximisation(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = mixture_langid.fit(docs)
    texts = [r.text for r in docs.where("length(text) between 50 and 1500").orderBy("doc_id").limit(40).collect()] + ["", "12 !", "a"]
    texts += [texts[0] + " " + texts[1] + " " + texts[2]]
    got = mixture_langid.infer(model, texts)
    table = model.table.astype(float)
    for text, shares in zip(texts, got, strict=True):
        scores = []
        for word in "".join(c if c.isalpha() else " " for c in text.lower()).split():
            buckets, _, _ = mixture_langid.words_of([word])
            scores.append([sum(table[b, k] for b in buckets) for k in range(len(model.languages))])

        def likelihood(part, steps):
            for _ in range(steps):
                sums = [0.0] * len(part)
                for s in scores:
                    joint = [p * math.exp(x - max(s)) for p, x in zip(part, s)]
                    sums = [a + j / sum(joint) for a, j in zip(sums, joint)]
                part = [a / len(scores) for a in sums]
            return part, sum(math.log(sum(p * math.exp(x - max(s)) for p, x in zip(part, s))) + max(s) for s in scores)

        if not scores:
            assert not shares.any()
            continue
        cost = 2.0 + 0.5 * math.log(len(scores) + 1)
        part, like = likelihood([1 / len(model.languages)] * len(model.languages), mixture_langid.STEPS)
        value = like - cost * sum(p > 0 for p in part)
        while sum(p > 0 for p in part) > 1:
            low = min(p for p in part if p > 0)
            drop = max(i for i, p in enumerate(part) if p == low)
            trial = [0.0 if i == drop else p for i, p in enumerate(part)]
            trial = [p / sum(trial) for p in trial]
            trial, like = likelihood(trial, mixture_langid.STEPS)
            if like - cost * sum(p > 0 for p in trial) < value:
                break
            part, value = trial, like - cost * sum(p > 0 for p in trial)
        assert np.allclose(shares, part, atol=1e-4)


def test_long_texts_are_inferred_by_distinct_words(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) > 3000")
    model = mixture_langid.fit(docs)
    text = " ".join(r.text for r in docs.orderBy("doc_id").limit(5).collect())
    whole = mixture_langid.infer(model, [text])
    monkeypatch.setattr(mixture_langid, "SLICE", 500)
    assert np.allclose(whole, mixture_langid.infer(model, [text]), atol=1e-4)


def test_rare_languages_stay_in_the_sample():
    assert mixture_langid.shares_of({"a": 10, "b": 10**12, "c": 10**12}, 1000) == {"a": 1.0, "b": 495 / 10**12, "c": 495 / 10**12}
    assert mixture_langid.shares_of({"a": 3, "b": 4}, 100) == {"a": 1.0, "b": 1.0}


# ---- mixing

def test_rates_solve_the_dual(spark, sf):
    docs = [(r.source, len(words(r.text))) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    cells = spark.createDataFrame([(s, n, c) for (s, n), c in Counter(docs).items()], "source string, size long, n long")
    sums = {}
    for s, n in docs:
        total, rows = sums.get(s, (0, 0))
        sums[s] = total + n, rows + 1
    targets = brute_targets({s: t for s, (t, _) in sums.items()})
    got = entropy_mix.solve_multipliers(cells, sums, targets, 2.0)
    for s, (total, rows) in sums.items():
        if not 0 < targets[s] < 2 * total:
            continue
        mean, low, high = total / rows, -200.0, 200.0
        tokens = lambda x: sum(2 * n / (1 + math.exp(-x * n / mean)) for t, n in docs if t == s)  # noqa: B023, E731
        for _ in range(200):
            low, high = ((low + high) / 2, high) if tokens((low + high) / 2) < targets[s] else (low, (low + high) / 2)
        assert abs(got[s] - low) < 1e-5 * max(1, abs(low))


# ---- tokens and shards

def test_count_query_equals_the_library(spark, tmp_path):
    import public_tokenizers
    import sentencepiece

    texts = [*tricky(), None, "word " * 4096, "word " * 4097]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    counts = [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model")).encode([t or "" for t in texts])]
    want = [(i, len((t or "").encode()), n, n > 4096) for i, (t, n) in enumerate(zip(texts, counts, strict=True))]
    assert sorted(tuple(r) for r in Q["op8_token_counts"](spark, str(tmp_path)).collect()) == want
    assert {w[3] for w in want} == {True, False}


def test_shards_equal_plain_rendezvous_hashing(spark):
    keys = [*range(-50, 500), None, 1 << 62]
    weights = [1.0, 2.5, 0.0, 1.0, 0.5]

    def shard(key):
        best = None
        for s, w in enumerate(weights):
            h = 42 if key is None else xxhash.xxh64(key.to_bytes(8, "little", signed=True), seed=42).intdigest()
            h = xxhash.xxh64(s.to_bytes(4, "little"), seed=h).intdigest()
            if w:
                best = max(best or (-math.inf, 0), (math.log(((h >> 11) + 0.5) / (1 << 53)) / w, s))
        return best[1]

    df = rendezvous.assign_shards(spark.createDataFrame([(k,) for k in keys], "k long"), "k", weights)
    assert {r.k: r["shard"] for r in df.collect()} == {k: shard(k) for k in keys}


# ---- hot rows and long texts

@pytest.fixture(scope="module")
def hot(spark, tmp_path_factory):
    """A third of the rows without an id, a third with one id, a third one and the same row."""
    d = str(tmp_path_factory.mktemp("hot"))
    n = 60_000
    text = F.concat_ws(" ", *[F.concat(F.lit("w"), F.pmod(F.xxhash64("id", F.lit(i)), F.lit(5000))) for i in range(6)])
    rows = [spark.range(n).select(key.cast("long").alias("doc_id"), t.alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars"))
            for key, t in ((F.lit(None), text), (F.lit(7), text), (F.lit(8), F.lit(" ".join(f"q{i}" for i in range(40)))))]
    rows[0].unionByName(rows[1]).unionByName(rows[2]).write.parquet(f"{d}/documents.parquet")
    return d, n


def test_hot_ids_are_dealt_over_blocks(spark, hot):
    d, n = hot
    docs = spark.read.parquet(f"{d}/documents.parquet")
    blocks, wanted = common.corpus_blocks(docs, block_bytes=1 << 18)
    sizes = [r["n"] for r in blocks.groupBy("block").agg(F.sum(F.length("payload")).alias("n")).collect()]
    assert wanted > 10 and len(sizes) == wanted and max(sizes) < 2.5 * sum(sizes) / wanted
    ranges = winnowing.ranges_of(docs.where("text not like 'q%'").select("doc_id", "text").limit(n))
    assert ranges is not None


@pytest.mark.parametrize("name", ["op1_rlz_dedup", "op3_winnowing", "op4_signature_tree", "op4_signature_links", "op6_entropy_mix", "op10_rendezvous"])
def test_hot_rows(spark, hot, name):
    d, n = hot
    out = Q[name](spark, d)
    assert {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()} == {None: n, 7: n, 8: n}
    if name == "op1_rlz_dedup":
        assert out.where("doc_id = 8").agg(F.min("n_removed")).first()[0] == 40
    if name == "op10_rendezvous":
        assert out.groupBy("shard").agg((F.max("slot") - F.count(F.lit(1)) + 1).alias("gap"), (F.countDistinct("slot") - F.count(F.lit(1))).alias("twice")).where("gap <> 0 or twice <> 0").isEmpty()


def test_one_row_a_million_times(spark):
    df = spark.range(1_000_000).select(F.lit(3).cast("long").alias("k"), F.lit("x").alias("o"))
    out = common.ranked(df, ["k"], ["o"], "rank").agg(F.count(F.lit(1)), F.min("rank"), F.max("rank"), F.countDistinct("rank")).first()
    assert tuple(out) == (1_000_000, 0, 999_999, 1_000_000)


_LONG = """
import json, random, resource, sys
sys.path.insert(0, sys.argv[1])
import numpy as np, pyarrow as pa
from tallyspark.llm import bpe_codec, common, flac_media, library_bpe, mixture_langid, phrase_automata, rlz_dedup, signature_tree, token_counts, winnowing
import public_tokenizers
rnd = random.Random(1)
vocabulary = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randrange(2, 9))) for _ in range(50000)]
text = " ".join(rnd.choice(vocabulary) for _ in range(5_500_000))
table, column = pa.table({"doc_id": [1], "text": [text], "times": [1]}), pa.array([text])
name = sys.argv[2]
if name == "op1":
    words = rlz_dedup.Words.of(table, 35, 12)
    out = len(words.hashes), len(rlz_dedup.without_spans(text.encode(), [{"start": 3, "end": 5_000_000}]).split())
elif name == "op2":
    out = len(flac_media.encode([flac_media.padded(text.encode())])[0]) > 0
elif name == "op3":
    out = len(winnowing.fingerprints([text])[1][0]) > 10
elif name == "op4":
    out = len(signature_tree.shingle_sets(table)[0])
elif name == "op5":
    model = mixture_langid.LanguageModel(["a", "b", "c"], np.log(np.random.default_rng(1).random((mixture_langid.BUCKETS, 3)).astype(np.float32)))
    out = mixture_langid.infer(model, [text]).shape
elif name == "op7":
    codec = bpe_codec.codec(public_tokenizers.path("byte_bpe_50k.json"))
    out = sum(len(codec.decode_flat(ids, n)[0]) for ids, n, _ in codec.encoded_parts(column)) - len(text)
elif name == "op12":
    codec = library_bpe.library_codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    out = sum(len(codec.decode_flat(ids, n)[0]) for ids, n, _ in codec.encoded_parts(column)) - len(text)
elif name == "op13":
    rows = pa.RecordBatch.from_arrays([column, pa.array(["en"])], ["text", "lang"])
    out = sum(int(t.weight[0].sum()) for t in phrase_automata.shard_tries(iter([rows]), 3))
else:
    counter = token_counts.piece_counter(public_tokenizers.path("piece_bpe_32k.model"))
    out = sum(len(token_counts.pieces(raw, at, on)[0]) for raw, at, _, on in token_counts._parts(column))
print(json.dumps([out, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024]))
"""


@pytest.mark.parametrize("name", ["op1", "op2", "op3", "op4", "op5", "op7", "op8", "op12", "op13"])
def test_a_text_of_33_megabytes_takes_little_memory(name):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    out, peak = json.loads(subprocess.run([sys.executable, "-c", _LONG, root, name], capture_output=True, text=True, check=True).stdout)
    assert peak < 600 and out in (True, [1, 3], 0, 5_500_000, 5_499_996, [5_500_000, 500_003])


# ---- columns of any name

def test_mixed_and_formatted_tables_with_clashing_names(spark, folder):  # noqa: F811
    from tallyspark.llm import chat_format

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for c in ("_h", "_g", "_copies", "_i", "_j", "_a", "_b", "_c", "size", "target", "_repeat", "rank"):
        docs = docs.withColumn(c, F.lit("own"))
    out = entropy_mix.mix_documents(docs)
    assert out.columns == docs.columns and out.where("_h <> 'own' or _a <> 'own' or size <> 'own'").isEmpty() and out.count() > 0
    chats = spark.read.parquet(f"{folder}/conversations.parquet")
    plain = sorted(map(repr, chat_format.format_chats(chats).collect()))
    for c in ("turns", "formatted", "rows", "parsed", "_plain", "escaped"):
        chats = chats.withColumn(c, F.lit("own"))
    assert sorted(map(repr, chat_format.format_chats(chats).collect())) == plain


def test_no_conversations_but_the_planted_one(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    (row,) = Q["op9_chat_format"](spark, str(tmp_path)).collect()
    assert (row.conv_id, row.n_turns, row.loss_chars) == (-7, 2, len("</s>[INST] ok [/INST]"))


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="checkpoint"):
        common.working_dir(Session())


def test_last_stage_gives_checked_ids(spark, folder):  # noqa: F811
    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    want = Counter(repr((r.doc_id, library.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect())
    out = corpus_pipeline.tokens(spark, docs, folder).collect()
    assert Counter(repr((r.doc_id, r.ids)) for r in out) == want and all(r.exact and r.n_tokens == len(r.ids) for r in out)


def test_run_leaves_one_intermediate_table(spark, folder, tmp_path, monkeypatch):  # noqa: F811
    import corpus_pipeline

    made = iter(range(1000))
    monkeypatch.setattr(common, "working_dir", lambda spark: f"file://{tmp_path}/t{next(made)}")
    assert corpus_pipeline.run(spark, folder).count() > 0
    assert next(made) > 10 and len(os.listdir(tmp_path)) == 1
