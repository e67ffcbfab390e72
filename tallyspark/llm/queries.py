"""Registered queries of the training-data operators (thin digests of what the operators return) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import anchor_codes, bpe_codec, chat_format, entropy_mix, flac_media, library_bpe, mixture_langid, phrase_automata, rendezvous, rlz_dedup, signature_tree, token_counts, winnowing

SHARDS = 8


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_rlz_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = rlz_dedup.dedup_substrings(_table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op2_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = flac_media.to_media(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return flac_media.read_media(stored)


def op3_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.compare_with_edits(_table(spark, sf_dir, "documents"))


def op4_signature_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signature_tree.near_copies(_table(spark, sf_dir, "documents"))


def op4_signature_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signature_tree.near_copy_links(_table(spark, sf_dir, "documents"))


def op5_mixture_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = mixture_langid.fit(docs.where(~mixture_langid.held_out(F.col("doc_id"))))
    return mixture_langid.identify(docs.select("doc_id", "text"), model, keep=["doc_id"]).select(
        "doc_id", mixture_langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "languages", "proportions")


def op6_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    sized = docs.select("doc_id", "source", entropy_mix.n_words(F.col("text")).alias("size"))
    mixed = entropy_mix.mix(sized, ["doc_id"])
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_codec.round_trip(_table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counted = token_counts.count_tokens(_table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 4096)


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    chats = chat_format.format_chats(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own))
    loss = chat_format.loss_text(F.col("formatted"), F.col("loss_spans"))
    lines = F.concat_ws("", F.transform("parsed", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return chats.select(
        "conv_id", F.size("parsed").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def op10_rendezvous(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = _table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "utf-8")).alias("text_crc32"))
    placed = rendezvous.assign_shards(rows, "doc_id", [1.0] * SHARDS)
    slots = rendezvous.shard_slots(placed, ["doc_id", "size", "text_crc32"])
    grown = rendezvous.assign_shards(slots, "doc_id", [1.0] * (SHARDS + 1), "grown_shard")
    return grown.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op11_anchor_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    coded, books = anchor_codes.quantize(rows, keep=["vec_id", "label"])
    return anchor_codes.with_label_error(coded).select(
        "vec_id", anchor_codes.hex_code("codes").alias("code"), "error", "label_error", F.lit(anchor_codes.codebook_digest(books)).alias("codebooks_sha256"))


def op12_library_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return library_bpe.round_trip(_table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op13_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_automata.mine_phrases(_table(spark, sf_dir, "documents").select("text", "lang"))


def queries() -> dict:
    return {
        "op1_rlz_dedup": op1_rlz_dedup,
        "op2_flac_media": op2_flac_media,
        "op3_winnowing": op3_winnowing,
        "op4_signature_tree": op4_signature_tree,
        "op4_signature_links": op4_signature_links,
        "op5_mixture_langid": op5_mixture_langid,
        "op6_entropy_mix": op6_entropy_mix,
        "op7_bpe_codec": op7_bpe_codec,
        "op8_token_counts": op8_token_counts,
        "op9_chat_format": op9_chat_format,
        "op10_rendezvous": op10_rendezvous,
        "op11_anchor_codes": op11_anchor_codes,
        "op12_library_bpe": op12_library_bpe,
        "op13_phrase_automata": op13_phrase_automata,
    }


#: The operators whose whole result SQL can express; the others are tested against brute force, round trips or held-out accuracy.
_OP1 = r"""
WITH w AS (SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '[^ \t\n\v\f\r]+') AS ws FROM documents),
g AS (SELECT doc_id, text, i, array_to_string(ws[i:i + 34], ' ') AS win FROM (SELECT doc_id, text, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)),
d AS (SELECT doc_id, text, i FROM (SELECT *, count(*) OVER (PARTITION BY win) AS n FROM g) WHERE n > 1),
gone AS (SELECT doc_id, text, list_sort(list_distinct(flatten(list(range(i, i + 35))))) AS bad FROM d GROUP BY ALL)
SELECT w.doc_id, cast(len(ws) AS BIGINT) AS n_words, cast(coalesce(len(bad), 0) AS BIGINT) AS n_removed,
  sha256(CASE WHEN bad IS NULL THEN array_to_string(ws, ' ') ELSE coalesce(array_to_string(list_transform(list_filter(range(1, len(ws) + 1), lambda i: NOT list_contains(bad, i)), lambda i: ws[i]), ' '), '') END) AS kept_sha256
FROM w LEFT JOIN gone ON gone.doc_id IS NOT DISTINCT FROM w.doc_id AND gone.text = w.text"""
_OP4 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t\n\v\f\r]+') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 4], ' ') END AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n u ON u.doc_id = x JOIN n v ON v.doc_id = y WHERE 100 * c >= 80 * (u.n + v.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, e.y FROM r JOIN e ON e.x = r.b)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce((SELECT min(b) FROM r WHERE r.a = w.doc_id), w.doc_id) AS component_id FROM w LEFT JOIN n ON n.doc_id = w.doc_id"""
_OP9 = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
f AS (SELECT *, regexp_matches(text, '[<\[]\\+(/?s>|/?INST\])') OR contains(text, '<s>') OR contains(text, '[INST] ') OR CASE WHEN role = 'assistant' THEN contains(text, '</s>')
    ELSE contains(text, ' [/INST]') OR contains(role, chr(10)) OR contains(role, '<s>') OR contains(role, '[INST] ') OR contains(role, ' [/INST]') OR regexp_matches(role, '%3C|%5B|%0A|%25') END AS clash FROM t),
c AS (SELECT *, bool_or(clash) OVER (PARTITION BY conv_id) AS escaped FROM f)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  cast(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  cast(sum(CASE WHEN role = 'assistant' THEN 7 ELSE 16 + CASE WHEN escaped THEN length(replace(replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '[', '%5B'), '<', '%3C')) ELSE length(role) END END
    + CASE WHEN escaped THEN length(regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g')) ELSE length(text) END) AS BIGINT) AS formatted_chars FROM c GROUP BY conv_id"""



def _op11_round(k: int) -> str:
    """Assignment of all parts to codebook k - 1 and the codebook k that it gives."""
    return f"""
a{k} AS (SELECT rid, part, x, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (SELECT rid, p.part, x, entry, list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - e[i]) * (x[i] - e[i]))) AS d FROM p JOIN b{k - 1} b ON b.part = p.part) GROUP BY ALL),
s{k} AS (SELECT part, entry, list(m ORDER BY i) AS e FROM (SELECT part, entry, i, cast(floor(sum(c) / count(*)) AS BIGINT) AS m FROM (SELECT part, entry, unnest(range(len(x))) AS i, unnest(x) AS c FROM a{k}) GROUP BY ALL) GROUP BY ALL),
b{k} AS (SELECT b.part, b.entry, coalesce(s.e, b.e) AS e FROM b{k - 1} b LEFT JOIN s{k} s ON s.part = b.part AND s.entry = b.entry)"""


_OP11 = f"""
WITH k AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS rid, vec_id, label, list_transform(embedding, lambda x: cast(floor(256 * cast(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
p AS (SELECT rid, part, v[part * (len(v) // 16) + 1:(part + 1) * (len(v) // 16)] AS x FROM k, range(16) t(part)),
b0 AS (SELECT part, rid - 1 AS entry, x AS e FROM p WHERE rid <= 64),{_op11_round(1)},{_op11_round(2)},{_op11_round(3)},
r AS (SELECT rid, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, cast(sum(d) AS BIGINT) AS error FROM a3 GROUP BY 1),
h AS (SELECT sha256(string_agg(cast(c AS VARCHAR), ',' ORDER BY part, entry, i)) AS books FROM (SELECT part, entry, unnest(range(len(e))) AS i, unnest(e) AS c FROM b2))
SELECT vec_id, code, error, cast(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, books AS codebooks_sha256 FROM k JOIN r USING (rid), h"""

_OP13 = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\v\f\r]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS ws FROM p),
g AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS g, count(*) AS f FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, range(1, 4) t(k)) GROUP BY ALL),
n AS (SELECT lang, cast(sum(f) AS BIGINT) AS n FROM g WHERE k = 1 GROUP BY 1),
c AS (SELECT *, string_split(g, ' ') AS x FROM g WHERE k > 1 AND f >= 10),
s AS (SELECT c.lang, c.g, c.f AS a, a.f AS l, b.f AS r, cut, (1000000::HUGEINT * c.f * c.f) // (a.f::HUGEINT * b.f) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM c) c JOIN g a ON a.lang = c.lang AND a.g = array_to_string(x[1:cut], ' ') JOIN g b ON b.lang = c.lang AND b.g = array_to_string(x[cut + 1:c.k], ' ')),
o AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1),
i AS (SELECT lang, part, max(f) AS f FROM (SELECT lang, f, unnest([array_to_string(x[1:k - 1], ' '), array_to_string(x[2:k], ' ')]) AS part FROM c WHERE k > 2) GROUP BY ALL)
SELECT o.lang, row_number() OVER (PARTITION BY o.lang ORDER BY score DESC, a DESC, g) AS rank, g AS phrase, a, l, r, n, cast(score AS BIGINT) AS score
FROM o JOIN n ON n.lang = o.lang LEFT JOIN i ON i.lang = o.lang AND i.part = o.g WHERE coalesce(100 * i.f < 50 * a, true) QUALIFY row_number() OVER (PARTITION BY o.lang ORDER BY score DESC, a DESC, g) <= 2000"""


def oracle_sql() -> dict[str, str]:
    return {"op1_rlz_dedup": _OP1, "op4_signature_tree": _OP4, "op9_chat_format": _OP9, "op11_anchor_codes": _OP11, "op13_phrase_automata": _OP13}
