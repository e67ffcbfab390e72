"""Byte-level BPE through the tokenizers library, for vocabularies given as ranks of byte strings.

The vocabulary is turned into a model of the library: every byte becomes a character of the byte alphabet, and the pair that a
token is merged from is what plain merging below its own rank leaves of its bytes (a token of which that leaves more than two
parts is never merged, only looked up).  A pre-token that is a token itself is taken as it is, which is the model's
``ignore_merges``.

Arrow batches: texts are cut into pre-tokens, all at once, and each becomes a number by a table of 64-bit hashes; the
library gets the new ones of a batch together, as characters, and their ids are kept by number.  A batch's ids are gathered from
the numbers' lists.  Every batch is decoded and compared with its bytes; a text that doesn't come back (a false match of
hashes) is encoded anew without the table.

Decoding reverses the byte table: the bytes of all tokens lie one behind the other, and a batch of ids is one gather.
A character that is split over tokens comes together, as bytes are joined before they are read as UTF-8; where the ids of a
text begin or end inside a character, its bytes become U+FFFD.

Offsets: a token's first and end byte follow from the lengths, and its characters from the count of bytes that begin one; a
token with a part of a character has that whole character, as in the library.

Defined results: null and empty texts have no tokens; there are no special tokens, their strings are ordinary text; a text
of any length is encoded whole, in parts that end between pre-tokens (one pre-token is never parted).  Repeated rows each
count; an empty table gives an empty table.  Extra columns are kept; one with the name of an output column gives way to
it.  The vocabulary's path is a parameter, read by each worker, and the table holds a fixed number of pre-tokens.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallyspark.llm import bpe_codec
from tallyspark.llm.bpe_codec import CACHE, PreTokenTable, byte_alphabet
from tallyspark.llm.common import WORKER_CACHES, without


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a file with one token (Base64) and its rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def pair_of(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two parts that merging below the token's own rank leaves of its bytes; None if it leaves more."""
    parts, until = [token[i : i + 1] for i in range(len(token))], ranks[token]
    while len(parts) > 2:
        rank, i = min((ranks.get(parts[i] + parts[i + 1], until), i) for i in range(len(parts) - 1))
        if rank >= until:
            return None
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts[0], parts[1]


class LibraryCodec(PreTokenTable):
    """Encoder and decoder for one file of ranks; the merges are the tokenizers library's."""

    def __init__(self, path: str, cache: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task a core
        from tokenizers import Tokenizer, models

        ranks = read_ranks(path)
        character = {b: c for c, b in byte_alphabet().items()}
        self.characters = str.maketrans({chr(b): c for b, c in character.items()})
        merges = [pair for token, _ in sorted(ranks.items(), key=lambda x: x[1]) if len(token) > 1 and (pair := pair_of(token, ranks))]
        self.library = Tokenizer(models.BPE(vocab={self.written(t): i for t, i in ranks.items()}, merges=[(self.written(a), self.written(b)) for a, b in merges], ignore_merges=True))
        # decoding goes by what the library calls its tokens, character by character
        byte_of = byte_alphabet()
        piece = [b""] * (max(ranks.values()) + 1)
        for name, i in self.library.get_vocab().items():
            piece[i] = bytes(byte_of[c] for c in name)
        super().__init__(piece, {}, cache)

    def written(self, token: bytes) -> str:
        """Bytes as characters of the byte alphabet."""
        return token.decode("latin-1").translate(self.characters)

    def merged(self, pre_tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        lists = [e.ids for e in self.library.encode_batch_fast([self.written(t) for t in pre_tokens], add_special_tokens=False)]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter((i for ids in lists for i in ids), np.int32, int(sizes.sum())), sizes

    def spans(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and end character of every token within its list, and how many characters begin in each list."""
        raw, at = self.decode_flat(ids, counts)
        begun = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        ends = np.cumsum(self.offsets[ids + 1] - self.offsets[ids])
        base = np.repeat(begun[at[:-1]], counts)
        first = begun[ends - (self.offsets[ids + 1] - self.offsets[ids]) + 1] - 1
        return first - base, begun[ends] - base, np.diff(begun[at])


@lru_cache(maxsize=2)
def library_codec(path: str) -> LibraryCodec:
    return LibraryCodec(path)


WORKER_CACHES.append(library_codec.cache_clear)


def encode_documents(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all others by default) with the ids (array<int>) of each text."""
    return bpe_codec.encode_documents(docs, path, text, ids, keep, library_codec)


def encode_with_offsets(docs: DataFrame, path: str, text: str = "text", tokens: str = "tokens", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all others by default) with each text's tokens: id, and its characters' first and end in the text."""
    keep = without([c for c in docs.columns if c != text] if keep is None else keep, [tokens])
    schema = f"{tokens} array<struct<id: int, start: int, end: int>>"
    fields = docs.select(*keep).schema
    for f in docs.sparkSession.createDataFrame([], schema).schema:
        fields = fields.add(f)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = library_codec(path)
        for b in batches:
            done, counts, columns = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64), []
            for part, sizes, doc in c.encoded_parts(b.column(text)):
                first, end, characters = c.spans(part, sizes)
                base = np.repeat(done[doc], sizes)
                columns.append((part, first + base, end + base))
                done[doc] += characters
                counts[doc] += sizes
            flat = [np.concatenate([x[k] for x in columns]) if columns else np.zeros(0, np.int64) for k in range(3)]
            values = pa.StructArray.from_arrays([pa.array(x, pa.int32()) for x in flat], ["id", "start", "end"])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), values)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), lists], [*keep, tokens])

    return docs.select(*keep, text).mapInArrow(run, fields)


def decode_documents(encoded: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """All columns but ``ids`` with the text that they decode to (bytes that are no UTF-8 become U+FFFD); null: empty."""
    return bpe_codec.decode_documents(encoded, path, ids, text, library_codec)


def round_trip(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None, ids: str | None = None) -> DataFrame:
    """``keep`` columns (all others by default) with n_tokens, ids_sha256 (decimal ids joined by commas) and decoded_sha256
    (decoded bytes) of each text; with ``ids``, also the ids (array<int>) under that name."""
    return bpe_codec.round_trip(docs, path, text, keep, ids, library_codec)
