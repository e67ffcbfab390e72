"""Byte-level BPE: a backtracking encoder with exact merges, and decoding through an offset table.

Longest-match: an Aho-Corasick automaton over the vocabulary gives the longest token at each position, for all new
pre-tokens of a batch in one pass.  Two tokens may stand side by side only if their merge histories never join across the
border; the pair table remembers that answer for each pair met.  A segmentation whose pairs are all compatible is the one
that BPE's merges give: the encoder walks the pre-token from the left with the longest token, takes the next shorter one
where the pair is refused, steps back where none is left, and never visits a position twice that failed, so work is linear
in its length.  Short pre-tokens of a batch take their steps side by side.

Batches: texts are cut into pre-tokens by their characters' classes, all at once, and each pre-token becomes a number by
a table of 64-bit hashes; only new ones are encoded.  Ids are gathered from the numbers' lists.  A false match of hashes
can't pass: every batch is decoded, and a text that doesn't come back is encoded anew without the table.

Decoding: the bytes of all tokens lie in one array; token i is bytes[offset[i]:offset[i + 1]], so that a batch of ids is
decoded by one gather.  The decimal ids that the digests read are gathered likewise.

Defined results: null and empty texts have no tokens; special strings of the vocabulary file inside a text become their
token, as the tokenizers library does by default; a text of any length is encoded whole, in parts that end between
pre-tokens.  Repeated rows each count; an empty table gives an empty table.  Extra columns are kept; one with the name of
an output column gives way to it.  The vocabulary's path is a parameter, read by each worker, and the caches hold a fixed
number of pre-tokens.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm.common import _BYTE, STEP, WORKER_CACHES, HashTable, mix, runs_gathered, slices, sums_of_runs, utf8, without

#: Pre-tokens and pairs of tokens that a worker remembers, and bytes of those that take their steps side by side.
CACHE, PAIRS, SHORT = 250_000, 250_000, 48


def byte_alphabet() -> dict[str, int]:
    """Characters that stand for bytes in byte-level vocabularies: printable ones themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def _pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64))


def _hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix(sums_of_runs(_BYTE[raw], starts, ends) + (ends - starts).astype(np.uint64))


class PreTokenTable:
    """Texts as ids through a table of pre-tokens: what encoders of one vocabulary share.  A subclass says how new pre-tokens are
    encoded (``merged``)."""

    def __init__(self, piece: list[bytes], specials: dict[str, int], cache: int):
        """``piece``: the bytes of every token; ``specials``: strings inside texts that are a token of their own."""
        import regex

        self.piece, self.specials, self.size = piece, specials, len(piece)
        self.offsets = np.concatenate([[0], np.cumsum([len(p) for p in piece])]).astype(np.int64)
        self.bytes = np.frombuffer(b"".join(piece), np.uint8)
        names = [b"%d," % i for i in range(self.size)]
        self.name_offsets = np.concatenate([[0], np.cumsum([len(n) for n in names])]).astype(np.int64)
        self.names = np.frombuffer(b"".join(names), np.uint8)
        self.special_split = regex.compile("|".join(map(regex.escape, sorted(specials, key=len, reverse=True)))) if specials else None
        self.special_ids = {content.encode(): i for content, i in specials.items()}
        self.cache_size = cache
        self.forget()

    def merged(self, pre_tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Exact encodings of pre-tokens: ids, one list behind the other, and the lists' lengths."""
        raise NotImplementedError

    def forget(self, room: int = 0) -> None:
        """Empties the cache of pre-tokens: a table from hash to number, and by number the place and length of its ids."""
        self.table = HashTable(max(self.cache_size, room) + len(self.specials))
        self.first, self.count = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.pool, self.known, self.pooled = np.zeros(1 << 14, np.int32), 0, 0
        if self.specials:
            raw = np.frombuffer(b"".join(self.special_ids), np.uint8)
            ends = np.cumsum([len(x) for x in self.special_ids])
            n = len(ends)
            self._remember(_hashes(raw, np.r_[0, ends[:-1]], ends), np.array(list(self.special_ids.values()), np.int32), np.ones(n, np.int64))

    def _remember(self, hashes: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        n, p = self.known + len(sizes), self.pooled + len(ids)
        while n > len(self.first):
            self.first, self.count = np.concatenate([self.first, self.first]), np.concatenate([self.count, self.count])
        while p > len(self.pool):
            self.pool = np.concatenate([self.pool, self.pool])
        self.first[self.known : n], self.count[self.known : n] = self.pooled + np.cumsum(sizes) - sizes, sizes
        self.pool[self.pooled : p] = ids
        self.table.add(hashes, np.arange(self.known, n, dtype=np.int32))
        self.known, self.pooled = n, p

    def learn(self, hashes: np.ndarray, pre_tokens: list[bytes]) -> None:
        """New pre-tokens (distinct hashes) into the cache."""
        for i in range(0, len(pre_tokens), 1 << 14):
            self._remember(hashes[i : i + (1 << 14)], *self.merged(pre_tokens[i : i + (1 << 14)]))

    def plainly(self, raw: bytes) -> np.ndarray:
        """Ids of a text without cache and hashes."""
        bounds, _ = self.segments(np.frombuffer(raw, np.uint8), np.array([0, len(raw)], np.int64))
        out = [np.zeros(0, np.int32)]
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            own = raw[a:b]
            if own in self.special_ids:
                out.append(np.array([self.special_ids[own]], np.int32))
                continue
            starts = pre_token_starts(np.frombuffer(own, np.uint8), np.array([0, len(own)], np.int64)).tolist()
            out.append(self.merged([own[i:j] for i, j in zip(starts, [*starts[1:], len(own)])])[0])
        return np.concatenate(out)

    def segments(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Offsets of stretches that are cut into pre-tokens each by itself, and the text of each: texts, parted where a
        special string begins or ends."""
        doc = np.arange(len(offsets) - 1)
        if self.special_split is None:
            return offsets, doc
        view, cuts = raw.tobytes(), []
        if any(s in view for s in self.special_ids):
            for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                own = view[a:b]
                if any(s in own for s in self.special_ids):
                    text, done, at = own.decode("utf-8"), 0, a
                    for m in self.special_split.finditer(text):
                        at += len(text[done : m.start()].encode())
                        cuts.append((at, i))
                        at += len(m.group().encode())
                        cuts.append((at, i))
                        done = m.end()
        if not cuts:
            return offsets, doc
        begin = np.concatenate([offsets[:-1], np.array([c for c, _ in cuts], np.int64)])
        of = np.concatenate([doc, np.array([i for _, i in cuts], np.int64)])
        order = np.lexsort((begin, of))
        return np.append(begin[order], offsets[-1]), of[order]

    def encode_part(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of concatenated texts (UTF-8), one behind the other, and how many each text has."""
        bounds, of = self.segments(raw, offsets)
        starts = pre_token_starts(raw, bounds)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(offsets) - 1, np.int64)
        if len(of) != len(offsets) - 1:  # a special string stays whole
            view = raw.tobytes()
            whole = [k for k in range(len(of)) if view[bounds[k] : bounds[k + 1]] in self.special_ids]
            lows, highs = bounds[whole], bounds[np.array(whole, np.int64) + 1]
            at = np.searchsorted(lows, starts, side="right") - 1
            starts = starts[(at < 0) | (starts == lows[at]) | (starts >= highs[at])] if len(lows) else starts
        ends = np.append(starts[1:], len(raw))
        hashes = _hashes(raw, starts, ends)
        number = self.table.find(hashes)
        miss = np.flatnonzero(number < 0)
        if len(miss):
            new, first = np.unique(hashes[miss], return_index=True)
            if self.known + len(new) > self.cache_size:
                self.forget(len(np.unique(hashes)))  # room for all of this part
                number = self.table.find(hashes)
                miss = np.flatnonzero(number < 0)
                new, first = np.unique(hashes[miss], return_index=True)
            view = raw.tobytes()
            at = miss[first]
            self.learn(new, [view[i:j] for i, j in zip(starts[at].tolist(), ends[at].tolist())])
            number[miss] = self.table.find(hashes[miss])
        size = self.count[number]
        ids = runs_gathered(self.pool, self.first[number], size)
        total = np.concatenate([[0], np.cumsum(size)])
        counts = np.diff(total[np.searchsorted(starts, offsets)])
        back, at = self.decode_flat(ids, counts)
        if len(back) == len(raw) and np.array_equal(back, raw):
            return ids, counts
        view, lists = raw.tobytes(), []
        for i in range(len(counts)):
            a, b = offsets[i], offsets[i + 1]
            lists.append(self.plainly(view[a:b]) if back[at[i] : at[i + 1]].tobytes() != view[a:b] else ids[total[np.searchsorted(starts, a)] : total[np.searchsorted(starts, b)]])
        return np.concatenate(lists), np.array([len(x) for x in lists], np.int64)

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        out: list[list[int]] = [[] for _ in texts]
        for ids, counts, doc in self.encoded_parts(pa.array(texts, pa.large_string())):
            for i, part in zip(doc.tolist(), np.split(ids, np.cumsum(counts)[:-1]), strict=True):
                out[i] += part.tolist()
        return out

    def encoded_parts(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Ids, their number in each part of a text, and each part's text, for parts of about ``STEP`` bytes."""
        raw, offsets = utf8(column)
        for i, j in slices(offsets, STEP):
            a, b = int(offsets[i]), int(offsets[j])
            if b - a <= 2 * STEP:
                yield *self.encode_part(raw[a:b], offsets[i : j + 1] - a), np.arange(i, j)
                continue
            at = a
            while at < b:
                end = min(at + STEP, b)
                while end < b and not (cut := self.cut(raw[at:end])):
                    end = min(end + end - at, b)
                end = at + cut if end < b else b
                yield *self.encode_part(raw[at:end], np.array([0, end - at], np.int64)), np.array([i])
                at = end

    def cut(self, raw: np.ndarray) -> int:
        """The last place at which the beginning of a text can be cut between pre-tokens, whatever follows; 0: none."""
        n = len(raw)
        while n and (raw[n - 1] & 0xC0) == 0x80:
            n -= 1
        n = max(0, n - 1)  # a character that may be incomplete
        starts = pre_token_starts(raw[:n], np.array([0, n], np.int64)) if n else np.zeros(0, np.int64)
        kinds = _kinds()
        view = raw[: min(n, len(raw))].tobytes()
        far = max((len(s) for s in self.special_ids), default=0)
        for at in starts[::-1].tolist():
            # behind a character that is no space, and not within reach of the end, of an apostrophe or of a special string
            before = view[max(0, at - 4) : at].decode("utf-8", "ignore")
            if 0 < at <= n - 16 and before and kinds[ord(before[-1])] != _SPACE and not any(view.find(s, max(0, at - len(s) + 1), at + len(s) - 1) >= 0 for s in self.special_ids) and at <= n - far:
                return at
        return 0

    def decode_flat(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of concatenated id lists, and the offsets of each list's bytes: one gather through the offset table."""
        return self._gathered(self.bytes, self.offsets, ids, counts)

    def decimals(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Decimal ids with a comma behind each, and the offsets of each list's bytes."""
        return self._gathered(self.names, self.name_offsets, ids, counts)

    @staticmethod
    def _gathered(source: np.ndarray, places: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first, size = places[ids], places[ids + 1] - places[ids]
        at = np.concatenate([[0], np.cumsum(size)])
        return runs_gathered(source, first, size), at[np.concatenate([[0], np.cumsum(counts)])]


class BpeCodec(PreTokenTable):
    """Encoder and decoder for one vocabulary file (tokenizers' JSON, model BPE, byte level)."""

    def __init__(self, path: str, cache: int = CACHE):
        import ahocorasick

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if any(t.get(k) for t in spec["added_tokens"] for k in ("lstrip", "rstrip", "single_word")):
            raise ValueError(f"special strings of {path} take up their surroundings")
        vocab, specials = spec["model"]["vocab"], {t["content"]: t["id"] for t in spec["added_tokens"]}
        alphabet = byte_alphabet()
        piece = [b""] * (max([*vocab.values(), *specials.values()]) + 1)
        for content, i in vocab.items():
            if content not in specials:
                piece[i] = bytes(alphabet[c] for c in content)
        self.id_of = {p: i for i, p in enumerate(piece) if p}
        for content, i in specials.items():
            piece[i] = content.encode()
        super().__init__(piece, specials, cache)
        self.merge_rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, m in enumerate(spec["model"]["merges"]):
            left, right = (vocab[x] for x in (m.split(" ") if isinstance(m, str) else m))
            whole = self.id_of[self.piece[left] + self.piece[right]]
            self.merge_rank[left, right] = rank
            self.parts.setdefault(whole, (left, right, rank))
        self.automaton = ahocorasick.Automaton()
        for p, i in self.id_of.items():
            self.automaton.add_word(p.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.longest_piece = max(map(len, self.id_of))
        self.near: dict[int, bool] = {}
        self.pairs = HashTable(PAIRS)
        self.merges = HashTable(len(self.merge_rank))
        pairs = np.array(list(self.merge_rank), np.uint64).reshape(-1, 2)
        self.merges.add(_pair_key(pairs[:, 0], pairs[:, 1]), np.array(list(self.merge_rank.values()), np.int32))
        self.shorter = np.full(self.size, -1, np.int64)
        for p, i in self.id_of.items():
            self.shorter[i] = next((self.id_of[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in self.id_of), -1)
        self.length = np.array([len(p) for p in self.piece], np.int64)
        self.spines = []
        for side in (0, 1):
            own = [self.spine(t, side) for t in range(self.size)]
            size = np.array([len(x) for x in own], np.int64)
            self.spines.append((np.cumsum(size) - size, size, np.array([t for x in own for t, _ in x], np.uint64), np.array([u for x in own for _, u in x], np.int64)))

    def spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """The token's parts at one border (side 1: its right end, 0: its left end), each with the rank of the merge that
        takes it up (beyond all ranks for the whole token)."""
        out = [(token, 1 << 40)]
        while (made := self.parts.get(out[-1][0])) is not None:
            out.append((made[side], made[2]))
        return out

    def compatible(self, a: int, b: int) -> bool:
        """Whether tokens a and b stay apart: no part at a's right end and part at b's left end are merged before either
        is taken up by its own token.  At equal rank the merge further left comes first."""
        key = a << 32 | b
        known = self.near.get(key)
        if known is None:
            lefts, rights = self.spine(a, 1), self.spine(b, 0)
            known = not any((r := self.merge_rank.get((x, y))) is not None and r < x_until and r <= y_until for x, x_until in lefts for y, y_until in rights)
            if len(self.near) > 100_000:
                self.near.clear()
            self.near[key] = known
        return known

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``compatible`` of many pairs, through the pair table."""
        key = _pair_key(a, b)
        out = self.pairs.find(key)
        miss = np.flatnonzero(out < 0)
        if len(miss):
            new, first = np.unique(key[miss], return_index=True)
            x, y = a[miss[first]], b[miss[first]]
            (left_at, left_n, left, left_until), (right_at, right_n, right, right_until) = self.spines
            n = right_n[x] * left_n[y]
            begin = np.cumsum(n) - n
            of = np.repeat(np.arange(len(n)), n)
            k = np.arange(len(of)) - begin[of]
            i, j = right_at[x][of] + k // left_n[y][of], left_at[y][of] + k % left_n[y][of]
            rank = self.merges.find(_pair_key(right[i], left[j]))
            joined = (rank >= 0) & (rank < right_until[i]) & (rank <= left_until[j])
            value = (~np.logical_or.reduceat(joined, begin)).astype(np.int32)
            if self.pairs.entries + len(new) > PAIRS:
                self.pairs = HashTable(max(PAIRS, len(new)))
            self.pairs.add(new, value)
            out[miss] = value[np.searchsorted(new, key[miss])]
        return out > 0

    def longest(self, raw: str, at: int) -> int:
        """The longest token at a position (bytes as Latin-1)."""
        n = self.automaton.longest_prefix(raw[at : at + self.longest_piece])
        while n and (i := self.automaton.get(raw[at : at + n], None)) is None:
            n -= 1
        return i

    def backtrack(self, raw: str) -> tuple[int, ...]:
        """Exact encoding of one pre-token (bytes as Latin-1)."""
        end, out, at = len(raw), [], 0
        failed = bytearray(end + 1)
        token = self.longest(raw, 0)
        while True:
            stop = at + len(self.piece[token])
            if not failed[stop] and (not out or self.compatible(out[-1], token)):
                out.append(token)
                at = stop
                if at == end:
                    return tuple(out)
                token = self.longest(raw, at)
                continue
            token = int(self.shorter[token])
            while token < 0:
                failed[at] = 1
                token = out.pop()
                at -= len(self.piece[token])
                token = int(self.shorter[token])

    def side_by_side(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``backtrack`` of many short pre-tokens at once: a pool of ids, and where in it each one's are and how many."""
        size = np.array([len(t) for t in texts], np.int64)
        begin = np.cumsum(size + 1) - size - 1  # U+0100 parts them: it stands in no token
        found = np.fromiter(self.automaton.iter("Ā".join(t.decode("latin-1") for t in texts)), np.dtype([("last", np.int64), ("token", np.int64)]))
        longest = np.full(int((size + 1).sum()), -1, np.int64)
        longest[found["last"] - self.length[found["token"]] + 1] = found["token"]  # of those at a place, the last is the longest
        failed, pool = np.zeros(len(longest), bool), np.zeros(len(longest), np.int32)
        at, depth, live, token = begin.copy(), np.zeros(len(texts), np.int64), np.flatnonzero(size), longest[begin].copy()
        end = begin + size
        while len(live):
            t = token[live]
            back = t < 0  # no shorter token: the place failed, and the token before it gives way
            if back.any():
                who = live[back]
                failed[at[who]] = True
                depth[who] -= 1
                last = pool[begin[who] + depth[who]].astype(np.int64)
                at[who] -= self.length[last]
                token[who] = self.shorter[last]
                who, t = live[~back], t[~back]
            else:
                who = live
            stop = at[who] + self.length[t]
            good = ~failed[stop]
            check = np.flatnonzero(good & (depth[who] > 0))
            if len(check):
                good[check] = self.apart(pool[begin[who[check]] + depth[who[check]] - 1].astype(np.int64), t[check])
            token[who[~good]] = self.shorter[t[~good]]
            who, t, stop = who[good], t[good], stop[good]
            pool[begin[who] + depth[who]] = t
            depth[who] += 1
            at[who] = stop
            token[who] = longest[stop]
            live = live[at[live] < end[live]]
        return pool, begin, depth

    def merged(self, pre_tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Exact encodings of pre-tokens: ids, one list behind the other, and the lists' lengths."""
        long = [i for i, t in enumerate(pre_tokens) if len(t) > SHORT]
        pool, first, count = self.side_by_side([b"" if len(t) > SHORT else t for t in pre_tokens])
        if long:
            lists = [np.array(self.backtrack(pre_tokens[i].decode("latin-1")), np.int32) for i in long]
            count[long] = [len(x) for x in lists]
            first[long] = len(pool) + np.cumsum(count[long]) - count[long]
            pool = np.concatenate([pool, *lists])
        return runs_gathered(pool, first, count), count


_OTHER, _LETTER, _NUMBER, _SPACE = range(4)


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """The class of every code point in the pre-token pattern, by the tables of the tokenizers library (the regex module knows
    letters of later Unicode versions)."""
    from tokenizers import Regex, pre_tokenizers

    out = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
        split = pre_tokenizers.Split(Regex(pattern), "removed")
        for begin in range(0, 0x110000, 1 << 11):  # the library keeps many bytes a character
            if 0xD800 <= begin < 0xE000:
                continue
            own = out[begin : begin + (1 << 11)]
            inside = np.ones(len(own), bool)
            for _, (low, high) in split.pre_tokenize_str("".join(map(chr, range(begin, begin + len(own))))):
                inside[low:high] = False
            own[inside] = kind
    return out


def pre_token_starts(raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """First bytes of the pre-tokens of concatenated stretches of UTF-8 text, by rules for the pattern of byte-level BPE (contractions, letters, numbers,
    other characters, white space):

    a pre-token is a run of one class; a plain space goes to the run behind it; the last of several spaces before another
    class stands alone or goes with that; an apostrophe that opens a run takes the letters of a contraction."""
    if not len(raw):
        return np.zeros(0, np.int64)
    ascii_only = raw.max() < 128
    point = raw if ascii_only else np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    n = len(point)
    if ascii_only:
        byte_at, begin = None, bounds[:-1][bounds[:-1] < n]
    else:
        width = 1 + (point >= 0x80).astype(np.int64) + (point >= 0x800) + (point >= 0x10000)
        byte_at = np.cumsum(width) - width
        begin = np.searchsorted(byte_at, bounds[:-1][bounds[:-1] < len(raw)])
    kind = _kinds()[point]
    opens = np.zeros(n + 1, bool)  # of a stretch
    opens[begin], opens[n] = True, True
    run = opens[:n].copy()
    run[1:] |= kind[1:] != kind[:-1]
    start = run.copy()
    # of spaces, also the last before another class; a plain one there goes to what follows
    space = kind == _SPACE
    ahead = np.zeros(n, bool)
    ahead[:-1] = space[:-1] & ~space[1:] & ~opens[1:n]
    start |= ahead
    plain = ahead & (point == 0x20)
    start[1:] &= ~plain[:-1]
    # contractions
    quote = np.flatnonzero(start & (point == 0x27) & run)
    if len(quote):
        padded = np.concatenate([point, np.zeros(3, point.dtype)])
        shut = np.concatenate([opens, np.ones(3, bool)])
        one, two = padded[quote + 1], padded[quote + 2]
        inside = ~shut[quote + 1]
        short = inside & np.isin(one, [ord(c) for c in "stmd"])
        long = inside & ~shut[np.minimum(quote + 2, n)] & (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
        took = short | long
        at, size = quote[took], np.where(short, 2, 3)[took]
        start[at + 1] = False
        follow = at + size
        start[follow[follow < n]] = True
    found = np.flatnonzero(start)
    return found if byte_at is None else byte_at[found]


@lru_cache(maxsize=2)
def codec(path: str) -> BpeCodec:
    return BpeCodec(path)


WORKER_CACHES.append(codec.cache_clear)


Encoder = Callable[[str], PreTokenTable]


def encode_documents(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", keep: list[str] | None = None, encoder: Encoder = codec) -> DataFrame:
    """``keep`` columns (all others by default) with the ids (array<int>) of each text."""
    keep = without([c for c in docs.columns if c != text] if keep is None else keep, [ids])
    schema = docs.select(*keep).schema.add(ids, T.ArrayType(T.IntegerType(), False), False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = encoder(path)
        for b in batches:
            parts = list(c.encoded_parts(b.column(text)))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), _id_lists(parts, b.num_rows)], [*keep, ids])

    return docs.select(*keep, text).mapInArrow(run, schema)


def _id_lists(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], n: int) -> pa.Array:
    counts = np.zeros(n, np.int64)
    for _, own, doc in parts:
        np.add.at(counts, doc, own)
    flat = np.concatenate([p for p, _, _ in parts]) if parts else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(flat, pa.int32()))


def decode_documents(encoded: DataFrame, path: str, ids: str = "ids", text: str = "decoded", encoder: Encoder = codec) -> DataFrame:
    """All columns but ``ids`` with the text that they decode to (bytes that are no UTF-8 become U+FFFD); null: empty."""
    keep = without([c for c in encoded.columns if c != ids], [text])
    schema = encoded.select(*keep).schema.add(text, "string", False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = encoder(path)
        for b in batches:
            lists = b.column(ids).fill_null(pa.scalar([], b.column(ids).type))
            counts = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            raw, at = c.decode_flat(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), counts)
            raw = raw.tobytes()
            out = [raw[i:j].decode("utf-8", "replace") for i, j in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(out, pa.string())], [*keep, text])

    return encoded.select(*keep, ids).mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None, ids: str | None = None, encoder: Encoder = codec) -> DataFrame:
    """``keep`` columns (all others by default) with n_tokens, ids_sha256 (decimal ids joined by commas) and decoded_sha256 of
    each text, encoded and decoded in one pass; with ``ids``, also the ids (array<int>) under that name."""
    names = [*([ids] if ids else []), "n_tokens", "ids_sha256", "decoded_sha256"]
    keep = without([c for c in docs.columns if c != text] if keep is None else keep, names)
    schema = docs.select(*keep).schema
    for name, kind in zip(names, [*([T.ArrayType(T.IntegerType(), False)] if ids else []), T.LongType(), T.StringType(), T.StringType()], strict=True):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = encoder(path)
        for b in batches:
            n = np.zeros(b.num_rows, np.int64)
            digest = [(hashlib.sha256(), hashlib.sha256()) for _ in range(b.num_rows)]
            parts = []
            for part, counts, doc in c.encoded_parts(b.column(text)):
                decoded, at = c.decode_flat(part, counts)
                decimal, at_d = c.decimals(part, counts)
                decoded, decimal = memoryview(decoded.tobytes()), memoryview(decimal.tobytes())
                for k, i in enumerate(doc.tolist()):
                    by_id, by_text = digest[i]
                    by_text.update(decoded[at[k] : at[k + 1]])
                    if counts[k]:
                        by_id.update(b"," if n[i] else b"")
                        by_id.update(decimal[at_d[k] : at_d[k + 1] - 1])
                    n[i] += counts[k]
                if ids:
                    parts.append((part, counts, doc))
            out = [*([_id_lists(parts, b.num_rows)] if ids else []), pa.array(n), pa.array([x.hexdigest() for x, _ in digest], pa.string()), pa.array([x.hexdigest() for _, x in digest], pa.string())]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), *out], [f.name for f in schema])

    return docs.select(*keep, text).mapInArrow(run, schema)


def token_count(ids: Column) -> Column:
    return F.size(ids).cast("long")
