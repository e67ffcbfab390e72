"""Phrase collocation mining with weighted acyclic automata over words.

1. Shards.  Every task counts the n-grams of its texts (a shard is up to ``SHARD_WORDS`` words) as a sorted trie by level: a
   node is a language and the words so far, its weight the count of that n-gram.
2. Prefix ranges.  The space of n-grams, ordered word by word, is cut at keys taken from a sample of rows, so that a range
   holds about ``RANGE_ENTRIES`` shard entries.  A shard's trie is cut there, and each stretch becomes a count transducer:
   from the sorted n-grams' ends to their beginnings, states with equal weight and equal arcs are one state, so stretches share
   their tails.  One transducer a shard and range is shuffled.  A phrase, word or line that fills the corpus is one entry a shard,
   and a first word that begins very many n-grams is cut inside, by its second and third words.
3. Union.  A range's transducers are united arc by arc from the roots, weights of equal paths are added, and paths of weight
   under ``least`` are cut off: a part of a candidate occurs at least as often as the candidate, so nothing else is needed.
   Totals of a language's words are summed first.
4. Part lookups.  A range asks for the parts of its candidates (first k words, the rest) by one request automaton for each
   range that holds any, with the candidate's own count as weight where the part lacks just one word; the asked range composes
   them with its counts (both are walked together) and answers the counts.  The largest weight that asks for a phrase
   is the count of the longest-lived longer candidate around it, which decides whether it is dropped.
5. A range keeps its best ``top`` phrases a language, then groups of ranges, then the language.

Exact: counts are 64-bit integers, scores come from integers of any size.  Words are told apart by their bytes once a shard is
built; within a shard by 64-bit hashes of their bytes.

Defined results: a null text is empty, a null language is ``und``; A-Z are lower-cased first, other letters stay; texts that are
empty or without words give nothing; repeated rows each count; texts of any length are read whole, in parts that end between
words, and n-grams over the parts' borders and shards' borders are counted once.  Other columns are left out.  An empty table gives
an empty table.  Equal scores are ordered by count, then by the phrase's bytes.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import _BYTE, HashTable, cut_at, drop_caches, give_memory_back, mix, parts_of_texts, runs_gathered, sums_of_runs, utf8, written

#: Words in a shard at most (about 8 MB of text) and distinct ones from which it is closed; shard entries in a range.
SHARD_WORDS, SHARD_VOCABULARY, RANGE_ENTRIES = 1_250_000, 1 << 19, 1_500_000
#: Bytes of text that boundaries are sampled from for each range, at least ``SAMPLE_BYTES`` together, and keys for each range.
RANGE_SAMPLE, SAMPLE_BYTES, RANGE_KEYS = 16 << 10, 8 << 20, 64
#: Shard entries that a byte of text makes about: sets the number of ranges only.
ENTRIES_A_BYTE = 0.3
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = True
_PARTS = _BREAK.copy()
_PARTS[[0x20, 0x09]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_cut = cut_at(lambda w: _PARTS[w] & ~np.r_[True, _PARTS[w][:-1]])


# ---- tries and transducers

@dataclass
class Trie:
    """Sorted n-grams by level: node i of level k is a child of node ``parent[k][i]`` (level 0: of that language) by the word
    ``symbol[k][i]``; nodes are in order of (parent, symbol); a weight of 0 means that the n-gram itself isn't there."""

    langs: list[str]
    words: list[bytes]
    parent: list[np.ndarray]
    symbol: list[np.ndarray]
    weight: list[np.ndarray]

    @property
    def keys(self) -> list[np.ndarray]:
        return [p * max(1, len(self.words)) + s for p, s in zip(self.parent, self.symbol)]

    def only(self, keep: list[np.ndarray]) -> Trie:
        """The nodes that ``keep`` names, and those above them (these with weight 0)."""
        parent, symbol, weight, below = [], [], [], None
        for k in reversed(range(len(self.parent))):
            stay = keep[k].copy()
            if below is not None:
                stay[self.parent[k + 1][below]] = True
                parent[0] = (np.cumsum(stay) - 1)[parent[0]]
            parent.insert(0, self.parent[k][stay])
            symbol.insert(0, self.symbol[k][stay])
            weight.insert(0, np.where(keep[k], self.weight[k], 0)[stay])
            below = stay
        return Trie(self.langs, self.words, parent, symbol, weight)

    def compact(self) -> Trie:
        """With no words but those of its nodes."""
        used = np.unique(np.concatenate(self.symbol))
        return Trie(self.langs, [self.words[i] for i in used.tolist()], self.parent, [np.searchsorted(used, s) for s in self.symbol], self.weight)

    def paths(self) -> list[list[tuple]]:
        """(language, word, ...) of all nodes, by level."""
        out: list[list[tuple]] = []
        for k, (parent, symbol) in enumerate(zip(self.parent, self.symbol)):
            above = [(x,) for x in self.langs] if not k else out[-1]
            out.append([(*above[p], self.words[s]) for p, s in zip(parent.tolist(), symbol.tolist())])
        return out


def trie_of(grams: dict[tuple, int], levels: int) -> Trie:
    """The trie of (language, word, ...) keys with positive weights."""
    langs, words = sorted({g[0] for g in grams}), sorted({w for g in grams for w in g[1:]})
    number = {w: i for i, w in enumerate(words)}
    parent, symbol, weight = [], [], []
    at: dict[tuple, int] = {(x,): i for i, x in enumerate(langs)}
    for k in range(1, levels + 1):
        here = sorted({g[: k + 1] for g in grams if len(g) > k})
        parent.append(np.array([at[g[:-1]] for g in here], np.int64))
        symbol.append(np.array([number[g[-1]] for g in here], np.int64))
        weight.append(np.array([grams.get(g, 0) for g in here], np.int64))
        at = {g: i for i, g in enumerate(here)}
    return Trie(langs, words, parent, symbol, weight)


@dataclass
class Transducer:
    """A minimal weighted acyclic automaton: the arcs of state s of level k are those from ``first[k][s]`` on, ``arcs[k][s]`` of
    them; level 0 has one state a language.  ``weight[k]`` belongs to the states that the arcs of level k lead to."""

    langs: list[str]
    words: list[bytes]
    arcs: list[np.ndarray] = field(default_factory=list)
    symbol: list[np.ndarray] = field(default_factory=list)
    target: list[np.ndarray] = field(default_factory=list)
    weight: list[np.ndarray] = field(default_factory=list)

    @classmethod
    def minimal(cls, t: Trie) -> Transducer:
        """From the ends of the sorted n-grams to the roots: nodes with equal weight and equal arcs are one state."""
        out = cls(t.langs, t.words)
        state = symbol = None
        for k in reversed(range(len(t.parent))):
            n = len(t.parent[k])
            size = np.zeros(n, np.int64) if state is None else np.bincount(t.parent[k + 1], minlength=n)
            first = np.cumsum(size) - size
            sign = mix(t.weight[k].astype(np.uint64))
            if state is not None:
                arc = mix(mix(symbol.astype(np.uint64)) + state.astype(np.uint64))
                sign = mix(sign + sums_of_runs(arc, first, first + size) + mix(size.astype(np.uint64)))
            _, whose, own = np.unique(sign, return_index=True, return_inverse=True)
            like = whose[own]
            other = (t.weight[k] != t.weight[k][like]) | (size != size[like])
            if state is not None:
                like = np.where(other, np.arange(n), like)
                for x in (symbol, state):
                    wrong = runs_gathered(x, first[like], size) != x
                    other[np.repeat(np.arange(n), size)[wrong]] = True
            if other.any():  # equal hashes of different states: these nodes stay alone
                own[other] = len(whose) + np.arange(int(other.sum()))
                whose = np.concatenate([whose, np.flatnonzero(other)])
            if state is not None:
                out.arcs.insert(0, size[whose])
                out.symbol.insert(0, runs_gathered(symbol, first[whose], size[whose]))
                out.target.insert(0, runs_gathered(state, first[whose], size[whose]))
            out.weight.insert(0, t.weight[k][whose])
            state, symbol = own, t.symbol[k]
        out.arcs.insert(0, np.bincount(t.parent[0], minlength=len(t.langs)))
        out.symbol.insert(0, symbol)
        out.target.insert(0, state)
        return out

    def unfolded(self) -> Trie:
        """The sorted n-grams that the automaton accepts, with their weights."""
        parent, symbol, weight, states = [], [], [], np.arange(len(self.langs))
        for arcs, name, target, w in zip(self.arcs, self.symbol, self.target, self.weight):
            first = np.cumsum(arcs) - arcs
            size = arcs[states]
            parent.append(np.repeat(np.arange(len(states)), size))
            symbol.append(runs_gathered(name, first[states], size))
            states = runs_gathered(target, first[states], size)
            weight.append(w[states])
        return Trie(self.langs, self.words, parent, symbol, weight)

    def packed(self) -> bytes:
        arrays = [x for level in zip(self.arcs, self.symbol, self.target, self.weight) for x in level]
        kinds = [np.min_scalar_type(int(x.max(initial=0))) for x in arrays]
        text = b" ".join(self.words)
        head = json.dumps([self.langs, len(text), [[k.str, len(x)] for k, x in zip(kinds, arrays)]]).encode()
        body = b"".join([len(head).to_bytes(4, "little"), head, text, *(x.astype(k).tobytes() for k, x in zip(kinds, arrays))])
        return len(body).to_bytes(8, "little") + pa.compress(body, codec="zstd", asbytes=True)

    @classmethod
    def unpacked(cls, data: bytes) -> Transducer:
        body = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
        at = 4 + int.from_bytes(body[:4], "little")
        langs, text, arrays = json.loads(body[4:at])
        out = cls(langs, body[at : at + text].split(b" ") if text else [])
        at += text
        for i, (kind, n) in enumerate(arrays):
            kind = np.dtype(kind)
            (out.arcs, out.symbol, out.target, out.weight)[i % 4].append(np.frombuffer(body, kind, n, at).astype(np.int64))
            at += kind.itemsize * n
        return out


def added(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, which of them each key is, and their exact sums of weights."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    new = np.r_[True, ranked[1:] != ranked[:-1]][: len(keys)]
    inverse = np.empty(len(keys), np.int64)
    inverse[order] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    return ranked[first], inverse, np.add.reduceat(weights[order], first) if len(first) else weights


def union(transducers: list[Transducer]) -> Trie:
    """All n-grams of the automata with added weights: from the roots on, arcs of one united state and word lead to one state."""
    tries = [t.unfolded() for t in transducers]
    langs = sorted({x for t in tries for x in t.langs})
    words = sorted({w for t in tries for w in t.words})
    number, lang = {w: i for i, w in enumerate(words)}, {x: i for i, x in enumerate(langs)}
    names = [np.fromiter(map(number.__getitem__, t.words), np.int64, len(t.words)) for t in tries]
    above = [np.array([lang[x] for x in t.langs], np.int64) for t in tries]
    parent, symbol, weight, base = [], [], [], max(1, len(words))
    for k in range(len(tries[0].parent)):
        keys, own, sums = added(np.concatenate([a[t.parent[k]] * base + n[t.symbol[k]] for a, t, n in zip(above, tries, names)]), np.concatenate([t.weight[k] for t in tries]))
        parent.append(keys // base)
        symbol.append(keys % base)
        weight.append(sums)
        above = np.split(own, np.cumsum([len(t.parent[k]) for t in tries])[:-1])
    return Trie(langs, words, parent, symbol, weight)


def composed(asked: Trie, counts: Trie) -> list[np.ndarray]:
    """Both automata walked together: for each node that is asked for, the node of ``counts`` with the same path (-1: none)."""
    number, lang = {w: i for i, w in enumerate(counts.words)}, {x: i for i, x in enumerate(counts.langs)}
    word = np.array([number.get(w, -1) for w in asked.words], np.int64)
    above, out, base = np.array([lang.get(x, -1) for x in asked.langs], np.int64), [], max(1, len(counts.words))
    for parent, symbol, keys in zip(asked.parent, asked.symbol, counts.keys):
        at, name = above[parent], word[symbol]
        key = at * base + name
        place = np.minimum(np.searchsorted(keys, key), max(0, len(keys) - 1))
        good = (at >= 0) & (name >= 0) & (keys[place] == key if len(keys) else False)
        above = np.where(good, place, -1)
        out.append(above)
    return out


def cuts(t: Trie, bounds: list[tuple]) -> list[np.ndarray]:
    """How many nodes of each level come before each bound, in the order of n-grams (an n-gram before those that go on from it)."""
    words, langs, keys = np.array([*t.words, None], object)[:-1], np.array([*t.langs, None], object)[:-1], t.keys
    length, base = np.array([len(b) - 1 for b in bounds], np.int64), max(1, len(t.words))
    lang = [b[0] for b in bounds]
    at = np.searchsorted(langs, np.array([*lang, None], object)[:-1]).astype(np.int64)
    exact = np.array([i < len(langs) and langs[i] == x for i, x in zip(at.tolist(), lang)], bool)
    out = []
    for k in range(len(t.parent)):
        here = np.searchsorted(t.parent[k], at)
        go = np.flatnonzero(exact & (length > k))
        found = np.zeros(len(bounds), bool)
        if len(go):
            name = [bounds[i][k + 1] for i in go.tolist()]
            word = np.searchsorted(words, np.array([*name, None], object)[:-1]).astype(np.int64)
            there = np.array([i < len(words) and words[i] == x for i, x in zip(word.tolist(), name)], bool)
            key = at[go] * base + word
            here[go] = np.searchsorted(keys[k], key)
            place = np.minimum(here[go], max(0, len(keys[k]) - 1))
            found[go] = there & (keys[k][place] == key if len(keys[k]) else False)
        exact = found & (length > k + 1)
        out.append(here + exact)
        at = here
    return out


def stretches(t: Trie, bounds: list[tuple]) -> Iterator[tuple[int, Trie]]:
    """The trie cut at ascending bounds: (range, its part) where there is one; the nodes above a part's first are in it with weight 0."""
    marks = [np.concatenate([[0], c, [len(p)]]) for c, p in zip(cuts(t, bounds), t.parent)]
    levels = range(len(t.parent))
    for r in np.flatnonzero(sum(np.diff(m) for m in marks)).tolist():
        low, high = [int(m[r]) for m in marks], [int(m[r + 1]) for m in marks]
        begin, end = low.copy(), high.copy()
        for k in reversed(levels[:-1]):
            if end[k + 1] > begin[k + 1]:
                p = t.parent[k + 1]
                first, last = int(p[begin[k + 1]]), int(p[end[k + 1] - 1]) + 1
                begin[k], end[k] = (min(begin[k], first), max(end[k], last)) if end[k] > begin[k] else (first, last)
        weight = []
        for k in levels:
            w = t.weight[k][begin[k] : end[k]].copy()
            w[: max(0, low[k] - begin[k])] = 0
            w[max(0, high[k] - begin[k]) :] = 0
            weight.append(w)
        parent = [t.parent[k][begin[k] : end[k]] - (begin[k - 1] if k else 0) for k in levels]
        yield r, Trie(t.langs, t.words, parent, [t.symbol[k][begin[k] : end[k]] for k in levels], weight).compact()


# ---- shards

class Shard:
    """Counts n-grams of up to ``longest`` words of texts that are added part by part."""

    def __init__(self, longest: int):
        self.longest = longest
        self.clear()

    def clear(self) -> None:
        self.table, self.words, self.langs = HashTable(SHARD_VOCABULARY + (1 << 19)), [], {}
        self.ids: list[np.ndarray] = []
        self.begins: list[np.ndarray] = []
        self.lang: list[np.ndarray] = []
        self.size = self.carried = 0

    def full(self) -> bool:
        return self.size >= SHARD_WORDS or len(self.words) >= SHARD_VOCABULARY

    def number(self, hashes: np.ndarray, words) -> np.ndarray:
        """Numbers of words by their hashes; ``words(i)`` gives the bytes of a new one."""
        distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        known = self.table.find(distinct)
        new = np.flatnonzero(known < 0)
        if len(new):
            known[new] = np.arange(len(self.words), len(self.words) + len(new))
            self.table.add(distinct[new], known[new])
            self.words += words(first[new])
        return known[inverse].astype(np.int32)

    def add(self, raw: np.ndarray, offsets: np.ndarray, langs: list[str], goes_on: bool, open_text: bool) -> bool:
        """Texts (bytes, offsets) with a language each; ``goes_on``: they are a part of a text that began before, ``open_text``: whose
        last word the first one here may follow.  Returns the same for the part behind these."""
        raw = _FOLD[raw]
        inside = ~_PARTS[raw]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        begin = offsets[:-1][offsets[:-1] < len(raw)]
        first[begin] = inside[begin]
        last[:-1] &= ~inside[1:] | first[1:]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        if not len(starts):
            return open_text and goes_on and not _BREAK[raw].any()
        hashes = mix(sums_of_runs(_BYTE[raw], starts, ends) + (ends - starts).astype(np.uint64))
        view = raw.tobytes()
        ids = self.number(hashes, lambda at: [view[i:j] for i, j in zip(starts[at].tolist(), ends[at].tolist())])
        doc = np.searchsorted(offsets, starts, side="right") - 1
        breaks = np.cumsum(_BREAK[raw])[starts]
        begins = np.ones(len(starts), bool)
        begins[1:] = (breaks[1:] != breaks[:-1]) | (doc[1:] != doc[:-1])
        if goes_on and open_text and not breaks[0]:
            begins[0] = False
        self.ids.append(ids)
        self.begins.append(begins)
        self.lang.append(np.array([self.langs.setdefault(x, len(self.langs)) for x in langs], np.int32)[doc])
        self.size += len(ids)
        return bool(doc[-1] == len(offsets) - 2) or (open_text and goes_on)

    def tail(self) -> tuple[list[bytes], list[bool], list[str]]:
        """The last words, which n-grams that end in the next shard begin with."""
        n, names = self.longest - 1, list(self.langs)
        ids, begins, lang = (np.concatenate(x[-n:])[-n:] for x in (self.ids, self.begins, self.lang)) if self.ids and n else ([], [], [])
        return [self.words[i] for i in ids], [bool(b) for b in begins], [names[i] for i in lang]

    def carry(self, words: list[bytes], begins: list[bool], langs: list[str]) -> None:
        """Words of the shard before: they begin n-grams here, but none ends with them."""
        for w, b, x in zip(words, begins, langs):
            raw = np.frombuffer(w, np.uint8)
            hashes = mix(sums_of_runs(_BYTE[raw], np.array([0]), np.array([len(raw)])) + np.array([len(raw)], np.uint64))
            self.ids.append(self.number(hashes, lambda at, w=w: [w]))
            self.begins.append(np.array([b]))
            self.lang.append(np.array([self.langs.setdefault(x, len(self.langs))], np.int32))
        self.size += len(words)
        self.carried = len(words)

    def trie(self) -> Trie | None:
        if self.size == self.carried:
            return None
        order = sorted(range(len(self.words)), key=self.words.__getitem__)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        lang_order = sorted(self.langs)
        lang_rank = np.array([lang_order.index(x) for x in self.langs], np.int64)
        word, base = rank[np.concatenate(self.ids)], len(order)
        lang, begins = lang_rank[np.concatenate(self.lang)], np.concatenate(self.begins)
        depth = np.minimum(np.arange(len(begins)) - np.maximum.accumulate(np.where(begins, np.arange(len(begins)), 0)), self.longest)
        counted = np.arange(len(word)) >= self.carried
        parent, symbol, weight, node = [], [], [], None
        for k in range(self.longest):
            at = np.flatnonzero(depth >= k)
            key = (lang[at] if node is None else node[at - 1]) * base + word[at]
            keys, own, sums = added(key, counted[at].astype(np.int64))
            node = np.zeros(len(word), np.int64)
            node[at] = own
            parent.append(keys // base)
            symbol.append(keys % base)
            weight.append(sums)
        return Trie(lang_order, [self.words[i] for i in order], parent, symbol, weight)


def shard_tries(batches: Iterator[pa.RecordBatch], longest: int) -> Iterator[Trie]:
    """The n-grams of (text, lang) batches, a trie a shard."""
    drop_caches()
    give_memory_back()
    shard, open_text = Shard(longest), False
    for b in batches:
        raw, offsets = utf8(b.column(0))
        langs = b.column(1).to_pylist()
        for own, at, text, goes_on in parts_of_texts(raw, offsets, _cut):
            on = bool(goes_on[0]) if len(goes_on) else False
            if shard.full():
                tail = shard.tail() if on and open_text else ([], [], [])
                made = shard.trie()
                shard.clear()
                if made is not None:
                    yield made
                del made
                shard.carry(*tail)
            open_text = shard.add(own, at, [langs[i] for i in text.tolist()], on, open_text)
    made = shard.trie()
    if made is not None:
        yield made


# ---- jobs

_SENT = "range int, source int, payload binary"


def _sent(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["range", "source", "payload"])


def boundaries(texts: DataFrame, longest: int) -> list[tuple]:
    """Ascending n-grams at which the space is cut, for ranges of about ``RANGE_ENTRIES`` shard entries: quantiles of the
    n-grams of a sample of rows.  The driver holds one key a range; they change the work's split, never results."""
    total = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    ranges = int(total * ENTRIES_A_BYTE) // RANGE_ENTRIES + 1
    if ranges == 1:
        return []
    sample = max(SAMPLE_BYTES, ranges * RANGE_SAMPLE)
    tasks = max(1, sample // SAMPLE_BYTES)
    rows = texts.where(F.rand(13) < F.lit(min(1.0, sample / total))).repartition(tasks)
    every = max(1, int(sample * ENTRIES_A_BYTE) // (ranges * RANGE_KEYS))
    names = [f"w{k}" for k in range(longest)]

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in shard_tries(batches, longest):
            found = [p for level in t.paths() for p in level[every // 2 :: every]]
            columns = [[p[k + 1] if len(p) > k + 1 else None for p in found] for k in range(longest)]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in found], pa.string()), *(pa.array(c, pa.binary()) for c in columns)], ["lang", *names])

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for b in batches:
            for x in zip(*(c.to_pylist() for c in b.columns)):
                own = tuple(v for v in x if v is not None)
                best = own if best is None or own < best else best
        if best is not None:
            yield pa.RecordBatch.from_arrays([pa.array([best[0]], pa.string()), *(pa.array([best[k + 1] if len(best) > k + 1 else None], pa.binary()) for k in range(longest))], ["lang", *names])

    schema = "lang string, " + ", ".join(f"{n} binary" for n in names)
    spread = rows.mapInArrow(keys, schema).repartitionByRange(ranges, "lang", *names)
    found = sorted(tuple(bytes(v) if i else v for i, v in enumerate(r) if v is not None) for r in spread.mapInArrow(least, schema).collect())
    return sorted(set(found))[1:]


def count_ranges(texts: DataFrame, bounds: list[tuple], longest: int, least: int) -> DataFrame:
    """(range, source -1, payload) rows, one a range: its counts of at least ``least`` as a transducer, and each language's words."""
    shared = texts.sparkSession.sparkContext.broadcast(bounds)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in shard_tries(batches, longest):
            rows: list[tuple] = []
            for r, part in stretches(t, shared.value):
                rows.append((r, 0, Transducer.minimal(part).packed()))
                if len(rows) == 64:
                    yield _sent(rows)
                    rows = []
            if rows:
                yield _sent(rows)

    def unite(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_caches()
        give_memory_back()
        whole = union([Transducer.unpacked(x.as_py()) for b in batches for x in b.column("payload")])
        totals = np.zeros(len(whole.langs), np.int64)
        np.add.at(totals, whole.parent[0], whole.weight[0])
        counts = whole.only([w >= least for w in whole.weight]).compact()
        head = json.dumps(dict(zip(whole.langs, totals.tolist()))).encode()
        yield _sent([(key[0].as_py(), -1, len(head).to_bytes(4, "little") + head + Transducer.minimal(counts).packed())])

    return written(texts.mapInArrow(cut, _SENT).groupBy("range").applyInArrow(unite, _SENT))


def _counts(payload: bytes) -> tuple[dict[str, int], Trie]:
    n = int.from_bytes(payload[:4], "little")
    return json.loads(payload[4 : 4 + n]), Transducer.unpacked(payload[4 + n :]).unfolded()


def asked_parts(t: Trie, bounds: list[tuple]) -> tuple[dict[tuple, int], dict[int, list[tuple]]]:
    """The candidates of a range with their counts; the parts that they need by the range that holds each, shortest first and in
    order, each as (part, largest count of a candidate that is longer by one word)."""
    found: dict[tuple, int] = {}
    need: dict[tuple, int] = {}
    for k, level in enumerate(t.paths()):
        for path, n in zip(level, t.weight[k].tolist()) if k else ():
            if n:
                found[path] = n
                for cut in range(2, len(path)):
                    for part in (path[:cut], (path[0], *path[cut:])):
                        need[part] = max(need.get(part, 0), n if len(part) == len(path) - 1 and len(part) > 2 else 0)
    out: dict[int, list[tuple]] = {}
    for part in sorted(need, key=lambda p: (len(p), p)):
        out.setdefault(bisect_right(bounds, part), []).append((part, need[part]))
    return found, out


def answered(counts: DataFrame, bounds: list[tuple], longest: int) -> DataFrame:
    """(range, source, payload) rows: the counts of the parts that a range asked ``source`` for, in its order, and for source -2 how
    often the longest-lived longer candidate around each of its own nodes occurs."""
    shared = counts.sparkSession.sparkContext.broadcast(bounds)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r, payload in zip(b.column("range").to_pylist(), b.column("payload")):
                rows = [(target, r, Transducer.minimal(trie_of({p: n + 1 for p, n in parts}, longest - 1)).packed()) for target, parts in asked_parts(_counts(payload.as_py())[1], shared.value)[1].items()]
                for i in range(0, len(rows), 64):
                    yield _sent(rows[i : i + 64])

    def answer(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_memory_back()
        own, questions = None, []
        for b in batches:
            for source, payload in zip(b.column("source").to_pylist(), b.column("payload")):
                if source == -1:
                    own = _counts(payload.as_py())[1]
                else:
                    questions.append((source, payload.as_py()))
        if own is None:
            return
        longer = [np.zeros(len(p), np.int64) for p in own.parent]
        for source, payload in questions:
            asked = Transducer.unpacked(payload).unfolded()
            out = []
            for k, node in enumerate(composed(asked, own)):
                final = asked.weight[k] > 0
                assert (node[final] >= 0).all(), "a candidate's part has no count"
                np.maximum.at(longer[k], node[final], asked.weight[k][final] - 1)
                out.append(own.weight[k][node[final]])
            yield _sent([(source, key[0].as_py(), np.concatenate(out).tobytes())])
        yield _sent([(key[0].as_py(), -2, np.concatenate(longer).tobytes())])

    return counts.unionByName(counts.mapInArrow(ask, _SENT)).groupBy("range").applyInArrow(answer, _SENT)


def lowest_score(a: int, cuts: list[tuple[int, int]]) -> tuple[int, int, int]:
    """The lowest of the cuts' scores floor(10^6 a a / (l r)), with its l and r; ties go to the first cut."""
    best = None
    for left, right in cuts:
        s = 1_000_000 * a * a // (left * right)
        if best is None or s < best[0]:
            best = (s, left, right)
    return best


def mine_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = 3, least: int = 10, inside: int = 50, top: int = 2000) -> DataFrame:
    """The best ``top`` phrases of 2 to ``longest`` words of each language: lang, rank, phrase, a (its count), l and r (of its parts
    at the lowest-scoring cut), n (words of the language) and score.  A phrase that stands inside a longer one with at least
    ``inside`` per cent of its count is left out."""
    texts = docs.select(F.col(text).cast("string").alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"))
    bounds = boundaries(texts, longest)
    counts = count_ranges(texts, bounds, longest, least)
    shared = docs.sparkSession.sparkContext.broadcast(bounds)
    schema = "group int, lang string, phrase string, a long, l long, r long, score long"

    def finish(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_memory_back()
        got = {s: p.as_py() for b in batches for s, p in zip(b.column("source").to_pylist(), b.column("payload"))}
        own = _counts(got[-1])[1]
        found, asked = asked_parts(own, shared.value)
        count: dict[tuple, int] = {}
        for target, parts in asked.items():
            count.update(zip((p for p, _ in parts), np.frombuffer(got[target], np.int64).tolist(), strict=True))
        longer = dict(zip((p for level in own.paths() for p in level), np.frombuffer(got[-2], np.int64).tolist(), strict=True))
        best: dict[str, list[tuple]] = {}
        for p, a in found.items():
            if 100 * longer[p] < inside * a:
                score, left, right = lowest_score(a, [(count[p[:k]], count[(p[0], *p[k:])]) for k in range(2, len(p))])
                best.setdefault(p[0], []).append((-score, -a, b" ".join(p[1:]), left, right))
        rows = [(key[0].as_py() % 64, x, phrase.decode("utf-8"), -a, left, right, -score) for x, own in best.items() for score, a, phrase, left, right in sorted(own)[:top]]
        kinds = [pa.int32(), pa.string(), pa.string(), *[pa.int64()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(7)], ["group", "lang", "phrase", "a", "l", "r", "score"])

    rows = counts.unionByName(answered(counts, bounds, longest)).groupBy("range").applyInArrow(finish, schema)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    near = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "group").orderBy(*order))).where(F.col("rank") <= top)
    last = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for payload in b.column("payload"):
                own = _counts(payload.as_py())[0]
                yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.string()), pa.array(list(own.values()), pa.int64())], ["of", "n"])

    n = counts.mapInArrow(totals, "of string, n long").groupBy("of").agg(F.sum("n").alias("n"))
    return last.join(n, F.col("lang") == F.col("of")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
