"""Evaluation passages inside training text, found with a generalised suffix automaton.

The items are normalised to words (case, punctuation, spacing, line breaks and marks vanish), sentences that several items
share are blanked out, and one suffix automaton is built over the rest. Each document streams its words through it, which
gives the longest runs of words that it shares with each item. Runs of one item on nearby diagonals are joined to
passages, the words between them are compared one by one, and an item counts as leaked when its passages are long enough.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspace.plans.runtime import ship

WORD = re.compile(r"[^\W_]+")
SENTENCE = r"(?<=[.!?])\s+|[\r\n]+"
#: Stands for a blanked-out sentence; no document word equals it.
GAP = "\x00"
def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


class SuffixAutomaton:
    """All word runs of some items, packed into arrays: twelve bytes a transition or place, twelve more a state.

    ``ids`` numbers the words; words that it doesn't know are added. A state stands for the runs that end at the same places of the
    items; ``link`` is the suffix tree, in which a state's places are its own and those of all states below it.
    """

    def __init__(self, items: list[tuple[int, list[str]]], ids: dict[str, int] | None = None):
        self.ids: dict[str, int] = {} if ids is None else ids
        number = self.ids.setdefault
        coded = [[-1 if w == GAP else number(w, len(self.ids)) for w in words] for _, words in items]
        following: list[dict[int, int]] = [{}]
        link, length = [-1], [0]
        ends: list[tuple[int, int, int]] = []

        def new(size: int, to: int, nxt: dict[int, int]) -> int:
            following.append(nxt)
            link.append(to)
            length.append(size)
            return len(following) - 1

        def split(p: int, q: int, c: int) -> int:
            clone = new(length[p] + 1, link[q], dict(following[q]))
            link[q] = clone
            while p >= 0 and following[p].get(c) == q:
                following[p][c] = clone
                p = link[p]
            return clone

        def extend(last: int, c: int) -> int:
            q = following[last].get(c)
            if q is not None:
                return q if length[q] == length[last] + 1 else split(last, q, c)
            cur = new(length[last] + 1, 0, {})
            p = last
            while p >= 0 and c not in following[p]:
                following[p][c] = cur
                p = link[p]
            if p >= 0:
                q = following[p][c]
                link[cur] = q if length[q] == length[p] + 1 else split(p, q, c)
            return cur

        for n, words in enumerate(coded):
            last = 0
            for i, c in enumerate(words):
                last = 0 if c < 0 else extend(last, c)
                if c >= 0:
                    ends.append((last, n, i + 1))
        states = len(following)
        self.link, self.length = np.array(link, np.int32), np.array(length, np.int32)
        sizes = np.fromiter(map(len, following), np.int64, states)
        self.out_start = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        edges = np.fromiter((v for f in following for e in sorted(f.items()) for v in e), np.int32, 2 * int(sizes.sum())).reshape(-1, 2)
        self.out_code, self.out_state = np.ascontiguousarray(edges[:, 0]), np.ascontiguousarray(edges[:, 1])
        at = np.array(ends, np.int32).reshape(-1, 3)
        at = at[np.argsort(at[:, 0], kind="stable")]
        self.end_start = np.searchsorted(at[:, 0], np.arange(states + 1)).astype(np.int32)
        self.end_item, self.end_at = np.ascontiguousarray(at[:, 1]), np.ascontiguousarray(at[:, 2])
        self.child = np.argsort(self.link, kind="stable").astype(np.int32)[1:]
        self.child_start = np.searchsorted(self.link[self.child], np.arange(states + 1)).astype(np.int32)
        count = np.diff(self.end_start).tolist()  # places of each state
        for s in np.argsort(-self.length, kind="stable").tolist():
            if s:
                count[link[s]] += count[s]
        self.count = np.array(count, np.int32)
        self.word_start = np.concatenate([[0], np.cumsum([len(w) for w in coded])]).astype(np.int64)
        self.word = np.fromiter((c for w in coded for c in w), np.int32, int(self.word_start[-1]))
        self.views: dict[str, memoryview] = {}

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "ids"} | {"views": {}}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state

    def view(self, name: str) -> memoryview:
        """An array whose elements come out as plain numbers, which is what stepping through it word by word needs."""
        if name not in self.views:
            self.views[name] = memoryview(getattr(self, name))
        return self.views[name]

    @property
    def nbytes(self) -> int:
        return sum(v.nbytes for v in self.__dict__.values() if isinstance(v, np.ndarray))

    def item(self, k: int) -> list[int]:
        """The item's words; -1 for a gap."""
        return self.word[self.word_start[k] : self.word_start[k + 1]].tolist()

    def stepper(self) -> Callable[[int, int], int]:
        """``step(state, code)``: the next state, or -1."""
        start, code, target = self.view("out_start"), self.view("out_code"), self.view("out_state")

        def step(s: int, c: int) -> int:
            lo, hi = start[s], start[s + 1]
            at = lo if hi - lo == 1 else bisect_left(code, c, lo, hi)
            return target[at] if at < hi and code[at] == c else -1

        return step

    def places(self, state: int, without: int = -1) -> Iterator[tuple[int, int]]:
        """Where the runs of ``state`` end: its own places and those of all states below it, but for ``without`` and those below that."""
        first, item, at, child, children = (self.view(n) for n in ("end_start", "end_item", "end_at", "child", "child_start"))
        stack = [state]
        while stack:
            s = stack.pop()
            if s != without:
                for i in range(first[s], first[s + 1]):
                    yield item[i], at[i]
                stack += child[children[s] : children[s + 1]]

    def runs(self, codes: list[int], least: int) -> Iterator[tuple[int, int, int]]:
        """Maximal matches (end, length, state) of at least ``least`` words."""
        step, link, length = self.stepper(), self.view("link"), self.view("length")
        s = n = 0
        for i, c in enumerate(codes):
            t = step(s, c)
            if t < 0:
                if n >= least:
                    yield i, n, s
                while s and t < 0:
                    s = link[s]
                    n = length[s]
                    t = step(s, c)
            s, n = (t, n + 1) if t >= 0 else (0, 0)
        if n >= least:
            yield len(codes), n, s

    def own_runs(self, codes: list[int], least: int) -> Iterator[tuple[int, int, int, int]]:
        """Each item's own maximal runs (end, length, item, offset after the run) of at least ``least`` words.

        A run of one item inside a longer run of another is among them: at each word the places that the next word doesn't
        follow drop out, those of the current state with the whole match and those of the states it links to with theirs.
        """
        step, link, length, count, word, start = self.stepper(), *(self.view(n) for n in ("link", "length", "count", "word", "word_start"))
        s = n = 0
        for i, c in enumerate([*codes, -1]):
            t = step(s, c)
            if n >= least:
                top = s
                while length[link[top]] >= least:
                    top = link[top]
                after = step(top, c)
                if count[top] != (count[after] if after >= 0 else 0):
                    below, u, m = -1, s, n
                    while u > 0 and m >= least:
                        for k, at in self.places(u, below):
                            if c < 0 or start[k] + at >= start[k + 1] or word[start[k] + at] != c:
                                yield i, m, k, at
                        below, u = u, link[u]
                        m = length[u]
            while s and t < 0:
                s = link[s]
                n = length[s]
                t = step(s, c)
            s, n = (t, n + 1) if t >= 0 else (0, 0)


class ItemIndex:
    """Several automata over one numbering of words, so that texts are cut into words and numbered once for all of them.

    ``bits`` marks the hashes of all neighbouring word pairs of the items, 64 bits a pair.
    """

    def __init__(self, lots: Iterable[list[tuple[int, list[str]]]]):
        self.ids: dict[str, int] = {}
        self.automata: list[SuffixAutomaton] = []
        self.names: list = []
        self.first: list[int] = []
        for lot in lots:
            self.first.append(len(self.names))
            self.automata.append(SuffixAutomaton(lot, self.ids))
            self.names += [i for i, _ in lot]
        pairs = [(w[:-1], w[1:]) for w in (a.word.astype(np.int64) for a in self.automata)]
        size = 1 << max(22, (64 * sum(len(a) for a, _ in pairs)).bit_length())
        self.bits = np.zeros(size // 8, np.uint8)
        for a, b in pairs:
            real = (a >= 0) & (b >= 0)  # pairs across two items among them, which does no harm
            h = self.hash(a[real], b[real])
            np.bitwise_or.at(self.bits, h >> 3, np.left_shift(1, h & 7).astype(np.uint8))

    def hash(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a * np.int64(2654435761) + b * np.int64(40503)) & np.int64(8 * len(self.bits) - 1)

    def paired(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        h = self.hash(a, b)
        return (self.bits[h >> 3] >> (h & 7).astype(np.uint8)) & 1 == 1

    def item(self, number: int) -> list[int]:
        n = bisect_right(self.first, number) - 1
        return self.automata[n].item(number - self.first[n])


@dataclass
class Limits:
    """``seed``: shortest exact run that is followed up; ``passage``: shortest passage that counts; ``total``: words that the
    best two passages of an item need together; ``altered``: at most one word in so many may differ; ``gap``: words that may
    lie between two runs of a passage."""

    seed: int = 5
    passage: int = 12
    total: int = 20
    altered: int = 8
    gap: int = 4


def _windows(parts: list[tuple[int, int, int, int, int]], limits: Limits) -> list[tuple[int, int, int, int]]:
    """The longest stretch of an alignment that keeps to the rule of altered words, and the longest ones before and after it.

    ``parts``: document start, end, item start, end and altered words of each piece; pieces without altered words are matches.
    """
    before, after = [0], []  # eight times the altered words less the words, up to each part and with it
    for _, _, i, j, bad in parts:
        before.append(before[-1] + bad * limits.altered - (j - i))
    after, before = before[1:], before[:-1]
    found, todo = [], [(0, len(parts))]
    while todo:
        lo, hi = todo.pop()
        starts, highest = [], []  # a later start can be the better one only if fewer words are spent up to it
        for n in range(lo, hi):
            if not parts[n][4] and (not highest or before[n] > highest[-1]):
                starts.append(n)
                highest.append(before[n])
        most, best = limits.passage - 1, None
        for n in range(lo, hi):
            if not parts[n][4] and (at := bisect_left(highest, after[n])) < len(starts) and starts[at] <= n and parts[n][3] - parts[starts[at]][2] > most:
                most, best = parts[n][3] - parts[starts[at]][2], (starts[at], n)
        if best:
            a, z = best
            found.append((parts[a][0], parts[z][1], parts[a][2], parts[z][3]))
            todo += [(lo, a), (z + 1, hi)]
    return found


def _compared(doc: list[int], item: list[int], d: int, e: int, i: int, j: int) -> list[tuple[int, int, int, int, int]]:
    """The words between two runs one by one; stretches of unequal length are one piece, altered in full."""
    if e - d != j - i:
        return [(d, e, i, j, max(e - d, j - i))]
    return [(d + n, d + n + 1, i + n, i + n + 1, int(doc[d + n] != item[i + n] or item[i + n] < 0)) for n in range(e - d)]


def _beyond(doc: list[int], item: list[int], a: int, b: int, step: int, gap: int) -> list[tuple[int, int, int, int, int]]:
    """The words from ``a`` and ``b`` on in one direction, up to the last equal pair with at most ``gap`` altered words before it."""
    out, good = [], 0
    while 0 <= a < len(doc) and 0 <= b < len(item) and item[b] >= 0 and len(out) - good <= gap:
        out.append((a, a + 1, b, b + 1, int(doc[a] != item[b])))
        if doc[a] == item[b]:
            good = len(out)
        a, b = a + step, b + step
    return out[:good][::step]


def passages(doc: list[int], item: list[int], runs: list[tuple[int, int, int]], limits: Limits) -> list[tuple[int, int, int, int]]:
    """Passages (document start, end, item start, end) out of exact runs (document start, item start, length).

    Runs with few words between them are chained, whatever these words are; the rule of altered words then decides which stretches
    of a chain are passages.
    """
    chains: list[list[tuple[int, int, int, int, int]]] = []
    near: list[list[tuple[int, int, int, int, int]]] = []  # chains that a run can still follow
    for d, i, n in sorted(runs):
        near = [c for c in near if d - c[-1][1] <= limits.gap]
        best = None
        for c in near:
            _, e, _, j, _ = c[-1]
            gd, gi = d - e, i - j
            skip = max(0, -gd, -gi)  # overlap of the runs
            if d + n <= e or i + n <= j or skip >= n or max(gd, gi) + skip > limits.gap or (best and best[0][-1][1] >= e):
                continue
            best = (c, skip)
        if best:
            c, skip = best
            c += _compared(doc, item, c[-1][1], d + skip, c[-1][3], i + skip)
        else:
            c, skip = [], 0
            chains.append(c)
            near.append(c)
        c += [(d + w, d + w + 1, i + w, i + w + 1, 0) for w in range(skip, n)]
    found = []
    for c in chains:  # over single altered words at either end
        head = _beyond(doc, item, c[0][0] - 1, c[0][2] - 1, -1, limits.gap)
        found += _windows([*head, *c, *_beyond(doc, item, c[-1][1], c[-1][3], 1, limits.gap)], limits)
    return sorted(set(found))


def leaked(found: list[tuple[int, int, int, int]], limits: Limits) -> list[tuple[int, int, int, int]]:
    """The one or two passages that reach the total, in the item's order; empty if none do."""
    longest = max(found, key=lambda p: p[3] - p[2], default=None)
    if longest is None:
        return []
    if longest[3] - longest[2] >= limits.total:
        return [longest]
    best: dict[int, tuple[int, int, int, int]] = {}  # for each end in the item, the longest passage that is over in the document
    first = sorted(found, key=lambda p: -p[1])
    for b in sorted(found):
        while first and first[-1][1] <= b[0]:
            a = first.pop()
            if a[3] not in best or a[3] - a[2] > a[3] - best[a[3]][2]:
                best[a[3]] = a
        for end, a in best.items():
            if end <= b[2] and end - a[2] + b[3] - b[2] >= limits.total:
                return [a, b]
    return []


def item_words(items: DataFrame, item: str, text: str) -> DataFrame:
    """``item, words``: the item's normalised words, a gap for each sentence that also occurs in another item."""
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))
    once = items.filter(F.col(item).isNotNull() & F.col(text).isNotNull()).groupBy(F.col(item).alias("__i")).agg(F.min(text).alias("__x"))
    parts = once.select("__i", F.posexplode(F.split("__x", SENTENCE)).alias("__n", "__s")).withColumn("__k", plain(F.col("__s")))
    common = parts.filter("__k <> ''").groupBy("__k").agg(F.min("__i").alias("__a"), F.max("__i").alias("__b")).filter("__a <> __b").select("__k", F.lit(True).alias("__shared"))
    marked = parts.join(common, "__k", "left").withColumn("__s", F.when(F.col("__shared"), F.lit(None)).otherwise(F.col("__s")))
    ordered = F.sort_array(F.collect_list(F.struct("__n", "__s")))
    return marked.groupBy(F.col("__i").alias(item)).agg(F.transform(ordered, lambda e: e["__s"]).alias("sentences"))


def _shards(items: DataFrame, most: int) -> Iterator[list[tuple[int, list[str]]]]:
    """The items in lots of at most ``most`` words (a longer item is a lot of its own)."""
    lot, size = [], 0
    for i, sentences in items.toLocalIterator():
        words = [w for s in sentences for w in ([GAP] if s is None else words_of(s))]
        if lot and size + len(words) > most:
            yield lot
            lot, size = [], 0
        lot.append((i, words))
        size += len(words)
    if lot:
        yield lot


def _indexes(items: DataFrame, most: int, lots: int) -> Iterator[ItemIndex]:
    """Indexes of at most ``lots`` automata each."""
    shards = _shards(items, most)
    while some := list(islice(shards, lots)):
        yield ItemIndex(some)


def find_leaks(documents: DataFrame, items: DataFrame, document: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", limits: Limits = Limits(), most: int = 500_000, lots: int = 8) -> DataFrame:
    """Leaked passages: ``item, document, start, end, words``, with character places in the document's text.

    A row for each of the one or two passages that prove the leak. NULL and empty texts hold nothing; repeated items count once;
    each document row is examined as a whole. An automaton holds at most ``most`` item words and one pass over the documents serves
    ``lots`` automata (more items make more passes), so what is broadcast doesn't grow with either table. Empty tables give no rows.
    """
    spark = ship(documents.sparkSession)
    corpus = documents.filter(F.col(text).isNotNull() & (F.col(text) != "") & F.col(document).isNotNull()).select(F.col(document).alias("__d"), F.col(text).alias("__x"))
    kinds = [T.StructField(item, items.schema[item].dataType), T.StructField(document, documents.schema[document].dataType)]
    schema = T.StructType([*kinds, *(T.StructField(n, T.LongType()) for n in ("start", "end", "words"))])
    out = None
    for index in _indexes(item_words(items, item, item_text), most, lots):
        shared = spark.sparkContext.broadcast(index)

        def scan(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            index = shared.value
            for b in batches:
                ids, texts = b["__d"].tolist(), b["__x"].tolist()
                for lot in _lots(texts):
                    rows = list(_scan(ids[lot], texts[lot], index, limits))
                    yield pd.DataFrame([(index.names[n], *rest) for n, *rest in rows], columns=schema.fieldNames())

        part = corpus.mapInPandas(scan, schema)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def _lots(texts: list[str], most: int = 8_000_000) -> Iterator[slice]:
    """Runs of neighbouring texts of at most ``most`` characters together (a longer text is a run of its own)."""
    lo = size = 0
    for i, t in enumerate(texts):
        if i > lo and size + len(t) > most:
            yield slice(lo, i)
            lo, size = i, 0
        size += len(t)
    if texts:
        yield slice(lo, len(texts))


def _scan(names: list, texts: list[str], index: ItemIndex, limits: Limits, whole: bool = False) -> Iterator[tuple]:
    """Item number, name, start, end and words of the passages that prove a leak; if ``whole``, of all passages of a leaked item."""
    get = index.ids.get
    per_doc = [words_of(t) for t in texts]
    sizes = np.array([len(w) + 1 for w in per_doc], np.int64)
    codes = np.fromiter((c for w in per_doc for c in (*(get(x, -1) for x in w), -1)), np.int64, int(sizes.sum()))
    starts = np.concatenate([[0], np.cumsum(sizes)])
    # only where enough neighbouring word pairs occur in items can a run of `seed` words lie
    ok = np.concatenate([[False], (codes[:-1] >= 0) & (codes[1:] >= 0) & index.paired(codes[:-1], codes[1:]), [False]])
    edge = np.flatnonzero(ok[1:] != ok[:-1])
    lo, hi = edge[0::2], edge[1::2] + 1
    keep = hi - lo >= limits.seed
    found: dict[tuple[int, int], list[tuple[int, int, int]]] = defaultdict(list)
    for a, z in zip(lo[keep].tolist(), hi[keep].tolist(), strict=True):
        d = int(np.searchsorted(starts, a, side="right")) - 1
        base = a - int(starts[d])
        stretch = codes[a:z].tolist()
        for first, automaton in zip(index.first, index.automata, strict=True):
            for end, n, k, at in automaton.own_runs(stretch, limits.seed):
                found[d, first + k].append((base + end - n, at - n, n))
    for (d, k), runs in found.items():
        doc = codes[starts[d] : starts[d + 1] - 1].tolist()
        every = passages(doc, index.item(k), runs, limits)
        hits = leaked(every, limits)
        if hits:
            spans = [m.span() for m in WORD.finditer(texts[d].lower())]
            same = len(texts[d].lower()) == len(texts[d])
            if not same:  # lower-casing changed the length: find the words again, one by one
                spans = _spans(texts[d])
            for s, e, i, j in every if whole else hits:
                yield k, names[d], spans[s][0], spans[e - 1][1], j - i


def _spans(text: str) -> list[tuple[int, int]]:
    """Places of the lower-cased text's words in the text itself."""
    origin = [i for i, c in enumerate(text) for _ in c.lower()]
    return [(origin[m.start()], origin[m.end() - 1] + 1) for m in WORD.finditer("".join(c.lower() for c in text))]


def _cutter(shared: Broadcast, limits: Limits) -> Callable[[Column], Column]:
    """A column function: ``struct<text, gone>``, the text without its leaked passages and the number of characters taken out."""

    @F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("gone", T.LongType())]))
    def cut(texts: pd.Series) -> pd.DataFrame:
        known = [t or "" for t in texts]
        size = [0] * len(known)
        left = list(range(len(known)))
        while left:  # what a cut brings together may be a passage again
            spans: dict[int, list[tuple[int, int]]] = defaultdict(list)
            for some in _lots([known[d] for d in left]):
                for _, d, s, e, _ in _scan(left[some], [known[d] for d in left[some]], shared.value, limits, whole=True):
                    spans[d].append((s, e))
            for d, own in spans.items():
                t, at, pieces = known[d], 0, []
                for s, e in sorted(own):
                    a, e = max(s, at), max(e, at)
                    pieces.append(t[at:a])
                    size[d] += e - a
                    at = e
                known[d] = " ".join([*pieces, t[at:]])
            left = sorted(spans)
        return pd.DataFrame({"text": pd.Series(known, dtype=object), "gone": pd.Series(size, dtype="int64")})

    return cut


def remove_leaks(documents: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", limits: Limits = Limits(), most: int = 500_000, most_share: float = 0.5, lots: int = 8) -> DataFrame:
    """The documents with all passages of each leaked item replaced by one blank each, in the pass that finds them, without a shuffle of the texts.

    Cutting goes on until the document leaks nothing of the items of one pass (see ``find_leaks``).
    A document of which more than ``most_share`` of the characters would go is dropped as a whole. Documents without leaks stay as
    they are, those with a NULL or empty text too; all columns stay. Items of several passes are removed one pass after the
    other.
    """
    spark = ship(documents.sparkSession)
    kept, whole, gone = (max([stem, *(c + "_" for c in documents.columns if c.startswith(stem))], key=len) for stem in ("__kept", "__whole", "__gone"))
    out = documents.withColumns({whole: F.length(text), gone: F.lit(0).cast("long")})
    for index in _indexes(item_words(items, item, item_text), most, lots):
        shared = spark.sparkContext.broadcast(index)
        out = out.withColumn(kept, _cutter(shared, limits)(F.col(text)))
        out = out.withColumns({gone: F.col(gone) + F.col(f"{kept}.gone"), text: F.when(F.col(text).isNotNull(), F.col(f"{kept}.text"))})
        out = out.filter(F.col(text).isNull() | (F.col(whole) == 0) | (F.col(gone) <= most_share * F.col(whole)))
    return out.select(*documents.columns)
