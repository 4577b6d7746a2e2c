"""Personal information in free text, found by a linear-chain conditional random field.

A line is cut into tokens (runs of letters, runs of digits, single marks). Each token type is turned into a few word-shape features
of its own spelling, and the weights of these features at the places -3 .. 3 around a token add up to its score for each
label (BIO over five kinds). The field is trained on a small labelled table by stochastic gradient ascent on the conditional
likelihood, and decoded by Viterbi over batches of lines in NumPy. A span then has to pass its kind's plain form.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspace.llm.pii_examples import labelled_lines
from loomspace.llm.packing import vocabulary_folder
from loomspace.plans.runtime import ship

KINDS = ("email", "phone", "idnum", "street", "name")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
TOKEN = re.compile(r"[^\W\d_]+|\d+|\S")
OFFSETS = (-3, -2, -1, 0, 1, 2, 3)
ABBREVIATED = ("st", "rd", "ave", "blvd", "str", "sq", "pl", "dr", "ln", "ct")
ENDINGS = ("weg", "aße", "sse", "tr", "lee", "atz")
VOCABULARY = f"{vocabulary_folder()}/word_bpe_49k.json"
PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "idnum": "[ID_NUMBER]", "street": "[STREET]", "name": "[NAME]"}
TWO_WORDS = re.compile(r"[\w'’.,-] [^\W\d_]")
SIX_DIGITS = re.compile(r"(?:\d[^\w\n]{0,2}){5}\d")
LETTER, DIGIT = re.compile(r"[^\W\d_]"), re.compile(r"\d")
#: Plain forms. Lengths are bounded (a word of a name by 60 letters, an address by the mail standard), which keeps the search linear.
FORMS = {
    "email": re.compile(r"[\w.+-]{1,64}(?:@| ?[\[(]at[\])] ?| at )[\w-]{1,63}(?:(?:\.| dot )[\w-]{1,63}){0,7}(?:\.| dot )[^\W\d_]{2,63}(?![\w-])", re.I),
    "phone": re.compile(r"(?<![\w+])\+?\(?\d(?:[ ()./-]{0,2}\d){6,14}(?!\w|\.\.)"),
    "idnum": re.compile(r"(?<!\w)(?:[A-Z]{1,2} ?)?\d(?:[ -]?\d){5,12}(?: ?[A-Z])?(?![\w-]|\.\.)"),
    "street": re.compile(r"(?<!\w)(?:\d{1,5}[a-z]?(?: [^\W\d_](?:[\w'’-]{0,60}\w)?\.?){1,5}|[^\W\d_](?:[\w'’-]{0,60}\w)?\.?(?: \w(?:[\w'’-]{0,60}\w)?\.?){0,4},? \d{1,5}[a-z]?)(?!\w)"),
    "name": re.compile(r"(?:[^\W\d_][\w'’-]{0,60}\.?,? ){1,4}[^\W\d_][\w'’-]{0,60}"),
}


def may_hold(line: str) -> bool:
    """A necessary condition of all forms: an at-sign, two words with a blank between them (also of a spelled-out address), a digit and a letter
    (street), or six digits with little between them (phone, personal number). Lines without any of it can't hold a value."""
    return "@" in line or TWO_WORDS.search(line) is not None or (DIGIT.search(line) is not None and (LETTER.search(line) is not None or SIX_DIGITS.search(line) is not None)) or "at" in line.lower()


class NameList:
    """Known given names as sorted 64-bit hashes: eight bytes a name, however long the list."""

    def __init__(self, names: Iterable[str]):
        self.hashes = np.unique(np.fromiter((self.hash(n.lower()) for n in names), np.uint64))

    @staticmethod
    def hash(name: str) -> int:
        return int.from_bytes(blake2b(name.encode(), digest_size=8).digest(), "big")

    def __contains__(self, low: str) -> bool:
        if not len(self.hashes):
            return False
        h = np.uint64(self.hash(low))
        at = int(np.searchsorted(self.hashes, h))
        return at < len(self.hashes) and self.hashes[at] == h


def shape_features(token: str, given: NameList, words: frozenset[str], common: frozenset[str] = frozenset()) -> list[str]:
    """Features of a token's own spelling."""
    low = token.lower()
    if token.isdigit():
        return ["digits", f"digits{min(len(token), 14)}", f"first{token[0]}", f"known:{token}" if token in words else "rare digits"]
    if not token[0].isalpha():
        return [f"mark:{token}"]
    case = "lower" if token == low else "upper" if token == token.upper() else "capital" if token[0].isupper() and token[1:] == low[1:] else "mixed"
    if len(token) == 1:
        case = f"one {case}"
    out = [case, f"{case} length{min(len(token), 6)}", f"end:{low[-3:]}" if low[-3:] in words or low[-3:] in ENDINGS else "end", f"word:{low}" if low in words else f"rare {case}"]
    if low in given:
        out.append(f"given {case}")
    if not token.isascii():
        out.append(f"accent {case}")
    if low in common:
        out.append(f"common {case}")
    return out


@dataclass
class Tagger:
    """Weights ``unary[offset, feature, label]`` and ``chain[label, label]``; row 0 of the features stands for line ends."""

    features: dict[str, int]
    words: frozenset[str]
    given: NameList
    common: frozenset[str]
    unary: np.ndarray
    chain: np.ndarray
    memo: dict[str, int] = field(default_factory=dict)
    rows: dict[tuple[int, ...], int] = field(default_factory=dict)
    table: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"memo": {}, "rows": {}, "table": None}

    def row(self, token: str) -> int:
        """Row of the token's scores in ``table``; tokens with the same features share it."""
        key = tuple(self.features[f] for f in shape_features(token, self.given, self.words, self.common) if f in self.features)
        n = self.rows.get(key)
        if n is None:
            n = self.rows[key] = len(self.rows) + 1
            if n == len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[n] = self.unary[:, list(key)].sum(axis=1)
        return n

    def types(self, tokens: list[str]) -> np.ndarray:
        if self.table is None:
            self.table = np.zeros((4096, len(OFFSETS), len(LABELS)), np.float32)
            self.table[0] = self.unary[:, 0]
        if len(self.memo) > 500_000:  # bounded memory however many spellings the corpus has
            self.memo = {}
        memo = self.memo
        for t in set(tokens) - memo.keys():
            memo[t] = self.row(t)
        return np.fromiter(map(memo.__getitem__, tokens), np.int64, len(tokens))

    def decode(self, lines: list[list[str]]) -> dict[int, np.ndarray]:
        """Best labels of the tokenised lines that have any label but O, by the line's number.

        A line whose every token prefers O by more than any two transitions can make up for has O throughout on the best path
        and is left out of the Viterbi steps.
        """
        out: dict[int, np.ndarray] = {}
        reach = OFFSETS[-1]
        gain = 2 * max(0.0, float((self.chain - self.chain[0, 0]).max()))
        at = 0
        while at < len(lines):
            end, tokens = at, 0
            while end < len(lines) and (end == at or tokens + len(lines[end]) + reach <= 200_000):
                tokens += len(lines[end]) + reach
                end += 1
            size = np.array([len(x) for x in lines[at:end]])
            flat = self.types([t for x in lines[at:end] for t in x])
            # lines one after the other with `reach` edge rows before each and after the last
            start = np.cumsum(size + reach) - size
            place = np.arange(len(flat)) + np.repeat(start - (np.cumsum(size) - size), size)
            strip = np.zeros(int(size.sum()) + reach * (len(size) + 1), np.int64)
            strip[place] = flat
            score = np.zeros((len(strip) - 2 * reach, len(LABELS)), np.float32)
            for k, o in enumerate(OFFSETS):
                score += self.table[strip[reach + o : len(strip) - reach + o], k]
            start = start - reach
            lead = score[:, 1:].max(axis=1) - score[:, 0]
            full = np.flatnonzero(size > 0)
            if len(full):
                bounds = np.stack([start[full], start[full] + size[full]], axis=1).ravel()
                most = np.maximum.reduceat(np.concatenate([lead, [-np.inf]]), bounds)[::2]
                open_lines = full[most + gain >= 0]
                for i, path in self._viterbi(score, start[open_lines], size[open_lines]):
                    out[at + int(open_lines[i])] = path
            at = end
        return out

    def _viterbi(self, score: np.ndarray, start: np.ndarray, size: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        chain = self.chain.astype(np.float32)
        order = np.argsort(-size, kind="stable")
        lo = 0
        while lo < len(order):
            width = int(size[order[lo]])
            own = order[lo : lo + max(1, min(512, 400_000 // width))]  # one very long line makes a batch of its own
            lo += len(own)
            n = size[own]
            back = np.zeros((len(own), width, len(LABELS)), np.int8)
            best = score[start[own]]
            final = best.copy()
            live = len(own)
            for t in range(1, width):
                while n[live - 1] <= t:  # sorted by length: the short ones are done
                    live -= 1
                step = best[:live, :, None] + chain
                pick = step.argmax(axis=1)
                back[:live, t] = pick
                best = np.take_along_axis(step, pick[:, None], 1)[:, 0] + score[start[own[:live]] + t]
                final[:live] = best
            label = final.argmax(axis=1)
            path = np.zeros((len(own), width), np.int8)
            every = np.arange(len(own))
            for t in range(width - 1, -1, -1):
                here = n > t
                path[here, t] = label[here]
                if t:
                    label = np.where(here, back[every, t, label], label)
            for j in np.flatnonzero(path.any(axis=1)).tolist():
                yield int(own[j]), path[j, : n[j]]


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis=axis))


def train(examples: list[tuple[str, list[tuple[int, int, str]]]], given: NameList, common: frozenset[str] = frozenset(), epochs: int = 12, batch: int = 64, rate: float = 0.1, decay: float = 2e-5, seed: int = 2) -> Tagger:
    """Fit the field to labelled lines (Adam on the negative conditional log-likelihood, with weight decay)."""
    tokenised = [[(m.group(), m.span()) for m in TOKEN.finditer(t)] for t, _ in examples]
    count: dict[str, int] = {}
    for (_, spans), toks in zip(examples, tokenised, strict=True):
        for t, (a, _) in toks:
            if not any(s <= a < e and k in ("name", "email") for s, e, k in spans):
                count[t.lower()] = count.get(t.lower(), 0) + 1
    words = frozenset(w for w, c in count.items() if c >= 12)
    index: dict[str, int] = {"<edge>": 0}
    rows, gold = [], []
    for (_, spans), toks in zip(examples, tokenised, strict=True):
        rows.append([[index.setdefault(f, len(index)) for f in shape_features(t, given, words, common)] for t, _ in toks])
        y = np.zeros(len(toks), np.int64)
        for s, e, k in spans:
            inside = [i for i, (_, (a, b)) in enumerate(toks) if s <= a and b <= e]
            for j, i in enumerate(inside):
                y[i] = LABELS.index(f"{'I' if j else 'B'}-{k}")
        gold.append(y)
    n_labels, reach = len(LABELS), OFFSETS[-1]
    unary = np.zeros((len(OFFSETS), len(index), n_labels))
    chain = np.zeros((n_labels, n_labels))
    moments = [np.zeros_like(p) for p in (unary, unary, chain, chain)]
    rng, step = np.random.default_rng(seed), 0
    lengths = np.array([len(r) for r in rows])
    steps = epochs * -(-int((lengths > 0).sum()) // batch)
    for _ in range(epochs):
        shuffled = rng.permutation(np.flatnonzero(lengths > 0))
        shuffled = shuffled[np.argsort(lengths[shuffled] // 4, kind="stable")]
        lots = [shuffled[i : i + batch] for i in range(0, len(shuffled), batch)]
        rng.shuffle(lots)
        for own in lots:
            size, width, n = lengths[own], int(lengths[own].max()), len(own)
            lot = np.concatenate([np.repeat([[i, j] for j in range(lengths[x])], [len(f) for f in rows[x]], axis=0) for i, x in enumerate(own)])
            feats = np.concatenate([np.concatenate(rows[x]) for x in own]).astype(np.int64)
            score = np.zeros((n, width, n_labels))
            ends = np.array([[i, j] for i in range(n) for j in (*range(-reach, 0), *range(size[i], size[i] + reach))])
            all_at, all_f = np.concatenate([lot, ends]), np.concatenate([feats, np.zeros(len(ends), np.int64)])
            reached = []
            for k, o in enumerate(OFFSETS):
                t = all_at[:, 1] - o
                ok = (t >= 0) & (t < size[all_at[:, 0]])
                reached.append((all_at[ok, 0], t[ok], all_f[ok]))
                np.add.at(score, (all_at[ok, 0], t[ok]), unary[k, all_f[ok]])
            alpha = np.zeros((n, width, n_labels))
            beta = np.zeros((n, width, n_labels))
            alpha[:, 0] = score[:, 0]
            for t in range(1, width):
                alpha[:, t] = _logsumexp(alpha[:, t - 1, :, None] + chain, 1) + score[:, t]
            for t in range(width - 2, -1, -1):
                inner = _logsumexp(chain + (score[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
                beta[:, t] = np.where((size > t + 1)[:, None], inner, 0.0)
            z = _logsumexp(alpha[np.arange(n), size - 1], 1)
            real = np.arange(width) < size[:, None]
            error = np.where(real[..., None], np.exp(np.minimum(alpha + beta - z[:, None, None], 0.0)), 0.0)
            for i, x in enumerate(own):
                error[i, np.arange(size[i]), gold[x]] -= 1
            g_unary, g_chain = np.zeros_like(unary), np.zeros_like(chain)
            for k, (i, t, f) in enumerate(reached):
                np.add.at(g_unary[k], f, error[i, t])
            for t in range(1, width):
                pair = alpha[:, t - 1, :, None] + chain + (score[:, t] + beta[:, t])[:, None, :] - z[:, None, None]
                g_chain += np.exp(np.minimum(pair[size > t], 0.0)).sum(axis=0)
            for x in own:
                np.add.at(g_chain, (gold[x][:-1], gold[x][1:]), -1)
            step += 1
            slower = rate * max(0.02, 1 - step / steps)
            for p, g, m, v in ((unary, g_unary, moments[0], moments[1]), (chain, g_chain, moments[2], moments[3])):
                g = g / n + decay * p
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= slower * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Tagger(index, words, given, common, unary.astype(np.float32), chain)


@lru_cache(maxsize=4)
def common_words(path: str) -> frozenset[str]:
    """The whole words of a public vocabulary file with word ends: what is in there is rarely a surname. Empty if there is no such file."""
    if not os.path.exists(path):
        return frozenset()
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    return frozenset(t[:-4] for t in vocabulary if t.endswith("</w>") and len(t) > 6 and t[:-4].isalpha())


@lru_cache(maxsize=4)
def default_weights(names: tuple[str, ...], vocabulary: str, copies: int = 6, seed: int = 1) -> Tagger:
    """The tagger trained on the package's own labelled table, with surrogates from the given names; kept for the process."""
    common = common_words(vocabulary)
    return train(labelled_lines(list(names), copies, seed, tuple(sorted(common))), NameList(names), common)


def default_tagger(given_names: DataFrame, given: str, vocabulary: str, training_names: int = 2_000, most_names: int = 20_000_000) -> Tagger:
    """``default_weights`` with all given names of the table.

    The training draws its surrogates from at most ``training_names`` of them, chosen by hash. All names become a feature; the list takes
    eight bytes a name, and one of more than ``most_names`` is refused rather than cut.
    """
    names = given_names.select(F.trim(given).alias("g")).filter("g IS NOT NULL AND g <> ''").distinct()
    rows = names.count()
    if rows > most_names:
        raise ValueError(f"{rows} given names; at most {most_names} can be broadcast")
    known = names.toPandas()["g"].tolist()
    drawn = sorted(sorted(known, key=NameList.hash)[:training_names])
    return replace(default_weights(tuple(drawn), vocabulary), given=NameList(known), memo={}, rows={}, table=None)


def spans_of(text: str, spans: list[tuple[int, int]], labels: np.ndarray) -> Iterator[tuple[int, int, str]]:
    """Maximal labelled spans of one line that pass their kind's form, cut to the form."""
    at = 0
    while at < len(labels):
        if labels[at] == 0:
            at += 1
            continue
        kind = LABELS[labels[at]][2:]
        end = at + 1
        while end < len(labels) and LABELS[labels[end]] == f"I-{kind}":
            end += 1
        a, e = spans[at][0], spans[end - 1][1]
        if kind != "street":  # never part of a run without blanks
            a, e = _run(text, a, e, "-'’" if kind == "name" else "_.+-@")
        elif text[e : e + 1] == "." and text[a:e].lower().rpartition(" ")[2] in ABBREVIATED:
            e += 1
        m = FORMS[kind].search(text, a, e)
        if m:
            yield m.start(), m.end(), kind
        at = end


def _run(text: str, a: int, e: int, marks: str, most: int = 100) -> tuple[int, int]:
    """The span widened to the edges of the runs of letters, digits and inner marks in which it begins and ends."""
    lo, hi = a, e
    while lo > 0 and a - lo < most and (text[lo - 1].isalnum() or text[lo - 1] in marks):
        lo -= 1
    while hi < len(text) and hi - e < most and (text[hi].isalnum() or text[hi] in marks):
        hi += 1
    while lo < a and not text[lo].isalnum() and not (text[lo] == "+" and text[lo + 1].isdigit()):  # no mark in front, but for a phone's plus
        lo += 1
    while hi > e and not text[hi - 1].isalnum():
        hi -= 1
    return lo, hi


def lots_of(texts: list[str], most: int = 4_000_000) -> Iterator[slice]:
    """Runs of neighbouring texts of at most ``most`` characters together (a longer text is a run of its own)."""
    lo = size = 0
    for i, t in enumerate(texts):
        if i > lo and size + len(t) > most:
            yield slice(lo, i)
            lo, size = i, 0
        size += len(t)
    if texts:
        yield slice(lo, len(texts))


def tag_texts(texts: list[str], tagger: Tagger) -> list[list[tuple[int, int, str]]]:
    """Spans (start, end, kind) of each text, in order."""
    found: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    where, lines = [], []
    for n, t in enumerate(texts):
        start = 0
        for line in t.split("\n"):
            if may_hold(line):
                where.append((n, start, line))
                lines.append(TOKEN.findall(line))
            start += len(line) + 1
    for i, labels in sorted(tagger.decode(lines).items()):
        n, start, line = where[i]
        places = [m.span() for m in TOKEN.finditer(line)]
        found[n] += [(start + a, start + e, k) for a, e, k in spans_of(line, places, labels)]
    return found


def find_personal(documents: DataFrame, given_names: DataFrame, document: str = "doc_id", text: str = "text", given: str = "given_name", vocabulary: str | None = None) -> DataFrame:
    """Each place of personal information: ``document, kind, value, start, end``.

    ``value`` is written exactly as in the text. NULL and empty texts hold nothing; whole texts are read, however long; a NULL
    document id is left out; repeated rows give repeated places; other columns are ignored; an empty table gives no rows. An empty
    list of given names only takes that feature away. ``vocabulary``: a public vocabulary file with word ends (``VOCABULARY`` if None).
    """
    spark = ship(documents.sparkSession)
    shared = spark.sparkContext.broadcast(default_tagger(given_names, given, VOCABULARY if vocabulary is None else vocabulary))
    schema = T.StructType([documents.schema[document], T.StructField("kind", T.StringType()), T.StructField("value", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tagger = shared.value
        for b in batches:
            ids, texts = b["__d"].tolist(), b["__x"].tolist()
            for lot in lots_of(texts):
                found = tag_texts(texts[lot], tagger)
                rows = [(i, k, t[a:e], a, e) for i, t, own in zip(ids[lot], texts[lot], found, strict=True) for a, e, k in own]
                yield pd.DataFrame(rows, columns=schema.fieldNames())

    corpus = documents.filter(F.col(document).isNotNull() & F.col(text).isNotNull() & (F.col(text) != "")).select(F.col(document).alias("__d"), F.col(text).alias("__x"))
    return corpus.mapInPandas(scan, schema)


def redact(documents: DataFrame, given_names: DataFrame, text: str = "text", given: str = "given_name", vocabulary: str | None = None) -> DataFrame:
    """The documents with every value replaced by its kind's placeholder; NULL stays NULL, all columns stay."""
    spark = ship(documents.sparkSession)
    shared = spark.sparkContext.broadcast(default_tagger(given_names, given, VOCABULARY if vocabulary is None else vocabulary))

    @F.pandas_udf(T.StringType())
    def replaced(texts: pd.Series) -> pd.Series:
        known = [t or "" for t in texts]
        out = []
        for lot in lots_of(known):
            for t, own in zip(known[lot], tag_texts(known[lot], shared.value), strict=True):
                at, kept = 0, []
                for a, e, k in own:
                    kept += [t[at:a], PLACEHOLDER[k]]
                    at = e
                out.append("".join([*kept, t[at:]]))
        return pd.Series(out, dtype=object)

    return documents.withColumn(text, F.when(F.col(text).isNotNull(), replaced(F.col(text))))
