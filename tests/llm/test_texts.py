"""Packing, leaks and personal information."""

import random
import time
from dataclasses import replace
from zlib import crc32

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomspace.llm.leakage import GAP, ItemIndex, Limits, SuffixAutomaton, _scan, find_leaks, leaked, passages, remove_leaks
from loomspace.llm.packing import BestFit, byte_tokens, pack, vocabulary_folder, vocabulary_tokens
from loomspace.llm.pii import FORMS, KINDS, VOCABULARY, NameList, common_words, default_tagger, default_weights, find_personal, may_hold, redact, tag_texts, train
from loomspace.llm.pii_examples import labelled_lines, templates

NAMES = ["Grace", "Mark", "Tereska", "Omar", "Elif"]

# packing ------------------------------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=80), st.integers(1, 6))
def test_best_fit_keeps_capacity_and_bounds(sizes, open_bins):
    bins, filled, spans = BestFit(50, open_bins), {}, {}
    for n in sizes:
        number, start = bins.put(n)
        assert filled.get(number, 0) == start
        filled[number] = start + n
        assert filled[number] <= 50
        assert 0 <= bins.open <= open_bins
        spans.setdefault(number, []).append(n)
    assert sum(filled.values()) == sum(sizes)


def test_best_fit_takes_the_tightest_bin_and_closes_the_fullest():
    bins = BestFit(10, 2)
    assert bins.put(4) == (0, 0)
    assert bins.put(7) == (1, 0)
    assert bins.put(3) == (1, 7)  # exact fit in the tighter one, which then is full
    assert bins.put(8) == (2, 0)  # bins 0 (6 free) and 2 (2 free) are open
    assert bins.put(7) == (3, 0)  # no room: bin 2, the fullest, closes
    assert bins.put(6) == (0, 4)


def test_pack_round_trip(spark):
    rows = [(1, "a" * 9), (2, None), (3, ""), (4, "b" * 47), (5, "é" * 4), (5, "é" * 4), (None, "x"), (6, "c" * 19)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("__size", F.lit("extra")).coalesce(1)
    got = pack(df, "doc_id", byte_tokens(F.col("text")), 20, open_bins=3).collect()
    size = {1: 10, 3: 1, 4: 48, 5: 9, 6: 20}
    per = {}
    for r in got:
        per[r["doc_id"]] = per.get(r["doc_id"], 0) + r["tokens"]
    assert per == {**size, 5: 18}
    assert {r["doc_id"] for r in got if r["pieces"] > 1} == {4}
    assert sorted((r["piece"], r["tokens"]) for r in got if r["doc_id"] == 4) == [(0, 20), (1, 20), (2, 8)]
    used = {}
    for r in sorted(got, key=lambda r: (r["container"], r["start"])):
        assert used.get(r["container"], 0) == r["start"]
        used[r["container"]] = r["start"] + r["tokens"]
    assert max(used.values()) <= 20


def test_pack_empty_and_many(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pack(empty, "doc_id", byte_tokens(F.col("text")), 20).count() == 0
    many = spark.range(20000).select(F.col("id").alias("doc_id"), (F.pmod(F.xxhash64("id"), F.lit(900)) + 1).alias("n")).repartition(3)
    got = pack(many, "doc_id", F.col("n"), 4096)
    bins, tokens = got.select(F.count_distinct("container"), F.sum("tokens")).first()
    assert tokens / (bins * 4096) > 0.98


def test_vocabulary_tokens(spark):
    df = spark.createDataFrame([("hello world",), (None,), ("",)], "text string").coalesce(1)
    for name in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"):
        got = [r[0] for r in df.select(vocabulary_tokens(f"{vocabulary_folder()}/{name}")(F.col("text"))).collect()]
        assert got[0] >= 3 and got[1] is None and got[2] == 1


# leaks --------------------------------------------------------------------------------------------------------------

WORDS = [f"w{i}" for i in range(400)]


def _passage(seed, n):
    return random.Random(seed).sample(WORDS, n)


@pytest.fixture(scope="module")
def items(spark):
    shared = "Read this shared sentence with care and then answer the question in one short line of text."
    rows = [(1, " ".join(_passage(1, 40)) + "."), (2, shared + "\n" + " ".join(_passage(2, 50)) + "."), (3, shared + "\n" + " ".join(_passage(3, 45)) + "."), (4, None), (5, ""), (1, " ".join(_passage(1, 40)) + "."), (None, " ".join(_passage(9, 40)))]
    return spark.createDataFrame(rows, "item_id long, text string").withColumn("words", F.lit(1))


def _documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit(0)).withColumn("__kept", F.lit(0))


def test_suffix_automaton_finds_all_longest_matches():
    rng = random.Random(5)
    lots = [(i, [rng.choice("abcd") for _ in range(30)]) for i in range(6)]
    auto = SuffixAutomaton(lots)
    for _ in range(200):
        text = [rng.choice("abcd") for _ in range(12)]
        for end, n, state in auto.runs([auto.ids[c] for c in text], 3):
            run = text[end - n : end]
            want = {(k, i + n) for k, (_, w) in enumerate(lots) for i in range(len(w) - n + 1) if w[i : i + n] == run}
            assert want and set(auto.places(state)) == want
            if end < len(text):
                longer = text[end - n : end + 1]
                assert not any(w[i : i + n + 1] == longer for _, w in lots for i in range(len(w)))


def test_automaton_is_compact():
    rng = random.Random(9)
    words = [f"w{rng.randrange(20_000)}" for _ in range(100_000)]
    auto = SuffixAutomaton([(i, words[i * 500 : i * 500 + 500]) for i in range(200)])
    assert auto.nbytes <= 80 * len(words)


def test_each_item_has_its_own_maximal_runs():
    rng = random.Random(6)
    for _ in range(30):
        lots = [(i, [rng.choice(["a", "b", "c", GAP] if i % 2 else "abc") for _ in range(25)]) for i in range(5)]
        auto = SuffixAutomaton(lots)
        text = [rng.choice("abc") for _ in range(40)]
        want = set()
        for k, (_, w) in enumerate(lots):
            for d in range(len(text)):
                for i in range(len(w)):
                    n = 0
                    while d + n < len(text) and i + n < len(w) and text[d + n] == w[i + n]:
                        n += 1
                    if n >= 3 and (not d or not i or text[d - 1] != w[i - 1]):
                        want.add((d + n, n, k, i + n))
        got = list(auto.own_runs([auto.ids[c] for c in text], 3))
        assert len(got) == len(set(got)) and set(got) == want


def test_overlapping_items_are_all_found():
    a = _passage(1, 30)
    near = [w if i % 12 != 9 else f"other{i}" for i, w in enumerate(a)]
    auto = ItemIndex([[(1, a), (2, a[:25] + _passage(2, 50)[:10])], [(3, near)]])
    for text in (" ".join(a), "head " + " ".join(a) + " tail"):
        assert {k for k, *_ in _scan([0], [text], auto, Limits())} == {0, 1, 2}
    assert {k for k, *_ in _scan([0], [" ".join(near)], auto, Limits())} == {0, 1, 2}


def test_find_leaks(spark, items):
    p1, p2, p3 = _passage(1, 40), _passage(2, 50), _passage(3, 45)
    noise = " ".join(f"z{i}" for i in range(30))
    altered = p1[:]
    altered[10] = altered[19] = altered[28] = "changed"
    often = [w if i % 4 else "changed" for i, w in enumerate(p1)]
    rows = [
        (10, f"+# {noise}\n+# " + "\n+# ".join(" ".join(p1[i : i + 6]).upper() + "," for i in range(0, 40, 6))),
        (11, noise + " " + " ".join(altered)),
        (12, noise + " " + " ".join(p2[3:23]) + " " + noise),
        (13, " ".join(p2[:13]) + " " + noise + " " + " ".join(p2[30:44])),
        (14, " ".join(p2[30:44]) + " " + noise + " " + " ".join(p2[:13])),  # in the wrong order
        (15, " ".join(p3[:11]) + " " + noise + " " + " ".join(p3[20:31])),  # runs too short
        (16, "Read this shared sentence with care and then answer the question in one short line of text."),
        (17, " ".join(often)),
        (18, None), (19, ""), (None, " ".join(p1)),
        (20, "İ " * 5 + " ".join(p1)),  # lower-casing changes its length
        (21, " ".join(p1) + " " + noise * 20000 + " " + " ".join(p3)),
    ]
    got = find_leaks(_documents(spark, rows), items).collect()
    assert {(r["item_id"], r["doc_id"]) for r in got} == {(1, 10), (1, 11), (2, 12), (2, 13), (1, 20), (1, 21), (3, 21)}
    text = dict(rows)
    for r in got:
        piece = text[r["doc_id"]][r["start"] : r["end"]]
        assert piece.split()[0].strip("+#,").lower() in (p1 + p2 + p3) and r["words"] >= 12
    for lots in (1, 8):  # a pass for each automaton, or one for all
        sharded = find_leaks(_documents(spark, rows), items, most=45, lots=lots).collect()
        assert {tuple(r) for r in sharded} == {tuple(r) for r in got}


def test_leaks_of_empty_tables(spark, items):
    none = _documents(spark, [])
    assert find_leaks(none, items).count() == 0
    assert find_leaks(_documents(spark, [(1, "a b c")]), items.limit(0)).count() == 0
    assert remove_leaks(none, items).count() == 0


def test_remove_leaks(spark, items):
    p1 = _passage(1, 40)
    tail = " ".join(f"z{i}" for i in range(200))
    rows = [(1, "head " + " ".join(p1) + " " + tail), (2, "head " + " ".join(p1)), (3, "untouched"), (4, None), (5, "")]
    df = _documents(spark, rows)
    got = {r["doc_id"]: r["text"] for r in remove_leaks(df, items).collect()}
    assert got == {1: "head   " + tail, 3: "untouched", 4: None, 5: ""}
    assert remove_leaks(df, items).columns == df.columns


@pytest.mark.parametrize(
    ("change", "want"),
    [
        ([12, "+", "+", "+", "+", 12], [12, 12]),
        ([20, "-", "-", "-", "-", 5], [20]),
        ([5, "-", "-", "-", "-", 20], [20]),
        ([5, "-", "-", 5, "-", 20], [33]),
        ([8, "-", 7, "-", "-", "-", "-", 7, "-", 8], [16, 16]),  # both with one word in sixteen altered
        ([12, "-", "-", "-", "-", 3, "-", "-", "-", 12], [12, 12]),
        ([7, "-", 2, "-", 5, "-", 8], [25]),
        ([7, "-", 2, "-", 5], [16]),
        ([7, "-", 2, "-", 4], []),  # a word less, and two altered ones are too many
    ],
)
def test_passages_keep_to_the_rule_of_altered_words(change, want):
    doc, at = [], 0
    for c in change:  # so many words of the item, a word put in or a word replaced
        doc += range(at, at + c) if isinstance(c, int) else [-1]
        at += c if isinstance(c, int) else c == "-"
    runs, d, at = [], 0, 0
    for c in change:
        if isinstance(c, int) and c >= Limits().seed:
            runs.append((d, at, c))
        d += c if isinstance(c, int) else 1
        at += c if isinstance(c, int) else c == "-"
    found = passages(doc, list(range(at)), runs, Limits())
    assert sorted(j - i for _, _, i, j in found) == sorted(want)
    for s, e, i, j in found:
        assert doc[s] == i and doc[e - 1] == j - 1 and 8 * sum(w < 0 for w in doc[s:e]) <= j - i
    assert bool(leaked(found, Limits())) == (sum(sorted(want)[-2:]) >= 20)


def test_nothing_leaks_after_removal(spark, items):
    p1, p2 = _passage(1, 40), _passage(2, 50)
    noise = " ".join(f"z{i}" for i in range(300))
    rows = [
        (1, " ".join(p2[:22]) + " " + noise + " " + " ".join(p2[27:50])),  # two passages that each suffice
        (2, " ".join(p1) + " " + noise + " " + " ".join(p1)),  # two copies
        (3, noise + " " + " ".join([*p1[:10], *p1[20:40], *p1[10:20]]) + " " + noise),  # what is left around the cut is a passage
    ]
    left = remove_leaks(_documents(spark, rows), items)
    assert left.count() == 3 and find_leaks(left, items).count() == 0
    assert all(r["text"].split() == (noise.split() * (1 + (r["doc_id"] == 3))) for r in left.collect())


def test_limits_are_parameters(spark, items):
    rows = [(1, " ".join(_passage(1, 40)[:15]))]
    assert find_leaks(_documents(spark, rows), items).count() == 0
    assert find_leaks(_documents(spark, rows), items, limits=Limits(total=15)).count() == 1


# personal information -----------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tagger():
    return default_weights(tuple(NAMES), VOCABULARY)


def _scores(lines, got):
    """Recall and precision of each kind."""
    out = {}
    for kind in KINDS:
        want, have = ({(n, *v) for n, own in enumerate(rows) for v in own if v[2] == kind} for rows in ([s for _, s in lines], got))
        out[kind] = (len(want & have) / len(want), len(want & have) / max(1, len(have)))
    return out


def test_accuracy_on_held_out_templates():
    """Trained on one half of the templates and scored on the other, with given names and words of its own, either way round."""
    words = tuple(sorted(common_words(VOCABULARY)))
    for half in (0, 1):
        mine, other = ([t for t in templates() if crc32(t.encode()) % 2 == k] for k in (half, 1 - half))
        unseen = ["Ravi", "Zoltan", "Imogen", "Noor"]
        field = train(labelled_lines(NAMES, 6, 1, words, mine), NameList(NAMES), common_words(VOCABULARY))
        lines = labelled_lines(unseen, 3, 99, words, other)
        field = replace(field, given=NameList([*NAMES, *unseen]))
        for kind, (recall, precision) in _scores(lines, tag_texts([t for t, _ in lines], field)).items():
            print(f"half {half}: {kind} recall {recall:.3f} precision {precision:.3f}")
            assert recall >= 0.8 and precision >= 0.8, (kind, recall, precision)


def test_accuracy_on_own_templates(tagger):
    lines = labelled_lines(NAMES, copies=1, seed=77)
    for recall, precision in _scores(lines, tag_texts([t for t, _ in lines], tagger)).values():
        assert recall > 0.93 and precision > 0.93


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab Zé@.dot7 42-+()/,'[]\t_ß", max_size=40))
def test_skipped_lines_can_hold_nothing(line):
    if not may_hold(line):
        assert not any(form.search(line) for form in FORMS.values())


def test_name_list():
    names = NameList(["Ana", "ANA", "José", "Mark"])
    assert len(names.hashes) == 3 and "ana" in names and "josé" in names and "bob" not in names and "ana" not in NameList([])


def test_batched_decoding_equals_plain_viterbi(tagger):
    import numpy as np

    from loomspace.llm.pii import LABELS, OFFSETS, TOKEN

    lines = [TOKEN.findall(t) for t, _ in labelled_lines(NAMES, copies=1, seed=5)]
    got = tagger.decode(lines)
    for i, line in enumerate(lines):
        rows = [list(map(tagger.table.__getitem__, [tagger.types([t])[0]]))[0] for t in line]
        score = np.zeros((len(line), len(LABELS)))
        for t in range(len(line)):
            for k, o in enumerate(OFFSETS):
                score[t] += rows[t + o][k] if 0 <= t + o < len(line) else tagger.table[0][k]
        best, back = score[0], []
        for t in range(1, len(line)):
            step = best[:, None] + tagger.chain
            back.append(step.argmax(axis=0))
            best = step.max(axis=0) + score[t]
        total = best.max()
        path = got.get(i, np.zeros(len(line), int))
        mine = score[np.arange(len(line)), path].sum() + sum(tagger.chain[a, b] for a, b in zip(path, path[1:]))
        assert abs(total - mine) < 1e-3 * max(1, abs(total))


def test_find_and_redact(spark):
    text = "Author: Tereska Vou-Marel <tvoumarel@corp.example.net>\r\n\n    Thanks to Omar Kritasen for the report.\n    On-call number moved to +44 7700 900123, the old one is dead.\n# remote: git@forge.lattice.example:queue/socket.git\nindex 1a2b3c4..5d6e7f8 100644"
    rows = [(1, text), (2, None), (3, ""), (4, "plain words only"), (1, text), (None, text)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kind", F.lit(0)).withColumn("value", F.lit(0))
    names = spark.createDataFrame([(n,) for n in NAMES] + [(None,)], "given_name string")
    got = {tuple(r) for r in find_personal(df, names).select("doc_id", "kind", "value").distinct().collect()}
    assert got == {(1, "name", "Tereska Vou-Marel"), (1, "email", "tvoumarel@corp.example.net"), (1, "name", "Omar Kritasen"), (1, "phone", "+44 7700 900123")}
    clean = redact(df, names)
    assert clean.columns == df.columns and clean.count() == len(rows)
    by = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert by[1].startswith("Author: [NAME] <[EMAIL]>\r\n") and "moved to [PHONE], the old" in by[1] and "git@forge" in by[1]
    assert by[2] is None and by[3] == "" and by[4] == "plain words only"
    assert find_personal(df.limit(0), names).count() == 0
    with pytest.raises(ValueError):
        default_tagger(names, "given_name", VOCABULARY, most_names=2)


def test_very_long_lines_stay_fast(tagger):
    began = time.time()
    texts = ["7" * 300_000 + "x" * 300_000, "fooBar " + "12 " * 200_000, "Ab" * 200_000 + " 1", "9 " * 100_000 + "\nAuthor: Grace Veskamann"]
    got = tag_texts(texts, tagger)
    assert got[3][-1][2] == "name"
    assert time.time() - began < 60


def test_pack_very_long_text(spark):
    df = spark.createDataFrame([(1, "x" * 3_000_000), (2, "y")], "doc_id long, text string").coalesce(1)
    got = pack(df, "doc_id", byte_tokens(F.col("text")), 4096).collect()
    assert sum(r["tokens"] for r in got if r["doc_id"] == 1) == 3_000_001 and {r["pieces"] for r in got if r["doc_id"] == 1} == {733}
