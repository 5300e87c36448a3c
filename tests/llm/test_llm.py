"""The text operators against brute force, exact round trips and held-out accuracy, with edge cases."""

from __future__ import annotations

import collections
import html
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sentencepiece = pytest.importorskip("sentencepiece")
public_tokenizers = pytest.importorskip("public_tokenizers")

from fathomline.llm import decontaminate, html_extract, language_id, license_scan, near_dedup, pii, quality_rules, sentencepiece_codec, substring_dedup, token_counts  # noqa: E402
from fathomline.llm.components import connected_components  # noqa: E402

PATH = public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = "the of and on tide harbour light über été ñandú 中文 🙂 12 a b c".split()


def prose(rng: random.Random, n: int) -> str:
    return "".join(rng.choice(WORDS) + rng.choice([" ", " ", "  ", "\n", ", ", "\t", " "]) for _ in range(n))


def rows(seed: int = 1, n: int = 60):
    rng = random.Random(seed)
    base = [prose(rng, rng.choice([0, 1, 3, 15, 80, 300])) for _ in range(n)]
    out = []
    for i, t in enumerate(base):
        out.append((i, t, rng.choice(["en", "de", None]), rng.choice(["hot", "hot", "a", None]), len(t)))
    for i in range(n, n + 20):  # exact and near copies
        words = rng.choice(base).split(" ")
        if len(words) > 30 and rng.random() < 0.7:
            words[rng.randrange(len(words))] = "changed"
        t = " ".join(words)
        out.append((i, t, "en", "hot", len(t)))
    out += [(n + 20, None, None, None, None), (n + 21, "", "en", "a", 0), (n + 22, " \n\t ", "en", "a", 4), (n + 23, "x" * 5000, "en", "a", 5000), (n + 24, "MIT License " * 3000, "en", "a", 36000)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def split(t):
    return (t or "").encode().split()


# 1 ------------------------------------------------------------------------------------------------------------------


def test_encoding_is_the_librarys():
    m, sp = sentencepiece_codec.PieceModel(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)
    rng = random.Random(3)
    alphabet = list(" \n▁ab<0x>é中😀\ttheing\x00​.,!8") + ["▁▁", "tion", "  "]
    for _ in range(3000):
        s = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
        ids = sp.encode(s)
        assert m.encode(s) == ids
        assert m.decode(ids) == sp.decode(ids)
    for _ in range(500):
        ids = [rng.randrange(3, 400) for _ in range(rng.randint(1, 8))]
        assert m.decode(ids) == sp.decode(ids)


def test_encoding_table(spark, docs, empty):
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    got = sentencepiece_codec.encode(docs.withColumn("token_ids", F.lit(1)), PATH, decoded_col="decoded")
    assert got.columns[-2:] == ["token_ids_", "decoded"]
    for r in got.collect():
        assert r["token_ids_"] == sp.encode(r["text"] or "")
        assert r["decoded"] == (r["text"] or "")
    assert sentencepiece_codec.encode(empty, PATH).count() == 0
    ids = sentencepiece_codec.encode(docs, PATH)
    assert all(r["decoded"] == (r["text"] or "") for r in sentencepiece_codec.decode(ids, PATH).collect())


# 2 ------------------------------------------------------------------------------------------------------------------


def brute_substrings(docs_, w=13):
    first = {}
    for i, t in docs_:
        ws = split(t)
        for k in range(len(ws) - w + 1):
            key = tuple(ws[k : k + w])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, t in docs_:
        ws = split(t)
        gone = [False] * len(ws)
        for k in range(len(ws) - w + 1):
            if first[tuple(ws[k : k + w])] < i:
                gone[k : k + w] = [True] * w
        out.append((i, len(ws), sum(gone), b" ".join(x for x, g in zip(ws, gone, strict=True) if not g).decode()))
    return sorted(out)


def test_substring_dedup(spark, docs, empty):
    got = sorted(tuple(r) for r in substring_dedup.deduplicate(docs).collect())
    assert got == brute_substrings([(r[0], r[1]) for r in rows()])
    assert substring_dedup.deduplicate(empty).count() == 0
    twice = [(r[0] % 50, r[1]) for r in rows()]  # keys repeat
    got = sorted(tuple(r) for r in substring_dedup.deduplicate(spark.createDataFrame(twice, "doc_id bigint, text string")).collect())
    assert got == brute_substrings(twice)


def test_sketch_filters_at_its_load():
    """A block filled as shards_for() fills it: every repeat is seen, and few unique minimizers pass."""
    rng = np.random.default_rng(1)
    load = (substring_dedup.BYTES_A_COUNTER << substring_dedup.BLOCK_BITS) // 24
    once = rng.integers(0, 2**32, load, dtype=np.uint32)
    again = once[:1000]
    found = substring_dedup.estimated_twice([once[: load // 2], once[load // 2 :], again])
    assert found[:1000].all() and found[load:].all()
    assert found[1000:load].mean() < 0.05


@pytest.mark.parametrize("shards", [1, 64, 5000])
def test_many_shards(spark, shards):
    """However many shards there are, all windows found twice are estimated repeated and nearly no others."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    passage = " ".join(word() for _ in range(40))
    data = []
    for i in range(120):
        t = " ".join(word() for _ in range(300))
        data.append((i, f"{t} {passage} {word()}" if i % 3 == 0 else t))
    data += [(500, data[1][1]), (501, "few words"), (502, ""), (503, None)]
    df = spark.createDataFrame(data, "doc_id bigint, text string").withColumn("_mark", F.hash("text")).repartition(5)
    told = {r["key"]: r for r in substring_dedup.repeated_spans(substring_dedup.sketches(df, shards, "text", "doc_id")).collect()}
    assert len(told) == len(data)
    places = collections.defaultdict(list)
    for i, t in data:
        w = split(t)
        assert told[i]["n_words"] == len(w)
        for k in range(len(w) - 12):
            places[tuple(w[k : k + 13])].append((i, k))
    estimated = {(i, k) for i, r in told.items() for a, b in np.frombuffer(r["spans"] or b"", np.int32).reshape(-1, 2).tolist() for k in range(a, b)}
    repeated = {p for at in places.values() if len(at) > 1 for p in at}
    assert repeated <= estimated
    unique = sum(len(at) == 1 for at in places.values())
    assert len(estimated - repeated) < 0.1 * unique
    assert told[1]["same"] == told[500]["same"] != told[2]["same"]


# 3 ------------------------------------------------------------------------------------------------------------------


def test_myers_distance():
    def dp(p, t):
        prev = [0] * (len(t) + 1)
        for i in range(1, len(p) + 1):
            cur = [i]
            for j in range(1, len(t) + 1):
                cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (p[i - 1] != t[j - 1])))
            prev = cur
        return min(prev)

    rng = random.Random(2)
    for _ in range(500):
        p, t = ("".join(rng.choice("abc") for _ in range(rng.randint(a, 20))) for a in (1, 0))
        assert decontaminate.distance(p, t, 99)[0] == dp(p, t)


def test_contamination(spark, empty):
    rng = random.Random(5)
    letters = "abcdefghijklmnop"
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(3, 8)))
    items = [(i, " ".join(word() for _ in range(30))) for i in range(8)] + [(8, None), (9, "short")]
    filler = lambda: " ".join(word() for _ in range(200))
    docs_, want = [], set()
    for d in range(40):
        i = rng.randrange(8)
        t = items[i][1]
        if d % 4 == 0:
            want.add((d, i, 0))
            t = t.upper().replace(" ", ",\n", 3)
        elif d % 4 == 1:
            chars = list(t)
            for at in rng.sample(range(len(chars)), 5):
                chars[at] = "q" if chars[at] != " " else " "
            t = "".join(chars)
        elif d % 4 == 2:
            t = filler()
        else:
            docs_.append((d, filler()))
            continue
        docs_.append((d, f"{filler()} {t} {filler()}"))
    docs_ += [(40, None), (41, ""), (42, items[0][1])]
    want.add((42, 0, 0))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    table = spark.createDataFrame(docs_, "doc_id bigint, text string")
    got = {tuple(r) for r in decontaminate.leaks(table, bench).collect()}
    assert want <= got
    assert {d for d, _, _ in got} == {d for d in range(40) if d % 4 < 2} | {42}
    assert {r[0] for r in decontaminate.clean(table, bench).collect()} == {d for d, _ in docs_} - {d for d, _, _ in got}
    assert decontaminate.leaks(table, bench.where("false")).count() == 0
    assert decontaminate.leaks(empty, bench).count() == 0


def test_short_items_are_searched(spark):
    """Items too short for an edit: exact, as whole words, at any place, also where the document is as short."""
    bench = spark.createDataFrame([(1, "Why me?"), (2, "为什么"), (3, "me"), (4, "?!")], "item_id bigint, text string")
    docs_ = [(1, "why, ME"), (2, "so: why me now"), (3, "why men"), (4, "home me"), (5, "说 为什么 呢"), (6, "me"), (7, "why m"), (8, "?!")]
    got = decontaminate.leaks(spark.createDataFrame(docs_, "doc_id bigint, text string"), bench)
    assert sorted(map(tuple, got.collect())) == [(1, 1, 0), (1, 3, 0), (2, 1, 0), (2, 3, 0), (4, 3, 0), (5, 2, 0), (6, 3, 0)]


def test_blocks_of_items(spark, monkeypatch):
    """Many blocks find what one block finds, and clashing column names are carried through."""
    rng = random.Random(6)
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    items = [(i, text(12)) for i in range(12)]
    docs_ = [(i, f"{text(20)} {items[i % 12][1]} {items[(i * 5) % 12][1][:-2]} {text(20)}", i) for i in range(24)] + [(30, None, 0), (31, text(30), 0)]
    df = spark.createDataFrame(docs_, "doc_id bigint, text string, _text bigint").withColumn("_hits", F.lit(1)).withColumn("leaks", F.lit(2))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    one = sorted(map(tuple, decontaminate.leaks(df, bench).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 100)
    assert len(list(decontaminate.blocks(bench))) > 5
    assert sorted(map(tuple, decontaminate.leaks(df, bench).collect())) == one and len(one) >= 40
    brute = {(d, i) for d, t, _ in docs_ for i, x in items if t and decontaminate.distance(x, t, len(x) // 20)}
    assert {r[:2] for r in one} == brute
    left = decontaminate.clean(df, bench)
    assert left.columns == df.columns and sorted(r[0] for r in left.collect()) == [30, 31]


# 4 ------------------------------------------------------------------------------------------------------------------


def brute_near(docs_, size):
    sets = {}
    for i, t in docs_:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + size]) for j in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            shared = len(sets[a] & sets[b])
            if a < b and sets[a] and sets[b] and 100 * shared >= 80 * (len(sets[a]) + len(sets[b]) - shared):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i), find(i) == i) for i, s in sets.items())


def test_near_duplicates(spark, docs, empty):
    got = sorted(tuple(r) for r in near_dedup.near_duplicates(docs, size=4).collect())
    assert got == brute_near([(r[0], r[1]) for r in rows()], 4)
    assert near_dedup.near_duplicates(empty).count() == 0
    assert sorted(r[0] for r in near_dedup.keep_first(docs, size=4).collect()) == [r[0] for r in got if r[3]]


def test_near_duplicates_in_a_large_group(spark):
    """A group far larger than a bucket that is compared in full, whose members differ from each other."""
    rng = random.Random(9)
    base = [f"w{rng.randrange(9999)}" for _ in range(120)]
    docs_ = []
    for i in range(90):
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(9999)}"
        docs_.append((i, " ".join(w)))
    got = sorted(tuple(r) for r in near_dedup.near_duplicates(spark.createDataFrame(docs_, "doc_id bigint, text string"), size=4).collect())
    assert got == brute_near(docs_, 4)


def test_links_of_a_group_stay_below_its_size(spark):
    """Mutated copies of one text beside pairs just above and just below the threshold: a spanning set of links, no link lost."""
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(99999)}"
    base, docs_ = [word() for _ in range(150)], []
    for i in range(500):
        w = list(base)
        for _ in range(rng.randrange(6)):
            w[rng.randrange(len(w))] = word()
        docs_.append((i, " ".join(w)))
    for i in range(500, 700, 2):  # the first k of 100 shingles differ: 80 of 120 miss, 89 of 111 (80.2 %) link
        w = [word() for _ in range(103)]
        k = 11 if i % 4 else 12
        docs_ += [(i, " ".join(w)), (i + 1, " ".join([word() for _ in range(k)] + w[k:]))]
    df = spark.createDataFrame(docs_, "doc_id bigint, text string")
    reps, _, joints = near_dedup.representatives(near_dedup.sketch(df, "doc_id", "text", 4))
    likely, _ = near_dedup.likely_pairs(reps)
    made = near_dedup._sets(reps.select("doc"), df, "doc_id", "text", 4)
    assert near_dedup.spanning_links(likely, made).count() < len(docs_) and joints.count() == 0
    got = sorted(tuple(r) for r in near_dedup.near_duplicates(df, size=4).collect())
    assert got == brute_near(docs_, 4)
    assert sum(r[2] != r[0] for r in got if r[0] >= 500) == 50


def test_near_duplicates_with_repeated_keys(spark):
    """A key with two texts joins the groups of both; a null key is a document of its own."""
    a, b = (" ".join(f"{x}{i}" for i in range(30)) for x in "ab")
    docs_ = [(1, a), (2, b), (3, a), (3, b), (3, b), (4, a + " more"), (None, a), (5, None)]
    got = near_dedup.near_duplicates(spark.createDataFrame(docs_, "doc_id bigint, text string"), size=4).collect()
    assert sorted(((r[0], r[2], r[3]) for r in got), key=str) == sorted([(1, 1, True), (2, 1, False), (3, 1, False), (3, 1, False), (3, 1, False), (4, 1, False), (None, None, True), (5, 5, True)], key=str)


def test_a_link_with_a_low_estimate(spark):
    """A pair at exactly 80 % whose registers say less than 68 %: it must reach verification."""
    words = [f"w{i}" for i in range(2000)]
    each = np.stack([near_dedup.registers(x) for x in near_dedup.shingle_sets(pa.array(words), 1)])
    rng, n = np.random.default_rng(4), np.full(2000, 9.0)
    for _ in range(200):
        w = np.argsort(rng.random((2000, 2000)), 1)[:, :10]
        a, b = each[w[:, :9]].max(1), each[np.delete(w, 8, 1)].max(1)  # registers of parts merge by maximum
        low = near_dedup.estimate(a, b, n, n)
        if ((low > 0.62) & (low < 0.68)).any():
            break
    w = [words[i] for i in w[np.flatnonzero((low > 0.62) & (low < 0.68))[0]]]
    docs_ = [(1, " ".join(w[:9])), (2, " ".join(w[:8] + w[9:]))]
    got = sorted(tuple(r) for r in near_dedup.near_duplicates(spark.createDataFrame(docs_, "doc_id bigint, text string"), size=1).collect())
    assert got == brute_near(docs_, 1) == [(1, 9, 1, True), (2, 9, 1, False)]


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + k) for k in range(1, 30)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(got[x] == find(x) for x in got)
    assert set(got) == {x for a, b in edges if a != b for x in (a, b)}


# 5 ------------------------------------------------------------------------------------------------------------------


def test_forward_sums_all_segmentations():
    import numpy as np

    vocabulary = {"▁": 0, "a": 1, "b": 2, "ab": 3, "▁a": 4, "ba": 5}
    p = np.vstack([np.array([[0.2, 0.1], [0.1, 0.3], [0.2, 0.2], [0.2, 0.1], [0.2, 0.2], [0.1, 0.1]]), [[1e-9, 1e-9]], [[0, 0]]])

    def brute(w, lang):
        if not w:
            return 1.0
        return sum(p[vocabulary[w[:k]], lang] * brute(w[k:], lang) for k in range(1, len(w) + 1) if w[:k] in vocabulary)

    for w in ("▁ab", "▁ba", "▁aa"):
        got = language_id.forward([w], vocabulary, p)[0]
        assert np.allclose(np.exp(got), [brute(w, 0), brute(w, 1)])


def test_long_words_are_summed_whole():
    """A word of any length: the sum over all segmentations, and expected counts, as exact fractions give them."""
    from fractions import Fraction

    vocabulary = {"▁": 0, "a": 1, "b": 2, "ab": 3, "▁a": 4, "bab": 5}
    probability = [Fraction(1, 5), Fraction(1, 10), Fraction(1, 7), Fraction(1, 9), Fraction(1, 4), Fraction(1, 11)]
    p = np.vstack([np.array([[float(x)] for x in probability]), [[1e-9]], [[0]]])
    w = "▁" + "abbab" * 300
    n = len(w)
    ahead, after = [Fraction(1)], [Fraction(1)]
    for j in range(1, n + 1):
        ahead.append(sum((ahead[j - k] * probability[vocabulary[w[j - k : j]]] for k in (1, 2, 3) if w[j - k : j] in vocabulary and k <= j), Fraction(0)))
        i = n - j
        after.append(sum((after[j - k] * probability[vocabulary[w[i : i + k]]] for k in (1, 2, 3) if w[i : i + k] in vocabulary and k <= j), Fraction(0)))
    counts = np.zeros((6, 1))
    got = language_id.forward([w, w], vocabulary, p, (np.array([[2.0], [1.0]]), counts))
    import math

    log = math.log(ahead[n].numerator) - math.log(ahead[n].denominator)
    assert np.allclose(got, log) and log < -1000
    want = [0.0] * 6
    for i in range(n):
        for k in (1, 2, 3):
            if i + k <= n and w[i : i + k] in vocabulary:
                x = vocabulary[w[i : i + k]]
                want[x] += 3 * float(ahead[i] * probability[x] * after[n - i - k] / ahead[n])
    assert np.allclose(counts[:, 0], want)


def test_language_of_held_out_texts(spark):
    rng = random.Random(4)
    syllables = {"en": "the ing tion er and th".split(), "fr": "que eau ment ou é le".split(), "de": "sch ung keit ü der ein".split()}
    data = [(i, " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 3))) for _ in range(40)), lang) for i, lang in enumerate(rng.choice(list(syllables)) for _ in range(150))]
    data += [(900, None, "en"), (901, "12 34 !!", "en"), (902, "theing", None)]
    df = spark.createDataFrame(data, "doc_id bigint, text string, lang string").withColumn("held_out", language_id.held_out(F.col("doc_id")))
    langs, table = language_id.train(df.where("not held_out"), PATH)
    assert langs == ["de", "en", "fr"]
    got = {r["doc_id"]: r for r in language_id.identify(df.drop("lang"), PATH, langs, table, keep=["doc_id", "held_out"]).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang in data[:150] if got[i]["held_out"])
    assert got[900]["lang_pred"] == got[901]["lang_pred"] == "und" and 0 <= got[902]["score"] <= 1
    assert language_id.train(df.where("false"), PATH)[0] == []


# 6 ------------------------------------------------------------------------------------------------------------------


def brute_base(t):
    low = (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    at, labels = [], set()
    for phrase, label in license_scan.BASE.items():
        p = phrase.split()
        for k in range(len(w)):
            if w[k : k + len(p)] == p:
                at.append(k)
                labels.add(label)
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def test_licences(spark, docs, empty):
    more = [
        (200, "Under the MIT License. Licensed under the Apache License, Version 2.0"), (201, "under the mit license under the mit license"), (202, "This work is licensed under the GNU General Public License, version 3."),
        (203, "KK İ under the mit lİcense"), (204, "Licensed under CC BY-NC 4.0."), (205, "general public works of the version three"), (206, "Released under the MIT License."),
    ]
    table = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id bigint, text string"))
    got = {r["doc_id"]: r for r in license_scan.scan(table).collect()}
    for i, t in [(r[0], r[1]) for r in rows()] + more:
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute_base(t)
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1
    assert got[202]["labels"] == "gpl-3" and got[200]["labels"] == "apache-2,mit" and got[204]["labels"] == "cc-by-nc" and got[205]["labels"] == ""
    assert license_scan.scan(empty).count() == 0


def test_many_notices_in_one_text(spark):
    """A text of very many notices takes time in proportion, and clashing columns are carried."""
    import time

    notice = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
    df = spark.createDataFrame([(1, notice * 20_000, 5), (2, "x " + notice, 6), (3, None, 7)], "doc_id bigint, text string, n_words int").withColumn("_words", F.lit("w")).withColumn("labels", F.lit("l"))
    began = time.time()
    got = {r["doc_id"]: r for r in license_scan.scan(df).collect()}
    assert time.time() - began < 60
    assert got[1]["labels_"] == got[2]["labels_"] == "mit" and got[3]["labels_"] == "" and got[2]["n_words"] == 6 and got[2]["n_words_"] == 21 and got[1]["_words"] == "w"


# 7 ------------------------------------------------------------------------------------------------------------------


def brute_spans(t):
    out = [(m.start(), 0, "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, "ip", m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    digits = lambda s: re.sub(r"[^0-9]", "", s)
    out += [(m.start(), 2, "card", m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(digits(m[0])) <= 19 and pii._luhn(digits(m[0]))]
    out += [(m.start(), 3, "phone", m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]
    return [(k, a, b) for a, _, k, b in sorted(out)]


def test_base_spans():
    rng = random.Random(3)
    parts = ["a", "@", ".", "b@c.d", "1", "23", "4", ".5", "0", " ", "-", "+", "(", ")", "555-1234", "é", "%", "4111 1111 1111 1111", "+1 (555) 555-1234"]
    for _ in range(20_000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 16)))
        assert pii.base_spans(t) == brute_spans(t)


def test_personal_data(spark, docs, empty):
    more = [(300, "write to ann.lee@mail.example.com or call +1 (555) 555-1234 now"), (301, 'token = "0f3a9c7d5e1b2a4c6d8e0f1a2b3c4d5e6f708192"'), (302, "ssn 123-45-6789 here"), (303, "plain words only")]
    table = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id bigint, text string"))
    found = pii.detect(table, keep=["doc_id", "text"])
    got = {r["doc_id"]: r for r in found.collect()}
    for i, t in [(r[0], r[1]) for r in rows()] + more:
        assert [(s["kind"], s["start"], s["end"]) for s in got[i]["pii_spans"] if s["base"]] == brute_spans(t or "")
    assert [s["kind"] for s in got[301]["pii_spans"]] == ["secret"] and [s["kind"] for s in got[302]["pii_spans"]] == ["ssn"] and got[303]["pii_spans"] == []
    clean = {r["doc_id"]: r["text"] for r in pii.redact(found).collect()}
    assert clean[300] == "write to <EMAIL> or call <PHONE> now" and clean[303] == "plain words only" and clean[80] is None
    assert pii.detect(empty).count() == 0


def test_added_spans():
    """Further candidates: whole, beside base spans without overlap, and in time in proportion to the text."""
    import time

    found = pii.candidates("a" * 100 + " (at) b.com and ann.lee [at] mail (dot) example (dot) org")
    assert [(c["start"], c["end"]) for c in found] == [(0, 111), (116, 157)]
    t = "mail a@b.com 123-45-6789 or 10.0.0.1 token 0f3a9c7d5e1b2a4c6d8e0f1a2b3c4d5e 555-123-4567 "
    one = pii.candidates(t)
    spans = sorted((c["start"], c["end"]) for c in one)
    assert all(b <= c for (_, b), (c, _) in zip(spans, spans[1:], strict=False))
    assert {c["kind"] for c in one} == {"email", "ssn", "ip", "secret", "phone"}
    began = time.process_time()
    assert len(pii.candidates(t * 10_000)) == 10_000 * len(one)
    assert time.process_time() - began < 30


def test_precision_of_added_spans(spark, docs):
    """Identifiers, dates, paths and counted numbers are no personal data; tokens, numbers and addresses among them are."""
    clean = [
        "id 550e8400-e29b-41d4-a716-446655440000 of it", "see x.org/articles/2020/some-long-title-here-1 for more", "at 2024-01-30T12-00-00-minutes we met", "row 100 200-3000 of it", "figure 123-45-6789 shows",
        "the file src/main/java8/org/example/Thing", "build release-candidate-2-final-version is out", "model 415 200 3000 sold", "isbn 978 030 4061 57", "commit 0f3a9c7d5e1b2a4c6d8e0f1a2b3c4d5e6f708192 fixed",
    ]
    personal = [
        ("token = {}", "sk9Zq8LmP2vXw7RtB4nY6c", "secret"), ("ssn {} here", "123-45-6789", "ssn"), ("my ssn is {}", "321-54-9876", "ssn"), ("call {} now", "(555) 123-4567", "phone"), ("phone {} today", "555-123-4567", "phone"),
        ('api_key: "{}"', "a8F3kLm29QzXc7VbN1wE", "secret"), ("write to {}", "ann.lee [at] mail (dot) example (dot) org", "email"), ("iban {}", "DE89 3704 0044 0532 0130 00", "iban"), ("iban {}", "DE89370400440532013000", "iban"),
    ]
    base = [f"{w} +1 (555) 555-{1000 + k} and {w}.{k}@mail.example.com" for k, w in enumerate(WORDS * 6)]
    texts_ = base + clean + [t.format(x) for t, x, _ in personal]
    got = {r["doc_id"]: r["pii_spans"] for r in pii.detect(spark.createDataFrame(list(enumerate(texts_)), "doc_id bigint, text string"), keep=["doc_id"]).collect()}
    for i in range(len(clean)):
        assert not got[len(base) + i], clean[i]
    for i, (t, x, kind) in enumerate(personal, len(base) + len(clean)):
        assert [(s["kind"], s["start"], s["end"]) for s in got[i]] == [(kind, t.index("{"), t.index("{") + len(x))], t
    assert all([s["kind"] for s in got[i]] == ["phone", "email"] for i in range(len(base)))


def test_reliabilities_are_estimated_by_kind():
    """A labeler that is right for one kind and silent for another does not lend its figure."""
    chance = pii.fit([("ssn", "1110/4,0-,3", False, 50), ("ssn", "1200/4,0-,5", False, 50), ("secret", "1100/6,a0,", False, 200), ("secret", "1202/6,a0,7", False, 20)])
    assert chance["ssn:1110/4,0-,3"] > 0.5 > chance["ssn:1200/4,0-,5"] and chance["secret:1100/6,a0,"] > 0.5 > chance["secret:1202/6,a0,7"]


# 8 ------------------------------------------------------------------------------------------------------------------


def page(body: str, extra: str = "") -> str:
    nav = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in ("home", "news", "about"))
    return f'<html><head><title>t t</title><script>var x="</p>";</script></head><body><nav><ul>{nav}</ul></nav><div class="ad">buy this now please</div><article>{body}</article>{extra}<footer>&copy; site of words</footer></body></html>'


def test_main_text(spark):
    body = "<h1>A &amp; B</h1><p>One  two\nthree.</p><p>Four<br>five <b>six</b>.<p>Seven &#233;"
    pages = [(i, "u", page(body + f"<p>{'word ' * (5 + i)}</p>")) for i in range(30)]
    pages += [(90, "u", None), (91, "u", ""), (92, "u", "<p>only this</p>"), (93, "u", page(body, '<div class="comments"><p>I like it very much indeed</p></div>')), (94, "u", page(body).replace("article", "div")), (95, "u", "<div class='a' \"broken"), (96, "u", page("<h1>x</h1>" + "<p>long text here</p>" * 5000))]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extract.extract(df, html_extract.train(df)).collect()}
    want = "A & B\nOne two three.\nFour five six.\nSeven é"
    assert got[3] == want + "\n" + " ".join(["word"] * 8)
    assert got[90] == got[91] == "" and got[92] == "only this" and got[93] == want and got[94] == want
    assert got[96].count("\n") == 5000
    assert html_extract.extract(df.where("false"), {}).count() == 0


@pytest.fixture(scope="module")
def labelled_pages():
    """Pages to fit on and pages held out."""
    import pyarrow.parquet as pq

    found = [x for x in pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"]).column(0).to_pylist() if x and re.search("(?i)<(article|main)[ >]", x)]
    return found[:150], found[150:]


@pytest.fixture(scope="module")
def fitted(labelled_pages):
    return html_extract.fit(labelled_pages[0])


@pytest.mark.parametrize(
    "body",
    [
        "<header><a href='/'>Site of all words</a><ul><li>one</li></ul></header>{a}",
        "<div class='masthead'><h2>The daily word and more of it</h2></div>{a}",
        "<div class='alert'>We use cookies on all of these pages here</div>{a}",
        "{a}<div class='discussion'><p>I do not agree with any of this at all</p></div>",
        "<div class='content with-sidebar'>{a}<div class='sidebar'>See also these pages of ours</div></div>",
        "<div class='social-science'>{a}</div>",
        "<form id='page-menu'>{a}</form>",
        "<noscript>{a}",
        "<nav>Home News</nav>{b}<div></div><div></div><div></div><div></div><div></div><div></div>{c}",
        "{b}<div class='related'><p>" + "other news of the day " * 30 + "</p></div>{c}",
        "{a}<section id='comments'><p>" + "so many words of readers " * 60 + "</p></section>",
    ],
)
def test_pages_of_many_kinds(body, fitted):
    first, second = "First words of the text stand here.", "And then come some more words, " * 5
    title = "<div class='article-header'><h1>A long title of the page</h1></div>"
    page_ = f"<html><body>{body}<footer>Imprint and terms of use</footer></body></html>".replace("{a}", f"<article>{title}<p>{first}</p><p>{second}</p></article>")
    page_ = page_.replace("{b}", f"{title}<p>{first}</p>").replace("{c}", f"<p>{second}</p>")
    assert html_extract.main_text(page_, fitted) == f"A long title of the page\n{first}\n{second.strip()}"


PARTS = ["The harbour was quiet that morning, and the boats lay still. Nobody had slept.", "A second paragraph follows here, with more to say about it. It ends well.", "In the third we learn why the boats were late, and who paid for it."]
ADVERT = "<div class='dfp-slot'>Buy our lovely boats now</div>"


@pytest.mark.parametrize("mark", ["article", "main", "div"])
@pytest.mark.parametrize(
    "before, middle, end, after, more",
    [
        ("", "", "<section class='related-work'><h2>Related work</h2><p>Others have seen boats before. They wrote it down.</p></section>", "", "Related work\nOthers have seen boats before. They wrote it down."),
        ("", "", "<p class='notice'>The harbour will be closed on Monday. Ask at the office.</p>", "", "The harbour will be closed on Monday. Ask at the office."),
        ("", "", "<table class='menu'><tr><td>Soup of the day</td><td>4.50</td></tr><tr><td>Fish</td><td>9.00</td></tr></table>", "", "Soup of the day\n4.50\nFish\n9.00"),
        ("", "", "<h2 id='share'>Share prices</h2><p>They fell by two points on Tuesday, and rose on Friday.</p>", "", "Share prices\nThey fell by two points on Tuesday, and rose on Friday."),
        ("", "", "", "<div class='thread'><p>I do not agree with this at all.</p><p>Me neither, sorry to say.</p></div>", ""),
        (ADVERT, "", "", "", ""),
        ("", ADVERT, "", "", ""),
        ("", "", "", ADVERT, ""),
        ("", "", "", "<div class='bottom'>Copyright 2024 The Harbour Times. All rights reserved.</div>", ""),
        ("", "<div hidden>Not seen by anyone. Really.</div>", "<p style='display: none'>Nor is this one.</p>", "", ""),
        ("<header><h1>The Harbour Times</h1></header>", "", "", "", ""),
        ("<header><h1>The Harbour Times</h1><nav><a href=/>Home</a> <a href=/n>News</a></nav></header>", "", "", "", ""),
    ],
)
def test_fitted_weights_decide(before, middle, end, after, more, mark, fitted):
    """Article text under names of boxes stays, boxes under names of their own go; without the element weights it does not come out right."""
    article = f"<{mark}><h1>A long title of the page</h1><p>{PARTS[0]}</p>{middle}<p>{PARTS[1]}</p><p>{PARTS[2]}</p>{end}</{mark}>"
    page_ = f"<html><body><nav><ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li></ul></nav>{before}{article}{after}<footer>&copy; Imprint and terms</footer></body></html>"
    want = "\n".join(["A long title of the page", *PARTS, *([more] if more else [])])
    assert html_extract.main_text(page_, fitted) == want
    assert html_extract.main_text(page_, {k: v for k, v in fitted.items() if not k.startswith("e|")}) != want


def _article_of(page_):
    found, inside = html_extract._labelled(page_)
    blocks = [""]
    for (kind, name, _), x in zip(found, inside, strict=True):
        if x and kind == "text":
            blocks[-1] += name
        elif x and name in html_extract.BLOCKS:
            blocks.append("")
        elif x and name == "br":
            blocks[-1] += " "
    return "\n".join(" ".join(html.unescape(b).split()) for b in blocks if b.split())


def test_held_out_pages_without_their_mark(fitted, labelled_pages):
    held = labelled_pages[1]
    wrong = ablated = 0
    tags_only = {k: v for k, v in fitted.items() if not k.startswith("e|")}
    for p in held:
        want, q = _article_of(p), re.sub(r"(?i)<(/?)(article|main)\b", r"<\1div", p)
        wrong += html_extract.main_text(q, fitted) != want
        ablated += html_extract.main_text(q, tags_only) != want
    assert len(held) > 50 and wrong <= 0.05 * len(held) and ablated > 0.5 * len(held)


def test_pages_repeated_and_clashing(spark, fitted):
    p = "<html><body><nav><a href=/>Home</a></nav><article><h1>A title of it</h1><p>Some words stand here. They stay.</p></article></body></html>"
    df = spark.createDataFrame([(1, p, "x", 5)] * 3 + [(2, None, "y", 6)], "page_id bigint, html string, text string, n_chars int")
    got = html_extract.extract(df, fitted)
    assert got.columns[:3] == ["page_id", "text", "n_chars"] and len(set(got.columns)) == 4
    assert sorted(r[3] for r in got.collect()) == [""] + ["A title of it\nSome words stand here. They stay."] * 3
    assert html_extract.fit([]) == {} and html_extract.main_text("<p>only this text here</p>", {}) == "only this text here"


def test_broken_pages_take_linear_time():
    import time

    for bad in ('<a "', "<noscript>", "<a '>x", "<", "< b", '<a "\'>x', "<div>", "</p>", "<div class=ad>", "<!", "<header>"):
        began = time.process_time()
        html_extract.main_text(bad * 20_000, {})
        assert time.process_time() - began < 5, bad


def test_training_pages_by_one_rule(spark, monkeypatch):
    """Few or many marked pages, distinct or equal keys: always those with the smallest hashes train."""
    monkeypatch.setattr(html_extract, "TRAINING_PAGES", 5)
    monkeypatch.setattr(html_extract, "fit", lambda found: found)
    for n, keys in ((15, 15), (200, 200), (200, 1), (200, 3)):
        df = spark.createDataFrame([(i % keys, f"<main><p>page {i}</p></main>") for i in range(n)], "page_id bigint, html string")
        want = [r["html"] for r in df.orderBy(F.xxhash64("page_id", "html")).limit(5).collect()]
        assert html_extract.train(df) == want
    copies = spark.createDataFrame([(1, "<main>a</main>")] * 200, "page_id bigint, html string")
    assert html_extract.train(copies) == ["<main>a</main>"] * 5


def test_best_run():
    rng = random.Random(1)
    for _ in range(300):
        x = [rng.choice([-3, -1, 1, 2]) for _ in range(rng.randint(0, 12))]
        a, b = html_extract.best_run(x)
        best = max((sum(x[i:j]) for i in range(len(x)) for j in range(i + 1, len(x) + 1)), default=0)
        assert sum(x[a:b]) == max(0, best)


# 9 ------------------------------------------------------------------------------------------------------------------


def test_greedy_lengths(spark, docs, empty):
    rng = random.Random(5)

    def greedy(v, w):
        n = i = 0
        while i < len(w):
            k = next((k for k in range(len(w) - i, 0, -1) if w[i : i + k] in v), None)
            n, i = (n + 1, i + k) if k else (n + len(w[i].encode()), i + 1)
        return n

    for _ in range(300):
        v = {"".join(rng.choice("abcé") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 20))}
        a = token_counts.Automaton(v)
        for _ in range(10):
            w = "".join(rng.choice("abcdé") for _ in range(rng.randint(0, 14)))
            assert a.count(w) == greedy(v, w)
    vocabulary = token_counts.automaton(PATH).vocabulary
    got = {r["doc_id"]: (r["n_words"], r["n_tokens"]) for r in token_counts.count_tokens(docs, PATH, keep=["doc_id"]).collect()}
    for i, t, *_ in rows():
        w = [x.decode() for x in split(t)]
        if len(t or "") < 4000:
            assert got[i] == (len(w), sum(greedy(vocabulary, "▁" + x) for x in w))
    assert token_counts.count_tokens(empty, PATH).count() == 0


# 10 -----------------------------------------------------------------------------------------------------------------


def test_quality(spark, docs, empty):
    got = {r["doc_id"]: r for r in quality_rules.judge(docs, keep=["doc_id"]).collect()}
    for i, t, *_ in rows():
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        c = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        covered = {p for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for p in (k, k + 1, k + 2)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert not (r["base_failed"] and r["kept"])
    assert quality_rules.judge(empty).count() == 0
    clash = quality_rules.judge(docs.withColumn("n_words", F.lit("x")).withColumn("kept", F.lit("y")).withColumn("host", F.lit("z")))
    assert clash.columns[-1] == "kept_" and {r["doc_id"]: (r["n_words_"], r["kept_"]) for r in clash.collect()} == {i: (r["n_words"], r["kept"]) for i, r in got.items()}


def test_hosts_shrink(spark):
    rows_ = [("bad", True)] * 90 + [("bad", False)] * 10 + [("good", False)] * 100 + [("tiny", True)]
    v = {r["host"]: r for r in quality_rules.host_verdicts(spark.createDataFrame(rows_, "host string, failed boolean")).collect()}
    assert not v["bad"]["trusted"] and v["good"]["trusted"] and v["tiny"]["rate"] < 1


# pipeline -----------------------------------------------------------------------------------------------------------


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefghijklmnoprstuv") for _ in range(rng.randint(2, 9))) for _ in range(4000)]
    text = lambda n=120: " ".join(rng.choice(vocabulary) for _ in range(n))
    item = text(30)
    good = [text() for _ in range(12)]
    data = [*good, good[0], good[1] + " end", text(10), f"{text()} {item} {text()}", text() + " mail me@host.example.com " + text(20), None]
    documents = spark.createDataFrame([(i, t, "en", f"h{i % 3}", len(t or ""), "x") for i, t in enumerate(data)], DOCS + ", kept string")
    documents.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    at = documents
    for _, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == documents.columns
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert sorted(got) == [*range(12), 16]
    assert "<EMAIL>" in got[16]["text"] and all(r["round_trip"] for r in got.values())
    assert all(got[i]["text"] == good[i] for i in range(12))


def test_digests_of_registered_queries(spark, tmp_path):
    from fathomline.llm import queries

    spark.createDataFrame(rows(), DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r["doc_id"]: r for r in queries.op1_sentencepiece(spark, str(tmp_path)).collect()}
    for i, t, *_ in rows():
        ids = sp.encode(t or "")
        assert tuple(got[i]) == (i, len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids)))
    got = {r["doc_id"]: r for r in queries.op7_pii(spark, str(tmp_path)).collect()}
    for i, t, *_ in rows():
        assert got[i]["base_sha256"] == sha(",".join(f"{k}:{a}:{b}" for k, a, b in brute_spans(t or "")))
