"""Spelling variants, subvector centroids, prefix BPE and the ordinal likelihood against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.llm import plans, prefixes, severity, spelling, subvectors
from waymark.llm.common import Scratch

# --- 11 spelling variants


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def variants_of(rows, least=5, often=3):
    count = Counter()
    for doc, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            k = h % len(run)
            count[run[:k] + run[k + 1 :] if h % 97 == 0 else run] += 1
    words = {w: n for w, n in count.items() if len(w) >= least and n >= often}
    near = {w: [v for v in words if distance(w, v) == 1] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 2 * words[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w] or "", root(w), words[w], len(near[w]), words[form[w]] if form[w] else 0) for w in words)


def rows_of(df):
    return sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], r["form_n"] or 0) for r in df.collect())


def test_scan_equals_the_whole_matrix():
    rng = random.Random(1)
    cores = sorted({"".join(rng.choice("abÿ") for _ in range(rng.randint(0, 5))) for _ in range(150)})
    for q in [*cores, "", "a", "zzz", "abab"]:
        assert [cores[k] for k in spelling.scan(q, cores)] == [c for c in cores if distance(q, c) == 1]


@pytest.mark.parametrize("most", [2, 5, 1000])
def test_variants_equal_brute_force(spark, most):
    rng = random.Random(most)
    stems = ["".join(rng.choice("abcÉé") for _ in range(rng.randint(5, 9))) for _ in range(12)] + ["aaaaa", "aaaaaa", "aaaaaaa", "aaaaaaaa"]
    pool = list(stems)
    for w in stems:  # chains of edits, so that forms have forms
        for _ in range(6):
            k = rng.randrange(len(w) + 1)
            w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abc") + w[k:], w[:k] + "d" + w[k + 1 :]])
            pool.append(w)
    rows = [(i, " ".join(rng.choice(pool).upper() if rng.random() < 0.1 else rng.choice(pool) for _ in range(rng.randint(0, 120)))) for i in range(40)]
    rows += [(None, "abcab " * 9), (None, None), (3, ""), (3, "×÷×÷× ×÷×÷×\t×÷×÷×_aaaaa1aaaaa"), (5, "bcbcb-" * 300), (5, "bcbcb-" * 300), (6, "q" * 40_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("clash")).withColumn("N", F.lit(1))
    got = rows_of(spelling.group_variants(docs, most))
    assert got == variants_of(rows) and any(form for _, form, *_ in got) and any(a != b and b for _, a, b, *_ in got)


def test_variants_of_nothing(spark):
    docs = spark.createDataFrame([(1, None), (None, ""), (2, "ab cd")], "doc_id long, text string")
    assert spelling.group_variants(docs).count() == 0 and spelling.group_variants(docs.limit(0)).count() == 0


def test_hot_groups_are_dealt_again(spark):
    # A third and more of the words share all but their last letters.
    rng = random.Random(3)
    words = sorted({"gemeinsam" + "".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(900)})
    table = spark.createDataFrame([(w, 3) for w in words], "word string, n long")
    pairs = {(r["word"], r["near"]) for r in spelling.near_words(table, Scratch(spark, "hot"), 16).collect()}
    cut = {}
    for w in words:
        for k in range(len(w)):
            cut.setdefault((k, w[:k] + w[k + 1 :]), []).append(w)
    want = {(a, b) for ws in cut.values() for a in ws for b in ws if a != b}
    assert pairs == want and len(want) > 500


# --- 12 centroids over subvector dictionaries


def clusters_of(vectors, k=16, rounds=3, dims=64):
    rows = [(i, [math.floor(64 * x) for x in v]) for i, v in vectors if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]

    def mark(r):
        return (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])

    centroids = [list(v) for _, v in sorted(rows, key=mark)[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(centroids))

    for _ in range(rounds):
        own = [near(v)[1] for _, v in rows]
        groups = [[v for (_, v), o in zip(rows, own) if o == i] for i in range(len(centroids))]
        centroids = [[sum(x) // len(g) for x in zip(*g)] if g else c for g, c in zip(groups, centroids)]
    last = [near(v) for _, v in rows]
    each = [sum(d for d, i in last if i == c) for c in range(len(centroids))]
    return sorted(((i if i is not None else -1), c, d, each[c], sum(each), centroids[c]) for (i, _), (d, c) in zip(rows, last))


@pytest.mark.parametrize(("width", "chunk"), [(2, 32_768), (1, 7), (5, 50), (64, 16)])
def test_clusters_equal_plain_loops(spark, width, chunk):
    rng = np.random.default_rng(width)
    vectors = [(i, rng.normal(0, 0.2, 64).astype(np.float32).tolist()) for i in range(120)]
    vectors += [(i, vectors[3][1]) for i in range(200, 260)]  # one very common vector
    vectors += [(7, vectors[9][1]), (7, vectors[9][1]), (None, vectors[11][1]), (300, [0.0] * 64), (301, [-0.015625] * 64)]
    odd = [(400, None), (401, []), (402, [1.0] * 63), (403, [1.0] * 65), (404, [1.0] * 63 + [None]), (405, [float("nan")] * 64), (406, [1.0] * 63 + [float("-inf")])]
    table = spark.createDataFrame(vectors + odd, "vec_id long, embedding array<float>").withColumn("CLUSTER", F.lit("clash")).repartition(3)
    got = subvectors.cluster(table, width=width, chunk=chunk).collect()
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got) == clusters_of(vectors)


def test_few_vectors_ties_and_large_components(spark):
    schema = "vec_id long, embedding array<double>"
    same = [(i, [0.5] * 64) for i in range(5)]
    got = subvectors.cluster(spark.createDataFrame(same, schema)).collect()
    assert sorted(r["vec_id"] for r in got) == list(range(5)) and {(r["cluster"], r["distance"], r["inertia"]) for r in got} == {(0, 0, 0)}
    assert subvectors.cluster(spark.createDataFrame([], schema)).count() == 0
    far = spark.createDataFrame([(1, [1e30] * 64), (2, [-1e30] * 64)], schema)
    got = {r["vec_id"]: r for r in subvectors.cluster(far).collect()}
    assert got[1]["centroid"] == [subvectors.LARGEST] * 64 and got[2]["distance"] == 0


def test_codes_and_dictionaries_lose_nothing(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(-3, 4, (500, 64)) / 64
    rows = subvectors.kept(spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").coalesce(1), 64)
    (chunk,) = subvectors.encode(rows, 64, 3).toArrow().to_batches()
    (row,) = subvectors.rows_of([chunk])
    parts = [words[codes] for _, words, codes in subvectors.blocks_of(row, 64, 3)]
    assert np.array_equal(np.concatenate(parts, 1), (x * 64).astype(int)) and max(row["sizes"]) <= 7**3
    assert row["ids"].to_pylist() == list(range(500))


# --- 13 prefix BPE


@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library(vocabulary):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary)


ODD = ["a", "b", " ", "  ", "\n", "\t", "\x1c", "\x85", " ", "'s", "'re", "'", "1", "23", "²", "½", "é", "日", "본", "한", "😀", "́", "​", "<|endoftext|>"]
ODD += ["<|", "_", "#", "՘", "\U00011de0", "　", "ﬀ", "ß", "İ", "͸", "٣", "\x00", "aaaa", "=====", "﻿", "\r", " ", "don't", " The"]


def ids_of(coder, text):
    return np.frombuffer(coder.encode(text), "<u4").tolist()


def test_ids_equal_the_library(vocabulary, library):
    rng = random.Random(5)
    coder = prefixes.PrefixBpe(vocabulary)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    texts += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzAE") for _ in range(40)) for _ in range(1500)]
    texts += ["".join(rng.choice("ab") for _ in range(60)) for _ in range(500)] + ["a" * k for k in range(200)] + ["=-" * k for k in range(60)]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [ids_of(coder, t) for t in texts] == want
    assert [coder.decode(coder.encode(t)) for t in texts] == [library.decode(i, skip_special_tokens=False) for i in want] == texts


def test_every_prefix_has_its_last_token(vocabulary, library):
    coder = prefixes.PrefixBpe(vocabulary)
    for word in ["internationalization", "aaaaaaaaaaaa", "xqzjkvbw", "----====----", "0123456789"]:
        last = coder.last_tokens(word.encode())
        assert last[1:] == [library.encode(word[:k], add_special_tokens=False).ids[-1] for k in range(1, len(word) + 1)]


def test_any_ids_decode(vocabulary, library):
    rng = random.Random(6)
    coder = prefixes.PrefixBpe(vocabulary)
    for _ in range(300):
        ids = [rng.randrange(50_257) for _ in range(20)]
        assert coder.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids, skip_special_tokens=False)


def test_characters_are_split_as_the_library_does(vocabulary, library):
    coder = prefixes.PrefixBpe(vocabulary)
    for start in range(0, 0x30000, 0x100):
        chars = [chr(i) for i in range(start, start + 0x100) if not 0xD800 <= i < 0xE000]
        for text in ("".join("a" + c for c in chars), "".join("1" + c for c in chars), "".join("! " + c for c in chars)):
            assert coder.split(text) == [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)]


def test_whole_tables(spark, sf, vocabulary, library):
    rows = [(1, None), (None, ""), (2, "x" * 30_000), (2, "x" * 30_000), (3, " \n"), (4, "one <|endoftext|>two"), (5, "日本語 😀\x00")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("IDS", F.lit("clash")).withColumn("a b", F.lit(1)).repartition(2)
    out = prefixes.encode(docs, vocabulary)
    got = sorted(((r["doc_id"] or 0, np.frombuffer(r["ids"], "<u4").tolist(), r["n_tokens"], r["decoded"]) for r in out.collect()), key=str)
    each = [(i or 0, library.encode(t or "", add_special_tokens=False).ids, t or "") for i, t in rows]
    assert got == sorted(((i, ids, len(ids), t) for i, ids, t in each), key=str)
    assert out.columns == ["doc_id", "text", "a b", "ids", "n_tokens", "decoded"]
    assert {r["decoded"] for r in prefixes.decode(out, vocabulary).collect()} == {t or "" for _, t in rows}
    assert prefixes.encode(docs.limit(0), vocabulary).count() == 0
    texts = {r["doc_id"]: r["text"] or "" for r in plans.table(spark, sf, "documents").collect()}
    for r in plans.QUERIES["op13_prefix_bpe"](spark, sf).collect():
        e = library.encode(texts[r["doc_id"]], add_special_tokens=False)
        text = library.decode(e.ids, skip_special_tokens=False)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (
            len(e.ids),
            hashlib.sha256(np.array(e.ids, "<u4").tobytes()).hexdigest(),
            hashlib.sha256(text.encode()).hexdigest(),
        )


# --- 9 the likelihood of ordinal grades


def ordinal_rows(n=600, words=6):
    rng = np.random.default_rng(9)
    x = rng.random((n, words)) < 0.4
    eta = x @ np.array([2.0, 1.0, 0.5, -1.0, 0.0, 1.5])
    noise = rng.logistic(size=n)
    return x, (eta[:, None] + noise[:, None] >= [0.5, 2.0, 3.5]).sum(1)


def mean_loss(w, t, x, grade):
    """-log P(grade) row by row, from the probabilities themselves."""
    total = 0.0
    for row, y in zip(x, grade):
        above = [1.0, *(1 / (1 + math.exp(k - float(row @ w))) for k in t), 0.0]
        total -= math.log(above[y] - above[y + 1])
    return total / len(x)


def test_slopes_are_those_of_the_likelihood():
    x, grade = ordinal_rows(80)
    w, t = np.array([0.3, -0.2, 0.1, 0.4, -0.5, 0.2]), np.array([-0.4, 0.7, 1.9])
    loss, g_eta, g_t = severity._loss(x @ w, t, grade)
    assert loss == pytest.approx(mean_loss(w, t, x, grade))
    for k in range(6):
        step = np.eye(6)[k] * 1e-6
        assert (g_eta @ x)[k] == pytest.approx((mean_loss(w + step, t, x, grade) - mean_loss(w - step, t, x, grade)) / 2e-6, abs=1e-6)
    for k in range(3):
        step = np.eye(3)[k] * 1e-6
        assert g_t[k] == pytest.approx((mean_loss(w, t + step, x, grade) - mean_loss(w, t - step, x, grade)) / 2e-6, abs=1e-6)


def test_fit_is_the_optimum():
    x, grade = ordinal_rows()
    w, t = severity._fit([np.flatnonzero(r).tolist() for r in x], grade, 6, l2=0.0)
    # Plain descent, many small steps.
    v, u = np.zeros(6), np.array([0.0, 1.0, 2.0])
    for _ in range(6000):
        _, g_eta, g_t = severity._loss(x @ v, u, grade)
        v, u = v - 0.5 * (g_eta @ x), u - 0.5 * g_t
    assert mean_loss(w, t, x, grade) <= mean_loss(v, u, x, grade) + 1e-5
    assert np.allclose(w, v, atol=0.02) and np.allclose(t, u, atol=0.02) and list(t) == sorted(t)


def test_severity_of_odd_rows(spark):
    bad, good = "vile nasty awful words here", "kind gentle plain words here"
    docs = [(i, bad if i % 2 else good) for i in range(60)] + [(0, good), (None, bad), (70, None), (71, "")]
    docs = spark.createDataFrame(docs, "doc_id long, text string").withColumn("TOXIC", F.lit("clash"))
    marks = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (999, 1), (3, None)], "doc_id long, toxic int")
    out = severity.score(docs, severity.fit(docs, marks)).collect()
    assert len(out) == 64 and all(r["toxic"] == ("vile" in r["text"]) for r in out if r["text"])
    nothing = docs.limit(0)
    assert severity.score(nothing, severity.fit(nothing, marks)).count() == 0
    assert {r["severity"] for r in severity.score(docs, severity.fit(docs, marks.limit(0))).collect()} == {0.0}
