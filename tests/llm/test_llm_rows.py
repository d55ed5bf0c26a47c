"""Defined results for odd rows, and brute force, for the operators on rows and pairs."""

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewarden.llm import catalog, decontamination, embedding_duplicates, graph, learning, licences, lm_scores, mixing, near_duplicates, quality, tokencounts, tokenfiles, toxicity

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, lang string, n_chars long, size string, row string, words string, _doc string, d string, score string"


def docs(spark, rows):
    """Documents with extra columns whose names clash with those used inside."""
    return spark.createDataFrame([(i, t, s, "en", len(t or ""), "a", "b", "c", "d", "e", "f") for i, t, s in rows], DOCS)


WORDS = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa", "theta", "iota", "zeta", "été", "naïve", "x1"]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


ODD = [(1, None, None), (2, "", "a"), (3, "  \n\t ", "a"), (4, "one two\nthree  four", "b"), (4, "one two\nthree  four", "b"), (None, "five", None), (None, None, "b"), (7, prose(1, 3000), "a"), (8, "Ünï cödé ß 'x' don't <|endoftext|> 12 ...", "é"), (9, "a" * 5000, "b")]


@pytest.fixture(scope="module")
def odd(spark):
    return docs(spark, ODD).persist()


@pytest.fixture(scope="module")
def none(spark):
    return docs(spark, [])


# ---- graph


def test_components(spark):
    r = random.Random(3)
    for n, m in ((40, 25), (60, 60), (30, 0)):
        links = [(r.randrange(n), r.randrange(n)) for _ in range(m)] + [(k, k + 1) for k in range(100, 117)]
        links = [(a, b) for a, b in links if a != b]
        up = {}

        def find(x, up=up):
            while up.get(x, x) != x:
                x = up[x]
            return x

        for a, b in links:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
        half = len(links) // 2
        df = lambda x: spark.createDataFrame(x, "a long, b long")
        roots = graph.merge(graph.merge(graph.no_roots(spark), df(links[:half])), df(links[half:]))
        got = {row["node"]: row["root"] for row in roots.collect()}
        assert got == {x: find(x) for x in {y for e in links for y in e} if find(x) != x}


# ---- 1


def plain_find(rows, items, n=5, share=0.8):
    def grams(t):
        w = [x for x in __import__("regex").split(r"[^\p{L}\p{N}]+", (t or "").lower()) if x]
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}

    out = set()
    for i, q in set(items):
        g = grams(q)
        for d, t in set(rows):
            s = len(g & grams(t))
            if g and s / len(g) >= share:
                out.add((d, i, len(g), s))
    return out


def test_decontamination(spark, odd, none):
    items = [(k, prose(100 + k, n)) for k, n in enumerate((4, 5, 9, 20, 33, 64))] + [(90, None), (91, ""), (None, prose(200, 12))]
    rows = [(i, t) for i, t, _ in ODD]
    for k, q in items[:6]:
        w = (q or "").split()
        rows += [(100 + k, prose(k, 300) + " " + q.upper().replace(" ", ",  ") + " " + prose(k + 50, 200)), (200 + k, prose(k, 30) + " " + " ".join(w[: int(len(w) * 0.9)]) + " end"), (300 + k, " ".join(w[: len(w) // 2]) + " " + prose(k, 20) + " " + " ".join(w[len(w) // 2 :]))]
    rows += [(None, prose(200, 12)), (None, "x " + prose(200, 12))]
    d = docs(spark, [(i, t, "s") for i, t in rows])
    it = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(0))
    got = [tuple(r)[:4] for r in decontamination.find(d, it).collect()]
    assert Counter(got) == Counter(x for x in plain_find(rows, items) for _ in range(2 if x[0] is None and x[1] is None else 1))
    cleaned = decontamination.clean(d, it)
    bad = {(i, t) for i, t in rows if plain_find([(i, t)], items)}
    assert cleaned.columns == d.columns and Counter((r["doc_id"], r["text"]) for r in cleaned.collect()) == Counter(x for x in rows if x not in bad)
    assert decontamination.find(none, it).isEmpty() and decontamination.find(odd, it.limit(0)).isEmpty()


# ---- 2


def test_licences(spark, odd, none):
    mit = dict(licences.known_texts())["MIT"].split("\n\n", 1)[1]
    rows = [(1, "Copyright (c) 2020 Me\nAll rights reserved.\n\n" + mit.upper().replace(", ", ",\n"), "s"), (2, "Hello.\nReleased under the MIT Licence!\nreleased UNDER the mit license\nBye", "s"), (3, "licensed under the apache license version 2.0 and more", "s"), (4, "Licensed under the Apache Licence, ver. 2.0", "s")]
    notice = next(t for k, t in licences.NOTICES if k == "MPL-2.0" and len(t) > 100)
    rows.append((5, "Some code.\n\n" + notice.replace(" form", "\nform").replace(" a copy", "\r\na copy") + "\n \n\nMore.", "s"))
    got = {(r["doc_id"], r["license"]): (r["whole"], r["n_paragraphs"], r["n_lines"]) for r in licences.scan(docs(spark, rows).unionByName(odd)).collect()}
    assert got == {(1, "MIT"): (True, 1, 0), (2, "MIT"): (False, 0, 2), (4, "Apache-2.0"): (True, 0, 1), (5, "MPL-2.0"): (False, 1, 0)}
    assert licences.scan(none).isEmpty()


def test_each_licence(spark):
    """Each known text is found under its name, wrapped anew, in other spelling, with a line of copyright before it; with a word changed it isn't."""
    files = {k: t for k, t in licences.known_texts() if len(t) > 500}
    assert {"MIT", "ISC", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "MPL-1.1", "CC0-1.0", "GFDL-1.3"} <= set(files)
    rows = []
    for n, (_, t) in enumerate(sorted(files.items())):
        rows.append((2 * n, "Copyright 2001 Someone\n\n" + t.replace("license", "licence").replace("\n\n", "\r\n\r\n\r\n").upper(), "s"))
        rows.append((2 * n + 1, t.replace(" and ", " nd ", 1), "s"))
    got = {(r["doc_id"], r["license"]) for r in licences.scan(docs(spark, rows)).where("whole").collect()}
    assert got == {(2 * n, k) for n, k in enumerate(sorted(files))}


# ---- 3


def test_embeddings(spark):
    r = np.random.default_rng(0)
    centres = r.standard_normal((30, 16))
    rows = []
    for k in range(900):
        c = centres[k % 30]
        v = (c + r.standard_normal(16) * (0.22 if k % 3 else 0.4)).tolist()
        rows.append([k + 1, k % 2 if k % 7 else None, v])
    rows += [[2001, 0, rows[1][2]], [2002, rows[1][1], rows[1][2]], [2002, rows[1][1], rows[1][2]], [None, rows[1][1], rows[1][2]], [2003, 0, None], [2004, 0, [0.0] * 16], [2005, 0, [float("nan")] * 16], [2006, 0, [1.0, None] + [0.0] * 14], [2007, 0, []], [2008, 0, [1e300] * 16], [2009, 0, [1e-300] * 16], [2010, 0, [1.0] * 8]]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumn("node", F.lit("x")).withColumn("leaf", F.lit(1))

    def ok(v):
        return v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    x = [np.array(v, float) / np.abs(v).max() if ok(v) else None for _, _, v in rows]
    x = [v / np.sqrt(v @ v) if v is not None else None for v in x]
    n, up = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if x[i] is not None and x[j] is not None and len(x[i]) == len(x[j]) and rows[i][1] is not None and rows[i][1] == rows[j][1] and x[i] @ x[j] >= 0.93:
            n[i] += 1
            n[j] += 1
            up[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (v, _, _) in enumerate(rows):
        if v is not None:
            least[find(i)] = min(v, least.get(find(i), v))
    want = Counter((v, n[i], least.get(find(i)), v is not None and v == least.get(find(i))) for i, (v, _, _) in enumerate(rows))
    assert Counter(tuple(r) for r in embedding_duplicates.link(df).collect()) == want and max(n) > 5
    small, embedding_duplicates.LEAF, embedding_duplicates.BLOCK = (embedding_duplicates.LEAF, embedding_duplicates.BLOCK), 40, 16
    try:
        got = embedding_duplicates.link(df).collect()
        assert sum(g["n_links"] for g in got) >= 0.99 * sum(n) and all(g["n_links"] <= max(n) for g in got)
    finally:
        embedding_duplicates.LEAF, embedding_duplicates.BLOCK = small
    assert embedding_duplicates.link(df.limit(0)).isEmpty()


def test_links_of_deep_trees(spark):
    """Planted pairs at the threshold in one label that is split five levels deep and more, and a dense cluster larger than a leaf."""
    r = np.random.default_rng(5)
    dim, pairs = 24, 700
    v = r.standard_normal((pairs, dim))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    u = r.standard_normal((pairs, dim))
    u -= (u * v).sum(1, keepdims=True) * v
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    cosine = r.uniform(0.9305, 0.95, (pairs, 1))
    dense = v[0] + 0.02 * r.standard_normal((150, dim))
    x = np.concatenate([v, cosine * v + np.sqrt(1 - cosine**2) * u, dense])
    df = spark.createDataFrame([(i, 1, row.tolist()) for i, row in enumerate(x)], "vec_id long, label int, embedding array<double>")
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = (x @ x.T >= 0.93).sum(1) - 1
    old, embedding_duplicates.LEAF, embedding_duplicates.BLOCK = (embedding_duplicates.LEAF, embedding_duplicates.BLOCK), 64, 32
    try:
        assert embedding_duplicates.trees(len(x), 64) > embedding_duplicates.trees(len(x), 1024)
        got = {row["vec_id"]: row["n_links"] for row in embedding_duplicates.link(df).collect()}
    finally:
        embedding_duplicates.LEAF, embedding_duplicates.BLOCK = old
    assert all(got[i] <= want[i] for i in got) and sum(got.values()) >= 0.998 * want.sum()
    assert sum(got[i] >= 1 for i in range(2 * pairs)) >= 0.997 * 2 * pairs and min(got[2 * pairs + i] for i in range(150)) >= 149


# ---- 4 and 6


def test_chain_marginals():
    r = np.random.default_rng(1)
    field = toxicity.Field(r.standard_normal(1 << toxicity.BITS), 0.1, r.standard_normal((2, 2)), r.standard_normal(2))
    texts = [["a", "b", "c"], [], ["d"], ["b"] * 7, ["x", "y"] * 40]
    got = toxicity.Tagger(field).marginals(texts)
    at = 0
    for words in texts[:4]:
        e = [field.marks[toxicity.slots(w)].sum() + field.bias for w in words]
        total = np.zeros(len(words))
        z = 0.0
        for path in itertools.product((0, 1), repeat=len(words)):
            if words:
                w = math.exp(field.first[path[0]] + sum(x for x, s in zip(e, path, strict=True) if s) + sum(field.step[a, b] for a, b in itertools.pairwise(path)))
                z += w
                total += w * np.array(path)
        assert np.allclose(got[at : at + len(words)], total / max(z, 1e-300) if words else [])
        at += len(words)
    alone = toxicity.Tagger(field).marginals([texts[4]])
    assert np.allclose(got[at:], alone) and len(got) == at + 80


@pytest.fixture(scope="module")
def labelled_docs(spark):
    rows, labels = [], []
    for k in range(600):
        t = prose(k, 30 + k % 50)
        toxic = k % 3 == 0
        if toxic:
            w = t.split()
            w.insert(k % len(w), f"vile{'abcdef'[k % 6]}")
            t = " ".join(w)
        if k % 4 == 0:
            t = t.replace(" ", " | ")
        rows.append((k, t, "s"))
        labels.append((k, int(k % 4 != 0), int(toxic)))
    labels += [(3, None, None), (99999, 1, 1), (None, 1, 1)]
    return docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {i: (q, t) for i, q, t in labels[:600]}


@pytest.mark.parametrize("which", [0, 1])
def test_classifiers(spark, odd, none, labelled_docs, which):
    d, labels, truth = labelled_docs
    run = (lambda x, lab: quality.classify(x, lab)) if which == 0 else (lambda x, lab: toxicity.score(x, lab))
    cut = 0.3 if which == 0 else 0.5
    got = run(d, labels).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= cut) for r in got)
    tested = [r for r in got if r["held_out"]]
    assert len(tested) > 80 and sum(r["predicted"] == truth[r["doc_id"]][which] for r in tested) / len(tested) >= 0.95
    # neither other columns nor the labels of the scored rows matter
    other = run(d.withColumn("source", F.lit("zzz")).withColumn("lang", F.lit("xx")), labels.where(~learning.held_out(F.col("doc_id"))))
    assert Counter((r["doc_id"], round(r["score"], 9)) for r in other.collect()) == Counter((r["doc_id"], round(r["score"], 9)) for r in got)
    odd_rows = run(odd.unionByName(d), labels).where(F.col("doc_id").isNull() | (F.col("doc_id") < 10)).collect()
    assert sum(r["doc_id"] is None for r in odd_rows) == 2 and all(r["score"] is not None for r in odd_rows)
    assert run(none, labels).isEmpty()
    blank = run(odd, labels.limit(0)).collect()
    assert len(blank) == len(ODD) and all(r["score"] is not None for r in blank)


def test_spans(spark, labelled_docs):
    d, labels, truth = labelled_docs
    texts = {r["doc_id"]: r["text"] for r in d.collect()}
    hits = [r for r in toxicity.score(d, labels).where("predicted = 1").collect() if truth[r["doc_id"]][1]]
    found = [texts[r["doc_id"]].lower()[s["start"] : s["end"]] for r in hits for s in r["spans"]]
    assert len(found) > 100 and sum(w.startswith("vile") for w in found) / len(found) > 0.95


def test_quality_against_plain_python():
    """Training and scores against the same rule on dictionaries, feature by feature."""
    import xxhash

    mask = (1 << 64) - 1
    odd = int(quality._ODD)

    def grams(text):
        t = [xxhash.xxh64_intdigest(x) for x in __import__("re").findall(r"[^\W_]+|[^\w\s]+|_+", text.lower())]
        t = [int(quality._SAME) if i and t[i - 1] == x else x for i, x in enumerate(t)]
        out = Counter([0])
        for i, x in enumerate(t):
            out[(x * odd & mask) >> (64 - quality.BITS)] += 1
            if i:
                p = ((t[i - 1] * odd & mask) + x & mask) * odd & mask
                out[(p ^ (p >> 31)) >> (64 - quality.BITS)] += 1
            else:
                out[0] += 1
        return out

    r = random.Random(11)
    sample = [(" ".join(r.choice(["good", "fine", "text"] if k % 2 else ["bad!!", "junk", "junk", "_"]) for _ in range(r.randrange(0, 15))), k % 2) for k in range(40)]
    z, g2 = Counter(), Counter()

    def weight(i):
        if abs(z[i]) <= quality.L1:
            return 0.0
        return (math.copysign(quality.L1, z[i]) - z[i]) / ((quality.BETA + math.sqrt(g2[i])) / quality.ALPHA + quality.L2)

    for _ in range(quality.PASSES):
        for text, y in sample:
            f = grams(text)
            n = math.sqrt(sum(f.values()))
            g = {i: (1 / (1 + math.exp(-sum(weight(j) * c / n for j, c in f.items()))) - y) * c / n for i, c in f.items()}
            for i, x in g.items():
                z[i] += x - (math.sqrt(g2[i] + x * x) - math.sqrt(g2[i])) / quality.ALPHA * weight(i)
                g2[i] += x * x
    w = quality.train(sample)
    assert {int(i) for i in np.flatnonzero(w)} == {i for i in z if weight(i)} and all(abs(w[i] - weight(i)) < 1e-4 for i in z)
    texts = [t for t, _ in sample] + ["", None, "never seen words"]
    got = quality.scores(texts, w)
    for t, s in zip(texts, got, strict=True):
        f = grams(t or "")
        assert abs(s - 1 / (1 + math.exp(-sum(weight(i) * c for i, c in f.items()) / math.sqrt(sum(f.values()))))) < 1e-4


# ---- 5


def plain_distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def test_a_shift_is_never_less_than_the_distance():
    rnd = random.Random(7)
    met = 0
    for _ in range(400):
        a = [rnd.randrange(6) for _ in range(rnd.randrange(14))]
        b = [x for x in a if rnd.random() > 0.1] + [rnd.randrange(6)] * rnd.randrange(2) if rnd.random() < 0.7 else [rnd.randrange(6) for _ in range(rnd.randrange(14))]
        want, got = plain_distance(a, b), near_duplicates.one_shift(np.array(a, "u4"), np.array(b, "u4"))
        assert got >= want
        met += got == want
        longer = max(len(a), len(b))
        assert near_duplicates.similar(np.array(a, "u4"), np.array(b, "u4")) == (want <= int(0.2 * longer + 1e-9))
    assert met > 100
    a = np.arange(100, dtype="u4")
    assert near_duplicates.one_shift(a, np.delete(a, [40, 41])) == 2 and near_duplicates.one_shift(a, a) == 0


def test_banded_distance():
    r = random.Random(5)
    for _ in range(400):
        a = [r.randrange(4) for _ in range(r.randrange(0, 14))]
        b = a[:] if r.random() < 0.5 else [r.randrange(4) for _ in range(r.randrange(0, 14))]
        for _ in range(r.randrange(3)):
            if b:
                b[r.randrange(len(b))] = 9
        want = plain_distance(a, b)
        for most in (0, 1, 2, 5, 20):
            got = near_duplicates.distance(np.array(a, "u4"), np.array(b, "u4"), most)
            assert got == (want if want <= most else most + 1), (a, b, most, want, got)
        longer = max(len(a), len(b), 1)
        assert near_duplicates.similar(np.array(a, "u4"), np.array(b, "u4")) == (want <= 0.2 * longer + 1e-9)


def test_alignment_of_long_texts():
    """Over MASKED words the rows of a word are looked up by window; the distance stays the same."""
    r = random.Random(6)
    a = np.array([r.choice([r.randrange(30), r.randrange(5000)]) for _ in range(3000)], "u4")
    b = a.tolist()
    for _ in range(200):
        i = r.randrange(len(b))
        b[i : i + 1] = r.choice([[], [99999], [b[i], 88888]])
    b = np.array(b, "u4")
    masked = [near_duplicates.distance(a, b, most) for most in (50, 199, 600)]
    old, near_duplicates.MASKED = near_duplicates.MASKED, 10
    try:
        assert [near_duplicates.distance(a, b, most) for most in (50, 199, 600)] == masked
    finally:
        near_duplicates.MASKED = old
    assert masked[0] == 51 and 150 < masked[2] <= 200
    long = np.arange(60_000, dtype="u4")
    other = long.copy()
    other[::100] += 100_000
    assert near_duplicates.distance(long, other, 700) == 600 and near_duplicates.similar(long, other)


def test_kmers_are_labelled():
    w = near_duplicates.word_hashes("a b c d e " * 3)
    k = near_duplicates.kmers(w)
    assert len(set(k.tolist())) == len(k) == 11 and k[0] == near_duplicates.kmers(w[:5])[0]


def near_rows():
    r = random.Random(8)
    rows = [(i, t, "s") for i, t, _ in ODD]
    n = 1000
    for g in range(25):
        base = prose(900 + g, 60 + 11 * g).split()
        for _ in range(1 + g % 5):
            w = base[:]
            for _ in range(r.randrange(0, 1 + len(w) // 25)):
                i = r.randrange(len(w))
                w[i : i + 1] = r.choice([[], ["new"], [w[i], "more"]])
            rows.append((n, " ".join(w).upper() if r.random() < 0.5 else ", ".join(w), "s"))
            n += 1
    shared = prose(5000, 40)
    rows += [(n + k, prose(6000 + k, 80) + " " + shared, "s") for k in range(12)]
    return rows


def plain_groups(rows):
    w = [near_duplicates.word_hashes(t).tolist() for _, t, _ in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        longer, shorter = max(len(w[i]), len(w[j])), min(len(w[i]), len(w[j]))
        if w[i] == w[j] or (shorter >= 5 and longer - shorter <= 0.2 * longer and near_duplicates.similar(np.array(w[i], "u8"), np.array(w[j], "u8"))):
            up[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (d, _, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(rows))], len({find(i) for i in range(len(rows))})


def test_near_duplicates(spark, none):
    rows = near_rows()
    d = docs(spark, rows)
    want, n = plain_groups(rows)
    got = near_duplicates.groups(d)
    assert Counter((r["doc_id"], r["class_id"]) for r in got.collect()) == Counter((i, c) for (i, _, _), c in zip(rows, want, strict=True))
    kept = near_duplicates.deduplicated(d)
    assert kept.columns == d.columns and kept.count() == n and set(near_duplicates.deduplicated(kept).select("doc_id").collect()) == set(kept.select("doc_id").collect())
    assert near_duplicates.groups(none).isEmpty() and near_duplicates.deduplicated(none).isEmpty()


# ---- 7


def test_lm_scores(spark, none):
    rows = [(i, t, s) for i, t, s in ODD] + [(50 + k, prose(k % 7, 20 + k), "s") for k in range(30)] + [(80, "alpha0 beta1 " * 9, "s"), (81, "only here only here", "s")]
    got = lm_scores.score(docs(spark, rows)).collect()
    old, lm_scores.TOP_BITS, lm_scores.TOGETHER, lm_scores.BROADCAST = (lm_scores.TOP_BITS, lm_scores.TOGETHER, lm_scores.BROADCAST), 4, 3, 40
    try:
        few = lm_scores.score(docs(spark, rows)).collect()
        assert len(lm_scores.top_words(lm_scores.unigrams(docs(spark, rows)))) <= 40
    finally:
        lm_scores.TOP_BITS, lm_scores.TOGETHER, lm_scores.BROADCAST = old
    w = [near_duplicates._WORD.findall((t or "").lower()) for _, t, _ in rows]
    c1, c2 = Counter(x for t in w for x in t), Counter(p for t in w for p in itertools.pairwise(t))
    n = sum(c1.values())
    want = []
    for (i, _, _), t in zip(rows, w, strict=True):
        own = Counter(itertools.pairwise(t))
        s = math.log(c1[t[0]] / n) if t else 0.0
        s += sum(math.log((c2[p] - own[p]) / c1[p[0]]) if c2[p] > own[p] else math.log(0.4 * c1[p[1]] / n) for p in itertools.pairwise(t))
        want.append((i, len(t), round(s, 4)))
    for x in (got, few):
        assert Counter((r["doc_id"], r["n_words"], round(r["log_score"], 4)) for r in x) == Counter(want)
    assert all((r["mean_log_score"] is None) == (r["n_words"] == 0) for r in got) and lm_scores.score(none).isEmpty()


# ---- 8 and 9


def tricky():
    r = random.Random(2)
    parts = ["hello", " ", "  ", "\n", "\r\n", "\t", "don't", "I'LL", "...", "!?", "é", "é", "Σ", "日本", "12", "<|endoftext|>", "<|startoftext|>", " ", " ", "\x1c", "\x01", "ß", "🙂", "supercalifragilistic", " a", "."]
    return ["".join(r.choice(parts) for _ in range(r.randrange(0, 25))) for _ in range(600)] + [None, "", " ", "\n", "x" * 3000, "word " * 3000]


def fuzzed(path, n, seed):
    """Texts of pieces of the vocabulary, runs, contractions, special strings, and letters of all planes."""
    from tokenizers import Tokenizer

    vocab = sorted(Tokenizer.from_file(path).get_vocab())
    r = random.Random(seed)
    odd = ["'s", "'re", "'l", "'ll", "\u2019", "<|endoftext|>", "<|startoftext|>", "<|", "\u03a3", "\u0130", "e\u0301", "\u0301", "\u200b", "\xa0", "\x85", "\x1c", "\x0b", "\u2028", "\u3000", "\ufeff", "\u0345", "\u1715", "\ua7cb", "\ua7d2", "\u212a", "1", "\xbd", "\u0663"]
    made = (
        lambda: r.choice(odd),
        lambda: r.choice(vocab).replace("</w>", r.choice(["", " "])),
        lambda: "".join(r.choice("etaoinshrdlu") for _ in range(r.randrange(1, 14))),
        lambda: chr(r.choice([r.randrange(32, 0x3000), r.randrange(0xA000, 0xD7FF), r.randrange(0xE000, 0x1FFFF)])),
        lambda: r.choice(" \n\t"),
        lambda: r.choice("aeiou!#$%*-=_.") * r.randrange(1, 40),
    )
    return ["".join(r.choice(made)() for _ in range(r.randrange(1, 30))) for _ in range(n)]


def test_token_counts_equal_the_library(spark, odd, none):
    from tokenizers import Tokenizer

    path = catalog.vocabulary("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    texts = tricky() + fuzzed(path, 3000, 7)
    want = [len(e.ids) for e in lib.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    m = tokencounts.Machine(path)
    assert m.counts(texts) == want
    assert len(m.states) < len(m.go) and all(to < len(m.states) for to, _ in m.go.values()) and any(n <= 0 for _, n in m.go.values())
    m.states.extend([()] * tokencounts.STATES)  # too many: it starts anew
    assert m.counts(texts[-500:]) == want[-500:] and len(m.states) < tokencounts.STATES
    r = random.Random(3)
    for t, n in r.sample(list(zip(texts, want, strict=True)), 400):
        k = r.randrange(1, 30)
        maps = tokencounts.chunk_maps(m, [(t or "")[i : i + k] for i in range(0, max(1, len(t or "")), k)])
        cut = r.randrange(len(maps) + 1)
        halves = [tokencounts.composed(m, h) for h in (maps[:cut], maps[cut:]) if h]
        assert tokencounts.composed(m, halves) == tokencounts.composed(m, maps)
        assert tokencounts.finished(m, tokencounts.composed(m, maps)) == n
    rows = odd.unionByName(docs(spark, [(100 + k, t, "s") for k, t in enumerate(texts[-60:])]))
    lens = [(r["doc_id"], r["text"] or "") for r in rows.collect()]
    want = Counter((i, len(t.encode()), n, n > 100) for i, t in lens for n in [len(lib.encode(t, add_special_tokens=False).ids)])
    old, tokencounts.RUN = tokencounts.RUN, 3
    try:
        for chunk, long in ((1 << 15, 1 << 16), (7, 20), (300, -1)):  # none, some and all dealt in chunks
            got = tokencounts.count_tokens(rows, path, 100, chunk, long).collect()
            assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got) == want
    finally:
        tokencounts.RUN = old
    assert tokencounts.count_tokens(none, path).isEmpty()


def test_encoder_equals_the_library():
    from tokenizers import Tokenizer

    path = catalog.vocabulary("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    texts = tricky()
    e = tokenfiles.Encoder(path, 2)
    want = [np.array(x.ids + [2], "<u2").tobytes() for x in lib.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert e.encode(texts) == want and e.encode(texts[::-1]) == want[::-1]


def test_token_files(spark, odd, none):
    from tokenizers import Tokenizer

    path = catalog.vocabulary("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    d = odd.unionByName(docs(spark, [(k, prose(k, 20), "s") for k in range(-50, 0)]))
    got = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["start"]), r["start"], r["n_tokens"], r["ids_crc32"]) for r in tokenfiles.round_trip(d, path, 2).collect())
    at = 0
    for _, start, n, _ in got:
        assert start == at
        at += n
    rows = Counter((i, len(lib.encode(t or "", add_special_tokens=False).ids) + 1, zlib.crc32(np.array(lib.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes())) for i, t in [(r["doc_id"], r["text"]) for r in d.collect()])
    assert rows == Counter((k[1] if k[0] else None, n, c) for k, _, n, c in got)
    assert tokenfiles.round_trip(none, path, 2).isEmpty()


def test_token_files_of_one_hot_id(spark, tmp_path):
    """Rows of one doc_id fill several parts, in order; files that ``parts`` doesn't name are no part of the data set."""
    path = catalog.vocabulary("byte_bpe_50k.json")
    d = docs(spark, [(7, prose(k, 5), "s") for k in range(200)] + [(k, "x", "s") for k in (1, 2, 9, 10)])
    at = f"file://{tmp_path}/files"
    parts = tokenfiles.write(d, at, path, 2).collect()
    assert len(parts) > 2
    (tmp_path / "files" / "part-000001-lost.ids").write_bytes(b"zz")
    got = sorted(tokenfiles.read_digests(spark, at, path, 2).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [1, 2] + [7] * 200 + [9, 10] and sum(p["docs"] for p in parts) == 204


# ---- 10


def test_permutation(spark):
    for n in (1, 2, 7, 64, 1000):
        df = mixing.permuted(spark.range(n).withColumn("n", F.lit(n).cast("long")), "id", "n", "to", F.lit("k"))
        to = [r["to"] for r in df.orderBy("id").collect()]
        assert sorted(to) == list(range(n)) and (n < 64 or to != list(range(n)))


def plain_targets(sizes):
    names = sorted((k for k in sizes if k is not None), key=lambda k: k.encode()) + [None] * (None in sizes)
    weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(names)}
    total, out, free = sum(sizes.values()), {}, set(names)
    while free:
        level = (total - sum(out.values())) / sum(weight[k] for k in free)
        over = [k for k in free if level * weight[k] > 3 * sizes[k]]
        if not over:
            return out | {k: level * weight[k] for k in free}
        for k in over:
            out[k] = 3.0 * sizes[k]
            free.discard(k)
    return out


def check_mix(spark, rows, shard_slots=mixing.SHARD_SLOTS):
    d = docs(spark, rows)
    got = mixing.mix_report(d, 0, shard_slots).collect()
    size = lambda t: len(__import__("re").findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, size(t)) for i, t, _ in rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += size(t)
    target = plain_targets(sizes)
    want = Counter((i, size(t), sizes[s], round(target[s], 6)) for i, t, s in rows)
    assert Counter((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6)) for r in got) == want
    assert all(0 <= r["taken"] <= 3 * r["size"] and (r["taken"] > 0) == (r["first_shard"] is not None) for r in got)
    shards = -(-sum(target.values()) // (mixing.BLOCK_WORDS * shard_slots))
    by, near = Counter(), {}
    for r in got:
        by[r["source_size"], r["target"]] += r["taken"]
    for s in sizes:
        near[sizes[s], target[s]] = near.get((sizes[s], target[s]), 0) + target[s]
    for (n, t), total in by.items():
        [w] = [v for (a, b), v in near.items() if a == n and abs(b - t) < 1e-6 * max(1, t)]
        assert abs(total - w) <= mixing.BLOCK_WORDS * (max(1, round(w / max(t, 1e-9))) + (4 * math.sqrt(shards) if shards > 1 else 0))
    assert Counter(map(tuple, mixing.mix_report(d, 0, shard_slots).collect())) == Counter(map(tuple, got))
    mixed = mixing.mixed_documents(d, 0, shard_slots)
    assert mixed.columns == d.columns
    out, cut, slots = Counter(), Counter(), Counter()
    for r in mixed.collect():
        out[r["doc_id"]] += size(r["text"])
        assert r["n_chars"] == len(r["text"])
    for r in mixing.mixed_blocks(d, 0, shard_slots).collect():
        cut[r["doc_id"]] += size(r["text"])
        slots[r["shard"], r["slot"]] += size(r["text"])
    taken = Counter()
    for r in got:
        taken[r["doc_id"]] += r["taken"]
    assert +out == +taken == +cut
    assert all(n <= mixing.BLOCK_WORDS for n in slots.values()) and all(n <= shard_slots for n in Counter(k for k, _ in slots).values())
    return got, Counter(k for k, _ in slots)


def test_draw(spark):
    d = docs(spark, [(k, prose(k, 300), f"s{k % 7}") for k in range(210)])
    src = mixing.source_targets(mixing.sized(d)).persist()
    want = {r["_src"]: r["_slots"] for r in src.collect()}
    totals = []
    for seed in range(6):
        n = mixing.draw_counts(src, 64, seed).collect()
        per = Counter()
        for r in n:
            per[r["shard"]] += r["n"]
            assert r["n"] < 64 * want[r["_src"]] / sum(want.values()) + 7
        assert sum(per.values()) == sum(want.values()) and sorted(per)[-1] == len(per) - 1 and all(per[k] == 64 for k in range(len(per) - 1))
        totals.append({s: sum(r["n"] for r in n if r["_src"] == s) for s in want})
        slots = mixing.draw_slots(src, 64, seed).groupBy("shard", "_src").count().collect()
        full = {s for s in want if totals[-1][s] <= 3 * next(r["_blocks"] for r in src.collect() if r["_src"] == s)}
        assert {(r["shard"], r["_src"], r["count"]) for r in slots if r["_src"] in full} == {(r["shard"], r["_src"], r["n"]) for r in n if r["_src"] in full}
    assert len({tuple(t.items()) for t in totals}) > 1  # the draw decides how much of a source is taken
    assert all(abs(np.mean([t[s] for t in totals]) - want[s]) < 6 for s in want)
    blocks = [{(r["_src"], r["_block"], r["pass"]) for r in mixing.draw_slots(src, 64, seed).collect()} for seed in (0, 1)]
    assert blocks[0] != blocks[1]


def test_mix(spark, none):
    r = random.Random(4)
    check_mix(spark, ODD)
    many = [(k, prose(k, r.randrange(0, 400)), r.choice(["a", "a", "a", "b", "c", "Z", "é", None])) for k in range(300)]
    check_mix(spark, many)
    _, shards = check_mix(spark, many, 64)
    assert len(shards) > 10
    check_mix(spark, [(1, "only", "a"), (2, prose(1, 5000), "b")])
    check_mix(spark, [(1, None, "a"), (2, "", None)])
    assert mixing.mix_report(none).isEmpty() and mixing.mixed_documents(none).isEmpty() and mixing.mixed_blocks(none).isEmpty()


def test_lm_documents_are_named_by_a_byte(spark):
    """Also beyond 127; n-grams carry no hash of their document, which nothing would compress."""
    rows = spark.createDataFrame([(7 * k << 40, f"a b w{k}") for k in range(300)], "row long, text string").coalesce(1)
    packed = lm_scores._packed(rows, np.array([], "i8"), np.array([]), 5)
    assert packed.schema["rows"].dataType.simpleString() == "array<tinyint>"
    grams = lm_scores.exploded(packed).select("row", "v", "w").collect()
    own = {r["row"]: r["w"] for r in grams if r["v"] == lm_scores.DOCUMENT}
    assert len(own) == 300 and set(own.values()) == {7 * k << 40 for k in range(300)}
    last = {r["row"]: r["w"] for r in grams if r["v"] == lm_scores.WORD and r["w"] not in (k - (1 << 64) for k in map(lm_scores.word_key, "ab"))}
    assert all(last[i] == lm_scores.word_key(f"w{w // 7 >> 40}") - (1 << 64) for i, w in own.items())
