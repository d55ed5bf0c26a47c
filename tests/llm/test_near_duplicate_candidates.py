"""Pairs that meet only in buckets of a shared passage, and the share of pairs at the threshold that meet at all."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
from test_llm_rows import docs, plain_groups

from tracewarden.llm import near_duplicates


def spread(r, words, n):
    """``words`` with n of them replaced, evenly."""
    w = list(words)
    for i in range(n):
        w[(2 * i + 1) * len(w) // (2 * n)] = f"new{r.randrange(10**9)}"
    return w


def shared_passage_rows(pairs):
    r = random.Random(11)
    fresh = lambda n: [f"w{r.randrange(10**9)}" for _ in range(n)]
    passage, rows = fresh(120), []
    for k in range(pairs):
        own = fresh(80)
        rows += [(2 * k, " ".join(own + passage), "s"), (2 * k + 1, " ".join(spread(r, own, 27) + passage), "s")]
    return rows


def test_pairs_that_meet_in_mixed_buckets_only(spark):
    rows = shared_passage_rows(40)
    want, n = plain_groups(rows)
    assert n == 40
    members, near_duplicates.MEMBERS = near_duplicates.MEMBERS, 16
    try:
        got = near_duplicates.groups(docs(spark, rows)).collect()
    finally:
        near_duplicates.MEMBERS = members
    assert Counter((r["doc_id"], r["class_id"]) for r in got) == Counter((i, c) for (i, _, _), c in zip(rows, want, strict=True))


def test_pairs_at_the_threshold_share_a_value():
    r = random.Random(12)
    met = 0
    for _ in range(200):
        a = [r.getrandbits(60) for _ in range(200)]
        b = a[:]
        for i in r.sample(range(200), 40):
            b[i] = r.getrandbits(60)
        x, y = np.array(a, "u8"), np.array(b, "u8")
        assert near_duplicates.similar(x, y)
        met += bool((near_duplicates.sketch(x) == near_duplicates.sketch(y)).any())
    assert met >= 0.85 * 200


def test_pairs_are_compared_in_their_first_bucket():
    words = [np.array([1, 2, 3, 4, 5, 6], "u4")] * 3
    ids, apart = np.arange(3), np.arange(3)
    block = np.zeros(3, int)
    assert near_duplicates._links_within(ids, apart, block, words, [[], [], []]) == [(0, 1), (0, 2)]
    assert near_duplicates._links_within(ids, apart, block, words, [[8], [8], [9]]) == [(0, 2), (1, 2)]
    assert near_duplicates._links_within(ids, apart, block, words, [[8, 9], [8, 9], [9]]) == []


def test_rare_tokens_of_similar_texts_meet():
    """For any order of tokens: what ``rarest`` gives of two similar texts has as many in common as it says."""
    r, met = random.Random(5), Counter()
    for _ in range(4000):
        n, vocabulary = r.randrange(5, 60), r.choice([3, 30, 10**6])
        a = [r.randrange(vocabulary) for _ in range(n)]
        b = a[:]
        for _ in range(r.randrange(0, n // 4 + 2)):
            i, what = r.randrange(len(b)), r.choice("rdi")
            b[i : i + (what != "i")] = [] if what == "d" and len(b) > 5 else [r.randrange(vocabulary)]
        x, y = np.array(a, "u4"), np.array(b, "u4")
        if not near_duplicates.similar(x, y):
            continue
        seen = np.array([r.randrange(4) for _ in range(64)], "u4")
        for gram in near_duplicates.GRAMS:
            (s, k), (t, m) = near_duplicates.rarest(x, gram, seen), near_duplicates.rarest(y, gram, seen)
            assert len(set(s.tolist())) == len(s) and len(set(s.tolist()) & set(t.tolist())) >= min(k, m)
            met[gram] += 1
    assert min(met.values()) > 1000


def test_tokens_are_met_in_any_batches(monkeypatch):
    r = random.Random(1)
    for _ in range(200):
        most, step = r.choice([2, 4, 6]), r.choice([1, 3, 7, 100])
        monkeypatch.setattr(near_duplicates, "FREQUENT", most)
        rows = sorted((r.randrange(-6, 6), r.randrange(1000), r.randrange(4), r.randrange(50, 100), r.randrange(1, 4)) for _ in range(r.randrange(1, 90)))
        want = []
        for t in sorted({x[0] for x in rows}):
            g = [x[1:] for x in rows if x[0] == t]
            if len(g) > most:
                want += [(n, None, None, t, root) for n, root, _, _ in g]
            else:
                want += [(min(a[0], b[0]), max(a[0], b[0]), min(a[3], b[3]), None, None) for i, a in enumerate(g) for b in g[i + 1 :] if a[1] != b[1] and min(a[2], b[2]) >= 0.8 * max(a[2], b[2]) - 1e-6]
        batches = [pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[i : i + step], strict=True), [pa.int64()] * 4 + [pa.int32()], strict=True)], ["token", "node", "root", "size", "common"]) for i in range(0, len(rows), step)]
        got = [tuple(x.values()) for b in near_duplicates._met(iter(batches)) for x in b.to_pylist()]
        assert Counter(got) == Counter(want)


def compared(spark, rows, monkeypatch):
    """The classes, and how many members are left to be compared bucket by bucket."""
    left, whole = [], near_duplicates._compared
    monkeypatch.setattr(near_duplicates, "_compared", lambda rest, classes: (left.append(rest.select("node").distinct().count()), whole(rest, classes))[1])
    got = near_duplicates.groups(docs(spark, rows)).collect()
    monkeypatch.setattr(near_duplicates, "_compared", whole)
    want, n = plain_groups(rows)
    assert Counter((r["doc_id"], r["class_id"]) for r in got) == Counter((i, c) for (i, _, _), c in zip(rows, want, strict=True))
    return sum(left), n


def test_unlike_texts_that_share_a_passage_are_not_compared(spark, monkeypatch):
    r = random.Random(6)
    passage = [f"p{k}" for k in range(120)]
    rows = [(k, " ".join([*passage, *(f"w{r.randrange(10**9)}" for _ in range(60))]), "s") for k in range(120)]
    # near copies of one of them, more than are frequent, and pairs that only their own words tell apart
    rows += [(200 + k, " ".join([*passage, *rows[0][1].split()[120:170], *(f"v{k}{j}" for j in range(10))]), "s") for k in range(60)]
    rows += [(300 + k, " ".join([*passage, *rows[k][1].split()[120:152], *(f"u{k}{j}" for j in range(28))]), "s") for k in range(1, 20)]
    left, n = compared(spark, rows, monkeypatch)
    assert n >= 100 and left <= 65


def test_texts_of_frequent_words_only(spark, monkeypatch):
    """Nothing is rare in them, so what is left is compared in blocks; the largest component isn't held against itself."""
    monkeypatch.setattr(near_duplicates, "FREQUENT", 4)
    monkeypatch.setattr(near_duplicates, "MEMBERS", 8)
    r = random.Random(7)
    passage = [f"p{k}" for k in range(60)]
    rows = [(k, " ".join([*passage, *(r.choice("abcd") for _ in range(40))]), "s") for k in range(40)]
    rows += [(100 + k, " ".join([*passage, *rows[0][1].split()[60:96], *(r.choice("abcd") for _ in range(4))]), "s") for k in range(30)]
    left, _ = compared(spark, rows, monkeypatch)
    assert left > 8


def written(monkeypatch, spark, rows, what):
    """The rows of the intermediate tables named ``what``."""
    n, whole = [], near_duplicates.materialize
    monkeypatch.setattr(near_duplicates, "materialize", lambda df, name, **more: (out := whole(df, name, **more), n.append(out.count()) if name == what else None)[0])
    near_duplicates.groups(docs(spark, rows)).collect()
    monkeypatch.setattr(near_duplicates, "materialize", whole)
    return n


def test_buckets_of_four_are_gone_through_by_anchors(spark, monkeypatch):
    r = random.Random(8)
    rows = []
    for k in range(10):
        passage = [f"p{k}x{j}" for j in range(120)]
        rows += [(4 * k + i, " ".join([*passage, *(f"w{r.randrange(10**9)}" for _ in range(60))]), "s") for i in range(4)]
    assert written(monkeypatch, spark, rows, "wanted") == [0]


def test_unlike_texts_of_common_words_meet_seldom(spark, monkeypatch):
    """Words that chance brings together are no candidates: their pairs, which grow with the square of the texts, stay few."""
    r = random.Random(9)
    passage = [f"p{k}" for k in range(120)]
    rows = [(k, " ".join([*passage, *(f"w{r.randrange(600)}" for _ in range(100))]), "s") for k in range(240)]
    met = written(monkeypatch, spark, rows, "met")
    assert met and sum(met) < 4 * len(rows)


def test_tokens_are_counted_in_cells(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "CELLS", 1000)
    monkeypatch.setattr(near_duplicates, "SLICES", 7)
    r = random.Random(10)
    texts = [np.array([r.randrange(5000) for _ in range(r.randrange(1, 90))], "<u4") for _ in range(50)]
    members = spark.createDataFrame([(w.tobytes(),) for w in texts], "words binary").repartition(3)
    for gram in near_duplicates.GRAMS:
        want = sum(np.bincount((near_duplicates.tokens(w, gram)[1] % np.uint64(1000)).astype("i8"), minlength=1000) for w in texts)
        assert near_duplicates._histogram(members, gram).tolist() == want.tolist()
    assert not near_duplicates._histogram(members.where("false"), 1).any()


def test_anchors_are_different_members(spark):
    slots = spark.createDataFrame([(b, 10 * b + i) for b in range(1, 8) for i in range(b)], "bucket long, node long")
    got = near_duplicates._anchored(slots).collect()
    assert Counter(r["bucket"] for r in got) == {b: b for b in range(2, 8)}
    for r in got:
        anchors = [r[a] for a in near_duplicates.ANCHORS if r[a] is not None]
        assert len(set(anchors)) == len(anchors) == min(r["bucket"], near_duplicates.ROUNDS) and anchors[0] == 10 * r["bucket"]
        assert all(a // 10 == r["bucket"] for a in anchors)


def test_similar_texts_meet_by_rare_tokens_or_are_both_left_over(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "FREQUENT", 3)
    r = random.Random(13)
    texts = []
    for k in range(40):
        base = [r.randrange(r.choice([40, 10**6])) for _ in range(r.randrange(12, 90))]
        for _ in range(r.randrange(1, 7)):
            w = base[:]
            for _ in range(r.randrange(0, len(base) // 4)):
                w[r.randrange(len(w))] = r.randrange(r.choice([40, 10**6]))
            texts.append((len(texts), len(texts) if r.random() < 0.8 else 1000 + k, len(w), np.array(w, "<u4")))
    members = spark.createDataFrame([(*t[:3], t[3].tobytes()) for t in texts], "node long, root long, size long, words binary").repartition(3)
    for gram in near_duplicates.GRAMS:
        links, rest = near_duplicates._by_rare_tokens(members, members, gram)
        links, rest = {tuple(x) for x in links.collect()}, {x["node"] for x in rest.collect()}
        wanted = {(a, b) for a, ra, _, x in texts for b, rb, _, y in texts if a < b and ra != rb and near_duplicates.similar(x, y)}
        assert links <= wanted and all(a in rest and b in rest for a, b in wanted - links)
        assert links and 0 < len(rest) < len(texts)


def test_frequent_tokens_make_no_rows(spark, monkeypatch):
    """Unlike texts that share many words: a row for each text and frequent word, and pairs that are compared later anyway, aren't written."""
    r = random.Random(14)
    passage = [f"p{k}" for k in range(120)]
    rows = [(k, " ".join([*passage, *(f"q{j}" if r.random() < 0.6 else f"w{r.randrange(10**9)}" for j in range(60))]), "s") for k in range(240)]
    assert sum(written(monkeypatch, spark, rows, "met")) < len(rows)


def test_buckets_of_the_same_members_have_the_same_anchors(spark):
    """Texts that share a passage share dozens of buckets: they aren't held against another anchor for each."""
    slots = spark.createDataFrame([(b, 100 + i) for b in range(60) for i in range(30)], "bucket long, node long")
    assert near_duplicates._anchored(slots).select(*near_duplicates.ANCHORS).distinct().count() == 1
