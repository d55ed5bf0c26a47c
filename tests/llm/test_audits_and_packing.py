"""Divergence of sources, interaction of filters and packing, on small tables with odd rows, against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tracewarden.llm import catalog, filter_audit, packing, source_divergence

ODD = [(1, None, None, None), (2, "", "a", "en"), (3, " \n\t ", "a", ""), (4, "One two #\nTWO", "b", "en"), (4, "One two #\nTWO", "b", "en"), (None, "five", None, "en"), (None, None, "b", None), (None, "five", "b", "en"), (7, "Some words to go on with " * 900, "a", "en"), (8, "five", "c", "fr"), (9, "a" * 70000, "b", "en")]


def corpus(seed: int, n: int = 160):
    r = random.Random(seed)
    words = ["the", "The", "été", "Ünder", "don't", "x1y", "ÀB", "zeta", "#tag", "A|B", "名前", "áb", *(f"w{chr(97 + i)}" for i in range(20))]
    texts = [" ".join(r.choice(words) for _ in range(r.choice([0, 3, 20, 60, 200]))) for _ in range(n // 2)]
    return [(k if k % 17 else None, r.choice(texts), r.choice(["a", "a", "a", "b", "c", "é", None]), r.choice(["en", "en", "de", None])) for k in range(n)]


def frame(spark, rows):
    kinds = "doc_id long, text string, source string, lang string, n long, mask int, part string, term string, length long"
    return spark.createDataFrame([(*r, 1, 2, "x", "y", 3) for r in rows], kinds).repartition(3)


def plain_divergence(rows, least):
    docs = [(s or "", g or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for _, t, s, g in rows]
    out = set()
    for lang in {g for _, g, _ in docs}:
        own = [(s, ws) for s, g, ws in docs if g == lang]
        df = Counter(w for _, ws in own for w in set(ws))
        kept = [w for w in df if df[w] >= least]
        sources = {s for s, _ in own}
        n = {s: Counter(w for s2, ws in own if s2 == s for w in ws if df[w] >= least) for s in sources}
        n[None] = Counter(w for _, ws in own for w in ws if df[w] >= least)
        p = {s: {w: 1 + 10**9 * (n[s][w] + 2) // (sum(n[s].values()) + 2 * len(kept)) for w in kept} for s in n}
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in sources:
            pairs = sorted(((sum(f(p[s][w], p[o][w]) for w in kept), o) for o in sources if o != s), key=lambda x: (-x[0], x[1].encode()))
            terms = sorted(((f(p[s][w], p[None][w]), w) for w in kept if n[s][w] and p[s][w] > p[None][w]), key=lambda x: (-x[0], x[1].encode()))[:10]
            out |= {(lang, s, part, item, v, k) for part, found in (("pair", pairs), ("term", terms)) for k, (v, item) in enumerate(found, 1)}
    return out


@pytest.mark.parametrize("rows", [ODD, ODD[:1] * 3, corpus(1), corpus(2, 600), ODD + corpus(3)])
@pytest.mark.parametrize("small", [False, True])
def test_divergence(spark, rows, small, monkeypatch):
    """Also with tables that are emptied and added up all the time, pairs by few sources at once, and groups met by shuffling."""
    if small:
        for name, n in (("SLICE", 100), ("FULL", 5), ("MERGED", 20), ("PAIRS", 2), ("GROUPS", 0)):
            monkeypatch.setattr(source_divergence, name, n)
    got = [tuple(r) for r in source_divergence.divergence(frame(spark, rows), 3).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_divergence(rows, 10)


def test_price_of_large_counts(spark):
    n, size, kept = 10**13, 10**15, 10**7
    row = spark.range(1).select(source_divergence._price(F.lit(n), F.lit(size), F.lit(kept)).alias("p"), source_divergence._price(F.lit(0), F.lit(0), F.lit(0)).alias("q")).first()
    assert row["p"] == 1 + 10**9 * (n + 2) // (size + 2 * kept) and row["q"] is None


def plain_audit(rows, labels):
    good, toxic = ({i for i, q, t in labels if (q, t)[k] == 1 and i is not None} for k in (0, 1))
    least = {}
    for i, t, *_ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    by = defaultdict(list)
    for i, t, s, _ in rows:
        t = t or ""
        ws = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(ws) < 50, "B": 100 * len(set(ws)) < 65 * len(ws), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > least[t]}
        by[s or ""].append(({k for k, v in fails.items() if v}, i in good, i in toxic))
    out = set()
    for part, docs in by.items():
        steps, shapley = [], Counter()
        for order in map("".join, permutations("ABCDE")):
            left, gone = docs, []
            for step, f in enumerate(order, 1):
                bad = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                steps.append((part, order, step, len(left), len(bad), sum(f in d[0] for d in gone), sum(d[0] == {f} for d in docs), sum(d[1] for d in bad), sum(d[2] for d in bad)))
                gone = gone + bad
                shapley[f] += len(bad)
        out |= {(*x, shapley[x[1][x[2] - 1]]) for x in steps}
    return out


@pytest.mark.parametrize("rows", [ODD, ODD[:1] * 3, corpus(4)])
def test_filter_audit(spark, rows):
    labels = [(1, 1, 0), (4, 1, 1), (4, 0, 0), (7, None, 1), (7, 1, None), (None, 1, 1), (77, 1, 1), (3, 0, 0), *((k, k % 2, k % 3 // 2) for k in range(10, 90))]
    told = spark.createDataFrame([(*x, "z") for x in labels], "doc_id long, quality int, toxic int, part string")
    got = [tuple(r) for r in filter_audit.audit(frame(spark, rows), told).collect()]
    assert len(got) == 600 * len({r[2] or "" for r in rows}) and set(got) == plain_audit(rows, labels)


def check_packing(spark, rows, size, end):
    path = catalog.vocabulary("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    want = Counter()
    for i, t, *_ in rows:
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + ([] if end is None else [end]), "<u4")
        for k, at in enumerate(range(0, len(ids), size)):
            own = ids[at : at + size].tobytes()
            want[i, k, at, len(own) // 4, own] += 1
    packed = packing.pack(frame(spark, rows), path, end, size).persist()
    got = packed.collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], bytes(r["ids"])) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"], bytes(r["ids"])))
    for found in by.values():
        assert [o for o, _, _ in sorted(found)] == [sum(n for _, n, _ in sorted(found)[:k]) for k in range(len(found))] and sum(n for _, n, _ in found) <= size
    whole = {r["sequence_id"]: (r["length"], bytes(r["ids"]), r["bounds"]) for r in packing.sequences(packed).collect()}
    assert whole == {k: (sum(n for _, n, _ in v), b"".join(x for _, _, x in sorted(v)), [o for o, _, _ in sorted(v)]) for k, v in by.items()}
    packed.unpersist()
    made = packing.plan(dict(Counter(r["length"] for r in got)), size)
    assert len(by) == made.sequences
    return made


def test_packing(spark):
    made = check_packing(spark, corpus(5), 512, 1)
    assert made.sequences <= made.bound * 1.05 + 1
    check_packing(spark, ODD, 512, 1)
    check_packing(spark, ODD, 4096, None)
    check_packing(spark, ODD[:1] * 5, 2, 1)
    assert packing.pack(frame(spark, []), catalog.vocabulary("word_bpe_49k.json"), 1).isEmpty()
    digests = packing.pack_digests(frame(spark, ODD), catalog.vocabulary("word_bpe_49k.json"), 1).collect()
    ids = packing.pieces(frame(spark, ODD), catalog.vocabulary("word_bpe_49k.json"), 1).collect()
    assert Counter((r["doc_id"], r["start"], r["ids_crc32"]) for r in digests) == Counter((r["doc_id"], r["start"], zlib.crc32(r["ids"])) for r in ids)


def test_word_encoder(monkeypatch):
    """As the library, for every character below U+0300, other scripts and marks, odd white space and special tokens; with tables that are emptied, in stretches."""
    path = catalog.vocabulary("word_bpe_49k.json")
    library, enc = Tokenizer.from_file(path), packing.WordEncoder(path)
    r = random.Random(8)
    chars = [chr(c) for c in range(0x300)]
    odd = [*"\x1c\x1f\x85́ͅΑΣ ᠎   　名前가नि", "", "<|endoftext|>", "<|startoftext|>", "'s", "\U0001f600"]
    texts = ["", " ", *(f"ab{c}cd {c}{c} 's{c}'T {c}\n{c}X" for c in chars), *("".join(r.choice(chars + odd * 20 + [" ", "a", "B", "7"] * 60) for _ in range(400)) for _ in range(300)), "x" * 5000, "名" * 3000]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in enc.ids(texts)] == want
    monkeypatch.setattr(packing, "KEPT", 50)
    monkeypatch.setattr(packing, "SLICE", 30)
    assert [x.tolist() for t in texts[::5] for x in enc.ids([t])] == want[::5]


def test_memory_of_the_word_encoder():
    """Texts without white space leave nothing behind; others no more than the bound."""
    enc = packing.WordEncoder(catalog.vocabulary("word_bpe_49k.json"))
    for k in range(40):
        enc.ids([hashlib.sha256(f"{k} {j}".encode()).hexdigest() * 8 for j in range(50)])
    assert not enc.known and enc.known_chars == 0 and enc.spelled_chars == sum(map(len, enc.spelled)) < 10_000  # parts between digits
    enc.ids([" ".join(map(str, range(1000)))])
    assert enc.known_chars == sum(map(len, enc.known)) and enc.spelled_chars == sum(map(len, enc.spelled))


@pytest.mark.parametrize(
    "name, lengths",
    [("spread", [random.Random(k).randrange(1, 4097) ** 2 // 4096 + 1 for k in range(4000)]), ("pairs and threes", [random.Random(k).randrange(1400, 2700) for k in range(3000)]), ("one length", [12] * 5000), ("whole", [4096] * 50), ("halves", [2048] * 7 + [2049] * 3), ("few", [5, 4000, 90])],
)
def test_plan(name, lengths):
    """Holds every piece once, and comes near its own lower bound."""
    made = packing.plan(dict(Counter(lengths)))
    held = Counter()
    for config, times in made.configs:
        assert 0 < sum(k * c for k, c in config.items()) <= 4096 and times > 0
        for k, c in config.items():
            held[k] += c * times
    assert held == Counter(lengths) and made.sequences == sum(t for _, t in made.configs)
    assert made.bound <= made.sequences <= made.bound * 1.02 + 1
    assert packing.plan(dict(Counter(reversed(lengths)))) == made


def test_bound_against_all_packings():
    """The lower bound never passes the optimum, which a search over all packings of few pieces finds."""
    r = random.Random(3)

    def least(pieces, size):
        best = len(pieces)

        def place(at, bins):
            nonlocal best
            if len(bins) >= best:
                return
            if at == len(pieces):
                best = len(bins)
                return
            for k in range(len(bins)):
                if bins[k] + pieces[at] <= size:
                    place(at + 1, [*bins[:k], bins[k] + pieces[at], *bins[k + 1 :]])
            place(at + 1, [*bins, pieces[at]])

        place(0, [])
        return best

    for _ in range(60):
        size = r.choice([10, 17, 30])
        pieces = sorted((r.randrange(1, size + 1) for _ in range(r.randrange(1, 9))), reverse=True)
        made = packing.plan(dict(Counter(pieces)), size)
        assert made.bound <= least(pieces, size) <= made.sequences <= least(pieces, size) + 1
