"""What workers remember is bounded by characters, whatever the texts; results stay as the library's when it is emptied all the time."""

import hashlib

from tokenizers import Tokenizer

from tracewarden.llm import catalog, tokencounts, tokenfiles

UNSPACED = [hashlib.sha256(f"{k}".encode()).hexdigest() * 20 for k in range(300)]
MIXED = [f"{t[:50]} some words, and more {k}\n{t[50:90]}" for k, t in enumerate(UNSPACED)]


def test_token_counts(monkeypatch):
    monkeypatch.setattr(tokencounts, "KEPT", 20_000)
    path = catalog.vocabulary("word_bpe_49k.json")
    m, library = tokencounts.Machine(path), Tokenizer.from_file(path)
    for texts in (UNSPACED, MIXED):
        for lo in range(0, len(texts), 20):
            some = texts[lo : lo + 20]
            assert m.counts(some) == [len(e.ids) for e in library.encode_batch(some, add_special_tokens=False)]
            assert sum(map(len, m.counted)) <= m.chars <= 20_000 + sum(map(len, some)) + 8 * 200


def test_token_files(monkeypatch):
    monkeypatch.setattr(tokenfiles, "CACHED", 20_000)
    path = catalog.vocabulary("byte_bpe_50k.json")
    enc, library = tokenfiles.Encoder(path, None), Tokenizer.from_file(path)
    for texts in (UNSPACED, MIXED):
        for lo in range(0, len(texts), 20):
            some = texts[lo : lo + 20]
            assert [list(memoryview(x).cast("H" if enc.kind == "<u2" else "I")) for x in enc.encode(some)] == [e.ids for e in library.encode_batch(some, add_special_tokens=False)]
            assert sum(map(len, enc.known)) <= enc.chars + 1 <= 20_000 + sum(map(len, some)) + 8 * 400
