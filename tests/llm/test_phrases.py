"""Collocations against a plain count of every phrase."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from partwise.llm import phrases


def brute(rows, longest, least, top):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        folded = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", folded):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            count = f.setdefault(lang, Counter())
            for i in range(len(words)):
                for k in range(1, longest + 1):
                    if i + k <= len(words):
                        count[tuple(words[i:i + k])] += 1
    out = []
    for lang, count in f.items():
        held = {p: a for p, a in count.items() if 2 <= len(p) and a >= least}
        dropped = {q[i:i + k] for q, a in held.items() for k in range(2, len(q)) for i in range(len(q) - k + 1) if 100 * a >= 100 * count[q[i:i + k]]}
        found = []
        for p, a in held.items():
            if p not in dropped:
                score, k = min((1000 * a * n[lang] // (count[p[:k]] * count[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        out += [(lang, r + 1, p.decode(), -a, x, y, n[lang], -s) for r, (s, a, p, x, y) in enumerate(sorted(found)[:top])]
    return sorted(out)


def some_rows(seed=2):
    rng = random.Random(seed)
    words = ["the", "The", "of", "é", "É", "naïve", "x", "日本", "new", "york", "a\x00b", "a b"] + [f"w{i}" for i in range(40)]
    sets = ["new york city hall steps", "in the middle of nowhere at all", "a b a b a b", "THE END"]
    rows = []
    for i in range(300):
        parts = [rng.choice(sets) if rng.random() < 0.3 else rng.choice(words) for _ in range(rng.randint(0, 60))]
        rows.append((rng.choice(["en", "en", "fr", None, "und"]), "".join(p + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "\r\n"]) for p in parts)))
    return rows + [("en", None), (None, ""), ("de", " ., \t"), ("en", "x" * 5000), ("en", "long " * 9000), rows[0], rows[0]]


@pytest.mark.parametrize(("longest", "least", "top"), [(5, 8, 2000), (3, 30, 10), (2, 1, 2000)])
def test_equals_plain_counts(spark, monkeypatch, longest, least, top):
    monkeypatch.setattr(phrases, "BLOCK", 1 << 12)
    monkeypatch.setattr(phrases, "PORTION_BYTES", 1 << 14)
    rows = some_rows()
    frame = spark.createDataFrame([(*r, 1, "b") for r in rows], "lang string, text string, n int, phrase string").repartition(3)
    got = sorted(map(tuple, phrases.mine_phrases(frame, longest=longest, least=least, top=top).collect()))
    assert got == brute(rows, longest, least, top)
    assert got


def test_crowded_bitmaps_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(phrases, "BITMAP_BITS", 1 << 6)
    rows = some_rows(5)
    frame = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(map(tuple, phrases.mine_phrases(frame, least=8).collect())) == brute(rows, 5, 8, 2000)


def test_scores_beyond_64_bits(spark):
    nodes = spark.createDataFrame([(1, "a", 1, 3 * 10 ** 12), (1, "b", 1, 4 * 10 ** 12 + 1), (1, "a b", 2, 2 * 10 ** 12 + 7)], "lang long, phrase string, size int, a long")
    totals = spark.createDataFrame([(1, 9 * 10 ** 15 + 1)], "lang long, n long")
    row = phrases.scored(nodes.filter("size = 2"), nodes, totals).first()
    assert row.score == 1000 * (2 * 10 ** 12 + 7) * (9 * 10 ** 15 + 1) // (3 * 10 ** 12 * (4 * 10 ** 12 + 1))


def test_word_hashes_do_not_depend_on_the_place(monkeypatch):
    monkeypatch.setattr(phrases, "BLOCK", 64)
    raw = np.frombuffer(b"abc " * 100 + b"abcd" + b"x" * 300 + b" abc", np.uint8)
    starts, ends = np.r_[np.arange(0, 400, 4), 400, len(raw) - 3], np.r_[np.arange(3, 403, 4), 704, len(raw)]
    hashes = phrases.word_hashes(raw, starts, ends, phrases.Powers(phrases.FIRST_BASE))
    assert len(set(hashes.tolist())) == 2 and hashes[-1] == hashes[0]


def test_empty_table(spark):
    assert phrases.mine_phrases(spark.createDataFrame([], "lang string, text string")).count() == 0
