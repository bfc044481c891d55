"""Alignment against plain tokenization of whole texts, token by token."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from texts import TEXTS
from tokenizers import Tokenizer

from partwise.llm import align
from partwise.llm.pieces import MODEL_PATH

EXTRA = ["  two  spaces", "a \n b", " x", "x ", "end.\nNext line\r\n\r\n  indented", "<|endoftext|> and <s> </s> <unk>", " a  b  c 　", "a\x1cb \x1dc",
         "don't 's can't've 123 45,6", "\U0001f600 \U0001f600\U0001f600 ‍", "tab\there \tthere", "word " * 300, "x" * 3000 + " y", "\x85 \x85a", "é ́"]


@pytest.fixture(scope="module")
def vocabularies():
    return align.Vocabularies.load()


def brute(rows, vocabularies):
    byte_model = Tokenizer.from_file(align.BYTE_PATH)
    byte_model.encode_special_tokens = True
    piece_model = sentencepiece.SentencePieceProcessor(model_file=MODEL_PATH)
    done, held = [], Counter()
    for doc_id, text in rows:
        groups = []
        if text:
            raw = (" " + text).encode()
            a, b = byte_model.encode(" " + text, add_special_tokens=False).ids, piece_model.encode(text)
            sides = []
            for ids, entries in ((a, vocabularies.a_bytes), (b, vocabularies.b_bytes)):
                sides.append((b"".join(entries[i] for i in ids), np.cumsum([len(entries[i]) for i in ids]).tolist()))
            if sides[0][0] == raw == sides[1][0]:
                both = set(sides[0][1]) & set(sides[1][1])
                cuts = [[0] + [k + 1 for k, e in enumerate(s[1]) if e in both] for s in sides]
                groups = [(a[p:q], b[r:s]) for p, q, r, s in zip(cuts[0], cuts[0][1:], cuts[1], cuts[1][1:])]
        links = Counter()
        for x, y in groups:
            links.update((i, j) for i in x for j in y)
        held.update(links.keys())
        done.append((doc_id, groups, links))
    top = {}
    for (i, _), n in held.items():
        top[i] = max(top.get(i, 0), n)
    out = []
    for doc_id, groups, links in done:
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((doc_id, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), sum(links.values()),
                    sum(n for p, n in links.items() if held[p] == top[p[0]]), sum(n * held[p] for p, n in links.items()),
                    hashlib.sha256(said.encode()).hexdigest() if groups else ""))
    return out


def key(row):
    return tuple((x is None, x if x is not None else 0) for x in row)


@pytest.mark.parametrize("frequent", [align.FREQUENT, 50, 0])
def test_digest_equals_brute_force(spark, vocabularies, frequent):
    rows = list(enumerate(TEXTS + EXTRA)) + [(None, "a null id"), (7, None), (7, ""), (3, TEXTS[3]), (3, TEXTS[3])]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, `groups` string, n_a long").repartition(3)
    got = sorted(map(tuple, align.digest(frame, vocabularies, frequent).collect()), key=key)
    assert got == sorted(brute(rows, vocabularies), key=key)


def test_random_characters(vocabularies):
    rng = random.Random(4)
    alphabet = "ab .,'\n\t  é日1²\U0001f600▁<|>"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(1500)]
    facts, said, _, _, many = align.Aligner(vocabularies).texts(texts)
    want = brute(list(enumerate(texts)), vocabularies)
    assert [(*map(int, f), hashlib.sha256(s.encode()).hexdigest() if s else "") for f, s in zip(facts, said)] == [(*w[1:5], w[7]) for w in want]


def test_huge_groups_and_small_runs(vocabularies, monkeypatch):
    rows = [(0, "ab日" * 50), (1, "é" * 200 + "x;;;;;;" * 30), (2, " ".join(TEXTS[:5]))]
    usual = align.Aligner(vocabularies).texts([t for _, t in rows])
    monkeypatch.setattr(align, "PAIRS_AT_ONCE", 3)
    for x, y in zip(usual, align.Aligner(vocabularies).texts([t for _, t in rows])):
        assert list(map(str, x)) == list(map(str, y))


@pytest.mark.parametrize("work", [1, 2, 7, 1024])
def test_merge_pieces(work):
    rng = np.random.default_rng(work)
    for n in (1, 5, 300):
        end = 3 * n
        a = np.unique(np.r_[rng.integers(1, end + 1, n), end])
        b = np.unique(np.r_[rng.integers(1, end + 1, n // 2 + 1), end])
        i, j, group_a, group_b = align.merge_pieces(a, b, work)
        spans = [list(zip([0, *x[:-1].tolist()], x.tolist())) for x in (a, b)]
        want = [(p, q) for p, (s, e) in enumerate(spans[0]) for q, (u, v) in enumerate(spans[1]) if s < v and u < e]
        assert sorted(zip(i.tolist(), j.tolist())) == want
        common = np.intersect1d(a, b)
        assert group_a.tolist() == np.searchsorted(common, a).tolist() and group_b.tolist() == np.searchsorted(common, b).tolist()


def test_empty_table(spark, vocabularies):
    assert align.digest(spark.createDataFrame([], "doc_id long, text string"), vocabularies).count() == 0
