import random

import numpy as np
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as proto

from texts import TEXTS
from partwise.llm import encoding
from partwise.llm.counts import count_one, count_tokens, trie_counts
from partwise.llm.encoding import Decoder, Matcher, encode_documents, encode_words
from partwise.llm.pieces import MODEL_PATH, Pieces, words_of


@pytest.fixture(scope="module")
def pieces():
    return Pieces.load()


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL_PATH)


@pytest.fixture(scope="module")
def unigram_library(pieces):
    """The library's own unigram search over the same pieces and scores."""
    model = proto.ModelProto()
    with open(MODEL_PATH, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    for i, s in zip(pieces.unigram.ids, pieces.unigram.scores, strict=True):
        model.pieces[int(i)].score = float(s)
    return sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())


def by_words(texts, matcher):
    words = list({w for t in texts for w in words_of(t)})
    flat, counts = encode_words(words, matcher)
    ends = np.cumsum(counts)
    ids = {w: flat[e - c:e].tolist() for w, e, c in zip(words, ends, counts, strict=True)}
    return [[i for w in words_of(t) for i in ids[w]] for t in texts]


def test_merges_equal_the_library(pieces, library):
    got = by_words(TEXTS, Matcher(pieces))
    assert got == [library.encode(t) for t in TEXTS]


def test_merges_over_many_small_indexes(pieces, library, monkeypatch):
    monkeypatch.setattr(encoding, "INDEX_CHARS", 50)
    monkeypatch.setattr(encoding, "LONG_WORD", 5)
    assert by_words(TEXTS[:40], Matcher(pieces)) == [library.encode(t) for t in TEXTS[:40]]


def test_decoding_is_exact(pieces, library):
    ids = [library.encode(t) for t in TEXTS]
    back = Decoder(pieces).texts(np.array([i for x in ids for i in x]), np.array([len(x) for x in ids]))
    assert back == [t.replace("▁", " ") for t in TEXTS]


def test_unigram_relaxation_is_as_good_as_the_library(pieces, unigram_library):
    scores = dict(zip(pieces.unigram.ids.tolist(), pieces.unigram.scores.tolist(), strict=True))
    total = lambda ids: sum(scores.get(i, pieces.unigram.unknown_score / 3) for i in ids)
    texts = [t for t in TEXTS if t.isascii() and "\t" not in t and len(t) < 3000]
    for mine, theirs in zip(by_words(texts, Matcher(pieces.unigram)), [unigram_library.encode(t) for t in texts], strict=True):
        assert total(mine) == pytest.approx(total(theirs), rel=1e-6)


def test_trie_counts_equal_the_plain_recursion_and_the_library(pieces, unigram_library):
    words = list({w for t in TEXTS for w in words_of(t)})
    counts = dict(zip(words, trie_counts(words, pieces.unigram).tolist(), strict=True))
    assert all(counts[w] == count_one(w, pieces.unigram) for w in words if len(w) < 200)
    assert [sum(counts[w] for w in words_of(t)) for t in TEXTS] == [len(unigram_library.encode(t)) for t in TEXTS]
    assert trie_counts([], pieces.unigram).tolist() == []


def test_edges_of_tables(spark, edge, nothing, pieces, library, unigram_library):
    rows = encode_documents(edge, pieces, back="decoded").collect()
    assert len(rows) == edge.count()
    for r in rows:
        assert r.ids == (None if r.text is None else library.encode(r.text))
        assert r.decoded == (None if r.text is None else r.text.replace("▁", " "))
    counted = {(r.doc_id, r.n_tokens) for r in count_tokens(edge, pieces.unigram).collect()}
    assert counted == {(r.doc_id, len(unigram_library.encode(r.text or ""))) for r in edge.select("doc_id", "text").collect()}
    assert encode_documents(nothing, pieces).count() == count_tokens(nothing, pieces.unigram).count() == 0


def test_cache_limit_changes_nothing(spark, edge, pieces, monkeypatch):
    rng = random.Random(1)
    rows = [(i, " ".join("".join(rng.choice("abc") for _ in range(5)) for _ in range(30))) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    before = sorted(map(tuple, encode_documents(df, pieces).select("doc_id", "ids").collect()))
    monkeypatch.setattr(encoding, "CACHED_WORDS", 10)
    assert before == sorted(map(tuple, encode_documents(df, pieces).select("doc_id", "ids").collect()))


def test_memory_of_the_kernel_does_not_grow_with_a_batch(spark, monkeypatch):
    import random
    import tracemalloc

    import pyarrow as pa

    from partwise.llm.encoding import encode_documents
    from partwise.llm.pieces import Pieces

    docs, kernels = spark.createDataFrame([(1, "a")], "doc_id long, text string"), []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema: kernels.append(f) or self)
    encode_documents(docs, Pieces.load())
    rng, most = random.Random(1), []
    words = [f"w{i}" for i in range(2000)]
    for rows in (300, 1500):
        texts = [" ".join(rng.choices(words, k=500)) for _ in range(rows)]
        batch = pa.RecordBatch.from_pydict({"doc_id": list(range(rows)), "text": texts})
        tracemalloc.start()
        assert sum(b.num_rows for b in kernels[0](iter([batch]))) == rows
        most.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert most[1] < 1.5 * most[0], most
