import hashlib
import random
import zlib
from collections import Counter

from texts import equal_checksums

from partwise.llm import repeats
from partwise.llm.repeats import remove_repeats


def brute(texts, width=200):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i:i + width] for b in data for i in range(len(b) - width + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if seen[b[i:i + width]] > 1:
                gone[i:i + width] = b"\1" * width
        runs = sum(1 for i in range(len(gone)) if gone[i] and not (i and gone[i - 1]))
        out.append((len(b), sum(gone), runs, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out


def check(df):
    rows = df.select("doc_id", "text").collect()
    want = Counter((r.doc_id, *w) for r, w in zip(rows, brute([r.text for r in rows]), strict=True))
    got = remove_repeats(df).select("doc_id", "bytes", "removed", "kept").collect()
    assert Counter((r.doc_id, len(r.bytes), sum(s.stop - s.start for s in r.removed), len(r.removed), bytes(r.kept)) for r in got) == want


def test_planted_repeats(spark):
    rng = random.Random(2)
    noise = lambda n: "".join(rng.choice("abcd é") for _ in range(n))
    passage, long = noise(260), noise(3000)
    texts = [noise(900) + passage + noise(300), noise(10) + passage, passage[:199], passage[:200], passage[30:], long, long, long[:1400] + "!" + long[1401:]]
    texts += [long[100:301] + noise(100) + long[100:301], "z" * 450, "z" * 199, "ab" * 300, "ab" * 150 + "c" + "ab" * 150, None, "", noise(199) + passage[:201]]
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def test_many_edited_copies(spark):
    rng = random.Random(4)
    base = "".join(rng.choice("abcdefgh ") for _ in range(1500))
    texts = []
    for _ in range(60):
        t = list(base)
        for _ in range(rng.randint(0, 9)):
            t[rng.randrange(len(t))] = "Q"
        texts.append("".join(t))
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def test_texts_of_one_checksum_and_no_id(spark):
    rng = random.Random(6)
    noise = lambda n: "".join(rng.choice("abcd e") for _ in range(n))
    one, two = equal_checksums()
    before, after = noise(150), noise(150)
    rows = [(None, before + one + after), (None, before + two + after), (3, noise(50) + before + one + after[:90])]
    assert zlib.crc32(rows[0][1].encode()) == zlib.crc32(rows[1][1].encode())
    check(spark.createDataFrame(rows, "doc_id long, text string"))


def test_edges(edge, nothing):
    check(edge)
    out = remove_repeats(edge)
    assert set(edge.columns) - {"bytes", "removed", "kept"} <= set(out.columns)
    assert remove_repeats(nothing).count() == 0


def test_query(spark, sf):
    rows = repeats.table(spark, sf, "documents").select("doc_id", "text").collect()
    want = {(r.doc_id, w[0], w[1], w[2], hashlib.sha256(w[3]).hexdigest()) for r, w in zip(rows, brute([r.text for r in rows]), strict=True)}
    assert {tuple(r) for r in repeats.op9_repeats(spark, sf).collect()} == want
