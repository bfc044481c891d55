import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from partwise.llm import toxicity
from partwise.llm.lines import RUN, dedup_lines
from partwise.llm.toxicity import Machine, fit, keep_clean, score_texts, train

BLANK = re.compile(r"[\x20\x09-\x0D]*")


def brute(rows):
    """Rows (doc_id, text, text hash) that repeat id and text are one document; windows of RUN lines, first place wins."""
    docs = sorted({(-(1 << 63) if d is None else d, h, t) for d, t, h in rows if t is not None})
    seen, gone = set(), {}
    for doc, h, text in docs:
        lines = text.split("\n")
        real = [i for i, s in enumerate(lines) if not BLANK.fullmatch(s)]
        for j in range(len(real) - RUN + 1):
            window = tuple(lines[i] for i in real[j:j + RUN])
            if window in seen:
                gone.setdefault((doc, h), set()).update(real[j:j + RUN])
            seen.add(window)
    out = []
    for d, t, h in rows:
        cut = gone.get((-(1 << 63) if d is None else d, h), set())
        out.append((d, None if t is None else "\n".join(s for i, s in enumerate(t.split("\n")) if i not in cut), len(cut)))
    return out


def check(df):
    rows = [tuple(r) for r in df.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit("")))).collect()]
    got = [tuple(r) for r in dedup_lines(df, counts=True).select("doc_id", "text", "n_removed").collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)


def test_planted_runs(spark):
    rng = random.Random(8)
    pool = [f"line {i}" for i in range(40)] + ["", "  "]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randint(0, 30))) for _ in range(60)]
    texts += ["a\nb\nc\nd\ne", "x\na\nb\nc\nd\ny", "b\nc", "b\n\nc\n \nd", "same\n" * 9, "a\nb\nc\nd\ne", "a\nb\nc\nd\ne\n"]
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def test_line_edges(edge, nothing):
    check(edge)
    assert dedup_lines(edge).columns == edge.columns and dedup_lines(nothing).count() == 0


def test_many_lines_take_linear_time(spark):
    text = "\n".join(f"line {i}" for i in range(300_000))
    again = "start\n" + "\n".join(f"line {i}" for i in range(100_000, 200_000)) + "\nend"
    done = dedup_lines(spark.createDataFrame([(1, text), (2, again)], "doc_id long, text string"), counts=True)
    assert {r["doc_id"]: (r["n_lines"], r["n_removed"]) for r in done.collect()} == {1: (300_000, 0), 2: (100_002, 100_000)}


def test_columns_with_names_of_helpers(spark):
    import corpus_pipeline

    names = ["k_id", "K_TEXT", "gone", "n_lines", "n_removed", "place", "gram", "n_chars"]
    rows = [(i, "a\nb\nc\nd", *[7] * len(names)) for i in range(2)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} long" for n in names))
    assert dedup_lines(frame, counts=True).columns == ["doc_id", "text", *[n for n in names if n not in ("n_lines", "n_removed")], "n_lines", "n_removed"]
    left = corpus_pipeline.distinct_lines(spark, frame, None)
    assert left.columns == frame.columns and [r["n_removed"] for r in left.collect()] == [7]


def labelled(n, seed):
    """Toxic only where an insult meets a group: neither word alone says it."""
    rng = random.Random(seed)
    texts, y = [], []
    for _ in range(n):
        words = [f"w{rng.randrange(300)}" for _ in range(30)]
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        words += ["insult"] * insult + ["group"] * group
        rng.shuffle(words)
        texts.append(" ".join(words))
        y.append(float(insult and group))
    return texts, np.array(y)


def test_pairs_are_learnt_and_held_out():
    texts, y = labelled(2000, 1)
    machine = Machine(*train(texts, y))
    more, truth = labelled(1000, 2)
    assert ((machine.scores(more) >= toxicity.THRESHOLD) == truth).mean() > 0.97
    v = machine.factors
    pair = [machine.column[zlib.crc32(w.encode()) % toxicity.BUCKETS] for w in ("insult", "group")]
    assert min(pair) >= 0 and v[pair[0]] @ v[pair[1]] > 0


def test_one_class_and_no_labels(spark, edge, labels):
    for some in (labels.filter("toxic = 0"), labels.limit(0)):
        assert score_texts(edge, fit(edge, some)).select("score").distinct().count() == 1


def test_score_edges(edge, nothing, labels):
    machine = fit(edge, labels)
    scored = score_texts(edge, machine)
    assert scored.count() == edge.count() and scored.filter("score is null or score < 0 or score > 1").count() == 0
    assert set(scored.columns) == set(edge.columns)          # a column named score is replaced
    assert score_texts(nothing, machine).count() == 0
    assert keep_clean(edge, labels).columns == edge.columns
    texts = [r.text for r in edge.select("text").collect() if r.text]
    whole = machine.scores(texts)
    assert np.allclose(whole, [machine.scores([t])[0] for t in texts])


def test_held_out_accuracy(spark):
    """On the shared labelled documents: rows that were not learnt from."""
    sf = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.toxic for r in toxicity.table(spark, sf, "labels").collect()}
    rows = [r for r in toxicity.op5_toxicity(spark, sf).collect() if r.held_out and r.doc_id in truth]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows)
    hit = sum(r.predicted == truth[r.doc_id] for r in rows)
    caught = sum(r.predicted for r in rows if truth[r.doc_id])
    assert hit / len(rows) > 0.96 and caught / sum(truth[r.doc_id] for r in rows) > 0.8
