"""The stages one after the other against brute-force versions, and the registered queries against their SQL."""

import os
import subprocess
import sys
from collections import Counter

import pytest
import sentencepiece
from pyspark.sql import functions as F
from test_jaccard import brute as groups_of
from test_lines_toxicity import brute as lines_of

import corpus_pipeline
from texts import words_of
from partwise.llm.jaccard import Rule
from partwise.llm.mixing import apply_mix, plan_mix, with_draws
from partwise.llm.pieces import MODEL_PATH
from partwise.llm.queries import ORACLES, QUERIES
from partwise.llm.toxicity import THRESHOLD, fit, score_texts

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, sf):
    """Input and output of every stage on a shared table."""
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        done = stage(spark, docs, sf).cache()
        out.append((docs, done))
        docs = done
    return out


def pairs(df):
    return Counter((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def test_order_and_columns(stages):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line dedup", "n-gram Jaccard join", "mixing sources", "sentencepiece"]
    assert all(done.columns == COLUMNS for _, done in stages[:-1])
    assert all(done.filter("n_chars <> length(text)").count() == 0 for _, done in stages[1:4])


def test_rejected_documents_are_those_that_score(spark, sf, stages):
    docs, done = stages[0]
    machine = fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    assert pairs(done) == pairs(score_texts(docs, machine).filter(F.col("score") < THRESHOLD))


def test_lines(stages):
    docs, done = stages[1]
    rows = [tuple(r) for r in docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit("")))).collect()]
    assert pairs(done) == Counter((d, t) for d, t, gone in lines_of(rows) if not gone or words_of(t))


def test_one_of_each_group(stages):
    docs, done = stages[2]
    rows = sorted(tuple(r) for r in docs.select("doc_id", "text").collect())
    group, sizes = groups_of(rows, Rule(5, 80))
    assert pairs(done) == Counter(r for i, r in enumerate(rows) if group[i] == i or not sizes[i])


def test_mix(spark, sf, stages):
    docs, done = stages[3]
    slim = with_draws(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    want, got = Counter(), Counter()
    for r in apply_mix(slim, plan_mix(slim)).collect():
        want[r.doc_id] += r.taken
    for r in done.collect():
        got[r.doc_id] += len(words_of(r.text))
    assert +got == +want


def test_ids(stages):
    docs, done = stages[4]
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL_PATH)
    rows = done.collect()
    assert len(rows) == docs.count()
    assert all(r.round_trip and r.ids == model.encode(r.text) and r.n_tokens == len(r.ids) for r in rows)


def test_run_gives_the_last_stage(spark, sf, stages):
    assert pairs(corpus_pipeline.run(spark, sf)) == pairs(stages[4][1])


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_equal_their_sql(spark, sf, name):
    from oracle import compare, connect

    ok, message = compare(connect(sf), spark, sf, QUERIES[name], ORACLES[name])
    assert ok, message


def test_the_rest_works_without_the_subpackage(tmp_path):
    root = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    for name in os.listdir(root):
        if name not in ("corpus_pipeline.py", "partwise", ".git"):
            os.symlink(f"{root}/{name}", tmp_path / name)
    os.mkdir(tmp_path / "partwise")
    for name in os.listdir(f"{root}/partwise"):
        if name != "llm":
            os.symlink(f"{root}/partwise/{name}", tmp_path / "partwise" / name)
    code = f"import sys; sys.path.insert(0, {str(tmp_path)!r}); import importlib.util as u; s = u.spec_from_file_location('e', {str(tmp_path / '__spark_entry__.py')!r}); m = u.module_from_spec(s); s.loader.exec_module(m); q = m.queries(); print(len(q), 'pipeline' in q, any(k.startswith('op1_') for k in q))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=tmp_path, env=env, timeout=120)
    assert said.stdout.split()[1:] == ["False", "False"] and int(said.stdout.split()[0]) > 80, said.stderr
