import math
from collections import Counter

import pytest
import xxhash
from texts import words_of
from pyspark.sql import functions as F

from partwise.llm import mixing, sharding
from partwise.llm.mixing import apply_mix, mix_documents, plan_mix, with_draws
from partwise.llm.sharding import shard_records, with_measures


def winner(doc_id, weights):
    """The same bids by another XXH64: the key hashes into the seed, a null leaves it at 42."""
    seed = 42 if doc_id is None else xxhash.xxh64_intdigest(doc_id.to_bytes(8, "little", signed=True), 42)
    bids = []
    for s, w in enumerate(weights):
        h = xxhash.xxh64_intdigest(s.to_bytes(4, "little"), seed)
        bids.append((w / -math.log(((h >> 11) + 0.5) / 2.0 ** 53), -s))
    return -max(bids)[1]


@pytest.mark.parametrize("weights", [[1.0] * 7, [1.0, 2.0, 5.0]])
def test_rendezvous_by_brute_force(edge, weights):
    grown = [*weights, 1.5]
    rows = shard_records(with_measures(edge), "doc_id", weights, grown, ("size", "text_crc32")).collect()
    assert len(rows) == edge.count()
    for r in rows:
        assert r["shard"] == winner(r.doc_id, weights)
        assert r.grown_shard == winner(r.doc_id, grown) and r.grown_shard in (r["shard"], len(weights))
    slots = Counter()
    for r in sorted(rows, key=lambda r: (r["shard"], r.slot)):
        assert r.slot == slots[r["shard"]]
        slots[r["shard"]] += 1


def test_weights_set_the_shares(spark):
    rows = spark.range(6000).withColumn("size", F.lit(1))
    share = Counter(r["shard"] for r in shard_records(rows, "id", [1.0, 2.0, 3.0], order=("size",)).collect())
    assert [round(share[s] / 1000) for s in range(3)] == [1, 2, 3]
    with pytest.raises(ValueError):
        sharding.rendezvous(F.lit(1), [1.0, 0.0])


def test_shard_query_over_whole_table(spark, sf):
    import zlib

    texts = {r.doc_id: (r.text or "").encode() for r in sharding.table(spark, sf, "documents").select("doc_id", "text").collect()}
    rows = sharding.op6_sharding(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.size, r.text_crc32, r.law) == (len(texts[r.doc_id]) + 16, zlib.crc32(texts[r.doc_id]), "key")
        assert r["shard"] == winner(r.doc_id, [1.0] * 40) and r.grown_shard == winner(r.doc_id, [1.0] * 41)


def test_empty_tables(nothing, labels):
    assert shard_records(with_measures(nothing), "doc_id", [1.0] * 3, order=("size", "text_crc32")).count() == 0
    slim = with_draws(nothing, labels)
    assert apply_mix(slim, plan_mix(slim)).count() == mix_documents(nothing, labels).count() == 0


def shared_out(sizes):
    """Targets by sharing the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    full, total = set(), sum(sizes.values())
    while True:
        rest = total - sum(3 * sizes[s] for s in full)
        unit = rest / max(1, sum(weight[s] for s in order if s not in full))
        above = {s for s in order if s not in full and unit * weight[s] > 3 * sizes[s]}
        if not above:
            return {s: 3.0 * sizes[s] if s in full else unit * weight[s] for s in order}
        full |= above


def test_mix_of_edges(edge, labels):
    slim = with_draws(edge, labels)
    rows = apply_mix(slim, plan_mix(slim)).collect()
    assert len(rows) == edge.count()
    sizes, got = Counter(), Counter()
    for r in edge.select("source", "text").collect():
        sizes[r.source] += len(words_of(r.text))
    want = shared_out(dict(sizes))
    most = Counter()
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 3 * r["size"]
        got[r.source] += r.taken
        most[(r.source, r.draw)] += 1
    for s in sizes:
        assert want[s] - max(most.values()) - 1 <= got[s] <= want[s] + 1e-9


def test_small_and_capped_sources(spark, labels):
    rows = [(i, "w " * n, s) for i, (n, s) in enumerate([(100, "a"), (300, "a"), (5, "b"), (0, "c"), (7, None), (1, "d"), (2000, "e")])]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    slim = with_draws(df, labels)
    out = {r.doc_id: r for r in apply_mix(slim, plan_mix(slim)).collect()}
    want = shared_out({"a": 400, "b": 5, "c": 0, None: 7, "d": 1, "e": 2000})
    assert all(out[i].target == pytest.approx(want[s]) for i, (_, _, s) in enumerate(rows))
    assert out[2].taken == 15 and out[5].taken == 3 and out[4].taken == 21


def test_mixed_corpus_holds_what_is_taken(edge, labels):
    slim = with_draws(edge, labels)
    taken = Counter()
    for r in apply_mix(slim, plan_mix(slim)).collect():
        taken[r.doc_id] += r.taken
    mixed = mix_documents(edge, labels)
    assert mixed.columns == edge.columns
    got = Counter()
    for r in mixed.collect():
        got[r.doc_id] += len(words_of(r.text))
    assert +got == +taken
    assert mixed.filter("doc_id = 30").count() == 1        # no words: stays once
    assert sorted(map(str, mixed.collect())) == sorted(map(str, mix_documents(edge.repartition(3), labels).collect()))


def test_draws_follow_quality(spark):
    rows = [(i, "w " * 50, "s") for i in range(600)] + [(9999, "w " * 60000, "t")]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(600)], "doc_id long, quality int, toxic int")
    slim = with_draws(spark.createDataFrame(rows, "doc_id long, text string, source string"), labels)
    draws = {0: [], 1: []}
    for r in slim.filter("source = 's'").collect():
        draws[r.doc_id % 2].append(r.draw)
    assert sum(draws[0]) / sum(draws[1]) > 2.5        # mean key is 1 / weight: 2 against 0.5
    assert mixing.SOURCE_WEIGHTS == (1, 2, 3)
