import random
import tracemalloc
from collections import Counter
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pytest
from texts import equal_checksums, words_of

from partwise.llm import jaccard
from partwise.llm.graph import components
from partwise.llm.jaccard import Rule, join_sets, link_documents, one_of_each

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    w = words_of((text or "").translate(LOWER))
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(rows, rule):
    """Component number of every row, and its set size."""
    sets = [shingles(t, rule.words) for _, t in rows]
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, j in combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and rule.scale * min(len(a), len(b)) >= rule.percent * max(len(a), len(b)) and rule.scale * len(a & b) >= rule.percent * len(a | b):
            x, y = find(i), find(j)
            parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(rows))], [len(s) for s in sets]


def check(df, rule):
    rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
    group, sizes = brute(rows, rule)
    least = {}
    for (doc, _), g in zip(rows, group, strict=True):
        least[g] = min((x for x in (least.get(g), doc) if x is not None), default=None)
    want = sorted(((d, n, least[g]) for (d, _), g, n in zip(rows, group, sizes, strict=True)), key=str)
    got = link_documents(df, rule).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == want


def family(rng, size, copies, most):
    words = [f"w{rng.randrange(10 ** 6)}" for _ in range(size)]
    out = []
    for _ in range(copies):
        w = list(words)
        for _ in range(rng.randint(0, most)):
            at = rng.randrange(len(w))
            if rng.random() < 0.5:
                w[at] = f"e{rng.randrange(10 ** 6)}"
            else:
                del w[at]
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("rule", [Rule(3, 90), Rule(5, 80)])
def test_families_and_small_sets(spark, rule):
    rng = random.Random(rule.percent)
    texts = [t for _ in range(12) for t in family(rng, rng.randint(12, 200), rng.randint(2, 6), 8)]
    common = " ".join(f"c{i}" for i in range(60))
    texts += [" ".join(f"u{rng.randrange(10 ** 6)}" for _ in range(150)) + " " + common for _ in range(20)]
    texts += [" ".join(rng.choice("abcdef") for _ in range(rng.randint(0, 30))) for _ in range(80)]
    texts += [" ".join("abcdefghijklmnopqrstuvwxyz"[: rng.randint(8, 26)]) for _ in range(30)]
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), rule)


@pytest.mark.parametrize("rule, listed, levels", [(Rule(3, 90), 4, 6), (Rule(5, 80), 8, 1)])
def test_large_groups_of_near_copies(spark, rule, listed, levels, monkeypatch):
    monkeypatch.setattr(jaccard, "LISTED", listed)
    monkeypatch.setattr(jaccard, "LEVELS", levels)
    rng = random.Random(9)
    texts = family(rng, 120, 70, 5) + family(rng, 60, 40, 6)
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), rule)


@pytest.mark.parametrize("with_base", [True, False])
def test_edits_far_from_the_centre_of_their_list(spark, with_base):
    rng = random.Random(50)
    base = [f"w{i}" for i in range(50)]
    texts = [" ".join(base)] if with_base else []
    for i in range(300):
        w = list(base)
        w[rng.randrange(50)] = f"e{i}"
        texts.append(" ".join(w))
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), Rule(5, 80))


def test_texts_of_one_checksum_and_no_id(spark):
    one, two = equal_checksums()
    rows = [(None, one), (None, two), (7, one)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = one_of_each(df, Rule(3, 90)).select("doc_id", "text").collect()
    assert sorted(map(tuple, kept), key=str) == sorted(rows[1:], key=str)


def test_compared_pairs_leave_as_counts(spark):
    rng = random.Random(4)
    high = [rng.randrange(-2 ** 31, 2 ** 31) << 32 for _ in range(60)]
    sets = {k: sorted({rng.choice(high) + rng.randrange(3) for _ in range(rng.randint(1, 90))}) for k in range(12)}     # many tokens of one upper half
    table = spark.createDataFrame(list(sets.items()), "node long, tokens array<long>")
    ends = list(combinations(sets, 2))
    pairs = spark.createDataFrame(ends, "a long, b long")
    whole, short = jaccard.compared(pairs, table), jaccard.compared(pairs, table, short=True)
    assert not any("array" in kind for _, kind in whole.dtypes + short.dtypes)
    both = {(r.a, r.b): r for r in whole.collect()}
    assert {k: (r.both, r.n, r.m) for k, r in both.items()} == {(a, b): (len({*sets[a]} & {*sets[b]}), len(sets[a]), len(sets[b])) for a, b in ends}
    upper = short.collect()
    assert len(upper) == len(ends) and all(r.both + r.again >= both[r.a, r.b].both for r in upper)


def test_keys_of_long_lists_in_little_memory():
    rows, each = 2000, 120
    token = pa.array([(i * 7919 + j) * 104729 for i in range(rows) for j in range(each)], pa.int64())
    shared = pa.StructArray.from_arrays([token, pa.array([*range(each)] * rows, pa.int32()), pa.array([True] * len(token))], names=["token", "at", "hot"])
    lists = pa.ListArray.from_arrays(pa.array([i * each for i in range(rows + 1)], pa.int32()), shared)
    columns = [pa.array(range(rows), pa.int64()), pa.array([900] * rows, pa.int64()), pa.array([each] * rows, pa.int64()), lists]
    batch = pa.RecordBatch.from_arrays(columns, names=["node", "n", "frequent", "shared"])
    run = jaccard.index_keys(Rule(3, 90))
    tracemalloc.start()
    made = sum(out.num_rows for out in run(iter([batch])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert made == sum(comb(g, 2) for v in lists.to_pylist() for g in Counter(r["token"] % jaccard.GROUPS for r in v).values())
    assert most < 40e6, most


def test_parities_settle_pairs_and_lose_none(spark):
    rng, rule = random.Random(6), Rule(3, 90)
    sets = []
    for size in (1, 5, 31, 33, 60, 130, 500, 1030):         # near the steps of the bits' lengths, so that halves meet
        one = [rng.getrandbits(63) for _ in range(size)]
        for share in (1, 0.99, 0.97, 0.95, 0.93, 0.9, 0.8, 0.5, 0):
            sets.append(np.array(sorted({*rng.sample(one, int(share * size)), *(rng.getrandbits(63) for _ in range(size - int(share * size)))}), np.int64))
    n = np.array([len(s) for s in sets])
    bits, longs = jaccard.parities(np.concatenate(sets), n)
    assert (64 * longs >= 2 * n).all() and (longs < np.maximum(n / 16, 2)).all()
    nodes = spark.createDataFrame([(i, int(m), b.tolist()) for i, (m, b) in enumerate(zip(n, np.split(bits, np.cumsum(longs)[:-1]), strict=True))], "node long, n long, odd array<long>")
    ends = list(combinations(range(len(sets)), 2))
    both = {(a, b): len(np.intersect1d(sets[a], sets[b])) for a, b in ends}
    left = {tuple(r) for r in jaccard.alike(spark.createDataFrame(ends, "a long, b long"), nodes, rule).collect()}
    assert {(a, b) for a, b in ends if rule.linked(both[a, b], n[a], n[b])} <= left
    assert not any(both[p] < 0.75 * min(n[p[0]], n[p[1]]) for p in left if n[p[0]] > 100)


def test_small_sets_of_many_common_tokens_are_indexed_by_the_rarest(spark, monkeypatch):
    rng, stored, index = random.Random(8), jaccard.stored, []
    rows = [(i, " ".join([*(f"c{j}" for j in range(20)), *(f"u{i}x{j}" for j in range(14))])) for i in range(40)]       # 32 shingles, 18 of them common
    rows += [(100 + i, " ".join(f"p{j}" for j in range(30)) + f" q{i}") for i in range(20)] + [(200, rows[0][1])]
    rng.shuffle(rows)

    def kept(df):
        out = stored(df)
        index.extend([out] if out.columns == ["key", "node", "n"] else [])
        return out

    monkeypatch.setattr(jaccard, "stored", kept)
    check(spark.createDataFrame(rows, "doc_id long, text string"), Rule(3, 90))
    assert index[0].filter("n = 32").count() == 0 < index[0].filter("n = 29").count()


def test_groups_turn_what_two_share_into_their_consensus(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(62) for _ in range(60)]
    sets = {i: sorted({*base} - {*rng.sample(base, 2)} | {rng.getrandbits(62) for _ in range(2)}) for i in range(9)}
    sets |= {9: sorted(rng.getrandbits(62) for _ in range(60)), 10: sorted({*base})}        # the last two share nothing
    members = spark.createDataFrame([(0, i) for i in sets], "a long, node long")
    table = spark.createDataFrame(list(sets.items()), "node long, tokens array<long>")
    rows = jaccard.differences(members, table, Rule(3, 90)).collect()
    held = Counter(t for s in sets.values() for t in s)
    middle = {t for t, c in held.items() if 2 * c > len(sets)}
    gaps = {i: len({*s} ^ middle) * 190 - len(s) * 10 for i, s in sets.items()}
    assert {r.node: r.gap for r in rows} == gaps
    assert all(n <= 60 // 9 + 1 for n in Counter(r.node for r in rows).values())


def test_chains_are_united_in_one_task(spark):
    order = random.Random(2).sample(range(5000), 5000)
    links = list(zip(order[:3000], order[1:3001], strict=True)) + [(order[4000], order[4001])]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {n: min(order[:3001]) for n in order[:3001]} | {n: min(order[4000:4002]) for n in order[4000:4002]}


def test_chance_matches_of_large_sets_are_not_sure():
    n, both = 1_000_000, 947_365                    # one of 947,369 needed at 90 % of 3-word shingles is missing, and three more
    rule, chance = Rule(3, 90), n * n / 2 ** 32
    assert not rule.linked(both, n, n) and rule.linked(both + int(chance), n, n)
    assert not rule.linked(both + int(chance + 8 * chance ** 0.5) - jaccard.sure_margin(n, n), n, n)
    assert jaccard.sure_margin(100, 100) <= 3


def test_edges(edge, nothing):
    check(edge, Rule(3, 90))
    kept = one_of_each(edge, Rule(3, 90))
    assert kept.columns == edge.columns
    group, sizes = brute([tuple(r) for r in edge.select("doc_id", "text").collect()], Rule(3, 90))
    with_words = {g for g, n in zip(group, sizes, strict=True) if n}
    assert kept.filter("length(trim(replace(replace(coalesce(text, ''), '\n', ''), '\t', ''))) > 0").select("text").distinct().count() == len(with_words)
    assert kept.filter("text is null").count() == edge.filter("text is null").count()
    assert link_documents(nothing, Rule(3, 90)).count() == one_of_each(nothing, Rule(3, 90)).count() == 0
    assert "class" in join_sets(edge, Rule(3, 90)).columns
