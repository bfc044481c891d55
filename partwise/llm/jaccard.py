"""N-gram Jaccard join by token-combination prefixes.

A document is the set of hashes of its n-word shingles, in one global order (by hash). Two sets of sizes n, m link
when scale * |both| >= percent * |either|. A linked partner lacks at most slack(n) = n - ceil(t n) tokens of a set
(t = percent / scale), so among any slack + 1 tokens of it one is shared.

Region: the first slack + 1 + ALLOWANCE tokens. Tokens in the regions of more than FREQUENT sets are frequent.
A set with at most ALLOWANCE frequent tokens in its region has slack + 1 rare ones there and is *plain*; only
rare tokens, singly, index it. The region of any other set is the extended prefix of a *common* set: its frequent
tokens fall into GROUPS by hash and every pair within a group is indexed too. Sharing no pair costs at most one
shared token a group, and ALLOWANCE >= GROUPS, so
* common with common: more than slack tokens of the region that ends first count, a rare token or a pair is shared;
* plain with any: a region ends at or after the partner's last needed rare token, or else more than ALLOWANCE of its
  tokens lie in the plain one's region and one of them is rare.
Sets too small for that (ceil(t n) <= GROUPS) and all their possible partners have all their tokens as region; the slack + 1
that fewest sets hold index them singly as well.

A candidate goes unless the parities of both sets' tokens, counted in a few bits per token, differ in no more places than
linked sets may differ in tokens (``alike``); what is left is compared by whole sets.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import small
from .common import query, stored, table
from .graph import components
from .phrases import Bitmap
from .pieces import portions, ragged
from .repeats import Hashes, buffers, keyed_bytes, mixed, signed

ALLOWANCE = 40
GROUPS = 32
FREQUENT = 16        # sets that share a rare token, at most: all their pairs are counted
LISTED = 64         # members of an index list whose pairs are compared outright; larger ones are compared with one member first
GROUPED = 4         # times LISTED: members of open lists that share members, whose pairs are compared outright
LEVELS = 6          # of comparing with one member; what is still open is then compared in pairs


@dataclass(frozen=True)
class Rule:
    words: int
    percent: int
    scale: int = 100

    def least(self, n):
        """Tokens that a partner must share."""
        return -(-self.percent * n // self.scale)

    def slack(self, n):
        return n - self.least(n)

    def spread(self, n):
        """Most tokens in which a linked partner can differ, either way."""
        return n * (self.scale - self.percent) // self.percent

    def linked(self, both, n, m):
        return (self.scale + self.percent) * both >= self.percent * (n + m)

    @property
    def singles(self):
        """Largest set that single tokens must index, and its largest partner."""
        return (GROUPS * self.scale // self.percent) * self.scale // self.percent


def shingle_sets(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, words: int):
    """Sorted distinct shingle hashes of each text, one after the other, and how many each has.

    Words are compared with A-Z lower-cased; a text with fewer words is one shingle, one without words has none.
    """
    data = data.copy()
    data[(data >= 65) & (data <= 90)] += 32
    stop = np.ones(len(data) + 1, bool)
    stop[:-1] = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.zeros(len(data) + 1, bool)
    edge[starts] = True
    inside = ~stop[:-1]
    head = np.flatnonzero(inside & (np.r_[True, stop[:-2]] | edge[:-1])) if len(data) else np.empty(0, np.int64)
    tail = np.flatnonzero(inside & (stop[1:] | edge[1:])) + 1 if len(data) else head
    doc = np.searchsorted(starts + lengths, head, side="right")
    h = mixed(Hashes(data, 0).of(head, tail), tail - head)
    count = np.bincount(doc, minlength=len(starts))
    first = np.cumsum(count) - count
    made = np.where(count >= words, count - words + 1, np.minimum(count, 1))
    owner = np.repeat(np.arange(len(starts)), made)
    at = np.repeat(first - (np.cumsum(made) - made), made) + np.arange(made.sum())
    key = np.full(len(at), 0x1234567, np.uint64)
    for j in range(words):
        some = j < count[owner]
        key = np.where(some, mixed(key * np.uint64(0x100000001B3) + h[np.minimum(at + j, len(h) - 1)] if len(h) else key, np.full(len(at), j + 1)), key)
    key = signed(key)
    order = np.lexsort((key, owner))
    key, owner = key[order], owner[order]
    new = np.r_[True, (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])] if len(key) else np.empty(0, bool)
    return key[new], np.bincount(owner[new], minlength=len(starts))


def parities(tokens: np.ndarray, n: np.ndarray):
    """Bits of each set, 2 to 4 a token in a power of two of longs: bit i tells whether an odd number of tokens equal i modulo
    the bits. Two sets differ in at least as many tokens as bits, and the two halves of the bits together are those of half as many."""
    longs = 1 << np.ceil(np.log2(np.maximum(n / 32, 1))).astype(np.int64)
    ends = np.cumsum(longs)
    at = tokens.view(np.uint64) & np.repeat(64 * longs - 1, n).astype(np.uint64)
    bits = np.zeros(longs.sum(), np.uint64)
    np.bitwise_xor.at(bits, np.repeat(ends - longs, n) + (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return signed(bits), longs


SET = "k_id long, k_sum long, doc_id long, node long, n long, region array<long>, odd array<long>"


def read_sets(rule: Rule):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in portions(batch, 2, 1 << 18):
                tokens, n = shingle_sets(*buffers(part.column(2)), rule.words)
                ends = np.cumsum(n)
                sums = np.zeros(len(tokens) + 1, np.uint64)
                np.cumsum(mixed(tokens.view(np.uint64), np.full(len(tokens), 1)), out=sums[1:])
                node = mixed(sums[ends] - sums[ends - n], n)
                size = np.where(n <= rule.singles, n, np.minimum(n, rule.slack(n) + 1 + ALLOWANCE))
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)], pa.int32()),
                                                 pa.array(tokens[np.repeat(ends - n - (np.cumsum(size) - size), size) + np.arange(size.sum())]))
                bits, longs = parities(tokens, n)
                odd = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(longs)], pa.int32()), pa.array(bits))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(3), pa.array(signed(node)), pa.array(n), lists, odd],
                                                 names=["k_id", "k_sum", "doc_id", "node", "n", "region", "odd"])

    return run


def full_sets(rule: Rule):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in portions(batch, 1, 1 << 18):
                tokens, n = shingle_sets(*buffers(part.column(1)), rule.words)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)], pa.int32()), pa.array(tokens))], names=["node", "tokens"])

    return run


def held_tokens(known):
    """Kernel: (node, n, token) of the region tokens that the set of keys ``known`` (a broadcast Bitmap) may hold."""
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in portions_of_lists(batch, batch.schema.get_field_index("region"), 1 << 17):
                region = part.column("region")
                tokens = region.flatten().to_numpy()
                hit = np.flatnonzero(known.value.has(tokens.view(np.uint64)))
                of = pa.array(np.repeat(np.arange(part.num_rows), region.value_lengths().to_numpy())[hit])
                yield pa.RecordBatch.from_arrays([part.column("node").take(of), part.column("n").take(of), pa.array(tokens[hit])], names=["node", "n", "token"])

    return run


def index_keys(rule: Rule):
    """Index keys of common and small sets from their shared region tokens: (key, node, n). ``at`` of a small set's token is
    its place among all of them, those of fewer sets first."""
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in portions_of_lists(batch, batch.schema.get_field_index("shared"), 1 << 16):
                node, n, frequent = (part.column(c).to_numpy() for c in ("node", "n", "frequent"))
                lists = part.column("shared")
                row = np.repeat(np.arange(len(n)), lists.value_lengths().to_numpy())
                token, at, hot = (lists.flatten().field(f).to_numpy(zero_copy_only=False) for f in ("token", "at", "hot"))
                common = frequent > np.minimum(ALLOWANCE, np.minimum(n, rule.slack(n) + 1 + ALLOWANCE) - rule.slack(n) - 1)
                some = hot & common[row]
                group, t, owner = token[some].view(np.uint64) % np.uint64(GROUPS), token[some], row[some]
                order = np.lexsort((t, group, owner))
                group, t, owner = group[order], t[order].view(np.uint64), owner[order]
                last = np.r_[(group[1:] != group[:-1]) | (owner[1:] != owner[:-1]), np.ones(min(len(t), 1), bool)]
                after = np.repeat(np.flatnonzero(last), np.diff(np.r_[-1, np.flatnonzero(last)])) - np.arange(len(t))      # tokens of the group that follow
                one, two = np.repeat(np.arange(len(t)), after), ragged(np.arange(len(t)) + 1, after)
                early = (n <= rule.singles)[row] & (at <= rule.slack(n)[row])
                keys = np.concatenate([mixed(t[one], t[two] % np.uint64(1 << 62)), mixed(token[early].view(np.uint64), np.full(early.sum(), 7))])
                of = np.concatenate([owner[one], row[early]])
                yield pa.RecordBatch.from_arrays([pa.array(signed(keys)), pa.array(node[of]), pa.array(n[of])], names=["key", "node", "n"])

    return run


def portions_of_lists(batch, column: int, size: int):
    """A record batch in slices of about ``size`` list elements (one row at least)."""
    part = np.cumsum(batch.column(column).value_lengths().to_numpy()) // size
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def comparable(rule: Rule, n, m):
    return rule.scale * F.least(n, m) >= rule.percent * F.greatest(n, m)


def pairs_of(lists: DataFrame, rule: Rule) -> DataFrame:
    """(a, b) of every list's members whose sizes allow a link and which are not in one class yet; lists hold
    ``members`` (node, n, class)."""
    both = lists.select(F.col("members").alias("m"), F.posexplode("members").alias("i", "x"))
    x = F.col("x")
    apart = lambda y: (x["class"] != y["class"]) & comparable(rule, x["n"], y["n"])
    both = both.select("x", F.explode(F.filter(F.slice("m", F.col("i") + 2, F.size("m")), apart)).alias("y"))
    return both.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))


def compared(pairs: DataFrame, sets: DataFrame, short: bool = False) -> DataFrame:
    """(a, b, both, n, m, again): tokens that the sets of each pair share, the sets' sizes.

    ``short`` compares the upper halves of the tokens: ``both`` counts those that occur on both sides, once each, and
    ``again`` bounds how many more tokens may share one of them. A row holds two sets, and no batch of rows leaves the
    join, so that many pairs of one large set take no more memory than one.
    """
    wanted = ends_known(pairs)      # few of the sets take part after the first level

    def side(end: str, name: str, n: str, again: str) -> DataFrame:
        own = sets.join(wanted.filter(f"in_{end}"), "node", "left_semi")
        if short:
            own = own.withColumn("tokens", F.transform("tokens", lambda t: F.shiftright(t, 32).cast("int")))
        repeats = F.size("tokens") - F.size(F.array_distinct("tokens")) if short else F.lit(0)
        return own.select(F.col("node").alias(end), F.col("tokens").alias(name), F.size("tokens").cast("long").alias(n), repeats.alias(again))

    met = pairs.join(side("b", "y", "m", "again_y"), "b").join(side("a", "x", "n", "again_x"), "a")
    return met.select("a", "b", F.size(F.array_intersect("x", "y")).cast("long").alias("both"), "n", "m", F.least("again_x", "again_y").alias("again"))


SURE = 2        # shared tokens above the least number needed that no chance match of upper halves makes up in small sets


def sure_margin(n, m):
    """The same for any sizes (numbers or columns): n m / 2^32 upper halves are expected to match by chance; twice that and ten deviations more."""
    ceil, sqrt = (F.ceil, F.sqrt) if isinstance(n, Column) else (np.ceil, np.sqrt)
    chance = n * m / 2 ** 32
    return SURE + ceil(2 * chance + 10 * sqrt(chance))


def verify(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """The pairs that link. Upper halves of the tokens settle all pairs but those within a margin of the bound that
    grows with the sets (``sure_margin``), at half the size; these are settled by whole tokens."""
    n, m, both = F.col("n"), F.col("m"), F.col("both")
    rough = compared(pairs, sets, short=True)
    likely = rule.linked(both + F.col("again"), n, m)
    sure = rule.linked(both - sure_margin(n, m), n, m)
    rough = stored(rough.select("a", "b", likely.alias("likely"), sure.alias("sure"))).filter("likely")
    sure, close = rough.filter("sure").select("a", "b"), rough.filter(~F.col("sure")).select("a", "b")
    return sure if close.isEmpty() else sure.union(compared(close, sets).filter(rule.linked(both, n, m)).select("a", "b"))


def differences(members: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """Rows (a, key, node, n, gap): for each member (a, node) of a group some tokens in which it differs from the
    group's consensus M, the tokens that more than half of the members hold.

    Linked sets x, y differ in at most spread(x) tokens, and so do their differences from M. If these share a
    token, one is among the first spread + 1 of either in any order; the order is by how few members differ in the
    token, so that lists stay short. If they share none, |x - M| + |y - M| is at most c (|x| + |y|) with
    c = (1 - t) / (1 + t). Then the member with the least |z - M| - c |z| (the least ``gap``) links with x and with
    y, so comparing all members with that one is enough.

    Only tokens in which a member differs from what two members share become rows; those in which more than half
    differ from it turn it into M.
    """
    ends = members.groupBy("a").agg(F.min("node").alias("one"), F.max("node").alias("two"), F.count("*").alias("size"))
    one, two = sets.toDF("one", "x"), sets.toDF("two", "y")
    shared = ends.join(one, "one").join(two, "two").select("a", "size", F.array_intersect("x", "y").alias("m"))
    own = members.join(sets, "node").join(shared, "a")
    apart = lambda x, y: F.concat(F.array_except(x, y), F.array_except(y, x))
    own = stored(own.select("a", "node", "size", F.size("tokens").cast("long").alias("n"), apart("tokens", "m").alias("d")))
    differ = stored(own.select("a", "size", F.explode("d").alias("token")).groupBy("a", "size", "token").agg(F.count("*").alias("differ")))
    most = differ.filter(F.col("differ") * 2 > F.col("size")).groupBy("a").agg(F.collect_list("token").alias("h"))
    each = own.join(most, "a", "left").withColumn("h", F.coalesce("h", F.array().cast("array<long>"))).select("a", "node", "n", apart("d", "h").alias("d"))
    gap = F.size("d") * (rule.scale + rule.percent) - F.col("n") * (rule.scale - rule.percent)
    each = each.withColumn("gap", gap.cast("long"))
    differ = differ.select("a", "token", F.least("differ", F.col("size") - F.col("differ")).alias("differ"))
    tokens = each.select("a", "node", "n", "gap", F.explode("d").alias("token")).join(differ, ["a", "token"])
    order = F.row_number().over(W.partitionBy("a", "node").orderBy("differ", "token"))
    first = tokens.withColumn("place", order).filter(F.col("place") <= F.floor(F.col("n") * (rule.scale - rule.percent) / rule.percent) + 1)
    rows = first.select("a", F.xxhash64("a", "token").alias("key"), "node", "n", "gap")
    none = each.filter(F.size("d") == 0).select("a", F.xxhash64("a", F.lit(0)).alias("key"), "node", "n", "gap")      # sets that are M itself
    return rows.unionByName(none)


def classes_of(members: DataFrame, classes: DataFrame | None) -> DataFrame:
    """Adds ``class``, the component so far (the node itself where it has no link)."""
    if classes is None:
        return members.withColumn("class", F.col("node"))
    return members.join(classes, "node", "left").withColumn("class", F.coalesce("component", "node")).drop("component")


def across(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs whose ends are not in one component yet."""
    a, b = classes.toDF("a", "ca"), classes.toDF("b", "cb")
    joined = pairs.join(a, "a", "left").join(b, "b", "left")
    return joined.filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def ends_of(pairs: DataFrame) -> DataFrame:
    """The nodes of pairs (a, b)."""
    return pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()


def ends_known(pairs: DataFrame) -> DataFrame:
    """(node, in_a, in_b): the nodes of pairs (a, b) and at which end they stand, measured once for both ends."""
    a = pairs.select(F.col("a").alias("node"), F.lit(True).alias("in_a"), F.lit(False).alias("in_b"))
    b = pairs.select(F.col("b").alias("node"), F.lit(False).alias("in_a"), F.lit(True).alias("in_b"))
    return small(a.union(b).groupBy("node").agg(F.bool_or("in_a").alias("in_a"), F.bool_or("in_b").alias("in_b")))


def whole_sets(documents: DataFrame, nodes: DataFrame, wanted: DataFrame, rule: Rule) -> DataFrame:
    """(node, tokens) of the wanted nodes, stored."""
    chosen = small(nodes.join(wanted, "node", "left_semi").select("node", "k_id", "k_sum"))
    texts = keyed_bytes(documents).join(chosen, ["k_id", "k_sum"]).select("node", "bytes").dropDuplicates(["node"])
    return stored(texts.mapInArrow(full_sets(rule), "node long, tokens array<long>"))


def join_sets(documents: DataFrame, rule: Rule) -> DataFrame:
    """(k_id, k_sum, doc_id, n_shingles, node, class): the set size and link component of every document.

    ``class`` names the component; it is not a document's id. Equal sets are one node from the start, whatever
    their number. Candidate pairs of nodes come from the index (module text); pairs of plain nodes must share as
    many rare tokens as the regions' ends leave room for. Pairs are verified with the whole sets, each node's
    smallest partner first, the others only if their ends are still apart. An index list of more than LISTED
    members (a large group of near copies) is compared with one member; members that do not end up in one
    component are all indexed again, with or without a link to that one, by what they differ in from what most of
    their group shares (lists with common members are one group); small groups are compared in pairs.
    """
    read = keyed_bytes(documents, F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(read_sets(rule), SET)
    sets = stored(read.withColumn("row", F.monotonically_increasing_id()))        # numbers are fixed once written
    open_sizes = (F.col("n") > 0) & (rule.scale * F.col("n") >= rule.percent * (F.col("n") + 1))
    reps = small(sets.filter(open_sizes).groupBy("node").agg(F.min("row").alias("row")).select("row"))
    nodes = sets.join(reps, "row", "left_semi")
    counts = nodes.select(F.explode("region").alias("token")).groupBy("token").agg(F.count("*").alias("held")).filter("held > 1")
    counts = stored(counts)
    # most tokens stand in one set only; a bitmap keeps them out of the shuffle
    known = documents.sparkSession.sparkContext.broadcast(Bitmap.of(counts.select(F.col("token").alias("key"))))
    shared = stored(nodes.select("node", "n", "region").mapInArrow(held_tokens(known), "node long, n long, token long").join(counts, "token"))

    hot = F.col("held") > FREQUENT
    listed = shared.filter(hot | (F.col("n") <= rule.singles)).groupBy("node", "n")
    marked = listed.agg(F.count_if(hot).alias("frequent"), F.sort_array(F.collect_list(F.struct("held", "token"))).alias("shared"))
    first = (F.col("n") - F.size("shared")).cast("int")        # tokens of this set only come before all others
    placed = F.transform("shared", lambda x, i: F.struct(x["token"].alias("token"), (first + i).alias("at"), (x["held"] > FREQUENT).alias("hot")))
    marked = stored(marked.withColumn("shared", placed))
    index = stored(marked.mapInArrow(index_keys(rule), "key long, node long, n long"))

    # plain pairs: rare tokens in common, as many as the regions leave room for
    frequent = small(marked.select("node", "frequent"))
    rare = shared.filter(~hot).groupBy("token").agg(F.collect_list(F.struct("node", "n")).alias("members"))
    counted = pairs_of_sized(rare, rule).groupBy("a", "b", "n", "m").agg(F.count("*").alias("c"))
    fa, fb = frequent.toDF("a", "fa"), frequent.toDF("b", "fb")
    counted = counted.join(fa, "a", "left").join(fb, "b", "left")
    room = F.least(region_room(rule, "n"), region_room(rule, "m")) - F.least(F.coalesce("fa", F.lit(0)), F.coalesce("fb", F.lit(0)))
    pairs = counted.filter(F.col("c") >= room).select("a", "b")

    tokens, links, classes, lists, centred = None, None, None, index, None
    for level in range(LEVELS + 1):
        lists = classes_of(lists, classes)
        sizes = lists.groupBy("key").agg(F.count("*").alias("size"), F.min("node").alias("centre"), F.min("class").alias("x"), F.max("class").alias("y"))
        sized = stored(lists.join(sizes.filter("x <> y").select("key", "size", "centre"), "key"))
        few = sized.filter(F.col("size") <= LISTED) if level < LEVELS else sized
        found = pairs_of(few.groupBy("key").agg(F.collect_list(F.struct("node", "n", "class")).alias("members")), rule)
        many = sized.filter(F.col("size") > LISTED) if level < LEVELS else sized.limit(0)
        stars = many.filter("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b"), "key")
        others = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        if level == 0:
            pairs = pairs.union(found).union(others)
        else:       # pairs of lists are of two components already
            pairs = found.union(across(others.union(centred).distinct(), classes))
        pairs = stored(alike(pairs.distinct(), nodes, rule))
        if tokens is None:
            tokens = whole_sets(documents, nodes, ends_of(pairs), rule)
        nearest = stored(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
        first = stored(verify(nearest, tokens, rule))
        met = first.select(F.col("b").alias("node"), F.col("a").alias("component"))
        rest = stored(across(pairs.join(nearest, ["a", "b"], "left_anti"), met))      # read three times
        found = first.union(verify(rest, tokens, rule))
        links = stored(found if links is None else links.union(found))
        classes = components(links)
        if many.isEmpty():
            break
        apart = classes_of(many.drop("class"), classes).groupBy("key").agg(F.min("class").alias("x"), F.max("class").alias("y")).filter("x <> y").select("key")
        again = stored(stars.join(apart, "key", "left_semi").select("a", "b").distinct())
        # lists that share members are one group, so that each member is written once a level
        groups = components(again).withColumnRenamed("component", "a")
        groups = stored(groups.join(many.select("node", "n").distinct(), "node").withColumn("size", F.count("*").over(W.partitionBy("a"))))
        whole = F.col("size") <= GROUPED * LISTED
        by_group = classes_of(groups.filter(whole), classes).groupBy("a").agg(F.collect_list(F.struct("node", "n", "class")).alias("members"))
        if level == 0:      # members of open lists that no pair with their centre named
            absent = groups.select("node").join(small(tokens.select("node")), "node", "left_anti")
            tokens = tokens.union(whole_sets(documents, nodes, absent, rule))
        parted = stored(differences(groups.filter(~whole).select("node", "a"), tokens, rule))
        nearest = parted.groupBy("a").agg(F.min(F.struct("gap", "node"))["node"].alias("m"))
        centred = parted.select("a", "node").distinct().join(nearest, "a").filter("node <> m").select(F.least("m", "node").alias("a"), F.greatest("m", "node").alias("b"))
        centred = centred.union(pairs_of(by_group, rule))
        lists = parted.select("key", "node", "n")
    return classes_of(sets.select("k_id", "k_sum", "doc_id", F.col("n").alias("n_shingles"), "node"), classes)


def alike(pairs: DataFrame, nodes: DataFrame, rule: Rule) -> DataFrame:
    """The pairs whose sizes and parities allow a link; none that links goes."""
    def side(end: str, n: str, name: str) -> DataFrame:
        return nodes.join(wanted.filter(f"in_{end}"), "node", "left_semi").select(F.col("node").alias(end), F.col("n").alias(n), F.col("odd").alias(name))

    def half(name: str) -> Column:
        longs = (F.size(name) / 2).cast("int")
        return F.zip_with(F.slice(name, F.lit(1), longs), F.slice(name, longs + 1, longs), lambda p, q: p.bitwiseXOR(q))

    pairs = stored(pairs)
    wanted = ends_known(pairs)
    met = pairs.join(side("a", "n", "x"), "a").join(side("b", "m", "y"), "b").filter(comparable(rule, F.col("n"), F.col("m")))
    met = met.withColumn("u", F.when(F.size("x") == 2 * F.size("y"), half("x")).otherwise(F.col("x")))
    met = met.withColumn("v", F.when(F.size("y") == 2 * F.size("x"), half("y")).otherwise(F.col("y")))
    other = F.aggregate(F.zip_with("u", "v", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, c: s + c)
    least = F.when(F.size("u") == F.size("v"), other).otherwise(0)     # tokens in which the sets differ at least
    return met.filter((rule.scale + rule.percent) * least.cast("long") <= (rule.scale - rule.percent) * (F.col("n") + F.col("m"))).select("a", "b")


def pairs_of_sized(lists: DataFrame, rule: Rule) -> DataFrame:
    both = lists.select(F.col("members").alias("m"), F.posexplode("members").alias("i", "x"))
    both = both.select("x", F.explode(F.slice("m", F.col("i") + 2, F.size("m"))).alias("y")).filter(comparable(rule, "x.n", "y.n"))
    first, second = F.least("x", "y"), F.greatest("x", "y")
    return both.select(first["node"].alias("a"), second["node"].alias("b"), first["n"].alias("n"), second["n"].alias("m"))


def region_room(rule: Rule, n: str):
    """Region tokens of a set of size n that a linked partner must hold."""
    n = F.col(n)
    slack = n - F.ceil(F.lit(rule.percent) * n / F.lit(rule.scale)).cast("long")
    return F.least(n, slack + 1 + ALLOWANCE) - slack


def link_documents(documents: DataFrame, rule: Rule) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document: the smallest doc_id reachable by links.

    Null and empty texts and texts without words have no shingles and link with nothing: their component is their
    own id. A null id links as any text does but names no component (null if the component has no other). Rows
    that repeat an id count each.
    """
    joined = stored(join_sets(documents, rule))
    names = joined.filter("n_shingles > 0").groupBy("class").agg(F.min("doc_id").alias("component_id"))
    with_names = joined.filter("n_shingles > 0").join(names, "class").select("k_id", "k_sum", "doc_id", "n_shingles", "component_id")
    alone = joined.filter("n_shingles = 0").select("k_id", "k_sum", "doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return with_names.union(alone)


def one_of_each(documents: DataFrame, rule: Rule) -> DataFrame:
    """The documents without near copies: of every component the one with the smallest (id, text hash), null
    ids last. All columns are kept, and documents without words all stay. Rows that repeat id and text stay together.
    """
    joined = stored(join_sets(documents, rule))
    order = F.struct(F.col("doc_id").isNull().alias("null_id"), "k_id", "k_sum")
    kept = joined.filter("n_shingles > 0").groupBy("class").agg(F.min(order).alias("k")).select("k.k_id", "k.k_sum")
    gone = joined.filter("n_shingles > 0").select("k_id", "k_sum").distinct().join(kept, ["k_id", "k_sum"], "left_anti")
    row = F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row")
    left = keyed_bytes(documents, row).join(small(gone), ["k_id", "k_sum"], "left_anti")
    return left.select(*[F.col(f"row.`{c}`") for c in documents.columns])


def jaccard_sql(words: int, percent: int, source: str) -> str:
    """CTEs up to ``linked`` (doc_id, n_shingles, component_id) over the table ``source``, for small tables."""
    cut = ", ".join(f"w[i + {j}]" for j in range(words))
    return rf"""
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM {source}),
s AS (SELECT DISTINCT doc_id, array_to_string(sh, ' ') AS s FROM (
  SELECT doc_id, unnest(CASE WHEN len(w) >= {words} THEN list_transform(range(1, len(w) - {words - 2}), lambda i: [{cut}]) WHEN len(w) > 0 THEN [w] ELSE [] END) AS sh FROM w)),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
k AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id JOIN z x ON x.doc_id = a.doc_id JOIN z y ON y.doc_id = b.doc_id
      WHERE 100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n) GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= {percent} * (x.n + y.n - count(*))),
c AS (SELECT doc_id AS a, doc_id AS b FROM {source} UNION SELECT c.a, k.b FROM c JOIN k ON c.b = k.a),
linked AS (SELECT w.doc_id, coalesce(z.n, 0) AS n_shingles, m.m AS component_id FROM w LEFT JOIN z USING (doc_id) JOIN (SELECT a, min(b) AS m FROM c GROUP BY a) m ON m.a = w.doc_id)
"""


@query("op2_jaccard", "WITH RECURSIVE " + jaccard_sql(3, 90, "documents") + "SELECT doc_id, n_shingles, component_id FROM linked")
def op2_jaccard(spark, sf_dir):
    return link_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), Rule(3, 90)).select("doc_id", "n_shingles", "component_id")
