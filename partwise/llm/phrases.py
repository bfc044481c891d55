"""Phrase collocations from a weighted de Bruijn graph of the corpus, exact."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import dealt, query, stored, table
from .pieces import ragged

LONGEST = 5
LEAST = 100
TOP = 2000
PORTION_BYTES = 3 << 20     # text of a task that is worked on at once, about (one text at least)
BLOCK = 1 << 20             # bytes that are hashed at once
BITMAP_BITS = 1 << 27       # of a filter of frequent words or pairs, at most: 16 MB
FIRST_BASE, SECOND_BASE = 0x100000001B3, 0x9E3779B97F4A7C15 | 1
MASK = (1 << 64) - 1

FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
#: What a byte is: 0 of a word, 1 between words, 2 between pieces.
KIND = np.zeros(256, np.uint8)
KIND[[0x20, 0x09]] = 1
KIND[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2


class Powers:
    """Powers of an odd base and of its inverse, modulo 2^64, for the places of a block."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up, self.down = self.table(self.base), self.table(self.inverse)

    @staticmethod
    def table(base: int) -> np.ndarray:
        out = np.full(BLOCK, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)


def mixed(x: np.ndarray) -> np.ndarray:
    """Bits of a 64-bit number spread over all of it."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers) -> np.ndarray:
    """64-bit hash of each word's bytes: differences of running sums, taken back to the word's own start."""
    at_start, at_end = np.zeros(len(starts), np.uint64), np.zeros(len(starts), np.uint64)
    scale = np.ones(len(starts), np.uint64)
    carry, up, down = 0, 1, 1
    for begin in range(0, len(raw), BLOCK):
        block = raw[begin:begin + BLOCK]
        sums = np.cumsum((block.astype(np.uint64) + np.uint64(1)) * powers.up[:len(block)])
        sums = np.r_[np.uint64(0), sums] * np.uint64(up) + np.uint64(carry)
        a, b = np.searchsorted(starts, [begin, begin + len(block)])
        at_start[a:b] = sums[starts[a:b] - begin]
        scale[a:b] = powers.down[starts[a:b] - begin] * np.uint64(down)
        a, b = np.searchsorted(ends, [begin, begin + len(block)], side="right")
        at_end[a:b] = sums[ends[a:b] - begin]
        carry = int(sums[-1])
        up, down = up * pow(powers.base, len(block), 1 << 64) & MASK, down * pow(powers.inverse, len(block), 1 << 64) & MASK
    return mixed((at_end - at_start) * scale + (ends - starts).astype(np.uint64))


class Words:
    """The words of a run of texts in one language each: where they stand, and what may follow them."""

    def __init__(self, batch, powers: Powers):
        """batch: language numbers (int64) and texts."""
        import pyarrow as pa

        texts = batch.column(1)
        texts = (texts.cast(pa.binary()) if not pa.types.is_large_string(texts.type) else texts.cast(pa.large_binary())).fill_null(b"")
        wide = np.int64 if pa.types.is_large_binary(texts.type) else np.int32
        offsets = np.frombuffer(texts.buffers()[1], wide)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
        data = texts.buffers()[2]
        raw = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.empty(0, np.uint8)
        offsets = offsets - offsets[0]
        self.raw = FOLD[raw]
        kind = KIND[raw]
        word = kind == 0
        border = np.zeros(len(raw) + 1, bool)
        border[offsets] = True
        self.starts = np.flatnonzero(word & (np.r_[True, ~word[:-1]] | border[:-1]))
        self.ends = np.flatnonzero(word & (np.r_[~word[1:], True] | border[1:])) + 1
        text = np.searchsorted(offsets, self.starts, side="right") - 1
        piece = np.cumsum(kind == 2, dtype=np.int64)[self.starts] if len(raw) else np.empty(0, np.int64)
        self.lang = batch.column(0).to_numpy()[text]
        #: whether the next word stands in the same piece
        self.goes_on = np.r_[(text[1:] == text[:-1]) & (piece[1:] == piece[:-1]), False][:len(self.starts)]
        self.hash = word_hashes(self.raw, self.starts, self.ends, powers)
        self.key = mixed(self.hash * np.uint64(3) + self.lang.astype(np.uint64))

    def pair_keys(self) -> np.ndarray:
        """Key of each word with its language and the word after it."""
        return mixed(self.key * np.uint64(5) + np.r_[self.hash[1:], self.hash[:1]])

    def phrase(self, first: int, n: int) -> bytes:
        return b" ".join(self.raw[s:e].tobytes() for s, e in zip(self.starts[first:first + n].tolist(), self.ends[first:first + n].tolist(), strict=True))


def portions_of(batch):
    import pyarrow.compute as pc

    lengths = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(lengths) // PORTION_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


class Bitmap:
    """A set of 64-bit keys as bits: it may hold a key by chance, but never misses one. Bounded in size."""

    def __init__(self, bits: int, data: np.ndarray):
        self.bits, self.data = bits, data

    @staticmethod
    def of(keys: DataFrame) -> Bitmap:
        """From a stored column of keys; what the driver gets are the bytes of the bitmap that are not 0."""
        bits = 1 << 10
        rows = keys.count()
        while bits < min(16 * rows, BITMAP_BITS):
            bits *= 2
        place = F.shiftrightunsigned("key", 64 - (bits.bit_length() - 1)).cast("long")
        words = keys.select(F.shiftright(place, 6).alias("at"), F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(63).cast("int")).alias("bit"))
        filled = words.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
        data = np.zeros(bits // 64, np.uint64)
        data[filled.column("at").to_numpy()] = filled.column("bits").to_numpy().view(np.uint64)
        return Bitmap(bits, data)

    def has(self, keys: np.ndarray) -> np.ndarray:
        place = keys >> np.uint64(64 - (self.bits.bit_length() - 1))
        return (self.data[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def scan(texts: DataFrame, emit, schema: str) -> DataFrame:
    """``emit(words)`` of every run of texts; texts: (language number, text)."""
    def run(batches):
        powers = Powers(FIRST_BASE)
        for batch in batches:
            for part in portions_of(batch):
                yield emit(Words(part, powers))

    return texts.mapInArrow(run, schema)


def frequent(counts: DataFrame, least: int) -> DataFrame:
    return counts.filter(F.col("n") >= least).select("key")


def shared_set(counts: DataFrame, least: int):
    return counts.sparkSession.sparkContext.broadcast(Bitmap.of(stored(frequent(counts, least))))


def count_words(texts: DataFrame) -> DataFrame:
    """(lang, key, n): occurrences of every word, stored."""
    import pyarrow as pa

    def emit(words):
        key, at, n = np.unique(words.key, return_index=True, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(words.lang[at]), pa.array(key.view(np.int64)), pa.array(n)], names=["lang", "key", "n"])

    return stored(scan(texts, emit, "lang long, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n")))


def part_of(count) -> Column:
    """The first words of a phrase, or with a negative count the last."""
    return F.call_function("substring_index", F.col("phrase"), F.lit(" "), count)


def longest_grams(texts: DataFrame, words: DataFrame, longest: int, least: int) -> DataFrame:
    """(lang, phrase, n): the edges of the graph. Every word opens one gram: itself and the words that follow it in
    its piece, ``longest`` at most, up to the first word or pair of words that occurs less than ``least`` times in
    its language (no frequent phrase goes through those). Equal grams are one edge, weighted by their number.
    """
    import pyarrow as pa

    known = shared_set(words, least)

    def pairs_only(words):
        word = known.value.has(words.key)
        pair = words.goes_on & word & np.r_[word[1:], False][:len(word)]
        key, n = np.unique(words.pair_keys()[pair], return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], names=["key", "n"])

    pairs = scan(texts, pairs_only, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    paired = shared_set(pairs, least)
    second = {}

    def grams(words):
        if not second:
            second["powers"] = Powers(SECOND_BASE)
        word = known.value.has(words.key)
        follows = words.goes_on & word & np.r_[word[1:], False][:len(word)]
        follows &= paired.value.has(words.pair_keys())
        more = word_hashes(words.raw, words.starts, words.ends, second["powers"])
        opens = np.flatnonzero(word)
        size = np.ones(len(opens), np.int64)
        one, two = words.key[opens], mixed(more[opens] * np.uint64(3) + words.lang[opens].astype(np.uint64))
        alive = np.ones(len(opens), bool)
        for k in range(1, longest):
            alive = alive & follows[np.minimum(opens + k - 1, len(follows) - 1)]
            at = np.flatnonzero(alive)
            one[at] = mixed(one[at] * np.uint64(5) + words.hash[opens[at] + k])
            two[at] = mixed(two[at] * np.uint64(7) + more[opens[at] + k])
            size[at] += 1
        order = np.lexsort((two, one))
        one, two = one[order], two[order]
        head = np.flatnonzero(np.r_[True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])]) if len(order) else order
        n = np.diff(np.r_[head, len(order)])
        first = opens[order[head]]
        phrases = [words.phrase(i, k) for i, k in zip(first.tolist(), size[order[head]].tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(words.lang[first]), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(n)], names=["lang", "phrase", "n"])

    found = scan(texts, grams, "lang long, phrase string, n long")
    return found.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def flows(edges: DataFrame, longest: int, least: int) -> DataFrame:
    """(lang, phrase, size, a): every phrase with its occurrences, where they are ``least`` or more.

    A shorter phrase occurs wherever an edge begins with it: the flow out of its node along whole grams, and the
    grams that a piece's end cut short. So each edge adds its weight to all its beginnings.
    """
    heads = F.transform(F.sequence(F.lit(1), F.size(F.split("phrase", " "))), lambda k: F.struct(k.alias("size"), part_of(k).alias("phrase")))
    each = edges.select("lang", "n", F.explode(heads).alias("head")).select("lang", "head.phrase", "head.size", "n")
    return each.groupBy("lang", "phrase", "size").agg(F.sum("n").alias("a")).filter(F.col("a") >= least)


def compacted(nodes: DataFrame) -> DataFrame:
    """Candidates (2 words or more) that are no part of a longer phrase of the same weight.

    A phrase whose whole flow leaves by one edge, or comes in by one, lies on an unary path and is compacted into
    that longer phrase. A longer phrase of equal weight always goes through such a neighbour.
    """
    inner = F.col("size") - 1
    longer = nodes.filter("size > 2")
    parts = longer.select("lang", F.explode(F.array(part_of(inner), part_of(-inner))).alias("phrase"), F.col("a").alias("over"))
    most = parts.groupBy("lang", "phrase").agg(F.max("over").alias("over"))
    left = nodes.filter("size > 1").join(most, ["lang", "phrase"], "left")
    return left.filter(F.col("over").isNull() | (F.col("over") < F.col("a"))).drop("over")


def scored(phrases: DataFrame, nodes: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) by the lowest-scoring cut, the first of equal ones; products in 38 digits."""
    cuts = phrases.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part_of(F.col("k")).alias("left"), part_of(F.col("k") - F.col("size")).alias("right"))
    part = nodes.select("lang", "phrase", "a")
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("left"), F.col("a").alias("l")), ["lang", "left"])
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("right"), F.col("a").alias("r")), ["lang", "right"])
    cuts = cuts.join(totals, "lang")
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    cuts = cuts.withColumn("over", wide("a") * 1000 * wide("n")).withColumn("under", wide("l") * wide("r"))
    cuts = cuts.withColumn("score", F.expr("cast(over div under as long)"))
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("cut"))
    return best.select("lang", "phrase", *[F.col(f"cut.{c}").alias(c) for c in ("a", "l", "r", "n", "score")])


def mine_phrases(documents: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = LONGEST, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of 2 to ``longest`` words.

    Null languages are ``und``. Null and empty texts have no words, repeated rows count each time, and a language
    without frequent phrases has no rows. Equal scores go by a, then by the phrase's bytes. Words are told apart
    by 64-bit hashes where that can only let more through, by two of them (128 bits) where they are counted.
    """
    named = documents.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("name"), F.col(text_col).alias("text"))
    texts = named.select(F.xxhash64("name").alias("lang"), "text")
    words = count_words(texts)
    nodes = stored(flows(longest_grams(texts, words, longest, least), longest, least))
    totals = words.groupBy("lang").agg(F.sum("n").alias("n")).join(named.select("name").distinct().withColumn("lang", F.xxhash64("name")), "lang")
    totals = stored(totals)
    rows = scored(compacted(nodes), nodes, totals.select("lang", "n"))
    order = W.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    ranked = ranked.join(totals.select("lang", "name"), "lang")
    return ranked.select(F.col("name").alias("lang"), F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


@query("op11_collocations", r"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc, lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
g AS (SELECT lang, unnest(flatten(list_transform(range(1, len(ws) + 1), lambda i: list_transform(range(1, least(5, len(ws) - i + 1) + 1), lambda k: ws[i:i + k - 1])))) AS gram FROM w WHERE len(ws) > 0),
f AS (SELECT lang, array_to_string(gram, ' ') AS phrase, len(gram) AS size, count(*) AS f, any_value(gram) AS gram FROM g GROUP BY ALL HAVING count(*) >= 100),
totals AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
parts AS (SELECT lang, unnest(list_distinct([array_to_string(gram[1:size - 1], ' '), array_to_string(gram[2:], ' ')])) AS phrase, f FROM f WHERE size > 2),
over AS (SELECT lang, phrase, max(f) AS f FROM parts GROUP BY ALL),
c AS (SELECT f.* FROM f LEFT JOIN over o ON o.lang = f.lang AND o.phrase = f.phrase WHERE f.size > 1 AND (o.f IS NULL OR 100 * o.f < 100 * f.f)),
cuts AS (SELECT lang, phrase, gram, size, f AS a, unnest(range(1, size)) AS k FROM c),
s AS (SELECT c.lang, c.phrase, c.a, k, l.f AS l, r.f AS r, t.n, ((1000::HUGEINT * c.a * t.n) // (l.f::HUGEINT * r.f))::BIGINT AS score
      FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.gram[1:k], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.gram[k + 1:], ' ') JOIN totals t ON t.lang = c.lang),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM best
QUALIFY rank <= 2000""")
def op11_collocations(spark, sf_dir):
    """The 2,000 highest-scoring phrases of each language."""
    return mine_phrases(dealt(table(spark, sf_dir, "documents").select("lang", "text")))
