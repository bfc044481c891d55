"""Exact repeats of long byte strings: a depth-limited radix sort of suffixes, most significant digit first."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from ..session import small
from .common import NO_ID, query, stored, table
from .pieces import portions, ragged

WIDTH = 200             # bytes of a string that counts as repeated
GRAM = 64               # bytes of the first digit
STEPS = (32, 8, 1)      # neighbouring suffixes that share each further digit; the last is the whole string
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


class Hashes:
    """Hashes of any byte range of a buffer, from prefix sums of table[byte] * base^position modulo 2^64."""

    def __init__(self, data: np.ndarray, which: int):
        values = np.random.default_rng(100 + which).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        n = len(data)
        base = BASES[which]
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, inverse)]), dtype=np.uint64)
        up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n - 1, 0), base)]), dtype=np.uint64)[:n]
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values[data] * up, out=self.sums[1:])

    def of(self, start, stop):
        return (self.sums[stop] - self.sums[start]) * self.down[start]

    def grams(self, size: int):
        return (self.sums[size:] - self.sums[:-size]) * self.down[: len(self.sums) - size]


def mixed(h: np.ndarray, *more) -> np.ndarray:
    """Finaliser: every bit of the input reaches every bit of the output."""
    for m in more:
        h = h ^ (m.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def least_grams(grams: np.ndarray, window: int) -> np.ndarray:
    """For each window of grams the position of the least, the first one if equal (running minima from both sides)."""
    bits = np.uint64(max(1, int(len(grams)).bit_length()))
    ranked = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
    pad = -len(ranked) % window
    cells = np.concatenate([ranked, np.full(pad, np.iinfo(np.uint64).max)]).reshape(-1, window)
    ahead = np.minimum.accumulate(cells, axis=1).ravel()
    behind = np.minimum.accumulate(cells[:, ::-1], axis=1)[:, ::-1].ravel()
    count = len(grams) - window + 1
    least = np.minimum(behind[:count], ahead[window - 1: window - 1 + count])
    return (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def anchors_of(one: Hashes, two: Hashes, starts: np.ndarray, lengths: np.ndarray):
    """Runs of neighbouring suffixes with one first digit: (document, first, last, anchor, digit, whole).

    The first digit of a suffix is the least-hashed GRAM-byte string within its first WIDTH bytes, with its place
    there. It depends on those bytes alone, so equal suffixes share it, and about 70 neighbours share one anchor
    and are one row. ``whole`` hashes all bytes that the run's suffixes cover.
    """
    grams = mixed(one.grams(GRAM))
    least = least_grams(grams, WIDTH - GRAM + 1)
    fit = np.maximum(lengths - WIDTH + 1, 0)
    first = ragged(starts, fit)
    owner = np.repeat(np.arange(len(starts)), fit)
    at = least[first]
    heads = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])]) if len(at) else np.empty(0, np.int64)
    tails = np.r_[heads[1:], len(at)] - 1 if len(heads) else heads
    low, high, anchor, doc = first[heads], first[tails], at[heads], owner[heads]
    whole = mixed(two.of(low, high + WIDTH), anchor - low, high - low)
    return doc, low - starts[doc], high - starts[doc], anchor - starts[doc], grams[anchor], whole


def segments_of(one: Hashes, two: Hashes, doc_start, low, high, anchor, step: int):
    """The next digits of the suffixes low..high of some runs: ``step`` neighbouring places of the anchor share the
    bytes that all their suffixes have in common. Returns (run, from, to, core, full): the run's row, the places of
    the anchor, the hash of the common bytes and of all bytes covered."""
    s0, s1 = (anchor - high) // step, (anchor - low) // step
    run = np.repeat(np.arange(len(low)), s1 - s0 + 1)
    s = ragged(s0, s1 - s0 + 1)
    lo, hi = np.maximum((anchor - high)[run], step * s), np.minimum((anchor - low)[run], step * s + step - 1)
    at = anchor[run] + doc_start[run]
    core = mixed(one.of(at - step * s, at - step * s + WIDTH - step + 1), s + 1000 * step)
    full = mixed(two.of(at - hi, at - lo + WIDTH), lo, hi)
    return run, lo, hi, core, full


def signed(x: np.ndarray):
    return x.view(np.int64) if x.dtype == np.uint64 else x


def buffers(column):
    """Bytes of an Arrow binary column in one array, with starts and lengths (null: empty)."""
    values = [v or b"" for v in column.to_pylist()]
    lengths = np.array([len(v) for v in values], np.int64)
    return np.frombuffer(b"".join(values), np.uint8), np.cumsum(lengths) - lengths, lengths


SEGMENTS = "array<struct<core: long, full: long, lo: int, hi: int>>"
RUN = f"k_id long, k_sum long, anchor int, lo int, hi int, core long, full long, parts {SEGMENTS}"
SEGMENT = "k_id long, k_sum long, anchor int, lo int, hi int, core long, full long"


def narrow(x):
    import pyarrow as pa

    return pa.array(x.astype(np.int32))


def find_runs(batches):
    """Every run of a text with its first digit (core), its whole (full) and its segments of STEPS[0] suffixes."""
    import pyarrow as pa

    for batch in batches:
        for part in portions(batch, 2, 1 << 20):
            data, starts, lengths = buffers(part.column(2))
            if len(data) < WIDTH:
                continue
            one, two = Hashes(data, 0), Hashes(data, 1)
            doc, low, high, anchor, digit, whole = anchors_of(one, two, starts, lengths)
            run, lo, hi, core, full = segments_of(one, two, starts[doc], low, high, anchor, STEPS[0])
            fields = pa.StructArray.from_arrays([pa.array(signed(core)), pa.array(signed(full)), narrow(lo), narrow(hi)], names=["core", "full", "lo", "hi"])
            ends = np.r_[0, np.cumsum(np.bincount(run, minlength=len(doc)))]
            key = part.select(["k_id", "k_sum"]).take(pa.array(doc))
            yield pa.RecordBatch.from_arrays(
                [key.column(0), key.column(1), narrow(anchor), narrow(anchor - high), narrow(anchor - low), pa.array(signed(digit)), pa.array(signed(whole)),
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()), fields)], names=["k_id", "k_sum", "anchor", "lo", "hi", "core", "full", "parts"])


def find_segments(step: int):
    def run(batches):
        """Segments of ``step`` suffixes of the runs listed with each text."""
        import pyarrow as pa

        for batch in batches:
            for part in portions(batch, 2, 1 << 20):
                data, starts, _ = buffers(part.column(2))
                listed = part.column(3)
                doc = np.repeat(np.arange(len(starts)), np.diff(listed.offsets.to_numpy()))
                flat = listed.flatten()
                anchor, lo, hi = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
                found, lo, hi, core, full = segments_of(Hashes(data, 0), Hashes(data, 1), starts[doc], anchor - hi, anchor - lo, anchor, step)
                key = part.select(["k_id", "k_sum"]).take(pa.array(doc[found]))
                yield pa.RecordBatch.from_arrays([key.column(0), key.column(1), narrow(anchor[found]), narrow(lo), narrow(hi), pa.array(signed(core)), pa.array(signed(full))],
                                                 names=["k_id", "k_sum", "anchor", "lo", "hi", "core", "full"])

    return run


def keyed_bytes(documents: DataFrame, *keep) -> DataFrame:
    """k_id, k_sum (64-bit hash of the text), bytes (+ kept columns). Rows that repeat doc_id and text are occurrences of their own but share their fate."""
    data = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("k_id"), F.xxhash64(data).alias("k_sum"), data.alias("bytes"), *keep)


def common_cores(rows: DataFrame) -> DataFrame:
    """The digits that more than one row has, and whether all their rows are equal as a whole."""
    found = rows.groupBy("core").agg(F.count("*").alias("n"), F.min("full").alias("a"), F.max("full").alias("b"))
    return small(found.filter("n > 1").select("core", (F.col("a") == F.col("b")).alias("one")))


def covered(rows: DataFrame) -> DataFrame:
    """The byte range of each row's suffixes."""
    span = F.struct((F.col("anchor") - F.col("hi")).alias("start"), (F.col("anchor") - F.col("lo") + WIDTH).alias("stop"))
    return rows.select("k_id", "k_sum", span.alias("span"))


def repeated_spans(documents: DataFrame) -> DataFrame:
    """(k_id, k_sum, spans): byte ranges covered by repeated strings, one row per document that has any.

    Suffixes are sorted only through WIDTH bytes and only as far as needed, one digit a pass, and neighbours that
    share a digit are one row. Rows alone with their digit leave. Rows whose digit says that all of them are equal
    as a whole are repeats outright. The others are told apart by the next digit, of fewer neighbours and more
    bytes: the anchor string and its place first, then what 32, 8 and 1 neighbours have in common. Digits are
    counted map-side; of each class of equal rows one goes on to the next pass for comparison.
    """
    docs = keyed_bytes(documents).filter(F.octet_length("bytes") >= WIDTH)
    runs = docs.mapInArrow(find_runs, RUN)
    hit = runs.join(common_cores(runs.drop("parts")), "core")
    once = F.struct("core", "full", "lo", "hi")
    rows = F.when(F.col("one"), F.array(once)).otherwise(F.col("parts"))
    hit = stored(hit.select("k_id", "k_sum", "anchor", "one", F.explode(rows).alias("p")).select("k_id", "k_sum", "anchor", "one", "p.*"))
    spans = covered(hit.filter("one"))
    open_rows = hit.filter(~F.col("one")).drop("one")
    for step in [*STEPS[1:], 0]:
        hit = stored(open_rows.join(common_cores(open_rows), "core"))
        spans = spans.union(covered(hit.filter("one")))
        if not step:
            break           # the last digit is the whole string
        several = hit.filter(~F.col("one"))
        one_of = F.min(F.struct("k_id", "k_sum", "anchor", "lo", "hi")).alias("r")
        classes = stored(several.groupBy("core", "full").agg(F.count("*").alias("n"), one_of))
        spans = spans.union(covered(several.join(classes.filter("n > 1").select("core", "full"), ["core", "full"], "left_semi")))
        members = classes.select("r.*").groupBy("k_id", "k_sum").agg(F.collect_set(F.struct("anchor", "lo", "hi")).alias("runs"))
        keys = small(classes.select("r.k_id", "r.k_sum").distinct())
        texts = docs.join(keys, ["k_id", "k_sum"], "left_semi").join(members, ["k_id", "k_sum"]).dropDuplicates(["k_id", "k_sum"])
        open_rows = stored(texts.select("k_id", "k_sum", "bytes", "runs").mapInArrow(find_segments(step), SEGMENT))
    return spans.groupBy("k_id", "k_sum").agg(F.collect_list("span").alias("spans"))


def merged(spans) -> list[tuple[int, int]]:
    """Overlapping or touching ranges as one each, in order."""
    out: list[list[int]] = []
    for a, b in sorted((s["start"], s["stop"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove_repeats(documents: DataFrame) -> DataFrame:
    """All columns plus ``bytes`` (the UTF-8 text; null: empty), ``removed`` (its byte ranges, maximal, in order) and
    ``kept`` (the rest joined). A byte goes if a WIDTH-byte string over it also starts anywhere else, in the same
    text or another, judged on the input. Rows that repeat doc_id and text are two places. Texts below WIDTH bytes
    keep all. Columns with the names of the new ones are replaced.
    """
    kept = [c for c in documents.columns if c not in ("bytes", "removed", "kept")]
    row = F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row")
    spans = stored(repeated_spans(documents))
    texts, keys = keyed_bytes(documents, row), small(spans.select("k_id", "k_sum"))
    joined = texts.join(keys, ["k_id", "k_sum"], "left_semi").join(spans, ["k_id", "k_sum"])
    joined = joined.unionByName(texts.join(keys, ["k_id", "k_sum"], "left_anti"), allowMissingColumns=True)      # most texts need no shuffle

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            for part in portions(batch, 1):
                ranges = [merged(s) for s in part.column(2).to_pylist()]
                left = []
                for data, gone in zip(part.column(1).to_pylist(), ranges, strict=True):
                    edges = [0, *(x for r in gone for x in r), len(data)]
                    left.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)) if gone else data)
                removed = pa.array([[{"start": a, "stop": b} for a, b in r] for r in ranges], pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), removed, pa.array(left, pa.binary())], names=["row", "bytes", "removed", "kept"])

    span = StructType([StructField("start", IntegerType()), StructField("stop", IntegerType())])
    schema = StructType([joined.select("row").schema[0], StructField("bytes", BinaryType()), StructField("removed", ArrayType(span)), StructField("kept", BinaryType())])
    return joined.select("row", "bytes", "spans").mapInArrow(cut, schema).select(*[F.col(f"row.`{c}`") for c in kept], "bytes", "removed", "kept")


@query("op9_repeats")
def op9_repeats(spark, sf_dir):
    done = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n_bytes = F.octet_length("bytes").cast("long")
    return done.select("doc_id", n_bytes.alias("n_bytes"), (n_bytes - F.octet_length("kept")).alias("n_removed"),
                       F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
