"""Line dedup by winnowed fingerprints: repeated runs of lines go, but for the first."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..session import small
from .common import NO_ID, query, stored, table
from .pieces import portions
from .repeats import Hashes, buffers, mixed, signed

GRAM = 2        # lines of a fingerprint
WINDOW = 2      # neighbouring fingerprints of which the least is kept
RUN = GRAM + WINDOW - 1     # every repeated run of so many lines shares a kept fingerprint

BLANKS = " \t\n\x0b\x0c\r"


def document_key(doc_id: str, text: str) -> list[Column]:
    """Key columns of a document: its id (a fixed number for null) and a hash of its text. Rows that repeat
    both are the same document read again and share its fate."""
    return [F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("k_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("k_text")]


def line_hashes(column):
    """Of every text that has lines which are not blank: for these lines, one after the other, the row, two hashes."""
    data, starts, lengths = buffers(column)
    cut = np.flatnonzero(data == 10)
    begin = np.union1d(starts[lengths > 0], cut + 1)
    begin = begin[begin < len(data)]
    row = np.searchsorted(starts + lengths, begin, side="right")
    end = np.minimum(np.r_[begin[1:], len(data)], (starts + lengths)[row])
    end = np.where((end > begin) & (data[np.maximum(end - 1, 0)] == 10), end - 1, end)
    ink = np.r_[0, np.cumsum((data != 32) & ((data < 9) | (data > 13)))]
    real = ink[end] > ink[begin]
    row, begin, end = row[real], begin[real], end[real]
    return row, *(mixed(Hashes(data, i).of(begin, end), end - begin) for i in (0, 1))


def winnowed(batches):
    """Kernel: a row for every selected fingerprint, with its place (counted in lines that are not blank) and the
    windows of RUN lines that selected it: its GRAM lines extended by a line before, or by one after."""
    import pyarrow as pa

    for batch in batches:
        for part in portions(batch, 2, 1 << 20):
            row, *hashes = line_hashes(part.column(2))
            if len(row) < RUN:
                continue
            place = np.arange(len(row)) - np.searchsorted(row, row)
            gram = [mixed(h[:-1] * np.uint64(3) + h[1:]) for h in hashes]
            window = [signed(mixed(g[:-1] * np.uint64(5) + h[2:])) for g, h in zip(gram, hashes, strict=True)]
            starts = np.flatnonzero(row[2:] == row[:-2])                     # windows of lines of one text
            late = gram[0][starts + 1] < gram[0][starts]                    # which of its two fingerprints is the least
            chosen = np.where(late, starts + 1, starts)
            fingerprint, group = np.unique(chosen, return_inverse=True)
            sides = []
            for side in (late, ~late):
                value = [np.zeros(len(fingerprint), np.int64) for _ in window]
                has = np.zeros(len(fingerprint), bool)
                has[group[side]] = True
                for v, w in zip(value, window, strict=True):
                    v[group[side]] = w[starts[side]]
                sides += [pa.array(v, mask=~has) for v in value]
            of = pa.array(row[fingerprint])
            yield pa.RecordBatch.from_arrays([pa.array(signed(gram[0][fingerprint])), part.column(0).take(of), part.column(1).take(of),
                                              pa.array(place[fingerprint], pa.int32()), *sides], names=["gram", "k_id", "k_text", "place", "b1", "b2", "a1", "a2"])


def fingerprints(documents: DataFrame) -> DataFrame:
    """(gram, k_id, k_text, place, b1, b2, a1, a2): each selected fingerprint of each text, and the hashes of its lines
    with the line before (b) and with the line after (a), null where that window selected another."""
    docs = documents.filter("text is not null").select(*document_key("doc_id", "text"), F.col("text").cast("binary").alias("bytes"))
    return docs.mapInArrow(winnowed, "gram long, k_id long, k_text long, place int, b1 long, b2 long, a1 long, a2 long")


def repeated_lines(documents: DataFrame) -> DataFrame:
    """(k_id, k_text, gone): the first lines of the windows that stood before, counted in lines that are not blank;
    one row per document that has any.

    Positions of equal fingerprints meet by their windows: a match goes on before or behind a fingerprint exactly if
    the window on that side is equal, and neighbouring windows join up to the whole run. The earliest place of each
    window is found by minima that are taken map-side, so a line that many documents share is no large group.
    """
    found = stored(fingerprints(documents))
    grams = found.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1").select("gram")
    common = found.join(grams, "gram", "left_semi")
    before = F.struct((F.col("place") - 1).alias("first"), F.col("b1").alias("w1"), F.col("b2").alias("w2"))
    after = F.struct(F.col("place").alias("first"), F.col("a1").alias("w1"), F.col("a2").alias("w2"))
    sides = common.select("k_id", "k_text", F.explode(F.filter(F.array(before, after), lambda s: s["w1"].isNotNull())).alias("s")).select("k_id", "k_text", "s.*")
    place = F.struct("k_id", "k_text", "first")
    firsts = sides.groupBy("w1", "w2").agg(F.min(place).alias("origin"), F.max(place).alias("last")).filter("origin < last").drop("last")
    later = sides.join(firsts, ["w1", "w2"]).filter(place > F.col("origin"))
    return later.groupBy("k_id", "k_text").agg(F.array_sort(F.collect_set("first")).alias("gone"))


def unused(name: str, taken: list[str]) -> str:
    """The name, with as many underscores as make it none of those taken (in any case)."""
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def dedup_lines(documents: DataFrame, counts: bool | tuple[str, str] = False) -> DataFrame:
    """Delete every line within a run of RUN lines that stood before: earlier in the same text or in a document
    with a smaller (doc_id, text hash); a null doc_id comes first. The first run of its kind stays whole.

    Lines end at a line feed and are compared exactly; blank lines do not count as lines of a run and stay.
    A null text stays null, and a text that loses all its lines becomes empty. All columns are kept. With
    ``counts`` n_lines (0 for null) and n_removed are added, or columns by two other names; a column that has such a
    name is replaced. The work on a text grows with its length, however many lines it has.
    """
    names = () if not counts else ("n_lines", "n_removed") if counts is True else counts
    kept = [c for c in documents.columns if c not in names]
    one, two, lost = (unused(n, [*kept, *names]) for n in ("k_id", "k_text", "gone"))
    gone = small(repeated_lines(documents)).toDF(one, two, lost)
    key_id, key_text = document_key("doc_id", "text")
    keyed = documents.select(*[F.col(f"`{c}`") for c in kept], key_id.alias(one), key_text.alias(two))
    joined = keyed.join(gone, [one, two], "left").select(*[f"`{c}`" for c in kept], f"`{lost}`")
    at = kept.index("text")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in portions(batch, at, 1 << 20):
                texts, n_lines, n_removed = [], [], []
                for text, first in zip(part.column(at).to_pylist(), part.column(len(kept)).to_pylist(), strict=True):
                    n_lines.append(0 if text is None else text.count("\n") + 1)
                    removed = 0
                    if first:
                        lines = text.split("\n")
                        real = [i for i, s in enumerate(lines) if s.strip(BLANKS)]
                        drop = {real[f + k] for f in first for k in range(RUN)}
                        removed = len(drop)
                        text = "\n".join(s for i, s in enumerate(lines) if i not in drop)
                    texts.append(text)
                    n_removed.append(removed)
                columns = [pa.array(texts, pa.string()) if i == at else part.column(i) for i in range(len(kept))]
                more = [pa.array(n_lines, pa.int64()), pa.array(n_removed, pa.int64())] if names else []
                yield pa.RecordBatch.from_arrays([*columns, *more], names=[*kept, *names])

    fields = [*joined.schema.fields[:-1], *[StructField(n, LongType()) for n in names]]
    return joined.mapInArrow(run, StructType(fields))


#: The same by windows of three lines outright, without fingerprints.
LINES_SQL = r"""
l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM {documents} WHERE text IS NOT NULL),
m AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS j FROM l WHERE NOT regexp_full_match(line, '[\x20\x09-\x0D]*')),
w AS (
  SELECT doc_id, j, i AS i1, lead(i) OVER o AS i2, lead(i, 2) OVER o AS i3,
         line || chr(10) || lead(line) OVER o || chr(10) || lead(line, 2) OVER o AS body
  FROM m WINDOW o AS (PARTITION BY doc_id ORDER BY j)),
r AS (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, j) AS n FROM w WHERE body IS NOT NULL),
gone AS (SELECT DISTINCT doc_id, unnest([i1, i2, i3]) AS i FROM r WHERE n > 1),
kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE g.i IS NULL) AS text, count(*) AS n_lines, count(g.i) AS n_removed
  FROM l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id),
deduped AS (
  SELECT d.* REPLACE (CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text), coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed
  FROM {documents} d LEFT JOIN kept k ON d.doc_id = k.doc_id)
"""


@query("op7_line_dedup", "WITH " + LINES_SQL.replace("{documents}", "documents") + "SELECT doc_id, text, n_lines, n_removed FROM deduped")
def op7_line_dedup(spark, sf_dir):
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)
