"""SentencePiece encoding and decoding by suffix-array matching."""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from .common import query, table
from .pieces import SPACE, Pieces, portions, ragged, words_of

CACHED_WORDS = 500_000      # of a task; beyond it the cache starts anew (bounds memory, not results)
INDEX_CHARS = 400_000       # text under one suffix array
LONG_WORD = 64              # longer words contract one by one, with a heap


class Matcher:
    """Occurrences of all pieces in a text, by binary search over its suffix array.

    Characters become 16-bit codes of the piece alphabet (0: end of a word, 1: in no piece), four to a 64-bit
    digit, so suffixes are ordered only as deep as the longest piece and a piece is a range of whole keys.
    """

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        alphabet = sorted({c for p in pieces.text for c in p})
        self.codes = np.ones(0x110000, np.uint16)
        self.codes[[ord(c) for c in alphabet]] = np.arange(2, len(alphabet) + 2)
        self.digits = -(-pieces.longest // 4)
        self.sizes = np.array([len(p) for p in pieces.text])
        low = np.zeros((len(pieces.text), 4 * self.digits), ">u2")
        high = np.full_like(low, 0xFFFF)
        for k, p in enumerate(pieces.text):
            low[k, : len(p)] = high[k, : len(p)] = self.codes[[ord(c) for c in p]]
        self.low, self.high = self.as_keys(low), self.as_keys(high)
        self.space = self.codes[ord(SPACE)]
        runs = [k for k in range(1, pieces.longest + 1) if SPACE * k in pieces.by_text]
        tied = [pieces.by_text[SPACE * k] for k in runs if k > 1]
        self.merge_scores = pieces.scores.copy()
        self.merge_scores[[k for k in tied if pieces.scores[k] == pieces.scores.min()]] = -np.inf
        self.run = runs[-1] if runs else 1
        self.run_starts = np.zeros((self.run + 1, self.run + 1), bool)       # by what is left of a run: where its pieces start
        for left in range(1, self.run + 1):
            at = 0
            while at < left:
                self.run_starts[left, at] = True
                at += max((k for k in runs if k <= left - at), default=1)

    def as_keys(self, codes: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(codes).view(f"S{8 * self.digits}").ravel()

    def edges(self, codes: np.ndarray) -> np.ndarray:
        """edges[position, length]: the piece there or -1, from the occurrence range of each piece."""
        width = 4 * self.digits
        padded = np.zeros(len(codes) + width, ">u2")
        padded[: len(codes)] = codes
        # what follows the end of a word does not count
        ends = np.flatnonzero(padded == 0)
        left = ends[np.searchsorted(ends, np.arange(len(codes)))] - np.arange(len(codes))
        suffixes = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, width)[: len(codes)])
        suffixes[np.arange(width) >= left[:, None]] = 0
        keys = suffixes.view(">u8").astype(np.uint64)
        order = np.lexsort(keys.T[::-1])
        ranked = self.as_keys(suffixes[order])
        first = np.searchsorted(ranked, self.low)
        last = np.searchsorted(ranked, self.high, side="right")
        found = np.flatnonzero(last > first)
        at = order[ragged(first[found], last[found] - first[found])]
        piece = np.repeat(found, last[found] - first[found])
        table = np.full((len(codes), self.pieces.longest + 1), -1, np.int32)
        table[at, self.sizes[piece]] = piece
        return table


def relax_merges(edges, scores, starts, sizes):
    """Segmentation of every word of a merge-ranked (BPE) model: (symbol start, symbol length, word).

    All words at once: in each round every word relaxes its best edge, the best-scored piece that spans two
    neighbouring symbols, leftmost if equal; words without one are final.
    """
    word = np.repeat(np.arange(len(starts)), sizes)
    at = ragged(starts, sizes)
    length = np.ones(len(at), np.int64)
    done = []
    while len(at):
        joint = np.zeros(len(at), np.int64)
        joint[:-1] = np.where(word[1:] == word[:-1], length[:-1] + length[1:], 0)
        joint[joint >= edges.shape[1]] = 0
        piece = np.where(joint > 0, edges[at, joint], -1)
        score = np.where(piece >= 0, scores[piece], -np.inf)
        heads = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        counts = np.diff(np.r_[heads, len(at)])
        top = np.maximum.reduceat(score, heads)
        open_word = np.repeat(top > -np.inf, counts)
        if not open_word.all():
            done.append((at[~open_word], length[~open_word], word[~open_word]))
        best = np.flatnonzero(open_word & (score == np.repeat(top, counts)))
        best = best[np.r_[True, word[best][1:] != word[best][:-1]]] if len(best) else best
        length[best] = joint[best]
        keep = open_word
        keep[best + 1] = False
        at, length, word = at[keep], length[keep], word[keep]
    out = [np.concatenate(x) for x in zip(*done, strict=True)] if done else [np.empty(0, np.int64)] * 3
    order = np.argsort(out[0], kind="stable")
    return [x[order] for x in out]


def group_spaces(matcher, codes, at, length, word):
    """Space marks that no merge took, grouped from the left into the longest pieces of space marks. These
    pieces tie on the lowest score, so they come last and the model's library takes them this way."""
    single = (length == 1) & (codes[at] == matcher.space)
    start = single & ~(np.r_[False, single[:-1]] & np.r_[False, word[1:] == word[:-1]] & np.r_[False, at[1:] == at[:-1] + 1])
    head = np.flatnonzero(start)
    marks = np.flatnonzero(single)
    owner = np.cumsum(start)[marks] - 1
    offset = marks - head[owner]
    size = np.bincount(owner, minlength=len(head))[owner] if len(head) else np.empty(0, np.int64)
    full = size - size % matcher.run
    opens = np.where(offset < full, offset % matcher.run == 0, matcher.run_starts[size % matcher.run, np.maximum(offset - full, 0) % (matcher.run + 1)])
    keep = np.ones(len(at), bool)
    keep[marks[~opens]] = False
    grown = np.add.reduceat(length, np.flatnonzero(keep)) if keep.any() else length[:0]
    return at[keep], grown, word[keep]


def relax_one(edges, scores, start, size):
    """The same for one long word, with a heap of candidate merges: (symbol starts, symbol lengths)."""
    length = {start + i: 1 for i in range(size)}
    before = {start + i: start + i - 1 for i in range(size)}
    stop = start + size
    heap = []

    def offer(p):
        q = p + length[p]
        if p >= start and q < stop:
            joint = length[p] + length[q]
            if joint < edges.shape[1] and edges[p, joint] >= 0 and scores[edges[p, joint]] > -np.inf:
                heapq.heappush(heap, (-scores[edges[p, joint]], p, joint))

    for i in range(size):
        offer(start + i)
    while heap:
        _, p, joint = heapq.heappop(heap)
        if p not in length or p + length[p] not in length or length[p] + length[p + length[p]] != joint:
            continue                                                    # one of its symbols is gone
        del length[p + length[p]]
        length[p] = joint
        if p + joint < stop:
            before[p + joint] = p
        offer(p)
        if p > start:
            offer(before[p])
    at = np.array(sorted(length), np.int64)
    return at, np.array([length[p] for p in at.tolist()], np.int64)


def relax_scores(edges, scores, unknown, starts, sizes):
    """Segmentation of every word of a unigram model: edges are relaxed in order of their end, all words side by side.

    Equal sums go to the edge that starts first. A character without a piece has the unknown score.
    """
    longest = edges.shape[1] - 1
    score = np.full(int((starts + sizes).max()) + 1 if len(starts) else 1, -np.inf)    # at the end position, by word
    back = np.zeros(len(score), np.int64)
    for depth in range(1, int(sizes.max()) + 1 if len(sizes) else 1):
        words = np.flatnonzero(sizes >= depth)
        end = starts[words] + depth
        top, size_of = np.full(len(words), -np.inf), np.ones(len(words), np.int64)
        for size in range(1, min(depth, longest) + 1):
            begin = end - size
            piece = edges[begin, size]
            base = np.where(begin == starts[words], 0.0, score[begin])
            gain = np.where(piece >= 0, scores[piece], unknown if size == 1 else -np.inf)
            better = base + gain >= top
            top, size_of = np.where(better, base + gain, top), np.where(better, size, size_of)
        score[end], back[end] = top, size_of
    at, length, word = [], [], []
    ends, words = starts + sizes, np.arange(len(starts))
    while len(words):
        size = back[ends]
        at.append(ends - size), length.append(size), word.append(words)
        ends = ends - size
        left = ends > starts[words]
        ends, words = ends[left], words[left]
    out = [np.concatenate(x) if x else np.empty(0, np.int64) for x in (at, length, word)]
    order = np.argsort(out[0], kind="stable")
    return [x[order] for x in out]


def encode_words(words: list[str], matcher: Matcher) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words one after the other, and how many each has. Characters in no piece become their bytes."""
    pieces = matcher.pieces
    lengths = np.array([len(w) for w in words], np.int64)
    group = np.cumsum(lengths) // INDEX_CHARS
    flats, counts = [], []
    for g in np.unique(group):
        mine = np.flatnonzero(group == g)
        text = "\0".join(words[i] for i in mine) + "\0"
        chars = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        sizes = lengths[mine]
        starts = np.cumsum(sizes + 1) - sizes - 1
        codes = matcher.codes[chars]
        codes[starts + sizes] = 0
        edges = matcher.edges(codes)
        if pieces.ranked:
            short = np.flatnonzero(sizes <= LONG_WORD)
            at, length, word = relax_merges(edges, matcher.merge_scores, starts[short], sizes[short])
            word = short[word]
            for i in np.flatnonzero(sizes > LONG_WORD):
                a, n = relax_one(edges, matcher.merge_scores, int(starts[i]), int(sizes[i]))
                at, length, word = np.r_[at, a], np.r_[length, n], np.r_[word, np.full(len(a), i)]
            order = np.argsort(at, kind="stable")
            at, length, word = group_spaces(matcher, codes, at[order], length[order], word[order])
        else:
            at, length, word = relax_scores(edges, pieces.scores, pieces.unknown_score, starts, sizes)
        piece = edges[at, length]
        ids = pieces.ids[piece]
        spelled = np.flatnonzero(piece < 0)
        repeat = np.ones(len(at), np.int64)
        raw = [text[at[i]].encode() for i in spelled]
        repeat[spelled] = [len(b) for b in raw]
        flat = np.repeat(ids, repeat)
        first = np.cumsum(repeat) - repeat
        flat[ragged(first[spelled], repeat[spelled])] = pieces.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        flats.append(flat)
        counts.append(np.bincount(word, weights=repeat, minlength=len(mine)).astype(np.int64))
    return np.concatenate(flats) if flats else np.empty(0, np.int32), np.concatenate(counts) if counts else np.empty(0, np.int64)


class Decoder:
    """Text of id sequences: surfaces joined, space marks as spaces, bytes as UTF-8, without the dummy space."""

    def __init__(self, pieces: Pieces):
        is_byte = np.full(len(pieces.surfaces), -1)
        is_byte[pieces.byte_ids] = np.arange(256)
        special = set(range(len(pieces.surfaces))) - set(pieces.ids.tolist()) - set(pieces.byte_ids.tolist())
        raw = [bytes([is_byte[i]]) if is_byte[i] >= 0 else b"" if i in special else s.replace(SPACE, " ").encode()
               for i, s in enumerate(pieces.surfaces)]
        self.sizes = np.array([len(b) for b in raw])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)

    def texts(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        sizes = self.sizes[ids]
        raw = self.bytes[ragged(self.starts[ids], sizes)].tobytes()
        ends = np.r_[0, np.cumsum(sizes)][np.cumsum(counts)].tolist() if len(counts) else []
        out, start = [], 0
        for end in ends:
            out.append(raw[start + (raw[start:start + 1] == b" "):end].decode("utf-8", "replace"))
            start = end
        return out


def encode_documents(documents: DataFrame, pieces: Pieces, text_col: str = "text", ids: str = "ids", back: str | None = None) -> DataFrame:
    """All columns plus ``ids`` (array<int>, the ids of the whole text) and, if ``back`` is named, the decoded text.

    The words of each portion of texts that the task has not met are indexed together and encoded once. A null
    text has null ids, an empty one none. Merge-ranked models give the merges' result, unigram models the best
    sum. Nothing is shuffled, and a lost task is simply read again. A column that has the name of a new one is
    replaced.
    """
    shared = documents.sparkSession.sparkContext.broadcast(pieces)
    kept = [c for c in documents.columns if c not in (ids, back)]
    at = kept.index(text_col)

    def run(batches):
        import pyarrow as pa

        matcher, decoder = Matcher(shared.value), Decoder(shared.value)
        cache: dict[str, int] = {}
        flat, first, many = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            for part in portions(batch, at, 1 << 19):
                texts = part.column(at).to_pylist()
                words = [words_of(t or "") for t in texts]
                if len(cache) > CACHED_WORDS:
                    cache, flat, first, many = {}, flat[:0], first[:0], many[:0]
                fresh = list(dict.fromkeys(w for ws in words for w in ws if w not in cache))
                more, counts = encode_words(fresh, matcher)
                cache.update(zip(fresh, range(len(cache), len(cache) + len(fresh)), strict=True))
                first = np.r_[first, len(flat) + np.cumsum(counts) - counts]
                flat, many = np.r_[flat, more], np.r_[many, counts]
                keys = np.fromiter((cache[w] for ws in words for w in ws), np.int64)
                out = flat[ragged(first[keys], many[keys])]
                ends = np.r_[0, np.cumsum(many[keys])][np.r_[0, np.cumsum([len(ws) for ws in words])]]
                null = [t is None for t in texts]
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(out, pa.int32()),
                                                 mask=pa.array(null) if any(null) else None)
                cols = [*part.columns, lists]
                if back:
                    decoded = decoder.texts(out, np.diff(ends))
                    cols.append(pa.array([None if n else d for n, d in zip(null, decoded, strict=True)], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names=[*kept, ids, *([back] if back else [])])

    schema = documents.select(*[F.col(f"`{c}`") for c in kept]).schema.add(ids, ArrayType(IntegerType()))
    schema = schema.add(back, "string") if back else schema
    return documents.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(run, schema)


def normalised(text):
    """What decoding gives back: the text itself, but that a space mark in it is a space to this model."""
    return F.translate(text, SPACE, " ")


@query("op3_sentencepiece")
def op3_sentencepiece(spark, sf_dir):
    """Ids of every document, their number, and whether decoding them gives the text back."""
    encoded = encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), Pieces.load(), back="decoded")
    return encoded.select("doc_id", "ids", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"),
                          F.col("decoded").eqNullSafe(normalised(F.col("text"))).alias("round_trip"))
