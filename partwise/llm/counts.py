"""Token counts under a unigram piece model: forward scores shared over a trie of pre-tokens."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .common import query, table
from .pieces import BASE, Pieces, portions, words_of

CACHED_WORDS = 500_000      # of a task; beyond it the cache starts anew (bounds memory, not results)
TRIE_CHARS = 40             # longer words (a few per million) take the same recursion one by one


def count_one(word: str, pieces: Pieces) -> int:
    """Tokens on the best path of one word, by the plain forward recursion."""
    best, count = [0.0], [0]
    for end in range(1, len(word) + 1):
        top, tokens = -np.inf, 0
        for start in range(end - 1, max(-1, end - 1 - pieces.longest), -1):
            k = pieces.by_text.get(word[start:end])
            if k is not None:
                score, more = pieces.scores[k], 1
            elif start == end - 1:
                score, more = pieces.unknown_score, len(word[start:end].encode())
            else:
                continue
            if best[start] + score >= top:
                top, tokens = best[start] + score, count[start] + more
        best.append(top)
        count.append(tokens)
    return count[-1]


def trie_counts(words: list[str], pieces: Pieces) -> np.ndarray:
    """Token count of each word's best path.

    The sorted words are a trie: the node of word i at depth d is new only if the word before does not share
    its first d characters. Depth by depth the forward score of every new node is computed once, from the
    nodes of its own path up to the longest piece above it, and words read the count at their last node.
    Equal scores go to the piece that starts first. A character that is no piece counts its UTF-8 bytes.
    """
    out = np.zeros(len(words), np.int32)
    short = sorted((w, i) for i, w in enumerate(words) if len(w) <= TRIE_CHARS)
    for i, w in enumerate(words):
        if len(w) > TRIE_CHARS:
            out[i] = count_one(w, pieces)
    if not short:
        return out
    lengths = np.array([len(w) for w, _ in short])
    deepest = int(lengths.max())
    chars = np.zeros((len(short), deepest + 1), np.uint32)
    flat = np.frombuffer("".join(w for w, _ in short).encode("utf-32-le"), np.uint32)
    rows = np.repeat(np.arange(len(short)), lengths)
    chars[rows, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat + 1
    shared = np.zeros(len(short), np.int64)
    if len(short) > 1:
        shared[1:] = np.argmax(chars[1:] != chars[:-1], axis=1)         # the words differ, so one column does
    node = np.zeros((deepest + 1, len(short)), np.int32)                # of each word, by depth
    score, count = [np.zeros(1)], [np.zeros(1, np.int32)]
    powers = BASE ** np.arange(pieces.longest, dtype=np.uint64)
    targets = np.array([i for _, i in short])
    for depth in range(1, deepest + 1):
        alive = lengths >= depth
        new = alive & (shared < depth)
        node[depth] = np.cumsum(new) - 1
        rows = np.flatnonzero(new)
        top, tokens = np.full(len(rows), -np.inf), np.zeros(len(rows), np.int32)
        key = np.zeros(len(rows), np.uint64)
        for size in range(1, min(depth, pieces.longest) + 1):
            key = key + chars[rows, depth - size].astype(np.uint64) * powers[size - 1]
            k = pieces.find(key)
            above = node[depth - size][rows]
            from_score, from_count = score[depth - size][above], count[depth - size][above]
            if size == 1:
                code = chars[rows, depth - 1] - 1
                more = np.where(k >= 0, 1, 1 + (code > 0x7F).astype(np.int32) + (code > 0x7FF) + (code > 0xFFFF))
                top = from_score + np.where(k >= 0, pieces.scores[k], pieces.unknown_score)
                tokens = from_count + more.astype(np.int32)
            else:
                at = np.flatnonzero(k >= 0)
                reached = from_score[at] + pieces.scores[k[at]]
                better = reached >= top[at]
                at = at[better]
                top[at], tokens[at] = reached[better], from_count[at] + 1
        score.append(top)
        count.append(tokens)
        ends = np.flatnonzero(lengths == depth)
        out[targets[ends]] = tokens[node[depth][ends]]
    return out


def count_tokens(documents: DataFrame, pieces: Pieces, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_pretokens, n_tokens) for each document: pre-tokens, with repeats, and tokens of its whole text.

    Null and empty texts have 0 of either. Repeated rows give
    repeated results. Only a scan: nothing is shuffled, and a lost task is simply read again.
    """
    shared = documents.sparkSession.sparkContext.broadcast(pieces)

    def run(batches):
        import pyarrow as pa

        model, cache = shared.value, {}
        for batch in batches:
            for part in portions(batch, 1):
                words = [words_of(t or "") for t in part.column(1).to_pylist()]
                if len(cache) > CACHED_WORDS:
                    cache = {}
                fresh = list({w for ws in words for w in ws if w not in cache})
                cache.update(zip(fresh, trie_counts(fresh, model).tolist(), strict=True))
                totals = [sum(map(cache.__getitem__, ws)) for ws in words]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(map(len, words), pa.int64()), pa.array(totals, pa.int64())],
                    names=[id_col, "n_pretokens", "n_tokens"])

    kind = documents.schema[id_col].dataType.simpleString()
    return documents.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_pretokens long, n_tokens long")


@query("op8_token_counts")
def op8_token_counts(spark, sf_dir):
    return count_tokens(table(spark, sf_dir, "documents"), Pieces.load().unigram)
