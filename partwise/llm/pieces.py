"""A SentencePiece vocabulary as arrays, and the words into which a text falls for it."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cached_property

import numpy as np

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
UNKNOWN_PENALTY = 10.0
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
BASE = np.uint64(0x100000001B3)


@dataclass(frozen=True)
class Pieces:
    """Ordinary pieces with ids and scores, the ids of the 256 byte pieces, all surfaces by id.

    Read once on the driver; about 2 MB, whatever the data.
    """

    text: list[str]
    ids: np.ndarray
    scores: np.ndarray
    byte_ids: np.ndarray
    surfaces: list[str]

    @staticmethod
    def load(path: str = MODEL_PATH) -> Pieces:
        import sentencepiece

        with open(path, "rb") as f:
            model = sentencepiece.SentencePieceProcessor(model_proto=f.read())
        every = range(model.vocab_size())
        surfaces = [model.id_to_piece(i) for i in every]
        plain = [i for i in every if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        if not all(model.is_byte(int(i)) for i in byte_ids):
            raise ValueError("a vocabulary with byte fallback is needed")
        if any(re.search(f"[^{SPACE}]{SPACE}|\n", surfaces[i]) for i in plain):
            raise ValueError("pieces across words or lines are not supported")
        return Pieces([surfaces[i] for i in plain], np.array(plain, np.int32), np.array([model.get_score(i) for i in plain]), byte_ids, surfaces)

    @cached_property
    def longest(self) -> int:
        return max(map(len, self.text))

    @cached_property
    def by_text(self) -> dict[str, int]:
        return {p: k for k, p in enumerate(self.text)}

    @cached_property
    def ranked(self) -> bool:
        """Whether the scores are merge ranks (whole numbers, as BPE models have) and not log-probabilities."""
        return bool((self.scores == np.round(self.scores)).all())

    @property
    def unigram(self) -> Pieces:
        """The pieces with unigram scores. A merge rank r counts as the log-probability -ln(1 + r) of Zipf's law,
        up to a constant; summed ranks themselves would prefer several short pieces to one common word."""
        if not self.ranked:
            return self
        ranks = np.minimum(-self.scores, float(len(self.surfaces)))
        return Pieces(self.text, self.ids, -np.log1p(ranks), self.byte_ids, self.surfaces)

    @cached_property
    def unknown_score(self) -> float:
        return float(self.scores.min()) - UNKNOWN_PENALTY

    @cached_property
    def hashed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted hashes of the pieces (sum of char * BASE^distance from the end), their order, and a filter bitmap."""
        keys = np.array([sum((ord(c) + 1) * pow(int(BASE), j, 1 << 64) for j, c in enumerate(reversed(p))) % (1 << 64) for p in self.text], np.uint64)
        order = np.argsort(keys)
        if (np.diff(keys[order]) == 0).any():
            raise ValueError("two pieces share a hash")
        seen = np.zeros(1 << 20, bool)
        seen[(keys * MULTIPLIER) >> np.uint64(44)] = True
        return keys[order], order.astype(np.int32), seen

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index of the piece with each hash, or -1."""
        known, order, seen = self.hashed
        out = np.full(len(keys), -1, np.int32)
        maybe = np.flatnonzero(seen[(keys * MULTIPLIER) >> np.uint64(44)])
        at = np.minimum(np.searchsorted(known, keys[maybe]), len(known) - 1)
        hit = known[at] == keys[maybe]
        out[maybe[hit]] = order[at[hit]]
        return out


#: No piece has a space mark after another character, or a line end: words can be cut there and never change the result.
WORDS = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")


def words_of(text: str) -> list[str]:
    """The words of a text with the dummy space in front; joined they are the normalised text."""
    return WORDS.findall(SPACE + text.replace(" ", SPACE)) if text else []


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated ranges start, start + 1, ... of the given lengths."""
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return np.empty(0, np.int64)
    return np.arange(ends[-1]) + np.repeat(starts - (ends - lengths), lengths)


def portions(batch, column: int, size: int = 4 << 20):
    """A record batch in slices of about ``size`` bytes of text (one row at least), so that long texts bound memory too."""
    import pyarrow.compute as pc

    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(lengths) // size
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)
