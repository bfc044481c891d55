"""Alignment of two tokenizers over every text, by merge-path partitioning of their token ends."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from .common import dealt, query, stored, table
from .pieces import MODEL_PATH, SPACE, portions, ragged

BYTE_PATH = "/opt/tokenizers/byte_bpe_50k.json"
WORK = 1024                 # steps of a piece of a merge
JOINED_BYTES = 1 << 16      # text of new chunks that is encoded at once, about
CACHED_CHUNKS = 400_000     # of a task; beyond it the cache starts anew (bounds memory, not results)
PAIRS_AT_ONCE = 1 << 21     # links that are laid out at once
FREQUENT = 1 << 20          # id pairs that are broadcast, at most (16 bytes each)

#: Between other characters and a single space either tokenizer ends a token, whatever stands around.
CUT = re.compile(r"(?<=\S) (?=\S)")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of a byte-level vocabulary: printable Latin-1 bytes stand for themselves, the others,
    in order, for the characters from 256 on."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


@dataclass(frozen=True)
class Vocabularies:
    """Both files, and the bytes of each id: a few MB, whatever the data."""

    byte_file: str
    piece_file: bytes
    a_bytes: list[bytes]
    b_bytes: list[bytes]

    @staticmethod
    def load(byte_path: str = BYTE_PATH, piece_path: str = MODEL_PATH) -> Vocabularies:
        import sentencepiece

        with open(byte_path, encoding="utf-8") as f:
            byte_file = f.read()
        with open(piece_path, "rb") as f:
            piece_file = f.read()
        parsed = json.loads(byte_file)
        alphabet = byte_alphabet()
        special = {x["id"] for x in parsed["added_tokens"]}
        a_bytes = [b""] * (max([*parsed["model"]["vocab"].values(), *special]) + 1)
        for entry, i in parsed["model"]["vocab"].items():
            if i not in special:
                a_bytes[i] = bytes(alphabet[c] for c in entry)
        model = sentencepiece.SentencePieceProcessor(model_proto=piece_file)
        b_bytes = []
        for i in range(model.vocab_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                b_bytes.append(bytes([int(piece[3:5], 16)]))
            else:
                b_bytes.append(b"" if model.is_control(i) or model.is_unknown(i) else piece.replace(SPACE, " ").encode())
        return Vocabularies(byte_file, piece_file, a_bytes, b_bytes)


class Spelled:
    """Bytes of id sequences, and where each token ends."""

    def __init__(self, entries: list[bytes]):
        self.sizes = np.array([len(b) for b in entries])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(entries), np.uint8)

    def text(self, ids: np.ndarray) -> bytes:
        return self.flat[ragged(self.starts[ids], self.sizes[ids])].tobytes()

    def ends(self, ids: np.ndarray) -> np.ndarray:
        return np.cumsum(self.sizes[ids])


def diagonals(a: np.ndarray, b: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many entries of ``a`` are among the first ``at`` of the merge of both (a before an equal b): one binary
    search along each diagonal, all side by side."""
    low, high = np.maximum(0, at - len(b)), np.minimum(at, len(a))
    while (low < high).any():
        mid = (low + high) // 2
        open_ = low < high
        left = a[np.minimum(mid, len(a) - 1)] <= b[np.clip(at - mid - 1, 0, len(b) - 1)]
        low = np.where(open_ & left, mid + 1, low)
        high = np.where(open_ & ~left, mid, high)
    return low


def merge_pieces(a: np.ndarray, b: np.ndarray, work: int = WORK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Overlaps (i, j) of tokens that end at ``a`` and ``b``, in order, and the group of every token.

    The path of the merge has len(a) + len(b) steps. Diagonal searches cut it into pieces of ``work`` steps that
    need nothing of each other; all go on side by side. A step takes the next end of either side (a first) and
    emits the overlap of its token with the one open on the other side, or closes a group where b ends with a. A
    piece numbers its groups from 0; the first goes on with the last one of the piece before, so adding up the
    closings of the pieces stitches them.
    """
    total = len(a) + len(b)
    if not total:
        return (np.empty(0, np.int64),) * 4
    cuts = np.minimum(np.arange(-(-total // work) + 1) * work, total)
    i_cut = diagonals(a, b, cuts)
    i, j, left = i_cut[:-1].copy(), (cuts - i_cut)[:-1], np.diff(cuts)
    a_open, b_open = np.r_[a, np.iinfo(np.int64).max], np.r_[b, np.iinfo(np.int64).max]
    a_before = np.r_[-1, a]                                 # the end taken last of side a, by i
    over_i, over_j = np.full((len(left), work), -1), np.full((len(left), work), -1)
    group_a, group_b, closed = np.empty(len(a), np.int64), np.empty(len(b), np.int64), np.zeros(len(left), np.int64)
    piece_a, piece_b = np.empty(len(a), np.int64), np.empty(len(b), np.int64)
    pieces = np.arange(len(left))
    for step in range(min(work, total)):
        p = pieces if step < left.min() else np.flatnonzero(left > step)
        pi, pj = i[p], j[p]
        from_a = a_open[pi] <= b_open[pj]
        closes = ~from_a & (b_open[pj] == a_before[pi])
        both = ~closes
        over_i[p[both], step], over_j[p[both], step] = pi[both], pj[both]
        group_a[pi[from_a]], piece_a[pi[from_a]] = closed[p[from_a]], p[from_a]
        group_b[pj[~from_a]], piece_b[pj[~from_a]] = closed[p[~from_a]], p[~from_a]
        closed[p] += closes
        i[p] += from_a
        j[p] += ~from_a
    before = np.cumsum(closed) - closed
    seen = over_i.ravel() >= 0
    return over_i.ravel()[seen], over_j.ravel()[seen], group_a + before[piece_a], group_b + before[piece_b]


class Aligner:
    """Aligned chunks of texts, each distinct chunk of a task once.

    A chunk ends where CUT matches: both tokenizers end a token there, so a text's groups are those of its chunks.
    """

    def __init__(self, vocabularies: Vocabularies):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.byte_model = Tokenizer.from_str(vocabularies.byte_file)
        self.byte_model.encode_special_tokens = True
        self.piece_model = sentencepiece.SentencePieceProcessor(model_proto=vocabularies.piece_file)
        self.a, self.b = Spelled(vocabularies.a_bytes), Spelled(vocabularies.b_bytes)
        self.width = len(vocabularies.b_bytes)
        self.names = np.array([f"{i}{end}" for end in ",|;" for i in range(max(len(vocabularies.a_bytes), self.width))], object)
        self.names_each = len(self.names) // 3
        self.forget()

    def forget(self):
        self.known: dict[str, int] = {}
        self.said: list[str] = []
        #: by chunk: whether both spell it, and numbers of a tokens, b tokens, groups, links
        self.facts = np.empty((0, 5), np.int64)
        self.first, self.many = np.empty(0, np.int64), np.empty(0, np.int64)
        self.pairs, self.links = np.empty(0, np.int64), np.empty(0, np.int64)

    def both_ids(self, chunks: list[str]):
        """(a ids, b ids, text) of the chunks joined, or None where either spells something else."""
        joined = "".join(chunks)
        raw = joined.encode()
        a = np.array(self.byte_model.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.int64)
        b = np.array(self.piece_model.encode(joined[1:], num_threads=1), np.int64)
        fine = raw and self.a.text(a) == raw and self.b.text(b) == raw
        return (a, b, raw) if fine else None

    def learn(self, chunks: list[str]):
        """Take in chunks not met before. Each starts with a space."""
        sizes = np.cumsum([len(c) for c in chunks])
        batches = np.split(np.arange(len(chunks)), np.flatnonzero(np.diff(sizes // JOINED_BYTES)) + 1)
        for batch in batches:
            mine = [chunks[i] for i in batch]
            # white space at either end of a chunk (a text's first or last one) would join a neighbour's
            plain = [c for c in mine if c != " " and not c[1].isspace() and not c[-1].isspace()]
            rest = [[c] for c in mine if c == " " or c[1].isspace() or c[-1].isspace()]
            for some in [plain, *rest]:
                both = self.both_ids(some) if some else None
                if both:
                    self.add(some, *both)
                elif len(some) > 1:
                    for c in some:
                        both = self.both_ids([c])
                        self.add([c], *both) if both else self.add_unspelled(c)
                elif some:
                    self.add_unspelled(some[0])

    def add_unspelled(self, chunk: str):
        self.known[chunk] = len(self.said)
        self.said.append("")
        self.facts = np.r_[self.facts, np.zeros((1, 5), np.int64)]
        self.first, self.many = np.r_[self.first, len(self.pairs)], np.r_[self.many, 0]

    def add(self, chunks: list[str], a: np.ndarray, b: np.ndarray, raw: bytes):
        ends = np.cumsum([len(c.encode()) for c in chunks])
        a_ends, b_ends = self.a.ends(a), self.b.ends(b)
        _, _, group_a, group_b = merge_pieces(a_ends, b_ends)
        groups = int(group_a[-1]) + 1
        n_a, n_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
        first_a, first_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
        # the last group of each chunk ends with it
        last = group_a[np.searchsorted(a_ends, ends)] + 1
        start = np.r_[0, last[:-1]]
        of_group = np.repeat(np.arange(len(chunks)), last - start)
        add = lambda x: np.add.reduceat(x, start)
        facts = np.stack([np.ones(len(chunks), np.int64), add(n_a), add(n_b), last - start, add(n_a * n_b)], axis=1)

        each = self.names_each
        token_a = a + np.where(np.r_[group_a[1:] != group_a[:-1], True], each, 0)
        token_b = b + np.where(np.r_[group_b[1:] != group_b[:-1], True], 2 * each, 0)
        words = np.empty(len(a) + len(b), np.int64)
        words[np.arange(len(a)) + np.repeat(first_b, n_a)] = token_a
        words[np.arange(len(b)) + np.repeat(first_a + n_a, n_b)] = token_b
        words = self.names[words].tolist()
        stops = np.cumsum(facts[:, 1] + facts[:, 2]).tolist()
        said = ["".join(words[x:y])[:-1] for x, y in zip([0, *stops], stops, strict=False)]

        pairs, links, many = self.link(a, b, n_a, n_b, first_a, first_b, of_group, len(chunks))
        self.known.update(zip(chunks, range(len(self.said), len(self.said) + len(chunks)), strict=True))
        self.said += said
        self.facts = np.r_[self.facts, facts]
        self.first, self.many = np.r_[self.first, len(self.pairs) + np.cumsum(many) - many], np.r_[self.many, many]
        self.pairs, self.links = np.r_[self.pairs, pairs], np.r_[self.links, links]

    def link(self, a, b, n_a, n_b, first_a, first_b, of_group, chunks):
        """Distinct id pairs of each chunk, and how many links have them; laid out in bounded runs of groups."""
        out = []
        work = np.cumsum(n_a * n_b)
        for run in np.split(np.arange(len(n_a)), np.flatnonzero(np.diff(work // PAIRS_AT_ONCE)) + 1):
            if len(run) == 1 and n_a[run[0]] * n_b[run[0]] > PAIRS_AT_ONCE:
                # one huge group: each id of either side once, with how often it stands there
                g = run[0]
                x, cx = np.unique(a[first_a[g]:first_a[g] + n_a[g]], return_counts=True)
                y, cy = np.unique(b[first_b[g]:first_b[g] + n_b[g]], return_counts=True)
                out.append((np.full(len(x) * len(y), of_group[g]), (x[:, None] * self.width + y).ravel(), (cx[:, None] * cy).ravel()))
                continue
            i = ragged(first_a[run], n_a[run])
            wide = np.repeat(n_b[run], n_a[run])
            code = np.repeat(a[i], wide) * self.width + b[ragged(np.repeat(first_b[run], n_a[run]), wide)]
            out.append(summed(np.repeat(of_group[run], n_a[run] * n_b[run]), code, np.ones(len(code), np.int64)))
        owner, code, links = (np.concatenate(x) for x in zip(*out, strict=True))
        if len(out) > 1:
            owner, code, links = summed(owner, code, links)
        return code, links, np.bincount(owner, minlength=chunks)

    def texts(self, texts: list[str | None]):
        """For each text its facts, groups as text, and distinct pairs with their links (values, and how many each)."""
        chunked = []
        for t in texts:
            parts = CUT.split(" " + t) if t else []
            chunked.append([p if k == 0 else " " + p for k, p in enumerate(parts)])
        if len(self.known) > CACHED_CHUNKS:
            self.forget()
        fresh = list(dict.fromkeys(c for cs in chunked for c in cs if c not in self.known))
        if fresh:
            self.learn(fresh)
        counts = np.array([len(cs) for cs in chunked])
        keys = np.fromiter((self.known[c] for cs in chunked for c in cs), np.int64, counts.sum())
        row = np.repeat(np.arange(len(texts)), counts)
        facts = np.zeros((len(texts), 5), np.int64)
        np.add.at(facts, row, self.facts[keys])
        spelled = (facts[:, 0] == counts) & (counts > 0)
        facts[~spelled] = 0
        said, at = [], 0
        for n, ok in zip(counts.tolist(), spelled, strict=True):
            said.append(";".join(map(self.said.__getitem__, keys[at:at + n].tolist())) if ok else "")
            at += n
        keep = spelled[row]
        row, keys, times = summed(row[keep], keys[keep], np.ones(keep.sum(), np.int64))
        take = ragged(self.first[keys], self.many[keys])
        row, pairs, links = summed(np.repeat(row, self.many[keys]), self.pairs[take], self.links[take] * np.repeat(times, self.many[keys]))
        return facts[:, 1:], said, pairs, links, np.bincount(row, minlength=len(texts))


def summed(owner: np.ndarray, code: np.ndarray, amount: np.ndarray):
    """Distinct (owner, code) in order, with the sum of their amounts."""
    order = np.lexsort((code, owner))
    owner, code, amount = owner[order], code[order], amount[order]
    if not len(owner):
        return owner, code, amount
    head = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (code[1:] != code[:-1])])
    return owner[head], code[head], np.add.reduceat(amount, head)


NEW = {"n_a": "long", "n_b": "long", "n_groups": "long", "n_links": "long", "groups": "string",
       "link_pairs": ArrayType(LongType()), "link_sizes": ArrayType(LongType()), "row_key": "long"}


def align_documents(documents: DataFrame, vocabularies: Vocabularies, text_col: str = "text") -> DataFrame:
    """All columns, and for each text both tokenizers' tokens cut into groups where both end.

    ``groups`` lists them as ``a1,a2|b1;a3|b2,b3`` (ids in order). ``link_pairs`` are the distinct pairs of ids that
    share a group, as a * (size of vocabulary b) + b, and ``link_sizes`` how many links have them; ``row_key`` tells
    rows apart, also repeated ones. A text that is null, empty or not spelled by either tokenizer as a space and
    itself has no tokens: zeros, '' and empty lists. A column that has the name of a new one is replaced. Nothing is
    shuffled, and a lost task is simply read again.
    """
    shared = documents.sparkSession.sparkContext.broadcast(vocabularies)
    kept = [c for c in documents.columns if c not in NEW]
    at = kept.index(text_col)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        aligner = Aligner(shared.value)
        key = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in portions(batch, at, 1 << 20):
                facts, said, pairs, links, many = aligner.texts(part.column(at).to_pylist())
                ends = pa.array(np.r_[0, np.cumsum(many)], pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int64())) for x in (pairs, links)]
                cols = [pa.array(facts[:, k]) for k in range(4)] + [pa.array(said, pa.string()), *lists, pa.array(key + np.arange(part.num_rows))]
                key += part.num_rows
                yield pa.RecordBatch.from_arrays([*part.columns, *cols], names=[*kept, *NEW])

    columns = documents.select(*[F.col(f"`{c}`") for c in kept])
    schema = StructType(list(columns.schema.fields))
    for name, kind in NEW.items():
        schema = schema.add(name, kind)
    return columns.mapInArrow(run, schema)


def pair_counts(aligned: DataFrame, width: int) -> DataFrame:
    """(pair, documents, best): how many rows hold each pair linked, and whether no pair of its a id has more."""
    counts = aligned.select(F.explode("link_pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("documents"))
    counts = stored(counts.withColumn("a", F.expr(f"pair div {width}")))
    most = counts.groupBy("a").agg(F.max("documents").alias("most"))
    return stored(counts.join(most, "a").select("pair", "documents", (F.col("documents") == F.col("most")).alias("best")))


def weigh_links(aligned: DataFrame, width: int, frequent: int = FREQUENT) -> DataFrame:
    """Columns n_best (links whose pair is its a id's most widespread, ties included) and count_sum (documents of
    the pair, summed over links) added to a stored table of aligned documents.

    The most widespread pairs, ``frequent`` at most, are broadcast; pairs in few documents meet their counts by a
    shuffle, where none of them is a hot key. Sums of documents beyond a long are an error.
    """
    counts = pair_counts(aligned, width)
    # pairs by the binary order of their counts: 64 rows at most
    orders = {r[0]: r[1] for r in counts.groupBy(F.length(F.bin("documents")).alias("bits")).count().collect()}
    bits, head = 64, 0
    while bits > 0 and head + orders.get(bits, 0) <= frequent:
        head += orders.get(bits, 0)
        bits -= 1
    floor = 1 << bits if bits else 1
    links = aligned.select("row_key", F.explode(F.arrays_zip("link_pairs", "link_sizes")).alias("x")).select("row_key", F.col("x.link_pairs").alias("pair"), F.col("x.link_sizes").alias("links"))
    top = F.broadcast(counts.filter(F.col("documents") >= floor))
    met = links.join(top, "pair")
    sums = [F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("n_best"), F.sum(F.col("links") * F.col("documents")).alias("count_sum")]
    totals = met.groupBy("row_key").agg(*sums)
    if bits:
        rare = counts.filter(F.col("documents") < floor)
        totals = totals.unionByName(links.join(top.select("pair"), "pair", "left_anti").join(rare, "pair").groupBy("row_key").agg(*sums))
        totals = totals.groupBy("row_key").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    left = aligned.drop("n_best", "count_sum").join(totals, "row_key", "left")
    return left.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n_best", "count_sum")})


def digest(documents: DataFrame, vocabularies: Vocabularies, frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of documents."""
    aligned = align_documents(documents.select("doc_id", "text"), vocabularies)
    sha = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    numbers = ["n_a", "n_b", "n_groups", "n_links"]
    aligned = stored(aligned.select("doc_id", *numbers, sha, "link_pairs", "link_sizes", "row_key"))
    weighed = weigh_links(aligned, len(vocabularies.b_bytes), frequent)
    return weighed.select("doc_id", *numbers, "n_best", "count_sum", "groups_sha256")


@query("op13_alignment")
def op13_alignment(spark, sf_dir):
    """Both tokenizers over every whole text, with digests of their groups and links."""
    return digest(dealt(table(spark, sf_dir, "documents").select("doc_id", "text")), Vocabularies.load())
