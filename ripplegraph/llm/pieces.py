"""Sampled sentence-piece segmentations by forward filtering and backward sampling.

A word (with the space before it) spans a lattice of the model's pieces. The forward pass
sums the weights of all paths to each place; the backward pass draws, from the end of the
word, the last piece in proportion to the weight of the paths through it, then the one
before, and so on. Draws are hashes of the row's key, the word's number and the step, so
that a row has the same segmentation in any partition. Pieces don't reach over a space.

Weights: a unigram model's scores are log probabilities and are taken as they are. A BPE
model's scores are whole numbers, the order of merges, and no probabilities; there a piece
of rank r (0 for the first merge) has the probability 1 / (r + 2), divided by the sum of
these over the vocabulary: Zipf's law, as merges come in the order of frequency. A
segmentation's weight is the product of its pieces' probabilities to the power ALPHA.

A character that no piece has becomes byte pieces, each as unlikely as the rarest piece; so
does a literal U+2581, which would otherwise come back as a space. So decoding gives the
text as it was.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release, slices, table
from .near_dedup import mix

SPACE, STAND_IN = "\u2581", "\ue000"  # the stand-in is no piece
ALPHA = 0.3
SEED = 20
#: A task forgets its lattices once they have so many edges (about 13 bytes each); bytes of texts that are sampled together.
EDGES, CHUNK = 3_000_000, 1_000_000
#: Words up to this long are added many at once; their weights don't underflow.
SHORT = 60
_HIGH = np.uint64(48)
_BASE = np.array([0x5851F42D4C957F2D], np.uint64)
_WORD, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _codes(forms: list[str], n: int) -> np.ndarray:
    return np.frombuffer("".join(forms).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(forms), n)


def _prefixes(codes: np.ndarray) -> np.ndarray:
    """Polynomial hashes of the first 0, 1, ... symbols of each word; a row per number of symbols."""
    out = np.zeros((codes.shape[1] + 1, codes.shape[0]), np.uint64)
    for i in range(codes.shape[1]):
        out[i + 1] = out[i] * _BASE[0] + mix(codes[:, i].astype(np.uint64) + np.uint64(1))
    return out


class _Numbers(dict):
    """Numbers of words in the order in which they are first asked for; new ones wait in fresh."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.fresh.append(word)
        return n


class Sampler:
    """Lattices of words met so far, as flat arrays.

    A node is a place in a word. The edges that end at it follow each other from
    first[node]; share holds their cumulative shares of the node's weight (1 for the last),
    back how many places each reaches back, edge its piece's id or, if negative, bytes of the
    string numbered -1 - edge.
    """

    def __init__(self, path: str, alpha: float = ALPHA):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.weight: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.bytes: list[bytes] = [b""] * size
        self.byte_ids: dict[int, int] = {}
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes[i] = bytes([int(piece[3:5], 16)])
            elif not model.is_control(i) and not model.is_unknown(i) and not model.is_unused(i):
                self.id[piece] = i
                self.bytes[i] = piece.replace(SPACE, " ").encode()
        scores = np.array([model.get_score(i) for i in self.id.values()])
        if (scores == np.floor(scores)).all():
            chances = 1 / ((2 - scores) * (1 / np.arange(2, size + 2)).sum())
        else:
            chances = np.exp(scores)
        self.weight = dict(zip(self.id, (chances**alpha).tolist()))
        self.byte_weight = min(self.weight.values())
        self.longest = max(map(len, self.weight))
        self.by_length, self.sieves = [], []  # a sieve: which upper halves of hashes pieces of that length have
        for n in range(1, self.longest + 1):
            own = [p for p in self.weight if len(p) == n]
            sums = _prefixes(_codes(own, n))[n] if own else np.zeros(0, np.uint64)
            order = np.argsort(sums)
            sieve = np.zeros(1 << 16, bool)
            sieve[(sums >> _HIGH).astype(np.int64)] = True
            self.sieves.append(sieve)
            self.by_length.append((sums[order], np.array([self.weight[own[i]] for i in order]), np.array([self.id[own[i]] for i in order], np.int32)))
        self.reset()

    def reset(self) -> None:
        self.words = _Numbers()
        self.nodes = self.edges = self.ended = 0
        self.first, self.share, self.back, self.edge = np.zeros(0, np.int32), np.zeros(0), np.zeros(0, np.uint8), np.zeros(0, np.int32)
        self.end, self.length = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.strings, self.spelled = [], {}

    def _room(self, words: int, nodes: int, edges: int) -> None:
        """Make the arrays long enough for so many more, and longer by a half at least if they grow."""
        for names, used, more in ((("end", "length"), self.ended, words), (("first",), self.nodes, nodes), (("share", "back", "edge"), self.edges, edges)):
            for name in names:
                old = getattr(self, name)
                if used + more > len(old):
                    new = np.zeros(max(used + more, len(old) * 3 // 2), old.dtype)
                    new[:used] = old[:used]
                    setattr(self, name, new)

    def _spell(self, symbol: str) -> tuple[float, int]:
        """Weight and edge of a character as bytes."""
        raw = symbol.encode("utf-8", "surrogatepass")
        if symbol not in self.spelled:
            self.strings.append([self.byte_ids[b] for b in raw])
            self.spelled[symbol] = -len(self.strings)
        return self.byte_weight ** len(raw), self.spelled[symbol]

    def _add_long(self, number: int, word: str) -> None:
        """Forward pass over one word, place by place, scaled up before it underflows."""
        text = " " + word
        form = SPACE + word.replace(SPACE, STAND_IN)
        n, reach = len(form), self.longest
        sums = [1.0] + [0.0] * n
        weight, ids = self.weight, self.id
        first, shares, backs, edges = [0], [], [], []
        for end in range(1, n + 1):
            found = []
            total = 0.0
            for start in range(end - reach if end > reach else 0, end):
                piece = form[start:end]
                w = weight.get(piece)
                if w is not None:
                    total += sums[start] * w
                    found.append((total, end - start, ids[piece]))
            if form[end - 1] not in weight:
                w, edge = self._spell(text[end - 1])
                total += sums[end - 1] * w
                found.append((total, 1, edge))
            first.append(len(shares))
            for share, back, edge in found:
                shares.append(share / total)
                backs.append(back)
                edges.append(edge)
            shares[-1] = 1.0
            sums[end] = total
            if total < 1e-200:  # only the ratios near here matter
                low = max(0, end - reach)
                sums[low : end + 1] = [s * 1e200 for s in sums[low : end + 1]]
        self._room(0, n + 1, len(shares))
        self.end[number], self.length[number] = self.nodes + n, n
        self.first[self.nodes : self.nodes + n + 1] = self.edges + np.array(first)
        at = slice(self.edges, self.edges + len(shares))
        self.share[at], self.back[at], self.edge[at] = shares, backs, edges
        self.nodes += n + 1
        self.edges += len(shares)

    def add_fresh(self) -> None:
        """Forward pass over the words asked for since the last time: the short ones at once, the others one by one."""
        fresh, self.words.fresh = self.words.fresh, []
        if not fresh:
            return
        self._room(len(fresh), 0, 0)
        base, self.ended = self.ended, self.ended + len(fresh)
        short, numbers = [], []
        for number, w in enumerate(fresh, base):
            if len(w) < SHORT and SPACE not in w and (w.isascii() or len(w.encode("utf-8", "surrogatepass")) < 2 * SHORT):
                short.append(w)
                numbers.append(number)
            else:
                self._add_long(number, w)
        order = sorted(range(len(short)), key=lambda i: -len(short[i]))
        for at in range(0, len(order), 20_000):
            part = order[at : at + 20_000]
            self._add_short(np.array([numbers[i] for i in part]), [short[i] for i in part])

    def _add_short(self, numbers: np.ndarray, words: list[str]) -> None:
        """words, the longest first: those that have a place are the first ones, so each step is over a prefix of them."""
        m, n = len(words), len(words[0]) + 1
        lengths = np.fromiter(map(len, words), np.int64, m) + 1
        codes = _codes([SPACE + w.ljust(n - 1, "\0") for w in words], n)
        prefix = _prefixes(codes)
        powers = np.ones(self.longest + 1, np.uint64)
        powers[1:] = np.cumprod(np.full(self.longest, _BASE[0]))
        sums = np.zeros((n + 1, m))
        sums[0] = 1
        degree = np.zeros((n + 1, m), np.int32)  # of the nodes, place by place
        found = []  # end, rows (None: all that have the place), rank among the node's edges, sum up to the edge, back, edge
        for end in range(1, n + 1):
            many = int(np.searchsorted(-lengths, -end, "right"))
            total, count = sums[end, :many], degree[end, :many]
            for start in range(max(0, end - self.longest), end - 1):  # few are pieces
                known, weights, ids = self.by_length[end - start - 1]
                if not len(known):
                    continue
                own = prefix[end, :many] - prefix[start, :many] * powers[end - start]
                rows = np.flatnonzero(self.sieves[end - start - 1][(own >> _HIGH).astype(np.int64)])
                at = np.minimum(np.searchsorted(known, own[rows]), len(known) - 1)
                good = known[at] == own[rows]
                rows, at = rows[good], at[good]
                if len(rows):
                    total[rows] += sums[start, rows] * weights[at]
                    found.append((end, rows, count[rows], total[rows], end - start, ids[at]))
                    count[rows] += 1
            known, weights, ids = self.by_length[0]
            own = prefix[end, :many] - prefix[end - 1, :many] * powers[1]
            at = np.minimum(np.searchsorted(known, own), len(known) - 1)
            hit = known[at] == own
            weight, edge = weights[at], ids[at]
            if not hit.all():
                symbols = codes[:many, end - 1]
                for code in np.unique(symbols[~hit]).tolist():
                    here = ~hit & (symbols == code)
                    weight[here], edge[here] = self._spell(chr(code))
            total += sums[end - 1, :many] * weight
            found.append((end, None, count.copy(), total.copy(), 1, edge))
            count += 1
        per_word = degree.sum(0, dtype=np.int64)
        self._room(0, int(lengths.sum()) + m, int(per_word.sum()))
        bases = self.nodes + np.cumsum(lengths + 1) - lengths - 1
        begins = self.edges + np.cumsum(per_word) - per_word
        self.end[numbers], self.length[numbers] = bases + lengths, lengths
        before = begins + np.cumsum(degree, 0) - degree  # the first edge of each node
        for end in range(n + 1):
            many = int(np.searchsorted(-lengths, -end, "right"))
            self.first[bases[:many] + end] = before[end, :many]
        for end, rows, rank, total, back, edge in found:
            rows = slice(0, len(rank)) if rows is None else rows
            to = before[end, rows] + rank
            self.share[to] = np.where(rank + 1 == degree[end, rows], 1.0, total / sums[end, rows])
            self.back[to], self.edge[to] = back, edge
        self.nodes += int(lengths.sum()) + m
        self.edges += int(per_word.sum())

    def sample(self, keys: list[int], texts: list[str]) -> list[np.ndarray]:
        """Piece ids of each text; an empty one has none."""
        if self.edges > EDGES:
            self.reset()
        split = [t.split(" ") if t else [] for t in texts]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        of = np.fromiter(map(self.words.__getitem__, chain.from_iterable(split)), np.int64, counts.sum())
        del split
        self.add_fresh()
        seed = mix(np.array([k & (1 << 64) - 1 for k in keys], np.uint64) ^ mix(np.full(len(keys), SEED, np.uint64)))
        number = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
        seed = np.repeat(seed, counts) + number.astype(np.uint64) * _WORD
        which = np.argsort(of, kind="stable")  # by word, so that what is looked up together lies together
        of, seed = of[which], seed[which]
        node = self.end[of].astype(np.int64)
        begin = node - self.length[of]
        steps, taken = np.zeros(len(of), np.int64), []
        while len(node):
            draw = (mix(seed) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            at = self.first[node]
            above = np.flatnonzero(self.share[at] <= draw)
            while len(above):
                at[above] += 1
                above = above[self.share[at[above]] <= draw[above]]
            taken.append((which, self.edge[at]))
            node -= self.back[at]
            alive = node > begin
            if not alive.all():
                steps[which[~alive]] = len(taken)
                which, node, begin, seed = which[alive], node[alive], begin[alive], seed[alive]
            seed = seed + _STEP
        ends = np.cumsum(steps)
        path = np.zeros(ends[-1] if len(ends) else 0, np.int32)
        for back, (which, edge) in enumerate(taken):
            path[ends[which] - 1 - back] = edge
        cuts = np.append(0, ends)[np.cumsum(counts)]
        if len(path) and path.min() < 0:
            path, cuts = self._with_bytes(path, cuts)
        return np.split(path, cuts[:-1]) if len(cuts) else []

    def _with_bytes(self, path: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Put the byte pieces in the place of the strings."""
        sizes = np.array([len(s) for s in self.strings])
        width = np.where(path < 0, sizes[np.maximum(-1 - path, 0)], 1)
        ends = np.cumsum(width)
        out = np.repeat(path, width)
        strings = np.flatnonzero(path < 0)
        at = np.repeat(ends[strings] - width[strings] - np.cumsum(width[strings]) + width[strings], width[strings]) + np.arange(width[strings].sum())
        out[at] = list(chain.from_iterable(self.strings[-1 - e] for e in path[strings].tolist()))
        return out, np.append(0, ends)[cuts]

    def decode(self, ids) -> str:
        raw = b"".join(map(self.bytes.__getitem__, ids))
        return raw.decode("utf-8", "surrogatepass")[1:]


@lru_cache(1)
def sampler_of(path: str) -> Sampler:
    return Sampler(path)


def encode(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (of the ids as little-endian 32-bit numbers), lossless
    (decoding gave the text back) and, if asked for, ids of every row.

    A null text is empty and has no pieces. A very long text is sampled whole, as a slice
    of its own. A null id counts as 0 in the draws and stays null. Rows that repeat an id and
    a text have the same pieces. Other columns, whatever their names, are not read.
    """
    names = ["doc_id", "n_pieces", "ids_crc32", "lossless", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = sampler_of(path)
        for batch in batches:
            for part in slices(batch, 1, CHUNK):
                texts = [t or "" for t in part.column(1).to_pylist()]
                found = sampler.sample([k or 0 for k in part.column(0).to_pylist()], texts)
                columns = [
                    part.column(0),
                    pa.array([len(x) for x in found], pa.int64()),
                    pa.array([zlib.crc32(x.astype("<i4").tobytes()) for x in found], pa.int64()),
                    pa.array([sampler.decode(x.tolist()) == t for x, t in zip(found, texts)], pa.bool_()),
                ]
                if with_ids:
                    ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found))))
                yield pa.RecordBatch.from_arrays(columns, names=names)
        sampler.reset()  # the worker lives on and serves other stages
        release()

    schema = "doc_id long, n_pieces long, ids_crc32 long, lossless boolean" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), with_ids=False)
