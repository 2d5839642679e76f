"""Token ids in files: frequency-ranked, byte-aligned variable-length codes.

A document's ids become ranks by corpus frequency, so that common tokens have small
numbers. Each number takes 1 to 4 bytes; its length is kept in two bits of a separate
control stream, four numbers to a control byte. A reader looks every control byte up
in a table of lengths and decodes whole blocks with numpy.

The files are Parquet tables of blocks (documents in ascending id order, control bytes,
data bytes), so that every file system that Spark can write to will do, writes are atomic
and a task that runs again after a lost executor leaves no second copy.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table, tasks

END_ID = 2
#: Numbers in a block at most, unless one document is longer.
BLOCK_NUMBERS = 1 << 16
#: Words whose ids a Python worker remembers.
CACHE_WORDS = 1_200_000
_WHITE = r"[\s\x0b\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_RUN = f" {_WHITE}|{_WHITE} "
#: For each control byte the lengths of its four numbers.
LENGTHS = np.array([[((c >> 2 * i) & 3) + 1 for i in range(4)] for c in range(256)], np.uint8)


class Encoder:
    """Whole texts to ids with the tokenizers library.

    A byte-level BPE splits text before it merges, and always just before a single space
    between two other characters. So a text without longer runs of white space is the sum
    of its parts cut there, and parts that came before need not be merged again. Any
    other text, or one with a special token in it, goes to the library as it is.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.kind = np.uint16 if self.library.get_vocab_size() <= 1 << 16 else np.uint32
        self.widths = np.zeros(self.library.get_vocab_size(), np.int64)
        for token, i in self.library.get_vocab().items():
            self.widths[i] = len(token)  # a byte-level token has a character for each byte
        self.forget()

    def forget(self) -> None:
        """Words met so far: a number each, by which begins and sizes hold where its ids are in store."""
        self.number: dict[str, int] = {}
        self.store, self.begins, self.sizes = np.zeros(0, self.kind), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def merged(self, words: list[str], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, each with a space before it, and how many each has. Joined to one text, as one
        long text costs less than many, and cut again where the tokens' bytes end with a word's."""
        ids = np.array(self.whole([" " + " ".join(words)])[0], self.kind)
        ends = np.cumsum(lengths + 1)
        reach = np.cumsum(self.widths[ids])
        cuts = np.searchsorted(reach, ends, "right")
        if not len(ids) or (reach[cuts - 1] != ends).any():
            lists = self.whole([" " + w for w in words])
            return np.array([i for x in lists for i in x], self.kind), np.fromiter(map(len, lists), np.int64, len(lists))
        return ids, np.diff(cuts, prepend=0)

    def spaced(self, words: pa.Array) -> np.ndarray:
        """Numbers of distinct words with a space before them; new ones are encoded and remembered."""
        if len(self.number) > CACHE_WORDS:
            self.forget()
        texts = words.to_numpy(zero_copy_only=False).tolist()  # quicker than to_pylist
        out = np.fromiter(map(self.number.get, texts, repeat(-1)), np.int64, len(texts))
        new = np.flatnonzero(out < 0)
        if not len(new):
            return out
        lengths = pc.binary_length(words.cast(pa.binary())).to_numpy(zero_copy_only=False)[new].astype(np.int64)
        order = np.argsort(lengths == 0, kind="stable")  # an empty word would run into its neighbours: it comes last, alone
        new, lengths = new[order], lengths[order]
        full = int((lengths > 0).sum())
        stores, sizes = [self.store], [self.sizes]
        for at in [*range(0, full, 2048), *range(full, len(new))]:
            to = min(at + 2048, full) if at < full else at + 1
            ids, counts = self.merged([texts[i] for i in new[at:to]], lengths[at:to])
            stores.append(ids), sizes.append(counts)
        out[new] = len(self.number) + np.arange(len(new))
        self.number.update(zip([texts[i] for i in new], out[new].tolist()))
        self.store, self.sizes = np.concatenate(stores), np.concatenate(sizes)
        self.begins = np.cumsum(self.sizes) - self.sizes
        return out

    def encode_column(self, texts: pa.Array, end: list[int]) -> pa.Array:
        """Ids of every text, and the end ids, as a binary column of little-endian numbers.

        A text is its first word, its other words with the spaces before them, and the end ids.
        """
        n = len(texts)
        if not n:
            return pa.array([], pa.binary())
        texts = texts.fill_null("")
        whole = pc.match_substring_regex(texts, _RUN)
        for special in self.specials:
            whole = pc.or_(whole, pc.match_substring(texts, special))
        lists = pc.split_pattern(pc.if_else(whole, "", texts), " ")
        coded = lists.flatten().dictionary_encode()
        cuts = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        codes = coded.indices.to_numpy()
        number = self.spaced(coded.dictionary)
        heads = self.whole(pc.if_else(whole, texts, coded.dictionary.take(coded.indices.take(pa.array(cuts[:-1])))).to_pylist())
        own = np.fromiter(map(len, heads), np.int64, n)
        store = np.concatenate([self.store, np.fromiter(chain.from_iterable(heads), self.kind, own.sum()), np.array(end, self.kind)])
        begins = np.concatenate([self.begins, len(self.store) + np.cumsum(own) - own, [len(store) - len(end)]])
        sizes = np.concatenate([self.sizes, own, [len(end)]])
        row = np.arange(n)
        parts = np.empty(len(codes) + n, np.int64)
        parts[np.arange(len(codes)) + np.repeat(row, np.diff(cuts))] = number[codes]
        parts[cuts[:-1] + row] = len(self.sizes) + row
        parts[cuts[1:] + row] = len(sizes) - 1
        counts = sizes[parts]
        ends = np.cumsum(counts)
        ids = store[np.repeat(begins[parts] - ends + counts, counts) + np.arange(ends[-1])]
        offsets = np.append(0, ends[cuts[1:] + row]) * store.itemsize
        return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(ids.tobytes())])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        return self.encode_column(pa.array(texts, pa.string()), []).to_pylist()


@lru_cache(1)
def encoder_of(path: str) -> Encoder:
    """One per Python worker, so that it remembers words from task to task."""
    return Encoder(path)


def ranking(counts: np.ndarray) -> np.ndarray:
    """Ids in order of falling frequency, the smaller id first on ties."""
    return np.argsort(-counts, kind="stable")


def pack(numbers: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of numbers below 2 ** 32."""
    numbers = np.asarray(numbers, np.uint32)
    extra = (numbers > 0xFF).astype(np.uint8) + (numbers > 0xFFFF) + (numbers > 0xFFFFFF)
    fours = np.zeros(-(-len(numbers) // 4) * 4, np.uint8)
    fours[: len(numbers)] = extra
    fours = fours.reshape(-1, 4)
    control = fours[:, 0] | fours[:, 1] << 2 | fours[:, 2] << 4 | fours[:, 3] << 6
    spread = numbers.astype("<u4").view(np.uint8).reshape(-1, 4)
    return control.tobytes(), spread[np.arange(4) <= extra[:, None]].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n numbers; lengths come from a look-up of each control byte."""
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    spread = np.zeros((n, 4), np.uint8)
    spread[np.arange(4) < lengths[:, None]] = np.frombuffer(data, np.uint8)
    return spread.reshape(-1).view("<u4")


def tokenized(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (binary, little-endian) of every row, the end id included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            encoder = encoder_of(path)
            for at in range(0, len(batch), 2048):
                part = batch.slice(at, 2048)
                yield pa.RecordBatch.from_arrays([part.column(0), encoder.encode_column(part.column(1), [END_ID])], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids binary")


def frequencies(tokens: DataFrame, kind: type, size: int) -> np.ndarray:
    """How often each id occurs in all rows; one row per id and task is shuffled."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size, np.int64)
        for f in frames:
            total += np.bincount(np.frombuffer(b"".join(f["ids"]), kind), minlength=size)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"id": at, "n": total[at]})

    out = np.zeros(size, np.int64)
    for r in tokens.select("ids").mapInPandas(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r["id"]] = r["n"]  # one row per token of the vocabulary at most
    return out


BLOCK = "part int, block int, part_start long, doc_ids binary, nulls binary, sizes binary, n long, control binary, data binary"


def write(tokens: DataFrame, order: np.ndarray, kind: type) -> DataFrame:
    """Write the block files, documents in ascending order of doc_id (null ids first,
    equal ids by their ids' bytes), and return them as read back."""
    rank_of = np.empty(len(order), np.uint32)
    rank_of[order] = np.arange(len(order), dtype=np.uint32)
    spark = tokens.sparkSession
    held = spark.sparkContext.broadcast(rank_of)  # bounded by the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, start = TaskContext.get().partitionId(), 0, 0
        waiting: list[tuple[int | None, np.ndarray]] = []

        def flush():
            ids = [i for i, _ in waiting]
            sizes = np.array([len(x) for _, x in waiting], "<i8")
            control, data = pack(held.value[np.concatenate([x for _, x in waiting])])
            columns = [part, block, start, np.array([i or 0 for i in ids], "<i8").tobytes(), np.array([i is None for i in ids], np.uint8).tobytes(), sizes.tobytes(), int(sizes.sum()), control, data]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.binary()]
            return int(sizes.sum()), pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(columns, types)], names=[x.split()[0] for x in BLOCK.split(", ")])

        held_numbers = 0
        for batch in batches:
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.frombuffer(x.as_buffer(), kind)
                waiting.append((i, ids))
                held_numbers += len(ids)
                if held_numbers >= BLOCK_NUMBERS:
                    n, out = flush()
                    yield out
                    block, start, held_numbers, waiting = block + 1, start + n, 0, []
        if waiting:
            yield flush()[1]

    ranged = tokens.repartitionByRange(tasks(spark), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "ids")
    return stored(ranged.mapInArrow(run, BLOCK), "token-files")


def read(files: DataFrame, order: np.ndarray) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files.

    start counts the ids of all documents before it. Only one sum per file is gathered.
    """
    spark = files.sparkSession
    sums = sorted((r["part"], r["n"]) for r in files.groupBy("part").agg(F.sum("n").alias("n")).collect())
    before, total = {}, 0
    for part, n in sums:
        before[part], total = total, total + n
    held = spark.sparkContext.broadcast((order.astype("<u4"), before))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        order_, before_ = held.value
        for f in frames:
            for r in f.itertuples():
                ids = order_[unpack(r.control, r.data, r.n)]
                sizes = np.frombuffer(r.sizes, "<i8")
                ends = np.cumsum(sizes)
                sums_ = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(ends - sizes, ends)]
                doc_ids = pd.array(np.frombuffer(r.doc_ids, "<i8"), dtype="Int64")
                doc_ids[np.frombuffer(r.nulls, np.uint8).astype(bool)] = pd.NA
                yield pd.DataFrame({"doc_id": doc_ids, "start": before_[r.part] + r.part_start + ends - sizes, "n_tokens": sizes, "ids_crc32": sums_})

    return files.mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def write_and_read(docs: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """The block files of all documents and the digest read from them.

    A null text is empty and has the end id alone; repeated rows are documents of their
    own; an empty table gives no blocks and no rows.
    """
    encoder = encoder_of(path)
    size = max(encoder.library.get_vocab_size(), END_ID + 1)
    tokens = stored(tokenized(docs, path), "tokens")
    order = ranking(frequencies(tokens, encoder.kind, size))
    files = write(tokens, order, encoder.kind)
    return files, read(files, order)


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return write_and_read(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))[1]
