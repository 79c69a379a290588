"""Token ids in binary files of patched frame-of-reference blocks.

Documents are dealt into ranges of ascending ids and encoded; each document's ids end with the id 0. A range is
written as segments, which hold whole documents, as rows of a Parquet table in the shared folder: Spark's writers
commit them whole, so a lost executor leaves no half file. A segment's ``payload`` is a run of blocks of 128 ids:

    uint32 minimum, uint8 width, uint8 number of exceptions, then 16 * width bytes of the differences from
    the minimum, lowest bit first, then for each exception uint8 place and uint32 difference

all little-endian. The width is that of the 90th percentile of a block's differences; larger ones are exceptions,
packed as 0. The last block is filled up with its minimum. ``block_starts`` holds the uint32 place of each block
in the payload, so that a reader gets at any token without unpacking those before it. ``doc_ids`` and
``doc_tokens`` list a segment's documents.

Defined results: a null or empty text has the end id alone; a null id comes first; of rows with equal ids the
order is that of a hash of the text; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, shuffle_width, table, text_or_empty
from .textops import slices

BLOCK, PERCENTILE, END = 128, 90, 0
SEGMENT_SCHEMA = "range int, segment int, first_token long, n_tokens long, doc_ids binary, doc_tokens binary, block_starts binary, payload binary"
_HEADER = 6


def encode_blocks(ids: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The payload and the start of each block."""
    n = -(-len(ids) // BLOCK)
    if not n:
        return b"", np.zeros(0, np.uint32)
    grid = np.empty(n * BLOCK, np.uint32)
    grid[: len(ids)] = ids
    grid[len(ids) :] = ids[(n - 1) * BLOCK :].min()
    grid = grid.reshape(n, BLOCK)
    low = grid.min(axis=1)
    diff = grid - low[:, None]
    bound = np.partition(diff, BLOCK * PERCENTILE // 100, axis=1)[:, BLOCK * PERCENTILE // 100]
    width = np.zeros(n, np.int64)
    for bits in range(32):
        width += bound >= (1 << bits)
    over = diff >= (np.uint64(1) << width.astype(np.uint64))[:, None]
    exceptions = over.sum(axis=1)
    length = _HEADER + BLOCK // 8 * width + 5 * exceptions
    start = np.concatenate(([0], np.cumsum(length)))
    out = np.zeros(start[-1], np.uint8)
    at = start[:-1]
    out[at[:, None] + np.arange(4)] = low.astype("<u4").view(np.uint8).reshape(-1, 4)
    out[at + 4], out[at + 5] = width, exceptions
    packed = np.where(over, np.uint32(0), diff)
    for w in np.unique(width):
        if w:
            rows = np.flatnonzero(width == w)
            for k in range(0, len(rows), 4096):
                some = rows[k : k + 4096]
                cell = 2 if w <= 16 else 4
                bits = np.unpackbits(packed[some].astype(f"<u{cell}").view(np.uint8).reshape(-1, cell), axis=1, bitorder="little")[:, :w]
                out[at[some, None] + _HEADER + np.arange(BLOCK // 8 * w)] = np.packbits(bits.reshape(len(some), -1), axis=1, bitorder="little")
    b, place = np.nonzero(over)
    nth = np.arange(len(b)) - np.repeat(np.cumsum(exceptions) - exceptions, exceptions)
    to = at[b] + _HEADER + BLOCK // 8 * width[b] + 5 * nth
    out[to] = place
    out[to[:, None] + 1 + np.arange(4)] = diff[b, place].astype("<u4").view(np.uint8).reshape(-1, 4)
    return out.tobytes(), at.astype(np.uint32)


def decode_blocks(payload: bytes, block_starts: np.ndarray, n_tokens: int, first_block: int = 0) -> np.ndarray:
    """Ids of the blocks from ``first_block`` on that hold ``n_tokens`` ids."""
    n = -(-n_tokens // BLOCK)
    if not n:
        return np.zeros(0, np.uint32)
    data, at = np.frombuffer(payload, np.uint8), block_starts[first_block : first_block + n].astype(np.int64)
    low = np.ascontiguousarray(data[at[:, None] + np.arange(4)]).view("<u4").ravel()
    width, exceptions = data[at + 4].astype(np.int64), data[at + 5].astype(np.int64)
    diff = np.zeros((n, BLOCK), np.uint32)
    for w in np.unique(width):
        if w:
            rows = np.flatnonzero(width == w)
            for k in range(0, len(rows), 4096):
                some = rows[k : k + 4096]
                first = np.arange(BLOCK) * w
                raw = np.zeros((len(some), BLOCK // 8 * w + 8), np.uint8)
                raw[:, : BLOCK // 8 * w] = data[at[some, None] + _HEADER + np.arange(BLOCK // 8 * w)]
                cell = raw[:, first // 8].astype(np.uint64)
                for byte in range(1, (w + 14) // 8):
                    cell |= raw[:, first // 8 + byte].astype(np.uint64) << np.uint64(8 * byte)
                diff[some] = (cell >> (first % 8).astype(np.uint64)) & np.uint64((1 << w) - 1)
    b = np.repeat(np.arange(n), exceptions)
    nth = np.arange(len(b)) - np.repeat(np.cumsum(exceptions) - exceptions, exceptions)
    of = at[b] + _HEADER + BLOCK // 8 * width[b] + 5 * nth
    diff[b, data[of]] = np.ascontiguousarray(data[of[:, None] + 1 + np.arange(4)]).view("<u4").ravel() if len(b) else 0
    return (diff + low[:, None]).ravel()[:n_tokens]


class _Numbers(dict):
    """Numbers pieces as they are asked for."""

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        return n


class Encoder:
    """The tokenizers library with a memory of pieces it has encoded.

    In texts of ASCII and Latin characters, whose classes no Unicode version or library disputes, pieces are cut
    where the vocabulary's pre-tokeniser cuts, and a piece's ids do not depend on its neighbours. New pieces are
    encoded together, a line feed between them. Other texts are encoded as a whole.
    """

    _LETTER = r"A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u017f"
    _PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-\xa9\xab\xac\xae-\xb1\xb4\xb6-\xb8\xbb\xbf-\u017f]*")
    _PIECE = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{_LETTER}]+| ?[0-9]+| ?[^ \t\n\r0-9{_LETTER}]+|[ \t\n\r]+(?![^ \t\n\r])|[ \t\n\r]+")
    _FEED = "\n"

    def __init__(self, path: str, most_pieces: int):
        self.most_pieces = most_pieces
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        (self.feed,) = self._all([self._FEED])[0]
        self._forget()

    def _all(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _forget(self) -> None:
        self.known, self.ids, self.start = _Numbers(), np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _learn(self, new: list[str]) -> None:
        blank = [i for i, x in enumerate(new) if x.isspace()]
        lines = [x for x in new if not x.isspace()]
        flat = [np.zeros(0, np.uint32)]
        n = np.zeros(len(new), np.int64)
        inner = np.ones(len(new), bool)
        inner[blank] = False
        if lines:
            got = np.array([i for ids in self._all([self._FEED.join(lines[k : k + 2000]) + self._FEED for k in range(0, len(lines), 2000)]) for i in ids], np.uint32)
            ends = np.flatnonzero(got == self.feed)
            n[inner] = np.diff(np.concatenate(([-1], ends))) - 1
            words = got[got != self.feed]
        else:
            words = flat[0]
        some = self._all([new[i] for i in blank])
        n[blank] = [len(x) for x in some]
        ids = np.empty(n.sum(), np.uint32)
        of_word = np.repeat(inner, n)
        ids[of_word] = words
        ids[~of_word] = [i for x in some for i in x]
        self.ids = np.concatenate([self.ids, ids])
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(n)])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        plain = [t != "" and "<|endoftext|>" not in t and bool(self._PLAIN.fullmatch(t)) for t in texts]
        if len(self.known) > self.most_pieces:
            self._forget()
        before, number, places = len(self.known), self.known.__getitem__, []
        for t, p in zip(texts, plain, strict=True):
            if p:
                places.append(np.fromiter(map(number, self._PIECE.findall(t)), np.int64))
        if len(self.known) > before:
            self._learn(list(islice(self.known, before, None)))
        of, out = iter(places), []
        for text, p in zip(texts, plain, strict=True):
            if p:
                at = next(of)
                first = self.start[at]
                n = self.start[at + 1] - first
                out.append(self.ids[np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())])
            else:
                out.append(np.array(self._all([text])[0] if text else [], np.uint32))
        return out


_encoders: dict[str, Encoder] = {}


def encoder_of(path: str, most_pieces: int) -> Encoder:
    """One for each Python worker, which outlives a task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path, most_pieces)
    _encoders[path].most_pieces = most_pieces
    return _encoders[path]


def write_segments(docs: DataFrame, spark: SparkSession, tokenizer: str, scratch: Scratch, name: str = "segments", segment_tokens: int = 1_000_000, most_pieces: int = 1_600_000) -> DataFrame:
    """Encodes (doc_id, text) and writes the table of segments; returns it as read again.

    A Python worker remembers at most about ``most_pieces`` encoded pieces, of some 160 bytes each.
    """
    order = F.xxhash64(text_or_empty())
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), order.alias("o"))
    dealt = dealt.repartitionByRange(shuffle_width(spark), F.col("doc_id").asc_nulls_first(), "o").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "o")

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, range_ = encoder_of(tokenizer, most_pieces), TaskContext.get().partitionId()
        ids: list[np.ndarray] = []
        keys: list[int | None] = []
        lengths: list[int] = []
        state = {"first": 0, "segment": 0, "held": 0}

        def segment() -> pd.DataFrame:
            flat = np.concatenate(ids)
            payload, starts = encode_blocks(flat)
            key = np.array([np.iinfo(np.int64).min if k is None else k for k in keys], np.int64)
            row = {"range": range_, "segment": state["segment"], "first_token": state["first"], "n_tokens": len(flat), "doc_ids": key.tobytes(), "doc_tokens": np.array(lengths, np.int64).tobytes(), "block_starts": starts.tobytes(), "payload": payload}
            state["first"] += len(flat)
            state["segment"] += 1
            state["held"] = 0
            ids.clear(), keys.clear(), lengths.clear()
            return pd.DataFrame([row])

        for batch in batches:
            for part in slices(batch, most=2_000_000):
                for key, got in zip(part["doc_id"].astype("Int64").array, encoder.encode([t or "" for t in part["text"]]), strict=True):
                    got = np.append(got, np.uint32(END))
                    ids.append(got)
                    keys.append(None if key is pd.NA else int(key))
                    lengths.append(len(got))
                    state["held"] += len(got)
                    if state["held"] >= segment_tokens:
                        yield segment()
        if ids:
            yield segment()

    return scratch.put(dealt.select("doc_id", "text").mapInPandas(encode, SEGMENT_SCHEMA), name)


def read_documents(segments: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files."""
    # one row for each range, of which there are as many as shuffle partitions
    totals = segments.groupBy("range").agg(F.sum("n_tokens").alias("n"))
    bases = totals.withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")).drop("n")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                ids = decode_blocks(row.payload, np.frombuffer(row.block_starts, np.uint32), row.n_tokens).astype("<u4")
                keys, n = np.frombuffer(row.doc_ids, np.int64), np.frombuffer(row.doc_tokens, np.int64)
                ends = np.cumsum(n)
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
                doc = pd.array(keys, dtype="Int64")
                doc[keys == np.iinfo(np.int64).min] = pd.NA
                yield pd.DataFrame({"doc_id": doc, "start": row.base + row.first_token + ends - n, "n_tokens": n, "ids_crc32": crc})

    return segments.join(F.broadcast(bases), "range").mapInPandas(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def token_files(docs: DataFrame, spark: SparkSession, tokenizer: str | None = None, **options: int) -> DataFrame:
    return read_documents(write_segments(docs, spark, tokenizer or tokenizer_path(), Scratch(spark), **options))


def op4_tokenfiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"), spark)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_files(docs, spark, most_pieces=300_000)
