"""Token ids as directly addressable codes.

An id is split into chunks of ``BITS`` bits. Level 0 holds the lowest chunk of every id; a bitmap says which ids go on,
and the next level holds the next chunk of those only. A rank directory holds the number of set bits before each block
of a bitmap, so that the place of an id in the next level is one lookup and one count within a block: any id is read
without decoding its neighbours.

A segment is one self-contained byte string (little-endian):
``DAC1``, chunk bits u8, levels u8, 2 zero bytes, ids u64, then for each level: entries u64, the chunks (u8 each, padded
to 8 bytes), the bitmap (8 bytes a word) and the directory (u32 for each block of 512 bits, and one more at the end).
The files are Parquet tables of segments in ascending order of documents, so any store that Spark can write will do.
"""

from __future__ import annotations

import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import vocabulary_file
from .common import Scratch, blocks, partitions, released, text_of, utf8_parts
from .runs import RunTable

BITS, BLOCK_BITS = 8, 512
END_ID = 2
SEGMENT_IDS = 1 << 18
#: Different runs of text whose ids a worker remembers; it changes speed, never results.
CACHE_RUNS = 2_000_000


def _pad(b: bytes) -> bytes:
    return b + b"\0" * (-len(b) % 8)


def pack(ids: np.ndarray) -> bytes:
    """A segment of unsigned ids below 2**64."""
    left, levels = np.asarray(ids, np.uint64), []
    while True:
        chunk = (left & np.uint64(255)).astype(np.uint8)
        left = left >> np.uint64(BITS)
        go = left > 0
        bits = np.packbits(go, bitorder="little").tobytes()
        bits += b"\0" * (-len(bits) % (BLOCK_BITS // 8))
        ones = np.unpackbits(np.frombuffer(bits, np.uint8)).reshape(-1, BLOCK_BITS).sum(axis=1, dtype=np.uint32) if bits else np.zeros(0, np.uint32)
        ranks = np.concatenate(([0], np.cumsum(ones))).astype("<u4").tobytes()
        levels.append(struct.pack("<Q", len(chunk)) + _pad(chunk.tobytes()) + bits + _pad(ranks))
        left = left[go]
        if not len(left):
            return b"DAC1" + struct.pack("<BBHQ", BITS, len(levels), 0, len(ids)) + b"".join(levels)


class Dac:
    """Reader of one segment."""

    def __init__(self, data: bytes):
        if data[:4] != b"DAC1" or data[4] != BITS:
            raise ValueError("not a segment of directly addressable codes")
        self.n = struct.unpack_from("<Q", data, 8)[0]
        self.levels, at = [], 16
        for _ in range(data[5]):
            count = struct.unpack_from("<Q", data, at)[0]
            at += 8
            chunks = np.frombuffer(data, np.uint8, count, at)
            at += count + -count % 8
            size = -(-count // BLOCK_BITS) * BLOCK_BITS // 8
            bits = np.frombuffer(data, np.uint8, size, at)
            at += size
            blocks = size * 8 // BLOCK_BITS + 1
            ranks = np.frombuffer(data, "<u4", blocks, at)
            at += 4 * blocks + -4 * blocks % 8
            self.levels.append((chunks, bits, ranks))

    def __len__(self) -> int:
        return self.n

    def get(self, i: int) -> int:
        """The i-th id, with one rank for each level it reaches."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level, (chunks, bits, ranks) in enumerate(self.levels):
            value |= int(chunks[i]) << BITS * level
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // BLOCK_BITS
            first = block * BLOCK_BITS // 8
            before = int.from_bytes(bits[first : (i >> 3) + 1].tobytes(), "little") & ((1 << (i - block * BLOCK_BITS)) - 1)
            i = int(ranks[block]) + before.bit_count()
        return value

    def slice(self, start: int, stop: int) -> np.ndarray:
        """Ids from start to stop: each level's part is one run, found by two ranks."""
        out = np.zeros(stop - start, np.uint64)
        where = np.arange(stop - start)
        for level, (chunks, bits, ranks) in enumerate(self.levels):
            out[where] |= chunks[start:stop].astype(np.uint64) << np.uint64(BITS * level)
            go = np.unpackbits(bits[start >> 3 : (stop + 7) >> 3], bitorder="little")[start & 7 : (start & 7) + stop - start].astype(bool)
            where = where[go]
            if not len(where):
                break
            block = start // BLOCK_BITS
            inside = np.unpackbits(bits[block * BLOCK_BITS // 8 : (start + 7) >> 3], bitorder="little")[: start - block * BLOCK_BITS]
            start = int(ranks[block]) + int(inside.sum())
            stop = start + len(where)
        return out


class _Encoder:
    """The tokenizers library, called once for each different run of a text (see ``runs``) and for whole odd texts."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        suffix = self.tokenizer.model.end_of_word_suffix
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        if suffix:
            self.ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        self.table = RunTable(self._add, self._clear, CACHE_RUNS)

    def _clear(self) -> None:
        self.pool, self.first, self.count = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _add(self, runs: list[bytes]) -> None:
        count = np.zeros(len(runs), np.int64)
        letters = [i for i, r in enumerate(runs) if r and (r[0] >= 128 or r[:1].isalpha())]
        parts: list[tuple[np.ndarray, np.ndarray]] = []  # run numbers in order, their ids one after another
        single = [i for i, r in enumerate(runs) if r and not (r[0] >= 128 or r[:1].isalpha())]
        # a run of letters is one word, and a word's last token says so: many go through the library as one text
        groups = [letters[k : k + 1000] for k in range(0, len(letters), 1000)]
        for group, ids in zip(groups, self._ids([b" ".join([runs[i] for i in g]).decode() for g in groups])):
            stop = np.flatnonzero(self.ends[ids]) + 1
            if len(stop) == len(group) and stop[-1] == len(ids):
                count[group] = np.diff(stop, prepend=0)
                parts.append((np.array(group), ids))
            else:
                single += group
        for i, ids in zip(single, self._ids([runs[i].decode() for i in single])):
            count[i] = len(ids)
            parts.append((np.array([i]), ids))
        first = np.zeros(len(runs), np.int64)
        at = len(self.pool)
        for group, ids in parts:
            n = count[group]
            first[group] = at + np.cumsum(n) - n
            at += len(ids)
        self.pool = np.concatenate([self.pool, *(ids for _, ids in parts)])
        self.first, self.count = np.concatenate((self.first, first)), np.concatenate((self.count, count))

    def encode(self, raw: np.ndarray, off: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each with ``end_id`` behind it, one after another; number of ids of each text)."""
        n = len(off) - 1
        places, doc, odd = self.table.find(raw, off)
        keep = ~odd[doc]
        places, doc = places[keep], doc[keep]
        length = self.count[places]
        lengths = np.bincount(doc, length, minlength=n).astype(np.int64)
        data = raw.tobytes()
        whole = np.flatnonzero(odd)
        texts = self._ids([data[off[i] : off[i + 1]].decode() for i in whole])
        for i, ids in zip(whole, texts):
            lengths[i] = len(ids)
        lengths += 1
        stop = np.cumsum(lengths)
        out = np.full(int(stop[-1]) if n else 0, end_id, np.uint32)
        # where each run's ids go: its text's beginning and what its text has before it
        before = np.cumsum(length) - length
        own = np.concatenate(([0], np.cumsum(np.bincount(doc, length, minlength=n).astype(np.int64))))
        to = stop[doc] - lengths[doc] + before - own[doc]
        step = np.arange(int(length.sum())) - np.repeat(before, length)
        out[np.repeat(to, length) + step] = self.pool[np.repeat(self.first[places], length) + step]
        for i, ids in zip(whole, texts):
            out[stop[i] - lengths[i] : stop[i] - 1] = ids
        return out, lengths


@lru_cache(maxsize=2)
def _encoder(name: str) -> _Encoder:
    return _Encoder(SparkFiles.get(name))


_SEGMENT = "part int, seq int, base long, n_ids long, doc_ids array<long>, lengths array<long>, segment binary"


def write_ids(docs: DataFrame, vocabulary: str, path: str, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID) -> None:
    """Encode every whole text (null: empty), append ``end_id`` and write segments in ascending order of ``doc_id``.

    Rows with a null doc_id come first; rows of one doc_id are ordered by their text. An empty table writes no segment.
    """
    spark = docs.sparkSession
    name = vocabulary_file(spark, vocabulary)

    def run(batches):
        part, seq, base = TaskContext.get().partitionId(), 0, 0
        encoder = _encoder(name)
        held_ids, held, size = [], [], 0

        def segment():
            nonlocal seq, base, held_ids, held, size
            ids = np.concatenate([x[0] for x in held])
            lengths = np.concatenate([x[1] for x in held]).tolist()
            row = [part, seq, base, len(ids), held_ids, lengths, pack(ids)]
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
            seq, base, held_ids, held, size = seq + 1, base + len(ids), [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], ["part", "seq", "base", "n_ids", "doc_ids", "lengths", "segment"])

        for batch in batches:
            ids = batch.column(0).to_pylist()
            raw, off = utf8_parts(batch.column(1))
            for i, j in blocks(off, 1 << 21):
                held.append(encoder.encode(raw[off[i] : off[j]], off[i : j + 1] - off[i], end_id))
                held_ids += ids[i:j]
                size += len(held[-1][0])
                if size >= SEGMENT_IDS:
                    yield segment()
        if held_ids:
            yield segment()

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(docs, text).alias("text"))
    # a null or a repeated doc_id spreads by the beginnings of its texts
    rows = rows.repartitionByRange(partitions(spark), "doc_id", F.substring("text", 1, 24)).sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(released(run), _SEGMENT).write.mode("overwrite").parquet(path)


def read_ids(spark: SparkSession, path: str, keep_ids: bool = False) -> DataFrame:
    """Documents of written segments: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of the ids as
    little-endian unsigned 32-bit integers), and the ids themselves with ``keep_ids``."""
    segments = spark.read.parquet(path)
    before, firsts = 0, []
    # one row for each written part, however many ids it holds
    for part, ids in segments.groupBy("part").agg(F.sum("n_ids")).orderBy("part").collect():
        firsts.append((part, before))
        before += ids
    offsets = spark.createDataFrame(firsts, "part int, first long")
    rows = segments.join(F.broadcast(offsets), "part").select((F.col("first") + F.col("base")).alias("first"), "doc_ids", "lengths", "segment")

    def run(batches):
        for batch in batches:
            for first, docs, lengths, data in zip(*(batch.column(k).to_pylist() for k in range(4))):
                ids = Dac(data).slice(0, sum(lengths)).astype("<u4")
                at = np.concatenate(([0], np.cumsum(lengths))).astype(np.int64)
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(at[:-1], at[1:])]
                out = [pa.array(docs, pa.int64()), pa.array(first + at[:-1]), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())]
                if keep_ids:
                    out.append(pa.array([ids[a:b].astype(np.int64) for a, b in zip(at[:-1], at[1:])], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(out, names)

    names = ["doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if keep_ids else [])]
    return rows.mapInArrow(released(run), "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if keep_ids else ""))


def token_index(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """Write ids and read them back: doc_id, start, n_tokens, ids_crc32 for each row of ``docs``.

    Null and empty texts have the end id alone. Rows with a null doc_id come first, under a null doc_id; rows of one
    doc_id follow their text, and equal rows have an entry each. Texts of any length are encoded whole. An empty table gives
    no rows. Other columns are not read. See ``write_ids`` and ``read_ids``.
    """
    spark = docs.sparkSession
    path = path or Scratch(spark, "token-ids").path("segments")
    write_ids(docs, vocabulary, path, doc_id, text)
    return read_ids(spark, path)
