"""Quality scores from hashed word n-grams and logistic regression trained by FTRL-proximal updates.

Words are runs of letters (bytes from 128 on included), of digits or of other printable bytes, as written; white space
parts them. Features are the hashes of single words and of pairs of neighbours, of the words themselves and of their
shapes (kind, case and rough length), and one for any word that follows itself, in 2**18 slots; a slot's value is 1 + log of its count, and a text's vector has
length 1. A score is the logistic function of the sparse dot product with the weights and the bias, over the whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, released, ship, text_of, utf8_parts
from .wordhash import powers, mix

SLOTS = 1 << 18
#: Labelled rows that the weights are fitted to, at most: the first by a digest of their ids. The bound of the model's
#: training set; every row is scored.
TRAINING_ROWS = 6000
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.01, 0.01, 4

_KIND = np.full(256, 3, np.uint8)  # 0 space, 1 letter, 2 digit, 3 other
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_KIND[48:58] = 2
_UPPER = np.zeros(256, np.int64)
_UPPER[65:91] = 1


def features(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slots, values, offsets by text) of the texts ``raw[off[i]:off[i+1]]``."""
    n, size = len(off) - 1, len(raw)
    if size == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.float32), np.zeros(n + 1, np.int64)
    kind = _KIND[raw]
    change = np.ones(size, bool)
    change[1:] = kind[1:] != kind[:-1]
    edges = off[1:-1]
    change[edges[edges < size]] = True
    start = np.flatnonzero(change)
    end = np.append(start[1:], size)
    solid = kind[start] > 0
    start, end = start[solid], end[solid]
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.float32), np.zeros(n + 1, np.int64)
    power, inverse = powers(size + 1)
    total = np.zeros(size + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[:size], out=total[1:])
    length = end - start
    h = mix((total[end] - total[start]) * inverse[start] + length.astype(np.uint64))
    capitals = np.concatenate(([0], np.cumsum(_UPPER[raw])))
    high = capitals[end] - capitals[start]
    case = np.where(high == 0, 0, np.where(high == length, 2, 1))
    shape = mix((kind[start].astype(np.uint64) * np.uint64(3) + case.astype(np.uint64)) * np.uint64(64) + np.minimum(63, np.log2(length).astype(np.int64) * 2).astype(np.uint64))
    doc = np.searchsorted(off, start, side="right") - 1
    slot, owner = [], []
    for salt, g in ((1, h), (2, shape)):
        pair = g[:-1] * np.uint64(0x9E3779B97F4A7C15) + g[1:]
        same = doc[1:] == doc[:-1]
        for s, x, d in ((salt, g, doc), (salt + 2, pair[same], doc[1:][same])):
            slot.append((mix(x + np.uint64(s)) % np.uint64(SLOTS)).astype(np.int64))
            owner.append(d)
    again = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    slot.append(np.full(int(again.sum()), int(mix(np.array([5], np.uint64))[0] % np.uint64(SLOTS)), np.int64))
    owner.append(doc[1:][again])
    key = np.concatenate(owner) * SLOTS + np.concatenate(slot)
    key.sort()
    new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    count = np.diff(np.append(new, len(key)))
    owner, slot = key[new] // SLOTS, key[new] % SLOTS
    value = 1 + np.log(count)
    norm = np.sqrt(np.bincount(owner, value * value, minlength=n))
    value = (value / norm[owner]).astype(np.float32)
    return slot, value, np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=n))))


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def score(self, slot: np.ndarray, value: np.ndarray, off: np.ndarray) -> np.ndarray:
        part = np.concatenate(([0.0], np.cumsum(self.weights[slot].astype(np.float64) * value)))
        return 1 / (1 + np.exp(-np.clip(self.bias + part[off[1:]] - part[off[:-1]], -35, 35)))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS) -> Model:
    """FTRL-proximal over (slots, values, label), in the given order, ``epochs`` times. No rows: every score is 0.5."""
    z, n = np.zeros(SLOTS), np.zeros(SLOTS)
    zb = nb = 0.0
    if not rows:
        return Model(z.astype(np.float32), 0.0)

    def weight(z, n):
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def bias():
        return -zb / ((BETA + nb**0.5) / ALPHA)

    for _ in range(epochs):
        for slot, value, y in rows:
            zs, ns = z[slot], n[slot]
            w = weight(zs, ns)
            b = bias()
            p = 1 / (1 + np.exp(-np.clip(w @ value + b, -35, 35)))
            e = p - y
            g = e * value
            z[slot] = zs + g - (np.sqrt(ns + g * g) - np.sqrt(ns)) / ALPHA * w
            n[slot] = ns + g * g
            zb += e - ((nb + e * e) ** 0.5 - nb**0.5) / ALPHA * b
            nb += e * e
    return Model(weight(z, n).astype(np.float32), float(bias()))


def held_out(doc_id):
    """Rows that never teach: the remainder of crc32 of the id's text by 3 is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", limit: int = TRAINING_ROWS) -> Model:
    """A model from ``limit`` labelled texts at most, held-out ones excepted. Null labels, ids and unlabelled texts teach nothing."""
    ship(docs.sparkSession)
    marked = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col("doc_id")))
    marked = marked.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(label).cast("int").alias("y"))
    marked = marked.withColumn("o", F.md5(F.col("id").cast("string"))).orderBy("o").limit(limit)
    # the labelled side has ``limit`` rows at most
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), text_of(docs).alias("text")).join(F.broadcast(marked), "id")

    def run(batches):
        for batch in batches:
            raw, off = utf8_parts(batch.column(1))
            for i, j in blocks(off):
                slot, value, at = features(raw[off[i] : off[j]], off[i : j + 1] - off[i])
                cut = pa.array(at, pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.ListArray.from_arrays(cut, pa.array(slot, pa.int32())), pa.ListArray.from_arrays(cut, pa.array(value, pa.float32()))], ["o", "y", "slot", "value"])

    got = rows.select("o", "text", "y").mapInArrow(released(run), "o string, y int, slot array<int>, value array<float>").toArrow()
    got = got.sort_by("o").slice(0, limit).combine_chunks()  # repeated ids bring no more rows than the bound
    slot, value = got["slot"].combine_chunks() if got.num_rows else None, got["value"].combine_chunks() if got.num_rows else None
    labels_ = got["y"].to_pylist()
    return fit([(slot[i].values.to_numpy(), value[i].values.to_numpy(), y) for i, y in enumerate(labels_)])


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, score, predicted. Null and empty texts get the bias's score.
    A null doc_id stays null and isn't held out; equal texts have equal scores; other columns are not read."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast((model.weights, model.bias))  # SLOTS floats

    def run(batches):
        own = Model(*shared.value)
        for batch in batches:
            raw, off = utf8_parts(batch.column(1))
            out = [own.score(*features(raw[off[i] : off[j]], off[i : j + 1] - off[i])) for i, j in blocks(off)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate([np.zeros(0), *out]))], ["doc_id", "score"])

    scored = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(docs, text).alias("text")).mapInArrow(released(run), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Rows of ``docs`` that the model doesn't reject, with all their columns."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast((model.weights, model.bias))
    at = docs.columns.index(text)

    def run(batches):
        own = Model(*shared.value)
        for batch in batches:
            raw, off = utf8_parts(batch.column(at))
            out = [own.score(*features(raw[off[i] : off[j]], off[i : j + 1] - off[i])) for i, j in blocks(off)]
            yield batch.filter(pa.array(np.concatenate([np.zeros(0), *out]) >= 0.5))

    return docs.mapInArrow(released(run), docs.schema)
