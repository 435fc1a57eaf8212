"""Near-duplicate classes by HyperMinHash banding with exact confirmation.

Every distinct shingle set is kept once (a digest of the whole sorted set stands for all its copies). A shingle is known
by 128 bits that rest on its words' identities (see ``wordhash``), in digests as in comparisons of full sets. A set's
shingles are hashed ``DEALS`` times over and dealt to ``REGISTERS`` buckets; a bucket stores its least hash compressed to
a count of leading zeros (6 bits) and ``MANTISSA`` bits that follow. Empty buckets borrow from filled ones in an order
that depends on the bucket alone, so a register of two sets agrees with probability J. Bands of ``ROWS`` registers
propose pairs, the estimate of J, less the agreements that compression alone is expected to make in sets of their sizes,
thins them, and full sets confirm them.

Registers of a small set hang together, as they borrow from a few buckets, so no bound on an estimate holds for them.
Pairs with a set of at most ``SMALL`` shingles are found exactly: a set's shingles in order of how many sets have them,
rarest first, must share one of the first n - ceil(0.75 n) + 1 with any set that is near enough, and such pairs are
compared by their shingles at once. Larger sets fill 98 % of the buckets at least, as every shingle is dealt ``DEALS``
times: a pair at the very threshold then shares a band with probability 1 - 1e-10.

No pair list of a group is ever made. In a bucket, members are compared in cells of one or two blocks of about ``BLOCK``
members, and a cell gives out a spanning forest of what it finds; the same holds when full sets are compared inside
one candidate cluster. A larger group is first compared with a few hubs in each block, and only rows that this leaves
outside the group's largest component meet the whole group: rows grow with members, and with the blocks of the rest.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, blocks, released, ship, text_of, utf8_parts
from .components import components
from .wordhash import mix, shingles

WORDS, NUMERATOR, DENOMINATOR = 5, 75, 100
REGISTERS, ROWS, MANTISSA, DEALS = 128, 3, 10, 8
#: Sets of so many shingles are compared exactly; REACH is the size of the largest set that can be near one of them.
SMALL = 64
REACH = SMALL * DENOMINATOR // NUMERATOR
#: Standard deviations of the estimate that a candidate may lie under the threshold.
SLACK = 6.5
BLOCK = 2048
#: The same for full sets, whose size counts as well.
TEXT_BLOCK, SHINGLE_BLOCK = 512, 1_000_000
#: Rows, on average, that every part of a large group holds; it changes the work, never the links.
HUBS = 8


def _borrow_order() -> np.ndarray:
    tries = np.arange(24, dtype=np.uint64)[:, None] * np.uint64(REGISTERS) + np.arange(REGISTERS, dtype=np.uint64)
    return (mix(tries + np.uint64(0xABCD)) % np.uint64(REGISTERS)).astype(np.int64)


_DEALT = mix(np.arange(1, DEALS + 1, dtype=np.uint64) * np.uint64(0x5851F42D4C957F2D))


def sketch(hashes: np.ndarray, off: np.ndarray) -> np.ndarray:
    """HyperMinHash registers (uint16, one row a set) of the sets ``hashes[off[i]:off[i+1]]``; a row of an empty set means nothing."""
    n = len(off) - 1
    row = np.repeat(np.arange(n), np.diff(off)) * REGISTERS
    least = np.full(n * REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for deal in _DEALT:
        h = mix(hashes ^ deal)
        np.minimum.at(least, row + (h >> np.uint64(57)).astype(np.int64), (h << np.uint64(7)) | np.uint64(0x7F))
    least = least.reshape(n, REGISTERS)
    full = least != np.iinfo(np.uint64).max
    zeros = np.zeros(least.shape, np.uint64)
    left = least.copy()
    for step in (32, 16, 8, 4, 2, 1):
        low = left < (np.uint64(1) << np.uint64(64 - step))
        zeros += np.where(low, np.uint64(step), np.uint64(0))
        left = np.where(low, left << np.uint64(step), left)
    mantissa = (left << np.uint64(1)) >> np.uint64(64 - MANTISSA)
    own = (zeros << np.uint64(MANTISSA) | mantissa).astype(np.uint16)
    out, done = own.copy(), full.copy()
    for source in _borrow_order():
        take = ~done & full[:, source]
        out[take] = own[:, source][take]
        done |= take
    for i in np.flatnonzero(~done.all(axis=1) & full.any(axis=1)):  # very small sets: walk round to the next filled bucket
        at = np.flatnonzero(full[i])
        miss = np.flatnonzero(~done[i])
        out[i, miss] = own[i, at[np.searchsorted(at, miss) % len(at)]]
    return out


def band_keys(registers: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each row."""
    n, bands = len(registers), REGISTERS // ROWS
    rows = registers[:, : bands * ROWS].reshape(n, bands, ROWS).astype(np.uint64)
    key = np.zeros((n, bands), np.uint64)
    for j in range(ROWS):
        key = key << np.uint64(16) | rows[:, :, j]
    return mix(key + np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _spread(total: np.ndarray) -> np.ndarray:
    """Mean width of the cell at the least of ``total`` hashes of a bucket: widths are 2**-(i + 1) where a hash has i leading zeros."""
    edge = 2.0 ** -np.arange(1, 58)
    return (np.exp(-total[:, None] * edge) - np.exp(-total[:, None] * 2 * edge)) @ edge


_TOTALS = 2.0 ** np.arange(-8, 56, 1 / 16)
_SPREADS = _spread(_TOTALS) * _TOTALS


def chance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Probability that compression alone makes a register of disjoint sets of ``a`` and ``b`` shingles agree.

    With x and y hashes in a bucket, both least ones lie at u with density x y exp(-(x + y) u), and in one cell if they
    are as near as its width; the integral over u is read off a table of x + y, in which it hardly changes.
    """
    x, y = a * (DEALS / REGISTERS), b * (DEALS / REGISTERS)
    return np.minimum(0.5, x * y / (x + y) ** 2 * np.interp(np.log2(x + y), np.log2(_TOTALS), _SPREADS) * 2.0**-MANTISSA)


def estimate(equal: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard estimate from the number of agreeing registers of sets of ``a`` and ``b`` shingles, less expected collisions."""
    expected = chance(a, b)
    return (equal / REGISTERS - expected) / (1 - expected)


def least_estimate() -> float:
    """The threshold less the slack, and less one register, so that rounding loses no pair."""
    j = NUMERATOR / DENOMINATOR
    return j - SLACK * float(np.sqrt(j * (1 - j) / REGISTERS)) - 1 / REGISTERS


def digest_of(hashes: np.ndarray, others: np.ndarray) -> str | None:
    """Digest of a sorted shingle set, both halves of each; none for the empty set."""
    return hashlib.blake2b(hashes.tobytes() + others.tobytes(), digest_size=16).hexdigest() if len(hashes) else None


_FEATURES = "doc_id long, n_shingles long, digest string, sketch binary, keys array<long>, small array<long>"


def _features(batches):
    for batch in batches:
        ids = batch.column(0)
        raw, off = utf8_parts(batch.column(1))
        for i, j in blocks(off):
            part, cut = raw[off[i] : off[j]], off[i : j + 1] - off[i]
            h, other, at = shingles(part, cut, WORDS)
            registers = sketch(h, at)
            keys = band_keys(registers).astype(np.int64)
            sizes = np.diff(at)
            digests = [digest_of(h[a:b], other[a:b]) for a, b in zip(at[:-1], at[1:])]
            small = [h[a:b].astype(np.int64) if b - a <= REACH else None for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays(
                [ids.slice(i, j - i).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array([r.tobytes() for r in registers], pa.binary()), pa.ListArray.from_arrays(pa.array(np.arange(0, (j - i + 1) * keys.shape[1], keys.shape[1]), pa.int32()), pa.array(keys.ravel(), pa.int64())), pa.array(small, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "digest", "sketch", "keys", "small"],
            )


def _search(ids: np.ndarray, near) -> list[tuple[int, int]]:
    """Spanning forest by breadth-first search; ``near(i, rest)`` says which of ``rest`` are tied to ``i``."""
    rest, edges = np.arange(len(ids)), []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            i = queue.pop()
            hit = near(i, rest)
            found = rest[hit]
            rest = rest[~hit]
            edges += [(int(ids[i]), int(ids[k])) for k in found]
            queue += list(found)
    return edges


def _edges(found: list[tuple[int, int]]):
    return pa.table({"a": pa.array([min(x) for x in found], pa.int64()), "b": pa.array([max(x) for x in found], pa.int64())})


def _codes(h: np.ndarray, other: np.ndarray | None) -> np.ndarray:
    """Numbers of the different shingles, told apart by both halves."""
    _, first, code = np.unique(h, return_index=True, return_inverse=True)
    if other is not None and (other[first][code] != other).any():
        order = np.lexsort((other, h))
        new = np.concatenate(([False], (h[order][1:] != h[order][:-1]) | (other[order][1:] != other[order][:-1])))
        code[order] = np.cumsum(new)
    return code


def _meets(h: np.ndarray, at: np.ndarray, other: np.ndarray | None = None):
    """``near(i, some)`` that says exactly which of the sets ``h[at[k]:at[k+1]]``, k in ``some``, reach the threshold with set i."""
    code = _codes(h, other)
    sizes = np.diff(at)
    mark = np.zeros(int(code.max()) + 1 if len(code) else 1, bool)

    def near(i, some):
        if not len(some):
            return np.zeros(0, bool)
        mine = code[at[i] : at[i + 1]]
        mark[mine] = True
        length = sizes[some]
        cut = np.concatenate(([0], np.cumsum(length)))
        spot = np.arange(cut[-1]) + np.repeat(at[some] - cut[:-1], length)
        both = np.add.reduceat(mark[code[spot]].astype(np.int64), cut[:-1])
        mark[mine] = False
        return DENOMINATOR * both >= NUMERATOR * (length + sizes[i] - both)

    return near


def _bucket_forest(group: pa.Table) -> pa.Table:
    """Candidates in one cell of a bucket: sets whose estimate comes near the threshold, small ones by their shingles."""
    if group.num_rows < 2:
        return _edges([])
    group = group.sort_by("node")
    ids = group["node"].to_numpy()
    registers = np.frombuffer(b"".join(group["sketch"].to_pylist()), np.uint16).reshape(len(ids), REGISTERS)
    sizes = group["n_shingles"].to_numpy()
    least = least_estimate()
    small = group["small"].combine_chunks()
    exact = _meets(small.flatten().to_numpy(), np.concatenate(([0], np.cumsum(small.value_lengths().fill_null(0).to_numpy()))))

    def near(i, rest):
        lo, hi = np.minimum(sizes[rest], sizes[i]), np.maximum(sizes[rest], sizes[i])
        hit = DENOMINATOR * lo >= NUMERATOR * hi
        some, few = rest[hit], lo[hit] <= SMALL
        ok = np.zeros(len(some), bool)
        ok[few] = exact(i, some[few])
        ok[~few] = estimate((registers[some[~few]] == registers[i]).sum(axis=1), sizes[some[~few]], sizes[i]) >= least
        hit[hit] = ok
        return hit

    return _edges(_search(ids, near))


def _first_true(ids: np.ndarray, ok: np.ndarray) -> np.ndarray:
    out, seen = np.zeros(len(ids), bool), set()
    for i in np.flatnonzero(ok):
        if ids[i] not in seen:
            seen.add(ids[i])
            out[i] = True
    return out


def _verified_forest(group: pa.Table) -> pa.Table:
    """Confirmed links in one cell of a candidate cluster, on full sets."""
    if group.num_rows < 2:
        return _edges([])
    group = group.sort_by("node")
    raw, off = utf8_parts(group["text"])
    parts = [shingles(raw[off[i] : off[j]], off[i : j + 1] - off[i], WORDS) for i, j in blocks(off)]
    h, other = (np.concatenate([x[k] for x in parts]) for k in (0, 1))
    at = np.concatenate(([0], np.cumsum(np.concatenate([np.diff(x[2]) for x in parts]))))
    del parts
    # a doc_id on rows with several texts brings them all; only the row with the node's own set counts, once
    own = [digest_of(h[a:b], other[a:b]) == d for a, b, d in zip(at[:-1], at[1:], group["digest"].to_pylist())]
    ids = group["node"].to_numpy()
    own = np.array(own) & np.concatenate(([True], ids[1:] != ids[:-1])) if all(own) else _first_true(ids, np.array(own))
    if not own.all():
        held = np.repeat(own, np.diff(at))
        h, other, ids, at = h[held], other[held], ids[own], np.concatenate(([0], np.cumsum(np.diff(at)[own])))
    sizes = np.diff(at)
    exact = _meets(h, at, other)

    def near(i, rest):
        lo, hi = np.minimum(sizes[rest], sizes[i]), np.maximum(sizes[rest], sizes[i])
        hit = DENOMINATOR * lo >= NUMERATOR * hi
        hit[hit] = exact(i, rest[hit])
        return hit

    return _edges(_search(ids, near))


def _cell(*place: Column) -> Column:
    return F.xxhash64("key", *place).alias("cell")


def _linked(groups: DataFrame, compare, scratch: Scratch) -> DataFrame:
    """Components under the links that ``compare(cells)`` finds inside the groups of ``groups(key, node, load, members, parts)``.

    ``load`` is a row's share of a part. A group of one part is one cell, whose pairs all count. A larger group is dealt
    to its parts, and about ``HUBS`` of its rows are in every part, so that near copies are tied together in as many rows
    as there are. A link inside one component says nothing new: what is left are the links of rows outside a group's
    largest component, which meet all its rows in a second round.
    """
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    hub = F.pmod(F.xxhash64("node", F.lit(1)), F.col("members")) < HUBS
    parts = F.when((F.col("parts") > 1) & hub, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(part))
    first = groups.withColumn("part", F.explode(parts)).withColumn("cell", _cell(F.col("part")))
    done = components(compare(first), scratch)

    large = groups.where("parts > 1").join(done, "node", "left").withColumn("component", F.coalesce("component", "node"))
    shares = large.groupBy("key", "component").agg(F.count("*").alias("n"), F.sum("load").alias("load"))
    top = shares.groupBy("key").agg(F.max(F.struct("n", "component"))["component"].alias("top"))
    rest = shares.join(top, "key").where("component <> top").groupBy("key", "top").agg(F.ceil(F.sum("load")).cast("int").alias("rest"))
    again = scratch.save(large.join(rest, "key"), "unsettled")
    if again.limit(1).count():
        place = lambda i, j: F.struct(i.alias("i"), j.alias("j"))
        mine = F.pmod(F.xxhash64("node", F.lit(2)), F.col("rest")).cast("int")
        met = F.transform(F.sequence(F.lit(0), F.col("rest") - 1), lambda i: place(i, part))
        meets = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: place(mine, j))
        both = F.when(F.col("component") == F.col("top"), met).otherwise(F.array_union(met, meets))
        second = again.withColumn("at", F.explode(both)).withColumn("cell", _cell(F.col("at.i"), F.col("at.j")))
        known = done.select(F.col("component").alias("a"), F.col("node").alias("b"))
        more = components(known.unionByName(compare(second)), scratch)
        scratch.drop(done)
        done = more
    scratch.drop(again)
    return done


def _rare_keys(classes: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, key) of the shingles that a set of up to ``REACH`` shares with every set near it, if there is any.

    Shingles of one set alone come first in the order of counts and can't be shared, so a text with enough words of its
    own has no key, whatever common lines it holds.
    """
    held = classes.where(F.col("small").isNotNull()).select("node", "n_shingles", F.explode("small").alias("shingle"))
    shared = scratch.save(held.groupBy("shingle").agg(F.count("*").alias("sets")).where("sets > 1"), "shared-shingles")
    own = held.join(shared.hint("merge"), "shingle").groupBy("node", "n_shingles").agg(F.sort_array(F.collect_list(F.struct("sets", "shingle"))).alias("shared"))
    first = F.col("n_shingles") - F.ceil(F.col("n_shingles") * NUMERATOR / DENOMINATOR) + 1 - (F.col("n_shingles") - F.size("shared"))
    own = own.withColumn("first", first.cast("int")).where("first > 0")
    return own.select("node", F.explode(F.slice("shared", F.lit(1), F.col("first"))).alias("s")).select("node", F.xxhash64("s.shingle").alias("key"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id, kept.

    Null and empty texts and texts without words have no shingles and are linked with nothing. Repeated rows and equal
    texts have equal sets, J = 1. A null ``doc_id`` takes part in no link and gets a null component, kept. An empty
    table gives an empty result. Other columns, whatever their names, are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "near-duplicates")
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(docs, text).alias("text"))
    rows = scratch.save(source.mapInArrow(released(_features), _FEATURES), "features")
    sets = rows.where("n_shingles > 0 and doc_id is not null")
    classes = sets.groupBy("digest").agg(F.min("doc_id").alias("least"), *(F.first(c).alias(c) for c in ("n_shingles", "sketch", "keys", "small")))
    classes = scratch.save(classes.withColumn("node", F.monotonically_increasing_id()), "classes")

    # tables that grow with the data meet by a shuffle, whatever their size: plans are alike at every size
    bands = classes.select("node", F.explode("keys").alias("key")).unionByName(_rare_keys(classes, scratch))
    bands = scratch.save(bands, "keys")
    # buckets of the same members are one: near copies meet in many bands
    marks = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"mark{i}") for i in (0, 1)]
    shared = bands.groupBy("key").agg(F.count("*").alias("members"), *marks).where("members > 1")
    shared = scratch.save(shared.groupBy("members", "mark0", "mark1").agg(F.min("key").alias("key")).select("key", "members"), "buckets")
    load = F.lit(1 / BLOCK)
    members = scratch.save(bands.join(shared.hint("merge"), "key").select("key", "node", "members", load.alias("load"), F.ceil(F.col("members") * load).cast("int").alias("parts")), "members")

    def estimated(cells: DataFrame) -> DataFrame:
        held = cells.select("cell", "node").hint("merge").join(classes.select("node", "n_shingles", "sketch", "small"), "node")
        return held.groupBy("cell").applyInArrow(_bucket_forest, "a long, b long")

    clusters = _linked(members, estimated, scratch)

    load = F.greatest(F.lit(1 / TEXT_BLOCK), F.col("n_shingles") / SHINGLE_BLOCK)
    who = clusters.join(classes.select("node", "digest", F.col("least").alias("doc_id"), load.alias("load")), "node").withColumnRenamed("component", "key")
    sizes = who.groupBy("key").agg(F.count("*").alias("members"), F.ceil(F.sum("load")).cast("int").alias("parts"))
    who = scratch.save(who.join(sizes, "key"), "clusters")

    # the clusters grow with the data: all texts and clusters meet by a shuffle, whatever their size, and only once
    texts = scratch.save(source.join(who.select("node", "digest", "doc_id").hint("merge"), "doc_id").select("node", "digest", "text"), "texts")

    def verified(cells: DataFrame) -> DataFrame:
        held = texts.join(cells.select("cell", "node").hint("merge"), "node")
        return held.groupBy("cell").applyInArrow(_verified_forest, "a long, b long")

    linked = _linked(who, verified, scratch)

    named = linked.join(classes.select("node", "least"), "node")
    named = scratch.save(named.select("node", "component", "least"), "named")
    name = named.groupBy("component").agg(F.min("least").alias("component_id"))
    label = named.join(name, "component").select("node", "component_id")
    label = classes.select("node", "digest", "least").join(label, "node", "left")
    label = scratch.save(label.select("digest", F.coalesce("component_id", "least").alias("component_id")), "labels")
    scratch.drop(bands, shared, members, classes, clusters, who, texts, linked, named)
    # rows without words have no label and spread by their ids
    apart = F.coalesce("digest", F.col("doc_id").cast("string"), F.lit(""))
    out = rows.select("doc_id", "n_shingles", apart.alias("digest")).join(label, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``docs``, with all their columns, whose document is kept: one of each near-duplicate group. Rows of one
    doc_id stay or go together, equal ones of them once; rows with a null doc_id stay."""
    own, place = "_kept", "_place"
    while {own.lower(), place.lower()} & {c.lower() for c in docs.columns}:
        own, place = own + "_", place + "_"
    kept = near_duplicates(docs, doc_id, text).where("kept and doc_id is not null").select(F.col("doc_id").alias(own)).distinct()
    # equal rows of one doc_id are in one partition after the join: texts are dealt once
    keyed = docs.withColumn(place, F.col(doc_id).cast("long"))
    stay = keyed.join(kept, F.col(place) == F.col(own), "left_semi")
    same = Window.partitionBy(place, text).orderBy(F.lit(1))
    stay = stay.withColumn(place, F.row_number().over(same)).where(F.col(place) == 1).drop(place)
    return stay.unionByName(docs.where(F.col(doc_id).isNull()))
