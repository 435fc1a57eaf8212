"""Passages that repeat across documents, found with a sparse suffix array.

Every window of ``min_words`` words keeps one suffix: the first of its ``min_words - prefix + 1`` beginnings at which the
hash of the next ``GRAM`` words is least, a choice that the window's content alone makes. Neighbouring windows keep the
same suffix, so about one position in thirteen stays, and equal windows keep it at the same place. A kept suffix knows
how far its windows reach: ``lo`` to ``hi`` words to its left, and ``min_words`` words from there.

The suffixes are sorted across the cluster by their first ``prefix`` words, then by all words that their windows reach,
and neighbours are compared in the sorted stream. A suffix whose prefix no other document holds drops out. Suffixes of two
documents that agree in all their words are repeated as they are. For what is left, the words themselves are fetched,
sorted as text, and neighbours are extended: to the right by the words that they share in this order, to the left by the
words that they share in the order of their reversed left sides. A window is repeated if its words to the right and to
the left are those of a suffix of another document. Repeated windows are merged into spans.

Tables are cut into pieces of bounded size. A prefix that goes on beyond its piece, however many documents hold it, is
decided apart: its suffixes are sorted by their left sides first, where neighbours say how far to the left any match can
reach, then by their right sides. Windows that reach no further than some neighbour on both sides are few; what one piece
can't decide of them leaves as digests, one for each different window, which are combined map-side.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, blocks, partitions, released, ship, text_of, utf8_parts
from .wordhash import gram, lowered, ranges, words

MIN_WORDS, PREFIX, GRAM = 50, 25, 8
#: Rows that a task holds at once: suffixes without words, and with words.
PIECE, WORD_PIECE = 50_000, 10_000

_SUFFIX = "key long, ctx long, doc long, pos int, lo short, hi short"
_FOUND = _SUFFIX + ", many boolean, state string"


def _batch(columns: dict[str, tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns.values()], list(columns))


def _kept(h: np.ndarray, doc: np.ndarray, min_words: int, prefix: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, first window, last window) of each kept suffix; windows are numbered by their first word."""
    n = len(h) - min_words + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3
    span = min_words - prefix + 1
    at = np.arange(n) + sliding_window_view(gram(h, GRAM), span)[:n].argmin(axis=1)
    windows = np.flatnonzero(doc[:n] == doc[min_words - 1 :])
    at = at[windows]
    # the choice moves to the right with the window, so a suffix's windows are a run
    new = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1]))) if len(at) else np.zeros(0, np.int64)
    last = np.append(new[1:], len(at))[: len(new)] - 1
    return at[new], windows[new], windows[last]


def _suffixes(min_words: int, prefix: int):
    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            raw, off = utf8_parts(batch.column(1))
            for i, j in blocks(off):
                h, _, doc, _, _ = words(raw[off[i] : off[j]], off[i : j + 1] - off[i])
                pos, first, last = _kept(h, doc, min_words, prefix)
                if len(pos):
                    key = ranges(h, pos, pos + prefix).view(np.int64)
                    ctx = ranges(h, first, last + min_words).view(np.int64)
                    here = pos - np.searchsorted(doc, doc[pos])
                    yield _batch({"key": (key, pa.int64()), "ctx": (ctx, pa.int64()), "doc": (ids[i + doc[pos]], pa.int64()), "pos": (here.astype(np.int32), pa.int32()), "lo": ((pos - last).astype(np.int16), pa.int16()), "hi": ((pos - first).astype(np.int16), pa.int16())})

    return run


def _pieces(batches, limit: int, breaks):
    """(table, open to the left, open to the right) of a sorted stream, cut where a run ends (``breaks(table)``: rows that
    begin one). A run that is longer than a piece is cut inside; then both sides are open there."""
    held, size, left = [], 0, True
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size < limit:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        begin = breaks(table)
        cut = int(begin[-1]) if len(begin) > 1 else len(table)
        yield table.slice(0, cut), left, cut == len(table)
        left = cut == len(table)
        rest = table.slice(cut).combine_chunks()
        held, size = rest.to_batches() if len(rest) else [], len(rest)
    if held:
        yield pa.Table.from_batches(held).combine_chunks(), left, True


def _begins(*columns: np.ndarray) -> np.ndarray:
    new = np.ones(len(columns[0]), bool)
    new[1:] = False
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _neighbours(limit: int):
    """Compare neighbours in one sorted part. States of the rows given out: ``equal``, all windows of this suffix are
    repeated; ``extend``, its windows are open (``many``: it stands for equal suffixes of several documents, which are
    given out as well); ``edge``, the same in a prefix that may go on in another piece."""

    def run(batches):
        for table, left, right in _pieces(batches, limit, lambda t: np.flatnonzero(_begins(t["key"].to_numpy()))):
            key, ctx, doc = (table[c].to_numpy() for c in ("key", "ctx", "doc"))
            prefix, whole = np.cumsum(_begins(key)) - 1, np.cumsum(_begins(key, ctx)) - 1
            first = np.flatnonzero(_begins(whole))
            last = np.append(first[1:], len(whole)) - 1
            many = doc[first] != doc[last]  # of each group of equal suffixes
            outer = np.array([left] + [False] * prefix[-1])
            outer[-1] |= right
            groups = np.bincount(prefix[first])
            least, most = (np.full(len(groups), x, np.int64) for x in (np.iinfo(np.int64).max, np.iinfo(np.int64).min))
            np.minimum.at(least, prefix[first], doc[first])
            np.maximum.at(most, prefix[first], doc[last])
            single = np.bincount(prefix[first], ~many) > 0
            wanted = outer | ((groups > 1) & single & (least != most))
            alone = ~many[whole]
            is_first = _begins(whole)
            asked = wanted[prefix] & (alone | is_first)
            for rows, state in ((np.flatnonzero(many[whole]), "equal"), (np.flatnonzero(asked & ~outer[prefix]), "extend"), (np.flatnonzero(asked & outer[prefix]), "edge")):
                if len(rows):
                    out = table.take(pa.array(rows))
                    out = out.append_column("many", pa.array(~alone[rows] if state != "equal" else np.zeros(len(rows), bool))).append_column("state", pa.array([state]).take(pa.array(np.zeros(len(rows), np.int32))))
                    yield from out.to_batches()

    return run


def _settled(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(equal suffixes, suffixes to extend) of what neighbours gave out, prefixes of several pieces included."""
    edge = found.where("state = 'edge'").drop("state")
    whole = edge.groupBy("key", "ctx").agg((F.bool_or("many") | (F.min("doc") != F.max("doc"))).alias("together"), F.min(F.struct("doc", "pos", "lo", "hi")).alias("one"))
    met = edge.join(whole.select("key", "ctx", "together"), ["key", "ctx"])
    equal = found.where("state = 'equal'").select("doc", "pos", "lo", "hi").unionByName(met.where("together and not many").select("doc", "pos", "lo", "hi"))
    columns = ["key", "ctx", "doc", "pos", "lo", "hi", "many"]
    together = whole.where("together").select("key", "ctx", "one.*", F.lit(True).alias("many"))
    open_ = met.where("not together").select(columns).unionByName(together.select(columns))
    return equal, found.where("state = 'extend'").select(columns).unionByName(open_.select(columns))


_WORDS = "key long, head binary, tail binary, left binary, doc long, pos int, lo short, hi short, many boolean"


def _fetch(min_words: int, prefix: int):
    """Words to the right of suffixes, the prefix (head) apart from the rest (tail), and to the left, reversed. Rows of a document: its suffixes, then its texts."""

    def spelled(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The words in the given order, each with one space behind, and where each begins."""
        length = end - start + 1
        at = np.concatenate(([0], np.cumsum(length)))
        source = np.repeat(start - at[:-1], length) + np.arange(at[-1])
        out = low[source]
        out[at[1:] - 1] = 32
        return out.tobytes(), at

    def emit(texts, asked):
        raw = np.frombuffer(b"".join(texts), np.uint8)
        off = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        h, _, doc, start, end = words(raw, off)
        if not len(h):
            return
        low = lowered(raw)
        ahead, at = spelled(low, start, end)
        back, back_at = spelled(low, start[::-1], end[::-1])
        base = np.searchsorted(doc, np.arange(len(texts) + 1))
        sizes = [len(a) for a in asked]
        own = np.repeat(np.arange(len(texts)), sizes)
        ids, pos, lo, hi, many, ctx, key = np.concatenate([np.array(rows, np.int64) for rows in asked]).T
        p = base[own] + pos
        first, last = p - hi, p - lo + min_words
        fit = (first >= base[own]) & (last <= base[own + 1])
        p, first, last, ids, pos, lo, hi, many, ctx, key = (x[fit] for x in (p, first, last, ids, pos, lo, hi, many, ctx, key))
        same = ranges(h, first, last).view(np.int64) == ctx  # rows of one doc_id may have several texts
        p, first, last, ids, pos, lo, hi, many, key = (x[same] for x in (p, first, last, ids, pos, lo, hi, many, key))
        n = len(h)
        head = [ahead[a:b] for a, b in zip(at[p].tolist(), at[p + prefix].tolist())]
        tail = [ahead[a:b] for a, b in zip(at[p + prefix].tolist(), at[last].tolist())]
        left = [back[a:b] for a, b in zip(back_at[n - p].tolist(), back_at[n - first].tolist())]
        yield _batch({"key": (key, pa.int64()), "head": (head, pa.binary()), "tail": (tail, pa.binary()), "left": (left, pa.binary()), "doc": (ids, pa.int64()), "pos": (pos.astype(np.int32), pa.int32()), "lo": (lo.astype(np.int16), pa.int16()), "hi": (hi.astype(np.int16), pa.int16()), "many": (many.astype(bool), pa.bool_())})

    def run(batches):
        doc, rows, texts, asked, size = None, [], [], [], 0
        for batch in batches:
            columns = {c: batch.column(i).to_pylist() if c != "text" else batch.column(i) for i, c in enumerate(batch.schema.names)}
            for i, d in enumerate(columns["doc"]):
                if d != doc:
                    doc, rows = d, []
                if columns["pos"][i] is not None:
                    rows.append((d, columns["pos"][i], columns["lo"][i], columns["hi"][i], columns["many"][i], columns["ctx"][i], columns["key"][i]))
                elif rows:
                    texts.append(columns["text"][i].as_buffer().to_pybytes())
                    asked.append(rows)
                    size += len(texts[-1]) + 400 * len(rows)
                    if size > 1 << 20:
                        yield from emit(texts, asked)
                        texts, asked, size = [], [], 0
        if texts:
            yield from emit(texts, asked)

    return run


def _shared_words(a: bytes, b: bytes) -> int:
    """Words that both begin with, each with its space."""
    lo, hi = 0, min(len(a), len(b))
    if a[:hi] == b[:hi]:
        lo = hi
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return a.count(b" ", 0, lo)


def _shared(column: list[bytes]) -> np.ndarray:
    """Words that each shares with the one before; -1 for the first."""
    return np.array([-1, *(_shared_words(a, b) for a, b in zip(column, column[1:]))])


def _window(head: bytes, tail: bytes, left: bytes, i: int, more: int) -> list[int]:
    """Digest of the window with ``i`` words to the left and ``more`` behind the prefix, as two longs."""
    text = b" ".join(left.split(b" ", i)[:i]) + b"\n" + head + b" ".join(tail.split(b" ", more)[:more])
    d = hashlib.blake2b(text, digest_size=16).digest()
    return [int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)]


class _Piece:
    """Suffixes with their words, sorted by prefix and by what follows it, and what neighbours share on either side."""

    def __init__(self, table: pa.Table, min_words: int, prefix: int):
        self.min_words, self.prefix, self.n = min_words, prefix, len(table)
        self.head, self.tail, self.left = (table[c].to_pylist() for c in ("head", "tail", "left"))
        self.doc, self.pos, self.lo, self.hi, self.many = (table[c].to_numpy() for c in ("doc", "pos", "lo", "hi", "many"))
        new = np.array([True, *(a != b for a, b in zip(self.head, self.head[1:]))])
        self.run = np.cumsum(new) - 1
        self.ahead = np.where(new, -1, prefix + _shared(self.tail))
        runs, left = self.run.tolist(), self.left
        order = np.array(sorted(range(self.n), key=lambda k: (runs[k], left[k])))
        self.back = np.where(_begins(self.run[order]), -1, _shared([left[k] for k in order]))
        self.place = np.empty(self.n, np.int64)
        self.place[order] = np.arange(self.n)

    def groups(self, lo: np.ndarray, hi: np.ndarray):
        """For each ``i``: rows with lo <= i <= hi in the order of equal windows, the group of each, the first row of each
        group, its least and greatest document, and whether several documents hold it."""
        for i in range(self.min_words - self.prefix + 1):
            rows = np.flatnonzero((lo <= i) & (i <= hi))
            if len(rows):
                same = (np.cumsum(self.ahead < self.min_words - i) * (self.n + 1) + np.cumsum(self.back < i)[self.place])[rows]
                by = np.lexsort((self.doc[rows], same))
                rows, same = rows[by], same[by]
                new = _begins(same)
                first, group = np.flatnonzero(new), np.cumsum(new) - 1
                least, most = self.doc[rows[first]], self.doc[rows[np.append(first[1:], len(rows)) - 1]]
                yield i, rows, group, first, least, most, (least != most) | (np.bincount(group, self.many[rows]) > 0)

    def windows(self, hit: np.ndarray) -> dict:
        """Runs of repeated windows, ``hit[row, i]``, as columns."""
        edge = np.diff(np.pad(hit.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        (row, low), (_, high) = np.nonzero(edge == 1), np.nonzero(edge == -1)
        return {"doc": (self.doc[row], pa.int64()), "first": ((self.pos[row] - high + 1).astype(np.int32), pa.int32()), "last": ((self.pos[row] - low).astype(np.int32), pa.int32())}


def _full(columns: dict, schema: list[tuple]) -> pa.RecordBatch:
    """A batch of the schema; columns that aren't given are null."""
    n = len(next(iter(columns.values()))[0])
    return _batch({c: columns.get(c, ([None] * n, t)) for c, t in schema})


def _extend(min_words: int, prefix: int, limit: int):
    """Repeated windows (doc, first, last), and all suffixes of prefixes that may go on in another piece, as they came."""

    def breaks(table):
        return np.flatnonzero(_begins(table["key"].to_numpy()))

    def run(batches):
        for table, open_left, open_right in _pieces(batches, limit, breaks):
            key = np.cumsum(_begins(table["key"].to_numpy())) - 1
            outer = np.array([open_left] + [False] * key[-1])
            outer[-1] |= open_right
            outer = outer[key]
            schema = [("doc", pa.int64()), ("first", pa.int32()), ("last", pa.int32())] + [(f.name, f.type) for f in table.schema if f.name != "doc"]
            if outer.any():
                rows = table.filter(pa.array(outer))
                yield _full({c: (rows[c].combine_chunks(), rows[c].type) for c in rows.column_names}, schema)
            if not outer.all():
                piece = _Piece(table.filter(pa.array(~outer)), min_words, prefix)
                hit = np.zeros((piece.n, min_words - prefix + 1), bool)
                for i, rows, group, _, _, _, together in piece.groups(piece.lo, piece.hi):
                    hit[rows, i] = together[group] & ~piece.many[rows]
                yield _full(piece.windows(hit), schema)

    return run


_EXTENDED = "doc long, first int, last int, " + _WORDS.replace("doc long, ", "")


def _reach(prefix: int):
    """Suffixes sorted by prefix and left side, with the most words that any other one shares there, or all where a
    neighbour lies in another part; those whose windows need more than that drop out."""

    def run(batches):
        before = None
        held = None
        for batch in [*batches, None]:
            if batch is not None and not batch.num_rows:
                continue
            if held is not None:
                head, left = held.column("head").to_pylist(), held.column("left").to_pylist()
                nxt = (batch.column("head")[0].as_py(), batch.column("left")[0].as_py()) if batch is not None else None
                heads, lefts = [before[0] if before else None, *head, nxt[0] if nxt else None], [before[1] if before else b"", *left, nxt[1] if nxt else b""]
                met = np.array([1 << 14 if a is None or b is None else _shared_words(x, y) if a == b else 0 for a, b, x, y in zip(heads, heads[1:], lefts, lefts[1:])])
                reach = np.maximum(met[:-1], met[1:])
                top = np.minimum(reach, held.column("hi").to_numpy())
                keep = top >= held.column("lo").to_numpy()
                out = held.append_column("top", pa.array(top.astype(np.int16)))
                yield out.filter(pa.array(keep))
                before = head[-1], left[-1]
            held = batch

    return run


_DECIDED = "doc long, first int, last int, d1 long, d2 long, least long, most long, together boolean"
_DECIDED_KINDS = [("doc", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("d1", pa.int64()), ("d2", pa.int64()), ("least", pa.int64()), ("most", pa.int64()), ("together", pa.bool_())]


def _decide(min_words: int, prefix: int, limit: int):
    """Windows of prefixes that go on over several pieces. Repeated ones as (doc, first, last); of those that one document
    alone holds here, the same with the window's digest; and each different window's documents (least, most, together)."""

    def run(batches):
        # any cut will do: all that a piece leaves open is handed on
        for table, _, _ in _pieces(batches, limit, lambda t: np.zeros(1, np.int64)):
            piece = _Piece(table, min_words, prefix)
            top = table["top"].to_numpy()
            most_right = np.maximum(piece.ahead, np.append(piece.ahead[1:], -1))
            most_right[0] = most_right[-1] = min_words  # neighbours elsewhere
            low = np.maximum(piece.lo, min_words - most_right)
            hit = np.zeros((piece.n, min_words - prefix + 1), bool)
            for i, rows, group, first, least, most, together in piece.groups(low, top):
                hit[rows, i] = together[group] & ~piece.many[rows]
                digests = np.array([_window(piece.head[k], piece.tail[k], piece.left[k], i, min_words - i - prefix) for k in rows[first]], np.int64)
                yield _full({"d1": (digests[:, 0], pa.int64()), "d2": (digests[:, 1], pa.int64()), "least": (least, pa.int64()), "most": (most, pa.int64()), "together": (together, pa.bool_())}, _DECIDED_KINDS)
                alone = ~together[group]
                start, own = (piece.pos[rows[alone]] - i).astype(np.int32), digests[group[alone]]
                yield _full({"doc": (piece.doc[rows[alone]], pa.int64()), "first": (start, pa.int32()), "last": (start, pa.int32()), "d1": (own[:, 0], pa.int64()), "d2": (own[:, 1], pa.int64())}, _DECIDED_KINDS)
            yield _full(piece.windows(hit), _DECIDED_KINDS)

    return run


def repeated_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, prefix: int = PREFIX) -> DataFrame:
    """Spans of words that lie in a passage of ``min_words`` words or more found in another document as well.

    Rows: doc_id, start_word, end_word (exclusive), n_words. Words are as in ``wordhash`` and count from 0. Repeats
    inside one document alone are no rows; copies of whole documents are. Null, empty and short texts have none, rows
    with a null doc_id take no part, an empty table gives no rows. Rows with one doc_id count as one document, whose
    positions are those of each row; its suffixes meet in one task. Texts of any length are read whole, one at a time.
    Other columns are not read. ``prefix`` must be ``GRAM`` words at least.
    """
    if not GRAM <= prefix <= min_words:
        raise ValueError("prefix must lie between GRAM and min_words")
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "passages")
    n = partitions(spark)
    source = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc"), text_of(docs, text).alias("text"))
    array = scratch.save(source.mapInArrow(released(_suffixes(min_words, prefix)), _SUFFIX), "suffixes")
    order = ["key", "ctx", "doc", "pos"]
    found = scratch.save(array.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(released(_neighbours(PIECE)), _FOUND), "neighbours")
    scratch.drop(array)
    equal, open_ = _settled(found)

    asked = open_.select("doc", F.lit(None).cast("binary").alias("text"), "pos", "lo", "hi", "many", "ctx", "key")
    texts = source.select("doc", F.col("text").cast("binary").alias("text"), *[F.lit(None).cast(t).alias(c) for c, t in (("pos", "int"), ("lo", "short"), ("hi", "short"), ("many", "boolean"), ("ctx", "long"), ("key", "long"))])
    together = asked.unionByName(texts).repartition(n, "doc").sortWithinPartitions("doc", F.col("pos").asc_nulls_last())
    spelled = scratch.save(together.mapInArrow(released(_fetch(min_words, prefix)), _WORDS), "words")
    order = ["key", "head", "tail", "left", "doc", "pos"]
    by_prefix = spelled.repartitionByRange(n, "key", "doc", "pos").sortWithinPartitions(*order)
    extended = scratch.save(by_prefix.mapInArrow(released(_extend(min_words, prefix, WORD_PIECE)), _EXTENDED), "extended")
    scratch.drop(spelled)
    wide = extended.where("key is not null").select("key", "head", "tail", "left", "doc", "pos", "lo", "hi", "many")
    by_left = wide.repartitionByRange(n, "key", "left", "tail", "doc", "pos").sortWithinPartitions("key", "head", "left", "tail", "doc", "pos")
    reached = scratch.save(by_left.mapInArrow(released(_reach(prefix)), _WORDS + ", top short"), "reached")
    by_right = reached.repartitionByRange(n, "key", "tail", "left", "doc", "pos").sortWithinPartitions(*order)
    decided = scratch.save(by_right.mapInArrow(released(_decide(min_words, prefix, WORD_PIECE)), _DECIDED), "decided")
    scratch.drop(reached)
    held = decided.where("least is not null").groupBy("d1", "d2").agg((F.bool_or("together") | (F.min("least") != F.max("most"))).alias("together"))
    late = decided.where("d1 is not null and doc is not null").join(held.where("together"), ["d1", "d2"], "left_semi")

    windows = equal.select("doc", (F.col("pos") - F.col("hi")).alias("first"), (F.col("pos") - F.col("lo")).alias("last"))
    windows = windows.unionByName(extended.where("key is null").select("doc", "first", "last"))
    windows = windows.unionByName(decided.where("d1 is null").select("doc", "first", "last")).unionByName(late.select("doc", "first", "last"))
    before = Window.partitionBy("doc").orderBy("first", "last")
    reached = F.max("last").over(before.rowsBetween(Window.unboundedPreceding, -1))
    spans = windows.withColumn("new", F.when(F.col("first") <= reached + min_words, 0).otherwise(1)).withColumn("span", F.sum("new").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    spans = spans.groupBy("doc", "span").agg(F.min("first").alias("start_word"), (F.max("last") + min_words).alias("end_word"))
    return spans.select(F.col("doc").alias("doc_id"), F.col("start_word").cast("int").alias("start_word"), F.col("end_word").cast("int").alias("end_word"), (F.col("end_word") - F.col("start_word")).cast("int").alias("n_words"))
