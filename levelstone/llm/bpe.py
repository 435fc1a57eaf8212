"""Exact BPE encoding by dynamic programming over prefixes, and decoding.

For every prefix of a word there is exactly one token that ends its encoding. An automaton over the vocabulary
(Aho-Corasick: its failure links walk the suffixes of the prefix read so far) names the tokens that end at a position;
a token is that last one if the token before it, which is stored for the shorter prefix, is compatible with it. Back
pointers from the end give the ids. Two tokens are compatible if no merge across their border would come first: merges
happen in the order of rank, so a part on the border lives from its own merge to the merge that swallows it.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, released, ship, text_of, utf8_parts
from .runs import RunTable

#: White space as the normaliser's pattern has it; Python's own split() takes four control characters more.
_SPACE = regex.compile("[\t-\r \x85\xa0  -     　]+")
_NOT_SPACE = ("\x1c", "\x1d", "\x1e", "\x1f")
#: Different runs, words and pairs of tokens that a worker remembers; it changes speed, never results.
CACHE_RUNS, CACHE_WORDS, CACHE_PAIRS = 200_000, 30_000, 100_000
_FOREVER = 1 << 60


def _byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(others)) for b in range(256)]


class PrefixBPE:
    """Tokenizer of a byte-level vocabulary whose word ends carry a suffix, read from a tokenizers JSON text."""

    def __init__(self, spec: str):
        d = json.loads(spec)
        model = d["model"]
        vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {x["content"]: x["id"] for x in d["added_tokens"]}
        self.text = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        steps = d["pre_tokenizer"]["pretokenizers"]
        self.pieces = regex.compile(next(s["pattern"]["Regex"] for s in steps if s["type"] == "Split"))
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.symbols = _byte_symbols()
        self.rank: dict[tuple[int, int], int] = {}
        self.made = made = {}  # token: left part, right part, rank
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            t = vocab[a + b]
            self.rank.setdefault((vocab[a], vocab[b]), r)
            made.setdefault(t, (vocab[a], vocab[b], r))
        self._pairs: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        atoms = {*self.symbols, *(s + self.suffix for s in self.symbols)}
        for t, i in vocab.items():
            if t in atoms or (i in made and self._meets(made[i][0], made[i][1], made[i][2])):
                own = self._key(t)
                self.automaton.add_word(own, (i, len(own)))
        self.automaton.make_automaton()
        self._to_symbol = dict(enumerate(self.symbols))
        self._known: dict[str, list[int]] = {}

    def _key(self, token: str) -> str:
        """A token over the alphabet of symbols, in which a word's last symbol is a letter of its own."""
        if self.suffix and token.endswith(self.suffix):
            body = token[: -len(self.suffix)]
            return body[:-1] + chr(0x4000 + ord(body[-1])) if body else token
        return token

    def _border(self, t: int, side: int) -> list[tuple[int, int]]:
        """The parts of a token along one of its borders, each with the rank of the merge that swallows it."""
        out, end = [], _FOREVER
        while True:
            out.append((t, end))
            if t not in self.made:
                return out
            end = self.made[t][2]
            t = self.made[t][side]

    def _meets(self, a: int, b: int, before: int = _FOREVER) -> bool:
        """No merge across the border of a and b comes first (of rank under ``before``)."""
        left_of_b = self._border(b, 0)
        for x, x_end in self._border(a, 1):
            for y, y_end in left_of_b:
                r = self.rank.get((x, y))
                if r is not None and r < before and r < x_end and r <= y_end:
                    return False
        return True

    def word(self, symbols: str) -> list[int]:
        """Ids of one word, given as symbols."""
        n = len(symbols)
        last = [None] * (n + 1)
        pairs = self._pairs
        for end, (token, length) in self.automaton.iter(symbols):
            end += 1
            if last[end] is None:
                start = end - length
                if start:
                    before = last[start]
                    if before is None:
                        continue
                    k = before[0] << 20 | token
                    ok = pairs.get(k)
                    if ok is None:
                        if len(pairs) > CACHE_PAIRS:
                            pairs.clear()
                        ok = pairs[k] = self._meets(before[0], token)
                    if not ok:
                        continue
                last[end] = (token, start)
        out = []
        while n:
            token, n = last[n]
            out.append(token)
        return out[::-1]

    def _piece(self, piece: str) -> list[int]:
        ids = self._known.get(piece)
        if ids is None:  # odd texts and marks come here again and again, runs of letters once
            symbols = piece.encode().decode("latin-1").translate(self._to_symbol)
            if self.suffix:
                symbols = symbols[:-1] + chr(0x4000 + ord(symbols[-1]))
            ids = self.word(symbols)
            if len(piece) <= 64:
                if len(self._known) >= CACHE_WORDS:
                    self._known.clear()
                self._known[piece] = ids
        return ids

    def _segment(self, text: str) -> list[int]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # a final sigma is lowered like any other
        text = text.lower()
        if text.isascii() and text.isalpha():
            return self._piece(text)
        out = []
        for piece in self.pieces.findall(text):
            out += self._piece(piece)
        return out

    def chunk(self, chunk: str) -> list[int]:
        """Ids of a text without a cache; white space only parts words."""
        if self.cut and "<" in chunk:
            out = []
            for part in self.cut.split(chunk):
                out += [self.special[part]] if part in self.special else self._segment(part)
            return out
        return self._segment(chunk)

    def chunks(self, text: str) -> list[str]:
        if any(c in text for c in _NOT_SPACE):
            return [x for x in _SPACE.split(text) if x]
        return text.split()

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text."""
        out = []
        for chunk in self.chunks(text):
            out += self.chunk(chunk)
        return out

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by spaces: the vocabulary file names no decoder."""
        return " ".join(self.text[i] for i in ids if i in self.text)


class RunEncoder:
    """Encodes many texts at once: each different run of letters or marks goes through the dynamic program once."""

    def __init__(self, bpe: PrefixBPE):
        self.bpe = bpe
        self.table = RunTable(self._add, self._clear, CACHE_RUNS)

    def _clear(self) -> None:
        self.count, self.ids, self.tokens = np.zeros(0, np.int64), np.zeros(0, object), np.zeros(0, object)

    def _add(self, runs: list[bytes]) -> None:
        got = [self.bpe._segment(r.decode()) if r else [] for r in runs]
        n, ids, tokens = np.array([len(x) for x in got], np.int64), np.empty(len(got), object), np.empty(len(got), object)
        ids[:] = [" ".join(map(str, x)) for x in got]
        tokens[:] = [self.bpe.decode(x) for x in got]
        self.count, self.ids, self.tokens = (np.concatenate(x) for x in ((self.count, n), (self.ids, ids), (self.tokens, tokens)))

    def encode(self, raw: np.ndarray, off: np.ndarray):
        """(number of ids, ids as text, decoded text) of each text ``raw[off[i]:off[i+1]]``."""
        places, doc, odd = self.table.find(raw, off)
        cut = np.searchsorted(doc, np.arange(len(off)))
        n = np.concatenate(([0], np.cumsum(self.count[places])))
        ids, tokens = self.ids[places], self.tokens[places]
        for i in range(len(off) - 1):
            if odd[i]:
                got = self.bpe.encode(raw[off[i] : off[i + 1]].tobytes().decode())
                yield len(got), " ".join(map(str, got)), self.bpe.decode(got)
            else:
                a, b = cut[i], cut[i + 1]
                yield int(n[b] - n[a]), " ".join(ids[a:b].tolist()), " ".join(tokens[a:b].tolist())


@lru_cache(maxsize=2)
def _load(name: str) -> RunEncoder:
    with open(SparkFiles.get(name), encoding="utf-8") as f:
        return RunEncoder(PrefixBPE(f.read()))


def vocabulary_file(spark, path: str) -> str:
    """Send the vocabulary file to the executors once; its size is that of a vocabulary, not of the data."""
    ship(spark)
    name = path.rstrip("/").rsplit("/", 1)[-1]
    known = {str(f).rsplit("/", 1)[-1] for f in spark.sparkContext.listFiles}
    if name not in known:
        spark.sparkContext.addFile(path)
    return name


def encode_documents(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_tokens, ids_sha256, decoded_sha256; with ``keep_ids`` also ids and decoded.

    Null and empty texts, and texts of white space, have no tokens and the digests of the empty string. A null doc_id
    stays null; repeated rows give repeated rows; other columns are not read. Texts of any length are encoded whole.
    """
    name = vocabulary_file(docs.sparkSession, vocabulary)

    def run(batches):
        encoder = _load(name)
        for batch in batches:
            raw, off = utf8_parts(batch.column(1))
            rows = []
            for i, j in blocks(off):
                for n, ids, decoded in encoder.encode(raw[off[i] : off[j]], off[i : j + 1] - off[i]):
                    digests = [hashlib.sha256(x.encode()).hexdigest() for x in (ids, decoded)]
                    rows.append((n, *digests, *(([int(x) for x in ids.split()], decoded) if keep_ids else ())))
            kinds = (pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string())
            columns = [pa.array([r[k] for r in rows], kinds[k]) for k in range(5 if keep_ids else 3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if keep_ids else [])]
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if keep_ids else "")
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(docs, text).alias("text")).mapInArrow(released(run), schema)
