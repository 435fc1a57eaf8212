"""Runs of letters and of other marks in many texts at once, each different run tokenized once.

A run is a stretch of ASCII letters and bytes from 128 on, or of other bytes that are no white space. The vocabularies'
pattern never joins the two kinds, with two exceptions that make a run odd: marks with an apostrophe (which takes
letters along) or with the beginning of a special token, and letter runs with characters that are no letters. A text
with an odd run is tokenized whole. ASCII letters are lower-cased in a run's identity, as the vocabulary's normaliser does.

Runs are told apart by both halves of their identity (see ``wordhash``) and their length: up to 16 bytes these are the
run itself, beyond that a 128-bit digest. A text with a run that meets another one under the same first half is
tokenized whole, so a collision can't change any id.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .wordhash import identities, lowered

_CLASS = np.full(256, 2, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def split(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(identity's halves, text number, start byte, end byte) of each run."""
    size = len(raw)
    if not size:
        z, u = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return u, u, z, z, z
    kind = _CLASS[raw]
    change = np.ones(size, bool)
    change[1:] = kind[1:] != kind[:-1]
    edges = off[1:-1]
    change[edges[edges < size]] = True
    start = np.flatnonzero(change)
    end = np.append(start[1:], size)
    solid = kind[start] > 0
    start, end = start[solid], end[solid]
    a, b = identities(lowered(raw), start, end)
    return a, b, np.searchsorted(off, start, side="right") - 1, start, end


def is_odd(run: bytes) -> bool:
    if run.isalpha():  # ASCII letters
        return False
    if run[0] < 128 and not run[:1].isalpha():
        return b"'" in run or b"<" in run
    text = run.decode("utf-8", "replace")
    return not (text.isalpha() and text.lower().isalpha())  # lower case can bring a mark of its own


class RunTable:
    """Place of each different run seen so far. ``add`` takes new runs and keeps what they become; after ``limit`` runs
    the table starts anew, which costs time and changes nothing else."""

    def __init__(self, add: Callable[[list[bytes]], None], clear: Callable[[], None], limit: int):
        self.add, self.clear, self.limit = add, clear, limit
        self._start()

    def _start(self) -> None:
        self.keys, self.checks, self.lengths = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.place, self.odd = np.zeros(0, np.int64), np.zeros(0, bool)
        self.clear()

    def find(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of each run, its text, whether a text must be tokenized whole) of the texts ``raw[off[i]:off[i+1]]``."""
        key, check, doc, start, end = split(raw, off)
        if len(self.keys) > self.limit:
            self._start()
        different, first, back = np.unique(key, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, different)
        at[at == len(self.keys)] = 0
        known = self.keys[at] == different if len(self.keys) else np.zeros(len(different), bool)
        if not known.all():
            new = np.flatnonzero(~known)
            data = raw.tobytes()
            a, b = start[first[new]], end[first[new]]
            runs = [data[i:j] for i, j in zip(a.tolist(), b.tolist())]
            odd = np.array([is_odd(r) for r in runs])
            self.add([b"" if o else r for r, o in zip(runs, odd)])
            keys = np.concatenate((self.keys, different[new]))
            order = np.argsort(keys, kind="stable")
            self.keys = keys[order]
            self.checks = np.concatenate((self.checks, check[first[new]]))[order]
            self.lengths = np.concatenate((self.lengths, b - a))[order]
            self.place = np.concatenate((self.place, np.arange(len(self.odd), len(self.odd) + len(new))))[order]
            self.odd = np.concatenate((self.odd, odd))
            at = np.searchsorted(self.keys, different)
        at = at[back]
        places = self.place[at] if len(different) else np.zeros(0, np.int64)
        strange = np.zeros(len(off) - 1, bool)
        if len(different):
            strange[doc[self.odd[places] | (self.checks[at] != check) | (self.lengths[at] != end - start)]] = True
        return places, doc, strange
