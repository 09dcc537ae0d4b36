"""Texts cut into chunks that byte-pair tokenizers encode independently of each other, and remembered results.

A chunk is a run of blanks and line ends followed by a run of anything else. Between two chunks stands, on the left, a
character that is no white space, and on the right a blank or a line end. Tokenizers that split by words never join
characters across such a place, so the tokens of a text are those of its chunks one after the other, and a task has
to encode each different chunk once only.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable

import numpy as np

# Characters that some library takes for white space, other than the blank and the line end. Behind them is no cut.
OTHER_SPACE = (
    "\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u180e\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009"
    "\u200a\u200b\u2028\u2029\u202f\u205f\u2060\u3000\ufeff"
)
_HAS_OTHER = re.compile(f"[{OTHER_SPACE}]")
_CHUNK = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
CACHE_KEYS = 400_000  # chunks that a task remembers
CACHE_VALUES = 4_000_000  # and values of them


def chunks(text: str) -> list[str]:
    """The chunks of ``text``; joined they are the text."""
    found = _CHUNK.findall(text)
    if not _HAS_OTHER.search(text):
        return found
    first = [i for i in range(len(found)) if not i or found[i - 1][-1] not in OTHER_SPACE]
    return ["".join(found[a:b]) for a, b in itertools.pairwise([*first, len(found)])]


def gather(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions first, first + 1, .. of runs of the given sizes, one run after the other."""
    ends = np.cumsum(size)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - ends + size, size)


class Numbers(dict):
    """Numbers for keys, given when a key is first looked up."""

    def __missing__(self, key: object) -> int:
        number = self[key] = len(self)
        return number


class Remembered:
    """Arrays of values per key, for example ids per chunk, grown as keys are met for the first time.

    ``learn`` gets new keys and returns, for each, the number of its values, and the values one after the other.
    """

    def __init__(self, learn: Callable[[list], tuple[np.ndarray, np.ndarray]], dtype: type = np.int32) -> None:
        self.learn = learn
        self.dtype = dtype
        self.forget()

    def forget(self) -> None:
        self.known = Numbers()
        self.size = np.zeros(0, np.int64)
        self.first = np.zeros(0, np.int64)
        self.values = np.zeros(1024, self.dtype)
        self.used = 0

    def codes(self, keys: list) -> np.ndarray:
        """The number of each key; new ones are learned together. A number holds until everything is forgotten."""
        at = len(self.known)
        found = np.fromiter(map(self.known.__getitem__, keys), np.int64, len(keys))
        missing = list(itertools.islice(reversed(self.known), len(self.known) - at))[::-1]
        if missing:
            size, values = self.learn(missing)
            self.first = np.concatenate((self.first, self.used + np.cumsum(size) - size))
            self.size = np.concatenate((self.size, size))
            if self.used + len(values) > len(self.values):
                grown = np.zeros(2 * (self.used + len(values)), self.dtype)
                grown[: self.used] = self.values[: self.used]
                self.values = grown
            self.values[self.used : self.used + len(values)] = values
            self.used += len(values)
        return found

    def full(self) -> bool:
        return len(self.known) > CACHE_KEYS or self.used > CACHE_VALUES
