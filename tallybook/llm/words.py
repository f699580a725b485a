"""Words of texts as keys, and what was made of them lately: for tokenizers to which white space is a boundary."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np

#: Words in a generation, without another number given. Two are kept, so a worker holds twice as many at most.
GENERATION = 300_000
#: A stop or comma between a letter and white space is a piece of its own.
STOP = re.compile(rb"[.,](?<=[a-z][.,])(?=[ \n])")
#: Texts whose normal form only has other letters than they have where a capital is put in lower case.
WESTERN = re.compile("[\x00-\x7f\u00c0-\u00ff]*")


def word_keys(text: str) -> list[bytes]:
    """The words between ASCII white space, in an order that keeps the text's pieces.

    Where it can't change any piece, A-Z are put in lower case and a stop or comma after a letter stands alone, so that
    more words are the same. It can where special tokens may be written out or where marks combine with letters.
    """
    data = text.encode()
    if b"<|" in data or b"\xcc" in data or b"\xcd" in data:
        return data.split()
    return STOP.sub(rb" \g<0>", data.lower()).split()


class RecentWords:
    """The ids of recent words, as bytes of 32-bit integers. make is asked for those that are in neither generation."""

    def __init__(self, make: Callable[[list[bytes]], list[bytes]], generation: int = GENERATION):
        self.make, self.generation, self.young, self.old = make, generation, {}, {}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        docs, young, old = [word_keys(t) for t in texts], self.young, self.old
        new = [w for w in set().union(*docs) if w not in young]
        if old:
            young.update([(w, old[w]) for w in new if w in old])
            new = [w for w in new if w not in old]
        young.update(zip(new, self.make(new)))
        found = [np.frombuffer(b"".join(map(young.__getitem__, d)), "<i4") for d in docs]
        if len(young) > self.generation:
            self.old, self.young = young, {}
        return found
