"""Token ids of Arrow text columns by the tokenizers library, each distinct piece of text encoded once.

A text is cut where both tokenizers of this package split in any case, so the pieces' ids, joined, are the text's
ids (tests hold this against whole texts): where white space begins after another character, and between an ASCII
letter or digit and an ASCII punctuation mark other than an apostrophe. Next to what may be white space beyond
ASCII nothing is cut. The tokenizer is used as its file has it: the string of an added token, such as <|endoftext|>,
is one id wherever it stands in a text, so it is a piece of its own, and what stands before and after it are cut off.
"""

from __future__ import annotations

import os
import re
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa

from riskloom.llm.words import _buffers, dictionary, process_cache

#: Pieces remembered by a worker process, twice over: those of late, and those before them.
REMEMBERED = 250_000
#: Text encoded at once: repeats within it cost nothing.
ENCODED_BYTES = 8 << 20
#: Bytes that some white space beyond ASCII has before its last byte.
BEFORE_LAST = bytes([0x80, 0x81, 0x9A, 0xC2])


def _flags(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


ALNUM = _flags(bytes(b for b in range(128) if chr(b).isalnum()))
MARK = _flags(bytes(b for b in range(0x21, 0x7F) if not chr(b).isalnum() and b != ord("'")))
WHITE = _flags(b"\x20\t\n\v\f\r")
SOLID = ~_flags(b"\x20\t\n\v\f\r\x1c\x1d\x1e\x1f")
DOUBTFUL = _flags(BEFORE_LAST)


class Encoder:
    """Encodes texts; made in a task from the path of a tokenizer file that every machine has."""

    def __init__(self, path: str, end: int | None = None) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the cores already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        #: Nothing is cut where an added token takes in what stands around it or is known by a normalised form.
        self.plain = not any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added)
        strings = sorted((t.content.encode() for t in added), key=len, reverse=True)
        self.added = re.compile(b"|".join(map(re.escape, strings))) if strings else None
        self.end = end
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    @classmethod
    def of_process(cls, path: str, end: int | None = None) -> Encoder:
        """One encoder for all tasks that a worker process runs: what it has learnt of the words is of use to later tasks."""
        home = process_cache()
        if (path, end) not in home:
            home[path, end] = cls(path, end)
        return home[path, end]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's ids begin (and the end). Nulls are empty; ``end`` follows every text."""
        offsets, data = _buffers(texts)
        offsets = offsets - offsets[0]
        if self.plain:
            at = _cuts(np.frombuffer(data, np.uint8), offsets, self._added_in(data, offsets))
        else:
            at = np.unique(offsets[:-1][offsets[:-1] < len(data)])
        pieces, distinct = dictionary(data, np.append(at, len(data)))
        bounds = np.searchsorted(at, offsets)
        bounds[offsets >= len(data)] = len(at)
        coded = self._coded(distinct.to_numpy(zero_copy_only=False).tolist())
        if self.end is not None:
            pieces = np.insert(pieces, bounds[1:], len(coded))
            bounds = bounds + np.arange(len(bounds))
            coded.append(self.end.to_bytes(4, "little"))
        if not len(pieces):
            return np.zeros(0, "<u4"), np.zeros(len(bounds), np.int64)
        # The pieces' ids as bytes, one after another, are the values of the array that take makes of them.
        _, ends, flat = pa.array(coded, pa.large_binary()).take(pa.array(pieces)).buffers()
        ends = np.frombuffer(ends, np.int64, len(pieces) + 1) >> 2
        return np.frombuffer(flat, "<u4", int(ends[-1])), ends[bounds]

    def _added_in(self, data: bytes, offsets: np.ndarray) -> list[tuple[int, int]]:
        """Where added tokens stand, none of them across two texts."""
        out, at = [], 0
        while self.added is not None and (m := self.added.search(data, at)):
            a, b = m.span()
            if offsets[np.searchsorted(offsets, a, side="right")] < b:
                at = a + 1
            else:
                out.append((a, b))
                at = b
        return out

    def _coded(self, pieces: list[bytes]) -> list[bytes]:
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        new = []
        for p in filterfalse(known.__contains__, pieces):
            if p in older:
                known[p] = older[p]
            else:
                new.append(p)
        if new:
            ids = [e.ids for e in self.tokenizer.encode_batch_fast([p.decode() for p in new], add_special_tokens=False)]
            ends = np.cumsum([0, *map(len, ids)]) * 4
            flat = np.fromiter(chain.from_iterable(ids), "<u4", int(ends[-1]) // 4).tobytes()
            known.update(zip(new, map(flat.__getitem__, map(slice, ends[:-1].tolist(), ends[1:].tolist())), strict=True))
        return list(map(known.__getitem__, pieces))


def _cuts(raw: np.ndarray, offsets: np.ndarray, added: list[tuple[int, int]]) -> np.ndarray:
    """Where pieces begin; each of the places in ``added`` is a piece."""
    cut = np.zeros(len(raw), bool)
    if len(raw) > 1:
        before, here = raw[:-1], raw[1:]
        solid = SOLID[before]
        solid[1:] &= ~(DOUBTFUL[before[:-1]] & (before[1:] >= 0x80))
        cut[1:] = (WHITE[here] & solid) | (MARK[here] & ALNUM[before])
    for a, b in added:
        cut[a:b] = False
        cut[a] = True
        cut[b : b + 1] = True
    cut[offsets[:-1][offsets[:-1] < len(raw)]] = True
    return np.flatnonzero(cut)
