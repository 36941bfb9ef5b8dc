"""Encoding texts fragment by fragment with a tokenizer of the tokenizers library.

A text is cut where no token can lie across the cut and where the cut does not
change how the library splits what lies on either side.  Fragments repeat, so
each is encoded once per worker and looked up afterwards by a 64-bit hash of its
bytes; the ids of a text are the concatenation of its fragments' ids.  Cuts, hashes
and ids of many texts are found at once, with numpy.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa

from quire.llm.batch_bpe import WIDEST, BatchBPE
from quire.llm.words import span_hashes, text_bytes

#: Fragments and ids that a worker remembers before it starts afresh.
CACHE_ENTRIES, CACHE_IDS = 800_000, 1 << 24

_BREAK = np.zeros(256, dtype=bool)
_BREAK[[32, 9, 10, 11, 12, 13]] = True


class WordCuts:
    """The runs between ASCII white space, for tokenizers that drop white space."""

    whole = False

    def bytes(self, raw: np.ndarray) -> np.ndarray:
        """Where a fragment begins, but for the beginnings of texts."""
        inside = ~_BREAK[raw]
        out = inside.copy()
        out[1:] &= ~inside[:-1]
        return out

    def odd(self, text: str) -> list[str] | None:
        """No text must be cut in another way."""
        return None


class ForcedBoundaries:
    """Cuts at byte pairs that occur inside no token of a byte-level vocabulary.

    No token can lie across such a pair, so merges on its two sides never meet.
    Only those pairs are used at which the pre-tokenizer, too, splits the two
    sides as it would split the whole:

    * the right byte is ASCII white space (white space never follows anything
      else inside a piece; inside a run of white space the run is cut in both
      cases before its last character), or
    * the left byte is printable ASCII and the right byte starts a character and
      is no apostrophe (a piece that is cut goes on as a piece of its own class;
      an apostrophe might begin a contraction).

    A cut between white space and what follows it is never used: how the run is
    split depends on what follows.  Special tokens are set apart beforehand.
    """

    def __init__(self, tokens: list[bytes], specials: list[str]):
        inside = np.zeros((256, 256), dtype=bool)
        for t in tokens:
            if len(t) > 1:
                b = np.frombuffer(t, dtype=np.uint8)
                inside[b[:-1], b[1:]] = True
        left, right = np.meshgrid(np.arange(256), np.arange(256), indexing="ij")
        space = (right == 32) | ((right >= 9) & (right <= 13))
        starts = (right < 0x80) | (right >= 0xC0)
        printable = (left > 32) & (left < 127) & (right != 39) & starts
        self.table = (~inside & (space | printable)).reshape(-1)
        self.specials = re.compile("(" + "|".join(map(re.escape, specials)) + ")") if specials else None

    whole = True

    def bytes(self, raw: np.ndarray) -> np.ndarray:
        """Where a fragment begins, but for the beginnings of texts."""
        out = np.zeros(len(raw), dtype=bool)
        b = raw.astype(np.uint16)
        out[1:] = self.table[(b[:-1] << 8) | b[1:]]
        return out

    def odd(self, text: str) -> list[str] | None:
        """The fragments of a text that holds special tokens."""
        if not self.specials or not self.specials.search(text):
            return None
        out: list[str] = []
        for k, part in enumerate(self.specials.split(text)):
            out += [part] if k % 2 else self(part)
        return out

    def __call__(self, text: str) -> list[str]:
        """The fragments of a text without special tokens."""
        raw = text.encode()
        at = np.flatnonzero(self.bytes(np.frombuffer(raw, np.uint8))).tolist()
        return [raw[i:j].decode() for i, j in zip([0, *at], [*at, len(raw)])] if raw else []


#: A piece that a byte-level tokenizer never splits before merging, and marks behind it that it splits off.
_PLAIN = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]*)")


class FragmentEncoder:
    """``encode(texts)`` gives the ids of each text, as the library would.

    New fragments that are one run of letters, perhaps with marks behind it, are
    merged in bulk by :class:`quire.llm.batch_bpe.BatchBPE`; all others are encoded
    by the library itself.
    """

    def __init__(self, path: str, cuts: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        if cuts == "forced":
            self.token_bytes, specials = byte_vocabulary(path)
            plain = [t for t in self.token_bytes if t is not None]
            self.cut = ForcedBoundaries(plain, specials)
        else:
            self.cut = {"words": WordCuts}[cuts]()
        self.lower = cuts == "words"
        self.bulk = BatchBPE(path)
        self.marks: dict[str, list[int]] = {"": []}
        self._forget()

    def _forget(self) -> None:
        self.known: dict[int, int] = {}
        self.ids, self.first, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        raw, offsets = text_bytes(pa.array(texts, pa.large_string()))
        if not len(raw):
            return [np.zeros(0, np.uint32) for _ in texts]
        begins = self.cut.bytes(raw)
        inner = offsets[:-1][np.diff(offsets) > 0]
        begins[inner] = True if self.cut.whole else ~_BREAK[raw[inner]]
        for k, text in enumerate(texts):
            odd = self.cut.odd(text)
            if odd is not None and odd:
                a = int(offsets[k])
                begins[a : offsets[k + 1]] = False
                begins[a + np.cumsum([0, *(len(f.encode()) for f in odd[:-1])])] = True
        starts = np.flatnonzero(begins)
        if self.cut.whole:
            ends = np.append(starts[1:], len(raw))
        else:
            inside = ~_BREAK[raw]
            stops = inside.copy()
            stops[:-1] &= ~inside[1:]
            stops[inner[1:] - 1] |= inside[inner[1:] - 1]
            ends = np.flatnonzero(stops) + 1
        hashes = span_hashes(raw, starts, ends - starts)
        unique, at, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) > CACHE_ENTRIES or len(self.ids) > CACHE_IDS:
            self._forget()
        keys = unique.tolist()
        new = [k for k, h in enumerate(keys) if h not in self.known]
        if new:
            whole, place = raw.tobytes(), at[new]
            self._learn([whole[a:b].decode() for a, b in zip(starts[place].tolist(), ends[place].tolist())], [keys[k] for k in new])
        slot = np.fromiter(map(self.known.__getitem__, keys), np.int64, len(keys))[which]
        size = self.size[slot]
        last = np.cumsum(size)
        out = self.ids[np.repeat(self.first[slot] - (last - size), size) + np.arange(last[-1] if len(last) else 0)]
        edge = np.concatenate([[0], last])[np.searchsorted(starts, offsets)].tolist()
        return [out[a:b] for a, b in zip(edge, edge[1:])]

    def _learn(self, new: list[str], keys: list[int]) -> None:
        """Adds the ids of fragments and where they stand."""
        found: list = [None] * len(new)
        others, names, pieces, ends = [], [], [], []
        plain = _PLAIN.fullmatch
        for n, f in enumerate(new):
            m = plain(f)
            if m:
                word, mark = m.groups()
                piece = (word.lower() if self.lower else word).encode()
                if len(piece) <= WIDEST and len(mark) < 4:
                    names.append(n)
                    pieces.append(piece)
                    ends.append(mark)
                    continue
            others.append(n)
        for mark in set(ends).difference(self.marks):
            self.marks[mark] = self.tokenizer.encode(mark, add_special_tokens=False).ids
        for n, ids, mark in zip(names, self.bulk.encode(pieces), ends):
            found[n] = np.append(ids, self.marks[mark]) if mark else ids
        for k in range(0, len(others), 4096):
            some = others[k : k + 4096]
            for n, e in zip(some, self.tokenizer.encode_batch_fast([new[i] for i in some], add_special_tokens=False)):
                found[n] = e.ids
        size = np.array([len(x) for x in found], dtype=np.int64)
        self.known.update(zip(keys, range(len(self.size), len(self.size) + len(size))))
        self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.ids = np.concatenate([self.ids, *(np.asarray(x, dtype=np.uint32) for x in found)])


def byte_vocabulary(path: str) -> tuple[list[bytes | None], list[str]]:
    """The bytes of each id of a byte-level tokenizer file, and its special tokens."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    of = {chr(b): b for b in printable}
    others = [b for b in range(256) if b not in set(printable)]
    of |= {chr(256 + k): b for k, b in enumerate(others)}
    added = {t["id"]: t["content"] for t in spec.get("added_tokens", [])}
    vocab = spec["model"]["vocab"]
    out: list[bytes | None] = [None] * (max([*vocab.values(), *added, 0]) + 1)
    for token, i in vocab.items():
        if i not in added:
            out[i] = bytes(of[c] for c in token)
    for i, content in added.items():
        out[i] = content.encode()
    return out, list(added.values())


@lru_cache(maxsize=4)
def encoder(path: str, cuts: str) -> FragmentEncoder:
    """The worker's encoder for this file; workers that are used again keep it."""
    return FragmentEncoder(path, cuts)


def tokenizer_path(name: str) -> str:
    """Where the installed package of public vocabularies keeps a file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def chunks(texts: list[str], chars: int = 4_000_000) -> list[slice]:
    """Slices of about that many characters, one text at least."""
    out, start, size = [], 0, 0
    for k, t in enumerate(texts):
        if size and size + len(t) > chars:
            out.append(slice(start, k))
            start, size = k, 0
        size += len(t)
    if start < len(texts):
        out.append(slice(start, len(texts)))
    return out
