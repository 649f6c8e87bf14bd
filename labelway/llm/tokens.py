"""Encoding whole texts with a word-level public tokenizer through caches.

The tokenizer drops white space, composes (NFC), lower-cases and cuts words into
runs (letters, one digit, symbols, English contractions) before it merges, so a
run has the same ids wherever it stands. Each worker has the library encode a
run once; a text is a chain of lookups by word, and by run for new words. Caches
are bounded in entries, and results never depend on them.
"""

from __future__ import annotations

import os
import struct
import unicodedata
from itertools import chain

import numpy as np
import regex

# The tokenizer's own rule for cutting a lower-cased word into runs.
RUNS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
RUNS_AND_ENDS = regex.compile(RUNS.pattern + r"|\n")
#: Python splits words here, the tokenizer does not.
SEPARATORS = regex.compile("[\x1c-\x1f]")
MARK = "\x01"
CACHE = 700_000

_encoders: dict[str, WordEncoder] = {}


def normal(text: str) -> str:
    """Composed and lower-cased character by character, as the tokenizer does."""
    if text.isascii():
        return text.lower()
    return "".join(map(str.lower, unicodedata.normalize("NFC", text)))


def cut(words: list[str]) -> list[list[str]]:
    """The runs of each word; all words are normalised and cut in one pass, a line each."""
    runs = RUNS_AND_ENDS.findall(normal("\n".join([*words, ""])))
    out, start = [], 0
    for _ in words:
        end = runs.index("\n", start)
        out.append(runs[start:end])
        start = end + 1
    return out


class WordEncoder:
    """Ids of whole texts; one instance per worker process and file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words: dict[str, bytes] = {}
        self.recent: dict[str, bytes] = {}
        self.runs: dict[str, bytes] = {}
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        (self.mark,) = self.library(MARK)
        # lower-case ASCII goes to the merges as it is, unless this file says otherwise
        signs = [chr(c) for c in range(33, 127) if not 65 <= c <= 90]
        self.direct = all(self.merged(s) == self.library(s) for s in [*signs, "zebra", "internationalization"])

    @classmethod
    def of(cls, path: str) -> WordEncoder:
        if path not in _encoders:
            _encoders[path] = cls(path)
        return _encoders[path]

    def library(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def merged(self, run: str) -> list[int]:
        """Ids of a run by the merges alone, without the library's passes over whole texts."""
        return [t.id for t in self.tokenizer.model.tokenize(run)]

    def learn_runs(self, runs: list[str]) -> None:
        """Encodes new runs: plain ASCII by the merges, others many in one text, told apart by
        a mark between them."""
        plain = []
        for r in runs:
            if self.direct and r.isascii() and r.isprintable():
                ids = self.merged(r)
                self.runs[r] = struct.pack(f"<{len(ids)}I", *ids)
            elif MARK in r:
                self.runs[r] = np.array(self.library(r), "<u4").tobytes()
            else:
                plain.append(r)
        for at in range(0, len(plain), 200):
            part = plain[at : at + 200]
            ids = np.array(self.library(f" {MARK} ".join(part)), "<u4")
            cuts = np.flatnonzero(ids == self.mark)
            starts, ends = np.r_[0, cuts + 1], np.r_[cuts, len(ids)]
            data = ids.tobytes()
            for r, a, b in zip(part, (4 * starts).tolist(), (4 * ends).tolist()):
                self.runs[r] = data[a:b]

    def learn(self, words: set[str]) -> dict[str, bytes]:
        """Ids of new words. The first ``CACHE`` words stay; later ones are kept for a while."""
        if len(self.runs) > CACHE:
            self.runs.clear()
        plain = [w for w in words if w.isascii()]
        other = [w for w in words if not w.isascii()]
        known = self.runs
        parts = cut(plain) + cut(other)
        self.learn_runs(list(set(chain.from_iterable(parts)).difference(known)))
        ids = known.__getitem__
        new = {w: ids(p[0]) if len(p) == 1 else b"".join(map(ids, p)) for w, p in zip(plain + other, parts)}
        if len(self.words) < CACHE:
            self.words.update(new)
        else:
            if len(self.recent) > CACHE // 2:
                self.recent.clear()
            self.recent.update(new)
        return new

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian uint32, without special tokens around."""
        found: list[tuple[list[str], list[bytes | None]] | None] = []
        missing: set[str] = set()
        get, recent = self.words.get, self.recent.get
        for text in texts:
            if SEPARATORS.search(text) or any(s in text for s in self.special):
                found.append(None)
                continue
            own = text.split()
            ids = list(map(get, own))
            if None in ids:
                for i, x in enumerate(ids):
                    if x is None:
                        ids[i] = recent(own[i])
                        if ids[i] is None:
                            missing.add(own[i])
            found.append((own, ids))
        new = self.learn(missing) if missing else {}
        out = []
        for text, pair in zip(texts, found):
            if pair is None:  # the library sees the whole text
                out.append(np.array(self.library(text), "<u4").tobytes())
                continue
            own, ids = pair
            if None in ids:
                ids = [new[w] if x is None else x for w, x in zip(own, ids)]
            out.append(b"".join(ids))
        return out
