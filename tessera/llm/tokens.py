"""Whole-text token ids with public tokenizer files, as little-endian unsigned 32-bit bytes.

Encoding a text equals joining the encodings of parts cut where the tokenizer itself always cuts.
Words repeat, so words and their stems (a run of letters before closing punctuation) are looked up
in bounded caches, and the stems that a batch of texts lacks are encoded in one call. Tokenizers
whose pre-tokenization is not one of the two known forms encode whole texts.
"""

from __future__ import annotations

import json
import os
from array import array
from functools import lru_cache

import numpy as np

from .common import RangeHashes

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Most words that one worker process keeps, and most stems, these in two generations of half each.
CACHE = 1_000_000
CACHE_STEMS = 200_000
CACHE_TAILS = 10_000
#: Letters below are composed, have lower case one by one, and are letters in every Unicode version.
LATIN = "\u0130"
#: Signs that may close a word; none starts a contraction.
CLOSING = ".,;:!?*#$%&|"
#: Code points of text that are looked up together.
PIECE = 1 << 21
_LEADS = {0: "", 0x20: " ", 0x0A: "\n"}


def _spelled() -> dict[int, str]:
    """Byte-level models spell bytes as characters: visible ones as themselves, the rest from U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(0x100 + i) for i, b in enumerate(hidden)}


_SPELLED = _spelled()


class _Cache:
    """Ids by text; when the newer half is full it becomes the older one, which is then dropped."""

    def __init__(self) -> None:
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def lacking(self, keys: set[str]) -> list[str]:
        """The keys without a value; those of the older half are brought over."""
        if len(self.new) >= CACHE_STEMS // 2:
            self.old, self.new = self.new, {}
        out = []
        for key in keys - self.new.keys():
            value = self.old.get(key)
            if value is None:
                out.append(key)
            else:
                self.new[key] = value
        return out


class _Words:
    """Ids of words by 64-bit hash, in flat arrays; emptied when full."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.hashes, self.slots = np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int32)  # ascending, and each one's place below
        self.ids = np.empty(1 << 16, dtype="<u4")
        self.start, self.length = np.empty(1 << 16, dtype=np.int64), np.empty(1 << 16, dtype=np.int32)
        self.edged, self.used = np.zeros(1 << 16, dtype=bool), 0  # whether other white space begins or ends the word

    def __len__(self) -> int:
        return len(self.hashes)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, -1 for those unknown; where in the order they belong) of ascending hashes."""
        at = np.searchsorted(self.hashes, hashes)
        if not len(self.hashes):
            return np.full(len(hashes), -1, dtype=np.int64), at
        near = np.minimum(at, len(self.hashes) - 1)
        return np.where(self.hashes[near] == hashes, self.slots[near], -1).astype(np.int64), at

    def add(self, hashes: np.ndarray, at: np.ndarray, made: list[bytes], edged: list[bool]) -> None:
        flat = np.frombuffer(b"".join(made), dtype="<u4")
        lengths = np.fromiter(map(len, made), dtype=np.int64, count=len(made)) // 4
        first, n = len(self), len(made)
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        while first + n > len(self.start):
            self.start, self.length, self.edged = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length, self.edged))
        self.ids[self.used : self.used + len(flat)] = flat
        self.start[first : first + n] = self.used + np.cumsum(lengths) - lengths
        self.length[first : first + n] = lengths
        self.edged[first : first + n] = edged
        self.used += len(flat)
        self.hashes, self.slots = np.insert(self.hashes, at, hashes), np.insert(self.slots, at, np.arange(first, first + n, dtype=np.int32))


class Encoder:
    """Encodes texts to id bytes, without special tokens; their strings in a text are plain text."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.kind = self._kind(json.loads(self.tokenizer.to_str()))
        self.lead = " " if self.kind == "space leads" else ""
        self.words, self.stems = _Words(), _Cache()
        self.tails: dict[str, bytes] = {}

    @staticmethod
    def _kind(form: dict) -> str:
        pre = form["pre_tokenizer"] or {}
        if form["normalizer"] is None and pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"]:
            return "space leads"
        first = (pre.get("pretokenizers") or [{}])[0]
        drops = first.get("type") == "Split" and first["invert"] and first["behavior"] == "Removed"
        if drops and "[^\\s\\p{L}\\p{N}]+" in first["pattern"].get("Regex", "") and form["model"].get("end_of_word_suffix"):
            return "space dropped"
        return "whole"

    def _model_ids(self, texts: list[str]) -> list[bytes]:
        """Ids of texts of letters alone: one word to the pre-tokenizer, so the model is asked directly."""
        out, tokenize, odd = [b""] * len(texts), self.tokenizer.model.tokenize, []
        spaced, lead = bool(self.lead), _SPELLED[0x20]
        for i, text in enumerate(texts):
            # Beyond Latin letters the normalizer might have more to do than lower case.
            if text.isascii():
                spelled = lead + text[1:] if spaced else text
            elif max(text) < LATIN:
                spelled = text.encode().decode("latin-1").translate(_SPELLED)
            else:
                odd.append(i)
                continue
            out[i] = array("I", [t.id for t in tokenize(spelled)]).tobytes()
        for i, ids in zip(odd, self._encode([texts[i] for i in odd]), strict=True):
            out[i] = ids
        return out

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def _made(self, words: list[tuple[str, str]]) -> list[bytes]:
        """Ids of (white space before it, word): of stem and closing signs where that is all it has."""
        out: list[bytes] = [b""] * len(words)
        odd, plain = [], []
        for i, (lead, word) in enumerate(words):
            low = word.lower() if not self.lead and word and max(word) < LATIN else word  # as the tokenizer's normalizer does
            stem = low.rstrip(CLOSING)
            if lead == self.lead and stem.isalpha() and (self.lead or low.islower()):
                plain.append((i, lead + stem, low[len(stem) :]))
            else:
                odd.append((i, lead + word))
        for (i, _), ids in zip(odd, self._encode([w for _, w in odd]), strict=True):
            out[i] = ids
        stems = self.stems.lacking({p[1] for p in plain})
        self.stems.new.update(zip(stems, self._model_ids(stems), strict=True))
        tails = {p[2] for p in plain if p[2]} - self.tails.keys()
        self.tails.update(zip(tails, self._encode(list(tails)), strict=True))
        known = self.stems.new
        for i, stem, tail in plain:
            out[i] = known[stem] + self.tails[tail] if tail else known[stem]
        if len(self.tails) > CACHE_TAILS:
            self.tails.clear()
        return out

    def many(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text."""
        out: list[bytes] = [b""] * len(texts)
        low, size = 0, 0
        for high, text in enumerate(texts):
            size += len(text or "")
            if size > PIECE:
                out[low : high + 1] = self._some(texts[low : high + 1])
                low, size = high + 1, 0
        out[low:] = self._some(texts[low:])
        return out

    def _some(self, texts: list[str | None]) -> list[bytes]:
        if not texts:
            return []
        if self.kind == "whole":
            return [self._encode([t])[0] if t else b"" for t in texts]
        raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        data = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
        bounds = np.cumsum([len(r) + 1 for r in raw])
        inside = np.zeros(len(data) + 1, dtype=np.int8)
        inside[1:] = (data != 0x20) & (data != 0x0A)
        edge = np.diff(inside)
        starts = np.flatnonzero(edge == 1)
        ends = np.flatnonzero(edge == -1)
        words_upto = np.searchsorted(starts, bounds)
        leads = data[starts - 1] if self.lead else np.zeros(len(starts), dtype=np.uint8)
        if self.lead and len(starts):
            first = np.concatenate([[0], words_upto[:-1]])[np.diff(np.concatenate([[0], words_upto])) > 0]
            leads = leads.copy()
            leads[first] = 0
        hashes = RangeHashes(data, starts)(starts, ends) + leads.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        distinct, at, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.words) + len(distinct) > CACHE:
            self.words.clear()
        places, order = self.words.find(distinct)
        lacking = np.flatnonzero(places < 0)
        if len(lacking):
            whole = data.tobytes()
            spans = zip(starts[at[lacking]].tolist(), ends[at[lacking]].tolist(), leads[at[lacking]].tolist(), strict=True)
            words = [(_LEADS[k], whole[a:b].decode("utf-8", "surrogatepass")) for a, b, k in spans]
            places[lacking] = np.arange(len(self.words), len(self.words) + len(lacking))
            edged = [w[0].isspace() or w[-1].isspace() for _, w in words]
            self.words.add(distinct[lacking], order[lacking], self._made(words), edged)
        place = places[which]
        lengths = self.words.length[place].astype(np.int64)
        upto = np.cumsum(lengths)
        order = np.repeat(self.words.start[place] - upto + lengths, lengths) + np.arange(upto[-1] if len(upto) else 0)
        ids = self.words.ids[order].tobytes()
        cuts = np.concatenate([[0], upto])[words_upto] * 4
        even = np.ones(len(texts), dtype=bool)
        if self.lead:
            # Only where all white space is single and between words do the parts stand on their own.
            n = np.diff(np.concatenate([[0], words_upto]))
            gaps = np.diff(np.concatenate([[0], np.cumsum(inside[1:] == 0)[bounds - 1]])) - 1
            even = (n == gaps + 1) & (np.add.reduceat(np.concatenate([self.words.edged[place], [0]]), np.minimum(words_upto - n, len(place)))[: len(n)] * (n > 0) == 0)
        out, low = [], 0
        for text, is_even, high in zip(texts, even.tolist(), cuts.tolist(), strict=True):
            out.append(ids[low:high] if is_even or not text else self._encode([text])[0])
            low = high
        return out

    def __call__(self, text: str | None) -> bytes:
        return self.many([text])[0]


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """The process's encoder for a tokenizer file."""
    return Encoder(path)
