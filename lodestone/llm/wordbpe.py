"""Ids of a BPE vocabulary with word ends: texts are normalised and lower-cased, and white space is dropped.

No word crosses a space, so texts are cut at spaces where need be, and a word's ids are kept for the words to come.
Texts of characters on which no normal form acts and whose classes are settled go word by word; everything else, special
tokens included, goes to the library that the vocabulary is made for.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata

import numpy as np
from pyspark import Broadcast

from lodestone.llm.bpe import _Pool, byte_alphabet

#: Bytes of kept words before all are forgotten, with the bytes that an entry takes beside its text.
KEPT, ENTRY = 60_000_000, 200
#: Characters of a word from which it goes to the library.
LONG = 10_000
#: Characters that NFC leaves alone, whose lower case depends on no neighbour, and whose classes are settled: Latin and punctuation.
_PLAIN = [chr(c) for c in (*range(0x130), *range(0x131, 0x180), *range(0x2010, 0x2028), *range(0x2030, 0x205F))]
_PLAIN_TEXT = re.compile(r"[\x00-įı-ſ‐-‧‰-⁞]*")
_SPACE = r"\t-\r \x85\xa0"


def _of(kind: str) -> str:
    return "".join(re.escape(c) for c in _PLAIN if unicodedata.category(c)[0] == kind)


# letters first: no other alternative begins with one
_WORDS = re.compile(rf"[{_of('L')}]+|'s|'t|'re|'ve|'m|'ll|'d|[{_of('N')}]|[^{_SPACE}{_of('L')}{_of('N')}]+")
_ASCII_WORDS = re.compile(r"[a-z]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9]|[^\t-\r a-z0-9]+")
#: The steps before the merges that a vocabulary must name so that words are handled here.
_STEPS = (
    ["NFC", "Replace", "Lowercase"],
    r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
)


class WordEncoder:
    """Ids of texts for a specification in JSON."""

    def __init__(self, spec: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec)
        self.library.no_truncation(), self.library.no_padding()
        d = json.loads(spec)
        self.special = [x["content"] for x in d.get("added_tokens", [])]
        self.ranks = self._ranks(d)
        self.forget()

    @staticmethod
    def _ranks(d: dict):
        """An encoder by ranks of words that end in a line feed (which no word holds), or none where ids aren't ranks."""
        model, suffix = d["model"], d["model"].get("end_of_word_suffix")
        steps = [x["type"] for x in (d.get("normalizer") or {}).get("normalizers", [])]
        split = ((d.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0].get("pattern", {}).get("Regex")
        if model.get("type") != "BPE" or not suffix or (steps, split) != _STEPS:
            return None
        byte = {x: b for b, x in enumerate(byte_alphabet())}
        vocab, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        merged = np.array([vocab[a + b] for a, b in merges])
        raw = {}
        for x, i in vocab.items():
            if x not in {s["content"] for s in d.get("added_tokens", [])}:
                end = x.endswith(suffix)
                raw[bytes(map(byte.__getitem__, x[: -len(suffix)] if end else x)) + b"\n" * end] = i
        base = [raw[x] for b in range(256) for x in (bytes([b]), bytes([b]) + b"\n")]
        if (np.diff(merged) <= 0).any() or max(base) > merged.min() or len(raw) != len(base) + len(merges):
            return None
        import tiktoken

        ends = np.zeros(max(raw.values()) + 1, bool)
        ends[[i for x, i in raw.items() if x.endswith(b"\n") and len(x) > 1]] = True
        return tiktoken.Encoding("words", pat_str=r"[^\n]+\n", mergeable_ranks=raw, special_tokens={}), ends

    def forget(self) -> None:
        self.known, self.pool, self.kept = {}, _Pool(), 0

    def _learn(self, words: list[str]) -> None:
        short = [w for w in words if len(w) <= LONG]
        encoding, ends = self.ranks
        ids = np.array(encoding.encode_ordinary("\n".join([*short, ""])), np.int32)
        first = self.pool.add(ids, np.diff(np.flatnonzero(ends[ids]) + 1, prepend=0))
        self.known.update(zip(short, range(first, first + len(short)), strict=True))
        self.kept += ENTRY * len(words) + 6 * sum(map(len, words))
        for w in words:
            if len(w) > LONG:
                own = self._by_library(w)
                self.known[w] = self.pool.add(own, np.array([len(own)]))

    def _by_library(self, text: str) -> np.ndarray:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)

    def _plain(self, texts: list[list[str]]) -> list[np.ndarray]:
        """The ids of lists of words."""
        get, words = self.known.get, [w for x in texts for w in x]
        at = list(map(get, words))
        if None in at:
            self._learn(list(dict.fromkeys(w for w, k in zip(words, at, strict=True) if k is None)))
            at = [get(w) if k is None else k for w, k in zip(words, at, strict=True)]
        ids, sizes = self.pool.rows(np.array(at, np.int64))
        ends = np.concatenate(([0], np.cumsum(sizes)))[np.cumsum([0, *map(len, texts)])]
        return [ids[x:y] for x, y in zip(ends[:-1], ends[1:], strict=True)]

    def _words(self, text: str) -> list[str] | None:
        """The words of a text that is handled here."""
        if any(s in text for s in self.special):
            return None
        if text.isascii():
            return _ASCII_WORDS.findall(text.lower())
        return _WORDS.findall(text.lower()) if _PLAIN_TEXT.fullmatch(text) else None

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text, no special tokens added; a null text is empty. Special tokens' strings in a text are their ids."""
        texts = [x or "" for x in texts]
        if not self.ranks:
            return [self._by_library(x) for x in texts]
        if self.kept > KEPT:
            self.forget()
        found = [self._words(x) for x in texts]
        if None not in found:
            return self._plain(found)
        # the others chunk by chunk, of which those that aren't handled here have no words
        chunks = {k: [(c, self._words(c)) for c in texts[k].split(" ")] for k, x in enumerate(found) if x is None}
        plain = self._plain([*(x or [] for x in found), *(w or [] for x in chunks.values() for _, w in x)])
        out, at = plain[: len(texts)], len(texts)
        for k, x in chunks.items():
            out[k] = np.concatenate([own if w is not None else self._by_library(c) for (c, w), own in zip(x, plain[at : at + len(x)], strict=True)])
            at += len(x)
        return out


_ENCODERS: dict[int, WordEncoder] = {}


def worker_encoder(spec: Broadcast) -> WordEncoder:
    """The encoder of a broadcast specification, made once in a worker."""
    if spec.value["key"] not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[spec.value["key"]] = WordEncoder(spec.value["json"])
    return _ENCODERS[spec.value["key"]]
