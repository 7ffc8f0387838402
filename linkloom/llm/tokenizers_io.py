"""Fast, exact encoding with public tokenizer files.

Paths are parameters; each Python worker loads a file once. ``WordBpe`` equals
the tokenizers library on its file: texts are normalised by the file's rules,
split with the file's pattern, and each distinct word is encoded by the library
once and remembered. Texts that hold a special token's string, or characters on
which the two pattern engines could differ, go through the library itself.
"""

from __future__ import annotations

import array
import itertools
import json
import re
from functools import lru_cache

import numpy as np
import regex

from .kernels import MEMORIES

#: Words remembered by a worker, at most; later ones are encoded wherever they occur.
REMEMBERED = 300_000


class WordBpe:
    """Ids of the word-level BPE file, as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        described = json.load(open(path, encoding="utf-8"))
        self.special = re.compile("|".join(re.escape(t["content"]) for t in described["added_tokens"]) or "(?!)")
        pattern = described["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(pattern).findall
        #: Latin letters, common punctuation and general symbols: engines, lower-casing, composition and white space agree on them.
        self.plain = re.compile("[\\x01-\\x1b\\x20-\\x84\\x86-\\u012f\\u0131-\\u017f\\u2010-\\u2027\\u2030-\\u205e\\u20ac]*").fullmatch
        self.known: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        suffix = described["model"]["end_of_word_suffix"]
        self.fast = self._merges(described["model"]["vocab"], suffix)
        self.closes = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, bool)
        self.closes[[i for w, i in self.tokenizer.get_vocab().items() if w.endswith(suffix)]] = True

    def library(self, text: str) -> bytes:
        return array.array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str | None) -> bytes:
        return self.encode_many([text])[0]

    @staticmethod
    def _merges(vocabulary: dict[str, int], suffix: str):
        """The same merges in a faster engine: a zero byte, which no plain word has, stands for the word's end.

        Ids follow the order of merges, bytes with an end come before all merges, so the merge of least id is the next one in both.
        """
        import tiktoken

        places = _byte_places()
        ranks = {}
        for token, i in vocabulary.items():
            ends = token.endswith(suffix)
            body = token.removesuffix(suffix)
            if body and all(c in places for c in body):
                raw = bytes(places[c] for c in body)
                if 0 not in raw:
                    ranks[raw + b"\0" * ends] = i
        return tiktoken.Encoding("words", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text: those of its words between white space, which no pretoken crosses."""
        plain = [not t or bool(self.plain(t) and not ("<|" in t and self.special.search(t))) for t in texts]
        words: list[str] = []
        ends = []
        for t, p in zip(texts, plain, strict=True):
            if p and t:
                words += t.lower().split()
            ends.append(len(words))
        ids = self._looked_up(self.known, words, self._encode_spaced)
        return [b"".join(ids[a:z]) if p else self.library(t) for t, p, a, z in zip(texts, plain, [0, *ends], ends, strict=False)]

    @staticmethod
    def _looked_up(known: dict[str, bytes], words: list[str], make) -> list[bytes]:
        """The ids of each of ``words``; what is new is made at once, and remembered while there is room."""
        ids = list(map(known.get, words))
        missing = [i for i, x in enumerate(ids) if x is None]
        if missing:
            new = list(dict.fromkeys([words[i] for i in missing]))
            found = dict(zip(new, make(new), strict=True))
            for i in missing:
                ids[i] = found[words[i]]
            known.update(itertools.islice(found.items(), max(0, REMEMBERED - len(known))))
        return ids

    def _encode_spaced(self, words: list[str]) -> list[bytes]:
        split = list(map(self.words, words))
        ids = self._looked_up(self.parts, list(itertools.chain.from_iterable(split)), self._encode_words)
        ends = list(itertools.accumulate(map(len, split)))
        return [b"".join(ids[a:z]) for a, z in zip([0, *ends], ends, strict=False)]

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of pretokens, all in one go; each ends with the one token that closes a word."""
        ids = np.array(self.fast.encode_ordinary("\0".join(words) + "\0"), np.uint32)
        raw, ends = ids.tobytes(), (4 * (np.flatnonzero(self.closes[ids]) + 1)).tolist()
        return [raw[i:j] for i, j in zip([0, *ends], ends, strict=False)]


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


class ByteBpe:
    """Byte-level BPE: encode to and decode from ids; the special token's string is its id, as in the library."""

    def __init__(self, path: str):
        import tiktoken

        described = json.load(open(path, encoding="utf-8"))
        places = _byte_places()
        ranks = {bytes(places[c] for c in token): i for token, i in described["model"]["vocab"].items() if all(c in places for c in token)}
        special = {t["content"]: t["id"] for t in described["added_tokens"]}
        for t in special:
            ranks.pop(t.encode(), None)
        #: The pattern of byte-level BPE (a fixed value of this format).
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        self.special = special
        self.split = regex.compile(pattern)
        #: Bytes of each id.
        self.sizes = np.zeros(max([*ranks.values(), *special.values()]) + 1, np.int64)
        self.sizes[list(ranks.values())] = [len(x) for x in ranks]
        self.path, self._tokenizer = path, None

    @property
    def tokenizer(self):
        if self._tokenizer is None:
            from tokenizers import Tokenizer

            self._tokenizer = Tokenizer.from_file(self.path)
            self._tokenizer.no_truncation()
            self._tokenizer.no_padding()
        return self._tokenizer

    def encode_ordinary(self, text: str) -> list[int]:
        return self.encoding.encode_ordinary(text)

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of the ids; ids that the vocabulary doesn't have give none."""
        try:
            return self.encoding.decode_bytes(ids)
        except KeyError:
            return b"".join(x for i in ids if (x := self._bytes_of(i)) is not None)

    def _bytes_of(self, i: int) -> bytes | None:
        try:
            return self.encoding.decode_single_token_bytes(i)
        except KeyError:
            return None


def _byte_places() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones stand for themselves, the rest follow from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)


MEMORIES["words"] = word_bpe.cache_clear
MEMORIES["bytes"] = byte_bpe.cache_clear
