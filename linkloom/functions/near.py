"""For each of many words the most similar of many others: all that share a 3-gram are compared, in arrays."""

from __future__ import annotations

import re

import numpy as np

from .kernels import lcs

#: Ratios from which others are looked for, one after the other; the last leaves none out.
STEPS = (0.8, 0.65, 0.4, 0.0)
#: Words whose pairs are scored together, and pairs scored at once.
BLOCK, AT_ONCE = 128, 1 << 18
_WHITE = re.compile(r"[ \t\n\x0b\f\r]+")
_LETTERS, _REST = 26, 12


def _flat(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The characters of all texts, and where each text begins, with the end."""
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64), np.concatenate(([0], ends)).astype(np.int64)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(number of the text, 3-gram as a number), each once and by text: the grams of ``blocking.char_grams``."""
    c, at = _flat(["".join(f" {w} " for w in _WHITE.split(t.lower()) if w) for t in texts])
    blank = c == 32
    within = ~((blank[:-2] & blank[1:-1]) | (blank[1:-1] & blank[2:]))  # two blanks part words
    owner = np.repeat(np.arange(len(texts)), np.diff(at))[:-2][within]
    gram = (c[:-2] << 42 | c[1:-1] << 21 | c[2:])[within]
    order = np.lexsort((gram, owner))
    owner, gram = owner[order], gram[order]
    first = np.ones(len(gram), bool)
    first[1:] = (owner[1:] != owner[:-1]) | (gram[1:] != gram[:-1])
    return owner[first], gram[first]


def _letters(c: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A bit for each letter a to z that a text has, one more if it has it twice, and bits that other characters share."""
    n, wide = len(at) - 1, _LETTERS + _REST
    owner = np.repeat(np.arange(n), np.diff(at))
    letter = (c >= 97) & (c < 97 + _LETTERS)
    counts = np.bincount(owner * wide + np.where(letter, c - 97, _LETTERS + c % _REST), minlength=n * wide).reshape(n, wide)
    out = np.zeros(n, np.uint64)
    for i in range(wide):
        out |= (counts[:, i] > 0).astype(np.uint64) << np.uint64(i)
        if i < _LETTERS:
            out |= (counts[:, i] > 1).astype(np.uint64) << np.uint64(wide + i)
    return out


class Others:
    """Words, found by 3-grams; the earlier goes first among those of one score."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        c, self.at = _flat(texts)
        self.n = np.diff(self.at)
        self.letters = _letters(c, self.at)
        self.alphabet, self.codes = np.unique(c, return_inverse=True)
        owner, gram = grams(texts)
        order = np.argsort(gram, kind="stable")
        self.known, start = np.unique(gram[order], return_index=True)
        # of each gram the others that have it, and their letters and lengths side by side
        parts = lambda x: np.split(x, start[1:]) if len(start) else []
        owner = owner[order].astype(np.int32)
        self.lists, self.lists_letters, self.lists_n = parts(owner), parts(self.letters[owner]), parts(np.minimum(self.n, 255).astype(np.uint8)[owner])

    def common(self, forms: list[str], which: np.ndarray, other: np.ndarray) -> np.ndarray:
        """The lengths of the longest common subsequences of ``forms[which]`` and the others, bit-parallel over the forms."""
        out = np.zeros(len(which), np.int64)
        c, at = _flat(forms)
        n = np.diff(at)
        code = np.searchsorted(self.alphabet, c)
        known = code < len(self.alphabet)
        known[known] = self.alphabet[code[known]] == c[known]
        owner, bit = np.repeat(np.arange(len(forms)), n), np.arange(len(c)) - np.repeat(at[:-1], n)
        places = np.zeros(len(forms) * len(self.alphabet), np.uint64)
        fits = known & (bit < 64)
        np.bitwise_or.at(places, owner[fits] * len(self.alphabet) + code[fits], np.uint64(1) << bit[fits].astype(np.uint64))
        short = n[which] <= 64
        for k in np.flatnonzero(~short):
            out[k] = lcs(forms[which[k]], self.texts[other[k]])
        rows = np.flatnonzero(short)
        rows = rows[np.argsort(-self.n[other[rows]], kind="stable")]
        for i in range(0, len(rows), AT_ONCE):
            part = rows[i : i + AT_ONCE]
            w, o = which[part], other[part]
            row, base, begin, size = np.full(len(part), ~np.uint64(0)), w * len(self.alphabet), self.at[o], self.n[o]
            left = np.searchsorted(-size, -np.arange(size[0] if len(size) else 0), side="left")  # of t: how many are longer
            for t, k in enumerate(left):
                have = row[:k]
                hit = have & places[base[:k] + self.codes[begin[:k] + t]]
                row[:k] = (have + hit) | (have - hit)
            full = np.where(n[w] < 64, (np.uint64(1) << (n[w] % 64).astype(np.uint64)) - np.uint64(1), ~np.uint64(0))
            out[part] = n[w] - np.bitwise_count(row & full)
        return out

    def nearest(self, forms: list[str], most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the form, number of the other, ratio from 0 to 1): each form's ``most`` most similar of those that share a gram.

        Each bit of letters that one of two words has alone is a letter to remove, so what can't reach a ratio isn't scored. A form with
        ``most`` others at one ratio or more has its best among them; only the rest go on to the next, lower ratio.
        """
        c, at = _flat(forms)
        size, letters = np.diff(at), _letters(c, at)
        owner, gram = grams(forms)
        place = np.searchsorted(self.known, gram)
        hit = place < len(self.known)
        hit[hit] = self.known[place[hit]] == gram[hit]
        owner, place = owner[hit], place[hit]
        bound = np.searchsorted(owner, np.arange(len(forms) + 1))
        todo, found = np.flatnonzero(np.diff(bound)), []
        for least in STEPS:
            slack: dict[int, np.ndarray] = {}
            again = []
            for i in range(0, len(todo), BLOCK):
                block, near = todo[i : i + BLOCK], []
                for f in block:
                    its = place[bound[f] : bound[f + 1]]
                    others = np.concatenate([self.lists[g] for g in its])
                    if least > 0:
                        n = int(size[f])
                        if (most_off := slack.get(n)) is None:  # by length, letters to remove at most; their number is odd or even as the lengths' sum is
                            m = np.arange(256)
                            room = np.floor((n + m) * (1 - least) + 1e-6).astype(np.int64)
                            room -= (room ^ (n + m)) & 1
                            most_off = slack[n] = np.where((np.abs(n - m) <= room) | (m == 255), np.where(m == 255, 127, np.minimum(room, 127)), -1).astype(np.int8)
                        off = np.bitwise_count(np.concatenate([self.lists_letters[g] for g in its]) ^ letters[f]).view(np.int8)
                        others = others[off <= most_off[np.concatenate([self.lists_n[g] for g in its])]]
                    near.append(others if len(others) < 2 else np.unique(others))
                which, other = np.repeat(np.arange(len(block)), [len(x) for x in near]), np.concatenate(near)
                total = size[block][which] + self.n[other]
                score = 200.0 * self.common([forms[f] for f in block], which, other) / total / 100
                good = score >= least
                which, other, score = which[good], other[good], score[good]
                full = (np.bincount(which, minlength=len(block)) >= most) | (least == 0)
                again.append(block[~full])
                good = full[which]
                which, other, score = which[good], other[good], score[good]
                order = np.lexsort((other, -score, which))
                which, other, score = which[order], other[order], score[order]
                rank = np.arange(len(which)) - np.searchsorted(which, which)
                found.append((block[which[rank < most]], other[rank < most], score[rank < most]))
            todo = np.concatenate(again) if again else todo[:0]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))
