"""A noisy channel for disguised words: leetspeak, spacing and repeated letters."""

from __future__ import annotations

import re

import numpy as np

#: Symbols of the language model: 0 a word's edge, 1-26 a-z, then other letters, the last one for all else.
LETTERS = "abcdefghijklmnopqrstuvwxyzäöüßéèêëçàâîïôûùúñíóáœ"
SIZE = 64
OTHER = SIZE - 1
#: What a disguised letter may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "{": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou",
}
SEPARATED = re.compile(r"\S(?:[._\-~/,:;']\S){3,}+[.,;:!?]*+")
SPACED = re.compile(r"(?<!\S)\S(?: \S){3,}(?!\S)")
TRIPLE = re.compile(r"(.)\1\1")
DOUBLE = re.compile(r"(.)\1", re.S)
REPEATED = re.compile(r"(.)\1\1+", re.S)
CUTS = re.compile(r"(?:[^\w@$!|+*]|_)+")
PLAIN_CUTS = re.compile(r"(?:[^\w@$!|+*(<{€£¡]|_)+")
LONG_RUN = re.compile(r"(.)\1{3,}", re.S)
EDGES = ".,;:?!\"'()[]{}<>«»“”„…-_*~`"
KEPT_EDGES = ".,;:?\"'[]«»“”„…-_~`"
#: Letters of a stretch that are new; longer strings are decoded in stretches of twice as many, so none is left out.
LONGEST = 64

_TABLE = np.full(0x250, OTHER, np.int64)
for _i, _c in enumerate(LETTERS):
    _TABLE[ord(_c)] = _i + 1
for _c in " \t\n\r\x0b\x0c.,;:?!\"'()-_":
    _TABLE[ord(_c)] = 0


def symbols(text: str) -> np.ndarray:
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    return _TABLE[np.minimum(points, len(_TABLE) - 1)]


def trigram_counts(text: str, counts: np.ndarray) -> None:
    s = symbols(f"  {text} ")
    counts += np.bincount((s[:-2] * SIZE + s[1:-1]) * SIZE + s[2:], minlength=SIZE**3)


def language_model(counts: np.ndarray) -> np.ndarray:
    """Logarithms of P(c | ab), each smoothed by P(c | b) and P(c)."""
    tri = counts.reshape(SIZE, SIZE, SIZE).astype(float)
    one = (tri.sum((0, 1)) + 0.5) / (tri.sum() + 0.5 * SIZE)
    bi = tri.sum(0)
    two = (bi + 20 * one) / (bi.sum(1, keepdims=True) + 20)
    three = (tri + 20 * two) / (tri.sum(2, keepdims=True) + 20)
    return np.log(three).astype(np.float32)


class Restorer:
    """Finds the likeliest plain words behind a disguised token."""

    def __init__(self, model: np.ndarray, leet_cost: float = 1.0, repeat_cost: float = 0.5, edge_cost: float = 2.0) -> None:
        self.model = model
        self.number = {c: i + 1 for i, c in enumerate(LETTERS)}
        self.leet_cost, self.repeat_cost, self.edge_cost = leet_cost, repeat_cost, edge_cost

    def _lattice(self, chars: str, edges: bool, halve: bool) -> list[list[tuple[str, float]]]:
        """For every run of one character the strings it may stand for, with the channel's costs; '' drops it."""
        steps, i = [], 0
        while i < len(chars):
            j = i
            while j < len(chars) and chars[j] == chars[i]:
                j += 1
            c, n = chars[i], j - i
            readings = [(c, 0.0)] if c in self.number else []
            readings += [(x, self.leet_cost) for x in LEET.get(c, "")]
            if not readings:
                readings = [("", self.leet_cost)]
            options = []
            for x, cost in readings:
                if n > 2:
                    options += [(x, cost + self.repeat_cost), (x * 2, cost + self.repeat_cost)]
                else:
                    options.append((x * n, cost))
                    if n == 2 and halve and x:
                        options.append((x, cost + self.repeat_cost))
            if edges:  # a word may end after the run
                options += [(x + " ", cost + self.edge_cost) for x, cost in options]
            steps.append(options)
            i = j
        return steps

    def decode(self, chars: str, edges: bool = False, halve: bool = True) -> str:
        """The best path through the lattice by Viterbi; a state is the last two letters. With ``halve`` two equal
        signs may stand for one letter."""
        states: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
        for options in self._lattice(chars, edges, halve):
            nxt: dict[tuple[int, int], tuple[float, str]] = {}
            for (a, b), (score, path) in states.items():
                for text, cost in options:
                    x, y, s = a, b, score - cost
                    for c in text:
                        z = self.number.get(c, 0)
                        s += float(self.model[x, y, z])
                        x, y = y, z
                    if (x, y) not in nxt or s > nxt[x, y][0]:
                        nxt[x, y] = (s, path + text)
            states = nxt
        ends = [(s + float(self.model[a, b, 0]), path) for (a, b), (s, path) in states.items()]
        return max(ends)[1]

    def apart(self, chars: str) -> list[list[str]]:
        """The words of a string of any length in which words may end anywhere, each with its readings. Runs of more
        than three read like three; what is then longer than LONGEST is decoded in overlapping stretches. Two equal
        signs may be two letters, of two words too, or one; words that begin alike are readings of one."""
        chars, out = LONG_RUN.sub(r"\1\1\1", chars), []
        for i in range(0, len(chars), LONGEST) if len(chars) > LONGEST else [0]:
            part = chars[i : i + 2 * LONGEST]
            words = [[w] for w in self.decode(part, True, False).split()]
            more = self.decode(part, True).split() if DOUBLE.search(part) else []
            for w in dict.fromkeys(more):
                same = next((own for own in words if own[0][:4] == w[:4]), None)
                if same is None:
                    words.append([w])
                elif w not in same:
                    same.append(w)
            out += words
        return out

    def read(self, token: str) -> tuple[list[list[str]], bool]:
        """The words of a token of lower-case text, each with its readings, and whether it had to be restored.
        Letters set apart, joined parts and strings longer than LONGEST can hold several words."""
        plain, bare = token.strip(EDGES), token.strip(KEPT_EDGES)
        if plain.isalpha() and not TRIPLE.search(plain):
            found = self._word(plain)
            if bare != plain and (bare.strip("!()*<{}>") != plain or len(bare) - len(plain) < 2) and bare[0] in LEET:
                return self._merged(found, self._word(bare)), True
            return found, found != [[plain]]
        if not bare or not self._legible(bare):
            return [], False
        if SEPARATED.fullmatch(bare):
            return self._once(self.apart(re.sub(r"[._\-~/,:;']", "", bare))), True
        parts: list[list[str]] = []
        for piece in filter(None, PLAIN_CUTS.split(bare)):
            own = self._word(piece)
            for part in filter(None, CUTS.split(piece)):
                own = own if part == piece else self._merged(own, self._word(part), False)
            parts += own
        whole = self._word(bare)
        return (self._merged(whole, parts) if parts else whole), True

    def _legible(self, chars: str) -> bool:
        return any(c in self.number for c in chars)

    def _word(self, chars: str) -> list[list[str]]:
        """The readings of one word, or the words of a long string."""
        own = [chars] if chars.isalpha() else []
        if not self._legible(chars) or own and not DOUBLE.search(chars):
            return [own] if own else []
        found = []
        for s in dict.fromkeys((LONG_RUN.sub(r"\1\1\1", chars), LONG_RUN.sub(r"\1\1\1", chars.rstrip("!")))):  # an exclamation mark or an i
            if len(s) > LONGEST:
                return self._once([own] * bool(own) + self.apart(s))
            if not own or TRIPLE.search(s):
                found.append(self.decode(s, halve=False))
            if DOUBLE.search(REPEATED.sub(" ", s)):
                found.append(self.decode(s))
        return [list(dict.fromkeys(filter(None, own + found)))]

    @staticmethod
    def _once(words: list[list[str]]) -> list[list[str]]:
        return [list(own) for own in dict.fromkeys(map(tuple, words))]

    @staticmethod
    def _merged(whole: list[list[str]], parts: list[list[str]], apart: bool = True) -> list[list[str]]:
        """Words of a string and of its parts. The first part begins like the whole, so both are one word, and unless
        they stand ``apart`` all parts are; a long string's words are one each."""
        if len(whole) > 1:
            return Restorer._once(whole + parts)
        joined = whole + parts
        kept = 2 if apart else len(joined)
        return [list(dict.fromkeys(w for own in joined[:kept] for w in own)), *joined[kept:]]

    def words(self, token: str) -> tuple[list[str], bool]:
        """The plain words of a token of lower-case text, and whether it had to be restored."""
        found, restored = self.read(token)
        return [w for readings in found for w in readings], restored

    def spaced(self, text: str) -> list[list[str]]:
        """The words behind runs of single characters, each with its readings; long runs in overlapping stretches."""
        out = []
        for run in SPACED.findall(text):
            chars = run.replace(" ", "")
            if len(set(chars)) > 2:
                out += self.apart(chars)
        return out
