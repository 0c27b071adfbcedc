"""Byte-pair tokenizers compiled to deterministic transducers.

Two machines are compiled from a tokenizer's file.

* The splitter reads classes of characters and marks where pieces begin.  It
  has a dozen states, so the map of states that a chunk makes is an element of
  a small finite monoid: chunks are reduced to their element in lockstep, the
  maps are composed by a parallel prefix scan, which gives every chunk's entry
  state, and a second lockstep pass writes the marks.
* The piece transducer reads a piece's bytes; the count on each of its
  transitions is the change in the number of tokens of what was read.  A state
  holds the tokens that may still be open: trie node, token before it, and tokens
  up to it less tokens up to now.  The last token of a prefix's encoding is
  the only one that goes with the token before it, so one pass without going
  back counts exactly.  States are compiled when first met.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable

import numpy as np
from tokenizers import pre_tokenizers

# Classes of characters: letters but for those of contractions, numbers, all others, the apostrophe, blank, other white
# space, letters that end a contraction after an apostrophe, those that need a second one, that one, end of a text, first
# and following characters of a special token.
LETTER, NUMBER, OTHER, QUOTE, BLANK, SPACE, SHORT, R, V, L, E, END, MARK, MARKED = range(14)
CLASSES, UNKNOWN = 14, 255
LETTERS = (LETTER, SHORT, R, V, L, E)
# The letters of the contractions 's 't 'm 'd 're 've 'll that the splitter's pattern names.
CONTRACTION = {"s": SHORT, "t": SHORT, "m": SHORT, "d": SHORT, "r": R, "v": V, "l": L, "e": E}
#: What a transition marks as the beginning of a piece: the character read, and the one before it.
HERE, BEFORE = 1, 2
#: Symbols of a chunk, and of a block that is scanned at a time.
CHUNK, BLOCK = 128, 1 << 20
#: States that are kept compiled, and pieces whose counts are.
MOST_STATES, MOST_PIECES = 150_000, 500_000

_STATES = "start letters numbers others quote quote_r quote_v quote_l blank space blanks spaces special".split()


def _splitter() -> tuple[np.ndarray, np.ndarray]:
    """(next state, mark) by state and class."""
    number = {s: i for i, s in enumerate(_STATES)}
    follow, mark = np.zeros((len(_STATES), CLASSES), dtype=np.uint8), np.zeros((len(_STATES), CLASSES), dtype=np.uint8)

    def opened(c: int) -> str:
        """The state after a piece's first character."""
        if c in LETTERS:
            return "letters"
        return {NUMBER: "numbers", OTHER: "others", QUOTE: "quote", BLANK: "blank", SPACE: "space", MARK: "special", MARKED: "special", END: "start"}[c]

    def run(c: int) -> str:
        """The state after a character that continues a piece begun by a blank."""
        return "others" if c == QUOTE else opened(c)

    def of_letters(c: int) -> tuple[str, int]:
        return ("letters", 0) if c in LETTERS else (opened(c), HERE)

    def step(s: str, c: int) -> tuple[str, int]:
        if c in (END, MARK):
            late = BEFORE if s in ("quote_r", "quote_v", "quote_l") else 0
            return opened(c), late | (HERE if c == MARK else 0)
        white = c in (BLANK, SPACE)
        if s in ("start", "special"):
            return ("special", 0) if s == "special" and c == MARKED else (opened(c), HERE)
        if s == "letters":
            return of_letters(c)
        if s == "numbers":
            return ("numbers", 0) if c == NUMBER else (opened(c), HERE)
        if s == "others":
            return ("others", 0) if c in (OTHER, QUOTE) else (opened(c), HERE)
        if s == "quote":
            if c in (OTHER, QUOTE):
                return "others", 0
            second = {SHORT: "start", R: "quote_r", V: "quote_v", L: "quote_l"}
            return (second[c], 0) if c in second else (opened(c), HERE)
        if s.startswith("quote_"):
            if c == (L if s == "quote_l" else E):
                return "start", 0
            then, here = of_letters(c)
            return then, here | BEFORE
        if white:
            return ("blanks" if c == BLANK else "spaces"), 0
        if s == "blank":
            return run(c), 0
        if s == "blanks":
            return run(c), BEFORE
        return opened(c), HERE | (BEFORE if s == "spaces" else 0)

    for s in _STATES:
        for c in range(CLASSES):
            then, m = step(s, c)
            follow[number[s], c], mark[number[s], c] = number[then], m
    return follow, mark


FOLLOW, MARKS = _splitter()


def _monoid() -> tuple[np.ndarray, np.ndarray]:
    """(maps, times): the maps of states that words of classes make, by number, and the number of a map followed by a class."""
    identity = tuple(range(len(_STATES)))
    seen, times, at = {identity: 0}, [], 0
    todo = [identity]
    while at < len(todo):
        row = []
        for c in range(CLASSES):
            then = tuple(int(FOLLOW[s, c]) for s in todo[at])
            if then not in seen:
                seen[then] = len(todo)
                todo.append(then)
            row.append(seen[then])
        times.append(row)
        at += 1
    return np.array(todo, dtype=np.uint8), np.array(times, dtype=np.int32)


MAPS, TIMES = _monoid()


def composed(maps: np.ndarray) -> np.ndarray:
    """The inclusive prefix scan of maps (n, states): row i is row 0 followed by row 1 and so on to row i."""
    out, step = maps.copy(), 1
    while step < len(out):
        out[step:] = np.take_along_axis(out[step:], out[:-step].astype(np.int64), axis=1)
        step *= 2
    return out


def marks(symbols: np.ndarray, state: int) -> tuple[np.ndarray, int]:
    """The marks that the splitter writes for classes, from a state, and the state after them."""
    n = len(symbols)
    whole = -(-n // CHUNK)
    padded = np.full(whole * CHUNK, END, dtype=np.uint8)
    padded[:n] = symbols
    lanes = np.ascontiguousarray(padded.reshape(whole, CHUNK).T)
    element = np.zeros(whole, dtype=np.int32)
    for column in lanes:
        element = TIMES[element, column]
    entry = np.concatenate([[state], composed(MAPS[element])[:-1, state]]).astype(np.uint8) if whole else np.zeros(0, dtype=np.uint8)
    out = np.empty((CHUNK, whole), dtype=np.uint8)
    now, last, at = entry, state, (n - 1) % CHUNK
    for i, column in enumerate(lanes):
        out[i] = MARKS[now, column]
        now = FOLLOW[now, column]
        if i == at and n:
            last = int(now[-1])
    return out.T.ravel()[:n], last


class Classes:
    """The class of every code point, asked of the library's own splitter when it is first met."""

    def __init__(self) -> None:
        self.table = np.full(0x110000, UNKNOWN, dtype=np.uint8)
        self.splitter = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)

    def _joins(self, first: str, points: list[int]) -> list[bool]:
        """Whether each code point continues a piece that ``first`` begins."""
        text = "".join(f"\n{first}{chr(p)}\n" for p in points)
        ends = {a: b for _, (a, b) in self.splitter.pre_tokenize_str(text)}
        return [ends.get(4 * i + 1) == 4 * i + 3 for i in range(len(points))]

    def of(self, points: np.ndarray) -> np.ndarray:
        out = self.table[points]
        if (out == UNKNOWN).any():
            new = np.unique(points[out == UNKNOWN])
            for part in np.array_split(new, -(-len(new) // 4096)):
                listed = part.tolist()
                for p, a, b, c in zip(listed, self._joins("a", listed), self._joins("1", listed), self._joins("!", listed)):
                    kind = LETTER if a else NUMBER if b else OTHER if c else SPACE
                    ch = chr(p)
                    self.table[p] = QUOTE if ch == "'" else BLANK if ch == " " else CONTRACTION.get(ch, kind)
            out = self.table[points]
        return out


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, code point) of each character of well-formed UTF-8."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[at].astype(np.int32)
    out = lead.copy()
    wide = np.flatnonzero(lead >= 0xC0)
    if len(wide):
        size = 2 + (lead[wide] >= 0xE0) + (lead[wide] >= 0xF0)
        value = lead[wide] & (0xFF >> (size + 1))
        for i in (1, 2, 3):
            more = size > i
            value[more] = value[more] << 6 | data[at[wide[more]] + i] & 0x3F
        out[wide] = value
    return at, out


def _bytes_of_characters() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable Latin-1 as itself, others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _open(node: int, before: int, less: int) -> int:
    """A token that may still be open, in one number."""
    return node << 48 | before + 1 << 16 | less + 0x8000


class Pieces:
    """The transducer that counts the tokens of a piece."""

    def __init__(self, vocabulary: dict[str, int], merges: Iterable[tuple[str, str]]):
        letters = _bytes_of_characters()
        self.text = {i: bytes(letters[c] for c in t) for t, i in vocabulary.items() if all(c in letters for c in t)}
        self.of_byte = {t[0]: i for i, t in self.text.items() if len(t) == 1}
        if len(self.of_byte) < 256:
            raise ValueError("not a byte-level vocabulary: some bytes have no token")
        self.merge = {(vocabulary[a], vocabulary[b]): (rank, vocabulary[a + b]) for rank, (a, b) in enumerate(merges)}
        self.parts = {made: (pair, rank) for pair, (rank, made) in self.merge.items()}
        if len(self.parts) < len(self.merge):
            raise ValueError("tokens that several merges make aren't compiled")
        self.spines: tuple[dict[int, list[tuple[int, int]]], ...] = ({}, {})
        self.alone: dict[int, bool] = {}
        self.child: dict[int, int] = {}
        self.token = [-1]
        inner = [False]
        for i, t in self.text.items():
            node = 0
            for b in t:
                key = node << 8 | b
                inner[node] = True
                if key not in self.child:
                    self.child[key] = len(self.token)
                    self.token.append(-1)
                    inner.append(False)
                node = self.child[key]
            self.token[node] = i
        self.inner = inner
        self.together: dict[int, bool] = {}
        self.counts: dict[bytes, int] = {}
        self._forget()

    def _forget(self) -> None:
        self.states: list[tuple[int, ...]] = []
        self.number: dict[tuple[int, ...], int] = {}
        self.moves: list[dict[int, tuple[int, int]]] = []
        self._numbered((_open(0, -1, 0),))

    def _numbered(self, state: tuple[int, ...]) -> int:
        number = self.number.get(state)
        if number is None:
            number = self.number[state] = len(self.states)
            self.states.append(state)
            self.moves.append({})
        return number

    def _spine(self, side: int, token: int) -> list[tuple[int, int]]:
        """The parts at one end of a token (0: first, 1: last) as its merges make them, largest first, with the rank at which each is merged further."""
        out = self.spines[side].get(token)
        if out is None:
            pair, rank = self.parts.get(token, ((), 0))
            out = self.spines[side][token] = [(token, len(self.merge)), *((p, min(r, rank)) for p, r in self._spine(side, pair[side]))] if pair else [(token, len(self.merge))]
        return out

    def _crosses(self, before: int, after: int, below: int) -> bool:
        """Whether a merge of rank under ``below`` joins the end of one token with the beginning of the next before either is whole."""
        for p, p_until in self._spine(1, before):
            for q, q_until in self._spine(0, after):
                rank, _ = self.merge.get((p, q), (below, 0))
                # of merges of one rank the left one is made first
                if rank < below and rank < p_until and rank <= q_until:
                    return True
        return False

    def _stands(self, token: int) -> bool:
        """Whether a token's own bytes are encoded as that token."""
        ok = self.alone.get(token)
        if ok is None:
            pair, rank = self.parts.get(token, ((), 0))
            ok = len(self.text[token]) == 1 or bool(pair) and self._stands(pair[0]) and self._stands(pair[1]) and not self._crosses(*pair, rank)
            self.alone[token] = ok
        return ok

    def _goes(self, before: int, token: int) -> bool:
        """Whether a token may follow another (-1: begin a piece) in an encoding."""
        key = before << 32 | token if before >= 0 else token
        ok = self.together.get(key)
        if ok is None:
            if len(self.together) > MOST_PIECES:
                self.together.clear()
            ok = self._stands(token) and (before < 0 or not self._crosses(before, token, len(self.merge)))
            self.together[key] = ok
        return ok

    def _compile(self, number: int, byte: int) -> tuple[int, int]:
        live, last, change = [], None, 0
        state = self.states[number]
        for item in state:
            node, before, less = item >> 48, (item >> 16 & 0xFFFFFFFF) - 1, (item & 0xFFFF) - 0x8000
            then = self.child.get(node << 8 | byte)
            if then is None:
                continue
            token = self.token[then]
            if last is None and token >= 0 and self._goes(before, token):
                last, change = token, less + 1
            if self.inner[then]:
                live.append((then, before, less))
        if last is None:
            raise ValueError("these merges have no left-to-right encoding")
        if len(self.states) >= MOST_STATES:
            self._forget()
            number = self._numbered(state)
        move = (self._numbered((*[_open(n, b, less - change) for n, b, less in live], _open(0, last, 0))), change)
        self.moves[number][byte] = move
        return move

    def count(self, piece: bytes) -> int:
        state = total = 0
        for b in piece:
            move = self.moves[state].get(b)
            if move is None:
                move = self._compile(state, b)
            state, change = move
            total += change
        return total

    def count_all(self, pieces: list[bytes]) -> np.ndarray:
        if len(self.counts) > MOST_PIECES:
            self.counts.clear()
        out = np.empty(len(pieces), dtype=np.int64)
        for i, p in enumerate(pieces):
            n = self.counts.get(p)
            if n is None:
                n = self.count(p)
                if len(p) <= 64:
                    self.counts[p] = n
            out[i] = n
        return out


class Compiled:
    """Both machines of a tokenizer's file; ValueError for kinds other than byte-level merges without a normalizer."""

    def __init__(self, file: str):
        spec = json.loads(file)
        model, split, added = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
        plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback"))
        if not plain or spec.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
            raise ValueError("only byte-level merges with the usual splitter are compiled")
        if any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("special tokens that take in their surroundings aren't compiled")
        self.classes = Classes()
        self.pieces = Pieces(model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]])
        self.special = {t["content"].encode() for t in added if t["content"]}
        self.pattern = re.compile(b"|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def cuts(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Offsets, ascending, between pieces of texts that lie one after another and end at ``ends``."""
        special = np.zeros((0, 2), dtype=np.int64)
        if self.pattern and self.pattern.search(view := memoryview(data)):
            starts = np.concatenate([[0], ends[:-1]]).tolist()
            special = np.array([m.span() for a, b in zip(starts, ends.tolist()) for m in self.pattern.finditer(view[:b], a)], dtype=np.int64).reshape(-1, 2)
        cut = np.zeros(len(data) + 1, dtype=bool)
        cut[ends] = True
        state = before = at = text = 0
        while at < len(data):
            upto = min(len(data), at + BLOCK)
            while upto < len(data) and data[upto] & 0xC0 == 0x80:
                upto += 1
            place, point = code_points(data[at:upto])
            place += at
            kind = self.classes.of(point)
            for a, b in special[(special[:, 0] < upto) & (special[:, 1] > at)].tolist():
                kind[(place >= a) & (place < b)] = MARKED
                kind[place == a] = MARK
            # a text's end is a symbol of its own, before the next text's first
            stop = int(np.searchsorted(ends, upto, side="right" if upto == len(data) else "left"))
            closed = ends[text:stop]
            text = stop
            where = np.searchsorted(place, closed)
            kind, place = np.insert(kind, where, END), np.insert(place, where, closed)
            mark, state = marks(kind, state)
            cut[place[mark & HERE > 0]] = True
            late = np.flatnonzero(mark & BEFORE)
            cut[np.where(late > 0, place[late - 1], before)] = True
            before, at = int(place[-1]), upto
        return np.flatnonzero(cut)
