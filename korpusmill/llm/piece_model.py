"""Weighted finite-state transducer of a SentencePiece model, and shortest paths of texts through it.

Compiled from the model file into one machine over input characters:

* The normaliser: states for nothing read, in the text, blanks read; an arc for a blank or another character says what it emits,
  which gives dummy prefix and removal of extra white space. Blank and piece mark are one symbol to what follows, so where no white space is removed, composing it comes down to that symbol and the first arc.
* The pieces, as a trie whose arcs read symbols and whose ends emit the piece.
* The byte fallback: a character outside the alphabet has an arc that emits the byte pieces of its UTF-8 form, or the
  unknown piece. Unknown pieces in a row are one.

A text composed with the machine is a lattice of arcs between places. Weights are of the tropical semiring: a path's is the
sum of its arcs', the least of all paths is the result.

* Unigram models: an arc that ends a piece weighs the piece's negated score; a state is a place in the text.
* BPE models: every arc weighs 1, and a state is also the piece last read. A piece may follow another if the two, written
  together, are taken apart into just these two again; all other pairs weigh infinity. Merges depend on neighbours alone,
  so a text's BPE pieces are the one path of which all neighbouring pairs are such. Pairs are compiled when first met.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np

MARK = "▁"
#: Kinds of pieces and of models in a model file.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Bytes of chunks and their ids, and pairs of pieces, that a worker keeps; how many chunks, of up to how many characters, go through the transducer side by side.
CACHE_BYTES, CACHE_PAIRS, SIDE_BY_SIDE, SHORT = 96 << 20, 400_000, 1 << 13, 40
#: What a character that no piece holds weighs more than the worst piece.
FALLBACK = 10.0
CHUNK = re.compile(f"[ {MARK}]+[^ {MARK}\n]*|\n[^ {MARK}\n]*|[^ {MARK}\n]+")
RUN = re.compile(" +|[^ ]+")
#: States of the normaliser, and what its arcs emit before the character itself, which a blank may lose.
START, TEXT, BLANK = 0, 1, 2
_PAIR_SLOTS = 1 << 21


def _fields(data: bytes) -> Iterator[tuple[int, int | float | bytes]]:
    """(number, value) of the fields of a serialized message."""
    i = 0

    def number() -> int:
        nonlocal i
        out = shift = 0
        while True:
            c = data[i]
            i, out, shift = i + 1, out | (c & 127) << shift, shift + 7
            if c < 128:
                return out

    while i < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(key & 7) or number()
        value = data[i : i + size]
        i += size
        yield key >> 3, struct.unpack("<f", value)[0] if key & 7 == 5 else value


class PieceModel:
    """Pieces with scores and kinds, in order of their ids, and the normaliser's settings."""

    def __init__(self, pieces: list[tuple[str, float, int]], kind: int = UNIGRAM, byte_fallback: bool = True, dummy_prefix: bool = True, remove_extra: bool = False):
        self.pieces, self.kind, self.byte_fallback = pieces, kind, byte_fallback
        self.dummy_prefix, self.remove_extra = dummy_prefix, remove_extra
        if any(k in (USER, UNUSED) for *_, k in pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.ids = {p: i for i, (p, _, k) in enumerate(pieces) if k == NORMAL}
        self.unknown = next((i for i, (*_, k) in enumerate(pieces) if k == UNKNOWN), 0)
        self.bytes = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(pieces) if k == BYTE}
        if byte_fallback and len(self.bytes) != 256:
            raise ValueError("byte fallback needs 256 byte pieces")

    @classmethod
    def load(cls, path: str) -> PieceModel:
        pieces, kind, fallback, prefix, extra = [], UNIGRAM, False, True, True
        with open(path, "rb") as f:
            message = f.read()
        for field, value in _fields(message):
            if field == 1:
                own = dict(_fields(value))
                pieces.append((own[1].decode(), own.get(2, 0.0), own.get(3, NORMAL)))
            elif field == 2:
                own = dict(_fields(value))
                kind, fallback = own.get(3, UNIGRAM), bool(own.get(35, 0))
            elif field == 3:
                own = dict(_fields(value))
                prefix, extra = bool(own.get(3, 1)), bool(own.get(4, 1))
                if own.get(2) or not own.get(5, 1):
                    raise ValueError("character maps and unescaped white space are not supported")
        if kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        return cls(pieces, kind, fallback, prefix, extra)

    def normaliser(self) -> dict[tuple[int, bool], tuple[int, str, bool]]:
        """Arcs by (state, whether a blank is read): next state, what is emitted first, whether the character itself follows."""
        prefix = " " if self.dummy_prefix else ""
        if self.remove_extra:
            return {
                (START, True): (START, "", False), (TEXT, True): (BLANK, "", True), (BLANK, True): (BLANK, "", False),
                (START, False): (TEXT, prefix, True), (TEXT, False): (TEXT, "", True), (BLANK, False): (TEXT, "", True),
            }
        return {(START, True): (TEXT, prefix, True), (START, False): (TEXT, prefix, True), (TEXT, True): (TEXT, "", True), (TEXT, False): (TEXT, "", True)}


class Transducer:
    """A compiled model: the normaliser's arcs, trie arcs by (state, symbol), byte arcs, and the weights of pairs."""

    def __init__(self, model: PieceModel):
        self.model, self.arcs_of_text = model, model.normaliser()
        pieces = {p.replace(MARK, " "): i for p, i in model.ids.items()}
        self.text_of = {i: p for p, i in pieces.items()}
        self.score = {p: model.pieces[i][1] for p, i in pieces.items()}
        self.ids, self.longest = pieces, max(map(len, pieces), default=1)
        symbols = {c: k + 1 for k, c in enumerate(sorted({c for p in pieces for c in p}))}
        self.symbols = np.zeros(0x110000, np.int64)
        for c, k in symbols.items():
            self.symbols[ord(c)] = k
        self.alone = np.zeros(0x110000, bool)
        self.alone[[ord(p) for p in pieces if len(p) == 1]] = True
        self.symbols[ord(MARK)], self.alone[ord(MARK)] = self.symbols[ord(" ")], self.alone[ord(" ")]  # the normaliser's own arcs
        self.byte_ids = np.array([model.bytes[b] for b in range(256)] if model.byte_fallback else [], np.int64)
        if model.kind == BPE and not self.alone[[ord(c) for c in symbols]].all():
            raise ValueError("every character of a BPE model's pieces must be a piece")
        arcs: dict[int, int] = {}
        ends: dict[int, int] = {}
        for piece, i in pieces.items():
            state = 0
            for c in piece:
                state = arcs.setdefault(state << 21 | symbols[c], len(arcs) + 1)
            ends[state] = i
        self.trie, self.ends_of = arcs, ends
        order = sorted(arcs)
        self.arcs, self.next = np.array([*order, 1 << 62], np.int64), np.array([*(arcs[k] for k in order), -1], np.int64)
        self.ends = np.full(len(arcs) + 1, -1, np.int64)
        self.ends[list(ends)] = list(ends.values())
        scores = [s for _, s, k in model.pieces if k == NORMAL]
        self.weights = np.array([-s for _, s, _ in model.pieces] + [FALLBACK - min(scores, default=0.0)])
        if model.kind == BPE:
            self.weights[:] = 1.0
        self.other = len(model.pieces)  # stands for a character outside the alphabet
        #: Chunks may be cut before a blank that follows another character, and around line ends.
        self.cuts = not any(" " in p.lstrip(" ") or "\n" in p for p in pieces)
        self.pair_keys, self.pair_ok, self.pairs = np.full(_PAIR_SLOTS, -1, np.int64), np.zeros(_PAIR_SLOTS, bool), {}

    def read(self, text: str) -> str:
        """What the normaliser emits for a text, blanks standing for piece marks; a run of equal arcs is taken at once."""
        if not self.model.remove_extra:
            return self.arcs_of_text[START, text[0] == " "][1] + text if text else text
        state, out = START, []
        for run in RUN.findall(text):
            blank = run[0] == " "
            state, before, own = self.arcs_of_text[state, blank]
            out.append(before + (run[0] if own else ""))
            if len(run) > 1:
                state, before, own = self.arcs_of_text[state, blank]
                out.append(run[1:] if own else "")
        return "".join(out).rstrip(f" {MARK}")  # marks that no text follows are on no path

    def _taken_apart(self, text: str) -> list[str]:
        """BPE pieces of a short text: of all neighbours that make up a piece those of the best score are joined, leftmost first."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _follows(self, key: int) -> bool:
        ok = self.pairs.get(key)
        if ok is None:
            if len(self.pairs) > CACHE_PAIRS:
                self.pairs.clear()
            first, second = divmod(key, self.other + 1)
            if self.other in (first, second):
                ok = True
            elif first == second == self.model.unknown:
                ok = False
            else:
                a, b = self.text_of.get(first, ""), self.text_of[second]
                ok = self._taken_apart(a + b) == ([a, b] if a else [b])
            self.pairs[key] = ok
        return ok

    def follows(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Whether pieces may follow those before them; ``unknown`` stands for the start of a chunk."""
        keys = before * (self.other + 1) + piece
        slots = (keys * -7046029254386353131 >> 40) & (_PAIR_SLOTS - 1)
        out = self.pair_ok[slots]
        if len(odd := np.flatnonzero(self.pair_keys[slots] != keys)):
            new, back = np.unique(keys[odd], return_inverse=True)
            found = np.array([self._follows(k) for k in new.tolist()])
            out[odd] = found[back]
            self.pair_keys[slots[odd]], self.pair_ok[slots[odd]] = keys[odd], found[back]
        return out

    def compose(self, codes: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Arcs (first place, characters, piece) of the transducer composed with chunks laid end to end, longest first at each place."""
        symbols = self.symbols[codes]
        stop = np.repeat(begins + sizes, sizes)
        at, state = np.arange(len(codes)), np.zeros(len(codes), np.int64)
        outside = np.flatnonzero(~self.alone[codes])
        out = [(outside, 1, np.full(len(outside), self.other))]
        for n in range(1, self.longest + 1):
            keys = state << 21 | symbols[at + n - 1]
            k = np.searchsorted(self.arcs, keys)
            live = self.arcs[k] == keys
            at, state = at[live], self.next[k[live]]
            piece = self.ends[state]
            done = piece >= 0
            out.append((at[done], n, piece[done]))
            more = at + n < stop[at]
            at, state = at[more], state[more]
            if not len(at):
                break
        return np.concatenate([x[0] for x in out]), np.concatenate([np.full(len(x[0]), x[1]) for x in out]), np.concatenate([x[2] for x in out])

    def paths(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces on the shortest paths of chunks, end to end, and how many each chunk has; all chunks take a step at a time."""
        bpe, count = self.model.kind == BPE, np.arange(len(chunks))
        sizes = np.array([len(c) for c in chunks])
        begins = np.cumsum(sizes) - sizes
        codes = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32)
        first, n, piece = self.compose(codes, begins, sizes)
        # place p of chunk c stands at p + c: every chunk has one place more than characters
        owner = np.repeat(count, sizes)[first]
        depth = first + n - begins[owner]
        order = np.argsort(depth.astype(np.int16), kind="stable")
        source, n, piece = (first + owner)[order], n[order], piece[order]
        target, edges = source + n, np.append(0, np.cumsum(np.bincount(depth, minlength=1)[1:]))
        places, floor = len(codes) + len(chunks), begins + count
        least, last, length = np.full(places, np.inf), np.zeros(places, np.int64), np.zeros(places, np.int64)
        least[floor], last[floor] = 0.0, self.model.unknown
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            total = least[source[lo:hi]] + self.weights[piece[lo:hi]]
            usable = np.flatnonzero(np.isfinite(total))
            if bpe:  # one arc into each place at most is left
                usable = usable[self.follows(last[source[lo + usable]], piece[lo + usable])]
            else:
                usable = usable[np.lexsort((-n[lo + usable], total[usable], target[lo + usable]))]  # ties: the longer piece
                usable = usable[np.append(True, np.diff(target[lo + usable]) > 0)[: len(usable)]]
            to = target[lo + usable]
            least[to], last[to], length[to] = total[usable], piece[lo + usable], n[lo + usable]
        on_path, place, alive = np.zeros(places, bool), floor + sizes, count
        while len(alive):
            on_path[place[alive]] = True
            place[alive] -= length[place[alive]]
            alive = alive[place[alive] > floor[alive]]
        where = np.flatnonzero(on_path)
        what, who = last[where], np.repeat(count, sizes + 1)[where]
        if len(odd := np.flatnonzero(what == self.other)):
            flat, sizes_ = self.outside(codes[where[odd] - who[odd] - 1])
            many = np.ones(len(what), np.int64)
            many[odd] = sizes_
            who, what = np.repeat(who, many), np.repeat(what, many)
            what[what == self.other] = flat
        return what.astype(np.uint32), np.bincount(who, minlength=len(chunks))

    def outside(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the arcs of characters outside the alphabet emit, end to end, and how much each does."""
        if not self.model.byte_fallback:
            return np.full(len(codes), self.model.unknown, np.int64), np.ones(len(codes), np.int64)
        text = [chr(c).encode("utf-8", "surrogatepass") for c in codes.tolist()]
        return self.byte_ids[np.frombuffer(b"".join(text), np.uint8)], np.array([len(x) for x in text], np.int64)

    def path(self, chunk: str) -> list[int]:
        """The same for one chunk of any length; the trie is walked from every place that a path reaches."""
        bpe, many, other = self.model.kind == BPE, len(chunk), self.other
        codes = np.frombuffer(chunk.encode("utf-32-le", "surrogatepass"), np.uint32)
        symbols, alone, weights = self.symbols[codes].tolist(), self.alone[codes].tolist(), self.weights.tolist()
        least, last, length = [0.0] + [float("inf")] * many, [self.model.unknown] * (many + 1), [0] * (many + 1)
        arcs, ends, follows = self.trie, self.ends_of, self._follows
        for start in range(many):
            here = least[start]
            if here == float("inf"):
                continue
            before = last[start] * (other + 1)
            if not alone[start] and here + weights[other] < least[start + 1]:
                least[start + 1], last[start + 1], length[start + 1] = here + weights[other], other, 1
            state = 0
            for end in range(start, many):
                state = arcs.get(state << 21 | symbols[end])
                if state is None:
                    break
                piece = ends.get(state)
                if piece is not None and here + weights[piece] < least[end + 1] and (not bpe or follows(before + piece)):
                    least[end + 1], last[end + 1], length[end + 1] = here + weights[piece], piece, end + 1 - start
        out, end = [], many
        while end:
            out.append(self.outside(codes[end - 1 : end])[0].tolist() if last[end] == other else [last[end]])
            end -= length[end]
        return [i for part in reversed(out) for i in part]
