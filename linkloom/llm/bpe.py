"""Byte-level BPE as a bounded-lookahead streaming transducer, and its inverse.

A merge list fixes how far to the right of a boundary a byte can still change
what stands to the left of it: a merge (u, v) is undone only if a suffix of v
is taken earlier, by a merge of lower rank, with what follows, and that merge
in turn depends only on merges of lower rank still.  Ranks fall along such a
chain, so its greatest length in bytes is a finite number that the list alone
decides: the *sufficient lookahead*, which `MergeList.lookahead` computes by
one pass over the rules in rank order.  The transducer keeps a window of
pending bytes, merges it, and emits the tokens that end at least the lookahead
before its end; a pretoken that ends inside the window needs no lookahead.
Memory is a chunk and the window, whatever the length of the text.

Between a single space and what is no white space on either side a pretoken
ends for sure, so a transducer emits at every such cut, and the units between
two cuts, which recur, are remembered in a dictionary of bounded size that
many transducers share.  The merging kernel works on all units that are new to
them at once, with numpy.

Decoding maps ids to bytes and feeds an incremental UTF-8 state machine that
holds at most three bytes; malformed bytes become U+FFFD.

Defined results: a null or empty text has no tokens; text of any length is
encoded whole; the strings of special tokens in a text become their ids, as
the tokenizers library does by default.
"""

from __future__ import annotations

import codecs
import gc
import json
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import batched
from operator import add

import numpy as np
import regex

PRETOKEN = regex.compile(r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_RUNS = [(regex.compile(r" ?\p{L}"), regex.compile(r"\p{L}*")), (regex.compile(r" ?\p{N}"), regex.compile(r"\p{N}*")), (regex.compile(r" ?[^\s\p{L}\p{N}]"), regex.compile(r"[^\s\p{L}\p{N}]*"))]
_SPACE = regex.compile(r"\s*")
_CUT = regex.compile(r"(?<=\S) (?=\S)")
_BIG = np.uint64(1 << 62)
_SHIFT = np.uint64(17)
_MULT = np.uint64(0x9E3779B97F4A7C15)


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class MergeList:
    """Vocabulary and ranked merges of a tokenizers JSON file of byte-level BPE."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()

        def raw(token: str) -> bytes:
            return bytes(alphabet[c] for c in token)

        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.marks = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.cuts = not any(c.isspace() for t in self.special for c in t)  # a special token never spans a cut
        vocab = {raw(t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.bytes_of: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.bytes_of[i] = token
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.base = np.zeros(256, np.uint64)
        for b in range(256):
            self.base[b] = vocab[bytes([b])]
        self.rules: list[tuple[int, int, int]] = []
        seen = {}
        for rule in spec["model"]["merges"]:
            left, right = rule.split(" ") if isinstance(rule, str) else rule
            left, right = raw(left), raw(right)
            a, b, c = vocab[left], vocab[right], vocab[left + right]
            seen[a << 17 | b] = (len(self.rules), c)  # a repeated rule counts at its last place
            self.rules.append((a, b, c))
        self._table(seen)
        self._lookahead: int | None = None

    def _table(self, seen: dict[int, tuple[int, int]]) -> None:
        """Open addressing: pair of ids -> rank and merged id."""
        bits = 20
        self._hash_shift = np.uint64(64 - bits)
        self._mask = (1 << bits) - 1
        keys, vals = np.full(1 << bits, _BIG, np.uint64), np.full(1 << bits, _BIG, np.uint64)
        for key, (rank, made) in seen.items():
            h = (key * int(_MULT) & (1 << 64) - 1) >> (64 - bits)
            while keys[h] != _BIG:
                h = h + 1 & self._mask
            keys[h], vals[h] = key, rank << 17 | made
        self._keys, self._vals = keys, vals

    def _find(self, keys: np.ndarray) -> np.ndarray:
        at = (keys * _MULT >> self._hash_shift).astype(np.int64)
        there = self._keys[at]
        out = np.where(there == keys, self._vals[at], _BIG)
        open_ = np.flatnonzero((there != keys) & (there != _BIG))
        while len(open_):
            at[open_] = at[open_] + 1 & self._mask
            there = self._keys[at[open_]]
            hit = there == keys[open_]
            out[open_[hit]] = self._vals[at[open_[hit]]]
            open_ = open_[~hit & (there != _BIG)]
        return out

    @property
    def lookahead(self) -> int:
        """Bytes to the right of a boundary after which it can't change any more."""
        if self._lookahead is None:
            made_by: dict[int, tuple[int, int]] = {}  # token -> right part, rank
            ranks: dict[int, list[int]] = {}
            needs: dict[int, list[int]] = {}

            def settled(token: int, rank: int) -> int:
                most = 0
                while True:
                    if token in ranks and (n := bisect_left(ranks[token], rank)):
                        most = max(most, needs[token][n - 1])
                    if token not in made_by:
                        return most
                    token, rank = made_by[token]

            for rank, (a, b, c) in enumerate(self.rules):
                need = len(self.bytes_of[b]) + settled(b, rank)
                ranks.setdefault(a, []).append(rank)
                rows = needs.setdefault(a, [])
                rows.append(max(need, rows[-1] if rows else 0))
                made_by.setdefault(c, (b, rank))
            end = len(self.rules)
            self._lookahead = max([1, *(settled(t, end) for t in {*made_by, *map(int, self.base)})])
        return self._lookahead

    def merge(self, windows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of each window by itself: ids end to end, and how many each has."""
        return self.merge_buffer(b"".join(windows), np.fromiter(map(len, windows), np.int64, len(windows)))

    def merge_buffer(self, data: bytes, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same of windows that lie end to end."""
        sym = self.base[np.frombuffer(data, np.uint8)]
        word = np.repeat(np.arange(len(lens)), lens)
        done_sym, done_word = [], []
        while len(sym):
            rank = np.full(len(sym), _BIG, np.uint64)
            same = word[1:] == word[:-1]
            rank[:-1][same] = self._find((sym[:-1] << _SHIFT | sym[1:])[same])
            starts = np.flatnonzero(np.r_[True, ~same])
            best = np.minimum.reduceat(rank, starts)
            count = np.diff(np.r_[starts, len(sym)])
            going = np.repeat(best != _BIG, count)
            if not going.all():
                done_sym.append(sym[~going])
                done_word.append(word[~going])
            at = np.flatnonzero(going & (rank == np.repeat(best, count)))
            at = at[np.r_[True, word[at][1:] != word[at][:-1]]] if len(at) else at
            sym[at] = rank[at] & np.uint64((1 << 17) - 1)
            going[at + 1] = False
            sym, word = sym[going], word[going]
        if not done_sym:
            return np.zeros(0, "<u4"), np.zeros(len(lens), np.int64)
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        return sym[np.argsort(word, kind="stable")].astype("<u4"), np.bincount(word, minlength=len(lens))


class _Run:
    """Merges one open-ended pretoken: holds a window, emits what is stable."""

    def __init__(self, merges: MergeList):
        self.merges, self.held, self.peak = merges, b"", 0

    def feed(self, data: bytes, last: bool) -> list[int]:
        out: list[int] = []
        step = max(4 * self.merges.lookahead, 1024)
        for i in range(0, len(data), step):
            self.held += data[i : i + step]
            self.peak = max(self.peak, len(self.held))
            if len(self.held) > 2 * self.merges.lookahead:
                self._emit(out, len(self.held) - self.merges.lookahead)
        if last and self.held:
            self._emit(out, len(self.held))
        return out

    def _emit(self, out: list[int], safe: int) -> None:
        ids, _ = self.merges.merge([self.held])
        ends = np.cumsum([len(self.merges.bytes_of[i]) for i in ids.tolist()])
        n = int(np.searchsorted(ends, safe, side="right"))
        out += ids[:n].tolist()
        self.held = self.held[int(ends[n - 1]) if n else 0 :]


class _Open:
    """Text without a sure cut in sight: chunks in, ids out as soon as they are stable."""

    def __init__(self, merges: MergeList, window: int):
        self.merges, self.window = merges, window
        self.buf, self.kind, self.run = "", None, _Run(merges)
        self.hold = max([0, *map(len, merges.special)]) - 1
        self.raw = ""

    def feed(self, text: str, last: bool = False) -> Iterator[int]:
        self.raw += text
        at = 0
        for m in self.merges.marks.finditer(self.raw) if self.merges.marks else ():
            yield from self._plain(self.raw[at : m.start()], True)
            yield self.merges.special[m[0]]
            at = m.end()
        end = len(self.raw) if last else max(at, len(self.raw) - max(self.hold, 0))
        yield from self._plain(self.raw[at:end], last)
        self.raw = self.raw[end:]

    def _plain(self, text: str, last: bool) -> Iterator[int]:
        self.buf += text
        while self.buf:
            if self.kind is not None:
                end = self.kind.match(self.buf).end()
                whole = end == len(self.buf)
                closed = last if whole else True
                if self.kind is _SPACE and not (whole and last):
                    end = max(end - 1, 0)  # the last space may belong to what follows
                yield from self.run.feed(self.buf[:end].encode("utf-8", "surrogatepass"), closed)
                self.buf = self.buf[end:]
                if not closed:
                    return
                self.kind = None
                continue
            words, at = [], 0
            for m in PRETOKEN.finditer(self.buf):
                if not last and m.end() > len(self.buf) - 4:
                    break
                words.append(m[0].encode("utf-8", "surrogatepass"))
                at = m.end()
            yield from self.merges.merge(words)[0].tolist()
            self.buf = self.buf[at:]
            if last or len(self.buf) < self.window:
                break
            self.kind = next((run for start, run in _RUNS if start.match(self.buf)), _SPACE)
            if self.kind is not _SPACE:  # a leading space isn't part of the class
                yield from self.run.feed(self.buf[:2].encode("utf-8", "surrogatepass"), False)
                self.buf = self.buf[2:]
        if last and self.kind is not None:
            yield from self.run.feed(b"", True)
            self.kind = None


def _sliced(ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
    data, ends = ids.tobytes(), (4 * np.cumsum(counts)).tolist()
    return [data[a:b] for a, b in zip([0, *ends], ends)]


class Words:
    """Tokens of units, remembered by unit; transducers share it.

    A unit lies between two sure cuts: single spaces with no other white space
    beside them, where a pretoken ends whatever follows."""

    def __init__(self, merges: MergeList, limit: int = 600_000, room: int = 1 << 26):
        self.merges, self.limit, self.room = merges, limit, room
        # marks that are pretokens by themselves after a letter, with their ids
        self.stops = {c: merges.merge([c.encode()])[0].tobytes() for c in ".,;:!?)"}
        self.clear()

    def clear(self) -> None:
        self.first: dict[str, bytes | None] = {}  # at a text's start
        self.later: dict[str, bytes | None] = {}  # after a space, which is theirs
        self.odd: dict[str, bytes] = {}  # with white space inside, or special tokens; with the space before them
        self.size = 0

    def learn(self, first: set[str], later: set[str], odd: set[str]) -> None:
        """Looks all of these up, so that their tokens are here."""
        if len(self.first) + len(self.later) + len(self.odd) > self.limit or self.size > self.room:
            self.clear()
        marks, mixed, inner = self.merges.marks, [], []
        for memo, units, lead in ((self.first, first, ""), (self.later, later, " ")):
            letters, ended = [], []
            for u in units.difference(memo):
                if u.isalpha():
                    letters.append(u)
                elif u[-1:] in self.stops and u[:-1].isalpha():
                    ended.append(u)
                elif not u or u[0].isspace() or u[-1].isspace() or (marks and marks.search(u)):
                    memo[u] = None  # not between sure cuts
                else:
                    mixed.append((memo, u))
                    inner.append(PRETOKEN.findall(lead + u))
            bases = [u[:-1] for u in ended]  # letters and one mark: two pretokens
            letters += set(bases).difference(memo).difference(letters)
            if letters:
                memo.update(zip(letters, self._words(letters, lead)))
            memo.update(zip(ended, map(add, map(memo.__getitem__, bases), [self.stops[u[-1]] for u in ended])))
            self.size += sum(map(len, letters)) + sum(map(len, ended))
        for u in odd.difference(self.odd):
            mixed.append((self.odd, u))
            inner.append(self._parts(u))
        parts = list({w for ws in inner for w in ws})
        if not parts:
            return
        special = self.merges.special
        plain = [w for w in parts if w not in special]
        ids, counts = self.merges.merge([w.encode("utf-8", "surrogatepass") for w in plain])
        get = (dict(zip(plain, _sliced(ids, counts))) | {w: np.array([i], "<u4").tobytes() for w, i in special.items()}).__getitem__
        for (memo, u), ws in zip(mixed, inner):
            memo[u] = b"".join(map(get, ws))
            self.size += len(u)

    def _words(self, letters: list[str], lead: str) -> list[bytes]:
        """Ids of words of letters, which hold no space."""
        data = f" {' '.join(letters)}".encode("utf-8", "surrogatepass")
        buf = np.frombuffer(data, np.uint8)
        lens = np.diff(np.r_[np.flatnonzero(buf == 32), len(buf)])
        if not lead:
            data, lens = buf[buf != 32].tobytes(), lens - 1
        return _sliced(*self.merges.merge_buffer(data, lens))

    def _parts(self, text: str) -> list[str]:
        """Pretokens and special tokens, which are never pretokens of anything else."""
        if not self.merges.marks:
            return PRETOKEN.findall(text)
        out, at = [], 0
        for m in self.merges.marks.finditer(text):
            out += [*PRETOKEN.findall(text[at : m.start()]), m[0]]
            at = m.end()
        return out + PRETOKEN.findall(text[at:])


class Transducer:
    """Text chunks in, ids out as soon as they are stable; memory is a chunk and a window.

    What lies before the last sure cut is stable.  Where no cut comes within a
    window the merge list's lookahead decides, pretoken by pretoken."""

    def __init__(self, merges: MergeList, window: int = 4096, words: Words | None = None):
        self.merges, self.window, self.words = merges, window, words or Words(merges)
        self.open = _Open(merges, window)
        self.run = self.open.run
        self.buf, self.begun, self.opened = "", False, False
        self.ready, self.segment = b"", ""

    def take(self, text: str, last: bool = False) -> tuple[list[str], list[str]]:
        """Adds a chunk; returns the units it completes, those at the text's start and others."""
        self.buf = self.buf + text if self.buf else text
        end = len(self.buf) if last else self._cut()
        ids: list[int] = []
        if not end:
            if not last and (self.opened or len(self.buf) > self.window):
                ids += self.open.feed(self.buf[:-1])
                self.buf, self.opened, self.begun = self.buf[-1:], True, True
            segment = ""
        else:
            segment, self.buf = self.buf[:end], self.buf[end:]
        if self.opened and (segment or last):
            m = _CUT.search(segment) if self.merges.cuts else None
            ids += self.open.feed(segment[: m.start()] if m else segment, True)
            segment, self.opened = segment[m.start() :] if m else "", False
        self.ready, self.segment = np.array(ids, "<u4").tobytes(), segment
        if not segment:
            self.units = ([], [])
        elif not self.merges.cuts:
            self.units = ([""], []) if not self.begun else ([], [""])
        elif self.begun:
            self.units = ([], segment[1:].split(" "))
        else:
            head, *rest = segment.split(" ")
            self.units = ([head], rest)
        self.begun = self.begun or bool(segment)
        return self.units

    def give(self) -> bytes | None:
        """Ids of the units taken last, once they are learned; None: ask for odd() first."""
        try:
            return b"".join([self.ready, *map(self.words.first.__getitem__, self.units[0]), *map(self.words.later.__getitem__, self.units[1])])
        except TypeError:
            return None

    def odd(self) -> list[str]:
        """The units taken last, cut only where it is sure."""
        if not self.merges.cuts:
            return [self.segment]
        head, *rest = _CUT.split(self.segment[bool(not self.units[0]) :])
        return [head if self.units[0] else " " + head, *(" " + u for u in rest)]

    def give_odd(self) -> bytes:
        return b"".join([self.ready, *map(self.words.odd.__getitem__, self.odd())])

    def step(self, text: str, last: bool = False) -> bytes:
        first, later = self.take(text, last)
        self.words.learn(set(first), set(later), set())
        out = self.give()
        if out is None:
            self.words.learn(set(), set(), set(self.odd()))
            out = self.give_odd()
        return out

    def feed(self, text: str, last: bool = False) -> list[int]:
        return np.frombuffer(self.step(text, last), "<u4").tolist()

    def _cut(self) -> int:
        """Place of the last sure cut, 0 if there is none."""
        b = self.buf
        i = b.rfind(" ", 1, len(b) - 1) if self.merges.cuts else 0
        while i > 0 and (b[i - 1].isspace() or b[i + 1].isspace()):
            i = b.rfind(" ", 1, i)
        return max(i, 0)


class Encoder:
    """Encodes many texts, each by a transducer; ids come as little-endian 32-bit bytes.

    Transducers of short texts take a step together, so that one call of the
    merging kernel serves them all; a longer text is fed chunk by chunk."""

    def __init__(self, merges: MergeList, memo: int = 600_000, chunk: int = 1 << 18, group: int = 1 << 21):
        self.merges, self.chunk, self.group = merges, chunk, group
        self.words = Words(merges, memo)

    def pieces(self, texts: Iterable[str | None]) -> Iterator[tuple[bytes, bool]]:
        """Stable ids, text by text, and whether the text ends with them."""
        group, size = [], 0
        for text in texts:
            text = text or ""
            if len(text) > self.chunk:
                yield from self._together(group)
                group, size = [], 0
                t = Transducer(self.merges, words=self.words)
                for i in range(0, len(text), self.chunk):
                    yield t.step(text[i : i + self.chunk]), False
                yield t.step("", True), True
                continue
            group.append(text)
            size += len(text)
            if size > self.group:
                yield from self._together(group)
                group, size = [], 0
        yield from self._together(group)

    def _together(self, texts: list[str]) -> Iterator[tuple[bytes, bool]]:
        collects = gc.isenabled()
        gc.disable()  # nothing here is cyclic, and the memo is long to walk
        try:
            found = self._step(texts)
        finally:
            if collects:
                gc.enable()
        yield from ((ids, True) for ids in found)

    def _step(self, texts: list[str]) -> list[bytes]:
        bank = [Transducer(self.merges, words=self.words) for _ in texts]
        first, later = set(), set()
        for t, text in zip(bank, texts):
            a, b = t.take(text, True)
            first.update(a)
            later.update(b)
        self.words.learn(first, later, set())
        found = [t.give() for t in bank]
        rest = [t for t, ids in zip(bank, found) if ids is None]
        if rest:
            self.words.learn(set(), set(), {u for t in rest for u in t.odd()})
        return [t.give_odd() if ids is None else ids for t, ids in zip(bank, found)]

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The ids of each text, in order."""
        held = []
        for ids, ended in self.pieces(texts):
            if not ended or held:
                held.append(ids)
                ids = b"".join(held) if ended else b""
            if ended:
                held = []
                yield ids

    def stream(self, text: str) -> bytes:
        """The ids of one text, chunk by chunk."""
        t = Transducer(self.merges, words=self.words)
        return b"".join([*(t.step(text[i : i + self.chunk]) for i in range(0, len(text), self.chunk)), t.step("", True)])


class Decoder:
    """Ids in, text out; no more than a partial character is held."""

    def __init__(self, merges: MergeList):
        self.of, self.machine = merges.bytes_of.__getitem__, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int], last: bool = False) -> str:
        return self.machine.decode(b"".join(map(self.of, ids)), last)


def decode(merges: MergeList, ids: Iterable[int], step: int = 4096) -> Iterator[str]:
    """Text of a stream of ids, piece by piece."""
    machine = Decoder(merges)
    for some in batched(ids, step):
        yield machine.feed(some)
    yield machine.feed((), True)


@lru_cache(maxsize=4)
def load(path: str) -> MergeList:
    return MergeList(path)


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(load(path))
