"""Byte-level BPE encoding and decoding.

The merge ranks are compiled into a finite-state transducer that is determinised lazily: reading one byte moves to the
next state and emits the tokens that no longer depend on what follows. A state holds the longest run of bytes just read
that begins some token, and the tokens chosen since the last emission; the lookahead is therefore bounded by the longest
token. Transitions, with what they emit, are computed on first use and kept in a table of bounded size.

The short pieces of a group of texts that aren't kept from before pass the transducer together, byte by byte: at each
byte the transitions that some piece takes are determinised at once, in numpy, one for all pieces that share them. What a
transition rests on (the next run, whether two tokens stay apart) is kept from group to group in two tables of fixed size.

Decoding is streamed: ``StreamDecoder`` gives text as soon as characters are complete, driven by an incremental UTF-8
state machine; runs of tokens that are whole characters pass it at once.

Defined results: null text counts as empty (no tokens); any length of text is encoded whole; repeated rows give
repeated results; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Sequence
from contextlib import suppress
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, BooleanType, LongType, StructField, StructType

from .arrow import KEPT, map_slices, texts

KEPT_BYTES = 40 << 20  # memoised chunks and pieces that a worker keeps in each generation of each of its three tables
SHORT = 20  # characters of a chunk that is kept; longer ones hardly come again
MAX_MOVES = 300_000  # transitions kept, some 150 MB; the table is then started again
MAX_PAIRS = 400_000  # steps between runs kept, and pairs of tokens
WIDE = 32  # bytes of a piece that goes with others; nothing need be put out before its end
TOGETHER = 1 << 14  # pieces that go together
GROUP = 1 << 20  # characters of the texts whose new pieces are found together
STEPS, PAIRS = 1 << 17, 1 << 19  # places for steps between runs, and for pairs of tokens
PORTION = 1 << 16  # ids decoded at once
HELD = 512  # tokens held back at most, besides those of the longest run, where transitions aren't kept
SPACE = re.compile(r" (?=\S)")
ODD_SPACE = re.compile(r" \s")


State = tuple[int, int, tuple[int, ...]]  # node of the run, last token put out (-1: none), tokens that end at each boundary since


class MergeTransducer:
    """Encodes one piece at a time. Of the tokens that end at a boundary, the longest that stays apart from the token
    before it is the one that merging gives for the bytes up to there; only boundaries within the run can still be
    where a later token starts, so what lies before their common past is put out."""

    def __init__(self, ranks: dict[bytes, int], share: float = 1):
        self.ranks, self.share = ranks, share
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        self.child: dict[int, int] = {}  # (node << 8 | byte) -> node; node 0 is the root
        self.token_at: dict[int, int] = {}
        self.depth = [0]
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
            at = 0
            for b in token:
                key = at << 8 | b
                nxt = self.child.get(key)
                if nxt is None:
                    nxt = self.child[key] = len(self.depth)
                    self.depth.append(self.depth[at] + 1)
                at = nxt
            self.token_at[at] = rank
        self.length = [len(t) for t in self.bytes_of]
        self.runs: dict[int, int] = {}
        self.shorter: dict[int, int] = {0: 0}  # the node for the run without its first byte
        self.ending: dict[int, tuple[tuple[int, int], ...]] = {0: ()}  # tokens that may end here, longest first
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.pairs: dict[int, bool] = {}
        self.restart()

    def restart(self) -> None:
        """Forget all transitions; state 0 is the start."""
        self.states: list[State] = [(0, -1, ())]
        self.known: dict[State, int] = {self.states[0]: 0}
        self.moves: dict[int, tuple[int, tuple[int, ...]]] = {}  # (state << 8 | byte) -> next state, tokens put out
        self.asked: set[int] = set()  # transitions asked for once

    def merge(self, piece: bytes, keep: int = 1) -> list[int]:
        """The definition: join the adjacent pair of lowest rank, leftmost first, until none is left (or ``keep`` parts)."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > keep:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = self.ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a byte."""
        if token not in self.halves:
            parts = self.merge(self.bytes_of[token], keep=2)
            self.halves[token] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self.halves[token]

    def follows(self, left: int, right: int) -> bool:
        """Whether merging leaves these two tokens apart when they stand side by side.

        Undo the merges of both in the order opposite to that in which they are done; the tokens stay apart unless, at
        some moment, the two parts that touch could merge before the next merge inside either token.
        """
        if left < 0:
            return True
        if len(self.pairs) >= MAX_PAIRS:
            self.pairs.clear()
        a, b, ok, bound = left, right, True, len(self.bytes_of)
        while True:
            joined = self.ranks.get(self.bytes_of[a] + self.bytes_of[b])
            if joined is not None and joined < bound:
                ok = False
                break
            x, y = self.split(a), self.split(b)
            if x is None and y is None:
                break
            if y is None or (x is not None and a > b):
                bound = a  # ties: the left one merges first
                a = x[1]
            else:
                bound = b + 1  # at the same rank the touching pair is further left
                b = y[0]
        self.pairs[left << 32 | right] = ok
        return ok

    def _run(self, node: int, byte: int) -> int:
        """The node of the longest run after one more byte."""
        key = node << 8 | byte
        got = self.runs.get(key)
        if got is not None:
            return got
        to, at = self.child.get(key), node
        while to is None and at:
            at = self.shorter[at]
            to = self.child.get(at << 8 | byte)
        if to is None:
            to = 0
        if to not in self.shorter:
            self.shorter[to] = self._run(self.shorter[at], byte) if at else 0
            own = self.token_at.get(to, -1)
            self.ending[to] = (((own, self.length[own]),) if own >= 0 else ()) + self.ending[self.shorter[to]]
        if len(self.runs) > MAX_PAIRS:
            self.runs.clear()
        self.runs[key] = to
        return to

    def ends_here(self, node: int, left: int, ends: Sequence[int]) -> int:
        """The token that ends after one more byte, when the run is at ``node``."""
        have, pairs = len(ends) + 1, self.pairs
        for token, length in self.ending[node]:
            start = have - length
            if start >= 0:
                before = ends[start - 1] if start else left
                ok = before < 0 or pairs.get(before << 32 | token)
                if ok or ok is None and self.follows(before, token):
                    return token
        raise ValueError("no token covers a byte")

    def release(self, node: int, left: int, ends: Sequence[int]) -> tuple[tuple[int, ...], int, Sequence[int]]:
        """What can't change any more: the tokens up to where the paths to all boundaries meet from which a later token may start."""
        have = len(ends)
        if self.depth[node] >= have:
            return (), left, ends
        length, alive = self.length, (2 << self.depth[node]) - 1 << have - self.depth[node]  # a bit a boundary
        while alive & (alive - 1):
            last = alive.bit_length() - 1
            alive = alive ^ 1 << last | 1 << last - length[ends[last - 1]]
        cut = alive.bit_length() - 1
        return (self.path(ends, cut), ends[cut - 1], ends[cut:]) if cut else ((), left, ends)

    def step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """Determinise one transition: the next state, and the tokens put out on the way."""
        node, left, ends = self.states[state]
        node = self._run(node, byte)
        put, left, ends = self.release(node, left, (*ends, self.ends_here(node, left, ends)))
        after = (node, left, ends)
        number = self.known.get(after)
        if number is None:
            number = self.known[after] = len(self.states)
            self.states.append(after)
        out = self.moves[state << 8 | byte] = (number, put)
        return out

    def path(self, ends: Sequence[int], at: int) -> tuple[int, ...]:
        """The tokens that lead to a boundary."""
        out = []
        while at > 0:
            out.append(ends[at - 1])
            at -= self.length[ends[at - 1]]
        return tuple(out[::-1])

    def encode(self, piece: bytes) -> list[int]:
        """The tokens of a piece. A transition is determinised when it is asked for the second time, one a piece at most, as the state behind it has none yet; the rest of the piece is run without."""
        most = MAX_MOVES * self.share
        if len(self.moves) > most:
            self.restart()
        out: list[int] = []
        state, moves, asked, made = 0, self.moves, self.asked, False
        for i, byte in enumerate(piece):
            move = moves.get(state << 8 | byte)
            if move is None:
                key = state << 8 | byte
                if made or key not in asked:
                    if not made:
                        if len(asked) >= most:
                            asked.clear()
                        asked.add(key)
                    return out + self._rest(state, piece[i:])
                move, made = self.step(state, byte), True
            state, put = move
            if put:
                out += put
        ends = self.states[state][2]
        return out + list(self.path(ends, len(ends)))

    def _rest(self, state: int, piece: bytes) -> list[int]:
        node, left, known = self.states[state]
        ends, out = [left, *known], []  # the token before the first boundary stands in front
        runs, ending, pairs = self.runs, self.ending, self.pairs
        have = len(ends)
        for byte in piece:
            to = runs.get(node << 8 | byte)
            node = self._run(node, byte) if to is None else to
            for token, length in ending[node]:
                if length <= have:
                    before = ends[-length]
                    if before < 0:
                        break
                    ok = pairs.get(before << 32 | token)
                    if ok or ok is None and self.follows(before, token):
                        break
            else:
                raise ValueError("no token covers a byte")
            ends.append(token)
            have += 1
            if have > HELD:
                put, left, rest = self.release(node, ends[0], ends[1:])
                ends = [left, *rest]
                have = len(ends)
                out += put
        return out + list(self.path(ends[1:], have - 1))


def spread(key: np.ndarray, places: int) -> np.ndarray:
    """The place of a key in a table of ``places``, a power of two."""
    return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(65 - places.bit_length())).astype(np.int64)


class Lockstep:
    """Many short pieces through one transducer. Pieces are sorted, so that those with a prefix in common, which have a state in common, stand together."""

    def __init__(self, t: MergeTransducer):
        self.transducer, self.none = t, len(t.bytes_of)
        n = len(t.depth)
        self.depth, self.length = np.array(t.depth, np.int32), np.array(t.length, np.int32)
        self.token = np.full(n, -1, np.int32)
        self.token[np.fromiter(t.token_at, np.int64, len(t.token_at))] = np.fromiter(t.token_at.values(), np.int64, len(t.token_at))
        edges, to = np.fromiter(t.child, np.int64, len(t.child)), np.fromiter(t.child.values(), np.int64, len(t.child))
        order = np.argsort(edges)
        self.edges, self.to = edges[order], to[order]
        self.steps, self.apart = np.full(STEPS, -1, np.int64), np.full(PAIRS, -1, np.int64)  # key and what it gives, in one number
        at, byte = np.zeros(n, np.int64), np.zeros(n, np.int64)
        at[to], byte[to] = edges >> 8, edges & 255
        self.shorter, self.last = np.zeros(n, np.int64), np.zeros(n, np.int64)  # last: the longest suffix of the run that is a token
        by_depth = np.argsort(self.depth, kind="stable")
        for nodes in np.split(by_depth, np.flatnonzero(np.diff(self.depth[by_depth])) + 1)[1:]:
            if self.depth[nodes[0]] > 1:
                self.shorter[nodes] = self._run(self.shorter[at[nodes]], byte[nodes])
            self.last[nodes] = np.where(self.token[nodes] >= 0, nodes, self.last[self.shorter[nodes]])
        ranks = t.ranks
        joins = {ranks[x[:i]] << 32 | ranks[x[i:]]: rank for x, rank in ranks.items() for i in range(1, len(x)) if x[:i] in ranks and x[i:] in ranks}
        keys, values = np.fromiter(joins, np.int64, len(joins)), np.fromiter(joins.values(), np.int64, len(joins))
        order = np.argsort(keys)
        self.joins, self.joined = np.append(keys[order], -1), np.append(values[order], self.none)
        self.left, self.right = np.full(self.none, -2, np.int64), np.full(self.none, -2, np.int64)  # -2: not asked yet, -1: a byte

    def _run(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        out, live, node = np.zeros(len(node), np.int64), np.arange(len(node)), node.copy()
        while len(live) and len(self.edges):
            key = node[live] << 8 | byte[live]
            at = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
            found = self.edges[at] == key
            out[live[found]] = self.to[at[found]]
            live = live[~found & (node[live] > 0)]
            node[live] = self.shorter[node[live]]
        return out

    def run(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The nodes of the longest runs after one more byte each."""
        key = node << 8 | byte
        place = spread(key, STEPS)
        got = self.steps[place]
        out, new = got & 0xFFFFFF, np.flatnonzero(got >> 24 != key)
        if len(new):
            out[new] = self._run(node[new], byte[new])
            self.steps[place[new]] = key[new] << 24 | out[new]
        return out

    def _halves(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for token in np.unique(tokens[self.left[tokens] == -2]).tolist():
            self.left[token], self.right[token] = self.transducer.split(token) or (-1, -1)
        return self.left[tokens], self.right[tokens]

    def _follows(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``MergeTransducer.follows`` for many pairs."""
        a, b, bound, ok, live = left.copy(), right.copy(), np.full(len(left), self.none), np.ones(len(left), bool), np.arange(len(left))
        while len(live):
            key = a[live] << 32 | b[live]
            at = np.searchsorted(self.joins[:-1], key)
            bad = (self.joins[at] == key) & (self.joined[at] < bound[live])
            ok[live[bad]] = False
            live = live[~bad]
            (_, x), (y, _) = self._halves(a[live]), self._halves(b[live])
            whole = (x < 0) & (y < 0)
            live, x, y = live[~whole], x[~whole], y[~whole]
            first = (y < 0) | (x >= 0) & (a[live] > b[live])
            one, other = live[first], live[~first]
            bound[one], bound[other] = a[one], b[other] + 1
            a[one], b[other] = x[first], y[~first]
        return ok

    def follows(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        place = spread(key, PAIRS)
        got = self.apart[place]
        out, new = (got & 1).astype(bool), np.flatnonzero(got >> 1 != key)
        if len(new):
            some, back = np.unique(key[new], return_inverse=True)
            out[new] = self._follows(some >> 32, some & 0xFFFFFFFF)[back]
            self.apart[place[new]] = key[new] << 1 | out[new]
        return out

    def ends_here(self, node: np.ndarray, ends: np.ndarray, have: int) -> np.ndarray:
        """The token that ends after ``have`` bytes, by state; ``ends`` holds those that end at each boundary before, and -1 at the start."""
        out, at, live = np.empty(len(node), np.int64), self.last[node], np.arange(len(node))
        while len(live):
            if not at.all():
                raise ValueError("no token covers a byte")
            token = self.token[at].astype(np.int64)
            before = ends[live, have - self.depth[at]].astype(np.int64)
            ok = before < 0
            some = np.flatnonzero(~ok)
            ok[some] = self.follows(before[some], token[some])
            out[live[ok]] = token[ok]
            live, at = live[~ok], self.last[self.shorter[at[~ok]]]
        return out

    def encode(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """Ids, as little-endian bytes, of different pieces of 1 to WIDE bytes."""
        pieces = sorted(pieces)
        n, lengths = len(pieces), np.array([len(p) for p in pieces])
        width = int(lengths.max())
        data = np.frombuffer(b"".join([p.ljust(width, b"\0") for p in pieces]), np.uint8).reshape(n, width).astype(np.int64)
        other, state, rows = np.arange(n) == 0, np.zeros(n, np.int64), np.arange(n)  # other: not the prefix of the piece before
        node, ends, last = np.zeros(1, np.int64), np.full((1, width + 1), -1, np.int32), np.empty((n, width + 1), np.int32)
        for have in range(1, width + 1):
            other[1:] |= data[1:, have - 1] != data[:-1, have - 1]
            rows = rows[lengths[rows] >= have]
            prefix = np.cumsum(other)[rows]
            new = np.append(True, prefix[1:] != prefix[:-1])
            before = state[rows[new]]
            node, ends = self.run(node[before], data[rows[new], have - 1]), ends.take(before, 0)
            ends[:, have] = self.ends_here(node, ends, have)
            state[rows] = np.cumsum(new) - 1
            whole = rows[lengths[rows] == have]
            last[whole] = ends[state[whole]]
        out, at, rows = np.full((n, width), -1, np.int32), lengths.copy(), np.arange(n)
        for back in range(1, width + 1):  # the tokens that lead to the end, from there
            token = last[rows, at[rows]]
            out[rows, width - back] = token
            at[rows] -= self.length[token]
            rows = rows[at[rows] > 0]
            if not len(rows):
                break
        real = out >= 0
        raw, stops = out[real].astype("<u4").tobytes(), (4 * np.cumsum(real.sum(1))).tolist()
        return {p: raw[a:b] for p, a, b in zip(pieces, [0, *stops], stops, strict=False)}


class Recent(dict):
    """Ids, as little-endian bytes, of the short chunks seen lately: two generations of a bounded number of bytes, the older one dropped when the newer is full."""

    def __init__(self, encode, prefix: str = "", share: float = 1):
        super().__init__()
        self.compute, self.prefix, self.older, self.share = encode, prefix, {}, share
        self.room = KEPT_BYTES * share
        self.long: dict[str, bytes] = {}  # the longer chunks of the group of texts at hand

    def __missing__(self, chunk: str) -> bytes:
        if len(chunk) > SHORT:
            got = self.long.get(chunk)
            return self.compute(self.prefix + chunk) if got is None else got
        got = self.older.get(chunk)
        if got is None:
            got = self.compute(self.prefix + chunk)
        self.make_room()
        self.keep(chunk, got)
        return got

    def keep(self, chunk: str, got: bytes) -> None:
        self.room -= 4 * len(chunk) + len(got) + 180  # with what Python needs for two objects and a place
        self[chunk] = got

    def make_room(self) -> None:
        if self.room < 0:
            self.older, self.room = dict(self), KEPT_BYTES * self.share
            self.clear()

    def missing(self, chunks: set[str]) -> set[str]:
        """Those that aren't there. What the older generation has comes over."""
        new = chunks.difference(self)
        old = {c: self.older[c] for c in new if c in self.older}
        new.difference_update(old)
        self.put(old)
        return new

    def put(self, found: dict[str, bytes]) -> None:
        long = {c: x for c, x in found.items() if len(c) > SHORT}
        self.long |= long
        for c in long:
            del found[c]
        self.room -= 4 * sum(map(len, found)) + sum(map(len, found.values())) + 180 * len(found)
        self.update(found)


def utf8_step(state: tuple[int, int, int], byte: int) -> tuple[int, int, int] | None:
    """State: bytes still wanted, then the range of the next one. None: the byte can't come here."""
    want, low, high = state
    if want:
        return ((want - 1, 0x80, 0xBF) if want > 1 else START) if low <= byte <= high else None
    if byte < 0x80:
        return (0, 0, 0)
    if 0xC2 <= byte <= 0xDF:
        return (1, 0x80, 0xBF)
    if 0xE0 <= byte <= 0xEF:
        return (2, 0xA0 if byte == 0xE0 else 0x80, 0x9F if byte == 0xED else 0xBF)
    if 0xF0 <= byte <= 0xF4:
        return (3, 0x90 if byte == 0xF0 else 0x80, 0x8F if byte == 0xF4 else 0xBF)
    return None


START = (0, 0, 0)


class StreamDecoder:
    """Feed ids in any portions; get text as soon as its characters are complete. Ill-formed bytes become U+FFFD."""

    def __init__(self, bpe: ByteBPE):
        self.bpe, self.state, self.held = bpe, START, b""
        self.well_formed = True

    def feed(self, ids: np.ndarray) -> str:
        ids = np.asarray(ids, np.int64)
        bytes_of = self.bpe.bytes_of
        if self.state == START:
            with suppress(UnicodeDecodeError):  # mostly all of it is whole characters
                return self.bpe.joined(ids).decode()
        cut = np.flatnonzero(~self.bpe.whole[ids])  # tokens that begin or end within a character
        out, i, n = [], 0, len(ids)
        while i < n:
            if self.state == START:
                j = np.searchsorted(cut, i)
                end = int(cut[j]) if j < len(cut) else n
                out.append(self.bpe.joined(ids[i:end]).decode())
                i = end
                if i == n:
                    break
            out.append(self._bytes(bytes_of[ids[i]]))
            i += 1
        return "".join(out)

    def _bytes(self, token: bytes) -> str:
        out = ""
        for b in token:
            nxt = utf8_step(self.state, b)
            if nxt is None:
                self.well_formed = False
                out += "\ufffd"
                nxt = utf8_step(START, b) if self.held else None
                self.held = b""
                if nxt is None:
                    self.state = START
                    continue
            self.held, self.state = self.held + bytes([b]), nxt
            if nxt == START:
                out += self.held.decode()
                self.held = b""
        return out

    def finish(self) -> str:
        rest, self.held, self.state = self.held, b"", START
        self.well_formed = self.well_formed and not rest
        return "\ufffd" if rest else ""


class ByteBPE:
    """``share`` is that of the usual tables' size, for work beside which there is less memory; ids don't depend on it."""

    def __init__(self, path: str, pattern: str, share: float = 1):
        import regex

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.split = regex.compile(pattern).findall
        self.transducer = MergeTransducer(ranks, share)
        self.bytes_of = self.transducer.bytes_of
        encode = lambda piece: array("I", self.transducer.encode(piece.encode())).tobytes()
        self.pieces = Recent(encode, share=share)

        def by_piece(chunk: str) -> bytes:
            pieces = self.split(chunk)
            return b"".join(map(self.pieces.__getitem__, pieces)) if len(pieces) != 1 else encode(pieces[0])

        self.lockstep = Lockstep(self.transducer)

        def shared(chunk: str) -> bytes:
            """A piece that opens with a space is a chunk of its own, as the pattern leaves it whole, and is kept as such."""
            pieces = self.split(chunk)
            return b"".join([self.rest[p[1:]] if p[0] == " " else self.pieces[p] for p in pieces]) if len(pieces) != 1 else encode(pieces[0])

        self.first, self.rest = Recent(by_piece, share=share), Recent(shared, " ", share)
        self.by_piece, self.chunked = by_piece, pattern == defaults()[1]
        self.whole = np.array([self._is_whole(t) for t in self.bytes_of], bool)
        self.lengths = np.array([len(t) for t in self.bytes_of], np.int64)
        self.starts, self.flat = np.cumsum(self.lengths) - self.lengths, np.frombuffer(b"".join(self.bytes_of), np.uint8)

    @staticmethod
    def _is_whole(token: bytes) -> bool:
        """Whether a token is whole characters."""
        state: tuple[int, int, int] | None = START
        for b in token:
            state = utf8_step(state, b) if state is not None else None
        return state == START

    def encode_bytes(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers.

        In the usual pattern a piece never goes on over a space that stands before a visible character, so such text is
        first cut there and the pattern only reads chunks not seen lately.
        """
        if not self.chunked:
            return self.by_piece(text)
        chunks = self.chunks(text)
        return self.first[chunks[0]] + b"".join(map(self.rest.__getitem__, chunks[1:]))

    @staticmethod
    def chunks(text: str) -> list[str]:
        return SPACE.split(text) if ODD_SPACE.search(text) else text.split(" ")

    def encode_texts(self, texts: list[str | None]) -> list[bytes]:
        """``encode_bytes`` of many texts, where new pieces of a group go together. Null gives b""."""
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and size < GROUP:
                size += len(texts[end] or "")
                end += 1
            out += self._group(texts[at:end])
            at = end
        return out

    def _group(self, texts: list[str | None]) -> list[bytes]:
        for table in (self.first, self.rest, self.pieces):
            table.make_room()
        if not self.chunked:
            pieces = [self.split(t) if t else [] for t in texts]
            ids = self._learn({p for own in pieces for p in own})
            out = [b"".join([ids[p] for p in own]) for own in pieces]
        else:
            chunks = [self.chunks(t) if t else [] for t in texts]
            self._learn_chunks(self.first, {own[0] for own in chunks if own})
            self._learn_chunks(self.rest, set().union(*[own[1:] for own in chunks]))
            out = [self.first[own[0]] + b"".join(map(self.rest.__getitem__, own[1:])) if own else b"" for own in chunks]
        for table in (self.first, self.rest, self.pieces):
            table.long = {}
        return out

    def _learn_chunks(self, table: Recent, chunks: set[str]) -> None:
        """Put the chunks into their table. Those after a space are read as one text, which the pattern cuts at each of them."""
        new = list(table.missing(chunks))
        pieces = self.split(" " + " ".join(new)) if table.prefix else []
        stops = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        wanted = np.cumsum(np.fromiter(map(len, new), np.int64, len(new)) + 1)
        places = np.searchsorted(stops, wanted)
        if not len(stops) or len(new) and not np.array_equal(stops[np.minimum(places, len(stops) - 1)], wanted):
            own = [self.split(table.prefix + c) for c in new]
            pieces, places = [p for x in own for p in x], np.cumsum([len(x) for x in own], dtype=np.int64) - 1
        ids = list(map(self._learn(set(pieces)).__getitem__, pieces))
        ends = (places + 1).tolist()
        table.put({c: ids[a] if b - a == 1 else b"".join(ids[a:b]) for c, a, b in zip(new, [0, *ends], ends, strict=False)})

    def _learn(self, pieces: set[str]) -> dict[str, bytes]:
        """The ids of pieces, which are kept."""
        new = list(self.pieces.missing(pieces))
        raw = [p.encode() for p in new]
        found: dict[bytes, bytes] = {}
        short = [x for x in raw if 0 < len(x) <= WIDE]
        for at in range(0, len(short), TOGETHER):
            found |= self.lockstep.encode(short[at : at + TOGETHER])
        ids = {p: found[x] if x in found else array("I", self.transducer.encode(x)).tobytes() for p, x in zip(new, raw, strict=True)}
        self.pieces.put(dict(ids))
        for p in pieces.difference(ids):
            ids[p] = self.pieces[p]
        return ids

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()

    def joined(self, ids: np.ndarray) -> bytes:
        """The bytes of the tokens."""
        n = self.lengths[ids]
        shift = self.starts[ids] - (np.cumsum(n) - n)
        return self.flat[np.repeat(shift, n) + np.arange(n.sum())].tobytes()

    def decode(self, ids: np.ndarray) -> tuple[str, bool]:
        """The text, portion by portion, and whether its bytes were well-formed."""
        stream = StreamDecoder(self)
        out = [stream.feed(ids[at : at + PORTION]) for at in range(0, len(ids), PORTION)]
        return "".join([*out, stream.finish()]), stream.well_formed


@lru_cache(maxsize=2)
def load(path: str, pattern: str, share: float = 1) -> ByteBPE:
    return ByteBPE(path, pattern, share)


def let_go() -> bool:
    """Forget the tables, which stay between tasks of this module alone."""
    any_there = load.cache_info().currsize > 0
    load.cache_clear()
    return any_there


KEPT["bpe"] = let_go


def defaults() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, ids (little-endian unsigned 32-bit integers), n_tokens."""

    def make():
        bpe = load(path, pattern)

        def do(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = bpe.encode_texts(batch.column(1).to_pylist())
            return pa.record_batch([batch.column(0), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())], ["doc_id", "ids", "n_tokens"])

        return do

    return map_slices(texts(docs, id_col, text_col), make, "doc_id long, ids binary, n_tokens long", "bpe")


def with_ids(docs: DataFrame, path: str, pattern: str, text_col: str = "text", share: float = 1) -> DataFrame:
    """All columns of the documents, and ids, n_tokens and decodes: whether decoding the ids gives the text again. Null text has no tokens."""
    at = docs.columns.index(text_col)

    def make():
        bpe = load(path, pattern, share)

        def do(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(at).to_pylist()
            ids = bpe.encode_texts(texts)
            same = [bpe.decode(np.frombuffer(raw, "<u4"))[0] == (text or "") for text, raw in zip(texts, ids, strict=True)]
            return pa.record_batch([*batch.columns, pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(same, pa.bool_())], [*batch.schema.names, "ids", "n_tokens", "decodes"])

        return do

    return map_slices(docs, make, StructType([*docs.schema.fields, StructField("ids", BinaryType()), StructField("n_tokens", LongType()), StructField("decodes", BooleanType())]), "bpe")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """The inverse of ``encode``: doc_id, text; ids that don't make UTF-8 give U+FFFD for the broken bytes."""

    def make():
        bpe = load(path, pattern)

        def do(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = [bpe.decode(np.frombuffer(raw or b"", "<u4"))[0] for raw in batch.column(1).to_pylist()]
            return pa.record_batch([batch.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

        return do

    return map_slices(encoded.select("doc_id", "ids"), make, "doc_id long, text string", "bpe")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode and decode every text: doc_id, n_tokens, ids_sha256, decoded_sha256, well_formed."""

    def make():
        bpe = load(path, pattern)
        sha = hashlib.sha256

        def do(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, a, b, ok = [], [], [], []
            for raw in bpe.encode_texts(batch.column(1).to_pylist()):
                ids = np.frombuffer(raw, "<u4")
                n.append(len(ids))
                a.append(sha(raw).hexdigest())
                back, well_formed = bpe.decode(ids)
                b.append(sha(back.encode()).hexdigest())
                ok.append(well_formed)
            return pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(ok, pa.bool_())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "well_formed"])

        return do

    return map_slices(texts(docs), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, well_formed boolean", "bpe")
