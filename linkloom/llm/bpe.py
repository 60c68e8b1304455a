"""Byte-level BPE by a lazily determinised transducer, and decoding by an incremental UTF-8 machine.

Merging by rank fixes, for every prefix of a piece, the last token of that prefix's encoding: a
token sequence is the encoding if and only if each adjacent pair encodes to itself. So the
transducer reads a piece byte by byte and says of each prefix which token ends it. Its state is the
set of positions from which a token may still end later, each a trie node and the last token before
it. A byte moves the trie nodes; the one token that ends here and fits the last token before it is
the prefix's. At nodes above ``SMALL`` tokens or fewer, last tokens after which the same of these
fit are one, and positions after which none fits are let go, so that states of different pasts meet
and their number flattens. Tokens are emitted by walking back from prefix to prefix: at a piece's
end, and in long ones after ``AHEAD`` bytes up to the place that all live positions share.

States and transitions are made when first met. When ``STATES`` are held, all are let go and made
anew; so are remembered pieces beyond ``PIECES`` or ``HELD`` bytes, tested pairs beyond ``PAIRS`` and
met positions beyond ``MET``. Each step is the same whatever is held. Ranks are below 2**20 - 1.

A piece that is itself a token is that token, as in the rank library. Null texts encode to no ids
like empty ones; repeated rows and null ids pass through; other columns, whatever their names, are
ignored; texts are whole whatever their length, as pieces are joined as they come; an empty table
gives an empty result.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import sys
from array import array
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm import worker

STATES, PIECES, HELD, PAIRS, MET, SMALL, AHEAD = 100_000, 250_000, 16 << 20, 100_000, 50_000, 32, 4096
_BITS = 20
_MASK = (1 << _BITS) - 1
_CHUNK, _LONG = 1 << 16, 1 << 20


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def merge_by_rank(piece: bytes, ranks: dict[bytes, int], below: int = 1 << 40) -> list[bytes]:
    """The definition: merge the adjacent pair of least rank, leftmost first, until none is left that ranks below the limit."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, at = min((ranks.get(a + b, 1 << 40), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if rank >= below:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Transducer:
    """Ids of a piece, by states that are built on demand."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.tokens = ranks, {r: t for t, r in ranks.items()}
        self.child: dict[int, int] = {}
        ends: dict[int, int] = {}
        nodes = 1
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                nxt = self.child.get(node << 8 | byte)
                if nxt is None:
                    nxt = self.child[node << 8 | byte] = nodes
                    nodes += 1
                node = nxt
            ends[node] = rank
        self.ends = array("i", (ends.get(node, -1) for node in range(nodes)))
        self.kid, self.next, self.depth, self.under = (array("i", bytes(4 * nodes)) for _ in range(4))  # kid: the first child, next: a node's next sibling (0: none)
        for key, node in self.child.items():  # parents come before their children
            above = key >> 8
            self.kid[above], self.next[node] = node, self.kid[above]
            self.depth[node] = self.depth[above] + 1
        for key, node in reversed(self.child.items()):  # under: tokens strictly below a node
            self.under[key >> 8] += self.under[node] + (self.ends[node] >= 0)
        self.size = {rank: len(token) for token, rank in ranks.items()}
        self.spines: dict[int, tuple | None] = {}
        self.pairs: dict[int, bool] = {}
        self._clear()

    def _clear(self) -> None:
        self.ids: dict[bytes, int] = {}
        self.states: list[bytes] = []
        self.moves: dict[int, int] = {}
        self.met: dict[int, int] = {}
        self.first: dict[int, int] = {}
        self._state(_packed((_position(0, -1),)))

    def _state(self, state: bytes) -> int:
        at = self.ids.get(state)
        if at is None:
            at = self.ids[state] = len(self.states)
            self.states.append(state)
        return at

    def spine(self, token: int) -> tuple | None:
        """((bytes, rank of the next merge), ...) up the left and the right edge of a token's merges; None if it isn't its own encoding."""
        if token not in self.spines:
            data = self.tokens[token]
            own = (data, token)
            if len(data) == 1:
                found = (own,), (own,)
            else:
                parts = merge_by_rank(data, self.ranks, below=token)
                ways = [self.spine(self.ranks[p]) for p in parts] if len(parts) == 2 else [None]
                found = None if None in ways else ((*ways[0][0], own), (*ways[1][1], own))
            self.spines[token] = found
        return self.spines[token]

    def fits(self, left: int, token: int) -> bool:
        """Whether the token stands by itself after left (-1: at the start).

        Merges run by rank, so the pair breaks if a merge across the border ranks before those
        that finish what it needs: walk up left's right edge and token's left edge in rank order.
        """
        pair = left + 1 << 24 | token
        known = self.pairs.get(pair)
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[pair] = self._fits(left, token)
        return known

    def _fits(self, left: int, token: int) -> bool:
        own = self.spine(token)
        if own is None or left < 0:
            return own is not None
        a, b, i, j, never = self.spine(left)[1], own[0], 0, 0, 1 << 40
        while True:
            up = a[i + 1][1] if i + 1 < len(a) else never
            down = b[j + 1][1] if j + 1 < len(b) else never
            across = self.ranks.get(a[i][0] + b[j][0], never)
            if across < up and across <= down and across < never:
                return False
            if up == down == never:
                return True
            if up <= down:
                i += 1
            else:
                j += 1

    def _below(self, node: int) -> Iterator[int]:
        kid = self.kid[node]
        while kid:
            if self.ends[kid] >= 0:
                yield self.ends[kid]
            yield from self._below(kid)
            kid = self.next[kid]

    def _meet(self, node: int, left: int) -> int:
        """The position that stands for all with this node after which the same tokens fit; -1 if none does."""
        fit = 0
        for k, token in enumerate(self._below(node)):
            fit |= self.fits(left, token) << k
        return self.first.setdefault(node << SMALL | fit, _position(node, left)) if fit else -1

    def _move(self, at: int, byte: int) -> int:
        """The next state and the token that ends here, after a byte, as one integer."""
        if len(self.met) >= MET:
            self.met.clear()
        if len(self.states) >= STATES:
            live = self.states[at]
            self._clear()
            at = self._state(live)
        here, after = -1, []
        for position in array("q", self.states[at]):
            node, left = self.child.get((position >> _BITS) << 8 | byte), (position & _MASK) - 1
            if node is None:
                continue
            token = self.ends[node]
            if here < 0 <= token and self.fits(left, token):
                here = token
            if self.under[node]:
                now = _position(node, left)
                if self.under[node] <= SMALL:
                    met = self.met.get(now)
                    if met is None:
                        met = self.met[now] = self._meet(node, left)
                    now = met
                if now >= 0:
                    after.append(now)
        move = self.moves[at << 8 | byte] = self._state(_packed((*after, _position(0, here)))) << _BITS | here
        return move

    def encode(self, piece: bytes) -> list[int]:
        """Ids of a piece."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        at, last, out, known, look = 0, [], [], self.moves.get, AHEAD
        for byte in piece:
            move = known(at << 8 | byte)
            if move is None:
                move = self._move(at, byte)
                known = self.moves.get
            at = move >> _BITS
            last.append(move & _MASK)
            if len(last) == look:
                last = last[self._emit(last, {len(last) - self.depth[p >> _BITS] for p in array("q", self.states[at])}, out) :]
                look = len(last) + AHEAD
        self._emit(last, {len(last)}, out)
        return out

    def _emit(self, last: list[int], ends: set[int], out: list[int]) -> int:
        """Append the tokens up to the place that the encodings of all these prefixes share, and return it."""
        size = self.size
        while len(ends) > 1:
            end = max(ends)
            ends.remove(end)
            ends.add(end - size[last[end - 1]])
        (shared,) = ends
        back, end = [], shared
        while end:
            back.append(last[end - 1])
            end -= size[back[-1]]
        out += reversed(back)
        return shared


def _position(node: int, left: int) -> int:
    """A trie node and the token before it (-1: none) as one integer."""
    return node << _BITS | left + 1


def _packed(positions: tuple[int, ...]) -> bytes:
    """Positions in a row of 64-bit integers, which takes a third of a tuple's memory."""
    return array("q", positions).tobytes()


class Encoder(dict):
    """Piece to its ids as packed little-endian 32-bit integers."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        super().__init__()
        self.machine, self.split = Transducer(ranks), regex.compile(pattern)
        self.tokens, self.held = self.machine.tokens, 0

    def __missing__(self, piece: str) -> bytes:
        ids = array("I", self.machine.encode(piece.encode()))
        if sys.byteorder == "big":
            ids.byteswap()
        packed = ids.tobytes()
        size = sys.getsizeof(piece) + sys.getsizeof(packed)
        if len(self) >= PIECES or self.held + size > HELD:
            self.clear()
            self.held = 0
        if size <= HELD:
            self[piece] = packed
            self.held += size
        return packed

    def encode(self, text: str) -> bytes:
        """Packed ids of a text."""
        pieces = self.split.findall(text) if len(text) < _LONG else (m[0] for m in self.split.finditer(text))
        return b"".join(map(self.__getitem__, pieces))


_NEED = [1] * 192 + [2] * 32 + [3] * 16 + [4] * 8 + [1] * 8


class Utf8Machine:
    """Text from bytes that come in any cuts; ill-formed bytes become U+FFFD."""

    def __init__(self) -> None:
        self.held = b""

    def feed(self, data: bytes) -> str:
        data = self.held + data
        whole = len(data)
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte & 0xC0 != 0x80:
                if _NEED[byte] > back:
                    whole = len(data) - back
                break
        self.held = data[whole:]
        return data[:whole].decode("utf-8", "replace")

    def end(self) -> str:
        out, self.held = self.held.decode("utf-8", "replace"), b""
        return out


def decode(ids: Iterator[int], tokens: dict[int, bytes]) -> Iterator[str]:
    """Text of ids, chunk by chunk."""
    machine, part = Utf8Machine(), []
    for token in ids:
        part.append(tokens[token])
        if len(part) == _CHUNK:
            yield machine.feed(b"".join(part))
            part = []
    yield machine.feed(b"".join(part)) + machine.end()


@contextmanager
def _no_collector() -> Iterator[None]:
    """The stores hold no cycles, so the cycle collector would only walk them in vain."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


def encoder(path: str, pattern: str) -> Encoder:
    """The encoder of a rank file, one per worker process."""
    return worker.keep(("bpe", path, pattern), lambda: Encoder(load_ranks(path), pattern))


def encode_texts(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): packed ids of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for batch in batches:
            for part in (batch.slice(at, 256) for at in range(0, batch.num_rows, 256)):
                packed = [own.encode(x.as_py() or "") for x in part.column(1)]
                yield pa.record_batch([part.column(0), pa.array(packed, pa.large_binary() if sum(map(len, packed)) >> 31 else pa.binary())], ["id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, ids binary")


def decode_ids(coded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(id, ids, text): the texts of packed ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(path, pattern).tokens
        for batch in batches:
            for part in (batch.slice(at, 256) for at in range(0, batch.num_rows, 256)):
                texts = ["".join(decode(np.frombuffer(x.as_buffer(), "<u4").tolist(), tokens)) for x in part.column(1)]
                yield pa.record_batch([part.column(0), part.column(1), pa.array(texts)], ["id", "ids", "text"])

    return coded.mapInArrow(run, "id long, ids binary, text string")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of each text encoded and decoded again; with_ids adds the packed ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        names = ["id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
        for part in (batch.slice(at, 512) for batch in batches for at in range(0, batch.num_rows, 512)):
            rows = []
            with _no_collector():
                for x in part.column(1):
                    packed, digest = own.encode(x.as_py() or ""), hashlib.sha256()
                    for text in decode(np.frombuffer(packed, "<u4").tolist(), own.tokens):
                        digest.update(text.encode())
                    rows.append((len(packed) // 4, hashlib.sha256(packed).hexdigest(), digest.hexdigest(), packed if with_ids else None))
            cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.string(), pa.binary()), strict=True)]
            yield pa.record_batch([part.column(0), *cols[: 4 if with_ids else 3]], names[: 5 if with_ids else 4])

    kinds = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, kinds)
