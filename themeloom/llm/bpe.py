"""Byte-level BPE as a transducer: encoding emits tokens after bounded lookahead, decoding streams UTF-8.

A BPE encoding is fixed by its neighbours: a token sequence is the encoding of its bytes exactly when
every adjacent pair of it is the encoding of that pair's bytes. Reading a text left to right, a
non-deterministic transducer guesses where tokens end and drops the guesses whose pair is not such an
encoding. ``Transducer`` determinises it lazily: a state stands for the guesses that are still possible,
and what all of them agree on is emitted. A guess lives only while its bytes begin some token, so output
lags by at most the longest token. States and transitions are made when first met and reused from then on.
"""

from __future__ import annotations

import array
import base64
import gc
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A memory bound, not a cap on the data: about 300 bytes for each piece that a Python worker remembers. Those not
#: asked for during the last half of this number of new ones are forgotten, and made again when asked for. Of
#: the transducer's states it keeps a quarter of that number, then begins anew.
PIECES = 1_400_000

_BYTES = [bytes((byte,)) for byte in range(256)]


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file with lines ``base64(token) rank``."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def merge_pieces(data: bytes, ranks: dict[bytes, int], down_to: int = 1) -> list[int]:
    """BPE by its definition: join the adjacent pair of least rank, leftmost first, until none is known.

    With ``down_to`` it stops at so many parts.
    """
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > down_to:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], len(ranks) + 1))
        if parts[best] + parts[best + 1] not in ranks:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return [ranks[part] for part in parts]


class Transducer:
    """Bytes to token ids. A state is the last token emitted and the bytes read since, which fix all guesses."""

    def __init__(self, ranks: dict[bytes, int], states: int = PIECES // 4):
        self.ranks, self.most = ranks, states
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.child: dict[int, int] = {}  # trie: node * 256 + byte
        self.token_at = [-1]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                following = self.child.get(node << 8 | byte)
                if following is None:
                    following = self.child[node << 8 | byte] = len(self.token_at)
                    self.token_at.append(-1)
                node = following
            self.token_at[node] = rank
        self._pairs: dict[int, bool] = {}
        self._alone: dict[int, bool] = {}
        self._split: dict[int, tuple[int, int] | None] = {}
        self._forget()

    def _forget(self) -> None:
        self._names: dict[tuple[int, bytes], int] = {(-1, b""): 0}
        # Of each state: the bytes held; of every place in them the token that ends there and where it begins
        # (one valid way each); the places that a longer token may still begin at, with their trie nodes.
        self._states: list[tuple] = [(b"", (-1,), (0,), ((0, 0),))]
        self._moves: dict[int, int] = {}  # state * 256 + byte: next state, or its complement if something is emitted
        self._emits: dict[int, bytes] = {}
        self._ends: dict[int, bytes] = {}

    def _halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge made ``token``; None for one byte, and for what no merge makes."""
        if token not in self._split:
            parts = merge_pieces(self.bytes_of[token], self.ranks, down_to=2)
            self._split[token] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self._split[token]

    def _own(self, token: int) -> bool:
        """Whether ``token`` is the encoding of its own bytes."""
        known = self._alone.get(token)
        if known is None:
            known = self._alone[token] = merge_pieces(self.bytes_of[token], self.ranks) == [token]
        return known

    def _fits(self, left: int, right: int) -> bool:
        """Whether ``left, right`` encodes its bytes: undo merges at the seam, latest first, and look for an
        earlier merge across it. At the start of a piece, where ``left`` is negative, ``right`` alone has to."""
        key = (left << 32) + right
        known, limit, ranks, text = self._own(right), len(self.ranks) + 1, self.ranks, self.bytes_of
        while known and left >= 0:
            across = ranks.get(text[left] + text[right])
            if across is not None and across < limit:
                known = False
                break
            undo_left, undo_right = self._halves(left), self._halves(right)
            if undo_left is None and undo_right is None:
                break
            if undo_right is None or undo_left is not None and left > right:
                limit, left = left, undo_left[1]
            else:
                limit, right = right + 1, undo_right[0]  # of equal ranks the left merge comes first
        self._pairs[key] = known
        return known

    def _determinise(self, state: int, byte: int) -> int:
        held, ending, begin, guesses = self._states[state]
        child, token_at, pairs, n = self.child.get, self.token_at, self._pairs, len(ending)
        found, start, alive = -1, 0, []
        for at, node in guesses:
            node = child(node << 8 | byte)
            if node is None:
                continue
            alive.append((at, node))
            if found < 0:
                token = token_at[node]
                if token >= 0:
                    fits = pairs.get((ending[at] << 32) + token)
                    if fits if fits is not None else self._fits(ending[at], token):
                        found, start = token, at
        if found < 0:
            raise ValueError("the vocabulary lacks a single byte")
        ending += (found,)
        begin += (start,)
        agreed = n
        for other, _ in alive:  # the last place that all guesses have gone through
            while other != agreed:
                if other > agreed:
                    other = begin[other]
                else:
                    agreed = begin[agreed]
        held += _BYTES[byte]
        if agreed:
            self._emits[state << 8 | byte] = self._path(ending, begin, agreed)
            held, ending = held[agreed:], ending[agreed:]
        key = (ending[0], held)
        move = self._names.get(key)
        if move is None:
            move = self._names[key] = len(self._states)
            if agreed:
                begin = tuple([at - agreed for at in begin[agreed:]])  # the first is never asked for
                alive = [(at - agreed, node) for at, node in alive]
            alive.append((n - agreed, 0))
            self._states.append((held, ending, begin, alive))
        if agreed:
            move = ~move
        self._moves[state << 8 | byte] = move
        return move

    @staticmethod
    def _path(ending: tuple[int, ...], begin: tuple[int, ...], place: int) -> bytes:
        tokens = []
        while place:
            tokens.append(ending[place])
            place = begin[place]
        return array.array("I", reversed(tokens)).tobytes()

    def encode(self, piece: bytes) -> bytes:
        """Ids of one piece of text, packed as 32-bit integers. A piece that is a token as a whole is that token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return array.array("I", (whole,)).tobytes()
        out = bytearray()
        state, moves = 0, self._moves
        for byte in piece:
            move = moves.get(state << 8 | byte)
            if move is None:
                if len(self._states) >= self.most:
                    state, moves = self._start_anew(state), self._moves
                move = self._determinise(state, byte)
            if move < 0:
                out += self._emits[state << 8 | byte]
                move = ~move
            state = move
        left = self._ends.get(state)
        if left is None:
            _, ending, begin, _ = self._states[state]
            left = self._ends[state] = self._path(ending, begin, len(ending) - 1)
        return bytes(out + left)

    def _start_anew(self, state: int) -> int:
        """Forget all states but ``state``, wherever in a piece that is, and with them pairs beyond the bound."""
        kept = self._states[state]
        self._forget()
        if len(self._pairs) > 4 * self.most:
            self._pairs.clear()
        if state == 0:
            return 0
        self._states.append(kept)
        self._names[kept[1][0], kept[0]] = 1
        return 1


#: Longer pieces are encoded each time they are met: few come again, and what is remembered stays bounded in bytes.
LONG = 256


class _Pieces(dict):
    """Packed ids by piece, made when first asked for; an older generation is kept beside the current one."""

    def __init__(self, transducer: Transducer, most: int):
        super().__init__()
        self.transducer, self.most = transducer, most
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        if len(piece) > LONG:
            return self.transducer.encode(piece.encode("utf-8"))
        if len(self) >= self.most // 2:
            self.older = dict(self)
            self.clear()
        ids = self.older.get(piece)
        if ids is None:
            ids = self.transducer.encode(piece.encode("utf-8"))
        self[piece] = ids
        return ids


def splitter(pattern: str):
    """A function that lists the matches of ``pattern``.

    ``regex`` knows letters and numbers as Unicode has them. ``re`` is faster and knows nearly the same ones, so
    Latin texts without a character on which the two differ go to it.
    """
    exact = regex.compile(pattern).findall
    simpler = pattern.replace(r"[^\s\p{L}\p{N}]", r"(?:[^\s\w]|_)").replace(r"\p{L}", r"[^\W\d_]").replace(r"\p{N}", r"\d")
    if r"\p" in simpler or "(" in simpler.replace("(?", ""):
        return exact
    quick = re.compile(simpler).findall
    every = "".join(map(chr, range(0x250)))  # Latin; a larger class takes longer to search than it saves
    same = set(every)
    for one, other in ((r"\p{L}", r"[^\W\d_]"), (r"\p{N}", r"\d"), (r"\s", r"\s"), (r"[^\s\p{L}\p{N}]", r"[^\s\w]|_")):
        same -= set(regex.findall(one, every)) ^ set(re.findall(other, every))
    odd = re.compile(f"[^{re.escape(''.join(sorted(same)))}]").search
    return lambda text: exact(text) if odd(text) else quick(text)


class Codec:
    """One vocabulary: texts to packed 32-bit ids, and packed ids back to bytes or text."""

    def __init__(self, path: str, pattern: str, pieces: int = PIECES):
        self.ranks = load_ranks(path)
        self.split = splitter(pattern)
        self.pieces = _Pieces(Transducer(self.ranks, pieces // 4), pieces)
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.split(text)))

    def decode(self, ids: array.array, chunk: int = 4096):
        """Text of ``ids``, in parts of ``chunk`` tokens."""
        reader = Utf8Reader()
        token = self.bytes_of.__getitem__
        for begin in range(0, len(ids), chunk):
            yield reader.feed(b"".join(map(token, ids[begin : begin + chunk])))
        yield reader.finish()


class Utf8Reader:
    """UTF-8 in parts of any size. Its state is the unfinished character at the end of what was read.

    Ill-formed bytes become U+FFFD, by the same rule at any division into parts.
    """

    def __init__(self):
        self.held = b""

    @staticmethod
    def unfinished(data: bytes) -> int:
        """Number of bytes at the end that begin a well-formed character and don't complete it."""
        for back in range(1, min(3, len(data)) + 1):
            lead = data[-back]
            if lead & 0xC0 == 0x80:
                continue
            width = 2 if 0xC2 <= lead <= 0xDF else 3 if 0xE0 <= lead <= 0xEF else 4 if 0xF0 <= lead <= 0xF4 else 1
            if width <= back:
                return 0
            if back > 1:  # the second byte's range rules out overlong forms, surrogates and what is above U+10FFFF
                low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(lead, (0x80, 0xBF))
                if not low <= data[1 - back] <= high:
                    return 0
            return back
        return 0

    def feed(self, data: bytes) -> str:
        data = self.held + data
        keep = len(data) - self.unfinished(data)
        self.held = data[keep:]
        return data[:keep].decode("utf-8", "replace")

    def finish(self) -> str:
        left, self.held = self.held, b""
        return left.decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str, pattern: str, pieces: int = PIECES) -> Codec:
    """The codec of this Python worker; tasks that follow reuse what it has learned."""
    made = Codec(path, pattern, pieces)
    # the tables grow to millions of numbers and strings without cycles; don't have them searched for some
    gc.freeze()
    gc.set_threshold(100_000, 50, 50)
    return made


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Add ``out``: token ids of the whole ``text``. Null and empty texts have none; no row is dropped or joined.

    A column already called ``out`` is replaced. Runs where the rows are: nothing is shuffled.
    """

    @F.arrow_udf("array<int>")
    def ids_of(texts: pa.Array) -> pa.Array:
        run = codec(path, pattern)
        packed = [run.encode(value.as_py() or "") for value in texts]
        ends = [0]
        for ids in packed:
            ends.append(ends[-1] + len(ids) // 4)
        flat = pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(b"".join(packed))])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)

    return docs.withColumn(out, ids_of(F.col(text)))


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add ``out``: the text of ``ids``; ids cut inside a character end in U+FFFD. Null ids count as none."""

    @F.arrow_udf("string")
    def text_of(lists: pa.Array) -> pa.Array:
        run = codec(path, pattern)
        return pa.array(["".join(run.decode(_packed(value))) for value in lists], pa.string())

    return df.withColumn(out, text_of(F.col(ids)))


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text", pieces: int = PIECES, kept: bool = True) -> DataFrame:
    """Add n_tokens, ids_sha256 and decoded_sha256: number and digest of the ids of ``text`` (little-endian unsigned
    32-bit integers), and digest of the text decoded from them. Encodes once and decodes in parts, so neither
    ids nor decoded texts are gathered or leave the task. ``pieces`` bounds what a Python worker remembers. It keeps
    that for later tasks, unless ``kept`` is false: then it goes with the task, for stages that other ones share their
    workers with. Columns of these names are replaced."""

    @F.arrow_udf("struct<n_tokens: long, ids_sha256: string, decoded_sha256: string>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        run = codec(path, pattern, pieces)
        try:
            for texts in batches:
                yield _digests(run, texts)
        finally:
            if not kept:
                del run
                codec.cache_clear()
                gc.unfreeze()
                gc.collect()
                pa.default_memory_pool().release_unused()

    names = ["n_tokens", "ids_sha256", "decoded_sha256"]
    marked = docs.withColumn("_trip", of(F.col(text))).drop(*names)
    return marked.select("*", *[F.col("_trip")[name].alias(name) for name in names]).drop("_trip")


def _digests(run: Codec, texts: pa.Array) -> pa.Array:
    counts, ids_digests, text_digests = [], [], []
    for value in texts:
        packed = run.encode(value.as_py() or "")
        ids, digest = array.array("I", packed), hashlib.sha256()
        for part in run.decode(ids):
            digest.update(part.encode("utf-8"))
        counts.append(len(ids))
        ids_digests.append(hashlib.sha256(packed).hexdigest())
        text_digests.append(digest.hexdigest())
    return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(ids_digests, pa.string()), pa.array(text_digests, pa.string())], ["n_tokens", "ids_sha256", "decoded_sha256"])


def _packed(value: pa.ListScalar) -> array.array:
    """The values of one list as 32-bit integers, without making Python objects of all of them."""
    numbers = array.array("I")
    if value.is_valid:
        numbers.frombytes(value.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes())
    return numbers
