"""Byte-level BPE: exact encoding by backtracking over longest matches, and decoding.

Each piece of the split pattern is read as Latin-1 so that one character stands for one byte, and
an Aho-Corasick automaton of all tokens finds every token that starts at each byte. The encoder
walks from the left, takes the longest token that is compatible with the one before it and steps
back at a dead end. Two tokens are compatible if merging their joint bytes by rank gives these two
tokens again; a sequence in which all neighbours are compatible is the sequence that the merges
give. Compatibility is memoised, and a position that failed once is not entered again, so the time
is linear in the length of the piece.

Defined results: a null or empty text has no ids and decodes to no bytes; repeated rows give equal
results; a text of any length is encoded whole.
"""

from __future__ import annotations

import base64
import re
from array import array
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assetloom.llm.common import Recent, per_text, release, table

#: White space as the split pattern's engine defines it.
SPACE = "\t-\r \x85\xa0  -     　"
#: Every boundary between these units is a boundary of the split pattern too: none of its
#: alternatives goes on from other characters into white space.
UNIT = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
#: Entries kept by a worker's caches; units longer than this many characters are not kept.
CACHE_UNITS, CACHE_PAIRS, CACHE_CHARS = 150_000, 700_000, 48
#: Bytes of a long piece that the automaton is given at once; more than twice the longest token.
WINDOW = 512
#: Above every rank.
NEVER = 1 << 30


class _Lazy(dict):
    """A value for each token, computed when first asked for."""

    def __init__(self, value):
        super().__init__()
        self.value = value

    def __missing__(self, token: int):
        self[token] = out = self.value(token)
        return out


class ByteBpe:
    """The encoder of a rank file and a split pattern."""

    def __init__(self, rank_path: str, pattern: str):
        with open(rank_path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}
        self.size_of = {rank: len(token) for token, rank in self.ranks.items()}
        self.halves: dict[bytes, list[bytes]] = {}
        self.pairs: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        space = pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]")
        self.split = regex.compile(space)
        self.left_spine = _Lazy(lambda rank: self._spine(rank, 0))
        self.right_spine = _Lazy(lambda rank: self._spine(rank, 1))
        self.shorter = _Lazy(self._shorter)
        self.longest_token = max(self.size_of.values())
        self.whole = {token.decode("latin-1"): rank for token, rank in self.ranks.items()}
        self.pieces = Recent(self._piece, CACHE_UNITS, CACHE_CHARS, __name__)
        self.units = Recent(self._unit, CACHE_UNITS, CACHE_CHARS, __name__)

    def merged(self, data: bytes) -> list[bytes]:
        """Tokens by plain rank-ordered merging, for a token's last merge; quadratic."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 2:
            rank, at = min((self.ranks.get(a + b, NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == NEVER:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _spine(self, token: int, side: int) -> list[tuple[bytes, int]]:
        """The parts that stand at one end of a token while it is merged, each with the rank at
        which it goes up into a larger part; the whole token stays for ever."""
        out, data, until = [], self.bytes_of[token], NEVER
        while True:
            out.append((data, until))
            if len(data) == 1:
                return out
            if data not in self.halves:
                self.halves[data] = self.merged(data)
            until, data = self.ranks[data], self.halves[data][-side]

    def _shorter(self, token: int) -> int | None:
        """The longest token that is a proper prefix of a token."""
        data = self.bytes_of[token]
        return next((rank for n in range(len(data) - 1, 0, -1) if (rank := self.ranks.get(data[:n])) is not None), None)

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the joint bytes of two tokens gives the two again.

        It does unless some part at the end of ``left`` meets some part at the start of ``right``
        at the rank of their joint token, before either goes up into a larger part of its own.
        Of equal ranks the leftmost is merged first.
        """
        key = left << 32 | right
        known = self.pairs.get(key)
        if known is None:
            known = self._stay(self.right_spine[left], self.left_spine[right])
            if len(self.pairs) >= CACHE_PAIRS:
                self.pairs.clear()
            self.pairs[key] = known
        return known

    def _stay(self, lefts: list[tuple[bytes, int]], rights: list[tuple[bytes, int]]) -> bool:
        get = self.ranks.get
        for a, a_until in lefts:
            for b, b_until in rights:
                if (rank := get(a + b)) is not None and rank < a_until and rank <= b_until:
                    return False
        return True

    def piece(self, data: str) -> tuple[int, ...]:
        """Ids of one piece, given as Latin-1."""
        if (rank := self.whole.get(data)) is not None:
            return (rank,)
        pairs, sizes, shorter = self.pairs, self.size_of, self.shorter
        n, at, taken = len(data), 0, []
        dead: set[int] = set()
        longest, valid = self._from(data, 0)
        while at < n:
            if longest is None or at >= valid:
                longest, valid = self._from(data, at)
            token = next(longest)[1]
            while True:
                if at + sizes[token] not in dead:
                    if not taken:
                        break
                    known = pairs.get(taken[-1] << 32 | token)
                    if self.compatible(taken[-1], token) if known is None else known:
                        break
                longest = None  # its next match no longer starts where the walk goes on
                token = shorter[token]
                while token is None:
                    dead.add(at)
                    token = taken.pop()
                    at -= sizes[token]
                    token = shorter[token]
            taken.append(token)
            at += sizes[token]
        return tuple(taken)

    def _from(self, data: str, at: int):
        """Longest tokens, one after the other, from a place on; and up to where these hold."""
        if len(data) - at <= WINDOW:
            return self.automaton.iter_long(data[at:]), len(data)
        return self.automaton.iter_long(data[at : at + WINDOW]), at + WINDOW - self.longest_token

    def _unit(self, unit: str) -> tuple[int, ...]:
        if unit[0] == " " and unit.isascii() and unit[1:].isalpha():
            return self.piece(unit)
        pieces = self.split.findall(unit)
        if len(pieces) == 1:
            return self.pieces[unit]
        return tuple(chain.from_iterable(map(self.pieces.__getitem__, pieces)))

    def _piece(self, piece: str) -> tuple[int, ...]:
        return self.piece(piece if piece.isascii() else piece.encode().decode("latin-1"))

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.units.__getitem__, UNIT.findall(text))))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(rank_path: str, pattern: str) -> ByteBpe:
    """The encoder, one in each Python worker."""
    return ByteBpe(rank_path, pattern)


ROUND_TRIP = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())])


def bpe_round_trip(text: Column, rank_path: str, pattern: str) -> Column:
    """struct(ids array<int>, decoded binary): the ids of a text, and the bytes of these ids."""

    def run(texts: pa.Array) -> pa.Array:
        release(__name__)
        c = codec(rank_path, pattern)
        ids, ends, decoded = array("i"), [0], []
        for text in texts.to_pylist():
            own = c.encode(text or "")
            ids.extend(own)
            ends.append(len(ids))
            decoded.append(c.decode(own))
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(ids, np.int32)))
        return pa.StructArray.from_arrays([lists, pa.array(decoded, pa.binary())], names=["ids", "decoded"])

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, returnType=ROUND_TRIP)(text)


@lru_cache(maxsize=2)
def _encode(rank_path: str, pattern: str):
    return codec(rank_path, pattern).encode


def bpe_encode(text: Column, rank_path: str, pattern: str) -> Column:
    """array<int> of ids."""
    return per_text(_encode, T.ArrayType(T.IntegerType()), rank_path, pattern)(text)


def op2_byte_bpe(spark, sf_dir):
    """Encode and decode every text of documents; digests of both."""
    import public_tokenizers

    coded = table(spark, sf_dir, "documents").select("doc_id", bpe_round_trip(F.col("text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).alias("bpe"))
    return coded.select(
        "doc_id",
        F.size("bpe.ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("bpe.ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("bpe.decoded"), 256).alias("decoded_sha256"),
    )
