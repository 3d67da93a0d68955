"""Encoding of a corpus with a public byte-level BPE vocabulary.

The merges are compiled into a finite-state transducer that is determinised as texts need it.
Its states stand on a fact of BPE: a sequence of tokens is the encoding of its bytes exactly if
each two neighbours are, so the last token of a prefix's encoding follows from the last tokens of
shorter prefixes. A state holds, for each position from which a vocabulary token may still grow,
the bytes since then and the tokens not yet certain; a token is emitted once all of them share it,
so the lookahead is bounded by the longest token's length.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the public pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Entries kept of each cache of a worker; beyond that it is emptied, which costs time only.
CACHE = 200_000
STATES = 100_000


class Transducer:
    """Lazily determinised transducer from bytes to token ids."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.prefixes = {token[:n] for token in ranks for n in range(1, len(token))}
        self.fits = lru_cache(maxsize=CACHE)(self._fits)
        self._reset()

    def _reset(self) -> None:
        #: A state: (bytes since the position, pending token ids; the first is the last one emitted, or -1) of each live position.
        start = ((b"", (-1,)),)
        self.states, self.numbers, self.steps = [start], {start: 0}, [{}]

    def merged(self, data: bytes) -> list[int]:
        """Encoding of few bytes by the merges themselves: the lowest rank first, the leftmost on a tie."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _fits(self, left: int, right: int) -> bool:
        return left < 0 or self.merged(self.bytes_of[left] + self.bytes_of[right]) == [left, right]

    def _step(self, state: tuple, byte: bytes) -> tuple[int, tuple[int, ...]]:
        """Next state's number and the tokens that became certain."""
        ended, live = None, []
        for since, path in state:  # positions in order: the longest token that fits its left neighbour ends here
            grown = since + byte
            if ended is None and (token := self.ranks.get(grown)) is not None and self.fits(path[-1], token):
                ended = (*path, token)
            if grown in self.prefixes:
                live.append((grown, path))
        live.append((b"", ended))
        paths = [path for _, path in live]
        common, shortest = 0, min(map(len, paths))
        while common < shortest and all(p[common] == paths[0][common] for p in paths):
            common += 1
        out = paths[0][1:common]
        state = tuple((since, path[common - 1 :]) for since, path in live)
        number = self.numbers.get(state)
        if number is None:
            number = self.numbers[state] = len(self.states)
            self.states.append(state)
            self.steps.append({})
        return number, out

    def encode(self, data: bytes) -> list[int]:
        """Ids of one pre-token's bytes."""
        if len(self.states) > STATES:
            self._reset()
        ids: list[int] = []
        at = 0
        for k in range(len(data)):
            found = self.steps[at].get(data[k])
            if found is None:
                found = self.steps[at][data[k]] = self._step(self.states[at], data[k : k + 1])
            at = found[0]
            ids += found[1]
        return ids + list(self.states[at][-1][1][1:])


class Encoder:
    """Text to ids and back by one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.transducer = Transducer(ranks)
        self.split = regex.compile(pattern).findall
        self.known: dict[str, list[int]] = {}

    def encode(self, text: str) -> list[int]:
        """Ids of a text, special tokens' strings being ordinary text; [] for the empty text."""
        ids: list[int] = []
        for word in self.split(text):
            found = self.known.get(word)
            if found is None:
                found = self.transducer.encode(word.encode("utf-8", "surrogatepass"))
                if len(word) < 64:
                    if len(self.known) >= CACHE:
                        self.known.clear()
                    self.known[word] = found
            ids += found
        return ids

    def decode(self, ids: Iterable[int]) -> Iterator[str]:
        """Characters of a stream of ids, each as soon as its last byte is there; broken sequences become U+FFFD."""
        held, need = b"", 0
        for i in ids:
            for byte in self.transducer.bytes_of[i]:
                if need and 0x80 <= byte < 0xC0:
                    held, need = held + bytes([byte]), need - 1
                    if not need:
                        yield held.decode("utf-8", "replace")
                    continue
                if need:
                    yield "�"
                held = bytes([byte])
                need = 0 if byte < 0x80 else 1 if 0xC2 <= byte < 0xE0 else 2 if 0xE0 <= byte < 0xF0 else 3 if 0xF0 <= byte < 0xF5 else -1
                if need <= 0:
                    yield held.decode("utf-8", "replace")
                    need = 0
        if need:
            yield "�"


def read_ranks(path: str) -> dict[bytes, int]:
    """Vocabulary of a rank file: base64 token and rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


_encoders: dict[str, Encoder] = {}


def _encoder(key: str, ranks) -> Encoder:
    """The worker's encoder of a vocabulary; compiled states last from batch to batch."""
    if key not in _encoders:
        _encoders[key] = Encoder(ranks.value)
    return _encoders[key]


def encoded(docs: DataFrame, text: str = "text", *, vocabulary: str = VOCABULARY, ids: str = "ids", check: str | None = None) -> DataFrame:
    """``docs`` with the ids of each row's text, in the column ``ids``; with ``check`` also whether they decode to the text.

    - A null or empty text has an empty list; blank text has the ids of its white space.
    - Rows are neither added nor dropped; other columns stay, a column named like the result is replaced.
    - The vocabulary (50,257 entries, a bounded size) is read on the driver and broadcast; texts stay where they are.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))

    @F.pandas_udf(ArrayType(IntegerType()))
    def encode(texts: pd.Series) -> pd.Series:
        encoder = _encoder(vocabulary, ranks)
        return texts.map(lambda t: encoder.encode(t) if isinstance(t, str) else [])

    @F.pandas_udf("string")
    def decode(lists: pd.Series) -> pd.Series:
        encoder = _encoder(vocabulary, ranks)
        return lists.map(lambda x: "".join(encoder.decode(map(int, x))))

    out = docs.withColumn(ids, encode(F.col(text)))
    return out.withColumn(check, decode(F.col(ids)) == F.coalesce(F.col(text), F.lit(""))) if check else out


def with_token_count(docs: DataFrame, text: str = "text", *, vocabulary: str = VOCABULARY, name: str = "n_tokens") -> DataFrame:
    """``docs`` with the number of tokens of each row's text (0 for null and empty)."""
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        encoder = _encoder(vocabulary, ranks)
        return texts.map(lambda t: len(encoder.encode(t)) if isinstance(t, str) else 0)

    return docs.withColumn(name, count(F.col(text)))
