"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Adjacent parts of a pre-token that the vocabulary can merge wait in buckets, one
per rank.  A two-level bitmap says which buckets hold something, so the next rank
is found by two find-first-set steps whatever the number of ranks.  A bucket
hands out its positions from left to right; an entry whose pair has changed
meanwhile is stale and skipped.  Each merge costs a constant number of queue
steps, so a pre-token of a million bytes is no worse per byte than a short one.

Pre-tokens recur, so each worker keeps the ids of those it has seen, up to
:data:`CACHE` of them.  Nulls count as empty texts.  Ids of rows may be null or
repeat; every input row gives one row.
"""

from __future__ import annotations

import base64
import hashlib
import re
import unicodedata
from collections.abc import Callable
from heapq import heappop, heappush
from itertools import chain

import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.llm.common import digest_of, held, per_text, text_or_empty

WORD_BITS = 8
WORD_MASK = (1 << WORD_BITS) - 1
#: Texts whose characters all lie below this one are split by a faster pattern.
LATIN_END = 0x250
CACHE = 900_000
#: Pre-tokens longer than this are not cached.
CACHED_LENGTH = 64


def encode_piece(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Ids of one pre-token.

    The queue: ``buckets`` has the positions of a rank as a heap, ``words`` the
    bits of the ranks in use, WORD_BITS of a rank number a bit within a word,
    ``top`` the bits of the words in use.  It is written out in place, as it is
    the inner loop of all encoding.
    """
    rank_of = ranks.get
    whole = rank_of(piece)
    if whole is not None:
        return (whole,)
    n = len(piece)
    after = list(range(1, n + 1))  # where the part that starts here ends
    before = list(range(-1, n - 1))
    pair = [-1] * n  # rank of the part here joined with the next, -1 if none
    top = 0
    words: dict[int, int] = {}
    buckets: dict[int, list[int]] = {}
    for i in range(n - 1):
        rank = rank_of(piece[i:i + 2])
        if rank is not None:
            pair[i] = rank
            if rank in buckets:
                buckets[rank].append(i)  # in ascending order, so still a heap
            else:
                buckets[rank] = [i]
                word = rank >> WORD_BITS
                words[word] = words.get(word, 0) | 1 << (rank & WORD_MASK)
                top |= 1 << word
    while top:
        word = (top & -top).bit_length() - 1
        bits = words[word]
        low = bits & -bits
        rank = word << WORD_BITS | low.bit_length() - 1
        bucket = buckets[rank]
        i = heappop(bucket) if len(bucket) > 1 else bucket.pop()
        if not bucket:
            del buckets[rank]
            bits ^= low
            words[word] = bits
            if not bits:
                top ^= 1 << word
        if pair[i] != rank:
            continue  # stale
        gone = after[i]
        end = after[gone]
        pair[gone] = -1
        after[i] = end
        left = before[i]
        if end < n:
            before[end] = i
            new = rank_of(piece[i:after[end]], -1)
        else:
            new = -1
        pair[i] = new
        at = i
        while True:  # the pair that starts here, then the one to its left
            if new >= 0:
                if new in buckets:
                    heappush(buckets[new], at)
                else:
                    buckets[new] = [at]
                    word = new >> WORD_BITS
                    words[word] = words.get(word, 0) | 1 << (new & WORD_MASK)
                    top |= 1 << word
            if left < 0 or at == left:
                break
            at = left
            new = pair[left] = rank_of(piece[left:end], -1)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i:after[i]]])
        i = after[i]
    return tuple(out)


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 of the token, then its rank, per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, map(bytes.strip, f)))}


def latin_split() -> tuple[Callable, Callable]:
    """The public pattern written out for characters below U+0250, for which the
    standard regular expressions are faster; and a search for any other character.
    Classes come from the character database, white space from the general engine."""

    def ranges(holds: Callable[[str], bool]) -> str:
        return "".join(re.escape(chr(c)) for c in range(LATIN_END) if holds(chr(c)))

    letter = ranges(lambda c: unicodedata.category(c)[0] == "L")
    number = ranges(lambda c: unicodedata.category(c)[0] == "N")
    blank = ranges(lambda c: regex.match(r"\s", c) is not None)
    pattern = (
        rf" ?[{letter}]+|'(?:[sdmt]|re|ve|ll)| ?[{number}]+| ?[^{blank}{letter}{number}]+"
        rf"|[{blank}]+(?![^{blank}])|[{blank}]+"
    )
    return re.compile(pattern).findall, re.compile(f"[^\0-{chr(LATIN_END - 1)}]").search


class _Seen(dict):
    """Ids by pre-token; what is missing is encoded, and kept unless it is long."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        super().__init__()
        self.ranks = ranks

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = encode_piece(piece.encode(), self.ranks)
        if len(piece) <= CACHED_LENGTH:
            self[piece] = ids
        return ids


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.general = regex.compile(pattern).findall
        self.latin, self.beyond_latin = latin_split() if pattern == public_tokenizers.PATTERN else (None, None)
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.names = {rank: str(rank) for rank in self.tokens}
        self.seen = _Seen(ranks)

    def split(self, text: str) -> list[str]:
        if self.latin is None or self.beyond_latin(text):
            return self.general(text)
        return self.latin(text)

    def encode(self, text: str) -> list[int]:
        if len(self.seen) > CACHE:
            self.seen.clear()
        return list(chain.from_iterable(map(self.seen.__getitem__, self.split(text))))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def report(self, text: str) -> tuple:
        ids = self.encode(text)
        listed = ",".join(map(self.names.__getitem__, ids))
        return len(ids), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(self.decode(ids)).hexdigest()


def round_trip(
    docs: DataFrame, vocabulary: str, pattern: str, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``.

    ``vocabulary`` is read on the driver and sent to the workers: it has a fixed
    size, and the file need not exist elsewhere.
    """
    ranks = read_ranks(vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    content = digest_of("codec", ranks, pattern)

    def make() -> Callable[[str], tuple]:
        return held(content, lambda: Codec(shared.value, pattern)).report

    return per_text(
        docs, id_column, text_or_empty(text_column),
        "n_tokens long, ids_sha256 string, decoded_sha256 string", make,
    )


def encode_texts(
    docs: DataFrame, vocabulary: str, pattern: str, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``doc_id, ids``: the token ids themselves."""
    ranks = read_ranks(vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    content = digest_of("codec", ranks, pattern)

    def make() -> Callable[[str], tuple]:
        codec = held(content, lambda: Codec(shared.value, pattern))
        return lambda text: (codec.encode(text),)

    return per_text(docs, id_column, text_or_empty(text_column), "ids array<int>", make)


def decode_ids(docs: DataFrame, vocabulary: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """``doc_id, text``: texts of token ids; bytes that are no UTF-8 become U+FFFD."""
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))

    def make() -> Callable[[list[int]], tuple]:
        tokens = {rank: token for token, rank in shared.value.items()}
        return lambda ids: (b"".join(map(tokens.__getitem__, ids)).decode(errors="replace"),)

    ids = F.coalesce(F.col(ids_column), F.array().cast("array<int>"))
    return per_text(docs, id_column, ids, "text string", make)
