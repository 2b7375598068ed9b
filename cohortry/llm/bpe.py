"""Byte-level BPE encoding and decoding.

A text is cut by the tokenizer's pattern, and a batch of texts goes to Python as arrays of words.  Each different
word of a batch is merged once: step by step, the neighbours whose joined bytes have the lowest rank.  Ids of words
are remembered within a task, a bounded number of them; Arrow puts them in the words' places.  Nothing is counted,
shuffled or collected beforehand, so neither the plan nor the driver holds anything that grows with the corpus.
Decoding looks up the bytes of every id and joins them.
"""

from __future__ import annotations

import base64
import json
from array import array
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush
from itertools import chain, pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.llm.common import col, let, text_of

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
WORDS = 1 << 19              # a task remembers at most so many words
WORD_CHARS = 64              # and none longer than this
ROWS = 2000                  # texts whose words are looked up together
LONG_WORD = 128              # bytes from which possible merges wait in a heap
NONE = 1 << 31               # rank of neighbours that do not merge


def read_ranks(path: str = RANKS) -> dict[bytes, int]:
    """Bytes and rank of every token of a rank file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def piece_table(ranks: dict[bytes, int]) -> Column:
    """The literal table of the bytes of every id, a character U+0000 to U+00FF for each."""
    table = [""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        table[rank] = token.decode("latin-1")
    return F.from_json(F.lit(json.dumps(table)), "array<string>")


def words_of(text: Column, pattern: str = PATTERN) -> Column:
    """The matches of the pattern, in order.  White space is Unicode's, as in the pattern's own engine."""
    return F.regexp_extract_all(text, F.lit("(?U)" + pattern), F.lit(0))


def merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a word: the lowest-ranked neighbours merge, leftmost first, until none are a token.

    ``cuts`` are the ends of pieces, ``low`` the ranks of the merges of each piece with the next.
    """
    if len(word) >= LONG_WORD:
        return merged_long(word, ranks)
    rank = ranks.get
    cuts = list(range(len(word) + 1))
    low = [rank(word[i:i + 2], NONE) for i in cuts[:-2]]
    while low:
        least = min(low)
        if least == NONE:
            break
        i = low.index(least)
        del cuts[i + 1], low[i]
        if i:
            low[i - 1] = rank(word[cuts[i - 1]:cuts[i + 1]], NONE)
        if i < len(low):
            low[i] = rank(word[cuts[i]:cuts[i + 2]], NONE)
    return [ranks[word[a:b]] for a, b in pairwise(cuts)]


def merged_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """What :func:`merged` gives, in little more than linear time.

    A possible merge waits in a heap as rank, start and end; it stands for as long as two pieces fill its place.
    """
    n = len(word)
    ends = list(range(1, n + 1))         # end of the piece at a start; n where no piece starts any more
    starts = list(range(-1, n))          # start of the piece before the one at a start
    waiting = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i:i + 2])) is not None]
    heapify(waiting)
    while waiting:
        _, i, end = heappop(waiting)
        at = ends[i]
        if at == n or ends[at] != end:
            continue
        ends[i], ends[at] = end, n
        starts[end] = i
        for a, b in ((starts[i], end), (i, ends[end] if end < n else n + 1)):
            if a >= 0 and b <= n and (r := ranks.get(word[a:b])) is not None:
                heappush(waiting, (r, a, b))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[word[i:ends[i]]])
        i = ends[i]
    return ids


def encoder(ranks: dict[bytes, int], words: int = WORDS) -> Callable[[Iterator[pa.Array]], Iterator[pa.Array]]:
    """Arrays of words to arrays of ids, batch by batch.

    The ids of at most ``words`` words are remembered, as bytes: half of them at most are the latest that were met,
    the others are those met before them.
    """
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        latest: dict[str, bytes] = {}
        earlier: dict[str, bytes] = {}

        def ids_of(word: str) -> bytes:
            nonlocal latest, earlier
            ids = latest.get(word)
            if ids is None:
                ids = earlier.get(word)
                if ids is None:
                    data = word.encode()
                    whole = ranks.get(data)
                    ids = array("i", merged(data, ranks) if whole is None else [whole]).tobytes()
                if words > 1 and len(word) <= WORD_CHARS:
                    if len(latest) >= words // 2:
                        latest, earlier = {}, latest
                    latest[word] = ids
            return ids

        for batch in batches:
            for at in range(0, len(batch), ROWS):
                some = batch.slice(at, ROWS)
                found = some.flatten().dictionary_encode()
                lists = [ids_of(w) for w in found.dictionary.to_pylist()]
                sizes = np.fromiter(map(len, lists), np.int32, len(lists)) // 4
                table = pa.ListArray.from_arrays(offsets(sizes), np.frombuffer(b"".join(lists), np.int32))
                bounds = some.offsets.to_numpy()
                yield pa.ListArray.from_arrays(offsets(sizes[found.indices.to_numpy()])[bounds - bounds[0]],
                                               table.take(found.indices).flatten())

    return encode


def offsets(sizes: np.ndarray) -> np.ndarray:
    """Where lists of these sizes begin, one after the other, and where the last ends."""
    out = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=out[1:])
    return out


def bpe_encode(df: DataFrame, text_col: str = "text", ids_col: str = "ids", ranks: str = RANKS, pattern: str = PATTERN,
               words: int = WORDS) -> DataFrame:
    """``df`` with ``ids_col``, the array of the text's token ids; a column of this name is replaced.

    Whole texts are read; null counts as empty and gives no ids; strings of special tokens are ordinary text.
    Repeated rows and any other columns stay as they are; an empty table stays empty.  A text's words are held
    in memory together.
    """
    encode = F.arrow_udf(encoder(read_ranks(ranks), words), "array<int>")
    return df.withColumn(ids_col, encode(words_of(text_of(text_col), pattern)))


def bpe_decode(ids: Column, ranks: str = RANKS) -> Column:
    """The bytes of token ids, piece after piece, as binary.  Null stays null; no ids give no bytes."""
    pieces = let(piece_table(read_ranks(ranks)), lambda table: F.array_join(F.transform(ids, lambda i: F.get(table, i)), ""))
    return F.encode(pieces, "ISO-8859-1")


def bpe_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = RANKS) -> DataFrame:
    """One row per row of ``df``: ``id_col``, n_tokens, ids_sha256 of the ids' decimals, decoded_sha256 of the decoded bytes."""
    ids = bpe_encode(df.select(col(id_col).alias("id"), col(text_col).alias("text")), "text", "ids", ranks)
    return ids.select(
        F.col("id").alias(id_col), F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.translate(F.col("ids").cast("string"), "[],", "").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(bpe_decode(F.col("ids"), ranks), 256).alias("decoded_sha256"))
