"""Packing of tokenised documents into sequences of a fixed length, by the sum-of-squares rule.

Documents are tokenised where they are; only pieces longer than a sequence are cut.  Pieces are dealt by a
hash into groups of bounded size and each group is packed in its own task, longest pieces first: a piece goes
where the sum over all gaps of the squared number of open sequences with that gap becomes smallest.  Groups are
many times larger than the few sequences that stay open in each, so cutting the corpus into groups costs next to
nothing and no task or group grows with the corpus.
"""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cohortry.llm.common import col, durable

LENGTH = 2048
END = 0                      # the id that closes a document
GROUP = 50_000               # pieces packed in one task
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


class _Ids:
    """Token ids of a text, as the tokenizer file gives them without special tokens added.

    The file's ids come from its vocabulary read as ranks, which is several times faster; texts that hold one
    of its special tokens go through the file itself.
    """

    def __init__(self, file: str, ranks: str | None):
        self.slow = Tokenizer.from_file(file)
        self.special = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks:
            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table,
                                          special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if self.fast is None or any(s in text for s in self.special):
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


_made: dict = {}


def _ids(file: str, ranks: str | None) -> _Ids:
    """One tokenizer per Python worker."""
    if (file, ranks) not in _made:
        _made[file, ranks] = _Ids(file, ranks)
    return _made[file, ranks]


def cut(n: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: all full but the first, which may be shorter."""
    first = n % length or min(n, length)
    starts = [0, *range(first, n, length)]
    return [(s, e - s) for s, e in zip(starts, [*starts[1:], n])]


def tokenized_pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                     tokenizer: str = TOKENIZER, ranks: str | None = RANKS, with_ids: bool = False) -> DataFrame:
    """One row per piece: id, row, piece, start, length, crc, and the ids themselves where asked for."""
    fields = "piece int, start long, length long, crc long" + (", ids array<int>" if with_ids else "")

    @F.pandas_udf(f"array<struct<{fields.replace(' ', ':').replace(',:', ',')}>>")
    def pieces(texts: pd.Series) -> pd.Series:
        encode = _ids(tokenizer, ranks)
        out = []
        for text in texts:
            ids = np.array([*encode(text or ""), END], "<u4")
            rows = []
            for k, (s, n) in enumerate(cut(len(ids), length)):
                part = ids[s:s + n]
                row = {"piece": k, "start": s, "length": n, "crc": zlib.crc32(part.tobytes())}
                rows.append(row | {"ids": part.astype(np.int32)} if with_ids else row)
            out.append(rows)
        return pd.Series(out)

    return (df.select(col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"),
                      pieces(col(text_col).cast("string")).alias("pieces"))
            .select("id", "row", F.inline("pieces")))


def sum_of_squares(sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Sequence number and offset of each size, in the order given, and the number of sequences.

    ``count[g]`` is the number of open sequences with gap ``g``.  A piece of size s that moves one sequence from
    gap g to gap g - s changes the sum of squares by 2 * (count[g - s] - count[g] + 1); full sequences do not
    count.  It goes where the sum becomes smallest, ties to the smallest gap; a new sequence is opened only
    where no open one has room.
    """
    count = np.zeros(length + 1, np.int64)
    open_at: list[list[int]] = [[] for _ in range(length + 1)]
    seq, offset = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    made = 0
    never = np.iinfo(np.int64).max
    for k, s in enumerate(sizes.tolist()):
        room = count[s:] > 0
        if room.any():
            change = np.where(room, 2 * (count[:length - s + 1] - count[s:] + 1), never)
            if room[0]:
                change[0] = 1 - 2 * count[s]      # becomes full
            gap = int(change.argmin()) + s
            where = open_at[gap].pop()
            count[gap] -= 1
        else:
            gap, where, made = length, made, made + 1
        seq[k], offset[k] = where, length - gap
        if gap > s:
            count[gap - s] += 1
            open_at[gap - s].append(where)
    return seq, offset, made


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
         tokenizer: str = TOKENIZER, ranks: str | None = RANKS, group: int = GROUP) -> DataFrame:
    """One row per piece: ``id_col``, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its token ids and then id 0; null and empty texts are id 0 alone.  Documents longer than
    ``length`` are cut so that only their first piece may be shorter.  Pieces of one sequence lie gapless from
    offset 0.  Null identifiers and repeated rows are packed like any other row; other columns are not
    touched.  An empty table gives an empty result.
    """
    pieces = durable(tokenized_pieces(df, id_col, text_col, length, tokenizer, ranks), "pieces")
    # Full pieces fill a sequence each and need no company.
    full, part = pieces.where(F.col("length") == length), pieces.where(F.col("length") < length)
    groups = max(1, -(-part.count() // group))

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "row", "piece"], ascending=[False, True, True], ignore_index=True)
        seq, offset, _ = sum_of_squares(rows["length"].to_numpy(), length)
        rows["sequence_id"] = (seq * groups + int(rows["grp"].iloc[0])) * 2
        rows["offset"] = offset
        return rows.drop(columns="grp")

    dealt = part.withColumn("grp", F.pmod(F.xxhash64("row", F.lit("group")), F.lit(groups)))
    packed = dealt.groupBy("grp").applyInPandas(
        fill, f"id {pieces.schema['id'].dataType.simpleString()}, row long, piece int, start long, length long, crc long, "
              "sequence_id long, offset long")
    # Even numbers are the groups' sequences, odd numbers (unique per row and piece) those of full pieces.
    alone = full.withColumns({"sequence_id": F.monotonically_increasing_id() * 2 + 1, "offset": F.lit(0).cast("long")})
    return packed.unionByName(alone).select(
        F.col("id").alias(id_col), "piece", "start", "length", F.col("crc").alias("ids_crc32"), "sequence_id", "offset")


def packed_ids(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
               tokenizer: str = TOKENIZER, ranks: str | None = RANKS, group: int = GROUP) -> DataFrame:
    """The sequences themselves: sequence_id, and ids, the token ids of its pieces one after the other.

    Identifiers must be unique; a sequence holds at most ``length`` ids, so grouping by it is bounded.
    """
    placed = pack(df, id_col, text_col, length, tokenizer, ranks, group)
    ids = tokenized_pieces(df, id_col, text_col, length, tokenizer, ranks, with_ids=True).select(
        F.col("id").alias(id_col), "piece", "ids")
    return (placed.join(ids, [id_col, "piece"]).groupBy("sequence_id")
            .agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
            .select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids")))
