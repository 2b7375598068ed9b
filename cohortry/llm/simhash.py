"""SimHash near-dedup: 64-bit fingerprints, compared exactly tile by tile.

Distinct fingerprints are cut into tiles of one population count each and about TILE_ROWS rows.  Two tiles
meet only when their population counts differ by at most the radius, since counts that differ by more
cannot belong to fingerprints within it.  Inside a pair of tiles the same rule is applied again to the
population counts of the four 16-bit quarters, and the blocks that remain are compared by exclusive-or and
bit counts.  A task keeps a spanning forest of the links it finds, never the pairs themselves.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortry.llm.common import col, durable, spare_name
from cohortry.llm.components import connected_components

SEED = 42
TILE_ROWS = 131_072      # fingerprints in a tile, 1 MB
BLOCK = 1 << 21          # compared at once, in cells
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None, words: int = 4) -> int:
    """The fingerprint of a text as an unsigned number; no word at all gives zero."""
    found = (text or "").encode().translate(FOLD).split()
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= words:
        shingles = [joined]
    else:
        ends = np.cumsum([len(w) + 1 for w in found])
        starts = np.concatenate(([0], ends[:-1]))[:len(found) - words + 1]
        shingles = [joined[s:e] for s, e in zip(starts.tolist(), (ends[words - 1:] - 1).tolist())]
    hashes = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), shingles), np.uint64, len(shingles))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at:at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1,
                             bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """One row (id, fp) per input row; fp holds the 64 bits as a signed long."""
    @F.pandas_udf(T.LongType())
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64))

    return df.select(col(id_col).alias("id"), of(col(text_col).cast("string")).alias("fp"))


def _quarters(fps: np.ndarray) -> np.ndarray:
    """Population counts of the four 16-bit quarters, one row each."""
    return np.bitwise_count(np.ascontiguousarray(fps).view(np.uint16).reshape(-1, 4)).astype(np.int8)


def tile_links(a: np.ndarray, b: np.ndarray | None, radius: int) -> list[tuple[int, int]]:
    """A spanning forest (fingerprint, root) of the links within ``a``, or between ``a`` and ``b``."""
    own = b is None
    rest = a if own else b
    order = np.lexsort(_quarters(a).T)
    a = a[order]
    cells, first = np.unique(_quarters(a), axis=0, return_index=True)
    cuts = np.append(np.sort(first), len(a))
    all_fps = a if own else np.concatenate([a, rest])
    root = np.arange(len(all_fps))
    if own:
        rest = a
    shift = 0 if own else len(a)
    marks = _quarters(rest)
    kinds, kind_of = np.unique(marks, axis=0, return_inverse=True)
    kind_of = kind_of.ravel()
    for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        mark = _quarters(a[s:s + 1])[0]
        near = np.abs(kinds.astype(np.int16) - mark).sum(axis=1) <= radius
        cand = np.flatnonzero(near[kind_of])
        if own:
            cand = cand[cand >= s]      # earlier blocks were compared from their side
        if not len(cand):
            continue
        other = rest[cand]
        rows = max(1, BLOCK // len(other))
        for at in range(s, e, rows):
            mine = a[at:min(e, at + rows)]
            i, j = np.nonzero(np.bitwise_count(mine[:, None] ^ other[None, :]) <= radius)
            i, j = i + at, cand[j] + shift
            while len(i):
                x, y = root[i], root[j]
                apart = x != y
                i, j, x, y = i[apart], j[apart], x[apart], y[apart]
                if not len(i):
                    break
                np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
                while True:
                    up = root[root]
                    if np.array_equal(up, root):
                        break
                    root = up
    moved = np.flatnonzero(root != np.arange(len(root)))
    signed = all_fps.view(np.int64)
    return list(zip(signed[moved].tolist(), signed[root[moved]].tolist()))


def fingerprint_links(distinct: DataFrame, radius: int, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Links (u, v) that connect exactly the distinct fingerprints (column fp) within ``radius`` bits of each other."""
    counted = distinct.withColumn("pop", F.bit_count("fp"))
    sizes = {r["pop"]: r["n"] for r in counted.groupBy("pop").agg(F.count(F.lit(1)).alias("n")).collect()}  # 65 rows
    cuts = F.array(*[F.lit(-(-sizes.get(p, 0) // tile_rows)) for p in range(65)])
    tiles = (counted.withColumn("cut", F.pmod(F.xxhash64("fp", F.lit("tile")), cuts[F.col("pop")]).cast("int"))
             .groupBy("pop", "cut").agg(F.collect_list("fp").alias("fps")))
    low, high = F.greatest(F.col("pop") - radius, F.lit(0)), F.least(F.col("pop") + radius, F.lit(64))
    partners = F.flatten(F.transform(F.sequence(low, high), lambda q: F.transform(
        F.filter(F.sequence(F.lit(0), cuts[q]), lambda s: s < cuts[q]),
        lambda s: F.struct(q.alias("pop"), s.alias("cut")))))
    me, you = F.struct("pop", "cut"), F.col("partner")
    pairs = (tiles.withColumn("partner", F.explode(partners))
             .select(F.least(me, you).alias("low"), F.greatest(me, you).alias("high"),
                     (me == you).alias("alone"), "fps"))

    def compare(pair: pd.DataFrame) -> pd.DataFrame:
        sides = [np.asarray(x, np.int64).view(np.uint64) for x in pair["fps"]]
        if pair["alone"].iloc[0]:
            found = tile_links(sides[0], None, radius)
        else:      # a tile that got no rows has no partner to meet
            found = tile_links(*sides, radius) if len(sides) == 2 else []
        return pd.DataFrame(found, columns=["u", "v"], dtype="int64")

    return pairs.groupBy("low", "high").applyInPandas(compare, "u long, v long")


def simhash_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4,
                       radius: int = 4, tile_rows: int = TILE_ROWS) -> DataFrame:
    """One row per input row: ``id_col``, fingerprint (16 lowercase hex digits), component_id.

    A-Z in lower case, words between ASCII white space, shingles of ``words`` words with repeats (fewer words:
    the whole sequence); a bit is 1 where over half of the shingles' hashes have it.  Null, empty and blank
    texts have fingerprint zero and link like any other.  component_id is the smallest identifier reachable
    over links of at most ``radius`` differing bits; null identifiers are reached but never name a component
    unless all of it is null.  Repeated rows come out as often as they went in.  Other columns are not
    touched; an empty table gives an empty result.
    """
    fps = durable(fingerprints(df, id_col, text_col, words), "fingerprints")
    distinct = durable(fps.groupBy("fp").agg(F.min("id").alias("rep")), "distinct")
    roots = connected_components(fingerprint_links(distinct.select("fp"), radius, tile_rows), "u", "v")
    owned = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "rep", F.coalesce("root", "fp").alias("root"))
    least = owned.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = durable(owned.join(least, "root").select("fp", "component_id"), "components")
    return fps.join(named, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4,
                     radius: int = 4) -> DataFrame:
    """The rows of ``df`` whose identifier names their component, with their columns and nothing else.

    Rows that share an identifier are one document.  Rows without identifier have none to stay by and are
    kept.
    """
    found = simhash_components(df.select(col(id_col).alias("id"), col(text_col).alias("text")), "id", "text", words, radius)
    stay = found.groupBy("id").agg(F.max(F.col("id") == F.col("component_id")).alias("stays")).where("not stays")
    name = spare_name(df, "__simhash_id")
    gone = durable(stay.select(F.col("id").alias(name)), "near-copies")
    return df.join(gone, col(id_col) == F.col(name), "left_anti")
