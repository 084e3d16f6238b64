"""Document fingerprints: 64-bit SimHash and all pairs within a Hamming radius by permuted block tables.

Terms are a text's distinct words. A term's weight is (1 + log2 of its occurrences in the text) times its rarity, the
logarithm of rows over rows with the term; rows are counted over the whole table in a fixed number of hashed buckets, so
that the table of rarities that tasks get doesn't grow with the data. Every bit of a term's hash votes for or against the
fingerprint's bit with that weight; ties vote against.

Search: the 64 bits are cut into radius + spare blocks. Two fingerprints within the radius agree in at least `spare`
blocks, so for every choice of `spare` blocks there is a table keyed by those blocks' bits (the permuted prefix), and
distinct fingerprints that share a key are compared. A pair is taken only from the first table in which it agrees. Any
`spare` of at least 1 finds the same pairs; it is chosen from the number of distinct fingerprints, so that keys grow
longer as these grow more and a key's chance partners stay few. Equal fingerprints are put together before, so that copies
don't multiply the work.

Result: (fingerprint_a, fingerprint_b, distance, doc_id_a, doc_id_b). A fingerprint stands for the rows that have it, its
representative is their least id. Rows with fingerprint_a < fingerprint_b (as signed numbers) are the pairs of
fingerprints within the radius, with their representatives; rows with equal fingerprints and distance 0 are the members:
doc_id_b has the same fingerprint as its representative doc_id_a. No link is left out, and no list grows with the copies
of a text.

Defined results: null, empty and wordless texts have no fingerprint and no partners; a text of any length is read whole;
rows with a null id are left out; a repeated row counts once, an id with several texts has the fingerprint of each; an
empty table gives no rows; columns besides the two that are read don't matter, whatever their names.
"""

from collections import Counter
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, cut, slices, text_udf, words_of

RADIUS = 3
#: Comparisons of two fingerprints that cost as much as one more row of a table.
COMPARISONS = 8
DF_BITS = 18
#: Distinct words up to which sums of weights are exact in single precision.
EXACT_TERMS = 16_000
SEED = 3


def _terms(texts: list[str | None], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of distinct words by text, hashes of the words and how often each occurs in its text."""
    found = [Counter(words_of(t)) if t else {} for t in texts]
    sizes = np.array([len(c) for c in found], dtype=np.int64)
    words = hashes.of([w for c in found for w in c])
    return sizes, words, np.fromiter((n for c in found for n in c.values()), dtype=np.int64, count=len(words))


def term_rarities(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """log(rows / rows with a term of the bucket) of every bucket, over all rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, table, rows = WordHashes(SEED), np.zeros((1 << DF_BITS) + 1, dtype=np.int64), 0
        for batch in batches:
            for a, n in slices(batch.column(0)):
                _, word, _ = _terms(batch.column(0).slice(a, n).to_pylist(), hashes)
                table[:-1] += np.bincount((word >> np.uint64(64 - DF_BITS)).astype(np.int64), minlength=1 << DF_BITS)
                rows += n
        table[-1] = rows
        some = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(table[some])], names=["bucket", "rows"])

    found = docs.select(text_col).mapInArrow(count, "bucket long, rows long").groupBy("bucket").agg(F.sum("rows").alias("rows")).toArrow()
    table = np.zeros((1 << DF_BITS) + 1, dtype=np.int64)
    table[found["bucket"].to_numpy()] = found["rows"].to_numpy()
    return np.log1p(table[-1] / np.maximum(1, table[:-1])).astype(np.float32)


def simhash(texts: list[str | None], rarity: np.ndarray, hashes: WordHashes) -> list[int | None]:
    """Signed 64-bit fingerprints; None for a text without words."""
    sizes, word, times = _terms(texts, hashes)
    weight = (1 + np.log2(times)) * rarity[(word >> np.uint64(64 - DF_BITS)).astype(np.int64)]
    # whole numbers, so that sums don't depend on their order
    weight = np.maximum(1, np.rint(weight * 4)).astype(np.float32)
    out: list[int | None] = []
    start = 0
    for n in sizes.tolist():
        if not n:
            out.append(None)
            continue
        own = weight[start : start + n]
        if n > EXACT_TERMS:
            own = own.astype(np.float64)
        bits = np.unpackbits(word[start : start + n].astype("<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little").astype(own.dtype)
        out.append(int(np.packbits(2 * (own @ bits) > own.sum(), bitorder="little").view("<i8")[0]))
        start += n
    return out


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) of every row; the fingerprint is null where there are no words."""
    shared = docs.sparkSession.sparkContext.broadcast(term_rarities(docs, text_col))

    def make():
        hashes = WordHashes(SEED)
        return lambda texts: pa.array(simhash(texts, shared.value, hashes), pa.int64())

    return docs.select(id_col, text_udf(make, "long")(F.col(text_col)).alias("fingerprint"))


def spare_blocks(fingerprints: int, radius: int) -> int:
    """The number of blocks in a key for which tables and chance partners together cost least."""

    def cost(spare: int) -> float:
        return comb(radius + spare, spare) * (1 + fingerprints / 2.0 ** (64 * spare // (radius + spare)) / COMPARISONS)

    return min(range(2, 9), key=cost)


def block_masks(radius: int, spare: int) -> list[int]:
    """Masks of radius + spare blocks that make up 64 bits, as signed numbers."""
    n = radius + spare
    edges = [64 * i // n for i in range(n + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def hamming_pairs(prints: DataFrame, column: str, radius: int = RADIUS, spare: int = 2) -> DataFrame:
    """(fingerprint_a, fingerprint_b, distance) of all pairs of the distinct values of `column` within the radius."""
    if not 0 <= radius < 32 or spare < 1:
        raise ValueError("radius or spare")
    masks = block_masks(radius, spare)
    tables = list(combinations(range(len(masks)), spare))
    value = F.col(column)

    def masked(v: Column, blocks: tuple[int, ...]) -> Column:
        mask = 0
        for b in blocks:
            mask |= masks[b]
        return v.bitwiseAND(F.lit(mask).cast("long"))

    keyed = prints.select(value.alias("__p"), F.explode(F.array(*[F.struct(F.lit(k).alias("k"), masked(value, blocks).alias("v")) for k, blocks in enumerate(tables)])).alias("__key"))
    keyed = keyed.select("__p", F.col("__key.k").alias("__k"), F.col("__key.v").alias("__v"))
    differ = F.col("a.__p").bitwiseXOR(F.col("b.__p"))
    # the first table in which a pair agrees is that of its first `spare` equal blocks
    earlier = F.lit(False)
    for k, blocks in enumerate(tables):
        skipped = [b for b in range(blocks[-1]) if b not in blocks]
        clash = F.lit(False)
        for b in skipped:
            clash = clash | (differ.bitwiseAND(F.lit(masks[b]).cast("long")) == 0)
        earlier = F.when(F.col("a.__k") == k, clash).otherwise(earlier)
    pairs = keyed.alias("a").join(keyed.alias("b"), (F.col("a.__k") == F.col("b.__k")) & (F.col("a.__v") == F.col("b.__v")) & (F.col("a.__p") < F.col("b.__p")))
    near = pairs.where(F.bit_count(differ) <= radius).where(~earlier)
    return near.select(F.col("a.__p").alias("fingerprint_a"), F.col("b.__p").alias("fingerprint_b"), F.bit_count(differ).cast("int").alias("distance"))


def near_fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, spare: int | None = None) -> DataFrame:
    """All fingerprints within the radius of each other, and the members of each that several rows have."""
    found = fingerprints(docs, id_col=id_col, text_col=text_col).select(F.col(id_col).alias("id"), "fingerprint")
    prints = cut(found.where(F.col("fingerprint").isNotNull() & F.col("id").isNotNull()))
    groups = cut(prints.groupBy("fingerprint").agg(F.min("id").alias("least"), F.max("id").alias("last")))
    pairs = hamming_pairs(groups.select("fingerprint"), "fingerprint", radius, spare or spare_blocks(groups.count(), radius))
    a, b = (groups.select(F.col("fingerprint").alias(f"fingerprint_{x}"), F.col("least").alias(f"doc_id_{x}")) for x in "ab")
    columns = ["fingerprint_a", "fingerprint_b", "distance", "doc_id_a", "doc_id_b"]
    copied = groups.where(F.col("least") != F.col("last")).select(F.col("fingerprint").alias("fingerprint_a"), F.col("least").alias("doc_id_a"))
    held = prints.distinct().join(copied, F.col("fingerprint") == F.col("fingerprint_a")).where(F.col("id") != F.col("doc_id_a"))
    members = held.select("fingerprint_a", F.col("fingerprint").alias("fingerprint_b"), F.lit(0).alias("distance"), "doc_id_a", F.col("id").alias("doc_id_b"))
    return pairs.join(a, "fingerprint_a").join(b, "fingerprint_b").select(columns).unionByName(members)
