"""Sharding by histogram sort: exact byte counts below probes refine the splitters, then rows are exchanged once.

Rows are ordered by an integer key and cut into n shards of nearly equal text bytes. Splitter i (1 to n - 1) is the least
key at or below which lie at least i / n of all bytes; a row's shard is the number of splitters below its key. Each
splitter has an interval that holds it. A round spreads probes over all open intervals, every partition adds up the exact
bytes between neighbouring probes, and the sums narrow the intervals, until each is a single key or its count is within
the tolerance (a share of a shard's bytes; 0: exact). The rounds read only a table of keys and sizes kept in the shared
checkpoint folder, not the texts.

Splitters are arrays of numbers on the driver, about 40 bytes a shard. Rows of a shard are one partition, sorted by key;
above MOST_PARTITIONS shards a partition holds several, one after the other.

Defined results: the key has to be of an integer type, any other is a TypeError; a null key comes first, in shard 0, where
its bytes may fill further shards that stay empty; rows with equal keys (ties, repeated rows) stay together whatever their
size; null texts have 0 bytes, a text of any length counts whole and is never cut; an empty table, or one without any
byte, is one shard; other columns are kept whatever their names, but a column that has the shard column's name is
replaced.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut

SHARD_BYTES = 32 << 20
MIN_SHARDS = 16
PROBES = 16
#: Probes of a round (8 bytes each, broadcast) and partitions of the exchange, whatever the number of shards.
MOST_PROBES = 1 << 20
MOST_PARTITIONS = 50_000


def _histogram(sizes: DataFrame, probes: np.ndarray) -> np.ndarray:
    """Exact bytes with key <= probe, for each of the sorted probes; null keys don't count here."""
    shared = sizes.sparkSession.sparkContext.broadcast(probes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(shared.value) + 1, dtype=np.int64)
        for batch in batches:
            keys, size = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            np.add.at(sums, np.searchsorted(shared.value, keys, "left"), size)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some])], names=["slot", "bytes"])

    found = sizes.mapInArrow(count, "slot long, bytes long").groupBy("slot").agg(F.sum("bytes").alias("bytes")).toArrow()
    sums = np.zeros(len(probes) + 1, dtype=np.int64)
    sums[found["slot"].to_numpy()] = found["bytes"].to_numpy()
    shared.unpersist()
    return np.cumsum(sums)[:-1]


def find_splitters(sizes: DataFrame, n_shards: int | None = None, *, shard_bytes: int = SHARD_BYTES, min_shards: int = MIN_SHARDS, tolerance: float = 0.0, probes: int = PROBES, most_probes: int = MOST_PROBES) -> np.ndarray:
    """Splitters for rows (key, bytes), both long; `sizes` is read once a round. A round has at most `most_probes` probes,
    or one an open interval where there are more of these."""
    key, size = sizes.columns
    low, high, total, null_bytes = sizes.agg(F.min(key), F.max(key), F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.sum(F.when(F.col(key).isNull(), F.col(size))), F.lit(0))).first()
    n = n_shards or max(min_shards, -(-total // shard_bytes))
    if low is None or not total or n < 2:
        return np.empty(0, dtype=np.int64)
    keyed = sizes.where(F.col(key).isNotNull())
    target = np.array([-(-i * total // n) for i in range(1, n)], dtype=np.int64) - null_bytes
    # a splitter lies in lo .. hi, as unsigned distances from the lowest key, which hold any range of 64-bit keys
    base = np.int64(low).astype(np.uint64)
    lo, hi = np.zeros(n - 1, dtype=np.uint64), np.full(n - 1, high - low, dtype=np.uint64)
    excess, allowed = total - null_bytes - target, tolerance * total / n
    while True:
        left = np.flatnonzero((hi > lo) & (excess > allowed) & (target > 0))
        if not len(left):
            break
        k = np.uint64(min(probes, max(1, most_probes // len(left))))
        step, rest = np.divmod(hi[left] - lo[left], k + np.uint64(1))
        at = np.unique(np.concatenate([lo[left] + step * j + rest * j // (k + np.uint64(1)) for j in range(1, int(k) + 1)]))
        below = _histogram(keyed, (at + base).view(np.int64))
        reach = np.searchsorted(below, target[left], "left")  # the first probe that has enough below
        inside = left[(reach < len(at)) & (at[np.minimum(reach, len(at) - 1)] <= hi[left])]
        first = np.searchsorted(below, target[inside], "left")
        hi[inside], excess[inside] = at[first], below[first] - target[inside]
        some = reach > 0
        lo[left[some]] = np.maximum(lo[left[some]], at[reach[some] - 1] + np.uint64(1))
    found = (hi + base).view(np.int64)
    found[target <= 0] = max(low - 1, -(1 << 63))  # rows without a key fill these shards
    return found


def shard_by_bytes(docs: DataFrame, *, key_col: str = "doc_id", text_col: str = "text", shard_col: str = "shard", n_shards: int | None = None, shard_bytes: int = SHARD_BYTES, min_shards: int = MIN_SHARDS, tolerance: float = 0.0, probes: int = PROBES, most_partitions: int = MOST_PARTITIONS) -> DataFrame:
    """All rows and columns with their shard; one exchange, after which partition i is shard i sorted by key."""
    if not isinstance(docs.schema[key_col].dataType, T.IntegralType):
        raise TypeError(f"the key {key_col} has to be of an integer type, not {docs.schema[key_col].dataType.simpleString()}")
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")
    sizes = cut(docs.select(F.col(key_col).cast("long").alias("key"), size.alias("bytes")))
    splitters = find_splitters(sizes, n_shards, shard_bytes=shard_bytes, min_shards=min_shards, tolerance=tolerance, probes=probes)
    shared = docs.sparkSession.sparkContext.broadcast(splitters)

    @F.arrow_udf("int")
    def place(keys: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(shared.value, np.asarray(keys), "left").astype(np.int32))

    key = F.coalesce(F.col(key_col).cast("long"), F.lit(-(1 << 63)))
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != shard_col.lower()], place(key).alias(shard_col))
    together = -(-(len(splitters) + 1) // most_partitions)
    parts = -(-(len(splitters) + 1) // together)
    return kept.repartitionById(parts, F.floor(F.col(shard_col) / together).cast("int")).sortWithinPartitions(key_col)
