"""Helpers shared by the text operators: text kernels over Arrow, word caches, bounded samples."""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType
from xxhash import xxh3_64_intdigest

from ..tables import checkpoint_folder, cut

PIECE_BYTES = 2_000_000
CACHE_ENTRIES = 400_000

#: ASCII bytes that are neither letters nor digits become spaces.
_FOLD = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    """Lower-cased words of a text: runs of letters, digits and non-ASCII characters."""
    return text.lower().encode("utf-8", "replace").translate(_FOLD).split()


def slices(array: pa.Array, budget: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """(start, length) of runs whose texts have about `budget` bytes together; a longer text is a run of its own."""
    if not len(array):
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(array), 0).to_numpy(zero_copy_only=False), dtype=np.int64) + 16
    ends, start = np.cumsum(sizes), 0
    while start < len(sizes):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + budget, "right")))
        yield start, stop - start
        start = stop


def text_udf(make_kernel: Callable[[], Callable[[list], pa.Array]], kind: DataType | str) -> Callable[..., Column]:
    """A column function over texts: make_kernel() runs once a task, its result gets lists of texts (None for null)."""

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kernel = make_kernel()
        for batch in batches:
            parts = [kernel(batch.slice(a, n).to_pylist()) for a, n in slices(batch)]
            yield pa.concat_arrays(parts) if parts else kernel([])

    return run


class WordHashes(dict):
    """word -> 64-bit hash; forgets everything when it is full, so that its memory is bounded."""

    def __init__(self, seed: int = 0, most: int = CACHE_ENTRIES):
        super().__init__()
        self.seed, self.most = seed, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxh3_64_intdigest(word, self.seed)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit numbers (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hash_bound(share: float) -> int:
    """The signed 64-bit number at or below which lies about this share of all hashes."""
    return min((1 << 63) - 1, int(share * (1 << 64)) - (1 << 63))


def bounded_sample(rows: DataFrame, key: str, most: int, seed: int) -> DataFrame:
    """At most `most` rows, those with the smallest seeded hash of `key`: the same ones however the table is split. Keys
    are distinct. The rows are counted first, so that only about twice as many as are wanted have to be put in order."""
    order = F.xxhash64(F.lit(seed), F.col(key))
    total = rows.count()
    share = 2 * (most + 100) / max(1, total)
    near = rows
    while share < 1:
        near = rows.where(order <= F.lit(hash_bound(share)))
        if near.count() >= most:
            break
        near, share = rows, share * 4
    return near.orderBy(order, F.col(key)).limit(most)


__all__ = ["CACHE_ENTRIES", "PIECE_BYTES", "WordHashes", "bounded_sample", "checkpoint_folder", "cut", "hash_bound", "mix64", "slices", "text_udf", "words_of"]
