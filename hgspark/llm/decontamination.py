"""Benchmark decontamination by Wu-Manber multi-pattern search.

Test strings are all windows of `window` consecutive words of every benchmark item, or the whole item where it has fewer
words. Texts and items are folded alike (lower case; ASCII punctuation and white space become one space), and a window
has to begin and end at a word.

Shift table: for every block of B bytes in the first m bytes of a test string (m: length of the shortest) the distance to
that prefix's end, else m - B + 1. Buckets: test strings by the hash of the block that ends their prefix. A text is cut
into lanes that advance together, each by the shift of its block; where the shift is 0, the bucket's strings whose first
bytes agree are compared directly.

Defined results: null, empty and wordless texts and items match nothing; a text of any length is searched whole; a document
row that is repeated counts once; items with equal text are all reported; ties can't arise, as every match is reported; a
null id stays null in the result; an empty table of documents or items gives no rows; columns besides those that are read
don't matter, whatever their names.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import PIECE_BYTES, slices, text_udf, words_of

WINDOW = 8
LANE = 4096
TABLE_BITS = 20
#: Test strings a table may hold; more are searched by further tables, one after the other.
TABLE_STRINGS = 1_000_000
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def windows(text: str | None, window: int = WINDOW) -> list[bytes]:
    """The distinct test strings of an item, in order of appearance."""
    words = words_of(text) if text else []
    if not words:
        return []
    return list(dict.fromkeys(b" " + b" ".join(words[i : i + window]) + b" " for i in range(max(1, len(words) - window + 1))))


class WuManber:
    """Finds which of the given byte strings occur in a buffer."""

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.m = min(map(len, strings))
        self.b = min(8, self.m)
        self.mask = np.uint64((1 << (8 * self.b)) - 1)
        self.far = self.m - self.b + 1
        self.shift = np.full(1 << TABLE_BITS, self.far, dtype=np.int32)
        flat = np.frombuffer(b"".join(s[: self.m] for s in strings), dtype=np.uint8).reshape(len(strings), self.m)
        padded = np.zeros((len(strings), self.m + 8), dtype=np.uint8)
        padded[:, : self.m] = flat
        for end in range(self.b, self.m + 1):
            np.minimum.at(self.shift, self.slot(self.blocks(padded, end - self.b)), self.m - end)
        last = self.slot(self.blocks(padded, self.m - self.b))
        self.order = np.argsort(last, kind="stable")
        self.first = self.blocks(padded, 0)[self.order]
        self.start = np.searchsorted(last[self.order], np.arange((1 << TABLE_BITS) + 1)).astype(np.int32)

    def blocks(self, rows: np.ndarray, at: int) -> np.ndarray:
        return np.ascontiguousarray(rows[:, at : at + 8]).view("<u8")[:, 0] & self.mask

    def slot(self, block: np.ndarray) -> np.ndarray:
        return ((block * _MULTIPLIER) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def search(self, buffer: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Start positions and numbers of the strings that occur."""
        n = len(buffer)
        if n < self.m:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        view = np.ndarray((n,), dtype="<u8", buffer=buffer + b"\0" * 8, strides=(1,))
        at = np.arange(self.m - self.b, n - self.b + 1, LANE)
        stop = np.minimum(at + LANE, n - self.b + 1)
        found = []
        while len(at):
            slot = self.slot(view[at] & self.mask)
            step = self.shift[slot]
            hit = step == 0
            if hit.any():
                found.append((at[hit], slot[hit]))
            at = at + np.maximum(step, 1)
            live = at < stop
            at, stop = at[live], stop[live]
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        begin = np.concatenate([a for a, _ in found]) - (self.m - self.b)
        slot = np.concatenate([s for _, s in found])
        count = self.start[slot + 1] - self.start[slot]
        who = np.repeat(np.arange(len(slot)), count)
        entry = np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count) + self.start[slot][who]
        same = (view[begin] & self.mask)[who] == self.first[entry]
        begin, number = begin[who[same]], self.order[entry[same]]
        strings = self.strings
        right = [buffer.startswith(strings[k], p) for p, k in zip(begin.tolist(), number.tolist(), strict=True)]
        return begin[right], number[right]

    def search_texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text number, string number) pairs, sorted."""
        folded = [b" " + b" ".join(words_of(t)) + b" \n" if t else b"\n" for t in texts]
        ends = np.cumsum([len(x) for x in folded])
        begin, number = self.search(b"".join(folded))
        owner = np.searchsorted(ends, begin, "right")
        pairs = np.unique(np.stack([owner, number], axis=1), axis=0) if len(owner) else np.empty((0, 2), np.int64)
        return pairs[:, 0], pairs[:, 1]


def _tables(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> list[tuple[WuManber, np.ndarray, np.ndarray, list]]:
    """Search tables of at most TABLE_STRINGS strings with, for each string, the items that hold it."""
    items, holders = [], {}
    for row in benchmark.select(F.col(item_col).alias("i"), F.col(text_col).alias("t")).distinct().toLocalIterator():
        found = windows(row["t"], window)
        for s in found:
            holders.setdefault(s, []).append(len(items))
        items.append(row["i"])
    strings, out = sorted(holders), []
    for k in range(0, len(strings), TABLE_STRINGS):
        part = strings[k : k + TABLE_STRINGS]
        offsets = np.cumsum([0, *(len(holders[s]) for s in part)])
        out.append((WuManber(part), offsets, np.array([i for s in part for i in holders[s]], dtype=np.int64), items))
    return out


def benchmark_overlaps(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, item, n_windows): every document and item that share at least one test string, and how many they share."""
    spark = docs.sparkSession
    id_type, item_type = docs.schema[id_col].dataType, benchmark.schema[item_col].dataType
    schema = T.StructType([T.StructField(id_col, id_type), T.StructField(item_col, item_type), T.StructField("n_windows", T.LongType())])
    arrow_item = spark.createDataFrame([], T.StructType([schema[1]])).toArrow().schema.field(0).type
    parts = []
    for table in _tables(benchmark, item_col, item_text_col, window):
        shared = spark.sparkContext.broadcast(table)

        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            search, offsets, flat, items = shared.value
            for batch in batches:
                for a, n in slices(batch.column(1)):
                    ids = batch.column(0).slice(a, n)
                    text, string = search.search_texts(batch.column(1).slice(a, n).to_pylist())
                    if not len(text):
                        continue
                    each = offsets[string + 1] - offsets[string]
                    who = np.repeat(text, each)
                    item = flat[np.arange(len(who)) - np.repeat(np.cumsum(each) - each, each) + np.repeat(offsets[string], each)]
                    pairs, count = np.unique(np.stack([who, item], axis=1), axis=0, return_counts=True)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(pairs[:, 0])), pa.array([items[i] for i in pairs[:, 1]], type=arrow_item), pa.array(count, type=pa.int64())], names=[id_col, item_col, "n_windows"])

        parts.append(docs.select(id_col, text_col).mapInArrow(find, schema))
    if not parts:
        return spark.createDataFrame([], schema)
    # Equal rows of a table count once; windows of one item in several search tables add up.
    found = [p.groupBy(id_col, item_col).agg(F.max("n_windows").alias("n_windows")) for p in parts]
    whole = found[0]
    for p in found[1:]:
        whole = whole.unionByName(p)
    return whole if len(found) == 1 else whole.groupBy(id_col, item_col).agg(F.sum("n_windows").alias("n_windows"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The documents that share no test string with the benchmark, all columns kept; no shuffle."""
    clean = docs
    for search, *_ in _tables(benchmark, item_col, item_text_col, window):
        shared = docs.sparkSession.sparkContext.broadcast(search)

        def make(shared=shared):
            def kernel(texts: list) -> pa.Array:
                out = np.ones(len(texts), dtype=bool)
                out[shared.value.search_texts(texts)[0] if texts else []] = False
                return pa.array(out)

            return kernel

        clean = clean.where(text_udf(make, "boolean")(F.col(text_col)))
    return clean


__all__ = ["PIECE_BYTES", "WINDOW", "WuManber", "benchmark_overlaps", "drop_contaminated", "windows"]
