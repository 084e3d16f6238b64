"""Token-id output: one array of 16-bit ids per shard and Elias-Fano encoded document boundaries.

A shard is one row: the ids of its documents one after the other as little-endian 16-bit numbers, and the sorted sequence
of document ends in Elias-Fano form. Of each end the low l = floor(log2(u / n)) bits stand in `ef_lower`, l bits each;
the rest is unary in `ef_upper`: end number i sets bit (end >> l) + i. select(i) gives that bit's position: `ef_select`
has, for every 64th end, the position of its bit, and at most the bits up to the next sample are scanned. That takes
about 2 + log2(u / n) bits a document instead of 64.

The pre-tokenising pattern gives up on very long runs of white space. Such a run is one piece of its own in that pattern
(but for its last character where more text follows), so it is encoded as that piece and what stands around it as usual:
the ids are those of the whole text.

Defined results: null and empty texts are documents of no tokens (their ends repeat); repeated rows are written as often
as they occur; ties can't arise, as rows keep the order of the input partition; an empty table gives no shards; a document
longer than a shard has a shard of its own and is never cut, whatever it consists of; special tokens' names in a text are
ordinary text; columns besides the two that are read don't matter, whatever their names. The tokenizer's file is read by
the driver and broadcast (it has a fixed size below 1 MB), so that executors need no copy of it.
"""

import base64
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import slices

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pre-tokenising pattern published with the byte-level BPE of 50,257 ids.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SHARD_TOKENS = 1 << 22
SAMPLE = 64
#: Runs of white space from this length on are encoded on their own.
LONG_RUN = 10_000
_WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_LONG_WHITE = re.compile(f"(?<![{_WHITE}])[{_WHITE}]{{{LONG_RUN},}}+")


@dataclass(frozen=True)
class EliasFano:
    """A non-decreasing sequence of n numbers below u + 1 with random access."""

    n: int
    low_bits: int
    lower: bytes
    upper: bytes
    samples: bytes

    @staticmethod
    def encode(values: np.ndarray) -> "EliasFano":
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        if not n:
            return EliasFano(0, 0, b"", b"", b"")
        low_bits = max(0, int(max(1, int(values[-1]) // n)).bit_length() - 1)
        low = ((values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1, dtype=np.uint8)
        bits[ones] = 1
        return EliasFano(n, low_bits, np.packbits(low.ravel(), bitorder="little").tobytes(), np.packbits(bits, bitorder="little").tobytes(), ones[::SAMPLE].astype("<u4").tobytes())

    def select(self, i: int) -> int:
        """Position of the bit of number i, found from the nearest sample."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at = int(np.frombuffer(self.samples, dtype="<u4", count=1, offset=4 * (i // SAMPLE))[0])
        left, byte = i % SAMPLE, at >> 3
        if not left:
            return at
        word = self.upper[byte] & (0xFF << (at & 7)) & 0xFF
        while left >= word.bit_count():
            left -= word.bit_count()
            byte += 1
            word = self.upper[byte]
        for _ in range(left):
            word &= word - 1
        return (byte << 3) + (word & -word).bit_length() - 1

    def __getitem__(self, i: int) -> int:
        high, start = self.select(i) - i, i * self.low_bits
        first, last = start >> 3, (start + self.low_bits + 7) >> 3
        low = int.from_bytes(self.lower[first:last], "little") >> (start & 7) & ((1 << self.low_bits) - 1)
        return high << self.low_bits | low

    def decode(self) -> np.ndarray:
        """All numbers."""
        if not self.n:
            return np.empty(0, dtype=np.int64)
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.upper, np.uint8), bitorder="little"))[: self.n]
        low = np.unpackbits(np.frombuffer(self.lower, np.uint8), bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
        return ((ones - np.arange(self.n)) << self.low_bits) + low.astype(np.int64) @ (1 << np.arange(self.low_bits, dtype=np.int64))


def read_ranks(lines: bytes):
    """The encoding of a file of ranks, from its content."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines())}
    if len(ranks) > 1 << 16:
        raise ValueError("ids don't fit 16 bits")
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def load_tokenizer(path: str):
    with open(path, "rb") as file:
        return read_ranks(file.read())


def encoder(encoding) -> Callable[[str | None], list[int]]:
    """Ids of a text of any kind, as the tokenizer has them."""
    plain = encoding.encode_ordinary

    def encode(text: str | None) -> list[int]:
        if not text:
            return []
        if len(text) < LONG_RUN:
            return plain(text)
        out, done = [], 0
        for m in _LONG_WHITE.finditer(text):
            stop = m.end() - (m.end() < len(text))
            out += plain(text[done : m.start()])
            out += encoding._encode_single_piece(text[m.start() : stop])
            done = stop
        return out + plain(text[done:])

    return encode


_ENCODERS: dict = {}

_FIELDS = [("doc_ids", T.ArrayType(T.LongType())), ("n_docs", T.LongType()), ("n_tokens", T.LongType()), ("token_ids", T.BinaryType()), ("ef_low_bits", T.IntegerType()), ("ef_lower", T.BinaryType()), ("ef_upper", T.BinaryType()), ("ef_select", T.BinaryType())]
SCHEMA = T.StructType([T.StructField(n, t) for n, t in _FIELDS])


def token_shards(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str = TOKENIZER, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row a shard (SCHEMA): ids of its documents, token ids, Elias-Fano ends. Map only: nothing is shuffled."""
    doc_ids = T.ArrayType(docs.schema[id_col].dataType)
    schema = T.StructType([T.StructField("doc_ids", doc_ids), *SCHEMA.fields[1:]])
    with open(tokenizer_path, "rb") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path not in _ENCODERS:  # kept while the worker lives
            _ENCODERS[tokenizer_path] = encoder(read_ranks(shared.value))
        tokenize = _ENCODERS[tokenizer_path]
        ids, tokens, sizes, total, kind = [], [], [], 0, None

        def shard() -> pa.RecordBatch:
            ends = EliasFano.encode(np.cumsum(sizes))
            row = [pa.array([ids], type=pa.list_(kind)), pa.array([len(ids)], pa.int64()), pa.array([total], pa.int64()), pa.array([b"".join(tokens)], pa.binary()), pa.array([ends.low_bits], pa.int32()), *(pa.array([x], pa.binary()) for x in (ends.lower, ends.upper, ends.samples))]
            return pa.RecordBatch.from_arrays(row, names=schema.names)

        for batch in batches:
            kind = batch.schema.field(0).type
            for a, n in slices(batch.column(1)):
                for doc, text in zip(batch.column(0).slice(a, n).to_pylist(), batch.column(1).slice(a, n).to_pylist(), strict=True):
                    found = np.array(tokenize(text), dtype="<u2")
                    if ids and total + len(found) > shard_tokens:
                        yield shard()
                        ids, tokens, sizes, total = [], [], [], 0
                    ids.append(doc)
                    tokens.append(found.tobytes())
                    sizes.append(len(found))
                    total += len(found)
        if ids:
            yield shard()

    return docs.select(id_col, text_col).mapInArrow(encode, schema)


def boundaries(row) -> EliasFano:
    """The document ends of a shard row."""
    return EliasFano(row["n_docs"], row["ef_low_bits"], bytes(row["ef_lower"]), bytes(row["ef_upper"]), bytes(row["ef_select"]))


def document_tokens(row, i: int) -> np.ndarray:
    """Token ids of the shard's document number i, by two selects."""
    ends = boundaries(row)
    start, stop = ends[i - 1] if i else 0, ends[i]
    return np.frombuffer(row["token_ids"], dtype="<u2", count=stop - start, offset=2 * start)
