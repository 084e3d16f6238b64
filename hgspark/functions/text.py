"""Text functions: content ids, the recursive splitter, previews, file stems, chunk tables."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CHUNK_OVERLAP, PREVIEW_CHARS, SPLITTER_CHUNK_SIZE

SEPARATORS = ("\n\n", "\n", ". ", " ", "")


def content_id(text: Column) -> Column:
    """Lower-case hexadecimal MD5 of the UTF-8 text."""
    return F.md5(text.cast("binary"))


def preview(text: Column, most: int = PREVIEW_CHARS) -> Column:
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most), F.lit("...")))


def file_stem(path: Column) -> Column:
    """The last part of a path without its last extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")


class RecursiveSplitter:
    """Splits at the coarsest separator that occurs, parts that are too long at the next ones, and glues small parts.

    Lengths are code points. A part as long as a chunk is split further though it would fit; gluing allows exactly a
    chunk's length. The whole list is glued once more at the end, so small neighbours from different branches join and an
    overlap is applied twice. Without overlap and with separators kept, the chunks concatenate to the text.
    """

    def __init__(self, chunk_size: int = SPLITTER_CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, separators: Iterable[str] = SEPARATORS, keep_separator: bool = True):
        if chunk_size <= 0 or not 0 <= overlap < chunk_size:
            raise ValueError("the chunk size must be positive and the overlap smaller")
        self.size, self.overlap, self.separators, self.keep = chunk_size, overlap, tuple(separators), keep_separator

    def __repr__(self) -> str:
        return f"RecursiveSplitter(chunk_size: {self.size}, overlap: {self.overlap})"

    def __call__(self, text: str) -> list[str]:
        return self._glue(self._divide(text, self.separators))

    def _parts(self, text: str, separator: str) -> list[str]:
        if not separator:
            return list(text)
        parts = text.split(separator)
        if self.keep:
            parts = [p + separator for p in parts[:-1]] + parts[-1:]
        return [p for p in parts if p]

    def _divide(self, text: str, separators: tuple[str, ...]) -> list[str]:
        at = next((k for k, s in enumerate(separators) if not s or s in text), None)
        chosen = separators[at] if at is not None else (separators[-1] if separators else "")
        finer = separators[at + 1 :] if at is not None and chosen else ()
        out: list[str] = []
        small: list[str] = []
        for part in self._parts(text, chosen):
            if len(part) < self.size:
                small.append(part)
                continue
            out += self._glue(small)
            small = []
            out += self._divide(part, finer) if finer else [part]
        return out + self._glue(small)

    def _glue(self, parts: list[str]) -> list[str]:
        out: list[str] = []
        now: list[str] = []
        length = 0
        for part in parts:
            if length + len(part) <= self.size:
                now.append(part)
                length += len(part)
                continue
            whole = "".join(now)
            if whole:
                out.append(whole)
            start = whole[max(0, len(whole) - self.overlap) :] + part if self.overlap and out else part
            if len(start) > self.size:
                out.append(start)
                now, length = [], 0
            else:
                now, length = [start], len(start)
        if length:
            out.append("".join(now))
        return out


def chunk_texts(text: Column | str, splitter: RecursiveSplitter | None = None) -> Column:
    """The array of a text's chunks in order; none of null and empty texts."""
    cutter = splitter or RecursiveSplitter()

    @F.arrow_udf("array<string>")
    def pieces(texts: pa.Array) -> pa.Array:
        return pa.array([cutter(t) if t else [] for t in texts.to_pylist()], pa.list_(pa.string()))

    return pieces(text)


def split_documents(docs: DataFrame, splitter: RecursiveSplitter | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, seq, chunk_id, text): the chunks of every document in order. Null and empty texts give none."""
    parts = docs.select(id_col, F.posexplode(chunk_texts(F.col(text_col), splitter)).alias("seq", "text"))
    return parts.select(id_col, "seq", content_id(F.col("text")).alias("chunk_id"), "text")


class ChunkIndex:
    """Texts by chunk id: (chunk_id, text), one row an id."""

    def __init__(self, df: DataFrame):
        self.df = df.select("chunk_id", "text")

    @staticmethod
    def empty(spark: SparkSession) -> ChunkIndex:
        return ChunkIndex(spark.createDataFrame([], "chunk_id string, text string"))

    @staticmethod
    def from_dict(spark: SparkSession, items: dict[str, str]) -> ChunkIndex:
        return ChunkIndex(spark.createDataFrame(list(items.items()), "chunk_id string, text string"))

    @staticmethod
    def from_chunks(chunks: DataFrame, order: Iterable[str] = ("doc_id", "seq")) -> ChunkIndex:
        """The first text of each id in the given order."""
        first = chunks.groupBy("chunk_id").agg(F.min(F.struct(*order, "text")).alias("r"))
        return ChunkIndex(first.select("chunk_id", F.col("r.text").alias("text")))

    def count(self) -> int:
        return self.df.count()

    def is_empty(self) -> bool:
        return self.df.isEmpty()

    def chunk_ids(self) -> DataFrame:
        return self.df.select("chunk_id")

    def get(self, chunk_id: str) -> str | None:
        row = self.df.where(F.col("chunk_id") == chunk_id).select("text").first()
        return row[0] if row else None

    def preview(self, chunk_id: str, most: int = PREVIEW_CHARS) -> str | None:
        row = self.df.where(F.col("chunk_id") == chunk_id).select(preview(F.col("text"), most)).first()
        return row[0] if row else None

    def add(self, chunk_id: str, text: str) -> ChunkIndex:
        return self.merge(ChunkIndex.from_dict(self.df.sparkSession, {chunk_id: text}))

    def remove(self, chunk_id: str) -> ChunkIndex:
        return ChunkIndex(self.df.where(F.col("chunk_id") != chunk_id))

    def merge(self, other: ChunkIndex) -> ChunkIndex:
        """The other's texts win."""
        return ChunkIndex(self.df.join(other.df, "chunk_id", "left_anti").unionByName(other.df))
