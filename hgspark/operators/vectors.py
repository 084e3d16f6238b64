"""Vector arithmetic on array<float> columns, in double precision, and similarity search.

Column expressions for one pair of vectors; matrix blocks in Arrow batches where every vector meets every other.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

BLOCK_ROWS = 1024
#: Blocks that one task may hold of either side.
BAND_BLOCKS = 32
#: Similarities that a task has in memory at once, and rows of a batch that leaves it.
TILE, BATCH_ROWS = 1 << 20, 1 << 16


def _sum(column: Column) -> Column:
    return F.aggregate(column, F.lit(0.0), lambda total, x: total + x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))


def cosine_strict(a: Column, b: Column) -> Column:
    """0 for empty vectors and those of length zero; unequal dimensions are an error."""
    value = F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))
    return F.when(F.size(a) == F.size(b), value).otherwise(F.raise_error(F.lit("vectors differ in dimension")).cast("double"))


def cosine(a: Column, b: Column) -> Column:
    """Null where dimensions differ, or a vector is empty or of length zero."""
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), F.try_divide(dot(a, b), norm(a) * norm(b)))


def l2_distance(a: Column, b: Column) -> Column:
    """Euclidean; unequal dimensions are an error."""
    value = F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))
    return F.when(F.size(a) == F.size(b), value).otherwise(F.raise_error(F.lit("vectors differ in dimension")).cast("double"))


def normalize(v: Column) -> Column:
    """The unit vector; one of length zero is left as it is."""
    return F.transform(v, lambda x: F.coalesce(F.try_divide(x.cast("double"), norm(v)), x.cast("double")))


def _literal(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector]).cast("array<double>")


def find_similar(embeddings: DataFrame, vector: list[float], k: int = 10, threshold: float = 0.0) -> DataFrame:
    """(node, similarity): the k most similar nodes at or above the threshold, ties by name."""
    scored = embeddings.select("node", cosine(F.col("embedding"), _literal(vector)).alias("similarity"))
    return scored.where(F.col("similarity") >= threshold).orderBy(F.desc("similarity"), "node").limit(k)


def find_similar_to_node(embeddings: DataFrame, node, k: int = 10, threshold: float = 0.0) -> DataFrame:
    """The same for a node's own vector, without the node; nothing if it has none."""
    found = embeddings.where(F.col("node") == node).select("embedding").first()
    others = embeddings.where(F.col("node") != node)
    if found is None:
        return others.select("node", F.lit(0.0).alias("similarity")).limit(0)
    return find_similar(others, found[0], k, threshold)


def top_k_similar(embeddings: DataFrame, vector: list[float], k: int) -> DataFrame:
    """The k most similar without a threshold; undefined similarity counts as 0."""
    scored = embeddings.select("node", F.coalesce(cosine(F.col("embedding"), _literal(vector)), F.lit(0.0)).alias("similarity"))
    return scored.orderBy(F.desc("similarity"), "node").limit(k)


def _blocks(frame: DataFrame, name: str) -> DataFrame:
    """Rows gathered into blocks of at most BLOCK_ROWS: (block, names, numbers as little-endian doubles, dimension)."""
    kind = frame.schema[name].dataType

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_size: dict[int, tuple[list, list]] = {}
            for n, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if n is None or not v or any(x is None for x in v):
                    continue
                held = by_size.setdefault(len(v), ([], []))
                held[0].append(n)
                held[1].append(v)
            for size, (names, rows) in by_size.items():
                for k in range(0, len(names), BLOCK_ROWS):
                    part = np.array(rows[k : k + BLOCK_ROWS], dtype="<f8").reshape(-1, size)
                    yield pa.RecordBatch.from_arrays([pa.array([names[k : k + BLOCK_ROWS]], type=pa.list_(batch.schema.field(0).type)), pa.array([part.tobytes()], pa.binary()), pa.array([size], pa.int32())], names=["names", "numbers", "dimension"])

    schema = T.StructType([T.StructField("names", T.ArrayType(kind)), T.StructField("numbers", T.BinaryType()), T.StructField("dimension", T.IntegerType())])
    return frame.select(name, "embedding").mapInArrow(gather, schema)


def _grid(embeddings: DataFrame) -> DataFrame:
    """Blocks placed in cells (row, column) so that every two meet once: as side 0 and 1 of the cell of their bands."""
    from ..tables import cut

    blocks = cut(_blocks(embeddings, "node").select("*", F.monotonically_increasing_id().alias("block")))
    # A grid of about as many cells as blocks, or more so that a band has few enough for a task's memory: each block goes
    # to one row and one column of it, and no task sees all of them.
    n = blocks.count()
    grid = max(1, math.isqrt(n), -(-n // BAND_BLOCKS))
    placed = blocks.select("*", F.pmod(F.hash("block"), F.lit(grid)).alias("band"))
    a = placed.select(*placed.columns, F.lit(0).alias("side"), F.col("band").alias("row"), F.explode(F.sequence(F.col("band"), F.lit(grid - 1))).alias("column"))
    b = placed.select(*placed.columns, F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), F.col("band"))).alias("row"), F.col("band").alias("column"))
    return a.unionByName(b)


def _cosines(x: np.ndarray, y: np.ndarray, long_x: np.ndarray, long_y: np.ndarray, undefined: float) -> np.ndarray:
    """Similarities of all rows of x with all of y, which have these lengths."""
    sim, lengths = x @ y.T, np.outer(long_x, long_y)
    with np.errstate(invalid="ignore", divide="ignore"):
        np.divide(sim, lengths, out=sim)
    if not (long_x.min(initial=1) * long_y.min(initial=1) > 0):  # NaN too
        sim[~(lengths > 0)] = undefined
    return sim


def _meetings(batches: Iterator[pa.RecordBatch], undefined: float) -> Iterator[tuple]:
    """(block, names, block, names, first row, similarities) of a cell's blocks, at most TILE or one row of them at once."""
    sides: list[list] = [[], []]
    for cell in batches:
        names, numbers = cell.column("names"), cell.column("numbers")
        for k, (size, block, band, side) in enumerate(zip(*(cell.column(c).to_pylist() for c in ("dimension", "block", "band", "side")), strict=True)):
            own = names[k].values
            x = np.frombuffer(numbers[k].as_buffer(), dtype="<f8").reshape(len(own), size)
            sides[side].append((own, x, np.linalg.norm(x, axis=1), size, block, band))
    for names_a, x, long_a, size_a, block_a, band_a in sides[0]:
        for names_b, y, long_b, size_b, block_b, band_b in sides[1]:
            if not size_a or size_a != size_b or band_a == band_b and block_a > block_b:
                continue
            rows = max(1, TILE // len(names_b))
            for start in range(0, len(names_a), rows):
                yield block_a, names_a, block_b, names_b, start, _cosines(x[start : start + rows], y, long_a[start : start + rows], long_b, undefined)


def _batches(columns: dict[str, pa.Array]) -> Iterator[pa.RecordBatch]:
    whole = pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
    for start in range(0, len(whole), BATCH_ROWS):
        yield whole.slice(start, BATCH_ROWS)


def _arrow_type(embeddings: DataFrame, kind: T.DataType) -> pa.DataType:
    return embeddings.sparkSession.createDataFrame([], T.StructType([T.StructField("i", kind)])).toArrow().schema.field(0).type


def similar_pairs(embeddings: DataFrame, threshold: float, *, strict: bool = True, zero_undefined: bool = True) -> DataFrame:
    """(i, j, similarity), i < j: all pairs above the threshold (`strict`) or at least at it.

    Vectors are gathered into blocks, every two blocks of one dimension meet once as a matrix product, a tile at a time,
    and only pairs that pass leave the task, a batch at a time.
    Vectors of length zero are similar to nothing (their similarity counts as 0 with `zero_undefined`, which matters
    for thresholds below 0); vectors of different dimension aren't compared.
    """
    kind = embeddings.schema["node"].dataType
    own = _arrow_type(embeddings, kind)

    def multiply(cell: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block_a, names_a, block_b, names_b, start, sim in _meetings(cell, 0.0 if zero_undefined else np.nan):
            passed = sim > threshold if strict else sim >= threshold
            if block_a == block_b:
                passed = np.triu(passed, 1 + start)
            i, j = np.nonzero(passed)
            if len(i):
                p, q = names_a.take(pa.array(i + start)).cast(own), names_b.take(pa.array(j)).cast(own)
                turned = pc.greater(p, q)
                yield from _batches({"i": pc.if_else(turned, q, p), "j": pc.if_else(turned, p, q), "similarity": pa.array(sim[i, j])})

    schema = T.StructType([T.StructField("i", kind), T.StructField("j", kind), T.StructField("similarity", T.DoubleType())])
    return _grid(embeddings).groupBy("row", "column").applyInArrow(multiply, schema).where("i <> j")


def _own_similarity(embeddings: DataFrame) -> DataFrame:
    return embeddings.select(F.col("node").alias("i"), F.col("node").alias("j"), F.when(norm(F.col("embedding")) > 0, 1.0).otherwise(0.0).alias("similarity"))


def similarity_matrix(embeddings: DataFrame) -> DataFrame:
    """(i, j, similarity) for all ordered pairs, the diagonal too: 0 where a vector has length zero. Quadratic by nature;
    `similarity_totals` has its rows' sums without it."""
    half = similar_pairs(embeddings, -2.0)
    both = half.select(F.inline(F.array(F.struct("i", "j", "similarity"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), "similarity"))))
    return both.unionByName(_own_similarity(embeddings))


def similarity_totals(embeddings: DataFrame) -> DataFrame:
    """(i, n, total): the number and the sum of each row of similarity_matrix. Every two vectors meet, but only a row for
    each vector leaves a cell."""
    kind = embeddings.schema["node"].dataType
    own = _arrow_type(embeddings, kind)

    def add(cell: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[pa.Array, list[int], np.ndarray]] = {}
        for block_a, names_a, block_b, names_b, start, sim in _meetings(cell, 0.0):
            a = held.setdefault(block_a, (names_a, np.zeros(len(names_a), np.int64), np.zeros(len(names_a))))
            a[1][start : start + len(sim)] += sim.shape[1]
            a[2][start : start + len(sim)] += sim.sum(axis=1)
            if block_a != block_b:
                b = held.setdefault(block_b, (names_b, np.zeros(len(names_b), np.int64), np.zeros(len(names_b))))
                b[1][:] += len(sim)
                b[2][:] += sim.sum(axis=0)
        for names, n, total in held.values():
            yield from _batches({"i": names.cast(own), "n": pa.array(n), "total": pa.array(total)})

    schema = T.StructType([T.StructField("i", kind), T.StructField("n", T.LongType()), T.StructField("total", T.DoubleType())])
    sums = _grid(embeddings).groupBy("row", "column").applyInArrow(add, schema)
    # rows that meet no other have the diagonal alone
    alone = F.col("node").isNull() | F.col("embedding").isNull() | (F.size("embedding") == 0) | F.exists("embedding", lambda x: x.isNull())
    rest = _own_similarity(embeddings.where(alone)).select("i", F.lit(1).cast("long").alias("n"), F.col("similarity").alias("total"))
    return sums.unionByName(rest).groupBy("i").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def _best(asked: pa.Array, q: np.ndarray, names: pa.Array, x: np.ndarray, k: int, threshold: float) -> Iterator[tuple[pa.Array, pa.Array, pa.Array]]:
    """(queries, nodes, similarities): each query's k most similar of these nodes at or above the threshold, ties by name;
    as many queries at once as TILE similarities are of."""
    turn = np.empty(len(names), dtype=np.int64)
    turn[pc.sort_indices(names, null_placement="at_start").to_numpy()] = np.arange(len(names))
    long, rows = np.linalg.norm(x, axis=1), max(1, TILE // max(1, len(names)))
    for start in range(0, len(asked), rows):
        part = q[start : start + rows]
        sim = _cosines(part, x, np.linalg.norm(part, axis=1), long, np.nan)
        passed = sim >= threshold
        if len(names) > k and np.count_nonzero(passed) > sim.size // 16:  # too many to sort; with all that tie with the last
            ranked = np.where(passed, sim, -np.inf)
            passed &= ranked >= np.partition(ranked, -k, axis=1)[:, -k][:, None]
        r, c = np.nonzero(passed)
        order = np.lexsort((turn[c], -sim[r, c], r))
        r, c = r[order], c[order]
        r_starts = np.searchsorted(r, r)
        kept = np.arange(len(r)) - r_starts < k
        r, c = r[kept], c[kept]
        if len(r):
            yield asked.take(pa.array(start + r)), names.take(pa.array(c)), pa.array(sim[r, c])


def _best_in_cells(queries: DataFrame, embeddings: DataFrame, k: int, threshold: float, schema: T.StructType) -> DataFrame:
    """Each query's k best of every cell of a grid of blocks of queries and blocks of nodes."""
    from ..tables import cut

    def placed(frame: DataFrame, name: str, vector: str) -> tuple[DataFrame, int]:
        # a name in a struct may be null
        blocks = cut(_blocks(frame.where(F.size(vector) > 0).select(F.struct(F.col(name).alias("name")).alias("name"), F.col(vector).alias("embedding")), "name").select("*", F.monotonically_increasing_id().alias("block")))
        n = blocks.count()
        bands = max(1, math.isqrt(n), -(-n // BAND_BLOCKS))
        return blocks.select("numbers", "dimension", "names", F.pmod(F.hash("block"), F.lit(bands)).alias("band")), bands

    a, rows = placed(queries, "query", "vector")
    b, columns = placed(embeddings, "node", "embedding")
    none_a, none_b = F.lit(None).cast(a.schema["names"].dataType), F.lit(None).cast(b.schema["names"].dataType)
    a = a.select(F.col("names").alias("asked"), none_b.alias("names"), "numbers", "dimension", F.col("band").alias("row"), F.explode(F.sequence(F.lit(0), F.lit(columns - 1))).alias("column"))
    b = b.select(none_a.alias("asked"), "names", "numbers", "dimension", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("row"), F.col("band").alias("column"))
    kinds = [f.type for f in queries.sparkSession.createDataFrame([], schema).toArrow().schema]

    def multiply(cell: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides: list[list] = [[], []]
        for batch in cell:
            numbers = batch.column("numbers")
            for k_row, size in enumerate(batch.column("dimension").to_pylist()):
                side = int(batch.column("names")[k_row].is_valid)
                own = batch.column("names" if side else "asked")[k_row].values.field("name")
                sides[side].append((own, np.frombuffer(numbers[k_row].as_buffer(), dtype="<f8").reshape(len(own), size), size))
        for size in {size for *_, size in sides[1]}:
            names, x = zip(*[(n, v) for n, v, other in sides[1] if other == size], strict=True)
            names, x = pa.concat_arrays(names), np.concatenate(x)
            for asked, q, other in sides[0]:
                if size == other:
                    for found in _best(asked, q, names, x, k, threshold):
                        yield from _batches({n: v.cast(t) for n, v, t in zip(schema.names, found, kinds, strict=True)})

    return a.unionByName(b).groupBy("row", "column").applyInArrow(multiply, schema)


def top_k_batch(queries: DataFrame, embeddings: DataFrame, k: int, threshold: float) -> DataFrame:
    """(query, node, similarity) for rows (query, vector): each query's k most similar nodes at or above the threshold.

    Up to BLOCK_ROWS queries are collected into a matrix, past which the embeddings stream; more meet the embeddings
    block by block, as in similar_pairs, so that their number has no bound. Each batch or cell keeps its own best k of
    a query, and a window takes the best of those.
    """
    kind, name = queries.schema["query"].dataType, embeddings.schema["node"].dataType
    schema = T.StructType([T.StructField("query", kind), T.StructField("node", name), T.StructField("similarity", T.DoubleType())])
    spark = queries.sparkSession
    turn = Window.partitionBy("query").orderBy(F.desc("similarity"), "node")
    held = queries.select("query", "vector").limit(BLOCK_ROWS + 1).collect()
    rows = [(r[0], r[1]) for r in held if r[1]]
    if k < 1 or not rows and len(held) <= BLOCK_ROWS:
        return spark.createDataFrame([], schema)
    if len(held) > BLOCK_ROWS:
        found = _best_in_cells(queries, embeddings, k, threshold, schema)
        return found.select("*", F.row_number().over(turn).alias("__k")).where(F.col("__k") <= k).drop("__k")
    by_size: dict[int, tuple[list, list]] = {}
    for q, v in rows:
        held = by_size.setdefault(len(v), ([], []))
        held[0].append(q)
        held[1].append(v)
    query_type = spark.createDataFrame([], T.StructType([schema[0]])).toArrow().schema.field(0).type
    shared = spark.sparkContext.broadcast({s: (pa.array(q, query_type), np.array(v, dtype=np.float64)) for s, (q, v) in by_size.items()})

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[int, tuple[list, list]] = {}
            for n, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if v and len(v) in shared.value:
                    names, vectors = held.setdefault(len(v), ([], []))
                    names.append(n)
                    vectors.append(v)
            for size, (names, vectors) in held.items():
                asked, q = shared.value[size]
                x = np.array(vectors, dtype=np.float64)
                for found in _best(asked, q, pa.array(names, batch.schema.field(0).type), x, k, threshold):
                    yield from _batches(dict(zip(schema.names, found, strict=True)))

    found = embeddings.select("node", "embedding").mapInArrow(best, schema)
    return found.select("*", F.row_number().over(turn).alias("__k")).where(F.col("__k") <= k).drop("__k")
