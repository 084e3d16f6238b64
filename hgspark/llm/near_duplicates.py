"""Near duplicates by a chosen-path set similarity join over MinHash vectors.

A text's tokens are its runs of SHINGLE words; its MinHash vector has SIZE coordinates. Two texts are near when their
vectors agree in a share of at least `threshold` of the coordinates (an estimate of the Jaccard similarity of their
tokens; a coordinate is compared by one byte and the share is corrected for bytes that agree by chance).

Each of TREES independent trees starts with all texts at its root. A node chooses coordinates at random, `fan` of them on
average, by a hash of its own path; for each chosen coordinate a text goes on to the child named by its value there. A
near pair shares fan * similarity children on average. With 1 / threshold coordinates that would be 1 at the threshold,
and the chance to stay together in some branch would fall towards 0 with depth; `fan` is larger by as much as it takes
for the chance not to fall below RECALL in all trees together, however deep they are, while others part. The first LEVELS levels need no knowledge of other
texts and are expanded where the vectors are read. Then nodes are counted; those above NODE_ROWS are split by further
levels in the same way, up to MOST_LEVELS; what is still above then is compared in blocks of NODE_ROWS, two of which are a
task. Other nodes end in a task that goes on recursively: up to LEAF texts are compared exhaustively, larger nodes branch.
Equal vectors are put together before, so copies are one text here.

Texts that stay similar to most of their node (copies of a template) can't be parted by branching. They are settled by
pivots: a pivot is compared with the whole node, and what is near is linked to it. Disagreements are a metric, so a text
within r of the pivot can only be near to texts within `most + r` of it (`most`: the disagreements of a pair at the
threshold); it leaves the node once it is compared with those of them that aren't linked to the pivot yet. The same is done
with PIVOTS pivots for nodes above NODE_ROWS in Spark, where texts leave if there is nothing to compare them with. What
leaves has lost no link to its node, and a node of copies takes time in proportion to its size.

The trees find RECALL of the pairs at the threshold at any depth, so more at those that nodes reach, and more above it;
that holds on both sides of NODE_ROWS.

A task returns links that connect the near texts of its nodes (a spanning forest). Groups are the connected components of
all links, by label propagation that alternates with pointer jumping; each round is cut by a checkpoint. The row with the
smallest id of a group stays.

Defined results: null, empty and wordless texts have no tokens and are never in a group; a text of fewer words than a
shingle is one token, one of any length is read whole; rows with a null id are never removed or kept for others; an id is
taken to name one text, so rows that share it go or stay together, and drop_near_duplicates leaves one row of those with
equal id (not null) and text; ties can't arise, as a group keeps its smallest id; an empty table gives no groups; columns
besides the two that are read don't matter, whatever their names, and drop_near_duplicates keeps them all.
"""

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import sized
from .common import WordHashes, cut, mix64, slices, words_of

SHINGLE = 3
SIZE = 128
THRESHOLD = 0.6
TREES = 4
RECALL = 0.95
LEVELS = 2
MOST_LEVELS = 8
LEAF = 200
NODE_ROWS = 20_000
PIVOTS = 8
#: Nodes (each with its pivots, about 1 kB) up to which pivots are broadcast.
PIVOT_NODES = 10_000
SEED = 13
_PRIMES = np.random.default_rng(SEED).integers(1, 1 << 31, SIZE, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFTS = np.random.default_rng(SEED + 1).integers(0, 1 << 32, SIZE, dtype=np.uint32)


def _runs(texts: list[str | None], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes of all texts one after the other, the texts that have any and where theirs begin."""
    split = [words_of(t) if t else [] for t in texts]
    sizes = np.array([len(s) for s in split], dtype=np.int64)
    words = mix64(hashes.of([w for s in split for w in s]))
    some = np.flatnonzero(sizes)
    starts = (np.cumsum(sizes) - sizes)[some]
    token = words.copy()
    left = np.repeat(sizes[some], sizes[some]) - (np.arange(len(words)) - np.repeat(starts, sizes[some]))  # words to the end of the text
    for k in range(1, SHINGLE):
        follow = np.zeros_like(words)
        follow[:-k] = words[k:]
        token = np.where(left > k, mix64(token ^ (follow + np.uint64(k))), token)
    # a start within the last words of a longer text isn't a whole run
    whole = (left >= SHINGLE) | (np.repeat(sizes[some] < SHINGLE, sizes[some]) & (left == np.repeat(sizes[some], sizes[some])))
    kept = np.flatnonzero(whole)
    count = np.add.reduceat(whole.astype(np.int64), starts) if len(starts) else np.empty(0, np.int64)
    return token[kept], some, np.cumsum(count) - count


def minhash(texts: list[str | None], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Texts that have tokens, and their vectors."""
    token, some, starts = _runs(texts, hashes)
    out = np.empty((len(some), SIZE), dtype=np.uint32)
    if len(some):
        short = (token >> np.uint64(32)).astype(np.uint32)
        for j in range(SIZE):
            out[:, j] = np.minimum.reduceat(short * _PRIMES[j] + _SHIFTS[j], starts)
    return some, out


def vectors(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, vector, sketch): a hash that equal vectors share, and one byte of each coordinate."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes(SEED)
        for batch in batches:
            for a, n in slices(batch.column(1)):
                some, found = minhash(batch.column(1).slice(a, n).to_pylist(), hashes)
                if not len(some):
                    continue
                whole = np.zeros(len(some), dtype=np.uint64)
                for j in range(SIZE):
                    whole = mix64(whole ^ found[:, j].astype(np.uint64) + np.uint64(j))
                short = (mix64(found.astype(np.uint64)) & np.uint64(255)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, n).take(pa.array(some)), pa.array(whole.view(np.int64)), pa.array([r.tobytes() for r in short], pa.binary())], names=["id", "vector", "sketch"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.where(F.col(id_col).isNotNull()).select(id_col, text_col).mapInArrow(sketch, f"id {kind}, vector long, sketch binary")


@lru_cache
def fan(threshold: float, trees: int) -> float:
    """The least mean number of coordinates a node has to choose for a pair at the threshold to stay together in any of
    the trees with probability RECALL at every depth: the chance in one tree has a fixed point there."""
    one = 1 - (1 - RECALL) ** (1 / trees)
    low, high = 1.0, float(SIZE)
    for _ in range(60):
        middle = (low + high) / 2
        least, rest = divmod(middle, 1)
        kept = 1 - (1 - threshold * one) ** least * (1 - rest * threshold * one)
        low, high = (low, middle) if kept >= one else (middle, high)
    return high


def children(nodes: np.ndarray, sketches: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, child node) for rows that stand at nodes: each node chooses the whole part of 1 / share coordinates and one
    more with the rest's probability, without repetition."""
    rows, out = [], []
    draw = mix64(nodes ^ np.uint64(0x5851F42D4C957F2D))
    least, rest = divmod(1 / share, 1)
    most = min(SIZE, int(least) + 1)
    chosen = np.where((draw >> np.uint64(40)).astype(np.float64) / (1 << 24) < rest, most, int(least))
    place = draw
    taken: list[np.ndarray] = []
    for k in range(most):
        at = (place % np.uint64(SIZE - k)).astype(np.int64)
        for earlier in sorted_columns(taken):  # skip coordinates that are taken
            at = at + (at >= earlier)
        taken.append(at)
        go = np.flatnonzero(chosen > k)
        value = sketches[go, at[go]].astype(np.uint64)
        rows.append(go)
        out.append(mix64(mix64(nodes[go] + np.uint64(k + 1)) ^ (at[go].astype(np.uint64) << np.uint64(8)) ^ value))
        place = mix64(place + np.uint64(k + 1))
    return np.concatenate(rows), np.concatenate(out)


def sorted_columns(columns: list[np.ndarray]) -> list[np.ndarray]:
    return list(np.sort(np.stack(columns), axis=0)) if columns else []


def _level(frame: DataFrame, share: float, levels: int) -> DataFrame:
    """(node, vector, sketch) rows moved down by some levels."""

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            sketch = _matrix(batch.column(2))
            row = np.arange(len(node))
            for _ in range(levels):
                step, node = children(node, sketch[row], share)
                row = row[step]
            if len(row):
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), batch.column(1).take(take), batch.column(2).take(take)], names=["node", "vector", "sketch"])

    return frame.mapInArrow(move, "node long, vector long, sketch binary")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), SIZE)


class _Forest:
    """Links between numbers that aren't connected yet."""

    def __init__(self, n: int):
        self.root = list(range(n))
        self.links: list[tuple[int, int]] = []

    def top(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            x, y = self.top(i), self.top(j)
            if x != y:
                self.root[x] = y
                self.links.append((i, j))


def _near(one: np.ndarray, many: np.ndarray, threshold: float) -> np.ndarray:
    """Which of `many` agree with `one` (or each with its own row of it) in the threshold's share."""
    agree = (one == many).sum(axis=-1)
    return agree >= _needed(threshold)


def _needed(threshold: float) -> int:
    return int(np.ceil(SIZE * (threshold + (1 - threshold) / 256) - 1e-9))


def _settle(here: np.ndarray, heavy: np.ndarray, threshold: float, forest: _Forest, numbers: np.ndarray) -> np.ndarray:
    """Takes heavy texts, and others around them, out of a node: the places of those that are left. No link is lost. A
    pivot's radius is the one that costs the fewest comparisons for each text that goes."""
    most, alive = SIZE - _needed(threshold), np.ones(len(here), dtype=bool)
    for k in heavy.tolist():
        if not alive[k]:
            continue
        at = np.flatnonzero(alive)
        rows = here[at]
        apart = (rows != here[k]).sum(axis=1)
        near = at[apart <= most]
        forest.join(np.full(len(near), numbers[k]), numbers[near])
        within = np.bincount(apart, minlength=2 * SIZE + 1).cumsum()
        radius = min((0, most // 8, most // 4, most // 2, most * 3 // 4, most), key=lambda r: len(at) / within[r] + within[most + r] - within[most])
        inner = np.flatnonzero(apart <= radius)
        shell = np.flatnonzero((apart > most) & (apart <= most + radius))
        if len(shell):
            own = forest.top(int(numbers[k]))
            shell = shell[[forest.top(i) != own for i in numbers[at[shell]].tolist()]]
        if len(shell) < len(inner):
            for z in shell.tolist():
                found = np.flatnonzero(_near(rows[z], rows[inner], threshold))
                if len(found):
                    forest.join(numbers[at[[z]]], numbers[at[inner[found[:1]]]])
        else:
            for y in inner.tolist():
                if not len(shell):
                    break
                hit = _near(rows[y], rows[shell], threshold)
                forest.join(np.full(int(hit.sum()), numbers[at[y]]), numbers[at[shell[hit]]])
                shell = shell[~hit]  # linked to all of `inner` by now
        alive[at[inner]] = False
    return np.flatnonzero(alive)


def join_node(sketches: np.ndarray, threshold: float, forest: _Forest, numbers: np.ndarray, node: int, trees: int = TREES, depth: int = 0) -> None:
    """Links the near texts of a node; `numbers` are the rows of `sketches` that stand in it."""
    n = len(numbers)
    if n < 2:
        return
    if n <= LEAF or depth >= 40:
        for k in range(n - 1):
            rest = numbers[k + 1 :]
            near = rest[_near(sketches[numbers[k]], sketches[rest], threshold)]
            if len(near):
                forest.join(np.full(len(near), numbers[k]), near)
        return
    # Average agreement of each text with the node, from counts of values by coordinate.
    here = sketches[numbers]
    total = np.zeros(n)
    for j in range(SIZE):
        total += np.bincount(here[:, j], minlength=256)[here[:, j]] - 1
    left = _settle(here, np.flatnonzero(total / (n - 1) / SIZE >= 0.9 * threshold), threshold, forest, numbers)
    light = numbers[left]
    if len(light) < 2 or len({forest.top(i) for i in light.tolist()}) == 1:
        return
    row, child = children(np.full(len(light), node, dtype=np.uint64), sketches[light], 1 / fan(threshold, trees))
    order = np.argsort(child, kind="stable")
    row, child = row[order], child[order]
    cuts = np.flatnonzero(child[1:] != child[:-1]) + 1
    for part, name in zip(np.split(row, cuts), child[np.concatenate([[0], cuts])] if len(child) else [], strict=False):
        if len(part) > 1:
            join_node(sketches, threshold, forest, light[part], int(name), trees, depth + 1)


def _leaves(threshold: float, trees: int):
    """Links of rows (node, vector, sketch) that come sorted by node."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_node, held_vector, held_sketch = np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, SIZE), np.uint8)

        def links(node: np.ndarray, vector: np.ndarray, sketch: np.ndarray) -> pa.RecordBatch:
            left, right = [], []
            heads = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])) if len(node) else np.empty(0, np.int64)
            sizes = np.diff(np.append(heads, len(node)))
            for span in range(1, 5):  # small nodes all at once: each row with the one `span` further
                at = np.concatenate([heads[(sizes > span) & (sizes <= 5)] + k for k in range(4)])
                at = at[(at + span < len(node))]
                at = at[node[at] == node[at + span]]
                if len(at):
                    at = at[_near(sketch[at], sketch[at + span], threshold)]
                    left.append(vector[at])
                    right.append(vector[at + span])
            for k in np.flatnonzero(sizes > 5):
                own = slice(heads[k], heads[k] + sizes[k])
                forest = _Forest(int(sizes[k]))
                join_node(sketch[own], threshold, forest, np.arange(sizes[k]), int(node[heads[k]]) & 0xFFFFFFFFFFFFFFFF, trees)
                if forest.links:
                    pairs = np.array(forest.links)
                    left.append(vector[own][pairs[:, 0]])
                    right.append(vector[own][pairs[:, 1]])
            a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (left, right))
            pairs = np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1)
            pairs = np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        for batch in batches:
            held_node = np.concatenate([held_node, batch.column(0).to_numpy(zero_copy_only=False)])
            held_vector = np.concatenate([held_vector, batch.column(1).to_numpy(zero_copy_only=False)])
            held_sketch = np.concatenate([held_sketch, _matrix(batch.column(2))])
            done = int(np.searchsorted(held_node, held_node[-1], "left")) if len(held_node) else 0
            if done:
                yield links(held_node[:done], held_vector[:done], held_sketch[:done])
                held_node, held_vector, held_sketch = held_node[done:], held_vector[done:], held_sketch[done:]
        yield links(held_node, held_vector, held_sketch)

    return compare


def _pivot_rows(nodes: DataFrame) -> DataFrame:
    """(node, pivots): up to PIVOTS texts of each node, the one of the smallest hash in each of PIVOTS parts of it."""
    picked = nodes.groupBy("node", F.pmod(F.xxhash64("vector"), F.lit(PIVOTS)).alias("part")).agg(F.min("vector").alias("vector")).select("node", "vector")
    held = nodes.join(sized(cut(picked), PIVOTS * PIVOT_NODES), ["node", "vector"], "left_semi").groupBy("node", "vector").agg(F.first("sketch").alias("sketch"))
    return cut(held.groupBy("node").agg(F.collect_list(F.struct("vector", "sketch")).alias("pivots")))


def _settled(nodes: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Links of large nodes' texts to pivots, and the rows (node, vector, sketch) that have to go on."""
    most = SIZE - _needed(threshold)
    radius = most // 2

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            node, sketch = batch.column(0).to_numpy(zero_copy_only=False), _matrix(batch.column(2))
            names, first, own = np.unique(node, return_index=True, return_inverse=True)
            apart = np.full((len(node), PIVOTS), 2 * SIZE, dtype=np.int16)
            vector = np.zeros((len(node), PIVOTS), dtype=np.int64)
            for k, pivots in enumerate(batch.column(3).take(pa.array(first)).to_pylist()):
                at = np.flatnonzero(own == k)
                for j, p in enumerate(sorted(pivots, key=lambda p: p["vector"])):
                    apart[at, j] = (sketch[at] != np.frombuffer(p["sketch"], np.uint8)).sum(axis=1)
                    vector[at, j] = p["vector"]
            columns = [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), PIVOTS).cast(pa.list_(t)) for x, t in ((apart, pa.int16()), (vector, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *columns], names=["node", "vector", "sketch", "apart", "pivot"])

    together = nodes.join(sized(_pivot_rows(nodes), PIVOT_NODES), "node").select("node", "vector", "sketch", "pivots")
    table = cut(together.mapInArrow(measure, "node long, vector long, sketch binary, apart array<short>, pivot array<long>"))
    each = table.select("vector", F.explode(F.arrays_zip("apart", "pivot")).alias("p")).where((F.col("p.apart") <= most) & (F.col("vector") != F.col("p.pivot")))
    links = each.select(F.least("vector", "p.pivot").alias("a"), F.greatest("vector", "p.pivot").alias("b"))
    between = [(F.col("apart")[j] > most) & (F.col("apart")[j] <= most + radius) for j in range(PIVOTS)]
    shells = cut(table.groupBy("node").agg(F.array(*[F.max(x) for x in between]).alias("shell")))
    away = F.lit(False)
    for j in range(PIVOTS):
        away = away | ((F.col("apart")[j] <= radius) & ~F.col("shell")[j])
    rest = table.join(sized(shells, PIVOTS * PIVOT_NODES), "node").where(~away).select("node", "vector", "sketch")
    return links, rest


def _blocks(nodes: DataFrame, node_rows: int) -> DataFrame:
    """Nodes cut into blocks of about `node_rows`; every two blocks of a node are a node of their own."""
    sizes = cut(nodes.groupBy("node").agg(F.ceil(F.count("*") / F.lit(node_rows)).cast("int").alias("n")))
    own = nodes.join(sized(sizes, PIVOTS * PIVOT_NODES), "node").withColumn("c", F.pmod(F.xxhash64("vector"), F.col("n")).cast("int"))
    others = F.explode(F.when(F.col("n") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda k: k != F.col("c"))))
    pairs = own.select("node", "vector", "sketch", "c", others.alias("d"))
    return pairs.select(F.xxhash64("node", F.least("c", "d"), F.greatest("c", "d")).alias("node"), "vector", "sketch")


def near_links(distinct: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, levels: int = LEVELS, node_rows: int = NODE_ROWS, most_levels: int = MOST_LEVELS) -> DataFrame:
    """(a, b): links between near vectors, from rows (vector, sketch) of distinct vectors."""
    share = 1 / fan(threshold, trees)
    roots = F.explode(F.array(*[F.lit(int(mix64(np.array([SEED + t], dtype=np.uint64)).view(np.int64)[0])) for t in range(trees)]))
    nodes = _level(distinct.select(roots.alias("node"), "vector", "sketch"), share, levels)
    compare, found, level = _leaves(threshold, trees), [], levels

    def ended(rows: DataFrame) -> None:
        found.append(rows.repartition("node").sortWithinPartitions("node").mapInArrow(compare, "a long, b long"))

    while True:
        large = cut(nodes.groupBy("node").count().where(F.col("count") > node_rows).select("node"))
        if large.isEmpty():
            ended(nodes)
            break
        ended(nodes.join(large, "node", "left_anti"))
        links, rest = _settled(nodes.join(large, "node", "left_semi").select("node", "vector", "sketch"), threshold)
        found.append(links)
        if level >= most_levels:
            ended(_blocks(rest, node_rows))
            break
        nodes, level = cut(_level(rest, share, 1)), level + 1
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    return links.distinct()


def connected(links: DataFrame) -> DataFrame:
    """(vertex, root): the smallest vertex of its component for every vertex of the links (a, b)."""
    both = cut(links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v"))))
    labels = cut(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("root")).withColumnRenamed("u", "vertex"))
    while True:
        heard = both.join(labels, both.v == labels.vertex).groupBy("u").agg(F.min("root").alias("heard"))
        lower = labels.join(heard, labels.vertex == heard.u, "left").select("vertex", "root", F.least("root", F.coalesce("heard", "root")).alias("next"))
        # pointer jump: a root's own label is at most as large
        own = labels.select(F.col("vertex").alias("__r"), F.col("root").alias("__rr"))
        jumped = cut(lower.join(own, lower.next == own["__r"], "left").select("vertex", F.least("next", F.coalesce("__rr", "next")).alias("root"), F.col("root").alias("__old")))
        labels = jumped.select("vertex", "root")
        if jumped.where("root <> __old").isEmpty():
            return labels


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, trees: int = TREES, levels: int = LEVELS, node_rows: int = NODE_ROWS) -> DataFrame:
    """(id, kept_<id>, group_size) for every row that isn't the one kept of its group; group_size counts distinct ids."""
    table = cut(vectors(docs, id_col, text_col))
    distinct = table.groupBy("vector").agg(F.first("sketch").alias("sketch"))
    labels = connected(near_links(distinct, threshold, trees, levels, node_rows))
    members = table.select("id", "vector").join(labels, table.vector == labels.vertex, "left").select("id", F.coalesce("root", "vector").alias("root")).distinct()
    groups = members.groupBy("root").agg(F.min("id").alias("kept"), F.count("*").alias("group_size")).where("group_size > 1")
    return members.join(groups, "root").where("id <> kept").groupBy(F.col("id").alias(id_col)).agg(F.min("kept").alias(f"kept_{id_col}"), F.max("group_size").alias("group_size"))


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows that stay, all columns kept: of each group those with the smallest id, of equal id and text one row."""
    gone = near_duplicates(docs, id_col=id_col, text_col=text_col, **options).select(F.col(id_col).alias("__gone"))
    kept = docs.join(gone, docs[id_col] == gone["__gone"], "left_anti")
    repeated = cut(docs.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__again")).count().where("count > 1").select("__again"))
    if repeated.isEmpty():
        return kept
    # only rows of repeated ids can be repetitions; those with a null id are in neither table's keys
    single = kept.join(repeated, kept[id_col] == repeated["__again"], "left_anti")
    several = kept.join(repeated, kept[id_col] == repeated["__again"], "left_semi")
    return single.unionByName(several.dropDuplicates([id_col, text_col]))
