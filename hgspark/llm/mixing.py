"""Mixing sources to target weights: a tempered distribution realised as budgeted block permutations.

A source's share p is its part of all white-space tokens. Its weight is p ** alpha over the sum of these. Entropy falls
and the largest repetition (budget * weight / tokens) of a source changes as alpha goes from 0 (uniform) to 1
(proportional); alpha is bisected to the least value that keeps every source within `max_repeats` passes over its
documents, or to the one whose entropy is `target_entropy` of the uniform one's, whichever is larger.

A source gets round(weight * budget) tokens: whole passes (epochs), then part of one. Its documents lie in hashed blocks
of about `block_tokens` tokens. Every epoch orders the blocks by a seeded hash, and the documents in a block by another.
Whole epochs take everything; the last one takes documents in this order as long as the sum of their tokens stays within
the rest. Which ones these are is told by one number pair a source, the hashes of the first document that doesn't fit:
sums over the leading bits of the hashes find it in a few rounds, so no source needs a task of its own, blocks are nowhere
listed, and choosing documents is a filter beside a broadcast table of sources. (With more than BROADCAST_ROWS sources
their join shuffles.)

Result: the chosen columns, the epoch, the block and its place in the epoch's permutation: rows of an epoch in the order
of `block_order` have their blocks permuted.

Defined results: a null source is a source; null and blank texts have 0 tokens and go with their block, those of any length
count whole; a source without any token has weight 0 and isn't drawn; repeated rows, and others with equal hashes, are drawn
together; where sources are so even that an exponent of 1 still is above the target entropy, 1 is taken (proportional
shares); an empty table gives an empty result; columns of the table that have the names of the added ones are replaced,
others are kept whatever their names.
"""

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..tables import cut, sized

BLOCK_TOKENS = 1 << 18
MAX_REPEATS = 4.0
TARGET_ENTROPY = 0.95
SEED = 17
STEPS = 60
#: Bits of the block key that a round of sums looks at, and rounds before documents are put in order.
LEVEL_BITS = 12
LEVELS = 2
#: Rows (of about 100 bytes) up to which the table of sources is broadcast.
BROADCAST_ROWS = 100_000


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\r\f]+")), F.lit(0)).cast("long")


def tempered(shares: np.ndarray, alpha: float) -> np.ndarray:
    """Weights that belong to shares above 0."""
    parts = np.asarray(shares, dtype=np.float64) ** alpha
    return parts / parts.sum()


def bisect_exponent(tokens: np.ndarray, budget: int, *, target_entropy: float | None = TARGET_ENTROPY, max_repeats: float | None = MAX_REPEATS) -> float:
    """The least exponent within both limits, 1 where even that isn't; `tokens`: of every source, all above 0."""
    tokens = np.asarray(tokens, dtype=np.float64)
    if len(tokens) < 2:
        return 0.0
    shares = tokens / tokens.sum()

    def too_flat(alpha: float) -> bool:
        w = tempered(shares, alpha)
        if max_repeats is not None and (budget * w / tokens).max() > max_repeats:
            return True
        some = w[w > 0]
        return target_entropy is not None and -(some * np.log(some)).sum() > target_entropy * math.log(len(w))

    if not too_flat(0.0):
        return 0.0
    low, high = 0.0, 1.0
    for _ in range(STEPS):
        middle = (low + high) / 2
        low, high = (middle, high) if too_flat(middle) else (low, middle)
    return high


def _order(*parts: Column | str | int) -> Column:
    return F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) if isinstance(p, Column) else F.lit(str(p)) for p in parts]))


def _key(*parts: Column | str | int) -> Column:
    """The first 60 bits of the hash as a number."""
    return F.conv(F.substring(_order(*parts), 1, 15), 16, 10).cast("long")


def _block(id_: Column, blocks: Column, seed: int) -> Column:
    return F.conv(F.substring(_order(seed, "block", id_), 1, 8), 16, 10).cast("long") % blocks


_SOURCE = "__mix_source"


def _first_without_room(rows: DataFrame) -> DataFrame:
    """(source, block key, document key) of the first document, in the order of the keys, at which the sum of a source's
    tokens is above its rest. `rows`: (source, __n > 0, __rest, __bk, __dk), each source with more tokens than its rest."""
    left = rows
    for shift in range(60 - LEVEL_BITS, 60 - LEVEL_BITS * LEVELS - 1, -LEVEL_BITS):
        part = F.shiftright("__bk", shift)
        sums = left.groupBy(_SOURCE, "__rest", part.alias("__part")).agg(F.sum("__n").alias("__sum"))
        upto = F.sum("__sum").over(Window.partitionBy(_SOURCE).orderBy("__part").rowsBetween(Window.unboundedPreceding, 0))
        full = sums.select("*", upto.alias("__upto")).where("__upto > __rest").groupBy(_SOURCE).agg(F.min(F.struct("__part", (F.col("__rest") - F.col("__upto") + F.col("__sum")).alias("r"))).alias("__m"))
        at = sized(cut(full.select(F.col(_SOURCE).alias("__s"), F.col("__m.__part").alias("__part"), F.col("__m.r").alias("__r"))), BROADCAST_ROWS)
        left = left.join(at, F.col(_SOURCE).eqNullSafe(F.col("__s")) & (part == F.col("__part"))).select(_SOURCE, "__n", F.col("__r").alias("__rest"), "__bk", "__dk")
    each = left.groupBy(_SOURCE, "__rest", "__bk", "__dk").agg(F.sum("__n").alias("__n"))
    upto = F.sum("__n").over(Window.partitionBy(_SOURCE).orderBy("__bk", "__dk").rowsBetween(Window.unboundedPreceding, 0))
    return each.select("*", upto.alias("__upto")).where("__upto > __rest").groupBy(_SOURCE).agg(F.min(F.struct("__bk", "__dk")).alias("__end"))


def mixing_plan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", budget: int | None = None, target_entropy: float | None = TARGET_ENTROPY, max_repeats: float | None = MAX_REPEATS, block_tokens: int = BLOCK_TOKENS, seed: int = SEED) -> DataFrame:
    """One row a source: its number of blocks, of whole epochs, and the keys of the first document that the epoch after
    these doesn't take (null where it takes none)."""
    small = cut(docs.select(F.col(source_col).cast("string").alias(_SOURCE), F.col(id_col).alias("__id"), token_count(F.col(text_col)).alias("__n")))
    sums = cut(small.groupBy(_SOURCE).agg(F.sum("__n").alias("__tokens")).where("__tokens > 0"))
    tokens = np.sort(sums.select("__tokens").toArrow()["__tokens"].to_numpy())
    total = int(tokens.sum())
    budget = total if budget is None else budget
    alpha = bisect_exponent(tokens, budget, target_entropy=target_entropy, max_repeats=max_repeats)
    scale = float((np.asarray(tokens / max(1, total)) ** alpha).sum())
    weight = F.pow(F.col("__tokens") / F.lit(total), F.lit(alpha)) / F.lit(scale)
    quotas = sums.select(_SOURCE, "__tokens", F.floor(weight * F.lit(budget) + 0.5).cast("long").alias("__quota"))
    sources = cut(quotas.select(_SOURCE, F.expr(f"(__tokens + {block_tokens - 1}) div {block_tokens}").alias("__blocks"), F.expr("__quota div __tokens").alias("__epochs"), (F.col("__quota") % F.col("__tokens")).alias("__rest")))
    asked = sized(sources.where("__rest > 0").withColumnRenamed(_SOURCE, "__s"), BROADCAST_ROWS)
    block = _block(F.col("__id"), F.col("__blocks"), seed)
    rows = small.where("__n > 0").join(asked, F.col(_SOURCE).eqNullSafe(F.col("__s"))).select(_SOURCE, "__n", "__rest", _key(seed, F.col("__epochs"), F.col(_SOURCE), block).alias("__bk"), _key(seed, F.col("__epochs"), F.col("__id")).alias("__dk"))
    ends = _first_without_room(rows).withColumnRenamed(_SOURCE, "__s") if sources.where("__rest > 0").count() else None
    if ends is None:
        return sources.select(_SOURCE, "__blocks", "__epochs", F.lit(None).cast("struct<__bk: bigint, __dk: bigint>").alias("__end"))
    return cut(sources.join(ends, F.col(_SOURCE).eqNullSafe(F.col("__s")), "left").select(_SOURCE, "__blocks", "__epochs", "__end"))


def mix_sources(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: list[str] | None = None, added: bool = True, seed: int = SEED, **limits) -> DataFrame:
    """The drawn documents, one row for each time one is drawn: the columns `keep` (all by default), its epoch, its block
    and the block's place in the epoch's order; without `added` the columns `keep` alone."""
    plan = mixing_plan(docs, id_col=id_col, text_col=text_col, source_col=source_col, seed=seed, **limits)
    names = [c for c in (keep or docs.columns) if not added or c.lower() not in ("epoch", "block", "block_order")]
    held = docs.select(*[F.col(f"`{c}`").alias(f"__k_{c}") for c in names], F.col(id_col).alias("__id"), F.col(source_col).cast("string").alias("__s"))
    counted = held.join(sized(plan, BROADCAST_ROWS), F.col("__s").eqNullSafe(F.col(_SOURCE)))
    last = F.when(F.col("__end").isNull(), F.col("__epochs") - 1).otherwise(F.col("__epochs"))
    passes = counted.where(last >= 0).select("*", _block(F.col("__id"), F.col("__blocks"), seed).alias("__b"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("__e"))
    placed = passes.select("*", _key(seed, F.col("__e"), F.col("__s"), F.col("__b")).alias("__bk"))
    before_end = (F.col("__bk") < F.col("__end.__bk")) | ((F.col("__bk") == F.col("__end.__bk")) & (_key(seed, F.col("__e"), F.col("__id")) < F.col("__end.__dk")))
    taken = placed.where((F.col("__e") < F.col("__epochs")) | before_end)
    places = [F.col("__e").alias("epoch"), F.col("__b").alias("block"), F.col("__bk").alias("block_order")] if added else []
    return taken.select(*[F.col(f"`__k_{c}`").alias(c) for c in names], *places)
