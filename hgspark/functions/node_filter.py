"""Filtering of node names that say nothing: pronouns, vague nouns, author words, very short names."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .word_lists import AUTHOR_TERMS, PRONOUNS, VAGUE_NOUNS

_EDGES = r"(?U)^\s+|\s+$"


def should_filter(node: Column) -> Column:
    """Whether a name is to be left out. A name is compared lower-cased and trimmed, and once more with only its letters
    and white space, which isn't trimmed again, against the pronouns."""
    name = F.regexp_replace(F.lower(node), _EDGES, "")
    letters = F.regexp_replace(name, r"(?U)[^\p{L}\s]", "")
    words = sorted(PRONOUNS | VAGUE_NOUNS | AUTHOR_TERMS)
    return (F.length(name) < 2) | name.isin(words) | letters.isin(sorted(PRONOUNS))


def filter_events(rows: DataFrame, column: str = "event") -> DataFrame:
    """Rows with an event struct: its source and target without such names; rows left with none of either go."""
    event = F.col(column)
    source, target = F.filter(event["source"], lambda n: ~should_filter(n)), F.filter(event["target"], lambda n: ~should_filter(n))
    new = rows.withColumn(column, F.struct(source.alias("source"), event["relation"].alias("relation"), target.alias("target")))
    return new.where((F.size(F.col(column)["source"]) > 0) & (F.size(F.col(column)["target"]) > 0))


def filter_event_lists(rows: DataFrame, column: str = "events") -> DataFrame:
    """The same in an array of events, order kept."""

    def cleaned(e: Column) -> Column:
        return F.struct(F.filter(e["source"], lambda n: ~should_filter(n)).alias("source"), e["relation"].alias("relation"), F.filter(e["target"], lambda n: ~should_filter(n)).alias("target"))

    return rows.withColumn(column, F.filter(F.transform(F.col(column), cleaned), lambda e: (F.size(e["source"]) > 0) & (F.size(e["target"]) > 0)))
