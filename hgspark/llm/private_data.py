"""Personal data and secrets by bootstrapped extraction: seeds induce patterns, patterns find further identifiers.

Candidates are all tokens of a text with a digit or an @, without the punctuation around them; neighbouring numeric tokens
are one (telephone and card numbers with spaces), until they pass a strict test. The strict expressions are also searched
within and across candidates, with tests of what stands beside a hit, and assignments to a key like password in the whole
text, whether their value has a digit or not (without one it has to stand right behind the sign, or in quotes). A hit is a
candidate of its own, and so is what is left of the candidate it was cut from. No candidate is too long or too short. A
group of a spaced number that stands in a row of unmarked numbers is none of its own. A candidate that passes a type's
strict test is a seed. Every candidate has patterns: its shape, its shape with runs of one length, its first characters with
its length and kind of characters, the key it is assigned to, and the whole words before and after it with its kind.
Candidates and patterns of more than NAME characters are known to the graph by a 128-bit hash.

Spark scores the graph of patterns and distinct candidates in rounds. A pattern's confidence in a type is the summed score
its candidates have for the type over one more than their number, 0 below LEAST_SUPPORT candidates' worth of score. A
candidate's score is 1 for a seed's own type, else 1 - product of (1 - confidence) over its patterns with a confidence of
at least LEAST_CONFIDENCE. Scores below PROMOTED are dropped, so only what is well supported carries over to the next
round. The result has every occurrence of a candidate that has a type after ROUNDS rounds.

Result: (id, start, end, entity_type, entity, score); start and end count characters (code points) from 0.

Defined results: null and empty texts have no candidates; a text of any length is searched whole, in time that grows with
its length (a row of a million numbers too); equal scores go to the first type in alphabetical order, of overlapping hits
the longest is taken, of equally long ones the first; an id may be null; a repeated row's occurrences count once; the
patterns count distinct candidates, so copies of a text don't add support; an empty table gives no rows; columns besides
the two that are read don't matter, whatever their names.
"""

import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, slices

ROUNDS = 3
LEAST_SUPPORT = 3.0
LEAST_CONFIDENCE = 0.6
PROMOTED = 0.8
NAME = 64
#: No merged number that passes a strict test is longer: 19 digits with a sign between any two.
_LONGEST_NUMBER = 40

_MARKS = re.compile(r"[@\d]+")
_SPACE = re.compile(r"\s")
_NUMERIC = re.compile(r"[+(]?[\d().\-/]+")
_EMAIL = re.compile(r"[\w.+%-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}")
_PHONE = re.compile(r"(?:\+\d{1,3}[ .-]?)?\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}")
_IP = re.compile(r"(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)")
_CARD = re.compile(r"\d(?:[ -]?\d){12,18}")
_SSN = re.compile(r"\d{3}-\d{2}-\d{4}")
_KEY_ID = re.compile(r"(?:AKIA|ASIA)[A-Z0-9]{16}")
_SECRET = re.compile(r"(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)[\"']?\s*[=:]\s*[\"']?[A-Za-z0-9+/_\-]{8,}={0,2}(?:\.[A-Za-z0-9+/_\-]{8,}={0,2})*")
#: How a match of _SECRET may begin, in lower case.
_KEYS = ("password", "passwd", "pwd", "secret", "token", "api", "access")
_LOOSE = re.compile(r"[^=:]*[=:]\s+[^\s\"']")
_RUN = re.compile(r"[^\W\d_]+")
_DIGITS = re.compile(r"\d+")
# The strict expressions within a text: what stands beside a hit mustn't go on with it.
_LEFT, _RIGHT = r"(?<![A-Za-z0-9])(?<!\d[-./])", r"(?![A-Za-z0-9])(?![-./]\d)"
_WITHIN = (
    re.compile(r"(?<![\w.+%-])[\w.+%-]++@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?![A-Za-z0-9]|[_.-]+[A-Za-z0-9])"),
    re.compile(rf"(?<![A-Za-z0-9])(?<!\d\.){_IP.pattern}(?![A-Za-z0-9]|\.\d)"),
    re.compile(_LEFT + _SSN.pattern + _RIGHT),
    re.compile(_LEFT + _PHONE.pattern + _RIGHT),
    re.compile(_LEFT + r"(?:[2-6]\d{12,18}|[2-6]\d{3}([ -])\d{6}\1\d{4,5})" + _RIGHT),
)
_FOURS, _ENDS = re.compile(_LEFT + r"\d{4}([ -])\d{4}(?:\1\d{4})++"), re.compile(_RIGHT)
_ALONE = re.compile(rf"(?<![A-Za-z0-9]){_KEY_ID.pattern}(?![A-Za-z0-9])")
_SPACED = re.compile(r"[\d ]+")
TYPES = ("card", "email", "ip", "key_id", "phone", "secret", "ssn")


def _luhn(text: str) -> bool:
    total = 0
    for k, c in enumerate(reversed([int(c) for c in text if c.isdigit()])):
        total += c if k % 2 == 0 else c * 2 - 9 * (c > 4)
    return total % 10 == 0


def seed_type(entity: str) -> str | None:
    """The type whose strict test a candidate passes."""
    if _EMAIL.fullmatch(entity):
        return "email"
    if _KEY_ID.fullmatch(entity):
        return "key_id"
    if _SECRET.fullmatch(entity):
        return "secret"
    if _IP.fullmatch(entity):
        return "ip"
    if _SSN.fullmatch(entity):
        return "ssn"
    if _PHONE.fullmatch(entity):
        return "phone"
    if _CARD.fullmatch(entity) and _luhn(entity):
        return "card"
    return None


def _kind(text: str) -> str:
    """What a candidate is made of."""
    if re.fullmatch(r"[0-9a-f]+", text):
        return "digits" if text.isdigit() else "hex"
    if re.fullmatch(r"[A-Z0-9]+", text):
        return "upper"
    return "alnum" if text.isalnum() else "".join(sorted({c for c in text if not c.isalnum()}))


def _hits(text: str, start: int, stop: int) -> Iterator[tuple[int, int]]:
    """Identifiers with a digit or an @ that the strict expressions find in a part of a text that ends with a token."""
    for expression in _WITHIN:
        for m in expression.finditer(text, start, stop):
            a, b = m.span()
            if "@" in m.group():
                while text[a] in ".+%-":
                    a += 1
            elif _SPACED.fullmatch(m.group()) and (text[a - 2 : a].strip(" ").isdigit() or text[b : b + 2].strip(" ").isdigit()):
                continue  # some of a row of numbers, none of which is marked as a number of its own
            if seed_type(text[a:b]):
                yield a, b
    for m in _FOURS.finditer(text, start, stop):  # a run of groups of four is one card or several, or none
        cards = [(a, a + 19) for a in range(m.start(), m.end(), 20)]
        if _ENDS.match(text, m.end()) and all(b <= m.end() and text[a] in "23456" and _luhn(text[a:b]) for a, b in cards):
            yield from cards


def _named(text: str) -> Iterator[tuple[int, int]]:
    """Assignments to a key and key ids anywhere in a text, which need no digit."""
    folded = text.lower()
    if len(folded) != len(text):  # a few characters have longer small forms
        folded = "".join(low if len(low := c.lower()) == 1 else c for c in text)
    for key in _KEYS:
        at = folded.find(key)
        while at >= 0:
            m = _SECRET.match(text, at)
            if m and (any(c.isdigit() for c in re.split("[=:]", m.group(), maxsplit=1)[1]) or not _LOOSE.match(m.group())):
                yield m.span()
            at = folded.find(key, at + 1)
    for prefix in ("AKIA", "ASIA"):
        at = text.find(prefix)
        while at >= 0:
            if m := _ALONE.match(text, at):
                yield m.span()
            at = text.find(prefix, at + 1)


def _apart(hits: set[tuple[int, int]]) -> list[tuple[int, int]]:
    """Hits that don't overlap, longer ones first."""
    out: list[tuple[int, int]] = []
    cluster: list[tuple[int, int]] = []
    end = -1
    for hit in [*sorted(hits), None]:
        if hit is None or hit[0] >= end:  # a cluster of overlapping hits ends
            taken: list[tuple[int, int]] = []
            for a, b in sorted(cluster, key=lambda x: (x[0] - x[1], x)):
                if all(b <= c or d <= a for c, d in taken):
                    taken.append((a, b))
            out += sorted(taken)
            cluster = []
        if hit is not None:
            cluster.append(hit)
            end = max(end, hit[1])
    return out


def _trimmed(text: str, start: int, stop: int) -> tuple[int, int]:
    """A token, or a part of one, without the punctuation and space around it."""
    numeric = None  # where the token's numeric end begins: that keeps its bracket or point
    while start < stop and text[start] in " \"'<[{(,;:!?.":
        if text[start] in "(.":
            if numeric is None:
                numeric = end = start + len(text[start:stop].rstrip(".,;:!?\"'"))
                while numeric > start and (text[numeric - 1].isdecimal() or text[numeric - 1] in "().-/"):
                    numeric -= 1
            if numeric <= start < end:
                break
        start += 1
    opened = "(" in text[start:stop]
    while stop > start and (text[stop - 1] in " \"'>]},;:!?." or (text[stop - 1] == ")" and not opened)):
        stop -= 1
    return start, stop


def _grouped(entity: str) -> bool:
    """Whether a card number is written without separators or in the usual groups."""
    return [len(p) for p in re.split("[ -]", entity)] in ([len(entity)], [4, 4, 4, 4], [4, 6, 5], [4, 6, 4], [4, 4, 4, 4, 3])


def candidates(text: str | None) -> list[tuple[int, int]]:
    """Spans of candidates, from left to right."""
    spans: list[list[int]] = []
    if not text:
        return []
    regions: list[list[int]] = []  # neighbouring marked tokens as they stand, where identifiers are searched
    done, points = 0, None  # points in the last span if it is known to be a row of numbers, 2 if it is none
    for m in _MARKS.finditer(text):
        if m.start() < done:
            continue
        start = m.start()
        while start > done and not text[start - 1].isspace():
            start -= 1
        space = _SPACE.search(text, m.end())
        done = stop = space.start() if space else len(text)
        if regions and regions[-1][1] + 1 == start and text[start - 1] == " ":
            regions[-1][1] = stop
        else:
            regions.append([start, stop])
        start, stop = _trimmed(text, start, stop)
        if start == stop:
            continue
        if spans and spans[-1][1] + 1 == start and text[start - 1] == " " and text[start] != "+":
            size = spans[-1][1] - spans[-1][0]
            if points is None:
                before = text[spans[-1][0] : spans[-1][1]]
                points = before.count(".") if all(_NUMERIC.fullmatch(p) for p in before.split(" ")) else 2
            own = text[start:stop]
            if points < 2 and _NUMERIC.fullmatch(own) and own.count(".") < 2 and (size > _LONGEST_NUMBER or seed_type(text[spans[-1][0] : spans[-1][1]]) is None):
                spans[-1][1] = stop
                points += own.count(".")
                continue
        points = None
        spans.append([start, stop])
    found = {(a, b) for a, b in spans if (kind := seed_type(text[a:b])) and (kind != "card" or _grouped(text[a:b]))}
    for start, stop in regions:
        found.update(_hits(text, start, stop))
    found.update(_named(text))
    hits = _apart(found)
    out, k = list(hits), 0
    for start, stop in spans:
        while k < len(hits) and hits[k][1] <= start:
            k += 1
        inside, j = [], k
        while j < len(hits) and hits[j][0] < stop:
            inside.append(hits[j])
            j += 1
        if not inside:
            out.append((start, stop))
            continue
        edges = [start, *[x for h in inside for x in h], stop]
        for a, b in zip(edges[::2], edges[1::2], strict=True):
            a, b = _trimmed(text, a, max(a, b))
            if _MARKS.search(text, a, b):
                out.append((a, b))
    return sorted(out)


def _name(text: str) -> str:
    """What the graph calls a candidate or a pattern: itself or, if it is long, its hash."""
    return text if len(text) <= NAME else "#" + blake2b(text.encode("utf-8", "replace"), digest_size=16).hexdigest()


def _word_before(text: str, first: int, start: int) -> str:
    """The whole word that ends before a place; `first` is where to look from."""
    near = text[max(first, start - 40) : start].rsplit(None, 1)
    if len(near) < 2 and start - 40 > first:  # a word that may have begun before
        near = text[first:start].rsplit(None, 1)
    return near[-1].lower() if near else ""


def _word_after(text: str, stop: int, last: int) -> str:
    near = text[stop : min(last, stop + 40)].split(None, 1)
    if (not near or len(near) < 2) and stop + 40 < last:
        near = text[stop:last].split(None, 1)
    return near[0].lower() if near else ""


def patterns(text: str, start: int, stop: int, first: int = 0, last: int | None = None) -> list[str]:
    """The patterns of a candidate in its place; the words around it lie between `first` and `last`."""
    entity = text[start:stop]
    shape = _RUN.sub("a", entity)
    coarse = _DIGITS.sub("9", shape)
    kind, size = _kind(entity), len(entity)
    out = [f"shape {_DIGITS.sub(lambda m: '9' * len(m.group()), shape)}" if "a" not in shape or size <= 24 else f"long {kind} {size}"]
    if len(coarse) > 3 and not entity.isalnum():
        out.append(f"coarse {coarse}")
    if entity[:4].isalpha():
        out.append(f"starts {entity[:4]} {kind} {size}")
    key = re.match(r"([^\W\d]+)[\"']?\s?[=:]", entity)
    if key:
        value = entity[key.end() :].strip(" \"'")
        out.append(f"key {key.group(1).lower()} {_kind(value)}")
    short = coarse if len(coarse) < 12 else size
    out.append(f"after {_word_before(text, first, start)} {kind} {short}")
    out.append(f"before {_word_after(text, stop, len(text) if last is None else last)} {kind} {short}")
    return [_name(p) for p in out]


def _occurrences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, n in slices(batch.column(1)):
                row, starts, stops, entities, seeds, all_patterns = [], [], [], [], [], []
                for k, text in enumerate(batch.column(1).slice(a, n).to_pylist()):
                    spans = candidates(text)
                    for i, (start, stop) in enumerate(spans):
                        row.append(k)
                        starts.append(start)
                        stops.append(stop)
                        entities.append(text[start:stop])
                        seeds.append(seed_type(text[start:stop]))
                        all_patterns.append(patterns(text, start, stop, spans[i - 1][0] if i else 0, spans[i + 1][1] if i + 1 < len(spans) else len(text)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, n).take(pa.array(row, pa.int64())), pa.array(starts, pa.int64()), pa.array(stops, pa.int64()), pa.array(entities, pa.string()), pa.array([_name(e) for e in entities], pa.string()), pa.array(seeds, pa.string()), pa.array(all_patterns, pa.list_(pa.string()))], names=["id", "start", "end", "entity", "name", "seed", "patterns"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("entity", T.StringType()), T.StructField("name", T.StringType()), T.StructField("seed", T.StringType()), T.StructField("patterns", T.ArrayType(T.StringType()))])
    return docs.select(id_col, text_col).mapInArrow(find, schema)


def score_candidates(found: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(entity, entity_type, score) from occurrences (entity, seed, patterns)."""
    edges = cut(found.select("entity", F.explode("patterns").alias("pattern")).distinct())
    sizes = edges.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_SUPPORT)
    # patterns that too few candidates have can't pass, whatever the scores
    edges = cut(edges.join(sizes, "pattern"))
    seeds = cut(found.where("seed is not null").select("entity", F.col("seed").alias("entity_type"), F.lit(1.0).alias("score")).distinct())
    scores = seeds
    for _ in range(rounds):
        held = edges.join(scores, "entity").groupBy("pattern", "entity_type", "n").agg(F.sum("score").alias("mass"))
        sure = held.where(F.col("mass") >= LEAST_SUPPORT).select("pattern", "entity_type", (F.col("mass") / (F.col("n") + 1)).alias("confidence")).where(F.col("confidence") >= LEAST_CONFIDENCE)
        new = edges.select("entity", "pattern").join(sure, "pattern").groupBy("entity", "entity_type").agg(F.round(1 - F.exp(F.sum(F.log(1 - F.col("confidence")))), 6).alias("score")).where(F.col("score") >= PROMOTED)
        fresh = new.join(seeds.select("entity"), "entity", "left_anti")
        scores = cut(seeds.unionByName(fresh.groupBy("entity").agg(F.min(F.struct((-F.col("score")).alias("s"), "entity_type")).alias("b")).select("entity", "b.entity_type", (-F.col("b.s")).alias("score"))))
    return scores


def find_private(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """Every occurrence of personal data or a secret."""
    found = cut(_occurrences(docs, id_col, text_col))
    scores = score_candidates(found.select(F.col("name").alias("entity"), "seed", "patterns"), rounds).withColumnRenamed("entity", "name")
    places = found.dropDuplicates(["id", "start", "end", "name"])
    return places.join(scores, "name").select(F.col("id").alias(id_col), "start", "end", "entity_type", "entity", "score")
