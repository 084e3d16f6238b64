"""Toxicity by weak supervision: a generative model of many voters gives labels, on which a linear classifier is trained.

Voters. Each fires or not on a text's words. Lexicon voters hold words of abuse by kind, and terms (words and word starts)
induced from a bounded sample of labelled rows, where a term has to occur in toxic rows far more often than in others
(a likelihood-ratio test that allows for the number of terms and counts copies of a text once); the terms are dealt out to several voters. Pattern voters look for abuse addressed to a person, threats, spelt-out
or disguised abuse, and piled-up abuse.

Label model. One pass over all rows counts how often each combination of votes occurs: at most 2 ** voters counts,
whatever the number of rows. Expectation maximisation on them estimates the toxic share and every voter's firing rates
on toxic and on other rows (its accuracy). Voters that correlate beyond what the class explains (first judged by triples
of covariances, then given the posteriors) by more than CORRELATED form a clique, which is modelled by its joint table.

Classifier. Logistic regression over hashed words, word starts and words of abuse that were written in disguise (present
or not), trained by gradient descent in numpy on posterior labels. Labels of rows help only to induce terms: the texts
that are learned from are those of the labelled sample (at most SAMPLE_ROWS a class) and of a sample of the whole table: of
about POOL_ROWS rows, those with the smallest hash of their id, whose votes come with the counts of the same pass, at most
SAMPLE_ROWS / 2 on either side of an even posterior. It then scores every row's whole text. Where the posteriors of all
these texts are on one side there is nothing to tell apart, and every row gets the label model's posterior of its votes.

Defined results: null, empty and wordless texts get probability 0; a text of any length is read whole; repeated rows are
scored alike, each counts as a row of the label model, and copies of a text are evidence for terms once; an id with several
texts is learned from by one of them, and a row with a null id by its votes only; null labels are left out, an id labelled
repeatedly is toxic if one of its labels is; with no labels at all only the fixed voters vote; if nothing votes, nothing is
toxic; a probability equal to the threshold is toxic; an empty table gives no rows; columns besides those that are read
don't matter, whatever their names.
"""

import re
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import bounded_sample, hash_bound, mix64, text_udf, words_of

LEXICONS = {
    "wits": "idiot idiots idiotic moron morons moronic stupid stupidity imbecile imbeciles dumb dumbass dimwit halfwit cretin nitwit",
    "contempt": "loser losers pathetic worthless useless failure pitiful miserable spineless coward",
    "filth": "scum trash garbage vermin filth filthy filthiest pig swine disgusting disgrace repulsive vile",
    "ridicule": "clown clowns joke freak weirdo creep jerk fool fools buffoon",
    "profane": "fuck fucking fucker shit bullshit bitch bastard asshole crap damn dick whore slut cunt",
}
_ABUSE = frozenset(w.encode() for words in LEXICONS.values() for w in words.split())
#: A 1 stands for an i or an l.
_DISGUISES = [bytes.maketrans(b"013457@$!", b"o" + one + b"eastasi") for one in (b"i", b"l")]
_SIGNED = re.compile(rb"[a-z0-9@$!]+")
_SPELT = re.compile(rb"(?:\b[a-z0-9@$!][ .*_-]){3,}[a-z0-9@$!]\b")
INDUCED_VOTERS = 4
PREFIXES = (4, 5, 6)
SAMPLE_ROWS = 4000
POOL_ROWS = 64_000
LEAST_SUPPORT = 3
LEAST_PRECISION = 0.9
CORRELATED = 0.2
#: Rows without votes that the label model takes as seen in the other class, as voters know nothing but abuse: they
#: decide where a table has no such row.
CALM_ROWS = 10
ROUNDS = 300
BUCKETS = 1 << 18
THRESHOLD = 0.5
SEED = 11
_CACHE = 300_000
_RUN = 1 << 17
_THREATS = (b"kill yourself", b"go die", b"shut up", b"i will kill", b"i will hurt", b"hate you", b"drop dead", b"get lost")
_THREAT_WORDS = frozenset({b"kill", b"die", b"shut", b"hate", b"drop", b"hurt", b"lost"})
_YOU = frozenset({b"you", b"your", b"youre"})
_DIGIT = re.compile("[013457]")
VOTERS = [*LEXICONS, "addressed", "threat", "disguised", "piled", *(f"induced{k}" for k in range(INDUCED_VOTERS))]
_BIT = {v: 1 << k for k, v in enumerate(VOTERS)}


def terms_of(word: bytes) -> tuple[bytes, ...]:
    """A word and its starts: a term that ends in * is a start."""
    if word.isascii():
        return (word, *(word[:n] + b"*" for n in PREFIXES if len(word) > n))
    text = word.decode("utf-8", "replace")
    return (word, *(text[:n].encode("utf-8", "replace") + b"*" for n in PREFIXES if len(text) > n))


class _Corpus:
    """The words of some texts as numbers, and which of them stand between neighbours that no earlier text had around the
    same word: copies of a text, exact or near, are evidence once."""

    def __init__(self, texts: list[str]):
        number: dict[bytes, int] = defaultdict()
        number.default_factory = number.__len__
        flat, ends = array("i"), [0]
        for t in texts:
            flat.extend(map(number.__getitem__, (b"", *words_of(t), b"")))
            ends.append(len(flat))
        self.sizes = np.diff(ends)
        self.flat = np.array(flat, dtype=np.int32)
        del flat
        self.words = list(number)
        self.new = self._first(np.fromiter((xxh3_64_intdigest(w, SEED) for w in self.words), dtype=np.uint64, count=len(self.words)))
        self.new[self.flat == number[b""]] = False  # the ends of texts
        number.default_factory = None  # else it would refer to itself and stay

    def _first(self, hashes: np.ndarray) -> np.ndarray:
        """Which words stand in a place for the first time. Places are hashed run by run and compared part by part of their
        hashes, so that beside them hardly anything is held for all words at once."""
        new = np.zeros(len(self.flat), dtype=bool)
        place = np.empty(max(0, len(new) - 2), dtype=np.uint64)
        part = np.empty(len(place), dtype=np.uint8)
        for a in range(0, len(place), _RUN):
            h = hashes[self.flat[a : a + _RUN + 2]]
            run = place[a : a + _RUN] = mix64(mix64(mix64(h[:-2]) + h[1:-1]) + h[2:])
            part[a : a + _RUN] = run >> np.uint64(64 - 5)
        for k in range(1 << 5):
            some = np.flatnonzero(part == k)
            new[1 + some[np.unique(place[some], return_index=True)[1]]] = True
        return new

    def terms(self, terms: Callable[[bytes], tuple], new: bool, extra: list[set] | None = None) -> tuple[list, Iterator[tuple[np.ndarray, np.ndarray]]]:
        """All terms, and runs of texts as distinct (text, term number) pairs, of words in new places only if `new`; `extra`
        has further words by text."""
        number: dict = defaultdict()
        number.default_factory = number.__len__
        held, ends = array("q"), array("q", [0])
        for w in self.words:
            if w:
                held.extend(number[t] for t in set(terms(w)))
            ends.append(len(held))
        more = [sorted({number[t] for w in x for t in terms(w)}) for x in extra] if extra else None
        start, count = np.array(ends[:-1], dtype=np.int64), np.diff(ends)
        flat = np.array(held, dtype=np.int64)
        names = list(number)
        number.default_factory = None
        del held, number

        def runs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            ends = np.cumsum(self.sizes)
            for a in range(0, len(ends), 256):
                b = min(len(ends), a + 256)
                first = ends[a] - self.sizes[a]
                words = self.flat[first : ends[b - 1]]
                text = np.repeat(np.arange(a, b), self.sizes[a:b])
                if new:
                    some = self.new[first : ends[b - 1]]
                    words, text = words[some], text[some]
                pairs = np.unique(text * len(self.words) + words)
                text, words = pairs // max(1, len(self.words)), pairs % max(1, len(self.words))
                each = count[words]
                term = flat[np.repeat(start[words] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))]
                text = np.repeat(text, each)
                if more:
                    text = np.concatenate([text, np.repeat(np.arange(a, b), [len(x) for x in more[a:b]])])
                    term = np.concatenate([term, np.array([t for x in more[a:b] for t in x], dtype=np.int64)])
                pairs = np.unique(text * len(names) + term)
                yield pairs // max(1, len(names)), pairs % max(1, len(names))

        return names, runs()


def _telling(corpus: _Corpus, terms: Callable[[bytes], tuple], weight: np.ndarray) -> dict:
    """Terms that occur in toxic rows (weight 1) far more often than in others (0), by a likelihood-ratio test whose
    threshold grows with the number of terms, so that hardly one term of all would pass by chance."""
    names, runs = corpus.terms(terms, new=True)
    bad, clean = np.zeros(len(names)), np.zeros(len(names))
    for text, term in runs:
        bad += np.bincount(term, weight[text], len(names))
        clean += np.bincount(term, 1 - weight[text], len(names))
    some = np.flatnonzero(bad >= LEAST_SUPPORT - 1e-9)
    bad, clean = bad[some], np.maximum(clean[some], 0)
    total = np.array([(1 - weight).sum(), weight.sum()])
    share, needed = min(0.999, max(1e-6, total[1] / max(1, total.sum()))), 4 * np.log(max(10, len(some)))
    # rates by class, so that the sample's balance doesn't matter
    good_rate, bad_rate = (clean + 0.1) / (total[0] + 1), bad / (total[1] + 1)
    n = bad + clean
    ratio = bad * np.log(bad / (n * share)) + clean * np.log(np.maximum(clean, 1e-300) / (n * (1 - share)))
    passed = (bad_rate > good_rate) & (2 * ratio >= needed)
    return {names[some[k]]: bad_rate[k] / (bad_rate[k] + good_rate[k]) for k in np.flatnonzero(passed)}


def induce_lexicon(texts: list[str], toxic: list[int]) -> list[bytes]:
    """Terms that tell toxic rows from others in a labelled sample."""
    return sorted(t for t, precision in _telling(_Corpus(texts), terms_of, np.array(toxic, dtype=np.float64)).items() if precision >= LEAST_PRECISION)


def _plain(word: bytes) -> set[bytes]:
    """The abuse that a word is with signs in place of letters."""
    return {plain for d in _DISGUISES if (plain := word.translate(d)) != word and plain in _ABUSE}


def disguised(text: str, words: list[bytes], different: set[bytes]) -> set[bytes]:
    """Words of abuse that a text has in disguise: digits or signs for letters, or letters set apart."""
    out: set[bytes] = set()
    if _DIGIT.search(text):
        for w in different:
            if not w.isalpha():
                out |= _plain(w)
    raw = None
    if "@" in text or "$" in text or "!" in text:
        raw = text.lower().encode("utf-8", "replace")
        for w in set(_SIGNED.findall(raw)):
            for form in (w, w.rstrip(b"!")):  # a last ! may be just that
                if not form.isalnum():
                    out |= _plain(form)
    if list(map(len, words)).count(1) > 3 and b"1111" in bytes(49 if len(w) == 1 else 48 for w in words):
        for m in _SPELT.findall(raw or text.lower().encode("utf-8", "replace")):
            w = re.sub(rb"[ .*_-]", b"", m)
            out |= {w} & _ABUSE | _plain(w)
    return out


class Voters:
    """Votes of all voters on a text as bits of a number, bit k for VOTERS[k]."""

    def __init__(self, induced: list[bytes]):
        self.bit = {w.encode(): 1 << k for k, words in enumerate(LEXICONS.values()) for w in words.split()}
        first = VOTERS.index("induced0")
        self.induced = {t: 1 << (first + xxh3_64_intdigest(t, SEED) % INDUCED_VOTERS) for t in induced}
        # most words begin like no term at all
        self.starts = frozenset(t.rstrip(b"*")[:4] for t in (*self.bit, *self.induced))

    def of_word(self, word: bytes) -> int:
        bits = self.bit.get(word, 0)
        for t in terms_of(word):
            bits |= self.induced.get(t, 0)
        return bits

    def __call__(self, text: str | None) -> int:
        words = words_of(text) if text else []
        bits = hits = 0
        starts, different = self.starts, set(words)
        for w in [w for w in different if w[:4] in starts]:
            b = self.of_word(w)
            bits |= b
            hits += b > 0
        if hits > 1:
            bits |= _BIT["piled"]
        if bits and different & _YOU:
            for k, w in enumerate(words):
                if w in _YOU and any(x in _ABUSE for x in words[k + 1 : k + 5]):
                    bits |= _BIT["addressed"]
                    break
        if different & _THREAT_WORDS and any(t in b" ".join(words) for t in _THREATS):
            bits |= _BIT["threat"]
        if words and disguised(text, words, different):
            bits |= _BIT["disguised"]
        return bits


class LabelModel:
    """Latent-class model of vote combinations: a class share and, per clique of voters, a joint table for each class."""

    def __init__(self, masks: np.ndarray, counts: np.ndarray):
        self.votes = (masks[:, None] >> np.arange(len(VOTERS)) & 1).astype(np.int64)
        self.counts = counts.astype(np.float64)
        self.cliques = self.group(self.excess())
        posterior = np.where(self.votes.any(axis=1), 0.9, 0.01)
        for _ in range(2):
            posterior = self.estimate(posterior)
            self.correlations = self.correlate(posterior)
            merged = self.group(np.maximum(self.excess(), self.correlations))
            if merged == self.cliques:
                break
            self.cliques = merged
        posterior = self.estimate(posterior)
        self.by_mask = dict(zip(masks.tolist(), posterior.tolist(), strict=True))
        rates = [self.rate(posterior if y else 1 - posterior) for y in (0, 1)]
        self.accuracies = {v: (float(rates[1][k]), float(rates[0][k])) for k, v in enumerate(VOTERS)}

    def rate(self, weight: np.ndarray) -> np.ndarray:
        w = weight * self.counts
        return (w @ self.votes + 0.01) / (w.sum() + 1)

    def estimate(self, posterior: np.ndarray) -> np.ndarray:
        state = [self.votes[:, c] @ (1 << np.arange(len(c))) for c in self.cliques]
        for _ in range(ROUNDS):
            bad = posterior * self.counts
            share = min(0.5, (bad.sum() + 1e-3) / (self.counts.sum() + 1))
            logit = np.full(len(posterior), np.log(share / (1 - share)))
            for c, s in zip(self.cliques, state, strict=True):
                cells = 1 << len(c)
                tables = [np.bincount(s, w, cells) + 0.5 / cells for w in (self.counts - bad, bad)]
                tables[0][0] += CALM_ROWS
                ratio = np.log(tables[1] / tables[1].sum()) - np.log(tables[0] / tables[0].sum())
                # a single vote may not speak for a clean text, as voters only know abuse
                logit += ratio[s] if len(c) > 1 else np.where(s > 0, np.maximum(ratio[s], 0), np.minimum(ratio[s], 0))
            new = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
            done, posterior = np.abs(new - posterior).max() < 1e-6, new
            if done:
                break
        return posterior

    def excess(self) -> np.ndarray:
        """Correlations beyond those that the class causes. If voters only had the class in common, covariances would be
        products a_i * a_j, and a_i ** 2 = cov_ij * cov_ik / cov_jk for all j, k; the median over these bears some pairs
        that break the rule, and what is left of their covariance is their own."""
        total = self.counts.sum()
        mean = self.counts @ self.votes / total
        cov = (self.votes * self.counts[:, None]).T @ self.votes / total - np.outer(mean, mean)
        n = len(mean)
        live = [k for k in range(n) if mean[k] * total >= 20]
        a = np.zeros(n)
        for i in live:
            ratios = sorted(cov[i, j] * cov[i, k] / cov[j, k] for j in live for k in live if j < k and i not in (j, k) and cov[j, k] > 0)
            if ratios:
                a[i] = np.sqrt(max(0.0, ratios[(len(ratios) - 1) // 2]))
        spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
        out = (cov - np.outer(a, a)) / np.outer(spread, spread)
        out[[k for k in range(n) if not a[k]], :] = 0
        out[:, [k for k in range(n) if not a[k]]] = 0
        return out

    def correlate(self, posterior: np.ndarray) -> np.ndarray:
        """Correlations given the class, averaged over the classes by their shares."""
        total = np.zeros((len(VOTERS), len(VOTERS)))
        for weight in (posterior, 1 - posterior):
            w = weight * self.counts
            mean = self.rate(weight)
            second = (self.votes * w[:, None]).T @ self.votes / (w.sum() + 1)
            spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-6))
            total += (second - np.outer(mean, mean)) / np.outer(spread, spread) * w.sum()
        return total / max(1.0, self.counts.sum())

    def group(self, correlations: np.ndarray) -> list[list[int]]:
        """Cliques of at most four voters, strongest pairs first."""
        root = list(range(len(VOTERS)))
        size = dict.fromkeys(root, 1)
        pairs = sorted(((correlations[i, j], i, j) for i in root for j in range(i)), reverse=True)

        def top(i: int) -> int:
            while root[i] != i:
                i = root[i]
            return i

        for value, i, j in pairs:
            a, b = top(i), top(j)
            if value > CORRELATED and a != b and size[a] + size[b] <= 4:
                root[a] = b
                size[b] += size[a]
        return [c for k in range(len(VOTERS)) if (c := [i for i in range(len(VOTERS)) if top(i) == k])]


def _buckets(word: bytes) -> tuple[int, ...]:
    return tuple(xxh3_64_intdigest(t, SEED) % BUCKETS for t in terms_of(word))


class Linear:
    """Logistic regression over the buckets of a text's distinct words and word starts."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    @staticmethod
    def train(texts: list[str], labels: np.ndarray, *, passes: int = 60, rate: float = 0.5, decay: float = 1e-4) -> "Linear":
        # only features that tell the classes apart in the sample, and the lexicons' words, get a weight
        corpus = _Corpus(texts)
        useful = np.zeros(BUCKETS, dtype=bool)
        useful[list(_telling(corpus, _buckets, np.asarray(labels, dtype=np.float64)))] = True
        useful[[xxh3_64_intdigest(w, SEED) % BUCKETS for w in _ABUSE]] = True
        names, runs = corpus.terms(_buckets, new=False, extra=[disguised(t, (w := words_of(t)), set(w)) for t in texts])
        bucket = np.array(names, dtype=np.int64)
        parts = [(text[some], term[some]) for text, term in runs for some in [useful[bucket[term]]]]
        owner, flat = np.concatenate([x for x, _ in parts]), bucket[np.concatenate([x for _, x in parts])]
        used, flat = np.unique(flat, return_inverse=True)
        y = np.asarray(labels)
        balance = np.where(y > 0.5, 0.5 / max(1.0, y.sum()), 0.5 / max(1.0, (1 - y).sum())) * len(y)
        w, b, seen = np.zeros(len(used)), -1.0, np.full(len(used), 1e-6)
        for _ in range(passes):
            p = 1 / (1 + np.exp(-np.clip(np.bincount(owner, w[flat], len(texts)) + b, -30, 30)))
            error = (p - y) * balance
            grad = np.bincount(flat, error[owner], len(used)) / len(y) + decay * w
            seen += grad**2
            w -= rate * grad / np.sqrt(seen)
            b -= rate * error.mean()
        weights = np.zeros(BUCKETS, dtype=np.float32)
        weights[used] = w
        return Linear(weights, float(b))


class _Scorer:
    """Scores texts; weights of words and of their starts are kept while there is room."""

    def __init__(self, model: Linear):
        self.weights, self.bias = model.weights, model.bias
        self.known: dict[bytes, tuple] = {}
        self.starts: dict[bytes, tuple] = {}

    def of_term(self, term: bytes) -> tuple:
        b = xxh3_64_intdigest(term, SEED) % BUCKETS
        return ((b, float(self.weights[b])),) if self.weights[b] else ()

    def of_word(self, word: bytes) -> tuple:
        terms, starts = terms_of(word), self.starts
        out = self.of_term(word)
        for t in terms[1:]:
            v = starts.get(t)
            if v is None:
                v = self.of_term(t)
                if len(starts) < _CACHE:
                    starts[t] = v
            out += v
        if len(self.known) < _CACHE:
            self.known[word] = out
        return out

    def __call__(self, text: str | None) -> float:
        split = words_of(text) if text else []
        if not split:
            return 0.0
        words = set(split)
        words |= disguised(text, split, words)
        get = self.known.get
        found: dict[int, float] = {}
        for w in words:
            v = get(w)
            if v is None:
                v = self.of_word(w)
            if v:
                found.update(v)
        z = sum(found[k] for k in sorted(found)) + self.bias
        return float(1 / (1 + np.exp(-min(30.0, max(-30.0, z)))))


def _texts_of(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> pa.Table:
    """(__id, ..., __t) of a bounded table of distinct ids: one text an id, in the order of ids."""
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__t")).where("__t is not null").join(F.broadcast(ids), "__id")
    columns = [F.first(c).alias(c) for c in ids.columns if c != "__id"]
    return texts.groupBy("__id").agg(F.min_by("__t", F.xxhash64("__t")).alias("__t"), *columns).toArrow().sort_by("__id")


class Toxicity:
    """What scores texts: the classifier or, where there is none, the voters with the label model's posteriors."""

    def __init__(self, linear: Linear | None, model: LabelModel | None, induced: list[bytes]):
        self.linear, self.model, self.induced = linear, model, induced

    def scorer(self) -> Callable[[str | None], float]:
        if self.linear is not None:
            return _Scorer(self.linear)
        if self.model is None:
            return lambda text: 0.0
        voters, by_mask = Voters(self.induced), self.model.by_mask
        return lambda text: by_mask.get(voters(text), 0.0) if text and words_of(text) else 0.0


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS, pool_rows: int = POOL_ROWS, seed: int = SEED) -> Toxicity:
    """The classifier and the label model. Gathered are at most `sample_rows` labelled rows of either class, the ids and
    votes of about `pool_rows` rows, and the texts of at most half of `sample_rows` of these on either side."""
    spark = docs.sparkSession
    known = labels.select(F.col(id_col).alias("__id"), F.col(label_col).alias("__y")).where("__id is not null and __y is not null").groupBy("__id").agg((F.max("__y") > 0).cast("int").alias("__y"))
    sample = bounded_sample(known.where("__y = 1"), "__id", sample_rows, seed).unionByName(bounded_sample(known.where("__y = 0"), "__id", sample_rows, seed))
    rows = _texts_of(docs, sample, id_col, text_col)
    texts, gold, taken = rows["__t"].to_pylist(), rows["__y"].to_pylist(), set(rows["__id"].to_pylist())
    del rows
    induced = induce_lexicon(texts, gold) if len(set(gold)) == 2 else []
    shared = spark.sparkContext.broadcast(induced)

    def make():
        voters = Voters(shared.value)
        return lambda batch: pa.array([voters(t) for t in batch], pa.int32())

    place = F.xxhash64(F.lit(seed), F.col(id_col))
    pooled = place <= F.lit(hash_bound(min(1.0, pool_rows / max(1, docs.count()))))
    votes = docs.select(F.when(pooled, F.col(id_col)).alias("__id"), text_udf(make, "int")(F.col(text_col)).alias("v")).groupBy("__id", "v").count().toArrow()
    if not votes.num_rows:
        return Toxicity(None, None, induced)
    v = votes["v"].to_numpy()
    masks, where = np.unique(v, return_inverse=True)
    model = LabelModel(masks, np.bincount(where, votes["count"].to_numpy()))
    likely = np.array([model.by_mask[m] for m in masks.tolist()])[where] >= 0.5
    picked = votes["__id"].to_pylist()
    # `picked` is sorted by a hash of its own, as the rows of a result come in any order
    order = sorted((k for k, i in enumerate(picked) if i is not None and i not in taken), key=lambda k: (xxh3_64_intdigest(str(picked[k]), seed), str(picked[k]), v[k]))
    chosen = dict.fromkeys(picked[k] for side in (True, False) for k in [k for k in order if likely[k] == side][: sample_rows // 2])
    if chosen:
        kind = docs.select(F.col(id_col).alias("__id")).schema
        more = _texts_of(docs, spark.createDataFrame([(i,) for i in chosen], kind), id_col, text_col)
        texts += more["__t"].to_pylist()
    voters = Voters(induced)
    posterior = np.array([model.by_mask.get(voters(t), 0.0) for t in texts])
    told = len(posterior) and posterior.max() >= 0.5 and posterior.min() <= 0.5
    return Toxicity(Linear.train(texts, posterior) if told else None, model, induced)


def score_toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, **training) -> DataFrame:
    """(id, toxicity, is_toxic) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(fit_toxicity(docs, labels, id_col=id_col, text_col=text_col, **training))

    def make():
        fitted = shared.value
        if not hasattr(fitted, "held"):  # kept with the model while the worker lives
            fitted.held = fitted.scorer()
        score = fitted.held
        return lambda batch: pa.array([score(t) for t in batch], pa.float64())

    scored = docs.select(id_col, text_udf(make, "double")(F.col(text_col)).alias("toxicity"))
    return scored.select(id_col, "toxicity", (F.col("toxicity") >= threshold).alias("is_toxic"))


def find_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of score_toxicity that are toxic."""
    return score_toxicity(docs, labels, **options).where("is_toxic")
