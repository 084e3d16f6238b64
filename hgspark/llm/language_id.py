"""Language identification by unigram piece models that sum over all segmentations.

The vocabulary is fixed: the pieces of a public tokenizer file. A text is lower-cased and split at white space; a word,
with the mark that begins words, may be cut into pieces in many ways, a cut's probability under a language is the product
of its pieces' probabilities, and the word's is the sum over all cuts (forward algorithm, in logarithms). A text's score
in a language is the sum over its words. A character outside the vocabulary is a piece of its own with probability FLOOR.

Piece probabilities of each language come from expectation maximisation (forward-backward) over the words of a bounded
sample of rows with a language label: ROWS_PER_LANGUAGE a language, those with the smallest hash of their id. The
vocabulary is never trained. Tasks score a word once while it stays in a bounded cache.

Words of up to SHORT characters are scored side by side with others of their length, longer ones (text without blanks) in
windows of SHORT characters, whose effects on the sums are found side by side too and then applied one after the other.

Defined results: null, empty and blank texts get a null language and score; a text, and a word in it, of any length is
scored whole; equal scores (ties) go to the first language in alphabetical order; a repeated row is scored like the first
and learned from once; a row whose label is null is scored like any other but isn't learned from, nor is one without id;
without any label every language is null; an empty table gives no rows; columns besides those that are read don't matter,
whatever their names.
"""

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import text_udf

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
ROWS_PER_LANGUAGE = 250
ROUNDS = 3
FLOOR = 1e-9
SMOOTHING = 0.01
SEED = 5
MARK = "▁"
SHORT = 32
_SLOTS = 19
_WINDOWS = 1024
#: A code that no character has.
_NO_CODE = np.uint64(1 << 31)
#: In windows every character's chance is multiplied by this, halfway between a frequent and an unknown one, so that products
#: over SHORT and a piece's characters stay within double precision either way.
_LIFT = 5e4
_STEP = np.uint64(0x9E3779B97F4A7C15)
_CACHE = 300_000


def load_pieces(path: str) -> list[str]:
    """The vocabulary's pieces without control, unknown and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return sorted({model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))})


class Lattices:
    """All pieces at all places of some words: edges (word, start, end, piece), ordered by end, then word."""

    def __init__(self, words: list[str], number: dict[str, int], longest: int):
        flat: list[int] = []
        add, get = flat.extend, number.get
        unknown = len(number)
        for w, word in enumerate(words):
            n = len(word)
            for i in range(n):
                known = False
                for j in range(i + 1, min(n, i + longest) + 1):
                    piece = get(word[i:j])
                    if piece is not None:
                        add((w, i, j, piece))
                        known = known or j == i + 1
                if not known:
                    add((w, i, i + 1, unknown))
        edges = np.array(flat, dtype=np.int64).reshape(-1, 4)
        self.edges = edges[np.lexsort((edges[:, 0], edges[:, 2]))]
        self.lengths = np.array([len(w) for w in words], dtype=np.int64)
        self.start = np.cumsum(self.lengths + 1) - self.lengths - 1  # a word's place 0 among all words' places
        self.places = int((self.lengths + 1).sum())

    def _sweep(self, order: np.ndarray, by: np.ndarray, frm: np.ndarray, to: np.ndarray, logp: np.ndarray, out: np.ndarray) -> None:
        cuts = np.flatnonzero(np.diff(by)) + 1
        for part in np.split(order, cuts):
            target = to[part]
            value = out[frm[part]] + logp[self.edges[part, 3]]
            heads = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1]]))
            peak = np.maximum.reduceat(value, heads, axis=0)
            sizes = np.diff(np.append(heads, len(part)))
            out[target[heads]] = peak + np.log(np.add.reduceat(np.exp(value - np.repeat(peak, sizes, axis=0)), heads, axis=0))

    def forward(self, logp: np.ndarray) -> np.ndarray:
        """Log sums over all cuts of each word's beginnings; logp: pieces x languages."""
        out = np.full((self.places, logp.shape[1]), -np.inf)
        out[self.start] = 0
        e = self.edges
        if len(e):
            self._sweep(np.arange(len(e)), e[:, 2], self.start[e[:, 0]] + e[:, 1], self.start[e[:, 0]] + e[:, 2], logp, out)
        return out

    def totals(self, logp: np.ndarray) -> np.ndarray:
        return self.forward(logp)[self.start + self.lengths]

    def expected(self, logp: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected counts of pieces (in one language) in words that occur `weight` times."""
        e, ahead = self.edges, self.forward(logp)
        if not len(e):
            return np.zeros(len(logp))
        back = np.full_like(ahead, -np.inf)
        back[self.start + self.lengths] = 0
        order = np.lexsort((e[:, 0], -e[:, 1]))
        self._sweep(order, e[order, 1], self.start[e[:, 0]] + e[:, 2], self.start[e[:, 0]] + e[:, 1], logp, back)
        whole = ahead[self.start + self.lengths]
        share = np.exp(ahead[self.start[e[:, 0]] + e[:, 1]] + logp[e[:, 3]] + back[self.start[e[:, 0]] + e[:, 2]] - whole[e[:, 0]])[:, 0]
        return np.bincount(e[:, 3], share * weight[e[:, 0]], len(logp))


class LanguageModel:
    def __init__(self, languages: list[str], pieces: list[str], logp: np.ndarray):
        self.languages, self.pieces, self.logp = languages, pieces, logp

    @staticmethod
    def train(samples: dict[str, list[str]], pieces: list[str], rounds: int = ROUNDS) -> "LanguageModel":
        number, longest = {p: i for i, p in enumerate(pieces)}, max(map(len, pieces), default=1)
        columns = []
        for language in sorted(samples):
            words = Counter(w for t in samples[language] for w in t.lower().split())
            keys = sorted(words)
            lattice = Lattices([MARK + w for w in keys], number, longest)
            weight = np.array([words[w] for w in keys], dtype=np.float64)
            logp = np.full((len(pieces) + 1, 1), -np.log(len(pieces) + 1))
            for _ in range(rounds):
                count = lattice.expected(logp, weight)[:-1] + SMOOTHING
                logp = np.append(np.log(count / count.sum()), np.log(FLOOR))[:, None]
            columns.append(logp)
        return LanguageModel(sorted(samples), pieces, np.concatenate(columns, axis=1) if columns else np.zeros((len(pieces) + 1, 0)))


def _hashes(codes: np.ndarray, seed: int) -> np.ndarray:
    """Hash of each row of character codes."""
    out = np.full(len(codes), seed, dtype=np.uint64)
    for k in range(codes.shape[1]):
        out = (out ^ codes[:, k]) * _STEP
        out ^= out >> np.uint64(29)
    return out


class PieceTable:
    """Pieces by hash: a table of slots, and a second one for pieces whose slot another piece has."""

    def __init__(self, pieces: list[str]):
        self.none, self.longest = len(pieces), max(map(len, pieces), default=1)
        by_length: dict[int, list[int]] = {}
        for k, piece in enumerate(pieces):
            by_length.setdefault(len(piece), []).append(k)
        for seed in range(1, 100):
            keys = np.empty(len(pieces), dtype=np.uint64)
            for where in by_length.values():
                keys[where] = _hashes(_codes([pieces[k] for k in where]), seed)
            if len(np.unique(keys)) < len(keys):
                continue
            slot = keys >> np.uint64(64 - _SLOTS)
            first = np.unique(slot, return_index=True)[1]
            rest = np.setdiff1d(np.arange(len(keys)), first)
            again = (keys[rest] & np.uint64((1 << _SLOTS) - 1))
            if len(np.unique(again)) == len(again):
                break
        else:
            raise ValueError("no seed places all pieces")
        self.seed = seed
        self.keys, self.ids = np.zeros((2, 1 << _SLOTS), dtype=np.uint64), np.full((2, 1 << _SLOTS), self.none, dtype=np.int32)
        self.keys[0, slot[first]], self.ids[0, slot[first]] = keys[first], first
        self.keys[1, again], self.ids[1, again] = keys[rest], rest

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Piece numbers, `none` where there is no such piece."""
        slot = hashes >> np.uint64(64 - _SLOTS)
        out = np.where(self.keys[0][slot] == hashes, self.ids[0][slot], self.none)
        slot = hashes & np.uint64((1 << _SLOTS) - 1)
        return np.where(self.keys[1][slot] == hashes, self.ids[1][slot], out)


def _codes(words: list[str]) -> np.ndarray:
    """Character codes of words of one length, a row a word."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4").reshape(len(words), -1).astype(np.uint64)


def _ahead(codes: np.ndarray, table: PieceTable, p: np.ndarray) -> np.ndarray:
    """Sums over all cuts of the beginnings of words of one length: places x words x languages."""
    n, words = codes.shape[1], len(codes)
    ahead = np.zeros((n + 1, words, p.shape[1]))
    ahead[0] = 1
    running = [np.full(words, table.seed, dtype=np.uint64) for _ in range(n)]
    found: list[list[np.ndarray | None]] = [[None] * (n + 1) for _ in range(n)]
    single = np.zeros((n, words), dtype=bool)
    for start in range(n):
        h = running[start]
        for size in range(1, min(table.longest, n - start) + 1):
            h = (h ^ codes[:, start + size - 1]) * _STEP
            h ^= h >> np.uint64(29)
            ids = table.find(h)
            if size == 1:
                single[start] = ids != table.none
                found[start][start + 1] = ids
            elif (ids != table.none).any():
                found[start][start + size] = ids
    for stop in range(1, n + 1):
        for start in range(max(0, stop - table.longest), stop):
            ids = found[start][stop]
            if ids is None:
                continue
            if stop == start + 1:
                ahead[stop] += ahead[start] * np.where(single[start][:, None], p[ids], FLOOR)
            else:
                some = np.flatnonzero(ids != table.none)
                ahead[stop][some] += ahead[start][some] * p[ids[some]]
    return ahead


def totals_of_length(words: list[str], table: PieceTable, p: np.ndarray) -> np.ndarray:
    """Log sums over all cuts of words that have one length of at most SHORT characters, so that a product of their
    pieces' probabilities p (pieces, and a row of zeros, x languages) can't vanish."""
    return np.log(_ahead(_codes(words), table, p)[-1])


def _transfers(codes: np.ndarray, table: PieceTable, p: np.ndarray) -> np.ndarray:
    """What windows of SHORT characters do to (lifted) sums: windows x languages x (places at the end, places at the start). A
    window's sums hang on those of the last `longest` places before it; its codes begin with the longest - 1 characters
    before it, as pieces may lie across its start."""
    reach, windows = table.longest, len(codes)
    out = np.zeros((reach + SHORT, reach, windows, p.shape[1]))
    for s in range(reach):
        out[s, s] = 1
    ends: list[list[tuple[int, np.ndarray, np.ndarray]]] = [[] for _ in range(reach + SHORT)]
    for start in range(reach + SHORT - 1):
        h = np.full(windows, table.seed, dtype=np.uint64)
        for size in range(1, min(reach, reach + SHORT - 1 - start) + 1):
            h = (h ^ codes[:, start + size - 1]) * _STEP
            h ^= h >> np.uint64(29)
            if start + size >= reach:
                ids = table.find(h)
                known = ids != table.none
                if size == 1:
                    ends[start + 1].append((start, np.arange(windows), _LIFT * np.where(known[:, None], p[ids], FLOOR)))
                elif known.any():
                    some = np.flatnonzero(known)
                    ends[start + size].append((start, some, _LIFT**size * p[ids[some]]))
    for stop in range(reach, reach + SHORT):
        for start, some, chance in ends[stop]:
            if start < reach:
                out[stop, start, some] += chance
            elif len(some) == windows:
                out[stop] += out[start] * chance
            else:
                out[stop][:, some] += out[start][:, some] * chance
    return out[SHORT:].transpose(2, 3, 0, 1)


def totals_of_long(words: list[str], table: PieceTable, p: np.ndarray) -> np.ndarray:
    """The same for words of any lengths above SHORT: a head of at most SHORT characters, then windows of SHORT. All
    windows' transfers are found side by side, then a word's sums are carried through them, scaled at every step."""
    reach, languages = table.longest, p.shape[1]
    heads = np.array([(len(w) - 1) % SHORT + 1 for w in words])
    state, log = np.zeros((len(words), languages, reach)), np.zeros((len(words), languages))
    for head in np.unique(heads).tolist():
        where = np.flatnonzero(heads == head)
        last = _ahead(_codes([words[k][:head] for k in where]), table, p)[-reach:]
        lifted = last * _LIFT ** np.arange(head + 1 - len(last), head + 1.0)[:, None, None]
        state[where, :, reach - len(last) :] = lifted.transpose(1, 2, 0)
    codes, owner, turn = [], [], []
    for k, w in enumerate(words):
        padded = np.concatenate([np.full(reach - 1, _NO_CODE), _codes([w])[0]])
        starts = np.arange(heads[k], len(w), SHORT)
        codes.append(padded[starts[:, None] + np.arange(reach - 1 + SHORT)])
        owner.append(np.full(len(starts), k))
        turn.append(np.arange(len(starts)))
    codes, owner, turn = np.concatenate(codes), np.concatenate(owner), np.concatenate(turn)
    order = np.argsort(turn, kind="stable")  # all words' first windows, then their second ones
    for a in range(0, len(order), _WINDOWS):
        part = order[a : a + _WINDOWS]
        moved = _transfers(codes[part], table, p)
        cuts = np.flatnonzero(np.diff(turn[part])) + 1
        for own, step in zip(np.split(owner[part], cuts), np.split(moved, cuts), strict=True):
            now = (step @ state[own][..., None])[..., 0]
            top = now.max(axis=2, keepdims=True)
            state[own] = now / top
            log[own] += np.log(top[..., 0])
    return log + np.log(state[:, :, -1]) - np.array([len(w) for w in words])[:, None] * np.log(_LIFT)


class Scorer:
    """Texts' log probabilities by language."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self.pieces = PieceTable(model.pieces)
        self.p = np.exp(model.logp)
        self.p[-1] = 0
        self.clear()

    def totals(self, words: list[str]) -> np.ndarray:
        """Log sums over all cuts of words, in time that grows with their characters."""
        out = np.empty((len(words), len(self.model.languages)))
        by_length: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            by_length.setdefault(len(w) if len(w) <= SHORT else 0, []).append(k)
        for length, where in by_length.items():
            part = [words[k] for k in where]
            for a in range(0, len(part), 8192):
                few = part[a : a + 8192]
                out[where[a : a + 8192]] = (totals_of_length if length else totals_of_long)(few, self.pieces, self.p)
        return out

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.table = np.empty((0, len(self.model.languages)))

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(scores, numbers of words)"""
        if len(self.known) > _CACHE:
            self.clear()
        known = self.known
        split = [t.lower().split() if t else [] for t in texts]
        lengths = np.array([len(s) for s in split], dtype=np.int64)
        fresh = list({w for s in split for w in s if w not in known})
        if fresh:
            for w in fresh:
                known[w] = len(known)
            self.table = np.concatenate([self.table, self.totals([MARK + w for w in fresh])])
        ids = np.fromiter((known[w] for s in split for w in s), dtype=np.int64, count=int(lengths.sum()))
        out, some = np.zeros((len(texts), len(self.model.languages))), np.flatnonzero(lengths)
        if len(some):
            out[some] = np.add.reduceat(self.table[ids], (np.cumsum(lengths) - lengths)[some], axis=0)
        return out, lengths


def train_languages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", vocabulary: str = VOCABULARY, rows_per_language: int = ROWS_PER_LANGUAGE, seed: int = SEED) -> LanguageModel:
    turn = Window.partitionBy("__l").orderBy(F.xxhash64(F.lit(seed), F.col("__id")), "__id")
    names = docs.select(F.col(lang_col).cast("string").alias("__l"), F.col(id_col).alias("__id")).where("__l is not null and __id is not null")
    picked = names.select("*", F.row_number().over(turn).alias("__k")).where(F.col("__k") <= rows_per_language).select("__l", "__id").distinct()
    texts = docs.select(F.col(id_col).alias("__id"), F.col(lang_col).cast("string").alias("__l"), F.col(text_col).alias("__t")).where("__t is not null")
    rows = texts.join(F.broadcast(picked), ["__l", "__id"]).dropDuplicates(["__l", "__id", "__t"]).toArrow()
    samples: dict[str, list[str]] = {}
    for language, text in sorted(zip(rows["__l"].to_pylist(), rows["__t"].to_pylist(), strict=True)):
        samples.setdefault(language, []).append(text)
    return LanguageModel.train(samples, load_pieces(vocabulary))


def identify_language(docs: DataFrame, model: LanguageModel | None = None, *, id_col: str = "doc_id", text_col: str = "text", **training) -> DataFrame:
    """(id, language, log_probability of a word on average, margin to the next language, the same way) for every row."""
    model = model or train_languages(docs, id_col=id_col, text_col=text_col, **training)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.struct([("language", pa.string()), ("log_probability", pa.float64()), ("margin", pa.float64())])

    def make():
        model = shared.value
        if not hasattr(model, "scorer"):  # kept with the model while the worker lives
            model.scorer = Scorer(model)
        scorer, names = model.scorer, model.languages

        def kernel(texts: list) -> pa.Array:
            if not texts or not names:
                return pa.array([{"language": None}] * len(texts), kind)
            scores, words = scorer(texts)
            best = scores.argmax(axis=1)
            ranked = np.sort(scores, axis=1)
            n = np.maximum(words, 1)
            none = words == 0
            margin = (ranked[:, -1] - ranked[:, -2]) / n if len(names) > 1 else np.zeros(len(texts))
            return pa.StructArray.from_arrays([pa.array([names[b] for b in best], mask=none), pa.array(ranked[:, -1] / n, mask=none), pa.array(margin, mask=none)], fields=list(kind))

        return kernel

    found = docs.select(id_col, text_udf(make, "language string, log_probability double, margin double")(F.col(text_col)).alias("__found"))
    return found.select(id_col, "__found.language", "__found.log_probability", "__found.margin")
