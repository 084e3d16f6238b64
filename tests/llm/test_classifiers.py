import random
import time
import tracemalloc

import numpy as np
import pytest

from hgspark.llm import language_id as L
from hgspark.llm import quality as Q
from hgspark.llm import toxicity as X


def words(rng, n, letters="abdefgiklmnoprstu"):
    return ["".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(n)]


def labelled(n=300, seed=1):
    """(id, text, quality, toxic): junk is shouted, toxic texts hold abuse, some of it only with invented endings."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        text, quality, toxic = words(rng, rng.randint(20, 60)), 1, 0
        if i % 4 == 0:
            text, quality = [w.upper() + "!!" for w in text], 0
        if i % 5 == 0:
            toxic = 1
            for _ in range(3):
                text.insert(rng.randrange(len(text)), rng.choice(["idiot", "scum", "zlorb" + "".join(words(rng, 1))]))
        rows.append((i, " ".join(text), quality, toxic))
    return rows


@pytest.fixture(scope="module")
def tables(spark):
    rows = labelled()
    docs = spark.createDataFrame([(r[0], r[1]) for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2], r[3]) for r in rows if r[0] < 200], "doc_id long, quality int, toxic int")
    return docs, labels, rows


def test_quality_on_held_out_rows(tables):
    docs, labels, rows = tables
    got = {r.doc_id: r.keep for r in Q.score_quality(docs, labels).collect()}
    held = [r for r in rows if r[0] >= 200]
    assert np.mean([got[r[0]] == (r[2] == 1) for r in held]) > 0.97
    kept = {r.doc_id for r in Q.keep_good(docs, labels).collect()}
    assert kept == {k for k, v in got.items() if v}


def test_cached_scores_match_plain_features():
    rows = labelled(60)
    m = Q.SubwordModel.train([r[1] for r in rows], [r[2] for r in rows])
    texts = [rows[0][1], "", None, "one", rows[1][1], "  "]
    got = m.probabilities(texts)
    for t, p in zip(texts, got, strict=True):
        f = Q.features(t)
        z = (m.scores[f].astype(np.float64).mean(axis=0) if len(f) else 0) + m.bias
        e = np.exp(z - z.max())
        assert p == pytest.approx(e / e.sum(), abs=1e-4)


def test_sample_is_bounded_and_the_same_however_split(tables):
    docs, labels, _ = tables
    a = Q.train_quality(docs, labels, train_rows=50)
    b = Q.train_quality(docs.repartition(7), labels.repartition(3), train_rows=50)
    assert np.array_equal(a.scores, b.scores)


def test_toxicity_on_held_out_rows(tables):
    docs, labels, rows = tables
    got = {r.doc_id: r.is_toxic for r in X.score_toxicity(docs, labels).collect()}
    held = [r for r in rows if r[0] >= 200]
    assert np.mean([got[r[0]] for r in held if r[3]]) > 0.9
    assert np.mean([got[r[0]] for r in held if not r[3]]) < 0.02
    assert {r.doc_id for r in X.find_toxic(docs, labels).collect()} == {k for k, v in got.items() if v}


def test_label_model_recovers_accuracies_and_correlation():
    rng = np.random.default_rng(1)
    n, k = 60_000, len(X.VOTERS)
    y = rng.random(n) < 0.2
    rates = [(0.8, 0.02), (0.6, 0.01), (0.7, 0.03), (0.5, 0.02)]
    votes = np.zeros((n, k), dtype=np.int64)
    for j, (a, b) in enumerate(rates):
        votes[:, j] = rng.random(n) < np.where(y, a, b)
    votes[:, 4] = np.where(rng.random(n) < 0.95, votes[:, 0], 1 - votes[:, 0])  # nearly a copy of voter 0
    masks, counts = np.unique(votes @ (1 << np.arange(k)), return_counts=True)
    m = X.LabelModel(masks, counts)
    for j, (a, b) in enumerate(rates):
        got = m.accuracies[X.VOTERS[j]]
        assert got[0] == pytest.approx(a, abs=0.08)
        assert got[1] == pytest.approx(b, abs=0.03)
    assert any({0, 4} <= set(c) for c in m.cliques)


def test_copies_do_not_make_a_lexicon():
    rng = random.Random(5)
    copy = " ".join(words(rng, 60))
    texts = [copy] * 30 + [" ".join(words(rng, 40)) for _ in range(60)]
    assert X.induce_lexicon(texts, [1] * 30 + [0] * 60) == []


def test_terms_match_plain_counts():
    """The counts by arrays against sets of terms by text."""
    rng = random.Random(9)
    texts = [" ".join(rng.choices(["idiotic", "idiots", "a", "house", "zlorbs", "zlorbed", "the"], k=rng.randint(0, 9))) for _ in range(700)]
    corpus = X._Corpus(texts)
    seen, want = set(), []
    for t in texts:
        w = [b"", *X.words_of(t), b""]
        fresh = {x for x in zip(w, w[1:], w[2:], strict=False)} - seen
        seen |= fresh
        want.append({k for x in fresh for k in X.terms_of(x[1])})
    for new, sets in ((True, want), (False, [{k for w in X.words_of(t) for k in X.terms_of(w)} for t in texts])):
        names, runs = corpus.terms(X.terms_of, new)
        got = [set() for _ in texts]
        for text, term in runs:
            for a, b in zip(text.tolist(), term.tolist(), strict=True):
                assert names[b] not in got[a]
                got[a].add(names[b])
        assert got == sets


def test_training_holds_little_for_each_word_and_nothing_afterwards():
    rng = random.Random(12)
    known = words(rng, 30_000, "abdefgiklmnoprstuvwxyz")
    texts = [" ".join(rng.choices(known, k=400)) for _ in range(1500)]
    tracemalloc.start()
    try:
        corpus = X._Corpus(texts)
        peak = tracemalloc.get_traced_memory()[1]
        assert peak < 30 * len(corpus.flat)
        del corpus
        before = tracemalloc.get_traced_memory()[0]
        model = X.Linear.train(texts[:300], np.arange(300) % 2)
        assert tracemalloc.get_traced_memory()[0] - before < model.weights.nbytes + 1_000_000
    finally:
        tracemalloc.stop()


def test_first_places_over_runs_and_parts(monkeypatch):
    monkeypatch.setattr(X, "_RUN", 7)
    rng = random.Random(13)
    for texts in ([], [""], ["a"], [" ".join(rng.choices("abcd", k=rng.randint(0, 12))) for _ in range(90)]):
        seen, want = set(), []
        for t in texts:
            w = [b"", *X.words_of(t), b""]
            places = list(zip(w, w[1:], w[2:], strict=False))
            want.append(False)
            for x in places:
                want.append(x not in seen)
                seen.add(x)
            want += [False] * (len(w) - 1 - len(places))
        assert X._Corpus(texts).new.tolist() == want


def test_posterior_matches_a_sum_over_classes():
    """The fixed point of the label model on a small table of votes, with every step written out."""
    k = len(X.VOTERS)
    votes = [(0, 900), (0b1, 30), (0b11, 40), (0b111, 25), (0b100, 20)]
    m = X.LabelModel(np.array([v for v, _ in votes]), np.array([n for _, n in votes]))
    for mask, _ in votes:
        bad = sum(n * m.by_mask[v] for v, n in votes)
        total = sum(n for _, n in votes)
        share = min(0.5, (bad + 1e-3) / (total + 1))
        odds = np.log(share / (1 - share))
        for clique in m.cliques:
            state = lambda v, c=clique: sum((v >> j & 1) << i for i, j in enumerate(c))
            cells = 1 << len(clique)
            tables = []
            for y in (0, 1):
                table = [sum(n * (m.by_mask[v] if y else 1 - m.by_mask[v]) for v, n in votes if state(v) == s) + 0.5 / cells for s in range(cells)]
                table[0] += 0 if y else X.CALM_ROWS
                tables.append(np.log(np.array(table) / sum(table)))
            ratio = float(tables[1][state(mask)] - tables[0][state(mask)])
            if len(clique) == 1:
                ratio = max(ratio, 0) if state(mask) else min(ratio, 0)
            odds += ratio
        assert m.by_mask[mask] == pytest.approx(1 / (1 + np.exp(-odds)), abs=1e-3)
    assert sorted(x for c in m.cliques for x in c) == list(range(k))
    assert m.by_mask[0] < 0.1 < 0.9 < m.by_mask[0b111]


def abusive(rng, n):
    return [" ".join(words(rng, 15) + ["you", "stupid", "idiot", "go", "die"] + words(rng, 5)) for _ in range(n)]


def test_classes_missing_from_labels_do_not_matter(spark):
    rng = random.Random(4)
    calm, rude = [" ".join(words(rng, 25)) for _ in range(200)], abusive(rng, 60)
    table = lambda texts: spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    label = lambda rows: spark.createDataFrame(rows, "doc_id long, toxic int")
    assert X.find_toxic(table(rude[:40]), label([(i, 1) for i in range(40)])).count() == 40
    for rows in ([(i, 0) for i in range(20)], []):
        assert sorted(r.doc_id for r in X.find_toxic(table(calm + rude), label(rows)).collect()) == list(range(200, 260))
    nameless = table(calm + rude).selectExpr("cast(null as long) as doc_id", "text")
    assert X.find_toxic(nameless, label([])).count() == 60
    assert X.find_toxic(table(calm), label([(i, i % 2) for i in range(0)])).count() == 0


def test_pattern_voters():
    vote = X.Voters([])
    names = lambda t: {v for k, v in enumerate(X.VOTERS) if vote(t) >> k & 1}
    assert "addressed" in names("You are an idiot")
    assert "threat" in names("just SHUT up now")
    assert "disguised" in names("such an 1d1ot")
    assert "disguised" in names("what an i.d.i.o.t he is")
    assert "piled" in names("stupid clown")
    for t in ("what sh!t", "you a$$hole!!", "an @sshole", "1d!ot"):
        assert "disguised" in names(t), t
    assert "disguised" not in names("stop! $5 a@b.com !!!! 1 2 3 4")
    assert names("a kind word, you see") == names("") == names(None) == set()


SAMPLES = {"en": "the quick brown fox jumps over the lazy dog and then the other one of them with that", "de": "der schnelle braune fuchs springt ueber den faulen hund und dann der andere mit dem", "fr": "le rapide renard brun saute par dessus le chien paresseux et puis les autres avec une"}


def brute(word, logp, number, longest):
    """Log sum over all cuts by recursion."""
    if not word:
        return np.zeros(logp.shape[1])
    out = None
    for n in range(1, min(longest, len(word)) + 1):
        piece = number.get(word[:n])
        if piece is None and n == 1:
            piece = len(number)
        if piece is not None:
            rest = brute(word[n:], logp, number, longest) + logp[piece]
            out = rest if out is None else np.logaddexp(out, rest)
    return out


def test_forward_sums_all_cuts():
    m = L.LanguageModel.train({k: [v] for k, v in SAMPLES.items()}, L.load_pieces(L.VOCABULARY))
    s = L.Scorer(m)
    number, longest = {p: i for i, p in enumerate(m.pieces)}, max(map(len, m.pieces))
    for w in ("the", "springt", "x", "日本", "zzz\U0001f600qu", "renard"):
        want = brute(L.MARK + w, m.logp, number, longest)
        assert s.totals([L.MARK + w])[0] == pytest.approx(want, rel=1e-9)
        assert L.Lattices([L.MARK + w], number, longest).totals(m.logp)[0] == pytest.approx(want, rel=1e-9)
    assert np.isfinite(s.totals(["日" * 3000, "a" * L.SHORT, "\U0001f600" * L.SHORT])).all()


def test_long_words_in_windows_match_logarithms():
    m = L.LanguageModel.train({k: [v] for k, v in SAMPLES.items()}, L.load_pieces(L.VOCABULARY))
    s, rng = L.Scorer(m), random.Random(6)
    number, longest = {p: i for i, p in enumerate(m.pieces)}, max(map(len, m.pieces))
    glued = "".join(" ".join(SAMPLES.values()).split())
    words = ["".join(rng.choices(letters, k=n)) for n in (33, 34, 63, 64, 65, 96, 97, 150, 333) for letters in (glued, "日本語\U0001f600\x00a", "the")]
    words += [glued, glued * 7, "\U0001f600" * 100, "a" * 129, "short"]
    assert s.totals(words) == pytest.approx(L.Lattices(words, number, longest).totals(m.logp), rel=1e-9)


def test_text_without_blanks_takes_time_in_proportion():
    m = L.LanguageModel.train({k: [v] for k, v in SAMPLES.items()}, L.load_pieces(L.VOCABULARY))
    s = L.Scorer(m)
    began = time.perf_counter()
    scores, words = s(["".join(random.Random(1).choices("".join(SAMPLES.values()).replace(" ", ""), k=400_000))])
    assert np.isfinite(scores).all()
    assert time.perf_counter() - began < 20


def test_training_raises_likelihood():
    pieces = L.load_pieces(L.VOCABULARY)
    scores = []
    for rounds in (1, 2, 4):
        m = L.LanguageModel.train({"en": [SAMPLES["en"]]}, pieces, rounds)
        scores.append(L.Scorer(m)([SAMPLES["en"]])[0][0, 0])
    assert scores == sorted(scores)


def test_languages_on_held_out_rows(spark):
    rng = random.Random(2)
    rows = []
    for i in range(240):
        lang = ("en", "de", "fr")[i % 3]
        rows.append((i, " ".join(rng.choices(SAMPLES[lang].split(), k=8)), lang if i < 120 else None))
    got = {r.doc_id: r.language for r in L.identify_language(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert np.mean([got[i] == ("en", "de", "fr")[i % 3] for i in range(120, 240)]) > 0.97


def test_odd_rows(spark, odd_docs, odd_rows, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 1, 0), (None, 1, 1), (20, None, None), (21, 0, 1), (6, 1, 0)], "doc_id long, quality int, toxic int")
    n = len(odd_rows)
    scored = Q.score_quality(odd_docs, labels).collect()
    assert len(scored) == n
    assert not any(r.keep for r in scored if r.doc_id in (3, 4, 5))
    assert Q.keep_good(odd_docs, labels).columns == odd_docs.columns
    assert all(r.quality_probability in (0.0, 1.0) for r in Q.score_quality(odd_docs, labels.limit(0)).collect())
    tox = X.score_toxicity(odd_docs, labels).collect()
    assert len(tox) == n
    assert all(r.toxicity == 0 for r in tox if r.doc_id in (3, 4, 5, 8))
    # among 60,000 random words are some of abuse
    assert {r.doc_id for r in X.find_toxic(odd_docs, labels.limit(0)).collect()} <= {6}
    lang = {r.doc_id: r.language for r in L.identify_language(odd_docs).collect()}
    assert lang[3] is lang[4] is lang[5] is None
    assert lang[6] == "en"
    for f in (lambda: Q.score_quality(no_docs, labels), lambda: X.score_toxicity(no_docs, labels), lambda: L.identify_language(no_docs), lambda: Q.keep_good(no_docs, labels)):
        assert f().count() == 0
    same = [r for r in scored if r.doc_id == 2]
    assert len(same) == 2
    assert same[0] == same[1]


def test_without_labels_no_language(spark):
    df = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert L.identify_language(df).first().language is None
