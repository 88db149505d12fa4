"""The trained operators and mixing against slow, plain versions of the whole calculation, row by row."""

import math
import random
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest

from trialweave.llm import language_id, mixing, nb_classifiers
from trialweave.llm.grams import Grams


def ngrams(text, chars, words):
    out = Counter()
    for n in chars:
        out.update(("c", text.lower()[i : i + n]) for i in range(len(text) - n + 1))
    w = text.lower().split()
    for n in words:
        out.update(("w", *w[i : i + n]) for i in range(len(w) - n + 1))
    return out


def chosen(rows, per_label, salt):
    """Distinct (label, text) in the order of the sample: by place within the label, then by label."""
    out = []
    for label in sorted({y for y, _ in rows}):
        keys = {t: brute.spark_hash(t) for y, t in rows if y == label}
        order = sorted(keys, key=lambda t: (brute.spark_hash(brute.Int(salt), keys[t]), keys[t]))
        out += [(place, label, t) for place, t in enumerate(order[:per_label])]
    return [(y, t) for _, y, t in sorted(out)]


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@pytest.fixture(scope="module")
def labelled():
    """Short texts of two classes that overlap, one of them copied a thousand times over."""
    r = random.Random(7)
    good, bad = ["calm", "fine", "warm", "kind"], ["grim", "foul", "vile", "crud"]
    rows = [(y, " ".join(r.choice((bad if y else good) if r.random() < 0.35 else ["the", "a", "of", "sun", "sea", "hill", "fine", "grim"]) for _ in range(9))) for y in (0, 1) for _ in range(70)]
    return rows + [rows[100]] * 1000 + [(0, None)]


@pytest.mark.parametrize("learner", ["logistic", "hinge"])
def test_classifier_equals_plain_version(spark, labelled, learner):
    chars, words, l2, c = (2, 3), (1, 2), 0.05, 0.02
    unit = learner == "hinge"
    model = nb_classifiers.train(spark.createDataFrame([(t, y) for y, t in labelled], "text string, label int"), learner, grams=Grams(chars, words, 20), max_rows=100, l2=l2, c=c, unit=unit)
    rows = [(y, t or "") for y, t in labelled]
    n, df = Counter(y for y, _ in rows), {0: Counter(), 1: Counter()}
    for y, t in rows:
        df[y].update(ngrams(t, chars, words).keys())
    ratio = {g: math.log((df[1][g] + 1) / (n[1] + 2)) - math.log((df[0][g] + 1) / (n[0] + 2)) for g in df[0].keys() | df[1].keys()}
    place = {g: k for k, g in enumerate(sorted(ratio))}

    def vector(t):
        v = np.zeros(len(place))
        for g in ngrams(t, chars, words):
            if g in place:
                v[place[g]] = ratio[g]
        return v / (np.linalg.norm(v) or 1.0) if unit else v

    sample = chosen(rows, 50, 2)
    assert len(sample) == 100 and len(set(sample)) == 100
    x, y = np.array([vector(t) for _, t in sample]), np.array([1.0 if y else -1.0 for y, _ in sample])
    mix = np.random.default_rng(9).permutation(len(sample))
    held, fit = mix[: len(mix) // 5], mix[len(mix) // 5 :]
    a, b = np.hstack([x[fit], np.ones((len(fit), 1))]), y[fit]
    half = np.where(b > 0, 0.5 / (b > 0).sum(), 0.5 / (b < 0).sum())
    if learner == "logistic":
        w, penalty = np.zeros(a.shape[1]), np.append(np.full(len(place), l2), 0.0)
        for _ in range(60):  # Newton's method on all coordinates
            p = sigmoid(-b * (a @ w))
            gradient = a.T @ (-half * b * p) + penalty * w
            w -= np.linalg.solve((a.T * (half * p * (1 - p))) @ a + np.diag(penalty) + 1e-12 * np.eye(len(w)), gradient)
    else:
        q, bound, alpha = (a * b[:, None]) @ (a * b[:, None]).T, c * len(b) * half, np.zeros(len(b))
        top = np.linalg.norm(q, 2)
        for _ in range(30_000):  # projected gradient on the dual
            alpha = np.clip(alpha - (q @ alpha - 1) / top, 0, bound)
        w = a.T @ (alpha * b)
    margins, target = x[held] @ w[:-1] + w[-1], np.where(y[held] > 0, ((y[held] > 0).sum() + 1) / ((y[held] > 0).sum() + 2), 1 / ((y[held] < 0).sum() + 2))
    best, slope, offset = np.inf, 1.0, 0.0
    for width in (8.0, 2.0, 0.5, 0.1, 0.02):  # a grid, finer and finer
        for s in slope + np.linspace(-1, 1, 41) * width:
            for o in offset + np.linspace(-1, 1, 41) * width:
                z = s * margins + o
                loss = (np.logaddexp(0, z) - target * z).sum()
                if loss < best:
                    best, found = loss, (s, o)
        slope, offset = found
    of = model.scorer()
    for _, t in set(rows) | {(0, "unseen words"), (1, "foul vile")}:
        assert of(t) == pytest.approx(sigmoid(slope * (vector(t) @ w[:-1] + w[-1]) + offset), abs=0.02)


def test_language_model_equals_plain_version(spark):
    r = random.Random(3)
    words = {"aa": ["kato", "hundo", "domo", "arbo"], "bb": ["cat", "dog", "house", "tree"], "cc": ["katze", "hund", "haus", "baum"]}
    rows = [(la, " ".join(r.choice(words[la]) for _ in range(6))) for la in words for _ in range(40)]
    rows += [rows[5]] * 300
    chars, how = (1, 2), {"alpha": 1.0, "beta": 1.0, "l1": 0.02, "l2": 0.5}
    model = language_id.train(spark.createDataFrame([(t, la) for la, t in rows], "text string, lang string"), grams=Grams(chars, (), 20), per_language=20, max_rows=54)
    df = Counter(g for _, t in rows for g in ngrams(t, chars, ()))
    idf = {g: math.log((1 + len(rows)) / (1 + n)) + 1 for g, n in df.items()}

    def vector(t):
        v = {g: (1 + math.log(n)) * idf.get(g, math.log(1 + len(rows)) + 1) for g, n in ngrams(t, chars, ()).items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {g: x / size for g, x in v.items()}

    names, sample = sorted(words), chosen(rows, 18, 1)
    assert len(sample) == 54
    held, fit, seen = [], [], Counter()
    for k in np.random.default_rng(5).permutation(len(sample)):
        seen[sample[k][0]] += 1
        (fit if seen[sample[k][0]] % 5 else held).append(k)
    z, n = defaultdict(lambda: [0.0] * 3), defaultdict(lambda: [0.0] * 3)

    def weight(g, k):
        l1 = 0.0 if g is None else how["l1"]
        return 0.0 if abs(z[g][k]) <= l1 else -(z[g][k] - math.copysign(l1, z[g][k])) / ((how["beta"] + math.sqrt(n[g][k])) / how["alpha"] + how["l2"])

    def probabilities(v, temperature=1.0):
        logits = np.array([sum(x * weight(g, k) for g, x in v.items()) + weight(None, k) for k in range(3)]) / temperature
        e = np.exp(logits - logits.max())
        return e / e.sum()

    for _ in range(2):
        for k in fit:
            v = vector(sample[k][1])
            p = probabilities(v)
            for g, x in [*v.items(), (None, 1.0)]:
                old = [weight(g, j) for j in range(3)]
                for j in range(3):
                    d = x * (p[j] - (names[j] == sample[k][0]))
                    z[g][j] += d - (math.sqrt(n[g][j] + d * d) - math.sqrt(n[g][j])) / how["alpha"] * old[j]
                    n[g][j] += d * d
    vectors = [(vector(sample[k][1]), names.index(sample[k][0])) for k in held]
    temperature = min(np.exp(np.linspace(-4, 4, 801)), key=lambda t: -sum(math.log(probabilities(v, t)[k]) for v, k in vectors))
    assert model.languages == names and model.temperature == pytest.approx(temperature, rel=0.02)
    of = model.predictor()
    for t in {t for _, t in rows} | {"cathund", "x"}:
        p = probabilities(vector(t), model.temperature)
        name, score = of(t)
        assert score == pytest.approx(p.max(), abs=1e-4) and (name == names[int(p.argmax())] or p.max() - p[names.index(name)] < 1e-4)


@pytest.mark.parametrize("max_bytes", [0, 1 << 20])
def test_mix_equals_plain_order_sampling(spark, max_bytes):
    r = random.Random(11)
    docs = [(k, " ".join("w" * r.randint(1, 3) for _ in range(r.choice([0, 1, 5, 20, 90]))), r.choice(["a", "b", "c", "d", None])) for k in range(600)]
    docs += [(700 + k, "x y z", f"s{k:03}") for k in range(60)]  # many small sources
    docs += [(None, "one text without an id " * 3, "a")] * 40 + [docs[3]] * 30 + [(9, None, "b"), (10, "", None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(7)
    found = Counter((x.doc_id, x.size, x.copies, round(x.target, 6)) for x in mixing.mix(df, max_bytes=max_bytes).collect())
    sizes = defaultdict(int)
    for _, t, s in docs:
        sizes[s] += len(brute.words(t))
    target, want, kept = brute.water(sizes), Counter(), Counter()
    for source in sizes:
        rows = [(d, t, len(brute.words(t))) for d, t, s in docs if s == source]
        mean = sum(n for *_, n in rows) / len(rows)
        rate = lambda lam, n: 0.0 if not n else 2 / (1 + math.exp(-max(-60, min(60, lam * n / mean))))
        low, high = -1e3, 1e3
        for _ in range(200):  # bisection on the dual's gradient
            lam = (low + high) / 2
            low, high = (lam, high) if sum(n * rate(lam, n) for *_, n in rows) < target[source] else (low, lam)
        if target[source] >= 2 * sizes[source] * (1 - 1e-12):
            lam = math.inf
        drawn, missing = [], target[source]
        for d, t, n in rows:
            whole, part = (2, 0.0) if lam == math.inf and n else divmod(rate(lam, n) if lam < math.inf else 0.0, 1)
            missing -= whole * n
            u = (brute.spark_hash(brute.Int(7), brute.spark_hash(d, t)) % (1 << 52)) / (1 << 52)
            drawn.append((u / part if part > 1e-9 else math.inf, n, int(whole), d, t))
        taken = 0
        for rank, n, whole, d, t in sorted(drawn, key=lambda x: x[:2]):
            taken += n if rank < math.inf else 0
            copies = whole + (rank < math.inf and taken - n / 2 <= missing)
            want[d, n, copies, round(target[source], 6)] += 1
            kept[d, t, source] += copies
    assert found == want
    again = Counter((x.doc_id, x.text, x.source) for x in mixing.mixed(df, max_bytes=max_bytes).collect())
    assert again == +kept


def test_a_mix_that_does_not_settle_raises(spark):
    goal = spark.createDataFrame([("a", 100, 150.0)], "source string, source_size long, target double")
    histogram = spark.createDataFrame([("a", 10, 5), ("a", 50, 1)], "source string, size long, n long")
    with pytest.raises(RuntimeError, match="did not settle"):
        mixing.multipliers(histogram, goal, steps=1)
    assert mixing.multipliers(histogram, goal).first()["multiplier"] > 0
