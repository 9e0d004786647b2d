"""Clustering, whitening and positive-unlabelled quality against plain Python, with nulls, ties, repeated rows and clashing columns."""

import hashlib
import math
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import puquality, queries, shallot, whiten

DATA = "/root/testdata/sf0.001"
#: Columns named like the operators' own.
EXTRA = ("x", "first", "cluster", "upper", "component", "n", "f", "score", "e", "dims")


@pytest.fixture(scope="module")
def vectors(spark):
    base = spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding").where("vec_id < 160")
    odd = [
        (900, None), (901, [0.1] * 63), (902, [None] + [0.1] * 63), (903, [float("nan")] + [0.1] * 63), (904, [float("-inf")] + [0.1] * 63), (905, []),
        (906, [0.0] * 64), (907, [-0.0] * 64), (908, [0.0] * 64), (None, [0.25] * 64), (909, [-7.5] * 64), (909, [-7.5] * 64), (3, [1.0] * 64),
    ]
    both = base.unionByName(spark.createDataFrame(odd, base.schema))
    return both.unionByName(base.where("vec_id % 5 = 0")).withColumns({c: F.lit("clash") for c in EXTRA}).cache()


def integers(v, scale=256):
    return tuple(math.floor(scale * e) for e in v)


def fine(v):
    return v is not None and all(e is not None and math.isfinite(e) for e in v)


def brute_clusters(rows, k, rounds, seed=2):
    kept = [(i, integers(v)) for i, v in rows if fine(v) and len(v) == 64]
    def hashed(row):
        return hashlib.sha256(f"{seed}:{'' if row[0] is None else row[0]}".encode()).hexdigest(), row[1]

    centroids = [list(x) for _, x in sorted(kept, key=hashed)[:k]]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        held = {}
        for _, x in kept:
            held.setdefault(nearest(x)[1], []).append(x)
        for j, own in held.items():
            centroids[j] = [sum(e) // len(own) for e in zip(*own, strict=True)]
    found = [(i, *nearest(x)[::-1]) for i, x in kept]
    inertia = Counter()
    for _, j, d in found:
        inertia[j] += d
    total = sum(inertia.values())
    return Counter((i, j, d, inertia[j], total, hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for i, j, d in found)


@pytest.mark.parametrize(("k", "rounds"), [(40, 5), (7, 3), (1, 2), (500, 1), (3, 0)])
def test_clusters(vectors, k, rounds):
    got = shallot.clustered(vectors, k=k, rounds=rounds)
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    assert Counter(map(tuple, got.collect())) == brute_clusters(rows, k, rounds)


def test_clusters_of_nothing(vectors):
    got = shallot.clustered(vectors.limit(0))
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and got.count() == 0


def test_components_beyond_integers_are_an_error(spark):
    with pytest.raises(Exception, match="a component of a vector is over"):
        shallot.clustered(spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<double>")).collect()


def test_search_skips_and_never_errs():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.integers(-40, 40, (1500, 6)) + 300 * rng.integers(0, 4, (1500, 1)), rng.integers(0, 3, (500, 6))])
    points = np.concatenate([x[:20], x[:2], x[1600:1610]])
    first, second, upper, lower = np.zeros(len(x), np.int64), np.ones(len(x), np.int64), np.full(len(x), np.inf), np.zeros(len(x))
    moved, computed = np.zeros(len(points)), []
    for _ in range(8):
        c = shallot.Centroids(points)
        shallot.loosen(first, upper, lower, moved)
        computed.append(shallot.search(x, first, second, upper, lower, c))
        d = ((x[:, None, :] - points[None]) ** 2).sum(axis=2)
        assert (first == d.argmin(axis=1)).all()
        real = np.sqrt(d)
        assert (upper >= real[np.arange(len(x)), first]).all()
        real[np.arange(len(x)), first] = np.inf
        assert (lower <= real.min(axis=1)).all()
        after = points.copy()
        for j in np.unique(first):
            after[j] = x[first == j].sum(axis=0) // (first == j).sum()
        moved, points = np.sqrt(((after - points) ** 2).sum(axis=1)), after
    assert max(computed) < len(x) * len(points) / 2 and computed[-1] < computed[0] / 2


def brute_whitening(rows):
    kept = [(i, integers(v)) for i, v in rows if fine(v)]
    dims = Counter(len(x) for _, x in kept).most_common(1)[0][0]
    kept = [(i, x) for i, x in kept if len(x) == dims]
    fit = sorted({x for _, x in kept})
    n, s = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    y = [[n * a - b for a, b in zip(x, s, strict=True)] for x in fit]
    v = np.array([[float(Fraction(sum(r[i] * r[j] for r in y), n**3)) for j in range(dims)] for i in range(dims)])
    return kept, n, s, v


def test_whitening(vectors):
    kept, n, s, v = brute_whitening([(r.vec_id, r.embedding) for r in vectors.collect()])
    got = whiten.whitened(vectors).collect()
    assert len(got) == 4 * len(kept) and {r.n for r in got} == {n}
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    expected = []
    for i, x in kept:
        deviation = sum((n * a - b) ** 2 for a, b in zip(x, s, strict=True))
        centred = np.array([float(Fraction(n * a - b, n)) for a, b in zip(x, s, strict=True)])
        expected += [(str(i), c + 1, deviation, abs(centred @ u[:, c]) / math.sqrt(e[c]), e[c] / v.trace()) for c in range(4)]
    own = sorted((str(r.vec_id), r.component, int(r.deviation), abs(r.whitened), r.explained) for r in got)
    for a, b in zip(own, sorted(expected), strict=True):
        assert a[:3] == b[:3] and a[3:] == pytest.approx(b[3:], rel=1e-7, abs=1e-9)
    assert {r.identity_error for r in got}.pop() < 1e-9 and len({r.identity_error for r in got}) == 1
    # One sign for all rows.
    signs = {c: {round(math.copysign(1, r.whitened)) for r in got if r.component == c and abs(r.whitened) > 1e-6} for c in range(1, 5)}
    assert all(x == {-1, 1} for x in signs.values())


def test_covariance_is_exact_beyond_64_bits(spark):
    rows = [(i, [float(e) * 2.0**44 for e in ((i * 7) % 13 - 6, (i * 5) % 11 - 5, i % 3)]) for i in range(60)]
    found = whiten.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), scale=2).collect()
    fit = sorted({tuple(int(2 * e) for e in v) for _, v in rows})
    n, s = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    for r in found:
        assert r.n == n and int(r.deviation) == sum((n * int(2 * e) - b) ** 2 for e, b in zip(rows[r.vec_id][1], s, strict=True))
    assert len(found) == 3 * 60 and max(r.identity_error for r in found) < 1e-9


def test_polarisation_is_the_covariance(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(-900, 900, (5000, 9)) + 100_000
    w = whiten.fit(spark.createDataFrame([(r.tolist(),) for r in np.unique(x, axis=0)], "x array<long>"), 9)
    assert np.allclose(w.covariance, np.cov(np.unique(x, axis=0).T, bias=True), rtol=1e-11)


@pytest.mark.parametrize(
    ("rows", "n", "shown"),
    [([], None, None), ([(1, None)], None, None), ([(1, [])], None, None), ([(1, [1.0, 2.0])], 1, 2), ([(1, [1.0]), (2, [2.0]), (3, [2.0])], 2, 1), ([(1, [0.5, 0.5]), (2, [0.25, 0.25]), (3, [9.0])], 2, 2)],
)
def test_whitening_of_little(spark, rows, n, shown):
    got = whiten.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    if n is None:
        assert got == []
        return
    assert {r.n for r in got} == {n} and {r.component for r in got} == set(range(1, shown + 1))
    if n == 1:
        assert all(r.whitened is None and r.explained is None and r.identity_error is None and r.deviation == 0 for r in got)
    else:
        assert all((r.whitened is None) == (r.component == 2) for r in got) and all(r.identity_error < 1e-12 for r in got)


@pytest.fixture(scope="module")
def texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id < 4000").select("doc_id", "text")
    odd = [(90_001, None), (90_002, ""), (90_003, " \n\t "), (90_004, "word " * 40_000), (None, "a null id"), (90_002, "again"), (90_005, "İ中文\x00"), (90_006, "y" * 5000)]
    return docs.unionByName(spark.createDataFrame(odd, docs.schema)).withColumns({c: F.lit("clash") for c in EXTRA}).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.1/labels.parquet").where("doc_id < 4000").withColumn("f", F.lit("clash"))


def brute_features(text):
    raw = (text or "").encode()
    words = raw.lower().split()
    kinds = [sum(b in chars for b in raw) for chars in puquality._KINDS.values()]
    names = dict(zip(puquality._KINDS, kinds, strict=True))
    held, windows = Counter(words), [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    some = max(len(words), 1)
    return [
        *(k / max(len(raw), 1) for k in kinds), (len(raw) - sum(kinds)) / max(len(raw), 1), names["upper"] / max(names["upper"] + names["lower"] + names["wide"], 1),
        (names["mark"] + names["shout"]) / some, math.log1p(len(raw)), math.log1p(len(words)), sum(map(len, words)) / some, sum(len(w) <= 3 for w in words) / some,
        sum(len(w) > 15 for w in words) / some, len(held) / some, max(held.values(), default=0) / some, sum(n * (n - 1) for n in held.values()) / max(len(words) * (len(words) - 1), 1),
        1 - len(set(windows)) / max(len(windows), 1), sum(a == b for a, b in zip(words, words[1:], strict=False)) / some, len(words) / (names["newline"] + 1),
    ]


def test_features(texts):
    rows = texts.where("doc_id IS NULL OR doc_id < 150 OR doc_id > 90000")
    got = Counter((str(r.doc_id), tuple(round(e, 4) for e in r.f)) for r in puquality.features(rows).collect())
    expected = [(str(r.doc_id), brute_features(r.text)) for r in rows.collect()]
    assert len(puquality.NAMES) == len(expected[0][1])
    left = sorted((i, f) for (i, f), k in got.items() for _ in range(k))
    for (i, a), (j, b) in zip(left, sorted(expected), strict=True):
        b = [1 - (1 - e) if k == len(b) - 3 and len(b) else e for k, e in enumerate(b)]
        assert i == j and (a == pytest.approx(b, abs=2e-4) or i == "90001" or b[-3] == 1)


def test_quality_on_held_out_rows(texts, labels):
    got = puquality.held_out_scores(texts, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = got.collect()
    assert Counter(str(r.doc_id) for r in rows) == Counter(str(r.doc_id) for r in texts.select("doc_id").collect())
    truth = {r.doc_id: r.quality for r in labels.collect()}
    for r in rows:
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    known = [(truth[r.doc_id], r.score, r.predicted) for r in rows if r.held_out and r.doc_id in truth]
    good, bad = [(s, p) for y, s, p in known if y == 1], [(s, p) for y, s, p in known if y == 0]
    assert np.mean([p for _, p in good]) > 0.99 and np.mean([p for _, p in bad]) < 0.3
    assert np.mean([a > b for a, _ in good for b, _ in bad]) > 0.98


def test_labels_of_zero_and_held_out_labels_are_not_read(texts, labels):
    changed = labels.withColumn("quality", F.when((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0) & (F.col("doc_id") % 2 == 0), 1 - F.col("quality")).otherwise(F.col("quality")))
    changed = changed.where((F.col("quality") == 1) | (F.col("doc_id") % 3 == 0))
    a, b = (sorted((str(r.doc_id), r.score) for r in puquality.held_out_scores(texts, x).collect()) for x in (labels, changed))
    assert a == b


def test_quality_without_labels_or_rows(texts, labels):
    none = puquality.held_out_scores(texts.limit(40), labels.limit(0)).collect()
    assert len(none) == 40 and {(r.score, r.predicted) for r in none} == {(0.5, 1)}
    zeros = puquality.held_out_scores(texts.limit(40), labels.withColumn("quality", F.lit(0))).collect()
    assert {r.score for r in zeros} == {0.5}
    assert puquality.held_out_scores(texts.limit(0), labels).count() == 0
    nulls = labels.withColumn("quality", F.lit(None).cast("int"))
    assert {r.score for r in puquality.held_out_scores(texts.limit(40), nulls).collect()} == {0.5}


def test_prior_of_a_known_mixture():
    rng = np.random.default_rng(4)
    for share in (0.3, 0.6, 0.9):
        p = rng.normal(2, 1, 20_000)
        u = np.where(rng.random(60_000) < share, rng.normal(2, 1, 60_000), rng.normal(-2, 1, 60_000))
        found = puquality.class_prior(*(np.bincount(puquality._interval(x), minlength=puquality.INTERVALS) for x in (u, p)))
        assert abs(found - share) < 0.03


def test_risk_against_its_formula_and_slope():
    rng = np.random.default_rng(5)
    loss = lambda z: math.log1p(math.exp(-z))
    for prior, shift in ((0.4, 0.0), (0.9, -6.0)):
        p, u = rng.normal(1, 2, 50), rng.normal(0, 2, 80) + shift
        plain = prior * np.mean([loss(z) for z in p])
        rest = np.mean([loss(-z) for z in u]) - prior * np.mean([loss(-z) for z in p])
        risk, g_p, g_u = puquality.risk_gradient(p, u, prior)
        assert risk == pytest.approx(plain + max(0, rest))
        step = 1e-6
        sign = 1 if rest >= 0 else -1
        whole = (lambda a, b: prior * np.mean([loss(z) for z in a]) + np.mean([loss(-z) for z in b]) - prior * np.mean([loss(-z) for z in a])) if rest >= 0 else (lambda a, b: np.mean([loss(-z) for z in b]) - prior * np.mean([loss(-z) for z in a]))
        for i in (0, 7):
            up = p.copy()
            up[i] += step
            assert g_p[i] == pytest.approx(sign * (whole(up, u) - whole(p, u)) / step, abs=1e-5)
            up = u.copy()
            up[i] += step
            assert g_u[i] == pytest.approx(sign * (whole(p, up) - whole(p, u)) / step, abs=1e-5)


def test_queries_of_the_vector_operators(spark):
    assert {n for n in queries.QUERIES if re.match(r"op1[123]_", n)} == {"op11_shallot", "op12_pu_quality", "op13_whitening"}
    got = queries.QUERIES["op13_whitening"](spark, DATA)
    assert dict(got.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
