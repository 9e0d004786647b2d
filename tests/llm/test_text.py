"""The text operators against plain Python on whole small tables, with nulls, empty and long texts, repeated rows and clashing columns."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tickloom.llm import blockdedup, bpe, langid, licenses, lm, packing, quality, queries, sigtree, toxicity, urlfilter
from tickloom.llm.common import mix
from tickloom.llm.components import components

DATA = "/root/testdata/sf0.001"
#: Columns named like the operators' own.
EXTRA = ("row", "score", "bucket", "k1", "component", "names", "host", "quality", "hits", "_gone")


@pytest.fixture(scope="module")
def docs(spark):
    base = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang", "source")
    rng = random.Random(5)
    long = " ".join(rng.choice("alpha beta gamma delta. epsilon zeta eta".split()) for _ in range(40_000))
    odd = [
        (9001, None, None, None), (9002, "", "en", "src1"), (9003, " \t\n\x0b\x0c\r ", "en", None), (9004, long, "en", "src1"), (9005, long + " end", "en", "src1"),
        (9006, "one two three", "en", "src1"), (9007, "ONE  two\nthree", "en", "src1"), (9008, "123 456 --- !!!", "en", "src1"), (9009, "same\nsame\n\n\nsame", "en", "src1"),
        (9010, "x<|endoftext|>y İstanbul Ａ\u0301 中文 Σς", "en", "src1"), (9006, "one two three", "en", "src1"), (9011, "Released under the MIT License.\nother words here", "en", "src1"),
        (9012, "a\x1cb\x85c\xa0d\u2003e", "en", "src1"),
    ]
    both = base.unionByName(spark.createDataFrame(odd, base.schema))
    return both.withColumns({c: F.lit("clash") for c in EXTRA}).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def words(text, lower=False):
    raw = (text or "").encode()
    return (raw.lower() if lower else raw).split()


def multiset(it):
    return Counter(map(str, it))


def test_hashes_of_words_do_not_depend_on_their_neighbours():
    from tickloom.llm.common import words_of

    texts = [b"one two three", b"x" * 5000 + b" two " + b"y" * 9000, b"three two " * 30_000, b"y" * 9000 + b" one"]
    hashes = {}
    for group in ([0], [0, 1], [2, 3], [0, 1, 2, 3]):
        data = b"".join(texts[i] for i in group)
        offsets = np.cumsum([0, *[len(texts[i]) for i in group]])
        w = words_of(np.frombuffer(data, np.uint8), offsets)
        assert np.diff(w.first).tolist() == [len(texts[i].split()) for i in group]
        for a, n, h in zip(w.starts.tolist(), w.lengths.tolist(), w.hashes.tolist(), strict=True):
            assert hashes.setdefault(data[a : a + n], h) == h
    assert len(set(hashes.values())) == len(hashes) == 5


# 1


def brute_quality(text):
    ws = words(text)
    seen = defaultdict(list)
    for i in range(len(ws) - 7):
        seen[tuple(ws[i : i + 8])].append(i)
    covered = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    lines = (text or "").split("\n")
    dup = sum(1 for i, x in enumerate(lines) if words(x) and x in lines[:i])
    return len(ws), sum(len(w.decode()) for w in ws), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def test_quality(docs, rows, empty):
    got = quality.judge(docs).collect()
    expected = {}
    for i, t, *_ in rows:
        expected[i] = brute_quality(t)
    for r in got:
        m = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert m == expected[r.doc_id], r.doc_id
        assert r.base_failed == (m[0] < 20 or 100 * m[4] > 30 * m[0])
    assert len(got) == len(rows) and quality.judge(empty).count() == 0
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert multiset(r.doc_id for r in kept.collect()) == multiset(r.doc_id for r in got if r.kept)


def test_bad_host_is_rejected(spark):
    good = " ".join(f"w{i}" for i in range(30))
    table = [(i, good if i % 10 else "short", None, f"h{i % 5}") for i in range(100)] + [(1000 + i, "short" if i % 8 else good, None, "bad") for i in range(64)]
    out = quality.judge(spark.createDataFrame(table, "doc_id long, text string, lang string, source string"))
    assert {r.host for r in out.where("NOT kept AND NOT base_failed").collect()} == {"bad"}


# 2


def labelled(spark, n=600):
    rng = random.Random(3)
    plain = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(n):
        ws = [rng.choice(plain) for _ in range(60)]
        if i % 6 == 0:
            for _ in range(3):
                ws[rng.randrange(60)] = rng.choice(["nitwit", "grokkaba", "grokkalo", "grokkami"])
        rows.append((i, " ".join(ws) + ".", int(i % 6 == 0)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_toxicity(spark, docs):
    table = labelled(spark)
    out = {r.doc_id: r for r in toxicity.held_out_scores(table.select("doc_id", "text"), table.select("doc_id", "toxic")).collect()}
    held = [r for r in out.values() if r.held_out]
    assert len(held) > 100 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out.values())
    assert sum(r.predicted == int(r.doc_id % 6 == 0) for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out.values())
    clean = toxicity.keep_clean(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    assert clean.columns == docs.columns and clean.where("doc_id IN (9001, 9002, 9003)").count() == 3


def test_held_out_labels_change_nothing(spark):
    table = labelled(spark, 300)
    flipped = table.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted(map(tuple, toxicity.held_out_scores(table.select("doc_id", "text"), x.select("doc_id", "toxic")).collect())) for x in (table, flipped))
    assert a == b


def test_no_labels(spark, docs, empty):
    labels = spark.read.parquet(f"{DATA}/labels.parquet").limit(0)
    assert toxicity.held_out_scores(docs, labels).count() == docs.count() and toxicity.held_out_scores(empty, labels).count() == 0


def test_grammar_names_kinds():
    model = toxicity.Model({"nitwit": 5.0, "grokka*": 3.0, "grokkafine": -1.0, "dim": 0.8, "bulb": 0.9}, pairs={"dim bulb": 4.0})
    kinds = lambda text: {k for k in range(toxicity.KINDS) if model.features(text)[k]}
    assert kinds("a nitwit") == {0} and kinds("you nitwit") == {1} and kinds("not a nitwit") == {2} and kinds("she said nitwit") == {4}
    assert kinds("i will kill you") == {9} and kinds("nothing. here") == set() and kinds(None) == set() and kinds("he kills time") == set()
    assert kinds("kills you") == {9} and kinds("she wrote i will not hurt them") == {15} and kinds("dim bulb") == {0} and kinds("bulb big dim") == {0} and kinds("bulb") == set()
    assert kinds("grokkaxyz") == {0} and kinds("grokkafine") == set()
    long = "nitwit " + "w " * 200 + "nitwit"
    assert model.features(long)[0] == pytest.approx(math.log(3))  # two clauses, though no mark ends them


def test_composed_machine_against_enumeration():
    """Every clause of up to five classes, and many longer ones: the machine finds what the definitions say."""
    import itertools

    slur, half, intend, hurt, aim, negate, report = range(1, 8)

    def matches(tokens):
        out, aimed = [], aim in tokens
        for i, c in enumerate(tokens):
            insult = c == slur or (c == half and half in tokens[max(0, i - 2) : i])
            threat = (c == hurt and intend in tokens[max(0, i - toxicity.REACH) : i]) or (c == aim and hurt in tokens[max(0, i - toxicity.REACH) : i])
            if insult or threat:
                out.append((8 * (not insult) + aimed + 2 * (negate in tokens[max(0, i - toxicity.REACH) : i]) + 4 * (report in tokens[:i]), float(i)))
        return out

    rng = random.Random(4)
    clauses = [c for n in range(6) for c in itertools.product(range(8), repeat=n)] + [[rng.randrange(8) for _ in range(rng.randrange(6, 30))] for _ in range(3000)]
    for c in clauses:
        assert toxicity.read_clause([(x, float(i)) for i, x in enumerate(c)]) == matches(list(c)), c


def test_fit_settles_on_separable_rows():
    x = np.zeros((4000, toxicity.KINDS + toxicity.EXTRAS))
    y = (np.arange(4000) % 9 == 0).astype(float)
    x[y == 1, toxicity.KINDS :] = np.random.default_rng(3).uniform(2, 7, (int(y.sum()), 3))
    w = toxicity.logistic(x, y, np.ones(4000))
    p = 1 / (1 + np.exp(-(w[0] + x @ w[1:])))
    assert p[y == 1].min() > 0.7 and p[y == 0].max() < 0.1


# 3


def test_bpe(docs, rows, empty):
    library = bpe.WordBpe.load(bpe.tokenizer_path()).library
    expected = Counter()
    for i, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        expected[i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()] += 1
    assert Counter(map(tuple, bpe.round_trip(docs).collect())) == expected and bpe.round_trip(empty).count() == 0


def test_bpe_columns(docs):
    some = docs.where("doc_id IN (9006, 9010, 9001)").select("text", bpe.encode(F.col("text")).alias("ids")).withColumn("back", bpe.decode(F.col("ids"))).collect()
    library = bpe.WordBpe.load(bpe.tokenizer_path()).library
    for r in some:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == ids and r.back == library.decode(ids, skip_special_tokens=False)


def test_bpe_random_words():
    model = bpe.WordBpe.load(bpe.tokenizer_path())
    rng = random.Random(11)
    texts = ["".join(rng.choice("aaabcdeeeinrst'.!?é9-") for _ in range(rng.randint(1, 40))) for _ in range(3000)] + ["ab" * 500, "é" * 300, "a" * 200, "it's we'll"]
    for t, got in zip(texts, model.encode_bytes([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == model.library.encode(t, add_special_tokens=False).ids, t


# 4


def brute_license(text, templates=licenses.TEMPLATES):
    """By the definition: every passage that begins with a bigram of the template, until it holds too many others."""
    grams = licenses.bigrams(licenses.words_in(text or ""))
    found = {}
    for name, body in templates.items():
        own = set(licenses.bigrams(licenses.words_in(body)))
        if 2 * len(own & set(grams)) < licenses.MATCH * (len(own & set(grams)) + len(own)):
            continue  # not even a passage of these alone would do
        for i, g in enumerate(grams):
            if g in own:
                inside = set()
                for g2 in grams[i:]:
                    inside.add(g2)
                    if len(inside) * licenses.MATCH > len(own) * (2 - licenses.MATCH):
                        break
                    dice = 2 * len(inside & own) / (len(inside) + len(own))
                    if dice >= licenses.MATCH and dice > found.get(name, (0, 0))[0]:
                        found[name] = (dice, i)
    if not found:
        return None, 0.0, None, 0
    name = min(found, key=lambda n: (-found[n][0], n))
    return name, round(found[name][0], 6), found[name][1], len(found)


def test_licenses_over_all_passages_of_random_texts(spark):
    """Few different words, so that all repeats; here each pair of places is a passage, without any bound."""
    rng = random.Random(9)
    templates = {"a": "x y z w v", "b": "p q p r s t u", "c": "x x y y z", "d": "one"}
    texts = [" ".join(rng.choice("x y z w v p q r s t u o".split()[: rng.choice((3, 6, 12))]) for _ in range(rng.randrange(40))) for _ in range(400)]

    def all_passages(text):
        grams, found = licenses.bigrams(text.split()), {}
        for name, body in templates.items():
            own = set(licenses.bigrams(body.split()))
            for i in range(len(grams)):
                for j in range(i + 1, len(grams) + 1):
                    inside = set(grams[i:j])
                    dice = 2 * len(inside & own) / (len(inside) + len(own))
                    if dice >= licenses.MATCH and dice > found.get(name, (0, 0))[0]:
                        found[name] = (dice, i)
        return found

    out = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), templates=templates).collect()}
    some = 0
    for k, text in enumerate(texts):
        found = all_passages(text)
        some += bool(found)
        name = min(found, key=lambda n: (-found[n][0], n)) if found else None
        assert (out[k].license, out[k].n_licenses) == (name, len(found)), text
        if name:
            assert out[k].dice == round(found[name][0], 6) and grams_from(text, out[k].first_word, templates[name], found[name][0])
    assert some > 40


def grams_from(text, first, body, dice):
    """Whether a passage from this word on has the coefficient."""
    grams, own = licenses.bigrams(text.split()), set(licenses.bigrams(body.split()))
    return any(2 * len(set(grams[first:j]) & own) / (len(set(grams[first:j])) + len(own)) == dice for j in range(first + 1, len(grams) + 1))


def test_licenses_with_words_put_in_and_very_long(spark):
    body = licenses.TEMPLATES["mit-body"]
    texts = ["Licensed under the CC BY-NC 4.0 and more words follow here", "Licensed under the Apache License, as of Version 2.0. and more", f"{body} " * 3, "the of and " * 20_000 + "released under the mit license " * 3]
    out = sorted(licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect(), key=lambda r: r.doc_id)
    for r, text in zip(out, texts, strict=True):
        assert (r.license, r.dice, r.first_word, r.n_licenses) == brute_license(text)
    assert [r.license for r in out] == ["cc-by-nc-4.0", "apache-2.0", "mit-body", "mit"]


def test_licenses(docs, rows, empty):
    out = licenses.scan(docs).collect()
    assert len(out) == len(rows)
    assert Counter((r.doc_id, r.license, r.dice, r.first_word, r.n_licenses) for r in out) == Counter((i, *brute_license(t)) for i, t, *_ in rows)
    assert {r.doc_id: r.license for r in out}[9011] == "mit" and licenses.scan(empty).count() == 0


def test_licenses_inside_lines_over_lines_and_whole_bodies(spark):
    around = " ".join(f"w{i}" for i in range(60))
    notice, body = licenses.TEMPLATES["bsd-3-clause"], licenses.TEMPLATES["mit-body"]
    wrapped = "\n".join(" ".join(body.split()[i : i + 7]) for i in range(0, len(body.split()), 7))
    texts = {
        "This project is released under the MIT License.": ("mit", 1.0), f"{around} released under the MIT license. {around}": ("mit", 1.0),
        f"{around}\n" + notice.replace(" with or", "\n with or").replace(" that", "\nthat") + f"\n{around}": ("bsd-3-clause", 1.0),
        f"Copyright 2020\n\n{wrapped}\n{around}": ("mit-body", 1.0), wrapped.replace("FITNESS", "USE").replace("merge", "join"): ("mit-text", 1.0),
        f"{around} released under the MIT": ("mit", 0.857143), f"{around} under the license of nobody {around}": (None, 0.0), "": (None, 0.0), "MIT": (None, 0.0),
        f"Licensed under CC BY-NC 4.0. {around} released under the MIT License.": ("cc-by-nc-4.0", 1.0),
    }
    out = sorted(licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect(), key=lambda r: r.doc_id)
    for r, (text, (name, dice)) in zip(out, texts.items(), strict=True):
        assert (r.license, r.dice, r.first_word, r.n_licenses) == brute_license(text)
        assert r.license == name and r.dice == dice, text


# 5


@pytest.mark.parametrize(("size", "bucket"), [(blockdedup.BLOCK, blockdedup.bucket_of), (7, lambda *c: F.pmod(F.xxhash64(*c), F.lit(5)))])
def test_block_dedup(docs, rows, empty, size, bucket):
    table, own = docs, rows
    if size < 100:  # every bucket is shared, so the sorted lists decide
        table = docs.where("length(coalesce(text, '')) < 600")
        own = [r for r in rows if len(r[1] or "") < 600]
    groups = defaultdict(list)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    for i, t, *_ in own:
        groups[norm(t)].append(i)
    expected = Counter((i, min(groups[norm(t)]), len(groups[norm(t)]), i == min(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t, *_ in own)
    assert Counter(map(tuple, blockdedup.groups(table, size=size, bucket=bucket).collect())) == expected
    assert blockdedup.groups(empty, size=size, bucket=bucket).count() == 0


def test_keep_first(docs, rows):
    out = blockdedup.keep_first(docs)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    first = {}
    for i, t, *_ in rows:
        first[norm(t)] = min(first.get(norm(t), i), i)
    assert out.columns == docs.columns and Counter(r.doc_id for r in out.collect()) == Counter(first.values())


# 6


def shingles(text):
    ws = words(text, lower=True)
    return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 5 else {tuple(ws)} if ws else set()


def brute_components(rows):
    sets = [(i, shingles(t)) for i, t, *_ in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 3 * len(x) <= 4 * len(y) and 3 * len(y) <= 4 * len(x) and 100 * len(x & y) >= 75 * len(x | y):
                parent[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(sets):
        low[find(k)] = min(low.get(find(k), i), i)
    return Counter((i, len(s), low[find(k)]) for k, (i, s) in enumerate(sets))


def test_signature_trees(docs, rows, empty):
    assert Counter(map(tuple, sigtree.link_components(docs).collect())) == brute_components(rows)
    assert sigtree.link_components(empty).count() == 0
    kept = sigtree.keep_one(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {c for _, _, c in brute_components(rows)}


def test_signature_trees_on_families(spark):
    """Chains of edits around the threshold, over more sets than one tile with small tiles."""
    rng = random.Random(8)
    rows = []
    for family in range(6):
        base = [f"f{family}w{rng.randrange(999)}" for _ in range(60)]
        for k in range(25):
            ws = list(base)
            for _ in range(rng.randrange(5)):
                ws[rng.randrange(60)] = f"e{rng.randrange(9999)}"
            rows.append((family * 100 + k, " ".join(ws)))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    old, sigtree.TILE = sigtree.TILE, 8
    try:
        assert Counter(map(tuple, sigtree.link_components(table).collect())) == brute_components(rows)
    finally:
        sigtree.TILE = old


def test_signature_trees_with_hot_shingles(spark, monkeypatch):
    """A passage in all texts and copies of texts, in steps of a few texts each, so that most hashes are counted inside steps."""
    from tickloom.llm import common

    monkeypatch.setattr(sigtree, "word_steps", lambda column: common.word_steps(column, limit=3000))
    rng = random.Random(9)
    hot = [f"hot{i}" for i in range(25)]
    rows = []
    for family in range(12):
        base = [f"f{family}w{rng.randrange(999)}" for _ in range(40)]
        for k in range(8):
            ws = list(base)
            for _ in range(rng.randrange(4)):
                ws[rng.randrange(40)] = f"e{rng.randrange(9999)}"
            at = rng.choice([0, 40])
            rows.append((family * 100 + k, " ".join(ws[:at] + hot + ws[at:])))
    rows += [(5000 + i, rows[rng.randrange(len(rows))][1]) for i in range(40)]
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    assert Counter(map(tuple, sigtree.link_components(table).collect())) == brute_components(rows)


@pytest.fixture
def quoting(spark, monkeypatch, tmp_path):
    """Pairs below the threshold that all quote a passage, small tiles, and how many sets went to tiles of families."""
    real = sigtree._links_of

    def noted(keys, sets, labels, percent):
        if labels is not None:
            (tmp_path / f"{keys[0]}-{random.random()}").write_text(str(len(keys)))
        return real(keys, sets, labels, percent)

    monkeypatch.setattr(sigtree, "_links_of", noted)
    monkeypatch.setattr(sigtree, "TILE", 8)
    hot = [f"hot{i}" for i in range(20)]
    rows = []
    for family in range(40):
        base = [f"f{family}w{i}" for i in range(60)]
        edited = [f"e{family}n{i}" if i in (10, 30, 50) else w for i, w in enumerate(base)]
        rows += [(2 * family, " ".join(hot + base)), (2 * family + 1, " ".join(hot + edited))]
    rows.append((1000, " ".join(hot)))
    return rows, spark.createDataFrame(rows, "doc_id long, text string"), lambda: sum(int(f.read_text()) for f in tmp_path.iterdir())


def test_a_passage_of_many_texts_does_not_chain_families(quoting):
    """Each set travels about once, and not to all tiles of one large family."""
    rows, table, sent = quoting
    assert Counter(map(tuple, sigtree.link_components(table).collect())) == brute_components(rows)
    assert 80 <= sent() <= 160


def test_near_copies_of_the_pipeline_travel_once(spark, quoting, monkeypatch):
    import corpus_pipeline

    monkeypatch.setattr(corpus_pipeline, "_small_batches", lambda spark: None)  # the session is shared
    rows, table, sent = quoting
    kept = corpus_pipeline.drop_near_copies(spark, table, "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(c for _, _, c in brute_components(rows))
    assert 80 <= sent() <= 160


def test_signature_trees_with_marks_that_collide(spark, monkeypatch):
    """Marks of eight values: no link is lost, whatever hashes look alike in a bucket."""
    places = sigtree._places
    weak = vars(sigtree) | {"_places": lambda hashes, buckets: (places(hashes, buckets)[0], places(hashes, buckets)[1] & np.uint32(7))}
    for name in ("_pack", "_twins", "_prefixes"):
        f = getattr(sigtree, name)
        monkeypatch.setattr(sigtree, name, type(f)(f.__code__, weak, name, f.__defaults__))
    rng = random.Random(10)
    rows = []
    for family in range(8):
        base = [f"f{family}w{rng.randrange(999)}" for _ in range(60)]
        for k in range(8):
            ws = list(base)
            for _ in range(rng.randrange(5)):
                ws[rng.randrange(60)] = f"e{rng.randrange(9999)}"
            rows.append((family * 100 + k, " ".join(ws)))
    table = spark.createDataFrame(rows + rows[:9], "doc_id long, text string")
    assert Counter(map(tuple, sigtree.link_components(table).collect())) == brute_components(rows + rows[:9])


def test_postings_are_packed_whole(spark):
    rng = np.random.default_rng(4)
    keys, doc = mix(np.arange(5000, dtype=np.uint64)), rng.integers(0, 3, 5000)
    table = np.array([[7, 70], [8, 80], [9, 90]])
    found = Counter()
    for row in sigtree._pack(keys, doc, table, 4).to_pylist():
        marks, docs = sigtree._unpack(pa.Table.from_pylist([row], schema=sigtree._POSTING), 2)
        found.update((row["bucket"], int(m), *d) for m, d in zip(marks, docs.tolist(), strict=True))
    bucket, marks = sigtree._places(keys, 4)
    assert found == Counter((int(b), int(m), *table[d].tolist()) for b, m, d in zip(bucket, marks, doc, strict=True))
    assert sigtree._pack(keys[:0], doc[:0], table, 4).num_rows == 0


def test_written_tables_leave_no_shuffle_files(spark):
    from pathlib import Path

    from tickloom.llm.common import materialise

    def shuffled():
        return {f.name for f in Path(spark.conf.get("spark.local.dir")).rglob("shuffle_*")}

    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, files = spark.conf.get(name), shuffled()
    assert len(materialise(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()).collect()) == 7
    end = time.time() + 10
    while shuffled() - files and time.time() < end:
        time.sleep(0.1)
    assert not shuffled() - files
    assert spark.conf.get(name) == before


def test_tree_links_all_that_links(spark):
    rng = np.random.default_rng(2)
    sets = []
    for _ in range(150):
        if sets and rng.random() < 0.7:
            s = sets[rng.integers(len(sets))].copy()
            n = int(rng.integers(0, max(1, len(s) // 5)))
            s[:n] = rng.integers(1, 1 << 62, n).astype(np.uint64)
            sets.append(np.unique(s))
        else:
            sets.append(np.unique(rng.integers(1, 1 << 62, int(rng.integers(1, 120))).astype(np.uint64)))
    found = sigtree.SignatureTree(sets).link(np.arange(150))
    parent = list(range(150))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in found:
        assert 100 * len(np.intersect1d(sets[a], sets[b])) >= 75 * len(np.union1d(sets[a], sets[b]))
        parent[find(a)] = find(b)
    for a in range(150):
        for b in range(a):
            if 100 * len(np.intersect1d(sets[a], sets[b])) >= 75 * len(np.union1d(sets[a], sets[b])):
                assert find(a) == find(b)


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    assert {tuple(r) for r in components(edges).collect()} == {(i, 0) for i in range(41)} | {(100, 100), (101, 100)}


# 7


def test_urls(spark):
    urls = [
        None, "", "no scheme", "http://", "http://Example.COM/en/1?x", "http://www.example.com/en/1", "http://a.www.example.com/en/", "http://example.com/e", "http://example.com", "https://x.net/es/1#t",
        "https://net/fr/", "https://xnet/fr/", "https://a.net/de/", "http://ads.example.org/1", "http://m.ads-track.example.org/es/", "http://o.org/x.net/es/", "http://o.org/adserver/1", "http://o.org/a://b.com/", "http://c.com/x\ny", "http://com/", "http://example.com?q=/en/",
    ]
    table = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls + urls)], "page_id long, url string, rule string")
    for r in urlfilter.judge(table).collect():
        u = (urls + urls)[r.page_id] or ""
        rest = u.split("://", 1)[1] if "://" in u else ""
        host = re.match(r"(?s)[^/?#]*", rest).group().lower()
        path = re.match(r"(?s)[^?#]*", rest[len(host) :]).group()
        rules = [(rule, v) for v, rule in urlfilter.RULES if ("." + host).endswith("." + rule.split("/", 1)[0]) and path.startswith("/" + rule.split("/", 1)[1])]
        rule = max(rules, key=lambda x: len(x[0]), default=(None, None))
        globs = ["(?s)" + "".join({"*": ".*", "~": "[^/]*"}.get(c, re.escape(c)) for c in g) for g in urlfilter.BLOCK_GLOBS]
        verdict = rule[1] or ("block" if any(re.fullmatch(g, f".{host}{path}") for g in globs) else "allow")
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule[0], verdict), u
    assert urlfilter.judge(table.limit(0)).count() == 0


# 8


def test_language(docs, rows, empty):
    out = langid.held_out_predictions(docs).collect()
    truth = {i: lang for i, _, lang, _ in rows}
    real = [r for r in out if r.held_out and r.doc_id < 9000]
    assert sum(r.lang_pred == truth[r.doc_id] for r in real) >= 0.95 * len(real) and len(out) == len(rows)
    assert {r.doc_id for r in out if r.lang_pred == "und"} == {9001, 9002, 9003, 9008} and all(0 <= r.score <= 1 for r in out)
    assert langid.held_out_predictions(empty).count() == 0
    assert {r.lang_pred for r in langid.with_language(docs, langid.Model.of_rows([], [], {})).select("language.lang").withColumnRenamed("lang", "lang_pred").collect()} == {"und"}


def test_language_backs_off():
    model = langid.Model.of_rows(["a", "b"], [("a", 0, "dog", 5), ("b", 0, "hund", 5), ("a", 3, "ing", 4), ("b", 3, "ung", 4)], {("a", 0): 5, ("b", 0): 5, ("a", 3): 4, ("b", 3): 4})
    assert model.predict("dog")[0] == "a" and model.predict("zwing")[0] == "a" and model.predict("zwung")[0] == "b" and model.predict("1 2") == ("und", 0.0)


def test_language_against_brute_force(docs, rows):
    """Counts, log frequencies and back-off by plain dictionaries, over the same training rows (fewer than the sample takes)."""
    import regex

    counts = defaultdict(Counter)  # (kind, language) -> gram -> n
    languages = sorted({r[2] for r in rows if r[2]})
    split = lambda t: regex.findall(r"\p{L}+", (t or "").lower())
    grams = lambda w, n: [f"<{w}>"[i : i + n] for i in range(len(w) + 3 - n)]
    learned = set()
    for i, t, lang, _ in rows:
        if t is not None and lang is not None and zlib.crc32(str(i).encode()) % 4 != 2 and (i, t, lang) not in learned:
            for w in split(t):
                counts[0, lang][w] += 1
                for n in langid.SIZES:
                    counts[n, lang].update(grams(w, n))
    kept, total = {}, {}
    for k in (0, *langid.SIZES):
        every = Counter()
        for lang in languages:
            every.update(counts[k, lang])
            total[k, lang] = sum(counts[k, lang].values())
        kept[k] = {g for g, n in every.items() if n >= langid.LEAST}

    def log(k, g, lang):
        return math.log(counts[k, lang][g] + 0.5) - math.log(total[k, lang] + len(kept[k]) + 1)

    def score(w, lang):
        if w in kept[0]:
            return log(0, w, lang)
        for n in langid.SIZES:
            hits = [g for g in grams(w, n) if g in kept[n]]
            if hits:
                return sum(log(n, g, lang) for g in hits) / len(hits)
        return 0.0

    got = {}
    for r in langid.held_out_predictions(docs).collect():
        got.setdefault(r.doc_id, r)
    for i, t, *_ in rows[:60] + rows[-13:]:
        ws = split(t)
        if not ws:
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        weight, c = min(1.0, langid.CERTAIN / len(ws)), Counter(ws)
        z = [weight * sum(n * score(w, lang) for w, n in c.items()) for lang in languages]
        p = [math.exp(x - max(z)) for x in z]
        best = max(range(len(z)), key=lambda k: (z[k], -k))
        assert got[i].lang_pred == languages[best] or abs(max(p) - sorted(p)[-2]) < 1e-3, i
        assert got[i].score == pytest.approx(max(p) / sum(p), abs=2e-3), i


def test_too_many_languages_is_an_error(spark, docs, monkeypatch):
    monkeypatch.setattr(langid, "LANGUAGES", 2)
    with pytest.raises(ValueError):
        langid.held_out_predictions(docs)


# 9


def test_lm(docs, rows, empty, monkeypatch):
    monkeypatch.setattr(lm, "HOT", 50)  # most words take the join
    out = lm.held_out_scores(docs).collect()
    tokens = [(i, [*words(t, lower=True), b" "], zlib.crc32(str(i).encode()) % 7 == 2) for i, t, *_ in rows]
    c = Counter(w for _, ws, held in tokens if not held for w in ws)
    n, v = sum(c.values()), len(c)
    expected = {i: (held, len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for i, ws, held in tokens}
    assert len(out) == len(rows)
    for r in out:
        e = expected[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == e[:4] and r.base_score == pytest.approx(e[4], rel=1e-9)
        assert r.score < 0
    assert lm.held_out_scores(empty).count() == 0


@pytest.mark.parametrize("bits", [lm.FILTER_BITS, 1 << 17, 0])
def test_lm_holds_all_pairs(docs, rows, monkeypatch, bits):
    """Those seen once too, in the filter, or beyond its size in the table; only errors of a small filter may raise a score."""
    monkeypatch.setattr(lm, "FILTER_BITS", bits)
    tokens = [(i, [*words(t, lower=True), b" "], zlib.crc32(str(i).encode()) % 7 == 2) for i, t, *_ in rows]
    c = Counter(w for _, ws, held in tokens if not held for w in ws)
    pairs = Counter(p for _, ws, held in tokens if not held for p in zip([b" ", *ws], ws, strict=False))
    assert sum(n == 1 for n in pairs.values()) > 100
    total = sum(c.values()) + len(c) + 1

    def middle(n):
        return (1.5 * 2 ** (n.bit_length() - 1) - 0.5 if n > 1 else n) if n else 0

    def score(ws):
        return sum(math.log10(lm.LAMBDA * min(1, middle(pairs[a, b]) / max(1, middle(c[a]))) + (1 - lm.LAMBDA) * (middle(c[b]) + 1) / total) for a, b in zip([b" ", *ws], ws, strict=False))

    expected = {i: score(ws) for i, ws, _ in tokens}
    got = {r.doc_id: r.score for r in lm.held_out_scores(docs).collect()}
    off = [abs(got[i] - e) / abs(e) for i, e in expected.items()]
    assert len(got) == len(expected) and (sum(off) / len(off) < 0.01 if bits else max(off) < 1e-9), (sum(off) / len(off), max(off))


def test_bloom_counts_never_fall_short(spark):
    rng = np.random.default_rng(1)
    keys, counts = rng.integers(1, 1 << 63, 5000, dtype=np.uint64), rng.integers(1, 3000, 5000)
    words_ = spark.createDataFrame(list(zip(keys.view(np.int64).tolist(), counts.tolist(), strict=True)), "word long, c long")
    none = spark.createDataFrame([], "key long, c long")
    bits, _ = lm.build_filter(lm.leveled(words_, none))
    level = lm.BloomCounts(bits).level(lm.filter_keys(keys))
    assert (level >= lm.levels_of(counts)).all() and (level == lm.levels_of(counts)).mean() > 0.99
    assert (lm.BloomCounts(bits).level(lm.filter_keys(rng.integers(1, 1 << 63, 5000, dtype=np.uint64))) == 0).mean() > 0.99


# 10


def check_packing(pieces, rows, limit=packing.LIMIT):
    model = bpe.WordBpe.load(bpe.tokenizer_path())
    ids = defaultdict(list)
    for i, t, *_ in rows:
        ids[i].append(model.library.encode(t or "", add_special_tokens=False).ids + [2])
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append(p)
        found = [d for d in ids[p.doc_id] if len(d) == p.doc_tokens]
        assert any(zlib.crc32(np.array(d[p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32 for d in found)
    for i, docs in ids.items():
        assert sum(p.length for p in by_doc[i]) == sum(map(len, docs))
        if len(docs) == 1:
            at = 0
            for p in sorted(by_doc[i], key=lambda p: p.start):
                assert p.start == at
                at += p.length
    padding = total = 0
    for own in by_seq.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= limit
        total += at
        padding += 0 if at & (at - 1) == 0 else limit - at
    return padding / total


def test_packing(docs, rows, empty):
    assert check_packing(packing.pack(docs).collect(), rows) < 0.02
    assert packing.pack(empty).count() == 0


def test_packing_in_small_buffers(docs, rows, monkeypatch):
    monkeypatch.setattr(packing, "BUFFER", 9000)
    model = bpe.WordBpe.load(bpe.tokenizer_path())
    packer, out = packing._Packer(model, 0, 4096), []
    for i, t, *_ in rows:
        out += packer.add(i, model.encode_bytes([(t or "").encode()])[0] + np.array([2], "<u4").tobytes())
    out += packer.flush(last=True)
    names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    from collections import namedtuple

    assert check_packing([namedtuple("P", names)(*x) for x in out], rows) < 0.05


def test_plan_is_optimal():
    rng = random.Random(4)
    for _ in range(60):
        cuts = np.cumsum([0] + [rng.randint(1, 300) for _ in range(rng.randint(1, 14))])
        costs = np.array([0] + [rng.choice([0, 8, 48]) for _ in cuts[1:]])
        limit = 512
        pad = lambda n: 0 if n & (n - 1) == 0 and n >= packing.LEAST_POWER else limit - n  # noqa: B023, E731
        best = [0.0] + [math.inf] * (len(cuts) - 1)
        for j in range(1, len(cuts)):
            for i in range(j):
                if cuts[j] - cuts[i] <= limit:
                    best[j] = min(best[j], best[i] + pad(int(cuts[j] - cuts[i])) + costs[j] + packing.WINDOW_COST)
        chosen = packing.plan(cuts, costs, limit)
        cost = sum(pad(int(cuts[b] - cuts[a])) + costs[b] + packing.WINDOW_COST for a, b in zip(chosen, chosen[1:], strict=False))
        assert cost == best[-1]


# rows that no id names

SAME_IDS = [(1, "a b c d e f g"), (1, "x b c d e f h"), (2, "a b  c d e f g"), (3, "a b c d e f g"), (3, "one more text with words"), (4, ""), (4, " "), (None, "e e e"), (None, "f f f"), (None, "E e e"), (None, "f f  f"), (5, "f f f")]


@pytest.mark.parametrize("kind", ["long", "string"])
def test_repeated_and_null_ids(spark, kind):
    table = spark.createDataFrame(SAME_IDS, "doc_id long, text string").withColumn("doc_id", F.col("doc_id").cast(kind)).withColumns({c: F.lit("clash") for c in (*EXTRA, "g_id", "g_sum", "_sum", "_class", "node", "n")})
    order = lambda rows: sorted((str(r.doc_id), " ".join(r.text.split()).lower()) for r in rows)
    near = order(sigtree.keep_one(table).collect())
    assert near == sorted([("1", "a b c d e f g"), ("1", "x b c d e f h"), ("3", "one more text with words"), ("4", ""), ("4", ""), ("None", "e e e"), ("5", "f f f")])
    first = order(blockdedup.keep_first(table).collect())
    assert first == sorted([("1", "a b c d e f g"), ("1", "x b c d e f h"), ("3", "one more text with words"), ("4", ""), ("4", ""), ("None", "e e e"), ("None", "e e e"), ("5", "f f f")])
    assert sigtree.keep_one(table).columns == table.columns == blockdedup.keep_first(table).columns
    pieces = packing.pack(table).collect()
    assert {p.doc_id for p in pieces} == {r.doc_id for r in table.collect()} and sum(p.start == 0 for p in pieces) == table.count()
    assert packing.pack(table.limit(0)).count() == 0


# all


def test_every_operator_has_a_query():
    assert [re.match(r"op(\d+)_", k).group(1) for k in queries.QUERIES] == [str(n) for n in range(1, 14)]
    assert set(queries.ORACLES) <= set(queries.QUERIES)


def brute_pipeline(docs, labels):
    """(id, text) of what the stages before packing keep of a table, row by row."""
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]
    toxic = {r.doc_id for r in toxicity.held_out_scores(docs, labels).where("predicted = 1").collect()}
    rows = [r for r in rows if r[0] not in toxic]
    rows = [r for r in rows if (m := brute_quality(r[1])) and not (m[0] < 20 or 100 * m[4] > 30 * m[0])]
    kept, seen = [], set()
    for r in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        k = re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "")
        if k not in seen:
            seen.add(k)
            kept.append(r)
    keep = {c for _, _, c in brute_components(kept)}
    return [r for r in kept if r[0] in keep]


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, DATA).collect()
    rows = brute_pipeline(spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet"))
    assert {p.doc_id for p in out} == {r[0] for r in rows}
    check_packing(out, rows)


def test_pipeline_on_odd_tables(spark, tmp_path, docs, empty):
    """Nulls, empty and very long texts, repeated rows, clashing columns; and a table without rows."""
    import corpus_pipeline

    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for name, table in (("odd", docs), ("none", empty)):
        held = table
        for _, stage in corpus_pipeline.STAGES[:-1]:
            held = stage(spark, held, str(tmp_path))
            assert held.columns == docs.columns
            held.write.parquet(f"{tmp_path}/{name}-{_}")
            held = spark.read.parquet(f"{tmp_path}/{name}-{_}")
        out = corpus_pipeline.STAGES[-1][1](spark, held, str(tmp_path)).collect()
        rows = brute_pipeline(table, labels) if name == "odd" else []
        assert {p.doc_id for p in out} == {r[0] for r in rows}
