"""Spelling variants, vector codes and n-gram joins against brute force, their SQL and edge cases."""

import hashlib
import itertools
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import ngram_join, set_trees, spelling, vector_codes
from corpusloom.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"
VECTORS = "vec_id long, embedding array<float>, label int"


def tuples(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", ["op11_spelling", "op12_vector_codes", "op13_ngram_join"])
def test_query_matches_sql(spark, name):
    duck = duckdb.connect()
    for f in os.listdir(SF):
        duck.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    df = QUERIES[name](spark, SF)
    wanted = duck.execute(ORACLE_SQL[name])
    names = [x[0] for x in wanted.description]
    assert sorted(names) == sorted(df.columns)
    assert tuples(df.select(*names)) == sorted(wanted.fetchall(), key=repr)


# Spelling variants


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def slow_variants(rows, least_length=7, least_count=2, ratio=10, lost=31):
    count = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % lost == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += len(run) >= least_length
    words = {w: n for w, n in count.items() if n >= least_count}
    form, near = {}, {}
    for w, n in words.items():
        near[w] = [v for v in words if one_edit(v, w)]
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= ratio * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return sorted(out, key=repr)


def spelled_rows():
    r = random.Random(11)
    stems = ["".join(r.choice("abcé") for _ in range(r.randint(6, 9))) for _ in range(12)] + ["aaaaaaaa", "Ébabcab", "abababab"]
    def typed():
        w = r.choice(stems)
        if r.random() < 0.2:
            k = r.randrange(len(w))
            w = r.choice([w[:k] + w[k + 1 :], w[:k] + r.choice("abÿ") + w[k:], w[:k] + "c" + w[k + 1 :]])
        return w.upper() if r.random() < 0.1 else w
    rows = [(k, " ".join(typed() for _ in range(r.randint(0, 60)))) for k in range(80)]
    return [*rows, (90, None), (91, ""), (92, "x" * 3000 + " " + "x" * 2999 + " " + "x" * 3000 + "-" + "x" * 2999), (None, rows[1][1]), (1, rows[1][1]), (93, "×÷ abcabca÷abcabca")]


@pytest.mark.parametrize("bucket", [1, 32])
def test_variants_equal_brute_force(spark, bucket):
    rows = spelled_rows()
    df = spark.createDataFrame(rows, DOCS).withColumns({"word": F.lit("clash"), "n": F.lit(1), "fixed": F.lit("x")})
    got = spelling.group_variants(df, ratio=3, lost_one_in=5, bucket=bucket)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    wanted = slow_variants(rows, ratio=3, lost=5)
    assert tuples(got) == wanted
    assert any(f is not None and f != root for _, f, root, *_ in wanted), "no chain of forms in the fixture"


def test_pairs_of_crowded_buckets_come_once(spark):
    words = ["".join(p) for k in range(1, 6) for p in itertools.product("ab", repeat=k)] + ["c" * 40 + x for x in ("", "a", "b", "ab")]
    df = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    for bucket in (1, 4, 1000):
        got = [(r["word"], r["near"]) for r in spelling.near_pairs(df, bucket).collect()]
        assert len(got) == len(set(got))
        assert set(got) == {(v, w) for v in words for w in words if one_edit(v, w)}


def test_no_words_no_rows(spark):
    assert spelling.group_variants(spark.createDataFrame([], DOCS)).collect() == []
    assert spelling.group_variants(spark.createDataFrame([(1, None), (2, "short"), (3, "onceonly")], DOCS)).collect() == []


# Vector codes


def slow_codes(rows, parts=8, entries=16, rounds=6):
    kept = [(v, [int(np.floor(4096 * float(x))) for x in e], lab) for v, e, lab in rows if e and all(x is not None and np.isfinite(x) for x in e)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0))
    step = len(kept[0][1]) // parts
    cut = [[x[p * step : (p + 1) * step] for _, x, _ in kept] for p in range(parts)]
    books = [[list(x) for x in c[:entries]] for c in cut]
    apart = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c, strict=True))
    near = lambda x, book: min((apart(x, c), k) for k, c in enumerate(book))[1]
    for _ in range(rounds):
        for p in range(parts):
            at = [near(x, books[p]) for x in cut[p]]
            for k in range(len(books[p])):
                own = [x for x, a in zip(cut[p], at, strict=True) if a == k]
                if own:
                    books[p][k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    out, total = [], Counter()
    for i, (v, _, lab) in enumerate(kept):
        code = [near(cut[p][i], books[p]) for p in range(parts)]
        error = sum(apart(cut[p][i], books[p][code[p]]) for p in range(parts))
        total[lab] += error
        out.append((v, "".join(f"{c:02x}" for c in code), error, lab))
    text = ",".join(str(x) for b in books for c in b for x in c)
    return sorted(((v, c, e, total[lab]) for v, c, e, lab in out), key=repr), hashlib.sha256(text.encode()).hexdigest()


def vector_rows(n, dim, seed=5):
    r = np.random.default_rng(seed)
    grid = lambda: [float(np.float32(x)) for x in r.integers(-3, 4, dim) / 8]
    rows = [(k, grid(), [None, 1, 2][k % 3]) for k in range(n)]
    bad = [(500, None, 1), (501, [], 1), (-5, [None] * dim, 1), (-4, [float("nan")] * dim, 2), (-3, [0.1] * (dim - 1) + [float("-inf")], None)]
    return [*rows, *bad, (600, rows[4][1], 7), (7, rows[7][1], None), (None, [-3.9999] * dim, 2)]


@pytest.mark.parametrize(("n", "dim"), [(150, 16), (9, 8)])
def test_codes_equal_brute_force(spark, n, dim):
    rows = vector_rows(n, dim)
    df = spark.createDataFrame(rows, VECTORS).withColumns({"whole": F.lit(1), "code": F.lit("clash"), "error": F.lit(2)}).repartition(5)
    coded, books = vector_codes.compress(df)
    assert (tuples(coded.select("vec_id", "code", "error", "label_error")), vector_codes.codebooks_digest(books)) == slow_codes(rows)


def test_screening_is_exact_where_float32_is_not():
    r = np.random.default_rng(2)
    for size in (3, 1 << 12, 1 << 25):
        book = r.integers(-size, size, (16, 8))
        book[5:9] = book[4] + r.integers(-1, 2, (4, 8))
        book[9] = book[5]
        x = np.concatenate([book[r.integers(0, 16, 500)] + r.integers(-2, 3, (500, 8)), r.integers(-size, size, (500, 8)), (book[:1] + book[1:2]) // 2])
        wanted = ((x[:, None, :] - book[None]) ** 2).sum(axis=2).argmin(axis=1)
        got, compared = vector_codes.nearest(x, book)
        assert (got == wanted).all()
        assert compared < x.shape[0] * 16
    far = np.full((4, 8), 10_000_000)
    far[1:] += np.arange(1, 4)[:, None]
    got, compared = vector_codes.nearest(far + np.array([[0], [0], [0], [-1]]), far)
    assert got.tolist() == [0, 1, 2, 2]
    assert compared > 4, "nothing was compared exactly"


def test_codes_of_no_and_of_odd_vectors(spark):
    coded, books = vector_codes.compress(spark.createDataFrame([], VECTORS))
    assert coded.collect() == [] and books == []
    with pytest.raises(Exception, match="beyond 16384"):
        vector_codes.compress(spark.createDataFrame([(1, [1e6] * 8, 1)], VECTORS))
    for rows in ([(1, [0.5] * 8, 1), (2, [0.5] * 16, 1)], [(1, [0.5] * 9, 1)]):
        with pytest.raises(ValueError, match="one length"):
            vector_codes.compress(spark.createDataFrame(rows, VECTORS))


def test_codes_stand_for_vectors(spark):
    df = spark.createDataFrame(vector_rows(60, 16), VECTORS)
    coded, books = vector_codes.compress(df)
    back = coded.withColumn("back", vector_codes.decompress(F.col("code"), books)).collect()
    for r in back:
        parts = [int(r["code"][2 * p : 2 * p + 2], 16) for p in range(8)]
        assert r["back"] == pytest.approx(np.concatenate([(books[p][c] + 0.5) / 4096 for p, c in enumerate(parts)]))


def test_many_labels_are_joined(spark, monkeypatch):
    df = spark.createDataFrame(vector_rows(60, 16), VECTORS)
    sent = tuples(vector_codes.compress(df)[0])
    monkeypatch.setattr(vector_codes, "MOST_SENT_LABELS", 0)
    assert tuples(vector_codes.compress(df)[0]) == sent


# N-gram joins


def slow_links(rows, words=3, percent=90):
    sets = []
    for _, t in rows:
        w = [x for x in re.split("[\x20\x09-\x0d]+", "".join(c.lower() if c < "\x80" else c for c in t or "")) if x]
        sets.append({" ".join(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set())
    label, links = list(range(len(rows))), [0] * len(rows)
    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            links[a] += 1
            links[b] += 1
            old, new = label[b], label[a]
            label = [new if x == old else x for x in label]
    out = []
    for k, (d, _) in enumerate(rows):
        ids = [i for (i, _), x in zip(rows, label, strict=True) if x == label[k] and i is not None]
        out.append((d, len(sets[k]), min(ids, default=None), links[k]))
    return sorted(out, key=repr)


def copied_rows(seed=1):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    rows, passage = [], [r.choice(vocabulary) for _ in range(60)]
    for n in (1, 2, 3, 8, 12, 20, 45, 120, 400):
        for _ in range(3):
            base = [r.choice(vocabulary) for _ in range(n)]
            for _ in range(9):
                copy = list(base)
                for _ in range(r.choice([0, 0, 1, 1, 2, max(1, n // 60)])):
                    k = r.randrange(len(copy) or 1)
                    copy[k : k + 1] = r.choice([[], [r.choice(vocabulary)], [*copy[k : k + 1], "new"]])
                rows.append(" ".join(copy).title() if r.random() < 0.1 else " ".join(copy))
            rows.append(" ".join(passage + base))
    rows = [(k * 7 % 1009, t) for k, t in enumerate(rows)]
    return [*rows, (2000, None), (2001, ""), (2002, " \n\t"), (None, rows[100][1]), (rows[3][0], rows[100][1]), (None, "alone here"), (2003, "y " * 20_000)]


@pytest.mark.parametrize(("percent", "tree_grams"), [(90, 1_000_000), (90, 300), (75, 2_000), (100, 500)])
def test_links_equal_brute_force(spark, percent, tree_grams):
    rows = copied_rows()
    df = spark.createDataFrame(rows, DOCS).withColumns({"row": F.lit(1), "n": F.lit("clash"), "node": F.lit(None).cast("int")}).repartition(6)
    got = ngram_join.set_links(df, percent=percent, tree_grams=tree_grams)
    assert tuples(got) == slow_links(rows, percent=percent)


def test_linked_sets_share_a_key():
    r = np.random.default_rng(3)
    for percent in (60, 80, 90, 97):
        bands, met = ngram_join.Bands(percent), 0
        for _ in range(1500):
            n = int(r.integers(1, 900))
            whole = np.unique(r.integers(0, 1 << 64, n, dtype=np.uint64))
            gone = r.integers(0, 1 + int(len(whole) * (100 - percent) / 100))
            a = np.delete(whole, r.choice(len(whole), int(r.integers(0, gone + 1)), replace=False))
            b = np.delete(whole, r.choice(len(whole), int(r.integers(0, gone + 1)), replace=False))
            shared = len(np.intersect1d(a, b))
            if not len(a) or not len(b) or np.array_equal(a, b) or 100 * shared < percent * (len(a) + len(b) - shared):
                continue
            met += 1
            assert np.intersect1d(bands.keys(a), bands.keys(b)).size, (percent, len(a), len(b), shared)
        assert met > 100


def test_prefix_tree_finds_all_links(monkeypatch):
    r = np.random.default_rng(9)
    for cells in (50, 1 << 24):
        monkeypatch.setattr(set_trees, "CELLS_AT_ONCE", cells)
        for _ in range(20):
            base = r.integers(0, 1 << 62, 60, dtype=np.uint64)
            sets = [np.unique(r.choice(base, int(r.integers(1, 60)), replace=False)) for _ in range(40)] + [base[:0]]
            sizes = np.array([len(s) for s in sets])
            ranks, width = set_trees._ranked(sets)
            got = {(int(a), int(b)) for q, y in set_trees.PrefixTree(ranks, sizes).links(ranks, sizes, width, 70) for a, b in zip(q, y, strict=True)}
            wanted = {(a, b) for a in range(40) for b in range(40) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 70 * len(np.union1d(sets[a], sets[b]))}
            assert {p for p in got if 40 not in p} == wanted


def test_no_documents_no_rows(spark):
    assert ngram_join.set_links(spark.createDataFrame([], DOCS)).collect() == []
