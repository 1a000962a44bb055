"""Near copies in crowded shards, and with many links a text, against brute force."""

import functools
import random

import numpy as np
import pytest

from corpusloom.llm import set_trees, simhash

VOCABULARY = [f"w{k}" for k in range(4000)]


def shingles(text):
    w = text.split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def stay(rows, similarity=0.8):
    """The least id of each group of texts that pairs of the similarity connect."""
    sets = [shingles(t) for _, t in rows]
    place = {}
    for s in sets:
        for x in s:
            place.setdefault(x, len(place))
    held = np.zeros((len(rows), len(place)), dtype=np.float32)
    for k, s in enumerate(sets):
        held[k, [place[x] for x in s]] = 1
    n = held.sum(axis=1)
    shared = held @ held.T
    alike = shared >= similarity * (n[:, None] + n[None, :] - shared)
    label = np.arange(len(rows))
    while True:
        new = np.where(alike, label[None, :], len(rows)).min(axis=1)
        if (new == label).all():
            return {rows[k][0] for k in np.unique(label)}
        label = new


def changed(r, words, n, k):
    out = list(words)
    for at in r.sample(range(len(out)), n):
        out[at] = f"new{k}x{at}"
    return " ".join(out)


def test_pairs_in_crowded_shards_are_met(spark, monkeypatch):
    """Keys of four bits crowd all shards: what the first round's cuts part is met in the second."""
    monkeypatch.setattr(simhash, "LEAST_BITS", 4)
    r, rows = random.Random(2), []
    for k in range(150):
        words = [r.choice(VOCABULARY) for _ in range(r.randint(80, 160))]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, changed(r, words, max(1, len(words) // 60), k))]
    wanted = stay(rows)
    assert len(wanted) < 160
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x["doc_id"] for x in simhash.keep_one_a_group(df, tree_size=16).collect()} == wanted


@pytest.mark.parametrize(("tree_size", "tree_grams"), [(128, 20_000), (4096, 300_000)])
def test_a_crowd_with_links_at_the_edge(spark, monkeypatch, tree_size, tree_grams):
    """1,200 copies of one text, each like the text or some copies only, beside their own copies and strangers."""
    monkeypatch.setattr(simhash, "linked_sets", functools.partial(set_trees.linked_sets, tree_grams=tree_grams))
    r, rows = random.Random(5), []
    base = [r.choice(VOCABULARY) for _ in range(150)]
    rows.append((5000, " ".join(base)))
    far = [changed(r, base, r.choice([4, 5, 6, 8]), f"f{k}").split() for k in range(60)]
    for k in range(1200):
        words = base if r.random() < 0.7 else r.choice(far)
        rows.append((k, changed(r, words, r.choice([1, 2, 3, 3, 4]), k)))
    rows += [(6000 + k, " ".join(w)) for k, w in enumerate(far)]
    rows += [(7000 + k, " ".join(r.choice(VOCABULARY) for _ in range(120))) for k in range(40)]
    wanted = stay(rows)
    assert 60 < len(wanted) < 400
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {x["doc_id"] for x in simhash.keep_one_a_group(df, tree_size=tree_size).collect()}
    # Of links of just 0.8 two in a hundred may agree in no key.
    assert len(got ^ wanted) <= 2, (sorted(got - wanted)[:9], sorted(wanted - got)[:9])
