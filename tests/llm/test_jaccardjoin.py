"""The size-aware Jaccard join against comparing all pairs."""

import collections
import random

import pytest
from test_operators import SCHEMA, made_docs

from lodestar.llm import jaccardjoin


def brute(rows, percent=85, shingle=4):
    sets = []
    for r in rows:
        w = (r[1] or "").encode().lower().split()
        sets.append({b" ".join(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return collections.Counter((r[0], len(sets[i]), least.get(find(i))) for i, r in enumerate(rows))


def found(spark, rows, **kw):
    docs = spark.createDataFrame([(*r, *[None] * (6 - len(r))) for r in rows], SCHEMA).repartition(3)
    return collections.Counter(map(tuple, jaccardjoin.similar_documents(docs, **kw).collect()))


def near_copies(rng, sizes, copies, edits):
    vocab = [f"v{i}" for i in range(3000)]
    out = []
    for n in sizes:
        base = [rng.choice(vocab) for _ in range(n)]
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randint(0, edits)):
                at = rng.randrange(len(w))
                if rng.random() < 0.4:
                    del w[at]
                elif rng.random() < 0.5:
                    w.insert(at, rng.choice(vocab))
                else:
                    w[at] = rng.choice(vocab)
                if not w:
                    break
            out.append(" ".join(w))
    rng.shuffle(out)
    return [(i * 7 % 10_007, t) for i, t in enumerate(out)]


def test_odd_rows_match_brute_force(spark):
    rows = made_docs()
    assert found(spark, rows) == brute(rows)
    assert jaccardjoin.similar_documents(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize(("percent", "shingle", "tile"), [(85, 4, 4096), (85, 1, 3), (60, 2, 5), (100, 4, 4096)])
def test_random_near_copies_match_brute_force(spark, percent, shingle, tile, monkeypatch):
    monkeypatch.setattr(jaccardjoin, "TILE", tile)
    rng = random.Random(percent + shingle)
    rows = near_copies(rng, [1, 2, 3, 4, 5, 8, 10, 12, 14, 16, 17, 18, 20, 22, 25, 30, 40, 60, 90, 150], 9, 3)
    assert found(spark, rows, percent=percent, shingle=shingle) == brute(rows, percent, shingle)


@pytest.mark.parametrize("most", [0, 9, 17, 20])
def test_any_boundary_gives_the_same_links(spark, most, monkeypatch):
    monkeypatch.setattr(jaccardjoin, "boundary", lambda sets, percent: most)
    rng = random.Random(most)
    rows = near_copies(rng, list(range(4, 30)), 6, 2)
    assert found(spark, rows) == brute(rows)


def test_one_base_with_many_unlike_copies(spark, monkeypatch):
    # copies that share a list and are linked through chains only
    monkeypatch.setattr(jaccardjoin, "TILE", 50)
    rng = random.Random(4)
    rows = near_copies(rng, [60], 400, 3)
    want = brute(rows)
    assert len({c for _, _, c in want}) > 3
    assert found(spark, rows) == want


def test_a_passage_that_thousands_share_links_nobody(spark):
    rng = random.Random(5)
    words = lambda n: " ".join(rng.choice("abcdefghij") + str(rng.randrange(500)) for _ in range(n))
    shared = words(30)
    rows = [(i, f"{words(40)} {shared}") for i in range(1500)] + [(2000 + i, shared) for i in range(3)]
    got = found(spark, rows)
    assert {(i, c) for i, _, c in got if i < 2000} == {(i, i) for i in range(1500)}
    assert {c for i, _, c in got if i >= 2000} == {2000}


def test_texts_longer_than_a_piece(spark):
    rng = random.Random(9)
    words = [f"w{rng.randrange(5000)}" for _ in range(200_000)]
    other = [*words[:190_000], *(f"x{i}" for i in range(6_000))]
    rows = [(1, " ".join(words)), (2, "\n".join(other)), (3, " ".join(words[:60_000])), (4, "y" * 700_000), (5, "y" * 700_000)]
    assert len(rows[0][1]) > 4 * jaccardjoin.PIECE
    assert found(spark, rows) == brute(rows)
    assert {c for i, _, c in brute(rows) if i < 3} == {1}
