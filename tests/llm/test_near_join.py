from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lethe.llm import near_join
from lethe.llm.components import connected_components
from lethe.llm.near_join import drop_near_copies, found_per_run, near_copies, runs_needed
from lethe.llm.shingles import shingle_set, sketch, word_hashes
from tests.llm.cases import awkward, awkward_rows, empty, prose

SF_DIR = "/root/testdata/sf0.001"


def words_model(text):
    words = [w for w in (text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """Class and links of each row, from all pairs."""
    sets = [words_model(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = Counter()
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                common = len(sets[i] & sets[j])
                if common / (len(sets[i]) + len(sets[j]) - common) >= 0.8:
                    links[i] += 1
                    links[j] += 1
                    parent[root(i)] = root(j)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        out.append((doc_id, min(ids) if ids else None, links[i]))
    return sorted(out, key=repr)


def result(df):
    return sorted(((r.doc_id, r.class_id, r.links) for r in near_copies(df).collect()), key=repr)


def test_query_against_all_pairs(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    assert result(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])


def variants(n, seed=0):
    """Near copies of a few texts, some linked only over others, and unrelated texts."""
    rng, rows = random.Random(seed), []
    bases = [prose(100 + i, 90).split() for i in range(4)]
    for i in range(n):
        words = list(rng.choice(bases))
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = f"w{rng.randint(0, 5)}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, prose(500 + i, 60)) for i in range(60)]
    return rows


@pytest.mark.parametrize("limits", [{}, {"BUCKET": 8, "TILE": 8}, {"BUCKET": 8, "TILE_SHINGLES": 300}])
def test_small_limits_lose_nothing(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(near_join, name, value)
    rows = variants(150)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(df) == brute(rows)


def test_tiles_hold_every_pair_once(spark, monkeypatch):
    monkeypatch.setattr(near_join, "TILE", 5)
    rng = random.Random(1)
    rows = [(bytes([1]), bytes([i]), bytes([i]), 1, rng.randint(20, 60)) for i in range(80)]
    df = spark.createDataFrame(rows, "component binary, `set` binary, row_key binary, copies long, n long")
    tiled = near_join._tiles(df).select("set", F.explode("tiles").alias("t")).select("set", "t.*")
    tiles = {}
    for r in tiled.collect():
        tiles.setdefault(r.tile, []).append((bytes(r.set), r.side))
    met = Counter()
    for members in tiles.values():
        across = members[0][1] > 0
        assert all((s > 0) == across for _, s in members)
        for i, (a, s) in enumerate(members):
            for b, t in members[:i]:
                if s != t or not across:
                    met[frozenset((a, b))] += 1
    assert set(met.values()) == {1}
    size = {bytes(r[1]): r[4] for r in rows}
    for a in size:
        for b in size:
            if a < b and min(size[a], size[b]) >= 0.8 * max(size[a], size[b]):
                assert frozenset((a, b)) in met


def test_awkward_rows(spark):
    df = awkward(spark)
    want = brute([r[:2] for r in awkward_rows()])
    empties = {r[0] for r in awkward_rows() if not words_model(r[1])}
    got = result(df)
    assert [g for g in got if g[0] not in empties] == [w for w in want if w[0] not in empties]
    out = drop_near_copies(df)
    assert out.columns == df.columns
    without = sum(not words_model(r[1]) for r in awkward_rows())
    classes = {w[1] for w in brute([r[:2] for r in awkward_rows() if words_model(r[1])])}
    # A text without words is kept whatever else has its id.
    assert out.count() == without + len(classes)
    assert near_copies(empty(spark)).count() == 0


def test_one_of_each_class_is_kept(spark):
    rows = variants(60)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    classes = {c for _, c, _ in brute(rows)}
    assert sorted(r.doc_id for r in drop_near_copies(df).collect()) == sorted(classes)


def test_recall_of_runs():
    assert found_per_run(1) == pytest.approx(0.632, abs=1e-3)
    assert 1 - (1 - found_per_run()) ** runs_needed() >= near_join.RECALL


def test_sketch_estimates_similarity():
    a = [f"w{i}" for i in range(2000)]
    b = a[:1700] + [f"v{i}" for i in range(300)]
    x, y = shingle_set(" ".join(a)), shingle_set(" ".join(b))
    true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    assert abs((sketch(x) == sketch(y)).mean() - true) < 0.12


def test_word_hashes_depend_on_the_word_alone():
    a, b = word_hashes("aa bb\tcc  aa\n"), word_hashes(" cc bb aa")
    assert a[0] == a[3] == b[2] and a[1] == b[1] and a[2] == b[0] and len(set(a.tolist())) == 3


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rng.randint(100, 160), rng.randint(100, 160)) for _ in range(40)]
    edges += [(200, i) for i in range(201, 260)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    assert got == {x: root(x) for x in parent}
