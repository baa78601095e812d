from __future__ import annotations

import hashlib
import zlib
from fractions import Fraction

from hypothesis import given, settings
from hypothesis import strategies as st

from lethe.llm.periodic import find_runs, repeated_regions, runs_of_words
from lethe.llm.queries import QUERIES
from lethe.llm.suffix_tree import Extensions, all_runs, build_tree
from tests.llm.cases import SCHEMA, awkward, awkward_rows, empty, prose, saved


def brute_runs(words, least, periods):
    """Every period, every stretch of words equal to those one period on."""
    n, seen, out = len(words), set(), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i >= q and (i, j + q) not in seen:  # else a shorter period had it
                seen.add((i, j + q))
                if j + q - i >= max(least, periods * q):
                    out.append((i, j + q - i, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


words_of = st.integers(1, 4).flatmap(lambda k: st.lists(st.integers(0, k), max_size=50))


@st.composite
def cyclic(draw):
    words = draw(words_of)
    if not words:
        return words
    a = draw(st.integers(0, len(words) - 1))
    p = draw(st.integers(1, max(1, (len(words) - a) // 2)))
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


@settings(max_examples=400, deadline=None)
@given(cyclic(), st.sampled_from([(2, 2), (6, 3), (24, 3), (5, 2)]))
def test_runs_are_those_of_brute_force(words, limits):
    want = brute_runs(words, *limits)
    assert [tuple(r) for r in all_runs(words, *limits).tolist()] == sorted(want)
    spelt = [b"%d" % w for w in words]
    assert [tuple(r) for r in runs_of_words(spelt, *limits).tolist()] == want


@settings(max_examples=200, deadline=None)
@given(words_of)
def test_tree_spells_all_suffixes(words):
    closed = [*words, -1]
    parent, first, begin, end = build_tree(closed)
    inner = set(parent)
    spelt = []
    for v in range(1, len(parent)):
        assert closed[begin[v]] == first[v]
        if v not in inner:
            path = []
            while v > 0:
                path = closed[begin[v] : end[v]] + path
                v = parent[v]
            spelt.append(path)
    assert sorted(spelt) == sorted(closed[i:] for i in range(len(closed)))


@settings(max_examples=200, deadline=None)
@given(words_of.filter(bool))
def test_orders_and_extensions(words):
    tree = Extensions(words)
    n = len(words)
    assert tree.order == sorted(range(n + 1), key=lambda i: words[i:])
    assert tree.reversed_order() == sorted(range(n + 1), key=lambda i: [-w for w in words[i:]])
    import numpy as np

    pairs = [(i, j) for i in range(n) for j in range(i + 1, n + 1)]
    a, b = np.array(pairs).T
    for (i, j), found in zip(pairs, tree.common(a, b).tolist(), strict=True):
        k = 0
        while j + k < n and words[i + k] == words[j + k]:
            k += 1
        assert found == k


def test_plain_prose_needs_no_tree():
    import numpy as np

    words = prose(3, 5000).split()
    known = {w: i for i, w in enumerate(words)}
    codes = np.array([known[w] for w in words] + list(range(9000, 9010)) * 5)
    ((low, high),) = repeated_regions(codes, 24, 3)
    assert low <= 5000 and high - low < 100


def expected(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and words:
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = [tuple(r) for r in runs_of_words(words, 24, 3).tolist()] if len(words) > 3000 else brute_runs(words, 24, 3)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    milli = 1000 * best[1] // best[2] if runs else None
    return (doc_id, len(runs), *best, milli, sha(listed.encode()), sha(kept))


def key(row):
    return repr(row)


def test_query_on_awkward_rows(spark, tmp_path):
    rows = awkward_rows()
    # Ids whose documents are made cyclic, with texts of all sizes.
    chosen = [i for i in range(100, 400) if zlib.crc32(str(i).encode()) % 10 == 0]
    filler = rows[0][4:]
    texts = ["", " ", "one", "a b", None, *[prose(i, 40 * i) for i in range(1, 12)]]
    rows += [(i, t, "en", "a", *filler) for i, t in zip(chosen, texts, strict=False)]
    loop = " ".join(f"w{i % 7}" for i in range(100))
    rows += [(900, loop, "en", "a", *filler), (901, f"{prose(4, 30)} {loop}\n{prose(5, 30)} {loop}", "en", "a", *filler)]
    sf_dir = saved(spark, rows, SCHEMA, tmp_path)
    result = QUERIES["op11_periodic_runs"](spark, sf_dir).collect()
    assert sorted(map(key, map(tuple, result))) == sorted(key(expected(r[0], r[1])) for r in rows)
    assert sum(r.n_runs > 0 for r in result) > 10


def test_operator_keeps_clashing_columns(spark):
    df = awkward(spark).withColumnRenamed("taken", "runs").withColumnRenamed("id", "collapsed")
    found = find_runs(df, keep=["doc_id", "runs", "collapsed"])
    assert found.columns == ["doc_id", "runs", "collapsed", "n_words", "runs_", "collapsed_"]
    assert found.count() == len(awkward_rows())


def test_empty_table(spark):
    assert find_runs(empty(spark)).collect() == []


def test_a_very_long_text(spark):
    words = prose(9, 100).split() * 400
    ((row),) = find_runs(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")).collect()
    (run,) = row.runs
    assert (run.start, run.length, run.period) == (0, 40_000, 100) and row.collapsed.split() == words[:100]
