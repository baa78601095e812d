from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lethe.llm import quality_rules as rules
from lethe.llm.queries import QUERIES
from tests.llm.cases import SCHEMA, awkward, awkward_rows, empty, prose, saved

WHITE = " \t\n\x0b\x0c\r"


def split(text):
    out, word = [], ""
    for c in text:
        if c in WHITE:
            if word:
                out.append(word)
            word = ""
        else:
            word += c
    return out + [word] * bool(word)


def plain_statistics(text):
    text = text or ""
    words = split(text)
    lines = [line for line in text.split("\n") if line.strip(WHITE)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    inside = "".join(words)
    return (
        len(words),
        len(inside),
        sum(c in "#*$%&|<>" for c in text),
        len(lines),
        len(lines) - len(set(lines)),
        len(repeated),
        sum("A" <= c <= "Z" for c in inside),
        sum(33 <= ord(c) < 127 and not c.isalnum() for c in inside),
    )


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab#|\n\t \x0b\x1c éA日", max_size=80))
def test_statistics_are_those_of_brute_force(text):
    assert rules.text_statistics(text) == plain_statistics(text)


def test_chi_square_quantiles():
    for share, dimensions, value in ((0.95, 1, 3.841459), (0.5, 2, 1.386294), (0.999, 7, 24.321886)):
        assert abs(rules.chi_square_quantile(share, dimensions) - value) < 1e-5


def features(s):
    n, chars = max(s[0], 1), max(s[1], 1)
    values = (
        math.log2(1 + s[0]),
        math.log2((s[1] + 1) / n),
        math.sqrt(s[2] / chars),
        s[4] / max(s[3], 1),
        s[5] / n,
        math.sqrt(s[6] / chars),
        math.sqrt(s[7] / chars),
    )
    return [math.floor(v * rules.SCALE + 0.5) for v in values]


def estimate(x):
    floor = np.diag(np.square(np.array(rules.FLOOR) * rules.SCALE))
    c = np.cov(x.T, bias=True).reshape(len(rules.FLOOR), -1) + floor
    return x.mean(0), np.linalg.inv(c), np.linalg.slogdet(c)[1]


def distances(x, mean, inverse):
    return np.einsum("ij,jk,ik->i", x - mean, inverse, x - mean)


def concentrate(x, d):
    bins = np.floor(np.log2(np.maximum(d, 1e-6)) * rules.BINS)
    order = np.sort(bins)
    most = order[math.ceil(len(x) * rules.HALF) - 1]
    middle = 2 ** ((order[math.ceil(len(x) / 2) - 1] + 0.5) / rules.BINS)
    return *estimate(x[bins <= most]), middle


def least_determinant(x):
    """One group with all its rows in memory: both starts, all steps, the final weighting."""
    floor = np.array(rules.FLOOR) * rules.SCALE
    median = np.median(x, axis=0)
    spread = np.maximum(1.4826 * np.median(abs(x - median), axis=0), floor)
    z = np.square((x - median) / spread)
    ends = []
    for d in (z.sum(1), z.max(1)):
        now = concentrate(x, d)
        for _ in range(rules.MAX_STEPS):
            then = concentrate(x, distances(x, *now[:2]))
            if not then[2] < now[2] - 1e-9:
                break
            now = then
        ends.append(now)
    mean, inverse, _, middle = min(ends, key=lambda e: round(e[2], 9))
    size = len(rules.FLOOR)
    usual = max(middle / rules.chi_square_quantile(0.5, size), 1.0)
    inside = distances(x, mean, inverse) <= usual * rules.chi_square_quantile(rules.INLIERS, size)
    return estimate(x[inside])[:2]


def brute_force(rows):
    """``{place: (statistics, base_failed, distance)}`` for rows of text, lang and source."""
    stats = [plain_statistics(t) for t, _, _ in rows]
    failed = [s[0] < 10 or 100 * s[5] > 20 * s[0] for s in stats]
    own = Counter((lang, src) for (_, lang, src), f in zip(rows, failed, strict=True) if not f)
    langs: Counter = Counter()
    for (lang, _), n in own.items():
        langs[lang] += n * (n < rules.MIN_ROWS)
    rest = sum(n for n in langs.values() if n < rules.MIN_ROWS)
    groups = defaultdict(list)
    for i, ((_, lang, src), f) in enumerate(zip(rows, failed, strict=True)):
        if not f:
            if own[lang, src] >= rules.MIN_ROWS:
                groups[0, lang, src].append(i)
            elif langs[lang] >= rules.MIN_ROWS:
                groups[1, lang].append(i)
            elif rest >= rules.MIN_ROWS:
                groups[2,].append(i)
    distance = {}
    for places in groups.values():
        x = np.array([features(stats[i]) for i in places], float)
        distance.update(zip(places, distances(x, *least_determinant(x)), strict=True))
    return [(s, f, distance.get(i)) for i, (s, f) in enumerate(zip(stats, failed, strict=True))]


def check(result, rows):
    """Every row has the statistics, the distance and the verdict of brute force."""
    cut = rules.chi_square_quantile(rules.OUTLIERS, len(rules.FLOOR))
    want = defaultdict(list)
    for (doc_id, *_), (s, failed, d) in zip(rows, brute_force([r[1:4] for r in rows]), strict=True):
        want[doc_id].append((s[0], s[1], s[2], s[4], s[5], failed, d))
    got = defaultdict(list)
    for r in result:
        assert r.kept == (not r.base_failed and (r.distance is None or r.distance <= cut))
        got[r.doc_id].append(
            (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.distance)
        )
    assert got.keys() == want.keys()
    for doc_id, a in got.items():
        b = want[doc_id]
        assert len(a) == len(b)
        for x, y in zip(sorted(a, key=repr), sorted(b, key=repr), strict=True):
            assert x[:6] == y[:6] and (x[6] is None) == (y[6] is None), doc_id
            assert x[6] is None or math.isclose(x[6], y[6], rel_tol=1e-6, abs_tol=1e-6), doc_id


def test_query_is_brute_force_on_given_documents(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    result = QUERIES["op12_quality_rules"](spark, sf_dir).collect()
    check(result, [tuple(r) for r in docs.collect()])
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    kept = {q: [r.kept for r in result if labels.get(r.doc_id) == q and not r.base_failed] for q in (0, 1)}
    assert np.mean(kept[1]) > 0.98 and np.mean(kept[0]) < 0.35


@pytest.mark.parametrize("broadcast", [10_000, 0])
def test_groups_of_their_own_and_shared_ones(spark, tmp_path, monkeypatch, broadcast):
    monkeypatch.setattr(rules, "BROADCAST_GROUPS", broadcast)
    rows = []
    for i in range(400):
        source = "hot" if i % 2 else f"s{i % 40}"
        junk = "| " * 30 if i % 19 == 0 else ""
        rows.append((i, junk + prose(i, 20 + i % 90), "en" if i % 3 else "de", source))
    rows += [(1000 + i, prose(i, 50), None, None) for i in range(10)]
    filler = awkward_rows()[0][4:]
    sf_dir = saved(spark, [(*r, *filler) for r in rows], SCHEMA, tmp_path)
    check(QUERIES["op12_quality_rules"](spark, sf_dir).collect(), rows)


def test_awkward_rows_are_too_few_to_judge(spark, tmp_path):
    rows = awkward_rows()
    sf_dir = saved(spark, rows, SCHEMA, tmp_path)
    result = QUERIES["op12_quality_rules"](spark, sf_dir).collect()
    check(result, [r[:4] for r in rows])
    assert all(r.distance is None and r.kept != r.base_failed for r in result)


def test_empty_table(spark):
    assert rules.judge_documents(empty(spark)).collect() == []


def test_kept_columns_may_clash(spark):
    df = awkward(spark).withColumnRenamed("taken", "kept").withColumnRenamed("id", "g")
    found = rules.judge_documents(df, keep=["doc_id", "kept", "g", "text", "lang"])
    assert found.columns[:5] == ["doc_id", "kept", "g", "text", "lang"] and "kept_" in found.columns
    assert found.count() == len(awkward_rows())


@pytest.mark.parametrize("n", [1, 9])
def test_no_spread_at_all(n):
    spread, mean, inverse = rules.ridge_estimate(n, [5 * n] * 7, [25 * n] * len(rules.PAIRS))
    assert mean == [5.0] * 7 and np.isfinite(inverse).all() and math.isfinite(spread)
