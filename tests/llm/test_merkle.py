from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from lethe.llm import merkle
from lethe.llm.queries import QUERIES
from tests.llm.cases import SCHEMA, awkward, awkward_rows, empty, saved


def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def code(value) -> str:
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def climb(level: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
    """Root, and per leaf the digests left and right of it on each level."""
    at = list(range(len(level)))
    paths = [[] for _ in level]
    while len(level) > 1:
        runs = [level[i : i + 8] for i in range(0, len(level), 8)]
        for leaf, place in enumerate(at):
            run, k = runs[place // 8], place % 8
            paths[leaf].append(("".join(run[:k]), "".join(run[k + 1 :])))
        level, at = [h(*run) for run in runs], [place // 8 for place in at]
    return level[0], paths


def brute_force(rows: list[tuple]) -> dict:
    """``(doc_id, leaf) -> (subroot, root, path)`` from rows of the query's five fields."""
    groups: dict = {}
    for row in rows:
        leaf = h(*[code(v) for v in row])
        groups.setdefault(row[2], []).append(((row[0] is not None, row[0] or 0), leaf, row[0]))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        leaves = sorted(groups[g])
        trees[g] = leaves, *climb([leaf for _, leaf, _ in leaves])
    root, above = climb([trees[g][1] for g in order])
    out: dict = {}
    for g, up in zip(order, above, strict=True):
        leaves, subroot, paths = trees[g]
        for (_, leaf, doc_id), path in zip(leaves, paths, strict=True):
            out.setdefault((doc_id, leaf), []).append((subroot, root, path + up))
    return {k: sorted(v) for k, v in out.items()}


def found(df) -> dict:
    leaf = merkle.row_digest(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")])
    rows = merkle.build_manifest(df, leaf, carried=[F.col("doc_id")]).collect()
    out: dict = {}
    for r in rows:
        path = [(s.left, s.right) for s in r.path]
        out.setdefault((r.doc_id, r.leaf), []).append((r.subroot, r.root, path))
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("digits", [1, 3])
def test_awkward_rows(spark, digits, monkeypatch):
    # Few digits make small blocks, so that blocks are rolled up over several rounds.
    monkeypatch.setattr(merkle, "DIGITS", digits)
    want = brute_force([(r[0], r[3], r[2], r[4], r[1]) for r in awkward_rows()])
    assert found(awkward(spark)) == want


def test_a_group_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(merkle, "DIGITS", 1)
    rows = [(i, "s", "en" if i % 50 else f"l{i}", i, f"text {i}") for i in range(130)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert found(df) == brute_force(rows)


def test_lone_leaf_is_its_own_root(spark):
    rows = [(7, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    ((key, ((subroot, root, path),)),) = found(df).items()
    assert key[1] == subroot == root == h("1:7", "-" * 4) and path == []


def test_empty_table(spark):
    assert found(empty(spark)) == {}


def test_null_and_empty_differ(spark):
    rows = spark.createDataFrame([(None,), ("",), ("-",), ("0:",)], "v string")
    assert len({r[0] for r in rows.select(merkle.field_code(F.col("v"))).collect()}) == 4


def test_query_on_awkward_rows(spark, tmp_path):
    import zlib

    rows = awkward_rows()
    sf_dir = saved(spark, rows, SCHEMA, tmp_path)
    result = QUERIES["op13_merkle_manifest"](spark, sf_dir).collect()
    want = brute_force([(r[0], r[3], r[2], r[4], r[1]) for r in rows])
    assert len(result) == len(rows)
    # Rows with one leaf stand at several places of one text's run; any of them will do.
    changed = {}
    for i, text, lang, source, n, *_ in rows:
        leaf = h(*[code(v) for v in (i, source, lang, n, text)])
        low = text and "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        told = i is not None and zlib.crc32(str(i).encode()) % 3 == 0
        changed[i, leaf] = h(*[code(v) for v in (i, source, lang, n, low if told else text)])
    left = {k: list(v) for k, v in want.items()}
    for r in result:
        for place in left[r.doc_id, r.leaf]:
            subroot, root, path = place
            back = changed[r.doc_id, r.leaf]
            for a, b in path:
                back = h(a, back, b)
            if (subroot, root, h(*[x for s in path for x in s])) == (r.subroot, r.root, r.proof_sha256):
                assert r.folded_root == back and r.verified == (back == root)
                left[r.doc_id, r.leaf].remove(place)
                break
        else:
            raise AssertionError(r)
    assert not any(left.values())


def test_plan_has_no_join_after_ranking(spark):
    """Roll-up and proofs are groupings and explodes; only the ranking meets its offsets."""
    df = spark.createDataFrame([(i, "s", "en", i, "t") for i in range(600)], "doc_id long, source string, lang string, n_chars long, text string")
    leaf = merkle.row_digest(F.col("doc_id"))
    plan = merkle.build_manifest(df, leaf)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Generate" in plan
