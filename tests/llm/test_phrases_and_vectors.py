"""Phrase collocations, whitening and the vector forest against plain versions."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom.llm import collocations, vector_forest, whitening

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 977}" for i in range(30_000))


def plain_collocations(rows, least, top):
    """(lang, text) -> the contract's rows, with whole-number arithmetic."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(lower)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang in f:
        found = {p: a for p, a in f[lang].items() if a >= least}
        held = {q for p, a in found.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if len(q := p[i:j]) < len(p) and 100 * a >= 100 * found[q]}
        own = []
        for p, a in found.items():
            if len(p) > 1 and p not in held:
                score, _, l, r = min((1000 * a * n[lang] // (found[p[:k]] * found[p[k:]]), k, found[p[:k]], found[p[k:]]) for k in range(1, len(p)))
                own.append((" ".join(p), a, l, r, n[lang], score))
        own.sort(key=lambda x: (-x[5], -x[1], x[0].encode()))
        out += [(lang, k + 1, *x) for k, x in enumerate(own[:top])]
    return sorted(out)


@pytest.fixture
def small_shards(monkeypatch):
    monkeypatch.setattr(collocations, "TEXT_BYTES", 50)
    monkeypatch.setattr(collocations, "RANK_ROWS", 10)
    monkeypatch.setattr(collocations, "BATCH_ROWS", 7)


@pytest.mark.parametrize("least,top", [(3, 2000), (2, 5)])
def test_collocations_match_brute_force(spark, small_shards, least, top):
    draw = random.Random(3)
    words = ["New", "york", "new", "de", "a", "É", "é", "x\x00y", "\x1c", "1", "naïve"]
    glue = [" ", "  ", "\t", " ", ". ", "\n", "\x0b", "!", " "]
    text = lambda: "".join(draw.choice(words) + draw.choice(glue) for _ in range(draw.randrange(30)))
    rows = [(draw.choice(["en", "en", "fr", None, "und"]), text()) for _ in range(120)]
    rows += [("en", None), ("en", ""), ("fr", " \t.\n"), (None, None), ("en", "same words here again")] + [("en", "same words here")] * 4 + [("de", LONG)]
    df = spark.createDataFrame([(a, b, 1, 2, "z") for a, b in rows], "lang string, text string, n long, words int, phrase string").repartition(3)
    got = sorted(tuple(r) for r in collocations.collocations(df, least=least, top=top).collect())
    assert got == plain_collocations(rows, least, top)
    assert collocations.collocations(df.limit(0)).count() == 0
    assert collocations.collocations(df.withColumn("text", F.lit(None).cast("string")), least=least).count() == 0


@pytest.mark.parametrize("depth", [1, 2, 3, 5, 8])
def test_suffix_array_orders_suffixes_to_its_depth(depth):
    draw = np.random.default_rng(depth)
    ids = draw.integers(0, 4, 500).astype(np.int32)
    order, common = collocations.suffix_array(ids, depth)
    padded = [*ids.tolist(), *[0] * depth]
    keys = [padded[i : i + depth] for i in order]
    assert sorted(order.tolist()) == list(range(500)) and keys == sorted(keys)
    for a, b, c in zip(keys, keys[1:], common[1:], strict=False):
        assert c == next((k for k in range(depth) if a[k] != b[k]), depth)
    for n, at, counts in collocations.intervals(ids, depth):
        want = Counter(tuple(g) for i in range(500 - n + 1) if 0 not in (g := ids[i : i + n].tolist()))
        assert {tuple(ids[i : i + n].tolist()): c for i, c in zip(at, counts, strict=True)} == want


def test_a_full_filter_changes_no_count(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = sorted(tuple(r) for r in collocations.collocations(docs, least=20).collect())
    monkeypatch.setattr(collocations, "MOST_BITS", 64)
    monkeypatch.setattr(collocations, "BUCKETS", 0)
    assert sorted(tuple(r) for r in collocations.collocations(docs, least=20).collect()) == want != []


def plain_whitening(rows):
    x = {i: [math.floor(256 * c) for c in v] for i, v in enumerate(rows) if v is not None and all(c is not None and math.isfinite(c) for c in v)}
    points = sorted(set(map(tuple, x.values())))
    n, d = len(points), len(points[0])
    sums = [sum(p[j] for p in points) for j in range(d)]
    y = np.array([[p[j] - sums[j] / n for j in range(d)] for p in points])
    values, vectors = np.linalg.eigh(y.T @ y / n)
    out = {}
    for i, v in x.items():
        deviation = sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True))
        for k in range(min(4, d)):
            e, u = values[-1 - k], vectors[:, -1 - k]
            out[i, k + 1] = (n, deviation, (np.array(v) - np.array(sums) / n) @ u / math.sqrt(e), e / values.sum())
    return out


def test_whitening_matches_a_plain_version(spark):
    draw = np.random.default_rng(1)
    scale = [3, 0.001, 1, 0.5, 2, 0.2]
    rows = [[float(c) for c in draw.normal(size=6) * scale] for _ in range(300)]
    rows += [None, [], [1.0] * 5, [math.nan] * 6, [math.inf, *[0.0] * 5], [None, *[1.0] * 5], rows[0], rows[0], [-0.0] * 6, [0.0] * 6]
    df = spark.createDataFrame([(i, v, 3, 4.0) for i, v in enumerate(rows)], "vec_id long, embedding array<double>, n int, whitened double")
    df = df.union(df.where("vec_id = 5")).repartition(3)
    want = plain_whitening([v if v is not None and len(v) == 6 else None for v in rows])
    got = defaultdict(list)
    for r in whitening.whiten(df).collect():
        got[r.vec_id, r.component].append(r)
    assert got.keys() == want.keys() and {k: len(v) for k, v in got.items() if len(v) > 1} == {(5, k): 2 for k in (1, 2, 3, 4)}
    sign = {k: math.copysign(1, got[0, k][0].whitened * want[0, k][2]) for k in (1, 2, 3, 4)}
    for key, (n, deviation, value, explained) in want.items():
        for r in got[key]:
            assert (r.n, r.deviation) == (n, deviation) and 0 <= r.identity_error < 1e-9
            assert r.whitened * sign[key[1]] == pytest.approx(value, rel=1e-9, abs=1e-9) and r.explained == pytest.approx(explained, rel=1e-9)


def test_whitening_of_flat_and_empty_tables(spark):
    of = lambda rows: spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "vec_id long, embedding array<float>")
    assert whitening.whiten(of([])).count() == whitening.whiten(of([None, []])).count() == 0
    one = whitening.whiten(of([[1.0, 2.0], [1.0, 2.0]])).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 0, None, None, None)] * 4
    flat = whitening.whiten(of([[1.0, 2.0], [3.0, 2.0], [None, 1.0]])).orderBy("vec_id", "component").collect()
    assert [r.explained for r in flat] == [1, 0, 1, 0] and [r.whitened is None for r in flat] == [False, True] * 2
    assert sorted(r.whitened for r in flat if r.whitened is not None) == pytest.approx([-1, 1])


@pytest.mark.parametrize("d", [1, 2, 5, 31, 64])
def test_jacobi_keeps_small_eigenvalues_accurate(d):
    draw = np.random.default_rng(d)
    scale = 10.0 ** draw.uniform(-8, 4, d)
    a = draw.normal(size=(3 * d, d))
    well = a.T @ a  # D a D with a well conditioned: small eigenvalues are determined to full precision
    matrix = well * scale[:, None] * scale
    values, vectors = whitening.jacobi(matrix)
    assert (np.diff(values) <= 0).all() and np.abs(vectors.T @ vectors - np.eye(d)).max() < 1e-12
    # the inverse has the reciprocals; its largest eigenvalue is the smallest one's reciprocal
    inverse = np.linalg.inv(well) / scale[:, None] / scale
    assert 1 / np.linalg.norm(inverse, 2) == pytest.approx(values[-1], rel=1e-9)


def plain_links(rows, similar=0.9):
    """vec_id -> (n_links, component) of rows (vec_id, vector), by all pairs."""
    good = [(i, k, np.array(v) / np.linalg.norm(v)) for k, (i, v) in enumerate(rows) if v is not None and None not in v and np.isfinite(v).all() and any(v)]
    links, parent = Counter(), {k: k for k in range(len(rows))}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for p, (_, a, x) in enumerate(good):
        for _, b, y in good[p + 1 :]:
            if len(x) == len(y) and x @ y >= similar:
                links[a] += 1
                links[b] += 1
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted([(i, links[k], least.get(find(k)), i == least.get(find(k))) for k, (i, _) in enumerate(rows)], key=repr)


def test_forest_handles_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.1]), (3, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [0.0, 1.0]), (5, None), (6, []), (7, [0.0, -0.0]), (7, [0.0, 0.0]), (8, [math.nan, 1.0]), (9, [math.inf, 1.0])]
    rows += [(10, [None, 1.0]), (None, [0.0, 3.0]), (None, [-1.0, -1.0]), (11, [1e200, 1e-200]), (12, [1e-200, 1e-202]), (13, [-1.0, 0.0]), (14, [-0.0, 5.0])]
    plain = [(i, None if v == [] else v) for i, v in rows]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, node int, leaf int")
    got = [tuple(r) for r in vector_forest.near_vectors(df).collect()]
    scaled = [(i, v if v is None or None in v or not np.isfinite(v).all() or not any(v) else (np.array(v) / np.abs(v).max()).tolist()) for i, v in plain]
    assert sorted(got, key=repr) == plain_links(scaled)
    assert vector_forest.near_vectors(df.limit(0)).count() == 0
    odd = df.where("vec_id = 1").union(df.where("vec_id = 1").withColumn("embedding", F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0))).withColumn("vec_id", F.lit(50).cast("long")))
    assert sorted((r.vec_id, r.n_links) for r in vector_forest.near_vectors(odd).collect()) == [(1, 0), (50, 0)]


@pytest.mark.parametrize("leaf,sample", [(1024, 16_384), (50, 200), (30, 5_000)])
def test_forest_finds_the_links_of_brute_force(spark, leaf, sample):
    """Spread vectors, small groups, one group of a third of all rows, and copies; leaves that must be split again and dense ones."""
    draw = np.random.default_rng(2)
    spread = draw.normal(size=(400, 24))
    centre = draw.normal(size=24)
    tight = centre + draw.normal(size=(250, 24)) * 0.2
    pairs = np.repeat(draw.normal(size=(40, 24)), 3, axis=0) + draw.normal(size=(120, 24)) * 0.15
    vectors = np.vstack([spread, tight, pairs, spread[:20]])
    rows = [(1000 - k, v.tolist()) for k, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in vector_forest.near_vectors(df, leaf=leaf, sample=sample).collect()}
    want = {i: (n, c) for i, n, c, _ in plain_links(rows)}
    assert got.keys() == want.keys() and all(got[i].n_links <= want[i][0] for i in want)  # no pair counts twice, none below the threshold
    assert sum(r.n_links for r in got.values()) >= 0.98 * sum(n for n, _ in want.values()) > 10_000
    assert sum(got[i].component_id == want[i][1] for i in want) >= 0.98 * len(want)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
