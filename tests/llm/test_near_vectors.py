import numpy as np
import pytest

from inkfold.llm import near_vectors as N


def brute(rows, least=0.98):
    """(id, links, component, kept) by comparing all pairs."""
    def usable(v, label):
        return v is not None and label is not None and len(v) and all(c is not None and np.isfinite(c) for c in v) and any(v)

    n = len(rows)
    links, parent = [0] * n, list(range(n))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(n):
        for j in range(i):
            (a, v, k), (b, w, m) = rows[i], rows[j]
            if usable(v, k) and usable(w, m) and k == m and len(v) == len(w):
                x, y = np.array(v, float), np.array(w, float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                    links[i] += 1
                    links[j] += 1
                    parent[max(find(i), find(j))] = min(find(i), find(j))
    least_id = {}
    for i in range(n):
        least_id[find(i)] = min(least_id.get(find(i), rows[i][0]), rows[i][0])
    return sorted((rows[i][0], links[i], least_id[find(i)], rows[i][0] == least_id[find(i)]) for i in range(n))


def cloud(seed, n=700, size=24):
    """Scattered vectors, pairs and chains near the limit, a dense ball, equal vectors."""
    r = np.random.default_rng(seed)
    base = r.standard_normal((n, size))
    out = []
    for v in base[: n // 2]:
        out.append(v)
        for _ in range(r.integers(0, 3)):
            v = v + r.standard_normal(size) * 0.11
            out.append(v)
    ball = r.standard_normal(size)
    out += [ball + r.standard_normal(size) * 0.03 for _ in range(120)] + [ball] * 40
    labels = r.integers(0, 3, len(out)).tolist()
    ids = r.permutation(len(out)).tolist()
    return [(i, [float(np.float32(c)) for c in v], k) for i, v, k in zip(ids, out, labels, strict=True)]


@pytest.mark.parametrize("how", [N.Forest(leaf=40), N.Forest(leaf=20, task_rows=60)])
def test_against_all_pairs(spark, how):
    rows = cloud(3)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    got = sorted(tuple(r) for r in N.near_vectors(df, how).collect())
    want = brute(rows)
    found, there = sum(g[1] for g in got), sum(w[1] for w in want)
    assert there * 0.99 <= found <= there
    assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True))
    assert np.mean([g[2] == w[2] for g, w in zip(got, want, strict=True)]) > 0.99


def test_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (5, [1.0, 0.0], 1), (3, [1.0, 0.0], 1), (9, [1.0, 0.0], 2), (1, [0.0, 0.0], 1), (2, None, 1), (4, [1.0, None], 1), (6, [nan, 1.0], 1),
        (7, [1.0, inf], 1), (8, [1.0, 0.0], None), (10, [], 1), (11, [1.0, 0.0, 0.0], 1), (12, [2.0, 0.0], 1), (13, [1e-30, 0.0], 1), (14, [1e30, 0.0], 1),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, n_links string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in N.near_vectors(df).collect()}
    for i in (5, 3, 12, 13, 14):
        assert got.pop(i) == (4, 3, i == 3)
    assert got == {i: (0, i, True) for i in (9, 1, 2, 4, 6, 7, 8, 10, 11)}
    assert N.near_vectors(df.limit(0)).count() == 0


def test_a_dense_ball_gives_a_row_a_vector_and_block(spark, monkeypatch):
    r = np.random.default_rng(5)
    ball = r.standard_normal(16)
    rows = [(i, [float(c) for c in ball + r.standard_normal(16) * 0.02], 1) for i in range(600)]
    written = []
    plain = N._links
    monkeypatch.setattr(N, "_links", lambda *a: written.append(plain(*a)) or written[0])
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted(tuple(x) for x in N.near_vectors(df, N.Forest(leaf=40, task_rows=200)).collect())
    assert got == brute(rows) and sum(g[1] for g in got) > 300_000
    # Six blocks, at most once for each other block and tree: not the pairs.
    assert written[0].count() <= 600 * 6 * 4


def test_helpers_against_plain_loops():
    r = np.random.default_rng(1)
    names = [[f"{t:03d}.{r.integers(0, 3)}" for t in range(3)] for _ in range(30)]
    plain = [[any(n in b and n < "001.1" for n in a) for b in names] for a in names]
    got = N._together(names, "001.1")
    assert all(got[i, j] == plain[i][j] for i in range(30) for j in range(30) if i != j)
    close = r.random((60, 60)) < 0.02
    close = (close | close.T) & ~np.eye(60, dtype=bool)
    reach = np.linalg.matrix_power((close | np.eye(60, dtype=bool)).astype(float), 60) > 0
    assert N._roots(close).tolist() == reach.argmax(axis=1).tolist()
