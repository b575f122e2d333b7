import random

import numpy as np
import pytest

from wardlake.llm import charpoly as c


def scatter(rng, d, n, rank=None):
    rows = rng.integers(-50, 50, (n, rank or d))
    if rank:
        rows = rows @ rng.integers(-3, 4, (rank, d))
    rows = rows * n - rows.sum(axis=0)
    return [[int(x) for x in row] for row in rows.T @ rows]


def solved(matrix, k):
    coefficients = c.remaindered([(p, c.polynomial_mod(matrix, p)) for p in c.needed_primes(matrix)])
    roots = c.largest_roots(coefficients, k, sum(matrix[i][i] for i in range(len(matrix))))
    values, vectors = [], []
    for root, shift, many in roots:
        values += [root / (1 << shift)] * many
        vectors += c.null_vectors(matrix, root, shift, many)
    return coefficients, np.array(values), np.array(vectors)


def test_polynomial_of_small_matrices():
    assert solved([[2, 1], [1, 2]], 2)[0] == [3, -4, 1]
    assert solved([[5]], 1)[0] == [-5, 1]
    assert c.remaindered([(p, c.polynomial_mod([[0, 2, 0], [2, 0, 0], [0, 0, 7]], p)) for p in (2147483647, 2147483629)]) == [28, -4, -7, 1]


def test_primes_against_division():
    found = [p for _, p in zip(range(20), c.primes())]
    assert all(all(p % q for q in range(2, int(p**0.5) + 1)) for p in found[:3])
    assert found == sorted(set(found), reverse=True) and found[0] == 2**31 - 1


@pytest.mark.parametrize("d, n, rank", [(1, 5, None), (3, 9, None), (8, 40, None), (20, 200, None), (12, 30, 5)])
def test_against_numpy(d, n, rank):
    matrix = scatter(np.random.default_rng(d), d, n, rank)
    _, values, vectors = solved(matrix, 16)
    want = np.linalg.eigvalsh(np.array(matrix, dtype=float))[::-1]
    want = want[: min(16, rank or d)]
    assert len(values) == len(want) and np.allclose(values, want, rtol=1e-10)
    assert np.allclose(vectors @ vectors.T, np.eye(len(values)), atol=1e-14)
    a = np.array(matrix, dtype=float)
    assert np.allclose(vectors @ a, values[:, None] * vectors, atol=1e-12 * abs(a).max() * d)


def test_repeated_and_close_roots():
    def diagonal(*values):
        return [[v if i == j else 0 for j, v in enumerate(values)] for i in range(len(values))]

    rng = random.Random(1)
    _, values, vectors = solved(diagonal(9, 9, 9, 4, 0, 0), 16)
    assert list(values) == [9, 9, 9, 4] and np.allclose(vectors @ vectors.T, np.eye(4), atol=1e-15)
    assert np.allclose(vectors[:, 4:], 0)
    big = 10**18
    _, values, vectors = solved(diagonal(big, big + 1, big - 1, 5), 3)
    assert np.allclose(abs(vectors), [[0, 1, 0, 0], [1, 0, 0, 0], [0, 0, 1, 0]], atol=1e-15)
    # a plane of equal roots inside a rotated basis: 6 on two directions, 15 on the third
    rotated = [[7, 2, 2], [2, 10, 4], [2, 4, 10]]
    _, values, vectors = solved(rotated, 3)
    assert np.allclose(values, [15, 6, 6], rtol=1e-15) and np.allclose(vectors @ np.array(rotated), values[:, None] * vectors, atol=1e-13)
    mixed = [[rng.randint(-9, 9) for _ in range(6)] for _ in range(6)]
    gram = np.array(mixed).T @ np.array(mixed)
    assert np.allclose(solved([[int(x) for x in r] for r in gram], 2)[1], np.linalg.eigvalsh(gram)[::-1][:2])
    assert c.largest_roots([0, 0, 1], 5, 0) == []
