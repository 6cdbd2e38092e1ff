import math

import numpy as np
import pytest

from tests.llm.conftest import by
from tidemark.llm.caps import decode_filters, embedding_groups, scores, unit

COSINE = 0.98


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").selectExpr(
        "*", "1 as n", "2 as node", "'x' as chunk", "3 as size", "4 as filter", "5 as rep", "6 as h1", "7 as component", "8 as list_rows"
    )


def brute(rows):
    usable = []
    for i, v, label in rows:
        ok = i is not None and v and label is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)
        usable.append(unit(np.array([v], float))[0] if ok else None)
    links, component = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while component[i] != i:
            i = component[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            x, y = usable[i], usable[j]
            if x is not None and y is not None and len(x) == len(y) and rows[i][2] == rows[j][2] and x @ y >= COSINE:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                component[max(a, b)] = min(a, b)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(r[0], least.get(find(i), r[0]))
    return sorted(((r[0], links[i], least.get(find(i))) for i, r in enumerate(rows)), key=repr)


@pytest.fixture(scope="module")
def rows():
    random = np.random.default_rng(4)
    out, n = [], 100
    for size in (16, 64):
        for label in (0, 1):
            for _ in range(12):
                centre = random.standard_normal(size)
                for _ in range(random.integers(1, 9)):
                    near = centre + random.standard_normal(size) * random.choice([0.0, 0.05, 0.1, 0.14, 0.2])
                    out.append((n, near.tolist(), label))
                    n += 1
    centre = random.standard_normal(16)
    out += [(n + i, (centre * (i + 1)).tolist(), 3) for i in range(40)]  # one direction, many lengths
    out += [(1, None, 0), (2, [], 0), (3, [0.0] * 16, 0), (4, [float("nan")] * 16, 0), (5, [float("inf")] * 16, 0), (6, [1.0, None] * 8, 0)]
    out += [(7, out[0][1], None), (None, out[0][1], 0), (out[0][0], out[0][1], 0), (8, [1e300] * 16, 3), (9, [1e300] * 16, 3), (10, [2.0], 0), (11, [3.0], 0)]
    return out


@pytest.mark.parametrize("limit", [2048, 5])
def test_groups_equal_brute_force_also_when_blocks_are_split(spark, rows, limit):
    found = embedding_groups(table(spark, rows), cosine=COSINE, block_vectors=limit)
    assert by(found, "vec_id", "n_links", "component_id") == brute(rows)


def test_near_vectors_share_the_filter_of_their_middle():
    random = np.random.default_rng(8)
    x = unit(random.standard_normal((4000, 64)))
    y = unit(x + unit(random.standard_normal((4000, 64))) * 0.19)
    keep = (x * y).sum(axis=1) >= COSINE
    x, y = x[keep], y[keep]
    listed = [set(zip(*(c.tolist() for c in decode_filters(v, COSINE, 64, 5.5)))) for v in (x, y)]
    middle = [s.argmax(axis=1) for s in scores(x + y, 64)]
    own = {(i, int(a * 64 + b)) for i, (a, b) in enumerate(zip(*middle))}
    assert len(x) > 2000 and own <= listed[0] and own <= listed[1]


def test_empty_table(spark):
    assert embedding_groups(table(spark, [])).collect() == []
