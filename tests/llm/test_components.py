import random

from pyspark.sql import functions as F

from tidemark.llm.components import Forest, blocks, components


def expected(edges):
    parent = {}

    def find(i):
        parent.setdefault(i, i)
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in parent}


def test_components_of_random_graphs_paths_and_stars(spark):
    random.seed(3)
    edges = [(random.randrange(200), random.randrange(200)) for _ in range(90)]
    edges += [(i, i + 1) for i in range(1000, 1040)] + [(2000, i) for i in range(2001, 2100)] + [(5, 5), (None, 3), (4, None)]
    edges += [(-7, 9), (9, -7), (-(1 << 60), 1 << 60)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    assert {r["node"]: r["component"] for r in components(df).collect()} == expected(edges)


def test_no_links(spark):
    assert components(spark.createDataFrame([], "a bigint, b bigint")).isEmpty()


def test_blocks_bring_all_pairs_of_a_list_together(spark):
    df = spark.range(30).selectExpr("if(id < 25, 1, id) as key", "id as member")
    found = blocks(df, ["key"], F.xxhash64("member"), F.col("member"), limit=7).collect()
    pairs = {(a, b) for r in found for a in r["members"] for b in r["members"]}
    assert {(a, b) for a in range(25) for b in range(25)} <= pairs
    assert {r["key"] for r in found} == {1} and max(len(r["members"]) for r in found) < 25


def test_forest_keeps_the_smallest_root():
    forest = Forest(5)
    forest.join(4, 2)
    forest.join(2, 1)
    member, root = forest.edges()
    assert dict(zip(member.tolist(), root.tolist())) == {2: 1, 4: 1}
