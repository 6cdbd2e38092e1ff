import random
import zlib

from pyspark.sql import functions as F

from tests.llm.conftest import by
from tidemark.llm.mixing import expected_copies, mix, source_targets
from tidemark.llm.sharding import shard_documents
from tidemark.llm.splitters import splitters


def test_targets_fall_where_running_sums_say(spark):
    random.seed(2)
    rows = [(random.choice(["a", "b", None]), random.choice([5, 5, random.randrange(10**12)]), i, random.randrange(4)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, k bigint, row bigint, w bigint")
    targets = [(g, t, random.randrange(2500)) for g in ("a", "b", None) for t in range(6)]
    found = splitters(df, spark.createDataFrame(targets, "g string, target_id int, target bigint"), "g", ["k", "row"], "w", fan_out=16)
    expected = []
    for g, t, target in targets:
        upto = 0
        for _, k, row, w in sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2])):
            if upto <= target < upto + w:
                expected.append((g, t, target, k, row, upto))
            upto += w
    assert by(found, "g", "target_id", "target", "k", "row", "below") == sorted(expected, key=repr)


def shards_by_running_sum(rows, shards):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0))
    sizes = [len((t or "").encode()) + 16 for _, t in rows]
    before, out, slots = 0, {}, {}
    for i in order:
        shard = before * shards // sum(sizes)
        out.setdefault(shard, []).append((rows[i][0], sizes[i], zlib.crc32((rows[i][1] or "").encode())))
        before += sizes[i]
    return out


def test_shards_are_consecutive_and_near_equal(documents):
    random.seed(9)
    rows = [(random.randrange(-(1 << 62), 1 << 62), "é" * random.randrange(300)) for _ in range(400)]
    rows += [(None, None), (None, ""), (1 << 62, "x" * 20000), (7, None), (-(1 << 63), "low"), ((1 << 63) - 1, "high")]
    for pieces in (200_000, 9):
        found = shard_documents(documents(rows), 8, rows_per_piece=pieces, carry=("n", "size")).collect()
        expected = shards_by_running_sum(rows, 8)
        mine = {}
        for r in sorted(found, key=lambda r: (r["shard"], r["slot"])):
            mine.setdefault(r["shard"], []).append((r["doc_id"], r["size"], r["text_crc32"]))
            assert r["law"] == "bytes" and r["grown_shard"] is None and r["carried"]["n"] == "x"
        assert mine == expected
        for shard in mine:
            assert sorted(r["slot"] for r in found if r["shard"] == shard) == list(range(len(mine[shard])))


def test_rows_that_share_an_id_are_split_like_any_other(documents):
    found = shard_documents(documents([(5, "same")] * 90), 9).groupBy("shard").count().collect()
    assert sorted(r["count"] for r in found) == [10] * 9


def test_shards_of_small_tables(documents):
    assert shard_documents(documents([]), 40).collect() == []
    found = shard_documents(documents([(1, None), (2, "ab")]), 40).collect()
    assert sorted((r["doc_id"], r["size"], r["shard"]) for r in found) == [(1, 16, 0), (2, 18, 18)]
    assert shard_documents(documents([(1, "a")]), 1).first()["shard"] == 0


def fill(sizes):
    """Targets by sharing and resharing until no source is above three times its size."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    full, left, target = set(), float(sum(sizes.values())), {}
    while True:
        open_weight = sum(weight[s] for s in names if s not in full)
        rest = left - sum(3 * sizes[s] for s in full)
        target = {s: 3.0 * sizes[s] if s in full else rest * weight[s] / open_weight for s in names}
        above = {s for s in names if target[s] > 3 * sizes[s]} - full
        if not above:
            return target
        full |= above


def test_targets_are_shared_and_reshared(spark):
    random.seed(1)
    for _ in range(4):
        sizes = {random.choice([f"s{i}", f"é{i}"]): int(random.paretovariate(0.5)) for i in range(12)} | {None: 40, "empty": 0}
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
        found = {r["source"]: r["target"] for r in source_targets(df).collect()}
        expected = fill(sizes)
        assert found.keys() == expected.keys()
        assert all(abs(found[s] - expected[s]) < 1e-6 * max(1, expected[s]) for s in found)


def test_mixture_comes_near_its_targets_and_reruns_agree(documents):
    random.seed(4)
    rows = []
    for i in range(1500):
        source = random.choice(["hot"] * 6 + ["b", "c", None, "tiny"] if i % 50 == 0 else ["hot"] * 6 + ["b", "c", None])
        rows.append((i, " ".join(["w"] * int(random.lognormvariate(3, 1))), "en", source))
    rows += [(9000, None, "en", "b"), (9001, "", "en", "c"), (None, "a b c", "en", "b"), (9002, "a b", None, "c"), (9002, "a b", None, "c")]
    df = documents(rows)
    columns = ("doc_id", "size", "source_size", "target", "copies", "taken")
    found = mix(df, carry=("source", "taken"))
    kept = found.select(*columns, "carried.source").collect()
    assert len(kept) == len(rows)
    words = {}
    for i, t, _, s in rows:
        words[s] = words.get(s, 0) + len((t or "").split())
    for s, target in fill(words).items():
        mine = [r for r in kept if r["source"] == s]
        assert {r["source_size"] for r in mine} == {words[s]} and abs(mine[0]["target"] - target) < 1e-6
        assert abs(sum(r["taken"] for r in mine) - target) <= max(4, 0.01 * target)
        assert all(r["taken"] == r["copies"] * r["size"] and r["copies"] <= 3 for r in mine)
    assert by(mix(df.repartition(3)), *columns) == sorted((tuple(r[c] for c in columns) for r in kept), key=repr)


def test_desirable_documents_are_taken_more_often(documents):
    rows = [(i, "a b c d", "en", "s" if i % 2 else "t") for i in range(2000)]
    df = documents(rows).withColumn("wish", F.when(F.col("doc_id") % 4 < 2, 3).otherwise(1))
    taken = mix(df, desirability="wish", carry=("wish", "source")).where("carried.source = 's'").groupBy("carried.wish").sum("copies")
    counts = dict(taken.collect())
    total = mix(df, desirability="wish").agg({"taken": "sum", "size": "sum"}).first()
    assert counts[3] > 1.5 * counts[1] and abs(total["sum(taken)"] - total["sum(size)"]) <= 2 * 4  # a document per source


def share(words, target, most=3):
    """Copies each merit expects: in proportion, the overflow of full ones shared again."""
    full = set()
    while True:
        rest = target - sum(most * words[m] for m in full)
        open_shares = sum(m * words[m] for m in words if m not in full)
        unit = rest / open_shares if open_shares else 0.0
        above = {m for m in words if unit * m >= most} - full
        if not above:
            return {m: float(most) if m in full else unit * m for m in words}
        full |= above


def test_copies_are_expected_in_proportion_to_merit(spark):
    random.seed(6)
    words = {f"s{i}": {m: random.randrange(1, 10_000) for m in random.sample(range(1, 60), 6)} for i in range(9)}
    rows = [(s, m, w) for s, of in words.items() for m, w in of.items()] + [("s0", 0, 500)]
    found = expected_copies(spark.createDataFrame(rows, "source string, merit bigint, words bigint")).collect()
    assert len(found) == len(rows)
    for r in found:
        expected = 0.0 if r["merit"] == 0 else share(words[r["source"]], r["target"])[r["merit"]]
        assert abs(r["whole"] + r["chance"] - expected) < 1e-6 and 0 <= r["chance"] < 1
    for s in words:
        mine = {r["merit"]: r for r in found if r["source"] == s}
        certain = sum(mine[m]["whole"] * w for m, w in words[s].items())
        assert abs(mine[min(mine)]["wanted"] - (mine[min(mine)]["target"] - certain)) < 1e-6


def test_inclusion_frequencies_are_those_given(spark):
    # 900 sources of the same 40 documents: 300 independent draws for each of the three weights.
    merits = (1, 2, 5, 9)
    population = spark.range(900 * 40).select(
        F.col("id").alias("doc_id"),
        F.format_string("s%03d", F.floor(F.col("id") / 40)).alias("source"),
        F.repeat(F.lit("a "), (20 + F.col("id") % 7).cast("int")).alias("text"),
        F.element_at(F.array(*map(F.lit, merits)), (F.col("id") % 4 + 1).cast("int")).alias("wish"),
    )
    taken = mix(population, desirability="wish", carry=("source",))
    per_source = taken.groupBy("carried.source").agg(F.sum("taken").alias("t"), F.max("target").alias("target"))
    assert per_source.where("abs(t - target) > 27").isEmpty()
    weight = F.substring("carried.source", 2, 3).cast("int") % 3 + 1
    cells = taken.groupBy(weight.alias("weight"), "merit").agg(
        F.avg("copies").alias("copies"), F.avg("chance").alias("chance"), F.min("copies").alias("least"), F.max("copies").alias("greatest"),
    ).collect()
    assert len(cells) == 12 and len({round(c["chance"], 3) for c in cells}) > 8
    for c in cells:
        # 3,000 draws in each cell: a standard error of at most 0.01.
        assert abs(c["copies"] % 1 - c["chance"]) < 0.04 or abs(abs(c["copies"] % 1 - c["chance"]) - 1) < 0.04
        assert c["greatest"] - c["least"] <= 1 and c["greatest"] <= 3


def test_mixture_of_undesired_documents(documents):
    df = documents([(1, "a b", "en", "s"), (2, "c d e", "en", "s")]).withColumn("wish", F.lit(None).cast("int"))
    assert [r["taken"] for r in mix(df, desirability="wish").collect()] == [0, 0]
    one = df.withColumn("wish", F.when(F.col("doc_id") == 1, 1e9).otherwise(-1))
    assert dict(mix(one, desirability="wish").select("doc_id", "copies").collect()) == {1: 2, 2: 0}


def test_mixture_with_a_very_long_text(documents):
    rows = [(0, "word " * 300_000, "en", "s")] + [(i, "a b c d e f g h i j", "en", "s") for i in range(1, 101)]
    rows += [(i, "w " * 1000, "en", "t") for i in range(101, 201)]
    found = {r["doc_id"]: r for r in mix(documents(rows)).collect()}
    assert len(found) == 201 and found[0]["size"] == 300_000 and found[0]["merit"] == 4
    assert all(0 <= r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"] for r in found.values())
    # The long text is more than its source wants; all that fits beside it is taken once more.
    assert found[0]["copies"] == 0 and all(found[i]["copies"] == 1 for i in range(1, 101))
    assert abs(sum(found[i]["taken"] for i in range(101, 201)) - found[101]["target"]) <= 500


def test_mixture_of_nothing(documents):
    assert mix(documents([])).collect() == []
    assert [(r["taken"], r["target"]) for r in mix(documents([(1, None, None, None), (2, "", "en", "a")])).collect()] == [(0, 0.0)] * 2
