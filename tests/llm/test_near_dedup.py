import random

import duckdb
from pyspark.sql import functions as F

from clickloom.llm import near_dedup
from tests.conftest import DATA
from tests.llm import helpers


def brute(texts):
    """Components by comparing every pair of sets."""
    sets = []
    for t in texts:
        w = helpers.PLAIN.findall(helpers.fold(t))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    label = list(range(len(texts)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    by = {}
    for i, s in enumerate(sets):
        for g in s:
            by.setdefault(g, []).append(i)
    for i, s in enumerate(sets):
        near = {}
        for g in s:
            for j in by[g]:
                if j < i:
                    near[j] = near.get(j, 0) + 1
        for j, n in near.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return [(i, len(s), find(i), find(i) == i) for i, s in enumerate(sets)]


def check(spark, texts):
    got = near_dedup.near_duplicates(helpers.frame(spark, texts)).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == brute(texts)


def test_equals_brute_force_on_documents(spark):
    check(spark, [t for _, t in duckdb.sql(f"select doc_id, text from '{DATA}/sf0.01/documents.parquet' order by doc_id").fetchall()])


def test_chains_whose_ends_are_far_apart(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    texts = [None, "", "  ", "one two", "One TWO", "one two three four five", "ONE two three four five"]
    for chain in range(6):  # each step changes a few words: neighbours link, ends do not
        now = [f"{chain}{w}" for w in base]
        steps = []
        for _ in range(12):
            now = list(now)
            for _ in range(rng.choice([6, 9, 11])):
                now[rng.randrange(400)] = f"x{rng.randrange(10**6)}"
            steps.append(" ".join(now))
        rng.shuffle(steps)
        texts += steps
    for _ in range(60):  # copies of one text that link to it alone
        now = list(base)
        for _ in range(11):
            now[rng.randrange(400)] = f"y{rng.randrange(10**6)}"
        texts.append(" ".join(now))
    texts.append(" ".join(base))
    check(spark, texts)


def test_estimate_and_empty_table(spark):
    import pyarrow as pa

    words = [f"w{i}" for i in range(1004)]
    texts = [" ".join(words), " ".join(words[:600] + ["z"] + words[600:])]
    frame = near_dedup.signatures(helpers.frame(spark, texts))
    lanes = frame.alias("x").crossJoin(frame.alias("y")).where("x.doc_id < y.doc_id").select(near_dedup.equal_lanes("x", "y").alias("n")).first().n
    assert abs(near_dedup.estimated_similarity(lanes) - 0.991) < 0.1
    packed = frame.collect()
    want = sum((packed[0][f"s{i}"] >> 4 * j) & 15 == (packed[1][f"s{i}"] >> 4 * j) & 15 for i in range(8) for j in range(16))
    assert lanes == want
    assert [len(x) for x in near_dedup.shingle_sets(pa.array(["", None, "a"]))] == [0, 0, 1]
    assert near_dedup.near_duplicates(helpers.frame(spark, [])).count() == 0
    docs = helpers.frame(spark, ["a b c", "a b c", "q"])
    assert sorted(r.doc_id for r in near_dedup.deduplicated(docs).collect()) == [0, 2]


def test_repeated_and_null_ids_keep_one_of_each_set(spark):
    rows = [(1, "a b c"), (1, "a b c"), (2, "A b c"), (2, "d e f"), (2, "d e f"), (3, "d e f"), (4, "g h"), (None, "a b c"), (None, "x y z"), (None, "x y Z"), (None, "x y z q"), (None, ""), (None, None), (5, "")]
    docs = spark.createDataFrame([(i, t, f"s{k}") for k, (i, t) in enumerate(rows)], "doc_id long, text string, source string")
    out = near_dedup.deduplicated(docs)
    got = sorted((repr(r.doc_id), helpers.fold(r.text)) for r in out.collect())
    assert out.columns == docs.columns
    assert got == sorted([("1", "a b c"), ("2", "d e f"), ("4", "g h"), ("None", "x y z"), ("None", "x y z q"), ("None", ""), ("None", ""), ("5", "")])


def test_a_hot_band_of_classes_that_do_not_link(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 100)
    rng = random.Random(9)
    base = [f"w{k}" for k in range(300)]
    texts = []
    for _ in range(700):  # neighbours share about two thirds of their shingles
        now = list(base)
        for k in rng.sample(range(300), 12):
            now[k] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(now))
    texts += [texts[5] + " more", " ".join(base), "  ".join(base).upper()]
    check(spark, texts)


def test_blocks_meet_every_pair_once(spark):
    rows = spark.range(50).selectExpr("id AS class_id", "id % 2 AS band")
    x, y = near_dedup._blocked(rows, 4)
    pairs = x.alias("x").join(y.alias("y"), (F.col("x.band") == F.col("y.band")) & (F.col("x.block") == F.col("y.block")) & (F.col("x.class_id") < F.col("y.class_id"))).select("x.class_id", "y.class_id").collect()
    assert len(pairs) == len(set(pairs)) == 2 * 25 * 24 // 2


def test_what_the_estimate_may_lose():
    low = near_dedup.least_estimate()
    assert 0.4 < low < 0.6 and all(near_dedup.estimated_similarity(n) < low for n in range(60)) and near_dedup.estimated_similarity(75) > low


def test_components_of_long_chains(spark):
    chain = [(i, i + 1) for i in range(0, 300)] + [(1000 + i, 2000 - i) for i in range(5)] + [(2000, 1004), (5, 5)]
    got = {r.node: r.component for r in near_dedup.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 301)) and got[2000] == 1000 and got[1004] == 1000 and 5000 not in got
