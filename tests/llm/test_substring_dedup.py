import hashlib
import random

import duckdb
import pytest

from clickloom.llm import substring_dedup
from tests.conftest import DATA
from tests.llm import helpers


def brute(texts):
    words = [helpers.PLAIN.findall(t or "") for t in texts]
    first, out = {}, []
    for i, w in enumerate(words):
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    for i, w in enumerate(words):
        gone = set()
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < i:
                gone |= set(range(k, k + 50))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


@pytest.mark.parametrize("group_segments", [4000, 1])
def test_equals_brute_force(spark, group_segments):
    texts = [t for _, t in duckdb.sql(f"select doc_id, text from '{DATA}/sf0.01/documents.parquet' order by doc_id").fetchall()]
    passage = " ".join(f"p{i}" for i in range(70))
    texts += [None, "", passage, f"before {passage} after", f"{passage} {passage}", passage.replace("p35", "q"), " ".join(["same"] * 300), " ".join(["same"] * 200), " ".join(f"p{i}" for i in range(49)), " ".join(f"p{i}" for i in range(10, 60)), "a b " * 90, "b a " * 90]
    got = substring_dedup.deduplicated(helpers.frame(spark, texts), group_segments).orderBy("doc_id").collect()
    want = brute(texts)
    assert sum(x[2] > 0 for x in want) > 50
    assert [tuple(r) for r in got] == want


def test_nulls_and_empty_table(spark):
    assert substring_dedup.deduplicated(helpers.frame(spark, [])).count() == 0
    text = " ".join(f"p{i}" for i in range(70))
    docs = spark.createDataFrame([(None, text), (1, text), (2, text)], "doc_id long, text string")
    assert {(r.doc_id, r.n_removed) for r in substring_dedup.deduplicated(docs).collect()} == {(None, 0), (1, 0), (2, 70)}


def families(rng):
    """A passage in many variants, so that its keys are crowded; copies; runs of one word and short periods."""
    base = [f"w{rng.randrange(10**6)}" for _ in range(160)]
    texts = []
    for _ in range(60):
        now = list(base)
        for _ in range(2):
            now[rng.randrange(160)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(now) if rng.random() < 0.5 else "  \n".join(now))
    return texts + texts[:10] + [" ".join(base)] * 3 + ["same " * 150, "same " * 90 + "end", "a b " * 60, "x a b " * 30 + "y"]


@pytest.mark.parametrize("group_segments", [4000, 5, 1])
def test_crowded_keys_get_longer_prefixes(spark, group_segments):
    texts = families(random.Random(8))
    got = substring_dedup.deduplicated(helpers.frame(spark, texts), group_segments).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == brute(texts)


def test_groups_fit(spark):
    docs = helpers.frame(spark, families(random.Random(8)))
    sizes = substring_dedup.partitioned(substring_dedup._identified(docs), 5)[2].groupBy("key").count().orderBy("count").collect()
    assert sizes[-1]["count"] <= substring_dedup.SEGMENT and sum(r["count"] > 5 for r in sizes) <= 6  # the runs of one word alone


def test_maximal_repeats_equal_brute_force(spark):
    rng = random.Random(2)
    base = [f"w{k}" for k in range(100)]
    texts = [" ".join(["l1", *base, "r1"]), " ".join(["l2", *base, "r2"]), " ".join(["l3", *base[:70], "r3"]), " ".join(rng.choice("pq") for _ in range(60))]
    lists = [t.split() for t in texts]
    want = set()
    for n in range(50, 101):
        places = {}
        for d, w in enumerate(lists):
            for k in range(len(w) - n + 1):
                places.setdefault(tuple(w[k : k + n]), []).append((d, k))
        for own in places.values():
            before = {lists[d][k - 1] if k else ("none", d) for d, k in own}
            after = {lists[d][k + n] if k + n < len(lists[d]) else ("none", d) for d, k in own}
            if len(own) > 1 and len(before) > 1 and len(after) > 1:
                want.add((*min(own), n, len(own)))
    got = {tuple(r) for r in substring_dedup.maximal_repeats(helpers.frame(spark, texts)).collect()}
    assert want == {(0, 1, 70, 3), (0, 1, 100, 2)}
    whole = [(r, w) for r in got for w in want if r[0] == w[0] and w[1] <= r[1] and r[1] + r[2] <= w[1] + w[2]]
    assert got and {r for r, _ in whole} == got and {(0, 1, 100, 2)} <= {w for _, w in whole}
    # one tree over the whole documents has them as they are
    entries = [(d, 0, len(w) - 49, t.encode()) for d, (w, t) in enumerate(zip(lists, texts, strict=True))]
    trees = substring_dedup.grown(entries)
    assert {(depth, len(own)) for depth, own in substring_dedup.deep_nodes(entries, trees)} == {(n, m) for _, _, n, m in want}
