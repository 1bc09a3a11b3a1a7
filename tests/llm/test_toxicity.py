import random
import re
import tracemalloc

import numpy as np
import pytest

from clickloom.llm import toxicity
from tests.conftest import DATA
from tests.llm import helpers


def corpus(n=900, seed=5):
    rng = random.Random(seed)
    words = ["".join(rng.choice(["ba", "do", "ki", "mel", "ran", "tos", "vu", "sho"]) for _ in range(rng.randint(1, 4))) for _ in range(1500)]
    insults = ["grubwit", "snotface", "dungpot"]
    texts, labels = [], []
    for i in range(n):
        own = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        bad = rng.random() < 0.2
        for _ in range(rng.randint(1, 3) if bad else 0):
            own.insert(rng.randrange(len(own) + 1), rng.choice(insults))
        texts.append(" ".join(own) + ".")
        labels.append(int(bad))
    return texts, labels


def test_respelled_insults_are_found(spark):
    texts, marks = corpus()
    labels = spark.createDataFrame([(i, 1, t) for i, t in enumerate(marks)], "doc_id long, quality int, toxic int")
    docs = helpers.frame(spark, texts)
    machine = toxicity.fitted(docs, labels)
    odd = ["kiran you GRUBWIT!", "melba g.r.u.b.w.i.t toska", "sho snotxface vu", "ran dung-pot ki", "a d u n g p o t b", "kiran melba sho", "", None, "tos " * 3000, "x" * 5000, "grubwit", "grubwit"]
    score = [r.score for r in toxicity.scored(helpers.frame(spark, odd), machine).orderBy("doc_id").collect()]
    assert all(s >= 0.5 for s in score[:5]) and all(0 <= s < 0.5 for s in score[5:10]) and score[10] == score[11] >= 0.5
    kept = toxicity.without_toxic(docs, labels)
    got = {r.doc_id for r in kept.select("doc_id").collect()}
    wrong = sum((i in got) == bool(t) for i, t in enumerate(marks))
    assert wrong <= 9 and kept.columns == docs.columns


def test_nothing_to_learn(spark):
    docs = helpers.frame(spark, ["a b c", None])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in toxicity.scored(docs, toxicity.fitted(docs, none)).collect()] == [0.5, 0.5]
    assert toxicity.without_toxic(docs, spark.createDataFrame([(0, 1, None), (None, 1, 1)], none.schema)).count() in (0, 2)
    assert toxicity.scored(docs.limit(0), 0.1).count() == 0


def subsequences(word):
    """Weights of all subsequences of three characters (ends included), by trying every three places."""
    w, out = f"^{word}$", {}
    for i in range(len(w)):
        for j in range(i + 1, len(w)):
            for k in range(j + 1, len(w)):
                if k - i < toxicity.SPAN:
                    key = w[i] + w[j] + w[k]
                    out[key] = out.get(key, 0) + toxicity.DECAY ** (k - i + 1)
    return out


def scale(word):
    w = f"^{word}$"
    plain = sum(toxicity.DECAY ** (2 * (k - i + 1)) for i in range(len(w)) for j in range(i + 1, len(w)) for k in range(j + 1, len(w)) if k - i < toxicity.SPAN) ** 0.5
    threes = [w[i : i + 3] for i in range(len(w) - 2)]
    return plain * (sum(threes.count(x) for x in threes) / len(threes)) ** 0.5


def test_kernel_equals_brute_force():
    marks = ["idiot", "clown", "trash", "tiontiontion", "él", "a"]
    words = ["idiot", "idxiot", "i.diot", "clown", "zebra", "qq", "trash", "tiontion", "ana", "éléé", "abcdefghijklmnop", "idiotidiotidiotidiotidio"]
    got = toxicity.Kernel(marks)(words)
    for i, a in enumerate(words):
        for j, b in enumerate(marks):
            x, y = subsequences(a), subsequences(b)
            want = sum(v * y.get(k, 0) for k, v in x.items()) / scale(a) / scale(b)
            assert abs(got[i, j] - want) < 1e-4, (a, b)
    own = toxicity.Kernel(marks)
    assert np.linalg.eigvalsh(own(marks).astype(float)).min() > -1e-5 and np.linalg.eigvalsh(own.image(marks).astype(float)).min() > -1e-5
    sentences = [["idiot", "zebra"], [], ["ana"]]
    assert np.allclose(toxicity.images(own, sentences), [own.image(["idiot"])[0] + own.image(["zebra"])[0], [0] * 6, own.image(["ana"])[0]], atol=1e-5)


def test_a_fit_holds_its_rows_once():
    rng, marks = np.random.default_rng(1), ["idiot", "clown", "trash"]
    kernel, root = toxicity.Kernel(marks), np.eye(3, 64)
    parts = [np.hstack([rng.normal(size=(n, 64)).astype(np.float32), np.ones((n, 1), np.float32)]) for n in (30_000, 70_000)]
    labels = np.arange(100_000) < 30_000
    parts[0][:, 0] += 3
    tracemalloc.start()
    machine, w = toxicity.fit(kernel, root, parts, labels, np.ones(100_000))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 0.7 * sum(x.nbytes for x in parts)
    assert ((parts[0] @ w > 0).mean() > 0.9 < (parts[1] @ w < 0).mean()) and np.allclose(machine.beta, root @ w[:-1], atol=1e-6) and machine.bias == w[-1]


def test_only_pairs_of_single_characters_are_looked_at_closely(monkeypatch):
    def plain(text):
        low = text.lower()
        for sentence in re.split(r"(?<=[.!?])\s|\n", low):
            own = sentence.split()
            if own:
                own += ["".join(x.split()) for x in toxicity._SINGLES.findall(sentence)]
                yield from (own[k : k + toxicity.PIECE] for k in range(0, len(own), toxicity.PIECE))

    rng = random.Random(2)
    for _ in range(3000):
        text = "".join(rng.choice(["a", "B", "é", "7", "word", ".", "! ", "? ", " ", "  ", "\n", "\t", "_", "-"]) for _ in range(rng.randint(0, 30)))
        assert list(toxicity.pieces(text)) == list(plain(text)), text
    for token in ("word", "(word).", "_a-b_", "..", "é²", "don't", "中文!", "a_b"):
        word = re.sub(r"^[\W_]+|[\W_]+$", "", token)
        assert toxicity.units(token) == list(dict.fromkeys(x for x in (word, re.sub(r"[\W_]+", "", word)) if x))
    monkeypatch.setattr(toxicity, "_SINGLES", None)
    assert list(toxicity.pieces("it was a word. and I")) == [["it", "was", "a", "word."], ["and", "i"]]


def test_pieces_hold_every_word():
    rng = random.Random(1)
    for _ in range(50):
        words = ["".join(rng.choice("abc.") for _ in range(rng.choice([2, 3, 9, 30]))) for _ in range(rng.randint(0, 90))]
        text = "".join(w + rng.choice([" ", ". ", "\n", "! "]) for w in words)
        own = [t for p in toxicity.pieces(text) for t in p]
        assert {t for t in text.split() if len(t) <= 2 * toxicity.LONG} <= set(own) and all(len(p) <= toxicity.PIECE for p in toxicity.pieces(text))
    assert ["idiot"] in [[t for t in p if t == "idiot"] for p in toxicity.pieces("you i d i o t there")]
    assert "".join(dict.fromkeys(t for p in toxicity.pieces("q" * 30 + "idiot" + "z" * 200) for t in p)).count("idiot") >= 1


def test_rare_insults_unlike_the_frequent_ones_are_learned(spark):
    rng = random.Random(3)
    inner = list(dict.fromkeys("".join(rng.choice("bdklmnrstv") + rng.choice("aiou") for _ in range(3)) for _ in range(300)))
    rare = ["zjeqxyph", "pfwychek", "hygwyxez", "jyxqweph"]
    plain, marks = corpus(1200, 9)
    texts = [" ".join(x for x in t[:-1].split() if x not in ("grubwit", "snotface", "dungpot")) for t in plain]
    for k, bad in enumerate(marks):
        if bad:
            texts[k] += ". ba " + (rng.choice(rare) if rng.random() < 0.15 else f"grub{rng.choice(inner)}wit") + " do"
    labels = spark.createDataFrame([(i, 1, t) for i, t in enumerate(marks)], "doc_id long, quality int, toxic int")
    machine = toxicity.fitted(helpers.frame(spark, texts), labels)
    top, _ = machine.top([f"mel {w} ran" for w in rare] + ["mel zjeqqxyph ran", "mel hygwyxaez do"] + [f"ba {w} do vu" for w in ("sho", "tosran", "melkiba")])
    assert (machine.probability(top)[:4] >= 0.5).all() and (top[4:6, 0] > 0).all() and (machine.probability(top)[6:] < 0.5).all()


@pytest.mark.parametrize(("sf", "recall", "precision"), [("sf0.01", 0.7, 0.7), ("sf0.1", 0.86, 0.89)])
def test_held_out_fold(spark, sf, recall, precision):
    """Figures that no constant prediction reaches."""
    rows = toxicity.query(spark, f"{DATA}/{sf}").join(spark.read.parquet(f"{DATA}/{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    hit = sum(r.predicted == r.toxic == 1 for r in rows)
    assert hit >= recall * sum(r.toxic for r in rows) > 0 and hit >= precision * sum(r.predicted for r in rows)


def test_null_ids_and_clashing_columns(spark):
    texts, marks = corpus(300)
    labels = spark.createDataFrame([(i, 1, t) for i, t in enumerate(marks)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(i if i else None, t, i, "x", 1.0) for i, t in enumerate(texts)], "doc_id long, text string, toxic long, word string, score double")
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns and 0 < kept.count() < 300
    assert docs.select(toxicity.held_out("doc_id").alias("h")).where("h is null").count() == 0
