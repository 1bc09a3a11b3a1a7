import hashlib
import os
import random
import zlib

import duckdb
import numpy as np
import pytest

from clickloom.llm import decontamination, near_dedup, sentencepiece_bpe, substring_dedup, token_shards
from clickloom.llm.common import PLAIN, shared_dir, sliding_min, split_by_ids, word_slices, written
from tests.conftest import DATA
from tests.llm import helpers

ODD = ["a\x1cb \x1f\u2003c\u00a0d\u0085e \u0301f", None, "", " ", "  two  spaces ", "a\nb\r\n\tc", "naïve É 日本語 🙂 ▁ mark", "x" * 30000, "word " * 5000, "\u0000 nul", "don't 1234567 <s> </s> <|endoftext|>", "ﬁ ½ ǅ İ Σς", "a b c\u0085d", "same", "same"]


def documents(sf="sf0.01"):
    return duckdb.sql(f"select doc_id, text from '{DATA}/{sf}/documents.parquet' order by doc_id").fetchall()


def test_words_and_windows():
    import pyarrow as pa

    texts = [t or "" for t in ODD]
    got = []
    for a, b, data, words in word_slices(pa.array(ODD, pa.string()), PLAIN, 1000):
        for k in range(b - a):
            own = range(words.bounds[k], words.bounds[k + 1])
            got.append([bytes(data[words.begin[i] : words.end[i]]).decode() for i in own])
    assert got == [helpers.PLAIN.findall(t) for t in texts]
    x = np.random.default_rng(1).integers(0, 99, 200)
    for width in (1, 2, 7, 35):
        assert list(sliding_min(x, width)) == [x[i : i + width].min() for i in range(201 - width)]


def test_split_by_ids(spark):
    docs = spark.range(-500, 3000).selectExpr("id AS doc_id", "id * 2 AS x").unionByName(spark.createDataFrame([(None, 1), (7, 7)], "doc_id long, x long"))
    ids = written(spark.range(0, 3000, 13).withColumnRenamed("id", "doc_id"))
    likely, others = split_by_ids(docs, ids)
    have, rest = [r.doc_id for r in likely.collect()], [r.doc_id for r in others.collect()]
    assert set(range(0, 3000, 13)) <= set(have) and None in rest and len(have) + len(rest) == 3502 and len(have) < 800
    assert split_by_ids(docs, ids.limit(0))[0].count() == 0


def test_sentencepiece_equals_library(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_bpe.default_model())
    texts = ODD + [t for _, t in documents()][:300]
    rows = {r.doc_id: r for r in sentencepiece_bpe.encoded(helpers.frame(spark, texts), texts=True).collect()}
    codec = sentencepiece_bpe.Codec(sentencepiece_bpe.default_model())
    for i, t in enumerate(texts):
        want = library.encode(t or "")
        assert rows[i].ids == want and rows[i].decoded == library.decode(want) and rows[i].n_library == 0, t
        assert rows[i].ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest() and rows[i].n_tokens == len(want)
        if len(t or "") < 3000:
            assert codec.encode(t or "") == want and codec.decode(want) == library.decode(want)
    assert codec.decode([3 + 0xE9, 300, 3 + 0xC3, 3 + 0xA9]) == library.decode([3 + 0xE9, 300, 3 + 0xC3, 3 + 0xA9])


ALPHABET = ["▁", " ", "  ", "\n", "\t", "-", "a", "b", "the", "The", "É", "é", "日本", "🙂", "<|ENDOFTEXT|>", "<|endoftext|>", "<|EndOfText|>", "<|startoftext|>", "<|StartOfText|>", "<s>", "</s>", "<unk>", "\x00", "\x1c", "\x1f", "\u0301", "\u2003", "\u00a0", "1", "23", ".", ",", "!", "|", "<|", "|>", "ﬁ", "İ", "Σ", "ß", "don't", "'S", "<0x41>", "\u200d", "\u0085"]


def random_texts(n=20_000):
    rng = random.Random(4)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(1, 12))) for _ in range(n)]


def test_random_texts_as_the_libraries_encode_them():
    import sentencepiece
    from tokenizers import Tokenizer

    texts = random_texts()
    library, table = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_bpe.default_model()), sentencepiece_bpe.Table(sentencepiece_bpe.default_model())
    tokenizer, encoder = Tokenizer.from_file(token_shards.default_tokenizer()), token_shards.Encoder(token_shards.default_tokenizer())
    for at in range(0, len(texts), 500):
        own = texts[at : at + 500]
        chunks = [table.chunks(t) for t in own]
        ids = table.encode(chunks)
        want = library.encode(own)
        assert ids == [",".join(map(str, x)) for x in want] and [table.text(c) for c in chunks] == library.decode(want)
        assert not table.corrected and not table.differing(own, chunks, ids)
        got = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode([token_shards.words_of(t, encoder.added) for t in own])]
        assert got == [[*tokenizer.encode(t, add_special_tokens=False).ids, 2] for t in own]


def test_list_and_heap_agendas_agree(monkeypatch):
    codec = sentencepiece_bpe.Codec(sentencepiece_bpe.default_model())
    texts = random_texts(2_000)
    flat = [codec.encode(t) for t in texts]
    monkeypatch.setattr(sentencepiece_bpe, "SHORT", 0)
    assert [codec.encode(t) for t in texts] == flat


def test_full_tables_start_again_with_all_that_belongs_to_them(monkeypatch):
    import sentencepiece

    monkeypatch.setattr(sentencepiece_bpe, "TABLE_CHUNKS", 50)
    library, table = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_bpe.default_model()), sentencepiece_bpe.Table(sentencepiece_bpe.default_model())
    texts = random_texts(1_000)
    for at in range(0, len(texts), 20):
        own = texts[at : at + 20]
        chunks = [table.chunks(t) for t in own]
        assert table.encode(chunks) == [",".join(map(str, x)) for x in library.encode(own)] and [table.text(c) for c in chunks] == library.decode(library.encode(own))
        assert len(table.odd) < 2_000


def test_words_that_move_between_tables(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_shards, "TABLE_WORDS", 40)
    monkeypatch.setattr(token_shards, "TABLE_RUNS", 15)
    tokenizer, encoder = Tokenizer.from_file(token_shards.default_tokenizer()), token_shards.Encoder(token_shards.default_tokenizer())
    texts = [t or "" for _, t in documents()][:120] + random_texts(500)
    for at in range(0, len(texts), 10):
        own = texts[at : at + 10]
        want = [tokenizer.encode(t, add_special_tokens=False).ids for t in own]
        assert [np.frombuffer(x, "<u4").tolist()[:-1] for x in encoder.encode([token_shards.words_of(t, encoder.added) for t in own])] == want
        assert encoder.count(own) == [len(x) for x in want]


def twins():
    """Two words of 1,024 letters that every polynomial hash modulo 2**64 with an odd base takes for one."""
    a = "a"
    while len(a) < 1024:
        a += a.translate(str.maketrans("ab", "ba"))
    return a, a.translate(str.maketrans("ab", "ba"))


def test_words_that_polynomial_hashes_confuse(spark):
    import pyarrow as pa

    a, b = twins()
    for _, _, _, words in word_slices(pa.array([f"{a} {b}"]), PLAIN):
        assert len(set(words.hash.tolist())) == 2
    texts = [" ".join(f"{w}" if k % 7 == 3 else f"w{k}" for k in range(61)) for w in (a, b)]
    assert [r.n_removed for r in substring_dedup.deduplicated(helpers.frame(spark, texts)).orderBy("doc_id").collect()] == [0, 0]
    assert [r.component_id for r in near_dedup.near_duplicates(helpers.frame(spark, [a, b])).orderBy("doc_id").collect()] == [0, 1]
    bench = spark.createDataFrame([("x", " ".join([a, *"cdefghijkl"])), ("y", " ".join([b, *"cdefghijkl"]))], "item_id string, text string")
    assert [r["items"] for r in decontamination.contamination(helpers.frame(spark, [f"q {a} c d e f g h i j k"]), bench).collect()] == [["x"]]


def test_decontamination_equals_brute_force(spark):
    items = duckdb.sql(f"select item_id, text from '{DATA}/sf0.01/benchmark.parquet'").fetchall() + [(100, "Tiny Item"), (101, ""), (102, None), (103, "go go go go go go go go go go go")]
    texts = [t for _, t in documents()][:400] + [None, "", "a tiny item here, tiny item", items[3][1].upper() + " x", "go " * 30]
    docs, bench = helpers.frame(spark, texts), spark.createDataFrame(items, "item_id long, text string")
    windows = {}
    for i, t in items:
        w = helpers.ALNUM.findall(helpers.fold(t))
        for k in range(max(1, len(w) - 9)) if w else ():
            windows.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    lengths = {len(w) for w in windows}
    want = []
    for i, t in enumerate(texts):
        w = helpers.ALNUM.findall(helpers.fold(t))
        hit, found = set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[k : k + n]))) is not None:
                    found |= own
                    hit |= set(range(k, k + n))
        want.append((i, len(w), len(hit), sorted(found)))
    for block in (10**6, 60):
        got = decontamination.contamination(docs, bench, block_words=block).orderBy("doc_id").collect()
        assert [(r.doc_id, r.n_words, r.n_hit, r.items) for r in got] == want
    last = got[-2]
    for r in got:  # the longest match of each item, by trying every alignment
        w = helpers.ALNUM.findall(helpers.fold(texts[r.doc_id]))
        for x in r.longest:
            own = helpers.ALNUM.findall(helpers.fold(next(t for i, t in items if str(i) == x.item_id)))
            assert w[x.doc_word : x.doc_word + x.length] == own[x.item_word : x.item_word + x.length]
            best = 0
            for shift in range(-len(own), len(w)) if len(w) < 2000 else ():
                run = 0
                for k in range(len(own)):
                    run = run + 1 if 0 <= k + shift < len(w) and w[k + shift] == own[k] else 0
                    best = max(best, run)
            assert best in (0, x.length)
    assert last.longest[0].length == len(helpers.ALNUM.findall(items[3][1])) and last.longest[0].doc_word == 0
    clean = decontamination.without_contaminated(docs, bench)
    assert {r.doc_id for r in clean.collect()} == {x[0] for x in want if not x[2]} and clean.columns == docs.columns
    assert decontamination.contamination(docs.limit(0), bench.limit(0)).count() == 0


def test_token_shards_round_trip(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(token_shards.default_tokenizer())
    texts = ODD + [t for _, t in documents()][:200]
    folder = shared_dir(spark)
    shards = token_shards.committed(token_shards.write_shards(helpers.frame(spark, texts), folder, shard_bytes=20_000), folder)
    assert shards.count() > 4
    got = token_shards.read_shards(shards, folder).orderBy("start").collect()
    start = 0
    for i, (t, r) in enumerate(zip(texts, got, strict=True)):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), t
        start += len(ids)
    path = next(r.path for r in shards.orderBy("shard_key", "part").collect())
    assert token_shards.read_document(path, folder, 1)[0].tolist() == [2]
    folder = shared_dir(spark)
    assert token_shards.read_shards(token_shards.committed(token_shards.write_shards(helpers.frame(spark, []), folder), folder), folder).count() == 0


def test_written_gives_freed_memory_back(spark, monkeypatch):
    from pathlib import Path

    from clickloom.llm import common

    def resident():
        return int(Path("/proc/self/statm").read_text().split()[1]) * 4096 >> 20

    blocks = [b"x" * 60_000 for _ in range(5_000)]
    pinned = blocks[::500]  # glibc gives back the end of its heap alone by itself
    full = resident()
    del blocks
    monkeypatch.setattr(common, "_last_given", float("-inf"), raising=False)
    assert written(spark.range(3)).count() == 3
    assert len(pinned) == 10 and full - resident() > 200


def test_workers_give_freed_memory_back(spark):
    import pyarrow as pa

    from clickloom.llm.common import in_arrow

    def resident():
        return int(open("/proc/self/statm").read().split()[1]) * 4096 >> 20

    def fill(batches):
        import sys

        for _ in batches:
            blocks = [b"x" * 60_000 for _ in range(5_000)]
            held = blocks[::500]
            full = resident()
            del blocks
            sys.pinned_blocks = held  # outlives the task
            yield pa.RecordBatch.from_arrays([pa.array([os.getpid()]), pa.array([full])], names=["pid", "mb"])

    one = spark.range(1).coalesce(1)
    full = {r.pid: r.mb for r in in_arrow(one, fill, "pid long, mb long").collect()}
    for pid, mb in full.items():  # the worker sits idle now
        idle = int(open(f"/proc/{pid}/statm").read().split()[1]) * 4096 >> 20
        assert mb - idle > 200
