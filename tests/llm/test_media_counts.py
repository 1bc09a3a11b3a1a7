import base64
import hashlib
import zlib

import duckdb
import pytest

from clickloom.llm import media, sentencepiece_bpe, token_counts, token_shards
from clickloom.llm.common import shared_dir
from tests.conftest import DATA
from tests.llm import helpers


def test_png_round_trip_and_feature():
    for text in (None, "", "a", "é" * 96, "x" * 192, "y" * 5000):
        payload = media.padded(text)
        assert len(payload) % 192 == 0 and len(payload) > 0 and payload.rstrip(b" ") == (text or "").encode()
        png = media.to_png(payload)
        assert media.from_png(png) == payload and media.feature(payload) == media.feature(media.from_png(png))
    with pytest.raises(ValueError):
        media.from_png(png[:60] + bytes([png[60] ^ 1]) + png[61:])


def test_items_in_order_with_captions():
    data = "data:image/png;base64," + base64.b64encode(b"pixels").decode()
    page = f"<h1>Head</h1><p>One <b>bold</b> word<img src='a.png' alt='An &amp; image'>and on</p><figure><img src=\"{data}\"><figcaption>Two <i>words</i></figcaption></figure><script>no</script><video src=v.mp4></video>tail"
    got = media.items(page)
    assert [(x["position"], x["kind"], x["text"] or x["source"][:8], x["caption"]) for x in got] == [
        (0, "text", "Head", None), (1, "text", "One bold word", None), (2, "media", "a.png", "An & image"), (3, "text", "and on", None),
        (4, "media", "data:ima", "Two words"), (5, "media", "v.mp4", None), (6, "text", "tail", None),
    ]
    assert got[4]["digest"] == hashlib.sha256(b"pixels").hexdigest() and media.items(None) == media.items("") == []
    assert [x["caption"] for x in media.items("<figure><img src=x><figcaption>open")] == ["open"]


def test_resolution_keeps_places(spark):
    store = media.facts(media.stored(helpers.frame(spark, ["same", "same", "other"])))
    digest = hashlib.sha256(media.padded("other")).hexdigest()
    pages = spark.createDataFrame([(1, f"<p>a<img src='sha256:{digest}' alt=c>b<img src='u'><img src='gone'>"), (2, None)], "page_id long, html string")
    known = spark.createDataFrame([("u", digest)], "source string, digest string")
    rows = {r.page_id: r["items"] for r in media.resolved(media.interleaved(pages), store, known).collect()}
    assert [(x["kind"], x["caption"], x["media"] and x["media"]["payload_bytes"]) for x in rows[1]] == [("text", None, None), ("media", "c", 192), ("text", None, None), ("media", None, 192), ("media", None, None)]
    assert rows[2] == [] and store.count() == 2


def plain_feature(payload):
    """Average hash of an 8 by 8 grid and channel means, by plain loops."""
    rows = [payload[i : i + 192] for i in range(0, len(payload), 192)]
    grid = []
    for i in range(8):
        low, high = i * len(rows) // 8, max(i * len(rows) // 8 + 1, (i + 1) * len(rows) // 8)
        for j in range(8):
            total = sum(sum(r[24 * j : 24 * j + 24]) for r in rows[low:high])
            grid.append(total * 840 // (high - low))
    bits = "".join("1" if x * 64 > sum(grid) else "0" for x in grid)
    means = [sum(payload[c::3]) * 1000 // (len(rows) * 64) for c in range(3)]
    return f"{int(bits, 2):016x}:" + ":".join(map(str, means))


def test_query_follows_the_contract(spark):
    import struct

    got = {r.doc_id: r for r in media.query(spark, f"{DATA}/sf0.001").collect()}
    rows = duckdb.sql(f"select doc_id, text from '{DATA}/sf0.001/documents.parquet'").fetchall()
    assert len(got) == len(rows)
    for doc_id, text in rows:
        raw = (text or "").encode()
        payload = raw + b" " * (192 - len(raw) % 192 if len(raw) % 192 or not raw else 0)
        r = got[doc_id]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        lines = b"".join(b"\0" + payload[i : i + 192] for i in range(0, len(payload), 192))
        file = b"\x89PNG\r\n\x1a\n"
        for kind, body in ((b"IHDR", struct.pack(">IIBBBBB", 64, len(payload) // 192, 8, 2, 0, 0, 0)), (b"IDAT", zlib.compress(lines, 1)), (b"IEND", b"")):
            file += struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
        assert (r.media_bytes, r.media_sha256, r.feature) == (len(file), hashlib.sha256(file).hexdigest(), plain_feature(payload))


def test_copies_are_stored_once_and_odd_ids_resolve(spark):
    rows = [(1, "same"), (2, "same"), (3, "other"), (3, "third"), (None, "same"), (None, "fourth"), (4, None), (5, ""), (6, "same")]
    docs = spark.createDataFrame([(i, t, "q") for i, t in rows], "doc_id long, text string, digest string")
    store = media.stored(docs)
    assert store.count() == 6 and store.select("digest").distinct().count() == 5  # the row without id is stored for itself
    empty = docs.limit(0)
    assert media.stored(empty).count() == 0 and media.interleaved(media.galleries(media.named(empty)), "members").count() == 0
    shown = media.interleaved(media.galleries(media.named(docs)), "members").collect()
    assert sum(len(r.members) for r in shown) == 9
    for r in shown:  # the note after a figure and the heading of the next are blocks of their own
        assert [x["kind"] for x in r["items"]] == ["text", "media", "text"] * len(r.members) and [x["position"] for x in r["items"]] == list(range(3 * len(r.members)))


def test_rollup(spark):
    rollup = token_counts.Rollup(spark, shared_dir(spark))
    rows = lambda *x: spark.createDataFrame(list(x), "source string, lang string, tokenizer string, sign int, n_tokens long")
    assert rollup.totals().count() == 0
    assert rollup.commit("a", rows(("s", "en", "t", 1, 5), ("s", "en", "t", 1, 7), (None, "en", "t", 1, None)))
    assert not rollup.commit("a", rows(("s", "en", "t", 1, 5)))
    assert rollup.commit("b", rows(("s", "en", "t", -1, 5), ("s", "en", "t", 1, 6), (None, "en", "t", -1, None), ("z", "de", "t", 1, 1)))
    want = {("s", "en", "t", 2, 13), ("z", "de", "t", 1, 1)}
    assert {tuple(r) for r in rollup.totals().collect()} == want
    rollup.compact()
    assert rollup.commit("c", rows(("z", "de", "t", 1, 2))) and rollup.commit("d", rows(("z", "de", "t", -1, 2)))
    rollup.compact()
    rollup.compact()
    names = lambda: sorted(r.batch for r in rollup.batches().collect())
    assert names() == ["a", "b", "c", "d"] and not rollup.commit("c", rows(("z", "de", "t", 1, 2)))
    assert names()[:2] == ["a", "b"] and {tuple(r) for r in rollup.totals().collect()} == want and not rollup.commit("b", rows(("s", "en", "t", 1, 5)))


def test_two_writers_of_one_batch(spark):
    rollup = token_counts.Rollup(spark, shared_dir(spark))
    rows = spark.createDataFrame([("s", "en", "t", 1, 5)], "source string, lang string, tokenizer string, sign int, n_tokens long")
    rollup.commit("a", rows)
    known, rollup.known = rollup.known, lambda batch: False  # as if both had looked before either wrote
    rollup.commit("a", rows)
    rollup.known = known
    assert [tuple(r) for r in rollup.totals().collect()] == [("s", "en", "t", 1, 5)]
    rollup.commit("b", rows)
    rollup.compact()
    assert [tuple(r) for r in rollup.totals().collect()] == [("s", "en", "t", 2, 10)] and rollup.known("a") and not rollup.known("c")


def test_counts_equal_the_libraries(spark):
    import sentencepiece
    from tokenizers import Tokenizer

    piece = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_bpe.default_model())
    word = Tokenizer.from_file(token_shards.default_tokenizer())
    docs = duckdb.sql(f"select doc_id, source, lang, text from '{DATA}/sf0.001/documents.parquet'").fetchall()
    labels = {}
    for doc_id, quality, toxic in duckdb.sql(f"select doc_id, quality, toxic from '{DATA}/sf0.001/labels.parquet'").fetchall():
        labels[doc_id] = (quality, toxic)
    want = {}
    for doc_id, source, lang, text in docs:
        quality, toxic = labels.get(doc_id, (None, None))
        if toxic == 1:
            continue
        n = {"piece_bpe_32k": len(piece.encode(text or "")), "word_bpe_49k": len(word.encode(text or "", add_special_tokens=False).ids)}
        if quality == 0:
            n["piece_bpe_32k"] = n["word_bpe_49k"]
        for k, v in n.items():
            d, t = want.get((source, lang, k), (0, 0))
            want[source, lang, k] = (d + 1, t + v)
    got = {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in token_counts.query(spark, f"{DATA}/sf0.001").collect()}
    assert got == want
    odd = helpers.frame(spark, ["▁ \n-", None, "", "<|ENDOFTEXT|> a", "x" * 3000, "same", "same"])
    for version, count in (("piece_bpe_32k", lambda t: len(piece.encode(t))), ("word_bpe_49k", lambda t: len(word.encode(t, add_special_tokens=False).ids))):
        assert [r.n_tokens for r in token_counts.counted(odd, version).orderBy("doc_id").collect()] == [count(r.text or "") for r in odd.orderBy("doc_id").collect()]
        assert token_counts.counted(odd.limit(0), version).count() == 0


def test_counts_equal_sql(spark):
    got = {tuple(r[c] for c in ("source", "lang", "tokenizer", "n_docs", "n_tokens")) for r in token_counts.word_query(spark, f"{DATA}/sf0.01").collect()}
    for name in ("documents", "labels"):
        duckdb.sql(f"create or replace view {name} as select * from '{DATA}/sf0.01/{name}.parquet'")
    assert got == set(duckdb.sql(token_counts.ORACLE).fetchall())
