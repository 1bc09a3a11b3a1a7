import hashlib
import re

import duckdb

from clickloom.llm import personal_data
from tests.conftest import DATA
from tests.llm import helpers

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 13 <= len(digits) <= 19 and luhn(digits) or kind == "phone" and 9 <= len(digits) <= 15
            if good:
                out.append((kind, m.start(), m.end()))
    return out


ODD = [
    None, "", "a@b c@d.e.f+g@h.i", "x..@y.z-", "@a.b", "a@b.c@d.e", "1.2.3.4.5.6.7.8", "1.2.3.256 1.02.003.0004", "300.1.1.1.1", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (988) 555-2485.", "+1((((((((", "++1 234 567 890",
    "🙂é a.b@c.de 🙂 10.0.0.1", "9" * 20000, "1 " * 5000, "a" * 50000, "a@" + "b." * 20000 + "c", "+" * 3000 + "1" + " " * 3000, "1.1." * 5000, "0 4111111111111111", "a@b.c" * 50, "+12345678901234567 +123456789",
]


def test_base_spans_equal_brute_force(spark):
    texts = ODD + [t for _, t in duckdb.sql(f"select doc_id, text from '{DATA}/sf0.01/documents.parquet' order by doc_id").fetchall()]
    rows = personal_data.base_spans(helpers.frame(spark, texts)).select("doc_id", "base").collect()
    got = {r.doc_id: [(x.kind, x.start, x.end) for x in r.base] for r in rows}
    for i, t in enumerate(texts):
        assert got[i] == spans(t), (t or "")[:80]
    assert sum(len(x) for x in got.values()) > 100


def test_contexts_lead_to_unseen_identifiers(spark):
    texts = [f"Text {chr(97 + i)} Reach us: u{i}@mail{i}.example.org today and more" for i in range(9)] + ["And so: Reach us: user7#mail.example today and more", "no cue user8#mail.example here", None, ""]
    out = {r.doc_id: r for r in personal_data.personal_data(helpers.frame(spark, texts)).collect()}
    assert [(x.kind, x.value) for x in out[9].more] == [("email", "user7#mail.example")]
    assert not any(out[i].more for i in out if i != 9)
    clean = {r.doc_id: r for r in personal_data.redacted(helpers.frame(spark, texts)).collect()}
    assert clean[0].text == "Text a Reach us: <email> today and more" and clean[0].n_chars == len(clean[0].text)
    assert clean[9].text == "And so: Reach us: <email> today and more" and clean[10].text == texts[10] and clean[11].text is None


def test_kinds_and_documents_of_a_pattern(spark):
    texts = [f"Text {chr(97 + i)} Reach us: u{i}@mail{i}.example.org today" for i in range(19)] + ["Text t Reach us: +1 988 555 2485 today", "Now: Reach us: user7#mail.example today"]
    texts += [f"Text {chr(97 + i)} Call desk: u{i}@post{i}.example.org soon" for i in range(5)] + [f"Text {chr(97 + i)} Call desk: +1 988 555 248{i} soon" for i in range(4)] + ["Now: Call desk: user8#mail.example soon"]
    texts += [" ".join(f"Write to: u{i}@land{i}.example.org then" for i in range(4)), "Now: Write to: user9#mail.example then"]
    more = {r.doc_id: [(x.kind, x.value) for x in r.more] for r in personal_data.personal_data(helpers.frame(spark, texts)).collect()}
    assert more.pop(20) == [("email", "user7#mail.example")]  # one phone among many emails
    assert not any(more.values())  # kinds in like shares; seeds of one document


def test_positions_of_very_many_matches(spark):
    texts = ["a@b.cc " * n + "x" for n in (personal_data.BLOCK - 1, personal_data.BLOCK, personal_data.BLOCK + 1, 5 * personal_data.BLOCK, 3_000)]
    for r in personal_data.base_spans(helpers.frame(spark, texts)).select("doc_id", "base").collect():
        assert [(x.kind, x.start, x.end) for x in r.base] == spans(texts[r.doc_id])


def hexadecimal(k):
    return hashlib.sha1(str(k).encode()).hexdigest()


def test_secrets_and_promoted_instances(spark):
    texts = [f"Line {chr(97 + i)} token = \"{hexadecimal(i)}\" set by hand{i}x" for i in range(8)]
    texts += [f"Line {chr(97 + i)} commit {hexadecimal(50 + i)} of {chr(110 + i)}" for i in range(2)]  # such a look, but no pattern
    texts += ['Then token = "s3cr3t-key-001" was sent', 'Then token = "s3cr3t-key-002" was sent', 'Then token = "s3cr3t-key-003" was sent', "was s3cr3t-key-004 sent"]
    found = {r.doc_id: [(x.kind, texts[r.doc_id][x.start : x.end]) for x in r.more] for r in personal_data.personal_data(helpers.frame(spark, texts)).collect()}
    assert all(found[i] == [("secret", hexadecimal(i))] for i in range(8))  # without their quotes
    assert not found[8] and not found[9] and not found[13]
    clean = {r.doc_id: r.text for r in personal_data.redacted(helpers.frame(spark, texts)).collect()}
    assert clean[0] == 'Line a token = "<secret>" set by hand0x' and clean[8] == texts[8]


def test_secrets_of_the_table(spark):
    """All words that look like a secret after `token =`, and nothing else that the tables' texts have."""
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    right = found = 0
    planted = {}
    for doc_id, text in duckdb.sql(f"select doc_id, text from '{DATA}/sf0.01/documents.parquet'").fetchall():
        planted[doc_id] = {(m.start(1), m.end(1)) for m in re.finditer(r'(?i)token = "([0-9a-f]{40})"', text or "")}
    for r in personal_data.personal_data(docs).select("doc_id", "more").collect():
        own = {(x.start, x.end) for x in r.more if x.kind == "secret"}
        found += len(own)
        right += len(own & planted[r.doc_id])
    assert right == found > 0 and right >= 0.9 * sum(map(len, planted.values()))


def test_rows_of_one_id_and_columns_of_any_name(spark):
    text = "Mail a@b.cc now"
    docs = spark.createDataFrame([(1, text, 15, "p"), (1, "none", 4, "q"), (None, text, 15, "r"), (None, "x 10.0.0.1", 10, "s")], "doc_id long, TEXT string, N_CHARS int, base string")
    out = personal_data.redacted(docs)
    assert out.columns == docs.columns
    assert {tuple(r) for r in out.collect()} == {(1, "Mail <email> now", 16, "p"), (1, "none", 4, "q"), (None, "Mail <email> now", 16, "r"), (None, "x <ip>", 6, "s")}
    assert personal_data.redacted(docs.limit(0)).count() == 0


def test_query(spark):
    got = {r.doc_id: r for r in personal_data.query(spark, f"{DATA}/sf0.001").collect()}
    for doc_id, text in duckdb.sql(f"select doc_id, text from '{DATA}/sf0.001/documents.parquet'").fetchall():
        own = spans(text)
        r = got[doc_id]
        base = [f"{k}:{a}:{b}" for k, a, b in own]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest() and set(base) <= set(r.spans.split(",")) | {""}
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, _, _ in own) for x in BASE]
    assert personal_data.personal_data(helpers.frame(spark, [])).count() == 0
