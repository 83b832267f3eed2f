import hashlib
import re

from rows import AWKWARD, FOLDER, frame, table_docs

from voxlake.llm import pii
from voxlake.llm.catalog import op10_pii


def luhn(d):
    t = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        t += v - 9 if v > 9 else v
    return t % 10 == 0


def digits(s):
    return re.sub("[^0-9]", "", s)


RULES = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda x: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda x: all(int(p) <= 255 for p in x.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda x: 13 <= len(digits(x)) <= 19 and luhn(digits(x))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda x: 9 <= len(digits(x)) <= 15),
]


def brute(text):
    return [(k, m.start(), m.end()) for k, p, ok in RULES for m in re.finditer(p, text or "") if ok(m.group())]


def matches(got, rows):
    texts = dict(rows)
    for r in got:
        spans = brute(texts[r.doc_id])
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest(), (r, said)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in spans) for k, *_ in RULES]
        assert r.spans.startswith(said)


def test_query_is_brute_force(spark):
    got = op10_pii(spark, FOLDER).collect()
    matches(got, table_docs())
    assert len(got) == len(table_docs()) and sum(r.n_email for r in got) > 0


TRICKY = [
    (1, "a@b.c_d@e.f x@y a@b..c q@w.e.r, 1@2.3"), (2, "😀é jo.81@mail7.example.com; +1 (980) 555-6268 and +12 3"), (3, "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.255 1.2.3"),
    (4, "4111 1111 1111 1111 4111-1111-1111-1112 4111  1111 12345678901234567890"), (5, "IBAN GB82 WEST 1234 5698 7654 32 and DE89370400440532013000, GB82 WEST 1234 5698 7654 33"),
    (6, "+" * 50 + "1" * 20), (7, "7" * 6000), (8, "1 " * 3000 + "x"), (9, "a@b.cd " * 2000), (10, "call +49 30 1234567 now"), (11, "a" * 4000 + "@"),
]


def test_tricky_texts(spark, folder):
    from rows import write_docs

    rows = TRICKY + [(100 + d, t) for d, t, _ in AWKWARD]
    got = op10_pii(spark, write_docs(spark, f"{folder}/t", rows)).collect()
    matches(got, rows)
    assert {r.doc_id: r.n_iban for r in got}[5] == 2


def test_context_raises_the_score(spark):
    rows = [(1, "call +49 30 1234567", "s"), (2, "see +49 30 1234567", "s")]
    score = {r.doc_id: r.pii[0]["score"] for r in pii.find_pii(frame(spark, rows)).collect()}
    assert score[1] > score[2]


def test_awkward_rows_and_redaction(spark):
    df = frame(spark)
    assert pii.find_pii(df).count() == len(AWKWARD) and pii.find_pii(df.limit(0)).count() == 0
    rows = [(1, "to jo@x.org or 10.0.0.1, card 4111 1111 1111 1111.", "s"), (2, None, "s"), (3, "none", "s")]
    got = {r.doc_id: r.text for r in pii.redact(frame(spark, rows)).collect()}
    assert got == {1: "to [EMAIL] or [IP], card [CARD].", 2: None, 3: "none"}
    assert pii.redact(df).columns == df.columns
