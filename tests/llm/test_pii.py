import hashlib
import re

import pytest

from hearthline.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TEXTS = [
    None, "", "mail a.b@c.de, a@b.c.@d.e x@y @z.q a@b", "1.2.3.4.5 and 999.1.1.1 300.2.3.4 10.0.0.255 0255.1.1.1", "4111 1111 1111 1111 and 4111-1111-1111-1112, 12 34", "+1 (555) 555-1234 +12 ++49 30 1234567- +1",
    "x" * 5000 + "@" + "9" * 3000, "a@b.c d@e.f@g.h", "é 4111111111111111 ü a@b.co",
]


def brute(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 12 <= len(d := re.sub("[ -]", "", m.group())) <= 19 and pii.luhn(d)]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(out)


@pytest.mark.parametrize("text", TEXTS)
def test_base(text):
    assert pii.base_spans(text or "") == brute(text)


def test_long_tokens_cost_their_length():
    import time

    start = time.process_time()
    text = "x" * 1_000_000 + " 1 " + "9" * 300_000 + "@" + "a-" * 300_000 + " " + "12.34." * 100_000
    assert len(list(pii.candidates(text, pii.base_spans(text)))) <= 3
    assert len(pii.shape("a1" * 200_000)) == 16 and pii.shape("Ab-12") == "Aa-9"
    assert time.process_time() - start < 20


def test_query_base(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = pii.op2_pii(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        base = brute(docs[r["doc_id"]])
        s = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert r["base_sha256"] == hashlib.sha256(s.encode()).hexdigest()
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == tuple(sum(k == i for _, k, _ in base) for i in range(4))


def test_bootstrap_finds_what_stands_where_known_ones_do(spark):
    rows = [(i, f"please call me at {'+1 (555) 555-' if i % 2 else '(555) 555-'}{1000 + i} soon, order {i}77777 shipped", "extra") for i in range(60)]
    rows += [(100 + i, f"pay with card {_luhn(i)} today", "extra") for i in range(40)]
    rows += [(900, "pay with card 4111111111111112 today", "x"), (901, None, None), (901, None, None), (902, "", "x"), (None, "a@b.co", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    out = {r["doc_id"]: r for r in pii.scan_pii(docs).collect()}
    assert [(s["kind"], s["start"], s["end"]) for s in out[900]["spans"]] == [(2, 14, 30)] and out[900]["base"] == []
    assert out[901]["spans"] == [] and out[None]["spans"][0]["kind"] == 0
    assert not any(s["start"] > 40 for r in out.values() for s in r["spans"]), "order numbers are no identifiers"
    assert pii.scan_pii(docs.limit(0)).count() == 0 and pii.scan_pii(docs).count() == len(rows)


def test_candidates_are_runs():
    text = 'call (555) 555-1234, or 1 (555) 555-1234 or "(555) 555 1234". Pay 4111 1111 1111 1112 at john@localhost (AB-12345) a@b 12 7; 555 12th. (((((((1 +12'
    assert [text[a:b] for a, b in pii.candidates(text, pii.base_spans(text))] == [
        "(555) 555-1234", "1 (555) 555-1234", "(555) 555 1234", "4111 1111 1111 1112", "john@localhost", "AB-12345", "a@b",
    ]
    rows = "1234567 " * 40
    assert len(list(pii.candidates(rows, []))) == 40, "a row of numbers is no single identifier"


def test_bootstrap_finds_unseen_formats_and_learns_from_them(spark):
    """Formats that no fixed pattern has, by their places; and a place without any known one, by what was found elsewhere."""
    texts = [f"please call me at {'+1 (555) 555-' if i % 3 else '(555) 555-'}{1000 + i} soon, order {i}77777 shipped" for i in range(60)]
    texts += [f"write a mail to {'user%d@localhost' % i if i % 4 == 0 else 'user%d@mail.example.com' % i} now" for i in range(60)]
    texts += [f"she paid by card {'4111 1111 %04d 1112' % i if i % 5 == 0 else _luhn(i)} yesterday" for i in range(60)]
    second = len(texts)
    texts += [f"the fax machine: (555) 555-{1000 + i}" for i in range(0, 60, 3)]
    texts += [f"the fax machine: (555) 777-{2000 + i}" for i in range(4)]
    texts += [f"see page {10000 + i} there" for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["doc_id"]: [(s["kind"], texts[r["doc_id"]][s["start"] : s["end"]]) for s in r["spans"]] for r in pii.scan_pii(docs).collect()}
    for i in range(60):
        assert out[i] == [(3, f"{'+1 (555) 555-' if i % 3 else '(555) 555-'}{1000 + i}")]
        assert out[60 + i] == [(0, texts[60 + i].split()[4])]
        assert len(out[120 + i]) == 1 and out[120 + i][0][0] == 2 and len(out[120 + i][0][1].replace(" ", "")) == 16
    for i in range(second, second + 24):
        assert out[i] == [(3, texts[i].split(": ")[1])], "a place that only found ones vouch for"
    assert all(out[i] == [] for i in range(second + 24, len(texts)))


def test_bootstrap_finds_national_phones(spark):
    """Half of the phones at a place, the rest in a format that no fixed pattern has."""
    texts = [f"please call me at {'+1 (555) 555-' if i % 2 else '(555) 555-'}{1000 + i} soon, order {i}77777 shipped" for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.scan_pii(docs).collect():
        text = texts[r["doc_id"]]
        assert [(s["kind"], text[s["start"] : s["end"]]) for s in r["spans"]] == [(3, text[18:].split(" soon")[0])]


def _luhn(i):
    head = f"411111{i:09d}"
    return next(head + str(d) for d in range(10) if pii.luhn(head + str(d)))
