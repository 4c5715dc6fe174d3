import hashlib
import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from sparknorm.llm import pii


def brute(text):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def base(text):
    return [tuple(s) for s in pii.find(text) if s.kind in pii.BASE]


PARTS = ["a@b.c", "@", ".", "-", " ", "+", "0", "1", "25", "4111 1111 1111 1111", "192.168.0.1", "+49 (30) 1234-567", "x", "é", "DE89370400440532013000", "http://a.b/c?d", "account no 123456", "00000255.1.2.3"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=12).map("".join))
def test_base_is_the_patterns(text):
    assert base(text) == brute(text)


@settings(max_examples=200, deadline=None)
@given(st.text("a@.+0 1-29()", max_size=40))
def test_base_on_any_text(text):
    assert base(text) == brute(text)


def test_added_kinds():
    text = "Pay IBAN DE89 3704 0044 0532 0130 00 or Account no. 12345678, see https://user:pw@host.example/x."
    assert [s.kind for s in pii.find(text) if s.kind not in pii.BASE] == ["iban", "account", "url"]
    assert pii.mask("mail me: jo.e@x.example, +44 20 7946 0958!") == "mail me: <EMAIL>, <PHONE>!"
    assert pii.mask(None) is None and pii.mask("") == ""


def test_schemes_cues_and_secrets():
    found = lambda t, k: [t[s.start : s.end] for s in pii.find(t) if s.kind == k]
    for url in ("sftp://a.b/c", "ftp://a.b", "WSS://a.b:80?x", "http://u@b:c@host.example/p_(1", "ssh://localhost:22"):
        assert found(f"({url}).", "url") == [url]
    assert found("xhttp://a.b 1http://a.b http://a_b.c/d http:// https://a", "url") == []
    assert found("http://http://a.b/c", "url") == ["http://a.b/c"] and found("http://a.b/http://c.d", "url") == ["http://a.b/http://c.d"]
    for text in ("Kontonummer: 12345678", "accounts 12345678", "Girokonto 12345678", "Kontonr. 12345678", "account id=12345678", "Cuenta numero 12345678"):
        assert found(text, "account") == ["12345678"], text
    assert found("1konto 12345678 konto 12345", "account") == []
    assert found('token = "9dd3c80004c73dc9e548fee51b23b527780d4f20" password: short secret=abcdefghijklmnopqrst', "secret") == ["9dd3c80004c73dc9e548fee51b23b527780d4f20"]


def test_time_is_linear():
    for part in ("http://", "://", "a@", "token=", "konto", "http://a.b@", "account 12345", "+1", "1.", "secret=a1"):
        took = []
        for n in (20_000, 80_000):
            began = time.perf_counter()
            pii.find(part * n)
            took.append(time.perf_counter() - began)
        assert took[1] < 0.5 or took[1] < 12 * took[0], (part, took)


def test_long_texts():
    for text in ("1" * 200_000, "1." * 100_000, "a" * 200_000 + "@", "@" * 200_000, "+1" * 100_000, "A1" * 100_000):
        pii.find(text)


def test_spark_and_edge_cases(spark):
    rows = [(1, "é a@b.co", "z"), (1, "é a@b.co", "z"), (2, None, "z"), (None, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = {r["doc_id"]: r for r in pii.scan(docs).collect()}
    assert pii.scan(docs).count() == 4
    assert got[1]["spans"] == "email:2:8" and got[2]["spans"] == "" and got[None]["n_email"] == 0
    assert [r[0] for r in docs.select(pii.masked(docs.text)).collect()] == ["é <EMAIL>", "é <EMAIL>", None, ""]
    assert pii.scan(docs.limit(0)).count() == 0
    assert pii.digest("") == hashlib.sha256(b"").hexdigest()
