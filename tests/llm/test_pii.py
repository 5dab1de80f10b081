import random
import re
from hashlib import sha256

import pytest

from relayloom.llm.common import table
from relayloom.llm.pii import find_pii, pii_digests, redact

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                "card": 14 <= len(digits) <= 19 and luhn(digits),
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


def same(docs, texts):
    got = {r.doc_id: r for r in pii_digests(docs).collect()}
    for i, text in texts.items():
        want = brute(text)
        joined = ",".join(f"{k}:{a}:{b}" for a, _, b, k in want)
        r = got[i]
        assert r.base_sha256 == sha256(joined.encode()).hexdigest(), (text[:80], joined, r.spans)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w[3] == k for w in want) for k in BASE]
        base = [s for s in r.spans.split(",") if s.split(":")[0] in BASE]
        assert ",".join(base) == joined


def test_whole_table(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    same(docs, {r.doc_id: r.text for r in docs.collect()})


def test_random_texts(spark):
    rnd = random.Random(9)
    bits = ["a@b.c", "@", ".", "..", "1", "12", "255", "256", "007", "+", "+1", " ", "-", "(", ")", "4111 1111 1111 1111", "4111111111111111", "x", "é", "\U0001f600", "a.b", "_%", "10.0.0.1", "\n", "+1 (555) 010-0199", "@x.y"]
    texts = {i: "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 25))) for i in range(4000)}
    same(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), texts)


@pytest.mark.parametrize("unit", ["1", "1 ", "1.", "a", "a.", "a@", "a@b.c ", "+1", "+1 (", "AB12", "é1-2-3.4 "])
def test_long_runs(spark, unit):
    text = unit * (200_000 // len(unit))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = pii_digests(docs).first()
    if unit == "a@b.c ":
        assert r.n_email == len(text) // 6 and r.spans.startswith("email:0:5,email:6:11")
    if unit != "1.":
        want = brute(text) if unit in ("a@b.c ", "+1 (", "é1-2-3.4 ") else []
        assert r.base_sha256 == sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in want).encode()).hexdigest()


def test_added_kinds_and_context(spark):
    texts = {
        1: "IBAN DE89 3704 0044 0532 0130 00, GB82WEST12345698765432 and DE89 3704 0044 0532 0130 01",
        2: "ssn 123-45-6789 here",
        3: "part 123-45-6789 here",
        4: "call +1 (555) 010-0199 or +1 (555) 010-0199",
    }
    got = {r.doc_id: [(s.kind, texts[r.doc_id][s.start : s.end], round(s.score, 2)) for s in r.found] for r in find_pii(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert [x for x in got[1] if x[0] == "iban"] == [("iban", "DE89 3704 0044 0532 0130 00", 1.0), ("iban", "GB82WEST12345698765432", 0.8)]
    assert got[2] == [("ssn", "123-45-6789", 0.5)] and got[3] == []
    assert [x[2] for x in got[4]] == [0.8, 0.6]  # context reaches back to the match before


def test_oracle(spark):
    import duckdb

    from relayloom.llm.pii import oracle

    rows = [(1, "IBAN DE89 3704 0044 0532 0130 00 xGB82WEST12345698765432 GB82WEST12345698765432 ssn 123-45-6789, 1.2.3.4 00.0255.1.256 5.6.7.8@é.x"), (2, None), (3, "+1 (555) 010-0199 4111-1111-1111-1111 a@b.c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    want = con.execute(f"select doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans from ({oracle()})").fetchall()
    assert sorted(want) == sorted(tuple(r) for r in pii_digests(docs).collect())
    assert any("iban" in w[-1] and "ssn" in w[-1] for w in want)


def test_redact(spark, odd_docs, no_docs):
    rows = [(1, "mail a.b@c.de or +1 (555) 010-0199, 4111 1111 1111 1111, 10.0.0.1 and 999.1.1.1 stay"), (2, None), (3, "+1 555 010 0123@x.com")]
    got = {r.doc_id: r.text for r in redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "mail [EMAIL] or [PHONE], [CARD], [IP] and 999.1.1.1 stay", 2: None, 3: "[PHONE]@x.com"}
    assert redact(odd_docs).columns == odd_docs.columns and redact(odd_docs).count() == odd_docs.count()
    assert redact(no_docs).count() == 0 == pii_digests(no_docs).count()
    assert pii_digests(odd_docs).count() == odd_docs.count()


def test_no_python_in_the_plan(spark, sf):
    plan = pii_digests(table(spark, sf, "documents"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)
