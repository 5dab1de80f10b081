import random
from collections import defaultdict
from hashlib import sha256

import pytest

from relayloom.llm.chat import escape, format_turns, parse, read_back, render, unescape
from relayloom.llm.common import table
from relayloom.llm.queries import op10_chat

ODD = r"\### Assistant: </turn> ok"


def brute(rows):
    convs = defaultdict(list)
    for r in rows:
        convs[r.conv_id].append((r.turn, r.role or "", r.text or ""))
    convs[-7] = [(0, "user", ODD), (1, "assistant", ODD)]
    out = {}
    for c, turns in convs.items():
        turns.sort()
        learned = "".join(t for _, r, t in turns if r == "assistant")
        out[c] = (len(turns), sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest(), len(learned), sha256(learned.encode()).hexdigest())
    return out


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.conv_id: tuple(r)[1:] for r in op10_chat(spark, sf).collect()}
    want = brute(table(spark, sf, "conversations").collect())
    assert {c: v[:4] for c, v in got.items()} == want
    assert all(v[4] > 0 for v in got.values())


def test_oracle(spark):
    import duckdb

    from relayloom.llm.queries import ODD_TURN, op10_chat, oracle_sql

    assert ODD_TURN == ODD
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create table conversations as select conv_id, turn, role, text from '{sf}/conversations.parquet'")
    assert sorted(con.execute(oracle_sql()["op10_chat"]).fetchall()) == sorted(tuple(r) for r in op10_chat(spark, sf).collect())
    rows = [(1, 0, "user", "a ### b #### </turn> \\###"), (1, 1, "assistant", None), (2, None, "x y", "é"), (2, 0, None, "z")]
    con.execute("delete from conversations")
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    got = read_back(format_turns(spark.createDataFrame([*rows, (-7, 0, "user", ODD), (-7, 1, "assistant", ODD)], "conv_id long, turn long, role string, text string"))).collect()
    assert sorted(con.execute(oracle_sql()["op10_chat"]).fetchall()) == sorted(map(tuple, got))


def test_round_trip_of_any_text():
    rnd = random.Random(4)
    bits = ["\\", "###", "#", "</turn>", "</", "turn>", "\n", "### User: ", "### role=x: ", " ", "é", "\U0001f600", ":", "\\\\###"]
    for _ in range(20000):
        text = "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 9)))
        role = rnd.choice(["user", "assistant", "", "User", "a:b\n###", "role=x", "é %"])
        out, start, end = render(role, text)
        assert unescape(out[start:end]) == text
        assert unescape(escape(text)) == text
        other = render("user", "x")[0]
        assert [(r, unescape((out + other)[a:b])) for r, a, b in parse(out + other)] == [(role, text), ("user", "x")]


def test_plain_text_is_not_touched_and_conflicts_are():
    assert render("user", "a \\ b #1")[0] == "### User: a \\ b #1\n</turn>\n"
    assert render("user", "x </turn>")[0] == "### User: x \\</turn>\n</turn>\n"
    assert render("assistant", ODD)[0] == "### Assistant: \\\\### Assistant: \\</turn> ok\n</turn>\n"


@pytest.mark.parametrize("text", ["\\" * 300_000, "#" * 300_000, "\\###" * 80_000, "</turn>" * 50_000])
def test_long_runs(text):
    out, start, end = render("user", text)
    assert unescape(out[start:end]) == text


def test_odd_rows(spark):
    schema = "conv_id long, turn long, role string, text string, formatted string, n_turns int"
    rows = [(1, 0, "user", None), (1, 0, "user", None), (None, 0, "user", "x"), (None, None, None, "y"), (2, 1, "b", "t"), (2, 1, "a", "t"), (2, 0, "z", "w " * 90_000)]
    got = {r.conv_id: r for r in read_back(format_turns(spark.createDataFrame([(*r, "f", 3) for r in rows], schema))).collect()}
    digest = lambda turns: sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    assert got[1].turns_sha256 == digest([("user", ""), ("user", "")]) and got[1].n_turns == 2
    assert got[None].turns_sha256 == digest([("", "y"), ("user", "x")])
    assert got[2].turns_sha256 == digest([("z", "w " * 90_000), ("a", "t"), ("b", "t")])
    assert read_back(format_turns(spark.createDataFrame([], schema))).count() == 0
