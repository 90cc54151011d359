from __future__ import annotations

import duckdb
from quern.llm import chat
from tests.conftest import rows_of, rows_of_sql

PAIR = "conv_id long, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>"


def test_equals_sql(spark):
    folder = "/root/testdata/sf0.01"
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet'")
    got = rows_of(chat.op6_preference_format(spark, folder))
    assert got == rows_of_sql(connection, chat.SQL["op6_preference_format"])


def python(chosen, rejected):
    chosen, rejected, n = chosen or [], rejected or [], 0
    while n < min(len(chosen), len(rejected)) and chosen[n] == rejected[n]:
        n += 1
    show = lambda t: f"<|{t[0]}|>\n{t[1]}<|end|>\n"

    def spans(turns):
        out, at = [], 0
        for t in turns:
            end = at + len(show(t))
            if t[0] == "assistant":
                out.append((at + len(t[0]) + 5, end))
            at = end
        return out

    a, b = chosen[n:], rejected[n:]
    text = lambda turns: "".join(map(show, turns))
    return n, text(chosen[:n]), text(a), spans(a), text(b), spans(b)


def test_pairs_of_all_kinds(spark):
    u, a, b = ("user", "Hi 🙂"), ("assistant", "Hello"), ("assistant", "")
    pairs = [
        (1, [u, a], [u, b]),
        (2, [u, a, u, a], [u, a, u, b, u, a]),
        (3, [u, a], [u, a]),
        (4, [u, a], [u, a, u, a]),
        (5, [a], [b]),
        (6, [], [a]),
        (7, None, [u]),
        (8, None, None),
    ]
    got = chat.preferences(spark.createDataFrame(pairs, PAIR)).collect()
    for r, (_, x, y) in zip(sorted(got), pairs):
        masks = [[tuple(s) for s in m] for m in (r.chosen_mask, r.rejected_mask)]
        assert (r.prompt_turns, r.prompt, r.chosen_text, masks[0], r.rejected_text, masks[1]) == python(x, y)


def test_rough_turns(spark):
    rows = [
        (1, None, "assistant", "late"),
        (1, 0, "user", None),
        (1, 1, "assistant", "x"),
        (1, 1, "assistant", "x"),
        (2, 0, "assistant", "alone"),
        (3, 0, "user", "no answer"),
        (None, 0, "assistant", "nobody's"),
        (4, 0, None, "q"),
        (4, 1, "assistant", "long " * 50_000),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns = turns.selectExpr("*", "1 AS chosen", "2 AS places", "3 AS t")
    got = {r.conv_id: r for r in chat.preferences(chat.answer_pairs(chat.conversations(turns))).collect()}
    assert set(got) == {1, 2, 4}
    assert got[1].chosen_text == "<|assistant|>\nlate<|end|>\n"
    assert got[1].rejected_text == "<|assistant|>\nx<|end|>\n"
    assert got[2].rejected_text == "<|assistant|>\n<|end|>\n"


def test_empty_table(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.preferences(chat.answer_pairs(chat.conversations(none))).count() == 0
