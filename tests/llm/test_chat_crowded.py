"""Crowded ranges: the registered query's rows are whole, in dialogue order, and those of its SQL."""
import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
from test_chat import brute, table

from seqlab.llm import chat
from seqlab.llm.queries import ORACLE, op3_chat_perspectives

ROWS = [(1, i % 3 if i % 5 else None, f"p{i % 2}", f"words {i * 7919 % 200}") for i in range(200)] + \
    [(2, 1, "ann", "hi"), (2, 70, "bob", "later"), (2, 0, "system", "rules")] + [(3, 9, "ann", f"x{i}") for i in range(9)]
random.Random(2).shuffle(ROWS)


def test_crowded_ranges_are_whole_in_dialogue_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(chat, "SLICE", 8)
    df = table(spark, ROWS)
    df.select("conv_id", "turn", "role", "text").write.parquet(f"{tmp_path}/conversations.parquet")
    rows = op3_chat_perspectives(spark, str(tmp_path)).collect()
    want = brute(ROWS, 64)
    assert len(rows) == len(want)
    for r in rows:
        n, text, mask = want[r.conv_id, r.perspective, r.chunk]
        assert (r.n_turns, r.rendered, r["mask"]) == (n, text, ",".join(f"{a}:{b}" for a, b in mask))


def test_parts_follow_the_dialogue(spark, monkeypatch):
    monkeypatch.setattr(chat, "SLICE", 8)
    got = sorted((r.part, r.n_turns, r.rendered) for r in chat.perspectives(table(spark, ROWS)).collect()
                 if (r.conv_id, r.perspective, r.chunk) == (1, "p0", 0))
    assert len(got) > 1 and max(n for _, n, _ in got) <= 8
    assert "".join(text for _, _, text in got) == brute(ROWS, 64)[1, "p0", 0][1]


def test_crowded_ranges_match_the_sql(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(chat, "SLICE", 8)
    columns = dict(zip(("conv_id", "turn", "role", "text"), map(list, zip(*ROWS, strict=True)), strict=True))
    pq.write_table(pa.table(columns), f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from read_parquet('{tmp_path}/conversations.parquet')")
    want = con.execute(ORACLE["op3_chat_perspectives"]).fetchall()
    got = [tuple(r) for r in op3_chat_perspectives(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
