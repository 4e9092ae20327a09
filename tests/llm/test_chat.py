from collections import defaultdict

import pytest

from seqlab.llm import chat

ROWS = [
    (1, 0, "system", "rules"), (1, 1, "ann", "hi <|im_end|> there"), (1, 2, "bob", None), (1, 2, "ann", ""), (1, 3, None, "who"),
    (1, None, "bob", "late"), (1, 3, None, "who"), (2, 0, "system", "only rules"), (None, 0, "ann", "lost"), (3, 70, "ann", "x" * 100_000),
    (3, 1, "b<|b", "two"), (3, 1, "ann", "same"), (3, 1, "ann", "same"),
]


def brute(rows, size):
    out = {}
    talks = defaultdict(set)
    for c, t, s, x in rows:
        if c is not None:
            talks[c].add((t, s, x or ""))
    for c, turns in talks.items():
        for p in {s for _, s, _ in turns if s not in (None, "system")}:
            parts = defaultdict(list)
            for t, s, x in turns:
                parts[None if t is None else t // size].append((t is None, t or 0, s is not None, s or "", x))
            for k, part in parts.items():
                text, mask = "", []
                for _, _, named, s, x in sorted(part):
                    name = "assistant" if named and s == p else "system" if s == "system" else "user name=" + (s if named else "unknown").replace("<|", "< |")
                    text += f"<|im_start|>{name}\n"
                    start = len(text)
                    text += x.replace("<|", "< |") + "<|im_end|>"
                    if name == "assistant":
                        mask.append((start, len(text)))
                    text += "\n"
                out[c, p, k] = (len(part), text, mask)
    return out


def table(spark, rows=ROWS):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    from pyspark.sql import functions as F
    return df.select("*", F.lit("clash").alias("perspective"), F.lit(1).alias("chunk"), F.lit(2).alias("n"), F.lit("t").alias("ts"))


def test_every_perspective(spark):
    got = {(r.conv_id, r.perspective, r.chunk): (r.n_turns, r.rendered, [tuple(m) for m in r["mask"]]) for r in chat.perspectives(table(spark)).collect()}
    assert got == brute(ROWS, 64)


def test_crowded_ranges_are_cut(spark, monkeypatch):
    monkeypatch.setattr(chat, "SLICE", 8)
    rows = [(1, i % 3, f"p{i % 2}", f"words {i}") for i in range(200)]
    got = chat.perspectives(table(spark, rows)).collect()
    assert sum(r.n_turns for r in got if r.perspective == "p0") == 200
    assert max(r.n_turns for r in got) <= 24 and all(r.rendered.count("<|im_start|>") == r.n_turns for r in got)
    said = [r.rendered[m.start:m.end] for r in got if r.perspective == "p0" for m in r["mask"]]
    assert sorted(said) == sorted(f"words {i}<|im_end|>" for i in range(0, 200, 2))


def test_empty_table(spark):
    assert chat.perspectives(table(spark).limit(0)).count() == 0


def test_no_python_on_executors(spark):
    plan = chat.perspectives(table(spark))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
