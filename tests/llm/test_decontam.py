import random
import re

import pytest
from edge import edge_documents, edge_texts, no_documents, words

from seqlab.llm import decontam

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def cut(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))


def brute(text, items, window=10):
    w, hit, found = cut(text), set(), set()
    for item, passage in items:
        p = cut(passage)
        m = min(window, len(p))
        for i in range(len(p) - m + 1 if m else 0):
            for a in range(len(w) - m + 1):
                if w[a:a + m] == p[i:i + m]:
                    hit.update(range(a, a + m))
                    found |= {str(item)} if item is not None else set()
    return len(w), len(hit), sorted(found)


def planted(rnd):
    items = [(i, words(rnd, rnd.choice([1, 2, 5, 9, 10, 11, 30]))) for i in range(15)]
    items += [(3, items[3][1]), (40, items[6][1]), (None, items[7][1]), (41, None), (42, ""), (43, "?!"), (44, "Née à 日本 1 2")]
    texts = []
    for _ in range(60):
        body = words(rnd, rnd.choice([0, 3, 40, 200])).split(" ")
        for _ in range(rnd.randint(0, 3)):
            p = cut(items[rnd.randrange(15)][1])
            a = rnd.randrange(len(p))
            body[rnd.randrange(len(body)):0] = p[a:a + rnd.choice([3, 10, 12, 40])]
        texts.append(rnd.choice([" ", ", ", "\n"]).join(body))
    return items, texts + [items[0][1], items[4][1].upper(), "x née À 日本: 1-2 y"]


@pytest.mark.parametrize("block", [16_000_000, 200])
def test_matches_brute_force_in_one_block_and_in_many(spark, monkeypatch, block):
    monkeypatch.setattr(decontam, "BLOCK_CHARS", block)
    monkeypatch.setattr(decontam, "LANES", 7)
    items, texts = planted(random.Random(4))
    rows = edge_texts() + [(100 + i, t) for i, t in enumerate(texts)]
    docs = edge_documents(spark, rows)
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontam.contaminated_words(docs, bench, keep=["doc_id", "text", "n_words", "row"]).collect()
    assert len(found) == len(rows)
    for r in found:
        assert (r.n_words, r.n_hit, r["items"]) == brute(r.text, items), r.text


def test_empty_tables(spark):
    bench = spark.createDataFrame([(1, "some words of a test")], "item_id long, text string")
    assert decontam.contaminated_words(no_documents(spark), bench, keep=["doc_id"]).count() == 0
    none = decontam.contaminated_words(edge_documents(spark), bench.limit(0), keep=["doc_id"]).collect()
    assert len(none) == len(edge_texts()) and not any(r.n_hit for r in none)


def test_tables_of_a_full_block_stay_small_and_still_skip():
    """A tenth of a block: tables in proportion to the windows, and a shift table that is mostly unmarked."""
    import random

    import numpy as np

    from seqlab.llm import decontam
    rnd = random.Random(5)
    text = " ".join("".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(decontam.BLOCK_CHARS // 70))
    (size, phrases, ids), = decontam._pattern_block([(text, ["b", "a"]), (text[:700], ["c"])], 10)
    assert size == 10 and ids[-1] is ids[-2] and ids[0] == ("a", "b", "c")
    t = decontam.Windows(size, phrases)
    held = t.shift.nbytes + t.hashes.nbytes + t.order.nbytes + t.last.nbytes + sum(map(len, phrases)) + 40 * len(phrases)
    assert held < 50e6 and np.mean(t.shift) > 6
