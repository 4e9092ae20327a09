from collections import Counter

import pytest
from edge import edge_documents, edge_texts, no_documents

from seqlab.llm import sharding


def by_turns(shards, size):
    """The same table from whole permutations, claimed turn by turn."""
    orders = []
    for s in shards:
        offset, skip = sharding._number(s, "offset") % size, sharding._number(s, "skip") % (size - 1) + 1
        orders.append(iter([(offset + j * skip) % size for j in range(size)]))
    taken, turn = {}, 0
    while len(taken) < size:
        for at in orders[turn % len(shards)]:
            if at not in taken:
                taken[at] = turn % len(shards)
                break
        turn += 1
    return [taken[i] for i in range(size)]


@pytest.mark.parametrize("shards,size", [(["a"], 7), (["a", "b", "c"], 101), ([f"s{i}" for i in range(30)], 1009)])
def test_table_is_claimed_in_turns(shards, size):
    table = sharding.fill_table(shards, size)
    assert table == by_turns(shards, size)
    counts = Counter(table).values()
    assert max(counts) - min(counts) <= 1


def test_few_slots_move_when_a_shard_goes():
    shards = [f"s{i}" for i in range(20)]
    before, after = sharding.fill_table(shards, 10007), sharding.fill_table(shards[:-1], 10007)
    moved = sum(a != b for a, b in zip(before, after, strict=True) if a != 19)
    assert moved < 0.15 * 10007


def test_refuses_bad_tables():
    for shards, size in ((["a", "a"], 7), ([], 7), (["a"], 8), ([str(i) for i in range(8)], 7)):
        with pytest.raises(ValueError):
            sharding.fill_table(shards, size)


def test_placement_matches_table(spark, tmp_path):
    from pyspark.sql import functions as F
    docs = edge_documents(spark).withColumn("slot", F.lit("clash")).withColumn("shard", F.lit("clash"))
    shards = ["x", "y", "z"]
    rows = sharding.place(docs, "doc_id", shards, keep=["doc_id", "shard", "key"], size=101).collect()
    assert len(rows) == len(edge_texts())
    table = sharding.fill_table(shards, 101)
    assert all(r.shard == shards[table[r.slot]] for r in rows)
    assert len({(r.doc_id, r.shard) for r in rows}) == len({r.doc_id for r in rows})
    assert sharding.place(no_documents(spark), "doc_id", shards, keep=["doc_id"]).count() == 0
    out = str(tmp_path / "out")
    sharding.write_shards(sharding.place(docs, "doc_id", shards, keep=["doc_id"], size=101), out, 3, 4)
    back = spark.read.parquet(out)
    assert sorted((str(r.doc_id), r.shard) for r in back.collect()) == sorted((str(r.doc_id), r.shard) for r in rows)


def test_query_places_every_document_evenly(spark):
    from seqlab.llm.queries import SHARDS, op2_sharding
    rows = op2_sharding(spark, "/root/testdata/sf0.01").collect()
    table = sharding.fill_table(SHARDS)
    assert len(rows) == 1000 and all(r.shard == SHARDS[table[r.slot]] for r in rows)
