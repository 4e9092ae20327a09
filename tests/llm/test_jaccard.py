import random
import re

import numpy as np
import pytest
from edge import edge_documents, edge_texts, no_documents, words

from seqlab.llm import jaccard, queries

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    return frozenset(tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute(rows, k, percent):
    """Component of every row with an id, by comparing all pairs of rows."""
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            both = len(x & y)
            if x and y and rows[a][0] is not None and rows[b][0] is not None and 100 * both >= percent * (len(x) + len(y) - both):
                root[find(a)] = find(b)
    low = {}
    for a, (i, _) in enumerate(rows):
        if i is not None:
            low[find(a)] = min(i, low.get(find(a), i))
    return sorted((((i if i is not None else -1), len(s), low.get(find(a), -1) if i is not None else -1)
                   for a, ((i, _), s) in enumerate(zip(rows, sets, strict=True))))


def got(df):
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.select("doc_id", "n_shingles", "component_id").collect())


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80)])
def test_edges_match_brute_force(spark, k, percent):
    rows = edge_texts()
    assert got(jaccard.jaccard_components(edge_documents(spark, rows), k, percent)) == brute(rows, k, percent)


def test_empty_table(spark):
    assert jaccard.jaccard_components(no_documents(spark)).count() == 0
    assert jaccard.one_of_each_group(no_documents(spark)).count() == 0


def chains(seed=1):
    """Groups whose members drift by a few words, with many members, beside unrelated texts and shared passages."""
    rnd = random.Random(seed)
    rows, passage = [], words(rnd, 25)
    for g in range(6):
        text = words(rnd, rnd.choice([4, 12, 60, 90])).split(" ")
        for _ in range(rnd.choice([2, 8, 30])):
            for _ in range(rnd.randint(0, 3)):
                text[rnd.randrange(len(text))] = words(rnd, 1)
            rows.append((len(rows), " ".join(text)))
    for _ in range(30):
        rows.append((len(rows), words(rnd, 20) + " " + passage + " " + words(rnd, rnd.randint(0, 20))))
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("bucket,block", [(64, 512), (1, 3)])
def test_drifting_groups_in_pairs_and_in_blocks(spark, monkeypatch, bucket, block):
    monkeypatch.setattr(jaccard, "BUCKET", bucket)
    monkeypatch.setattr(jaccard, "BLOCK_SETS", block)
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 0 if bucket == 1 else 1000)
    rows = chains()
    for k, percent in ((3, 90), (5, 80)):
        assert got(jaccard.jaccard_components(edge_documents(spark, rows), k, percent)) == brute(rows, k, percent)


def test_forest_spans_the_links():
    rnd = np.random.default_rng(3)
    sets = [np.unique(rnd.integers(0, 40, 30).astype(np.uint64)) for _ in range(40)]
    for sides in (np.zeros(40, int), (np.arange(40) % 2)):
        edges = list(jaccard.verified_forest([], sets, sides, 60))
        root = list(range(40))

        def find(root, x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in edges:
            assert find(root, a) != find(root, b)  # a forest
            root[find(root, a)] = find(root, b)
        want = list(range(40))
        for a in range(40):
            for b in range(a):
                both = len(np.intersect1d(sets[a], sets[b]))
                if (sides[a] != sides[b] or not sides.any()) and 100 * both >= 60 * (len(sets[a]) + len(sets[b]) - both):
                    want[find(want, a)] = find(want, b)
        assert len({find(root, x) for x in range(40)}) == len({find(want, x) for x in range(40)})
        assert all((find(root, a) == find(root, b)) == (find(want, a) == find(want, b)) for a in range(40) for b in range(a))


def test_one_of_each_group(spark):
    rows = edge_texts()
    left = jaccard.one_of_each_group(edge_documents(spark, rows), 5, 80)
    assert left.columns == edge_documents(spark, rows).columns
    kept = sorted((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in left.collect())
    want = {}
    sets = [shingles(t, 5) for _, t in rows]
    out = []
    for (i, t), s in zip(rows, sets, strict=True):
        if i is None or not s:
            out.append((-1 if i is None else i, t or ""))
            continue
        for other in want:
            both = len(s & other)
            if 100 * both >= 80 * (len(s) + len(other) - both):
                break
        else:
            want[s] = (i, t)
            out.append((i, t))
    assert kept == sorted(out)


def passages(seed=5):
    """Unrelated documents of much the same size around one passage, and two pairs of near copies."""
    rnd = random.Random(seed)
    passage = words(rnd, 25)
    rows = [(i, words(rnd, 20) + " " + passage + " " + words(rnd, rnd.randint(0, 20))) for i in range(40)]
    for _ in range(2):
        text = words(rnd, 90)
        rows += [(len(rows), text + " one"), (len(rows) + 1, text + " two")]
    return rows


def recorded(monkeypatch):
    """The tables that the operator writes, by label."""
    tables, write = {}, jaccard.written

    def written(df, label):
        tables[label] = write(df, label)
        return tables[label]

    monkeypatch.setattr(jaccard, "written", written)
    return tables


def test_pipeline_stage_copies_no_document_that_is_only_chained(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BUCKET", 1)
    monkeypatch.setattr(jaccard, "WEIGHT_BITS", 1)  # as crowded as with a very large table of documents
    tables, rows = recorded(monkeypatch), passages()
    kept = jaccard.one_of_each_group(edge_documents(spark, rows), 5, 80)
    assert sorted(r.doc_id for r in kept.collect()) == [*range(40), 40, 42]
    assert sorted(r.doc_id for r in tables["chosen"].collect()) == [40, 41, 42, 43]
    members = tables["members"]
    assert members.groupBy("cluster").count().agg({"count": "max"}).first()[0] >= 20  # they were chained


def test_operator_copies_no_document_that_is_only_chained(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(jaccard, "BUCKET", 1)
    monkeypatch.setattr(jaccard, "WEIGHT_BITS", 1)
    tables, rows = recorded(monkeypatch), passages()
    edge_documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    assert got(queries.op1_ngram_jaccard_join(spark, str(tmp_path))) == brute(rows, 3, 90)
    assert sorted(r.doc_id for r in tables["chosen"].collect()) == [40, 41, 42, 43]


@pytest.mark.parametrize("sketches", [1, 3, 4096])
def test_sketches_in_bands_and_blocks(spark, monkeypatch, sketches):
    monkeypatch.setattr(jaccard, "BUCKET", 1)
    monkeypatch.setattr(jaccard, "WEIGHT_BITS", 1)
    monkeypatch.setattr(jaccard, "BLOCK_SKETCHES", sketches)
    rows = chains(2)
    assert got(jaccard.jaccard_components(edge_documents(spark, rows), 5, 80)) == brute(rows, 5, 80)


def test_sketches_part_no_link():
    rnd = np.random.default_rng(4)
    base = [np.unique(rnd.integers(0, 1 << 63, n).astype(np.uint64)) for n in (3, 40, 60, 120, 130, 500, 1000)]
    sets = [np.sort(rnd.choice(b, int(np.ceil(len(b) * share)), replace=False)) for b in base for share in (1, 0.97, 0.93, 0.85, 0.6)]
    first = np.r_[0, np.cumsum([len(s) for s in sets])]
    sketches = [np.frombuffer(s, np.uint64) for s in jaccard.parity_sketches(np.concatenate(sets), first).to_pylist()]
    assert [64 * len(s) for s in sketches] == [max(64, 1 << (len(s) - 1).bit_length()) for s in sets]
    for percent in (50, 80, 90, 100):
        for side in (np.zeros(len(sets), int), np.arange(len(sets)) % 2):
            root = list(range(len(sets)))

            def find(x, root=root):
                while root[x] != x:
                    x = root[x]
                return x

            for a, b in jaccard.near_forest(np.diff(first), sketches, side, percent):
                assert find(a) != find(b)  # a forest
                assert side[a] != side[b] or not side.any()
                root[find(a)] = find(b)
            for a in range(len(sets)):
                for b in range(a):
                    both = len(np.intersect1d(sets[a], sets[b]))
                    if (side[a] != side[b] or not side.any()) and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                        assert find(a) == find(b)
            assert percent < 80 or len({find(x) for x in range(len(sets))}) >= len(base)


def test_weights_of_shingles(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "WEIGHT_BITS", 10)
    monkeypatch.setattr(jaccard, "WEIGHT_ROW", 64)
    rows = passages()
    counts = np.zeros(1 << 10, int)
    for _, text in rows:
        raw = np.frombuffer(text.encode(), np.uint8)
        value, _, _ = jaccard.shingle_sets(raw, np.array([0, len(raw)]), 3)
        np.add.at(counts, (value >> np.uint64(54)).astype(int), 1)
    found = jaccard.shingle_weights(edge_documents(spark, rows), 3)
    assert found.tolist() == np.minimum(255, 12 * np.log2(np.maximum(counts, 1))).astype(np.uint8).tolist()
