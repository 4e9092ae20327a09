import random

from edge import edge_documents, edge_texts, no_documents, words

from seqlab.llm import licenses


def shares(text):
    """Best share of each license over all windows of the plan, by comparing every window with every notice."""
    import regex
    w = regex.findall(licenses.WORD, (text or "").lower())
    found = set()
    for name, notice in licenses.NOTICES:
        t = licenses._shingles(licenses._words(notice))
        size, step = licenses.window_plan(notice)
        for q in range(0, max(len(w) - licenses.SHINGLE + 1, 0), step):
            if len(t & licenses._shingles(w[q:q + size])) >= 0.8 * len(t):
                found.add((q, name))
    return sorted(found)


def test_matches_all_windows(spark):
    rnd = random.Random(9)
    texts = []
    for _, notice in licenses.NOTICES:
        w = notice.split(" ")
        for drop in (0, 1, 3):
            v = list(w)
            for _ in range(min(drop, len(v) - 1)):
                v[rnd.randrange(len(v))] = "changed"
            texts.append(words(rnd, rnd.randint(0, 60)) + " " + " ".join(v).upper() + "\n" + words(rnd, rnd.randint(0, 60)))
    rows = edge_texts() + [(200 + i, t) for i, t in enumerate(texts)] + [(500, "license " * 300), (501, texts[0]), (501, texts[0])]
    got = licenses.find_licenses(edge_documents(spark, rows), keep=["doc_id", "text", "key"]).collect()
    assert len(got) == len(rows)
    for r in got:
        assert sorted({(m.word, m.license) for m in r.matches}) == shares(r.text), r.text


def test_markers_leave_no_notice_unmarked():
    marks = licenses.markers(licenses.NOTICES, 0.8)
    for _, notice in licenses.NOTICES:
        s = licenses._shingles(licenses._words(notice))
        assert sum(not set(marks) & set(x) for x in s) < 0.8 * len(s)


def test_empty_table_and_native_plan(spark):
    df = licenses.find_licenses(no_documents(spark), keep=["doc_id"])
    assert df.count() == 0
    plan = licenses.find_licenses(edge_documents(spark), keep=["doc_id"])._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
