"""The pipeline's near-dedup stage against brute-force Jaccard similarity of five-word shingles."""

import numpy as np

from terrafold.llm import jaccard, simhash


def shingles(t):
    w = (t or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else ({tuple(w)} if w else set())


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    group = {i: i for i in sets}
    for a in sets:
        for b in sets:
            union = len(sets[a] | sets[b])
            if a < b and (5 * len(sets[a] & sets[b]) >= 4 * union):
                x, y = sorted((group[a], group[b]))
                group = {i: x if g == y else g for i, g in group.items()}
    return set(group.values())


def corpus():
    rng = np.random.default_rng(1)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 400, n)]
    passage, texts = word(60), []
    for i in range(40):
        base = word(80 + 5 * i)
        texts.append(base)
        for edits in range(1, 8):  # similarity from over 0.9 to under 0.6
            near = list(base)
            for at in rng.integers(0, len(base), edits):
                near[at] = "changed"
            texts.append(near)
    chain = word(200)  # each near the next, the ends far apart
    for i in range(10):
        texts.append(chain[6 * i :] + word(6 * i))
    big = word(150)  # a large group of near copies, and texts that are mostly one passage
    texts += [big[:j] + ["other"] + big[j + 1 :] for j in range(0, 150, 2)] + [passage + word(int(n)) for n in rng.integers(1, 40, 60)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    n = len(rows)
    return rows + [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "one two"), (n + 4, "One  Two"), (n + 5, "one"), (n + 6, rows[3][1]), (n + 7, rows[3][1].upper())]


def test_survivors_against_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute(rows)
    n = len(rows) - 8
    want -= {n + 1, n + 2}  # texts without words are equal
    assert {r["doc_id"] for r in simhash.survivors(docs).collect()} == want
    assert simhash.survivors(docs.filter("false")).count() == 0


def test_common_members_change_the_order_only(spark, monkeypatch):
    rows = corpus()[:200]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    for common in ([], [int(x) for t in rows[::3] for x in jaccard.Shingles()(t[1])]):
        monkeypatch.setattr(jaccard, "_common", lambda src, words, c=common: np.unique(np.array(c, np.uint64)))
        assert {r["doc_id"] for r in simhash.survivors(docs).collect()} == want


def family():
    """Near copies of one text, most of whose pairs are under the threshold, and texts that have little more than a passage in common."""
    rng = np.random.default_rng(2)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 4000, n)]
    base, passage, texts = word(150), word(12), []
    for i in range(360):
        near, edits = list(base), int(rng.integers(1, 9))
        for at in sorted(rng.integers(0, 150, edits), reverse=True):
            near[at : at + 1] = [] if rng.random() < 0.5 else [f"x{rng.integers(0, 40)}"]
        texts.append(near)
    texts += [texts[i][:-2] + ["end"] for i in range(0, 200, 5)]  # close to one copy, far from the rest
    texts += [passage + word(int(n)) for n in rng.integers(20, 60, 90)]
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


def test_a_large_family_is_not_paired(spark, monkeypatch):
    rows, listed = family(), []
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    across = jaccard.Join.across
    monkeypatch.setattr(jaccard.Join, "across", lambda *a: listed.append(across(*a)) or listed[-1])
    assert {r["doc_id"] for r in simhash.survivors(docs).collect()} == brute(rows)
    assert listed[0].count() < 5 * len(rows)


def test_differences_from_centers_against_brute_force(spark, monkeypatch):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute(rows) - {len(rows) - 7, len(rows) - 6}
    for crowd, drawn in ((1, 32), (3, 1)):
        monkeypatch.setattr(jaccard, "CROWD", crowd)
        monkeypatch.setattr(jaccard, "DRAWN", drawn)
        assert {r["doc_id"] for r in simhash.survivors(docs).collect()} == want
