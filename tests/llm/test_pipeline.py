"""The pipeline against a plain version of it on a small folder of documents."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

WORDS = "the of and to in is that it for was on are as with be at by this from have".split()


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(WORDS[i] + "er" * (j % 4) for i, j in zip(rng.integers(0, 20, n), rng.integers(0, 4, n)))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows = []
    for i in range(60):
        text = prose(i // 2 if i < 20 else i, 150)  # pairs of copies among the first 20
        if i % 7 == 0:
            text += f" token = {hashlib.md5(str(i).encode()).hexdigest()} end"
        if i % 5 == 0:
            text += " password=examplesecret1234567 end"
        rows.append((i, text, "en", f"s{i % 4 if i % 3 else 0}", len(text)))
    rows += [(100, "too short", "en", "s1", 9), (101, None, "en", "s1", 0), (102, "x ### " * 200, "en", None, 1200), (103, "", None, "s2", 0)]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    return str(path), rows


def similar(a, b):
    """Jaccard similarity of five-word shingles of 0.8 or more: the rule of near-duplicate stages."""
    x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a.lower().split(), b.lower().split()))
    return 5 * len(x & y) >= 4 * len(x | y)


def plain(rows):
    kept = {i: (t, s) for i, t, _, s, _ in rows if t and len(t.split()) >= 50 and "###" not in t}
    best, ids = {}, sorted(kept)
    near = [(a, b) for a in ids for b in ids if a < b and similar(kept[a][0], kept[b][0])]
    group = {i: i for i in ids}
    for _ in ids:
        for a, b in near:
            group[a] = group[b] = min(group[a], group[b])
        if group == best:
            break
        best = dict(group)
    kept = {i: kept[i] for i in set(group.values())}
    owners = defaultdict(set)
    found = {}
    for i, (t, s) in kept.items():
        f = [(m.start(), m.end(), m[2]) for m in re.finditer(r"(token|password)\x20*=\x20*([A-Za-z0-9]{12,})", t)]
        f += [(m.start(), m.end(), m[0]) for m in re.finditer("[0-9a-f]{16,}", t)]
        found[i] = sorted(f)
        for _, _, v in f:
            owners[v].add(s)
    texts = {}
    for i, (t, _) in kept.items():
        out, at = "", 0
        for a, b, v in found[i]:
            if len(owners[v]) < 3 and a >= at:
                out += t[at:a] + "[SECRET]"
                at = b
        texts[i] = out + t[at:]
    return texts, {i: s for i, (_, s) in kept.items()}


def test_pipeline_against_the_plain_version(spark, folder):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    import corpus_pipeline
    from terrafold.llm import mixing

    path, rows = folder
    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    texts, source = plain(rows)
    want = {}
    for i, t in texts.items():
        ids = lib.encode(t, add_special_tokens=False).ids
        want[i] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    got = corpus_pipeline.run(spark, path).collect()
    assert {r["doc_id"] for r in got} == set(want)
    assert all((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == want[r["doc_id"]] for r in got)
    count = Counter(source[r["doc_id"]] for r in got)
    sizes = Counter(source.values())
    slots = mixing.shares(mixing.tempered(sizes))
    total = sum(count.values())
    assert all(abs(count[s] - slots[s] / sum(slots.values()) * total) <= 2 * mixing.BLOCK for s in sizes)
    assert all(count[s] >= sizes[s] for s in sizes)


def test_stages_return_the_documents_columns(spark, folder):
    import corpus_pipeline

    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder[0]).columns == docs.columns


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
