"""The pipeline's stages on a small corpus, each against a plain version of itself."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.cases import WORD, sentence, vocabulary
from tests.llm.test_operators import plain_kept


@pytest.fixture(scope="module")
def folder(tmp_path_factory, spark):
    """A corpus with exact and near copies, toxic documents, empty and null texts."""
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(700):
        bad = i % 5 == 0
        words = sentence(rng, rng.randint(30, 120)).split()
        if bad:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["vermin", "swine", "filth."]))
        rows.append((i, " ".join(words), "en", rng.choice(["a", "b", "c"]), 0))
        labels.append((i, 1, int(bad)))
    rows += [(800 + i, rows[i * 7 + 1][1], "en", "a", 0) for i in range(30)]
    rows += [(900 + i, rows[3][1], "en", "b", 0) for i in range(40)]
    long = sentence(rng, 3000)
    rows += [(1000, long, "de", "c", 0), (1001, long + " end", "de", "c", 0), (1002, "", "en", None, 0), (1003, None, None, None, 0), (1004, None, None, "a", 0)]
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        before = docs.toPandas()
        docs = corpus_pipeline.materialize(stage(spark, docs, folder), name)
        after = docs.toPandas()
        kept.append((name, before, after))
        assert name == "packing" or docs.columns == columns
    by = {n: (b, a) for n, b, a in kept}
    assert [n for n, _, _ in kept] == ["toxicity", "exact_dedup", "simhash", "mixing", "packing"]

    before, after = by["toxicity"]
    toxic = {i for i, t in zip(before.doc_id, before.text) if t and any(w in t for w in ("vermin", "swine", "filth"))}
    clean = set(before.doc_id) - toxic
    left = set(after.doc_id)
    assert len(left & toxic) <= 0.03 * len(toxic) and len(clean - left) <= 0.01 * len(clean)

    before, after = by["exact_dedup"]
    best = before.assign(text=before.text.fillna("")).groupby("text").doc_id.max()
    assert sorted(after.doc_id) == sorted(best)

    before, after = by["simhash"]
    kept_rows = plain_kept(list(zip(before.doc_id, before.text)), 2, 2, 4)
    assert sorted(after.doc_id) == sorted(d for d, _ in kept_rows)

    before, after = by["mixing"]
    copies = Counter(after.doc_id)
    assert set(copies) <= set(before.doc_id) and max(copies.values()) <= 3

    before, after = by["packing"]
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    texts = dict(zip(before.doc_id, before.text))
    pieces = defaultdict(list)
    for r in after.itertuples():
        pieces[r.doc_id, r.start].append(np.frombuffer(r.ids, "<u4").tolist())
    for i, n in copies.items():
        ids = [*library.encode(texts[i] or "", add_special_tokens=False).ids, corpus_pipeline.END_ID]
        mine = {s: p for (d, s), p in pieces.items() if d == i}
        assert all(len(p) == n and all(x == p[0] for x in p) for p in mine.values())
        assert [t for s in sorted(mine) for t in mine[s][0]] == ids


def test_run_is_all_stages(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "start", "length", "doc_tokens", "bucket", "sequence_id", "offset", "ids"] and out.count() > 0
    assert corpus_pipeline.run(spark, folder).count() == out.count()


def test_empty_corpus(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.count() == 0
