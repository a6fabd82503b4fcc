"""Each training-data operator against a plain version, on awkward rows, repeated rows and no rows."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docvigil.llm import common
from docvigil.llm.components import connected_components
from docvigil.llm.exact_dedup import drop_copies, exact_groups
from docvigil.llm.importance import importance_sample
from docvigil.llm.language_id import fit_language, language_sample, predict_language
from docvigil.llm.mixing import mix_sources, mixed
from docvigil.llm.packing import pack, pieces
from docvigil.llm.simhash import BUCKET, fingerprints, keep_one, near_duplicates, near_pairs
from docvigil.llm.substring_dedup import cut_text, substring_dedup
from docvigil.llm.tiff_media import decode_pages, encode_page, file_pages, lzw_decode, lzw_encode, packbits_decode, packbits_encode, payload_of, texts_as_files, with_features
from docvigil.llm.token_files import read_token_files, write_token_files
from docvigil.llm.toxicity import drop_toxic, fit_toxicity, labelled_sample, score_toxicity
from tests.llm.cases import LOWER, WORD, awkward, frame, sentence, vocabulary


def by_id(rows: list[tuple]) -> list[tuple]:
    return [r for r in rows if r[0] is not None]


# ---------------------------------------------------------------- 1 and 8


def library_ids(name: str, text: str | None, end: int) -> list[int]:
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(vocabulary(name)).encode(text or "", add_special_tokens=False).ids, end]


def test_token_files(spark):
    rows = awkward()
    manifest = write_token_files(frame(spark, rows), vocabulary("word_bpe_49k.json"), 1, shards=3)
    found = read_token_files(manifest).toPandas().sort_values("start")
    wanted = sorted(((r[0], library_ids("word_bpe_49k.json", r[1], 1)) for r in rows), key=lambda x: -1 if x[0] is None else x[0])
    start = 0
    named = {}
    for r in found.itertuples():
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert r.start == start and r.n_tokens == len(ids)
        start += len(ids)
        named.setdefault(None if math.isnan(r.doc_id) else int(r.doc_id), []).append(ids)
    for k, g in itertools.groupby(wanted, key=lambda x: x[0]):
        assert sorted(named[k]) == sorted(x[1] for x in g)
    assert found.doc_id.dropna().is_monotonic_increasing


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@pytest.mark.parametrize("bound", [40_000_000, 20_000])
def test_chunks_have_the_ids_of_the_library(name, bound, monkeypatch):
    """Random texts of characters that normalizers and patterns treat in their own ways."""
    from tokenizers import Tokenizer

    from docvigil.llm import tokenizing

    monkeypatch.setattr(tokenizing, "CACHE_BYTES", bound)
    rng = random.Random(1)
    signs = [" ", "  ", "\n", "\r\n", ".", ",", "a", "B", "İ", "é", "É", "ß", "×", "÷", "1", "'s", "'", "\t", "ǆ", "-", "Σ", "\u0301", "\u0323", "x", "<", "|", "\xa0", "\u2009", "日", "\x1c", "LL", "n't", "²"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 12))) for _ in range(6000)] + ["İ. x", "İ,", "K, Kelvin", "z" * 9000, "<|endoftext|>"]
    encoder, library = tokenizing.Encoder(vocabulary(name)), Tokenizer.from_file(vocabulary(name))
    found = []
    for _, _, data, offsets in common.text_slices(pa.array(texts), 3000):
        ids, first = encoder.encode(data, offsets)
        found += [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:])]
    assert found == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]


def test_token_files_of_nothing_and_of_repeated_rows(spark):
    none = frame(spark, awkward()).limit(0)
    assert read_token_files(write_token_files(none, vocabulary("word_bpe_49k.json"), 1)).count() == 0
    twice = frame(spark, [(1, "a b", None, None), (1, "a b", None, None), (1, None, None, None)])
    assert sorted(r.n_tokens for r in read_token_files(write_token_files(twice, vocabulary("word_bpe_49k.json"), 1)).collect()) == [1, 3, 3]
    hot = spark.range(4000).selectExpr("7L AS doc_id", "concat('lot ', id % 50) AS text").repartition(4)
    manifest = write_token_files(hot, vocabulary("word_bpe_49k.json"), 1, shards=8)
    assert manifest.count() > 4 and manifest.agg(F.max("n_docs"), F.sum("n_docs")).first()[1] == 4000


def test_packing(spark):
    rows = awkward()
    found = pack(frame(spark, rows), vocabulary("byte_bpe_50k.json"), 1).toPandas()
    assert found.sequence_id.is_unique and (found.offset == 0).all()
    assert all(n & (n - 1) == 0 and n <= 2048 for n in found.length)
    for i, g in found.dropna(subset="doc_id").groupby("doc_id"):
        g = g.sort_values("start")
        ids = np.concatenate([np.frombuffer(b, "<u4") for b in g.ids]).tolist()
        assert ids == library_ids("byte_bpe_50k.json", rows[int(i)][1], 1)
        assert g.start.tolist() == [0, *np.cumsum(g.length)[:-1].tolist()] and set(g.doc_tokens) == {len(ids)}
    owner, at = pieces(np.array([2048 * 2 + 5, 1, 4]), 2048)
    assert owner.tolist() == [0, 0, 0, 0, 1, 2] and at.tolist() == [0, 2048, 4096, 4100, 0, 0]
    assert pack(frame(spark, rows).limit(0), vocabulary("byte_bpe_50k.json"), 1).count() == 0
    with pytest.raises(ValueError):
        pack(frame(spark, rows), vocabulary("byte_bpe_50k.json"), 1, context=1000)


# ---------------------------------------------------------------- 2


def language_rows(n: int = 240) -> list[tuple]:
    rng = random.Random(5)
    parts = {"aa": ["ba", "lu", "ti"], "bb": ["schr", "eng", "ö"], "cc": ["qué", "ción", "llo"]}
    return [(i, " ".join("".join(rng.choice(parts[k]) for _ in range(3)) for _ in range(30)), k, None) for i, k in enumerate(itertools.islice(itertools.cycle(parts), n))]


def test_language(spark):
    train = common.crc_mod(F.col("doc_id"), 3) != 1
    docs = frame(spark, language_rows())
    model = fit_language(language_sample(docs, train, 40), landmarks=30)
    found = predict_language(docs, model).toPandas().set_index("doc_id")
    held = [r for r in language_rows() if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert sum(found.lang_pred[r[0]] == r[2] for r in held) >= 0.95 * len(held)
    assert found.score.between(0, 1).all()
    odd = predict_language(frame(spark, [(1, None, None, None), (2, "123 !", None, None), (3, "", None, None), (4, "é", None, None)]), model).toPandas().set_index("doc_id")
    assert odd.lang_pred[[1, 2, 3]].tolist() == ["und"] * 3 and odd.lang_pred[4] != "und" and (odd.score[[1, 2, 3]] == 0).all()
    assert predict_language(docs.limit(0), model).count() == 0


def plain_grams(text: str, n: int, buckets: int) -> set[int]:
    """The hashed n-grams of a text, by loops over its bytes."""
    data, out, bits = text.translate(LOWER).encode(), set(), buckets.bit_length() - 1
    for k in range(1, n + 1):
        for i in range(len(data) - k + 1):
            code = data[i]
            for c in data[i + 1 : i + k]:
                code = (code * 257 + c) & 0xFFFFFFFF
            out.add(((code + k * 0x9E3779) * 2654435761 & 0xFFFFFFFF) >> (32 - bits))
    return out


def test_language_equals_a_dense_kernel_and_ridge(spark, monkeypatch):
    from docvigil.llm import language_id

    monkeypatch.setattr(language_id, "SLICE_BYTES", 100)  # texts are read in several blocks
    rows = language_rows(60)
    sample = language_sample(frame(spark, rows), F.lit(True), 15)
    model = fit_language(sample, n=3, buckets=1 << 12, landmarks=9, ridge=0.05)
    train = sorted(((r["lang"], r["doc_id"], r["text"]) for r in sample.to_pylist()))
    names = sorted({t[0] for t in train})
    assert len(train) == 45
    grams = [plain_grams(t[2], 3, 1 << 12) for t in train]
    marks = [g for x in names for g in [g for t, g in zip(train, grams) if t[0] == x][:3]]
    kernel = lambda a, b: len(a & b) / math.sqrt(len(a) * len(b))
    km = np.array([[kernel(a, b) for b in marks] for a in marks])
    value, vector = np.linalg.eigh(km)
    vector, value = vector[:, value > 1e-6 * value.max()], value[value > 1e-6 * value.max()]  # texts with the same n-grams
    phi = np.array([[kernel(g, m) for m in marks] for g in grams]) @ vector / np.sqrt(value)
    w = np.diag([1 / sum(t[0] == u[0] for u in train) for t in train])
    solution = {}
    for x in names:  # one ridge regression for each language against the rest
        y = np.array([1.0 if t[0] == x else -1.0 for t in train])
        solution[x] = np.linalg.solve(phi.T @ w @ phi + 0.05 * len(names) / 100 * np.eye(phi.shape[1]), phi.T @ w @ y)
    found = {r.doc_id: r for r in predict_language(frame(spark, rows), model).collect()}
    for i, text, _, _ in rows:
        f = np.array([kernel(plain_grams(text, 3, 1 << 12), m) for m in marks]) @ vector / np.sqrt(value)
        scores = {x: float(f @ solution[x]) for x in names}
        best = max(names, key=lambda x: scores[x])
        assert found[i].lang_pred == best and math.isclose(found[i].score, min(1, max(0, (scores[best] + 1) / 2)), abs_tol=1e-4)


def test_samples_are_bounded_however_often_an_id_repeats(spark):
    rows = [(7, sentence(random.Random(i % 90), 20), "en", None) for i in range(400)] + [(i, "kurz " * 20_000, "de", None) for i in range(5)] + [(100 + i, "wort", "de", None) for i in range(3)]
    docs = frame(spark, rows)
    sample = language_sample(docs, F.lit(True), 30).to_pylist()
    assert Counter(r["lang"] for r in sample) == {"en": 30, "de": 3} and len({r["text"] for r in sample if r["lang"] == "en"}) == 30
    with pytest.raises(ValueError):
        language_sample(docs, F.lit(True), 30, rows=1)
    assert Counter(r["lang"] for r in language_sample(docs, F.lit(True), 30, rows=4).to_pylist()) == {"en": 2, "de": 2}
    labels = spark.createDataFrame([(7, 1, 1), *[(i, 1, 0) for i in (*range(5), 100, 101)]], "doc_id long, quality int, toxic int")
    assert Counter(r["toxic"] for r in labelled_sample(docs, labels, F.lit(True), 20, 10).to_pylist()) == {1: 20, 0: 2}


def test_language_without_training_rows(spark):
    docs = frame(spark, [(1, "abc", None, None)])
    model = fit_language(language_sample(docs, F.lit(True), 10))
    assert predict_language(docs, model).first()[1:] == ("und", 0.0)


# ---------------------------------------------------------------- 3


def fingerprint(text: str | None) -> int:
    import xxhash

    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), seed=42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(nodes: dict, radius: int = 2) -> dict:
    parent = {k: k for k in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(nodes), 2):
        if (nodes[a] ^ nodes[b]).bit_count() <= radius:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {k: find(k) for k in nodes}


def test_simhash(spark):
    rows = [r for r in awkward() if r[1] is None or len(r[1]) < 20_000]
    found = {r.doc_id: r for r in near_duplicates(frame(spark, rows)).collect()}
    prints = {r[0]: fingerprint(r[1]) for r in by_id(rows)}
    wanted = classes(prints)
    for k, v in prints.items():
        assert (found[k].fingerprint, found[k].component_id) == (f"{v:016x}", wanted[k])
    assert None in found
    kept = keep_one(frame(spark, rows))
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(set(wanted.values()))
    assert near_duplicates(frame(spark, rows).limit(0)).count() == 0


def test_keep_one_loses_no_text_of_a_repeated_id(spark):
    rng = random.Random(4)
    a, b, c, d = (sentence(rng, 60) for _ in range(4))
    rows = [(3, a, None, None), (5, a, None, None), (5, b, None, None), (5, d, None, None), (9, c, None, None), (9, c, None, None), (None, a, None, None), (7, None, None, None), (7, "", None, None), (8, " ", None, None)]
    kept = sorted(((r.doc_id, r.text) for r in keep_one(frame(spark, rows)).collect()), key=repr)
    null_or_empty = [k for k in kept if k[0] == 7]
    assert len(null_or_empty) == 1 and [k for k in kept if k[0] != 7] == sorted([(3, a), (5, b), (5, d), (9, c), (9, c), (None, a)], key=repr)


def plain_kept(rows: list[tuple], shingle: int, radius: int, prints: int) -> list[tuple]:
    """(doc_id, text) of what ``keep_one`` keeps of rows with different (doc_id, text)."""
    import xxhash

    M = (1 << 64) - 1

    def rehashed(x: int, k: int) -> int:
        if not k:
            return x
        x = (x + 0x9E3779B97F4A7C15 * (k + 1)) & M
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & M
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & M
        return x ^ (x >> 31)

    def prints_of(text: str | None) -> list[int]:
        words = WORD.findall((text or "").translate(LOWER))
        hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + shingle]).encode(), seed=42) for i in range(max(1, len(words) - shingle + 1))] if words else []
        return [sum(1 << b for b in range(64) if 2 * sum(rehashed(h, k) >> b & 1 for h in hashes) > len(hashes)) for k in range(prints)]

    fps = [prints_of(t) for _, t in rows]
    group = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if group[i] != group[j] and any((a ^ b).bit_count() <= radius for a, b in zip(fps[i], fps[j])):
            group = [group[i] if g == group[j] else g for g in group]
    best: dict = {}
    for i, (d, _) in enumerate(rows):
        best[group[i]] = min(best.get(group[i], (d, i)), (d, i))
    return [rows[i] for _, i in best.values()]


@pytest.mark.parametrize("shingle,radius,prints", [(2, 4, 3), (3, 2, 1)])
def test_keep_one_of_edited_copies(spark, shingle, radius, prints):
    rng = random.Random(23)
    rows = []
    for i in range(70):
        words = sentence(rng, rng.randint(20, 150)).split()
        rows.append((i * 3, " ".join(words)))
        for c in range(rng.randint(0, 2)):
            edited = list(words)
            for _ in range(rng.randint(1, 3)):
                edited[rng.randrange(len(edited))] = f"new{rng.randint(0, 9999)}"
            rows.append((1000 + i * 3 + c, " ".join(edited)))
    kept = sorted((r.doc_id, r.text) for r in keep_one(frame(spark, [(*r, None, None) for r in rows]), shingle, radius, prints).collect())
    assert kept == sorted(plain_kept(rows, shingle, radius, prints)) and len(kept) < len(rows)


def test_fingerprint_of_a_long_text_in_steps(spark, monkeypatch):
    from docvigil.llm import simhash

    monkeypatch.setattr(simhash, "STEP", 7)
    text = sentence(random.Random(3), 200)
    batch = frame(spark, [(1, text, None, None)])
    assert int(near_duplicates(batch).first().fingerprint, 16) == fingerprint(text)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("radius,agree", [(1, None), (2, None), (2, 4), (3, None), (4, None), (4, 4)])
def test_links_of_dense_clusters(spark, radius, agree):
    """Far more fingerprints around two centres than a bucket forms pairs of."""
    rng = random.Random(1)
    prints = {0: 0, 1: (1 << 64) - 1}
    while len(prints) < 6 * BUCKET:
        base = rng.choice([0, (1 << 64) - 1, rng.getrandbits(64)])
        for b in rng.sample(range(64), rng.randint(0, 5 + radius)):
            base ^= 1 << b
        if base not in prints.values():
            prints[len(prints)] = base
    nodes = spark.createDataFrame([(signed(v), k) for k, v in prints.items()], "fp long, rep long")
    found = {r.node: r.component for r in connected_components(near_pairs(nodes, radius, agree)).collect()}
    wanted = classes(prints, radius)
    assert {k: found.get(k, k) for k in prints} == wanted


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 400), (400, 500), (7, 7)], "u long, v long")
    found = {r.node: r.component for r in connected_components(edges).collect()}
    assert all(found[i] == 0 for i in range(201)) and found[500] == found[400] == 400


# ---------------------------------------------------------------- 4


def cut(rows: list[tuple], window: int) -> dict:
    words = {r[0]: WORD.findall(r[1] or "") for r in by_id(rows)}
    first: dict = {}
    for k in sorted(words):
        for i in range(len(words[k]) - window + 1):
            first.setdefault(tuple(words[k][i : i + window]), k)
    out = {}
    for k, w in words.items():
        gone = {j for i in range(len(w) - window + 1) if first[tuple(w[i : i + window])] < k for j in range(i, i + window)}
        out[k] = (len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))
    return out


@pytest.mark.parametrize("window", [50, 7])
def test_substring_dedup(spark, window):
    rows = [r for r in awkward() if r[1] is None or len(r[1]) < 20_000]
    found = substring_dedup(frame(spark, rows), window).collect()
    wanted = cut(rows, window)
    for r in found:
        if r.doc_id is not None:
            n, gone, kept = wanted[r.doc_id]
            assert (r.n_words, r.n_removed, r.kept_sha256) == (n, gone, hashlib.sha256(kept.encode()).hexdigest())
            assert cut_text(rows[0][1] or "" if r.doc_id == rows[0][0] else next(x[1] for x in rows if x[0] == r.doc_id) or "", r.removed) == kept
        else:
            assert r.n_removed == 0
    assert len(found) == len(rows)
    assert substring_dedup(frame(spark, rows).limit(0), window).count() == 0


def test_substring_dedup_of_repeated_rows(spark):
    text = sentence(random.Random(2), 80)
    found = substring_dedup(frame(spark, [(1, text, None, None), (1, text, None, None), (1, text + " x", None, None), (2, "y " + text, None, None)])).collect()
    assert sorted((r.doc_id, r.n_removed) for r in found) == [(1, 0), (1, 0), (1, 0), (2, 80)]


def test_substring_dedup_of_several_texts_of_an_id(spark):
    rng = random.Random(12)
    a, b, c = (sentence(rng, 90) for _ in range(3))
    part = " ".join(b.split()[10:70])
    rows = [(3, a), (5, a), (5, b), (7, f"{sentence(rng, 20)} {part} {c}"), (None, part), (9, part)]
    found = sorted((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup(frame(spark, [(*r, None, None) for r in rows])).collect() if r.doc_id)
    assert found == [(3, 90, 0), (5, 90, 0), (5, 90, 90), (7, 170, 60), (9, 60, 60)]


def test_windows_in_blocks(monkeypatch):
    from docvigil.llm import substring_dedup as module

    texts = [sentence(random.Random(i), n) for i, n in enumerate((0, 3, 50, 400, 49, 120))]
    (_, _, data, offsets), = common.text_slices(pa.array(texts))
    whole = list(module.windows(data, offsets, 50))
    monkeypatch.setattr(module, "BLOCK", 13)
    parts = list(module.windows(data, offsets, 50))
    for name in ("anchor", "high", "low", "doc", "valid", "pos"):
        assert np.array_equal(np.concatenate([getattr(w, name) for w in parts]), getattr(whole[0], name))
    assert len(whole) == 1 and len(parts) > 20


# ---------------------------------------------------------------- 5


def targets(sizes: dict, most: float = 3) -> dict:
    names = sorted((k for k in sizes if k is not None)) + [k for k in sizes if k is None]
    weight = {k: (1, 2, 3)[i % 3] for i, k in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        rest = total - sum(capped.values())
        free = {k: w for k, w in weight.items() if k not in capped}
        over = {k: most * sizes[k] for k, w in free.items() if rest * w / sum(free.values()) > most * sizes[k]}
        if not over:
            return capped | {k: rest * w / sum(free.values()) for k, w in free.items()}
        capped |= over


def test_mixing(spark):
    rng = random.Random(8)
    share = {"a": 6, "B": 1, "b": 3, "ü": 1, None: 2, "hot": 30}
    rows = [(i, sentence(rng, rng.randint(1, 60)), None, rng.choices(list(share), list(share.values()))[0]) for i in range(600)] + [(600, None, None, "a"), (601, "", None, None)]
    found = mix_sources(frame(spark, rows)).select("row.doc_id", "row.source", "row.row", "size", "source_size", "target", "copies", "taken").collect()
    assert len(found) == len(rows) and {r.row for r in found} == {"own row"}
    size = {r[0]: len(WORD.findall(r[1] or "")) for r in rows}
    sizes: dict = defaultdict(int)
    for r in rows:
        sizes[r[3]] += size[r[0]]
    wanted, taken = targets(dict(sizes)), Counter()
    for r in found:
        assert r["size"] == size[r.doc_id] and r.source_size == sizes[r.source] and math.isclose(r.target, wanted[r.source], rel_tol=1e-9)
        assert r.taken == r.copies * r["size"] <= 3 * r["size"]
        taken[r.source] += r.taken
    for k, t in wanted.items():
        assert abs(taken[k] - t) <= max(0.01 * t, 3), (k, taken[k], t)
    again = mix_sources(frame(spark, rows).repartition(5), carry=["doc_id"]).select("row.doc_id", "copies").collect()
    assert sorted((r.doc_id, r.copies) for r in again) == sorted((r.doc_id, r.copies) for r in found)
    repeated = mixed(frame(spark, rows))
    assert repeated.columns == frame(spark, rows).columns and repeated.count() == sum(r.copies for r in found)


def dense_rates(sizes: np.ndarray, target: float, most: float) -> np.ndarray:
    """Rates in [0, most] with the target in tokens that are nearest to 1 in entropy, by bisection of the dual."""
    x = sizes / sizes.mean()
    low, high = -1e6, 1e6
    for _ in range(300):
        mid = (low + high) / 2
        rates = np.minimum(most, np.exp(np.minimum(mid * x, 50)))
        low, high = (mid, high) if (rates * sizes).sum() < target else (low, mid)
    return rates


def test_rates_equal_a_dense_solver(spark):
    rng = random.Random(18)
    rows = [(i, sentence(rng, int(rng.lognormvariate(3, 1)) + 1), None, rng.choice(["a", "b", "b", "b", "c", "d", "d", "e"])) for i in range(900)] + [(1000, "one", None, "f")]
    found = defaultdict(list)
    for r in mix_sources(frame(spark, rows)).select("row.source", "size", "target", "rate").collect():
        found[r.source].append(r)
    varied = 0
    for of in found.values():
        size, rate = np.array([r["size"] for r in of], float), np.array([r.rate for r in of])
        assert np.allclose(rate, dense_rates(size, of[0].target, 3), rtol=1e-6) and math.isclose((rate * size).sum(), of[0].target, rel_tol=1e-7)
        varied += len(set(np.round(rate, 6))) > 5
    assert varied >= 4


def test_mixing_counts_every_repeated_row(spark):
    rng = random.Random(2)
    rows = [(7, "one two three four", None, "a")] * 200 + [(i, sentence(rng, 9), None, "a") for i in range(100, 140)] + [(900 + i, sentence(rng, 30), None, "b") for i in range(40)]
    taken, wanted = Counter(), {}
    for r in mix_sources(frame(spark, rows)).select("row.source", "target", "taken").collect():
        taken[r.source] += r.taken
        wanted[r.source] = r.target
    for k, t in wanted.items():
        assert taken[k] <= t + 1e-6 and t - taken[k] < (9 if k == "a" else 30), (k, taken, wanted)


def test_many_sources(spark):
    rows = [(i, sentence(random.Random(i), 1 + i % 17), None, f"s{i % 131}") for i in range(800)] + [(900, None, None, "t"), (901, "x", None, None)]
    found = {r.source: r for r in mix_sources(frame(spark, rows)).select("row.source", "target", "source_size").collect()}
    sizes: dict = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    wanted = targets(dict(sizes))
    assert all(math.isclose(found[k].target, wanted[k], rel_tol=1e-9) and found[k].source_size == sizes[k] for k in wanted)


def test_mixing_of_awkward_rows(spark):
    rows = awkward()
    assert mix_sources(frame(spark, rows)).count() == len(rows)
    assert mix_sources(frame(spark, rows).limit(0)).count() == 0
    empty = mix_sources(frame(spark, [(1, None, None, "a"), (2, "", None, None)])).collect()
    assert [(r.target, r.taken) for r in empty] == [(0.0, 0), (0.0, 0)]


def test_mixing_fills_the_target_around_long_documents(spark):
    rng = random.Random(9)
    rows = [(i, sentence(rng, 20), None, "a") for i in range(400)] + [(1000 + i, sentence(rng, 8000), None, "a") for i in range(1)]  # the short ones alone reach the target
    rows += [(2000 + i, sentence(rng, 5), None, "b") for i in range(20)] + [(3000, sentence(rng, 9000), None, "b")]  # all short ones thrice do not
    rows += [(4000 + i, sentence(rng, 10), None, "c") for i in range(30)] + [(5000, sentence(rng, 7000), None, "c")] + [(6000 + i, sentence(rng, 40), None, "d") for i in range(60)]
    rows += [(7, "one two three", None, "d")] * 5
    taken, wanted, spare = Counter(), {}, defaultdict(list)
    for r in mix_sources(frame(spark, rows)).select("row.source", "size", "target", "copies", "taken").collect():
        taken[r.source] += r.taken
        wanted[r.source] = r.target
        if r.copies < 3 and r["size"] > 3:
            spare[r.source].append(r["size"])
    for k, t in wanted.items():
        assert taken[k] <= t + 1e-6 and t - taken[k] < min(spare[k]), (k, taken[k], t, min(spare[k]))


# ---------------------------------------------------------------- 6


def test_codecs():
    rng = np.random.RandomState(0)
    for data in (b"", b"a", b"ab" * 700, b"\0" * 5000, bytes(rng.randint(0, 256, 20_000, dtype=np.uint8)), sentence(random.Random(1), 4000).encode()):
        assert packbits_decode(packbits_encode(data)) == data and lzw_decode(lzw_encode(data)) == data


@pytest.mark.parametrize("scheme", [1, 5, 8, 32773])
@pytest.mark.parametrize("tile", [0, 16, 32])
@pytest.mark.parametrize("order", ["<", ">"])
def test_pages_come_back(scheme, tile, order):
    rng = np.random.RandomState(1)
    for shape, kind in (((70, 33), np.uint8), ((5, 64, 3), np.uint8), ((40, 17), np.uint16)):
        page = rng.randint(0, 256, shape).astype(kind)
        for predictor in (1, 2):
            (back,) = file_pages(encode_page(page, scheme, predictor, 7, tile, order))
            assert back["error"] is None and back["pixels"] == page.tobytes() and (back["height"], back["width"]) == shape[:2]


def test_several_pages_and_broken_files(spark):
    page = np.arange(64, dtype=np.uint8).reshape(8, 8)
    one = encode_page(page)
    # a second directory behind the first: the same one, moved
    at = int.from_bytes(one[4:8], "little")
    n = int.from_bytes(one[at : at + 2], "little")
    directory = one[at : at + 2 + 12 * n] + (0).to_bytes(4, "little")
    two = bytearray(one + directory)
    two[at + 2 + 12 * n : at + 6 + 12 * n] = len(one).to_bytes(4, "little")
    loop = bytearray(two)
    loop[-4:] = at.to_bytes(4, "little")
    files = spark.createDataFrame([(1, bytes(two)), (2, b"no image"), (3, None), (4, one[:-30]), (5, bytes(loop))], "k int, media binary")
    found = decode_pages(files).toPandas()
    assert found[found.k == 1].page.tolist() == [0, 1] and found[found.k == 5].page.tolist() == [0, 1]
    assert all(bytes(p) == page.tobytes() for p in found[found.k == 1].pixels)
    assert found[found.k.isin([2, 3])].error.notna().all()
    assert decode_pages(files.limit(0)).count() == 0


def test_fuzzed_files_give_rows_with_an_error(spark):
    rng = np.random.RandomState(4)
    page = rng.randint(0, 4, (40, 48)).astype(np.uint8)
    rows = []
    for scheme in (1, 5, 8, 32773):
        for tile in (0, 16):
            whole = encode_page(page, scheme, 2, 9, tile)
            for _ in range(60):
                data = bytearray(whole)
                for at in rng.randint(0 if rng.rand() < 0.2 else len(data) - 250, len(data), 3):
                    data[max(0, at)] = rng.randint(0, 256)
                rows.append(bytes(data[: len(data) - rng.randint(0, 9) * int(rng.rand() < 0.2)]))
    entry = lambda tag, kind, value: tag.to_bytes(2, "little") + kind.to_bytes(2, "little") + (1).to_bytes(4, "little") + value.to_bytes(4, "little")

    def made(*entries: bytes) -> bytes:
        return b"II*\0" + (8).to_bytes(4, "little") + len(entries).to_bytes(2, "little") + b"".join(entries) + bytes(4)

    size, eight = (entry(256, 4, 1 << 30), entry(257, 4, 1 << 30)), entry(258, 3, 8)
    small = (entry(256, 4, 8), entry(257, 4, 8))
    rows += [made(*size, eight, entry(273, 4, 8), entry(279, 4, 4)), made(*small, eight, entry(324, 4, 8), entry(325, 4, 4)), made(*small, eight, entry(322, 4, 0), entry(323, 4, 0), entry(324, 4, 8), entry(325, 4, 4)), made(*small, eight, entry(273, 4, 8), entry(279, 4, 4), entry(277, 3, 0))]
    found = decode_pages(spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "k int, media binary")).toPandas()
    assert set(found.k) == set(range(len(rows))) and found[found.k >= len(rows) - 4].error.notna().all()
    assert (found.error.notna() == found.pixels.isna()).all() and found.error.notna().sum() > 50
    with pytest.raises(ValueError):
        from docvigil.llm.tiff_media import directories, page_samples

        page_samples(whole, next(directories(whole)), most_bytes=100)


def test_clashing_columns_of_files_move_into_a_struct(spark):
    data = encode_page(np.arange(64, dtype=np.uint8).reshape(1, 64), 8, 2)
    files = spark.createDataFrame([(7, "mine", data, 3, "f")], "page int, error string, media binary, k int, file string")
    r = decode_pages(files).first()
    assert (r.page, r.error, r.k, r.file.page, r.file.error, r.file.file) == (0, None, 3, 7, "mine", "f")
    r = decode_pages(files.select(files.media.alias("pixels"), "k"), media="pixels").first()
    assert bytes(r.pixels) == bytes(range(64)) and bytes(r.file.pixels) == data and r.__fields__ == ["k", "file", "page", "width", "height", "samples", "bits", "compression", "pixels", "error"]


def test_no_form_depends_on_a_texts_size():
    from docvigil.llm.tiff_media import form_of

    for size in (64, 6400, 640_000):
        forms = {form_of(payload_of(f"{i}".ljust(size, "x"))) for i in range(120)}
        assert forms == {(5, 0), (8, 0), (8, 64), (32773, 0)}


def test_names_of_texts_do_not_depend_on_partitions(spark):
    from docvigil.llm.common import numbered

    rows = [(f"block {i % 37:02d}".encode() * (i % 5),) for i in range(200)]
    df = spark.createDataFrame(rows, "block binary").distinct()
    names = [sorted((bytes(r.block), r.name) for r in numbered(df.repartition(n), "block").collect()) for n in (1, 3, 8)]
    assert names[0] == names[1] == names[2] and [n for _, n in names[0]] == list(range(len(names[0])))
    from pyspark.sql import functions as F

    nulls = spark.createDataFrame([(3, None), (1, "b"), (2, "a")], "k int, source string").withColumn("none", F.col("source").isNull())
    assert sorted((r.k, r.place) for r in numbered(nulls, "none", "source", name="place").collect()) == [(1, 1), (2, 0), (3, 2)]


def test_batches_end_at_whole_documents(spark, monkeypatch):
    from docvigil.llm import packing, token_files

    rows = [(i, "word " * (i * 40 % 130)) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    whole = read_token_files(write_token_files(df, vocabulary("word_bpe_49k.json"), 1)).orderBy("doc_id").collect()
    packed = pack(df, vocabulary("byte_bpe_50k.json"), 1).drop("sequence_id").orderBy("doc_id", "start").collect()
    monkeypatch.setattr(token_files, "BATCH_IDS", 50)
    monkeypatch.setattr(packing, "BATCH_PIECES", 3)
    assert read_token_files(write_token_files(df, vocabulary("word_bpe_49k.json"), 1)).orderBy("doc_id").collect() == whole
    assert pack(df, vocabulary("byte_bpe_50k.json"), 1).drop("sequence_id").orderBy("doc_id", "start").collect() == packed


def test_texts_as_pages(spark):
    rows = awkward()
    pages = with_features(decode_pages(texts_as_files(frame(spark, rows)))).toPandas()
    assert len(pages) == len(rows)
    for r in pages.dropna(subset="doc_id").itertuples():
        text = rows[int(r.doc_id)][1]
        assert bytes(r.pixels) == payload_of(text) and r.n_bytes == len((text or "").encode())
    assert {8, 32773} <= set(pages.compression) <= {8, 5, 32773} and pages.error.isna().all()
    same = pages[pages.doc_id.isin([6, 7])]
    assert same.media.map(bytes).nunique() == 1 and same.feature.nunique() == 1


# ---------------------------------------------------------------- 7


@pytest.mark.parametrize("block,head", [(8192, 64), (7, 3)])
def test_exact_dedup(spark, block, head):
    rows = [r for r in awkward() if block > 100 or r[1] is None or len(r[1]) < 10_000]
    found = exact_groups(frame(spark, rows), block_bytes=block, head_bytes=head).select("row.doc_id", "row.text", "row.uid", "keep_id", "group_size", "kept", "text_sha256").collect()
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    assert len(found) == len(rows) and {r.uid for r in found} == {"own uid"}
    for r in found:
        ids = groups[r.text or ""]
        best = max((i for i in ids if i is not None), default=None)
        assert (r.keep_id, r.group_size) == (best, len(ids)) and r.text_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
        assert r.kept == (r.doc_id == best)
    assert drop_copies(frame(spark, rows)).count() == len(groups)
    assert exact_groups(frame(spark, rows).limit(0)).count() == 0


def test_exact_dedup_keeps_one_of_repeated_rows(spark):
    kept = drop_copies(frame(spark, [(1, "t", None, None), (1, "t", None, None), (0, "t", None, None), (2, "u", None, None)]))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2]


# ---------------------------------------------------------------- 9


def toxic_rows(n: int = 900) -> tuple[list[tuple], list[tuple]]:
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.3
        words = sentence(rng, rng.randint(20, 80)).split()
        for _ in range(rng.randint(1, 3) * bad):
            words.insert(rng.randrange(len(words)), rng.choice(["vermin", "Vermin!", "swine", "filth."]))
        rows.append((i, " ".join(words), rng.choice(["en", "de"]), None))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity(spark):
    rows, labels = toxic_rows()
    table = spark.createDataFrame([*labels, (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    docs = frame(spark, rows)
    model = fit_toxicity(labelled_sample(docs, table, common.crc_mod(F.col("doc_id"), 5) != 0, 300, 500))
    found = score_toxicity(docs, model).toPandas().set_index("doc_id")
    held = [x for x in labels if zlib.crc32(str(x[0]).encode()) % 5 == 0]
    assert sum((found.score[i] >= 0.5) == bool(y) for i, _, y in held) >= 0.97 * len(held)
    assert found.score.between(0, 1).all()
    odd = frame(spark, [(1, None, None, None), (2, "", "xx", None), (3, "word " * 50_000 + "vermin", "en", None), (3, "ok", "en", None)])
    assert score_toxicity(odd, model).count() == 4 and drop_toxic(odd, model).columns == odd.columns
    kept = {r.doc_id for r in drop_toxic(docs, model).collect()}
    assert kept == {i for i, r in found.iterrows() if not r.rejected}
    assert drop_toxic(docs.limit(0), model).count() == 0


def test_one_forward_pass_by_loops(spark, monkeypatch):
    """Scores, the common cut and a language's threshold against loops over words and filters."""
    from docvigil.llm import toxicity

    rows, labels = toxic_rows(300)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = fit_toxicity(labelled_sample(frame(spark, rows), table, F.lit(True), 150, 150), epochs=1, steps=20)
    monkeypatch.setattr(toxicity, "BLOCK", 7)  # texts are scored in overlapping blocks
    texts = [rows[0][1], rows[1][1], "", None, "vermin", "VERMIN! 9 swine", rows[2][1] + " " + rows[3][1]]
    found = {r.doc_id: r for r in score_toxicity(frame(spark, [(i, t, "en", None) for i, t in enumerate(texts)]), model).collect()}
    import re

    known = {int(h): i + 1 for i, h in enumerate(model.vocabulary.tolist())}
    for i, t in enumerate(texts):
        words = re.findall(r"[a-z\x80-\U0010ffff]+", (t or "").translate(LOWER))
        ids = []
        for w in words:
            data = np.frombuffer(w.encode(), np.uint8)
            ids.append(known.get(int(common.words_hash(data, np.array([0]), np.array([len(data)]))[0]), 0))
        hidden = []
        for k, w in enumerate(model.filters):
            for f in range(w.shape[2]):
                answers = [sum(float(model.embedding[ids[p + j]] @ w[j, :, f]) for j in range(len(w)) if p + j < len(ids)) for p in range(len(ids))]
                hidden.append(max(0.0, (max(answers) if answers else 0.0) + float(model.bias[k * w.shape[2] + f])))
        logit = sum(h * float(x) for h, x in zip(hidden, model.weights[:-1])) + float(model.weights[-1]) + model.shift
        assert math.isclose(found[i].score, 1 / (1 + math.exp(-logit)), abs_tol=1e-4)
        assert found[i].threshold == model.thresholds.get("en", 0.5) and found[i].rejected == (found[i].score >= found[i].threshold)


def test_a_cut_has_the_best_f1():
    from docvigil.llm.toxicity import _cut

    rng = np.random.RandomState(2)
    for _ in range(40):
        n = rng.randint(2, 30)
        z, y = rng.randint(0, 8, n).astype(float), rng.randint(0, 2, n).astype(float)
        y[0] = 1
        f1 = lambda c: 2 * ((z >= c) & (y == 1)).sum() / ((z >= c).sum() + y.sum())
        assert math.isclose(f1(_cut(z, y)), max(f1(c) for c in z))


def test_toxicity_learns_from_all_labels(spark, monkeypatch):
    """Several shards; a word that only long texts have; the cut against all held-out scores; counts of words."""
    import re

    from docvigil.llm import toxicity

    monkeypatch.setattr(toxicity, "SHARD", 400)
    rows, labels = toxic_rows(1200)
    rows = [(i, t + " grub" + " ok" * 25_000 if i % 60 == 0 else t, lang, s) for i, t, lang, s in rows]
    labels = [(i, q, int(i % 60 == 0 or y)) for i, q, y in labels]
    table = spark.createDataFrame([*labels, (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    docs, train = frame(spark, rows), common.crc_mod(F.col("doc_id"), 5) != 0
    words = toxicity.labelled_words(docs, table, train)
    used = {i for i, _, _ in labels if zlib.crc32(str(i).encode()) % 5}
    assert words.count() == len(used) and words.select("shard").distinct().count() > 1
    plain = Counter(w for i, t, _, _ in rows if i in used for w in set(re.findall(r"[a-z\x80-\U0010ffff]+", t.translate(LOWER))))
    assert len(toxicity.frequent_words(words, 3, 1000)) == sum(n >= 3 for n in plain.values())
    model = toxicity.train_toxicity(docs, table, train)
    found = score_toxicity(docs, model).toPandas().set_index("doc_id")
    held = [x for x in labels if x[0] not in used]
    assert sum((found.score[i] >= 0.5) == bool(y) for i, _, y in held) >= 0.97 * len(held)
    grub = [i for i, _, _ in held if i % 60 == 0]
    assert sum(found.score[grub] >= 0.5) >= 0.9 * len(grub)
    calibrating = {r.id for r in spark.range(1200).filter(F.pmod(F.xxhash64("id", F.lit("held")), F.lit(4)) == 0).collect()} & used
    z, y = found.score[sorted(calibrating)].to_numpy(), np.array([dict((i, y) for i, _, y in labels)[i] for i in sorted(calibrating)])
    f1 = lambda c: 2 * ((z >= c) & (y == 1)).sum() / ((z >= c).sum() + y.sum())
    assert f1(0.5) >= max(f1(c) for c in z) - 0.005
    again = toxicity.train_toxicity(docs.repartition(5), table, train)
    assert again.shift == model.shift and (again.embedding == model.embedding).all()
    assert score_toxicity(docs, toxicity.train_toxicity(docs, table.limit(0), train)).filter("score >= 0.5").count() == 0


def test_toxicity_without_labels(spark):
    rows, _ = toxic_rows(20)
    docs = frame(spark, rows)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = fit_toxicity(labelled_sample(docs, none, F.lit(True), 10, 10))
    assert all(r.score < 0.5 for r in score_toxicity(docs, model).collect()) and drop_toxic(docs, model).count() == 20


# ---------------------------------------------------------------- 10


def test_importance(spark):
    rng = random.Random(6)
    rows = [(i, sentence(rng, 40) if i % 4 else " ".join(f"{rng.randint(0, 99)}###" for _ in range(40)), None, None) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(0, 400, 3)] + [(None, 1, 1), (4, None, 0)], "doc_id long, quality int, toxic int")
    found = importance_sample(frame(spark, rows), labels, buckets=1 << 12).toPandas().set_index("doc_id")
    kept = {i for i, k in found.kept.items() if k}
    assert len(found) == 400 and sum(i % 4 != 0 for i in kept) >= 0.99 * len(kept) and abs(len(kept) - 300) <= 3
    assert importance_sample(frame(spark, rows), labels.limit(0)).filter("kept").count() == 400
    assert importance_sample(frame(spark, rows).limit(0), labels).count() == 0
    odd = awkward()
    out = importance_sample(frame(spark, odd), labels, keep=0.5).toPandas()
    assert len(out) == len(odd) and out[out.doc_id.isin([0, 1, 2])].log_weight.eq(0).all()


def test_importance_equals_plain_counts_and_gumbel_keys(spark):
    rng = random.Random(16)
    rows = [(i, sentence(rng, rng.randint(0, 30)) if i % 3 else " ".join(f"{rng.randint(0, 9)}# W{rng.randint(0, 3)}" for _ in range(15)), None, None) for i in range(120)]
    labels = [(i, int(i % 3 != 0), 0) for i in range(0, 120, 2)]
    buckets = 1 << 10
    spread = {r.doc_id: r for r in frame(spark, rows).select("doc_id", "text", ((F.pmod(F.xxhash64("doc_id", "text", F.lit("gumbel")), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))).alias("drawn")).collect()}
    M = (1 << 64) - 1

    def mixed64(x: int, seed: int) -> int:
        x = (x + 0x9E3779B97F4A7C15 * (seed + 1)) & M
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & M
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & M
        return x ^ (x >> 31)

    def grams(text: str) -> list[int]:
        h = []
        for w in WORD.findall(text.translate(LOWER)):
            total = 0
            for i, b in enumerate(w.encode()):
                total = (total + mixed64(b, 11) * pow(0xD1342543DE82EF95, i, 1 << 64)) & M
            h.append(mixed64(total ^ len(w.encode()), 3))
        return [x % buckets for x in h] + [mixed64((a * 3 + b) & M, 9) % buckets for a, b in zip(h[:-1], h[1:])]

    good = {i for i, q, _ in labels if q}
    raw, target = Counter(), Counter()
    for i, t, _, _ in rows:
        raw.update(grams(t))
        if i in good:
            target.update(grams(t))
    n_raw, n_target = sum(raw.values()) + buckets, sum(target.values()) + buckets
    weight = lambda b: math.log((target[b] + 1) / n_target) - math.log((raw[b] + 1) / n_raw)
    wanted = {i: sum(weight(b) for b in grams(t)) for i, t, _, _ in rows}
    key = {i: w - math.log(-math.log(spread[i].drawn)) for i, w in wanted.items()}
    k = round(len(good) / len(labels) * len(rows))
    kept = set(sorted(key, key=lambda i: -key[i])[:k])
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for r in importance_sample(frame(spark, rows), table, buckets=buckets).collect():
        assert math.isclose(r.log_weight, wanted[r.doc_id], abs_tol=1e-8) and math.isclose(r.gumbel_key, key[r.doc_id], abs_tol=1e-8) and r.kept == (r.doc_id in kept)


def test_kth_largest_is_exact(spark):
    rng = random.Random(3)
    values = [rng.choice([rng.gauss(0, 1e6), 3.0, -1e-9]) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for k in (1, 2, 77, 499, 500):
        assert common.kth_largest(df, "v", k, bins=16)[0] == sorted(values, reverse=True)[k - 1]
    assert common.kth_largest(df.limit(0), "v", 3) == (None, 0)


# ---------------------------------------------------------------- shared parts


def test_word_slices_match_the_pattern():
    texts = [r[1] for r in awkward()]
    column = pa.array([None, *texts])
    for limit in (50, 1000, 10**9):
        found = []
        for low, high, data, offsets in common.text_slices(column, limit):
            w = common.Words(data, offsets)
            h = w.hashes()
            for i in range(high - low):
                a, b = w.first[i], w.first[i + 1]
                found.append(([data[s:e].tobytes().decode() for s, e in zip(w.start[a:b], w.end[a:b])], h[a:b].tolist()))
        assert [f[0] for f in found] == [WORD.findall(t or "") for t in [None, *texts]]
        names: dict = {}
        for words, hashes in found:
            for x, y in zip(words, hashes):
                assert names.setdefault(x, y) == y
        assert len(set(names.values())) == len(names)


def test_word_count(spark):
    rows = awkward()
    found = frame(spark, rows).select("text", common.n_words(F.col("text")).alias("n")).collect()
    assert all(r.n == len(WORD.findall(r.text or "")) for r in found)
