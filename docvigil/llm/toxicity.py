"""Toxicity: a convolutional text classifier on hashed word embeddings, trained in numpy.

A word (a run of letters, A-Z lowered) is known by its 64-bit hash; words in at least ``min_docs``
texts of the sample own an embedding, all others share a zero one. Filters of several widths slide
over a text's embeddings, the strongest answer of each filter in the whole text goes into a logistic
output. ``train_toxicity`` learns from all labelled rows and their whole texts: Spark counts the words,
deals the rows out into shards by a hash, and in each round every shard trains (Adam, in numpy) from the
model of the round before; Spark averages what they found. A quarter of the rows is not trained on;
counts of its scores in steps of 1 / ``GRID`` calibrate the score (0.5 is the best cut for all) and a
threshold for each language. The language only picks the threshold of ``rejected``; it is never an
input of a score. ``fit_toxicity`` trains the same model on a table that the driver holds.

Whole texts are scored, in blocks of ``BLOCK`` words that overlap by a filter's width, whose maxima are
combined: memory for a very long text is about 10 times its bytes.

Edge cases: null and empty texts get the score of a text without words; a null or unseen language
takes the common threshold; labels repeated for a doc_id count as toxic if any is; rows without a
usable label or with null doc_id do not train; if no class pair can be learned, every score is 0.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docvigil.llm.common import Words, byte_class, hash_order, materialize, segment_max, text_slices

_LETTER = byte_class((65, 90), (97, 122), (128, 255))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

WIDTHS = (1, 2, 3)
#: Words scored at once: the filters' answers take about 500 bytes of each.
BLOCK = 80_000
#: Labelled ids of a shard; words that a shard's task holds at once (beyond a text's own); words of an averaged piece.
SHARD, CHUNK, PIECE = 16_384, 8_000_000, 256
#: Rounds of averaging where there are several shards.
ROUNDS = 3
#: Steps of a logit in which held-out scores are counted.
GRID = 1024
#: Bits of a word's hash that are left off where texts are kept as words.
FOLD = 32


@dataclass
class ToxicityModel:
    vocabulary: np.ndarray  # sorted word hashes; word i has embedding i + 1
    embedding: np.ndarray
    filters: list[np.ndarray]  # of each width: (width, embedding, filters)
    bias: np.ndarray
    weights: np.ndarray
    shift: float
    common: float
    thresholds: dict[str, float]
    fold: int = 0  # low bits of a hash that the vocabulary lacks

    def rows_of(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        hashes = hashes >> np.uint64(self.fold)
        spot = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[spot] == hashes, spot + 1, 0)

    def answers(self, rows: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
        """Each width's filter outputs at each word, texts apart: windows past a text's end see zeros."""
        out = []
        count = np.diff(first)
        room = max(WIDTHS) - 1
        at = np.arange(len(rows)) + np.repeat(np.arange(len(count)) * room, count)
        spaced = np.zeros(len(rows) + room * len(count) + room, np.int64)
        spaced[at] = rows
        steps = np.concatenate([w[j] for w in self.filters for j in range(len(w))], axis=1)  # one product for all
        product = self.embedding[spaced] @ steps
        n, column = self.filters[0].shape[2], 0
        for w in self.filters:
            z = product[at, column : column + n]
            for j in range(1, len(w)):
                z = z + product[at + j, column + j * n : column + (j + 1) * n]
            out.append(z)
            column += len(w) * n
        return out

    def pooled(self, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The strongest answer of each filter in each text, found in blocks of words."""
        out = np.full((len(first) - 1, sum(w.shape[2] for w in self.filters)), -np.inf, np.float32)
        for a in range(0, len(rows), BLOCK):
            b = min(a + BLOCK, len(rows))
            low, high = int(np.searchsorted(first, a, side="right")) - 1, int(np.searchsorted(first, b, side="left"))
            # a block sees the words after it, as far as a filter of its last word looks into the text
            until = min(b + max(WIDTHS) - 1, int(first[high]))
            cut = np.clip(first[low : high + 1], a, until) - a
            starts = np.clip(first[low : high + 1], a, b) - a
            found = [segment_max(z[: b - a], starts, -np.inf) for z in self.answers(rows[a:until], cut)]
            out[low:high] = np.maximum(out[low:high], np.concatenate(found, axis=1))
        out[np.diff(first) == 0] = 0
        return out

    def strongest(self, rows: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``pooled``, and the word of each strongest answer by width, text and filter; -1 without words."""
        n, filters = len(first) - 1, self.filters[0].shape[2]
        best = np.full((len(WIDTHS), n, filters), -1, np.int64)
        top = np.full((len(WIDTHS), n, filters), -np.inf, np.float32)
        for a in range(0, len(rows), BLOCK):
            b = min(a + BLOCK, len(rows))
            low, high = int(np.searchsorted(first, a, side="right")) - 1, int(np.searchsorted(first, b, side="left"))
            until = min(b + max(WIDTHS) - 1, int(first[high]))
            cut = np.clip(first[low : high + 1], a, until) - a
            starts = np.clip(first[low : high + 1], a, b) - a
            for k, z in enumerate(self.answers(rows[a:until], cut)):
                for i, (s, e) in enumerate(zip(starts[:-1], starts[1:]), low):
                    if s < e:
                        spot = s + z[s:e].argmax(0)
                        found = z[spot, np.arange(filters)]
                        better = found > top[k, i]
                        top[k, i][better], best[k, i][better] = found[better], a + spot[better]
        top[best < 0] = 0
        return top.transpose(1, 0, 2).reshape(n, -1), best

    def logits(self, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
        return np.maximum(self.pooled(rows, first) + self.bias, 0) @ self.weights[:-1] + self.weights[-1] + self.shift

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        words = Words(_LOWER[data], offsets, ~_LETTER)
        return _sigmoid(self.logits(self.rows_of(words.hashes()), words.first).astype(np.float64))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def labelled_sample(docs: DataFrame, labels: DataFrame, train: Column, positives: int, negatives: int, longest: int = 65_536) -> pa.Table:
    """At most so many labelled rows of each class, (doc_id, text, lang, toxic), of texts of ``longest``
    bytes at most. Few ids are joined first; rows are drawn again after the join."""
    usable = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(train)
    usable = usable.groupBy(F.col("doc_id").alias("id")).agg(F.max("toxic").alias("is_toxic"))
    order = hash_order(F.col("id"))
    ids = usable.filter("is_toxic = 1").orderBy(order, "id").limit(positives).unionByName(usable.filter("is_toxic = 0").orderBy(order, "id").limit(negatives))
    rows = docs.select(F.col("doc_id").alias("of"), F.coalesce("text", F.lit("")).alias("words"), F.col("lang").alias("tongue")).filter(F.octet_length("words") <= longest)
    found = rows.join(F.broadcast(ids), rows["of"] == ids["id"]).withColumn("turn", hash_order(F.col("of"), F.col("words"))).drop("id")
    drawn = [found.filter(F.col("is_toxic") == y).orderBy("turn", "of").limit(n) for y, n in ((1, positives), (0, negatives))]
    return drawn[0].unionByName(drawn[1]).select(F.col("of").alias("doc_id"), F.col("words").alias("text"), F.col("tongue").alias("lang"), F.col("is_toxic").alias("toxic")).toArrow()


def fit_toxicity(sample: pa.Table, dims: int = 12, filters: int = 8, min_docs: int = 3, vocabulary: int = 65_536, epochs: int = 6, steps: int = 600, batch: int = 64, rate: float = 0.01, drop: float = 0.6, seed: int = 1) -> ToxicityModel:
    draw = np.random.RandomState(seed)
    y = np.array(sample.column("toxic").to_pylist(), np.float32)
    if len(set(y.tolist())) < 2:
        return _unlearned(dims, filters)
    ids = np.array(sample.column("doc_id").to_pylist(), np.int64)
    place = np.argsort(ids, kind="stable")  # the join's row order does not matter
    texts = []
    for _, _, data, offsets in text_slices(sample.column("text")):
        words = Words(_LOWER[data], offsets, ~_LETTER)
        h = words.hashes()
        texts += [h[a:b] for a, b in zip(words.first[:-1], words.first[1:])]
    texts, y, ids = [texts[i] for i in place], y[place], ids[place]
    lang = [sample.column("lang")[i].as_py() for i in place.tolist()]

    seen, df = np.unique(np.concatenate([np.unique(t) for t in texts]), return_counts=True)
    often = np.argsort(-df, kind="stable")[:vocabulary]
    known = np.sort(seen[often[df[often] >= min_docs]])
    model = _fresh(known, draw, dims, filters)
    rows = [model.rows_of(t) for t in texts]
    held = np.array([_spread(i) % 4 == 0 for i in ids.tolist()])
    if len(set(y[~held].tolist())) < 2 or len(set(y[held].tolist())) < 2:
        held[:] = False
    learn = np.flatnonzero(~held)
    state = _Adam(rate)
    weight = np.where(y == 1, 0.5 / max(y[learn].mean(), 1e-6), 0.5 / max(1 - y[learn].mean(), 1e-6)).astype(np.float32)
    for _ in range(max(epochs, -(-steps * batch // len(learn)))):  # a small sample is seen more often
        _pass(model, rows, y, weight, learn, draw, batch, drop, state)
    return _calibrated(model, rows, y, lang, np.flatnonzero(held) if held.any() else np.arange(len(y)))


def _unlearned(dims: int, filters: int) -> ToxicityModel:
    """What scores every text with 0."""
    return ToxicityModel(np.zeros(0, np.uint64), np.zeros((1, dims), np.float32), [np.zeros((w, dims, filters), np.float32) for w in WIDTHS], np.zeros(filters * len(WIDTHS), np.float32), np.zeros(filters * len(WIDTHS) + 1, np.float32), -30.0, 0.5, {})


def _fresh(known: np.ndarray, draw: np.random.RandomState, dims: int, filters: int, fold: int = 0) -> ToxicityModel:
    """A model before its first step."""
    model = ToxicityModel(
        known, draw.normal(0, 0.05, (len(known) + 1, dims)).astype(np.float32), [draw.normal(0, (2 / (w * dims)) ** 0.5, (w, dims, filters)).astype(np.float32) for w in WIDTHS],
        np.full(filters * len(WIDTHS), 0.05, np.float32), np.append(draw.normal(0, 0.3, filters * len(WIDTHS)), 0).astype(np.float32), 0.0, 0.5, {}, fold)
    model.embedding[0] = 0
    return model


def _pass(model: ToxicityModel, rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray, learn: np.ndarray, draw: np.random.RandomState, batch: int, drop: float, state: _Adam) -> None:
    """One pass over the texts ``learn``, in a new order."""
    draw.shuffle(learn)
    for a in range(0, len(learn), batch):
        some = learn[a : a + batch]
        # words are left out at random: else the strongest word of a text learns for all of them
        _step(model, [rows[i] * (draw.rand(len(rows[i])) >= drop) for i in some], y[some], weight[some], state)


def labelled_words(docs: DataFrame, labels: DataFrame, train: Column) -> DataFrame:
    """(held, toxic, lang, words, shard) of every labelled row of ``docs``, written in shards, each in a hash order.

    ``words`` holds the hashes of the whole text's words, in four bytes each. Texts meet the labels deflated, by a
    merge join at any size, so that what is shuffled grows in proportion. Rows of one doc_id are either all held
    out or none."""
    usable = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(train)
    usable = usable.groupBy(F.col("doc_id").alias("id")).agg(F.max("toxic").alias("is_toxic")).filter("is_toxic IN (0, 1)")

    def deflated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in text_slices(batch.column("text")):
                packed = pa.array([zlib.compress(data[a:b], 1) for a, b in zip(offsets[:-1], offsets[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(low, high - low) for c in ("of", "tongue")], packed], names=["of", "tongue", "packed"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for x in batch.column("packed"):
                data = np.frombuffer(zlib.decompress(x.as_buffer()), np.uint8)
                kept.append((Words(_LOWER[data], np.array([0, len(data)]), ~_LETTER).hashes() >> np.uint64(FOLD)).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("held", "toxic", "lang", "shard")], pa.array(kept, pa.binary())], names=["held", "toxic", "lang", "shard", "words"])

    rows = docs.filter("doc_id IS NOT NULL").filter(train).select(F.col("doc_id").cast("long").alias("of"), F.col("lang").cast("string").alias("tongue"), "text")
    rows = rows.mapInArrow(deflated, "of long, tongue string, packed binary")
    shards = max(1, -(-usable.count() // SHARD))
    turn = hash_order(F.col("of"), F.col("packed"))
    found = rows.join(usable.hint("merge"), rows["of"] == usable["id"]).select(
        (F.pmod(F.xxhash64("of", F.lit("held")), F.lit(4)) == 0).alias("held"), F.col("is_toxic").cast("int").alias("toxic"), F.col("tongue").alias("lang"), F.pmod(turn, F.lit(shards)).cast("int").alias("shard"), "packed", turn.alias("turn"))
    found = found.repartition(4 * shards, "shard").sortWithinPartitions("shard", "turn", "lang").drop("turn")  # more tasks than shards: few get two
    return materialize(found.mapInArrow(hashed, "held boolean, toxic int, lang string, shard int, words binary"), "labelled")


def frequent_words(rows: DataFrame, least: int, most: int) -> np.ndarray:
    """The words of at least ``least`` texts, sorted; of those the ``most`` that most texts have."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(np.frombuffer(x, "<u4")) for x in batch.column("words").to_pylist()]
            words, n = np.unique(np.concatenate([*found, np.zeros(0, "<u4")]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(words.astype(np.int64)), pa.array(n.astype(np.int64))], names=["word", "n"])

    counts = rows.select("words").mapInArrow(counted, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    kept = counts.filter(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(most).toArrow()
    return np.sort(kept.column("word").to_numpy().astype(np.uint64))


def train_toxicity(docs: DataFrame, labels: DataFrame, train: Column, dims: int = 12, filters: int = 8, min_docs: int = 3, vocabulary: int = 65_536, epochs: int = 6, steps: int = 600, batch: int = 64, rate: float = 0.01, drop: float = 0.6, seed: int = 1) -> ToxicityModel:
    """A model that learned from all rows of ``docs`` with a label that meet ``train``."""
    rows = labelled_words(docs, labels, train)
    count = {(r["held"], r["toxic"]): r["n"] for r in rows.groupBy("held", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if {y for _, y in count} != {0, 1}:
        return _unlearned(dims, filters)
    learn = held = rows
    if len(count) == 4:
        learn, held = rows.filter("NOT held"), rows.filter("held")
        count = {k: n for k, n in count.items() if not k[0]}
    total = sum(count.values())
    share = sum(n for (_, y), n in count.items() if y) / total
    model = _fresh(frequent_words(rows, min_docs, vocabulary), np.random.RandomState(seed), dims, filters, FOLD)
    passes = max(epochs, -(-steps * batch // total))  # a small table is seen more often
    rounds = 1 if learn.select("shard").distinct().count() == 1 else min(ROUNDS, passes)
    for i in range(rounds):
        model = _averaged(model, learn, share, -(-passes // rounds), batch, rate, drop, [seed, i])
    return _cut_by_counts(model, held)


def _texts(batches: Iterator[pa.RecordBatch], model: ToxicityModel) -> Iterator[tuple[int, list[np.ndarray], np.ndarray]]:
    """Runs of texts of a shard as rows of the embedding, of about ``CHUNK`` words at most, with their labels."""
    shard, texts, y, n = None, [], [], 0
    for batch in batches:
        for s, words, label in zip(batch.column("shard").to_pylist(), batch.column("words"), batch.column("toxic").to_pylist()):
            h = np.frombuffer(words.as_buffer(), "<u4").astype(np.uint64) << np.uint64(FOLD)
            if texts and (s != shard or n + len(h) > CHUNK):
                yield shard, texts, np.array(y, np.float32)
                texts, y, n = [], [], 0
            shard = s
            texts.append(model.rows_of(h).astype(np.int32))
            y.append(label)
            n += len(h)
    if texts:
        yield shard, texts, np.array(y, np.float32)


def _averaged(model: ToxicityModel, learn: DataFrame, share: float, passes: int, batch: int, rate: float, drop: float, seed: list[int]) -> ToxicityModel:
    """The mean of what shards make of ``model``: by their texts, for a word's embedding of the shards that changed it."""
    dims = model.embedding.shape[1]

    def dense(m: ToxicityModel) -> np.ndarray:
        return np.concatenate([*[w.ravel() for w in m.filters], m.bias, m.weights]).astype(np.float32)

    def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces() -> pa.RecordBatch:
            changed = state.v["embedding"].any(1) if "embedding" in state.v else np.zeros(len(own.embedding), bool)
            values = np.concatenate([changed[:, None].astype(np.float32), own.embedding], axis=1)
            at = np.unique(np.flatnonzero(changed) // PIECE)
            payload = [dense(own).tobytes(), *[values[k * PIECE : (k + 1) * PIECE].tobytes() for k in at]]
            return pa.RecordBatch.from_arrays([pa.array([-1, *at.tolist()], pa.int32()), pa.array([now] * len(payload), pa.int32()), pa.array([seen] * len(payload), pa.int64()), pa.array(payload, pa.binary())], names=["piece", "shard", "n", "payload"])

        now, seen = None, 0
        for shard, texts, y in _texts(batches, model):
            if shard != now:
                if now is not None:
                    yield pieces()
                now, seen, state, draw = shard, 0, _Adam(rate), np.random.RandomState([*seed, shard])
                own = ToxicityModel(model.vocabulary, model.embedding.copy(), [w.copy() for w in model.filters], model.bias.copy(), model.weights.copy(), 0.0, 0.5, {}, model.fold)
            weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
            for _ in range(passes):
                _pass(own, texts, y, weight, np.arange(len(y)), draw, batch, drop, state)
            seen += len(y)
        if now is not None:
            yield pieces()

    def mean(found: pa.Table) -> pa.Table:
        found = found.sort_by([("shard", "ascending"), ("n", "ascending")])
        piece, total, parts = found.column("piece")[0].as_py(), 0.0, 0.0
        for n, payload in zip(found.column("n").to_pylist(), found.column("payload")):
            x = np.frombuffer(payload.as_buffer(), np.float32).astype(np.float64)
            x = x.reshape(-1, 1 + dims) if piece >= 0 else x
            by = x[:, :1] if piece >= 0 else float(n)
            total, parts = total + by, parts + by * x
        return pa.table({"piece": pa.array([piece], pa.int32()), "payload": pa.array([(parts / np.maximum(total, 1e-9)).astype(np.float32).tobytes()], pa.binary())})

    found = learn.select("shard", "toxic", "words").mapInArrow(trained, "piece int, shard int, n long, payload binary")
    new = ToxicityModel(model.vocabulary, model.embedding.copy(), [], model.bias, model.weights, 0.0, 0.5, {}, model.fold)
    for r in found.groupBy("piece").applyInArrow(mean, "piece int, payload binary").collect():
        x = np.frombuffer(r["payload"], np.float32)
        if r["piece"] < 0:
            ends = np.cumsum([w.size for w in model.filters] + [model.bias.size])
            *parts, new.bias, new.weights = [p.copy() for p in np.split(x, ends)]
            new.filters = [p.reshape(w.shape) for p, w in zip(parts, model.filters)]
        else:
            x = x.reshape(-1, 1 + dims)
            at = r["piece"] * PIECE + np.flatnonzero(x[:, 0])
            new.embedding[at] = x[x[:, 0] > 0, 1:]
    return new


def _cut_by_counts(model: ToxicityModel, held: DataFrame, least: int = 20) -> ToxicityModel:
    """The cuts with the best F1, for all and by language, from counts of all held-out logits in steps of 1 / GRID."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spots = []
            for _, texts, _ in _texts(iter([batch]), model):
                first = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
                spots += [model.logits(np.concatenate(some), f) for some, f in _parts(texts, first)]
            spot = np.floor(np.clip(np.concatenate([*spots, np.zeros(0)]).astype(np.float64), -30, 30) * GRID).astype(np.int64)
            rows = pa.table({"lang": batch.column("lang"), "spot": pa.array(spot), "hit": batch.column("toxic").cast(pa.int64())})
            yield from rows.group_by(["lang", "spot"]).aggregate([("hit", "sum"), ("hit", "count")]).rename_columns(["lang", "spot", "hits", "n"]).to_batches()

    found = held.select("shard", "toxic", "words", "lang").mapInArrow(counted, "lang string, spot long, hits long, n long")
    found = found.groupBy("lang", "spot").agg(F.sum("hits").alias("hits"), F.sum("n").alias("n"))
    found = found.select(F.explode(F.array(F.struct(F.lit(True).alias("every"), F.lit(None).cast("string").alias("lang")), F.struct(F.lit(False).alias("every"), F.col("lang").alias("lang")))).alias("of"), "spot", "hits", "n")
    found = found.groupBy("of", "spot").agg(F.sum("hits").alias("hits"), F.sum("n").alias("n"))
    fall, whole = Window.partitionBy("of").orderBy(F.desc("spot")), Window.partitionBy("of")
    f1 = 2 * F.sum("hits").over(fall) / (F.sum("n").over(fall) + F.sum("hits").over(whole))
    found = found.select("of", "hits", "n", F.struct(f1.alias("f1"), "spot", F.lead("spot").over(fall).alias("below")).alias("cut"))
    found = found.groupBy("of").agg(F.max("cut").alias("cut"), F.sum("hits").alias("hits"), F.sum("n").alias("n"))
    found = found.filter(F.col("of.every") | F.col("of.lang").isNotNull() & (F.col("hits") >= least) & (F.col("hits") < F.col("n"))).collect()

    def logit(cut) -> float:
        """In the middle of the gap between the lowest step taken and the next one."""
        return (cut["spot"] + cut["below"] + 1) / 2 / GRID if cut["below"] is not None else cut["spot"] / GRID - 1

    cuts = {r["of"]["lang"]: logit(r["cut"]) for r in found}
    model.shift = -cuts.pop(None)
    model.thresholds = {k: float(_sigmoid(np.array([c + model.shift]))[0]) for k, c in cuts.items()}
    return model


def _spread(i: int) -> int:
    return (i * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 40


class _Adam:
    def __init__(self, rate: float):
        self.rate, self.t, self.m, self.v = rate, 0, {}, {}

    def update(self, key: str, value: np.ndarray, gradient: np.ndarray, rows: np.ndarray | None = None) -> None:
        """One Adam step; of an embedding only the rows that have a gradient."""
        m, v = self.m.setdefault(key, np.zeros_like(value)), self.v.setdefault(key, np.zeros_like(value))
        at = slice(None) if rows is None else rows
        m[at] = 0.9 * m[at] + 0.1 * gradient
        v[at] = 0.99 * v[at] + 0.01 * gradient * gradient
        value[at] -= self.rate * (m[at] / (1 - 0.9 ** self.t)) / (np.sqrt(v[at] / (1 - 0.99 ** self.t)) + 1e-7)


def _step(model: ToxicityModel, texts: list[np.ndarray], y: np.ndarray, weight: np.ndarray, state: _Adam) -> None:
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    rows = np.concatenate(texts) if texts else np.zeros(0, np.int64)
    n, filters = len(texts), model.filters[0].shape[2]
    pooled, best = model.strongest(rows, first)
    hidden = np.maximum(pooled + model.bias, 0)
    error = ((_sigmoid(hidden @ model.weights[:-1] + model.weights[-1]) - y) * weight / n).astype(np.float32)
    back = error[:, None] * model.weights[:-1] * (hidden > 0)
    state.t += 1
    old = [w.copy() for w in model.filters]
    state.update("weights", model.weights, np.append(error @ hidden, error.sum()).astype(np.float32) + 1e-4 * model.weights)
    state.update("bias", model.bias, back.sum(0))
    touched, pull = [], []
    for k, w in enumerate(old):
        g = back[:, k * filters : (k + 1) * filters]
        grown = np.zeros_like(w)
        doc, f = np.nonzero((best[k] >= 0) & (g != 0))
        at = best[k][doc, f]
        for j in range(len(w)):
            inside = at + j < first[doc + 1]
            r = rows[at[inside] + j]
            d, c = doc[inside], f[inside]
            np.add.at(grown[j].T, c, g[d, c][:, None] * model.embedding[r])
            touched.append(r)
            pull.append(g[d, c][:, None] * w[j][:, c].T)
        state.update(f"filters{k}", model.filters[k], grown)
    r = np.concatenate(touched) if touched else np.zeros(0, np.int64)
    known = r > 0
    if known.any():
        some, where = np.unique(r[known], return_inverse=True)
        total = np.zeros((len(some), model.embedding.shape[1]), np.float32)
        np.add.at(total, where, np.concatenate(pull)[known])
        state.update("embedding", model.embedding, total, some)


def _cut(logits: np.ndarray, y: np.ndarray) -> float:
    """The logit with the best F1, in the middle of its gap."""
    order = np.argsort(-logits, kind="stable")
    s, hit = logits[order], np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(len(s)) + 1 + y.sum())
    f1[:-1][s[:-1] == s[1:]] = -1
    i = int(f1.argmax())
    return float((s[i] + s[i + 1]) / 2 if i + 1 < len(s) else s[i] - 1)


def _calibrated(model: ToxicityModel, rows: list, y: np.ndarray, lang: list, held: np.ndarray, least: int = 20) -> ToxicityModel:
    first = np.concatenate([[0], np.cumsum([len(rows[i]) for i in held])]).astype(np.int64)
    logits = np.concatenate([model.logits(np.concatenate(rows_), f) for rows_, f in _parts([rows[i] for i in held], first)]).astype(np.float64)
    model.shift = -_cut(logits, y[held])
    by: dict = {}
    for i, k in enumerate(held.tolist()):
        by.setdefault(lang[k], []).append(i)
    for name, at in by.items():
        if name is not None and least <= y[held[at]].sum() < len(at):
            model.thresholds[name] = float(_sigmoid(np.array([_cut(logits[at], y[held[at]]) + model.shift]))[0])
    return model


def _parts(rows: list[np.ndarray], first: np.ndarray, size: int = 200) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    for a in range(0, len(rows), size):
        part = rows[a : a + size]
        yield part, (first[a : a + len(part) + 1] - first[a]).astype(np.int64)


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, score, threshold, rejected) of each row of ``docs(doc_id, text, lang)``."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = batch.column("lang").to_pylist()
            for low, high, data, offsets in text_slices(batch.column("text")):
                found = model.scores(data, offsets)
                limit = np.array([model.thresholds.get(x, model.common) for x in lang[low:high]])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(low, high - low), pa.array(found), pa.array(limit), pa.array(found >= limit)], names=["doc_id", "score", "threshold", "rejected"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    return rows.mapInArrow(score, "doc_id long, score double, threshold double, rejected boolean")


def drop_toxic(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows of ``docs`` that their language's threshold does not reject, in one pass."""
    names = docs.columns

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = batch.column(names.index("lang")).to_pylist()
            for low, high, data, offsets in text_slices(batch.column(names.index("text"))):
                limit = np.array([model.thresholds.get(x, model.common) for x in lang[low:high]])
                yield batch.slice(low, high - low).filter(pa.array(model.scores(data, offsets) < limit))

    return docs.mapInArrow(keep, docs.schema)
