"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text's letter runs (lower case, with word marks) are cut into character
n-grams, each hashed to a row of an embedding table; the rows are averaged and
a linear layer gives one logit per language. Table and layer are trained by
stochastic gradient descent in numpy on a bounded sample of labelled rows; a
temperature and a rejection threshold are then calibrated on rows of the
sample kept out of training.

Since averaging and the layer are linear, a word's share of the logits is a
constant, kept per worker; a prediction is a sum over the words of the whole
text. The work on documents is a map without a shuffle.

Defined results: a null text or one without a letter is ``und`` with score 0
and not accepted; rows with a null label are not learned from; with no usable
label every text is ``und``; equal rows get equal results.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sectorscope.llm.common import letter_runs, map_batches, row_struct, with_fields

UNDEFINED = "und"
_MUL = np.uint64(0x9E3779B97F4A7C15)
_GROUP = 1 << 20


@dataclass(frozen=True)
class LangIdConfig:
    per_language: int = 800         # rows of one language in the sample, at most
    sample_rows: int = 6_400        # rows of the sample; with many languages each has its share, one row at least
    buckets: int = 1 << 14
    dim: int = 16
    min_gram: int = 2
    max_gram: int = 4
    epochs: int = 4
    rate: float = 0.5
    held: float = 0.2               # share of the sample kept for calibration
    accept_precision: float = 0.99  # wanted accuracy among accepted texts
    word_limit: int = 400_000       # words remembered per worker
    sample_tasks: int = 16          # tasks that read the sample
    seed: int = 7


def subwords(words: list[str], cfg: LangIdConfig) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of the marked words: buckets, in order of the words, and how many each word has."""
    points = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    word = np.repeat(np.arange(len(words)), size)
    buckets, owners = [], []
    for k in range(cfg.min_gram, cfg.max_gram + 1):
        n = max(0, len(points) - k + 1)
        h = np.full(n, k, np.uint64)
        for j in range(k):
            h = (h ^ points[j:j + n]) * _MUL
            h ^= h >> np.uint64(29)
        whole = word[:n] == word[k - 1:k - 1 + n]
        buckets.append((h[whole] % np.uint64(cfg.buckets)).astype(np.int64))
        owners.append(word[:n][whole])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(buckets)[order], np.bincount(owner, minlength=len(words))


def bag(text: str | None, cfg: LangIdConfig) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a whole text and their shares."""
    words: dict[str, int] = {}
    for w in letter_runs((text or "").lower()):
        words[w] = words.get(w, 0) + 1
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    buckets, sizes = subwords(list(words), cfg)
    times = np.repeat(np.fromiter(words.values(), np.float64, len(words)), sizes)
    count = np.bincount(buckets, times, cfg.buckets)
    found = np.flatnonzero(count)
    return found.astype(np.int32), (count[found] / times.sum()).astype(np.float32)


@dataclass
class LangModel:
    languages: list[str]
    table: np.ndarray = field(repr=False)   # bucket -> logits (embedding times layer)
    bias: np.ndarray = field(repr=False)
    temperature: float
    threshold: float
    held_accuracy: float


def sample_labelled(docs: DataFrame, text_col: str, lang_col: str, id_col: str, cfg: LangIdConfig) -> DataFrame:
    """``lang`` and ``text`` of the sample: of every language the rows of smallest hash of id and text, as many as its bound."""
    rows = docs.where(F.col(f"`{lang_col}`").isNotNull()).select(
        F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"),
        F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"), F.lit(cfg.seed)).alias("draw"))
    languages = rows.select("lang").distinct().count()
    most = max(1, min(cfg.per_language, cfg.sample_rows // max(1, languages)))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("draw"))
    # first over the hashes alone: the largest one that each language needs
    last = (rows.select("lang", "draw").withColumn("rank", rank).where(F.col("rank") <= most)
            .groupBy("lang").agg(F.max("draw").alias("last")).collect())
    chosen: Column = F.lit(False)
    for r in last:
        chosen = chosen | ((F.col("lang") == r["lang"]) & (F.col("draw") <= r["last"]))
    # then over the chosen rows: equal ones beyond the bound go
    return rows.where(chosen).withColumn("rank", rank).where(F.col("rank") <= most).select("lang", "text")


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
          cfg: LangIdConfig = LangIdConfig()) -> LangModel:
    """Fit on ``docs`` (labelled rows only; the caller has left out the held-out ones)."""
    rows = sample_labelled(docs, text_col, lang_col, id_col, cfg).repartition(cfg.sample_tasks)

    def run(batch: dict[str, list]) -> dict[str, list]:
        bags = [bag(t, cfg) for t in batch["text"]]
        return {"lang": batch["lang"], "ids": [b[0].tobytes() for b in bags], "shares": [b[1].tobytes() for b in bags]}

    sample = [r for r in map_batches(rows, run, "lang string, ids binary, shares binary").collect() if r["ids"]]
    # a fixed order, whatever order the tasks ended in
    sample.sort(key=lambda r: (zlib.crc32(r["ids"]), r["lang"]))
    return fit([(r["lang"], np.frombuffer(r["ids"], np.int32), np.frombuffer(r["shares"], np.float32)) for r in sample], cfg)


def fit(sample: list[tuple[str, np.ndarray, np.ndarray]], cfg: LangIdConfig = LangIdConfig()) -> LangModel:
    rng = np.random.default_rng(cfg.seed)
    languages = sorted({s[0] for s in sample})
    number = {name: i for i, name in enumerate(languages)}
    k = len(languages)
    if not k:
        return LangModel([], np.zeros((cfg.buckets, 0), np.float32), np.zeros(0), 1.0, 0.0, 0.0)
    held = rng.random(len(sample)) < cfg.held
    if held.all() or len(sample) < 10:
        held[:] = False
    emb = rng.normal(0, 0.1, (cfg.buckets, cfg.dim)).astype(np.float32)
    layer = np.zeros((cfg.dim, k), np.float32)
    layer[np.arange(cfg.dim), np.arange(cfg.dim) % k] = 1.0
    bias = np.zeros(k, np.float32)
    order = np.flatnonzero(~held)
    steps, step = cfg.epochs * max(1, len(order)), 0
    for _ in range(cfg.epochs):
        rng.shuffle(order)
        for s in order:
            name, ids, shares = sample[s]
            mean = shares @ emb[ids]
            p = _softmax(mean @ layer + bias)
            p[number[name]] -= 1.0
            rate = np.float32(cfg.rate * (1 - step / steps))
            back = layer @ p
            layer -= rate * np.outer(mean, p)
            bias -= rate * 0.1 * p
            # a mean over many subwords moves each by little: scaled so that the step on the mean is the rate
            scale = rate / max(float(shares @ shares), 1e-6)
            emb[ids] -= np.float32(min(scale, 200.0)) * shares[:, None] * back
            step += 1
    table = emb @ layer
    check = np.flatnonzero(held) if held.any() else np.arange(len(sample))
    logits = np.array([sample[s][2] @ table[sample[s][1]] + bias for s in check], np.float64)
    truth = np.array([number[sample[s][0]] for s in check])
    temperature, threshold, accuracy = calibrate(logits, truth, cfg.accept_precision)
    return LangModel(languages, table.astype(np.float32), bias.astype(np.float64), temperature, threshold, accuracy)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def calibrate(logits: np.ndarray, truth: np.ndarray, precision: float) -> tuple[float, float, float]:
    """Temperature of least log loss; the lowest score at which accepted texts reach ``precision``; plain accuracy."""
    def loss(t: float) -> float:
        return -np.log(np.maximum(_softmax(logits / t)[np.arange(len(truth)), truth], 1e-12)).mean()

    temperature = min(np.geomspace(0.25, 8, 60), key=loss)
    p = _softmax(logits / temperature)
    right = p.argmax(axis=1) == truth
    score = p.max(axis=1)
    order = np.argsort(-score, kind="stable")
    share = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(share >= precision)
    threshold = float(score[order[good[-1]]]) if len(good) else 1.0
    return float(temperature), threshold, float(right.mean())


class _Words(dict):
    """Word -> row of the running table of (logit sums, subword count); cleared when full."""

    def __init__(self, model: LangModel, cfg: LangIdConfig):
        super().__init__()
        self.model, self.cfg = model, cfg
        self.rows = np.zeros((1024, len(model.languages) + 1))

    def learn(self, texts: list[list[str]]) -> None:
        """Make every word of ``texts`` known."""
        new = list(dict.fromkeys(w for words in texts for w in words if w not in self))
        if len(self) + len(new) > min(self.cfg.word_limit, 20_000_000 // self.rows.shape[1]):
            self.clear()
            new = list(dict.fromkeys(w for words in texts for w in words))
        if not new:
            return
        at = len(self)
        while len(self.rows) < at + len(new):
            self.rows = np.concatenate((self.rows, np.zeros_like(self.rows)))
        buckets, sizes = subwords(new, self.cfg)
        starts = np.cumsum(sizes) - sizes
        self.rows[at:at + len(new), :-1] = np.add.reduceat(self.model.table[buckets].astype(np.float64), starts, axis=0)
        self.rows[at:at + len(new), -1] = sizes
        self.update(zip(new, range(at, at + len(new))))

    def logits(self, words: list[str]) -> np.ndarray:
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        total = np.zeros(self.rows.shape[1])
        for i in range(0, len(at), 1 << 16):
            total += self.rows[at[i:i + (1 << 16)]].sum(axis=0)
        return total[:-1] / total[-1] + self.model.bias


def _groups(texts: list[str | None]) -> Iterator[list[list[str]]]:
    """The letter runs of the texts, in groups of about a million characters; a longer text is a group by itself."""
    group: list[list[str]] = []
    size = 0
    for text in texts:
        if group and size + len(text or "") > _GROUP:
            yield group
            group, size = [], 0
        group.append(letter_runs(text.lower()) if text else [])
        size += len(text or "")
    yield group


def predict(docs: DataFrame, model: LangModel, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",),
            cfg: LangIdConfig = LangIdConfig()) -> DataFrame:
    """One row per input row: ``row`` (struct of ``carry``), ``lang_pred``, ``score``, ``accepted``."""
    packed = docs.select(row_struct(carry), F.col(f"`{text_col}`").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    memo: dict[int, _Words] = {}

    def run(batch: dict[str, list]) -> dict[str, list]:
        m = shared.value
        table = memo.setdefault(0, _Words(m, cfg))
        names, scores = [], []
        for group in _groups(batch["text"]):
            if m.languages:
                table.learn(group)
            for words in group:
                if not words or not m.languages:
                    names.append(UNDEFINED)
                    scores.append(0.0)
                    continue
                p = _softmax(table.logits(words) / m.temperature)
                best = int(p.argmax())
                names.append(m.languages[best])
                scores.append(float(p[best]))
        return {"row": batch["row"], "lang_pred": names, "score": scores,
                "accepted": [n != UNDEFINED and s >= m.threshold for n, s in zip(names, scores)]}

    return map_batches(packed, run, with_fields(packed, "row", "lang_pred string, score double, accepted boolean"))
