"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages (runs of ``passage_words`` words). Each passage
is encoded by the shapes of its words (hashed) and a few style measures, mapped
to a hidden vector; a gated attention (a tanh unit times a sigmoid unit) gives
each passage a weight, and the weighted sum of the passage vectors is scored by
a logistic unit. Only document labels are used; which passages make a document
bad is learned by the attention. Training is plain numpy (Adam) on a bounded
sample of labelled documents; scoring is a map over whole texts.

Defined results: a null, empty or blank text is one passage of zeros and gets
that bag's score; null labels are not learned from; without a label of both
kinds the score is 0.5 for all; equal texts get equal scores.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sectorscope.llm.common import as_bytes, map_batches, row_struct, with_fields


@dataclass(frozen=True)
class MilConfig:
    sample: int = 3000              # labelled documents fitted on (about), with all their passages
    passage_words: int = 64
    shapes: int = 256
    hidden: int = 24
    attention: int = 12
    epochs: int = 30
    batch: int = 64
    rate: float = 0.01
    decay: float = 1e-4
    piece: int = 64                 # longer words are cut into pieces of so many bytes, each a word
    shape_limit: int = 300_000      # words remembered per worker
    seed: int = 11


#: Style measures per word, summed over a passage.
_STYLE = 6


def word_shape(word: bytes) -> str:
    """Runs of capitals, small letters and digits as one sign each; other characters stay."""
    out = []
    for c in word.decode("utf-8", "replace"):
        kind = "9" if c.isdigit() else ("X" if c.isupper() else "x") if c.isalpha() else c
        if not out or out[-1] != kind or not (c.isalnum()):
            out.append(kind)
    return "".join(out)


class Shapes(dict):
    """Word -> number of its features' row; rows hold shape bucket and style measures; cleared when full."""

    def __init__(self, cfg: MilConfig):
        super().__init__()
        self.cfg = cfg
        self.bucket = np.zeros(1024, np.int64)
        self.style = np.zeros((1024, _STYLE), np.float32)

    def __missing__(self, word: bytes) -> int:
        k = len(self)
        if k == len(self.bucket):
            self.bucket = np.concatenate((self.bucket, np.zeros_like(self.bucket)))
            self.style = np.concatenate((self.style, np.zeros_like(self.style)))
        shape = word_shape(word)
        self.bucket[k] = zlib.crc32(shape.encode()) % self.cfg.shapes
        text = word.decode("utf-8", "replace")
        letters = sum(map(str.isalpha, text))
        self.style[k] = (len(text) / 10, letters / len(text), sum(map(str.isupper, text)) / len(text),
                         sum(map(str.isdigit, text)) / len(text), len(text) - letters > 1, letters == 0)
        self[word] = k
        return k


def words_of(raw: bytes | None, piece: int) -> list[bytes]:
    """The words of a text, long ones in pieces (cut between bytes)."""
    words = [] if raw is None else raw.split()
    if words and len(max(words, key=len)) > piece:
        words = [w[i:i + piece] for w in words for i in range(0, len(w), piece)]
    return words


def encode_passages(raw: bytes | None, shapes: Shapes) -> np.ndarray:
    """One row per passage of the whole text: shape shares, mean style, and three measures of repetition."""
    cfg = shapes.cfg
    words = words_of(raw, cfg.piece)
    if not words:
        return np.zeros((1, cfg.shapes + _STYLE + 3), np.float32)
    if len(shapes) > cfg.shape_limit:
        shapes.clear()
    at = np.fromiter(map(shapes.__getitem__, words), np.int64, len(words))
    n = -(-len(words) // cfg.passage_words)
    passage = np.arange(len(words)) // cfg.passage_words
    size = np.bincount(passage, minlength=n).astype(np.float32)[:, None]
    shape = np.bincount(passage * cfg.shapes + shapes.bucket[at], minlength=n * cfg.shapes).reshape(n, cfg.shapes)
    starts = np.arange(n) * cfg.passage_words
    style = np.add.reduceat(shapes.style[at], starts, axis=0)
    # repeated word pairs: inside the text, and at what distance from the start they were seen
    _, first, code = np.unique(at[:-1] * (at.max() + 1) + at[1:], return_index=True, return_inverse=True)
    again = np.zeros(len(words), np.float32)
    again[:-1] = first[code] < np.arange(len(words) - 1)
    repeat = np.add.reduceat(again, starts)[:, None]
    extra = np.concatenate((repeat / size, np.minimum(size, cfg.passage_words) / cfg.passage_words,
                            np.full((n, 1), again.mean(), np.float32)), axis=1)
    return np.concatenate((4 * shape / size, style / size, extra), axis=1).astype(np.float32)


@dataclass
class MilModel:
    """Weights: passage layer V, attention A (tanh) and G (sigmoid) with w, output c; prior if nothing was learned."""

    weights: dict[str, np.ndarray]
    learned: bool

    def score(self, bags: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Score of each bag, and its attention weights."""
        if not self.learned:
            return np.full(len(bags), 0.5), [np.full(len(b), 1 / len(b)) for b in bags]
        z, state = _forward(self.weights, np.concatenate(bags), _bounds(bags))
        return 1 / (1 + np.exp(-z)), np.split(state["a"], _bounds(bags)[1:])


def _bounds(bags: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(([0], np.cumsum([len(b) for b in bags])[:-1])).astype(np.int64)


def _forward(w: dict[str, np.ndarray], x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, dict]:
    bag = np.zeros(len(x), np.int64)
    bag[starts[1:]] = 1
    bag = np.cumsum(bag)
    h = np.tanh(((x - w["mean"]) / w["scale"]) @ w["V"] + w["v0"])
    t, s = np.tanh(h @ w["A"]), 1 / (1 + np.exp(-(h @ w["G"])))
    e = (t * s) @ w["w"]
    e = np.exp(e - np.maximum.reduceat(e, starts)[bag])
    a = e / np.add.reduceat(e, starts)[bag]
    m = np.add.reduceat(a[:, None] * h, starts, axis=0)
    return m @ w["c"] + w["c0"][0], {"bag": bag, "h": h, "t": t, "s": s, "a": a, "m": m}


def _gradients(w: dict, x: np.ndarray, starts: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    z, f = _forward(w, x, starts)
    dz = (1 / (1 + np.exp(-z)) - y) * weight / len(y)
    bag, h, t, s, a = f["bag"], f["h"], f["t"], f["s"], f["a"]
    dm = dz[:, None] * w["c"]
    dh = a[:, None] * dm[bag]
    da = (h * dm[bag]).sum(axis=1)
    de = a * (da - np.add.reduceat(a * da, starts)[bag])
    dts = de[:, None] * w["w"]
    dt, ds = dts * s * (1 - t * t), dts * t * s * (1 - s)
    dh = dh + dt @ w["A"].T + ds @ w["G"].T
    dv = dh * (1 - h * h)
    return {"c": f["m"].T @ dz, "c0": np.array([dz.sum()]), "w": (t * s).T @ de, "A": h.T @ dt, "G": h.T @ ds,
            "V": ((x - w["mean"]) / w["scale"]).T @ dv, "v0": dv.sum(axis=0)}


def fit(bags: list[np.ndarray], labels: np.ndarray, cfg: MilConfig = MilConfig()) -> MilModel:
    """Adam on the log loss, both labels weighted alike."""
    if len(set(labels.tolist())) < 2:
        return MilModel({}, False)
    rng = np.random.default_rng(cfg.seed)
    every = np.concatenate(bags)
    d = every.shape[1]
    w = {"mean": every.mean(axis=0), "scale": every.std(axis=0) + 0.05,
         "V": rng.normal(0, 1 / np.sqrt(d), (d, cfg.hidden)), "v0": np.zeros(cfg.hidden),
         "A": rng.normal(0, 0.3, (cfg.hidden, cfg.attention)), "G": rng.normal(0, 0.3, (cfg.hidden, cfg.attention)),
         "w": rng.normal(0, 0.3, cfg.attention), "c": rng.normal(0, 0.3, cfg.hidden), "c0": np.zeros(1)}
    share = labels.mean()
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    trained = [k for k in w if k not in ("mean", "scale")]
    m1, m2, step = {k: 0.0 for k in trained}, {k: 0.0 for k in trained}, 0
    for _ in range(cfg.epochs):
        order = rng.permutation(len(bags))
        for i in range(0, len(order), cfg.batch):
            pick = order[i:i + cfg.batch]
            part = [bags[j] for j in pick]
            g = _gradients(w, np.concatenate(part), _bounds(part), labels[pick], weight[pick])
            step += 1
            for k in trained:
                grad = g[k] + cfg.decay * w[k]
                m1[k] = 0.9 * m1[k] + 0.1 * grad
                m2[k] = 0.999 * m2[k] + 0.001 * grad * grad
                w[k] = w[k] - cfg.rate * (m1[k] / (1 - 0.9 ** step)) / (np.sqrt(m2[k] / (1 - 0.999 ** step)) + 1e-8)
    return MilModel(w, True)


def train(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id",
          label_col: str = "quality", cfg: MilConfig = MilConfig()) -> MilModel:
    """Fit on the labelled documents of ``docs`` (the caller has left out the held-out ones).

    The sample is drawn by a hash of the id, so the labels broadcast to pick it
    are bounded by it, whatever their table's size. All passages of a drawn
    document are fitted on.
    """
    known = labels.where(F.col(f"`{label_col}`").isin(0, 1) & F.col(f"`{id_col}`").isNotNull()).select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"))
    share = min(1.0, cfg.sample / max(1, known.count()))
    in_sample = F.xxhash64("id", F.lit(cfg.seed)).cast("double") / float(1 << 64) + 0.5 <= share
    drawn = known.where(in_sample)
    # one label an id (the smaller of several)
    drawn = {r["id"]: r["label"] for r in drawn.groupBy("id").agg(F.min("label").alias("label")).collect()}
    shared = docs.sparkSession.sparkContext.broadcast(drawn)

    def run(batch: dict[str, list]) -> dict[str, list]:
        wanted, shapes, ids, bags = shared.value, Shapes(cfg), [], []
        for doc, raw in zip(batch["id"], batch["raw"]):
            if doc in wanted:
                ids.append(doc)
                bags.append(zlib.compress(encode_passages(raw, shapes).tobytes(), 1))
        return {"id": ids, "bag": bags}

    packed = docs.select(F.col(f"`{id_col}`").alias("id"), as_bytes(text_col).alias("raw")).where(in_sample)
    # at most one text an id, and no more rows than ids
    rows = (map_batches(packed, run, with_fields(packed, "id", "bag binary")).groupBy("id")
            .agg(F.min("bag").alias("bag")).collect())
    rows.sort(key=lambda r: zlib.crc32(str(r["id"]).encode()))
    width = cfg.shapes + _STYLE + 3
    bags = [np.frombuffer(zlib.decompress(r["bag"]), np.float32).reshape(-1, width) for r in rows]
    return fit(bags, np.array([drawn[r["id"]] for r in rows], float), cfg)


def score(docs: DataFrame, model: MilModel, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",),
          cfg: MilConfig = MilConfig()) -> DataFrame:
    """One row per input row: ``row`` (struct of ``carry``), ``score``, ``n_passages``, ``top_weight``.

    ``top_weight`` is the largest attention weight of a passage.
    """
    packed = docs.select(row_struct(carry), as_bytes(text_col).alias("raw"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    memo: dict[int, Shapes] = {}

    def run(batch: dict[str, list]) -> dict[str, list]:
        shapes = memo.setdefault(0, Shapes(cfg))
        scores, sizes, weights = [], [], []
        for raw in batch["raw"]:
            passages = encode_passages(raw, shapes)
            value, attention = shared.value.score([passages])
            scores.append(float(value[0]))
            sizes.append(len(passages))
            weights.append(float(attention[0].max()))
        return {"row": batch["row"], "score": scores, "n_passages": sizes, "top_weight": weights}

    return map_batches(packed, run, with_fields(packed, "row", "score double, n_passages int, top_weight double"))
