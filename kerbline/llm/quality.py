"""Quality classifier: a factorisation machine over hashed words and structure statistics.

Pairwise interactions have rank RANK and are summed in linear time by
sum_{i<j} <v_i, v_j> x_i x_j = 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2).
It is fitted on at most SAMPLE labelled rows, those of smallest hash; texts are read whole. Null and empty texts are scored
like any other (all word features absent); labels that are null or not 0 or 1 are left out; repeated labels of a document count
once (the largest); without any label every score is 0.5. Repeated documents get equal scores; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: The bound of the sample that the model is fitted on.
SAMPLE = 4000
WORDS, BINS, RANK, EPOCHS, RATE, CUT = 1 << 15, 8, 8, 8, 0.05, 0.3

_KINDS = {k: re.compile(p) for k, p in {"digit": rb"[0-9]+", "sign": rb"[!-/:-@\[-`{-~]+", "double": rb"[#$%&*+=|~^]{2,}", "bar": rb" [|] ", "upper": rb"[A-Z]+", "line": rb"\n+", "stop": rb"[.!?](?:\s|$)"}.items()}
N_STATS = 16


def statistics(raw: bytes, words: list[bytes], counts: Counter) -> list[float]:
    """Structure of one text: lengths, shares of kinds of characters, repetition."""
    n, w = max(1, len(raw)), max(1, len(words))
    found = {k: rx.findall(raw) for k, rx in _KINDS.items()}
    share = [sum(map(len, found[k])) / n for k in ("digit", "sign", "double", "upper")]
    top = counts.most_common(2)
    repeats = sum(a == b for a, b in zip(words, words[1:])) / w
    lines = raw.split(b"\n")
    return [
        np.log1p(len(raw)), np.log1p(len(words)), *share, len(found["bar"]) / w, len(found["line"]) / w, len(found["stop"]) / w,
        sum(map(len, words)) / w, len(counts) / w, (top[0][1] if top else 0) / w, repeats,
        1 - len(set(lines)) / max(1, len(lines)), sum(v for v in counts.values() if v > 3) / w, max(map(len, words), default=0) / n,
    ]


def _buckets() -> common.Recent:
    return common.Recent(lambda word: xxhash.xxh3_64_intdigest(word) % WORDS, 1 << 16)


def features(text: str) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Word buckets, their values (square roots of counts, of unit length), statistics."""
    raw = text.encode()
    words = raw.split()
    counts = Counter(words)
    buckets, inverse = np.unique(np.fromiter(map(common.lasting(__name__, _buckets).__getitem__, counts), np.int32, len(counts)), return_inverse=True)
    ids = buckets.astype(np.int32)
    x = np.sqrt(np.bincount(inverse, np.fromiter(counts.values(), np.float64, len(counts)), len(ids))).astype(np.float32)
    return ids, x / max(1e-9, float(np.sqrt((x * x).sum()))), statistics(raw, words, counts)


@dataclass
class Machine:
    edges: np.ndarray  # quantiles of each statistic
    mean: np.ndarray
    spread: np.ndarray
    bias: float
    w: np.ndarray
    v: np.ndarray

    def columns(self, parts: list[tuple[np.ndarray, np.ndarray, list[float]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids and values of all rows end to end, and where each row starts: words, bins of statistics, statistics."""
        stats = np.array([p[2] for p in parts], np.float64).reshape(len(parts), N_STATS)
        bins = np.array([(stats[:, k, None] > self.edges[k]).sum(1) for k in range(N_STATS)]).T
        bin_ids = (WORDS + np.arange(N_STATS) * BINS + bins).astype(np.int32)
        plain = np.clip((stats - self.mean) / self.spread, -3, 3) / 3
        more = np.concatenate([bin_ids, np.tile(np.arange(N_STATS, dtype=np.int32) + WORDS + N_STATS * BINS, (len(parts), 1))], 1)
        values = np.concatenate([np.full(bin_ids.shape, 0.5), plain], 1).astype(np.float32)
        ids = np.concatenate([x for p, m in zip(parts, more) for x in (p[0], m)])
        xs = np.concatenate([x for p, m in zip(parts, values) for x in (p[1], m)])
        return ids, xs, np.concatenate([[0], np.cumsum([len(p[0]) + more.shape[1] for p in parts])])[:-1]

    def raw(self, ids: np.ndarray, xs: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        vx = self.v[ids] * xs[:, None]
        s = np.add.reduceat(vx, starts, axis=0)
        return self.bias + np.add.reduceat(self.w[ids] * xs, starts) + 0.5 * ((s * s).sum(1) - np.add.reduceat((vx * vx).sum(1), starts)), s

    def score(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        out = self.raw(*self.columns([features(t) for t in texts]))[0]
        return 1 / (1 + np.exp(-np.clip(out.astype(np.float64), -30, 30)))


def fit(rows: list[tuple[str, int]], seed: int = 7) -> Machine:
    """AdaGrad on the logistic loss."""
    parts = [features(t) for t, _ in rows]
    y = np.array([q for _, q in rows], np.float32)
    stats = np.array([p[2] for p in parts], np.float64).reshape(-1, N_STATS)
    rng, size = np.random.default_rng(seed), WORDS + N_STATS * (BINS + 1)
    some = stats if len(stats) else np.zeros((1, N_STATS))
    m = Machine(np.quantile(some, np.arange(1, BINS) / BINS, axis=0).T, some.mean(0), some.std(0) + 1e-6, 0.0, np.zeros(size, np.float32), rng.normal(0, 0.05, (size, RANK)).astype(np.float32))
    if not rows:
        m.v[:] = 0
        return m
    share = float(np.clip(y.mean(), 0.02, 0.98))
    m.bias = float(np.log(share / (1 - share)))
    gw, gv = np.full(size, 1e-3, np.float32), np.full((size, RANK), 1e-3, np.float32)
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 64):
            mine = order[at : at + 64]
            ids, xs, starts = m.columns([parts[i] for i in mine])
            out, s = m.raw(ids, xs, starts)
            err = (1 / (1 + np.exp(-np.clip(out, -30, 30))) - y[mine]) / len(mine)
            row = np.repeat(np.arange(len(mine)), np.diff(np.append(starts, len(ids))))
            g = (err[row] * xs).astype(np.float32)
            u, inverse = np.unique(ids, return_inverse=True)
            dw = np.bincount(inverse, g, len(u)).astype(np.float32) + 1e-6 * m.w[u]
            each = g[:, None] * (s[row] - m.v[ids] * xs[:, None])
            dv = np.stack([np.bincount(inverse, each[:, f], len(u)) for f in range(RANK)], 1).astype(np.float32) + 1e-6 * m.v[u]
            gw[u] += dw * dw
            gv[u] += dv * dv
            m.w[u] -= 4 * RATE * dw / np.sqrt(gw[u])
            m.v[u] -= RATE * dv / np.sqrt(gv[u])
            m.bias -= RATE * float(err.sum())
    return m


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """Fit on the labelled rows of smallest hash that are not held out; at most `sample` texts come to the driver. Of rows that share an id the
    text of smallest hash is taken."""
    known = labels.where("doc_id is not null and quality in (0, 1)").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("q"))
    ids = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    one = F.min(F.struct(F.xxhash64("text").alias("h"), F.coalesce("text", F.lit("")).alias("text"), "q"))  # of rows that share an id always the same
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(one.alias("x")).select("doc_id", "x.text", "x.q").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    model = fit([(r["text"] or "", r["q"]) for r in rows.select("text", "q").collect()])
    common.serves("")  # the driver needs the buckets no more
    common.release()
    return model


def score(docs: DataFrame, model: Machine, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = [model.score(t[k : k + 64]) for t in (common.texts_of(batch.column("text")),) for k in range(0, len(t), 64)]
            s = np.concatenate(out) if out else np.zeros(0)
            cols = [batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= cut).astype(np.int32))]
            return pa.RecordBatch.from_arrays(cols, names=["doc_id", "held_out", "score", "predicted"])

        return step

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return common.map_batches(rows, "text", make, "doc_id bigint, held_out boolean, score double, predicted int")


def op5_quality(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return score(docs, train(docs, common.table(spark, sf_dir, "labels")))


def keep_good(docs: DataFrame, model: Machine, cut: float = CUT) -> DataFrame:
    """The rows of `docs`, all columns, whose text scores at least `cut`; only texts go to Python."""

    @F.arrow_udf("double")
    def scored(text: pa.Array) -> pa.Array:
        out = [model.score(common.texts_of(part.slice(k, 64))) for _, part in common.parts(text) for k in range(0, len(part), 64)]
        common.release()
        return pa.array(np.concatenate(out) if out else np.zeros(0))

    return docs.where(scored("text") >= cut)
