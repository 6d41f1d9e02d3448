"""Compression classifier of text quality (operator 2).

Two zstandard dictionaries are built from blocks of labelled good and bad text. A text is cut into blocks of whole BLOCK
bytes, so that a dictionary keeps its weight in long texts, and each block is compressed under either dictionary. The
two sizes' difference over the block's length, taken over the whole text and as the least of its blocks, is all that a
score depends on; a logistic curve fitted on labelled texts that built no dictionary turns it into a probability.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import _M1, U64, checkpoint, kept_columns, mix, slices, spread, text_bytes

BLOCK = 1024
LEVEL = 6
SAMPLE_BLOCKS = 1500  # blocks of each class in a dictionary: a sample, by hash, of all blocks of its labelled texts
SAMPLE_TEXTS = 2000  # labelled texts of each class, about, that calibrate: a sample, by hash, of those that build no dictionary
MARGIN = 1.25  # drawn over the wanted number, so that a draw by hash holds enough
RIDGE = 1e-3
THRESHOLD = 0.7


def block_counts(sizes: np.ndarray) -> np.ndarray:
    """Blocks of a text of so many bytes; a short rest joins the last block."""
    return np.maximum(1, sizes // BLOCK)


def blocks(raw: bytes) -> list[bytes]:
    n = max(1, len(raw) // BLOCK)
    return [raw[k * BLOCK : (k + 1) * BLOCK if k < n - 1 else len(raw)] for k in range(n)]


class Compressors:
    def __init__(self, good: bytes, bad: bytes):
        make = lambda d: zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_dict_id=False)
        self.good, self.bad = make(good), make(bad)

    def differences(self, raw: bytes) -> tuple[float, float]:
        """Bytes that the good dictionary saves over the bad one, per byte of text: over all blocks, and in the worst block."""
        parts = blocks(raw)
        saved = np.array([len(self.bad.compress(c)) - len(self.good.compress(c)) for c in parts])
        size = np.array([len(c) for c in parts])
        return saved.sum() / size.sum(), (saved / size).min()


class Model:
    """Dictionaries, and the logistic curve over standardised differences."""

    def __init__(self, good: bytes = b"", bad: bytes = b"", mean=None, scale=None, weights=None):
        self.good, self.bad, self.mean, self.scale, self.weights = good, bad, mean, scale, weights

    @property
    def knows_bad(self) -> bool:
        return self.weights is not None

    def score(self, differences) -> np.ndarray:
        z = (np.asarray(differences, float).reshape(-1, 2) - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(np.column_stack([np.ones(len(z)), z]) @ self.weights, -500, 500)))


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = RIDGE, steps: int = 100) -> np.ndarray:
    """Weighted ridge logistic regression by Newton's method. A step is halved until the penalised loss falls, and the ridge
    bounds the slopes of separable data; what still does not converge raises ArithmeticError."""
    a, weight = np.column_stack([np.ones(len(x)), x]), weight / weight.sum()
    w, penalty = np.zeros(a.shape[1]), np.full(a.shape[1], ridge)
    penalty[0] = ridge * 1e-3

    def loss(w):
        return (weight * (np.logaddexp(0, a @ w) - y * (a @ w))).sum() + (penalty * w * w).sum() / 2

    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -500, 500)))
        gradient = a.T @ (weight * (p - y)) + penalty * w
        if np.abs(gradient).max() < 1e-9:
            return w
        step, size = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + np.diag(penalty), gradient), 1.0
        while size > 1e-9 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
    if np.abs(gradient).max() > 1e-6:
        raise ArithmeticError("the calibration did not converge")
    return w


def _hash_cut(wanted: int, total: int) -> int:
    """The hash of 63 bits up to which some more than `wanted` of `total` hashes lie."""
    return min(int(MARGIN * wanted / max(total, 1) * 2**63), 2**63 - 1)


def _sampled_blocks(cut: int, halves: bool):

    def run(batches):
        for part in slices(batches, "text"):
            data, offsets = text_bytes(part.column("text"))
            h = part.column("h").to_numpy(zero_copy_only=False).astype(np.int64).view(U64)
            number = block_counts(np.diff(offsets))
            owner, place = np.repeat(np.arange(len(h)), number), spread(np.zeros(len(h), np.int64), number)
            code = mix(h[owner] + (place.astype(U64) + U64(1)) * _M1) >> U64(1)
            take = np.flatnonzero((code <= U64(cut)) & ((h[owner] & U64(1) == 0) | (not halves)))
            begin = offsets[owner[take]] + place[take] * BLOCK
            end = np.where(place[take] == number[owner[take]] - 1, offsets[owner[take] + 1], begin + BLOCK)
            found = [data[a:b].tobytes() for a, b in zip(begin.tolist(), end.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(h[owner[take]].view(np.int64)), pa.array(code[take].view(np.int64)), pa.array(found, pa.binary())], ["h", "code", "block"])

    return run, "h long, code long, block binary"


def _differences(good: bytes, bad: bytes):
    def run(batches):
        compressors, seen = Compressors(good, bad), set()
        for part in slices(batches, "text"):
            data, offsets = text_bytes(part.column("text"))
            hashes = part.column("h").to_pylist()
            fresh = [k for k, h in enumerate(hashes) if not (h in seen or seen.add(h)) and offsets[k + 1] > offsets[k]]
            x = np.array([compressors.differences(data[offsets[k] : offsets[k + 1]].tobytes()) for k in fresh]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array([hashes[k] for k in fresh], pa.int64()), pa.array(x[:, 0].copy()), pa.array(x[:, 1].copy())], ["h", "whole", "least"])

    return run, "h long, whole double, least double"


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """docs(doc_id, text), labels(doc_id, quality) -> a Model.

    Labelled texts, each taken once, are halved by a hash: one half gives the dictionaries' blocks, the other calibrates, with
    weights that restore the classes' shares among labelled texts. Null and empty texts, null labels and doc_ids teach
    nothing; a doc_id or a text labelled both ways teaches neither. A class with texts in one half only: both halves do
    both. Without both classes there is a Model that scores every text 1 (nothing is known to be bad).
    """
    marks = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).where("quality = other").select("doc_id", "quality")
    known = docs.where("text <> '' and doc_id is not null").select("doc_id", "text", F.xxhash64("text").alias("h"))
    # Hashes alone meet the labels; of texts only the sampled blocks move.
    count = F.greatest(F.lit(1), F.expr(f"octet_length(text) div {BLOCK}")).alias("blocks")
    texts = known.select("doc_id", "h", count).join(marks, "doc_id").groupBy("h").agg(F.min("quality").alias("quality"), F.max("quality").alias("other"), F.max("blocks").alias("blocks"))
    texts = checkpoint(texts.where("quality = other").select("h", "quality", "blocks"))
    sizes = {(q, half): (n, b) for q, half, n, b in texts.groupBy("quality", F.col("h").bitwiseAND(1)).agg(F.count("*"), F.sum("blocks")).collect()}
    if not {0, 1} <= {q for q, _ in sizes}:
        return Model()
    halves = len(sizes) == 4
    total = lambda q, half, k: sizes[q, half][k] if halves else sum(v[k] for (c, _), v in sizes.items() if c == q)

    cuts = [_hash_cut(SAMPLE_BLOCKS, total(q, 0, 1)) for q in (0, 1)]
    run, schema = _sampled_blocks(max(cuts), halves)
    drawn = known.select("h", "text").mapInArrow(run, schema).groupBy("h", "code").agg(F.first("block").alias("block")).join(texts.select("h", "quality"), "h")
    rows = drawn.where(F.col("code") <= F.when(F.col("quality") == 0, cuts[0]).otherwise(cuts[1])).select("quality", "code", "block").collect()
    bad, good = (b"\n".join(bytes(r.block) for r in sorted((r for r in rows if r.quality == q), key=lambda r: (r.code, r.block))[:SAMPLE_BLOCKS]) for q in (0, 1))

    cuts, code = [_hash_cut(SAMPLE_TEXTS, total(q, 1, 0)) for q in (0, 1)], F.shiftrightunsigned(F.xxhash64("h"), 1)
    run, schema = _differences(good, bad)
    calibrating = known.select("h", "text").where(((F.col("h").bitwiseAND(1) == 1) if halves else F.lit(True)) & (code <= max(cuts)))
    measured = calibrating.mapInArrow(run, schema).groupBy("h").agg(F.first("whole").alias("whole"), F.first("least").alias("least")).join(texts.select("h", "quality"), "h")
    rows = sorted(tuple(r) for r in measured.where(code <= F.when(F.col("quality") == 0, cuts[0]).otherwise(cuts[1])).select("quality", "whole", "least").collect())
    y, x = np.array([r[0] for r in rows], float), np.array([r[1:] for r in rows], float).reshape(-1, 2)
    weight = np.array([total(q, 1, 0) / max((y == q).sum(), 1) for q in (0, 1)])[y.astype(int)]
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    return Model(good, bad, mean, scale, fit((x - mean) / scale, y, weight))


def _score(shared):
    def run(batches):
        model = shared.value
        compressors = Compressors(model.good, model.bad) if model.knows_bad else None
        for part in slices(batches, "text"):
            data, offsets = text_bytes(part.column("text"))
            score = np.full(part.num_rows, 0.0 if model.knows_bad else 1.0)
            full = np.flatnonzero(np.diff(offsets) > 0)
            if model.knows_bad and len(full):
                score[full] = model.score([compressors.differences(data[offsets[k] : offsets[k + 1]].tobytes()) for k in full])
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(score, pa.float64())], ["row", "score"])

    return run


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """docs(text, ...) -> the `keep` columns with score (0 to 1, higher: better).

    Null and empty texts score 0 (1 if the model knows no bad text). Only `text` is an input. Repeated rows and equal texts
    score alike; very long texts are scored block by block, whole. Other columns may have any name.
    A kept column named like a result is a ValueError; without `keep` it is left out. Empty table: empty result.
    """
    keep = kept_columns(docs, keep, ["score"])
    types = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    run = _score(docs.sparkSession.sparkContext.broadcast(model))
    return docs.select(F.struct(*keep).alias("row"), "text").mapInArrow(run, f"row struct<{types}>, score double").select("row.*", "score")
