"""Language identification by multinomial naive Bayes over hashed character n-grams (operator 9).

Counts are taken over all training texts: each task adds up its own counts, rows (lang, feature, count) meet by a
partially aggregated sum. The log-probability matrix (features x languages) is broadcast. A batch is scored as a sparse
matrix of counts (text, feature) times that matrix, in numpy.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import kept_columns, slices

FEATURE_BITS = 14
FEATURES = 1 << FEATURE_BITS
ORDERS = (1, 2, 3)  # characters (code points) in an n-gram
MAX_LANGUAGES = 2000  # the matrix then holds 131 MB; training on more raises ValueError
UNDETERMINED = "und"
STEP = 1 << 20  # code points that are hashed at once
CELLS = 1 << 19  # cells of a group's count table
HELD = 256  # languages whose counts a task holds


def code_points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(lower-cased code points, offsets) of a string column; null is empty."""
    column = pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), ""))
    sizes = pc.utf8_length(column).to_numpy(zero_copy_only=False)
    raw = "".join(column.to_pylist()).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(raw, "<u4"), np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)


def features(points: np.ndarray, order: int) -> np.ndarray:
    """Feature of the n-gram that starts at each code point but the last order - 1."""
    n = len(points) - order + 1
    x = np.full(max(n, 0), order, np.uint32)
    for k in range(order):
        x = (x ^ points[k : n + k]) * np.uint32(2654435761)
        x ^= x >> np.uint32(15)
    return (x * np.uint32(2246822519) >> np.uint32(32 - FEATURE_BITS)).astype(np.int64)


def grams(points: np.ndarray, offsets: np.ndarray):
    """(text, feature) of the n-grams inside texts, STEP code points at a time."""
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    for begin in range(0, len(points), STEP):
        texts, found = [], []
        for order in ORDERS:
            f = features(points[begin : begin + STEP + order - 1], order)
            inside = np.ones(len(f), bool)
            for k in range(1, order):  # n-grams don't cross texts
                last = offsets[1:] - k - begin
                inside[last[(last >= 0) & (last < len(f))]] = False
            texts.append(owner[begin : begin + len(f)][inside])
            found.append(f[inside])
        yield np.concatenate(texts), np.concatenate(found)


def _rows(counts: dict[str, np.ndarray]) -> pa.RecordBatch:
    used = {lang: np.flatnonzero(c) for lang, c in counts.items()}
    lang = [lang for lang, u in used.items() for _ in range(len(u))]
    feature = np.concatenate([*used.values(), np.zeros(0, np.int64)])
    return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(feature, pa.int32()), pa.array(np.concatenate([*(counts[x][u] for x, u in used.items()), np.zeros(0, np.int64)]))], ["lang", "feature", "n"])


def _count(batches):
    counts: dict[str, np.ndarray] = {}
    for part in slices(batches, "text"):
        lang = part.column("lang").dictionary_encode()
        names, which = lang.dictionary.to_pylist(), lang.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(which, kind="stable")
        points, offsets = code_points(part.column("text").take(pa.array(order)))
        for begin, end, k in _runs(which[order]):
            total = counts.setdefault(names[k], np.zeros(FEATURES, np.int64))
            own = offsets[begin : end + 1]
            for _, f in grams(points[own[0] : own[-1]], own - own[0]):
                total += np.bincount(f, minlength=FEATURES)
            if len(counts) > HELD:
                yield _rows(counts)
                counts = {}
    yield _rows(counts)


def _runs(values: np.ndarray):
    """(begin, end, value) of each stretch of equal values."""
    cut = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))).tolist()
    return [(a, b, int(values[a])) for a, b in zip(cut, [*cut[1:], len(values)])]


def _log_probability(key, table):
    """One language's column of the matrix, as packed floats; every feature counts one more than seen."""
    n = np.ones(FEATURES)
    n[table.column("feature").to_numpy()] += table.column("n").to_numpy()
    return pa.table({"lang": pa.array([key[0].as_py()], pa.string()), "row": pa.array([np.log(n / n.sum()).astype("<f4").tobytes()], pa.binary())})


class Model:
    """Languages by name, and matrix[feature, language] of log probabilities."""

    def __init__(self, langs: list[str], matrix: np.ndarray):
        self.langs, self.matrix = langs, matrix


def train(docs: DataFrame) -> Model:
    """docs(text, lang, ...): rows with a null text or lang teach nothing; repeated rows teach each. Priors are equal: a
    language's share of the corpus says nothing about one text. More than MAX_LANGUAGES raise ValueError."""
    rows = docs.where("text is not null and lang is not null").select("text", "lang")
    table = rows.mapInArrow(_count, "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n"))
    packed = sorted(table.groupBy("lang").applyInArrow(_log_probability, "lang string, row binary").limit(MAX_LANGUAGES + 1).collect())
    if len(packed) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    columns = [np.frombuffer(r.row, "<f4") for r in packed]
    return Model([r.lang for r in packed], np.ascontiguousarray(np.column_stack(columns)) if columns else np.zeros((FEATURES, 0), np.float32))


def _totals(points: np.ndarray, offsets: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Sums of log probabilities (text, language): a sparse count matrix, group by group of texts, times the model's."""
    n = len(offsets) - 1
    out = np.zeros((n, matrix.shape[1]))
    size = max(CELLS // FEATURES, 1)
    for a in range(0, n, size):
        own = offsets[a : min(a + size, n) + 1]
        m = len(own) - 1
        counts = sum(np.bincount(text * FEATURES + f, minlength=m * FEATURES) for text, f in grams(points[own[0] : own[-1]], own - own[0]))
        cell = np.flatnonzero(counts)
        text, f = np.divmod(cell, FEATURES)
        for begin in range(0, len(cell), STEP):
            t, part = text[begin : begin + STEP], slice(begin, begin + STEP)
            first = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1])))
            out[a + t[first]] += np.add.reduceat(counts[cell[part], None] * matrix[f[part]].astype(np.float64), first, axis=0)
    return out


def _predict(shared):
    def run(batches):
        model = shared.value
        for part in slices(batches, "text", 1 << 20):
            text = pc.fill_null(part.column("text"), "")
            known = pc.match_substring_regex(text, r"\p{L}").to_numpy(zero_copy_only=False) & bool(model.langs)
            langs, score = np.full(part.num_rows, UNDETERMINED, object), np.zeros(part.num_rows)
            if known.any():
                total = _totals(*code_points(text.filter(pa.array(known))), model.matrix)
                best = total.argmax(axis=1)
                langs[known] = np.array(model.langs, object)[best]
                score[known] = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(langs, pa.string()), pa.array(score)], ["row", "lang_pred", "score"])

    return run, "lang_pred string, score double"


def predict(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """docs(text, ...) -> the `keep` columns with lang_pred and score (the posterior of the predicted language).

    Null text, or text without a letter, or a model without languages: `und`, score 0. Equal posteriors: the first
    language by name. Equal texts get equal predictions; very long texts are counted piece by piece, whole. Only `text` is
    an input of the prediction; other columns may have any name. A kept column named like a result is a ValueError; without `keep` it is left out.
    Empty table: empty result.
    """
    keep = kept_columns(docs, keep, ["lang_pred", "score"])
    types = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    run, schema = _predict(docs.sparkSession.sparkContext.broadcast(model))
    return docs.select(F.struct(*keep).alias("row"), "text").mapInArrow(run, f"row struct<{types}>, {schema}").select("row.*", "lang_pred", "score")
