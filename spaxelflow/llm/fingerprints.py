"""Lempel-Ziv phrase fingerprints (operator 7).

A text is parsed, whole, into LZ78 phrases (each the shortest one not met before); the phrases' hashes give a
one-permutation minimum-hash signature, empty bins being filled from the next one that isn't.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import U64, mix, partitions_of, slices, span_hash

BINS = 128


def phrase_ends(text: str, start: int = 0, seen: set | None = None, open_at: int | None = None) -> tuple[list[int], int]:
    """Ends of the LZ78 phrases of text[start:], and where the last, unfinished one begins. `seen` gains them."""
    seen = set() if seen is None else seen
    ends: list[int] = []
    begin = start if open_at is None else open_at
    add, note = seen.add, ends.append
    phrase = text[begin:start]
    for end, c in enumerate(text[start:], start + 1):
        phrase += c
        if phrase not in seen:
            add(phrase)
            note(end)
            phrase = ""
    return ends, ends[-1] if ends else begin


def ends_of_both(text: str, edited: str) -> tuple[list[int], list[int]]:
    """Phrase ends of a text and of an edited form that shares its first half; the shared half is parsed once."""
    half = len(text) - len(text) // 2
    seen: set[str] = set()
    head, begin = phrase_ends(text[:half], 0, seen)
    branch = set(seen)
    rest, _ = phrase_ends(text, half, seen, begin)
    other, _ = phrase_ends(edited, half, branch, begin)
    return head + rest, head + other


def signatures(texts: list[str], ends: list[list[int]], bins: int = BINS) -> list[np.ndarray | None]:
    """Each text's uint16 values of one-permutation minimum hashing over its phrases (and what is left behind the last);
    None for no phrases. All texts are hashed at once."""
    size = np.array([len(t) for t in texts], np.int64)
    stops = [e if e and e[-1] == len(t) else [*e, len(t)] if t else e for t, e in zip(texts, ends)]
    count = np.array([len(e) for e in stops], np.int64)
    text = np.repeat(np.arange(len(texts)), count)
    stop = np.fromiter(chain.from_iterable(stops), np.int64, int(count.sum()))
    start = np.zeros(len(stop), np.int64)
    start[1:] = stop[:-1]
    start[(np.cumsum(count) - count)[count > 0]] = 0
    base = (np.cumsum(size) - size)[text]
    h = span_hash(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint8), (base + start) * 4, (base + stop) * 4)
    cell, tail = text * bins + (h % U64(bins) if bins != 128 else h >> U64(57)).astype(np.int64), mix(h)
    order = np.lexsort((tail, cell))
    cell, tail = cell[order], tail[order]
    first = np.ones(len(cell), bool)
    first[1:] = cell[1:] != cell[:-1]
    cell, least = cell[first], tail[first]  # the least hash of each filled bin
    known = np.flatnonzero(count)
    wanted = (known[:, None] * bins + np.arange(bins)).ravel()
    begin, end = (np.repeat(np.searchsorted(cell, (known + k) * bins), bins) for k in (0, 1))
    take = np.searchsorted(cell, wanted)
    take = np.where(take < end, take, begin)  # past the last filled bin: the text's first one
    distance = (cell[take] - wanted) % bins if len(wanted) else wanted
    values = (mix(least[take] + distance.astype(U64) * U64(0x9E3779B97F4A7C15)) & U64(0xFFFF)).astype(np.uint16).reshape(-1, bins)
    out: list[np.ndarray | None] = [None] * len(texts)
    for k, v in zip(known.tolist(), values):
        out[k] = v
    return out


def likeness(a: np.ndarray | None, b: np.ndarray | None) -> float:
    """Share of equal bins; texts without phrases are like each other only."""
    if a is None or b is None:
        return float(a is None and b is None)
    return float((a == b).mean())


def text_form(s: np.ndarray | None) -> str:
    return "" if s is None else s.tobytes().hex()


def edited_text(text: str, following: str) -> str:
    """The last floor(n/2) code points give way to as many first ones (or all) of the following text."""
    cut = len(text) // 2
    return text[: len(text) - cut] + following[:cut]


def _stream(batches):
    """Rows sorted by (bucket, doc_id descending); each waits for the row behind it in its bucket."""
    held, waiting = None, None
    for batch in slices(batches, "text"):
        pairs = []  # (doc_id, text, the next document's text, is that one from the next range)
        for bucket, doc_id, text, ahead in zip(*(batch.column(c).to_pylist() for c in ("bucket", "doc_id", "text", "ahead"))):
            if held is not None and held[0] == bucket and not held[3]:
                pairs.append((held[1], held[2], text or "", ahead))
            held = (bucket, doc_id, text or "", ahead)
        rows, waiting = _answers(pairs, waiting)
        if rows:
            yield _batch(zip(*rows))


def _answers(pairs, waiting):
    """The rows of all pairs whose next document's signature is known, and the one that waits for the next pair."""
    texts, ends, rows = [], [], []
    for _, text, following, ahead in pairs:
        changed = edited_text(text, following)
        texts += [text, changed] + [following] * ahead
        ends += [*ends_of_both(text, changed), *([phrase_ends(following)[0]] if ahead else [])]
    signed = iter(zip(texts, signatures(texts, ends)))
    for doc_id, text, _, ahead in pairs:
        (_, own), (changed, edited) = next(signed), next(signed)
        if waiting is not None:
            rows.append((*waiting[:-1], likeness(waiting[-1], own)))
        waiting = (doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), text_form(own), text_form(edited), likeness(own, edited), own)
        if ahead:
            rows.append((*waiting[:-1], likeness(own, next(signed)[1])))
            waiting = None
    return rows, waiting


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _batch(out):
    types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(out, types)], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def fingerprint_neighbours(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) -> one row a document with its fingerprint, its edited text's and the next document's likeness.

    The next document is the one behind it by descending doc_id; behind the last comes the first. Null text is empty: an
    empty fingerprint, like only to another empty one. Null doc_id: last. Rows that repeat a doc_id follow each other
    by text. A single row is its own next one. A very long text is parsed whole; its phrases are held while it is. Extra columns are ignored. Empty table: empty result.

    Documents are dealt into ranges of doc_id (bounds from approximate quantiles); the first of each range is sent to
    the range before it too, so that one shuffle brings every document to its next one. Each range is a partition of its
    own. Rows that repeat one doc_id, or have none, lie in one range.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    parts = max(2, partitions_of(spark))
    bounds = sorted({int(x) for x in docs.approxQuantile("doc_id", [k / parts for k in range(1, parts)], 0.2 / parts)})
    shared = spark.sparkContext.broadcast(np.array(bounds, np.int64))

    def deal(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            low = len(shared.value) - np.searchsorted(shared.value, ids.fill_null(0).to_numpy(zero_copy_only=False), side="right")
            yield pa.RecordBatch.from_arrays([pa.array(np.where(known, low, len(shared.value) + 1), pa.int32()), *batch.columns], ["bucket", *batch.schema.names])

    dealt = docs.mapInArrow(deal, "bucket int, doc_id long, text string")
    ids = docs.select("doc_id").mapInArrow(deal, "bucket int, doc_id long")
    firsts = sorted((r[0], r[1]) for r in ids.groupBy("bucket").agg(F.max("doc_id").alias("m")).collect())  # one row a range
    if not firsts:
        return spark.createDataFrame([], _SCHEMA)
    before = {b: firsts[k - 1][0] for k, (b, _) in enumerate(firsts)}
    look = spark.createDataFrame([(b, m, before[b]) for b, m in firsts], "bucket int, m long, into int")
    own = dealt.withColumn("ahead", F.lit(False))
    first = dealt.join(F.broadcast(look), "bucket").where("doc_id <=> m").select(F.col("into").alias("bucket"), "doc_id", "text").withColumn("ahead", F.lit(True))
    rows = own.unionByName(first).repartitionById(len(bounds) + 2, "bucket").sortWithinPartitions("bucket", "ahead", F.desc_nulls_last("doc_id"), "text")
    return rows.mapInArrow(_stream, _SCHEMA)
