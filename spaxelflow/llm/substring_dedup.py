"""Removal of repeated word windows by recompression (operator 8).

A text's words are level-0 symbols. In each round every pair of neighbours (left, right) whose symbols fall into the
round's left and right half is replaced by a new symbol named by both. Halves and names depend on the symbols alone (names
are hashes of what they stand for), so they are the same in all documents, and a task runs its rounds without an exchange.
Runs of equal symbols fall into one half, are never cut and stay as they are: a name for a run and its length would set a
run of 60 words apart from one of 70, although both hold the same windows of 50. After ROUNDS = 4 rounds a symbol covers at
most 16 words and equal word sequences differ in at most 1 + 2 + 4 + 8 words at either end, so two equal windows of 50 words
share at least 20 inner words in equal symbols, that is two neighbouring symbols at least. Names of two neighbouring symbols
that occur in one document only therefore rule their windows out; windows around shared names are compared by 96 bits of
hashes of all their words.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import U64, WHITESPACE_WORDS, KeyFilter, Words, by_bucket, checkpoint, gathered, join2, kept_columns, least_gram, mix, partitions_of, slices, window_hash

WINDOW = 50
ROUNDS = 4
WORDS_A_BUCKET = 4_000_000
CAP_BITS = 1 << 28  # of the broadcast filter of shared names


def recompress(h: np.ndarray, text: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, index of each symbol's first word) after the rounds; pairs never cross texts."""
    symbol, first = h, np.arange(len(h))
    owner = text
    for r in range(rounds):
        if len(symbol) < 2:
            break
        half = (mix(symbol ^ U64(0xD6E8FEB86659FD93 + r)) & U64(1)).astype(bool)
        left = np.zeros(len(symbol), bool)
        left[:-1] = ~half[:-1] & half[1:] & (owner[:-1] == owner[1:])
        merged = symbol.copy()
        at = np.flatnonzero(left)
        merged[at] = join2(symbol[at], symbol[at + 1])
        keep = np.ones(len(symbol), bool)
        keep[at + 1] = False
        symbol, first, owner = merged[keep], first[keep], owner[keep]
    return symbol, first


class _Slice:
    """The long enough texts of a slice, recompressed: names of neighbouring symbols and the words that they cover."""

    def __init__(self, part: pa.RecordBatch, width: int):
        words = Words(part.column("text"), WHITESPACE_WORDS, lower=False)
        self.words, self.h = words, words.hashes()
        self.text = words.text_of_word()
        symbol, first = recompress(self.h, self.text)
        end = np.append(first[1:], len(self.h))
        whole = np.zeros(len(symbol), bool)
        if len(symbol):
            owner = self.text[first]
            whole[:-1] = (owner[:-1] == owner[1:]) & (words.counts[owner[:-1]] >= width)
        at = np.flatnonzero(whole)
        self.name, self.begin, self.end = join2(symbol[at], symbol[at + 1]) if len(at) else symbol[:0], first[at], end[at + 1] if len(at) else end[:0]


def _names(buckets: int, width: int):
    """Per bucket the tails of a slice's names, twice where two documents of the slice hold one."""

    def run(batches):
        for part in slices(batches, "text"):
            s = _Slice(part, width)
            if not len(s.name):
                continue
            order = np.argsort(s.name, kind="stable")  # stable: texts ascend inside a name
            name, text = s.name[order], s.text[s.begin[order]]
            fresh = np.ones(len(name), bool)
            fresh[1:] = name[1:] != name[:-1]
            more = ~fresh
            more[1:] &= text[1:] != text[:-1]
            group = np.cumsum(fresh) - 1
            twice = np.zeros(group[-1] + 1, bool)
            twice[group[more]] = True
            once = name[fresh]
            both = np.concatenate([once, once[twice]])
            rows = list(by_bucket(both, buckets, both.astype(np.uint32)))
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([c[0].tobytes() for _, c in rows], pa.binary())], ["bucket", "tails"])

    return run, "bucket int, tails binary"


def _shared(key, table):
    tails = np.sort(gathered(table, "tails", np.uint32))
    again = np.zeros(len(tails), bool)
    again[1:] = tails[1:] == tails[:-1]
    found = np.unique(tails[again])
    return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "n": pa.array([len(found)], pa.int64()), "tails": pa.array([found.tobytes()], pa.binary())})


class SharedNames:
    """Bits of the shared names: of (bucket, tail) pairs, in a table of at most CAP_BITS."""

    def __init__(self, bits: np.ndarray, buckets: int):
        self.bits, self.buckets = bits, buckets

    @staticmethod
    def codes(name: np.ndarray, buckets: int) -> np.ndarray:
        return mix(((name >> U64(32)) % U64(buckets) << U64(32)) | (name & U64(0xFFFFFFFF)))

    def has(self, name: np.ndarray) -> np.ndarray:
        return KeyFilter(self.bits).has(self.codes(name, self.buckets))


def _candidates(shared, buckets: int, width: int):
    """Windows around shared names: per slice and bucket their hash, document and word; one entry for each hash, the
    least document's. Others of the slice are already known to be repeated."""

    def run(batches):
        for part in slices(batches, "text"):
            s = _Slice(part, width)
            if not len(s.name):
                continue
            hit = shared.value.has(s.name)
            first, last = s.words.first[:-1], s.words.first[1:]
            owner = s.text[s.begin[hit]]
            low = np.maximum(s.end[hit] - width, first[owner])
            high = np.minimum(s.begin[hit], last[owner] - width)
            ok = low <= high
            step = np.zeros(len(s.h) + 1, np.int64)
            np.add.at(step, low[ok], 1)
            np.add.at(step, high[ok] + 1, -1)
            at = np.flatnonzero(np.cumsum(step[:-1]) > 0)
            if not len(at):
                continue
            key = part.column("row_key").to_numpy(zero_copy_only=False)
            doc = part.column("doc_id").fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
            # Buckets follow the windows' least inner 5-gram, so a document's windows meet few of them.
            gram, check, inner = window_hash(s.h, width)[at], second_hash(s.h, width)[at], mix(least_gram(s.h, width)[at])
            owner = s.text[at]
            order = np.lexsort((doc[owner], check, gram))
            gram, check, inner, at, owner = gram[order], check[order], inner[order], at[order], owner[order]
            fresh = fresh_windows(gram, check)
            least = doc[owner[np.flatnonzero(fresh)]][np.cumsum(fresh) - 1]
            known = doc[owner] > least
            place = (at - first[owner]).astype(np.uint32)
            send = ~known  # the least document's windows, the first and its own repeats
            rows = [(b, *c) for b, c in by_bucket(inner[send], buckets, gram[send], check[send], place[send], owner[send])]
            if known.any():
                rows.append((-1 - int(gram[0] % U64(buckets)), gram[:0], check[:0], place[known], owner[known]))
            packed = []
            for b, g, c, p, o in rows:
                texts, who = np.unique(o, return_inverse=True)  # a document's number and key go once a bucket
                packed.append((b, *(x.tobytes() for x in (g, c, p, who.astype(np.uint32), doc[texts], key[texts]))))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in packed], pa.int32()), *(pa.array([r[k] for r in packed], pa.binary()) for k in range(1, 7))], _FIELDS)

    return run, "bucket int, gram binary, check binary, place binary, who binary, doc binary, row_key binary"


def second_hash(h: np.ndarray, width: int) -> np.ndarray:
    """32 bits of an independent hash of each window."""
    return (window_hash(mix(h ^ U64(0x5851F42D4C957F2D)), width) >> U64(32)).astype(np.uint32)


def fresh_windows(gram: np.ndarray, check: np.ndarray) -> np.ndarray:
    """True at the first of equal windows, in sorted arrays of both hashes."""
    fresh = np.ones(len(gram), bool)
    fresh[1:] = (gram[1:] != gram[:-1]) | (check[1:] != check[:-1])
    return fresh


_FIELDS = ["bucket", "gram", "check", "place", "who", "doc", "row_key"]


def _packed(keys: np.ndarray, place: np.ndarray) -> pa.Table:
    """One row for each document: its repeated windows' first words."""
    order = np.argsort(keys, kind="stable")
    keys, place = keys[order], place[order]
    cut = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    ends = np.append(cut[1:], len(keys))
    return pa.table({"row_key": pa.array(keys[cut].astype(np.int64)), "places": pa.array([place[a:b].tobytes() for a, b in zip(cut.tolist(), ends.tolist())], pa.binary())})


def _repeated(key, table):
    gram, check, place = (gathered(table, c, t) for c, t in (("gram", U64), ("check", np.uint32), ("place", np.uint32)))
    who = [np.frombuffer(x, np.uint32) for x in table.column("who").to_pylist()]
    doc, row = (np.concatenate([np.frombuffer(x, np.int64)[w] for x, w in zip(table.column(c).to_pylist(), who)]) for c in ("doc", "row_key"))
    if key[0].as_py() < 0:
        return _packed(row, place)
    order = np.lexsort((doc, check, gram))
    gram, check, doc, place, row = gram[order], check[order], doc[order], place[order], row[order]
    fresh = fresh_windows(gram, check)
    later = doc > doc[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
    return _packed(row[later], place[later])


def _cut(width: int, with_places: bool):
    def run(batches):
        for batch in batches:
            for part in slices([batch], "text"):
                words = Words(part.column("text"), WHITESPACE_WORDS, lower=False)
                places = part.column("places").to_pylist() if with_places else [None] * part.num_rows
                raw, removed, digests, kept_text = words.data.tobytes(), [], [], []
                for k, packed in enumerate(places):
                    a, b = int(words.first[k]), int(words.first[k + 1])
                    gone = np.zeros(b - a + 1, np.int64)
                    for blob in packed or ():
                        p = np.frombuffer(blob, np.uint32).astype(np.int64)
                        np.add.at(gone, p, 1)
                        np.add.at(gone, p + width, -1)
                    keep = np.flatnonzero(np.cumsum(gone[:-1]) == 0) + a
                    removed.append(b - a - len(keep))
                    text = b" ".join([raw[x:y] for x, y in zip(words.starts[keep].tolist(), words.ends[keep].tolist())])
                    kept_text.append(text.decode())
                    digests.append(hashlib.sha256(text).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(words.counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept_text, pa.string()), pa.array(digests, pa.string())], ["row", "n_words", "n_removed", "kept_text", "kept_sha256"])

    return run, "n_words long, n_removed long, kept_text string, kept_sha256 string"


def remove_repeats(docs: DataFrame, keep: list[str] | None = None, width: int = WINDOW) -> DataFrame:
    """docs(doc_id, text, ...) -> the `keep` columns with n_words, n_removed, kept_text, kept_sha256.

    A word goes where a window of `width` words covers it whose word sequence also starts in a document of a smaller
    doc_id; windows are judged on the input. Null text: no words. A null doc_id counts as the largest. Rows that repeat a
    doc_id don't remove from each other. Texts of fewer words stay whole; a very long text is one slice of its own. Other
    columns may have any name. A kept column named like a result is a ValueError; without `keep` it is left out. Empty table:
    empty result.
    """
    if width != WINDOW:
        raise ValueError(f"the rounds are proven for windows of {WINDOW} words")
    spark = docs.sparkSession
    keep = kept_columns(docs, keep, ["n_words", "n_removed", "kept_text", "kept_sha256"])
    types = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    docs = docs.select(F.struct(*keep).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("row_key", F.xxhash64("doc_id", "text"))
    bare = docs.select("doc_id", "row_key", "text")
    size = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(partitions_of(spark), size // (6 * WORDS_A_BUCKET))

    run, schema = _names(buckets, width)
    shared = checkpoint(docs.select("text").mapInArrow(run, schema).groupBy("bucket").applyInArrow(_shared, "bucket int, n long, tails binary"))
    n = shared.agg(F.sum("n")).first()[0] or 0
    codes = shared.mapInArrow(lambda batches: _codes(batches, buckets), "code long")
    bits = KeyFilter.build(codes, "code", n).bits
    run, schema = _candidates(spark.sparkContext.broadcast(SharedNames(bits, buckets)), buckets, width)
    # A slice's own repeats are dealt out under a number below 0, so that no bucket gathers them all.
    found = bare.mapInArrow(run, schema).groupBy("bucket").applyInArrow(_repeated, "row_key long, places binary")
    places = checkpoint(found.groupBy("row_key").agg(F.collect_list("places").alias("places")))

    cut_keys = spark.sparkContext.broadcast(KeyFilter.build(places, "row_key", places.count()))
    flag = _flagged(cut_keys)
    marked = docs.select("row", "text", "row_key")
    untouched, plain = _cut(width, False)
    whole = marked.mapInArrow(flag(False, ["row", "text"]), f"row struct<{types}>, text string").mapInArrow(untouched, f"row struct<{types}>, {plain}")
    run, _ = _cut(width, True)
    some = marked.mapInArrow(flag(True, ["row", "text", "row_key"]), f"row struct<{types}>, text string, row_key long")
    part = some.join(places, "row_key", "left").select("row", "text", "places").mapInArrow(run, f"row struct<{types}>, {plain}")
    return whole.unionByName(part).select("row.*", "n_words", "n_removed", "kept_text", "kept_sha256")


def _codes(batches, buckets: int):
    for batch in batches:
        for b, tails in zip(batch.column("bucket").to_pylist(), batch.column("tails").to_pylist()):
            t = np.frombuffer(tails, np.uint32).astype(U64)
            for k in range(0, len(t), 1 << 20):
                code = mix(U64(b) << U64(32) | t[k : k + (1 << 20)])
                yield pa.RecordBatch.from_arrays([pa.array(code.view(np.int64))], ["code"])


def _flagged(keys):
    """Rows whose key may be (or surely isn't) among those with something to remove."""

    def make(wanted: bool, columns: list[str]):
        def run(batches):
            for batch in batches:
                has = keys.value.has(batch.column("row_key").to_numpy(zero_copy_only=False).astype(np.int64).view(U64))
                yield batch.filter(pa.array(has == wanted)).select(columns)

        return run

    return make
