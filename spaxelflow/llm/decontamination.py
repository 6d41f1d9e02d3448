"""Benchmark decontamination over a distributed positional inverted index (operator 6).

The index is a written table, one row a shard of whole documents (about 2 MB of text): the shard's different terms, sorted
by hash, and each one's list of word positions. It is built once, by document, so that there is no shuffle by term and a
frequent term is no hot key. Test items are sought in blocks of bounded size; a block writes its answers, not the index. A window's terms are ordered by their counts
over the whole index; the positions of the rarest one, shifted by its offset, are intersected with the shifted lists of the
others, from rare to frequent, and what is left of all lists are the exact matches. A proximity match needs the rarest
terms' lists alone, near each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import ALNUM_WORDS, U64, Words, checkpoint, kept_columns, slices, spread

WINDOW = 10
RAREST = 3  # terms of a window that proximity asks for
SLOP = 5  # further words that a proximity match may span
BLOCK_CHARS = 24_000_000  # of test items in one block: about 130 MB broadcast
CANDIDATES = 2_000_000  # positions that are intersected at once
_LISTS = "terms binary, ends binary, positions binary"


def _index(batches):
    for part in slices(batches, "text"):
        words = Words(part.column("text"), ALNUM_WORDS, lower=True)
        h = words.hashes()
        positions = np.argsort(h, kind="stable")  # stable: positions ascend inside a term
        terms, ends = _run_ends(h[positions])
        rows = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), pa.concat_arrays([part.column("row")]))
        packed = (words.first.astype("<u4"), terms.astype("<u8"), ends.astype("<u4"), positions.astype("<u4"))
        yield pa.RecordBatch.from_arrays([rows, *(pa.array([x.tobytes()], pa.binary()) for x in packed)], ["rows", "first", "terms", "ends", "positions"])


def _run_ends(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values of a sorted array, and where each one's run ends."""
    if not len(values):
        return values, np.zeros(0, np.int64)
    last = np.append(np.flatnonzero(values[1:] != values[:-1]), len(values) - 1)
    return values[last], last + 1


def build_index(docs: DataFrame, keep: list[str]) -> DataFrame:
    """docs(text, ...) -> the index as a written table: (shard: its number, rows: the kept columns of its documents, first: each
    document's first word, terms, ends of their lists, positions), arrays packed."""
    types = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    shards = docs.select(F.struct(*keep).alias("row"), "text").mapInArrow(_index, f"rows array<struct<{types}>>, first binary, {_LISTS}")
    return checkpoint(shards.withColumn("shard", F.monotonically_increasing_id()))


class Block:
    """Windows of some test items: `start` and `length` in the items' words, whose terms are numbers of `vocabulary`."""

    def __init__(self, items: list[tuple[str | None, str | None]], width: int):
        words = Words(pa.array([t for _, t in items], pa.string()), ALNUM_WORDS, lower=True)
        self.width, self.names = width, [i for i, _ in items]
        self.vocabulary, term = np.unique(words.hashes(), return_inverse=True)
        self.term = term.astype(np.int32)
        n = words.counts
        windows = np.where(n >= width, n - width + 1, np.minimum(n, 1))
        self.owner = np.repeat(np.arange(len(n)), windows)
        self.start = spread(words.first[:-1], windows)
        self.length = np.minimum(n, width)[self.owner]

    def plan(self, counts: np.ndarray) -> None:
        """`order`: each window's offsets, rarest term first (then leftmost); offsets past a short window come last."""
        offset = np.arange(self.width)
        self.order = np.zeros((len(self.start), self.width), np.int8)
        for k in range(0, len(self.start), 1 << 18):
            inside = offset < self.length[k : k + (1 << 18), None]
            at = np.minimum(self.start[k : k + (1 << 18), None] + offset, max(len(self.term) - 1, 0))
            self.order[k : k + (1 << 18)] = np.argsort(np.where(inside, counts[self.term[at]], np.iinfo(np.int64).max), axis=1, kind="stable")

    def terms(self, window: np.ndarray, rank: int) -> np.ndarray:
        """The term of that rank in each window."""
        return self.term[self.start[window] + self.order[window, rank]]


def _known(vocabulary: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(numbers in the vocabulary, places in `terms`) of the terms that both have."""
    if not len(vocabulary) or not len(terms):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(vocabulary, terms), len(vocabulary) - 1)
    place = np.flatnonzero(vocabulary[at] == terms)
    return at[place], place


def _term_counts(shared):
    def run(batches):
        vocabulary = shared.value.vocabulary
        counts = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for terms, ends in zip(batch.column("terms").to_pylist(), batch.column("ends").to_pylist()):
                number, place = _known(vocabulary, np.frombuffer(terms, "<u8"))
                counts[number] += np.diff(np.frombuffer(ends, "<u4").astype(np.int64), prepend=0)[place]
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(counts[used], pa.int64())], ["term", "count"])

    return run


def _packed(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([batch.column(k).to_numpy(zero_copy_only=False).astype("<i8").tobytes()], pa.binary()) for k in (0, 1)], ["terms", "counts"])


class Shard:
    """One row of the index: position lists by term, in one sorted array of (list, position)."""

    def __init__(self, first: bytes, terms: bytes, ends: bytes, positions: bytes):
        self.first = np.frombuffer(first, "<u4").astype(np.int64)
        self.terms = np.frombuffer(terms, "<u8")
        self.ends = np.frombuffer(ends, "<u4").astype(np.int64)
        self.begins = np.concatenate(([0], self.ends[:-1])) if len(self.ends) else self.ends
        self.positions = np.frombuffer(positions, "<u4").astype(np.int64)
        self.entries = np.repeat(np.arange(len(self.terms)) << 32, self.ends - self.begins) + self.positions

    def has(self, lists: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Does the list hold a position in [low, high)?"""
        base = lists << 32
        at = np.searchsorted(self.entries, base + low)
        return (at < len(self.entries)) & (self.entries[np.minimum(at, len(self.entries) - 1)] < base + high)

    def matches(self, block: Block, slop: int):
        """Yields (exact, windows, first words or positions of the rarest term), part by part."""
        lists = np.full(len(block.vocabulary), -1)
        number, place = _known(block.vocabulary, self.terms)
        lists[number] = place
        alive = np.flatnonzero(lists[block.terms(np.arange(len(block.start)), 0)] >= 0) if len(number) else np.zeros(0, np.int64)
        anchor = lists[block.terms(alive, 0)]
        sizes = (self.ends - self.begins)[anchor] if len(alive) else alive
        parts = np.flatnonzero(np.diff(np.cumsum(sizes) // CANDIDATES, prepend=-1)) if len(alive) else alive
        for a, b in zip(parts.tolist(), [*parts[1:].tolist(), len(alive)]):
            window = np.repeat(alive[a:b], sizes[a:b])
            at = self.positions[spread(self.begins[anchor[a:b]], sizes[a:b])]
            text = np.searchsorted(self.first, at, side="right") - 1
            low, high = self.first[text], self.first[text + 1]
            begin = at - block.order[window, 0]
            fits = (begin >= low) & (begin + block.length[window] <= high)
            w, p = window[fits], begin[fits]
            for rank in range(1, block.width):
                if not len(w):
                    break
                more = rank < block.length[w]
                found = lists[block.terms(np.where(more, w, w[0]), rank)] if more.any() else np.zeros(len(w), np.int64)
                q = p + block.order[w, rank]
                keep = ~more | ((found >= 0) & self.has(found, q, q + 1))
                w, p = w[keep], p[keep]
            yield True, w, p
            for rank in range(1, RAREST):  # near: within width + slop words of the rarest term, in its document
                more = rank < block.length[window]
                found = lists[block.terms(np.where(more, window, window[0]), rank)] if more.any() else np.zeros(len(window), np.int64)
                reach = block.length[window] + slop
                keep = ~more | ((found >= 0) & self.has(found, np.maximum(at - reach + 1, low), np.minimum(at + reach, high)))
                window, at, low, high = window[keep], at[keep], low[keep], high[keep]
                if not len(window):
                    break
            yield False, window, at


def _found(shard: Shard, block: Block, slop: int) -> tuple[np.ndarray, list[list[set]]]:
    """What a block's windows match in a shard: covered words, and for each document the exact and the near items' names."""
    step = np.zeros(len(shard.positions) + 1, np.int64)
    pairs: dict[bool, list] = {True: [], False: []}
    for exact, window, at in shard.matches(block, slop):
        if exact:
            np.add.at(step, at, 1)
            np.add.at(step, at + block.length[window], -1)
        text = np.searchsorted(shard.first, at, side="right") - 1
        pairs[exact].append(np.unique(text * max(len(block.names), 1) + block.owner[window]))
    names = []
    for exact in (True, False):
        sets: list[set] = [set() for _ in range(len(shard.first) - 1)]
        for code in np.unique(np.concatenate(pairs[exact])).tolist() if pairs[exact] else ():
            text, owner = divmod(code, len(block.names))
            sets[text].add(block.names[owner])
        names.append(sets)
    return np.cumsum(step[:-1]) > 0, names


def _in_order(names: set) -> list:
    return sorted(names, key=lambda i: (i is None, i))


def _rows(rows: pa.Array, first: np.ndarray, covered: np.ndarray, names: list[list[set]]) -> pa.RecordBatch:
    """One row for each document of a shard."""
    hits = np.concatenate(([0], np.cumsum(covered)))
    counts = (np.diff(first), hits[first[1:]] - hits[first[:-1]])
    items = pa.array([_in_order(x) for x in names[0]], pa.list_(pa.string()))
    return pa.RecordBatch.from_arrays([rows, *(pa.array(c, pa.int64()) for c in counts), items, pa.array([len(x) for x in names[1]], pa.int64())], ["row", "n_words", "n_hit", "items", "n_near"])


def _shards(batches):
    for batch in batches:
        for k in range(batch.num_rows):
            one = batch.slice(k, 1)
            yield one, Shard(*(one.column(c)[0].as_py() for c in ("first", "terms", "ends", "positions")))


def _search(shared, slop: int):
    """Rows of all documents: for test items that are one block."""

    def run(batches):
        for one, shard in _shards(batches):
            yield _rows(one.column("rows").flatten(), shard.first, *_found(shard, shared.value, slop))

    return run


_ANSWER = "shard long, covered binary, items array<array<string>>, near array<array<string>>"


def _answers(shared, slop: int):
    """A block's answers of the shards that it matches: covered words as first words and ends of runs, and the items' names."""

    def run(batches):
        for one, shard in _shards(batches):
            covered, names = _found(shard, shared.value, slop)
            if not any(map(any, names)):
                continue
            runs = np.flatnonzero(np.diff(covered.astype(np.int8), prepend=0, append=0)).astype("<u4")
            lists = [pa.array([[_in_order(x) for x in sets]], pa.list_(pa.list_(pa.string()))) for sets in names]
            yield pa.RecordBatch.from_arrays([one.column("shard"), pa.array([runs.tobytes()], pa.binary()), *lists], ["shard", "covered", "items", "near"])

    return run


def _merged(batches):
    """Rows of all documents from their shards' answers to each block."""
    for batch in batches:
        for k in range(batch.num_rows):
            one = batch.slice(k, 1)
            first = np.frombuffer(one.column("first")[0].as_py(), "<u4").astype(np.int64)
            step = np.zeros(first[-1] + 1, np.int64)
            names: list[list[set]] = [[set() for _ in first[1:]] for _ in range(2)]
            for answer in one.column("answers")[0].as_py() or ():
                runs = np.frombuffer(answer["covered"], "<u4")
                np.add.at(step, runs[::2], 1)
                np.add.at(step, runs[1::2], -1)
                for sets, lists in zip(names, (answer["items"], answer["near"])):
                    for own, more in zip(sets, lists):
                        own.update(more)
            yield _rows(one.column("rows").flatten(), first, np.cumsum(step[:-1]) > 0, names)


def _blocks(items: DataFrame, width: int) -> tuple[int, Iterator[Block]]:
    """The number of blocks, and the test items in blocks of about BLOCK_CHARS characters, dealt by a hash of the text; one at
    a time is on the driver."""
    rows = items.select(F.col("item_id").cast("string").alias("item_id"), "text").distinct()
    number = max(1, -(-(rows.agg(F.sum(F.length("text"))).first()[0] or 0) // BLOCK_CHARS))
    part = F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(number))
    return number, (Block([(r[0], r[1]) for r in (rows if number == 1 else rows.where(part == k)).collect()], width) for k in range(number))


def _plan(index: DataFrame, block: Block):
    """Broadcasts the block with its windows' terms ordered by their counts over the whole index."""
    context = index.sparkSession.sparkContext
    counts, shared = np.zeros(len(block.vocabulary), np.int64), context.broadcast(block)
    tallied = index.select("terms", "ends").mapInArrow(_term_counts(shared), "term long, count long").groupBy("term").agg(F.sum("count").alias("count"))
    for terms, n in tallied.mapInArrow(_packed, "terms binary, counts binary").collect():
        counts[np.frombuffer(terms, "<i8")] = np.frombuffer(n, "<i8")
    shared.unpersist()
    block.plan(counts)
    return context.broadcast(block)


def search(index: DataFrame, items: DataFrame, width: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """An index of build_index(), items(item_id, text) -> (row, n_words, n_hit, items, n_near), one row a document.

    One block of test items is answered in a pass over the index. Several are answered one after another, each in a pass
    that writes the answers of the shards that it matches and nothing else; the answers then meet by shard, once.
    """
    result = f"row {index.schema['rows'].dataType.elementType.simpleString()}, n_words long, n_hit long, items array<string>, n_near long"
    number, blocks = _blocks(items, width)
    if number == 1:
        return index.mapInArrow(_search(_plan(index, next(blocks)), slop), result)
    answers = []
    for block in blocks:
        shared = _plan(index, block)
        answers.append(checkpoint(index.drop("rows").mapInArrow(_answers(shared, slop), _ANSWER)))
        shared.unpersist()
    by_shard = reduce(DataFrame.unionByName, answers).groupBy("shard").agg(F.collect_list(F.struct("covered", "items", "near")).alias("answers"))
    return index.select("shard", "rows", "first").join(by_shard, "shard", "left").select("rows", "first", "answers").mapInArrow(_merged, result)


def contamination(docs: DataFrame, items: DataFrame, keep: list[str] | None = None, width: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """docs(text, ...), items(item_id, text) -> the `keep` columns of docs with n_words, n_hit, items, n_near.

    items: ids (as strings, sorted) of items of which a window occurs. All items without an id count as one, a null at the
    end of the list: their words are hits, they add one to n_items, and no name to items_sha256. n_hit: words inside any
    occurrence; n_near: items of which some window's rarest terms stand within width + slop words. Null and empty texts have
    no words and no hits, as have items without words; repeated items count once; repeated documents each get their row; an
    empty table gives an empty result. A very long text is a shard of its own. Other columns may have any name. A kept
    column named like a result is a ValueError; without `keep` it is left out. Terms are compared by 64-bit hashes, of which a
    match of a window needs all.
    """
    keep = kept_columns(docs, keep, ["n_words", "n_hit", "items", "n_near"])
    return search(build_index(docs, keep), items, width, slop).select("row.*", "n_words", "n_hit", "items", "n_near")


def digest(ids: list[str]) -> str:
    """The contract's digest of a list of item ids."""
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
