"""Hard-negative mining over an inverted multi-index (operator 13).

Two codebooks, one for each half of the components, make cells (a, b). The score of any row of a cell with an anchor is at
most the sum of two half bounds, q1.c_a + |q1| r_a + q2.c_b + |q2| r_b, with r the largest distance of a row from its codeword.
A heap takes the cells of an anchor in falling order of that sum. Each search has two steps: the first cells give lower limits
of the answers, and then every other cell whose bound reaches those limits is read, so that what is left out is certified to
hold nothing. Cells lie in blocks of bounded size, and blocks in parts that a task holds at once. Anchors are sent to parts, not to
blocks: a chunk of them goes once to each part that has blocks for it, and streams past the part's blocks there.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .clustering import Orchard
from .kernel import partitions_of, written
from .vectors import matrix, packed

SAMPLE = 20_000  # rows that the codebooks are fitted on, by hash of their id
FIT_ROUNDS = 8
ROWS_A_CELL, MAX_CODEWORDS = 1000, 64  # codewords of a half: such that a cell has about so many rows, within 2..64
BLOCK = 2048  # rows of a block
PART_BYTES = 32 << 20  # of a part's blocks, and of the anchors that are sent to them; a task holds both
CHUNK = 256  # anchors of a request
OPENING = 4096  # rows of the cells that are read first
HELD = 1_000_000  # candidates that a task holds before it keeps the first ones alone, or sends them on
NEVER = -(1 << 62)


@dataclass(frozen=True)
class Books:
    """Codebooks of the two halves, the radius of each codeword, the rows and blocks of each cell (a * codewords + b), the number of
    its first block, and how many parts there are; block n lies in part n % parts."""

    first: np.ndarray
    second: np.ndarray
    radii: tuple[np.ndarray, np.ndarray]
    rows: dict[int, int]
    blocks: dict[int, int]
    firsts: dict[int, int] = field(default_factory=dict)
    parts: int = 1


def _fit(halves: np.ndarray, codewords: int) -> np.ndarray:
    """Codewords of a bounded sample, by rounds of the mean."""
    book = np.unique(halves, axis=0)
    book = book[np.linspace(0, len(book) - 1, min(codewords, len(book))).astype(np.int64)].astype(np.int64)
    for _ in range(FIT_ROUNDS):
        best, _ = Orchard(book).nearest(halves)
        for k in np.unique(best):
            book[k] = halves[best == k].sum(axis=0) // (best == k).sum()
    return book


def _coder(shared, dims: int):
    half = dims // 2

    def code(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        first, second = shared.value
        a, da = first.nearest(v[:, :half])
        b, db = second.nearest(v[:, half:])
        return a * len(second.centroids) + b, np.stack([a, b]), [np.sqrt(da), np.sqrt(db)]

    return code


def build(rows: DataFrame, dims: int) -> tuple[Books, DataFrame]:
    """Codebooks and blocks (number, ids, labels, v: packed arrays) of rows(id, label, v), every row in one block."""
    spark, n = rows.sparkSession, rows.count()
    share = min(1.0, 0.9 * SAMPLE / max(n, 1))
    drawn = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("v").limit(SAMPLE).toArrow()
    sample = matrix(drawn.column("v").combine_chunks(), dims)
    codewords = min(MAX_CODEWORDS, max(2, round((n / ROWS_A_CELL) ** 0.5)))
    half = dims // 2
    books = [_fit(part, codewords) if len(part) else np.zeros((1, part.shape[1]), np.int64) for part in (sample[:, :half], sample[:, half:])]
    shared = spark.sparkContext.broadcast([Orchard(b) for b in books])
    code, width = _coder(shared, dims), len(books[1])

    def measure(batches):
        seen: dict[int, list] = {}
        for batch in batches:
            cells, _, (ra, rb) = code(matrix(batch.column("v"), dims))
            for c in np.unique(cells).tolist():
                own = cells == c
                old = seen.get(c, (0, 0.0, 0.0))
                seen[c] = (old[0] + int(own.sum()), max(old[1], float(ra[own].max())), max(old[2], float(rb[own].max())))
        if seen:
            n, ra, rb = zip(*seen.values())
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int32()), pa.array(n, pa.int64()), pa.array(ra), pa.array(rb)], ["cell", "n", "ra", "rb"])

    measured = rows.select("v").mapInArrow(measure, "cell int, n long, ra double, rb double")
    cells = measured.groupBy("cell").agg(F.sum("n").alias("n"), F.max("ra").alias("ra"), F.max("rb").alias("rb")).collect()  # at most codewords^2
    radii = np.zeros(len(books[0])), np.zeros(len(books[1]))
    for c in cells:
        a, b = divmod(c.cell, width)
        radii[0][a], radii[1][b] = max(radii[0][a], c.ra), max(radii[1][b], c.rb)
    counts = {c.cell: -(-c.n // BLOCK) for c in cells}
    firsts = dict(zip(counts, np.cumsum([0, *counts.values()]).tolist()))
    # as many parts as their size asks for, or as keep the cores busy: each more is one more copy of the anchors
    parts = max(-(-n * (4 * dims + 16) // PART_BYTES), min(partitions_of(spark), 3 * spark.sparkContext.defaultParallelism, sum(counts.values())), 1)
    made = Books(books[0], books[1], radii, {c.cell: c.n for c in cells}, counts, firsts, parts)

    def place(batches):
        turn: dict[int, int] = {}
        for batch in batches:
            cells, _, _ = code(matrix(batch.column("v"), dims))
            number = np.zeros(len(cells), np.int32)
            for c in np.unique(cells).tolist():  # rows of a cell go round its blocks, from an own place in each task
                own = np.flatnonzero(cells == c)
                start = turn.setdefault(c, _task() * 7919)
                number[own] = firsts[c] + (start + np.arange(len(own))) % counts[c]
                turn[c] = start + len(own)
            yield pa.RecordBatch.from_arrays([pa.array(number), *(batch.column(k) for k in ("id", "label", "v"))], ["number", "id", "label", "v"])

    def pack(batches):
        key, held = None, []
        for batch in batches:
            keys = batch.column("number").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), batch.num_rows]
            for x, y in zip(cuts, cuts[1:]):
                own = int(keys[x])
                if held and own != key:
                    yield _packed_block(key, held, dims)
                    held = []
                key = own
                held.append(batch.slice(x, y - x))
        if held:
            yield _packed_block(key, held, dims)

    placed = rows.mapInArrow(place, "number int, id long, label long, v binary")
    blocks = placed.repartition(partitions_of(spark), "number").sortWithinPartitions("number").mapInArrow(pack, "number int, ids binary, labels binary, v binary")
    return made, written(blocks)


def _task() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def _packed_block(key, parts: list[pa.RecordBatch], dims: int) -> pa.RecordBatch:
    """A block's rows by id, as one row of arrays."""
    table = pa.Table.from_batches(parts)
    ids, labels = (table.column(c).to_numpy().astype("<i8") for c in ("id", "label"))
    v = matrix(table.column("v").combine_chunks(), dims)
    order = np.argsort(ids, kind="stable")
    packs = [x[order].tobytes() for x in (ids, labels, v)]
    return pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), *(pa.array([p], pa.binary()) for p in packs)], ["number", "ids", "labels", "v"])


class CellOrder:
    """The cells that hold rows, in falling order of an anchor's bounds: a heap over the sums of two sorted lists."""

    def __init__(self, books: Books, q: np.ndarray):
        half, self.books = books.first.shape[1], books
        self.lists = []
        for part, book, radii in ((q[:, :half], books.first, books.radii[0]), (q[:, half:], books.second, books.radii[1])):
            norms = np.sqrt((part.astype(np.float64) ** 2).sum(axis=1))
            bound = part.astype(np.float64) @ book.T.astype(np.float64) + norms[:, None] * radii
            bound += 1 + 1e-9 * np.abs(bound)  # above the rounding of the floats
            order = np.argsort(-bound, axis=1, kind="stable")
            self.lists.append((order, np.take_along_axis(bound, order, axis=1)))

    def cells(self, anchor: int):
        """(bound, cell) of one anchor."""
        (oa, sa), (ob, sb) = ((o[anchor].tolist(), s[anchor].tolist()) for o, s in self.lists)
        heap, pushed = [(-(sa[0] + sb[0]), 0, 0)], {(0, 0)}
        while heap:
            bound, i, j = heapq.heappop(heap)
            cell = oa[i] * len(ob) + ob[j]
            if cell in self.books.rows:
                yield -bound, cell
            for x, y in ((i + 1, j), (i, j + 1)):
                if x < len(oa) and y < len(ob) and (x, y) not in pushed:
                    pushed.add((x, y))
                    heapq.heappush(heap, (-(sa[x] + sb[y]), x, y))


def requests(anchors: DataFrame, shared, dims: int, opening: bool, lanes: int = 1) -> DataFrame:
    """The blocks that anchors(aid, label, v, lows, highs) ask for: a row for each chunk of anchors and part, with those anchors
    packed that ask for blocks there, the blocks' numbers (`asks`) and, block by block, a bit for each of these anchors (`who`).
    Chunks go round the lanes. opening: the first cells, to OPENING rows; otherwise those behind them whose bound reaches the least of the anchor's `lows`."""

    def run(batches):
        books, lane = shared.value, _task()
        for whole in batches:
            for at in range(0, whole.num_rows, CHUNK):
                batch, lane = whole.slice(at, CHUNK), (lane + 1) % lanes
                q = matrix(batch.column("v"), dims)
                order, lows = CellOrder(books, q), batch.column("lows").to_pylist()
                wanted: dict[int, list[int]] = {}
                for k in range(len(q)):
                    rows, least = 0, min(lows[k])
                    for bound, cell in order.cells(k):
                        first = rows < OPENING
                        if bound < least or (opening and not first):
                            break
                        rows += books.rows[cell]
                        if first == opening:
                            wanted.setdefault(cell, []).append(k)
                asked: dict[int, list[tuple[int, list[int]]]] = {}
                for cell, own in wanted.items():
                    for number in range(books.firsts[cell], books.firsts[cell] + books.blocks[cell]):
                        asked.setdefault(number % books.parts, []).append((number, own))
                for part, found in asked.items():
                    who = np.zeros((len(found), len(q)), bool)
                    for row, (_, own) in zip(who, found):
                        row[own] = True
                    used = np.flatnonzero(who.any(axis=0))
                    own = batch.take(pa.array(used))
                    packs = [*(own.column(c).to_numpy().astype("<i8").tobytes() for c in ("aid", "label")), q[used].tobytes(), np.array([x[0] for x in found], "<i4").tobytes(), np.packbits(who[:, used], axis=1).tobytes()]
                    limits = [pa.array([own.column(c).to_pylist()], pa.list_(pa.list_(pa.int64()))) for c in ("lows", "highs")]
                    yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.int32()) for x in (part, lane)), *(pa.array([x], pa.binary()) for x in packs), *limits], ["part", "lane", "ids", "labels", "v", "asks", "who", "lows", "highs"])

    return anchors.select("aid", "label", "v", "lows", "highs").mapInArrow(run, "part int, lane int, ids binary, labels binary, v binary, asks binary, who binary, lows array<array<long>>, highs array<array<long>>")


def scores_of(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products, exact: by floats where they hold every partial sum."""
    most = int(np.abs(q).max(initial=0)) * int(np.abs(v).max(initial=0)) * q.shape[1]
    kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64
    return q.astype(kind) @ v.T.astype(kind)


def visit(asked: DataFrame, blocks: DataFrame, parts: int, lanes: int, dims: int, same: bool, k: int) -> DataFrame:
    """(aid, w, score, id): of each anchor's w-th range of scores the first k rows, by score and smaller id, in what a task has
    read; same: rows of the anchor's label, otherwise of other ones. A task gets a part's blocks, then the requests of a lane for them."""

    def run(batches):
        held: dict[int, list[np.ndarray]] = {}
        found, n = [], 0
        for batch in batches:
            numbers = batch.column("number").to_pylist()
            for r, number in enumerate(numbers):
                get = lambda c, t: np.frombuffer(batch.column(c)[r].as_buffer(), t)  # noqa: B023, E731
                own = [get("ids", "<i8"), get("labels", "<i8"), get("v", "<i4").reshape(-1, dims)]
                if number is not None:
                    held[number] = [x.copy() for x in own]
                    continue
                asks = get("asks", "<i4")
                who = np.unpackbits(get("who", np.uint8).reshape(len(asks), -1), axis=1, count=len(own[0])).astype(bool)
                limits = [_limits(batch.column(c)[r].as_py(), nothing) for c, nothing in (("lows", -NEVER), ("highs", NEVER))]
                for block, asking in zip(asks.tolist(), who):
                    found.append(_hits(held[block], own, np.flatnonzero(asking), *limits, same))
                    n += len(found[-1][0])
                    if n > HELD:
                        found = [_firsts(found, k)]
                        n = len(found[0][0])
                        if n > HELD // 2:
                            yield _candidates(found[0])
                            found, n = [], 0
        if found:
            yield _candidates(_firsts(found, k))

    placed = blocks.withColumn("part", F.col("number") % parts).withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    both = placed.unionByName(asked, allowMissingColumns=True)
    dealt = both.repartitionById(parts * lanes, F.col("part") * lanes + F.col("lane")).sortWithinPartitions(F.col("number").asc_nulls_last())
    return dealt.mapInArrow(run, "aid long, w int, score long, id long")


def _limits(lists: list[list[int]], nothing: int) -> np.ndarray:
    """A row for each anchor, filled up with a limit that no score meets."""
    width = max(map(len, lists))
    return np.array([x + [nothing] * (width - len(x)) for x in lists], np.int64)


def _hits(block: list[np.ndarray], anchors: list[np.ndarray], asking: np.ndarray, lows: np.ndarray, highs: np.ndarray, same: bool) -> tuple[np.ndarray, ...]:
    """(aid, w, -score, id) of the block's rows that lie in a range of the anchors at `asking`."""
    (ids, labels, v), (aids, wanted, q) = block, anchors
    scores = scores_of(q[asking], v)
    row, col = np.nonzero(scores >= lows[asking].min(axis=1)[:, None].astype(scores.dtype))
    fits = (labels[col] == wanted[asking[row]]) == same
    row, col = row[fits], col[fits]
    score, at = scores[row, col].astype(np.int64), asking[row]
    hit, w = np.nonzero((score[:, None] >= lows[at]) & (score[:, None] <= highs[at]))
    return aids[at[hit]], w, -score[hit], ids[col[hit]]


def _firsts(found: list[tuple[np.ndarray, ...]], k: int) -> tuple[np.ndarray, ...]:
    """The first k hits of each anchor's range, by score and smaller id."""
    aid, w, falling, ids = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((ids, falling, w, aid))
    aid, w, falling, ids = (x[order] for x in (aid, w, falling, ids))
    place = np.arange(len(aid))
    new = np.ones(len(aid), bool)
    new[1:] = (np.diff(aid) != 0) | (np.diff(w) != 0)
    kept = place - np.maximum.accumulate(np.where(new, place, 0)) < k
    return aid[kept], w[kept], falling[kept], ids[kept]


def _candidates(found: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    aid, w, falling, ids = found
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (aid, w.astype(np.int32), -falling, ids)], ["aid", "w", "score", "id"])


def first_of(found: DataFrame, k: int) -> DataFrame:
    """The first k of each range, with their rank."""
    order = Window.partitionBy("aid", "w").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(anchors: DataFrame, ranges: DataFrame, blocks: DataFrame, shared, count: int, dims: int, same: bool, k: int) -> DataFrame:
    """(aid, w, score, id, rank): the first k rows of each range; ranges(aid, lows, highs: arrays, one entry a range). count: of the
    anchors, which go to as many tasks as chunks, or the session's if they are fewer, and in lanes of PART_BYTES."""
    parts, lanes = shared.value.parts, max(1, -(-count * (4 * dims + 16 * (k + 2)) // PART_BYTES))
    tasks = max(1, min(partitions_of(anchors.sparkSession), -(-count // CHUNK)))
    # by number: a shuffle by aid would be dropped where the rows lie by aid already, and small tasks are merged
    spread = lambda rows: rows.repartitionById(tasks, F.pmod("aid", F.lit(tasks)).cast("int"))
    found = lambda rows, opening: visit(requests(spread(rows), shared, dims, opening, lanes), blocks, parts, lanes, dims, same, k)
    asked = anchors.join(ranges, "aid")
    opened = written(first_of(found(asked, True), k))
    # Each range's k-th score so far is a lower limit of its answers.
    full = opened.where(F.col("rank") == k).groupBy("aid").agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("found"))
    raised = asked.join(full, "aid", "left").withColumn("lows", F.transform("lows", lambda low, w: F.greatest(low, F.coalesce(F.element_at("found", w.cast("int")), low))))
    return written(first_of(opened.drop("rank").unionByName(found(raised, False)), k))


def mine(df: DataFrame, anchor: Column, dims: int, positives: int = 5, negatives: int = 5, low: int = 80, label: Column | None = None, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """df(id, label, vector array<float or double>, ...) -> anchor_id, positive_id long, rank int, negative_id, positive_score,
    negative_score long: for each row where `anchor` holds and each of its first `positives` other rows of its label, the first
    `negatives` rows of other labels with low * positive_score <= 100 * negative_score <= 100 * positive_score. Scores are inner
    products of floor(256 * x); higher ones first, then smaller ids. label: its column where it is not `label` as it is.

    Left out: rows with a null id or label, and vectors that are null, not of `dims` components, or with a null or non-finite one.
    Rows count one by one: a row that is there twice is two rows, and each other's positive; an anchor that is there twice gives
    its rows twice. A positive score below zero has no negatives. Empty table: empty result. Other columns may have any name.
    Codebooks are fitted on SAMPLE rows at most; every row is in the index. ValueError: components of 2^16 or more.
    """
    spark = df.sparkSession
    label = (F.col("label") if label is None else label).cast("long")
    number = F.col(id_column).cast("long")
    given = df.where(number.isNotNull() & label.isNotNull())
    rows = written(packed(given, {"id": number, "label": label, "asks": F.coalesce(anchor, F.lit(False))}, vector, dims))
    books, blocks = build(rows, dims)
    shared = spark.sparkContext.broadcast(books)
    once = rows.where("asks").groupBy("id", "label", "v").agg(F.count("*").alias("times"))
    spread = once.repartition(partitions_of(spark), "id", "label", "v").withColumn("aid", F.monotonically_increasing_id())
    anchors = written(spread.mapInArrow(_with_own(dims), "aid long, id long, label long, v binary, times long, own long"))
    count = anchors.count()

    # The anchor's own row may be among the first: one more is searched, and one row with its id and score is dropped.
    every = anchors.select("aid", F.array(F.lit(NEVER)).alias("lows"), F.array(F.lit(-NEVER)).alias("highs"))
    near = search(anchors, every, blocks, shared, count, dims, True, positives + 1)
    others = near.join(anchors.select("aid", F.col("id").alias("anchor_id"), "times", "own"), "aid")
    order = Window.partitionBy("aid").orderBy("rank")
    own = ((F.col("id") == F.col("anchor_id")) & (F.col("score") == F.col("own"))).cast("int")
    others = others.withColumn("_own", own).withColumn("_nth", F.sum("_own").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    kept = others.where("_own = 0 or _nth > 1").withColumn("w", F.row_number().over(order) - 1).where(F.col("w") < positives)
    chosen = written(kept.select("aid", "anchor_id", "times", "w", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))

    # the least whole score in the range; none where the positive score is below zero
    least = F.when(F.col("positive_score") < 0, F.lit(-NEVER)).otherwise(F.expr(f"(positive_score * {low} + 99) div 100"))
    ranges = chosen.groupBy("aid").agg(F.sort_array(F.collect_list(F.struct("w", least.alias("low"), F.col("positive_score").alias("high")))).alias("r"))
    far = search(anchors, ranges.select("aid", F.col("r.low").alias("lows"), F.col("r.high").alias("highs")), blocks, shared, count, dims, False, negatives)
    out = far.select("aid", "w", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(chosen, ["aid", "w"])
    out = out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def _with_own(dims: int):
    """Adds own, an anchor's score with itself."""

    def run(batches):
        for batch in batches:
            v = matrix(batch.column("v"), dims).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("aid", "id", "label", "v", "times")), pa.array((v * v).sum(axis=1))], ["aid", "id", "label", "v", "times", "own"])

    return run
