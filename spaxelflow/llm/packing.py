"""Best-fit packing planned over a histogram of lengths (operator 10).

Best fit decreasing runs over counts: at most `capacity` lengths, whatever the number of documents. Its plan is a
table of slot ranges; pieces take their slots by joining on their rank within their length. Ranks are counted in two
levels (by salt, then over the salts' totals), so that a length with a third of all pieces is no single task.
"""

from __future__ import annotations

import base64
import bisect
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernel import U64, checkpoint, kept_columns, partitions_of, slices, span_hash, spread, text_bytes

CAPACITY = 2048
END = 0  # id that closes each document
RANKS_A_SALT = 20_000
_CACHE_IDS = 20_000_000


class PieceEncoder:
    """Token ids of whole texts. Texts are cut into the pre-tokens of the byte-level BPE (numpy, on code units), each
    different pre-token is encoded once, and ids are gathered. Texts with characters whose class is not in the fixed
    table below (beyond Latin-1 and Latin Extended-A) or an added token's content (<|endoftext|>) go to the tokenizer whole. `ranks`: the same vocabulary as a file
    of ranks, with which single pre-tokens are encoded faster, to the same ids."""

    def __init__(self, path: str, ranks: str | None = None):
        from tokenizers import Tokenizer

        self.single = None
        if ranks:
            import tiktoken

            with open(ranks, "rb") as lines:
                merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            # each call gets one pre-token, which must stay whole
            self.single = tiktoken.Encoding("ranks", pat_str=r"(?s:.+)", mergeable_ranks=merges, special_tokens={}).encode_ordinary

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.clear()
        table = np.full(0x180, 3, np.uint8)  # 0 space, 1 letter, 2 number, 3 other
        for c in range(0x180):
            ch = chr(c)
            if ch.isalpha():
                table[c] = 1
            elif ch.isnumeric():
                table[c] = 2
        for c in (9, 10, 11, 12, 13, 32, 0x85, 0xA0):
            table[c] = 0
        self.table = table

    def clear(self) -> None:
        self.known = np.zeros(0, U64)
        self.slot = np.zeros(0, np.int64)
        self.begin, self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray) -> None:
        raw = data.tobytes()
        texts = [raw[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist())]
        new = [np.array(self.single(t), np.uint32) for t in texts] if self.single else self.whole(texts)
        sizes = np.array([len(x) for x in new], np.int64)
        base = len(self.ids)
        self.begin = np.concatenate([self.begin, base + np.cumsum(sizes) - sizes])
        self.size = np.concatenate([self.size, sizes])
        self.ids = np.concatenate([self.ids, *new])
        known = np.concatenate([self.known, keys])
        slot = np.concatenate([self.slot, np.arange(len(self.size) - len(new), len(self.size))])
        order = np.argsort(known)
        self.known, self.slot = known[order], slot[order]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of a slice of texts."""
        data, offsets = text_bytes(column)
        n = len(column)
        lead = (data & 0xC0) != 0x80
        at = np.flatnonzero(lead)
        first = data[at].astype(np.int64)
        nxt = np.zeros(len(at), np.int64)
        inside = at + 1 < len(data)
        nxt[inside] = data[at[inside] + 1]
        code = np.where(first < 0x80, first, np.where(first < 0xE0, ((first & 0x1F) << 6) | (nxt & 0x3F), 0x10000))
        begins = np.searchsorted(at, offsets)
        strange = code >= 0x180
        odd = np.zeros(n, bool)
        odd[np.searchsorted(begins, np.flatnonzero(strange), side="right") - 1] = True
        for content in self.added:
            odd |= pc.fill_null(pc.match_substring(column, content), False).to_numpy(zero_copy_only=False)
        kind = self.table[np.where(strange, 0, code)]
        m = len(at)
        edge = np.zeros(m + 1, bool)
        edge[begins] = True
        cut = edge.copy()
        if m:
            cut[1:m] |= kind[1:] != kind[:-1]
            # a space right before a non-space starts the next pre-token; another blank there stands alone
            last_blank = np.zeros(m, bool)
            last_blank[: m - 1] = (kind[:-1] == 0) & (kind[1:] != 0) & ~edge[1:m]
            cut[:m] |= last_blank
            follows = np.flatnonzero(last_blank & (code == 32)) + 1
            cut[follows] = False
            self._contractions(code, kind, cut, edge)
        bounds = np.flatnonzero(cut[:m])
        byte_at = np.append(at, len(data))
        starts = byte_at[bounds]
        ends = byte_at[np.append(bounds[1:], m)] if len(bounds) else starts
        keys = span_hash(data, starts, ends) if len(starts) else np.zeros(0, U64)
        token_text = np.searchsorted(offsets, starts, side="right") - 1
        usable = ~odd[token_text] if len(starts) else np.zeros(0, bool)
        starts, ends, keys, token_text = starts[usable], ends[usable], keys[usable], token_text[usable]
        if len(self.ids) > _CACHE_IDS:
            self.clear()
        fresh, where, back = np.unique(keys, return_index=True, return_inverse=True)
        place = np.minimum(np.searchsorted(self.known, fresh), max(len(self.known) - 1, 0))
        missing = self.known[place] != fresh if len(self.known) else np.ones(len(fresh), bool)
        if missing.any():
            w = where[missing]
            self._learn(data, starts[w], ends[w], fresh[missing])
            place = np.searchsorted(self.known, fresh)
        slots = self.slot[place][back] if len(fresh) else np.zeros(0, np.int64)
        sizes = self.size[slots]
        ids = self.ids[spread(self.begin[slots], sizes)]
        counts = np.bincount(token_text, weights=sizes, minlength=n).astype(np.int64) if len(sizes) else np.zeros(n, np.int64)
        if odd.any():
            which = np.flatnonzero(odd)
            whole = self.whole(column.take(pa.array(which)).to_pylist())
            pieces, done = [], np.cumsum(counts)
            parts = np.split(ids, done[:-1])
            for k, x in zip(which.tolist(), whole):
                parts[k] = x
            counts[which] = [len(x) for x in whole]
            ids = np.concatenate(parts)
        return ids, np.concatenate(([0], np.cumsum(counts)))

    @staticmethod
    def _contractions(code: np.ndarray, kind: np.ndarray, cut: np.ndarray, edge: np.ndarray) -> None:
        """'s 't 'm 'd 're 've 'll right where a pre-token may start split off from the letters behind them."""
        m = len(code)
        at = np.flatnonzero((code == 39) & cut[:m])
        for i in at.tolist():
            for tail in ("s", "t", "re", "ve", "m", "ll", "d"):
                j = i + 1 + len(tail)
                if j <= m and not edge[i + 1 : j].any() and all(code[i + 1 + k] == ord(c) for k, c in enumerate(tail)):
                    cut[i + 1 : j] = False
                    if j < m:
                        cut[j] = True
                        if kind[j] == 0 and j + 1 < m and kind[j + 1] != 0 and not edge[j + 1] and code[j] == 32:
                            cut[j + 1] = False
                    break


def _pieces(path: str, ranks: str | None, capacity: int):
    def run(batches):
        encoder = PieceEncoder(path, ranks)
        for part in slices(batches, "text"):
            text = pc.fill_null(part.column("text"), "")
            ids, offsets = encoder.encode(text)
            rows: list[list] = [[], [], [], [], []]
            for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                own = np.append(ids[a:b], END).astype("<u4")
                head = len(own) % capacity or capacity
                cuts = [0, *range(head, len(own) + 1, capacity)]
                for p, (x, y) in enumerate(zip(cuts, cuts[1:])):
                    for column, v in zip(rows, (k, p, x, y - x, zlib.crc32(own[x:y].tobytes()))):
                        column.append(v)
            row = part.column("row").take(pa.array(rows[0], pa.int64()))
            yield pa.RecordBatch.from_arrays([row, pa.array(rows[1], pa.int32()), *(pa.array(c, pa.int64()) for c in rows[2:])], ["row", "piece", "start", "length", "ids_crc32"])

    return run, "piece int, start long, length long, ids_crc32 long"


def plan_slots(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit decreasing over counts -> (length, first_rank, count, first_sequence, offset, per_sequence).

    Pieces of one length with ranks first_rank .. first_rank + count - 1 go, per_sequence to a sequence, to sequences
    from first_sequence on, at offset + length * (rank inside the sequence). Open sequences of the same fill are one
    entry with a count, so the work follows the number of lengths, not of pieces.
    """
    plan: list[tuple[int, int, int, int, int, int]] = []
    open_bins: dict[int, list[tuple[int, int]]] = {}  # room -> ranges (first sequence, count)
    rooms: list[int] = []
    sequence = 0

    def put(room: int, first: int, count: int) -> None:
        if count and room:
            if room not in open_bins:
                open_bins[room] = []
                bisect.insort(rooms, room)
            open_bins[room].append((first, count))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            i = bisect.bisect_left(rooms, length)
            if i == len(rooms):
                each = capacity // length
                full, over = divmod(left, each)
                for bins, items in ((full, each), (1 if over else 0, over)):
                    if bins:
                        plan.append((length, rank, bins * items, sequence, 0, items))
                        put(capacity - items * length, sequence, bins)
                        sequence, rank, left = sequence + bins, rank + bins * items, left - bins * items
                break
            room = rooms[i]
            first, count = open_bins[room].pop()
            if not open_bins[room]:
                del open_bins[room]
                rooms.pop(i)
            each = room // length
            bins, items = (count, each) if left >= count * each else (left // each, each)
            if not bins:
                bins, items = 1, left
            plan.append((length, rank, bins * items, first, capacity - room, items))
            put(room, first + bins, count - bins)
            put(room - items * length, first, bins)
            rank, left = rank + bins * items, left - bins * items
    return plan


def pack(docs: DataFrame, tokenizer_path: str | None = None, ranks_path: str | None = None, capacity: int = CAPACITY, keep: list[str] | None = None) -> DataFrame:
    """docs(text, ...) -> the `keep` columns (default doc_id) with piece, start, length, ids_crc32, sequence_id, offset.

    Null text is empty: one piece, the end id alone. Repeated rows are packed each; ties in length go by content. Empty
    table: empty result. A kept column named like a result is a ValueError. Only documents longer than `capacity` are cut; their first piece takes what is over.
    """
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path, ranks_path = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    spark = docs.sparkSession
    keep = kept_columns(docs, keep or ["doc_id"], ["piece", "start", "length", "ids_crc32", "sequence_id", "offset"])
    types = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    run, schema = _pieces(tokenizer_path, ranks_path, capacity)
    pieces = checkpoint(docs.select(F.struct(*keep).alias("row"), "text").mapInArrow(run, f"row struct<{types}>, {schema}"))
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").agg(F.count("*")).collect()}  # at most `capacity` rows
    plan = plan_slots(histogram, capacity)
    slots = spark.createDataFrame(plan, "length long, first_rank long, count long, first_sequence long, base long, each long")

    salts = max(1, sum(histogram.values()) // (RANKS_A_SALT * 8))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("row", "piece", "ids_crc32"), F.lit(max(salts, partitions_of(spark)))))
    inner = Window.partitionBy("length", "salt").orderBy("ids_crc32", "start", F.xxhash64("row"))
    ranked = salted.withColumn("rank", F.row_number().over(inner) - 1)
    totals = salted.groupBy("length", "salt").agg(F.count("*").alias("count"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base_rank"))
    ranked = ranked.join(base, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("base_rank"))

    # The plan's ranges of a length are few; a piece finds its own by the range that holds its rank.
    ranges = slots.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("first_rank", "count", "first_sequence", "base", "each"))).alias("ranges"))
    found = ranked.join(F.broadcast(ranges), "length").withColumn("slot", F.expr("filter(ranges, r -> rank >= r.first_rank and rank < r.first_rank + r.count)[0]"))
    nth = F.col("rank") - F.col("slot.first_rank")
    return found.select(
        "row.*", "piece", "start", "length", "ids_crc32",
        (F.col("slot.first_sequence") + F.floor(nth / F.col("slot.each")).cast("long")).alias("sequence_id"),
        (F.col("slot.base") + F.pmod(nth, F.col("slot.each")) * F.col("length")).cast("long").alias("offset"),
    )
