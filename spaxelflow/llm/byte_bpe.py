"""Byte-level BPE by prefix dynamic programming (operator 11).

For each byte prefix of a pre-token exactly one token can stand last in the prefix's encoding. These last tokens are the
table; a token t is last at i if t ends there and does not merge with the last token of the prefix that t leaves. Walking
back through the table gives the encoding. An entry depends on earlier bytes alone, so that appended text leaves the table
as it is, and an edit changes it until a whole token's length of entries agrees again.
"""

from __future__ import annotations

import base64

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import slices
from .packing import PieceEncoder

RANKS_BYTES = 64 << 20  # a larger rank file is refused: it is broadcast
_PAIRS, _PIECES = 400_000, 400_000  # kept by a worker: judged pairs, encoded pre-tokens
# Stand-ins of the classes of characters that another Unicode version knows: letter, number, other.
_STAND_INS = {r"\p{L}": "ª", r"\p{N}": "½", r"[^\s\p{L}\p{N}]": "¤"}


def read_ranks(path: str) -> bytes:
    """The rank file's bytes (base64 token, blank, rank a line)."""
    with open(path, "rb") as f:
        data = f.read(RANKS_BYTES + 1)
    if len(data) > RANKS_BYTES:
        raise ValueError(f"rank file larger than {RANKS_BYTES} bytes: {path}")
    return data


class PrefixTable:
    """Tables of last tokens over one vocabulary. A table of n bytes is a list of n + 1 ids, the first of them -1."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {v: k for k, v in ranks.items()}
        self.longest = max(map(len, ranks))
        self.matches = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.matches.add_word(token.decode("latin-1"), (rank, len(token)))
        self.matches.make_automaton()
        self.width = max(self.tokens) + 1
        self.pairs: dict[int, bool] = {}  # before * width + token -> stands()

    def merged(self, piece: bytes) -> list[bytes]:
        """BPE as defined: the leftmost pair of lowest rank merges, until none does."""
        rank, never = self.ranks.get, 1 << 62
        parts = [piece[k : k + 1] for k in range(len(piece))]
        pairs = [rank(a + b, never) for a, b in zip(parts, parts[1:])]
        while pairs and (least := min(pairs)) < never:
            k = pairs.index(least)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del pairs[k]
            if k < len(pairs):
                pairs[k] = rank(parts[k] + parts[k + 1], never)
            if k:
                pairs[k - 1] = rank(parts[k - 1] + parts[k], never)
        return parts

    def stands(self, before: int, token: int) -> bool:
        """Whether the two tokens next to each other are the encoding of their bytes; before -1: the token alone."""
        if len(self.pairs) > _PAIRS:
            self.pairs.clear()
        own = self.tokens[token]
        pair = [own] if before < 0 else [self.tokens[before], own]
        known = self.pairs[before * self.width + token] = self.merged(b"".join(pair)) == pair
        return known

    def extend(self, piece: bytes, last: list[int], old: list[int] | None = None, same_from: int = 0) -> int:
        """Fills `last`, which covers the first len(last) - 1 bytes of the piece, to its end; returns the entries computed.

        old: the table of an earlier piece with the same last bytes, those from `same_from` (a place in this piece) on. Once
        `longest` entries in a row agree with it, the rest is taken over.
        """
        done, n, known, width = len(last) - 1, len(piece), self.pairs.get, self.width
        begin = max(0, done - self.longest)
        last.extend([-1] * (n - done))
        shift, agreed, computed = (len(old) - 1 - n if old else 0), 0, 0
        for end, (token, size) in self.matches.iter(piece[begin:].decode("latin-1")):
            end += begin + 1
            if end <= done or last[end] >= 0:
                continue
            at = end - size
            before = last[at]
            stands = known(before * width + token)
            if self.stands(before, token) if stands is None else stands:
                last[end] = token
                computed += 1
                if old is not None and end >= same_from and end + shift > 0:
                    agreed = agreed + 1 if last[end] == old[end + shift] else 0
                    if agreed >= self.longest and at > 0:
                        last[end + 1 :] = old[end + shift + 1 :]
                        break
        return computed

    def walk(self, piece: bytes, last: list[int]) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        out, at = [], len(piece)
        while at:
            out.append(last[at])
            at -= len(self.tokens[last[at]])
        return out[::-1]

    def encode(self, piece: bytes) -> list[int]:
        """The ids of a pre-token; extend() and walk() in one, for the plain case."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        known, width, n, done = self.pairs.get, self.width, len(piece), -1
        last = [-1] * (n + 1)  # by the prefix's last byte; the place behind stands for the empty prefix
        for end, (token, size) in self.matches.iter(piece.decode("latin-1")):
            if end != done:
                before = last[end - size]
                stands = known(before * width + token)
                if stands or (stands is None and self.stands(before, token)):
                    last[end], done = token, end
        out, at, tokens = [], n - 1, self.tokens
        while at >= 0:
            token = last[at]
            out.append(token)
            at -= len(tokens[token])
        out.reverse()
        return out


class Splitter:
    """Pre-tokens of a text, each match of the pattern as the rank library's own pattern engine finds it. Python's `regex`
    does the work; characters that the two classify differently (other Unicode versions) are replaced by one of the right
    class while matching."""

    def __init__(self, pattern: str):
        import tiktoken

        self.pattern = regex.compile(pattern)
        single = {bytes([k]): k for k in range(256)}
        self.classes = {p: (tiktoken.Encoding(p, pat_str=p, mergeable_ranks=single, special_tokens={}), regex.compile(p)) for p in _STAND_INS}
        self.seen: set[str] = set()
        self.swap: dict[int, str] = {}

    def spans(self, text: str, start: int = 0):
        fresh = set(text) - self.seen
        if fresh:
            joined = "".join(fresh)
            for p, (engine, ours) in self.classes.items():
                theirs = set(engine.decode_bytes(engine.encode_ordinary(joined)).decode())
                self.swap |= {ord(c): _STAND_INS[p] for c in theirs - set(ours.findall(joined))}
            self.seen |= fresh
        return (m.span() for m in self.pattern.finditer(text.translate(self.swap) if self.swap else text, start))

    def pieces(self, text: str) -> list[str]:
        return [text[a:b] for a, b in self.spans(text)]


class Encoder(PieceEncoder):
    """Ids of whole texts: each different pre-token goes through the prefix table once and is kept (in bounds)."""

    def __init__(self, table: PrefixTable, splitter: Splitter):
        self.prefixes, self.splitter, self.added = table, splitter, []
        self.table = class_table()
        self.clear()
        self.own: dict[str, np.ndarray] = {}
        self.single = lambda piece: table.encode(piece.encode())

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > _PIECES:
            self.clear()
        return super().encode(column)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for text in texts:
            pieces = self.splitter.pieces(text)
            if len(self.own) > _PIECES // 4:
                self.own.clear()
            for p in pieces:
                if p not in self.own:
                    self.own[p] = np.array(self.single(p), np.uint32)
            out.append(np.concatenate([self.own[p] for p in pieces]) if pieces else np.zeros(0, np.uint32))
        return out


def class_table() -> np.ndarray:
    """Classes of the code points below 0x180: 0 space, 1 letter, 2 number, 3 other."""
    table = np.full(0x180, 3, np.uint8)
    for c in range(0x180):
        table[c] = 1 if chr(c).isalpha() else 2 if chr(c).isnumeric() else 3
    table[[9, 10, 11, 12, 13, 32, 0x85, 0xA0]] = 0
    return table


_MADE: dict[tuple[int, int, str], tuple[PrefixTable, Splitter, Encoder]] = {}  # a worker serves many tasks


def _tools(data: bytes, pattern: str) -> tuple[PrefixTable, Splitter, Encoder]:
    key = (len(data), hash(data), pattern)
    if key not in _MADE:
        table = PrefixTable({base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())})
        splitter = Splitter(pattern)
        _MADE.clear()
        _MADE[key] = (table, splitter, Encoder(table, splitter))
    return _MADE[key]


def _given(path: str | None, pattern: str | None) -> tuple[bytes, str]:
    if path is None or pattern is None:
        import public_tokenizers

        path = path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
        pattern = pattern or public_tokenizers.PATTERN
    return read_ranks(path), pattern


def _fields(df: DataFrame, keep: list[str]) -> str:
    return ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in df.select(*keep).schema)


def _unclashed(keep: list[str], own: list[str]) -> None:
    clash = sorted({k.lower() for k in keep} & set(own))
    if clash:
        raise ValueError(f"kept columns named like results: {clash}")


def encode(docs: DataFrame, keep: list[str], ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """docs(text, ...) -> the `keep` columns and ids array<int>, the same as the rank library gives for each match of the
    pattern, without special tokens.

    Null and empty texts have no ids; texts of any length go whole; repeated rows are encoded each; an empty table gives an
    empty one. Other columns of docs may have any name; a kept column named `ids` is a ValueError. The rank file is read on
    the driver and broadcast; it may have RANKS_BYTES at most (ValueError).
    """
    _unclashed(keep, ["ids"])
    data, pattern = _given(ranks_path, pattern)
    shared = docs.sparkSession.sparkContext.broadcast(data)

    def run(batches):
        encoder = _tools(shared.value, pattern)[2]
        for part in slices(batches, "text"):
            ids, offsets = encoder.encode(pc.fill_null(part.column("text"), ""))
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.ListArray.from_arrays(offsets.astype(np.int32), ids.astype(np.int32))], ["row", "ids"])

    out = docs.select(F.struct(*keep).alias("row"), F.col("text").alias("text")).mapInArrow(run, f"row struct<{_fields(docs, keep)}>, ids array<int>")
    return out.select("row.*", "ids")


def decode(encoded: DataFrame, keep: list[str], ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """encoded(ids array<int>, ...) -> the `keep` columns and decoded binary, the tokens' bytes one after another. Null or
    empty ids: no bytes. An id that is not in the vocabulary, a null one too, is a ValueError, as is a kept column named
    `decoded`."""
    _unclashed(keep, ["decoded"])
    data, pattern = _given(ranks_path, pattern)
    shared = encoded.sparkSession.sparkContext.broadcast(data)

    def run(batches):
        tokens = _tools(shared.value, pattern)[0].tokens
        most = max(tokens) + 1
        size = np.full(most, -1, np.int64)
        size[list(tokens)] = [len(t) for t in tokens.values()]
        begin = np.cumsum(np.maximum(size, 0)) - np.maximum(size, 0)
        flat = np.frombuffer(b"".join(tokens[k] for k in sorted(tokens)), np.uint8)
        for batch in batches:
            lists = batch.column("ids")
            lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            values = pc.list_flatten(lists)
            if values.null_count:
                raise ValueError("null id")
            ids = values.to_numpy(zero_copy_only=False)
            if len(ids) and (ids.min() < 0 or ids.max() >= most or (size[ids] < 0).any()):
                raise ValueError("an id is not in the vocabulary")
            ends = np.cumsum(lengths)
            for a, b in _runs(lengths):
                own = ids[ends[a] - lengths[a] : ends[b - 1]]
                sizes = size[own]
                out = flat[np.repeat(begin[own] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))]
                places = np.concatenate(([0], np.cumsum(sizes)))[np.concatenate(([0], np.cumsum(lengths[a:b])))]
                column = pa.Array.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(places.astype(np.int64).tobytes()), pa.py_buffer(out.tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(a, b - a), column.cast(pa.binary())], ["row", "decoded"])

    out = encoded.select(F.struct(*keep).alias("row"), F.col("ids").alias("ids")).mapInArrow(run, f"row struct<{_fields(encoded, keep)}>, decoded binary")
    return out.select("row.*", "decoded")


def _runs(lengths: np.ndarray, limit: int = 1 << 20):
    """Rows in runs of about `limit` ids."""
    group = np.cumsum(lengths) // limit
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(lengths)]
    yield from ((a, b) for a, b in zip(cuts, cuts[1:]) if b > a)


TABLE = "text string, ids array<int>, starts array<int>, last binary"


def _row(table: PrefixTable, text: str, pieces: list[bytes], lasts: list[list[int]]) -> dict:
    ids: list[int] = []
    for piece, last in zip(pieces, lasts):
        ids += table.walk(piece, last)
    starts = np.cumsum([0, *map(len, pieces)])[:-1] if pieces else []
    return {"text": text, "ids": ids, "starts": list(map(int, starts)), "last": np.array([t for last in lasts for t in last[1:]], "<u4").tobytes()}


def tabulate(docs: DataFrame, keep: list[str], ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """As encode(), with what edit() goes on from: the text, starts (first byte of each pre-token) and last, the last token of
    each byte prefix of each pre-token as little-endian unsigned 32-bit ids. Null text becomes empty."""
    _unclashed(keep, ["text", "ids", "starts", "last"])
    data, pattern = _given(ranks_path, pattern)
    shared = docs.sparkSession.sparkContext.broadcast(data)

    def run(batches):
        table, splitter, _ = _tools(shared.value, pattern)
        for part in slices(batches, "text"):
            rows = []
            for text in pc.fill_null(part.column("text"), "").to_pylist():
                pieces = [p.encode() for p in splitter.pieces(text)]
                lasts = [[-1] for _ in pieces]
                for piece, last in zip(pieces, lasts):
                    table.extend(piece, last)
                rows.append(_row(table, text, pieces, lasts))
            yield _batch(part.column("row"), rows, _TABLE_TYPES)

    out = docs.select(F.struct(*keep).alias("row"), F.col("text").alias("text")).mapInArrow(run, f"row struct<{_fields(docs, keep)}>, {TABLE}")
    return out.select("row.*", "text", "ids", "starts", "last")


_TABLE_TYPES = {"text": pa.string(), "ids": pa.list_(pa.int32()), "starts": pa.list_(pa.int32()), "last": pa.binary()}


def _batch(row: pa.Array, rows: list[dict], types: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([row, *(pa.array([r[c] for r in rows], t) for c, t in types.items())], ["row", *types])


def change(table: PrefixTable, splitter: Splitter, old: dict, at: int, removed: int, inserted: str) -> dict:
    """The row of TABLE after `removed` code points from `at` on gave way to `inserted`; `computed`: table entries that were
    worked out anew."""
    before = old["text"]
    at = min(max(at, 0), len(before))
    removed = min(max(removed, 0), len(before) - at)
    text = before[:at] + inserted + before[at + removed :]
    cut, back = len(before[:at].encode()), len(before[: at + removed].encode())
    raw, starts = before.encode(), np.array(old["starts"], np.int64)
    bounds, entries = np.append(starts, len(raw)), np.frombuffer(old["last"], "<u4").astype(np.int64)
    # A match looks one character beyond its end; pre-tokens that end two or more before the edit stay.
    safe = int(np.searchsorted(bounds, len(before[: max(at - 2, 0)].encode()), side="right")) - 1
    safe = max(min(safe, len(starts)), 0)
    place = int(bounds[safe])
    pieces = [raw[a:b] for a, b in zip(bounds[:safe].tolist(), bounds[1 : safe + 1].tolist())]
    lasts = [[-1, *entries[a:b].tolist()] for a, b in zip(bounds[:safe].tolist(), bounds[1 : safe + 1].tolist())]
    shift, computed = len(text.encode()) - len(raw), 0
    places = {int(s): k for k, s in enumerate(starts)}
    for a, b in splitter.spans(text, len(raw[:place].decode())):
        same = place - shift  # the place in the old text, if behind the edit
        if same >= back and same in places:
            k = places[same]
            pieces += [raw[x:y] for x, y in zip(bounds[k:-1].tolist(), bounds[k + 1 :].tolist())]
            lasts += [[-1, *entries[x:y].tolist()] for x, y in zip(bounds[k:-1].tolist(), bounds[k + 1 :].tolist())]
            break
        piece, last, tail, tail_from = text[a:b].encode(), [-1], None, 0
        if place < cut and place in places:  # the old pre-token here has the same first bytes
            k = places[place]
            last += entries[place : min(int(bounds[k + 1]), cut, place + len(piece))].tolist()
        end = place + len(piece) - shift
        k = int(np.searchsorted(bounds, end)) - 1
        if end > back and k >= 0 and k + 1 < len(bounds) and bounds[k + 1] == end:  # one ends here, with the same last bytes
            first = int(bounds[k])
            tail, tail_from = [-1, *entries[first:end].tolist()], max(back, first) + shift - place
        computed += table.extend(piece, last, tail, tail_from)
        pieces.append(piece)
        lasts.append(last)
        place += len(piece)
    return _row(table, text, pieces, lasts) | {"computed": computed}


def edit(tables: DataFrame, keep: list[str], at: str, removed: str, inserted: str, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Rows of tabulate() after an edit each -> the `keep` columns, the new TABLE columns and computed long, the number of
    prefixes whose last token was worked out; everything else is taken over. The result is tabulate()'s of the new text.

    at, removed, inserted: columns with the edit's place and length in code points and the new text (null: 0, 0, empty; places
    beyond the text are its end). An append is an edit at the end: `at` a large number, `removed` 0.
    """
    _unclashed(keep, ["text", "ids", "starts", "last", "computed"])
    data, pattern = _given(ranks_path, pattern)
    shared = tables.sparkSession.sparkContext.broadcast(data)

    def run(batches):
        table, splitter, _ = _tools(shared.value, pattern)
        for part in slices(batches, "text"):
            olds = [part.column(c).to_pylist() for c in ("text", "starts", "last")]
            edits = [part.column(c).to_pylist() for c in ("at", "removed", "inserted")]
            rows = [change(table, splitter, {"text": t or "", "starts": s or [], "last": e or b""}, p or 0, q or 0, x or "") for t, s, e, p, q, x in zip(*olds, *edits)]
            yield _batch(part.column("row"), rows, _TABLE_TYPES | {"computed": pa.int64()})

    given = tables.select(F.struct(*keep).alias("row"), "text", "starts", "last", F.col(at).cast("long").alias("at"), F.col(removed).cast("long").alias("removed"), F.col(inserted).alias("inserted"))
    return given.mapInArrow(run, f"row struct<{_fields(tables, keep)}>, {TABLE}, computed long").select("row.*", "text", "ids", "starts", "last", "computed")
