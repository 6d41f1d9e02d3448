"""Exact n-gram Jaccard self-join with set-relation skipping (operator 4).

Index-level skipping: shingles are ordered by an approximate corpus count, rare first; each set indexes only its
prefix; index lists are sorted by set size and cut into blocks, so that blocks which the size bound rules out are
skipped, and sets are skipped by position where too few shingles are left behind it.
Answer-level skipping: equal sets share one entry and one answer. The lists of a block name its first set as head;
a head's sets meet in one task (or in bounded blocks, and then what is left outside the head's component against all
blocks), where each set's overlaps with all others are counted at once, or derived from a highly similar set's counts by
the lists of the members in which the two differ; sets that have met in one component need no answer. Parity bitmaps
rule out, exactly, most sets without a link before any whole set is moved.

Overlaps are counted on whole 64-bit shingle sets, so links are exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .kernel import U64, WHITESPACE_WORDS, KeyFilter, Words, by_bucket, checkpoint, gathered, join2, mix, partitions_of, slices, spread, window_hash

SHINGLE = 5
PERCENT = 75
COUNT_SLOTS = 1 << 20  # of the approximate shingle counts; fixed, so the broadcast order table is 1 MB at any input size
POSTINGS_A_BUCKET = 1_000_000
SHINGLES_A_TASK = 4_000_000
SETS_A_TASK = 10_000  # a task compares its sets' bitmaps pair by pair
BROADCAST_HEADS = 1_000_000  # 12 bytes each; more are joined by a shuffle
COPIES = 1000  # sets of more equal rows are joined to them by a broadcast, up to as many sets
_SEGMENTS = 64


def shingle_sets(column: pa.Array, size: int = SHINGLE) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes; fewer words than `size`: the whole sequence is the one shingle."""
    words = Words(column, WHITESPACE_WORDS, lower=True)
    h = words.hashes()
    grams = window_hash(h, size) if len(h) else h
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if b - a >= size:
            s = np.sort(grams[a : b - size + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif b > a:
            short = h[a : a + 1]
            for k in range(a + 1, b):
                short = join2(short, h[k : k + 1])
            out.append(mix(short + U64(b - a)))
        else:
            out.append(h[:0])
    return out


def set_key(s: np.ndarray) -> np.uint64:
    """One 64-bit key of a set: order-free sum of remixed members, and the size."""
    total = mix(s ^ U64(0xA5A5A5A5A5A5A5A5)).sum(dtype=U64, keepdims=True)
    return join2(total, np.array([len(s)], U64))[0]


def _profile(size: int):
    """Per document its set's key and size, and the task's shingle counts by slot, in one pass."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("set_key", pa.int64()), ("segment", pa.int32()), ("counts", pa.binary())])

    def run(batches):
        counts = np.zeros(COUNT_SLOTS, np.uint16)
        for part in slices(batches, "text"):
            sets = shingle_sets(part.column("text"), size)
            n = len(sets)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(np.array([set_key(s) for s in sets], U64).view(np.int64)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], schema=schema)
            here = np.bincount((np.concatenate(sets) >> U64(44)).astype(np.int64), minlength=COUNT_SLOTS)
            counts = np.minimum(counts + here, 65535).astype(np.uint16)
        used = counts.reshape(_SEGMENTS, -1)
        yield pa.RecordBatch.from_arrays([pa.nulls(_SEGMENTS, pa.int64()), pa.nulls(_SEGMENTS, pa.int64()), pa.nulls(_SEGMENTS, pa.int64()), pa.array(range(_SEGMENTS), pa.int32()), pa.array([x.tobytes() for x in used], pa.binary())], schema=schema)

    return run, "doc_id long, n long, set_key long, segment int, counts binary"


def _add_counts(batches):
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            total[k] = total.get(k, 0) + np.frombuffer(b, np.uint16).astype(np.int64)
    if total:
        rank = [np.minimum(4 * np.log2(v + 1), 255).astype(np.uint8).tobytes() for v in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(rank, pa.binary())], ["segment", "counts"])


def prefix_of(s: np.ndarray, rank: np.ndarray, percent: int) -> np.ndarray:
    """The first n - ceil(percent * n / 100) + 1 members in the global order (count class, hash)."""
    keep = len(s) - (percent * len(s) + 99) // 100 + 1
    return s[np.argsort(rank[(s >> U64(44)).astype(np.int64)], kind="stable")[:keep]]


def _postings(rank, buckets: int, size: int, percent: int):
    def run(batches):
        for part in slices(batches, "text"):
            sets = [s for s in shingle_sets(part.column("text"), size) if len(s)]
            keys = np.array([set_key(s) for s in sets], U64)
            _, once = np.unique(keys, return_index=True)
            if not len(once):
                continue
            prefixes = [prefix_of(sets[i], rank.value, percent) for i in once]
            lengths = np.array([len(p) for p in prefixes])
            token = np.concatenate(prefixes)
            key = np.repeat(keys[once], lengths)
            n = np.repeat(np.array([len(sets[i]) for i in once], np.uint32), lengths)
            place = np.minimum(np.concatenate([np.arange(k) for k in lengths]), 65535).astype(np.uint16)
            rows = list(by_bucket(token, buckets, token.astype(np.uint32), key, n, place))
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), *(pa.array([c[k].tobytes() for _, c in rows], pa.binary()) for k in range(4))], ["bucket", "token", "set_key", "n", "place"])

    return run, "bucket int, token binary, set_key binary, n binary, place binary"


def _lists(table: pa.Table):
    """Index lists of two and more different sets, each sorted by size: token run bounds, set keys, sizes, places."""
    token, key, n, place = (gathered(table, c, t) for c, t in (("token", np.uint32), ("set_key", U64), ("n", np.uint32), ("place", np.uint16)))
    order = np.argsort(token, kind="stable")
    sorted_token = token[order]
    same = sorted_token[1:] == sorted_token[:-1]
    paired = np.zeros(len(order), bool)
    paired[1:] |= same
    paired[:-1] |= same
    order = order[paired]
    order = order[np.lexsort((place[order], key[order], n[order], token[order]))]
    token, key, n, place = token[order], key[order], n[order], place[order]
    fresh = np.ones(len(token), bool)
    fresh[1:] = (token[1:] != token[:-1]) | (key[1:] != key[:-1])
    token, key, n, place = token[fresh], key[fresh], n[fresh], place[fresh]
    bounds = np.concatenate(([0], np.flatnonzero(token[1:] != token[:-1]) + 1, [len(token)])) if len(token) else np.zeros(1, np.int64)
    return bounds, key, n, place


def _largest(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The largest of values[start:end] for each pair of bounds, -1 where it is empty; ranges are covered by two spans of a
    power of two."""
    out = np.full(len(start), -1, np.int64)
    length = end - start
    level = np.where(length > 0, np.frexp(np.maximum(length, 1))[1] - 1, -1)
    top, span = values, 1
    for k in range(int(level.max(initial=-1)) + 1):
        at = np.flatnonzero(level == k)
        out[at] = np.maximum(top[start[at]], top[end[at] - span])
        top, span = np.maximum(top[:-span], top[span:]), 2 * span
    return out


def _pairable(bounds: np.ndarray, n: np.ndarray, room: np.ndarray, percent: int) -> np.ndarray:
    """True for each set of each index list (sorted by size) that size and position leave a possible partner in its list.

    A pair is judged at the first member that it shares, so no more than `room` members are common to either: a set's
    partners have at most `reach` members. The widest reach among sizes within bounds, the set itself left out, decides.
    """
    reach = room * (100 + percent) // percent - n
    which = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)) << 32
    at, key = np.arange(len(n)), which + n
    low = np.searchsorted(key, which - (-percent * n // 100), side="left")
    high = np.searchsorted(key, which + np.clip(np.minimum(reach, 100 * n // percent), 0, (1 << 32) - 1), side="right")
    return np.maximum(_largest(reach, low, np.minimum(high, at)), _largest(reach, np.maximum(low, at + 1), high)) >= n


def _heads(percent: int):
    """From each list: (head, member, size of member) rows, one head for a block of sizes within the size bound.

    A pair within the bound lies in one block or in two neighbours, so each member goes to its own block's head and
    to the one before it; sets that size and position leave no partner in their list are skipped.
    """

    def run(_, table):
        bounds, key, n, place = _lists(table)
        n = n.astype(np.int64)
        fit = np.flatnonzero(_pairable(bounds, n, n - place, percent))
        bounds = np.unique(np.searchsorted(fit, bounds))
        size = np.diff(bounds)
        two = bounds[:-1][size == 2]
        heads, members = [np.repeat(fit[two], 2)], [fit[np.repeat(two, 2) + np.tile([0, 1], len(two))]]
        for a, b in zip(bounds[:-1][size > 2].tolist(), bounds[1:][size > 2].tolist()):
            rows = fit[a:b]
            sizes, before, at = n[rows], None, 0
            while at < len(rows):
                end = at + int(np.searchsorted(sizes[at:], 100 * sizes[at] // percent, side="right"))
                for h in (at, before):
                    if h is not None:
                        members.append(rows[at:end])
                        heads.append(np.full(end - at, rows[h]))
                before, at = at, end
        heads, members = np.concatenate(heads), np.concatenate(members)
        rows = np.unique(np.stack([key[heads], key[members], n[members].astype(U64)], axis=1), axis=0) if len(heads) else np.zeros((0, 3), U64)
        return pa.table({c: pa.array(np.ascontiguousarray(rows[:, k]).view(np.int64)) for k, c in enumerate(("head", "member", "n"))})

    return run, "head long, member long, n long"


def parity_bits(s: np.ndarray) -> np.ndarray:
    """A set's parity bitmap: each member flips one bit of 2n or more (a power of two). Two bitmaps differ in no more
    bits than their sets in members, so they bound an overlap from above at a 32nd of the sets' size."""
    size = 1 << max(6, int(2 * len(s) - 1).bit_length())
    flips = np.bincount((mix(s) & U64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(flips.astype(np.uint8)).view(U64)


def fold(bits: np.ndarray, words: int) -> np.ndarray:
    """The same set's bitmap in fewer words: members' bits are taken modulo the size."""
    return np.bitwise_xor.reduce(bits.reshape(-1, words), axis=0)


def _wanted(wanted, size: int, encode):
    """(member, members) of the documents in the filter: each set as `encode` gives it."""

    def run(batches):
        for part in slices(batches, "text"):
            ids = part.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(U64)
            part = part.filter(pa.array(wanted.value.has(ids)))
            if part.num_rows:
                sets = [s for s in shingle_sets(part.column("text"), size) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array(np.array([set_key(s) for s in sets], U64).view(np.int64)), pa.array([encode(s).tobytes() for s in sets], pa.binary())], ["member", "members"])

    return run, "member long, members binary"


def _survivors(percent: int):
    """Of the sets of a task: the groups that possible links join, by bitmaps; sets without a possible link drop out."""

    def run(_, table):
        keys, once = np.unique(table.column("member").to_numpy(), return_index=True)
        sizes = table.column("n").to_numpy()[once]
        bits = [np.frombuffer(x, U64) for x in table.column("members").take(pa.array(once)).to_pylist()]
        words = min(len(b) for b in bits)
        bits = np.stack([fold(b, words) for b in bits])
        m, label = len(keys), np.arange(len(keys))
        linked = np.zeros(m, bool)
        for a in range(m - 1):
            n = sizes[a + 1 :]
            common = (sizes[a] + n - np.bitwise_count(bits[a + 1 :] ^ bits[a]).sum(axis=1, dtype=np.int64)) // 2
            near = np.flatnonzero((100 * common >= percent * (sizes[a] + n - common)) & (100 * np.minimum(n, sizes[a]) >= percent * np.maximum(n, sizes[a]))) + a + 1
            if len(near):
                linked[a] = True
                linked[near] = True
                met = np.unique(label[near])
                label[np.isin(label, met)] = label[a]
        rows = np.flatnonzero(linked)
        names = np.zeros(m, np.int64)
        for c in np.unique(label[rows]):
            group = np.flatnonzero(linked & (label == c))
            names[group] = set_key(keys[group].view(U64)).view(np.int64)
        return pa.table({"group": pa.array(names[rows]), "member": pa.array(keys[rows])})

    return run, "group long, member long"


def spanning_links(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that join what all links of these sets join: at most len(sets) - 1.

    A set's overlaps with all others are counted at once over an inverted list. The next set is the one most like the set
    just answered, and its overlaps are derived from that answer where that reads less: the lists of members that only
    the old set has are taken off, those of members that only the new one has are added. Sets that have met need no
    answers of their own against each other: sets are taken from the smaller components until one component alone holds
    sets that weren't taken.
    """
    m = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    token = np.concatenate(sets)
    owner = np.repeat(np.arange(m), sizes)
    order = np.argsort(token, kind="stable")
    fresh = np.ones(len(token), bool)
    fresh[1:] = token[order][1:] != token[order][:-1]
    run_of = np.empty(len(token), np.int64)
    run_of[order] = np.cumsum(fresh) - 1
    starts = np.flatnonzero(fresh)
    counts = np.diff(np.append(starts, len(token)))
    owners, first = owner[order], np.cumsum(sizes) - sizes
    label, taken, out = np.arange(m), np.zeros(m, bool), []
    runs, common = np.zeros(0, np.int64), np.zeros(m, np.int64)  # of the set just answered

    def owning(runs):
        return np.bincount(owners[spread(starts[runs], counts[runs])], minlength=m)

    while True:
        open_labels, amount = np.unique(label[~taken], return_counts=True)
        if len(open_labels) <= 1:
            return out
        rest = np.flatnonzero(~taken & (label != open_labels[np.argmax(amount)]))
        a = int(rest[np.argmax(common[rest] / sizes[rest])])
        taken[a] = True
        before, runs = runs, run_of[first[a] : first[a] + sizes[a]]
        lost, gained = (np.setdiff1d(x, y, assume_unique=True) for x, y in ((before, runs), (runs, before)))
        if counts[lost].sum() + counts[gained].sum() < counts[runs].sum():
            common = common - owning(lost) + owning(gained)
        else:
            common = owning(runs)
        linked = np.flatnonzero((100 * common >= percent * (sizes[a] + sizes - common)) & (label != label[a]))
        if len(linked):
            met, where = np.unique(label[linked], return_index=True)
            out += [(a, int(linked[k])) for k in where]
            label[np.isin(label, np.append(met, label[a]))] = label[a]


def _answer(percent: int):
    def run(_, table):
        keys, once = np.unique(table.column("member").to_numpy(), return_index=True)
        blobs = table.column("members").take(pa.array(once)).to_pylist()
        links = spanning_links([np.frombuffer(x, U64) for x in blobs], percent)
        return pa.table({"a": pa.array([int(keys[x]) for x, _ in links], pa.int64()), "b": pa.array([int(keys[y]) for _, y in links], pa.int64())})

    return run, "a long, b long"


def _fetch(docs: DataFrame, reps: DataFrame, members: DataFrame, size: int, encode) -> DataFrame:
    """(member, members) of the set keys in `members`, from the documents that stand for them."""
    ids = checkpoint(members.select(F.col("member").alias("set_key")).distinct().join(reps, "set_key").select(F.coalesce("doc_id", F.lit(0)).alias("doc_id")))
    wanted = docs.sparkSession.sparkContext.broadcast(KeyFilter.build(ids, "doc_id", ids.count()))
    run, schema = _wanted(wanted, size, encode)
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _without_contained(groups: DataFrame) -> DataFrame:
    """(group, member) without the groups that lie inside a larger one, the largest that holds their first member."""
    sizes = groups.groupBy("group").agg(F.count("*").alias("c"), F.min("member").alias("member"))
    largest = groups.join(sizes.select("group", "c"), "group").groupBy("member").agg(F.max(F.struct("c", "group")).alias("top"))
    parent = sizes.join(largest, "member").where("top.c > c").select("group", F.col("top.group").alias("parent"))
    other = groups.select(F.col("group").alias("parent"), "member", F.lit(1).alias("hit"))
    inside = groups.join(parent, "group").join(other, ["parent", "member"], "left").groupBy("group").agg(F.count("*").alias("n"), F.count("hit").alias("k")).where("n = k").select("group")
    return groups.join(inside, "group", "left_anti")


def _block(blocks, seed: int = 0):
    """Which of `blocks` (a column) a set falls into."""
    return F.pmod(F.xxhash64("member", F.lit(seed)), blocks).cast("int")


def _blocks(rows: DataFrame, limit: int) -> DataFrame:
    """(head, blocks) of the heads whose rows weigh more than `limit`: blocks of half that weight. There are no more of
    them than the rows' whole weight over `limit`."""
    weight = F.greatest(F.col("n"), F.lit(SHINGLES_A_TASK // SETS_A_TASK))
    total = rows.groupBy("head").agg(F.sum(weight).alias("total")).where(F.col("total") > limit)
    return checkpoint(total.select("head", F.ceil(2 * F.col("total") / SHINGLES_A_TASK).cast("int").alias("blocks")))


def _few(table: DataFrame, count: int) -> DataFrame:
    """The table, to be broadcast if its counted rows are few enough."""
    return F.broadcast(table) if count <= BROADCAST_HEADS else table


def _compared(docs: DataFrame, reps: DataFrame, dealt: DataFrame, size: int, percent: int) -> DataFrame:
    """dealt(head, i, j, member, n), the sets of (head, i, j) in one task -> spanning links (a, b) of set keys.

    They meet as parity bitmaps first; what may link is then compared by its whole sets, so links are exact.
    """
    run, schema = _survivors(percent)
    bitmaps = _fetch(docs, reps, dealt, size, parity_bits)
    groups = checkpoint(dealt.join(bitmaps, "member").groupBy("head", "i", "j").applyInArrow(run, schema).distinct())
    groups = checkpoint(_without_contained(groups))
    run, schema = _answer(percent)
    return groups.join(_fetch(docs, reps, groups, size, lambda s: s), "member").groupBy("group").applyInArrow(run, schema)


def _links(docs: DataFrame, reps: DataFrame, heads: DataFrame, size: int, percent: int) -> DataFrame:
    """heads(head, member, n) -> spanning links (a, b) of set keys, exact on whole sets.

    A head's sets meet in one task up to SHINGLES_A_TASK and SETS_A_TASK. More are cut into blocks, so no task holds an
    unbounded group, and are answered in two rounds: first each block by itself, together with the head, so that the
    near copies of the head fall in one component; then the sets outside the head's largest component, cut into blocks
    of their own, against every block. Sets of one component need no answers of their own, so blocks don't meet in all
    pairs unless the group falls apart.
    """
    blocks = _blocks(heads, SHINGLES_A_TASK)
    large = blocks.count()
    whole = F.lit(0)
    if not large:
        return _compared(docs, reps, heads.select("head", whole.alias("i"), whole.alias("j"), "member", "n"), size, percent)
    blocks = _few(blocks, large)
    small = heads.join(blocks, "head", "left_anti").select("head", whole.alias("i"), whole.alias("j"), "member", "n")
    cut = heads.join(blocks, "head").withColumn("own", _block(F.col("blocks")))
    everywhere = F.when(F.col("head") == F.col("member"), F.sequence(whole, F.col("blocks") - 1)).otherwise(F.array("own"))
    near = checkpoint(_compared(docs, reps, small.unionByName(cut.select("head", F.explode(everywhere).alias("i"), whole.alias("j"), "member", "n")), size, percent))

    parts = connected_components(near).select(F.col("node").alias("member"), "component")
    cut = checkpoint(cut.join(parts, "member", "left").withColumn("part", F.coalesce("component", "member")).drop("component"))
    top = cut.groupBy("head", "part").count().groupBy("head").agg(F.max(F.struct("count", "part")).part.alias("part"))
    outside = checkpoint(cut.join(_few(top, large), ["head", "part"], "left_anti").select("head", "member", "n", "blocks"))
    several = _blocks(outside, 0).withColumnRenamed("blocks", "others")
    outside = outside.join(_few(several, large), "head").withColumn("i", _block(F.col("others"), 1))
    outside = outside.select("head", "i", F.explode(F.sequence(whole, F.col("blocks") - 1)).alias("j"), "member", "n")
    rest = cut.join(_few(several, large), "head").select("head", F.explode(F.sequence(whole, F.col("others") - 1)).alias("i"), F.col("own").alias("j"), "member", "n")
    return near.unionByName(_compared(docs, reps, outside.unionByName(rest), size, percent))


def jaccard_links(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """docs(doc_id, text, ...) -> (profile, components).

    profile(doc_id, n, set_key): each row's set size and set key. components(node, component): over set keys; sets
    without links are absent. Null or wordless text: n = 0, linked with
    nothing. Repeated rows keep their own profile rows. Extra columns are ignored. Empty table: both empty.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    run, schema = _profile(size)
    first = checkpoint(docs.mapInArrow(run, schema))
    profile = first.where("segment is null").select("doc_id", "n", "set_key")
    rank = np.zeros((_SEGMENTS, COUNT_SLOTS // _SEGMENTS), np.uint8)
    for k, b in first.where("segment is not null").select("segment", "counts").repartition(min(_SEGMENTS, partitions_of(spark)), "segment").mapInArrow(_add_counts, "segment int, counts binary").collect():
        rank[k] = np.frombuffer(b, np.uint8)
    reps = profile.where("n > 0").groupBy("set_key").agg(F.min("doc_id").alias("doc_id"))
    total = profile.agg(F.sum("n")).first()[0] or 0
    buckets = max(partitions_of(spark), total * (100 - percent) // 100 // POSTINGS_A_BUCKET)

    run, schema = _postings(spark.sparkContext.broadcast(rank.reshape(-1)), buckets, size, percent)
    pick, head_schema = _heads(percent)
    heads = checkpoint(docs.mapInArrow(run, schema).groupBy("bucket").applyInArrow(pick, head_schema).distinct())
    links = _links(docs, reps, heads, size, percent)
    return profile, connected_components(links)


def _to_rows(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """rows(set_key, ...) joined with sets(set_key, copies, ...), one row a set; a set of many equal rows doesn't bring them
    into one task."""
    sets = checkpoint(sets)
    hot = sets.where(F.col("copies") > COPIES)
    count = hot.count()
    if not 0 < count <= BROADCAST_HEADS:
        return rows.join(sets, "set_key")
    hot = F.broadcast(hot)
    return rows.join(hot, "set_key").unionByName(rows.join(hot.select("set_key"), "set_key", "left_anti").join(sets.where(F.col("copies") <= COPIES), "set_key"))


def near_duplicate_groups(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, n_shingles, component_id), one row a document row.

    component_id is the smallest doc_id reachable by links of Jaccard similarity >= percent / 100, itself included.
    A null doc_id never gives a component its id unless all of its ids are null.
    """
    profile, parts = jaccard_links(docs, size, percent)
    reps = profile.where("n > 0").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    linked = reps.join(parts, reps.set_key == parts.node).select("set_key", "rep", F.col("component").alias("part"))
    names = linked.groupBy("part").agg(F.min("rep").alias("component"))
    parts = linked.join(names, "part").select("set_key", "component")
    placed = reps.join(parts, "set_key", "left").select("set_key", "copies", F.coalesce("component", "rep").alias("component"))
    full = _to_rows(profile.where("n > 0"), placed).select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
    return full.unionByName(profile.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def surplus(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, set_key, stays) of the rows that are too many, each pair of the two once.

    A component is one of shingle sets, whatever ids their rows have. Its least (doc_id, set_key), null ids last, stays
    (stays true, only listed if several rows have both); all other rows with one of its sets go (stays false). Rows without
    words aren't listed.
    """
    profile, parts = jaccard_links(docs, size, percent)
    rows = profile.where("n > 0").groupBy("doc_id", "set_key").agg(F.count("*").alias("rows"))
    sets = rows.groupBy("set_key").agg(F.count("*").alias("copies"))
    sets = sets.join(parts, sets.set_key == parts.node, "left").select("set_key", "copies", F.coalesce("component", "set_key").alias("component"))
    rows = _to_rows(rows, sets)
    top = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "set_key")).alias("top"))
    top = top.select(F.col("top.doc_id").alias("top_id"), F.col("top.set_key").alias("top_key"))
    found = rows.join(top, rows.doc_id.eqNullSafe(top.top_id) & (rows.set_key == top.top_key), "left")
    return found.select("doc_id", "set_key", F.col("top_key").isNotNull().alias("stays"), "rows").where("rows > 1 or not stays").drop("rows")


def with_set_key(docs: DataFrame, wanted, size: int = SHINGLE) -> DataFrame:
    """docs(doc_id, text, ...) -> (row: all columns of docs, set_key) of the rows whose doc_id is in the filter."""

    def run(batches):
        for part in slices(batches, "text"):
            ids = part.column("id").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(U64)
            part = part.filter(pa.array(wanted.value.has(ids)))
            if not part.num_rows:
                continue
            keys = np.array([set_key(s) for s in shingle_sets(part.column("text"), size)], U64)
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(keys.view(np.int64))], ["row", "set_key"])

    types = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in docs.schema)
    return docs.select(F.struct(*docs.columns).alias("row"), "text", F.col("doc_id").cast("long").alias("id")).mapInArrow(run, f"row struct<{types}>, set_key long")
