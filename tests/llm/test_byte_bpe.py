"""Operator 11 against the rank library: whole texts, appends, edits, odd rows."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

pytest.importorskip("spaxelflow.llm")
from spaxelflow.llm import byte_bpe, queries  # noqa: E402


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers as P
    import tiktoken

    table = byte_bpe._tools(byte_bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), P.PATTERN)[0]
    return tiktoken.Encoding("reference", pat_str=P.PATTERN, mergeable_ranks=table.ranks, special_tokens={})


def texts():
    draw = random.Random(5)
    # The last ones are classed differently by Unicode versions, or are white space of one class only.
    parts = ["the ", "cat", "  ", "\n", "'ll", "'S", " x1", "中文", "é", "12", " tion", "!!", "ab" * 20, "\t", "<|endoftext|>", "\U0001f600", "՘", "ᲊ", "\U000105c0", "\x1c", "\u0085", "　"]
    out = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 60))) for _ in range(300)]
    return [*out, "", None, " ", "a" * 30_000, "=" * 5_000 + "x", "word " * 40_000, out[0], out[0]]


def test_ids_and_bytes_equal_the_library(spark, reference):
    rows = [(i if i != 7 else None, t, [1], "d", 0.5) for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids array<int>, decoded string, last double").repartition(3)
    encoded = byte_bpe.encode(docs, ["doc_id"])
    found = {r.doc_id: r.ids for r in encoded.collect()}
    assert found == {i: reference.encode_ordinary(t or "") for i, t, *_ in rows}
    back = {r.doc_id: bytes(r.decoded) for r in byte_bpe.decode(encoded, ["doc_id"]).collect()}
    assert back == {i: (t or "").encode() for i, t, *_ in rows}
    with pytest.raises(ValueError, match="ids"):
        byte_bpe.encode(docs, ["doc_id", "ids"])
    with pytest.raises(ValueError, match="decoded"):
        byte_bpe.decode(encoded.withColumn("decoded", F.lit(1)), ["decoded"])


def test_query(spark, reference, tmp_path):
    rows = list(enumerate(texts()))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = set()
    for i, t in rows:
        ids = reference.encode_ordinary(t or "")
        want.add((i, len(ids), sha(",".join(map(str, ids)).encode()), sha((t or "").encode())))
    out = queries.op11_byte_bpe(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert set(map(tuple, out.collect())) == want


def test_empty_table_and_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert byte_bpe.encode(empty, ["doc_id"]).collect() == []
    ids = spark.createDataFrame([(1, None), (2, []), (3, [0, 1])], "doc_id long, ids array<int>")
    assert [len(r.decoded) for r in byte_bpe.decode(ids, ["doc_id"]).orderBy("doc_id").collect()][:2] == [0, 0]
    for wrong in ([1 << 30], [-1], [None]):
        with pytest.raises(Exception, match="id"):
            byte_bpe.decode(spark.createDataFrame([(1, wrong)], "doc_id long, ids array<int>"), ["doc_id"]).collect()


def test_table_holds_each_prefixs_last_token(reference):
    import public_tokenizers as P

    table = byte_bpe._tools(byte_bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), P.PATTERN)[0]
    draw = random.Random(2)
    for _ in range(200):
        piece = bytes(draw.choice(b"abcdeing thon\xc3\xa9") for _ in range(draw.randint(1, 40)))
        last = [-1]
        table.extend(piece, last)
        assert last[1:] == [reference._encode_single_piece(piece[: k + 1])[-1] for k in range(len(piece))]


def test_edits_and_appends_give_the_table_of_the_new_text(spark, reference):
    draw = random.Random(9)
    rows = []
    for i, t in enumerate(t or "" for t in texts()):
        append = i % 3 == 0
        at = 1 << 40 if append else draw.randint(0, len(t))
        rows.append((i, t, at, 0 if append else draw.choice([None, 0, 1, 7]), draw.choice([None, "x", "ab" * 30, " the", "中 文"]), "e"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, place long, gone long, fresh string, extra string")
    cut = [F.col("place"), F.coalesce("gone", F.lit(0)), F.coalesce("fresh", F.lit(""))]
    after = docs.withColumn("text", F.concat(F.expr("substring(text, 1, least(place, length(text)))"), cut[2], F.expr("substring(text, least(place, length(text)) + coalesce(gone, 0) + 1)")))
    edited = byte_bpe.edit(byte_bpe.tabulate(docs, ["doc_id", "place", "gone", "fresh"]), ["doc_id"], "place", "gone", "fresh")
    found = {r.doc_id: r for r in edited.collect()}
    for r in byte_bpe.tabulate(after, ["doc_id"]).collect():
        new = found[r.doc_id]
        assert (new.text, new.ids, new.starts, bytes(new["last"])) == (r.text, r.ids, r.starts, bytes(r["last"]))
        assert new.ids == reference.encode_ordinary(new.text)
    # an append to 30,000 letters and an edit in the midst of them work out few prefixes
    letters = "".join(draw.choice("abcdefgh") for _ in range(30_000))
    long = spark.createDataFrame([(1, "a" * 30_000, 1 << 40, 0, "aab"), (2, letters, 20_000, 1, "zz")], "doc_id long, text string, place long, gone long, fresh string")
    few = byte_bpe.edit(byte_bpe.tabulate(long, ["doc_id", "place", "gone", "fresh"]), ["doc_id"], "place", "gone", "fresh")
    assert all(r.computed < 200 for r in few.collect())
