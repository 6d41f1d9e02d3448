"""Secret scan: fixed patterns, and dictionary-primed zstandard novelty (operator 5).

The identifiers of the corpus (words in code positions, counted by the different texts that hold them) make a dictionary.
A candidate is a long token-like string in a sensitive context. It is measured by the bytes that it adds to the compressed
form of the code around it, under that dictionary; what stays nearly incompressible is reported, as a span of kind
`novel`, unless a base span covers it.
"""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import Words, byte_class, kept_columns, slices

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "novel")
LEAST_ASSIGN, LEAST_ACCESS = 6, 20

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
SENSITIVE = re.compile(r"key|secret|token|passw|auth|credential|bearer|private|signature|session|cookie", re.IGNORECASE)
CONTEXT = 80  # characters on either side in which a sensitive word counts
CODE = 400  # characters on either side that a candidate is measured against
# A string is reported if its marginal bytes come to this share of those of its own characters in random orders: about 1
# for random strings of any alphabet and length, less where the dictionary or the code around holds parts of it.
NOVEL = 0.93
SHUFFLES = 4
LEAST_BYTES = 0.45  # marginal bytes a character below which nothing is reported (repeated characters, known words)
ONE_CASE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")  # no order of letters tells a long word from a secret of one case: not reported
DICTIONARY_WORDS = 4096  # the identifiers in most texts; their number bounds the broadcast
LEAST_TEXTS = 3  # different texts that an identifier must stand in, so that a secret's own letters are none
SHORTEST, LONGEST = 4, 24  # letters
COMMON = (
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 0000000000 1111111111 xxxxxxxxxx XXXXXXXXXX ---------- ========== __________ "
    "https://www.example.com/index.html http://localhost:8080/api/v1/users authorization authentication access_token refresh_token client_secret "
    "client_id api_key apikey secret_key private_key public_key password passwd username user_name session_id session_token cookie signature "
    "credentials bearer basic header request response configuration settings environment variable "
)
LETTERS = byte_class([(0x00, 0x40), (0x5B, 0x60), (0x7B, 0xFF)])
BEFORE, AFTER = (np.isin(np.arange(256), list(x)) for x in (b"_$/.-@<", b"_=:([{<"))


def _identifiers(batches):
    """(word, text) of each different word of a text that stands in a code position: next to `_`, before = : ( [ { < or
    behind $ / . - @ <."""
    for part in slices(batches, "text"):
        words = Words(part.column("text"), LETTERS, lower=True)
        data = np.concatenate([[0], words.data, [0]]).astype(np.uint8)
        length = words.ends - words.starts
        pick = np.flatnonzero((length >= SHORTEST) & (length <= LONGEST) & (BEFORE[data[words.starts]] | AFTER[data[words.ends + 1]]))
        text = part.column("h").to_numpy(zero_copy_only=False)[words.text_of_word()[pick]]
        raw = words.data.tobytes()
        found = sorted({(raw[a:b].decode(), h) for a, b, h in zip(words.starts[pick].tolist(), words.ends[pick].tolist(), text.tolist())})
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in found], pa.string()), pa.array([h for _, h in found], pa.int64())], ["word", "h"])


def identifiers(docs: DataFrame, words: int = DICTIONARY_WORDS) -> list[str]:
    """docs(text) -> the identifiers that stand in most different texts (LEAST_TEXTS at least), the most frequent last.
    Copies of a text count once; ties go by name."""
    pairs = docs.where("text is not null").select("text", F.xxhash64("text").alias("h")).mapInArrow(_identifiers, "word string, h long").distinct()
    counts = pairs.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_TEXTS)
    return [r.word for r in reversed(counts.orderBy(F.desc("n"), "word").limit(words).collect())]


class Novelty:
    def __init__(self, words: list[str]):
        dictionary = zstandard.ZstdCompressionDict((COMMON + " ".join(w.capitalize() for w in words) + " " + " ".join(words) + " ").encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        dictionary.precompute_compress(level=19)
        self.compressor = zstandard.ZstdCompressor(level=19, dict_data=dictionary, write_content_size=False, write_dict_id=False)

    def novelty(self, before: str, candidate: str, after: str) -> float:
        """The candidate's marginal bytes over the mean of its own shuffles'; 0 if they are few for its length."""
        around = (before + " " + after + " ").encode("utf-8", "replace")
        alone = len(self.compressor.compress(around))
        added = lambda word: len(self.compressor.compress(around + word.encode())) - alone
        own, draw = added(candidate), random.Random(candidate)  # the same orders for the same string
        if own < LEAST_BYTES * len(candidate):
            return 0.0
        return own * SHUFFLES / max(sum(added("".join(draw.sample(candidate, len(candidate)))) for _ in range(SHUFFLES)), 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base matches, in code points."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def novel_spans(text: str, base: list[tuple[int, int, int]], novelty: Novelty) -> list[tuple[int, int, int]]:
    out, at, reach = [], 0, 0
    for m in CANDIDATE.finditer(text):
        s, e = m.span()
        while at < len(base) and base[at][0] < e:  # base spans and candidates both ascend
            reach = max(reach, base[at][2])
            at += 1
        if reach > s or ONE_CASE.fullmatch(m.group()) or not (SENSITIVE.search(text, max(0, s - CONTEXT), s) or SENSITIVE.search(text, e, e + CONTEXT)):
            continue
        if novelty.novelty(text[max(0, s - CODE) : s], m.group(), text[e : e + CODE]) >= NOVEL:
            out.append((s, 3, e))
    return out


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def redacted(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    """The text with each stretch that spans cover replaced by the mark."""
    out, at = [], 0
    for s, _, e in sorted(spans):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join(out) + text[at:]


def _scan(words, mark: str):
    def run(batches):
        novelty = Novelty(words.value)
        for part in slices(batches, "text"):
            texts = part.column("text").to_pylist()
            rows: list[list] = [[] for _ in range(6)]
            for text in texts:
                base = base_spans(text or "")
                spans = base + novel_spans(text or "", base, novelty)
                counts = [sum(k == kind for _, k, _ in base) for kind in range(3)]
                clean = text if not spans else redacted(text, spans, mark)
                for column, v in zip(rows, (*counts, hashlib.sha256(written(base).encode()).hexdigest(), written(spans), clean)):
                    column.append(v)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([part.column("row"), *(pa.array(c, t) for c, t in zip(rows, types))], ["row", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "clean_text"])

    return run, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, clean_text string"


def scan(docs: DataFrame, keep: list[str] | None = None, mark: str = "[SECRET]") -> DataFrame:
    """docs(text, ...) -> the `keep` columns with n_assign, n_access, n_hex, base_sha256, spans, clean_text.

    clean_text is the text with every span replaced by `mark`; null stays null and has no spans. Spans are whole matches
    in code points. Repeated rows are scanned each; ties in start go by kind. A text is scanned whole, in time that grows
    with its length. Other columns may have any name. A kept column named like a result is a ValueError; without `keep` it is left out.
    Empty table: empty result.
    """
    keep = kept_columns(docs, keep, ["n_assign", "n_access", "n_hex", "base_sha256", "spans", "clean_text"])
    types = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    run, schema = _scan(docs.sparkSession.sparkContext.broadcast(identifiers(docs)), mark)
    return docs.select(F.struct(*keep).alias("row"), "text").mapInArrow(run, f"row struct<{types}>, {schema}").select("row.*", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "clean_text")
