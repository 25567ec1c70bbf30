"""Secret scan: fixed patterns, and random strings found by their poor token efficiency.

A byte-pair vocabulary learned on text packs several characters into a token.
A random string of letters and digits has few of its merges, so it needs nearly
a token for each character. A run of at least ``min_chars`` key characters with
fewer than ``min_ratio`` characters a token is reported as ``random``, unless it
is a bare digest, a UUID, a number, or overlaps what the patterns have found.

Results: one row per input row, in any order. A null or empty text has no span.
Repeated rows and null ids each give their own row; other columns are ignored.
Texts are scanned whole. Spans are code points, end exclusive.
"""

import base64
import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The patterns of the contract.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}

RUN = re.compile(r"[A-Za-z0-9+/_=-]+")
DIGEST = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)\Z")
DIGEST_CHARS = frozenset({32, 40, 56, 64, 96, 128})
IDENTIFIER = re.compile(
    r"(?:[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}|[0-9+/_=-]+)\Z"
)
# Fixed value: how this vocabulary cuts text into words.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SPANS = "array<struct<kind:string,start:int,end:int>>"
_KIND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
_encodings: dict = {}


def _encoding(content: bytes):
    """The vocabulary as an encoder; built once per worker."""
    import tiktoken

    if content not in _encodings:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
        _encodings[content] = tiktoken.Encoding(
            "given", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}
        )
    return _encodings[content]


def pattern_spans(text: str) -> list[tuple[int, int, str]]:
    found = [
        (m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]
    ]
    for kind, pattern in (("access", ACCESS), ("hex", HEX)):
        found += [
            (m.start(), m.end(), kind)
            for m in pattern.finditer(text)
            if m.end() - m.start() >= LEAST[kind]
        ]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def excluded(run: str) -> bool:
    """Digests of a usual length, UUIDs, numbers and rulers are no secrets by themselves."""
    return len(run) in DIGEST_CHARS and bool(DIGEST.match(run)) or bool(IDENTIFIER.match(run))


def random_spans(text, taken, encode, min_chars: int, min_ratio: float):
    """``taken``: spans by start. Both they and the runs are passed once."""
    at = reach = 0  # spans passed, which start before the run ends, and their furthest end
    found = []
    for m in RUN.finditer(text):
        if m.end() - m.start() < min_chars or excluded(m[0]):
            continue
        while at < len(taken) and taken[at][0] < m.end():
            reach = max(reach, taken[at][1])
            at += 1
        if reach > m.start():
            continue
        if m.end() - m.start() < min_ratio * len(encode(m[0])):
            found.append((m.start(), m.end(), "random"))
    return found


def scanner(content: bytes, min_chars: int, min_ratio: float):
    """A function from an Arrow column of texts to the spans of each."""
    maybe = [
        r"(?i:password|passwd|secret|token|api_?key)",
        "AKIA",
        f"[0-9a-f]{{{LEAST['hex']}}}",
        f"[A-Za-z0-9+/_=-]{{{min_chars}}}",
    ]

    def scan(texts: pa.Array) -> list[list[tuple[int, int, str]]]:
        texts = pc.fill_null(texts, "")
        hit = pc.match_substring_regex(texts, maybe[0])
        for p in maybe[1:]:
            hit = pc.or_(hit, pc.match_substring_regex(texts, p))
        out: list = [[] for _ in range(len(texts))]
        for k in pc.indices_nonzero(hit).to_pylist():
            text = texts[k].as_py()
            base = pattern_spans(text)
            more = random_spans(text, base, _encoding(content).encode_ordinary, min_chars, min_ratio)
            out[k] = sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2])))
        return out

    return scan


def _vocabulary(spark: SparkSession, path: str):
    """Sent once to each executor; a vocabulary has a fixed size (under 1 MB here)."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def find_secrets(
    docs: DataFrame,
    vocabulary: str = VOCABULARY,
    min_chars: int = 20,
    min_ratio: float = 2.0,
    ident: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``ident, spans``: all spans by start, then by kind in the order of ``KINDS``."""
    content = _vocabulary(docs.sparkSession, vocabulary)

    def run(batches):
        scan = scanner(content.value, min_chars, min_ratio)
        for batch in batches:
            rows = [[{"kind": k, "start": a, "end": b} for a, b, k in s] for s in scan(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(rows, _KIND)], [ident, "spans"]
            )

    chosen = docs.select(ident, text)
    return chosen.mapInArrow(run, f"`{ident}` {dict(chosen.dtypes)[ident]}, spans {SPANS}")


def redact(
    docs: DataFrame,
    vocabulary: str = VOCABULARY,
    min_chars: int = 20,
    min_ratio: float = 2.0,
    text: str = "text",
    mark: str = "[SECRET]",
) -> DataFrame:
    """The same rows and columns with each secret (overlapping spans as one) replaced by ``mark``.

    A null text stays null, a text without secrets stays as it is.
    """
    content = _vocabulary(docs.sparkSession, vocabulary)

    @F.pandas_udf("string")
    def clean(texts):
        scan = scanner(content.value, min_chars, min_ratio)
        out = texts.copy()
        for k, spans in enumerate(scan(pa.array(texts, pa.string()))):
            if not spans:
                continue
            whole, parts, at = texts.iloc[k], [], 0
            for start, end, _ in spans:
                if start >= at:
                    parts += [whole[at:start], mark]
                at = max(at, end)
            out.iloc[k] = "".join([*parts, whole[at:]])
        return out

    return docs.withColumn(text, clean(F.col(text)))
