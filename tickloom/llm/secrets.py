"""Secret scans: known patterns, and strings a tokenizer's vocabulary finds no words in.

Text that people write has several characters to a token of a byte-pair vocabulary; random
strings have one or two. Digests and identifiers are left out before that test.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm import ragged

#: Kinds in the order spans with one start are listed.
KINDS = ("assign", "access", "hex", "opaque")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_KEYWORDS = re.compile(rb"password|passwd|secret|token|api_?key")
#: What may be an opaque string: long enough to tell, and without the signs that part words.
MIN_OPAQUE = 20
_OPAQUE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIN_OPAQUE)
_SIGNS = "+/_=-"
_OPAQUE_BYTES = ragged.byte_flags(b"+/_=-" + bytes(range(48, 58)) + bytes(range(65, 91)) + bytes(range(97, 123)))
_UPPER_DIGIT = ragged.byte_flags([*range(48, 58), *range(65, 91)])
_LOW_HEX = ragged.byte_flags([*range(48, 58), *range(97, 103)])
#: Characters to a token under which a string counts as random.
MAX_RATIO = 2.0
#: The part of that ratio which holds for letters of one case without a digit.
PLAIN_SHARE = 0.9
#: Hexadecimal digests: MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512; and UUIDs.
_DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}|[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12})", re.IGNORECASE)
#: Identifiers and paths: words of letters, each with digits at its end at most, joined by signs.
_IDENTIFIER = re.compile(r"(?:[A-Za-z]?[a-z]+[0-9]{0,4}|[A-Z]+[0-9]{0,4}|[0-9]{1,4})(?:[_/=+-]+(?:[A-Za-z]?[a-z]+[0-9]{0,4}|[A-Z]+[0-9]{0,4}|[0-9]{1,4}))+")

_encodings: dict[str, object] = {}


def encoding(path: str):
    """The tiktoken encoding of a file of ranks, one for each worker process."""
    if path not in _encodings:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding("ranks", pat_str=r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9]+", mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def is_opaque(string: str, ranks: str, max_ratio: float = MAX_RATIO) -> bool:
    """Whether a string has letters, is no digest or identifier, and falls into short tokens.

    Without a digit and in one case (but for its first letter) it must fall into still shorter ones, as long words can be rare.
    """
    if not any(c.isalpha() for c in string) or _DIGEST.fullmatch(string) or _IDENTIFIER.fullmatch(string):
        return False
    if not any(c.isdigit() for c in string) and (string[1:].islower() or string.isupper()):
        max_ratio *= PLAIN_SHARE
    return len(string) < max_ratio * len(encoding(ranks).encode_ordinary(string))


def scan(text: str, ranks: str, max_ratio: float = MAX_RATIO) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all secrets of a text in order; opaque ones overlap none of the others.

    Where others cut a string, each stretch that is left and long enough is judged by itself, without signs at the cuts.
    """
    spans = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    spans += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    spans += [(m.start(), 2, m.end()) for m in _HEX.finditer(text) if m.end() - m.start() >= 24]
    base: list[tuple[int, int]] = []  # disjoint, in order
    for s, _, e in sorted(spans):
        if base and s <= base[-1][1]:
            base[-1] = (base[-1][0], max(e, base[-1][1]))
        else:
            base.append((s, e))
    k = 0
    for m in _OPAQUE.finditer(text):
        at, end = m.span()
        while k < len(base) and base[k][1] <= at:
            k += 1
        cuts = [*itertools.takewhile(lambda b: b[0] < end, itertools.islice(base, k, None)), (end, end)]  # noqa: B023
        for s, e in cuts:
            a, b = at, s
            if b - a >= MIN_OPAQUE:
                a += len(text[a:b]) - len(text[a:b].lstrip(_SIGNS)) if a > m.start() else 0
                b -= len(text[a:b]) - len(text[a:b].rstrip(_SIGNS)) if b < end else 0
                if is_opaque(text[a:b], ranks, max_ratio):
                    spans.append((a, 3, b))
            at = max(at, e)
    return sorted(spans)


def _suspects(column: pa.Array) -> set[int]:
    """Rows that can hold a secret at all: found on the bytes, before any text becomes a Python string."""
    out: set[int] = set()
    for first, x, bounds in ragged.slices(column):
        for flags, least in ((_OPAQUE_BYTES, MIN_OPAQUE), (_LOW_HEX, 24), (_UPPER_DIGIT, 20)):
            flag = flags[x]
            starts, ends, row = ragged.runs(flag, bounds)
            long = ends - starts >= least
            if flags is _OPAQUE_BYTES:
                letters = np.concatenate([[0], np.cumsum(((x | 32) >= 97) & ((x | 32) <= 122))])
                long &= letters[ends] > letters[starts]
            out.update((row[long] + first).tolist())
        for m in _KEYWORDS.finditer(ragged.ascii_lower(x).tobytes()):
            out.add(first + int(np.searchsorted(bounds, m.start(), "right")) - 1)
    return out


_SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
_ARROW = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])


def find(docs: DataFrame, ranks: str, max_ratio: float = MAX_RATIO, redact: bool = False, drop: tuple[str, ...] = ()) -> DataFrame:
    """docs with secrets: an array of (kind, start, end) in code points, end exclusive, in order.

    redact replaces each stretch of secrets in text by [SECRET]. A null or empty text has none
    and stays. Repeated rows are treated alike; other columns stay, save one named secrets.
    """
    fields = [T.StructField("secrets", T.ArrayType(_SPAN))]
    if redact:
        fields = [T.StructField("text", T.StringType()), *fields]

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        column = ragged.column(batch, "text")
        spans: list[list[dict]] = [[] for _ in range(batch.num_rows)]
        texts: dict[int, str] = {}
        for k in _suspects(column):
            text = column[k].as_py()
            found = scan(text, ranks, max_ratio)
            spans[k] = [{"kind": KINDS[kind], "start": s, "end": e} for s, kind, e in found]
            if found and redact:
                texts[k] = redacted(text, found)
        out = [pa.array(spans, pa.list_(_ARROW))]
        if redact:
            new = column
            if texts:
                mask = np.zeros(batch.num_rows, bool)
                mask[list(texts)] = True
                import pyarrow.compute as pc

                new = pc.replace_with_mask(column, pa.array(mask), pa.array([texts[k] for k in sorted(texts)], column.type))
            out = [new, *out]
        return out

    return ragged.append(docs, run, fields, drop)


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """text with each stretch that spans cover replaced by one mark."""
    out, at = [], 0
    for s, _, e in spans:
        if s >= at:
            out += [text[at:s], "[SECRET]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def digest(found: DataFrame) -> DataFrame:
    """What find() found, as counts, a hash of the base spans and a list of all."""
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of_kind = lambda k: lambda s: s["kind"] == k
    base = F.filter("secrets", lambda s: s["kind"] != KINDS[3])
    return found.select(
        "doc_id",
        *[F.size(F.filter("secrets", of_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(said(base).cast("binary"), 256).alias("base_sha256"),
        said(F.col("secrets")).alias("spans"),
    )


def default_ranks() -> str:
    """The byte-level vocabulary of the installed public tokenizers, as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def query(spark, sf_dir: str) -> DataFrame:
    """op8: secrets of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digest(find(docs, default_ranks(), drop=("text",)))


def spans_sha256(spans: list[tuple[int, int, int]]) -> str:
    """The hash digest() gives for base spans; for tests."""
    return hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans).encode()).hexdigest()
