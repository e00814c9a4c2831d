"""Packing: tokenise whole documents and fill context windows of several sizes with little padding.

Documents are routed to tiers by length (512, 1024, 2048, 4096 tokens), each tier is
packed best-fit, the gaps of long windows are filled with pieces of shorter tiers, and
the sequences are dealt into step groups of equal work.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from array import array
from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator
from functools import cached_property
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tickloom.llm import ragged

#: Windows a piece may be packed into, shortest first; the last is the longest context.
TIERS = (512, 1024, 2048, 4096)
#: Tokens, and pieces of documents, packed together in one task. A task holds no more than these and one document.
BLOCK_TOKENS, BLOCK_ROWS = 4_000_000, 50_000
#: Sequences that form one training step.
STEP_SEQUENCES = 8
#: Chunks, and pieces of chunks, that a worker remembers.
_CACHE_WORDS = 100_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step long, ids binary"


def _alphabet() -> dict[int, str]:
    """Byte-level alphabet: visible Latin-1 bytes stand for themselves, the others for U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(0x100 + k) for k, b in enumerate(rest)}


#: Marks a word's end in the spelling of a token; no UTF-8 text has this byte.
_END = b"\xff"


def vocabulary(path: str) -> tuple[dict[bytes, int], list[tuple[bytes, bytes]]]:
    """Tokens as bytes with their ids, and the merges in order, of a byte-level BPE file with word ends.

    Without the file's added tokens, which are no parts of words: see added().
    """
    model = json.loads(Path(path).read_text())["model"]
    byte = {c: bytes([b]) for b, c in _alphabet().items()}
    suffix = model["end_of_word_suffix"]

    def spelling(token: str) -> bytes:
        last = token.endswith(suffix)
        return b"".join(byte[c] for c in (token[: -len(suffix)] if last else token)) + _END * last

    pairs = [tuple(map(spelling, m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
    made = {a + b for a, b in pairs}
    ids = {spelling(t): i for t, i in model["vocab"].items() if not (t.startswith("<|") and t.endswith("|>"))}
    return {t: i for t, i in ids.items() if t in made or len(t.removesuffix(_END)) <= 1}, pairs


def added(path: str) -> dict[str, int]:
    """The file's added tokens with their ids; the library finds their exact text before anything else.

    Other kinds, which also take white space or go by the normalised text, are refused.
    """
    tokens = json.loads(Path(path).read_text())["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in tokens):
        raise ValueError("only added tokens that stand for their exact text are known")
    return {t["content"]: t["id"] for t in tokens}


def unreachable(path: str) -> list[bytes]:
    """Tokens that merging by the listed pairs never makes.

    The fast encoder joins two neighbours whenever their join is a token, the tokenizer only by
    listed pairs. Inside the span of a token, merging runs as it does on the token alone; so if
    each token comes out of its own bytes by listed pairs, no unlisted pair of neighbours ever
    joins to a token, and both give the same ids. Tokens that don't come out are never made; the
    fast encoder leaves them out. This is about the words between added tokens.
    """
    ids, pairs = vocabulary(path)
    order = {p: k for k, p in enumerate(pairs)}
    if [ids[a + b] for a, b in pairs] != sorted(ids[a + b] for a, b in pairs):
        raise ValueError("ids of this vocabulary don't follow the order of its merges")
    out = []
    for token in ids:
        core = token.removesuffix(_END)
        parts = [core[i : i + 1] for i in range(len(core))]
        if token.endswith(_END) and parts:
            parts[-1] += _END
        while len(parts) > 1:
            rank, at = min((order.get(p, len(order)), i) for i, p in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == len(order):
                out.append(token)
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return out


class Encoder(dict):
    """White-space chunk -> little-endian uint32 ids, by the vocabulary of a tokenizer file.

    A text is cut at the file's added tokens. The file's normaliser (NFC, lower case) and its word
    pattern never look across white space, so the ids of each part are its chunks' ids one after
    another, and a chunk is encoded once. never: what unreachable() gives for the file.
    """

    def __init__(self, path: str, never: list[bytes]):
        super().__init__()
        import tiktoken

        self.path = path
        self.pieces: dict[str, bytes] = {}
        self.added = {t: array("I", [i]).tobytes() for t, i in added(path).items()}
        # The first that begins, and of those the longest, as the library finds them.
        self.cuts = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
        ids, _ = vocabulary(path)
        ranks = {t: i for t, i in ids.items() if t not in set(never)}
        self.bpe = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    @cached_property
    def whole(self):
        """The file's own library, loaded for the few texts that need it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def piece(self, piece: str) -> bytes:
        """Ids of one match of the word pattern, kept as well: chunks differ by punctuation and case."""
        out = self.pieces.get(piece)
        if out is None:
            out = array("I", self.bpe(piece.encode() + _END)).tobytes()
            if len(self.pieces) >= _CACHE_WORDS:
                self.pieces.clear()
            if len(piece) <= 64:
                self.pieces[piece] = out
        return out

    def __missing__(self, chunk: str) -> bytes:
        if chunk.isascii():
            text = chunk.lower()
        else:
            text = chunk if unicodedata.is_normalized("NFC", chunk) else unicodedata.normalize("NFC", chunk)
            # Lowered letter by letter, as the file's normaliser does: no final sigma.
            text = "".join(map(str.lower, text)) if "\u03a3" in text else text.lower()
        if text.isalpha():
            out = self.piece(text)
        elif text[-1] in ".,!?;:" and text[:-1].isalpha():
            out = self.piece(text[:-1]) + self.piece(text[-1])
        else:
            out = b"".join(map(self.piece, self.words.findall(text)))
        if len(self) >= _CACHE_WORDS:
            self.clear()
        if len(chunk) <= 64:
            self[chunk] = out
        return out

    def encode(self, text: str) -> bytes:
        """Ids of a whole text. U+001C to U+001F split Python strings but are no white space to the tokenizer."""
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if self.cuts is not None and "<|" in text and self.cuts.search(text):
            return b"".join(self.added.get(part) or self.encode(part) for part in self.cuts.split(text))
        return b"".join(map(self.__getitem__, text.split()))


_encoders: dict[str, Encoder] = {}


def encoder(path: str, never: list[bytes]) -> Encoder:
    """One encoder for each worker process, kept between tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path, never)
    return _encoders[path]


def plan(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> tuple[list[list[tuple[int, int, int]]], list[int]]:
    """Pack documents of these token counts: sequences of (document, start, length), and each one's tier.

    A document longer than the longest window is cut into full windows and a rest. A rest goes
    to the tier of the smallest window that holds it. Each tier from the longest down opens a
    window for its longest unplaced rest, fills the gap best-fit from its own tier and the
    shorter ones, and closes what remains by cutting the next shorter rest to size. What fills no
    window of its tier goes into windows of smaller powers of two, so no sequence is padded.
    """
    top = tiers[-1]
    sequences: list[list[tuple[int, int, int]]] = []
    sizes: list[int] = []
    rest: list[tuple[int, int, int]] = []  # (length, document, start), by length
    for d, n in enumerate(lengths):
        full = n // top
        for k in range(full):
            sequences.append([(d, k * top, top)])
            sizes.append(top)
        if n % top:
            rest.append((n % top, d, full * top))
    rest.sort()
    tier_of = lambda n: tiers[bisect_left(tiers, n)]
    left = sum(r[0] for r in rest)
    while rest:
        window = tier_of(rest[-1][0])
        if left < window:
            # What is left fills no window of this tier: smaller powers of two take it exactly.
            window = 1 << (left.bit_length() - 1)
        sequence, room = [], window
        while room and rest:
            at = bisect_left(rest, (room + 1,)) - 1
            if at >= 0 and (rest[at][0] == room or room > tiers[0] // 4 or not sequence):
                n, d, s = rest.pop(at)
                sequence.append((d, s, n))
                room -= n
            else:  # cut the shortest rest that is longer than the gap, or take the longest there is
                n, d, s = rest.pop(bisect_left(rest, (room,)) if at + 1 < len(rest) else at)
                take = min(n, room)
                sequence.append((d, s, take))
                room -= take
                if n > take:
                    insort(rest, (n - take, d, s + take))
        sequences.append(sequence)
        sizes.append(window)
        left -= window
    return sequences, sizes


def steps(sizes: list[int], group: int = STEP_SEQUENCES) -> list[int]:
    """A step for each sequence: longest first, always to the step with the fewest tokens, group at most in a step."""
    import heapq

    n = -(-len(sizes) // group)
    heap = [(0, 0, k) for k in range(n)]
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        tokens, count, k = heapq.heappop(heap)
        out[i] = k
        if count + 1 < group:
            heapq.heappush(heap, (tokens + sizes[i], count + 1, k))
    return out


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, tiers: tuple[int, ...] = TIERS, block_tokens: int = BLOCK_TOKENS, block_rows: int = BLOCK_ROWS, with_ids: bool = True) -> DataFrame:
    """Pieces of all documents, packed into sequences; columns as PIECES says, ids as little-endian uint32.

    Each task packs its own rows block by block, so nothing is shuffled and a lost task is made
    again alone; sequence_id holds the task's number in its upper bits. A null or empty text has
    the end id alone. Repeated rows are packed as often as they come; extra columns are left out;
    an empty table gives no piece; doc_id is a long, null ones stay. A tier is its window's size:
    each sequence is a full window, or the remainder of a block as windows of smaller powers of
    two, so nothing is padded. Where a text holds an added token of the file, as the library finds
    them in raw text, it has that token's id.
    """
    if any(t & (t - 1) for t in tiers) or sorted(tiers) != list(tiers):
        raise ValueError("tiers must be ascending powers of two")
    never = unreachable(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, never)
        end = np.array([end_id], "<u4").tobytes()
        task = TaskContext.get().partitionId() << 40
        issued = [0, 0]  # sequences, steps
        names: list = []
        ids: list[bytes] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            lengths = [len(x) // 4 for x in ids]
            sequences, sizes = plan(lengths, tiers)
            step = steps(sizes)
            rows = deque()
            for k, sequence in enumerate(sequences):
                offset = 0
                for d, s, n in sequence:
                    part = ids[d][4 * s : 4 * (s + n)]
                    rows.append((names[d], s, n, zlib.crc32(part), lengths[d], task + issued[0] + k, offset, sizes[k], task + issued[1] + step[k], part if with_ids else None))
                    offset += n
            issued[0] += len(sequences)
            issued[1] += 1 + max(step, default=-1)
            kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64(), pa.binary()]
            columns = list(zip(*rows, strict=True))
            for at in range(0, len(rows), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 20_000], k) for c, k in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in PIECES.split(", ")])

        for batch in (piece for b in batches for piece in ragged.pieces(b)):
            keys = ragged.column(batch, "doc_id").to_pylist()
            for key, text in zip(keys, ragged.column(batch, "text"), strict=True):
                got = enc.encode(text.as_py() or "") + end
                names.append(key)
                ids.append(got)
                held += len(got) // 4
                if held >= block_tokens or len(ids) >= block_rows:
                    yield from flush()
                    names, ids, held = [], [], 0
        if ids:
            yield from flush()

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def default_tokenizer() -> str:
    """The word-level BPE file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark, sf_dir: str) -> DataFrame:
    """op10: the pieces of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, default_tokenizer(), with_ids=False).drop("ids")
