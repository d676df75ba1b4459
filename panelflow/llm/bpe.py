"""BPE encoding and decoding with content-defined chunks that are encoded once.

A text is cut after ASCII spaces that a rolling hash of the bytes before them selects, so
equal stretches of different documents give equal chunks wherever they stand.  A worker process
encodes a chunk the first time it meets it and looks it up from then on, in this document and the
next ones.  Chunk joins: between characters of ``PLAIN`` the tokenizer itself guarantees them
(white space is dropped and no piece spans it; checked when it is loaded).  At any other join the
two chunks are encoded once more as one; if that differs from the two parts, the joint chunk takes
their place and is compared with the next one, until both agree.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from panelflow.llm.texts import blocks

CHUNKS_KEPT = 500_000  # per worker process; then the table starts anew
PIECES_KEPT = 400_000
MERGE_ONE_IN = 8  # of the spaces, so many are no cut
#: Characters whose normal form, case and class are the same in every Unicode version.
PLAIN = re.compile("[ \t\n\r!-~À-ÖØ-öø-ÿ]*")
PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\s0-9a-zß-öø-ÿ]+")


def _byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte: itself, or one from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Codec:
    """One tokenizer file with its tables, one per worker process."""

    def __init__(self, path: str, keep: int = CHUNKS_KEPT):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.model = self.whole.model
        spec = json.loads(self.whole.to_str())
        kinds = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        split = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
        self.plain_rules = kinds == ["NFC", "Replace", "Lowercase"] and split.get("behavior") == "Removed" and "\\s" in str(split.get("pattern"))
        self.specials = [t["content"] for t in spec.get("added_tokens", [])]
        self.table = pa.array([self.whole.id_to_token(i) or "" for i in range(self.whole.get_vocab_size())], pa.string())
        self.letters = _byte_letters()
        self.keep = keep
        self.chunks: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.odd: set[bytes] = set()

    def direct(self, text: str) -> bytes:
        return np.asarray(self.whole.encode(text, add_special_tokens=False).ids, np.int32).tobytes()

    def piece(self, piece: str) -> bytes:
        letters = piece if piece.isascii() else "".join(self.letters[b] for b in piece.encode())
        ids = np.array([t.id for t in self.model.tokenize(letters)], np.int32).tobytes()
        if len(self.pieces) >= PIECES_KEPT:
            self.pieces.clear()
        self.pieces[piece] = ids
        return ids

    def chunk(self, raw: bytes) -> bytes:
        text = raw.decode()
        plain = self.plain_rules and PLAIN.fullmatch(text) and not any(s in text for s in self.specials)
        if plain:
            known = self.pieces
            ids = b"".join([known.get(p) or self.piece(p) for p in PIECE.findall(text.lower())])
        else:
            ids = self.direct(text)
        if len(self.chunks) >= self.keep:
            self.chunks.clear()
            self.odd.clear()
        if not plain:
            self.odd.add(raw)
        self.chunks[raw] = ids
        return ids

    def joined(self, chunks: list[bytes]) -> bytes:
        """The chunks' ids, joins of odd chunks repaired."""
        done: list[tuple[bytes, bytes]] = []
        for raw in chunks:
            ids = self.chunks.get(raw)
            if ids is None:
                ids = self.chunk(raw)
            while done and (raw in self.odd or done[-1][0] in self.odd):
                left, before = done[-1]
                both = self.direct((left + raw).decode())
                if both == before + ids:
                    break
                done.pop()
                raw, ids = left + raw, both
                self.odd.add(raw)
            done.append((raw, ids))
        return b"".join([ids for _, ids in done])

    def encode(self, raw: bytes, cuts: list[int]) -> bytes:
        """ids, as bytes of int32, of one text whose chunks end at ``cuts``."""
        begin, chunks = 0, []
        for end in cuts:
            chunks.append(raw[begin:end])
            begin = end
        get = self.chunks.get
        found = [get(c) for c in chunks]
        if None in found:
            for k, ids in enumerate(found):
                if ids is None:
                    found[k] = self.chunk(chunks[k])
        if self.odd and not self.odd.isdisjoint(chunks):
            return self.joined(chunks)
        return b"".join(found)


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def chunk_ends(data: np.ndarray, merge_one_in: int = MERGE_ONE_IN) -> np.ndarray:
    """Where chunks of ``data`` end: after spaces, but for those that the rolling hash merges."""
    spaces = np.flatnonzero(data == 32)
    spaces = spaces[spaces >= 3]
    window = np.zeros(len(spaces), np.uint32)
    for k in (1, 2, 3):
        window = window * np.uint32(0x01000193) + data[spaces - k]
    window ^= window >> np.uint32(15)
    window *= np.uint32(0x9E3779B1)
    return spaces[(window >> np.uint32(12)) % np.uint32(merge_one_in) != 0] + 1 if merge_one_in > 1 else spaces + 1


def encode_block(tables: Codec, data: np.ndarray, bounds: np.ndarray) -> pa.ListArray:
    ends = chunk_ends(data)
    raw = data.tobytes()
    places = np.searchsorted(ends, bounds, "right")
    out = []
    for a, b, i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), places[:-1], places[1:]):
        inner = ends[i:j]
        cuts = (inner[inner < b] - a).tolist()
        out.append(tables.encode(raw[a:b], [*cuts, b - a]) if b > a else b"")
    sizes = np.cumsum([0, *[len(x) // 4 for x in out]])
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.frombuffer(b"".join(out), np.int32)))


def decode_block(tables: Codec, ids: pa.ListArray) -> pa.Array:
    """Tokens joined by a space, as a tokenizer without a decoder writes them; unknown ids are left out."""
    flat = ids.flatten()
    words = tables.table.take(flat)
    return pc.binary_join(pa.ListArray.from_arrays(ids.offsets, words), " ").fill_null("")


def encode_decode(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, ids array<int>, decoded string.

    Null and empty texts have no ids and decode to the empty text; repeated and null ids are rows like
    any other; other columns of the input play no part.  The result of a row depends on its text
    alone.  A stretch without a space is one chunk, whatever its length.
    ``tokenizer_file`` is a path that every executor can open.
    """
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = plain.schema["doc_id"].dataType.simpleString()
    return plain.mapInArrow(_runner(tokenizer_file), f"doc_id {kind}, ids array<int>, decoded string")


def _runner(path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = codec(path)
        for batch in batches:
            for first, end, data, bounds in blocks(batch.column("text")):
                ids = encode_block(tables, data, bounds)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, end - first), ids, decode_block(tables, ids)], names=["doc_id", "ids", "decoded"]
                )

    return run
