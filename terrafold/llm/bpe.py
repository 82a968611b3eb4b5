"""Byte-level BPE by forced boundaries.

A pair of bytes that occurs inside no token of the vocabulary can never end up
inside one token, so a cut between them is certain: merges on its two sides
never meet. Texts are cut there, each distinct fragment is encoded once for a
batch, and the ids are concatenated.

A cut must not move the pre-tokenizer's own boundaries either. It looks ahead
only past white space and at an apostrophe, so no cut is made after a white
character or before an apostrophe; the strings of added tokens count as tokens,
so none is cut. All other positions are decided by the bytes on the two sides.

Cases: null is the empty text, which has no ids; strings of added tokens inside
a text are encoded as the library does by default; texts of any length are encoded
whole; repeated rows each get their ids; an empty table gives an empty result; other
columns, whatever their names, pass by.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.llm import kernel
from terrafold.llm.rows import texts_of
from terrafold.llm.tokenizers_public import Bounded, open_tokenizer, tokenizer_path
from terrafold.runtime import ship

#: Bytes of fragments and their ids that a worker keeps.
CACHED_BYTES = 96 << 20

#: Last bytes of the white characters beyond ASCII, in UTF-8.
_WHITE_TAILS = [0x85, 0xA0, *range(0x80, 0x8B), 0xA8, 0xA9, 0xAF, 0x9F]


def _byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ForcedBoundaryBpe:
    """Encoder and decoder for one byte-level tokenizer file."""

    def __init__(self, path: str) -> None:
        self.tokenizer = open_tokenizer(path)
        letters = _byte_letters()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        added = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.token_bytes = [b""] * (max(vocabulary.values()) + 1)
        inside = np.zeros(1 << 16, bool)
        for token, i in vocabulary.items():
            raw = token.encode() if token in added else bytes(letters[c] for c in token)
            self.token_bytes[i] = raw
            for a, b in zip(raw, raw[1:], strict=False):
                inside[a << 8 | b] = True
        self.forced = self._certain(inside)
        self.cache = Bounded(CACHED_BYTES)

    @staticmethod
    def _certain(inside: np.ndarray) -> np.ndarray:
        """[byte before << 8 | byte after]: whether a cut between them is certain and harmless."""
        before = np.zeros(256, bool)
        before[0x21:0x7F] = True
        before[0x80:0xC0] = True
        before[_WHITE_TAILS] = False
        after = np.ones(256, bool)
        after[0x80:0xC0] = False  # inside a character
        after[ord("'")] = False
        return ~inside & (before[:, None] & after[None, :]).ravel()

    def fragments(self, raw: bytes) -> list[bytes]:
        data = np.frombuffer(raw, np.uint8)
        pair = data[:-1].astype(np.uint16)
        pair <<= 8
        pair |= data[1:]
        cuts = (np.flatnonzero(self.forced[pair]) + 1).tolist()
        return [raw[a:b] for a, b in zip([0, *cuts], [*cuts, len(raw)], strict=True)]

    def encode(self, texts: Iterable[bytes]) -> Iterator[bytes]:
        """For each text its ids, as little-endian unsigned 32-bit integers."""
        split = [self.fragments(x) if len(x) > 1 else [x] * len(x) for x in texts]
        known = self.cache
        new = {f for own in split for f in own if f not in known}
        known.room(new, 3)
        if not known:
            new = {f for own in split for f in own}
        order = list(new)
        for a in range(0, len(order), 4096):
            part = order[a : a + 4096]
            for f, e in zip(part, self.tokenizer.encode_batch_fast([f.decode() for f in part], add_special_tokens=False), strict=True):
                known[f] = np.array(e.ids, "<u4").tobytes()
        for own in split:
            yield b"".join(map(known.__getitem__, own))

    def decode(self, ids: bytes) -> str:
        """The text of packed ids, special tokens included."""
        return b"".join(map(self.token_bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@functools.cache
def open_bpe(path: str) -> ForcedBoundaryBpe:
    return ForcedBoundaryBpe(path)


_SQL = "doc_id long, n_tokens long, ids binary, decoded string, ids_sha256 string, decoded_sha256 string"


def encode_decode(documents: DataFrame, path: str | None = None, full: bool = True) -> DataFrame:
    """Per document its ids (packed) and the text decoded from them, with their digests.

    full=False leaves ids and decoded null, where only digests are wanted.
    """
    ship(documents.sparkSession)
    path = path or tokenizer_path("byte_bpe_50k.json")
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = open_bpe(path)
        for batch in batches:
            for at, texts in kernel.chunks(batch):
                n, ids, texts_back, id_sums, text_sums = [], [], [], [], []
                for packed in bpe.encode(texts):
                    back = bpe.decode(packed)
                    n.append(len(packed) // 4)
                    id_sums.append(hashlib.sha256(packed).hexdigest())
                    text_sums.append(hashlib.sha256(back.encode()).hexdigest())
                    ids.append(packed if full else None)
                    texts_back.append(back if full else None)
                rest = (pa.array(x, f.type) for x, f in zip((n, ids, texts_back, id_sums, text_sums), list(schema)[1:], strict=True))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(texts)), *rest], schema=schema)

    return texts_of(documents).mapInArrow(run, _SQL)


def op4_forced_boundary_bpe(spark, sf_dir: str) -> DataFrame:
    out = encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"), full=False)
    return out.select("doc_id", F.col("n_tokens"), "ids_sha256", "decoded_sha256")
