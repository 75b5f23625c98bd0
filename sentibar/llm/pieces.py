"""SentencePiece encoding and decoding with a distinct-chunk table (operator 3).

The model's pieces have the space marker only at their start, so no piece
crosses the border between a character and a following marker.  A text is cut
at those borders into marked words ("chunks"); each distinct chunk is
segmented once by the library, and ids and decoded text are joined back by
position.  The table lives in a task: occurrences (far more than distinct
chunks) never leave it, there is no shuffle, and the table is emptied when it
reaches ``TABLE_CHUNKS`` entries, so memory stays bounded.

Defined cases: null and empty texts give the begin and end ids only and decode
to the empty text; repeated rows give repeated results; ids may be null; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import pick, read

MODEL = "piece_bpe_32k.model"
TABLE_CHUNKS = 200_000
MARK = "▁"
TAIL = "\ud800"  # no text has it: half of a surrogate pair is not UTF-8

_codecs: dict[str, "ChunkCodec"] = {}


class ChunkCodec:
    """Chunk tables over one loaded model."""

    def __init__(self, path: str, table_chunks: int = TABLE_CHUNKS):
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        if any(MARK in sp.id_to_piece(i).lstrip(MARK) for i in range(sp.get_piece_size())):
            raise ValueError("pieces of this model cross space markers")
        self.begin, self.end = (np.array([i], "<u4").tobytes() for i in (sp.bos_id(), sp.eos_id()))
        self.limit = table_chunks
        self.ids: dict[str, bytes] = {}
        self.text: dict[str, str] = {}

    @staticmethod
    def chunks(text: str) -> list[str]:
        """The chunks of a text, each without its first marker.

        The library puts one marker in front of a text, so splitting at single
        spaces takes exactly one marker off every part; an empty part is a
        marker that belongs to the chunk after it (or ends the text)."""
        parts = text.replace(MARK, " ").split(" ")
        if "" not in parts:
            return parts
        out, spaces = [], 0
        for p in parts:
            if p:
                out.append(" " * spaces + p)
                spaces = 0
            else:
                spaces += 1
        if spaces:
            out.append(" " * spaces if out else " " * (spaces - 1))
            # after a word the markers are all that the chunk has: see `learn`
            if len(out) > 1 or parts[0]:
                out[-1] = TAIL + out[-1]
        return out

    def learn(self, chunks: set[str]) -> None:
        if len(self.ids) + len(chunks) > self.limit:
            self.ids.clear()
            self.text.clear()
        new = [c for c in chunks if c not in self.ids]
        if not new:
            return
        plain = [c for c in new if c[:1] != TAIL]
        for c, ids, text in zip(plain, (coded := self.sp.encode(plain, num_threads=1)),
                                self.sp.decode(coded) if coded else []):
            self.ids[c] = np.array(ids, "<u4").tobytes()
            self.text[c] = " " + text
        for c in new:
            if c[:1] == TAIL:  # markers at the end of a text
                ids = self.sp.encode_as_ids(c[2:]) if len(c) > 2 else [self.sp.piece_to_id(MARK)]
                self.ids[c] = np.array(ids, "<u4").tobytes()
                self.text[c] = " " + self.sp.decode(ids)

    def encode_decode(self, texts: list[str]) -> tuple[list[bytes], list[str]]:
        """Ids (little-endian unsigned 32 bit, with begin and end) and decoded text."""
        cut = [self.chunks(t) if t else [] for t in texts]
        self.learn(set().union(*cut))
        ids, text = self.ids, self.text
        return ([self.begin + b"".join([ids[c] for c in one]) + self.end for one in cut],
                ["".join([text[c] for c in one])[1:] for one in cut])


def codec(path: str) -> ChunkCodec:
    if path not in _codecs:
        _codecs[path] = ChunkCodec(path)
    return _codecs[path]


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """``(id, ids, decoded)``: ids as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = codec(path)
        for batch in batches:
            col = batch.column("text").fill_null("")
            _, at = W.text_buffer(col)
            for lo, hi, _, _ in W.slices(at.view(), at, 1 << 20):
                ids, decoded = tables.encode_decode(col.slice(lo, hi - lo).to_pylist())
                yield pa.record_batch([batch.column("id").slice(lo, hi - lo),
                                       pa.array(ids, pa.binary()), pa.array(decoded, pa.string())],
                                      names=["id", "ids", "decoded"])

    src = pick(docs, id=id_col, text=text_col).withColumn("id", F.col("id").cast("long"))
    return src.mapInArrow(run, "id long, ids binary, decoded string")


def digests(coded: DataFrame) -> list:
    return [F.col("id").alias("doc_id"),
            (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
            F.sha2("ids", 256).alias("ids_sha256"),
            F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")]


def op3_sentencepiece(spark, sf_dir):
    coded = encode_decode(read(spark, sf_dir, "documents"), model_path())
    return coded.select(*digests(coded))
