"""SentencePiece encoding and decoding through a table of distinct chunks.

No piece of the model has a white-space marker after another character (checked when the model is loaded), so a
marked word, a run of markers and what follows up to the next marker, is segmented alike wherever it stands.
A Python worker keeps a table of the chunks it has met: each distinct chunk is segmented once, all new ones of a batch
in one call, and its ids are joined back by position. The table has two generations: once the younger has TABLE_ROWS
rows it becomes the older, whose rows come back as they are met; that bounds memory and changes nothing. Decoding reads
the ids: their pieces' spellings are gathered from one table; rows with unknown, byte or control pieces go to the library.

Null counts as the empty text, which has the begin and end ids only. A literal U+2581 is a marker, as in the library.
Very long texts are encoded whole; memory follows the texts of one batch. Repeated rows are encoded alike, ids and
ties have no influence, an empty table stays empty, and other columns, whatever their names, are carried along.
"""

from __future__ import annotations

import hashlib
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from sedimenta.llm.common import slices, table, trimmed

TABLE_ROWS = 400_000
CHUNK = re.compile(r" +[^ ]*")
MARK = "▁"
_held: dict[str, ChunkTable] = {}


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def worker_table(path: str) -> ChunkTable:
    """The table of this Python worker, which outlives a task: what one task has met, the next need not segment."""
    if path not in _held:
        _held[path] = ChunkTable(path)
    return _held[path]


class Generations(dict):
    """A dict of bounded size; what has not been asked for since the last turn of generations is forgotten."""

    def __init__(self, rows: int):
        super().__init__()
        self.rows, self.old = rows, {}

    def absent(self, keys: set) -> set:
        """The keys that neither generation has; those of the older one come back."""
        if len(self) > self.rows:
            self.old = dict(self)
            self.clear()
        gone = keys.difference(self)
        for k in gone & self.old.keys() if self.old else ():
            self[k] = self.old[k]
            gone.discard(k)
        return gone


class ChunkTable:
    def __init__(self, model_path: str, rows: int = TABLE_ROWS):
        import sentencepiece

        self.lib = lib = sentencepiece.SentencePieceProcessor(model_file=model_path)
        n = lib.vocab_size()
        pieces = [lib.id_to_piece(i) for i in range(n)]
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece crosses a white-space marker: chunks of this model depend on their neighbours")
        self.starts = np.array([p.startswith(MARK) for p in pieces])
        self.ids = Generations(rows)
        self.marker = np.array([lib.piece_to_id(MARK)], "<u4").tobytes()
        self.begin, self.end = (np.array([i], "<u4").tobytes() for i in (lib.bos_id(), lib.eos_id()))
        # what each piece adds to a decoded text; pieces that are not plain text are left to the library
        self.odd = np.array([lib.is_unknown(i) or lib.is_byte(i) or lib.is_control(i) for i in range(n)])
        plain = [b"" if o else p.replace(MARK, " ").encode() for o, p in zip(self.odd, pieces)]
        self.spelled, self.length = np.frombuffer(b"".join(plain), np.uint8), np.array([len(p) for p in plain], np.int32)
        self.at = (np.cumsum(self.length) - self.length).astype(np.int32)

    def chunks(self, text: str | None) -> list[str]:
        """The chunks, each without its first marker, which the library puts in front."""
        if not text:
            return []
        text = text.replace(MARK, " ")
        if "  " in text or text[0] == " " or text[-1] == " ":
            return [c[1:] for c in CHUNK.findall(" " + text)]
        return text.split(" ")

    def _segment(self, new: set[str]) -> None:
        """Adds the ids of chunks; those without a further marker go to the library as one text."""
        plain = [c for c in new if c and " " not in c]
        if plain:
            ids = np.array(self.lib.encode(" ".join(plain)), "<u4")
            at = np.flatnonzero(self.starts[ids])
            if len(at) == len(plain) and at[0] == 0:
                data, ends = ids.tobytes(), [*(4 * at[1:]).tolist(), 4 * len(ids)]
                self.ids.update(zip(plain, map(data.__getitem__, map(slice, [0, *ends[:-1]], ends))))
                new = [c for c in new if not c or " " in c]
        for c in new:
            self.ids[c] = np.array(self.lib.encode(c), "<u4").tobytes() if c else self.marker

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit integers, begin and end included."""
        every = [self.chunks(t) for t in texts]
        new = self.ids.absent(set(chain.from_iterable(every)))
        if new:
            self._segment(new)
        find, begin, end = self.ids.__getitem__, self.begin, self.end
        return [begin + b"".join(map(find, c)) + end for c in every]

    def decode(self, rows: list[bytes]) -> list[str]:
        """What the library's decode(ids) gives for each row of ids, begin and end included: their pieces' spellings, joined."""
        out = []
        for data in rows:
            ids = np.frombuffer(data, "<u4")[1:-1]
            if self.odd[ids].any():
                out.append(self.lib.decode(ids.tolist()))
                continue
            n = self.length[ids]
            ends = np.cumsum(n)
            text = self.spelled[np.repeat(self.at[ids] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)].tobytes().decode()
            out.append(text[1:] if text[:1] == " " else text)
        return out


def op3_pieces(spark, sf_dir: str, model_path: str | None = None) -> DataFrame:
    path = model_path or default_model()

    def run(batches):
        t = worker_table(path)
        for part in slices(batches, 256):
            ids = t.encode(part.column("text").to_pylist())
            texts = t.decode(ids)
            columns = [
                part.column("doc_id"),
                pa.array([len(i) // 4 for i in ids], pa.int64()),
                pa.array([hashlib.sha256(i).hexdigest() for i in ids], pa.string()),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x in texts], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(trimmed(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_documents(documents: DataFrame, model_path: str | None = None) -> DataFrame:
    """The columns of documents, and ids (begin and end included), n_tokens and decoded. Columns of those names are replaced."""
    path = model_path or default_model()
    kept = documents.drop("ids", "n_tokens", "decoded")
    schema = StructType([*kept.schema, StructField("ids", ArrayType(IntegerType())), StructField("n_tokens", LongType()), StructField("decoded", StringType())])

    def run(batches):
        t = worker_table(path)
        for part in slices(batches, 256):
            rows = t.encode(part.column("text").to_pylist())
            texts = t.decode(rows)
            offsets = np.concatenate([[0], np.cumsum([len(r) // 4 for r in rows])]).astype(np.int32)
            ids = pa.ListArray.from_arrays(offsets, np.frombuffer(b"".join(rows), "<i4"))
            yield pa.RecordBatch.from_arrays([*part.columns, ids, pa.array(np.diff(offsets), pa.int64()), pa.array(texts, pa.string())], names=[*part.schema.names, "ids", "n_tokens", "decoded"])

    return kept.mapInArrow(trimmed(run), schema)
