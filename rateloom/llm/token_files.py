"""Token ids as length-delimited binary records with masked checksums and a separate offset index.

Format. A data file is 8 bytes, "RLTOKEN" and the bytes an id takes (2 where the vocabulary has at most 65,536 entries,
else 4), and a run of records. Each record is
    8 bytes   length of the payload, little-endian
    4 bytes   masked checksum of these 8 bytes
    payload   token ids as little-endian unsigned integers
    4 bytes   masked checksum of the payload
The checksum is CRC-32 (IEEE); the mask rotates it right by 15 bits and adds 0xA282EAD8, so that a checksum of data
that itself holds checksums stays meaningful. The index file of a data file has 24 bytes a record, little-endian:
its offset in the file and its payload's length, unsigned 64-bit, and its doc_id, signed 64-bit (a null id is the
least value), so that a shuffled reader seeks any record without a scan. A manifest table names the files in order,
with their numbers of records and ids.

Documents are range-partitioned by doc_id and sorted, so files are in ascending order and no sort is global to a task.
Each task attempt writes a file of its own name, and only the file names that successful attempts return enter the
manifest: a lost executor or a second attempt leaves a stray file, never a wrong one. Files are opened by URI, so any
store that pyarrow knows will do.

Encoding. The tokenizer's pre-tokens never span the boundary between a non-blank character and a single blank followed
by a non-blank one, so texts are cut there, a few megabytes at a time, and each different piece is encoded once. Pieces of
earlier batches are kept up to a bound. Everything else is encoded by the tokenizers library.

Defined results: a null or empty text is the end id alone; null ids come first, repeated ids are ordered by their
text; repeated rows each give a record; an empty table gives no files and no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import struct as binary
import sys
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from rateloom.llm.arrow import struct
from rateloom.session import materialize, scratch, table

END_ID = 0
TOKENIZER = "byte_bpe_50k.json"
GROUP = 256
#: Characters of the pieces kept between batches, besides those of a batch.
KEPT_CHARS = 12_000_000
MAGIC = b"RLTOKEN"
MASK_DELTA = 0xA282EAD8
#: Characters encoded at a time.
FLUSH_BYTES = 4 << 20
INDEX = np.dtype([("offset", "<u8"), ("length", "<u8"), ("doc_id", "<i8")])
NO_ID = -(1 << 63)
CUT = re.compile(r"(?<=\S)(?= \S)")
OTHER_SPACE = [chr(c) for c in range(0x3001) if chr(c).isspace() and c != 32]


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = binary.pack("<Q", len(payload))
    return b"".join((head, binary.pack("<I", masked_crc(head)), payload, binary.pack("<I", masked_crc(payload))))


def unframe(data: bytes) -> bytes:
    """The payload of one record; raises where a checksum differs."""
    head = data[:8]
    (length,) = binary.unpack("<Q", head)
    payload = data[12 : 12 + length]
    if len(payload) != length or binary.unpack("<I", data[8:12])[0] != masked_crc(head) or binary.unpack("<I", data[12 + length : 16 + length])[0] != masked_crc(payload):
        raise ValueError("a record's checksum differs")
    return payload


def uneasy(text: str) -> bool:
    """Whether a blank stands beside other white space."""
    return "  " in text or any(c in text and (c + " " in text or " " + c in text) for c in OTHER_SPACE)


def pieces(text: str) -> list[str]:
    """Keys of the parts of a text whose ids, one after the other, are those of the text.

    A key that begins with a blank stands for what follows the blank, any other for a blank and itself.
    """
    if uneasy(text):  # cut only between a non-blank and ' ' + non-blank
        return [" " + p for p in CUT.split(text)]
    words = text.split(" ")
    words[0] = " " + words[0]
    return words if len(words[0]) > 1 else words[1:]  # a leading blank belongs to the first word


def literal(key: str) -> str:
    return key[1:] if key[:1] == " " else " " + key


class Encoder:
    """Texts to the bytes of their ids. Ids take two bytes where the vocabulary allows."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if hasattr(self.tokenizer.model, "_resize_cache"):
            self.tokenizer.model._resize_cache(0)  # it would see each word once
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        # a character of a byte-level token stands for a byte
        self.sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, k in vocabulary.items():
            self.sizes[k] = len(token)
        self.known: dict[str, bytes] = {}
        self.kept = 0
        self.width = 2 if len(self.sizes) <= 1 << 16 else 4

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, f"<u{self.width}") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def words(self, new: list[str]) -> dict[str, bytes]:
        """Ids of keys. Plain words go to the tokenizer many at a time; byte lengths tell whose ids are whose."""
        other = [p for p in new if not p or p[0].isspace() or p[-1].isspace()]
        plain = list(set(new).difference(other)) if other else new
        out = {p: x.tobytes() for p, x in zip(other, self.ids(list(map(literal, other))), strict=True)}
        groups = [plain[k : k + GROUP] for k in range(0, len(plain), GROUP)]
        for group, x in zip(groups, self.ids([" " + " ".join(g) for g in groups]), strict=True):
            ends = np.cumsum([len(p) + 1 if p.isascii() else len(p.encode("utf-8", "surrogatepass")) + 1 for p in group])
            cuts = ((np.searchsorted(np.cumsum(self.sizes[x]), ends) + 1) * self.width).tolist()
            data = x.tobytes()
            out.update(zip(group, [data[i:j] for i, j in zip([0, *cuts], cuts, strict=False)], strict=True))
        return out

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of all texts; each different piece of them is encoded once, and kept for the next ones."""
        cut = [pieces(t) for t in texts]
        if self.kept > KEPT_CHARS:
            self.known, self.kept = {}, 0
        new = list(set().union(*cut).difference(self.known))
        self.kept += sum(map(len, new))
        self.known.update(self.words(new))
        get = self.known.__getitem__
        out = [b"".join(map(get, c)) for c in cut]
        return out


def encoder(path: str) -> Encoder:
    """One for each Python worker and tokenizer file."""
    held = sys.__dict__.setdefault("_rateloom_encoders", {})
    if path not in held:
        held[path] = Encoder(path)
    return held[path]


def opened(uri: str, mode: str):
    """A file by URI; the folder is made where the store has folders."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    if mode == "w":
        store.create_dir(path.rpartition("/")[0], recursive=True)
        return store.open_output_stream(path)
    return store.open_input_file(path)


def width_of(data) -> int:
    """Bytes an id, from a data file's beginning."""
    head = data.read(len(MAGIC) + 1)
    if head[:-1] != MAGIC or head[-1] not in (2, 4):
        raise ValueError("not a token file")
    return head[-1]


MANIFEST = "part int, file string, n_records long, n_ids long"


def write_records(documents: DataFrame, folder: str, tokenizer: str, *, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID, files: int | None = None) -> DataFrame:
    """Write data and index files into the folder; returns the manifest, in the order of part."""
    spark = documents.sparkSession
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", "text")
    schema = struct(MANIFEST)
    arrow = to_arrow_schema(schema)

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        name = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}"
        encode = encoder(tokenizer)
        end = end_id.to_bytes(encode.width, "little")
        data = index = None
        at, records, n_ids = len(MAGIC) + 1, 0, 0
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            start = 0
            while start < len(texts):  # a few megabytes at a time, however long the texts
                stop, held, some = start, 0, []
                while stop < len(texts) and (held < FLUSH_BYTES or stop == start):
                    some.append(texts[stop].as_py() or "")
                    held += len(some[-1])
                    stop += 1
                payloads = [b + end for b in encode(some)]
                places = np.empty(len(payloads), INDEX)
                if data is None:
                    data, index = opened(f"{name}.bin", "w"), opened(f"{name}.idx", "w")
                    data.write(MAGIC + bytes([encode.width]))
                places["length"] = sizes = np.array(list(map(len, payloads)), np.int64)
                places["offset"] = at + np.cumsum(sizes + 16) - sizes - 16
                places["doc_id"] = [NO_ID if doc is None else doc for doc in ids[start:stop]]
                data.write(b"".join(map(frame, payloads)))
                index.write(places.tobytes())
                at += int((sizes + 16).sum())
                n_ids += int(sizes.sum()) // encode.width
                records += len(payloads)
                start = stop
        if data is not None:
            data.close()
            index.close()
            yield pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip((part, name, records, n_ids), arrow, strict=True)], schema=arrow)

    return materialize(rows.mapInArrow(run, schema), "token_manifest")


def read_records(manifest: DataFrame) -> DataFrame:
    """A row per record, from the files: doc_id, start (ids of all records before it), n_tokens, ids_crc32."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    files = manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    schema = struct("doc_id long, start long, n_tokens long, ids_crc32 long")
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for name, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with opened(f"{name}.idx", "r") as index, opened(f"{name}.bin", "r") as data:
                    width = width_of(data)
                    while raw := index.read(INDEX.itemsize * 4096):
                        places = np.frombuffer(raw, INDEX)
                        sums = np.empty(len(places), np.int64)
                        for k, (offset, length, _) in enumerate(places.tolist()):
                            data.seek(offset)
                            sums[k] = zlib.crc32(np.frombuffer(unframe(data.read(length + 16)), f"<u{width}").astype("<u4"))
                        n = places["length"].astype(np.int64) // width
                        ids = places["doc_id"]
                        columns = (pa.array(ids, mask=ids == NO_ID), first + np.cumsum(n) - n, n, sums)
                        first += int(n.sum())
                        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    wide = files.select("file", "start").repartition(max(1, manifest.count()))
    return wide.mapInArrow(run, schema)


def read_record(name: str, k: int) -> tuple[int | None, np.ndarray]:
    """The k-th record of a data file, found through the index: (doc_id, ids)."""
    with opened(f"{name}.idx", "r") as index, opened(f"{name}.bin", "r") as data:
        index.seek(INDEX.itemsize * k)
        width = width_of(data)
        (offset, length, doc) = np.frombuffer(index.read(INDEX.itemsize), INDEX)[0].tolist()
        data.seek(offset)
        return (None if doc == NO_ID else doc), np.frombuffer(unframe(data.read(length + 16)), f"<u{width}")


def op8_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    manifest = write_records(table(spark, sf_dir, "documents"), scratch(spark, "tokens"), public_tokenizers.path(TOKENIZER))
    return read_records(manifest)
