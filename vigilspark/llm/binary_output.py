"""Token ids as binary files: independent Zstandard frames, a trailing seek table, a checksum for each frame.

A file holds documents in ascending id order. Its data frames hold whole documents, about FRAME_IDS ids each, as
little-endian unsigned integers of two or four bytes; one more frame is the index (id, frame, first id in the frame
and number of ids of every document). The seek table is that of the public seekable Zstandard format: a skippable
frame with compressed size, size and checksum (lower half of XXH64 of the content) of every frame, found from the
last nine bytes. ``read_documents`` opens the index and decompresses only the frames that hold what is asked for.

Spark sorts the documents by range, so a file is a range of ids; rows with one id are spread by a hash of the text.
A task streams its rows to a file of its own name in the shared folder and returns one manifest row, and only the
manifest, written by Spark, says which files count: what a lost or repeated task leaves is never read. First ids of
files are a running sum over the manifest, as long as the number of files.

A null text is empty and has the end id only. Null ids sort first. Repeated rows are separate documents, other
columns are ignored, and an empty table gives an empty manifest.
"""

from __future__ import annotations

import json
import os
import re
import struct
import sys
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigilspark.llm.bpe import vocabulary
from vigilspark.session import materialize, shared_dir

#: Ids in a frame, unless one document has more.
FRAME_IDS = 1 << 17
#: Words kept with their ids in each Python worker.
WORDS_KEPT = 400_000
#: Words of letters asked for in one text.
JOINED = 256
#: Latin letters between ASCII punctuation. An apostrophe may begin an ending; U+0130 becomes two characters.
_FRAMED = re.compile("([!-&(-/:-@\\[-`{-~]*)([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u012F\u0131-\u024F]+)([!-&(-/:-@\\[-`{-~]*)")
_SKIPPABLE, _SEEKABLE, _CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
_INDEX = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("frame", "<u4"), ("first", "<u4"), ("n", "<u8")])


class LibraryEncoder:
    """The ``tokenizers`` library, asked once for each word: its normaliser and splitter never join what white space
    separates, so the ids of a text are those of its words.

    A tokenizer that splits letters from other characters and marks the ends of its pieces is asked for a word and the
    punctuation around it apart, and for many words of letters at once: each is one piece, so it ends where the next
    mark is. Where there are more marks than words, the words are asked one by one.
    """

    def __init__(self, content: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(content)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self._known: dict[str, bytes] = {}
        self._later: dict[str, bytes] = {}
        rules = json.loads(content)
        end = rules["model"].get("end_of_word_suffix")
        pattern = json.dumps(rules.get("pre_tokenizer"))
        self.splits = bool(end) and r"|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+" in pattern
        self._added = [token["content"] for token in rules.get("added_tokens", [])]
        self._ends = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        if end:
            self._ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith(end)]] = True

    def _ask(self, words: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        kind = "H" if self.width == 2 else "I"
        out = [array(kind, e.ids) for e in found]
        if sys.byteorder == "big":
            for ids in out:
                ids.byteswap()
        return [ids.tobytes() for ids in out]

    def _ask_letters(self, words: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(words), JOINED):
            some = words[at : at + JOINED]
            found = self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0]
            ids = np.array(found.ids, dtype=f"<u{self.width}")
            ends = np.flatnonzero(self._ends[ids]) + 1
            if len(ends) != len(some) or ends[-1] != len(ids):
                out += self._ask(some)
                continue
            whole, cuts = ids.tobytes(), [0, *(ends * self.width).tolist()]
            out += [whole[a:b] for a, b in zip(cuts, cuts[1:])]
        return out

    def _learn(self, words: set[str]) -> None:
        letters, others, framed = set(), set(), []
        for word in words:
            if self.splits and word.isalpha():
                letters.add(word)
            elif self.splits and (parts := _FRAMED.fullmatch(word)) and not any(token in word for token in self._added):
                before, core, after = parts.groups()
                framed.append((word, before, core, after))
                letters.add(core)
                others.update((before, after))
            else:
                others.add(word)
        known, later = self._known, self._later
        for asked, ask in ((letters, self._ask_letters), (others - {""}, self._ask)):
            fresh = list(asked.difference(known).difference(later))
            (known if len(known) < WORDS_KEPT else later).update(zip(fresh, ask(fresh)))
        for word, before, core, after in framed:
            later[word] = b"".join(known[p] if p in known else later[p] for p in (before, core, after) if p)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white space to Python alone
            return self._ask([text])[0]
        words = text.split()
        distinct, later = set(words), self._later
        new = distinct.difference(self._known).difference(later)
        if new:
            if len(later) + 3 * len(new) > WORDS_KEPT:  # a word and its pieces
                later.clear()
                new = distinct.difference(self._known)
            self._learn(new)
        out = list(map(self._known.get, words))
        if None in out:
            out = [later[word] if ids is None else ids for word, ids in zip(words, out)]
        return b"".join(out)


_ENCODERS: dict[int, LibraryEncoder] = {}


def _encoder(content: str) -> LibraryEncoder:
    key = hash(content)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = LibraryEncoder(content)
    return _ENCODERS[key]


class Writer:
    """Writes one file to a binary stream."""

    def __init__(self, stream, width: int, frame_ids: int = FRAME_IDS):
        self.stream, self.width, self.frame_ids = stream, width, frame_ids
        self._codec = zstandard.ZstdCompressor(level=3)
        self._table: list[bytes] = []
        self._parts: list[bytes] = []
        self._index: list[tuple] = []
        self._held = 0
        self.ids = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n = len(ids) // self.width
        if self._held and self._held + n > self.frame_ids:
            self._flush()
        self._index.append((doc_id or 0, doc_id is None, len(self._table), self._held, n))
        self._parts.append(ids)
        self._held += n
        self.ids += n

    def _frame(self, content: bytes) -> None:
        packed = self._codec.compress(content)
        self.stream.write(packed)
        self._table.append(struct.pack("<III", len(packed), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))

    def _flush(self) -> None:
        self._frame(b"".join(self._parts))
        self._parts, self._held = [], 0

    def close(self) -> None:
        self._flush()
        self._frame(np.array(self._index, dtype=_INDEX).tobytes())
        body = b"".join(self._table) + struct.pack("<IBI", len(self._table), _CHECKSUMS, _SEEKABLE)
        self.stream.write(struct.pack("<II", _SKIPPABLE, len(body)) + body)


class Reader:
    """Reads one file from a seekable binary stream."""

    def __init__(self, stream, size: int, width: int):
        self.stream, self.width = stream, width
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != _SEEKABLE or flags != _CHECKSUMS:
            raise ValueError("no seek table")
        self.table = np.frombuffer(self._at(size - 9 - 12 * n, 12 * n), dtype="<u4").reshape(n, 3)
        self.offsets = np.concatenate([[0], np.cumsum(self.table[:, 0], dtype=np.int64)])
        self.index = np.frombuffer(self.frame(n - 1), dtype=_INDEX)

    def _at(self, begin: int, n: int) -> bytes:
        self.stream.seek(begin)
        return self.stream.read(n)

    def frame(self, i: int) -> bytes:
        packed, size, check = (int(x) for x in self.table[i])
        content = zstandard.ZstdDecompressor().decompress(self._at(int(self.offsets[i]), packed), max_output_size=size)
        if xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {i} does not match its checksum")
        return content

    def documents(self, wanted: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """Place in the index and ids of all documents, or of those at ``wanted`` (ascending)."""
        held, content = -1, b""
        for i in range(len(self.index)) if wanted is None else wanted:
            entry = self.index[i]
            if entry["frame"] != held:
                held, content = int(entry["frame"]), self.frame(int(entry["frame"]))
            yield int(i), np.frombuffer(content, f"<u{self.width}", int(entry["n"]), int(entry["first"]) * self.width)


def _open(path: str):
    system, name = fs.FileSystem.from_uri(path)
    return system, name


def write_ids(docs: DataFrame, path: str, tokenizer: str, text: str = "text", doc_id: str = "doc_id", end_id: int = 1, frame_ids: int = FRAME_IDS) -> DataFrame:
    """Encode ``docs`` and write their ids to new files under ``path``. Returns the manifest, a written table:
    part (files in id order), file, width, documents, ids, first (ids in earlier files)."""
    spark = docs.sparkSession
    content = vocabulary(spark, tokenizer)
    folder = f"{path.rstrip('/')}/{uuid.uuid4().hex}"
    schema = pa.schema(
        [("part", pa.int32()), ("file", pa.string()), ("width", pa.int32()), ("documents", pa.int64()), ("ids", pa.int64())]
    )

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(content.value)
        part = TaskContext.get().partitionId()
        name = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.zst"
        writer = stream = None
        documents = 0
        end = np.array([end_id], dtype=f"<u{encoder.width}").tobytes()
        for batch in batches:
            for key, value in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                if writer is None:
                    system, place = _open(name)
                    system.create_dir(place.rpartition("/")[0], recursive=True)
                    stream = system.open_output_stream(place, compression=None)
                    writer = Writer(stream, encoder.width, frame_ids)
                writer.add(key, encoder.encode(value) + end)
                documents += 1
        if writer is not None:
            writer.close()
            stream.close()
            yield pa.RecordBatch.from_pylist(
                [{"part": part, "file": name, "width": encoder.width, "documents": documents, "ids": writer.ids}], schema=schema
            )

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    written = materialize(rows.mapInArrow(save, "part int, file string, width int, documents long, ids long"))
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return written.withColumn("first", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def read_ids(manifest: DataFrame) -> DataFrame:
    """All documents of the files of a manifest: doc_id, start (ids before it), ids."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (row for batch in batches for row in batch.to_pylist()):
            system, place = _open(row["file"])
            with system.open_input_file(place) as stream:
                reader = Reader(stream, stream.size(), row["width"])
                entries, lists, held = [], [], 0
                start = row["first"] + np.cumsum(reader.index["n"], dtype=np.int64) - reader.index["n"].astype(np.int64)
                for i, ids in reader.documents():
                    entries.append(i)
                    lists.append(ids.astype(np.int32))
                    held += len(ids)
                    if held > 1 << 20 or i == len(reader.index) - 1:
                        at = np.array(entries)
                        ends = np.cumsum([0, *map(len, lists)]).astype(np.int32)
                        keys = pa.array(reader.index["doc_id"][at], mask=reader.index["null"][at] == 1)
                        values = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(lists)))
                        yield pa.RecordBatch.from_arrays([keys, pa.array(start[at]), values], schema=schema)
                        entries, lists, held = [], [], 0

    files = max(1, manifest.count())  # one task for each file
    return manifest.repartition(files).mapInArrow(load, "doc_id long, start long, ids array<int>")


def read_documents(manifest: DataFrame, wanted: list[int]) -> DataFrame:
    """The ids of the documents named, decompressing only the frames that hold them: doc_id, ids."""
    names = np.array(sorted(wanted), dtype=np.int64)
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (row for batch in batches for row in batch.to_pylist()):
            system, place = _open(row["file"])
            with system.open_input_file(place) as stream:
                reader = Reader(stream, stream.size(), row["width"])
                at = np.flatnonzero(np.isin(reader.index["doc_id"], names) & (reader.index["null"] == 0))
                found = [{"doc_id": int(reader.index["doc_id"][i]), "ids": ids.tolist()} for i, ids in reader.documents(at)]
            if found:
                yield pa.RecordBatch.from_pylist(found, schema=schema)

    return manifest.mapInArrow(load, "doc_id long, ids array<int>")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("ids")
        flat, ends = lists.flatten().to_numpy().astype("<u4"), lists.offsets.to_numpy()
        ends = ends - ends[0]
        crcs = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:])]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("start"), pa.array(np.diff(ends).astype(np.int64)), pa.array(crcs, pa.int64())],
            names=["doc_id", "start", "n_tokens", "ids_crc32"],
        )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: ids of ``documents``, written to files and read back."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    manifest = write_ids(docs, f"{shared_dir(spark)}/ids", public_tokenizers.path("word_bpe_49k.json"))
    return read_ids(manifest).mapInArrow(_digests, "doc_id long, start long, n_tokens long, ids_crc32 long")
