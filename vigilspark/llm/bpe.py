"""BPE encoding by backtracking over longest matches, and decoding through an offset table.

The encoder gives exactly the tokens of merging in rank order, in linear time. An Aho-Corasick automaton finds the
longest token at every position in one pass. From left to right the longest is taken unless it can't stand next to
the token before it; then its next shorter prefix is tried, and when none is left the previous token is taken back
and its end is closed. Whether two tokens can stand side by side - no merge would have crossed their border first -
is looked up in a table of pairs, filled as pairs are met.

A vocabulary file in the ``tokenizers`` JSON format gives vocabulary and merges; its path is a parameter, and each
task reads it once (or gets its content, see ``vocabulary``). Supported: BPE with an end-of-word suffix, NFC, lower
case, white space dropped, the split pattern of that file, and byte symbols. Splitting on white space comes first:
no token spans it, so words are encoded once each and kept in tables of fixed size.

Decoding joins the token strings with spaces, as that format without a decoder does. Token strings lie in one
buffer; ids select offsets and lengths, and one gather copies all bytes.

Null texts are empty: no ids, empty text. Strings of the two special tokens inside a text become their ids.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterator, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilspark.llm import workers

#: Words kept with their ids in each Python worker: the first ones for good, later ones until they are as many.
WORDS_KEPT = 150_000

_SPACE = regex.compile(r"[\t-\r \x85\p{Z}]+")
_ODD = re.compile("[\x1c-\x1f]")  # white space to Python, not to the file's pattern


def _byte_symbols() -> list[str]:
    """The character that stands for each byte: printable ones themselves, the others from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class OffsetTable:
    """Strings by id in one buffer, each followed by a space."""

    def __init__(self, strings: Sequence[bytes]):
        self.size = np.array([len(s) + 1 for s in strings], dtype=np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.buffer = np.frombuffer(b" ".join(strings) + b" ", dtype=np.uint8)

    def join(self, ids: np.ndarray) -> bytes:
        """The strings of ``ids``, joined by spaces."""
        if not len(ids):
            return b""
        size = self.size[ids]
        end = np.cumsum(size)
        at = np.arange(end[-1]) + np.repeat(self.start[ids] - (end - size), size)
        return self.buffer[at[:-1]].tobytes()


class Decoder:
    """Strings and decimals of all ids: what decoding needs, without the tables of the encoder."""

    def __init__(self, content: str):
        file = json.loads(content)
        strings = {**file["model"]["vocab"], **{t["content"]: t["id"] for t in file["added_tokens"]}}
        table = [b""] * (max(strings.values()) + 1)
        for t, i in strings.items():
            table[i] = t.encode()
        self.tokens = OffsetTable(table)
        self.decimals = OffsetTable([str(i).encode() for i in range(len(table))])


class Codec(Decoder):
    def __init__(self, content: str):
        super().__init__(content)
        file = json.loads(content)
        model = file["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        patterns = [p["pattern"]["Regex"] for p in file["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self.pattern = regex.compile(patterns[0])
        self._special = regex.compile("|".join(regex.escape(t) for t in self.special)) if self.special else None

        # Symbols become single characters: a byte, or 256 and a byte at the end of a word.
        byte_of = {c: b for b, c in enumerate(_byte_symbols())}

        def symbols(token: str) -> str:
            ends = token.endswith(self.suffix) and len(token) > len(self.suffix)
            body = [byte_of[c] for c in (token.removesuffix(self.suffix) if ends else token)]
            return "".join(map(chr, body[:-1])) + chr(body[-1] + 256 * ends)

        self.id_of = {symbols(t): i for t, i in vocab.items()}
        n = max(vocab.values()) + 1
        self.length = [0] * n
        self.split = [(i, i) for i in range(n)]
        self.rank = list(range(n))  # base symbols come before all merges
        self.merged: dict[tuple[int, int], int] = {}
        base = n
        for order, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b, whole = vocab[left], vocab[right], vocab[left + right]
            if (a, b) not in self.merged:
                self.merged[a, b] = whole
                self.split[whole], self.rank[whole] = (a, b), base + order
        automaton = ahocorasick.Automaton()
        for s, i in self.id_of.items():
            self.length[i] = len(s)
            automaton.add_word(s, (i, len(s)))
        automaton.make_automaton()
        self.automaton = automaton
        self.shorter: list[int] = [-1] * n  # longest token that is a proper prefix
        for s, i in self.id_of.items():
            self.shorter[i] = next((self.id_of[s[:k]] for k in range(len(s) - 1, 0, -1) if s[:k] in self.id_of), -1)
        self._fits: dict[tuple[int, int], bool] = {}
        self._words: dict[str, bytes] = {}
        self._later: dict[str, bytes] = {}

    def fits(self, a: int, b: int) -> bool:
        """Whether merging leaves the tokens a and b side by side: undo their merges, latest first, and look for one
        that would have joined symbols across the border earlier."""
        known = self._fits.get((a, b))
        if known is None:
            if len(self._fits) > 4 * WORDS_KEPT:
                self._fits.clear()
            known = self._fits[a, b] = self._compatible(a, b)
        return known

    def _compatible(self, a: int, b: int) -> bool:
        rank, split = self.rank, self.split
        limit = float("inf")  # a merge across the border counts if it comes before what has been undone
        while True:
            whole = self.merged.get((a, b))
            if whole is not None and rank[whole] < limit:
                return False
            if rank[a] > rank[b]:
                limit, inner = rank[a], split[a][1]
                if inner == a:
                    limit, inner = rank[b] + 0.5, split[b][0]
                    if inner == b:
                        return True
                    b = inner
                else:
                    a = inner
            else:
                limit, inner = rank[b] + 0.5, split[b][0]  # of equal ranks the left one is merged first
                if inner == b:
                    limit, inner = rank[a], split[a][1]
                    if inner == a:
                        return True
                    a = inner
                else:
                    b = inner

    def _symbols(self, s: str) -> list[int]:
        """Tokens of one pre-token, given as symbol characters."""
        n = len(s)
        whole = self.id_of.get(s)
        if whole is not None:
            return [whole]
        length, shorter, fits = self.length, self.shorter, self._fits
        longest = [-1] * n
        for end, (i, size) in self.automaton.iter(s):
            longest[end - size + 1] = i  # ends grow, so the longest is the last
        open_ = [True] * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            while token >= 0:
                end = at + length[token]
                if open_[end] and (not out or (fit := fits.get((out[-1], token))) or fit is None and self.fits(out[-1], token)):
                    out.append(token)
                    at = end
                    token = longest[at] if at < n else -1
                    break
                token = shorter[token]
            else:
                open_[at] = False
                token = out.pop()
                at -= length[token]
        return out

    def word(self, word: str) -> list[int]:
        """Ids of a word without white space."""
        if word.isascii():
            out: list[int] = []
            for piece in self.pattern.findall(word.lower()):
                out += self._symbols(piece[:-1] + chr(ord(piece[-1]) + 256))
            return out
        text = unicodedata.normalize("NFC", word)
        text = text.lower() if "Σ" not in text else "".join(c.lower() for c in text)  # no final sigma
        out = []
        for piece in self.pattern.findall(text):
            raw = piece.encode()
            out += self._symbols("".join(map(chr, raw[:-1])) + chr(raw[-1] + 256))
        return out

    def _plain(self, text: str) -> bytes:
        words = text.split() if not _ODD.search(text) else [w for w in _SPACE.split(text) if w]
        known, later = self._words, self._later
        out = list(map(known.get, words))
        for at, ids in enumerate(out):
            if ids is None:
                w = words[at]
                ids = known.get(w) or later.get(w)
                if ids is None:
                    ids = array("i", self.word(w)).tobytes()
                    if len(w) > 64:
                        pass
                    elif len(known) < WORDS_KEPT:
                        known[w] = ids
                    else:
                        if len(later) >= WORDS_KEPT:
                            later.clear()
                        later[w] = ids
                out[at] = ids
        return b"".join(out)

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, dtype=np.int32)
        if self._special is None or "<|" not in text and not self._special.search(text):
            return np.frombuffer(self._plain(text), dtype=np.int32)
        parts, at = [], 0
        for m in self._special.finditer(text):
            parts += [self._plain(text[at : m.start()]), np.int32(self.special[m.group()]).tobytes()]
            at = m.end()
        parts.append(self._plain(text[at:]))
        return np.frombuffer(b"".join(parts), dtype=np.int32)

    def decode(self, ids: np.ndarray) -> str:
        return self.tokens.join(ids).decode("utf-8", "replace")


_CODECS: dict[int, Codec] = {}
_DECODERS: dict[int, Decoder] = {}


def codec(content: str) -> Codec:
    """One codec for each task and file: ``encode`` drops it at the task's end, as its tables grow with the words."""
    key = hash(content)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(content)
    return _CODECS[key]


def forget() -> None:
    _CODECS.clear()


def decoder(content: str) -> Decoder:
    """One decoder for each worker and file; an encoder's, if there is one."""
    key = hash(content)
    if key not in _CODECS and key not in _DECODERS:
        _DECODERS.clear()
        _DECODERS[key] = Decoder(content)
    return _CODECS.get(key) or _DECODERS[key]


def vocabulary(spark: SparkSession, path: str):
    """The file's content, broadcast: a vocabulary is a fixed small file and may lie with the driver only."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def _fields(df: DataFrame, *more: str) -> str:
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + list(more))


def _with(batch: pa.RecordBatch, names: list[str], arrays: list[pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*batch.schema.names, *names])


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", keep_text: bool = False) -> DataFrame:
    """Add the column ``ids`` (array of int); the text itself is dropped unless it is to be kept."""
    content = vocabulary(df.sparkSession, path)

    @workers.lean
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(content.value)
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    part = batch.slice(at, 512)
                    found = [c.encode(t) for t in part.column(text).to_pylist()]
                    ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))
                    whole = _with(part, [ids], [lists])
                    yield whole if keep_text else whole.drop_columns([text])
        finally:
            forget()  # the worker's next task may decode, or belong to another stage

    out = df if keep_text else df.drop(text)
    return df.mapInArrow(scan, _fields(out, f"`{ids}` array<int>"))


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """Add the decoded ``text`` and ``ids_sha256`` (of the decimal ids, joined by spaces); drops the ids."""
    content = vocabulary(df.sparkSession, path)

    @workers.lean
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = decoder(content.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                lists = part.column(ids)
                flat, ends = lists.flatten().to_numpy(), lists.offsets.to_numpy()
                ends = ends - ends[0]
                found = [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]
                texts = pa.array([c.tokens.join(x).decode("utf-8", "replace") for x in found], pa.string())
                decimals = pa.array([c.decimals.join(x).decode() for x in found], pa.string())
                yield _with(part, [text, "_decimals"], [texts, decimals]).drop_columns([ids])

    out = df.mapInArrow(scan, _fields(df.drop(ids), f"`{text}` string", "_decimals string"))
    return out.withColumn("ids_sha256", F.sha2("_decimals", 256)).drop("_decimals")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    coded = encode(docs.select("doc_id", "text"), path).withColumn("n_tokens", F.size("ids").cast("long"))
    back = decode(coded, path, text="decoded")
    return back.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def query(spark, sf_dir: str) -> DataFrame:
    """op7: ids and decoded texts of ``documents``, as digests."""
    import public_tokenizers

    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
