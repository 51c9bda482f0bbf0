"""Byte-level BPE: texts to token ids with offsets, and ids back to bytes.

Method: the rank file becomes a BPE model of the tokenizers library, whose alphabet is one printable
character a byte (the byte table). A merge's two parts are what the ranks below its own leave of it,
so the merges follow from the ranks alone. A text is cut by PATTERN; its pieces are encoded each for
itself, as tiktoken does, and every distinct piece of a batch only once: the known ones come from a
bounded memo, the rest go through the library together. Ids, byte lengths and characters are then
put together by array operations. The library's own splitter and tiktoken agree on every character;
since it takes a microsecond a character, its classes of characters are read out of it once and the
pattern runs over them in the re module (whose own classes are of another version of Unicode).

Offsets count characters: a token starts at the character that holds its first byte and ends after
the one that holds its last, so the parts of a split character all span that character.

Decoding looks every id up in the reversed byte table and joins the bytes before they are read as
UTF-8, so characters that are split between tokens come back whole; what is not UTF-8 in the joined
bytes becomes U+FFFD in the text, and stays as it is in the bytes.

The vocabulary is read where the driver runs and sent to the tasks (under 2 MB).

Cases: null or empty text has no tokens; ids that are null, or hold null or an id outside the
vocabulary, decode to null; bytes of a text that are not UTF-8 count as U+FFFD; texts of any length
are encoded whole; repeated rows and null ids of documents are rows like others; an empty table
gives no rows; the table's other columns stay, but for those named as the outputs (ids, starts,
ends; bytes, text), which the outputs replace.
"""

from __future__ import annotations

import base64
import os
import re
import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulselake.llm.common import slices, utf8
from pulselake.session import read_table

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: A memo that holds more pieces or more ids than this starts afresh.
MEMO_PIECES, MEMO_IDS = 200_000, 3_000_000
#: Characters of a text whose pieces stand in a list; those of a longer one come one by one.
LISTED = 1 << 20
#: Pieces that go through the library together.
TOGETHER = 4096


def byte_table() -> list[str]:
    """The character that stands for each byte: itself where printable, else from U+0100 on in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ids of a rank file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def parts(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The two tokens that the merge of this token joins."""
    have, own = [token[k : k + 1] for k in range(len(token))], ranks[token]
    while len(have) > 2:
        rank, at = min((ranks.get(a + b, own), k) for k, (a, b) in enumerate(zip(have, have[1:])))
        if rank >= own:
            raise ValueError(f"no merge makes token {own}")
        have[at : at + 2] = [have[at] + have[at + 1]]
    return have[0], have[1]


@lru_cache
def class_ranges(name: str) -> tuple[tuple[int, int], ...]:
    """First and last code point of the runs of a class of characters, such as \\p{L}, as the library knows it."""
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    split, runs = Split(Regex(f"{name}+"), "removed"), []
    for base in (k for k in range(0, sys.maxunicode, 0x800) if k != 0xD800):  # no surrogates
        others = [at for _, at in split.pre_tokenize_str("".join(map(chr, range(base, base + 0x800))))]
        edges = [0, *(e for at in others for e in at), 0x800]
        runs += [(base + a, base + b - 1) for a, b in zip(edges[::2], edges[1::2]) if a < b]
    return tuple(runs)


def explicit(pattern: str, most: int) -> str:
    """The pattern with its classes spelled out up to a code point, for texts without later ones."""
    inside, out = False, []
    for part in re.findall(r"\\[pP]\{\w+\}|\\.|\[\^?|.", pattern, re.S):
        if re.fullmatch(r"\\(?:[pP]\{\w+\}|[sSdD])", part):
            spelled = "".join(f"\\U{a:08x}-\\U{min(b, most):08x}" for a, b in class_ranges(part) if a <= most)
            part = spelled if inside else f"[{spelled}]"
        elif part[0] in "[]":
            inside = part != "]"
        out.append(part)
    return "".join(out)


class _Places(dict):
    """Pieces numbered as they come; new holds those whose ids are not known yet."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = at = len(self)
        self.new.append(piece)
        return at


class Codec:
    """Encodes and decodes; one per worker process."""

    def __init__(self, ranks: dict[bytes, int], patterns: tuple[str, str]):
        char = byte_table()
        self.translate = {b: char[b] for b in range(256)}
        back = {c: b for b, c in enumerate(char)}
        self.shown = {token.decode("latin-1").translate(self.translate): k for token, k in ranks.items()}
        self.size = max(ranks.values()) + 1
        self.width = np.zeros(self.size, np.int64)
        table = [b""] * self.size
        for word, k in self.shown.items():
            table[k] = bytes(back[c] for c in word)
            self.width[k] = len(table[k])
        self.bytes = np.frombuffer(b"".join(table), np.uint8)
        self.start = np.cumsum(self.width) - self.width
        self.ranks, self.patterns, self.model = ranks, patterns, None

    def _prepare(self) -> None:
        """What only encoding needs: the library's model and the compiled patterns."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.models import BPE
        from tokenizers.pre_tokenizers import Split

        show = lambda token: token.decode("latin-1").translate(self.translate)
        order = sorted((t for t in self.ranks if len(t) > 1), key=self.ranks.__getitem__)
        merges = [tuple(map(show, parts(t, self.ranks))) for t in order]
        self.model = Tokenizer(BPE(vocab=self.shown, merges=merges, cache_capacity=0))
        self.model.pre_tokenizer = Split("\n", "removed")  # no byte is shown as a line break, so it can part the pieces
        self.compiled = [re.compile(p) for p in self.patterns]
        self._forget()

    def _forget(self) -> None:
        self.memo = _Places()
        self.ids, self.first, self.count = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _learn(self) -> None:
        """The ids of the pieces that came new."""
        new, self.memo.new = self.memo.new, []
        ids, each = [self.ids], [self.count]
        for at in range(0, len(new), TOGETHER):
            some = new[at : at + TOGETHER]
            got = self.model.encode("\n".join([p.encode().decode("latin-1").translate(self.translate) for p in some]), add_special_tokens=False)
            ids.append(np.array(got.ids, np.int32))
            each.append(np.bincount(np.array(got.word_ids, np.int64), minlength=len(some)))
        self.ids, self.count = np.concatenate(ids), np.concatenate(each)
        self.first = np.cumsum(self.count) - self.count

    def _pieces(self, text: str) -> np.ndarray:
        """The memo's places of the text's pieces."""
        pattern = self.compiled[not text.isascii() and max(text, default="") > "\uffff"]
        found = pattern.findall(text) if len(text) <= LISTED else (m[0] for m in pattern.finditer(text))
        return np.fromiter(map(self.memo.__getitem__, found), np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if self.model is None:
            self._prepare()
        if len(self.memo) > MEMO_PIECES or len(self.ids) > MEMO_IDS:
            self._forget()
        places = [self._pieces(t) for t in texts]
        if self.memo.new:
            self._learn()
        return [self.ids[_ranges(self.first[p], self.count[p])] for p in places]

    def offsets(self, text: bytes, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each token, the first character that it touches and the place after its last."""
        width = self.width[ids]
        end = np.cumsum(width)
        char = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80) - 1
        return char[end - width], char[end - 1] + 1

    def decode(self, ids: np.ndarray) -> bytes | None:
        """The bytes of the ids; None if one is unknown."""
        if len(ids) and (ids.min() < 0 or ids.max() >= self.size or not self.width[ids].all()):
            return None
        return self.bytes[_ranges(self.start[ids], self.width[ids])].tobytes()


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ..., count[0] places, then those of first[1] and so on."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - count), count)


_CODECS: dict[str, Codec] = {}


def received(sent) -> Codec:
    """The codec of a vocabulary that send() sent, kept by the worker process."""
    key = sent.value["key"]
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(sent.value["ranks"], sent.value["patterns"])
    return _CODECS[key]


def send(spark: SparkSession, path: str, pattern: str = public_tokenizers.PATTERN):
    """A rank file and its pattern as a broadcast."""
    return spark.sparkContext.broadcast({"key": f"{path}\n{pattern}", "ranks": read_ranks(path), "patterns": (explicit(pattern, 0xFFFF), explicit(pattern, sys.maxunicode))})


def _with(batch: pa.RecordBatch, outputs: dict[str, pa.Array]) -> pa.RecordBatch:
    kept = [n for n in batch.schema.names if n not in outputs]
    return pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), *outputs.values()], [*kept, *outputs])


def _schema(df: DataFrame, outputs: dict[str, str]) -> str:
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name not in outputs]
    return ", ".join([*kept, *(f"{n} {t}" for n, t in outputs.items())])


def encode(df: DataFrame, column: str = "text", offsets: bool = True, vocabulary: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """df with ids, and starts and ends (characters) of each token of the column's text if wanted."""
    sent = send(df.sparkSession, vocabulary, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = received(sent)
        for batch in slices(batches):
            texts = [(t or b"").decode("utf-8", "replace") for t in utf8(batch, column)]
            ids = codec.encode(texts)
            out = {"ids": _lists(ids, pa.int32())}
            if offsets:
                places = [codec.offsets(t.encode(), i) for t, i in zip(texts, ids)]
                out |= {n: _lists([p[k] for p in places], pa.int64()) for k, n in enumerate(("starts", "ends"))}
            yield _with(batch, out)

    names = {"ids": "array<int>"} | ({"starts": "array<bigint>", "ends": "array<bigint>"} if offsets else {})
    return df.mapInArrow(run, _schema(df, names))


def decode(df: DataFrame, column: str = "ids", text: bool = True, vocabulary: str = VOCABULARY) -> DataFrame:
    """df with the bytes that the column's ids stand for, and their text if wanted."""
    sent = send(df.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = received(sent)
        for batch in slices(batches):
            given, found = batch.column(column).cast(pa.list_(pa.int64())), []
            for k in range(len(given)):
                ids = given[k].values
                found.append(codec.decode(ids.to_numpy(zero_copy_only=False)) if ids is not None and not ids.null_count else None)
            out = {"bytes": pa.array(found, pa.binary())}
            if text:
                out["text"] = pa.array([None if b is None else b.decode("utf-8", "replace") for b in found], pa.string())
            yield _with(batch, out)

    return df.mapInArrow(run, _schema(df, {"bytes": "binary"} | ({"text": "string"} if text else {})))


def _lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*rows, np.empty(0, np.int64)]), kind))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the bytes that they decode to."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = decode(encode(docs, offsets=False).drop("text"), text=False)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )
