"""SentencePiece encoding and decoding on the tokenizers library.

The model file's protobuf is parsed here: pieces with scores and types, the model type, and the
normaliser's settings. From them a tokenizer of the tokenizers library is rebuilt: the normaliser
(its compiled character map, extra white space, dummy prefix, the metaspace marker for blanks), a
unigram model from the scores or a BPE model whose merges follow the scores, byte fallback, and the
decoder. Where no piece crosses a blank or a line end, a text's ids are those of its stretches
between them, so a worker encodes a stretch once and keeps its ids through its tasks; new
stretches are encoded in batches by the library's threads. Parity with the sentencepiece library
is verified text by text.

Defined cases: a null text counts as empty and has no ids, a repeated row is a row of its own, an
empty table gives no rows, other columns are ignored; a text that holds the marker itself (U+2581)
decodes with a blank in its place, as in sentencepiece, and its round_trip is false.
"""

from __future__ import annotations

import os
import re
import struct
import sys
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loresmith.llm.packing import vocabulary_path

MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: Stretches in a generation of those whose ids a worker remembers; threads of the library in a task; texts in a batch.
REMEMBERED, THREADS, BATCH = 800_000, 2, 1024
if sys.byteorder != "little" or array("I").itemsize != 4:
    raise ImportError("ids are compared as little-endian 32-bit words")
#: Types of pieces and models in the protobuf (fixed values).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = raw[at]
        at += 1
        value |= (b & 127) << shift
        shift += 7
        if b < 128:
            return value, at


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protobuf message: whole numbers for varints, else the bytes."""
    at = 0
    while at < len(raw):
        key, at = _varint(raw, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(raw, at)
        else:
            if kind == 2:
                n, at = _varint(raw, at)
            elif kind in (1, 5):
                n = 8 if kind == 1 else 4
            else:
                raise ValueError(f"wire type {kind} at byte {at}")
            value, at = raw[at : at + n], at + n
        yield key >> 3, value


@dataclass
class Model:
    """What a model file says."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    remove_extra: bool = True
    escape: bool = True
    suffix: bool = False

    @property
    def unknown(self) -> int:
        return next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)


def parse(raw: bytes) -> Model:
    m = Model()
    for number, value in fields(raw):
        if number == 1:
            f = dict(fields(value))
            m.pieces.append((f.get(1, b"").decode(), struct.unpack("<f", f[2])[0] if 2 in f else 0.0, f.get(3, NORMAL)))
        elif number == 2:
            f = dict(fields(value))
            m.kind, m.byte_fallback, m.suffix = f.get(3, UNIGRAM), bool(f.get(35, 0)), bool(f.get(24, 0))
        elif number == 3:
            f = dict(fields(value))
            m.charsmap, m.dummy_prefix, m.remove_extra, m.escape = f.get(2, b""), bool(f.get(3, 1)), bool(f.get(4, 1)), bool(f.get(5, 1))
    return m


def merges(m: Model) -> list[tuple[str, str]]:
    """Pairs of pieces that make a piece, the best score first, and among equals the earlier parts."""
    number = {p: i for i, (p, _, kind) in enumerate(m.pieces) if kind in (NORMAL, USER_DEFINED)}
    found = []
    for p, i in number.items():
        found += [(-m.pieces[i][1], number[p[:k]], number[p[k:]], p[:k], p[k:]) for k in range(1, len(p)) if p[:k] in number and p[k:] in number]
    return [x[3:] for x in sorted(found)]


def normaliser(m: Model):
    from tokenizers import Regex, normalizers

    steps: list = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
    if m.remove_extra:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip()]
    if m.dummy_prefix:
        steps.append(normalizers.Prepend(" "))
    if m.escape:
        steps.append(normalizers.Replace(" ", MARK))
    return normalizers.Sequence(steps)


def rebuild(m: Model):
    """The whole tokenizer: normaliser, model, decoder."""
    from tokenizers import Tokenizer, decoders, models

    if m.suffix:
        raise ValueError("white space as suffix is not supported")
    if m.kind == BPE:
        vocab = {p: i for i, (p, _, _) in enumerate(m.pieces)}
        model = models.BPE(vocab=vocab, merges=merges(m), unk_token=m.pieces[m.unknown][0], fuse_unk=True, byte_fallback=m.byte_fallback)
    elif m.kind == UNIGRAM:
        model = models.Unigram([(p, s) for p, s, _ in m.pieces], unk_id=m.unknown, byte_fallback=m.byte_fallback)
    else:
        raise ValueError(f"model type {m.kind} is neither unigram nor BPE")
    t = Tokenizer(model)
    t.normalizer = normaliser(m)
    steps = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    t.decoder = decoders.Sequence(steps + ([decoders.Strip(" ", 1, 0)] if m.dummy_prefix else []))
    return t


class Codec:
    """Encodes and decodes texts by a model file's bytes."""

    def __init__(self, raw: bytes, threads: int = THREADS):
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import Split

        self.model = parse(raw)
        self.tokenizer = rebuild(self.model)
        self.bare = Tokenizer(self.tokenizer.model)  # for stretches that are normalised already
        self.split = Tokenizer(self.tokenizer.model)  # for many of them, a line each
        self.split.pre_tokenizer = Split("\n", "isolated")
        inner = [p for p, _, kind in self.model.pieces if kind in (NORMAL, USER_DEFINED) and (MARK in p.lstrip(MARK) or "\n" in p)]
        self.stretch = re.compile(rf"{MARK}*[^{MARK}\n]+|{MARK}+|\n") if not inner else None
        self.plain = not self.model.charsmap and not self.model.remove_extra and self.model.escape
        self.tied = self._tied() if self.model.kind == BPE else None
        # stops at which no piece ends together with a letter before: tokens of their own there
        crossed = {p[-1] for p, _, kind in self.model.pieces if kind in (NORMAL, USER_DEFINED) and len(p) > 1 and p[-1] in ".," and p[-2].isalpha()}
        self.stops = {c: self._batch([c])[0] for c in ".," if c not in crossed} if self.stretch is not None else {}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        newline = [i for i, (p, _, kind) in enumerate(self.model.pieces) if kind == BYTE and p == "<0x0A>"]
        self.number_of_newline = newline[0] if newline and self.model.byte_fallback and self.stretch is not None else None
        self.bytes_of = [
            bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN else p.replace(MARK, " ").encode() for p, _, kind in self.model.pieces
        ]

    def _tied(self) -> re.Pattern | None:
        """Pieces of two or more characters whose score another one has: ranks of merges cannot hold ties."""
        from collections import Counter

        scored = [(p, x) for p, x, kind in self.model.pieces if kind in (NORMAL, USER_DEFINED) and len(p) > 1]
        times = Counter(x for _, x in scored)
        tied = sorted((p for p, x in scored if times[x] > 1), key=len)
        least: list[str] = []
        for p in tied:
            if not any(q in p for q in least):
                least.append(p)
        self.score = {p: x for p, x in scored}
        self.number = {p: i for i, (p, _, kind) in enumerate(self.model.pieces) if kind != UNUSED}
        return re.compile("|".join(map(re.escape, least))) if least else None

    def _agenda(self, text: str) -> bytes:
        """Ids of a stretch in which scores tie: of the best pairs the leftmost merges first."""
        import heapq

        part, left, right = list(text), list(range(-1, len(text) - 1)), [*range(1, len(text)), -1]
        heap: list = []

        def offer(i: int) -> None:
            j = right[i]
            if i >= 0 and j >= 0 and (x := self.score.get(part[i] + part[j])) is not None:
                heapq.heappush(heap, (-x, i, part[i], j, part[j]))

        for i in range(len(part) - 1):
            offer(i)
        while heap:
            _, i, a, j, b = heapq.heappop(heap)
            if part[i] != a or part[j] != b or right[i] != j:
                continue
            part[i], part[j], right[i] = a + b, "", right[j]
            if right[j] >= 0:
                left[right[j]] = i
            offer(i)
            if left[i] >= 0:
                offer(left[i])
        ids: list[int] = []
        for p in part:
            if p in self.number:
                ids.append(self.number[p])
            elif p and self.model.byte_fallback:
                ids += [self.number[f"<0x{x:02X}>"] for x in p.encode()]
            elif p and (not ids or ids[-1] != self.model.unknown):
                ids.append(self.model.unknown)
        return np.array(ids, "<u4").tobytes()

    def normalise(self, text: str) -> str:
        if not text:
            return ""
        if self.plain:
            return (MARK if self.model.dummy_prefix else "") + text.replace(" ", MARK)
        return self.tokenizer.normalizer.normalize_str(text)

    def _batch(self, texts: list[str]) -> list[bytes]:
        out = [np.array(e.ids, "<u4").tobytes() for e in self.bare.encode_batch(texts, add_special_tokens=False)]
        if self.tied is not None:
            for i, t in enumerate(texts):
                if self.tied.search(t):
                    out[i] = self._agenda(t)
        return out

    def _learn(self, stretches: list[str]) -> None:
        """Remember the ids of new stretches: a thousand to a line-parted text, and such texts in a batch."""
        end = self.number_of_newline
        plain, lone = (stretches, []) if end is not None else ([], stretches)
        joined = "\n".join(plain)
        if "\n\n" in f"\n{joined}\n" or self.tied is not None and self.tied.search(joined):
            odd = {s for s in plain if s == "\n" or self.tied is not None and self.tied.search(s)}
            plain, lone = [s for s in plain if s not in odd], [*lone, *odd]
        groups = [plain[at : at + 1000] for at in range(0, len(plain), 1000)]
        for group, e in zip(groups, self.split.encode_batch_fast(["\n".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            ends = np.append(np.flatnonzero(ids == end), len(ids)) * 4
            raw = ids.tobytes()
            self.known.update(zip(group, map(raw.__getitem__, map(slice, [0, *(ends[:-1] + 4).tolist()], ends.tolist())), strict=True))
        self.known.update(zip(lone, self._batch(lone), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit bytes."""
        normal = [self.normalise(t) for t in texts]
        if self.stretch is None:
            return self._batch(normal)
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        parts = [self.stretch.findall(t) for t in normal]
        new: set[str] = set()
        for p in parts:
            new.update(p)
        new.difference_update(self.known)
        ended = {x: x[:-1] for x in new if x[-1] in self.stops and x[-2:-1].isalpha()}
        plain = new.difference(ended).union(ended.values()).difference(self.known)
        again = plain.intersection(self.older)
        self.known.update((x, self.older[x]) for x in again)
        self._learn(list(plain - again))
        self.known.update((x, self.known[base] + self.stops[x[-1]]) for x, base in ended.items())
        get = self.known.__getitem__
        return [b"".join(map(get, p)) for p in parts]

    def decode(self, ids: bytes) -> str:
        raw = b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        if self.model.dummy_prefix and raw.startswith(b" "):
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


_CODECS: dict[str, tuple] = {}


def codec(path: str):
    """This worker's codec and the sentencepiece processor of the same file."""
    if path not in _CODECS:
        import sentencepiece

        with open(path, "rb") as f:
            raw = f.read()
        _CODECS[path] = Codec(raw), sentencepiece.SentencePieceProcessor(model_proto=raw)
    return _CODECS[path]


def encode(docs: DataFrame, *, model: str = MODEL, verify: bool = True, keep_ids: bool = True) -> DataFrame:
    """(doc_id, n_ids, ids_crc32, parity, round_trip[, ids]) of each row of ``docs`` (doc_id, text).

    parity: sentencepiece gives the same ids (null unless ``verify``); round_trip: the ids decode
    to the text; ids: binary, little-endian unsigned 32-bit.
    """
    names = ["doc_id", "n_ids", "ids_crc32", "parity", "round_trip"] + ["ids"] * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, other = codec(vocabulary_path(model))
        for b in batches:
            cols: list[list] = [[] for _ in range(6)]
            for at in range(0, b.num_rows, BATCH):
                texts = [t.as_py() or "" for t in b.column(1).slice(at, BATCH)]
                found = own.encode(texts)
                for text, ids in zip(texts, found, strict=True):
                    same = array("I", other.encode(text, out_type=int)).tobytes() == ids if verify else None
                    for c, v in zip(cols[1:], (len(ids) // 4, zlib.crc32(ids), same, own.decode(ids) == text, ids if keep_ids else None), strict=True):
                        c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols[1 : len(names)], kinds, strict=False))], names=names)

    kinds = "doc_id long, n_ids long, ids_crc32 long, parity boolean, round_trip boolean" + (", ids binary" if keep_ids else "")
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, kinds)


def decode(encoded: DataFrame, *, model: str = MODEL) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids); null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, _ = codec(vocabulary_path(model))
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if not i.is_valid else own.decode(i.as_py()) for i in b.column(1)], pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


def op8_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep_ids=False)


QUERIES = {"op8_sentencepiece_codec": op8_sentencepiece_codec}
ORACLES: dict[str, str] = {}
