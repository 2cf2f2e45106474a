"""Best-fit packing with certified bin counts.

Documents become token ids, pieces of at most ``capacity`` tokens, and then sequences. Pieces are
dealt evenly to partitions, each packed by best-fit decreasing. Dual-feasible functions turn the
histogram of piece lengths into a lower bound on the number of sequences; while the sequences of
all partitions exceed the bound of the whole table, partitions give their emptiest sequences back
and exchange the documents in them with their neighbours, in a tree of ever fewer partitions whose
load stays bounded, and best-fit decreasing runs again on what was exchanged.

Defined cases: a null text counts as empty, an empty text is the end id alone, a repeated row is
packed as often as it stands in the table, null and repeated ``doc_id`` are carried along, an
empty table gives no rows, and other columns of the input are ignored.
"""

from __future__ import annotations

import json
import math
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loresmith.llm.store import Stash

END_ID = 1
CAPACITY = 4096
VOCABULARY = "word_bpe_49k.json"
#: Words in a generation of those whose ids a worker remembers; bytes of text encoded together.
REMEMBERED, AT_ONCE = 600_000, 3_000_000
_SPACE = re.compile(r"[ \t\n\r\x0b\x0c]")
#: Pieces in a partition, sequences that a partition gives back for exchange, partitions that exchange.
PER_PARTITION, RELEASED, FAN_IN = 50_000, 48, 8

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def gathered(numbers: np.ndarray, flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of numbered words one after the other, and where each word's end; word k is flat[begin[k] : begin[k] + size[k]]."""
    size = size[numbers]
    ends = np.cumsum(size)
    at = np.repeat(begin[numbers] - ends + size, size)
    at += np.arange(len(at))
    return flat[at], ends


class WordIds:
    """Token ids of texts, a worker's memory of words included.

    A tokenizer whose file says that it composes, folds white space and lowers case, cuts at one
    pattern, and merges each cut piece by itself (ends of words being tokens of their own) gives a
    text the ids of its white-space-separated words in turn, and a word those of its pieces. Such a
    tokenizer is asked for a distinct piece once; texts are cut, numbered and gathered as arrays.
    Any other tokenizer encodes the texts as they are. Which of both holds is read from the file, and
    tried on ``PROBE``, when a worker starts.

    Words are remembered through a worker's tasks, in two generations: when the newer one is full,
    the older one is forgotten, and so it is at the end of a task.
    """

    PROBE = "It's 3.5 m\u00b2 na\u00efve -- they'll r\u00c9sum\u00e9, e-mail a_b@c.org ('tis) \u4e2d\u6587 42nd!? \U0001f600x </w> It's"
    #: Texts that hold one of these are not lowered before they are cut: names of special tokens, and marks that compose.
    AS_IT_IS = "<\\||[\u0300-\u036f]"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_pieces = False
        if self._prepare(json.loads(self.tokenizer.to_str())):
            self.by_pieces = True
            self._forget()
            self.by_pieces = self.many([self.PROBE])[0] == self._ids(self.PROBE).tobytes()

    def _prepare(self, file: dict) -> bool:
        """Whether the tokenizer's file describes one that works by pieces; keeps what cuts and merges them."""
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        def steps(part: dict | None, inner: str) -> list[dict]:
            return [] if part is None else part.get(inner, [part])

        suffix = file["model"].get("end_of_word_suffix")
        norms, cuts = steps(file["normalizer"], "normalizers"), steps(file["pre_tokenizer"], "pretokenizers")
        plain = (
            file["model"]["type"] == "BPE" and suffix and not file["model"].get("dropout") and [n["type"] for n in norms] == ["NFC", "Replace", "Lowercase"]
            and norms[1]["pattern"] == {"Regex": r"\s+"} and norms[1]["content"] == " " and [c["type"] for c in cuts] == ["Split", "ByteLevel"]
            and cuts[0]["behavior"] == "Removed" and cuts[0]["invert"] and "Regex" in cuts[0]["pattern"] and not cuts[1]["add_prefix_space"] and not cuts[1]["use_regex"]
            and all(t["special"] and "<|" in t["content"] for t in file["added_tokens"])
        )
        if not plain:
            return False
        self.cut = regex.compile(cuts[0]["pattern"]["Regex"]).findall
        self.merges = Tokenizer(self.tokenizer.model)
        self.merges.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        return True

    def _forget(self) -> None:
        self.known: dict[str, int] = {"": 0}
        self.flat, self.begin, self.size = np.zeros(0, "<u4"), np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.older = None

    def rest(self) -> None:
        """Between tasks a worker keeps the newer words alone, and gives back what Arrow holds unused: it lives on beside the stages that follow."""
        if self.by_pieces:
            self.older = None
        pa.default_memory_pool().release_unused()

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _keep(self, words: list[str], ids: np.ndarray, size: np.ndarray) -> None:
        """Remember words that are not known, by their ids one after the other."""
        self.known.update(zip(words, range(len(self.size), len(self.size) + len(words)), strict=True))
        self.begin = np.append(self.begin, len(self.flat) + np.cumsum(size) - size)
        self.size = np.append(self.size, size)
        self.flat = np.append(self.flat, ids)

    def _learn(self, words: list[str]) -> None:
        """Remember new words."""
        if self.older is not None:
            known, *arrays = self.older
            number = np.fromiter((known.get(w, -1) for w in words), np.int64, len(words))
            again = [w for w, n in zip(words, number.tolist(), strict=True) if n >= 0]
            ids, ends = gathered(number[number >= 0], *arrays)
            self._keep(again, ids, np.diff(ends, prepend=0))
            words = [w for w, n in zip(words, number.tolist(), strict=True) if n < 0]
        plain = [w for w in words if w.isascii() and "<|" not in w]
        self._cut(plain, " ".join(plain).lower())
        odd = [w for w in words if not w.isascii() and "<|" not in w]
        # some may hold white space beyond ASCII, or letters that change in number: those have forms of their own
        form = self.tokenizer.normalizer.normalize_str
        for at in range(0, len(odd), 4000):
            part = odd[at : at + 4000]
            forms = form(" ".join(part))
            if forms.count(" ") == len(part) - 1:
                self._cut(part, forms)
            else:
                for w in part:
                    self._cut([w], form(w), one=True)
        for w in words:
            if "<|" in w:
                ids = self._ids(w)
                self._keep([w], ids, np.array([len(ids)]))

    def _cut(self, words: list[str], forms: str, *, one: bool = False) -> None:
        """Remember words by their pieces; forms: their normal forms with a space between. one: a single word, spaces or not."""
        if not words:
            return
        pieces = self.cut(forms)
        new = list(set(pieces).difference(self.known))
        ids = [self.merges.encode_batch_fast([" ".join(new[at : at + 4000])], add_special_tokens=False)[0].ids for at in range(0, len(new), 4000)]
        ids = np.concatenate([np.zeros(0, "<u4"), *(np.array(i, "<u4") for i in ids)])
        to = np.flatnonzero(self.ends[ids]) + 1  # the last token of a piece ends a word
        if len(to) != len(new):
            raise ValueError("a piece is not one stretch of tokens in this vocabulary")
        self._keep(new, ids, np.diff(to, prepend=0))
        number = np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))
        ids, ends = gathered(number, self.flat, self.begin, self.size)
        ends = np.r_[0, ends]
        if one:
            size = np.array([ends[-1]])
        else:  # pieces cover all but white space: words end where so many characters do
            covered = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
            upto = np.cumsum(np.fromiter(map(len, forms.split(" ")), np.int64, len(words)))
            last = np.searchsorted(covered, upto)
            if (covered[last] != upto).any():
                raise ValueError("the pieces do not cover the words in this vocabulary")
            size = np.diff(ends[last + 1], prepend=0)
        if self.known.keys().isdisjoint(words):
            self._keep(words, ids, size)
        else:  # words that are pieces are known by now
            fresh = np.fromiter((w not in self.known for w in words), bool, len(words))
            self._keep([w for w, f in zip(words, fresh.tolist(), strict=True) if f], ids[np.repeat(fresh, size)], size[fresh])

    def ids_of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text's end."""
        if not self.by_pieces:
            ids = [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
            return np.concatenate([np.zeros(0, "<u4"), *ids]), np.cumsum([len(i) for i in ids], dtype=np.int64)
        if len(self.known) > REMEMBERED:
            older = (self.known, self.flat, self.begin, self.size)
            self._forget()
            self.older = older
        # copied: Arrow lowers a slice by the whole buffer's offsets
        texts = pc.fill_null(texts.cast(pa.large_string()).take(pa.array(np.arange(len(texts)))), "")
        texts = pc.if_else(pc.match_substring_regex(texts, self.AS_IT_IS), texts, pc.ascii_lower(texts))
        words = pc.ascii_split_whitespace(texts)
        to = words.offsets.to_numpy()
        flat = words.flatten().dictionary_encode()
        del texts, words
        names = flat.dictionary.to_pylist()
        number = np.fromiter((self.known.get(w, -1) for w in names), np.int64, len(names))
        new = np.flatnonzero(number < 0)
        if len(new):
            unknown = [names[i] for i in new.tolist()]
            self._learn(unknown)
            number[new] = np.fromiter(map(self.known.__getitem__, unknown), np.int64, len(unknown))
        del names
        ids, ends = gathered(number[flat.indices.to_numpy()], self.flat, self.begin, self.size)
        return ids, np.r_[0, ends][to[1:] - to[0]]

    def many(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit bytes."""
        ids, ends = self.ids_of(pa.array(texts, pa.large_string()))
        return [ids[i:j].tobytes() for i, j in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def __call__(self, text: str) -> bytes:
        return self.many([text])[0]


_ENCODERS: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """This worker's encoder for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordIds(path)
    return _ENCODERS[path]


def vocabulary_path(vocabulary: str) -> str:
    """A file's own path, or the place of a public vocabulary of that name on this machine."""
    if os.path.isabs(vocabulary):
        return vocabulary
    import public_tokenizers

    return public_tokenizers.path(vocabulary)


def _stretches(encode: WordIds, texts: pa.Array) -> Iterator[bytes]:
    """Ids of each text as bytes: short texts are encoded together, a long one in parts that end at white space."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes, dtype=np.int64) // AT_ONCE
    at = 0
    while at < len(texts):
        if sizes[at] > 2 * AT_ONCE:
            text, parts, begin = texts[at].as_py(), [], 0
            while begin < len(text):
                to = begin + AT_ONCE
                if to < len(text):
                    space = _SPACE.search(text, to)
                    to = space.start() if space and space.start() - begin < 4 * AT_ONCE else len(text)
                parts.append(encode(text[begin:to]))
                begin = to
            yield b"".join(parts)
            at += 1
            continue
        to = at + 1
        while to < len(texts) and group[to] == group[at] and sizes[to] <= 2 * AT_ONCE:
            to += 1
        ids, ends = encode.ids_of(texts.slice(at, to - at))
        for i, j in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            yield ids[i:j].tobytes()
        at = to


def pieces(docs: DataFrame, *, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, keep_ids: bool = False) -> DataFrame:
    """Token pieces of ``docs``: (doc_id, piece, start, length, ids_crc32[, ids binary])."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_ids(vocabulary_path(vocabulary))
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            cols: list[list] = [[], [], [], [], [], []]
            for doc, ids in zip(batch.column(0).to_pylist(), _stretches(encode, batch.column(1)), strict=True):
                ids = memoryview(ids + end)
                for k, at in enumerate(range(0, len(ids) // 4, capacity)):
                    part = ids[4 * at : 4 * (at + capacity)]
                    row = (doc, k, at, len(part) // 4, zlib.crc32(part), bytes(part) if keep_ids else None)
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            names = ("doc_id", "piece", "start", "length", "ids_crc32", "ids")
            n = 6 if keep_ids else 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols[:n], kinds[:n], strict=True)], names=names[:n])
        encode.rest()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECE + (", ids binary" if keep_ids else ""))


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each length, and each bin's fill; ties go in the order given."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets, fills = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    free: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by room
    rooms = 0  # bit r is set if a bin has room r
    for i, size in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                rooms ^= 1 << room
        else:
            room, b = capacity, len(fills)
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += size
        left = room - size
        if left:
            free[left].append(b)
            rooms |= 1 << left
    return bins, offsets, np.array(fills, np.int64)


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs; counts[s]: pieces of length s, for s up to capacity.

    The largest of the volume bound, the three-class bound for every threshold (large pieces alone,
    middle ones in bins of their own, small ones in what room those leave) and the rounding
    functions x -> floor((k+1)x) / k.
    """
    size = np.arange(capacity + 1)
    volume = counts * size
    best = -(-int(volume.sum()) // capacity)
    n_up, v_up = np.cumsum(counts[::-1])[::-1], np.cumsum(volume[::-1])[::-1]  # pieces, volume of s or longer
    half = capacity // 2 + 1
    k = np.arange(capacity // 2 + 1)
    large = np.where(k > 0, n_up[np.minimum(capacity - k + 1, capacity)], 0)
    middle, v_middle = n_up[half] - large, v_up[half] - np.where(k > 0, v_up[np.minimum(capacity - k + 1, capacity)], 0)
    small = v_up[k] - v_up[half]
    extra = np.maximum(0, -(-(small - (middle * capacity - v_middle)) // capacity))
    best = max(best, int((large + middle + extra).max()))
    for j in range(1, 65):
        x = (j + 1) * size
        weight = np.where(x % capacity == 0, size * j, x // capacity * capacity)  # of capacity * j
        best = max(best, -(-int((counts * weight).sum()) // (capacity * j)))
    return best


def _histogram(lengths: np.ndarray, capacity: int) -> np.ndarray:
    return np.bincount(lengths, minlength=capacity + 1)


def pack(stash: Stash, parts: DataFrame, *, capacity: int = CAPACITY, per_partition: int = PER_PARTITION) -> DataFrame:
    """Place ``parts`` (any columns, with ``length`` from 1 to capacity) in sequences.

    Adds sequence_id, offset, and certified_gap: sequences used above the lower bound of the whole
    table (0: as few as possible, proven).
    """
    given = parts.columns
    now = stash.put(parts.withColumn("_part", F.lit(0).cast("long")), "pieces")
    total = now.count()
    width = max(1, math.ceil(total / per_partition))
    now = now.withColumn("_part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(width)))
    rows = now.groupBy("length").count().collect()  # one row a length: at most `capacity`
    counts = np.zeros(capacity + 1, np.int64)
    for r in rows:
        counts[r["length"]] += r["count"]
    bound = lower_bound(counts, capacity)

    def packed(level: int, last: bool):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            lengths = pdf["length"].to_numpy(np.int64)
            bins, offsets, fills = best_fit_decreasing(lengths, capacity)
            part = int(pdf["_part"].iloc[0])
            back = np.zeros(len(fills), bool)
            if not last and len(fills) > lower_bound(_histogram(lengths, capacity), capacity) - 1 and fills.sum() < len(fills) * capacity:
                emptiest = np.argsort(fills, kind="stable")[:RELEASED]
                back[emptiest[fills[emptiest] < capacity]] = True
            return pdf.assign(sequence_id=(level << 56) | (part << 28) | bins, offset=offsets, _back=back[bins])

        return run

    kept, level, used = [], 0, 0
    while True:
        last = width == 1
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in now.schema.fields) + ", sequence_id long, offset long, _back boolean"
        done = stash.put(now.groupBy("_part").applyInPandas(packed(level, last), schema), f"level{level}")
        kept.append(done.where(~F.col("_back")))
        used += kept[-1].where(F.col("offset") == 0).count()
        if last:
            break
        level, width = level + 1, math.ceil(width / FAN_IN)
        now = done.where("_back").select(*given, F.floor(F.col("_part") / FAN_IN).cast("long").alias("_part"))
        now = now.withColumn("_part", F.least("_part", F.lit(width - 1)))
    out = kept[0]
    for k in kept[1:]:
        out = out.unionByName(k)
    return out.select(*given, "sequence_id", "offset", F.lit(used - bound).cast("long").alias("certified_gap"))


def pack_documents(spark: SparkSession, docs: DataFrame, *, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, keep_ids: bool = False) -> DataFrame:
    """Tokenise, cut and pack ``docs`` (doc_id, text)."""
    return pack(Stash(spark, "packing"), pieces(docs, capacity=capacity, vocabulary=vocabulary, keep_ids=keep_ids), capacity=capacity)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op9_best_fit_packing": op9_best_fit_packing}
ORACLES: dict[str, str] = {}
