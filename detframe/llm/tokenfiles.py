"""Token ids as files: frequency-ranked ids in a byte-aligned variable-length code with separate control bytes.

A file row is a block of whole documents in ascending doc_id order. Ids are replaced by their rank (0 is the most frequent
id of the corpus), a rank takes 1 to 4 bytes, and two bits per rank, four in a control byte, tell how many. Control and
data bytes are stored apart, so that a table of 256 control bytes gives all lengths, and a running sum all offsets.
"""

from __future__ import annotations

import itertools
import json
import os
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from detframe.llm.common import raw, sliced, small_batches
from detframe.session import shared_dir

TOKENIZER, END = "word_bpe_49k.json", 1
#: Ids after which a block is closed (a document is never split), and pieces whose ids a worker remembers.
BLOCK_IDS, REMEMBERED = 1 << 17, 1 << 18
GROUP_BYTES = 1 << 22

_LENGTHS = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)


def encode(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit ranks."""
    ranks = ranks.astype(np.uint32)
    extra = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    padded = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    padded[:len(ranks)] = extra
    control = padded[0::4] | padded[1::4] << 2 | padded[2::4] << 4 | padded[3::4] << 6
    ends = np.cumsum(extra.astype(np.int64) + 1)
    starts = ends - extra - 1
    data = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    data[starts] = ranks & 0xFF
    for k in (1, 2, 3):
        longer = extra >= k
        data[starts[longer] + k] = ranks[longer] >> np.uint32(8 * k) & 0xFF
    return control.tobytes(), data.tobytes()


def decode(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` ranks behind control and data bytes."""
    lengths = _LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    stored = np.frombuffer(data, np.uint8)
    starts = np.cumsum(lengths, dtype=np.int64) - lengths
    ranks = stored[starts].astype(np.uint32)
    for k in (1, 2, 3):
        longer = np.flatnonzero(lengths > k)
        ranks[longer] |= stored[starts[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return ranks


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 bytes for themselves, the others
    by the letters from U+0100 on, in order."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or (0xA1 <= b <= 0xFF and b != 0xAD)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)).difference(own)))}


class Numbers(dict):
    """Numbers of keys in order of first sight."""

    def __missing__(self, key) -> int:
        self[key] = number = len(self)
        return number

    def of(self, keys, n: int) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, keys), np.int64, n)


class _Pieces(dict):
    """As above; a new piece is handed to ``learn``."""

    def __init__(self, learn):
        super().__init__()
        self.learn = learn

    def __missing__(self, piece: str) -> int:
        self[piece] = number = len(self)
        self.learn(piece)
        return number


def ragged(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of all members of slices that begin at ``first`` and have ``sizes`` members."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - (ends - sizes), sizes)


class WordIds:
    """Ids of texts, put together from the ids of their distinct words. ASCII spaces part pre-tokens and never join with a
    neighbour in normalisation, so this equals the encoding of the whole text.

    Words of printable ASCII and Latin-1 letters are lower-cased and cut by the tokenizer's own pattern, and each distinct
    piece goes to its BPE model once; any other word takes the whole tokenizer.
    """

    _plain = regex.compile("[\x21-\x7e\u00c0-\u00ff]*")
    _plain_lines = regex.compile("[\n\x21-\x7e\u00c0-\u00ff]*")

    def __init__(self, path: str, remembered: int = REMEMBERED):
        self.remembered = remembered
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            steps = json.load(file)
        cut = (steps.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        names = [n.get("type") for n in (steps.get("normalizer") or {}).get("normalizers", [])]
        fits = names == ["NFC", "Replace", "Lowercase"] and [c.get("type") for c in cut] == ["Split", "ByteLevel"] and cut[0].get("invert")
        fits = fits and not cut[1].get("use_regex") and not cut[1].get("add_prefix_space")
        self.pattern = regex.compile(cut[0]["pattern"]["Regex"] + "|\n") if fits else None
        self.specials = [t["content"] for t in steps.get("added_tokens", [])]
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.forget()

    def forget(self) -> None:
        self.pieces = _Pieces(self._learn)
        self.first, self.flat = array("q", [0]), array("I")
        self.pieces["\n"]  # the end of a word, without ids

    def _learn(self, piece: str) -> None:
        if piece != "\n":
            mapped = piece if piece.isascii() else "".join(self.letters[b] for b in piece.encode())
            self.flat.extend(t.id for t in self.model.tokenize(mapped))
        self.first.append(len(self.flat))

    def words(self, vocabulary: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and how many each has."""
        if len(self.pieces) > self.remembered:
            self.forget()
        texts = [w.decode("utf-8", "replace") for w in vocabulary]
        if self.pattern and self._plain_lines.fullmatch("\n".join(texts)):
            plain = np.ones(len(texts), bool)
        else:
            plain = np.array([self.pattern is not None and self._plain.fullmatch(t) is not None for t in texts], bool)
        for special in self.specials:
            if special in "\n".join(texts):
                plain &= np.array([special not in t for t in texts])
        sizes = np.zeros(len(texts), np.int64)
        easy = np.flatnonzero(plain)
        found = self.pattern.findall("".join(texts[i] + "\n" for i in easy).lower()) if len(easy) else []
        at = np.fromiter(map(self.pieces.__getitem__, found), np.int64, len(found))
        first, flat = np.array(self.first), np.array(self.flat, np.uint32)
        n = first[at + 1] - first[at]
        if len(easy):
            ends = np.flatnonzero(at == 0)
            total = np.cumsum(n)
            sizes[easy] = np.diff(np.r_[0, total[ends]])
        hard = {int(i): self.tokenizer.encode(texts[i], add_special_tokens=False).ids for i in np.flatnonzero(~plain)}
        for i, ids in hard.items():
            sizes[i] = len(ids)
        ids = np.empty(int(sizes.sum()), np.uint32)
        starts = np.cumsum(sizes) - sizes
        ids[ragged(starts[easy], sizes[easy])] = flat[ragged(first[at], n)]
        for i, own in hard.items():
            ids[starts[i]:starts[i] + len(own)] = own
        return ids, sizes

    def encode(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each has."""
        known = Numbers()
        split = [(t or b"").split() for t in texts]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        at = known.of(itertools.chain.from_iterable(split), int(counts.sum()))
        flat, sizes = self.words(list(known))
        n = sizes[at]
        total = np.r_[0, np.cumsum(n)]
        return flat[ragged((np.cumsum(sizes) - sizes)[at], n)], np.diff(total[np.r_[0, np.cumsum(counts)]])


_encoders: dict[tuple[str, int], WordIds] = {}


def word_ids(path: str, remembered: int = REMEMBERED) -> WordIds:
    """One encoder per worker, kept over tasks."""
    if (path, remembered) not in _encoders:
        _encoders[path, remembered] = WordIds(path, remembered)
    return _encoders[path, remembered]


def grouped(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Slices of consecutive rows with about ``most`` bytes."""
    start = 0
    while start < len(sizes):
        stop, size = start, 0
        while stop < len(sizes) and (stop == start or size + sizes[stop] <= most):
            size += sizes[stop]
            stop += 1
        yield start, stop
        start = stop


_PLACE = "part int, block int, before long, n long, doc_ids array<long>, sizes array<int>, "
_BLOCK, _CODED = _PLACE + "ids binary", _PLACE + "control binary, data binary"


def _blocks(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, before = TaskContext.get().partitionId(), 0, 0
        held, docs, sizes, n = [], [], [], 0

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([before], pa.int64()), pa.array([n], pa.int64()),
                                               pa.array([docs], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int32())),
                                               pa.array([np.concatenate(held).astype("<u4").tobytes()], pa.binary())],
                                              ["part", "block", "before", "n", "doc_ids", "sizes", "ids"])
        for batch in sliced(batches):
            ids, texts = batch.column(0).to_pylist(), raw(batch.column(1))
            for start, stop in grouped([len(t or b"") for t in texts], GROUP_BYTES):
                found, counts = word_ids(path).encode(texts[start:stop])
                for doc, piece in zip(ids[start:stop], np.split(found, np.cumsum(counts)[:-1])):
                    held.append(np.append(piece, np.uint32(end)))
                    docs.append(doc)
                    sizes.append(len(held[-1]))
                    n += sizes[-1]
                    if n >= BLOCK_IDS:
                        yield close()
                        block, before, held, docs, sizes, n = block + 1, before + n, [], [], [], 0
        if docs:
            yield close()
    return run


def _count_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for batch in batches:
        for ids in batch.column(0).to_pylist():
            found = np.bincount(np.frombuffer(ids, "<u4"))
            if len(found) > len(total):
                total = np.r_[total, np.zeros(len(found) - len(total), np.int64)]
            total[:len(found)] += found
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["id", "n"])


def ranked_ids(blocks: DataFrame) -> np.ndarray:
    """Ids by falling frequency over the whole corpus, ties by id: at most one entry per id of the vocabulary."""
    counts = blocks.select("ids").mapInArrow(_count_ids, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    return counts.sort_values(["n", "id"], ascending=[False, True])["id"].to_numpy(np.uint32)


def write_files(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end: int = END) -> None:
    """Encode ``docs`` (``doc_id``, ``text``) into ``path``: ``ranks`` and ``blocks``, in ascending doc_id order (null first)."""
    spark, model = docs.sparkSession, public_tokenizers.path(tokenizer)
    ordered = (small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).repartitionByRange("doc_id")
               .sortWithinPartitions("doc_id", F.xxhash64("text")))
    ordered.mapInArrow(_blocks(model, end), _BLOCK).write.parquet(f"{path}/ids")
    blocks = spark.read.schema(_BLOCK).parquet(f"{path}/ids")
    by_rank = ranked_ids(blocks)
    rank_of = np.zeros(int(by_rank.max()) + 1 if len(by_rank) else 0, np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    shared = spark.sparkContext.broadcast(rank_of)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank_of = shared.value
        for batch in batches:
            coded = [encode(rank_of[np.frombuffer(ids, "<u4")]) for ids in batch.column(6).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array([c for c, _ in coded], pa.binary()), pa.array([d for _, d in coded], pa.binary())],
                                             [*batch.schema.names[:6], "control", "data"])
    spark.createDataFrame([(i, int(t)) for i, t in enumerate(by_rank)], "rank int, id int").coalesce(1).write.parquet(f"{path}/ranks")
    blocks.mapInArrow(pack, _CODED).write.parquet(f"{path}/blocks")


def read_files(spark, path: str, digest: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens`` and the ids (or, with ``digest``, ``ids_crc32``) of every document in the files."""
    blocks = spark.read.schema(_CODED).parquet(f"{path}/blocks")
    parts = blocks.groupBy("part").agg(F.sum("n").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("part_start"))  # one row per written partition
    ranks = spark.read.parquet(f"{path}/ranks").orderBy("rank").toPandas()["id"].to_numpy(np.uint32)
    shared = spark.sparkContext.broadcast(ranks)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_rank = shared.value
        for batch in batches:
            for docs, sizes, control, data, start in zip(*(batch.column(c).to_pylist() for c in ("doc_ids", "sizes", "control", "data", "start"))):
                counts = np.array(sizes, np.int64)
                ids = by_rank[decode(control, data, int(counts.sum()))].astype("<u4")
                ends = np.cumsum(counts)
                pieces = [ids[e - c:e].tobytes() for e, c in zip(ends, counts)]
                last = pa.array([zlib.crc32(p) for p in pieces], pa.int64()) if digest else pa.array(pieces, pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(start + ends - counts), pa.array(counts), last],
                                                 ["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])
    last = "ids_crc32 long" if digest else "ids binary"
    placed = blocks.join(F.broadcast(parts), "part").withColumn("start", F.col("part_start") + F.col("before"))
    return placed.select("doc_ids", "sizes", "control", "data", "start").mapInArrow(
        unpack, f"doc_id long, start long, n_tokens long, {last}")


def token_files(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every row, read back from files that it writes into the shared folder.

    Null and empty texts are the end id alone. Rows that share a doc_id stand side by side, by a hash of their text; null
    ids come first. Strings of special tokens in a text are encoded as the tokenizer encodes them. Other columns are not
    read; an empty table gives empty files and an empty result.
    """
    path = f"{shared_dir(docs.sparkSession).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    write_files(docs, path, tokenizer)
    return read_files(docs.sparkSession, path, digest=True)
