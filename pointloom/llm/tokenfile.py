"""Token ids in fixed-width bit-packed files with random access.

A file holds the documents of one range of doc_ids, in order:

    header   64 bytes: magic, version, bits an id, ids a block, ids, documents
    blocks   ids packed in ``bits`` bits each, first id in the highest bits;
             every block starts on a byte
    offsets  uint64 for each block and one more: where it begins in the file
    docs     int64 doc_id, uint8 null flag, uint64 first id, for each document,
             and one more first id

``bits`` is the least that the vocabulary's largest id needs. Blocks unpack with
a few numpy calls; one document is read by its entry in ``docs`` and the blocks
that cover it.
"""

from __future__ import annotations

import os
import re
import struct
import unicodedata
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.filestore import read_bytes, read_range, write_bytes
from ..plans.materialize import cut, shared_dir

MAGIC, VERSION = b"PLTK", 1
HEAD = struct.Struct("<4sHHIIQQ")
HEAD_BYTES = 64
BLOCK_IDS = 1 << 16
#: Ids after which a writer begins a new file.
FILE_IDS = 1 << 22
#: Pre-tokens that a worker remembers, and the longest.
KNOWN, LONGEST = 800_000, 64
#: Characters after which a worker stops taking texts to encode at once.
AT_ONCE = 1 << 22


def bits_for(vocabulary_size: int) -> int:
    return max(1, (vocabulary_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids in ``bits`` bits each, highest bit first, padded to whole bytes."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    if bits == 16:
        return ids.astype(">u2").tobytes()
    each = np.unpackbits(ids.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)[:, 32 - bits :]
    return np.packbits(each).tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    if bits == 16:
        return np.frombuffer(data, ">u2", n).astype(np.uint32)
    each = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits).reshape(n, bits)
    wide = np.zeros((n, 32), np.uint8)
    wide[:, 32 - bits :] = each
    return np.packbits(wide, axis=1).view(">u4").ravel().astype(np.uint32)


def encode_file(doc_ids: list[int | None], docs: list[np.ndarray], bits: int, block: int = BLOCK_IDS) -> list[bytes]:
    """The parts of one file."""
    lengths = np.array([len(d) for d in docs], np.uint64)
    first = np.r_[np.uint64(0), np.cumsum(lengths, dtype=np.uint64)].astype("<u8")
    ids = np.concatenate(docs) if docs else np.zeros(0, np.uint32)
    parts = [HEAD.pack(MAGIC, VERSION, bits, block, 0, len(ids), len(docs)).ljust(HEAD_BYTES, b"\0")]
    at, offsets = HEAD_BYTES, [HEAD_BYTES]
    for i in range(0, len(ids), block):
        parts.append(pack(ids[i : i + block], bits))
        at += len(parts[-1])
        offsets.append(at)
    parts.append(np.array(offsets, "<u8").tobytes())
    parts.append(np.array([0 if i is None else i for i in doc_ids], "<i8").tobytes())
    parts.append(np.array([i is None for i in doc_ids], np.uint8).tobytes())
    parts.append(first.tobytes())
    return parts


class TokenFile:
    """A written file; the whole of it in memory, or ranges read as asked."""

    def __init__(self, path: str, whole: bool = False) -> None:
        self.path, self.data = path, read_bytes(path) if whole else None
        magic, version, self.bits, self.block, _, self.n_ids, self.n_docs = HEAD.unpack(self._get(0, HEAD.size))
        if magic != MAGIC or version != VERSION:
            raise ValueError(f"{path}: not a token file")
        n_blocks = -(-self.n_ids // self.block)
        full = -(-self.block * self.bits // 8)
        rest = self.n_ids - max(0, n_blocks - 1) * self.block
        self._offsets_at = HEAD_BYTES + max(0, n_blocks - 1) * full + (-(-rest * self.bits // 8) if n_blocks else 0)
        self._docs_at = self._offsets_at + 8 * (n_blocks + 1)

    def _get(self, start: int, length: int) -> bytes:
        return read_range(self.path, start, length) if self.data is None else self.data[start : start + length]

    def doc_ids(self) -> list[int | None]:
        ids = np.frombuffer(self._get(self._docs_at, 8 * self.n_docs), "<i8").tolist()
        null = self._get(self._docs_at + 8 * self.n_docs, self.n_docs)
        return [None if z else i for i, z in zip(ids, null, strict=True)]

    def _first(self, k: int, n: int) -> np.ndarray:
        return np.frombuffer(self._get(self._docs_at + 9 * self.n_docs + 8 * k, 8 * n), "<u8")

    def firsts(self) -> np.ndarray:
        return self._first(0, self.n_docs + 1)

    def ids(self, start: int, end: int) -> np.ndarray:
        """The ids from ``start`` to ``end``, from the blocks that hold them."""
        if end <= start:
            return np.zeros(0, np.uint32)
        a, b = start // self.block, -(-end // self.block)
        at = np.frombuffer(self._get(self._offsets_at + 8 * a, 8 * (b - a + 1)), "<u8").tolist()
        data = self._get(at[0], at[-1] - at[0])
        out = [
            unpack(data[at[k] - at[0] : at[k + 1] - at[0]], self.bits, min(self.block, self.n_ids - (a + k) * self.block))
            for k in range(b - a)
        ]
        return np.concatenate(out)[start - a * self.block : end - a * self.block]

    def document(self, k: int) -> np.ndarray:
        """The ids of the file's k-th document."""
        start, end = self._first(k, 2).tolist()
        return self.ids(start, end)


def _class(kind: str) -> str:
    """The characters up to U+017F of a general category, for a character class."""
    return "".join(re.escape(chr(c)) for c in range(0x180) if unicodedata.category(chr(c))[0] == kind)


class Encoder:
    """Whole texts to ids by the tokenizers library.

    The library spends most of its time on normalising and splitting a text,
    and encodes the same pre-tokens again and again. For texts without an added
    token or a character beyond U+017F (there NFC changes nothing and
    lower-casing goes character by character) the text is lower-cased and split
    here, by the file's own pattern, and the library encodes each distinct
    pre-token once, thousands in one text with a mark between them; the worker keeps
    their ids in a bounded table. Other texts go through the library as they are.
    Vocabulary files of another build are refused."""

    def __init__(self, path: str) -> None:
        import json

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = [n["type"] for n in spec["normalizer"]["normalizers"]]
        split, last = spec["pre_tokenizer"]["pretokenizers"]
        if steps != ["NFC", "Replace", "Lowercase"] or spec["normalizer"]["normalizers"][1]["content"] != " ":
            raise ValueError(f"{path}: another normaliser")
        if split.get("behavior") != "Removed" or not split.get("invert") or last["type"] != "ByteLevel" or last["use_regex"]:
            raise ValueError(f"{path}: another pre-tokenizer")
        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.pieces = Tokenizer.from_file(path)
        self.pieces.normalizer = None
        # pre-tokens hold no white space
        self.pieces.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        # a capital letter, which no lower-cased pre-token holds, and so no other pre-token has its id
        (self.mark,) = self.pieces.encode("A", add_special_tokens=False).ids
        # up to U+017F the pattern's classes are short lists, and the plain re module is faster with them
        plain = split["pattern"]["Regex"].replace(r"\p{L}", _class("L")).replace(r"\p{N}", _class("N"))
        self.find = re.compile(plain.replace(r"\s", "\t-\r \x85\xa0")).findall
        self.wide = re.compile(r"[^\x00-\u017F]").search
        self.added = [t["content"] for t in spec["added_tokens"]]
        self.known: dict[str, bytes] = {}

    def odd(self, text: str | None) -> bool:
        if text is None:
            return False
        return any(t in text for t in self.added) or not text.isascii() and self.wide(text) is not None

    def _ids(self, words: list[str]) -> list[bytes]:
        """The ids of each of some pre-tokens, by one call of the library."""
        (e,) = self.pieces.encode_batch_fast([" A ".join(words)], add_special_tokens=False)
        ids = array("I", e.ids)
        ends = np.flatnonzero(np.frombuffer(ids, np.uint32) == self.mark).tolist()
        data = ids.tobytes()
        return [data[4 * a : 4 * b] for a, b in zip([0, *(k + 1 for k in ends)], [*ends, len(ids)], strict=True)]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        odd = [self.odd(t) for t in texts]
        cut_up = [[] if o else self.find((t or "").lower()) for t, o in zip(texts, odd, strict=True)]
        if len(self.known) > KNOWN:
            self.known = {}
        known, look = self.known, self.known.get
        distinct = set().union(*cut_up)
        here = dict(zip(distinct, map(look, distinct), strict=True))  # small, so the look-ups below stay in the CPU's cache
        new = [w for w, ids in here.items() if ids is None]
        for i in range(0, len(new), 4096):
            part = new[i : i + 4096]
            for w, ids in zip(part, self._ids(part), strict=True):
                here[w] = ids
                if len(w) <= LONGEST:
                    known[w] = ids
        whole = iter(self.tokenizer.encode_batch([t for t, o in zip(texts, odd, strict=True) if o], add_special_tokens=False))
        get = here.__getitem__
        return [
            np.array(next(whole).ids, "<u4") if o else np.frombuffer(b"".join(map(get, words)), "<u4")
            for words, o in zip(cut_up, odd, strict=True)
        ]


def spans(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Where runs of texts begin and end that reach AT_ONCE characters, and the rest."""
    start = n = 0
    for k, t in enumerate(texts, 1):
        n += len(t or "")
        if n >= AT_ONCE or k == len(texts):
            yield start, k
            start, n = k, 0


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def write_token_files(
    docs: DataFrame, vocabulary: str, end_id: int, out: str, text_col: str = "text", id_col: str = "doc_id"
) -> DataFrame:
    """Encode and write all ``docs`` under ``out`` in ascending doc_id order;
    return one row a file: ``(part, seq, path, part_start, n_docs, n_ids)``,
    where part_start counts the ids of the same part's files before it. Parts
    are doc_id ranges in order."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(vocabulary)
        bits = bits_for(enc.size)
        part, seq, start = TaskContext.get().partitionId(), 0, 0
        ids: list[int | None] = []
        held: list[np.ndarray] = []
        end = np.array([end_id], np.uint32)

        def flush() -> pd.DataFrame:
            nonlocal seq, start, ids, held
            path, n = f"{out}/part-{part:06d}-{seq:05d}.pltk", sum(map(len, held))
            write_bytes(path, encode_file(ids, held, bits))
            row = pd.DataFrame([(part, seq, path, start, len(held), n)], columns=["part", "seq", "path", "part_start", "n_docs", "n_ids"])
            seq, start, ids, held = seq + 1, start + n, [], []
            return row

        n = 0
        for df in batches:
            texts = df["text"].tolist()
            names = [None if pd.isna(i) else int(i) for i in df["doc_id"].tolist()]
            for at, to in spans(texts):
                for name, found in zip(names[at:to], enc.encode(texts[at:to]), strict=True):
                    ids.append(name)
                    held.append(np.concatenate([found, end]))
                    n += len(held[-1])
                    if n >= FILE_IDS:
                        yield flush()
                        n = 0
        if held:
            yield flush()

    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    # by the texts' beginnings too, as rows may share a doc_id; whole texts would all be sampled for the ranges
    ranged = slim.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.substring("text", 1, 32)).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), "text"
    )
    return cut(
        ranged.mapInPandas(write, "part int, seq int, path string, part_start bigint, n_docs bigint, n_ids bigint")
    )


def read_token_files(files: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` for every document in the files
    that ``write_token_files`` returned. The running starts need one number for
    each part on the driver, none for each document."""
    base, bases = 0, []
    for row in files.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect():
        bases.append((row["part"], base))
        base += row["n"]
    spark = files.sparkSession
    starts = spark.createDataFrame(bases, "part int, base bigint")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for path, base, start in zip(df["path"], df["base"], df["part_start"], strict=True):
                f = TokenFile(path, whole=True)
                firsts, ids = f.firsts().astype(np.int64), f.ids(0, f.n_ids).astype("<u4")
                pairs = list(zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True))
                yield pd.DataFrame(
                    {
                        "doc_id": pd.array(f.doc_ids(), dtype="Int64"),
                        "start": firsts[:-1] + int(base + start),
                        "n_tokens": np.diff(firsts),
                        "ids_crc32": [zlib.crc32(ids[a:b]) for a, b in pairs],
                    }
                )

    return (
        files.join(F.broadcast(starts), "part")  # a row for each part
        .select("path", "base", "part_start")
        .mapInPandas(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    )


def token_ids(docs: DataFrame, vocabulary: str, end_id: int, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Encode, write under the shared folder, and read back: ``(doc_id, start,
    n_tokens, ids_crc32)`` a document. Defined cases: null and empty texts have
    the end id alone; rows with a null doc_id come first; equal doc_ids follow
    in the order of their texts; an empty table gives none; other columns are
    ignored."""
    out = f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    return read_token_files(write_token_files(docs, vocabulary, end_id, out, text_col, id_col))
