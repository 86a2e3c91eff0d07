"""Token counts by rank-synchronous merging of ragged symbol arrays.

A text is cut into pre-tokens by the vocabulary file's own pattern. A batch of
pre-tokens not met before lies in one flat numpy array of symbol ids with an
owner per symbol. In each round every pre-token looks up the rank of all its
neighbouring pairs, finds its own lowest, and all its occurrences of that pair
merge at once, from the left and without overlap; pre-tokens with no known pair
are finished and leave the arrays. A pair that holds a merged symbol always
ranks behind the pair that made it, so this gives the tokens that merging one
pair at a time gives. The symbols that survive are counted. Counts are kept per
distinct pre-token in a bounded table of the worker.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OVER = 1024
#: Pre-tokens remembered by a worker before it starts afresh, and the longest remembered.
KNOWN, LONGEST = 400_000, 64
#: Symbols merged together.
BLOCK = 1 << 20
#: Fixed value: the byte-level vocabularies' pre-token pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary file:
    printable bytes stand for themselves, the others follow from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


#: A character of each class that no contraction holds: letter, number, space, other.
STAND_IN = {r"\p{L}": "é", r"\p{N}": "٣", r"\s": "\u2003", "": "§"}


def differing() -> dict[int, str]:
    """Characters that the tokenizers library puts in another class than this
    process's ``regex``, as their Unicode versions differ, each with a character
    of the library's class."""
    import regex
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    every = "".join(map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x110000)]))
    here, there = np.full(len(every), 3), np.full(len(every), 3)
    for k, name in enumerate(list(STAND_IN)[:3]):
        for m in regex.finditer(f"{name}+", every):
            here[m.start() : m.end()] = k
        rest = np.ones(len(every), bool)
        for _, (a, b) in Split(Regex(f"{name}+"), "removed").pre_tokenize_str(every):
            rest[a:b] = False
        there[rest] = k
    stand = list(STAND_IN.values())
    return {ord(every[i]): stand[there[i]] for i in np.flatnonzero(here != there)}


class MergeTable:
    """A byte-level BPE file (tokenizers JSON) as sorted arrays."""

    def __init__(self, path: str) -> None:
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec["pre_tokenizer"], spec["model"]
        plain = pre["type"] == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"]
        if spec["normalizer"] is not None or not plain or model["type"] != "BPE" or model["ignore_merges"]:
            raise ValueError(f"{path}: not a plain byte-level BPE file")
        ids = model["vocab"]
        self.byte_id = np.array([ids[c] for c in byte_letters()], np.int64)
        self.base = max(ids.values()) + 1
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        key = np.array([ids[a] * self.base + ids[b] for a, b in pairs], np.int64)
        into = np.array([ids[a + b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.key, self.rank, self.into = key[order], order.astype(np.int64), into
        self.none = len(key)
        added = spec["added_tokens"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
            raise ValueError(f"{path}: added tokens with options")
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in added)) if added else None
        self.pattern = regex.compile(PATTERN)
        self.later = regex.compile("[^\x00-\u017f]")
        self.known: dict[str, int] = {}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        k = left * self.base + right
        at = np.minimum(np.searchsorted(self.key, k), self.none - 1)
        return np.where(self.key[at] == k, self.rank[at], self.none)

    def merge(self, pieces: list[bytes]) -> np.ndarray:
        """The number of symbols that survive in each of ``pieces``."""
        size = np.array([len(p) for p in pieces], np.int64)
        left = size.copy()
        sym = self.byte_id[np.frombuffer(b"".join(pieces), np.uint8)]
        own = np.repeat(np.arange(len(pieces)), size)
        while len(sym) > 1:
            rank = self.ranks(sym[:-1], sym[1:])
            rank[own[:-1] != own[1:]] = self.none
            start = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            low = np.minimum.reduceat(np.r_[rank, self.none], start)
            length = np.diff(np.r_[start, len(own)])
            here = np.repeat(low, length)
            if (low == self.none).any():  # finished pieces leave
                stay = here < self.none
                sym, own, here = sym[stay], own[stay], here[stay]
                rank = np.r_[rank, self.none][stay]
                if not len(sym):
                    break
            else:
                rank = np.r_[rank, self.none]
            hit = rank == here
            # of occurrences that overlap (a run of one symbol) every second one counts
            follows = np.r_[False, hit[1:] & hit[:-1]]
            run = np.arange(len(hit)) - np.maximum.accumulate(np.where(hit & ~follows, np.arange(len(hit)), 0))
            hit &= run % 2 == 0
            at = np.flatnonzero(hit)
            sym[at] = self.into[rank[at]]
            gone = at + 1
            left -= np.bincount(own[gone], minlength=len(left))
            stay = np.ones(len(sym), bool)
            stay[gone] = False
            sym, own = sym[stay], own[stay]
        return left

    def learn(self, pieces: list[str]) -> list[int]:
        """Counts of pieces that aren't in the table; short ones enter it."""
        raw = [p.encode("utf-8", "replace") for p in pieces]
        out: list[int] = []
        at = 0
        while at < len(raw):
            end, total = at, 0
            while end < len(raw) and (end == at or total + len(raw[end]) <= BLOCK):
                total += len(raw[end])
                end += 1
            out += self.merge(raw[at:end]).tolist()
            at = end
        return out

    @cached_property
    def odd(self):
        import regex

        self.others = differing()
        return regex.compile("[" + "".join(map(regex.escape, map(chr, self.others))) + "]") if self.others else None

    def pieces(self, text: str) -> list[str]:
        # characters up to U+017F have been in one class in all versions
        if text.isascii() or not self.later.search(text) or self.odd is None or not self.odd.search(text):
            return self.pattern.findall(text)
        return [text[m.start() : m.end()] for m in self.pattern.finditer(text.translate(self.others))]

    def spans(self, text: str) -> tuple[list[str], int]:
        """A text's pre-tokens, and how many added tokens stand in it."""
        parts = [text] if self.special is None else self.special.split(text)
        if len(parts) == 1:
            return self.pieces(text), 0
        return [p for s in parts for p in self.pieces(s)], len(parts) - 1

    def count(self, texts: list[str]) -> list[int]:
        """The number of tokens of each text; null counts as empty."""
        cut = [self.spans(t or "") for t in texts]
        if len(self.known) > KNOWN:
            self.known = {}
        known = self.known
        new = {p for pieces, _ in cut for p in pieces if p not in known}
        extra: dict[str, int] = {}
        if new:
            for p, n in zip(fresh := list(new), self.learn(fresh), strict=True):
                (known if len(p) <= LONGEST else extra)[p] = n
        if extra:
            return [n + sum(known[p] if p in known else extra[p] for p in pieces) for pieces, n in cut]
        get = known.__getitem__
        return [n + sum(map(get, pieces)) for pieces, n in cut]


@lru_cache(maxsize=4)
def merge_table(path: str) -> MergeTable:
    return MergeTable(path)


#: Characters counted in one go.
CHUNK = 1 << 20


def token_counts(
    docs: DataFrame, vocabulary: str, text_col: str = "text", id_col: str = "doc_id", over: int = OVER
) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` for every row of ``docs``.

    ``vocabulary``: a byte-level BPE file that every worker can open. The strings
    of its added tokens count one each, as the tokenizers library takes them by
    default; none is added, nothing is cut off. Defined cases: null and empty
    texts have 0 bytes and 0 tokens; null doc_ids and repeated rows come back
    as they came; an empty table gives none; other columns are ignored.
    """

    @F.pandas_udf("bigint")
    def n_tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = merge_table(vocabulary)
        for s in batches:
            texts, out, at = s.tolist(), [], 0
            while at < len(texts):
                end, total = at, 0
                while end < len(texts) and (end == at or total < CHUNK):
                    total += len(texts[end] or "")
                    end += 1
                out += table.count(texts[at:end])
                at = end
            yield pd.Series(out, dtype="int64")

    counted = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("bigint").alias("n_bytes"),
        n_tokens(F.col(text_col)).alias("n_tokens"),
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > over)
