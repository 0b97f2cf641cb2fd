"""Packing documents into fixed windows by best-fit decreasing.

Documents are tokenized, closed by an end id and first cut into full windows;
the remainders are placed longest first into the tightest open window, found by
a segment tree over remaining capacities. Pieces are dealt into independent
bins of about ``GROUP_TOKENS`` tokens by hash, so packing is parallel and its
memory bounded; thousands of windows per bin leave next to no padding.

Defined results: a null or empty text is the end id alone; equal rows are packed
each; ties in length go by doc_id and start; extra columns are ignored; an empty
table gives no windows.
"""

from __future__ import annotations

import codecs
import json
import math
import re
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW = 4096
END_ID = 2
#: Tokens of the pieces that are packed together: about 2,000 windows.
GROUP_TOKENS = 8 << 20
#: And so many pieces at most, on average, where documents are tiny.
GROUP_PIECES = 100_000
#: Bytes of texts that are split into words together.
TOGETHER = 2 << 20
#: Words whose ids a worker remembers; beyond it the memory starts anew.
CACHE_WORDS = 600_000


#: Latin letters that are alike in every normal form (no dotted capital I), then marks but the apostrophe.
_PLAIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+)([!-&(-/:-@\[-`{-~]*)")


#: Byte-level vocabularies write a byte as itself where it prints in Latin-1, else as the next free letter from U+0100; blanks part words.
_PRINTS = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_SPARE = iter(range(0x100, 0x200))
_BYTE_LETTERS = "".join(chr(b if b in _PRINTS else next(_SPARE)) for b in range(256)).replace(chr(0x120), " ")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def words_stand_alone(spec: dict) -> bool:
    """Whether a tokenizer's ids are those of its words, in lower case, one after the other."""
    normal, cut = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    normal, cut = normal.get("normalizers", [normal]), cut.get("pretokenizers", [cut])
    lower = bool(normal) and normal[-1].get("type") == "Lowercase" and all(n.get("type") in ("NFC", "Replace", "Lowercase") for n in normal)
    blanks = all(n.get("pattern") == {"Regex": r"\s+"} and n.get("content") == " " for n in normal if n.get("type") == "Replace")
    first = cut[0] if cut else {}
    split = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True and r"[^\s" in (first.get("pattern") or {}).get("Regex", "")
    model = spec.get("model", {})
    return lower and blanks and split and [c.get("type") for c in cut[1:]] == ["ByteLevel"] and not cut[1].get("add_prefix_space") and model.get("type") == "BPE" and model.get("end_of_word_suffix") == "</w>"


class WordEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes.

    A vocabulary of lower case that drops white space never joins across it, so the ids of a text are
    those of its words in a row. Words repeat; each is encoded once and remembered. Any
    other vocabulary, told by its normalizer and pre-tokenizer, encodes whole texts.
    """

    def __init__(self, path: str, size: int = CACHE_WORDS):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.size, self.known = Tokenizer.from_file(path), size, {}
        self.by_word = words_stand_alone(json.loads(self.tokenizer.to_str()))
        if not self.by_word:
            return
        # the merges alone, for words that need no normalizing and no splitting
        self.letters = Tokenizer(self.tokenizer.model)
        self.letters.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def learn(self, words: Iterable[bytes]) -> None:
        """Remember the ids of words.

        A word of plain letters is one pre-token, so it ends at the first id that
        ends a word: such words are encoded in one run and cut at those ids.
        Marks behind it are a pre-token of their own. Other words go one by one.
        """
        plain: dict[str, bytes] = {}
        marked: list[tuple[bytes, str, bytes]] = []
        other: list[bytes] = []
        for w in words:
            m = _PLAIN.fullmatch(w.decode())
            if m is None:
                other.append(w)
                continue
            letters, marks = m[1].lower(), m[2].encode()
            plain[letters] = b""
            marked.append((w, letters, marks))
            if marks and marks not in self.known:
                other.append(marks)
        if plain:
            text, _ = codecs.charmap_decode(" ".join(plain).encode(), "strict", _BYTE_LETTERS)
            ids = np.array(self.letters.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            ends = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(ends) != len(plain) or ends[-1] != 4 * len(ids):
                raise ValueError("the vocabulary does not end words as expected")
            body, at = ids.tobytes(), 0
            for letters, end in zip(plain, ends):
                plain[letters] = body[at:end]
                at = end
        other = list(dict.fromkeys(other))
        encoded = self.tokenizer.encode_batch_fast([w.decode() for w in other], add_special_tokens=False)
        self.known.update((w, np.array(e.ids, "<u4").tobytes()) for w, e in zip(other, encoded))
        known = self.known
        known.update((w, plain[letters] + known[marks] if marks else plain[letters]) for w, letters, marks in marked)

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        if not self.by_word:
            for text in texts:  # one at a time: long texts meet none of their like in memory
                yield np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, "<u4").tobytes()
            return
        known, together = self.known, []
        for text in texts:
            # the vocabulary is of lower case; only the strings of special ids are not
            together.append((text if b"<|" in text else text.lower()).split())
        missing = set(chain.from_iterable(together)).difference(known)
        if len(known) + len(missing) > self.size:
            known.clear()
            missing = set(chain.from_iterable(together))
        self.learn(missing)
        for words in together:
            yield b"".join(map(known.__getitem__, words))


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder per worker process and vocabulary."""
    if path not in _ENCODERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def tokenize(docs: DataFrame, path: str, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids]): the pieces of each document, full windows first.

    ``ids`` are little-endian unsigned 32-bit ids in a binary column.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), common.text_or_empty(text_col).cast("binary").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if with_ids else [])]
    width, end = 4 * window, END_ID.to_bytes(4, "little")
    common.bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(path)
        for batch in batches:
            kinds = [batch.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            ids = batch["doc_id"].to_pylist()
            texts = batch["text"]
            lo = 0
            while lo < len(ids):
                # so many texts together as hold TOGETHER bytes, or one
                hi, size = lo + 1, len(texts[lo].as_buffer())
                while hi < len(ids) and size + len(texts[hi].as_buffer()) <= TOGETHER:
                    size += len(texts[hi].as_buffer())
                    hi += 1
                rows = []
                for doc, body in zip(ids[lo:hi], words.encode(t.as_py() for t in texts[lo:hi])):
                    body += end
                    for at in range(0, len(body), width):
                        piece = body[at : at + width]
                        rows.append((doc, at // 4, len(piece) // 4, zlib.crc32(piece), len(body) // 4, piece)[: len(names)])
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                lo = hi
        words.known.clear()  # the worker lives on, for other work too

    return source.mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids)


class CapacityTree:
    """Open windows by remaining capacity, in a segment tree of counts."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, remaining: int, window: int) -> None:
        self.open[remaining].append(window)
        at = self.leaves + remaining
        while at:
            self.count[at] += 1
            at >>= 1

    def tightest(self, length: int) -> int | None:
        """The least remaining capacity of at least ``length`` that a window has."""
        count, at = self.count, self.leaves + length
        if count[at]:
            return length
        while at > 1:  # up until a right sibling holds windows, then down its left edge
            if not at & 1 and count[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if count[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return None

    def take(self, remaining: int) -> int:
        at = self.leaves + remaining
        while at:
            self.count[at] -= 1
            at >>= 1
        return self.open[remaining].pop()


def best_fit_decreasing(lengths: list[int], window: int = WINDOW) -> tuple[list[int], list[int]]:
    """(window, offset) of each piece; the lengths come in decreasing order, none above ``window``."""
    tree, windows, offsets, made = CapacityTree(window), [], [], 0
    for n in lengths:
        if n > window:
            raise ValueError(f"a piece of {n} tokens exceeds the window of {window}")
        remaining = tree.tightest(n) if n < window else None
        if remaining is None:
            own, remaining, made = made, window, made + 1
        else:
            own = tree.take(remaining)
        windows.append(own)
        offsets.append(window - remaining)
        if remaining > n:
            tree.add(remaining - n, own)
    return windows, offsets


def pack(pieces: DataFrame, window: int = WINDOW, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """Add sequence_id and offset to the (stored) pieces.

    A sequence id is the bin's number and the window's number in it.
    """
    total, count = pieces.agg(F.coalesce(F.sum("length"), F.lit(0)), F.count("*")).first()
    groups = max(1, math.ceil(total / group_tokens), math.ceil(count / GROUP_PIECES))
    # the place of a row among the stored ones, too: repeated rows would all have one bin
    dealt = pieces.withColumn("bin", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)).cast("long"))
    columns = [f"{c} {t}" for c, t in pieces.dtypes]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        by = [c for c in ("doc_id", "start", "ids_crc32") if c in rows]
        rows = rows.sort_values(["length", *by], ascending=[False, *[True] * len(by)], ignore_index=True)
        windows, offsets = best_fit_decreasing(rows["length"].tolist(), window)
        base = int(rows["bin"].iloc[0]) << 32
        return rows.drop(columns="bin").assign(sequence_id=[base + w for w in windows], offset=offsets)

    return dealt.groupBy("bin").applyInPandas(run, ", ".join(columns) + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str | None = None, window: int = WINDOW, group_tokens: int = GROUP_TOKENS, with_ids: bool = False) -> DataFrame:
    """Tokenize and pack: one row per piece."""
    pieces = common.store(tokenize(docs, path or tokenizer_path(), window, with_ids=with_ids), "pieces")
    return pack(pieces, window, group_tokens)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in windows of 4096 ids."""
    return pack_documents(common.table(spark, sf_dir, "documents")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
