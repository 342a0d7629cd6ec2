"""Best-fit packing of token sequences, with a bounded number of open bins.

Each scan partition packs its own documents, so no row is shuffled and a lost task is simply run
again. A document's pieces come in order of arrival. A piece goes into the open sequence with the
least free space that still holds it; the open sequences stand in lists keyed by free space, and
an integer with one bit for each free space finds that list in one step. When more than
``open_bins`` are open, the fullest one closes.

Defined results: a null or empty text is one piece that holds the end id alone; a document of more
than ``capacity`` ids is cut into pieces of ``capacity`` with a shorter last one; repeated rows are
packed once each; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assetloom.llm.common import Recent, release, table

CAPACITY, OPEN_BINS, END_ID = 4096, 512, 1
#: Entries kept by a worker's caches, and the longest word kept.
CACHE_WORDS, CACHE_CHARS = 330_000, 48
#: Words stand between ASCII white space; of other white space the tokenizer takes care itself.
WORD = re.compile(r"[^\t-\r ]+")
#: Words of these characters are their own normal form but for case.
PLAIN = re.compile(r"[!-~À-ÿ]+")


class WordIds:
    """Ids of words between white space, computed by the tokenizer when first asked for.

    The tokenizer drops white space and splits nothing across it, so the ids of a text are those
    of its words in turn. A plain word skips the tokenizer's normaliser: it is lower-cased, split by
    the tokenizer's own pattern and handed to its model; any other goes through the whole of it, as does
    a word that holds one of the tokenizer's added tokens, which it takes out before anything else.
    """

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]], [x["type"] for x in spec["pre_tokenizer"]["pretokenizers"]]
        if kinds != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]):
            raise ValueError(f"not a tokenizer that splits at white space: {kinds}")
        if any(x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] or WORD.fullmatch(x["content"]) is None for x in spec["added_tokens"]):
            raise ValueError("not added tokens that stand for themselves within words")
        self.added = re.compile("|".join(re.escape(x["content"]) for x in spec["added_tokens"]) or r"(?!)")
        self.split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.model = self.tokenizer.model
        self.numbers = list(range(self.tokenizer.get_vocab_size()))  # so that cached ids share their objects
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.chars = {c: level.pre_tokenize_str(c)[0][0] for c in map(chr, [*range(33, 127), *range(0xC0, 0x100)])}
        self.parts = Recent(self._part, CACHE_WORDS, CACHE_CHARS, __name__)
        self.words = Recent(self._word, CACHE_WORDS, CACHE_CHARS, __name__)

    def _part(self, part: str) -> tuple[int, ...]:
        """Ids of one piece of the split pattern."""
        numbers = self.numbers
        return tuple([numbers[t.id] for t in self.model.tokenize(part if part.isascii() else "".join(map(self.chars.__getitem__, part)))])

    def _word(self, word: str) -> tuple[int, ...]:
        if word.isascii() and word.isalpha():
            return self.parts[word.lower()]
        if not PLAIN.fullmatch(word) or self.added.search(word):
            return tuple(self.tokenizer.encode(word, add_special_tokens=False).ids)
        low = word.lower()
        if low.isalpha():
            return self.parts[low]
        if low[:-1].isalpha() and not low[-1].isalnum():
            return self.parts[low[:-1]] + self.parts[low[-1]]
        return tuple(chain.from_iterable(map(self.parts.__getitem__, self.split.findall(low))))

    def text(self, text: str) -> np.ndarray:
        return np.array(list(chain.from_iterable(map(self.words.__getitem__, WORD.findall(text)))), dtype="<u4")


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


class BestFit:
    """Bounded-space online best fit; gives each piece its sequence and its offset there."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.open_bins = capacity, open_bins
        self.free_bits, self.n_open, self.made = 0, 0, 0
        self.by_free: dict[int, list[int]] = {}

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        out = bins.pop()
        if not bins:
            self.free_bits ^= 1 << free
        self.n_open -= 1
        return out

    def place(self, length: int) -> tuple[int, int]:
        fits = self.free_bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            which = self._take(free)
        else:
            free, which = self.capacity, self.made
            self.made += 1
        left = free - length
        if left:
            if not self.by_free.get(left):
                self.by_free[left] = []
                self.free_bits |= 1 << left
            self.by_free[left].append(which)
            self.n_open += 1
            if self.n_open > self.open_bins:  # the fullest closes
                self._take((self.free_bits & -self.free_bits).bit_length() - 1)
        return which, self.capacity - free


PACKED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("tokens", T.BinaryType()),
        T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()),
    ]
)


def pack_documents(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, open_bins: int = OPEN_BINS, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, tokens (little-endian unsigned 32-bit),
    sequence_id, offset. Only the two named columns are read.

    Waste: at most ``open_bins`` sequences of a partition stay short of full, beside those closed
    early; the larger the partitions, the smaller their share.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        release(__name__)
        encode, fit, base = word_ids(path).text, BestFit(capacity, open_bins), TaskContext.get().partitionId() << 40
        end = np.array([end_id], dtype="<u4")
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.concatenate((encode(text.as_py() or ""), end))
                for k, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    which, offset = fit.place(len(part))
                    rows.append((doc, k, start, len(part), part.tobytes(), base + which, offset))
            columns = zip(*rows, strict=True) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, ARROW, strict=True)], names=PACKED.names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PACKED)


ARROW = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]


def packed_digest(packed: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their tokens."""
    return packed.select("doc_id", "piece", "start", "length", F.crc32("tokens").alias("ids_crc32"), "sequence_id", "offset")


def op9_best_fit_packing(spark, sf_dir):
    """Pack every document into sequences of at most 4096 tokens."""
    import public_tokenizers

    return packed_digest(pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))
