"""Token counts with overlap resynchronisation for huge documents.

The tokenizer never joins text across white space: its pre-tokens hold none, so the count of a text is the sum over its
words between white space, and words recur. Documents of up to two chunks are counted that way from a memo of words. A longer one is
cut into overlapping chunks that are encoded with offsets; two neighbours are spliced at a boundary between tokens that
lies at white space inside their overlap, after which both give the same tokens up to the end of the earlier chunk's last
whole word. A chunk goes on until its overlap holds white space; where the two don't agree, the overlap is doubled, and then the
chunk itself.
"""

from __future__ import annotations

import os
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: White space as the tokenizer's expressions have it (Unicode White_Space; str.split() would add four separators).
SPACE = re.compile(r"[\t-\r \x85\xa0  -     　]+")
_ODD = re.compile("[\x1c-\x1f]")
#: Characters above which a text is cut, of a chunk and of an overlap; the limit of tokens; words in the memo.
HUGE, CHUNK, OVERLAP, LIMIT, MEMO = 1 << 14, 1 << 13, 256, 2048, 1_500_000
_MEMOS: dict[str, dict[str, int]] = {}  # of this Python worker, by vocabulary; a cache of bounded size


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordCounter:
    """Counts tokens of texts. The memo outlives the task, as Spark uses its Python workers again."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok, self.memo = Tokenizer.from_file(path), _MEMOS.setdefault(path, {})
        self.tok.no_truncation()
        self.tok.no_padding()

    def words(self, texts: list[str]) -> list[int]:
        """Counts by word; words that are not in the memo are encoded together."""
        memo = self.memo
        if len(memo) > MEMO:  # rebuilt from the words that come
            memo.clear()
        split = [SPACE.split(t) if _ODD.search(t) else t.split() for t in texts]
        new = list({w for ws in split for w in ws if w not in memo})
        for at in range(0, len(new), 20_000):
            some = new[at : at + 20_000]
            memo.update(zip(some, map(len, self.tok.encode_batch_fast(some, add_special_tokens=False))))
        return [sum(map(memo.__getitem__, ws)) for ws in split]

    def spliced(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
        """Count of a huge text from overlapping chunks. A chunk goes on until its overlap holds white space, and what has no stable
        boundary is encoded again at twice the length, so the work is in proportion to the text whatever it looks like."""
        total, at, wide = 0, 0, overlap
        a = self._encode(text, 0, self._end(text, chunk, overlap))
        while a[1] < len(text):  # a: start, end, token starts, ids; tokens before `at` are counted
            start = max(at, self._back(text, a[1], wide))
            b = self._encode(text, start, self._end(text, max(start + max(chunk, 2 * wide), a[1] + 1), overlap))
            cut = self._common(text, a, b)
            if cut is None and start > at:
                wide *= 2
                continue
            if cut is None:  # not one boundary in all of a: twice as much at once
                a = self._encode(text, at, self._end(text, at + 2 * (a[1] - at), overlap))
                continue
            total += bisect_left(a[2], cut) - bisect_left(a[2], at)
            at, a, wide = cut, b, overlap
        return total + len(a[2]) - bisect_left(a[2], at)

    @staticmethod
    def _end(text: str, end: int, overlap: int) -> int:
        """Where a chunk that should end at end does: there, if white space stands twice in the overlap before it, else behind the
        second white space that follows, else with the text."""
        end = min(end, len(text))
        if end == len(text) or len(list(islice(SPACE.finditer(text, max(end - overlap, 0), end), 2))) == 2:
            return end
        after = [m.end() for m in islice(SPACE.finditer(text, end), 2)]
        return after[1] if len(after) == 2 else len(text)

    @staticmethod
    def _back(text: str, end: int, wide: int) -> int:
        """Where the next chunk begins: wide before end, or more where white space doesn't stand twice in between."""
        start = max(end - wide, 0)
        while start > 0 and len(list(islice(SPACE.finditer(text, start, end), 2))) < 2:
            start = max(end - 2 * (end - start), 0)
        return start

    def _encode(self, text: str, start: int, end: int) -> tuple[int, int, list[int], list[int]]:
        e = self.tok.encode(text[start:end], add_special_tokens=False)
        return start, end, [start + s for s, _ in e.offsets], e.ids

    @staticmethod
    def _common(text: str, a: tuple, b: tuple) -> int | None:
        """The first white space in the overlap from which on a and b have the same tokens; None if there is none.

        A boundary at white space is stable whatever stands around it. a's last word may be cut off by the end of the
        chunk, so the tokens are compared up to the white space before it.
        """
        spaces = [m.start() for m in SPACE.finditer(text, b[0], a[1])]
        if len(spaces) < 2:
            return None
        last = spaces[-1]
        mine, other = bisect_left(a[2], last), bisect_left(b[2], last)
        same = 0  # tokens before the last white space that agree, counted from there back
        while same < min(mine, other) and a[2][mine - same - 1] == b[2][other - same - 1] and a[3][mine - same - 1] == b[3][other - same - 1]:
            same += 1
        if not same:
            return None
        # Behind the first token that differs, if there is one: a token of a or b before the common ones.
        free = max([x[2][n - same - 1] for x, n in ((a, mine), (b, other)) if n > same], default=-1)
        first = next((p for p in spaces[:-1] if p > free and bisect_left(a[2], p) < mine), None)
        return first


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT, huge: int = HUGE) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit per row; null texts count as empty (0 tokens), repeated rows by themselves.

    path: a vocabulary file of the tokenizers library. huge: texts with more characters are spliced from chunks.
    """
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = WordCounter(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            counts = counter.words([t if len(t) <= huge else "" for t in texts])
            counts = [n if len(t) <= huge else counter.spliced(t) for n, t in zip(counts, texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["doc_id", "n_tokens"])

    kind = dict(docs.dtypes)["doc_id"]
    # The number of bytes comes along from the JVM side of the text column.
    counted = docs.select(F.struct("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")).alias("doc_id"), "text")
    out = counted.mapInArrow(run, f"doc_id struct<doc_id:{kind},n_bytes:bigint>, n_tokens bigint")
    return out.select("doc_id.doc_id", "doc_id.n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
