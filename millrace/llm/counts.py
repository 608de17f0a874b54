"""Token counts by byte-pair merging, without ids.

A text is cut by the tokenizer's pattern into pieces that no merge crosses. A piece starts as its UTF-8
bytes in a linked list; a heap holds its adjacent pairs that have a rank. The pair of lowest rank (the
leftmost of equals) is popped and merged as long as there is one, and its new neighbours are pushed. The
piece has as many tokens as it had bytes, less the merges: no id is looked up or emitted. Counts of short
pieces are kept in a table of bounded size, so a worker merges each frequent piece once; a long piece of n
bytes takes n log n steps.

Tokens added to the vocabulary, such as ``<|endoftext|>``, count one wherever their text occurs, which is
what the library does by default. The file must hold a byte-level BPE tokenizer (``byte_bpe_50k.json`` is
one); anything else is refused.

A missing text is empty: no bytes, no tokens, within every limit. Rows that repeat are counted each for
itself; an empty table gives an empty one. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from millrace.llm.common import over_batches, strings

LIMIT = 1024
# fixed values: white space as the tokenizer's pattern sees it, and that pattern
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: Characters of a text cut at once as a list; longer texts are cut piece by piece.
AT_ONCE = 1 << 20


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else one from 256 up."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class Counter(dict):
    """Tokens per piece, kept for short pieces; emptied by halves when full."""

    def __init__(self, path: str, limit: int = 300_000, longest: int = 64):
        with open(path, encoding="utf-8") as f:
            stated = json.load(f)
        model, cut = stated["model"], stated["pre_tokenizer"] or {}
        plain = not (stated["normalizer"] or cut.get("add_prefix_space") or model.get("ignore_merges") or model.get("dropout"))
        if model["type"] != "BPE" or cut.get("type") != "ByteLevel" or not cut.get("use_regex", True) or not plain:
            raise ValueError(f"{path} is not a plain byte-level BPE tokenizer")
        added = stated["added_tokens"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError(f"{path} has added tokens with conditions on their surroundings")
        self.pattern = regex.compile(PATTERN)
        # the longest of several added tokens at one place
        self.added = sorted((t["content"] for t in added), key=len, reverse=True)
        self.cutter = regex.compile("|".join(map(regex.escape, self.added))) if added else None
        self.letters = byte_letters()
        vocab = model["vocab"]
        self.first = [vocab[c] for c in self.letters]
        # a pair of symbols to the rank of its merge and the symbol it becomes
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocab[left], vocab[right]] = (rank, vocab[left + right])
        self.limit, self.longest, self.older = limit, longest, {}

    def __missing__(self, piece: str) -> int:
        n = self.older.get(piece)
        if n is None:
            n = self.merged(piece.encode())
        if len(piece) <= self.longest:
            if len(self) >= self.limit:
                # what was used since the last time is still near at hand
                self.older = dict(self)
                self.clear()
            self[piece] = n
        return n

    def merged(self, data: bytes) -> int:
        """The number of symbols left when no adjacent pair has a rank."""
        merges, end = self.merges, len(data)
        symbol = [self.first[b] for b in data]
        after, before = list(range(1, end + 1)), list(range(-1, end - 1))
        heap = []
        for at in range(end - 1):
            found = merges.get((symbol[at], symbol[at + 1]))
            if found:
                heap.append((found[0], at, found[1]))
        heapq.heapify(heap)
        left = end
        while heap:
            _, at, made = heapq.heappop(heap)
            nxt = after[at]
            # passed over if either symbol was merged since
            if symbol[at] < 0 or nxt >= end:
                continue
            found = merges.get((symbol[at], symbol[nxt]))
            if not found or found[1] != made:
                continue
            symbol[at], symbol[nxt] = made, -1
            left -= 1
            beyond = after[nxt]
            after[at] = beyond
            if beyond < end:
                before[beyond] = at
                found = merges.get((made, symbol[beyond]))
                if found:
                    heapq.heappush(heap, (found[0], at, found[1]))
            prior = before[at]
            if prior >= 0:
                found = merges.get((symbol[prior], made))
                if found:
                    heapq.heappush(heap, (found[0], prior, found[1]))
        return left

    def plain(self, text: str) -> int:
        """Tokens of a text without added tokens."""
        if len(text) <= AT_ONCE:
            return sum(map(self.__getitem__, self.pattern.findall(text)))
        return sum(self[m.group()] for m in self.pattern.finditer(text))

    def count(self, text: str) -> int:
        """Tokens of a whole text."""
        if not any(t in text for t in self.added):
            return self.plain(text)
        total, at = 0, 0
        for m in self.cutter.finditer(text):
            total += self.plain(text[at : m.start()]) + 1
            at = m.end()
        return total + self.plain(text[at:])


@lru_cache(4)
def counter(path: str) -> Counter:
    """One table per worker process and vocabulary file."""
    return Counter(path)


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more tokens than ``limit``) of every row."""
    kind = docs.select(id_col).schema[0].dataType

    def make():
        count = counter(tokenizer).count

        def one(batch):
            texts = strings(batch)
            n_tokens = pa.array(map(count, texts), pa.int64(), size=len(texts))
            n_bytes = pa.array([len(t.encode()) for t in texts], pa.int64())
            return pa.RecordBatch.from_arrays([batch.column(0), n_bytes, n_tokens], [id_col, "n_bytes", "n_tokens"])

        return one

    counted = over_batches(docs.select(F.col(id_col), F.col(text_col).alias("text")), make, f"`{id_col}` {kind.simpleString()}, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
