"""Token counts by rank-synchronous array merging."""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import unicodedata
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 2048
#: Distinct pre-tokens whose counts a task remembers; beyond it starts anew.
REMEMBERED = 1_000_000
#: What the vocabulary's patterns mean by white space.
SPACE = r"\t\n\x0b\x0c\r\x20\x85\xa0  -     　"


class WordBpe:
    """Counts of a BPE with word ends, read from a tokenizers file: NFC, lower case, split by its pattern, merges."""

    def __init__(self, path: str) -> None:
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        if kinds != ["NFC", "Replace", "Lowercase"] or split["behavior"] != "Removed" or not split["invert"] or level["type"] != "ByteLevel" or level["add_prefix_space"] or level["use_regex"]:
            raise ValueError(f"{path}: not a word BPE of the kind that this class counts")
        self.words = regex.compile(split["pattern"]["Regex"].replace(r"\s", SPACE))
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        # Byte-level vocabularies write printable bytes as themselves and the others as characters from 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        char = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        self.inner = np.array([vocab[char[b]] for b in range(256)], np.int64)
        self.final = np.array([vocab[char[b] + suffix] for b in range(256)], np.int64)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        a, b = (np.array([vocab[m[i]] for m in merges], np.int64) for i in (0, 1))
        made = np.array([vocab["".join(m)] for m in merges], np.int64)
        order = np.argsort(a << 32 | b, kind="stable")
        self.pairs, self.ranks, self.made = (a << 32 | b)[order], order.astype(np.int64), made
        # A merge may be applied to all its places at once if what it makes takes part in no earlier merge
        first = np.full(max(vocab.values()) + 1, len(merges), np.int64)
        np.minimum.at(first, a, np.arange(len(merges)))
        np.minimum.at(first, b, np.arange(len(merges)))
        self.at_once = first[made] > np.arange(len(merges))
        self.known: dict[str, int] = {}
        # Characters whose classes no Unicode version has changed of late; texts with others are split by the library
        self.rare = regex.compile("[^\x00-\u052f\u2000-\u206f\u20a0-\u20bf\u3000-\u30fe\u4e00-\u9fa5\uac00-\ud7a3]")
        self.library, self.byte = None, {c: b for b, c in char.items()}
        self.path = path

    def merged(self, words: list[bytes]) -> np.ndarray:
        """Symbols that are left of each word (not empty), all words merged in step."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(lengths) - 1
        symbols = self.inner[raw]
        symbols[ends] = self.final[raw[ends]]
        left = np.ones(len(words), np.int64)
        row = np.repeat(np.arange(len(words)), lengths)
        no = len(self.made)
        while len(symbols) > 1:
            pair = symbols[:-1] << 32 | symbols[1:]
            at = np.minimum(np.searchsorted(self.pairs, pair), no - 1)
            rank = np.where((self.pairs[at] == pair) & (row[:-1] == row[1:]), self.ranks[at], no)
            rank = np.append(rank, no)
            starts = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            low = np.minimum.reduceat(rank, starts)
            counts = np.diff(np.append(starts, len(row)))
            done = low == no
            if done.any():  # these words are finished; they leave the arrays
                left[row[starts[done]]] = counts[done]
                stay = np.repeat(~done, counts)
                symbols, row, rank = symbols[stay], row[stay], rank[stay]
                if not len(symbols):
                    return left
                starts = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
                low, counts = low[~done], counts[~done]
            lowest = np.repeat(low, counts)
            hit = np.flatnonzero(rank == lowest)
            # places in a run of equal symbols overlap: from the left every second one; unsafe merges: the first place
            new_run = np.append(True, (hit[1:] != hit[:-1] + 1) | (row[hit[1:]] != row[hit[:-1]]))
            run_start = np.maximum.accumulate(np.where(new_run, np.arange(len(hit)), 0))
            first = np.append(True, row[hit[1:]] != row[hit[:-1]])
            hit = hit[((np.arange(len(hit)) - run_start) % 2 == 0) & (self.at_once[rank[hit]] | first)]
            symbols[hit] = self.made[rank[hit]]
            keep = np.ones(len(symbols), bool)
            keep[hit + 1] = False
            symbols, row = symbols[keep], row[keep]
        if len(symbols):
            left[row[0]] = 1
        return left

    def split(self, text: str) -> list[str]:
        if self.rare.search(text):
            if self.library is None:
                from tokenizers import Tokenizer

                self.library = Tokenizer.from_file(self.path)
            words = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
            return [bytes(self.byte[c] for c in w).decode() for w, _ in words]
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower() would heed a word's end
        return self.words.findall(text.lower())

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text; special strings in it count one each."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known, found, parts = self.known, [], []
        for text in texts:
            n = 0
            if self.special and "<|" in text:
                pieces = self.special.split(text)
                n = len(pieces) - 1
                words = [w for p in pieces for w in self.split(p)]
            else:
                words = self.split(text)
            parts.append((n, words))
        new = list({w for _, words in parts for w in words} - known.keys())
        for i in range(0, len(new), 1 << 16):
            some = new[i : i + (1 << 16)]
            known.update(zip(some, self.merged([w.encode("utf-8", "surrogatepass") for w in some]).tolist()))
        found = [n + sum(map(known.__getitem__, words)) for n, words in parts]
        return found


@functools.cache
def counter(path: str) -> WordBpe:
    return WordBpe(path)


def token_counts(docs: DataFrame, vocabulary: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of docs (doc_id, text, ...).

    Null text counts as empty: no bytes, no tokens. Texts are counted whole, however long. Rows are counted where
    they are read, without a shuffle, so repeated rows, ties and an empty table need no care; a null doc_id stays
    null. Other columns are not read. Special strings inside texts are one token each.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = counter(vocabulary)
        for batch in batches:
            n: list[int] = []
            for i in range(0, batch.num_rows, 500):
                n += bpe.counts([t or "" for t in batch.column(1).slice(i, 500).to_pylist()])
            tokens = pa.array(n, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), tokens, pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col("doc_id").cast("long"), "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
