"""Token counts of a byte-level BPE with word ends, by rank-synchronous merging of ragged arrays.

A batch's new pre-tokens lie end to end in one symbol array. In each round every sequence finds its
lowest-ranked neighbouring pair by a segmented minimum, all of its occurrences are merged at once
(from the left where they overlap), and the arrays are closed up; sequences without a known pair leave.
The count of a pre-token is the number of its symbols that survive.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
#: Most pre-tokens that a Python worker remembers between batches; it forgets all beyond.
REMEMBERED = 1 << 20
#: Fixed value: the vocabulary's split pattern, and below the same classes spelled out for texts within Latin-1.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LATIN = r"[a-zªµºß-öø-ÿ]+|'(?:s|t|re|ve|m|ll|d)|[0-9²³¹¼-¾]|[^a-zªµºß-öø-ÿ0-9²³¹¼-¾\t-\r \x85\xa0]+"
_NONE = np.iinfo(np.int32).max


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where it is printable, else the next one from 256."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in own else next(others)) for b in range(256)]


class TokenCounter:
    """Counts tokens as the vocabulary's library does by default, special strings included."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocabulary, merges = spec["model"]["vocab"], spec["model"]["merges"]
        suffix = spec["model"].get("end_of_word_suffix") or ""
        letters = byte_letters()
        self.inner = np.array([vocabulary[x] for x in letters], np.int64)
        self.final = np.array([vocabulary[x + suffix] for x in letters], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        keys = np.array([vocabulary[a] << 32 | vocabulary[b] for a, b in pairs], np.int64)
        made = np.array([vocabulary[a + b] for a, b in pairs], np.int64)
        self.order = np.argsort(keys, kind="stable")
        self.keys, self.made = keys[self.order], made
        split = next(x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.find = regex.compile(split["pattern"]["Regex"]).findall
        self.find_latin = re.compile(_LATIN).findall if split["pattern"]["Regex"] == _SPLIT else None
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.special_mark = "<|"
        self.known: dict[str, int] = {}

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.order[at], _NONE).astype(np.int32)

    def merged_lengths(self, words: list[bytes]) -> np.ndarray:
        """Symbols left of each non-empty byte string after all merges."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        counts = sizes.copy()
        if not len(words):
            return counts
        flat = np.frombuffer(b"".join(words), np.uint8)
        symbols = self.inner[flat]
        ends = np.cumsum(sizes)
        symbols[ends - 1] = self.final[flat[ends - 1]]
        names, starts = np.arange(len(words)), ends - sizes
        ranks = np.full(len(symbols), _NONE, np.int32)
        ranks[:-1] = self._ranks(symbols[:-1], symbols[1:])
        ranks[ends - 1] = _NONE
        while len(names):
            least = np.minimum.reduceat(ranks, starts)
            alive = least != _NONE
            if not alive.all():
                counts[names[~alive]] = sizes[~alive]
                stays = np.repeat(alive, sizes)
                symbols, ranks = symbols[stays], ranks[stays]
                names, sizes, least = names[alive], sizes[alive], least[alive]
                if not len(names):
                    break
                starts = np.cumsum(sizes) - sizes
            hit = np.flatnonzero(ranks == np.repeat(least, sizes))
            # of touching occurrences (equal symbols in a row) every second one from the left
            first = np.ones(len(hit), bool)
            first[1:] = hit[1:] != hit[:-1] + 1
            run = np.flatnonzero(first)
            place = np.arange(len(hit)) - np.repeat(run, np.diff(np.append(run, len(hit))))
            hit = hit[place % 2 == 0]
            symbols[hit] = self.made[ranks[hit]]
            keep = np.ones(len(symbols), bool)
            keep[hit + 1] = False
            owner = np.searchsorted(starts, hit, "right") - 1
            sizes = sizes - np.bincount(owner, minlength=len(names))
            starts = np.cumsum(sizes) - sizes
            new = np.cumsum(keep)[hit] - 1  # places after closing up
            symbols, ranks = symbols[keep], ranks[keep]
            touched = np.unique(np.concatenate((new, new[new > 0] - 1)))
            last = np.zeros(len(symbols), bool)
            last[starts + sizes - 1] = True
            inside = touched[~last[touched]]
            ranks[touched] = _NONE
            ranks[inside] = self._ranks(symbols[inside], symbols[inside + 1])
        return counts

    def _pieces(self, text: str) -> list[str]:
        if self.find_latin:
            try:
                text.encode("latin-1")
                return self.find_latin(text.lower())  # composed already
            except UnicodeEncodeError:
                pass
        return self.find(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def count(self, texts: list[str]) -> np.ndarray:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        totals, later, new = np.zeros(len(texts), np.int64), [], set()
        for k, text in enumerate(texts):
            pieces: list[str] = []
            if self.special and self.special_mark in text:
                parts = self.special.split(text)
                totals[k] = len(parts) - 1
                for part in parts:
                    pieces += self._pieces(part)
            else:
                pieces = self._pieces(text)
            counts = list(map(self.known.get, pieces))
            if None in counts:
                new.update(x for x, n in zip(pieces, counts, strict=True) if n is None)
                later.append((k, pieces))
            else:
                totals[k] += sum(counts)
        words = list(new)
        for at in range(0, len(words), 1 << 17):
            part = words[at : at + (1 << 17)]
            self.known.update(zip(part, self.merged_lengths([x.encode() for x in part]).tolist(), strict=True))
        for k, pieces in later:
            totals[k] += sum(map(self.known.__getitem__, pieces))
        return totals


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row.

    Null or empty text: 0 bytes and tokens. Null doc_id and repeated rows: kept as they are. No rows in: no
    rows out. Columns of any other name are ignored. Texts of any length are counted whole.
    """
    path = path or default_path()

    def counted(batches):
        counter = TokenCounter(path)
        for frame in batches:
            texts = frame["text"].fillna("").tolist()
            totals = np.zeros(len(texts), np.int64)
            sizes = np.cumsum([0, *map(len, texts)])
            at = 0
            while at < len(texts):  # about a million characters at a time
                end = max(at + 1, int(np.searchsorted(sizes, sizes[at] + (1 << 20), "right")) - 1)
                totals[at:end] = counter.count(texts[at:end])
                at = end
            yield pd.DataFrame({"doc_id": frame["doc_id"], "n_bytes": frame["n_bytes"], "n_tokens": totals})

    rows = docs.select(F.col("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInPandas(counted, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op9_tokens(spark, sf_dir: str) -> DataFrame:
    from .shared import table

    return token_counts(table(spark, sf_dir, "documents"))
