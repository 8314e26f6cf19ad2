"""Passages of evaluation items in a corpus.

The items' n-grams of normalised words form a hash set that is sent to every worker; documents are scanned window by window on arrays, a hit of
the set is verified word by word, and the words of the item that lie in common runs are counted. The scan moves no data. Items come in blocks
whose n-grams stay under a fixed number, so what is sent never grows with the items; each block scans the corpus once.

Words are runs of letters and digits; letter case, punctuation, spacing and invisible characters don't count, composed and decomposed
letters are the same. A run is n or more words that follow each other in both texts. Defined results: null and empty texts, and items of
fewer than n words, leak nothing. Repeated documents and items are reported each for itself. Matches go across paragraphs.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import columns
from .arrays import LETTER, NUMBER, character_classes, code_points, invisible_characters, pieces, strings, widths

N = 5
SHARE = 0.25
#: n-grams that are sent to the workers at once.
BLOCK_GRAMS = 2_000_000
_BREAK = "\n\x00\n"


def words_of(texts: list[str | None]) -> tuple[pa.Array, np.ndarray]:
    """The normalised words of all texts in turn, as a dictionary array, and the text of each word."""
    joined = _BREAK.join([(t or "").replace("\x00", " ") for t in texts]).casefold()
    if not joined.isascii():
        joined = unicodedata.normalize("NFC", joined)
    codes = code_points(joined)
    if not joined.isascii():
        codes = codes[~invisible_characters()[codes]]
    kind = character_classes()[codes]
    part = (kind == LETTER) | (kind == NUMBER)
    begins = part.copy()
    begins[1:] &= ~part[:-1]
    text_no = np.cumsum(codes == 0)[begins]
    kept = codes[part]
    place = np.append(np.flatnonzero(begins[part]), len(kept))
    data = kept.tobytes().decode("utf-32-le").encode()
    if len(data) != len(kept):
        place = np.concatenate(([0], np.cumsum(widths(kept))))[place]
    return strings(data, place).dictionary_encode(), text_no


@lru_cache(1)
def _second_characters() -> frozenset[str]:
    """Characters that may be composed with one before them without being combining marks."""
    found = {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}
    for c in range(0x110000):
        parts = unicodedata.decomposition(chr(c)).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            found.add(chr(int(parts[1], 16)))
    return frozenset(found)


@lru_cache(4_096)
def _joins(c: str) -> bool:
    """Whether normalisation may change the character together with the one before it."""
    first = unicodedata.normalize("NFD", c.casefold())[:1]
    return not first or unicodedata.combining(first) > 0 or first in _second_characters()


def _normalised(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points as words_of sees them, the piece of the text that each comes from, and the bounds of the pieces in the text as it is."""
    if text.isascii():
        return code_points(text.casefold()), np.arange(len(text)), np.arange(len(text) + 1)
    joining = {c for c in set(text) if _joins(c)}
    bounds = [i for i, c in enumerate(text) if i == 0 or c not in joining] + [len(text)]
    parts = [unicodedata.normalize("NFC", text[a:b].casefold()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    codes, owner = code_points("".join(parts)), np.repeat(np.arange(len(parts)), [len(x) for x in parts])
    seen = ~invisible_characters()[codes]
    return codes[seen], owner[seen], np.array(bounds)


def _hashes(windows: np.ndarray) -> np.ndarray:
    h = np.zeros(len(windows), np.uint64)
    for i in range(windows.shape[1]):
        h = (h ^ (windows[:, i].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return h


class ItemGrams:
    """The n-grams of a block of items: hashes, words, and where each stands."""

    def __init__(self, ids: list[int], texts: list[str | None], n: int):
        self.n, self.ids = n, np.array(ids, np.int64)
        coded, text_no = words_of(texts)
        self.vocabulary = {w: i for i, w in enumerate(coded.dictionary.to_pylist())}
        words = coded.indices.to_numpy()
        self.sizes = np.bincount(text_no, minlength=len(texts))
        first = np.cumsum(self.sizes) - self.sizes
        at = np.flatnonzero(text_no[n - 1 :] == text_no[: len(text_no) - n + 1]) if len(words) >= n else np.zeros(0, np.int64)
        windows = words[at[:, None] + np.arange(n)] if len(at) else np.zeros((0, n), np.int32)
        hashes = _hashes(windows)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.windows = hashes[order], windows[order]
        self.item = text_no[at][order]
        self.at = at[order] - first[self.item]
        self.set = np.unique(self.hashes)

    @cached_property
    def known(self) -> set[tuple[int, ...]]:
        return set(map(tuple, self.windows.tolist()))

    def spans(self, text: str) -> list[int]:
        """Begin and end, in the text as it is, of each n-gram that it shares with an item."""
        codes, owner, bounds = _normalised(text)
        part = np.isin(character_classes()[codes], (LETTER, NUMBER))
        edges = np.diff(np.concatenate(([0], part.astype(np.int8), [0])))
        begins, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        plain = codes.tobytes().decode("utf-32-le", "surrogatepass")
        words = [self.vocabulary.get(plain[a:b].encode("utf-8", "surrogatepass"), -1) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
        out = []
        for i in range(len(words) - self.n + 1):
            if words[i] >= 0 and tuple(words[i : i + self.n]) in self.known:
                out += [int(bounds[owner[begins[i]]]), int(bounds[owner[ends[i + self.n - 1] - 1] + 1])]
        return out

    def scan(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, item, words of the item in common runs) of every pair with a common run."""
        n = self.n
        coded, text_no = words_of(texts)
        own = np.fromiter((self.vocabulary.get(w, -1) for w in coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
        none = np.zeros(0, np.int64)
        if len(coded) < n or not len(self.set):
            return none, none, none
        words = own[coded.indices.to_numpy()]
        known = words >= 0
        run = np.concatenate(([0], np.cumsum(known)))
        at = np.flatnonzero((run[n:] - run[:-n] == n) & (text_no[n - 1 :] == text_no[: len(text_no) - n + 1]))
        windows = words[at[:, None] + np.arange(n)]
        hashes = _hashes(windows)
        slot = np.minimum(np.searchsorted(self.set, hashes), len(self.set) - 1)
        hit = self.set[slot] == hashes
        at, windows, hashes = at[hit], windows[hit], hashes[hit]
        low, high = np.searchsorted(self.hashes, hashes, "left"), np.searchsorted(self.hashes, hashes, "right")
        found, size = np.repeat(np.arange(len(at)), high - low), high - low
        gram = np.arange(len(found)) + np.repeat(low - (np.cumsum(size) - size), size)
        same = (self.windows[gram] == windows[found]).all(axis=1)
        found, gram = found[same], gram[same]
        hits = pd.DataFrame({"text": text_no[at][found], "item": self.item[gram], "at": self.at[gram]}).drop_duplicates().sort_values(["text", "item", "at"])
        if not len(hits):
            return none, none, none
        following = (hits.text.eq(hits.text.shift(-1)) & hits.item.eq(hits.item.shift(-1))).to_numpy()
        gap = hits["at"].shift(-1).fillna(0).to_numpy(np.int64) - hits["at"].to_numpy()
        hits["words"] = np.where(following, np.minimum(gap, n), n)
        total = hits.groupby(["text", "item"], as_index=False)["words"].sum()
        return total.text.to_numpy(), total.item.to_numpy(), total.words.to_numpy()


def item_blocks(items: DataFrame, n: int, most: int = BLOCK_GRAMS) -> Iterator[ItemGrams]:
    """Items come to the driver partition by partition, and leave it in blocks of at most about `most` n-grams."""
    ids, texts, size = [], [], 0
    for r in columns(items, "item_id", "text").toLocalIterator():
        if r.item_id is None or not r.text:
            continue
        if ids and size + len(r.text) // 2 > most * 5:
            yield ItemGrams(ids, texts, n)
            ids, texts, size = [], [], 0
        ids.append(r.item_id)
        texts.append(r.text)
        size += len(r.text)
    if ids:
        yield ItemGrams(ids, texts, n)


def find_leaks(docs: DataFrame, items: DataFrame, share: float = SHARE, n: int = N, most: int = BLOCK_GRAMS) -> DataFrame:
    """(doc_id, item_id, words, item_words) of the documents that hold at least `share` of an item's words."""
    schema = "doc_id bigint, item_id bigint, words bigint, item_words bigint"
    cols = columns(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("bigint"))
    found = docs.sparkSession.createDataFrame([], schema)
    for number, grams in enumerate(item_blocks(items, n, most)):
        sent = docs.sparkSession.sparkContext.broadcast(grams)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            g = sent.value
            for batch in batches:
                texts = batch.column(1).to_pylist()
                for a, b in pieces(texts):
                    text, item, words = g.scan(texts[a:b])
                    enough = words >= share * g.sizes[item] - 1e-9
                    text, item, words = text[enough], item[enough], words[enough]
                    yield pa.record_batch([batch.column(0).take(pa.array(text + a)), pa.array(g.ids[item]), pa.array(words, pa.int64()), pa.array(g.sizes[item], pa.int64())], names=["doc_id", "item_id", "words", "item_words"])

        part = cols.mapInArrow(run, schema)
        found = part if number == 0 else found.unionAll(part)
    return found


def without_documents(docs: DataFrame, leaks: DataFrame) -> DataFrame:
    """docs without those that leak an item."""
    return docs.join(leaks.select("doc_id").distinct(), "doc_id", "left_anti")


def without_spans(docs: DataFrame, items: DataFrame, n: int = N, most: int = BLOCK_GRAMS) -> DataFrame:
    """docs with every run of n or more words shared with an item cut out of the text; other columns stay.

    The words are those of find_leaks, mapped back to the text as it is. Items of all blocks are looked for in the whole text before anything is cut."""
    spans = [_finder(docs.sparkSession.sparkContext.broadcast(grams))(F.col("text")) for grams in item_blocks(items, n, most)]
    return docs.withColumn("text", _cutter()(F.col("text"), F.concat(*spans))) if spans else docs


def _finder(sent):
    @F.pandas_udf("array<int>")
    def find(texts: pd.Series) -> pd.Series:
        g, values = sent.value, [t if isinstance(t, str) else None for t in texts]
        out = [[] for _ in values]
        for a, b in pieces(values):
            for i in np.unique(g.scan(values[a:b])[0]).tolist():
                out[a + i] = g.spans(values[a + i])
        return pd.Series(out, index=texts.index, dtype=object)

    return find


def _cutter():
    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([_without(t, s) if isinstance(t, str) else None for t, s in zip(texts, spans, strict=True)], index=texts.index, dtype=object)

    return cut


def _without(text: str, spans) -> str:
    out, at = [], 0
    for a, b in sorted(np.reshape(spans, (-1, 2)).tolist()):
        if a > at:
            out.append(text[at:a])
        at = max(at, b)
    return "".join([*out, text[at:]])
