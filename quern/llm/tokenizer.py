"""Encoding of texts with a public byte-level BPE vocabulary, and decoding.

Texts are first split by the vocabulary's pattern; the split is computed on arrays of character classes for a whole batch
(one pass, no pattern matching per word). Each distinct pretoken is then encoded by a streaming transducer and looked up
by all its occurrences.

The transducer reads bytes from left to right. Each prefix of a pretoken has exactly one encoding, and its last token is
the one token that ends there, encodes itself and stands beside the encoding of what precedes it unchanged (such pairs
are judged by the merges along the inner edges of the two tokens). A future token reaches back at most `reach` bytes, the longest token's length; so
only the encodings of the last `reach` prefixes can still be continued, and what all of them begin with is stable and is emitted. The
merge list's sufficient lookahead, computed with the list, bounds how far the encodings that remain can differ: what lies further back is emitted
at once, so memory stays constant however long a pretoken is. Decoding is an incremental UTF-8 state machine over the tokens' bytes.

Defined results: null and empty texts have no ids (an empty list). Special tokens in a text are ordinary text. Repeated documents
are encoded each for itself. Ids decode to the text exactly; ids that end inside a character, or bytes that aren't
UTF-8, decode to U+FFFD; ids outside the vocabulary raise an error.
"""

from __future__ import annotations

import base64
import codecs
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..sources.tables import columns
from .arrays import LETTER, PIECE, SPACE, character_classes, code_points, pieces, ragged, strings, widths

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Encoded pretokens that a worker keeps; beyond that it starts afresh.
CACHE = 400_000


def read_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    """Bytes of each token and its id, which is also the rank of its merge."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}


class Merges:
    """What the merge list says of single tokens and of pairs."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.reach = max(map(len, ranks))
        self.lookahead = self.sufficient_lookahead()
        self.ending: dict[bytes, int] = {}  # longest token by its last two bytes
        for b in ranks:
            end = b[-2:]
            self.ending[end] = max(self.ending.get(end, 1), len(b))
        self._fits: dict[tuple[int, int], bool] = {}
        self._edges: dict[int, tuple[list, list]] = {}
        self._whole: dict[int, bool] = {}

    def sufficient_lookahead(self) -> int:
        """Bytes after which the tokens before them can't change any more: at most one token of greatest length for
        each merge, since each merge that a suffix sets off further left has a greater rank than the one before it."""
        return (len(self.ranks) - 256) * self.reach

    def plain(self, data: bytes, below: int | None = None) -> list[int]:
        """Encoding by applying merges of rank less than `below`, least first; only for single tokens."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60 or below is not None and rank >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def whole(self, token: int) -> bool:
        """Whether the token is the encoding of its own bytes."""
        if token not in self._whole:
            self._whole[token] = self.plain(self.bytes_of[token]) == [token]
        return self._whole[token]

    def edges(self, token: int) -> tuple[list[tuple[bytes, int]], list[tuple[bytes, int]]]:
        """The subtokens along the left and the right edge, each with the rank of the merge that ends it."""
        if token not in self._edges:
            left, right = [(self.bytes_of[token], 1 << 60)], [(self.bytes_of[token], 1 << 60)]
            parts = self.plain(self.bytes_of[token], token) if len(self.bytes_of[token]) > 1 else []
            if len(parts) == 2:
                left += [(b, min(r, token)) for b, r in self.edges(parts[0])[0]]
                right += [(b, min(r, token)) for b, r in self.edges(parts[1])[1]]
            self._edges[token] = left, right
        return self._edges[token]

    def fits(self, a: int, b: int) -> bool:
        """Whether a and b side by side stay as they are: no merge across their border comes before the merges
        that use up the two subtokens it would take (of equal merges the left one comes first)."""
        known = self._fits.get((a, b))
        if known is None:
            get = self.ranks.get
            known = True
            right, left = self.edges(a)[1], self.edges(b)[0]
            for x, end_x in right:
                for y, end_y in left:
                    rank = get(x + y)
                    if rank is not None and rank < end_x and rank <= end_y:
                        known = False
                        break
                if not known:
                    break
            if len(self._fits) > 2_000_000:
                self._fits.clear()
            self._fits[a, b] = known
        return known


class Transducer:
    """Streaming encoder of one pretoken: feed() bytes, get the tokens that became stable; finish() gives the rest."""

    def __init__(self, merges: Merges):
        self.m = merges
        self.data, self.last = b"", [-1]  # bytes after what was emitted; last token of each prefix
        self.previous = -1  # the last emitted token
        self.most = 0

    def feed(self, data: bytes) -> list[int]:
        out: list[int] = []
        step = 4 * self.m.reach
        for at in range(0, len(data), step):
            self._extend(data[at : at + step])
            if len(self.data) > step:
                out += self._stable()
        return out

    def finish(self) -> list[int]:
        out = self._path(len(self.data))
        self.data, self.last, self.previous = b"", [-1], -1
        return out

    def _extend(self, more: bytes) -> None:
        begin = len(self.data)
        data = self.data = self.data + more
        last, ranks, ending, fits, whole = self.last, self.m.ranks, self.m.ending, self.m.fits, self.m.whole
        for i in range(begin + 1, len(data) + 1):
            longest = ending.get(data[i - 2 : i], 1) if i > 1 else 1
            if i == 1 and self.previous < 0:
                longest = 1
            for n in range(min(i, longest), 0, -1):
                token = ranks.get(data[i - n : i])
                if token is not None:
                    before = last[i - n] if n < i else self.previous
                    if whole(token) and (before < 0 or fits(before, token)):
                        last.append(token)
                        break
            else:
                raise ValueError(f"no token ends at byte {data[i - 1]!r}: the vocabulary lacks single bytes")

    def _path(self, end: int) -> list[int]:
        out = []
        while end > 0:
            out.append(self.last[end])
            end -= len(self.m.bytes_of[self.last[end]])
        return out[::-1]

    def _stable(self) -> list[int]:
        """What the encodings of all prefixes that can still be continued have in common is emitted."""
        live = set(range(max(0, len(self.data) - self.m.reach + 1), len(self.data) + 1))
        while len(live) > 1:
            last = max(live)
            live.discard(last)
            live.add(last - len(self.m.bytes_of[self.last[last]]))
        cut = live.pop()
        if not cut and len(self.data) > self.m.lookahead:  # the paths still differ, but what lies further back than this is the same in all continuations
            for token in self._path(len(self.data)):
                if (end := cut + len(self.m.bytes_of[token])) > len(self.data) - self.m.lookahead:
                    break
                cut = end
        self.most = max(self.most, len(self.data) - cut)
        if not cut:
            return []
        out = self._path(cut)
        self.previous, self.data, self.last = out[-1], self.data[cut:], [-1, *self.last[cut + 1 :]]
        return out


class StreamDecoder:
    """Incremental decoding: feed() ids, get the text that is complete; finish() ends it."""

    def __init__(self, bytes_of: dict[int, bytes]):
        self.bytes_of = bytes_of
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids) -> str:
        return self.machine.decode(b"".join([self.bytes_of[i] for i in ids]))

    def finish(self) -> str:
        return self.machine.decode(b"", True)


def pretoken_starts(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where pretokens start. codes: code points of several texts one after the other; first: whether a text starts there.

    The rules of the vocabulary's pattern: runs of letters, numbers or other characters, each with one space before it; of a run of
    white space before something else the last character stands apart; the endings after an apostrophe stand alone."""
    n = len(codes)
    kind = character_classes()[codes]
    space = kind == SPACE
    start = np.ones(n, bool)
    if n > 1:
        same = (kind[1:] == kind[:-1]) & ~first[1:]
        joined = (codes[:-1] == 32) & ~first[1:] & ~space[1:]
        start[1:] = ~(same | joined)
        last_of_run = space[:-1] & ~space[1:] & ~first[1:]
        start[:-1] |= last_of_run
    marks = np.flatnonzero((codes == 39) & start)
    if len(marks):
        text_end = np.append(np.flatnonzero(first)[1:], n)
        end = text_end[np.cumsum(first)[marks] - 1]
        at = lambda k: np.where(marks + k < end, codes[np.minimum(marks + k, n - 1)], 0)
        one, two = at(1), at(2)
        single = np.isin(one, [ord(c) for c in "stmd"])
        double = np.zeros(len(marks), bool)
        for a, b in ("re", "ve", "ll"):
            double |= (one == ord(a)) & (two == ord(b))
        for hit, size in ((marks[single], 2), (marks[double], 3)):
            start[hit + 1] = False
            after = hit + size
            after = after[after < n]
            start[after[kind[after] == LETTER]] = True
    return start | first


class Encoder:
    """Encodes lists of texts into one array of ids and the number of ids of each."""

    def __init__(self, ranks: dict[bytes, int]):
        self.merges = Merges(ranks)
        self.known: dict[bytes, list[int]] = {}

    def pretoken(self, data: bytes) -> list[int]:
        t = Transducer(self.merges)
        return t.feed(data) + t.finish()

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        counts, parts = np.zeros(len(texts), np.int64), []
        for a, b in pieces(texts):
            n, ids = self._some([t or "" for t in texts[a:b]])
            counts[a:b] = n
            parts += ids
        return (np.concatenate(parts) if parts else np.zeros(0, np.int32)), counts

    def _some(self, texts: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
        if len(texts) == 1 and len(texts[0]) > PIECE:  # one long text, in parts
            ids = [self._ids(*x) for x in self._cut(texts[0])]
            return np.array([sum(len(x) for x, _ in ids)]), [x for x, _ in ids]
        ids, counts = self._ids("".join(texts), np.fromiter(map(len, texts), np.int64, len(texts)))
        return counts, [ids]

    def _cut(self, text: str) -> Iterator[tuple[str, np.ndarray]]:
        """Parts of a long text, cut where a run of letters or numbers ends: a pretoken always starts there, and nothing that follows changes those before it."""
        import regex

        begin, border = 0, regex.compile(r"(?<=\p{L})(?=\P{L})|(?<=\p{N})(?=\P{N})")
        while begin < len(text):
            m = border.search(text, begin + PIECE) if begin + PIECE < len(text) else None
            end = m.start() if m else len(text)
            yield text[begin:end], np.array([end - begin])
            begin = end

    def _ids(self, joined: str, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not joined:
            return np.zeros(0, np.int32), np.zeros(len(sizes), np.int64)
        codes, data = code_points(joined), joined.encode()
        ends = np.cumsum(sizes)
        first = np.zeros(len(codes) + 1, bool)
        first[ends - sizes] = True
        first = first[:-1]
        starts = np.flatnonzero(pretoken_starts(codes, first))
        place = np.append(starts, len(codes))
        if len(data) != len(codes):
            place = np.concatenate(([0], np.cumsum(widths(codes))))[place]
        coded = strings(data, place).dictionary_encode()
        if len(self.known) > CACHE:
            self.known.clear()
        tokens = []
        for word in coded.dictionary.to_pylist():
            ids = self.known.get(word)
            if ids is None:
                ids = self.known[word] = self.pretoken(word)
            tokens.append(ids)
        lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        flat = np.fromiter((i for ids in tokens for i in ids), np.int32, int(lengths.sum()))
        which = coded.indices.to_numpy()
        n = lengths[which]
        ids = flat[ragged((np.cumsum(lengths) - lengths)[which], n)]
        upto = np.concatenate(([0], np.cumsum(n)))[np.searchsorted(starts, np.concatenate(([0], ends)))]
        return ids, np.diff(upto)




def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids array<int>). The vocabulary is read here and travels with the function; its size is that of the file."""
    ranks, made = read_ranks(path), []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            made.append(Encoder(ranks))
        for batch in batches:
            ids, counts = made[0](batch.column(1).to_pylist())
            offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
            yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))], names=["doc_id", "ids"])

    named = columns(docs, key, text).toDF("doc_id", "text")
    return named.withColumn("doc_id", named["doc_id"].cast("bigint")).mapInArrow(run, "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null ids give null."""
    bytes_of = {i: b for b, i in read_ranks(path).items()}

    def text_of(ids) -> str | None:
        if ids is None:
            return None
        machine = StreamDecoder(bytes_of)
        return "".join([machine.feed(ids[i : i + 65_536]) for i in range(0, len(ids), 65_536)]) + machine.finish()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([text_of(x) for x in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return columns(encoded, "doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")
