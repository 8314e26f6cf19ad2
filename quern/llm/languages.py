"""Language of documents and of paragraphs in another language, by compression.

For each language a raw-content dictionary for zstandard is filled with texts of that language; a text belongs to the language whose dictionary compresses it to
the fewest bytes. A result whose lead over the second is narrow is rejected. Confidence is that lead: 1 - smallest / second smallest size. As zstandard learns from
the text itself, so that a dictionary only helps at its start, texts are compressed in consecutive pieces, all of them, each for itself; sizes are their sums.

The dictionaries come from a bounded sample (SAMPLE documents of each label, chosen by a hash of their key from the whole table). As labels may be wrong, the sample is cleaned first: of each label, texts that the others compress far worse than usual leave. Labels are taken from the most frequent (over all
documents) on; one whose held-out texts its own dictionary compresses hardly better than those before it, or one of those as well as its own texts, is another name for it, or a mixture, and none of the languages. Then half of the sample judges the other
half and the reverse: documents that aren't judged to be of their label leave, then paragraphs in another language, then labels most of whose documents
left, until nothing changes. Only
languages whose texts take a similar number of bytes per character are tried for a text, which tells scripts apart; where fewer than two do, the
dictionary must compress the text surely better than none does, else the text is of no known language.

Defined results: segment 0 is the document (the language of most of its characters, over its running text; if none of that is judged surely, of all its words together, with a confidence of MARGIN at most), segment k its k-th paragraph of running text in another language, counted from 1 over the parts between
empty lines. Texts without words (null, empty, blank, only formulas) or with a single one, which may be a name, have no language and no rows, nor have those in a script of no known language.
A < or $ that begins no tag and no formula is text. Repeated documents are judged each for itself. Without any labelled text there are no languages and no rows.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from ..sources.tables import columns

#: Documents of each label that the dictionaries are made from, and characters taken of each of them.
SAMPLE, SAMPLE_CHARACTERS = 60, 6_000
#: Texts of more characters are sampled first.
LONG = 200
#: Bytes of a dictionary, and characters of the pieces it is made of.
DICTIONARY, PART = 16_384, 300
LEVEL = 1
#: Most characters that are compressed at once; longer texts are cut into equal pieces.
PIECE = 2_000
#: Least lead over the second language, as a share and in bytes, and least letters (or half as many ideographs) and words of running text.
MARGIN, MARGIN_BYTES, LETTERS, WORDS = 0.03, 6, 24, 5
#: A label's held-out texts must be this much smaller by its own dictionary than by those of more frequent labels; and by these that many
#: times larger than those labels' own held-out texts, unless the lead is sure and doesn't come from a few texts that may be copies.
LEAD, LIKENESS, SURE, FEW = 0.05, 1.15, 0.3, 6
#: Texts of a label's sample that are left so many times larger than usual are strange to it.
STRANGE = 1.3
#: A text is a copy of another if that one as a dictionary leaves less than this share of what no dictionary leaves.
COPY = 0.5
#: Bytes per character may differ by this factor at most.
SCRIPT = 1.45

_EMPTY_LINES = re.compile(r"\n(?:[^\S\n]*\n)+")
#: Tags (a name follows the <, attributes have values; the last > may be lost), placeholders of formulas, commands and names with an index.
_MARKUP = re.compile(r"""</?[A-Za-z][\w:.-]*(?:\s+[\w:.-]+\s*=\s*(?:"[^"<>]*"|'[^'<>]*'))*\s*/?>?|<!--.*?-->|\[\[[\w-]*\]\]|\\[a-zA-Z]+|[a-zA-Z]_\{?\w*\}?""", re.DOTALL)
#: What stands between dollars, or behind two that nothing closes; removed if it has the shape of a formula.
_DOLLARS = re.compile(r"\$\$([^$]*)(?:\$\$|\Z)|\$([^$\n]*)\$")
_FORMULA_WORD = re.compile(r"(?<![\\A-Za-z])[^\W\d_]{3,}")
_WORD = re.compile(r"[^\W\d_]{2,}")
_IDEOGRAPH = re.compile(r"[぀-ヿ㐀-鿿가-힯]")


def label_language(c: Column) -> Column:
    """Two-letter language of a label: trimmed, lower-cased, cut at - or _; null if it is none."""
    low = F.regexp_extract(F.lower(strip(c)), r"^([^-_]*)", 1)
    return F.when(low.rlike("^[a-z]{2}$"), low)


def _without_formula(m: re.Match) -> str:
    """A blank for a formula: its words, if any, are less than half of it and it has signs of formulas. All else stays."""
    inner = m[1] if m[1] is not None else m[2]
    letters = sum(map(len, _FORMULA_WORD.findall(inner)))
    return " " if not letters or letters * 2 < len(inner) and any(c in inner for c in "\\^_{}=") else m[0]


def without_markup(text: str) -> str:
    if "$" in text:
        text = _DOLLARS.sub(_without_formula, text)
    return _MARKUP.sub(" ", text) if any(c in text for c in "<[\\_") else text


def running_text(paragraph: str) -> str | None:
    """The paragraph without markup and formulas if it is running text, else none."""
    text = without_markup(paragraph)
    if len(text) < LETTERS // 2:
        return None
    words = _WORD.findall(text)
    letters = sum(map(len, words))
    if not text.isascii() and (wide := len(_IDEOGRAPH.findall(text))) * 2 > letters:
        return text if wide >= LETTERS // 2 else None
    return text if letters >= LETTERS and len(words) >= WORDS and letters * 2 >= len(text.strip()) else None


def cut(text: str) -> list[bytes]:
    """The whole text in consecutive pieces of at most PIECE characters, and of half as many at least if there are several."""
    if len(text) <= PIECE:
        return [text.encode()]
    step = -(-len(text) // -(-len(text) // PIECE))
    return [text[a : a + step].encode() for a in range(0, len(text), step)]


class Languages:
    """Compressors by language."""

    def __init__(self, contents: dict[str, bytes]):
        import zstandard

        self.contents, self.compressors, self.ratio = contents, {}, {}
        for language, content in sorted(contents.items()):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.compressors[language] = zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
            text = content.decode("utf-8", "ignore")
            self.ratio[language] = len(content) / max(1, len(text))
        self.plain = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False)
        self._of_ratio: dict[int, list] = {}

    def tried(self, ratio: float) -> list:
        """The languages of texts with that many bytes a character. Where there are no two of them to be compared, no dictionary at all ("") is tried too: one that doesn't help
        is of another language."""
        key = round(ratio * 20)
        if key not in self._of_ratio:
            near = [(x, self.compressors[x]) for x, r in self.ratio.items() if _near(r, key / 20)]
            self._of_ratio[key] = near if len(near) > 1 else [*(near or self.compressors.items()), ("", self.plain)]
        return self._of_ratio[key]

    def _sizes(self, text: str) -> list[tuple[int, str]]:
        parts = cut(text)
        return sorted((sum([len(c.compress(data)) for data in parts]), x) for x, c in self.tried(sum(map(len, parts)) / len(text)))

    def judge(self, text: str) -> tuple[str, float] | None:
        """(language, confidence) of running text; confidence 0 if the lead is narrow."""
        sizes = self._sizes(text)
        if not sizes[0][1]:
            return None
        lead = sizes[1][0] - sizes[0][0]
        return sizes[0][1], lead / sizes[1][0] if lead >= max(MARGIN_BYTES, MARGIN * sizes[1][0]) else 0.0

    def segments(self, text: str | None) -> list[tuple[int, str, float]]:
        """(segment, language, confidence): the document, then its paragraphs in another language. Without a sure paragraph the document is judged by all its words together."""
        if not text:
            return []
        return self.sure_segments(text) or self._by_words(text)

    def _by_words(self, text: str) -> list[tuple[int, str, float]]:
        words = _WORD.findall(without_markup(text))
        joined = " ".join(words)
        if max(len(words), len(_IDEOGRAPH.findall(joined))) < 2:
            return []
        sizes = self._sizes(joined)
        if any(not x for _, x in sizes):  # the lead over no dictionary must be sure: else any unknown language would be the nearest known one
            sizes = sizes if (found := self.judge(joined)) and found[1] else []
        return [(0, sizes[0][1], min(1 - sizes[0][0] / sizes[1][0], MARGIN))] if sizes else []

    def sure_segments(self, text: str) -> list[tuple[int, str, float]]:
        """As segments, by paragraphs of running text with a sure lead only."""
        judged, weight, sure = [], Counter(), defaultdict(float)
        for k, paragraph in enumerate(_EMPTY_LINES.split(text), 1):
            if (running := running_text(paragraph)) and (found := self.judge(running)):
                language, confidence = found
                if confidence:
                    judged.append((k, language, confidence))
                    weight[language] += len(paragraph)
                    sure[language] += confidence * len(paragraph)
        if not weight:
            return []
        main = min(weight, key=lambda x: (-weight[x], x))
        return [(0, main, sure[main] / sum(weight.values())), *(s for s in judged if s[1] != main)]


def dictionary_of(texts: list[str]) -> bytes:
    """Pieces of running text from all parts of all the texts, in the order of their hashes, up to the dictionary's size."""
    found = {}
    for t in texts:
        for paragraph in _EMPTY_LINES.split(t):
            if running := running_text(paragraph):
                for a in range(0, len(running), PART):
                    found[running[a : a + PART].encode()] = None
    out, size = [], 0
    for data in sorted(found, key=lambda x: (zlib.crc32(x), x)):
        if size >= DICTIONARY:
            break
        out.append(data)
        size += len(data) + 1
    return b"\n".join(out)[:DICTIONARY]


def _best(languages: Languages, text: str) -> tuple[int, str]:
    """Bytes of the text's running paragraphs by the dictionary that compresses them best together, and its language."""
    parts = [data for p in _EMPTY_LINES.split(text) if (r := running_text(p)) for data in cut(r)]
    return min((sum(len(c.compress(data)) for data in parts), x) for x, c in languages.compressors.items())


def _size(text: str) -> int:
    return sum(len(r.encode()) for p in _EMPTY_LINES.split(text) if (r := running_text(p)))


def _median(values: list[float]) -> float:
    return sorted(values)[len(values) // 2]


def _near(a: float, b: float) -> bool:
    return max(a, b) <= SCRIPT * min(a, b)


def _distinct(texts: list[str]) -> list[str]:
    """The texts without copies and near-copies of ones before them: two copies under a wrong label would vouch for each other."""
    kept: list[Languages] = []
    out = []
    for t in texts:
        parts = [data for p in _EMPTY_LINES.split(t) if (r := running_text(p)) for data in cut(r)]
        own = "\n".join(data.decode() for data in parts).encode()
        plain = sum(len(Languages({}).plain.compress(data)) for data in parts)
        if all(sum(len(k.compressors[""].compress(data)) for data in parts) >= COPY * plain for k in kept):
            kept.append(Languages({"": own}))
            out.append(t)
    return out


def _alike(texts: list[str]) -> list[str]:
    """The texts without those that the other half's dictionary compresses far worse than it usually does."""
    if len(texts) < 4:
        return texts
    halves = [Languages({"": dictionary_of(texts[h::2])}) for h in (0, 1)]
    left = [_best(halves[1 - i % 2], t)[0] / _size(t) for i, t in enumerate(texts)]
    return [t for t, x in zip(texts, left, strict=True) if x <= STRANGE * _median(left)]


def _halves(text: str) -> tuple[list[str], list[str]]:
    """Every other paragraph of a text's running text, and the rest; a single paragraph is cut into pieces of PART characters or half of it. The whole and nothing if there is no second half."""
    parts = [r for p in _EMPTY_LINES.split(text) if (r := running_text(p))]
    if len(parts) == 1:
        size = min(PART, -(-len(parts[0]) // 2))
        parts = [r for a in range(0, len(parts[0]), size) if (r := running_text(parts[0][a : a + size]))]
    return (["\n\n".join(parts[0::2])], ["\n\n".join(parts[1::2])]) if len(parts) > 1 else ([text], [])


def _own_part(languages: Languages, text: str, language: str) -> str | None:
    """The text without its paragraphs in other languages; none if the language isn't the text's."""
    found = languages.sure_segments(text)
    if not found or found[0][1] != language:
        return None
    foreign = {k for k, _, _ in found[1:]}
    return "\n\n".join([p for k, p in enumerate(_EMPTY_LINES.split(text), 1) if k not in foreign]) if foreign else text


def fit(samples: dict[str, list[str]], counts: dict[str, int] | None = None) -> Languages:
    """Languages of labelled texts of which some have a wrong label; counts: documents of each label."""
    kept = {x: [t for t in texts if any(map(running_text, _EMPTY_LINES.split(t)))] for x, texts in samples.items()}
    kept = {x: _alike(_distinct(t)) for x, t in kept.items() if t}
    counts = counts or {x: len(t) for x, t in kept.items()}
    own: dict[str, bytes] = {}
    usual: dict[str, float] = {}  # share that is left of held-out texts of a language by its dictionary
    for x in sorted(kept, key=lambda x: (-counts.get(x, 0), x)):  # a label that is another name of one before it, or a mixture, is none
        first, held = (kept[x][0::2], kept[x][1::2]) if len(kept[x]) > 1 else _halves(kept[x][0])
        content = dictionary_of(first)
        if own:
            mine, others = Languages({x: content}), Languages(own)
            leads, likeness = [], []
            for t in held:
                size, best = _best(others, t)
                leads.append(1 - _best(mine, t)[0] / size)
                likeness.append(size / _size(t) / usual[best])
            if not held or (lead := _median(leads)) < LEAD or _median(likeness) < LIKENESS and (lead < SURE or len(kept[x]) < FEW):
                continue
        own[x] = content
        usual[x] = _median([_best(Languages({x: content}), t)[0] / _size(t) for t in held or kept[x]])
    kept = {x: kept[x] for x in own}
    for _ in range(8):
        halves = [Languages({x: c for x, texts in kept.items() if (c := dictionary_of(texts[h::2] or texts))}) for h in (0, 1)]
        left = {}
        for x, texts in kept.items():
            good = [own for i, t in enumerate(texts) if (own := _own_part(halves[1 - i % 2], t, x))]
            if len(good) * 2 > len(texts):
                left[x] = good
        if left == kept:
            break
        kept = left
    return Languages({x: c for x, texts in kept.items() if (c := dictionary_of(texts))})


def sample(docs: DataFrame, each: int = SAMPLE) -> tuple[dict[str, list[str]], dict[str, int]]:
    """Texts of `each` documents at most per two-letter label (so of at most 676 labels), the least by a hash of the key; and the number of documents of each label.
    Labels are counted first, without reading texts; so one more scan finds the keys of the least hashes, with some to spare, together with their texts. Texts of LONG
    characters or fewer are taken after longer ones."""
    docs = columns(docs, "doc_id", "lang", "text")
    labelled = docs.select("doc_id", label_language(F.col("lang")).alias("language"), "text").where("language is not null and doc_id is not null")
    counts = {r.language: r["count"] for r in labelled.groupBy("language").count().collect()}
    if not counts:
        return {}, {}
    spare = each + 8 * math.isqrt(each) + 20  # that fewer than `each` are found among so many expected has a chance of 1e-14
    below = F.create_map(*(F.lit(x) for language, n in counts.items() for x in (language, math.ceil(min(1.0, spare / n) * (1 << 62)))))
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 2)
    near = labelled.where((place <= F.element_at(below, F.col("language"))) & (F.length("text") > 0))
    order = Window.partitionBy("language").orderBy((F.length("text") <= LONG), place, "doc_id", "text")
    chosen = near.withColumn("text", F.substring("text", 1, SAMPLE_CHARACTERS)).withColumn("place", F.row_number().over(order)).where(F.col("place") <= each)
    out: dict[str, list[str]] = {}
    seen = set()
    rows = chosen.select("language", "doc_id", "text").collect()
    long = {r.language for r in rows if len(r.text) > LONG}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.text)):
        if r.doc_id not in seen and (len(r.text) > LONG or r.language not in long):
            seen.add(r.doc_id)
            out.setdefault(r.language, []).append(r.text)
    return out, counts


def identify(docs: DataFrame, languages: Languages | None = None) -> DataFrame:
    """(doc_id, label, segment, lang, confidence); label is the document's as it is."""
    contents, made = (languages or fit(*sample(docs))).contents, []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            made.append(Languages(contents))
        for batch in batches:
            rows, out = [], ([], [], [])
            for i, text in enumerate(batch.column(2).to_pylist()):
                for found in made[0].segments(text):
                    rows.append(i)
                    for column, x in zip(out, found, strict=True):
                        column.append(x)
            at = pa.array(rows, pa.int64())
            yield pa.record_batch([batch.column(0).take(at), batch.column(1).take(at), pa.array(out[0], pa.int32()), pa.array(out[1], pa.string()), pa.array(out[2], pa.float64())], names=["doc_id", "label", "segment", "lang", "confidence"])

    cols = columns(docs, "doc_id", "lang", "text").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").alias("label"), "text")
    return cols.mapInArrow(run, "doc_id bigint, label string, segment int, lang string, confidence double")

