"""Problem 3: language of pages and of their segments by compression.

For each language a zstandard raw-content dictionary is made of its clean reference passages. A sentence or line
belongs to the language whose dictionary makes it smallest; where the second smallest is nearly as small the answer
is rejected. Only languages of the segment's own script (letters of the passages) compete.

A page's segments are runs of lines of one language; its own language is the one with most full sentences of the
main body (lines that the main-body model keeps, without code, data and links). Confidence is the margin between
the two smallest sizes, averaged over the sentences by length.

Defined cases: null and blank contents and records of the residue and spam operators have no rows; segments that are
too short or rejected have no language; labels are compared as languages (regions, scripts, three-letter codes and
names are understood); a label of a language without passages contradicts every found language.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import residue
from .common import scrapes
from .mainbody import Model, fit, fit_to, prepare, unpacked

#: Bounds of the reference passages: rows read, and bytes of a language's dictionary, which is made of whole passages.
PASSAGES = 5000
DICTIONARY = 1 << 16
#: Compression level: the fast one tells languages as well as level 3 (the same rows for all records of the test table).
LEVEL = -1
#: Least margin between the two smallest sizes, as a share of the second.
MARGIN = 0.04
#: Full sentences that make a language one of the page's.
SENTENCES = 2

# Names and codes of the languages of the corpus (fixed values): ISO 639-1, 639-2/T, 639-2/B, English and own names.
NAMES = {
    "en": "en eng english",
    "de": "de deu ger german deutsch",
    "fr": "fr fra fre french français francais",
    "es": "es spa spanish español espanol castellano castilian",
    "pt": "pt por portuguese português portugues",
    "it": "it ita italian italiano",
    "nl": "nl nld dut dutch nederlands flemish vlaams",
    "sv": "sv swe swedish svenska",
    "pl": "pl pol polish polski",
    "ru": "ru rus russian русский",
    "zh": "zh zho chi chinese 中文 汉语 漢語 cmn mandarin",
    "ja": "ja jpn japanese 日本語",
}
UNKNOWN = frozenset("unknown und undefined undetermined none null nil n/a na nan unk mul mis zxx other auto ? - -- ?? xx unbekannt inconnu desconocido unspecified not-known".split())
_LABELS = {name: code for code, names in NAMES.items() for name in names.split()}

_LETTER = re.compile(r"[^\W\d_]")
_CYRILLIC = re.compile(r"[Ѐ-ԯ]")
_CJK = re.compile(r"[぀-ヿ㐀-鿿가-힯]")
_OTHER_SCRIPT = re.compile(r"[Ѐ-ԯ぀-ヿ㐀-鿿가-힯]")
_LINK = re.compile(r"!?\[([^\]]*)\]\([^)\s]*\)|https?://\S+")
_CODE = re.compile(r"`[^`\n]*`")
_MARKS = re.compile(r"^(?:[\s>#*_+\-•|]+|\d{1,3}[.)]\s+)+")
# one set of first characters: the search skips to them
_SPLIT = re.compile(r"[.!?…。！？](?:(?<=[.!?…])[\"'”’»)*_]*\s+|(?<=[。！？])[」』”’）]*\s*)")


def label_language(label: str | None) -> str | None:
    """The language a label names: a code of :data:`NAMES`, ``""`` if it says nothing, another name as it is."""
    s = (label or "").strip().lower()
    if not s or s in UNKNOWN or not _LETTER.search(s):
        return ""
    if s in _LABELS:
        return _LABELS[s]
    first = re.split(r"[-_ (,;/]", s)[0]
    return _LABELS.get(first, first)


def script(text: str) -> str:
    """The script most of the text's letters are of: latin (and others), cyrillic or cjk."""
    if text.isascii():
        return "latin"
    if not _OTHER_SCRIPT.search(text):
        return "latin"
    letters = len(_LETTER.findall(text))
    if len(_CJK.findall(text)) * 3 > letters:
        return "cjk"
    cyrillic = len(_CYRILLIC.findall(text))
    return "cyrillic" if cyrillic * 2 > letters else "latin"


class Languages:
    """Compressors with one raw-content dictionary per language, grouped by script."""

    def __init__(self, passages: dict[str, str], level: int = LEVEL):
        self.passages, self.level = passages, level
        self.groups: dict[str, list] = {}

    def _group(self, name: str) -> list:
        if not self.groups:
            import zstandard as z

            for lang, text in sorted(self.passages.items()):
                d = z.ZstdCompressionDict(text.lower().encode("utf-8"), dict_type=z.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=self.level)
                c = z.ZstdCompressor(dict_data=d, level=self.level, write_checksum=False, write_content_size=False, write_dict_id=False)
                self.groups.setdefault(script(text), []).append((lang, c))
        return self.groups.get(name, [])

    def __getstate__(self):
        return {"passages": self.passages, "level": self.level, "groups": {}}

    def classify(self, text: str, latin: bool = False) -> tuple[str | None, float]:
        """(language, margin) of a text; no language if the margin is narrow or no passage is of its script. ``latin``: its
        script is known to be that."""
        group = self._group("latin" if latin else script(text))
        data = text.lower().encode("utf-8", "replace")
        if not group or len(data) < 12:
            return None, 0.0
        if len(group) == 1:
            # nothing competes: the text must at least be helped by the passages
            size = len(group[0][1].compress(data))
            margin = max(0.0, 1 - size / (0.95 * len(data)))
            return (group[0][0] if margin >= MARGIN else None), margin
        sizes = [len(c.compress(data)) for _, c in group]
        low = min(sizes)
        at = sizes.index(low)
        best = group[at][0]
        del sizes[at]
        second = min(sizes)
        margin = (second - low) / second
        return (best if margin >= MARGIN else None), margin

    def classify_all(self, texts: list[str]) -> list[tuple[str | None, float]]:
        """``classify`` of many texts, one language after the other: each compressor takes all of them in one call."""
        out: list[tuple[str | None, float]] = [(None, 0.0)] * len(texts)
        of_script: dict[str, list[int]] = defaultdict(list)
        for k, text in enumerate(texts):
            of_script[script(text)].append(k)
        for name, places in of_script.items():
            group = self._group(name)
            if len(group) < 2:
                for k in places if group else ():
                    out[k] = self.classify(texts[k])
                continue
            data = {k: x for k in places if len(x := texts[k].lower().encode("utf-8", "replace")) >= 12}
            if data:
                sizes = np.array([compressed_sizes(c, list(data.values())) for _, c in group])
                best = sizes.argmin(axis=0)
                low, second = np.partition(sizes, 1, axis=0)[:2]
                for k, b, margin in zip(data, best.tolist(), ((second - low) / second).tolist()):
                    out[k] = group[b][0] if margin >= MARGIN else None, margin
        return out


def compressed_sizes(compressor, data: list[bytes]) -> list[int]:
    if not hasattr(compressor, "multi_compress_to_buffer"):  # only the C backend has it
        return [len(compressor.compress(x)) for x in data]
    got = compressor.multi_compress_to_buffer(data)
    return [len(got[k]) for k in range(len(data))]


def full(s: str) -> bool:
    """Whether a text ends with an end mark, but for quotes, brackets and emphasis."""
    return s.rstrip("\"'”’»)」』*_")[-1:] in _ENDS


_ENDS = frozenset(".!?…。！？")


def is_data(s: str) -> bool:
    """Whether a line without blanks around it is data or code: in brackets as a whole, or ending as code does."""
    return s[-1] in "{};=<>" or s[0] in "[{<" and (len(s) > 1 and s[-1] in "]}>" or len(s) > 2 and s[-1] == "," and s[-2] in "]}>")


def plain(line: str) -> str:
    """A line without marks, links' targets and code spans."""
    if "](" in line or "://" in line:
        line = _LINK.sub(lambda m: m.group(1) or " ", line)
    if "`" in line:
        line = _CODE.sub(" ", line)
    marks = _MARKS.match(line)
    return (line[marks.end() :] if marks else line).strip()


def text_lines(content: str) -> list[tuple[int, str]]:
    """(number, text) of the lines that hold language: no code, data or blank lines."""
    out, fenced = [], False
    for no, line in enumerate(content.split("\n"), 1):
        s = line.strip()
        if s.startswith("```"):
            fenced = not fenced
        elif s and not fenced and not is_data(s):
            p = plain(s)
            if p:
                out.append((no, p))
    return out


def pieces(line: str) -> list[str]:
    """A line cut after its end marks, without the quotes, brackets and blanks that follow them."""
    out, at = [], 0
    for m in _SPLIT.finditer(line):
        out.append(line[at : m.start() + 1])
        at = m.end()
    out.append(line[at:])
    return out


def sentences(line: str) -> list[str]:
    """The full sentences of a line: with their end mark and at least three words (six CJK characters)."""
    if not full(line):
        cut = [m.end() for m in _SPLIT.finditer(line)]
        if not cut:
            return []
        line = line[: cut[-1]].strip()
    return [s for s in (x.strip() for x in pieces(line)) if full(s) and (s.count(" ") >= 2 or len(_CJK.findall(s)) >= 6)]


def line_languages(line: str, known: Languages) -> list[tuple[int, str, float]]:
    """(bytes, language, margin) of the full sentences of a line, each classified by itself."""
    latin = line.isascii() or not _OTHER_SCRIPT.search(line)
    return [(len(s.encode()), lang, margin) for s in sentences(line) for lang, margin in [known.classify(s, latin)] if lang]


class Page:
    """Languages of a record: per line (language, sentences, margin), and over the page."""

    def __init__(self, lines: list[tuple[int, list[tuple[int, str, float]]]]):
        self.lines = lines
        self.count: dict[str, int] = defaultdict(int)
        self.size: dict[str, int] = defaultdict(int)
        self.weight: dict[str, float] = defaultdict(float)
        for _, got in self.lines:
            for size, lang, margin in got:
                self.count[lang] += 1
                self.size[lang] += size
                self.weight[lang] += margin * size

    @classmethod
    def of(cls, content: str, known: Languages, cache: dict | None = None) -> Page:
        """All of a record, furniture included; ``cache`` keeps the answers of short lines."""
        lines = []
        for no, line in text_lines(content):
            got = cache.get(line) if cache is not None else None
            if got is None:
                got = line_languages(line, known)
                if cache is not None and len(line) < 160:
                    if len(cache) > 50_000:
                        cache.clear()
                    cache[line] = got
            if got:
                lines.append((no, got))
        return cls(lines)

    def without(self, skip: frozenset[int]) -> Page:
        """The page without the lines of these numbers."""
        return Page([x for x in self.lines if x[0] not in skip])

    def main(self) -> str | None:
        return max(self.size, key=lambda k: (self.count[k] >= SENTENCES, self.size[k], k)) if self.size else None

    def languages(self) -> list[str]:
        return sorted(k for k, n in self.count.items() if n >= SENTENCES)

    def confidence(self, lang: str) -> float:
        return self.weight[lang] / self.size[lang] if self.size.get(lang) else 0.0

    def segments(self) -> list[tuple[int, int, str, float]]:
        """(first line, last line, language, confidence) of the runs of sentences of one language."""
        out: list[list] = []
        for no, got in self.lines:
            for w, lang, margin in got:
                if out and out[-1][2] == lang:
                    out[-1][1] = no
                    out[-1][3] += margin * w
                    out[-1][4] += w
                else:
                    out.append([no, no, lang, margin * w, w])
        return [(a, b, lang, m / w) for a, b, lang, m, w in out]


def may_be_case(page: Page, named: str | None) -> bool:
    """Whether a record may be a case, by all of it, furniture included: nothing but the named language is none, whatever
    the furniture is."""
    return not (named and set(page.size) <= {named}) and bool(page.languages())


def case(page: Page, named: str | None) -> list[str]:
    """Languages of a record's main body if it is a case, else none."""
    langs = page.languages()
    return langs if not named or len(langs) >= 2 or page.main() != named else []


def main_pages(contents: list[str], pages: list[Page], model: Model) -> list[Page | None]:
    """The records' main bodies, None for spam. (Residue is told by the counts of all records.)"""
    return [None if model.chain.is_spam(c) else page.without(gone) for c, page, gone in zip(contents, pages, model.furnitures(contents))]


class Suspects:
    """Of a shard of the main-body model, the records that may be cases, and of all records what the residue operator needs:
    found when the shard is coded, judged when the model is known."""

    def __init__(self, known: Languages):
        self.known = known

    def __call__(self, ids: list[int | None], contents: list[str], labels: list[set[str | None]]) -> dict[int, tuple]:
        """Pages and labels of the suspects, by their places in the shard."""
        places: dict[str, int] = {}  # of the sentences, each once
        cache: dict[str, list[int]] = {}
        cut = []
        for content in contents:
            lines = []
            for no, line in text_lines(content):
                got = cache.get(line)
                if got is None:
                    got = cache[line] = [places.setdefault(s, len(places)) for s in sentences(line)]
                if got:
                    lines.append((no, got))
            cut.append(lines)
        told = [(len(s.encode()), lang, margin) if lang else None for s, (lang, margin) in zip(places, self.known.classify_all(list(places)))]
        out = {}
        for k, (lines, of) in enumerate(zip(cut, labels)):
            if lines:
                page = Page([(no, known) for no, got in lines if (known := [told[j] for j in got if told[j]])])
                if named := [x for x in {label_language(label) for label in of} if may_be_case(page, x)]:
                    out[k] = ids[k], page, named
        return out


def passages(spark, sf: str) -> dict[str, str]:
    """Reference text of each language (ISO 639-1), from a bounded number of rows."""
    rows = spark.read.parquet(f"{sf}/lang_samples.parquet").where("lang IS NOT NULL AND text IS NOT NULL").orderBy("sample_id").limit(PASSAGES).collect()
    out: dict[str, list[str]] = defaultdict(list)
    size: dict[str, int] = defaultdict(int)
    for r in rows:
        n = len(r["text"].lower().encode()) + 1
        if size[r["lang"]] + n <= DICTIONARY:
            size[r["lang"]] += n
            out[r["lang"]].append(r["text"])
    return {k: "\n".join(v) for k, v in out.items()}


FOUND = T.StructType([T.StructField("scrape_id", T.LongType()), T.StructField("lang", T.StringType())])
SEGMENTS = T.StructType(
    [
        T.StructField("scrape_id", T.LongType()),
        T.StructField("page_lang", T.StringType()),
        T.StructField("page_confidence", T.DoubleType()),
        T.StructField("segment_no", T.LongType()),
        T.StructField("first_line", T.LongType()),
        T.StructField("last_line", T.LongType()),
        T.StructField("lang", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
    ]
)


def _input(df: DataFrame) -> DataFrame:
    return df.select("scrape_id", "content", F.col("metadata.language").alias("label")).where("trim(content) <> ''")


def _no_residue(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The ``rows`` of records that the residue operator, with its counts of hosts, has not ``found``."""
    gone = found.select(F.col("scrape_id").alias("gone"))
    return rows.join(gone, F.col("scrape_id").eqNullSafe(F.col("gone")), "left_anti")


def found(df: DataFrame, known: Languages, model: Model) -> DataFrame:
    """(scrape_id, lang) of the records whose label is missing or wrong, or that mix languages."""
    shared = df.sparkSession.sparkContext.broadcast((known, model))  # some passages, and features that three lines of a shard share

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, model = shared.value
        cache: dict = {}
        for batch in batches:
            ids, langs = [], []
            rows = [(i, content, label_language(label), Page.of(content, known, cache)) for i, content, label in zip(*(batch.column(k).to_pylist() for k in range(3)))]
            rows = [r for r in rows if may_be_case(r[3], r[2])]
            for (i, _, named, _), page in zip(rows, main_pages([r[1] for r in rows], [r[3] for r in rows], model)):
                got = case(page, named) if page is not None else []
                ids += [i] * len(got)
                langs += got
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(langs, pa.string())], names=FOUND.names)

    return _no_residue(_input(df).mapInArrow(run, FOUND).distinct(), residue.found(df))


def segments(df: DataFrame, known: Languages, model: Model) -> DataFrame:
    """Language and confidence of every page's main body and of each of its segments."""
    shared = df.sparkSession.sparkContext.broadcast((known, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, model = shared.value
        cache: dict = {}
        for batch in batches:
            rows = []
            ids, contents = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, page in zip(ids, main_pages(contents, [Page.of(c, known, cache) for c in contents], model)):
                if page is None or (main := page.main()) is None:
                    continue
                rows += [(i, main, page.confidence(main), k, a, b, lang, c) for k, (a, b, lang, c) in enumerate(page.segments(), 1)]
            columns = list(zip(*rows)) or [()] * len(SEGMENTS)
            kinds = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=SEGMENTS.names)

    return _no_residue(_input(df).mapInArrow(run, SEGMENTS).dropDuplicates(["scrape_id", "segment_no"]), residue.found(df))


def found_prepared(prepared: DataFrame, model: Model) -> DataFrame:
    """``found`` of all records of shards that were prepared with :class:`Suspects`."""
    shared = prepared.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                x = unpacked(data.as_py())
                ids, langs = [], []
                suspects = x["judged"]
                at = sorted(suspects)
                coded = x["coded"].of(np.array([x["place"][k] for k in at], dtype=np.int64))
                gone = shared.value.furniture_of(coded)
                spam = shared.value.chain.are_spam(x["seen"])
                for k, lines in zip(at, gone):
                    if not spam[k]:
                        i, page, named = suspects[k]
                        page = page.without(lines)
                        got = {lang for label in named for lang in case(page, label)}
                        ids += [i] * len(got)
                        langs += got
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(langs, pa.string())], names=FOUND.names)

    assessed = prepared.select(F.inline("assessed"))
    return _no_residue(prepared.select("shard").mapInArrow(run, FOUND).distinct(), residue.found_in(residue.latest(assessed)))


def p3_found(spark, sf):
    """(scrape_id, lang) of missing or wrong labels and mixed languages."""
    prepared = prepare(spark, sf, judged=Suspects(Languages(passages(spark, sf))))
    return found_prepared(prepared, fit_to(prepared))


def p3_segments(spark, sf):
    """Language and confidence of pages and segments."""
    return segments(scrapes(spark, sf), Languages(passages(spark, sf)), fit(spark, sf))
