"""Missing or wrong language labels (problem 10): languages of documents and of their segments, by string kernels.

A sentence is the set of its letter n-grams of several lengths (blended spectrum, presence only). Its kernel with a
landmark sentence is the number of n-grams they share over the root of the product of their numbers. The kernels with
all landmarks, whitened by the Nyström matrix, are the features of a one-versus-rest kernel ridge regression, which is
fitted on a bounded sample of labelled documents and refitted without those sentences it takes to be mislabelled.
Landmarks, Nyström matrix and regression fold into one matrix of n-grams by languages, so that a batch of
sentences is scored by one product of its presence matrix, held in rows of n-gram numbers, with that matrix.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LANGUAGES = ("en", "de", "fr", "es", "pt", "nl")
#: Lengths of n-grams, and numbers they are hashed to.
SPECTRUM, BINS = (2, 3, 4), 1 << 14
#: Texts whose presence is marked at a time, and documents that are judged at a time.
ROWS, DOCS = 64, 4_000
#: Bounds of the sample that is fitted: labelled documents (those with the least key hashes among the not very long), their
#: longest length, sentences and landmarks a language.
SAMPLE, SAMPLE_CHARS, TRAIN, LANDMARKS = 9_000, 8_000, 500, 60
RIDGE, SHARPNESS = 0.1, 6.0
#: Words of a whole sentence, sentences that make a language, and confidence a minor language's sentences need.
WORDS, SENTENCES, SURE = 4, 2, 0.6

#: The names of the languages in labels.
NAMES = {
    "en": "en eng english inglés inglese anglais englisch",
    "de": "de deu ger german deutsch allemand alemán",
    "fr": "fr fra fre french français francais französisch francés",
    "es": "es spa spanish español espanol castellano espagnol spanisch",
    "pt": "pt por portuguese português portugues portugais portugiesisch",
    "nl": "nl nld dut dutch nederlands néerlandais niederländisch",
}
#: Labels that say nothing.
SILENT = frozenset({"", "und", "unk", "unknown", "none", "null", "n/a", "na", "mul", "mis", "zxx", "xx", "other", "?", "-", "auto", "nan", "unspecified", "undetermined"})
_NAMED = {name: code for code, names in NAMES.items() for name in names.split()}

_FENCE = re.compile(r"(?ms)^[ \t]*(```|~~~).*?(?:^[ \t]*\1[ \t]*$|\Z)")
_INLINE = re.compile(r"`[^`\n]*`")
_QUOTE = re.compile(r"\(\"[^\"\n]*\"\)|\"[^\"\n]{1,80}\"|[“„«][^”“»\n]{1,80}[”“»]")
_LINE_MARK = re.compile(r"^[ \t]*(?:(?:>|#+|\*|//+|--|;)[ \t]?)+|^[ \t]*(?:[-+•]|\d+[.)])[ \t]+|[ \t]*\*/[ \t]*$")
#: Characters with which a marked line may begin.
_MARKS = frozenset(" \t>#*/-;+•0123456789") - {""}
_ITEM = re.compile(r"^[ \t]*(?:[-+*•]|\d+[.)])[ \t]+")
_BREAK = re.compile(r"(?<=[.!?…])[\"')\]»”]*\s+")
_WORD = re.compile(r"(?<![^\s(\[\"'«„“¡¿*])[^\W\d_]+(?:['’-][^\W\d_]+)*(?=[.,;:!?…)\]\"'»”*]*(?:\s|$))")
_CAMEL = re.compile(r"[a-z][A-Z]")
_END = re.compile(r"[.!?…][\"')\]»”]*$")


def label_language(label: str | None) -> str | None:
    """The code a label names in any spelling or with a region, "" for a label that says nothing, None for another language."""
    text = (label or "").strip().lower()
    if text in SILENT:
        return ""
    return _NAMED.get(text) or _NAMED.get(re.split(r"[-_ (]", text)[0])


class _Kept(dict):
    """What becomes of each character: combining, invisible and control signs go."""

    def __missing__(self, c: int) -> int | None:
        self[c] = kept = None if unicodedata.category(chr(c)) in ("Mn", "Cf", "Cc", "Co") else c
        return kept


_KEPT = _Kept()


def fold(text: str) -> str:
    """Lower case without accents, invisible and combining signs."""
    if text.isascii():
        return text.lower()
    text = text.replace("ß", "ss")
    return unicodedata.normalize("NFKD", text.lower()).translate(_KEPT)


def sentences(text: str | None) -> list[tuple[int, str]]:
    """Whole sentences of a text's prose, as (number of the sentence, its words). Code, items and quotations are left out."""
    if not text:
        return []
    text = _FENCE.sub("\n\n", text.replace("\r\n", "\n").replace("\r", "\n").replace(" ", "\n"))
    out = []
    for block in re.split(r"\n[ \t]*\n", text):
        lines, run = [], []
        for line in block.split("\n"):
            item = False
            if line[:1] in _MARKS or line.endswith("*/"):
                item = bool(_ITEM.match(line))
                line = _LINE_MARK.sub("", line)
            bare = line.strip()
            if item and run:
                lines.append(" ".join(run))
                run = []
            if bare:
                run.append(bare)
        if run:
            lines.append(" ".join(run))
        for line in lines:
            if "`" in line:
                line = _INLINE.sub(" ", line)
            if any(c in line for c in "\"“„«"):
                line = _QUOTE.sub(" ", line)
            for sentence in _BREAK.split(line.strip()):
                if not _END.search(sentence.strip()):
                    continue
                words = [w for w in _WORD.findall(sentence) if w.islower() or not _CAMEL.search(w)]
                if len(words) >= WORDS:
                    out.append((len(out) + 1, fold(" ".join(words))))
    return out


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, gram): the distinct n-gram numbers of each text, rows in order."""
    joined = " " + "  ".join(texts) + " "
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.fromiter((len(t) + 2 for t in texts), np.int64, len(texts))
    ends = np.cumsum(size)
    own = np.repeat(np.arange(len(texts)), size)
    rows, keys = [], []
    for n in SPECTRUM:
        if len(points) < n:
            continue
        h = np.full(len(points) - n + 1, n, np.uint64)
        for k in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + points[k : len(points) - n + 1 + k]
            h ^= h >> np.uint64(29)
        first = own[: len(h)]
        inside = np.arange(len(h)) + n <= ends[first]
        rows.append(first[inside])
        keys.append((h[inside] % np.uint64(BINS)).astype(np.int64))
    out_row, out_gram = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for begin in range(0, len(texts), ROWS):  # the presence matrix, ROWS texts at a time
        present = np.zeros(ROWS * BINS, bool)
        for r, k in zip(rows, keys):
            a, b = np.searchsorted(r, (begin, begin + ROWS))
            present[(r[a:b] - begin) * BINS + k[a:b]] = True
        found = np.flatnonzero(present)
        out_row.append(found // BINS + begin)
        out_gram.append(found % BINS)
    return np.concatenate(out_row), np.concatenate(out_gram)


class Model:
    """One matrix of n-grams by languages."""

    def __init__(self, weights: np.ndarray) -> None:
        self.weights = weights

    def scores(self, texts: list[str]) -> np.ndarray:
        """Of each text and language the value of the regression, near 1 for the text's language and 0 for others."""
        out = np.zeros((len(texts), len(LANGUAGES)))
        if texts:
            row, gram = grams(texts)
            first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            count = np.diff(np.r_[first, len(row)])
            out[row[first]] = np.add.reduceat(self.weights[gram], first, axis=0) / np.sqrt(count)[:, None]
        return out

    def classify(self, texts: list[str]) -> list[tuple[str, float]]:
        """Language and confidence of each text."""
        s = self.scores(texts)
        p = np.exp(SHARPNESS * (s - s.max(axis=1, keepdims=True))) if len(s) else s
        p = p / p.sum(axis=1, keepdims=True) if len(s) else p
        best = s.argmax(axis=1) if len(s) else []
        return [(LANGUAGES[b], float(p[i, b])) for i, b in enumerate(best)]


def _presence(texts: list[str]) -> np.ndarray:
    row, gram = grams(texts)
    x = np.zeros((len(texts), BINS), np.float32)
    x[row, gram] = 1
    return x / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))


def fit(labelled: list[tuple[str, str]]) -> Model:
    """The model of (language, sentence) pairs; sentences that the first fit gives to another language are left out of the second."""
    by: dict[str, list[str]] = {x: [] for x in LANGUAGES}
    for language, text in labelled:
        if len(by[language]) < TRAIN:
            by[language].append(text)
    model = None
    for _ in range(2):
        if model is not None:
            by = {x: [t for t, (got, _) in zip(texts, model.classify(texts)) if got == x] for x, texts in by.items()}
        marks = _presence([t for x in LANGUAGES for t in by[x][:LANDMARKS]])
        texts = [t for x in LANGUAGES for t in by[x]]
        if not texts:
            return Model(np.zeros((BINS, len(LANGUAGES))))
        target = np.array([[x == y for y in LANGUAGES] for x in LANGUAGES for _ in by[x]], float)
        values, vectors = np.linalg.eigh((marks @ marks.T).astype(float))
        kept = values > 1e-6 * values.max()
        whiten = vectors[:, kept] / np.sqrt(values[kept])
        features = np.concatenate([_presence(texts[i : i + 500]) @ marks.T for i in range(0, len(texts), 500)]).astype(float) @ whiten
        weights = np.linalg.solve(features.T @ features + RIDGE * np.eye(features.shape[1]), features.T @ target)
        model = Model((marks.T.astype(float) @ (whiten @ weights)).astype(np.float32))
    return model


def sampled_model(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang") -> Model:
    """The model of the sample of `docs` that the bounds above allow."""
    usable = docs.filter(F.col(label).isNotNull() & F.col(text).isNotNull() & F.length(text).between(40, SAMPLE_CHARS))
    known = F.lower(F.trim(F.col(label)))
    first = F.regexp_extract(known, r"^([^\-_ (]*)", 1)
    named = usable.filter(known.isin(*_NAMED) | first.isin(*_NAMED))
    hashed = named.select(label, text, F.xxhash64(F.col(key)).alias("h"), F.col(key).alias("k"))
    share = min(1.0, 0.95 * SAMPLE / max(1, named.count()))
    chosen = hashed.filter(F.col("h") <= int(share * 2**64) - 2**63 - (share == 1.0))  # only the sample reaches the driver
    rows = sorted(chosen.limit(2 * SAMPLE).collect(), key=lambda r: (r["h"], str(r["k"])))[:SAMPLE]
    pairs = []
    for r in rows:
        language = label_language(r[0])
        if language:
            pairs += [(language, s) for _, s in sentences(r[1])[:2]]
    return fit(pairs)


def _segments(model: Model, texts: list[str | None]) -> list[list[tuple[str, float]]]:
    """Language and confidence of every whole sentence of every text; equal sentences are scored once."""
    split = [[s for _, s in sentences(t)] for t in texts]
    distinct = list({s for x in split for s in x})
    known: dict[str, tuple[str, float]] = {}
    for i in range(0, len(distinct), 4_000):
        known.update(zip(distinct[i : i + 4_000], model.classify(distinct[i : i + 4_000])))
    return [[known[s] for s in x] for x in split]


def languages_of(found: list[tuple[str, float]]) -> list[tuple[str, int, float]]:
    """(language, sentences, mean confidence) of each language with SENTENCES whole sentences; doubtful ones count for the main language."""
    if not found:
        return []
    main = Counter(x for x, _ in found).most_common(1)[0][0]
    sure = [(x if x == main or p >= SURE else main, p) for x, p in found]
    count = Counter(x for x, _ in sure)
    return [(x, n, sum(p for y, p in sure if y == x) / n) for x, n in count.items() if n >= SENTENCES]


def document_languages(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang") -> DataFrame:
    """(key, lang, n_sentences, confidence, verdict): the languages of each document with prose.

    The verdict holds the delivered label against them: `missing` (null or says nothing), `wrong` (another language), `mixed` (several
    languages, under any label) or `right`. Texts that are null, empty or without two whole sentences of one language give no row.
    """
    model = sampled_model(docs, key, text, label)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts, labels = (batch.column(i).to_pylist() for i in range(3))
            rows = []
            for i in range(0, len(keys), DOCS):
                for k, named, found in zip(keys[i : i + DOCS], labels[i : i + DOCS], _segments(model, texts[i : i + DOCS])):
                    kept = languages_of(found)
                    said = label_language(named)
                    verdict = "mixed" if len(kept) > 1 else "missing" if said == "" else "right" if kept and said == kept[0][0] else "wrong"
                    rows += [(k, x, n, c, verdict) for x, n, c in kept]
            columns = list(zip(*rows)) if rows else [[]] * 5
            kinds = [batch.schema.field(0).type, pa.string(), pa.int64(), pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["key", "lang", "n_sentences", "confidence", "verdict"])

    kind = docs.schema[key].dataType.simpleString()
    found = docs.select(key, text, label).mapInArrow(run, f"key {kind}, lang string, n_sentences long, confidence double, verdict string")
    return found.withColumnRenamed("key", key)


def document_segments(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang") -> DataFrame:
    """(key, segment, lang, first_sentence, n_sentences, confidence): runs of sentences of one language."""
    model = sampled_model(docs, key, text, label)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows = []
            for i in range(0, len(keys), DOCS):
                for k, found in zip(keys[i : i + DOCS], _segments(model, texts[i : i + DOCS])):
                    runs: list[list] = []
                    for n, (x, p) in enumerate(found, 1):
                        if runs and runs[-1][0] == x:
                            runs[-1][2] += 1
                            runs[-1][3] += p
                        else:
                            runs.append([x, n, 1, p])
                    rows += [(k, s, x, n, m, round(p / m, 4)) for s, (x, n, m, p) in enumerate(runs, 1)]
            columns = list(zip(*rows)) if rows else [[]] * 6
            kinds = [batch.schema.field(0).type, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64()]
            names = ["key", "segment", "lang", "first_sentence", "n_sentences", "confidence"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    kind = docs.schema[key].dataType.simpleString()
    found = docs.select(key, text).mapInArrow(run, f"key {kind}, segment long, lang string, first_sentence long, n_sentences long, confidence double")
    return found.withColumnRenamed("key", key)
