"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built.  A text is parsed greedily into the longest phrases
that occur in that language's labelled text (the automaton's longest-match lengths); the language whose text needs the
fewest phrases, each weighted by the logarithm of its training length, wins.

Training uses a bounded sample of every language (the bounds are parameters of ``train``): at most
``docs_per_language`` distinct labelled rows, the least by a hash of doc_id and text, and ``chars_per_language`` characters
of them (less if there are over 16 languages), in equal spans from anywhere in the texts.
The commonest letters are one symbol each, and every other letter of the sample is spelt in hexadecimal symbols, so none
of them are confused; letters that no language's sample has are one symbol.
The automata are completed to dense tables (a missing transition ends a phrase and starts the next at the root), so
prediction is one table look-up for each character and language, run over many pieces of text at once.  A piece has PIECE
symbols, and its last phrase ends with it in every language alike, so very long texts add at most one phrase for each.
Prediction is map-only.  The broadcast tables have at most 2 * ALPHABET places for each symbol of the sample.

Defined results: null texts and texts without a letter get ``und`` and score 0; if there are no labelled rows every
text gets ``und``; ties go to the language that comes first in alphabetical order; rows that repeat another are learned
once and each give a row; very long texts are read whole; a null doc_id is carried along; extra columns, whatever their
names, are ignored by ``identify`` and kept by ``keep_identified``; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import pickle
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import claim, load, whole_rows

ALPHABET, PIECE, LANES = 64, 512, 4096
LETTERS, SPELT = 45, 255  # how many letters are a symbol; mark of the others
PAD, OTHER, DIGIT = ALPHABET - 1, LETTERS + 1, LETTERS + 2
SALTS = 64
SHARED, LEAST = 16, 512  # beyond so many languages they share the characters; but so many each
_LETTER = regex.compile(r"\p{L}")
_COUNT = 29  # bits from here on hold how many phrases a transition ends


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def suffix_automaton(codes: list[int]) -> tuple[list[dict[int, int]], list[int]]:
    """Transitions and suffix links of the suffix automaton (Blumer et al.)."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt, link


class Model:
    """Dense tables, one after the other, of each language's automaton."""

    def __init__(self, texts: dict[str, str]) -> None:
        self.langs = sorted(texts)
        lowered = {k: texts[k].lower() for k in self.langs}
        common = Counter(c for t in lowered.values() for c in t if c.isalpha()).most_common()
        common, rest = common[:LETTERS], sorted(ord(c) for c, _ in common[LETTERS:])
        self.rest, self.width = np.array(rest, np.uint32), max(1, -(-len(rest).bit_length() // 4))
        self.classes = {c: i + 1 for i, (c, _) in enumerate(sorted(common))}
        tables, self.base, self.bits, at = [], [], [], 0
        for k in self.langs:
            codes = _collapsed(self.codes(lowered[k]))[0].tolist()
            nxt, _ = suffix_automaton(codes)
            table = np.full((len(nxt), ALPHABET), -1, np.int32)
            for s, arcs in enumerate(nxt):
                for c, t in arcs.items():
                    table[s, c] = t * ALPHABET + at
            root = np.where(table[0] >= 0, table[0], at)
            alien = root == at  # a character that the language doesn't have is a phrase of its own
            table = np.where(table >= 0, table, root + ((1 + alien) << _COUNT))
            table[0] = np.where(alien, at + (1 << _COUNT), root)
            table[:, PAD] = np.arange(len(nxt)) * ALPHABET + at
            tables.append(table.astype(np.int32).ravel())
            self.base.append(at)
            self.bits.append(math.log2(max(2, len(codes))))
            at += table.size
        self.table = np.concatenate(tables) if tables else np.zeros(0, np.int32)

    def lut(self) -> np.ndarray:
        out = np.where(_letters(), np.uint8(OTHER), np.uint8(0)).astype(np.uint8)
        for c, i in self.classes.items():
            out[ord(c)] = i
        out[self.rest] = SPELT
        return out

    def codes(self, text: str) -> np.ndarray:
        return self.coded([text])[0]

    def coded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all texts, and where each text ends in them."""
        if not hasattr(self, "_lut"):
            self._lut = self.lut()
        points = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), np.uint32)
        codes, ends = self._lut[points], np.cumsum([len(t) for t in texts])
        spelt = np.flatnonzero(codes == SPELT)
        if len(spelt):
            which = np.searchsorted(self.rest, points[spelt])
            width = np.ones(len(codes), np.int64)
            width[spelt] = self.width
            upto = np.concatenate([[0], np.cumsum(width)])
            codes, ends = np.repeat(codes, width), upto[ends]
            for k in range(self.width):
                codes[upto[spelt] + k] = DIGIT + (which >> (4 * (self.width - 1 - k)) & 15)
        return codes, ends

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_lut"}

    def phrases(self, codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Phrases by document and language; ends: where each document ends in codes."""
        begins = np.concatenate([[0], ends[:-1]])
        pieces = -(-(ends - begins) // PIECE)
        doc = np.repeat(np.arange(len(ends)), pieces)
        first = np.repeat(np.cumsum(pieces) - pieces, pieces)
        lo = begins[doc] + (np.arange(len(doc)) - first) * PIECE
        hi = np.minimum(lo + PIECE, ends[doc])
        order = np.argsort(lo - hi, kind="stable")  # long pieces first, so that lanes end together
        out = np.zeros((len(ends), len(self.langs)), np.int64)
        base = np.array(self.base, np.int32)[:, None]
        for at in range(0, len(doc), LANES):
            k = order[at : at + LANES]
            steps = int((hi[k] - lo[k]).max())
            where = lo[k][None, :] + np.arange(steps)[:, None]
            grid = np.where(where < hi[k][None, :], codes[np.minimum(where, len(codes) - 1)], PAD).astype(np.int32)
            state = np.repeat(base, len(k), 1)
            count = np.zeros_like(state)
            for row in grid:
                got = self.table[state + row]
                count += got >> _COUNT
                state = got & ((1 << _COUNT) - 1)
            count += state != base  # the phrase that is still open
            np.add.at(out, doc[k], count.T)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        has = np.array([bool(t and self.langs and _LETTER.search(t)) for t in texts], bool)
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        rows = np.flatnonzero(has)
        for part in _slices(texts, rows):
            codes, ends = _collapsed(*self.coded([texts[i].lower() for i in part]))
            cost = self.phrases(codes, ends) * np.array(self.bits)
            best = cost.argmin(1)
            low = cost[np.arange(len(part)), best]
            share = 1 / np.exp2(np.maximum(low[:, None] - cost, -60)).sum(1)
            for i, b, s in zip(part, best, share, strict=True):
                langs[i], scores[i] = self.langs[b], float(s)
        return langs, scores


def _collapsed(codes: np.ndarray, ends: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Runs of class 0 (all that is no letter) become one."""
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
    ends = np.array([len(codes)]) if ends is None else ends
    return codes[keep], np.cumsum(keep)[ends - 1] if len(codes) else ends


def _slices(texts: list[str | None], rows: np.ndarray, chars: int = 2_000_000) -> Iterator[list[int]]:
    part, n = [], 0
    for i in rows.tolist():
        part.append(i)
        n += len(texts[i])
        if n >= chars:
            yield part
            part, n = [], 0
    if part:
        yield part


def _joined(spans: list[str], chars: int) -> str:
    """Of each span an equal part, and what short spans leave for the others; ``chars`` characters in all."""
    left, parts = chars, {}
    for n, i in enumerate(sorted(range(len(spans)), key=lambda i: len(spans[i]))):
        parts[i] = spans[i][: max(1, left // (len(spans) - n))]
        left -= len(parts[i])
    return "\n".join(parts[i] for i in range(len(spans)))


def train(labelled: DataFrame, docs_per_language: int = 96, chars_per_language: int = 16_000) -> Model:
    """Fits a model on a bounded sample of labelled (doc_id, lang, text)."""
    labelled = labelled.select("doc_id", "lang", "text").where("lang IS NOT NULL AND text IS NOT NULL").where(F.col("text").rlike(r"\p{L}"))
    placed = labelled.withColumn("place", F.xxhash64("doc_id", "text"))
    # the least places of each part of a language, then of the language: at most SALTS * docs_per_language rows in a group
    least = lambda rows, *by: rows.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy("place"))).where(F.col("nth") <= docs_per_language).drop("nth")
    parts = placed.select("lang", "place").distinct().withColumn("salt", F.pmod("place", F.lit(SALTS)))
    chosen = least(least(parts, "lang", "salt").drop("salt"), "lang")
    each = 4 * chars_per_language // docs_per_language
    begin = F.pmod("place", F.greatest(F.lit(1), F.char_length("text") - each + 1)).cast("int") + 1
    spans = placed.withColumn("span", F.substring("text", begin, F.lit(each))).join(F.broadcast(chosen), ["lang", "place"])
    own: dict[str, list[str]] = {}
    for r in sorted(spans.groupBy("lang", "place").agg(F.min("span").alias("span")).collect(), key=lambda r: (r["lang"], r["place"])):
        own.setdefault(r["lang"], []).append(r["span"])
    chars = max(min(LEAST, chars_per_language), min(chars_per_language, SHARED * chars_per_language // max(1, len(own))))
    texts = {lang: _joined(rows, chars) for lang, rows in own.items()}
    return Model({lang: text for lang, text in texts.items() if any(c.isalpha() for c in text)})


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, one row per input row."""
    shared, name = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model)), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _model(shared, name)
        for b in batches:
            langs, scores = own.predict(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs whose language is known (not ``und``), all columns as they were."""
    shared, name = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model)), uuid.uuid4().hex
    names, at = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _model(shared, name)
        for b in batches:
            cols = b.column(0).flatten()
            known = pa.array([x != "und" for x in own.predict(cols[at].to_pylist())[0]], pa.bool_())
            yield pa.RecordBatch.from_arrays(cols, names).filter(known)

    return whole_rows(docs).mapInArrow(run, docs.schema)


_MODELS: dict[str, Model] = {}


def _model(shared, name: str) -> Model:
    """One unpickled model per Python worker."""
    claim("language models", _MODELS.clear)
    if name not in _MODELS:
        _MODELS.clear()
        _MODELS[name] = pickle.loads(shared.value)
    return _MODELS[name]


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    model = train(docs.where(~held_out()).select("doc_id", "lang", "text"))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
