"""Licence scans by patience alignment.

A notice (template) is looked for wherever one of its starts, the rarest of its words, stands in the text.  A template
has more starts than the threshold lets it miss words, so an alignment that reaches the threshold matches a start.
The words around that place and the template's are aligned: equal words at both ends are matched, words unique to both
sides are anchors, the longest increasing subsequence of the anchors is kept, and the gaps between anchors are aligned in
the same way.  Where that isn't enough the window grows to a template's length beyond the outermost anchors while that
finds more; parts that far apart must be dense.  Coverage is the share of the template's words that are matched.  Of the
findings of a text that overlap, the one that matches most words stays (then higher coverage, then the template listed
first).

Map-only: nothing is shuffled; the templates are a literal list.  Text costs one pass; templates of which it holds too
few words for the threshold are passed over, and places that share a diagonal are aligned once.

Defined results: null and empty texts, and texts without a notice, have no findings (``licenses`` is then an empty
array, ``license`` and ``coverage`` null); one insertion of more words than the notice has (and a quarter) divides it, its
halves are then told apart; repeated rows each give a row; a notice that occurs several times is found
each time; very long texts are read whole, and a word that is no start costs one look-up; a null doc_id is carried
along; extra columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import load
from tessera.llm.license_texts import NOTICES

THRESHOLD, RARE_WORDS = 0.8, 3
_WORD = re.compile(r"\w+")


def increasing(values: list[int]) -> list[int]:
    """Indexes of a longest increasing subsequence (patience sorting with back pointers)."""
    tops: list[int] = []
    piles: list[int] = []
    back = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        if k == len(tops):
            tops.append(v)
            piles.append(i)
        else:
            tops[k], piles[k] = v, i
        back[i] = piles[k - 1] if k else -1
    out = []
    i = piles[-1] if piles else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matched places of a and b, in order."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            out.append((j, m))
        if i >= j or k >= m:
            continue
        in_a, in_b = Counter(a[i:j]), Counter(b[k:m])
        once = {w for w, n in in_a.items() if n == 1 and in_b.get(w) == 1}
        if not once:
            continue
        place = {w: at for at, w in enumerate(b[k:m], k) if w in once}
        xs = [(at, place[w]) for at, w in enumerate(a[i:j], i) if w in once]
        anchors = [xs[n] for n in increasing([y for _, y in xs])]
        out += anchors
        for (x0, y0), (x1, y1) in zip([(i - 1, k - 1), *anchors], [*anchors, (j, m)], strict=True):
            if x0 + 1 < x1 and y0 + 1 < y1:
                todo.append((x0 + 1, x1, y0 + 1, y1))
    return sorted(out)


def dense(pairs: list[tuple[int, int]], slack: int, least: int) -> list[tuple[int, int]]:
    """The pairs in parts (places of the first side at most slack words apart) of at least ``least`` pairs, half of their span."""
    parts: list[list[tuple[int, int]]] = []
    for p in pairs:
        if not parts or p[0] - parts[-1][-1][0] > slack:
            parts.append([])
        parts[-1].append(p)
    return [p for part in parts if len(part) >= least and 2 * len(part) > part[-1][0] - part[0][0] for p in part]


class Scanner:
    def __init__(self, notices: tuple[tuple[str, str], ...], threshold: float) -> None:
        self.threshold = threshold
        self.templates = [(name, [w.lower() for w in _WORD.findall(text)]) for name, text in notices]
        often = Counter(w for _, words in self.templates for w in set(words))
        self.words = [Counter(words) for _, words in self.templates]
        self.least = [next(k for k in range(len(words) + 1) if k >= len(words) or k / len(words) >= threshold) for _, words in self.templates]
        self.starts: list[dict[str, list[int]]] = []
        for (_, words), own, least in zip(self.templates, self.words, self.least, strict=True):
            rare = sorted(range(len(words)), key=lambda i: (words[i].isdigit(), own[words[i]] > 1, often[words[i]], -len(words[i]), words[i]))
            starts: dict[str, list[int]] = defaultdict(list)
            for i in rare[: max(RARE_WORDS, len(words) - least + 1)]:
                starts[words[i]].append(i)
            self.starts.append(dict(starts))

    def _possible(self, words: list[str]) -> list[int]:
        """Templates with a start and enough of their words, in any order, in the text."""
        seen = set(words)
        near = [t for t, starts in enumerate(self.starts) if not seen.isdisjoint(starts)]
        near = [t for t in near if sum(n for w, n in self.words[t].items() if w in seen) >= self.least[t]]
        if near:
            counts = Counter(words)
            near = [t for t in near if sum(min(n, counts[w]) for w, n in self.words[t].items()) >= self.least[t]]
        return near

    def _aligned(self, words: list[str], t: int, diagonal: int) -> tuple[int, list[tuple[int, int]]] | None:
        """Begin of the window and pairs of the narrowest alignment that reaches the threshold."""
        template, least, known = self.templates[t][1], self.least[t], self.words[t]
        n, slack = len(template), len(template) // 4 + 2
        for more in (0, slack):
            lo = max(0, diagonal - more)
            part = words[lo : diagonal + n + more]
            if sum(map(known.__contains__, part)) >= least:
                pairs = align(part, template)
                if len(pairs) >= least:
                    return lo, pairs
        more = n + slack
        lo, hi = max(0, diagonal - more), min(len(words), diagonal + n + more)
        while True:
            pairs = dense(align(words[lo:hi], template), slack, max(2, n // 10))
            if len(pairs) >= least:
                return lo, pairs
            if not pairs:
                return None
            (x0, y0), (x1, y1) = pairs[0], pairs[-1]
            begin, end = max(0, min(lo, lo + x0 - y0 - more)), min(len(words), max(hi, lo + x1 - y1 + n + more))
            if (begin, end) == (lo, hi):
                return None
            lo, hi = begin, end

    def find(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """Findings: licence, coverage, first and last character."""
        lowered = (text or "").lower()
        words = _WORD.findall(lowered)
        possible = self._possible(words)
        if not possible:
            return []
        spots = [(m[0], m.start(), m.end()) for m in _WORD.finditer(lowered)]
        found: dict[tuple[int, int, int], tuple] = {}
        for t in possible:
            starts, n = self.starts[t], len(self.templates[t][1])
            for diagonal in sorted({at - i for at, w in enumerate(words) if w in starts for i in starts[w]}):
                got = self._aligned(words, t, diagonal)
                if got:
                    lo, pairs = got
                    a, z = lo + pairs[0][0], lo + pairs[-1][0]
                    found[t, a, z] = min(found.get((t, a, z), (0,)), (-len(pairs), -len(pairs) / n, t, a, z))
        out, taken = [], []
        for _, share, t, a, z in sorted(found.values()):
            if all(z < x or a > y for x, y in taken):
                taken.append((a, z))
                out.append((self.templates[t][0], -share, a, z))
        return [(name, share, spots[a][1], spots[z][2]) for name, share, a, z in sorted(out, key=lambda r: r[2])]


def scan(docs: DataFrame, notices: tuple[tuple[str, str], ...] = NOTICES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, licenses (array of license, coverage, begin, end), one row per input row; ends are exclusive.

    Places count characters of the lower-cased text, which are those of the text except for a few letters that
    lower-case to several.
    """
    kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("begin", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scanner(notices, threshold)
        for b in batches:
            found = [[dict(zip(("license", "coverage", "begin", "end"), f, strict=True)) for f in own.find(t.as_py())] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kind)], ["doc_id", "licenses"])

    src = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    return src.mapInArrow(run, "doc_id long, licenses array<struct<license: string, coverage: double, begin: long, end: long>>")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, license and coverage of the best finding, n_found, begin and end of the best finding."""
    found = scan(load(spark, sf_dir, "documents"))
    best = "array_sort(licenses, (x, y) -> case when x.coverage > y.coverage then -1 when x.coverage < y.coverage then 1 when x.begin < y.begin then -1 when x.begin > y.begin then 1 else 0 end)"
    return found.selectExpr("doc_id", "size(licenses) AS n_found", f"get({best}, 0) AS best").selectExpr("doc_id", "best.license", "best.coverage", "n_found", "best.begin", "best.end")
