"""License scans: hundreds of ordered signature rules over whole texts.

White space and comment signs between words count as one space, by the patterns, so
offsets are those of the text. An Aho-Corasick automaton over the
rules' keywords passes once over the text; only rules with a keyword in it are tried.
Detections are then resolved by priority and containment: a detection is suppressed where it
is contained in one of at least its priority (of equal ones the first rule stays), and partial
overlaps stay beside each other. A notice that names no licence (Unknown-Reference) also goes
where it overlaps any other detection: that one names the licence it speaks of.

Defined results
- Offsets count characters of the text; end is exclusive.
- A null or empty text, and a text without a licence, give no rows.
- Rows are scanned each on their own: equal rows give equal detections, a null doc_id is
  kept as it is. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from spanloom.llm.common import quoted, ship, table
from spanloom.llm.license_rules import all_rules

#: What may stand for a space of a pattern: white space with comment signs in it.
GAP = r"(?:[\s*#;/%]*[\s][\s*#;/%]*)"

#: The licence of notices that name none.
UNNAMED = "Unknown-Reference"

Detection = tuple[int, int, str, int, int]


def lowered(text: str) -> str:
    """Lower case, with the two letters that match s and i but don't become them."""
    return text.replace("\u017f", "s").replace("\u0130", "i").lower()


def _compiled(pattern: str) -> regex.Pattern:
    out, inside, escaped = [], False, False
    for c in pattern:
        if c == " ":
            out.append(r"\s" if inside else GAP)
        else:
            out.append(c)
            inside = not escaped and (c == "[" or inside and c != "]") or inside and escaped
        escaped = c == "\\" and not escaped
    return regex.compile("".join(out), regex.IGNORECASE)


class Scanner:
    """The compiled rules and the automaton over their keywords."""

    def __init__(self, rules=None):
        import ahocorasick

        self.rules = [(a, pr, kw, _compiled(p)) for a, pr, kw, p in (rules or all_rules())]
        by_word: dict[str, list[int]] = {}
        for i, (_, _, kw, _) in enumerate(self.rules):
            for k in kw:
                # the automaton can't know how a gap is written: a keyword's first word is enough
                by_word.setdefault(k.split(" ")[0] if " " in k.strip() else k.strip(), []).append(i)
        self.automaton = ahocorasick.Automaton()
        for word, ids in by_word.items():
            self.automaton.add_word(word, (word, tuple(ids)))
        self.automaton.make_automaton()
        self.second = {}
        for i, (_, _, kw, _) in enumerate(self.rules):
            self.second[i] = [[w for w in k.split(" ") if w] for k in kw]

    def wanted(self, low: str) -> list[int]:
        """Rules all of whose words of some keyword occur in the lower-cased text."""
        hit = dict(v for _, v in self.automaton.iter(low))
        ids = sorted({i for v in hit.values() for i in v})
        return [i for i in ids if any(all(w in low for w in words) for words in self.second[i])] if ids else []

    def matches(self, text: str, ids: list[int] | None = None) -> list[Detection]:
        """(start, end, licence, priority, rule) of every match of the rules, unresolved."""
        out = []
        for i in range(len(self.rules)) if ids is None else ids:
            name, priority, _, pattern = self.rules[i]
            out += [(m.start(), m.end(), name, priority, i) for m in pattern.finditer(text) if m.end() > m.start()]
        return out

    def scan(self, text: str | None) -> list[Detection]:
        if not text:
            return []
        ids = self.wanted(lowered(text))
        return uncontained(self.matches(text, ids)) if ids else []


def uncontained(found: list[Detection]) -> list[Detection]:
    """The detections that stay, in the order of the text."""
    import bisect

    starts, ends = [], []  # of kept ones that lie in no other kept one: both ascend
    kept = []
    for d in sorted(found, key=lambda d: (-d[3], d[0] - d[1], d[0], d[4])):
        k = bisect.bisect_right(starts, d[0])
        if k and ends[k - 1] >= d[1]:
            continue
        if d[2] == UNNAMED and (k and ends[k - 1] > d[0] or k < len(starts) and starts[k] < d[1]):
            continue
        kept.append(d)
        lo, hi = bisect.bisect_left(starts, d[0]), bisect.bisect_right(ends, d[1])
        starts[lo:hi], ends[lo:hi] = [d[0]], [d[1]]
    return sorted(kept)


def resolve(found: list[Detection]) -> list[Detection]:
    """The detections that stay if none may overlap another, in the order of the text."""
    import bisect

    kept: list[tuple[int, int, Detection]] = []
    for d in sorted(found, key=lambda d: (-d[3], d[0] - d[1], d[0], d[4])):
        k = bisect.bisect_right(kept, (d[0], 1 << 62))
        if (k and kept[k - 1][1] > d[0]) or (k < len(kept) and kept[k][0] < d[1]):
            continue
        kept.insert(k, (d[0], d[1], d))
    return [d for _, _, d in kept]


@cache
def scanner() -> Scanner:
    return Scanner()


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per detection: (doc_id, start, end, license, priority, rule, matched)."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scanner()
        for b in batches:
            rows = []
            ids, texts = b.column(0), b.column(1)
            for i in range(b.num_rows):
                text = texts[i].as_py()
                for d in s.scan(text):
                    rows.append((i, *d, text[d[0] : d[1]]))
            if rows:
                i, start, end, name, priority, rule, matched = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(i)), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(name), pa.array(priority, pa.int32()), pa.array(rule, pa.int32()), pa.array(matched)],
                    names=["doc_id", "start", "end", "license", "priority", "rule", "matched"],
                )

    d = docs.select(quoted(id_col).cast("long").alias("doc_id"), quoted(text_col).alias("text"))
    return d.mapInArrow(run, "doc_id long, start long, end long, license string, priority int, rule int, matched string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
