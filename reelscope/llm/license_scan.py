"""License scan: ordered signature rules over normalised words.

A rule is a regular expression over the words of a text, joined by one space. It is tried only where its keyword and a
word that its context cannot do without occur in the text; no rule matches without them. Rules are ordered by priority; a
detection inside another one of equal or higher priority is suppressed, and of two that merely overlap the one of higher
priority (then the longer, then the earlier) stays.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from reelscope.llm.common import folded_words, texts_in, utf8

#: Fixed by the contract of the query: phrase and label.
BASE = ((b"under the mit license", "mit"), (b"apache license version 2", "apache-2"), (b"cc by nc", "cc-by-nc"))

#: Family: keyword, name as a pattern over words, versions ("" = without). Every family takes every context below.
FAMILIES = {
    "mit": (b"mit", "mit", ("",)),
    "apache": (b"apache", "apache(?: software)?(?: license)?", ("", "1 0", "1 1", "2 0")),
    "gpl": (b"gpl", "(?:gnu )?gpl", ("", "1 0", "2 0", "3 0")),
    "gnu-gpl": (b"general public", "(?:gnu )?general public license", ("", "1", "2", "3")),
    "lgpl": (b"lgpl", "(?:gnu )?lgpl", ("", "2 1", "3 0")),
    "gnu-lgpl": (b"lesser general public", "(?:gnu )?lesser general public license", ("", "2 1", "3")),
    "agpl": (b"affero", "(?:gnu )?affero general public license", ("", "3")),
    "fdl": (b"free documentation", "(?:gnu )?free documentation license", ("", "1 2", "1 3")),
    "bsd-2-clause": (b"bsd", "(?:simplified|2 clause) bsd|bsd 2 clause", ("",)),
    "bsd-3-clause": (b"bsd", "(?:new|modified|revised|3 clause) bsd|bsd 3 clause", ("",)),
    "bsd": (b"bsd", "bsd", ("",)),
    "isc": (b"isc", "isc", ("",)),
    "mpl": (b"mozilla", "mozilla public license", ("", "1 1", "2 0")),
    "epl": (b"eclipse", "eclipse public license", ("", "1 0", "2 0")),
    "eupl": (b"european union public", "european union public licen[cs]e", ("", "1 1", "1 2")),
    "cddl": (b"common development", "common development and distribution license", ("", "1 0", "1 1")),
    "artistic": (b"artistic", "artistic license", ("", "1 0", "2 0")),
    "boost": (b"boost", "boost software license", ("", "1 0")),
    "zlib": (b"zlib", "zlib(?: libpng)?", ("",)),
    "unlicense": (b"unlicense", "unlicense", ("",)),
    "wtfpl": (b"wtfpl", "wtfpl", ("", "2")),
    "cc0": (b"cc0", "(?:creative commons )?cc0(?: 1 0)?(?: universal)?", ("",)),
    "cc-by": (b"cc by", "cc by", ("", "2 0", "3 0", "4 0")),
    "cc-by-sa": (b"cc by sa", "cc by sa", ("", "3 0", "4 0")),
    "cc-by-nd": (b"cc by nd", "cc by nd", ("", "3 0", "4 0")),
    "cc-by-nc": (b"cc by nc", "cc by nc", ("", "3 0", "4 0")),
    "cc-by-nc-sa": (b"cc by nc sa", "cc by nc sa", ("", "3 0", "4 0")),
    "cc-by-nc-nd": (b"cc by nc nd", "cc by nc nd", ("", "3 0", "4 0")),
    "creative-commons": (b"creative commons", "creative commons(?: attribution)?(?: non ?commercial)?(?: share ?alike| no ?derivatives)?", ("", "3 0", "4 0")),
    "odbl": (b"open database", "open database license", ("", "1 0")),
    "ofl": (b"open font", "(?:sil )?open font license", ("", "1 1")),
    "proprietary": (b"proprietary", "proprietary", ("",)),
}
#: Context: priority (smaller is stronger), confidence, pattern around {name}.
CONTEXTS = {
    "tag": (1, 1.0, "spdx licen[cs]e identifier {name}"),
    "notice": (2, 0.95, "this (?:work|file|program|software|project|document|page|text) is (?:licen[cs]ed|covered|governed|distributed|released) (?:under|by) (?:the )?(?:terms of the )?{name}(?: licen[cs]e)?"),
    "grant": (3, 0.9, "(?:licen[cs]ed|released|distributed|available|published|provided|redistributed) under (?:the )?(?:terms of the )?{name}(?: licen[cs]e)?"),
    "later": (3, 0.9, "{name} or (?:at your option )?any later version"),
    "mention": (5, 0.6, "{name} licen[cs]e"),
}
RESERVED = (("all-rights-reserved", b"all rights reserved", "all rights reserved", 6, 0.4), ("public-domain", b"public domain", "(?:dedicated to|released (?:in)?to|in) the public domain", 4, 0.8))
#: Words of which a match in the context holds one at least. In a notice and a grant the word licence is optional.
NEEDS = {"tag": (b" spdx ",), "notice": (b" under ", b" by "), "grant": (b" under ",), "later": (b" any later version ",), "mention": (b" license ", b" licence ")}


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: bytes  # whole words, with the spaces around them
    needs: tuple[bytes, ...]
    pattern: re.Pattern
    priority: int
    confidence: float


@lru_cache(1)
def rules() -> list[Rule]:
    """Signature rules in order of priority: every family in every version and context, then the general ones."""
    made = []
    for family, (keyword, name, versions) in FAMILIES.items():
        for version in versions:
            full = f"(?:{name}){f' (?:version |v )?{version}' if version else ''}"
            label = f"{family}-{version.replace(' ', '.')}" if version else family
            for kind, (priority, sure, context) in CONTEXTS.items():
                made.append(Rule(label, b" " + keyword + b" ", NEEDS[kind], re.compile(f"(?<= ){context.format(name=full)}(?= )".encode()), priority, sure))
    made += [Rule(label, b" " + key + b" ", (b" " + key + b" ",), re.compile(f"(?<= ){text}(?= )".encode()), rank, sure) for label, key, text, rank, sure in RESERVED]
    return sorted(made, key=lambda r: r.priority)


def base_places(joined: bytes) -> list[tuple[int, str]]:
    """(word, label) of every place of a base phrase; ``joined``: words with one space around each."""
    found = []
    for phrase, label in BASE:
        at, word, seen, needle = -1, 0, 0, b" " + phrase + b" "
        while (at := joined.find(needle, at + 1)) >= 0:
            word += joined.count(b" ", seen, at)
            seen = at
            found.append((word, label))
    return found


def detections(joined: bytes, ordered: list[Rule]) -> list[tuple[int, int, Rule]]:
    """(start, end, rule) that survive suppression, in the order of the rules."""
    present, found = {}, []

    def holds(words):
        if words not in present:
            present[words] = words in joined
        return present[words]

    for rule in ordered:
        if holds(rule.keyword) and any(map(holds, rule.needs)):
            found += [(m.start(), m.end(), rule) for m in rule.pattern.finditer(joined)]
    found.sort(key=lambda d: (d[2].priority, d[0] - d[1], d[0], d[2].label))
    taken, kept = bytearray(len(joined)), []
    for a, b, rule in found:
        if taken.find(1, a, b) < 0:
            taken[a:b] = b"\1" * (b - a)
            kept.append((a, b, rule))
    return kept


def scan(text: bytes | None, ordered: list[Rule]) -> tuple:
    words = folded_words(text)
    joined = b" " + b" ".join(words) + b" "
    base = base_places(joined)
    kept = detections(joined, ordered)
    starts = [w for w, _ in base]
    own = {label for _, label in base}
    return (
        len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(own)),
        ",".join(sorted(own | {r.label for _, _, r in kept})), max([r.confidence for _, _, r in kept] + [0.9] * bool(base), default=0.0),
    )


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, word count, places of the base phrases, labels and a confidence from 0 to 1.

    Null and empty texts have no words, empty labels and score 0; repeated rows each get a row; other columns are not
    read. The whole text is scanned. No shuffle: each row stands alone.
    """

    def run(batches):
        ordered = rules()
        for batch in batches:
            out = list(zip(*(scan(t, ordered) for t in batch.column(1).to_pylist()), strict=True)) or [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, k) for v, k in zip(out, kinds, strict=True))], [id_col, *NAMES])

    kind = docs.schema[id_col].dataType.simpleString()
    return texts_in(docs).select(id_col, utf8(text_col).alias("_text")).mapInArrow(run, f"`{id_col}` {kind}, {SCHEMA}")


NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
