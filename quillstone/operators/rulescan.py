"""Many rules over texts in one pass.

A rule names literals of which every match holds at least one.  An Aho-Corasick automaton over
all rules' literals reads a text once; only the rules it points to are matched.  The time is that of
the pass and of the hits, not of the number of rules.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

#: Letters that match an ASCII letter in any case, beyond what case folding gives.
DOTTED = str.maketrans({"İ": "i", "ı": "i"})


@dataclass(frozen=True)
class Rule:
    """``literals`` are in lower case; a rule without any is matched against every text."""

    name: str
    severity: str
    pattern: str
    literals: tuple[str, ...] = ()
    ignore_case: bool = False


@lru_cache(8)
def compiled(rules: tuple[Rule, ...]) -> tuple:
    """The automaton (None without literals), the rules it never rules out, and the patterns."""
    owners: dict[str, set[int]] = {}
    for i, rule in enumerate(rules):
        for literal in rule.literals:
            owners.setdefault(literal, set()).add(i)
    automaton = ahocorasick.Automaton()
    for literal, own in owners.items():
        automaton.add_word(literal, own)
    automaton.make_automaton()
    always = {i for i, rule in enumerate(rules) if not rule.literals}
    return automaton if owners else None, always, [re.compile(r.pattern, re.IGNORECASE if r.ignore_case else 0) for r in rules]


def findings(text: str | None, rules: tuple[Rule, ...]) -> list[tuple[str, str, str]]:
    """(rule, severity, first match) in the order of the rules."""
    if not text:
        return []
    automaton, always, patterns = compiled(rules)
    wanted = set(always)
    if automaton is not None:
        for _, own in automaton.iter(text.translate(DOTTED).casefold()):
            wanted |= own
    matched = [(i, patterns[i].search(text)) for i in sorted(wanted)]
    return [(rules[i].name, rules[i].severity, m[0]) for i, m in matched if m]


def scan_rules(texts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """id, rule, severity, evidence of texts (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, *f) for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for f in findings(text.as_py(), rules)]
            columns = list(zip(*found, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.schema.types[0]), *(pa.array(c, pa.string()) for c in columns[1:])], ["id", "rule", "severity", "evidence"])

    kind = dict(texts.dtypes)["id"]
    return texts.select("id", "text").mapInArrow(run, f"id {kind}, rule string, severity string, evidence string")
