"""Licence scan: an Aho-Corasick automaton finds notice phrases and identifier tags, and a
shunting-yard parser reads and evaluates the licence expression behind each tag.

An expression's value is what it asks of a user: the licences that every way of meeting it
needs (``required``), those of any way, and the grade of its mildest way. ``and`` joins
duties and takes the stricter grade, ``or`` leaves a choice and takes the milder, ``with``
makes a copyleft licence weak. So ``mit and gpl-2.0-only`` is copyleft and needs both, while
``mit or gpl-2.0-only`` is permissive and needs neither.

Words are runs of characters other than ASCII non-alphanumerics, with A-Z lower-cased;
phrases are matched on whole words standing consecutively.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .storage import map_batches

SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, "
    "base_labels string, labels string, score double, n_method long, expressions string, required string, verdict string"
)
#: The base phrases and their labels.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Further notice phrases that the method labels.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the mit license": "mit",
    "released under the mit license": "mit",
    "gnu general public license": "gpl",
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "mozilla public license version 2 0": "mpl-2.0",
    "eclipse public license": "epl",
    "redistribution and use in source and binary forms": "bsd",
    "redistributions of source code must retain the above copyright notice": "bsd",
    "boost software license": "bsl",
    "isc license": "isc",
    "the unlicense": "unlicense",
    "released into the public domain": "public-domain",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "creative commons attribution": "cc-by",
    "cc0 1 0 universal": "cc0",
}
TAG = "spdx license identifier"
_TAG_TEXT = re.compile(r"SPDX-License-Identifier:[ \t]*", re.IGNORECASE)
_LINE_END = re.compile(r"[\n\r]")
_TOKEN = re.compile(r"\(|\)|[A-Za-z0-9][A-Za-z0-9.+\-]*")
_PRECEDENCE = {"or": 1, "and": 2, "with": 3}

#: Grades from mild to strict; a licence that no rule names is ``unknown``.
GRADES = ["permissive", "weak-copyleft", "copyleft", "unknown", "non-commercial"]
#: Beginnings of identifiers and their grade; the longest that fits counts.
_BEGINNINGS = {
    "mit": 0, "apache-": 0, "bsd-": 0, "isc": 0, "zlib": 0, "unlicense": 0, "cc0-": 0, "bsl-1.0": 0, "0bsd": 0,
    "cc-by-": 0, "postgresql": 0, "python-": 0, "unicode-": 0, "wtfpl": 0,
    "lgpl-": 1, "mpl-": 1, "epl-": 1, "cddl-": 1, "gpl-": 2, "agpl-": 2, "cc-by-sa-": 2, "osl-": 2, "eupl-": 2,
    "cc-by-nc": 4, "polyform-noncommercial": 4,
}


def grade(name: str) -> int:
    """Place in ``GRADES`` of a licence identifier; ``+`` at its end means later versions."""
    name = name.removesuffix("+")
    fits = [b for b in _BEGINNINGS if name.startswith(b) if b[-1] in "-0123456789" or name == b or name[len(b)] == "-"]
    return _BEGINNINGS[max(fits, key=len)] if fits else GRADES.index("unknown")


def evaluate(postfix: list[str]) -> tuple[frozenset[str], int]:
    """(licences that every way of meeting the expression needs, grade of the mildest way)
    of a postfix expression."""
    stack: list[tuple[frozenset[str], int]] = []
    for token in postfix:
        if token not in _PRECEDENCE:
            stack.append((frozenset([token]), grade(token)))
            continue
        (b, strict_b), (a, strict_a) = stack.pop(), stack.pop()
        if token == "and":
            stack.append((a | b, max(strict_a, strict_b)))
        elif token == "or":
            stack.append((a & b, min(strict_a, strict_b)))
        else:
            named = frozenset(f"{x} with {y}" for x in a for y in b)
            stack.append((named, 1 if GRADES[strict_a] == "copyleft" else strict_a))
    return stack[0]


_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def parse_expression(text: str) -> tuple[list[str], str] | None:
    """Identifiers (lower case, in order) and the postfix form of the licence expression
    that ``text`` starts with, by the shunting-yard method; None if there is none.

    ``with`` binds tightest, then ``and``, then ``or``; reading stops at the first token
    that cannot continue an expression, and an open bracket at the end is an error."""
    output: list[str] = []
    operators: list[str] = []
    names: list[str] = []
    operand = True
    end = 0
    for m in _TOKEN.finditer(text):
        if text[end : m.start()].strip(" \t"):
            break
        token, low = m[0], m[0].lower()
        if operand:
            if token == "(":
                operators.append(token)
            elif token == ")" or low in _PRECEDENCE:
                return None
            else:
                output.append(low)
                if not (operators and operators[-1] == "with"):
                    names.append(low)
                operand = False
        elif low in _PRECEDENCE:
            while operators and operators[-1] != "(" and _PRECEDENCE[operators[-1]] >= _PRECEDENCE[low]:
                output.append(operators.pop())
            operators.append(low)
            operand = True
        elif token == ")" and "(" in operators:
            while operators[-1] != "(":
                output.append(operators.pop())
            operators.pop()
        else:
            break
        end = m.end()
    if operand or "(" in operators:
        return None
    output += reversed(operators)
    return list(dict.fromkeys(names)), " ".join(output)


def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    phrases: dict[str, list] = {}
    for phrase, label in [*BASE.items(), *NOTICES.items(), (TAG, "")]:
        base = BASE.get(phrase)
        phrases[phrase] = [base, label, len(phrase.split())]
    for phrase, value in phrases.items():
        found.add_word(f" {phrase} ", (phrase, *value))
    found.make_automaton()
    return found


def scan_text(text: str, found) -> tuple:
    folded = text.encode().translate(_FOLD).split()
    n_words = len(folded)
    joined = f" {b' '.join(folded).decode()} "
    ends: list[int] = []
    base_hits: list[tuple[int, str]] = []
    labels: set[str] = set()
    n_method = tagged = 0
    hits = list(found.iter(joined))
    if hits:
        blanks = np.flatnonzero(np.frombuffer(joined.encode("utf-32-le"), np.uint32) == 32)
        ends = np.searchsorted(blanks, [e for e, _ in hits]).tolist()
    for end, (_, (phrase, base, label, size)) in zip(ends, hits, strict=True):
        if base:
            base_hits.append((end - size, base))
        else:
            n_method += 1
        if phrase == TAG:
            tagged += 1
        else:
            labels.add(label)
    expressions: list[str] = []
    required: set[str] = set()
    strictest, sure = 0, 0
    if tagged:
        tags = list(_TAG_TEXT.finditer(text))
        stops = [m.start() for m in tags[1:]] + [len(text)]
        for m, stop in zip(tags, stops, strict=True):
            # up to the line's end or the next tag, whichever is first
            if end := _LINE_END.search(text, m.end(), stop):
                stop = end.start()
            if parsed := parse_expression(text[m.end() : stop]):
                labels.update(parsed[0])
                expressions.append(parsed[1])
                needed, strict = evaluate(parsed[1].split(" "))
                required |= needed
                strictest = max(strictest, strict)
                sure += bool(needed)
    evidence = len(base_hits) + n_method + len(expressions) + sure
    places = [p for p, _ in base_hits]
    return (
        n_words,
        len(base_hits),
        min(places, default=None),
        max(places, default=None),
        ",".join(sorted({b for _, b in base_hits})),
        ",".join(sorted(labels)),
        1.0 - 0.5**evidence,
        n_method,
        "; ".join(expressions),
        ",".join(sorted(required)),
        GRADES[strictest] if expressions else None,
    )


def _scanned(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = automaton()
    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
    fields = [part.split() for part in SCHEMA.split(", ")]
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [scan_text(t.as_py() or "", found) for t in batch.column(1)]
        columns = [batch.column(0).to_pylist(), *zip(*rows, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields]
        )


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: base phrase places, labels and licence expressions.

    A null or empty text has no words, no places (null first and last), empty labels and
    score 0; a null doc_id stays null; repeated rows give repeated results; other columns
    are ignored. ``labels`` has every licence named, ``required`` those that the expressions
    cannot be met without, ``verdict`` the grade of what all expressions ask together (null
    without any). ``score`` is 1 - 2**-evidence: one for each phrase, tag and expression, and
    one more for an expression that leaves no choice of all its licences."""
    narrow = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    return map_batches(narrow, _scanned, SCHEMA)
