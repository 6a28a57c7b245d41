"""Licence scans: notices and identifier tags by Aho-Corasick, licence expressions by shunting-yard.

A text becomes its words, joined by single spaces, and one pass of the automaton finds every
phrase. Where an identifier tag stands, the expression after it is parsed: operators go through
a stack by their rank, ids become operands, and the result is evaluated.

A null or empty text has no words, no places, empty labels and score 0. Texts of any length are
scanned whole; phrases may overlap. Repeated rows give repeated results.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomset.llm.workers import map_batches, per_worker, texts_of

# The phrases that count as base places.
BASE_PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}

# Phrases of notices: label and how sure one makes us.
NOTICES = {
    "lesser general public license": ("lgpl", 0.9),
    "library general public license": ("lgpl", 0.9),
    "affero general public license": ("agpl", 0.9),
    "gnu gpl": ("gpl", 0.8),
    "permission is hereby granted free of charge": ("mit", 0.8),
    "licensed under the mit": ("mit", 0.8),
    "licensed under the apache": ("apache", 0.8),
    "apache software license": ("apache", 0.8),
    "mozilla public license": ("mpl", 0.9),
    "eclipse public license": ("epl", 0.9),
    "bsd license": ("bsd", 0.9),
    "redistribution and use in source and binary forms": ("bsd", 0.8),
    "isc license": ("isc", 0.9),
    "boost software license": ("bsl", 0.9),
    "creative commons attribution": ("cc-by", 0.7),
    "cc by": ("cc-by", 0.7),
    "cc by sa": ("cc-by-sa", 0.9),
    "cc by nc": ("cc-by-nc", 0.9),
    "cc by nd": ("cc-by-nd", 0.9),
    "cc by nc sa": ("cc-by-nc-sa", 0.9),
    "cc by nc nd": ("cc-by-nc-nd", 0.9),
    "cc0": ("cc0", 0.8),
    "released into the public domain": ("public-domain", 0.8),
    "all rights reserved": ("proprietary", 0.5),
}
TAG = "spdx license identifier"
_BASE_SURE = 0.8

# Id prefixes of expressions, longest first where one starts another: label, free to reuse.
FAMILIES = {
    "agpl": ("agpl", False),
    "lgpl": ("lgpl", False),
    "gpl": ("gpl", False),
    "mit": ("mit", True),
    "apache": ("apache", True),
    "bsd": ("bsd", True),
    "0bsd": ("bsd", True),
    "isc": ("isc", True),
    "mpl": ("mpl", False),
    "epl": ("epl", False),
    "bsl": ("bsl", True),
    "cc0": ("cc0", True),
    "cc-by-nc-sa": ("cc-by-nc-sa", False),
    "cc-by-nc-nd": ("cc-by-nc-nd", False),
    "cc-by-nc": ("cc-by-nc", False),
    "cc-by-sa": ("cc-by-sa", False),
    "cc-by-nd": ("cc-by-nd", False),
    "cc-by": ("cc-by", True),
    "unlicense": ("public-domain", True),
}
_RANK = {"or": 1, "and": 2, "with": 3}
_TOKEN = re.compile(r"[()]|[A-Za-z0-9][A-Za-z0-9.+:-]*|\S")
_TAG_LINE = re.compile(r"spdx-license-identifier[ \t]*:[ \t]*([^\r\n]*)", re.I)

# Bytes of words after lower-casing A-Z: digits, a-z and everything beyond ASCII.
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_FOLD).split()


@dataclass
class Expression:
    """An evaluated licence expression."""

    text: str
    valid: bool
    labels: list[str]
    free: bool


def family(name: str) -> tuple[str, bool] | None:
    name = name.lower()
    for prefix in sorted(FAMILIES, key=len, reverse=True):
        if name == prefix or name.startswith((prefix + "-", prefix + "+")):
            return FAMILIES[prefix]
    return None


def to_postfix(text: str) -> list[str]:
    """Operands and operators in postfix order; raises ValueError on a malformed expression."""
    output: list[str] = []
    waiting: list[str] = []
    operand_next = True
    for token in _TOKEN.findall(text):
        word = token.lower()
        if word in _RANK:
            if operand_next:
                raise ValueError("an operand is missing")
            while waiting and waiting[-1] != "(" and _RANK[waiting[-1]] >= _RANK[word]:
                output.append(waiting.pop())
            waiting.append(word)
            operand_next = True
        elif token == "(":
            if not operand_next:
                raise ValueError("an operator is missing")
            waiting.append(token)
        elif token == ")":
            if operand_next:
                raise ValueError("an operand is missing")
            while waiting and waiting[-1] != "(":
                output.append(waiting.pop())
            if not waiting:
                raise ValueError("a bracket is not open")
            waiting.pop()
        elif token[0].isalnum():
            if not operand_next:
                raise ValueError("an operator is missing")
            output.append(token)
            operand_next = False
        else:
            raise ValueError(f"unexpected {token}")
    if operand_next or "(" in waiting:
        raise ValueError("the expression is cut off")
    return output + waiting[::-1]


def evaluate(text: str) -> Expression:
    """Labels of an expression and whether its terms leave reuse free: ``or`` leaves the choice,
    ``and`` binds to both, an exception after ``with`` changes neither."""
    text = re.sub(r"\s*(\*/|-->|#+|\*+)\s*$", "", text.strip())
    try:
        postfix = to_postfix(text)
    except ValueError:
        known = {f[0] for f in map(family, re.findall(r"[A-Za-z0-9][\w.+-]*", text)) if f}
        return Expression(text, False, sorted(known), False)
    stack: list[tuple[frozenset[str], bool]] = []
    for token in postfix:
        if token in _RANK:
            (right, right_free), (left, left_free) = stack.pop(), stack.pop()
            if token == "with":
                stack.append((left, left_free))
            else:
                free = left_free or right_free if token == "or" else left_free and right_free
                stack.append((left | right, free))
        else:
            found = family(token)
            stack.append((frozenset([found[0]]), found[1]) if found else (frozenset(), False))
    labels, free = stack.pop()
    return Expression(text, True, sorted(labels), free)


def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for phrase in {*BASE_PHRASES, *NOTICES, TAG}:
        found.add_word(f" {phrase} ", phrase)
    found.make_automaton()
    return found


@dataclass
class Scan:
    n_words: int
    places: list[tuple[str, str, int]]  # kind, label, first word
    expressions: list[Expression]

    @property
    def base(self) -> list[tuple[str, int]]:
        return [(label, word) for kind, label, word in self.places if kind == "base"]

    @property
    def labels(self) -> list[str]:
        found = {label for _, label, _ in self.places}
        return sorted(found.union(*(e.labels for e in self.expressions)))


def scan_text(text: str) -> Scan:
    words = words_of(text)
    if not words:
        return Scan(0, [], [])
    joined = " " + b" ".join(words).decode() + " "
    places: list[tuple[str, str, int]] = []
    counted, at = -1, 0  # spaces in joined[:at], less one: the number of the word at ``at``
    tagged = False
    hits = [
        (end - len(phrase) - 1, phrase)
        for end, phrase in per_worker("license phrases", _automaton).iter(joined)
    ]
    for start, phrase in sorted(hits):
        counted += joined.count(" ", at, start + 1)
        at = start + 1
        if phrase in BASE_PHRASES:
            places.append(("base", BASE_PHRASES[phrase], counted))
        elif phrase in NOTICES:
            places.append(("notice", NOTICES[phrase][0], counted))
        else:
            tagged = True
            places.append(("tag", "spdx", counted))
    expressions = [evaluate(m[1]) for m in _TAG_LINE.finditer(text)] if tagged else []
    return Scan(len(words), [p for p in places if p[0] != "tag"], expressions)


_SURE = {label: sure for label, sure in NOTICES.values()}


def score(scan: Scan) -> float:
    """How sure it is that the text states a licence: each kind of evidence counts once."""
    doubt = 1.0
    for kind, label in sorted({(kind, label) for kind, label, _ in scan.places}):
        doubt *= 1 - (_BASE_SURE if kind == "base" else _SURE[label])
    for valid in {e.valid for e in scan.expressions if e.labels}:
        doubt *= 1 - (0.95 if valid else 0.6)
    return 1 - doubt


def scan_licenses(df: DataFrame, text: str = "text", *keep: str) -> DataFrame:
    """``keep`` and, for every row, ``n_words``, ``places`` (kind, label, word), ``expressions``
    (expression, valid, labels, free), ``labels`` and ``score``. One pass without a shuffle."""
    kept = [f for f in df.schema.fields if f.name in keep]
    columns = [F.col(f"`{f.name}`").alias(f"k{i}") for i, f in enumerate(kept)]
    place = pa.struct([("kind", pa.string()), ("label", pa.string()), ("word", pa.int64())])
    parsed = pa.struct(
        [
            ("expression", pa.string()),
            ("valid", pa.bool_()),
            ("labels", pa.list_(pa.string())),
            ("free", pa.bool_()),
        ]
    )

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        scans = [scan_text(t) for t in texts_of(batch.column(0))]
        fields = ("kind", "label", "word")
        arrays = [
            pa.array([s.n_words for s in scans], pa.int64()),
            pa.array(
                [[dict(zip(fields, p, strict=True)) for p in s.places] for s in scans],
                pa.list_(place),
            ),
            pa.array(
                [
                    [
                        {"expression": e.text, "valid": e.valid, "labels": e.labels, "free": e.free}
                        for e in s.expressions
                    ]
                    for s in scans
                ],
                pa.list_(parsed),
            ),
            pa.array([s.labels for s in scans], pa.list_(pa.string())),
            pa.array(map(score, scans), pa.float64()),
        ]
        names = ["n_words", "places", "expressions", "labels", "score"]
        return pa.RecordBatch.from_arrays(
            [*batch.columns[1:], *arrays], [*batch.schema.names[1:], *names]
        )

    schema = ", ".join(
        [
            *(f"k{i} {f.dataType.simpleString()}" for i, f in enumerate(kept)),
            "n_words bigint",
            "places array<struct<kind:string,label:string,word:bigint>>",
            "expressions array<struct<expression:string,valid:boolean,labels:array<string>,free:boolean>>",
            "labels array<string>",
            "score double",
        ]
    )
    result = map_batches(df.select(F.col(f"`{text}`").alias("text"), *columns), work, schema)
    names = [*(f.name for f in kept), *result.columns[len(kept) :]]
    return result.toDF(*names)


def license_report(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document with its base places counted and all labels joined."""
    scanned = scan_licenses(df.select(key, text), text, key)
    base = F.filter("places", lambda p: p["kind"] == "base")
    words = F.transform("_base", lambda p: p["word"])
    return scanned.withColumn("_base", base).select(
        key,
        "n_words",
        F.size("_base").cast("bigint").alias("n_base"),
        F.array_min(words).alias("first_word"),
        F.array_max(words).alias("last_word"),
        F.array_join(
            F.array_sort(F.array_distinct(F.transform("_base", lambda p: p["label"]))), ","
        ).alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
        F.col("expressions.expression").alias("expressions"),
    )
