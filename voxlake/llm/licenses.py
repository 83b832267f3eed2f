"""License notices: templates with optional and replaceable regions, compiled into token automata."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
MARK = re.compile(r"<<(/?)(optional|var)(?: (\d+))?>>|([^\s<>]+)")

#: Phrases of the base labels.
PHRASES = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}
#: Notices in template markup: <<optional>>..<</optional>> may be missing, <<var N>> stands for up to N words.
TEMPLATES = {
    "apache-2.0": ["licensed under the apache license <<optional>>version<</optional>> 2 <<optional>>0<</optional>>"],
    "bsd": ["redistribution and use in source and binary forms <<optional>>with or without modification<</optional>> are permitted <<optional>>provided that the following conditions are met<</optional>>"],
    "cc-by-nc": ["<<optional>>licensed under<</optional>> cc by nc <<optional>>sa<</optional>> <<optional>>4 0<</optional>>"],
    "cc-by-sa": ["<<optional>>licensed under<</optional>> cc by sa <<optional>>4 0<</optional>>"],
    "copyright": ["copyright <<optional>>c<</optional>> <<var 6>> all rights reserved"],
    "gpl-version": ["gnu <<optional>>affero<</optional>> general public license <<optional>>v3<</optional>> <<optional>>as published by the free software foundation<</optional>> <<optional>>either<</optional>> version <<var 1>>"],
    "lgpl": ["gnu lesser general public license"],
    "mit": ["<<optional>>released<</optional>> under the <<optional>>terms of the<</optional>> mit license",
            "permission is hereby granted free of charge to any person obtaining a copy of this <<var 3>> and associated documentation files"],
    "spdx": ["spdx license identifier <<var 3>>"],
}


@dataclass
class Automaton:
    """States with word edges, edges for any word, and free edges; the last state accepts."""

    words: list[dict[bytes, int]] = field(default_factory=lambda: [{}])
    any_word: dict[int, int] = field(default_factory=dict)
    free: dict[int, list[int]] = field(default_factory=dict)

    def grow(self) -> int:
        self.words.append({})
        return len(self.words) - 1

    def closure(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for to in self.free.get(todo.pop(), ()):
                if to not in states:
                    states.add(to)
                    todo.append(to)
        return states

    def first(self) -> set[bytes]:
        """Words that a match can begin with (no template begins with a replaceable region)."""
        return {w for s in self.closure({0}) for w in self.words[s]}

    def longest(self, tokens: list[bytes], at: int) -> int:
        """End of the longest match that begins at ``at``; -1 if there is none. The live states are bounded by
        the template, so a text is read in linear time."""
        live, end, last = self.closure({0}), -1, len(self.words) - 1
        while live:
            if last in live:
                end = at
            if at == len(tokens):
                break
            word, at = tokens[at], at + 1
            step = {self.words[s][word] for s in live if word in self.words[s]} | {self.any_word[s] for s in live if s in self.any_word}
            live = self.closure(step)
        return end


def compile_template(markup: str) -> Automaton:
    """The automaton of a template; markup that isn't balanced is refused."""
    auto, here, opened = Automaton(), 0, []
    for close, kind, count, word in MARK.findall(markup):
        if word:
            nxt = auto.grow()
            auto.words[here][word.lower().encode()] = nxt
            here = nxt
        elif kind == "var":
            begin = here
            for _ in range(int(count or 1)):
                nxt = auto.grow()
                auto.any_word[here] = nxt
                here = nxt
                auto.free.setdefault(begin, []).append(here)
            end = auto.grow()  # a replaceable region may hold fewer words than it allows
            for s in range(begin, end):
                auto.free.setdefault(s, []).append(end)
            here = end
        elif not close:
            nxt = auto.grow()
            auto.free.setdefault(here, []).append(nxt)
            opened.append(here)
            here = nxt
        else:
            if not opened:
                raise ValueError(f"nothing to close in {markup!r}")
            nxt = auto.grow()
            auto.free.setdefault(here, []).append(nxt)
            auto.free.setdefault(opened.pop(), []).append(nxt)
            here = nxt
    if opened:
        raise ValueError(f"an optional region stays open in {markup!r}")
    return auto


class Scanner:
    """All templates and phrases at once."""

    def __init__(self, templates: dict[str, list[str]], phrases: dict[str, str]) -> None:
        self.phrases = {label: [w.encode() for w in phrase.split()] for label, phrase in phrases.items()}
        self.starts: dict[bytes, list[tuple[str, Automaton]]] = {}
        for label, forms in templates.items():
            for form in forms:
                auto = compile_template(form)
                for word in auto.first():
                    self.starts.setdefault(word, []).append((label, auto))
        self.wanted = set(self.starts) | {words[0] for words in self.phrases.values()}

    def scan(self, text: str) -> tuple[int, list[tuple[str, int]], list[tuple[str, int, int]]]:
        """Number of words, places of phrases, and spans (label, first word, end) of accepted templates."""
        tokens = WORD.findall(text.encode("utf-8", "surrogatepass").lower())
        if self.wanted.isdisjoint(tokens):
            return len(tokens), [], []
        places, spans = [], []
        for at, token in enumerate(tokens):
            if token not in self.wanted:
                continue
            places += [(label, at) for label, words in self.phrases.items() if words[0] == token and tokens[at : at + len(words)] == words]
            for label, auto in self.starts.get(token, ()):
                if (end := auto.longest(tokens, at)) > at:
                    spans.append((label, at, end))
        return len(tokens), places, spans


SCAN_TYPE = pa.schema([
    ("id", pa.int64()), ("n_words", pa.int64()), ("places", pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))),
    ("spans", pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64())]))),
])


def scan_licenses(
    docs: DataFrame, templates: dict[str, list[str]] | None = None, phrases: dict[str, str] | None = None,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per document: ``id_col, n_words, places, spans``.

    Words are runs of ASCII letters and digits and of characters outside ASCII, with A-Z in lower case.
    ``places`` lists where the words of a phrase stand one after the other; ``spans`` lists the texts that a
    template accepts: every mandatory word has to be there exactly, optional regions may be missing,
    replaceable ones hold any words up to their number. From one start the longest match counts; spans of
    several labels may overlap. Null and empty texts have no words; repeated rows give repeated rows; an
    empty table gives none. Nothing is shuffled.
    """
    made, named = templates or TEMPLATES, phrases or PHRASES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(made, named)
        for batch in batches:
            found = [scanner.scan(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column(0),
                pa.array([n for n, _, _ in found], pa.int64()),
                pa.array([[{"label": a, "word": b} for a, b in p] for _, p, _ in found], SCAN_TYPE.field("places").type),
                pa.array([[{"label": a, "first": b, "end": c} for a, b, c in s] for _, _, s in found], SCAN_TYPE.field("spans").type),
            ], schema=SCAN_TYPE)

    schema = f"{id_col} long, n_words long, places array<struct<label:string,word:long>>, spans array<struct<label:string,first:long,end:long>>"
    return docs.select(docs[id_col].cast("long"), docs[text_col]).mapInArrow(run, schema)
