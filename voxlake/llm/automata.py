"""Substring deduplication with suffix automata of earlier documents' passages."""

from __future__ import annotations

from functools import cached_property
from itertools import compress, groupby

import numpy as np
from pyspark.sql import DataFrame

from voxlake.llm.repeats import Context, Ranges, Unit, find_repeats
from voxlake.llm.wordcodes import word_codes


class SuffixAutomaton:
    """All substrings of the token sequences added so far."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]

    def _state(self, length: int, edges: dict, link: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, p: int, q: int, token: object) -> int:
        """A copy of state q for the strings that end where p goes on by ``token``."""
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = clone
            p = self.link[p]
        return clone

    def add(self, tokens: list) -> None:
        last = 0
        for token in tokens:
            known = self.next[last].get(token)
            if known is not None:  # seen in an earlier sequence
                last = known if self.length[known] == self.length[last] + 1 else self._split(last, known, token)
                continue
            here = self._state(self.length[last] + 1, {}, 0)
            p = last
            while p >= 0 and token not in self.next[p]:
                self.next[p][token] = here
                p = self.link[p]
            if p >= 0:
                q = self.next[p][token]
                self.link[here] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, token)
            last = here

    def statistics(self, tokens: list) -> list[int]:
        """For every position the length of the longest known string that ends there."""
        state, size, out = 0, 0, []
        for token in tokens:
            while state and token not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if token in self.next[state]:
                state, size = self.next[state][token], size + 1
            out.append(size)
        return out


def earlier_matches(span: int):
    """A matcher: for the contexts (document, anchor, words) of an anchor, the ranges of words in strings of
    ``span`` words that a smaller document's contexts hold. The shard's automaton grows document by document."""

    def match(contexts: list[Context]) -> list[Ranges]:
        first: dict[bytes, int] = {}
        for doc, _, body, _ in contexts:
            first[body] = min(doc, first.get(body, doc))
        shard, known = SuffixAutomaton(), 0
        out: list[Ranges] = [[] for _ in contexts]
        order = sorted(range(len(contexts)), key=lambda i: contexts[i][0])
        for doc, own in groupby(order, key=lambda i: contexts[i][0]):
            new = {}
            for i in own:
                body = contexts[i][2]
                words = body.split(b" ")
                if first[body] < doc:
                    out[i] = [(0, len(words))] if len(words) >= span else []
                    continue
                if known:
                    out[i] = [(j + 1 - span, j + 1) for j, size in enumerate(shard.statistics(words)) if size >= span]
                new[body] = words
            if len(first) > 1:
                for words in new.values():
                    shard.add(words)
                    known += 1
        return out

    return lambda groups: [match(contexts) for contexts in groups]


class _Words:
    """A text's bytes, and its words where they are asked for."""

    def __init__(self, data: bytes) -> None:
        self.data = data

    @cached_property
    def words(self) -> list[bytes]:
        return self.data.split()  # white space of bytes is \x20 and \x09-\x0D

    def join(self, keep: np.ndarray | None) -> bytes:
        return b" ".join(self.words if keep is None else compress(self.words, keep.tolist()))


def word_unit(span: int, gram: int) -> Unit:
    def read(text: str) -> tuple[np.ndarray, _Words]:
        data = text.encode("utf-8", "surrogatepass")
        return word_codes(data), _Words(data)

    return Unit(span, gram, read, lambda parsed, a, b: b" ".join(parsed.words[a:b]), lambda parsed, keep: parsed.join(keep))


def remove_earlier_passages(docs: DataFrame, span: int = 50, gram: int = 10, hot: int = 16384, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """One row per document: ``id_col, n_units`` (words), ``n_removed, n_spans, kept_sha256, removed`` and, with
    ``keep_text``, ``kept``: its words without those in strings of ``span`` words that also occur in a document
    with a smaller id, joined by single spaces (null where nothing is removed).

    Suffix automata of reference shards stream the documents for matching statistics. All documents are
    reference, so a broadcast of the automata would grow with the corpus. Instead the anchors of ``repeats``
    route the passages that can match to shards, and a shard's automaton is built where its passages are, in
    the order of the ids: each passage is first matched with the smaller documents and then added.

    Null and empty texts have no words; strings are judged on the input; rows with equal ids don't match one
    another, and a missing id counts as the largest; repeated rows give repeated rows; an empty table none.
    """
    return find_repeats(docs, word_unit(span, gram), earlier_matches(span), True, False, hot, id_col, text_col, keep_text)


SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), windows AS (
  SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) AS h
  FROM d, LATERAL (SELECT unnest(range(1, len(w) - 48)) AS i) WHERE len(w) >= 50
), firsts AS (SELECT h, min(doc_id) AS first FROM windows GROUP BY h
), gone AS (
  SELECT DISTINCT doc_id, i + k AS p
  FROM (SELECT doc_id, i FROM windows JOIN firsts USING (h) WHERE first < doc_id), (SELECT unnest(range(0, 50)) AS k)
), words AS (
  SELECT doc_id, p, w[p] AS word, g.p IS NOT NULL AS removed
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d) LEFT JOIN gone g USING (doc_id, p)
), runs AS (
  SELECT *, removed AND NOT coalesce(lag(removed) OVER (PARTITION BY doc_id ORDER BY p), FALSE) AS begins FROM words
), sums AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE removed) AS n_removed, count(*) FILTER (WHERE begins) AS n_spans,
    sha256(coalesce(string_agg(word, ' ' ORDER BY p) FILTER (WHERE NOT removed), '')) AS kept_sha256
  FROM runs GROUP BY doc_id
)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(kept_sha256, sha256('')) AS kept_sha256, coalesce(n_spans, 0) AS n_spans
FROM documents LEFT JOIN sums USING (doc_id)
"""
