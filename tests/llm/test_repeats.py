import hashlib
import random

import numpy as np
import pytest
from rows import AWKWARD, FOLDER, WORD, frame, table_docs, write_docs

from voxlake.llm import automata, repeats, suffixes
from voxlake.llm.catalog import op1_substring_automata, op3_suffix_repeats


def brute_words(rows, span=50):
    first, words = {}, {}
    for n, (d, t) in enumerate(rows):
        w = words[n] = WORD.findall(t or "")
        for i in range(len(w) - span + 1):
            k = tuple(w[i : i + span])
            first[k] = min(d, first.get(k, d))
    out = []
    for n, (d, _) in enumerate(rows):
        w, keep = words[n], [True] * len(words[n])
        for i in range(len(w) - span + 1):
            if first[tuple(w[i : i + span])] < d:
                keep[i : i + span] = [False] * span
        left = " ".join(x for x, k in zip(w, keep) if k)
        out.append((d, len(w), keep.count(False), hashlib.sha256(left.encode()).hexdigest()))
    return sorted(out)


def brute_bytes(rows, span=400):
    count, data = {}, [(t or "").encode() for _, t in rows]
    for b in data:
        for i in range(len(b) - span + 1):
            k = hash(b[i : i + span])
            count[k] = count.get(k, 0) + 1
    out = []
    for (d, _), b in zip(rows, data):
        keep = np.ones(len(b), bool)
        for i in range(len(b) - span + 1):
            if count[hash(b[i : i + span])] > 1:
                keep[i : i + span] = False
        edges = np.diff(np.concatenate([[True], keep]).astype(int))
        left = np.frombuffer(b, np.uint8)[keep].tobytes()
        out.append((d, len(b), int((~keep).sum()), int((edges < 0).sum()), hashlib.sha256(left).hexdigest()))
    return sorted(out)


def words_of(df):
    return sorted(tuple(r) for r in df.select("doc_id", "n_units", "n_removed", "kept_sha256").collect())


def bytes_of(df):
    return sorted(tuple(r) for r in df.select("doc_id", "n_units", "n_removed", "n_spans", "kept_sha256").collect())


@pytest.fixture(scope="module")
def pieced():
    """Texts put together from shared pieces, so that repeats begin and end everywhere."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(40)]
    pieces = [[rng.choice(vocabulary) for _ in range(rng.randint(5, 90))] for _ in range(25)]
    rows = []
    for d in range(70):
        w = [x for _ in range(rng.randint(1, 6)) for x in (rng.choice(pieces) if rng.random() < 0.7 else [rng.choice(vocabulary) for _ in range(rng.randint(1, 60))])]
        rows.append((d * 3, " ".join(w)))
    return rows + [(500, rows[0][1]), (7, rows[0][1]), (501, " ".join(["a"] * 300)), (502, " ".join(["a"] * 200)), (503, "x " + "b " * 400)]


@pytest.mark.parametrize("hot", [512, 3])
def test_words_are_brute_force(spark, pieced, hot):
    df = frame(spark, [(d, t, "s") for d, t in pieced])
    assert words_of(automata.remove_earlier_passages(df, hot=hot)) == brute_words(pieced)


@pytest.mark.parametrize("hot", [512, 3])
def test_bytes_are_brute_force(spark, pieced, hot):
    df = frame(spark, [(d, t, "s") for d, t in pieced])
    assert bytes_of(suffixes.remove_repeated_bytes(df, span=150, gram=20, hot=hot)) == brute_bytes(pieced, 150)


def test_queries_are_brute_force(spark):
    rows = table_docs()
    got = op1_substring_automata(spark, FOLDER).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_words(rows)
    got = op3_suffix_repeats(spark, FOLDER).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_bytes(rows)
    assert sum(r.n_removed > 0 for r in got) > 3


def test_awkward_rows(spark, folder):
    rows = [(d, t) for d, t, _ in AWKWARD]
    assert words_of(automata.remove_earlier_passages(frame(spark))) == brute_words(rows)
    assert bytes_of(suffixes.remove_repeated_bytes(frame(spark))) == brute_bytes(rows)
    empty = frame(spark).limit(0)
    assert automata.remove_earlier_passages(empty).count() == 0 and suffixes.remove_repeated_bytes(empty).count() == 0
    twice = frame(spark, AWKWARD + AWKWARD[10:12])
    assert automata.remove_earlier_passages(twice).count() == len(AWKWARD) + 2
    no_id = frame(spark, [(None, "q " * 60, "s"), (3, "q " * 60, "s")])
    assert {r.doc_id: r.n_removed for r in automata.remove_earlier_passages(no_id).collect()} == {None: 60, 3: 0}
    kept = automata.remove_earlier_passages(frame(spark, [(1, "q " * 60, "s"), (2, "q " * 60 + "end", "s")])).orderBy("doc_id").collect()
    assert [r.kept for r in kept] == [None, "end"]
    assert op1_substring_automata(spark, write_docs(spark, folder, rows)).count() == len(rows)


def test_automaton_statistics():
    rng = random.Random(1)
    for _ in range(60):
        known = [[rng.choice("ab") for _ in range(rng.randint(1, 12))] for _ in range(rng.randint(1, 4))]
        asked = [rng.choice("abc") for _ in range(15)]
        auto = automata.SuffixAutomaton()
        for k in known:
            auto.add(k)
        parts = {tuple(k[i:j]) for k in known for i in range(len(k)) for j in range(i, len(k) + 1)}
        want = [max(n for n in range(j + 2) if tuple(asked[j + 1 - n : j + 1]) in parts or n == 0) for j in range(len(asked))]
        assert auto.statistics(asked) == want


def test_quicksort_and_anchors():
    rng = random.Random(2)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 20))) for _ in range(200)]
    assert [strings[i] for i in suffixes.multikey_quicksort(strings, 3)] == sorted(strings)
    codes = np.random.default_rng(3).integers(1, 1 << 63, 5000, dtype=np.uint64)
    places, hashes = repeats.anchors(codes, 50, 10)
    assert np.diff(places).max() <= 41 and places[0] <= 40
    moved, same = repeats.anchors(codes[777:], 50, 10)
    inner = places[places >= 777 + 50]
    assert set(inner) <= set(moved + 777)
    repeats_slice, repeats.SLICE = repeats.SLICE, 300
    try:
        assert (repeats.anchors(codes, 50, 10)[0] == places).all()
    finally:
        repeats.SLICE = repeats_slice


def ranges_by_pairs(contexts, span):
    """What the byte matcher has to find for one anchor, from all pairs of contexts."""
    out = []
    for i, (_, at, body, places) in enumerate(contexts):
        keep = [places > 1 and len(body) >= span] * len(body)
        for j, (_, other, text, _) in enumerate(contexts):
            for start in range(len(body) - span + 1):
                begin = start - at + other
                if i != j and begin >= 0 and body[start : start + span] == text[begin : begin + span]:
                    keep[start : start + span] = [True] * span
        out.append([k for k, x in enumerate(keep) if x])
    return out


@pytest.mark.parametrize("paired", [512, 4, 0])
def test_many_anchors_are_matched_at_once(monkeypatch, paired):
    """The contexts of all anchors of a batch are sorted together, once to the right and once to the left."""
    rng, calls, plain = random.Random(8), [], suffixes.sorted_prefixes
    monkeypatch.setattr(suffixes, "PAIRED", paired)
    monkeypatch.setattr(suffixes, "sorted_prefixes", lambda *a: calls.append(1) or plain(*a))
    span, reach = 30, 22
    text = lambda n: bytes(rng.choice(b"a\0") for _ in range(n))
    groups = []
    for _ in range(150):
        gram, sides = text(8), [(text(rng.randint(0, reach)), text(rng.randint(0, reach))) for _ in range(rng.randint(1, 4))]
        own = []
        for d in range(rng.randint(1, 12)):
            left, right = rng.choice(sides)[0], rng.choice(sides)[1]
            left, right = (left[rng.randint(0, 3) :], right[: rng.randint(10, reach)]) if rng.random() < 0.5 else (left, right)
            own.append((d, len(left), left + gram + right, rng.choice([1, 1, 1, 2])))
        groups.append(own)
    groups.append([(d, reach, b"\0" * (reach + 8 + d % 23), 1) for d in range(40)])
    found = suffixes.repeated_bytes(span)(groups)
    assert len(calls) == 2
    got = [[sorted({k for a, b in ranges for k in range(a, b)}) for ranges in own] for own in found]
    assert got == [ranges_by_pairs(_counted(own), span) for own in groups]
    assert sum(bool(x) for own in got for x in own) > 100


def _counted(contexts):
    """Equal contexts count as one with the places of all."""
    places = {}
    for _, at, body, n in contexts:
        places[at, body] = places.get((at, body), 0) + n
    return [(d, at, body, places[at, body]) for d, at, body, _ in contexts]


def test_shared_prefixes_of_places_in_order():
    rng = random.Random(4)
    for token in (1, 3, 8):
        strings = [bytes(rng.choice(b"\0\xff") for _ in range(rng.randint(0, 25))) for _ in range(120)]
        group = np.sort(np.array([rng.randint(0, 9) for _ in strings]))
        order, shared = suffixes.sorted_prefixes(group, strings, token)
        assert [(group[i], strings[i]) for i in order] == sorted(zip(group.tolist(), strings))
        for p in range(119):
            a, b = strings[order[p]], strings[order[p + 1]]
            if group[p] == group[p + 1]:
                common = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
                assert min(shared[p], len(a), len(b)) == common
