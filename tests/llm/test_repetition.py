"""Quality rules and periodic runs: kernels and operators against plain versions."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lakewarden.llm import periodic, repetition
from lakewarden.llm.queries import _with_periods, op13_periodic_runs
from lakewarden.llm.wordids import match_lengths, numbered_words

LETTERS = [chr(97 + k) for k in range(26)]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def some_texts(seed, texts=6, longest=60):
    draw = random.Random(seed)
    for _ in range(texts):
        words = [draw.choice(LETTERS[: draw.choice([1, 2, 3, 5, 26])]) for _ in range(draw.randint(0, longest))]
        if draw.random() < 0.5 and words:
            words[20:20] = words[: draw.randint(1, 6)] * draw.randint(1, 8)
        yield words


def plain_runs(words):
    """Every period tried at every place."""
    found = {}
    for p in range(1, len(words) // 4 + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j > i and j - i + p >= max(6, 4 * p):
                found.setdefault((i, j - i + p), p)
            i = max(j, i + 1)
    return sorted((s, n, p) for (s, n), p in found.items())


def plain_collapse(words):
    dropped = {k for s, n, p in plain_runs(words) for k in range(s + p, s + n)}
    return " ".join(w for k, w in enumerate(words) if k not in dropped)


def runs_of(texts, limit=1 << 18, pairs=1 << 20):
    out = [[] for _ in texts]
    for row, _, _, numbers, first in numbered_words(pa.array([" ".join(t) for t in texts], pa.string()), limit):
        for text, *run in zip(*(x.tolist() for x in periodic.find_runs(numbers, first, pairs)), strict=True):
            out[row + text].append(tuple(run))
    return out


@pytest.mark.parametrize("seed", range(25))
def test_runs_equal_a_plain_search(seed):
    texts = list(some_texts(seed))
    assert runs_of(texts) == runs_of(texts, limit=20) == runs_of(texts, pairs=3) == [plain_runs(t) for t in texts]


def test_runs_of_one_word_and_of_long_periods():
    unit = [f"w{k}" for k in range(500)]
    texts = [["a"] * 20_000, unit * 4, unit * 3, ["a"] * 5, ["a"] * 6, ["a", "b"] * 3, ["a", "b"] * 4, unit * 40]
    assert runs_of(texts) == [[(0, 20_000, 1)], [(0, 2000, 500)], [], [], [(0, 6, 1)], [], [(0, 8, 2)], [(0, 20_000, 500)]]


def test_runs_stay_right_when_every_hash_agrees(monkeypatch):
    monkeypatch.setattr(periodic, "word_sums", lambda numbers: np.zeros(len(numbers) + 1, dtype=np.uint64))
    texts = [t for seed in range(12) for t in some_texts(seed)]
    assert runs_of(texts) == [plain_runs(t) for t in texts]


def test_match_lengths_by_comparison():
    draw = np.random.default_rng(1)
    numbers = np.concatenate([np.tile([1, 2, 3], 200), draw.integers(0, 3, 400)])
    a, b = draw.integers(0, 900, 300), draw.integers(0, 900, 300)
    a, b = a[a != b], b[a != b]

    def plain(x, y):
        k = 0
        while max(x, y) + k < len(numbers) and numbers[x + k] == numbers[y + k]:
            k += 1
        return k

    assert match_lengths(numbers, a, b, cells=64).tolist() == [plain(x, y) for x, y in zip(a, b, strict=True)]


@pytest.mark.parametrize("seed", range(25))
def test_suffix_array_and_maximal_repeats_equal_a_plain_search(seed):
    texts = list(some_texts(seed, texts=3, longest=40))
    ((_, _, _, numbers, _),) = numbered_words(pa.array([" ".join(t) for t in texts], pa.string()))
    n, words = len(numbers), numbers.tolist()
    order = repetition.suffix_array(numbers)
    assert order.tolist() == sorted(range(n), key=lambda k: words[k:])
    found = [tuple(words[order[a] : order[a] + k]) for a, _, k in repetition.maximal_repeats(numbers, order, repetition.common_prefixes(numbers, order), 2)]
    places: dict = {}
    for k in range(2, n):
        for i in range(n - k + 1):
            places.setdefault(tuple(words[i : i + k]), []).append(i)
    expected = set()
    for repeat, at in places.items():
        right = {words[i + len(repeat)] if i + len(repeat) < n else -1 for i in at}
        left = {words[i - 1] if i else -1 for i in at}
        if len(at) > 1 and (len(right) > 1) and (len(left) > 1 or -1 in left):
            expected.add(repeat)
    assert len(found) == len(set(found)) and set(found) == expected


def plain_rules(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]

    def spread(k):
        windows: dict = {}
        for i in range(len(words) - k + 1):
            windows.setdefault(tuple(words[i : i + k]), []).append(i)
        return len({i + j for at in windows.values() if len(at) > 1 for i in at for j in range(k)})

    longest = max((k for k in range(5, len(words)) if spread(k)), default=0)
    failed = len(words) < 20 or 100 * spread(8) > 30 * len(words)
    kept = not failed and 100 * spread(5) <= 30 * len(words) and longest <= 50
    dup_lines = sum(x in lines[:k] for k, x in enumerate(lines))
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup_lines, spread(8), failed, kept, spread(5), longest)


def rule_texts():
    draw = random.Random(5)
    some = [draw.choice(LETTERS) + draw.choice(LETTERS) for _ in range(300)]
    yield from (None, "", " \n\t ", "one", "naïve £5 #tag * $ % & | < > ž", "a\nb\na\n a\na\r\n\n\n", " ".join(some))
    yield " ".join(some[:100] + some[:60] + some[100:])
    yield " ".join(some[:200] + some[:45] + some[200:])
    yield " ".join(some[:12]) + "\n" + "\n".join(" ".join(some[k : k + 6]) for k in range(12, 100, 6)) * 2
    yield " ".join(some[k % 7] for k in range(90))
    for k in range(15):
        yield " ".join(draw.choice(LETTERS[:3]) for _ in range(k * 3))


def test_rules_equal_a_plain_version(docs):
    texts = list(rule_texts())
    got = {r.doc_id: r for r in repetition.quality_rules(docs(*enumerate(texts), (0, texts[6]))).collect() if r.doc_id}
    for k, text in enumerate(texts[1:], 1):
        assert tuple(got[k])[1:10] == plain_rules(text), text
    assert {True, False} == {r.kept for r in got.values() if not r.base_failed}


def test_rules_over_odd_tables(docs, empty):
    assert repetition.quality_rules(empty).count() == 0
    long = " ".join(f"w{k}" for k in range(300_000)) + " x" * 200_000
    rows = repetition.quality_rules(docs((None, "a b"), (None, "a b"), (7, long))).orderBy("n_words").collect()
    assert [r.doc_id for r in rows] == [None, None, 7] and rows[0] == rows[1]
    assert (rows[2].n_words, rows[2].n_repeat_words, rows[2].longest_repeat, rows[2].kept) == (500_000, 200_000, 199_999, False)


def test_runs_over_odd_tables(docs, empty):
    assert periodic.runs_report(empty).count() == 0
    long = "x y z " * 100_000
    rows = periodic.periodic_runs(docs((None, None), (None, None), (3, ""), (4, long), (5, "žluť kůň " * 5 + "a"))).collect()
    assert [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in rows] == [
        (None, 0, [], ""), (None, 0, [], ""), (3, 0, [], ""), (4, 300_000, [(0, 300_000, 3)], "x y z"), (5, 11, [(0, 10, 2)], "žluť kůň a"),
    ]
    (none,) = periodic.runs_report(docs((1, None))).collect()
    blank = hashlib.sha256(b"").hexdigest()
    assert tuple(none) == (1, 0, None, None, None, None, blank, blank)


def plain_periods(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]


def test_query_of_runs_equals_a_plain_version(spark, sf_dir):
    rows = {r.doc_id: r for r in op13_periodic_runs(spark, sf_dir).collect()}
    source = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert rows.keys() == source.keys()
    for doc_id, text in source.items():
        words = plain_periods(doc_id, WORD.findall(text or ""))
        runs = plain_runs(words)
        top = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
        expected = (doc_id, len(runs), *(top or (None,) * 3), top and 1000 * top[1] // top[2], *(hashlib.sha256(x.encode()).hexdigest() for x in (lines, plain_collapse(words))))
        assert tuple(rows[doc_id]) == expected


def test_periods_are_put_in_only_where_the_id_says_so(docs):
    ids = [k for k in range(200) if zlib.crc32(str(k).encode()) % 10 == 0][:8]
    texts = [(k, " ".join(f"w{j}" for j in range(n))) for k, n in zip(ids, (1, 2, 3, 7, 20, 50, 100, 333), strict=True)]
    got = {r.doc_id: r.text for r in _with_periods(docs(*texts, (None, " a  b "), (ids[0] + 1000, None))).collect()}
    assert got[None] == " a  b " and got[ids[0] + 1000] is None
    for k, text in texts:
        assert got[k].split(" ") == plain_periods(k, text.split(" "))
