import functools
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lakewarden.llm import chat, substrings, tokens
from lakewarden.llm.setsketch import merge, similarity, sketch
from lakewarden.llm.textkernels import mix, prefix_sums, range_hash, shingle_sets
from lakewarden.llm.warc import page_of, record_id, url_key

texts = st.lists(st.text(alphabet="aAbé \t\n\x0b.x", max_size=40) | st.none(), min_size=1, max_size=8)


@settings(max_examples=60, deadline=None)
@given(texts)
def test_shingle_sets_agree_with_words(column):
    sets = [s for _, part in shingle_sets(pa.array(column, pa.string())) for s in part]
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def words(text):
        own = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(low))
        return {tuple(own[k : k + 5]) for k in range(len(own) - 4)} if len(own) >= 5 else ({tuple(own)} if own else set())

    plain = [words(t) for t in column]
    assert [len(s) for s in sets] == [len(p) for p in plain]
    for i, a in enumerate(plain):
        for j, b in enumerate(plain):
            assert len(np.intersect1d(sets[i], sets[j])) == len(a & b)


def test_range_hash_depends_on_bytes_alone():
    data = np.frombuffer(b"xxhello--hello", dtype=np.uint8)
    sums = prefix_sums(data)
    a, b, c = range_hash(sums, np.array([2, 9, 3]), np.array([7, 14, 7]))
    assert a == b != c


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 60_000) | st.just(0), max_size=700), st.sampled_from([16, 64, 4096]))
def test_simple8b_round_trip(values, block):
    data = np.array(values, dtype=np.uint64)
    words, per_block = tokens.simple8b_encode(data, block)
    assert per_block.sum() == len(words)
    assert np.array_equal(tokens.simple8b_decode(words, per_block, len(data), block), data)


def test_simple8b_packs_runs():
    words, _ = tokens.simple8b_encode(np.zeros(480, dtype=np.uint64), 4096)
    assert len(words) == 2


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<", "s", ">", "\\", "/", "[", "INST", "]", *chat.CONTROL, "<\\s>", "a"]), max_size=9).map("".join))
def test_escape_is_reversible_and_leaves_no_control_string(text):
    escaped = chat.escape(text)
    assert chat.unescape(escaped) == text and not any(c in escaped for c in chat.CONTROL)


def test_setsketch_estimates_and_merges():
    rng = np.random.default_rng(5)
    common, one, other = (mix(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (900, 50, 60))
    a, b = np.concatenate([common, one]), np.concatenate([common, other])
    rows = sketch(np.concatenate([a, b, np.concatenate([a, b])]), np.array([0, len(a), len(a) + len(b), 2 * (len(a) + len(b)), 2 * (len(a) + len(b))]), 1024)
    assert abs(similarity(rows[:1], rows[1:2], np.array([len(a)]), np.array([len(b)]))[0] - 900 / 1010) < 0.04
    assert np.array_equal(merge(rows[0], rows[1]), rows[2]) and not rows[3].any()


def test_url_keys_and_record_ids():
    assert url_key("http://Blog.Example.com:80/a?b=1#c") == "com,example,blog)/a?b=1"
    assert url_key("") == "" and url_key("http://[bad") == "http://[bad"
    for page in (None, 0, 7, -7, 2**63 - 1, -(2**63)):
        assert page_of(record_id(page)) == page == page_of(record_id(page, f"http://x/{page}"))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=60).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=20), st.integers(1, 20))
def test_index_family_finds_the_first_and_stays_logarithmic(batches, length):
    text = np.frombuffer(b"".join(batches) + bytes(length + 8), dtype=np.uint8)
    family, seen, at = substrings.IndexFamily(text, length), {}, 0
    for batch in batches:
        starts = np.arange(at, at + len(batch))
        found = family.add(starts, starts)
        for own, first in zip(starts.tolist(), found.tolist(), strict=True):
            assert first == seen.setdefault(text[own : own + length].tobytes(), own)
        at += len(batch)
        for level, _ in family.levels:
            strings = [text[k : k + length].tobytes() for k in level]
            assert strings == sorted(set(strings))
    sizes = [len(level) for level, _ in family.levels]
    assert sum(sizes) == len(seen) and all(a > 2 * b for a, b in zip(sizes, sizes[1:]))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"ab", b"aaaaaaa", b"abcabd", b"xyzzy"]), max_size=30).map(b"".join), min_size=1, max_size=8), st.sampled_from([8, 13]), st.integers(1, 60))
def test_pieces_and_runs_equal_brute_force(docs, length, most):
    gram = 5
    data = np.frombuffer(b"".join(docs), dtype=np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    found = substrings.Pieces(data, offsets, length, gram)
    windows = {}
    for start, n, anchor in zip(found.start.tolist(), found.windows.tolist(), (found.anchor % substrings.MANY).tolist(), strict=True):
        for k in range(start, start + n):
            windows[k] = data[start + anchor : start + anchor + gram].tobytes()
    assert set(windows) == {o + k for o, d in zip(offsets.tolist(), docs) for k in range(len(d) - length + 1)}
    by_string, first = {}, {}
    for k, doc in enumerate(docs):
        for at in range(len(doc) - length + 1):
            assert by_string.setdefault(doc[at : at + length], windows[offsets[k] + at]) == windows[offsets[k] + at]
            first.setdefault(doc[at : at + length], k)
    expected = {offsets[k] + at + i for k, doc in enumerate(docs) for at in range(len(doc) - length + 1) if first[doc[at : at + length]] < k for i in range(length)}
    text = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    size = found.windows + length - 1
    # Runs may find more than pieces have in common by their anchors, as all pieces are at hand here.
    piece, begin, covered = substrings.matched_runs(found.doc, found.start, size, found.anchor, text, length, gram, most)
    got = {int(found.start[p] + b + i) for p, b, n in zip(piece, begin, covered) for i in range(n)}
    assert got == expected


@functools.cache
def library(path, literal):
    """The library's own tokenizer, apart from the operator's."""
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    if literal:
        found.encode_special_tokens = True
    return found


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([" ", "  ", "\n", "\t", "\r\n", "\xa0", "\u3000", ".", ",", "'s", "'", "-", "½", "²", "1", "word", "Wörd", "ɏ", "x", "e\u0301", "日本", "\u200d", "😀", "<|endoftext|>", "</s>"]) | st.text(max_size=4), max_size=40).map("".join))
def test_encoder_equals_the_library_on_any_text(text):
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    for literal in (False, True):
        expected = library(path, literal).encode(text, add_special_tokens=False).ids
        assert tokens.encoder(path, literal=literal).encode(text).tolist() == expected


def test_encoder_equals_the_library():
    public = pytest.importorskip("public_tokenizers")
    path = public.path("byte_bpe_50k.json")
    own, whole = tokens.CutEncoder(path), library(path, False)
    odd = ["a  b", "\n a", " a b ", "x  y", "don't  they're 's", "é è  ê\n\nz", "<|endoftext|> hi <|endoftext|>x", "", "  ", "\x1c a \x1d b", "日本 語 text", "a 's b 't", "١٢ 3",
           "foo, bar. b1, c' d's, e,, f., ½, ª. a\nb, x", "x a,\nb. c", "a a\nb's c", "z ×a ÷, ª a\n\nb", "a Ǆ ǅ, ɏ. q"]
    for text in odd * 2:
        assert own.encode(text).tolist() == whole.encode(text, add_special_tokens=False).ids, text
    assert own.encode("a <|endoftext|> b").tolist() == [64, 220, 50256, 275]
