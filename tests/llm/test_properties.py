"""Properties of the plain-Python parts."""

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm.capping import _middle
from lodestone.llm.defects import ending, judge, open_structures, tiles
from lodestone.llm.leakage import WordSearch
from lodestone.llm.lookalikes import form_sql
from lodestone.llm.mixing import route
from lodestone.llm.scan_noise import PageReader, joined_lines, words_of

CHARS = st.characters(blacklist_categories=["Cs"])


@given(st.text(CHARS), st.text(CHARS))
def test_middle_lies_between(a, b):
    low, high = min(a, b), max(a, b)
    if low < high:
        assert low < _middle(low, high) <= high


@given(st.text("ab-\n \t1", max_size=60))
def test_lines_are_left_alone_without_a_join(text):
    assert joined_lines(text, lambda a, b: None) == text


@given(st.lists(st.sampled_from("abc"), max_size=12), st.lists(st.sampled_from("abcd"), max_size=20))
def test_tiles_cover_common_tokens_only(q, a):
    used, held = tiles(q, a)
    assert 0 <= used <= len(q) and len(held) == len(a) and all(t in q for t, h in zip(a, held) if h)


@given(st.text(CHARS, max_size=200), st.text(CHARS, max_size=200))
@settings(max_examples=200, deadline=None)
def test_any_pair_is_judged(question, answer):
    assert judge(question, answer)[0] in (None, "empty", "truncated", "refusal", "copied_question", "other_language")
    assert ending(answer)[0] in ("cut", "sound", "open") and isinstance(open_structures(answer), list)


@given(st.lists(st.lists(st.sampled_from("xyz"), max_size=15), max_size=5), st.lists(st.sampled_from("xyz"), max_size=30))
def test_search_finds_all_runs(items, doc):
    runs = {tuple(doc[i : i + 4]) for i in range(len(doc) - 3)}
    want = {k for k, w in enumerate(items) if any(tuple(w[i : i + 4]) in runs for i in range(len(w) - 3))}
    assert WordSearch(enumerate(items), run=4, block=2).found(doc) == want


@given(st.text(CHARS, max_size=80))
@settings(max_examples=150, deadline=None)
def test_form_of_a_form(text):
    text = text.replace("\0", "")
    one = duckdb.execute(f"SELECT {form_sql('$1')}", [text]).fetchone()[0]
    assert duckdb.execute(f"SELECT {form_sql('$1')}", [one]).fetchone()[0] == one


@given(st.text(CHARS, max_size=300))
@settings(max_examples=100, deadline=None)
def test_any_chunk_is_read(text):
    reader = PageReader({"error": 50}, {"err0r": "error"})
    assert reader.noise(text, set())[0] <= {"page_number", "running_header", "hyphen_break", "misread"}
    assert isinstance(reader.repaired(text, set()), str) and all(len(w) > 2 for w in words_of(text))


@given(st.dictionaries(st.sampled_from([("a",), ("b",), ("a", "b"), ("b", "c")]), st.integers(1, 50), min_size=1), st.integers(0, 120), st.integers(0, 120))
@settings(deadline=None)
def test_flow_respects_its_limits(patterns, qa, qb):
    repeats = {"a": 2, "b": 3, "c": 1}
    got = route(patterns, {"a": qa, "b": qb, "c": 10}, repeats)
    for key, by in got.items():
        assert sum(by.values()) <= patterns[key] * max(repeats[s] for s in key)
        assert all(n <= patterns[key] * repeats[s] for s, n in by.items())
    for s, q in (("a", qa), ("b", qb), ("c", 10)):
        assert sum(by.get(s, 0) for by in got.values()) <= q
