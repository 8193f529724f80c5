import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from memlattice.llm.packing import combinations, fullest
from memlattice.llm.skeleton import skeleton
from memlattice.llm.tokens import TOKENIZERS, Transducer, read_ranks

with open(f"{TOKENIZERS}/byte_bpe_50k.tiktoken", "rb") as f:
    OURS = Transducer(read_ranks(f.read()), max_states=500, max_words=200)
THEIRS = Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
THEIRS.encode_special_tokens = True
TEXT = st.text(st.characters(exclude_categories=["Cs"]), max_size=300)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_encoding_equals_the_library_and_decodes(text):
    ids = OURS.encode(text)
    assert ids == THEIRS.encode(text, add_special_tokens=False).ids
    assert "".join(OURS.decode(ids)) == text


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_a_skeleton_is_its_own(text):
    assert skeleton(skeleton(text)) == skeleton(text)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 5), min_size=1, max_size=12), st.integers(60, 90))
def test_combinations_use_every_item_once_and_fit(lengths, capacity):
    used = dict.fromkeys(lengths, 0)
    for times, each in combinations(lengths, capacity):
        assert sum(n * c for n, c in each.items()) <= capacity
        for n, c in each.items():
            used[n] += c * times
    assert used == lengths


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=9), st.integers(0, 100))
def test_fullest_is_the_fullest(lengths, room):
    left = {n: lengths.count(n) for n in lengths}
    got = fullest(sorted(left, reverse=True), dict(left), room)
    sums = {0}
    for n in lengths:
        sums |= {s + n for s in sums if s + n <= room}
    assert sum(n * c for n, c in got.items()) == max(sums)


@pytest.mark.parametrize("name", ["byte_bpe_multi_50k"])
def test_another_vocabulary(name):
    import base64

    import tiktoken

    from memlattice.llm.tokens import WORDS

    with open(f"{TOKENIZERS}/{name}.tiktoken", "rb") as f:
        data = f.read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    library = tiktoken.Encoding("own", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
    ours = Transducer(read_ranks(data))
    for text in ("Пример текста на русском языке", "日本語のテキスト", "mixed тест 123 über"):
        assert ours.encode(text) == library.encode_ordinary(text)
