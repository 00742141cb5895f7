"""Token counts and packing against the libraries themselves."""

import random
import zlib
from collections import Counter
from itertools import combinations_with_replacement

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from rigbook.llm import packing, token_counts

from .conftest import ODD

WORDS, BYTES = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))


def test_counts_are_the_librarys(documents):
    library = Tokenizer.from_file(WORDS)
    rows = token_counts.token_counts(documents(ODD), WORDS, 20).collect()
    expected = Counter()
    for key, text in ODD:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        expected[key, len((text or "").encode()), n, n > 20] += 1
    assert Counter(map(tuple, rows)) == expected
    assert token_counts.token_counts(documents([]), WORDS).count() == 0


def test_every_character_splits_as_in_the_library():
    counts, ids = token_counts.counts_for(WORDS), packing.ids_for(BYTES)
    words, pieces = Tokenizer.from_file(WORDS), Tokenizer.from_file(BYTES)
    for c in [*range(1, 0x300), 0x301, 0x3a3, 0x3c2, 0x410, 0x2028, 0xfb01, 0x1f642]:
        for text in (f"a{chr(c)}b", f"1{chr(c)}! {chr(c)}", f"'{chr(c)}s  {chr(c)}"):
            assert counts.of(text) == len(words.encode(text, add_special_tokens=False).ids), hex(c)
            assert ids.of(text) == np.array(pieces.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), hex(c)


def test_pieces_are_cut_and_packed_without_gaps(documents):
    library, size = Tokenizer.from_file(BYTES), 16
    packed = packing.pack_documents(documents(ODD[:8] + ODD[9:]), BYTES, size, with_ids=True).cache()
    rows = packed.collect()
    whole = Counter()
    for key in {r.doc_id for r in rows} - {None, 5}:
        own = sorted((r for r in rows if r.doc_id == key), key=lambda r: r.piece)
        text = next(t for k, t in ODD if k == key)
        ids = [i for r in own for i in r.ids]
        assert ids == [*library.encode(text or "", add_special_tokens=False).ids, 0]
        assert [r.start for r in own] == list(np.cumsum([0, *(r.length for r in own)])[:-1])
        assert all(r.length == size for r in own[1:]) and own[0].length <= size
        assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in own)
    for r in rows:
        whole[r.sequence_id] += r.length
    for key, total in whole.items():
        spots = sorted((r.offset, r.length) for r in rows if r.sequence_id == key)
        assert total <= size and [o for o, _ in spots] == list(np.cumsum([0, *(n for _, n in spots)])[:-1])
    made = packing.sequences(packed).collect()
    assert {s.sequence_id: len(s.ids) for s in made} == dict(whole) and all(len(s.ids) == len(s.doc_ids) for s in made)
    assert packing.pack_documents(documents([]), BYTES).count() == 0


@pytest.mark.parametrize("seed", range(60))
def test_plans_hold_every_piece_and_are_nearly_the_best(seed):
    pick = random.Random(seed)
    size = pick.choice([7, 12, 30])
    counts = Counter(pick.randint(1, size) for _ in range(pick.randint(1, 60)))
    held = Counter()
    plan = packing.plan(counts, size)
    for pattern, times in plan:
        assert sum(n * k for n, k in pattern) <= size and times > 0
        for n, k in pattern:
            held[n] += k * times
    assert held == counts
    least = -(-sum(n * k for n, k in counts.items()) // size)
    assert sum(t for _, t in plan) <= 11 / 9 * least + 4


def best(pieces, size):
    """The fewest sequences, by trying everything."""
    if not pieces:
        return 0
    first, rest = pieces[0], pieces[1:]
    found = len(pieces)
    for mask in range(1 << len(rest)):
        chosen = [x for i, x in enumerate(rest) if mask >> i & 1]
        if first + sum(chosen) <= size:
            found = min(found, 1 + best(tuple(x for i, x in enumerate(rest) if not mask >> i & 1), size))
    return found


def test_fixed_sets_never_cost_a_sequence():
    size = 7
    for pieces in combinations_with_replacement(range(1, 7), 6):
        fixed, left = packing.reduce_instance(Counter(pieces), size)
        rest = tuple(sorted(left.elements(), reverse=True))
        assert sum(t for _, t in fixed) + best(rest, size) == best(tuple(sorted(pieces, reverse=True)), size)
