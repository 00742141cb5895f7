"""Deduplication and decontamination against brute force."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict
from math import comb

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rigbook.llm import decontamination, exact_dedup, near_dedup, similarity, substring_dedup
from rigbook.llm.common import components
from rigbook.llm.similarity import bits_of, maybe_in

from .conftest import ODD


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def test_components(spark):
    pick = random.Random(3)
    links = [(pick.randrange(60), pick.randrange(60)) for _ in range(45)] + [(100 + k, 101 + k) for k in range(20)]
    parent = {x: x for pair in links for x in pair}

    def root(x):
        return x if parent[x] == x else root(parent[x])
    for a, b in links:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for pair in links if pair[0] != pair[1] for x in pair}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_exact_dedup_over_history_and_arrivals(documents):
    rows = ODD + [(k, f"Text {k % 7}") for k in range(100, 140)]
    table = documents(rows)
    old = F.coalesce(F.col("doc_id") % 2 == 0, F.lit(True))
    got = exact_dedup.exact_dedup(table.where(~old), table.where(old)).collect()
    groups = defaultdict(list)
    for key, text in rows:
        groups[lower(text)].append(key)
    expected = Counter()
    for key, text in rows:
        group = groups[lower(text)]
        keep = max((k for k in group if k is not None), default=None)
        expected[key, keep, len(group), key == keep, hashlib.sha256(lower(text).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got) == expected
    nothing = documents([])
    assert exact_dedup.exact_dedup(nothing, nothing).count() == 0
    assert exact_dedup.exact_dedup(table, nothing).count() == exact_dedup.exact_dedup(nothing, table).count() == len(rows)


def test_perfect_hash_is_minimal_and_tells_strangers():
    keys = np.frombuffer(b"".join(hashlib.sha256(b"%d" % k).digest() for k in range(3000)), np.uint8).reshape(-1, 32)
    sizes, bits = exact_dedup.build_levels(keys[:2000])
    assert sorted(exact_dedup.find_slots(keys[:2000], sizes, bits)) == list(range(2000))
    slots = exact_dedup.find_slots(keys[2000:], sizes, bits)
    held = np.empty_like(keys[:2000])
    held[exact_dedup.find_slots(keys[:2000], sizes, bits)] = keys[:2000]
    assert not any((held[s] == k).all() for s, k in zip(slots, keys[2000:], strict=True) if s >= 0)


def brute_near(rows, size):
    sets = {}
    for key, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
        sets[key] = {tuple(words[k:k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()
    parent = {k: k for k in sets}

    def root(x):
        return x if parent[x] == x else root(parent[x])
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {(k, len(s), root(k)) for k, s in sets.items()}


def near_copies():
    pick = random.Random(11)
    rows = [(k, t) for k, t in ODD if k is not None]
    for base in range(12):
        words = [f"w{pick.randrange(5000)}" for _ in range(pick.choice([3, 40, 120]))]
        for copy in range(12):
            changed = [w if pick.random() > 0.015 * (copy % 3) else "new" for w in words]
            rows.append((1000 + base * 20 + copy, " ".join(changed)))
    return rows


@pytest.mark.parametrize("size", [4, 5])
def test_near_dedup_links_what_brute_force_links(documents, monkeypatch, size):
    monkeypatch.setattr(near_dedup, "BUCKET_BLOCK", 5)
    monkeypatch.setattr(near_dedup, "CLUSTER_BLOCK", 4)
    rows = near_copies()
    got = near_dedup.near_dedup(documents(rows + [(None, "a b c d e f"), (None, None)]), size).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == brute_near(rows, size)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got) and len(got) == len(rows) + 2
    assert near_dedup.near_dedup(documents([])).count() == 0


def test_near_dedup_of_several_texts_under_one_id(documents):
    """Rows that repeat an id are one document, whether their texts are near, unlike or equal."""
    pick = random.Random(4)
    base = [f"w{pick.randrange(5000)}" for _ in range(60)]

    def near(k):
        return " ".join([*base, f"end{k}"])
    rows = ([(1, near(k)) for k in range(800)] + [(None, near(k)) for k in range(40)]
            + [(5, near(900)), (5, "something else altogether here"), (3, "something else altogether here"), (8, "alone x y z"),
               (9, None), (9, "zwei drei vier fünf"), (9, "zwei drei vier fünf"), (10, "sechs sieben acht neun")])
    got = near_dedup.near_dedup(documents(rows)).collect()
    assert len(got) == len(rows)
    assert Counter((r.doc_id, r.component_id, r.kept) for r in got) == Counter(
        {(1, 1, True): 800, (None, None, True): 40, (5, 1, False): 2, (3, 1, False): 1, (8, 8, True): 1,
         (9, 9, True): 3, (10, 10, True): 1})


def brute_hits(text, items, window):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    own, hit, names = words(text), set(), set()
    for item, passage in items:
        w = words(passage)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            part = w[k:k + window]
            for p in range(len(own) - len(part) + 1):
                if own[p:p + len(part)] == part:
                    hit |= set(range(p, p + len(part)))
                    names.add(item)
    return len(own), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()


@pytest.mark.parametrize("block", [100_000, 3])
def test_decontamination(spark, documents, monkeypatch, block):
    monkeypatch.setattr(decontamination, "SEGMENT_WORDS", 40)
    monkeypatch.setattr(decontamination, "BLOCK_PHRASES", block)
    pick = random.Random(5)
    rows = [r for r in ODD if r[0] != 9] + [(k, " ".join(pick.choices("abcd", k=60))) for k in range(20, 40)]
    items = [("10", "a B c, d"), ("9", "b a"), ("x", None), ("y", "..."), ("z", "a b a b a b"), ("é", "Éàß Ωσς ΑΣ")]
    benchmark = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id string, text string, words int")
    got = decontamination.decontaminate(documents(rows), benchmark, window=4).collect()
    assert Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in got) == \
        Counter((k, *brute_hits(t, items, 4)) for k, t in rows)
    assert all(r.contaminated == (r.n_hit > 0 and 20 * r.n_hit >= r.n_words) for r in got)
    nothing = decontamination.decontaminate(documents(rows), benchmark.limit(0)).collect()
    assert len(nothing) == len(rows) and not any(r.n_hit or r.contaminated for r in nothing)
    assert decontamination.decontaminate(documents([]), benchmark).count() == 0


def test_pruning_gives_up_few_similar_pairs():
    alive, lost = {0: 1.0}, 0.0
    for least in near_dedup.least_matches(80):
        after = defaultdict(float)
        for m, chance in alive.items():
            for k in range(near_dedup.BATCH + 1):
                after[m + k] += chance * comb(near_dedup.BATCH, k) * 0.8**k * 0.2**(near_dedup.BATCH - k)
        lost += sum(chance for m, chance in after.items() if m < least)
        alive = {m: chance for m, chance in after.items() if m >= least}
    assert lost <= 1e-5


def test_proximity(documents):
    index = decontamination.build_index(documents([(1, "one x two y three"), (2, "one two x y z three"), (3, "three two one")]))
    found = decontamination.proximity_spans(index, [("q", [b"one", b"two", b"three"])], 2).collect()
    assert [(r.doc_id, r.begin, r.end) for r in found] == [(1, 0, 5)]
    assert decontamination.proximity_spans(index, [("q", [b"one", b"two", b"three"])], 3).count() == 2


def test_repeated_passages(documents):
    pick = random.Random(9)

    def sentences(n):
        return " ".join(" ".join(f"w{pick.randrange(10**6)}" for _ in range(9)).capitalize() + "." for _ in range(n))
    passage = sentences(7)
    rows = [(k, f"{sentences(3)} {passage if k % 3 == 0 else sentences(2)} {sentences(2)}") for k in range(20, 50)]
    got = {r.doc_id: r for r in substring_dedup.substring_dedup(documents(ODD + rows)).collect()}
    assert len(got) == len({k for k, _ in ODD + rows})
    for key, text in rows:
        if key % 3 == 0:
            assert got[key].n_repeated >= 54 and got[key].first_doc == 21
            assert (got[key].n_removed == 0) == (key == 21)
        else:
            assert got[key].n_repeated == got[key].n_removed == 0 and got[key].spans == []
    cut = {r.doc_id: r.text for r in substring_dedup.without_spans(
        documents(rows), substring_dedup.substring_dedup(documents(rows))).collect()}
    assert passage[-100:] in cut[21] and passage[-100:] not in cut[24]
    assert substring_dedup.substring_dedup(documents([])).count() == 0


def test_passages_inside_lines_without_marks(documents):
    pick = random.Random(12)

    def words(n):
        return " ".join(f"w{pick.randrange(10**6)}" for _ in range(n))
    passage = words(70)
    rows = [(k, f"{words(90)} {passage if k % 2 else words(70)} {words(90)}") for k in range(20)]
    for r in substring_dedup.substring_dedup(documents(rows)).collect():
        assert (r.n_passages, r.n_removed > 0) == ((1, r.doc_id > 1) if r.doc_id % 2 else (0, False))
        assert r.n_repeated <= 70 and (r.doc_id % 2 == 0 or r.n_repeated >= 45 and r.first_doc <= r.doc_id)
        text = dict(rows)[r.doc_id]
        assert all(text[a:b].strip() in passage for a, b in r.spans)


def windows(text, size=51):
    found = lower(text).split()
    return {tuple(found[k:k + size]) for k in range(len(found) - size + 1)}


def test_passages_against_brute_force(documents):
    """Passages of 51 to 90 words pasted anywhere, in texts of sentences, of long sentences and of lines without any:
    all documents that share 51 words in a row with an earlier one, and no others."""
    pick = random.Random(13)

    def text(n, mean):
        out = []
        while len(out) < n:
            out += [f"w{pick.randrange(10**6)}" for _ in range(pick.randint(1, 2 * mean))]
            out[-1] += pick.choice([".", "!", "\n", "?"])
        return out
    rows, passages = [], [text(pick.randint(51, 90), pick.choice([8, 15, 30, 200])) for _ in range(40)]
    for key in range(400):
        words, mean = [], pick.choice([8, 15, 30, 200])
        words += text(pick.randint(5, 200), mean)
        if key % 2:
            at = pick.randrange(len(words))
            words[at:at] = pick.choice(passages)
        rows.append((key, " ".join(words)))
    seen, repeated = set(), set()
    for key, t in rows:
        if windows(t) & seen:
            repeated.add(key)
        seen |= windows(t)
    got = {r.doc_id: r for r in substring_dedup.substring_dedup(documents(rows)).collect()}
    found = {key for key, r in got.items() if r.n_removed}
    assert len(found & repeated) >= 0.98 * len(repeated) > 100 and found <= repeated
    for key, r in got.items():      # and what goes stands before, but for words that similar paragraphs differ in
        before = set().union(*(windows(t, 5) for k, t in rows if k < key))
        for a, b in r.spans:
            cut = windows(dict(rows)[key][a:b], 5)
            assert len(cut & before) >= 0.7 * len(cut)


def test_texts_of_one_id_have_spans_of_their_own(documents):
    pick = random.Random(14)

    def words(n):
        return " ".join(f"w{pick.randrange(10**6)}" for _ in range(n))
    passage, own = words(60), [words(100), words(40), words(30)]
    rows = [(1, passage), (7, f"{own[0]}\n{passage}\n{own[1]}"), (7, own[2]), (7, f"{passage}\n{own[1]}"), (None, passage)]
    found = substring_dedup.substring_dedup(documents(rows))
    cut = [r.text for r in substring_dedup.without_spans(documents(rows), found).collect()]
    assert sorted(" ".join(t.split()) for t in cut) == sorted(
        [passage, passage, f"{own[0]} {own[1]}", own[2], own[1]])
    assert sorted((r.doc_id or 0, r.n_removed) for r in found.collect()) == [(0, 0), (1, 0), (7, 0), (7, 60), (7, 60)]


def test_stretches():
    def part(a, b, of=1):
        return a, b, 10 * a, 10 * b, of, 5
    assert substring_dedup.joined([part(5, 9), part(0, 3), part(3, 4, 2), part(6, 7)]) == [part(0, 4), part(5, 9)]
    assert substring_dedup.joined([]) == []
    others = [part(2, 4), part(6, 8), part(20, 30)]
    assert list(substring_dedup.outside(part(0, 10), others)) == [part(0, 2), part(4, 6), part(8, 10)]
    assert list(substring_dedup.outside(part(3, 7), others)) == [part(4, 6)]
    assert list(substring_dedup.outside(part(21, 25), others)) == []
    assert list(substring_dedup.outside(part(4, 6), others)) == [part(4, 6)]


def test_paragraphs_fill_the_text():
    text = "One two three four five. Six seven\n\n  eight\n" + "w" + " x".join(map(str, range(90))) + ". end"
    whole = [p for p in substring_dedup.paragraphs_of(text) if p[4]]
    assert [p[2] for p in whole] == [0, 5, 7, 8, 98] and whole[0][0] == 0 and whole[-1][1] == len(text)
    assert all(a[1] == b[0] for a, b in zip(whole, whole[1:]))
    pieces = [p for p in substring_dedup.paragraphs_of(text) if not p[4]]
    assert (pieces[0][0], pieces[-1][1]) == whole[3][:2] and all(a[1] == b[0] for a, b in zip(pieces, pieces[1:]))
    assert [w for p in pieces for w in p[3]] == whole[3][3] and [p[2] for p in pieces][0] == 8
    assert list(substring_dedup.paragraphs_of(None)) == list(substring_dedup.paragraphs_of(" \n \n")) == []


@pytest.mark.parametrize("size", [1, 2, 3, 50])
def test_shared_keys(size):
    pick = random.Random(size)
    rows = sorted((pick.randrange(12), pick.randrange(3)) for _ in range(40))
    batches = [pa.RecordBatch.from_pydict({"node": [n for _, n in part], "key": [k for k, _ in part]})
               for at in range(0, 40, size) for part in [rows[at:at + size]]]
    got = [(k, n) for b in substring_dedup.shared_keys(batches) for n, k in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    assert got == sorted({r for r in rows if len({n for k, n in rows if k == r[0]}) > 1})
    assert list(substring_dedup.shared_keys([])) == []


def test_bloom_filter_misses_nothing(spark):
    rng = np.random.default_rng(4)
    members, others = (rng.integers(-2**63, 2**63 - 1, 3000, dtype=np.int64) for _ in range(2))
    bits = bits_of(spark.createDataFrame([(int(x),) for x in [*members, -1, 0, members[0]]], "node long"))
    assert maybe_in(bits, np.append(members, [-1, 0])).all()
    assert maybe_in(bits, others).mean() < 0.01
    assert not bits_of(spark.createDataFrame([], "node long")).any()


def test_similar_paragraphs_are_one_class(documents):
    words = [f"w{k}" for k in range(80)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:40] + ["other"] + words[41:])), (3, " ".join(words[::-1]))]
    got = {r.doc_id: r.n_removed for r in substring_dedup.substring_dedup(documents(rows)).collect()}
    assert got == {1: 0, 2: 80, 3: 0}


def test_paragraphs_are_banded_together(monkeypatch):
    """No paragraph without repeated shingles costs a look of its own."""
    calls = []
    unique = np.unique
    monkeypatch.setattr(np, "unique", lambda *a, **k: calls.append(1) or unique(*a, **k))
    texts = [b" ".join(b"%d" % (100 * k + i) for i in range(9)) for k in range(200)]
    texts += [b"a b c d e " * 3, b"a a a a a a a a a"]         # the first has five different shingles, the last one
    batch = pa.RecordBatch.from_arrays([pa.array(range(202), pa.int64()), pa.array(texts, pa.binary())],
                                       names=["node", "words"])
    found = list(substring_dedup.banded([batch]))
    assert len(calls) < 10
    assert found[0].column("node").to_pylist() == [k for k in range(201) for _ in range(substring_dedup.BANDS)]


def test_pairs_of_texts_are_linked_as_larger_units_are():
    rng = random.Random(4)
    seen = set()
    for _ in range(500):
        one = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randrange(5, 30))]
        two = one[rng.randrange(3):] + rng.choice([[], [b"z"]])
        nodes = rng.choice([[1, 2], [9, 3], [5, 5]])
        sets = similarity.shingle_sets([one, two], 5)
        assert similarity.distinct_counts(similarity.shingles([one, two], 5)).tolist() == [len(s) for s in sets]
        expected = similarity.spanning(nodes, similarity.similar(sets, 80))
        assert similarity.linked_pair(nodes, [one, two], 5, 80) == expected
        seen.add(len(expected))
    assert seen == {0, 1}


@pytest.mark.parametrize("head, between", [("", " "), (" \t", " "), ("", "  "), ("é ", " "), ("", " \x0b")])
def test_pieces_of_long_paragraphs_lie_where_their_words_are(head, between):
    text = head + between.join(f"Word{k}" for k in range(300)) + " "
    pieces = [p for p in substring_dedup.paragraphs_of(text) if not p[4]]
    assert len(pieces) > 20 and pieces[0][0] == 0 and pieces[-1][1] == len(text)
    assert all(a[1] == b[0] and a[2] + len(a[3]) == b[2] for a, b in itertools.pairwise(pieces))
    assert all(text[begin:end].lower().encode().split() == words for begin, end, _, words, _ in pieces)
