"""Files of token ids: exact round trips."""

import random
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rigbook.llm import token_files
from rigbook.session import scratch_path

from .conftest import ODD

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("width", [1, 2, 3, 5, 7, 8, 9, 13, 16, 17, 24, 31, 32])
def test_bits_come_back(width):
    draw = np.random.default_rng(width)
    for n in (0, 1, 7, 8, 100, 1001):
        ids = draw.integers(0, 2**width, n, dtype=np.uint64)
        packed = token_files.pack_bits(ids, width)
        assert len(packed) == (n * width + 7) // 8
        assert int.from_bytes(packed, "little") == sum(int(x) << (k * width) for k, x in enumerate(ids))
        assert np.array_equal(token_files.unpack_bits(packed, width, 0, n), ids)
        for _ in range(5):
            a, b = sorted(draw.integers(0, n + 1, 2).tolist())
            # Packed ids of other places than whole bytes: ids up to a multiple of 8 begin a byte.
            assert np.array_equal(token_files.unpack_bits(packed, width, a, b), ids[a:b]) or width in (8, 16, 32)


def test_widths():
    assert [token_files.width_of(n) for n in (1, 2, 3, 256, 257, 50257, 65536, 65537)] == [1, 1, 2, 8, 9, 16, 16, 17]


@pytest.mark.parametrize("width", [11, 16])
def test_random_access(monkeypatch, tmp_path, width):
    monkeypatch.setattr(token_files, "BLOCK_IDS", 64)
    draw = np.random.default_rng(1)
    lengths = [1, 63, 64, 65, 1, 500, 3]
    ids = draw.integers(0, 2**width, sum(lengths))
    (tmp_path / "x").write_bytes(token_files.file_bytes([5, None, 7, 7, -1, 2**60, 0], lengths, ids, 3, 1234, width) + b"\n")
    held = token_files.TokenFile(np.memmap(tmp_path / "x", np.uint8, "r"))
    assert held.doc_ids == [5, None, 7, 7, -1, 2**60, 0] and (held.slice, held.before, held.n_ids) == (3, 1234, sum(lengths))
    begins = np.cumsum([0, *lengths])
    for k in range(len(lengths)):
        assert np.array_equal(held.document(k), ids[begins[k]:begins[k + 1]])
    for a in range(0, len(ids), 37):
        assert np.array_equal(held.ids(a, a + 100), ids[a:a + 100])
    assert not len(held.ids(5, 5))
    with pytest.raises(ValueError, match="no file"):
        token_files.TokenFile(b"x" * 100)


def expected(rows):
    """(doc_id, ids) of the library, with the end id."""
    library = Tokenizer.from_file(VOCABULARY)
    return [(k, [*library.encode(t or "", add_special_tokens=False).ids, 0]) for k, t in rows]


def test_documents_come_back(spark, documents):
    draw = random.Random(2)
    rows = [*ODD, *((draw.randrange(100), " ".join(draw.choice(["ein", "Wörter", "2024", "\n"]) for _ in range(
        draw.randrange(200)))) for _ in range(150))]
    path = scratch_path(spark, "ids")
    token_files.write_ids(documents(rows).repartition(5), path, VOCABULARY, file_ids=5000)
    found = token_files.read_ids(spark, path, with_ids=True).orderBy("start").collect()
    wanted = Counter((k, tuple(ids)) for k, ids in expected(rows))
    assert Counter((r.doc_id, tuple(r.ids)) for r in found) == wanted
    assert [r.doc_id for r in found] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x or 0))
    assert [r.start for r in found] == np.cumsum([0, *(r.n_tokens for r in found)])[:-1].tolist()
    for r in found:
        assert r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    files = token_files.file_table(spark, path).orderBy("start").collect()
    assert len(files) > 5 and sum(f.n_ids for f in files) == sum(r.n_tokens for r in found)
    # Any place is found by its file, without Spark.
    whole = [i for r in found for i in r.ids]
    for f in files:
        held = token_files.TokenFile(np.memmap(f.path.removeprefix("file:"), np.uint8, "r"))
        assert held.ids(0, 7).tolist() == whole[f.start:f.start + min(7, f.n_ids)]


def test_one_id_for_most_rows(spark, documents):
    """A hot id is cut into slices like any range of ids."""
    rows = [(7, "one two three four " * 20)] * 300 + [(None, "x")] * 100 + [(k, "y z") for k in range(20)]
    path = scratch_path(spark, "ids")
    token_files.write_ids(documents(rows), path, VOCABULARY, file_ids=4000)
    found = token_files.read_ids(spark, path).orderBy("start").collect()
    assert Counter((r.doc_id, r.n_tokens) for r in found) == Counter((k, len(ids)) for k, ids in expected(rows))
    assert [r.start for r in found] == np.cumsum([0, *(r.n_tokens for r in found)])[:-1].tolist()
    assert token_files.file_table(spark, path).agg(F.max("n_ids")).first()[0] < 4400


def test_an_empty_table(spark, documents):
    path = scratch_path(spark, "ids")
    token_files.write_ids(documents([]), path, VOCABULARY)
    assert Path(path.removeprefix("file:"), "_SUCCESS").exists()
    assert token_files.read_ids(spark, path).collect() == [] and token_files.file_table(spark, path).count() == 0
    with pytest.raises(Exception, match="already exists"):
        token_files.write_ids(documents([]), path, VOCABULARY)
