"""Token counts by the whole-token shortcut.

A vocabulary string that its own merges build up completely encodes alone as one token. That is proven once
per worker, from the vocabulary and nothing else. A pre-token among those strings counts one without any
merging; only the rest is merged, once for each different string while it is remembered.
"""

import functools
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Tokenizer, pre_tokenizers

from rigbook.llm.common import columns_of, small_batches

#: Texts of these characters alone, which every Unicode version treats alike: no combining marks, hence
#: nothing for NFC to do, and letter case by single characters.
PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-įı-˿]*").fullmatch
#: The vocabulary's own split, written for those characters: letters, single numerals, other signs.
LETTERS, NUMERALS = "a-zªµºß-öø-ˁˆ-ˑˠ-ˤˬˮ", "0-9²³¹¼½¾"
WORDS = re.compile(f"[{LETTERS}]+|[{NUMERALS}]|'s|'t|'re|'ve|'m|'ll|'d|[^\\s{LETTERS}{NUMERALS}]+").findall

#: So many merged pre-tokens are remembered before the memory starts afresh.
REMEMBERED = 400_000


class TokenCounts(dict):
    """Pre-token to number of tokens. Holds what is proven to be one token, and remembers what was merged."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.specials = re.compile("|".join(re.escape(s) for s in sorted(specials, key=len, reverse=True)) or "(?!)")
        self.whole = self.proven()
        super().__init__(self.whole)

    def proven(self) -> dict[str, int]:
        """Every string that is one pre-token, is left alone by the normaliser, and merges to one token."""
        ends = "</w>"
        found = {}
        for token in self.tokenizer.get_vocab(with_added_tokens=False):
            if token.endswith(ends) and len(self.model.tokenize(token[:-len(ends)])) == 1:
                text = token[:-len(ends)]
                if not text.isascii():  # printable ASCII is spelled as itself
                    text = _decoded(text, self.as_bytes)
                if text and PLAIN(text) and text.lower() == text and WORDS(text) == [text]:
                    found[text] = 1
        return found

    def __missing__(self, word: str) -> int:
        if len(self) - len(self.whole) >= REMEMBERED:
            self.clear()
            self.update(self.whole)
        self[word] = n = len(self.model.tokenize(word if word.isascii() else self.as_bytes(word)[0][0]))
        return n

    def of(self, text: str) -> int:
        """Tokens of a whole text. Special strings count one each, as the library takes them by default."""
        if "<" not in text or not self.specials.search(text):
            return self.of_part(text)
        return sum(map(self.of_part, self.specials.split(text))) + len(self.specials.findall(text))

    def of_part(self, text: str) -> int:
        if PLAIN(text):
            return sum(map(self.__getitem__, WORDS(text.lower())))
        # Other characters are normalised and split by the library, whose Unicode tables count.
        text = self.tokenizer.normalizer.normalize_str(text)
        pieces = [piece for piece, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        return sum(1 if p in self.whole_pieces else len(self.model.tokenize(p)) for p in pieces)

    @functools.cached_property
    def whole_pieces(self) -> frozenset[str]:
        """The proven strings as the library spells them after splitting."""
        return frozenset(self.as_bytes(text)[0][0] for text in self.whole)


def _decoded(piece: str, as_bytes) -> str:
    """A byte-level spelling as text, or "" if its bytes are no text."""
    try:
        return bytes(_byte_of(as_bytes)[c] for c in piece).decode()
    except (KeyError, UnicodeDecodeError):
        return ""


@functools.cache
def _byte_of(as_bytes) -> dict[str, int]:
    """Spelling of each byte, read off the library's own spelling of short texts."""
    table = {}
    for c in [*range(0x80), *range(0x80, 0x800), *range(0x800, 0x10000, 0x40), *range(0x10000, 0x110000, 0x1000)]:
        if not 0xd800 <= c < 0xe000:
            table.update(zip(as_bytes(chr(c))[0][0], chr(c).encode(), strict=True))
    return table


@functools.lru_cache(maxsize=2)
def counts_for(path: str) -> TokenCounts:
    return TokenCounts(path)


def token_counts(documents: DataFrame, vocabulary: str, limit: int = 2048, *, doc_id: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than ``limit`` tokens).

    ``vocabulary`` is a ``tokenizers`` file with word ends, reachable on every executor. A null text counts
    as empty: 0 bytes, 0 tokens. Rows that repeat give rows that repeat; a null id stays null; further
    columns are not read. Narrow: no shuffle, and memory is bounded by one batch and the longest text.
    """
    small_batches(documents.sparkSession)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counts_for(vocabulary)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            n = [counts.of(t) for t in texts]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "n_bytes": pa.array([len(t.encode()) for t in texts], pa.int64()),
                "n_tokens": pa.array(n, pa.int64()), "over_limit": pa.array([x > limit for x in n], pa.bool_())})

    rows = columns_of(documents, doc_id=doc_id, text=text)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
