"""Token counts by dynamic programming over prefixes.

For a text, ``counts[p]`` is the number of tokens of its first ``p`` characters,
for every ``p``.  Counts, truncation and budget questions then are look-ups.
The vocabulary is merged pairs of a byte alphabet with a mark at word ends
(`word_bpe_49k.json`), texts being lower-cased and white space collapsed first.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceline.llm.common import byte_signs, widened

#: Texts with more tokens than this are over the limit.
LIMIT = 2048

#: Entries of each table a worker keeps; a full one is emptied.
CACHE = 500_000

#: Symbols of a word whose prefixes are shared with other words, and of a word that is remembered whole.
SHARED, REMEMBERED = 64, 256


class WordPrefixes:
    """Token counts of all prefixes of a word (a sequence of byte symbols).

    The encoding of a prefix is that of a shorter prefix plus one last token.
    Exactly one last token is right: the one whose border with the last token of
    the shorter prefix merging leaves standing.  So a table over prefixes holds
    a count and a last token each (``opened``), filled from shorter to longer and
    shared by all words that begin alike.  A word that ends takes one more step,
    to a last token with the end mark.

    The table is a tree: a prefix is its parent's node and one symbol, so it takes
    the room of one entry however long.  Beyond SHARED symbols words hardly share
    anything; there only the last entries are kept, as many as a token may reach back.
    """

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], end: str):
        self.vocabulary, self.end = vocabulary, end
        self.rank = {pair: i for i, pair in enumerate(merges)}
        #: The merge that makes a token: its rank and its parts.
        self.made: dict[str, tuple[int, str, str]] = {}
        for i, (left, right) in enumerate(merges):
            self.made.setdefault(left + right, (i, left, right))
        self.longest = max((len(t) - len(end) * t.endswith(end) for t in vocabulary), default=1)
        self.spines: dict[tuple[str, int], list[tuple[str, float]]] = {}
        self.whole: dict[str, bool] = {}
        self.stands: dict[tuple[str, str], bool] = {}
        self.nodes: dict[tuple[int, str], int] = {}
        self.opened: list[tuple[int, str]] = [(0, "")]
        for token in vocabulary:
            self.is_whole(token)

    def spine(self, token: str, side: int) -> list[tuple[str, float]]:
        """What stands at the left (1) or right (2) border of a token while it is
        being merged, each with the rank of the merge that ends it."""
        found = self.spines.get((token, side))
        if found is None:
            found, until, t = [], float("inf"), token
            while t is not None:
                found.append((t, until))
                made = self.made.get(t)
                until, t = (made[0], made[side]) if made else (until, None)
            self.spines[token, side] = found
        return found

    def may_follow(self, left: str, right: str) -> bool:
        """Whether merging leaves the border between two tokens standing.

        A merge across the border takes place if both its parts are still there
        when its rank comes; of equal ranks the one further left goes first.
        """
        found = self.stands.get((left, right))
        if found is None:
            if len(self.stands) > CACHE:
                self.stands.clear()
            found = True
            for x, until_x in self.spine(left, 2):
                for y, until_y in self.spine(right, 1):
                    rank = self.rank.get((x, y))
                    if rank is not None and rank < until_x and rank <= until_y:
                        found = False
            self.stands[left, right] = found
        return found

    def is_whole(self, token: str) -> bool:
        """Whether a token's own symbols merge into it: its parts do, and stand side by side until they meet."""
        found = self.whole.get(token)
        if found is None:
            made = self.made.get(token)
            if token not in self.vocabulary:
                found = False
            elif made is None:
                found = len(token) - len(self.end) * token.endswith(self.end) == 1
            else:
                rank, left, right = made
                found = self.is_whole(left) and self.is_whole(right)
                for x, until_x in self.spine(left, 2):
                    for y, until_y in self.spine(right, 1):
                        other = self.rank.get((x, y))
                        if other is not None and other < rank and other < until_x and other <= until_y:
                            found = False
            if made is not None or found:
                self.whole[token] = found
        return found

    def _step(self, word: str, i: int, states: list[tuple[int, str]], mark: str) -> tuple[int, str]:
        """Count and last token of word[:i], by those of its shorter prefixes, the last of ``states`` being word[: i - 1]'s."""
        whole, stands = self.whole, self.stands
        before = i - len(states)
        for j in range(max(before, i - self.longest), i):
            token = word[j:i] + mark
            if whole.get(token):
                count, last = states[j - before]
                if not j:
                    return 1, token
                fits = stands.get((last, token))
                if fits is None:
                    fits = self.may_follow(last, token)
                if fits:
                    return count + 1, token
        raise ValueError(f"no token ends at {i} of a word of {len(word)} symbols")

    def states(self, word: str) -> Iterator[list[tuple[int, str]]]:
        """The table's entries for word[:0], word[:1], ... and all of it, each with those it may build on before it."""
        nodes, opened = self.nodes, self.opened
        if len(opened) > CACHE:
            nodes.clear()
            del opened[1:]
        last, node = [opened[0]], 0
        yield last
        for i in range(1, len(word) + 1):
            if i <= SHARED:
                step = (node, word[i - 1])
                node = nodes.get(step, -1)
                if node < 0:
                    node = nodes[step] = len(opened)
                    opened.append(self._step(word, i, last, ""))
                state = opened[node]
            else:
                state = self._step(word, i, last, "")
            last.append(state)
            if len(last) > 2 * self.longest:
                del last[: -self.longest]
            yield last

    def count(self, word: str) -> int:
        """Tokens of a word."""
        for last in self.states(word[:-1]):
            pass
        return self._step(word, len(word), last, self.end)[0]

    def counts(self, word: str) -> list[int]:
        """Tokens of word[:1], word[:2], ... each taken as a whole word."""
        return [self._step(word, i, last, self.end)[0] for i, last in enumerate(self.states(word[:-1]), start=1)]


#: Letters, marks and signs up to Armenian: here Python and the library agree on
#: what is a letter, a number and white space, and lower case goes sign by sign.
_COMMON = re.compile("[^\0-\u012f\u0131-\u03a2\u03a4-\u058f]")

#: Fixed value: the vocabulary's splitting pattern, white space spelled out.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\t-\r \x85\xa0\p{L}\p{N}]+"


class TextPrefixes:
    """Token counts of all prefixes of whole texts, words split as the library splits them."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        self.words = WordPrefixes(
            parts["model"]["vocab"],
            [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in parts["model"]["merges"]],
            parts["model"]["end_of_word_suffix"],
        )
        self.special = [t["content"] for t in parts["added_tokens"]]
        self.split = regex.compile(_SPLIT).findall
        self.signs = byte_signs()
        self.totals: dict[str, int] = {}
        self.cache: dict[str, tuple[bytes, int, str]] = {}
        self.piece_cache: dict[str, list[int]] = {}

    def total(self, text: str) -> int:
        """Tokens of the whole text: the sum over its words of their last prefixes."""
        if any(s in text for s in self.special):
            return sum(1 if special else self._plain(part) for part, special in self.pieces(text))
        return self._plain(text)

    def _plain(self, text: str) -> int:
        """Tokens of a text in which special strings count as ordinary ones."""
        if _COMMON.search(text) or not unicodedata.is_normalized("NFC", text):
            n = self.tokenizer.normalizer.normalize_str(text)
            return sum(self.words.count(s) for s, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(n))
        totals, words = self.totals, self.split(text.lower())
        if len(totals) > CACHE:
            totals.clear()
        long = 0
        for w in set(words).difference(totals):
            n = self.words.count(w if w.isascii() else "".join([self.signs[b] for b in w.encode()]))
            if len(w) <= REMEMBERED:
                totals[w] = n
            else:
                long += n * words.count(w)
        return long + sum(totals[w] for w in words if len(w) <= REMEMBERED) if long else sum(map(totals.__getitem__, words))

    def pieces(self, text: str) -> Iterator[tuple[str, bool]]:
        """Runs of ordinary text and, marked true, special strings; leftmost first."""
        while True:
            found = min(((at, s) for s in self.special if (at := text.find(s)) >= 0), default=None)
            if found is None:
                yield text, False
                return
            yield text[: found[0]], False
            yield found[1], True
            text = text[found[0] + len(found[1]) :]

    def _piece(self, symbols: str) -> list[int]:
        got = self.piece_cache.get(symbols)
        if len(symbols) > REMEMBERED:
            return self.words.counts(symbols)
        if got is None:
            if len(self.piece_cache) > CACHE:
                self.piece_cache.clear()
            got = self.piece_cache[symbols] = self.words.counts(symbols)
        return got

    def chunk(self, chunk: str) -> tuple[bytes, int, str]:
        """Counts after each character of a chunk without spaces, its total, its normal form."""
        done: list[int] = []
        total, form = 0, ""
        for part, special in self.pieces(chunk):
            if special:
                # Before its last character a special string is ordinary text.
                done += [total + self._plain(part[:k]) for k in range(1, len(part))]
                total += 1
                done.append(total)
                form += part
                continue
            text = self.tokenizer.normalizer.normalize_str(part)
            form += text
            places = [total] * len(text)
            at = 0
            for symbols, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text):
                places[at:a] = [total] * (a - at)
                counts = self._piece(symbols)
                if len(symbols) == b - a:
                    places[a:b] = [total + c for c in counts]
                else:  # several bytes to a character
                    ends = np.cumsum([len(c.encode()) for c in text[a:b]]) - 1
                    places[a:b] = [total + counts[e] for e in ends]
                total += counts[-1]
                at = b
            places[at:] = [total] * (len(text) - at)
            done += places
        return np.asarray(done, "<u4").tobytes(), total, form

    def _chunks(self, text: str) -> list[tuple[bytes, int, str]]:
        cache = self.cache
        if len(cache) > CACHE:
            cache.clear()
        chunks = text.replace("\n", " ").split(" ")
        own: dict[str, tuple[bytes, int, str]] = {}
        for c in set(chunks):
            if c not in cache:
                (cache if len(c) <= REMEMBERED else own)[c] = self.chunk(c)
        return [cache[c] if c in cache else own[c] for c in chunks]

    def __call__(self, text: str) -> np.ndarray:
        """counts[0..n] for the n characters of ``self.form(text)``."""
        raw, totals, _ = zip(*self._chunks(text), strict=True)
        # One entry before each chunk: the start, or the space between two.
        inside = np.frombuffer(b"\0\0\0\0".join([b"", *raw]), "<u4")
        before = np.zeros(len(raw), np.int64)
        np.cumsum(totals[:-1], out=before[1:])
        return inside + np.repeat(before, np.fromiter(map(len, raw), np.int64, len(raw)) // 4 + 1)

    def form(self, text: str) -> str:
        """The text whose prefixes are counted: chunks normalised, a space for every space or line end."""
        return " ".join([c[2] for c in self._chunks(text)])


@lru_cache(maxsize=2)
def prefixes_of(path: str) -> TextPrefixes:
    """A worker's tables, kept from task to task."""
    return TextPrefixes(path)


def longest_prefix(counts: np.ndarray, budget: int) -> int:
    """Characters of the longest prefix with at most ``budget`` tokens."""
    return int(np.flatnonzero(counts <= budget)[-1]) if budget >= 0 else 0


def _texts(batch: pa.RecordBatch) -> Iterator[str]:
    for text in batch.column("__text"):
        yield text.as_py() or ""


def _with(docs: DataFrame, tokenizer_path: str, text: str, schema: str, add) -> DataFrame:
    """``docs`` plus the columns of ``schema`` that ``add(prefixes, texts)`` gives per batch; they replace clashing names."""
    from pyspark.sql.types import StructType

    added = StructType.fromDDL(schema)
    own = [c for c in docs.columns if c not in added.names]
    source = docs.select(*[docs[c] for c in own], F.col(text).cast("string").alias("__text"))

    def rows(batches):
        prefixes = prefixes_of(tokenizer_path)
        for batch in batches:
            columns = add(prefixes, _texts(batch))
            kept = [batch.column(c) for c in own]
            yield pa.RecordBatch.from_arrays([*kept, *columns], [*own, *added.names])

    kept_schema = StructType([f for f in source.schema.fields if f.name != "__text"])
    return widened(docs.sparkSession, source).mapInArrow(rows, StructType([*kept_schema.fields, *added.fields]))


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT, text: str = "text") -> DataFrame:
    """``docs`` plus n_bytes (UTF-8), n_tokens and over_limit, off the last prefix of each text.

    Null text counts as empty: 0 bytes, 0 tokens.  Rows are independent; an
    empty table gives no rows; columns of the added names are replaced.
    """

    def add(prefixes, texts):
        n_bytes, n_tokens = [], []
        for t in texts:
            n_bytes.append(len(t.encode()))
            n_tokens.append(prefixes.total(t))
        return [
            pa.array(n_bytes, pa.int64()),
            pa.array(n_tokens, pa.int64()),
            pa.array([n > limit for n in n_tokens], pa.bool_()),
        ]

    return _with(docs, tokenizer_path, text, "n_bytes bigint, n_tokens bigint, over_limit boolean", add)


def prefix_counts(docs: DataFrame, tokenizer_path: str, text: str = "text") -> DataFrame:
    """``docs`` plus ``normal_text`` and ``prefix_tokens``: element p is the token
    count of its first p characters (so one element more than characters).

    Null text gives "" and [0].
    """

    def add(prefixes, texts):
        forms, counts = [], []
        for t in texts:
            forms.append(prefixes.form(t))
            counts.append(prefixes(t).astype(np.int32))
        return [pa.array(forms, pa.string()), pa.array(counts, pa.list_(pa.int32()))]

    return _with(docs, tokenizer_path, text, "normal_text string, prefix_tokens array<int>", add)


def tokens_of_prefix(chars: Column | int, counts: Column | str = "prefix_tokens") -> Column:
    """Tokens of the first ``chars`` characters (all of them if there are fewer)."""
    c = F.col(counts) if isinstance(counts, str) else counts
    n = chars if isinstance(chars, Column) else F.lit(chars)
    return F.get(c, F.greatest(F.lit(0), F.least(n, F.size(c) - 1)).cast("int"))


def truncate(docs: DataFrame, tokenizer_path: str, budget: int = LIMIT, text: str = "text") -> DataFrame:
    """``docs`` plus ``kept_text``, the longest prefix of the normal text with at
    most ``budget`` tokens, and ``kept_tokens``, its count.  Null gives "" and 0."""

    def add(prefixes, texts):
        kept, n = [], []
        for t in texts:
            counts = prefixes(t)
            p = longest_prefix(counts, budget)
            kept.append(prefixes.form(t)[:p])
            n.append(int(counts[p]))
        return [pa.array(kept, pa.string()), pa.array(n, pa.int64())]

    return _with(docs, tokenizer_path, text, "kept_text string, kept_tokens bigint", add)
