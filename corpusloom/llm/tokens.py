"""Operator 1: exact token counts of every prefix of a text.

A byte-level BPE splits a text into pieces by a pattern and merges bytes inside a piece.  Inside a piece the count of
every prefix follows from a recurrence: the last token of a prefix is the one vocabulary entry that ends there and
stays as it is behind the last token of the shorter prefix, so ``count[i] = count[i - len(token)] + 1``.  The table of
a piece is computed once and kept; pieces repeat, so a text costs about one look-up a word.  Counts at piece ends add
up, which gives the table of the whole text: counts, truncation points and budget questions are then read from the
table, and nothing is encoded again.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from functools import lru_cache
from itertools import accumulate

import numpy as np
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import map_batches, tokenizer_file

#: Fixed value: the splitting pattern of this vocabulary.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Piece tables that a worker keeps before it starts anew.
KEPT_PIECES = 250_000
#: Bytes of a piece up to which its table and states are kept.
KEPT_BYTES = 128
#: Pairs of tokens whose border a worker remembers.
KEPT_PAIRS = 600_000
#: Stands for the token before the first one.
NOTHING = (1 << 20) - 1


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the vocabulary file: printable Latin-1 as itself, the others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class _Tables(dict):
    """piece -> counts at each of its byte prefixes, filled on demand."""

    def __init__(self, counter: "PrefixCounter"):
        self.counter = counter

    def __missing__(self, piece: str) -> tuple[int, ...]:
        found = self.counter.piece_table(piece.encode("utf-8", "surrogatepass"))
        if len(piece) <= KEPT_BYTES:
            if len(self) >= KEPT_PIECES:
                self.clear()
            self[piece] = found
        return found


class _Totals(dict):
    def __init__(self, tables: _Tables):
        self.tables = tables

    def __missing__(self, piece: str) -> int:
        n = self.tables[piece][-1]
        if len(piece) <= KEPT_BYTES:
            if len(self) >= KEPT_PIECES:
                self.clear()
            self[piece] = n
        return n


class PrefixCounter:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        letters = _byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        self.vocab = {raw(s): i for s, i in data["model"]["vocab"].items()}
        self.text_of = {i: b for b, i in self.vocab.items()} | {NOTHING: b""}
        self.rank: dict[tuple[bytes, bytes], int] = {}
        for k, pair in enumerate(data["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[raw(a), raw(b)] = k
        self.longest = max(map(len, self.vocab))
        self.endings = {b[k:] for b in self.vocab for k in range(len(b))}
        self.special = sorted((t["content"] for t in data["added_tokens"]), key=len, reverse=True)
        self.at_special = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.split = regex.compile(SPLIT)
        self.states: dict[bytes, tuple[tuple[int, ...], tuple[int, ...]]] = {}
        self.tables = _Tables(self)
        self.totals = _Totals(self.tables)
        self.made: dict[bytes, list[tuple[int, bytes, bytes]] | None] = {}
        self.pairs: dict[int, bool] = {}

    def _merges(self, data: bytes) -> tuple[list[bytes], list[tuple[int, bytes, bytes]]]:
        """The tokens of some bytes, and for each merge in turn: its rank, the first and the last part after it."""
        parts, steps = [data[i : i + 1] for i in range(len(data))], []
        while len(parts) > 1:
            ranks = [self.rank.get(pair, 1 << 30) for pair in zip(parts, parts[1:])]
            best = min(ranks)
            if best == 1 << 30:
                break
            at = ranks.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            steps.append((best, parts[0], parts[-1]))
        return parts, steps

    def _own(self, token: bytes) -> list[tuple[int, bytes, bytes]] | None:
        """The merges that make a token from its bytes; None if its bytes become something else."""
        if token not in self.made:
            parts, steps = self._merges(token)
            self.made[token] = steps if parts == [token] else None
        return self.made[token]

    def _stays(self, before: bytes, token: bytes) -> bool:
        """Whether ``token`` behind ``before`` is left as these two tokens (``before`` empty: as one token).

        The merges inside either token are played in order of rank, the left one first at equal rank; the two stay apart
        unless the pair across the border comes up before either of its parts is used.
        """
        right = self._own(token)
        if not before or right is None:
            return right is not None
        left = self._own(before)
        i = j = 0
        x, y, never = before[-1:], token[:1], 1 << 30
        while True:
            a = left[i][0] if i < len(left) else never
            b = right[j][0] if j < len(right) else never
            across = self.rank.get((x, y), never)
            if across < a and across <= b:
                return False
            if a == b == never:
                return True
            if a <= b:
                x, i = left[i][2], i + 1
            else:
                y, j = right[j][1], j + 1

    def piece_table(self, piece: bytes) -> tuple[int, ...]:
        """Counts of the prefixes of 0, 1, ... bytes of one piece.

        The recurrence goes on from the longest shorter piece that is known and begins this one.  Only pieces of up to
        KEPT_BYTES are kept and looked for, and a token is sought backwards for as long as some token ends so, which makes
        the work linear in the piece's length.
        """
        number, pairs, longest, states, endings = self.vocab.get, self.pairs, self.longest, self.states, self.endings
        if len(pairs) >= KEPT_PAIRS:
            pairs.clear()
        if len(states) >= KEPT_PIECES:
            states.clear()
        counts, last = [0], [NOTHING]
        for end in range(min(len(piece), KEPT_BYTES), 2, -1):
            if (known := states.get(piece[:end])) is not None:
                counts, last = list(known[0]), list(known[1])
                break
        for end in range(len(counts), len(piece) + 1):
            for start in range(end - 1, (end - longest if end > longest else 0) - 1, -1):  # only one of them stays
                token = number(part := piece[start:end])
                if token is None:
                    if part in endings:
                        continue
                    raise ValueError("no token ends here")
                before = last[start]
                stays = pairs.get(before << 20 | token)
                if stays is None:
                    stays = pairs[before << 20 | token] = self._stays(self.text_of[before], self.text_of[token])
                if stays:
                    counts.append(counts[start] + 1)
                    last.append(token)
                    break
            else:
                raise ValueError("no token ends here")
        if len(piece) > KEPT_BYTES:
            return tuple(counts)
        states[piece] = tuple(counts), tuple(last)
        return states[piece][0]

    def _of_chars(self, piece: str) -> list[int]:
        """Counts of the prefixes of 1, 2, ... characters of a piece."""
        table = self.tables[piece]
        if len(table) == len(piece) + 1:
            return list(table[1:])
        ends = accumulate(len(c.encode("utf-8", "surrogatepass")) for c in piece)
        return [table[e] for e in ends]

    def _plain_table(self, text: str) -> tuple[np.ndarray, int]:
        """Counts at the character prefixes of a text without special tokens."""
        out, base, run, run_base = [0], 0, "", 0
        for piece in self.split.findall(text):
            counts = self._of_chars(piece)
            total = self.tables[piece][-1]
            if piece in ("'re", "'ve", "'ll"):  # a cut behind the first letter leaves a quote and a letter
                counts = [1, 2, total]
            marks = [base + n for n in counts]
            if run and piece[0].isspace():  # a cut inside white space leaves one piece, not two
                for k, c in enumerate(piece):
                    if not c.isspace():
                        break
                    marks[k] = run_base + self.tables[run + piece[: k + 1]][-1]
            if piece.isspace():
                if not run:
                    run_base = base
                run += piece
            else:
                run = ""
            out += marks
            base += total
        return np.array(out, dtype=np.int32), base

    def count(self, text: str) -> int:
        return sum(1 if one else sum(map(self.totals.__getitem__, self.split.findall(part))) for one, part in self._parts(text))

    def _parts(self, text: str) -> list[tuple[bool, str]]:
        """(is a special token, text) in order."""
        if self.at_special is None or not any(s in text for s in self.special):
            return [(False, text)]
        parts, at = [], 0
        for m in self.at_special.finditer(text):
            parts += [(False, text[at : m.start()]), (True, m[0])]
            at = m.end()
        return [*parts, (False, text[at:])]

    def table(self, text: str) -> np.ndarray:
        """Exact counts of the prefixes of 0, 1, ... characters of the text."""
        parts = self._parts(text)
        out, base = [np.zeros(1, np.int32)], 0
        for k in range(0, len(parts), 2):
            plain = parts[k][1]
            mark = parts[k + 1][1] if k + 1 < len(parts) else ""
            marks, _ = self._plain_table(plain + mark[:-1])  # a cut special token is ordinary text
            out.append(base + marks[1:])
            base += self.count(plain)
            if mark:
                base += 1
                out.append(np.array([base], np.int32))
        return np.concatenate(out)

    def longest_prefix(self, text: str, budget: int) -> int:
        """Characters of the longest prefix of at most ``budget`` tokens."""
        return self.count_and_fit(text, budget)[1]

    def count_and_fit(self, text: str, budget: int) -> tuple[int, int]:
        """Tokens of a text, and characters of the longest prefix within a budget, from the tables of the pieces at the border."""
        if self.at_special is not None and any(s in text for s in self.special):
            n = self.count(text)
            return n, len(text) if n <= budget else int(np.flatnonzero(self.table(text) <= budget)[-1])
        pieces = self.split.findall(text)
        counts = list(map(self.totals.__getitem__, pieces))
        total = sum(counts)
        if total <= budget:
            return total, len(text)
        sums = list(accumulate(counts))
        k = bisect_right(sums, budget)  # the first piece that ends beyond the budget
        first = k
        while first > 0 and pieces[first - 1].isspace():
            first -= 1
        # one white-space run and one piece more may still end within it
        stop = k + 1
        while stop < len(pieces) and pieces[stop - 1].isspace():
            stop += 1
        head = sum(map(len, pieces[:first]))
        marks, _ = self._plain_table("".join(pieces[first:stop]))
        start = sums[first - 1] if first else 0
        return total, head + int(np.flatnonzero(start + marks <= budget)[-1])


@lru_cache(maxsize=4)
def prefix_counter(path: str) -> PrefixCounter:
    """One counter a worker process."""
    return PrefixCounter(path)


def with_prefix_counts(df: DataFrame, key: str, text: str, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """(key, prefix_tokens array<int>): the count of every character prefix, the empty one first.

    A null text counts as empty: its table is ``[0]``.  The table has one entry a character and one more.
    """

    def rows(columns):
        counter = prefix_counter(tokenizer_file(tokenizer))
        for k, t in zip(*columns, strict=True):
            yield k, counter.table(t or "").tolist()

    kind = df.schema[key].dataType.simpleString()
    return map_batches(
        df.select(F.col(key).alias("key"), F.col(text).alias("text")), rows, f"key {kind}, prefix_tokens array<int>", most=64
    ).withColumnRenamed("key", key)


def tokens_of(prefix_tokens: Column) -> Column:
    """Tokens of the whole text, from its stored table."""
    return F.element_at(prefix_tokens, -1)


def fitting_chars(prefix_tokens: Column, budget: int) -> Column:
    """Characters of the longest prefix within a budget, from the stored table."""
    within = F.transform(prefix_tokens, lambda n, i: F.when(n <= budget, i).otherwise(F.lit(-1)))
    return F.array_max(within)


def token_counts(
    df: DataFrame, key: str = "doc_id", text: str = "text", budget: int = 1024, tokenizer: str = "byte_bpe_50k.json"
) -> DataFrame:
    """One row per row of ``df``: key, n_bytes, n_tokens, over_limit, fitting_chars (longest prefix within the budget).

    The tables are used piece by piece and not stored, so a row stays small whatever the length of its text.  Null and
    empty texts have 0 bytes and 0 tokens; repeated rows and null keys are kept.
    """

    def rows(columns):
        counter = prefix_counter(tokenizer_file(tokenizer))
        for k, t in zip(*columns, strict=True):
            t = t or ""
            n, fit = counter.count_and_fit(t, budget)
            yield k, len(t.encode("utf-8", "surrogatepass")), n, n > budget, fit

    kind = df.schema[key].dataType.simpleString()
    schema = f"key {kind}, n_bytes long, n_tokens long, over_limit boolean, fitting_chars long"
    return map_batches(df.select(F.col(key).alias("key"), F.col(text).alias("text")), rows, schema).withColumnRenamed("key", key)
