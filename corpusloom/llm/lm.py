"""Operator 7: language-model scores by online logistic context mixing.

A text is coded as binary decisions.  For each token: the decisions that lead to its word, and whether it repeats an
earlier token of the text or is drawn from the corpus, which a word beyond the most frequent ones is once a text, so that
the chances of all next tokens add up to one at most.  Several predictors give a prediction of each decision: tables of
the corpus, given the leading word of the text so far and given the token before, and adaptive tables addressed by a hash
of the decision and a context (the class before, the token before).  They are mixed in the logistic domain by weights
that the kind of decision selects, and tables and weights are refined after every token.  A token never seen in training
is spelled out byte by byte, again by mixed bit predictors, over the last one to four bytes, whose tables come from all
words of the corpus.  The sum is the score; over the bytes of a text it gives bits per byte.

A word's decisions are those of the Huffman code of the corpus counts (:func:`code_words`): tables and weights run on from
the first token of a text to its last, and texts of like length are coded side by side.  An older form
(:func:`code_texts`) codes a frequency class along a tree, gives the word inside it the corpus share, and starts tables and
weights anew in each block of a fixed number of tokens, its lanes.

Corpus counts come from one aggregation over all training texts.  The most frequent words, a fixed number, go to every
task; all others are looked up by a join, after counting them per document.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import map_tasks, remainder, saved

#: Words that every task knows, and bytes of such a word at most: the bound of what is broadcast.
HEAD, HEAD_BYTES = 1 << 16, 64
#: Frequent words that can lead a text; the weight of the corpus in a leader's shares.
ANCHORS, SMOOTH = 32, 100.0
#: Tokens of a lane; slots of a predictor's table in a lane; rates of tables and weights.
LANE, SLOTS, TABLE_RATE, WEIGHT_RATE = 512, 128, 0.05, 0.02
#: Log-odds, far into a text, that a token repeats an earlier one of the text.
REPEAT = -1.5
#: Classes: 0..6 by the logarithm of the rank, 7 for words beyond the head; bits of a class.
TAIL, CLASS_BITS = 7, 3
#: Whole words: slots of a text's table, weights at the start (leader, token before, and the text's own two), texts side by
#: side and tokens of a stretch, cells of the corpus table of nodes after a token, and the weight of the leader's share there.
WORD_SLOTS, WORD_WEIGHTS, SIDE, STEP_TOKENS = 1 << 10, (0.5, 0.5, 0.4, 0.4), 256, 4_000
PAIR_CELLS, PAIR_SMOOTH = 1 << 17, 16.0
#: Bytes of texts that are coded at once, in lanes and as whole texts.
TEXT_RUN, WORD_RUN = 5_000_000, 10_000_000
#: Slots of a spelling table, orders of its contexts, rate of its weights.
SPELL_SLOTS, ORDERS, SPELL_RATE = 1 << 15, (1, 2, 3, 4), 0.02
#: Unseen words that a task spells at once.
SPELLED = 20_000
END = b""


def words_of(text: str | None) -> list[bytes]:
    """Lower-case (A-Z) words as UTF-8 and the end, which is the empty word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    words.append(END)
    return words


def _words(texts: pa.Array) -> pa.ListArray:
    """:func:`words_of` for many texts at once, as strings."""
    texts = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    # a space at the end makes the last word empty; an empty text is one empty word as it stands
    ended = pc.binary_join_element_wise(texts, pa.scalar("", texts.type), pa.scalar(" ", texts.type))
    return pc.ascii_split_whitespace(pc.if_else(pc.equal(texts, ""), texts, ended))


def _runs(texts: pa.Array, most: int):
    """Runs of texts of bounded size; a longer text is a run of its own."""
    first = size = 0
    for k, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if k > first and size + n > most:
            yield texts.slice(first, k - first)
            first, size = k, 0
        size += n
    if len(texts):
        yield texts.slice(first)


def corpus_counts(texts: DataFrame) -> DataFrame:
    """(token, c) over a column ``text``; counted in tasks first."""

    def rows(batches):
        for batch in batches:
            for run in _runs(batch.column(0), WORD_RUN):
                found = pc.value_counts(_words(run).flatten())
                yield pa.RecordBatch.from_arrays([found.field("values").cast(pa.string()), found.field("counts")], ["token", "c"])

    return texts.select("text").mapInArrow(rows, "token string, c long").groupBy("token").agg(F.sum("c").alias("c"))


class Head:
    """The frequent words with their classes, and their shares given the leading word of the text so far.

    The leading word, among the ANCHORS most frequent ones, is the one that the text has used most; it tells languages
    and styles apart.  ``by_leader`` counts head words (and the tail, last) by leader.
    """

    def __init__(self, ranked: list[tuple[str, int]], total: int, types: int, once: int):
        self.total, self.types, self.once = total, types, once
        self.number = {t.encode("utf-8", "surrogatepass"): k for k, (t, _) in enumerate(ranked)}
        self.size = len(ranked)
        self.words = pa.array([t for t, _ in ranked], pa.string())
        self.count = np.array([c for _, c in ranked] + [0], dtype=np.int64)  # the last one stands for words beyond
        self.tail = max(0, total - int(self.count.sum()))
        self.base_head = np.log10(self.count + 0.1)
        self.base_each = math.log10(total + 0.1 * (types + 1))
        self.new = (once + 0.5) / (self.tail + once + 1)
        self.cls = np.append(np.minimum(np.log2(np.arange(1, self.size + 1)) / 3, TAIL - 1).astype(np.int64), TAIL)
        self.anchor = np.full(self.size + 1, -1, dtype=np.int64)
        spots = [k for k, (t, _) in enumerate(ranked) if t][:ANCHORS]
        self.anchor[spots] = np.arange(len(spots))

    def learn_leaders(self, by_leader: np.ndarray) -> None:
        """Shares of words in their class and of ones at the nodes of the class tree, for each leader."""
        n = 1 << CLASS_BITS
        every = self.count.astype(float)
        every[-1] = self.tail + self.once + 0.5  # as many unseen words are to come as there are words seen once
        mass = np.bincount(self.cls, weights=every, minlength=n)
        share = every / mass[self.cls]
        own = np.zeros((ANCHORS + 1, n))
        for g in range(ANCHORS + 1):
            own[g] = np.bincount(self.cls, weights=by_leader[g], minlength=n)
        word = (by_leader + SMOOTH * share) / (own[:, self.cls] + SMOOTH)
        word[:, -1] = 1.0
        self.word = word.astype(np.float32)
        beyond = 1 + self.once / max(1, self.tail) if self.tail else 1.0
        own[:, TAIL] *= beyond
        tree = np.zeros((ANCHORS + 1, 2 * n))
        tree[:, n:] = own + SMOOTH * (mass + 0.5) / (mass + 0.5).sum()
        for node in range(n - 1, 0, -1):
            tree[:, node] = tree[:, 2 * node] + tree[:, 2 * node + 1]
        self.prior = np.zeros((ANCHORS + 1, n), dtype=np.float32)
        for node in range(1, n):
            one = np.clip(tree[:, 2 * node + 1] / tree[:, node], 1e-6, 1 - 1e-6)
            self.prior[:, node] = np.log(one / (1 - one))


def leaders(known: np.ndarray, starts: np.ndarray, lengths: np.ndarray, head: Head) -> np.ndarray:
    """For each token the anchor that its text has used most before it; ANCHORS if none."""
    out = np.empty(len(known), dtype=np.int64)
    anchor = head.anchor[known]
    for a, n in zip(starts.tolist(), lengths.tolist(), strict=True):
        mine = anchor[a : a + n]
        at = np.flatnonzero(mine >= 0)
        counts, best, changes = [0] * ANCHORS, ANCHORS, [ANCHORS]
        for x in mine[at].tolist():
            counts[x] += 1
            if best == ANCHORS or counts[x] > counts[best] or counts[x] == counts[best] and x < best:
                best = x
            changes.append(best)
        out[a : a + n] = np.repeat(changes, np.diff(np.concatenate([[-1], at, [n - 1]])))
    return out


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -15, 15)))


class _Mixer:
    """Predictors and weights of many lanes."""

    def __init__(self, lanes: int):
        self.delta = np.zeros((2, lanes * SLOTS), dtype=np.float32)
        self.weight = np.full((4, lanes * (CLASS_BITS + 1)), 0.4, dtype=np.float32)
        self.weight[0] = 1.0

    def predict(self, lane: np.ndarray, gate: int, prior: np.ndarray, contexts: tuple) -> tuple:
        """The chance of a one in each lane, and what :meth:`learn` needs."""
        slots = [lane * SLOTS + (c & (SLOTS - 1)) for c in contexts]
        inputs = [prior, self.delta[0, slots[0]], self.delta[1, slots[1]]]
        at = lane * (CLASS_BITS + 1) + gate
        weights = [self.weight[k, at] for k in range(3)]
        p = _squash(weights[0] * inputs[0] + weights[1] * inputs[1] + weights[2] * inputs[2])
        return p, (at, slots, inputs, weights)

    def learn(self, p: np.ndarray, made: tuple, bit: np.ndarray) -> None:
        """Refines tables and weights by what came; ``bit`` may lie between 0 and 1."""
        at, slots, inputs, weights = made
        err = bit - p
        for k, s in enumerate(slots):
            self.delta[k, s] = inputs[k + 1] + TABLE_RATE * err
        err = WEIGHT_RATE * err
        for k in range(3):
            self.weight[k, at] = weights[k] + err * inputs[k]


def _token_before(known: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A number for the token before each token."""
    out = np.roll(known, 1) * 0x85EB
    out[starts] = 7
    return out


class _History:
    """What is known before each token of texts that lie one after the other, in narrow types: a task holds many tokens."""

    def __init__(self, flat: np.ndarray, lengths: np.ndarray, head: Head):
        total = len(flat)
        starts = np.cumsum(lengths) - lengths
        self.of = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        self.at = (np.arange(total) - np.repeat(starts, lengths)).astype(np.int32)
        # earlier occurrences of the same token in the same text
        key = flat * total
        key += np.arange(total)
        key.sort()
        token, order = np.divmod(key, total)
        new = np.ones(total, dtype=bool)
        new[1:] = (token[1:] != token[:-1]) | (self.of[order[1:]] != self.of[order[:-1]])
        del key, token
        seen = np.arange(total) - np.maximum.accumulate(np.where(new, np.arange(total), 0))
        self.repeat = np.empty(total, dtype=np.float32)
        self.repeat[order] = seen / np.maximum(self.at[order], 1)
        del seen, order, new
        known = np.minimum(flat, head.size)
        self.leader = leaders(known, starts, lengths, head).astype(np.int8)
        self.token_before = _token_before(known, starts).astype(np.uint32)
        self.before = (np.roll(head.cls[known], 1) + 1).astype(np.int32)
        self.before[starts] = 0
        self.before *= 0x9E37
        self.known = known.astype(np.int32)


def _repeat_prior(at: np.ndarray) -> np.ndarray:
    """Log-odds that a token at a place repeats an earlier one."""
    return (np.log((at + 1.0) / (at + 301.0)) + REPEAT).astype(np.float32)


def code_texts(flat: np.ndarray, lengths: np.ndarray, head: Head) -> np.ndarray:
    """Bits of each text given the numbers of its tokens, without what words beyond the head cost inside their class.

    ``flat`` holds the texts one after the other.  Numbers from the head's size on stand for other words, each distinct in
    its text.
    """
    past = _History(flat, lengths, head)
    total, of, at, known, leader, repeat = len(flat), past.of, past.at, past.known, past.leader, past.repeat
    before, token_before, cls, chance = past.before.astype(np.int64), past.token_before.astype(np.int64), head.cls[known], _repeat_prior(at)
    # a word beyond the head is drawn from the corpus once a text: what comes again costs its repeat, as its share is not known here
    fresh = np.where((known == head.size) & (repeat > 0), np.float32(0), head.word[leader, known])

    step = at % LANE
    lane_first = step == 0
    lane_of = np.cumsum(lane_first) - 1
    by_step = np.argsort(step.astype(np.uint16), kind="stable")
    edges = np.searchsorted(step[by_step], np.arange(min(LANE, int(lengths.max())) + 1))
    mixer = _Mixer(int(lane_first.sum()))
    cost = np.zeros(total, dtype=np.float64)
    for s in range(len(edges) - 1):
        here = by_step[edges[s] : edges[s + 1]]
        lane, prev, tok, mine, lead = lane_of[here], before[here], token_before[here], cls[here], leader[here]
        node = np.ones(len(here), dtype=np.int64)
        p_fresh = fresh[here]
        for k in range(CLASS_BITS):
            bit = (mine >> (CLASS_BITS - 1 - k)) & 1
            p, made = mixer.predict(lane, 1 + k, head.prior[lead, node], ((prev >> 4) + node, (tok >> 3) + node))
            mixer.learn(p, made, bit.astype(np.float32))
            p_fresh = p_fresh * np.where(bit > 0, p, 1 - p)
            node = 2 * node + bit
        # seen before in this text or drawn from the corpus: both ways count, and the share of the first is learned
        p, made = mixer.predict(lane, 0, chance[here], (prev >> 4, tok >> 3))
        again = p * repeat[here]
        both = again + (1 - p) * p_fresh
        mixer.learn(p, made, again / both)
        cost[here] = -np.log2(both)
    return np.bincount(of, weights=cost, minlength=len(lengths))


# --- whole words by mixed bits -------------------------------------------------------------------------------------


def _huffman(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parent and side (0 or 1) of each node: leaves first, in the order of ``weights``, the root last."""
    heap = [(w, k) for k, w in enumerate(weights.tolist())]
    heapq.heapify(heap)
    n = len(heap)
    up, side = np.zeros(2 * n - 1, dtype=np.int64), np.zeros(2 * n - 1, dtype=np.int64)
    for node in range(n, 2 * n - 1):
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        up[a[1]] = up[b[1]] = node
        side[b[1]] = 1
        heapq.heappush(heap, (a[0] + b[0], node))
    return up, side


class Tree:
    """A word of the head, or the tail, as binary decisions: the Huffman code of the corpus counts.

    ``first``, ``depth`` tell where the decisions of a leaf lie in ``node`` and ``bit``.  The root is node 0.
    """

    def __init__(self, head: Head):
        weights = head.count.astype(float)
        weights[-1] = head.tail + head.once + 0.5  # as many unseen words are to come as there are words seen once
        if len(weights) == 1:
            weights = np.append(weights, 0.5)  # without a head a word is beyond it
        self.weights = weights
        self.up, self.side = _huffman(weights)
        n, root = len(weights), 2 * len(weights) - 2
        at = live = np.arange(n)
        leaf, node, bit = [], [], []
        while len(live):
            leaf.append(live)
            node.append(root - self.up[at])
            bit.append(self.side[at])
            at = self.up[at]
            live, at = live[at != root], at[at != root]
        leaf = np.concatenate(leaf[::-1])  # nodes near the root come first
        order = np.argsort(leaf, kind="stable")
        self.depth = np.bincount(leaf, minlength=n)
        self.first = np.cumsum(self.depth) - self.depth
        self.node = np.concatenate(node[::-1])[order].astype(np.int32)
        self.bit = np.concatenate(bit[::-1])[order].astype(np.int8)

    def learn(self, head: Head, by_leader: np.ndarray, pairs: np.ndarray) -> None:
        """Log-odds of a one at each node for each leader, and the counts of zeros and ones after each token before."""
        n = len(self.weights)
        mass = np.zeros((2 * n - 1, ANCHORS + 1))
        mass[: by_leader.shape[1]] = by_leader.T
        if head.tail:
            mass[head.size] *= 1 + head.once / head.tail
        mass[:n] += SMOOTH * (self.weights / self.weights.sum())[:, None]
        ones = np.zeros((n - 1, ANCHORS + 1))
        root = 2 * n - 2
        for k in range(root):
            mass[self.up[k]] += mass[k]
            if self.side[k]:
                ones[root - self.up[k]] = mass[k]
        share = np.clip(ones / mass[n:][::-1], 1e-6, 1 - 1e-6)
        self.odds = np.ascontiguousarray(np.log(share / (1 - share)).astype(np.float32).T)  # nodes near the root lie together
        self.pairs = pairs.astype(np.float32)
        del self.up, self.side, self.weights

    def spread(self, leaf: np.ndarray, token_before: np.ndarray) -> tuple[np.ndarray, ...]:
        """The decisions of tokens, one token after the other: number by token, first by token, node, bit, hash of node, hash of node and token before.

        Hashes are of 32 bits; no use of them looks further.
        """
        depth = self.depth.take(leaf)
        start = np.cumsum(depth) - depth
        spot = np.repeat(self.first.take(leaf) - start, depth)
        spot += np.arange(len(spot))
        node = self.node.take(spot)
        hashed = node.view(np.uint32) * np.uint32(0x9E3779B1)
        pair = np.repeat(token_before.astype(np.uint32) * np.uint32(0x2545F491), depth)
        pair += hashed
        return depth, start, node, self.bit.take(spot), hashed, pair


def _pair_cell(pair: np.ndarray) -> np.ndarray:
    return ((pair >> np.uint32(7)) & np.uint32(PAIR_CELLS - 1)).astype(np.int64)


def code_words(flat: np.ndarray, lengths: np.ndarray, head: Head, tree: Tree) -> np.ndarray:
    """Bits of each text, as :func:`code_texts`, with every decision of a word coded by mixed predictors.

    Tables and weights of a text run on from its first token to its last.  All decisions of a token are predicted before
    any of them is learned.  Texts are coded side by side, in rows that go on with another text, and new tables, where one ends.
    """
    past = _History(flat, lengths, head)
    row, offset, ends = _in_rows(lengths)
    widths = np.searchsorted(-ends, -np.arange(int(ends[0])), side="left")  # rows with a token at each step
    begins = np.cumsum(widths) - widths
    here = np.empty(len(flat), dtype=np.int64)  # tokens, one step after the other
    here[begins.take(past.at + np.repeat(offset, lengths)) + np.repeat(row, lengths)] = np.arange(len(flat))
    coder, step, bits = _Rows(len(ends), head, tree), 0, np.zeros(len(lengths))
    while step < len(widths):
        some = widths[step : step + max(1, STEP_TOKENS // int(widths[step]))]  # steps with a bounded number of tokens
        now = here[begins[step] : begins[step] + int(some.sum())]
        bits -= np.bincount(past.of[now], weights=np.log2(coder.code(now, some, past)), minlength=len(lengths))
        step += len(some)
    return bits


def _in_rows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The row of each text and where in it the text begins, and the rows' ends, the last one first: SIDE rows at most, of like length."""
    count = min(SIDE, -(-int(lengths.sum()) // int(lengths.max())))
    row, offset = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    heap = [(0, k) for k in range(count)]
    for text in np.argsort(-lengths, kind="stable").tolist():
        offset[text], row[text] = heap[0]
        heapq.heapreplace(heap, (heap[0][0] + int(lengths[text]), heap[0][1]))
    heap.sort(reverse=True)
    rank = np.empty(count, dtype=np.int64)
    rank[[k for _, k in heap]] = np.arange(count)
    return rank[row], offset, np.array([end for end, _ in heap])


def _chance(x: np.ndarray) -> np.ndarray:
    """The chance of log-odds, which are overwritten; beyond 15 either way they count as 15."""
    np.minimum(np.maximum(x, np.float32(-15), out=x), np.float32(15), out=x)
    np.exp(np.negative(x, out=x), out=x)
    x += np.float32(1)
    return np.reciprocal(x, out=x)


class _Rows:
    """Tables and weights of texts that are coded side by side, one text a row at a time.

    Four weights of a decision stand together and move as one number of 16 bytes.
    """

    def __init__(self, count: int, head: Head, tree: Tree):
        self.head, self.tree, self.gates = head, tree, int(tree.depth.max())
        self.tables = np.empty((2, count * WORD_SLOTS), dtype=np.float32)
        self.weights = np.empty(count * self.gates, dtype=np.complex128)
        self.again = np.empty((2, count * SLOTS), dtype=np.float32)
        self.again_weights = np.empty((3, count), dtype=np.float32)

    def code(self, here: np.ndarray, widths: np.ndarray, past: _History) -> np.ndarray:
        """The chances of the tokens ``here``, which are those of some steps; the first rows are those that go on."""
        edges = np.concatenate([[0], np.cumsum(widths)])
        row = np.arange(len(here)) - np.repeat(edges[:-1], widths)
        at = past.at.take(here)
        begun: dict[int, list[int]] = {}
        for k in np.flatnonzero(at == 0).tolist():
            begun.setdefault(int(np.searchsorted(edges, k, side="right")) - 1, []).append(int(row[k]))
        leaf, repeat, before, token_before = (x.take(here) for x in (past.known, past.repeat, past.before, past.token_before))
        fresh = self._words(row, edges, begun, leaf, past.leader.take(here), before, token_before)
        # a word beyond the head is drawn from the corpus once a text: what comes again costs its repeat, as its share is not known here
        fresh[(leaf == self.head.size) & (repeat > 0)] = 0.0
        return self._repeats(row, edges, begun, at, before, token_before, repeat, fresh)

    def _words(self, row, edges, begun, leaf, leader, before, token_before) -> np.ndarray:
        """The chance of each token's word by its decisions."""
        tree, gates = self.tree, self.gates
        depth, start, node, bit, hashed, pair = tree.spread(leaf, token_before)
        x = np.empty((4, len(node)), dtype=np.float32)
        spot = np.repeat(leader.astype(np.int64) * tree.odds.shape[1], depth)
        spot += node
        tree.odds.ravel().take(spot, out=x[0], mode="clip")  # all are within it, and this mode writes in place
        share = np.negative(x[0])
        share = np.float32(PAIR_SMOOTH) / (np.exp(share, out=share) + np.float32(1))
        zeros, ones = tree.pairs.view(np.complex64).ravel().take(_pair_cell(pair)).view(np.float32).reshape(-1, 2).T
        ones = ones + share
        ones /= zeros + (np.float32(PAIR_SMOOTH) - share)
        np.log(ones, out=x[1])
        hashed += np.repeat(before.astype(np.uint32) * np.uint32(0x85EB), depth)
        base = np.repeat(row * WORD_SLOTS, depth)
        by_class = ((hashed >> np.uint32(5)) & np.uint32(WORD_SLOTS - 1)) + base
        by_token = ((pair >> np.uint32(5)) & np.uint32(WORD_SLOTS - 1)) + base
        gate = np.repeat(row * gates - start, depth)
        gate += np.arange(len(node))
        bit = bit.astype(np.float32)
        wrong = np.empty(len(node), dtype=np.float32)
        first, second = self.tables
        packed = np.empty((int(np.diff(edges).max()) * gates, 4), dtype=np.float32)
        cuts = np.append(start, len(node))[edges].tolist()
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if k in begun:
                self.tables.reshape(2, -1, WORD_SLOTS)[:, begun[k]] = 0
                self.weights.reshape(-1, gates)[begun[k]] = np.array(WORD_WEIGHTS, dtype=np.float32).view(np.complex128)
            s, t, g, inputs = by_class[a:b], by_token[a:b], gate[a:b], x[:, a:b]
            inputs[2], inputs[3] = first[s], second[t]
            w = np.ascontiguousarray(self.weights[g].view(np.float32).reshape(-1, 4).T)
            err = np.subtract(bit[a:b], _chance(np.einsum("ij,ij->j", w, inputs)), out=wrong[a:b])
            gone = np.float32(TABLE_RATE) * err
            first[s], second[t] = inputs[2] + gone, inputs[3] + gone
            w += (np.float32(WEIGHT_RATE) * err) * inputs
            to = packed[: b - a]
            to.T[:] = w
            self.weights[g] = to.view(np.complex128).ravel()
        return np.multiply.reduceat(1 - np.abs(wrong).astype(np.float64), start)

    def _repeats(self, row, edges, begun, at, before, token_before, repeat, fresh) -> np.ndarray:
        """The chance of each token with that of repeating an earlier one."""
        first, second = self.again
        base = row * SLOTS
        by_class = ((before >> 4) & (SLOTS - 1)) + base
        by_token = ((token_before >> np.uint32(3)) & np.uint32(SLOTS - 1)) + base
        x = np.empty((3, len(row)), dtype=np.float32)
        x[0], both = _repeat_prior(at), np.empty(len(row))
        for k, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
            if k in begun:
                self.again.reshape(2, -1, SLOTS)[:, begun[k]] = 0
                self.again_weights[:, begun[k]] = np.array([[1.0], [0.4], [0.4]], dtype=np.float32)
            s, t, inputs, w = by_class[a:b], by_token[a:b], x[:, a:b], self.again_weights[:, : b - a]
            inputs[1], inputs[2] = first[s], second[t]
            p = _chance(np.einsum("ij,ij->j", w, inputs))
            same = p * repeat[a:b]
            both[a:b] = total = same + (1 - p) * fresh[a:b]
            err = (same / total - p).astype(np.float32)
            gone = np.float32(TABLE_RATE) * err
            first[s], second[t] = inputs[1] + gone, inputs[2] + gone
            w += (np.float32(WEIGHT_RATE) * err) * inputs
        return both


def _coded(texts: pa.Array, head: Head) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Numbers of the tokens of all texts, one text after the other, the texts' lengths, and what the numbers beyond the head stand for."""
    split = _words(texts)
    words = split.flatten()
    flat = pc.fill_null(pc.index_in(words, value_set=head.words.cast(words.type)), -1).to_numpy().astype(np.int64)
    others = np.flatnonzero(flat < 0)
    named = words.take(pa.array(others)).dictionary_encode()
    flat[others] = head.size + named.indices.to_numpy()
    return flat, pc.list_value_length(split).to_numpy().astype(np.int64), named.dictionary


def corpus_cells(texts: DataFrame, head: Head, tree: Tree | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Counts of head words (and of all others, last) by the leader before them, over a column ``text``.

    With a tree also the counts of zeros and ones of its nodes by a hash of node and token before.  Both have a fixed
    number of cells.
    """
    handle = texts.sparkSession.sparkContext.broadcast((head, tree))
    width = head.size + 1
    size = (ANCHORS + 1) * width
    most = size + (2 * PAIR_CELLS if tree else 0)

    def rows(batches):
        h, tr = handle.value
        cells = np.zeros(most, dtype=np.int64)
        for batch in batches:
            for run in _runs(batch.column(0), TEXT_RUN):
                flat, lengths, _ = _coded(run, h)
                known, starts = np.minimum(flat, h.size), np.cumsum(lengths) - lengths
                leader = leaders(known, starts, lengths, h)
                cells[:size] += np.bincount(leader * width + known, minlength=size)
                if tr:
                    before = _token_before(known, starts)
                    for k in range(0, len(known), 20_000):
                        *_, bit, _, pair = tr.spread(known[k : k + 20_000], before[k : k + 20_000])
                        cells[size:] += np.bincount(2 * _pair_cell(pair) + bit, minlength=2 * PAIR_CELLS)
        at = np.flatnonzero(cells)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(cells[at])], ["cell", "n"])

    found = texts.select("text").mapInArrow(rows, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(most)
    out[found["cell"].to_numpy()] = found["n"].to_numpy()
    return out[:size].reshape(ANCHORS + 1, width), out[size:].reshape(-1, 2) if tree else None


def _scan(docs: DataFrame, head: Head, tree: Tree | None) -> DataFrame:
    """Per row: bits and base of the head words, and the other words with their numbers, once each."""
    handle = docs.sparkSession.sparkContext.broadcast((head, tree))
    other = pa.struct([("token", pa.string()), ("tf", pa.int32())])

    def scanned(texts, h, tr):
        flat, lengths, named = _coded(texts, h)
        bits = code_words(flat, lengths, h, tr) if tr else code_texts(flat, lengths, h)
        of, inside = np.repeat(np.arange(len(lengths)), lengths), flat < h.size
        base = np.bincount(of[inside], weights=h.base_head[flat[inside]], minlength=len(lengths)) - lengths * h.base_each
        key, tf = np.unique(of[~inside] * max(1, len(named)) + flat[~inside] - h.size, return_counts=True)
        text, word = np.divmod(key, max(1, len(named)))
        words = pa.StructArray.from_arrays([named.take(pa.array(word)).cast(pa.string()), pa.array(tf, pa.int32())], fields=list(other))
        offsets = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(lengths)))])
        return [lengths, np.bincount(of[inside], minlength=len(lengths)), base, bits, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), words)]

    def rows(batches):
        h, tr = handle.value
        names = ["doc_id", "n_bytes", "n_tokens", "n_head", "base", "bits", "others"]
        for batch in batches:
            at = 0
            for run in _runs(batch.column(1), WORD_RUN if tr else TEXT_RUN):
                size = pc.fill_null(pc.binary_length(run), 0).cast(pa.int64())
                made = pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(run)), size, *(x if isinstance(x, pa.Array) else pa.array(x) for x in scanned(run, h, tr))], names)
                yield from (made.slice(k, 1024) for k in range(0, len(run), 1024))
                at += len(run)

    schema = "doc_id long, n_bytes long, n_tokens long, n_head long, base double, bits double, others array<struct<token: string, tf: int>>"
    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(rows, schema)


# --- spelling of unseen words -------------------------------------------------------------------------------------


def _contexts(data: np.ndarray, pos: int, count: int) -> np.ndarray:
    """A hash of the last 1..4 bytes before ``pos``, by order, for the first words of ``data``, which holds a byte of all words a row."""
    out = np.empty((len(ORDERS), count), dtype=np.uint32)
    for n, h in zip(ORDERS, out, strict=True):
        h[:] = n * 0x9E3779B1 & 0xFFFFFFFF
        for k in range(pos - n, pos):
            h *= np.uint32(0x1B3)
            h += data[k, :count] if k >= 0 else np.uint32(257)
    return out


def _walk(words: list[bytes]):
    """For each bit of each word and its closing space: (rows, slots by order, bit)."""
    lengths = np.array([len(w) + 1 for w in words])
    order = np.argsort(-lengths, kind="stable")
    width = int(lengths.max())
    data = np.zeros((width, len(words)), dtype=np.uint8)
    for k, at in enumerate(order.tolist()):
        data[: len(words[at]) + 1, k] = np.frombuffer(words[at] + b" ", dtype=np.uint8)
    counts = np.searchsorted(-lengths[order], -np.arange(width), side="left").tolist()  # words with a byte at each place
    for pos, count in enumerate(counts):
        rows = order[:count]
        contexts = _contexts(data, pos, count) * np.uint32(0x9E3779B1)
        partial = np.ones(count, dtype=np.uint32)
        for b in range(7, -1, -1):
            bit = (data[pos, :count] >> b) & 1
            yield rows, ((contexts + partial * np.uint32(0x85EBCA6B)) >> np.uint32(9)) & np.uint32(SPELL_SLOTS - 1), bit
            partial += partial
            partial += bit


def _chunks(words: list[str], most: int = 4096, size: int = 4_000_000):
    """Words in runs whose padded bytes stay bounded (a longer word alone)."""
    run, width = [], 0
    for w in sorted((w.encode("utf-8", "surrogatepass") for w in words), key=len):
        if run and (len(run) >= most or (len(run) + 1) * (len(w) + 1) > size):
            yield run
            run = []
        run.append(w)
    if run:
        yield run


def spelling(counts: DataFrame) -> np.ndarray:
    """Counts of zeros and ones by order and slot, over all words of the corpus, each once."""
    cells = len(ORDERS) * SPELL_SLOTS * 2
    by_order = np.arange(len(ORDERS), dtype=np.uint32)[:, None] * np.uint32(SPELL_SLOTS)

    def rows(batches):
        table = np.zeros(cells, dtype=np.int64)
        for (column,) in batches:
            hit, size = [], 0
            for run in _chunks([w for w in column if w]):
                for _, slots, bit in _walk(run):
                    hit.append(((slots + by_order) * np.uint32(2) + bit).ravel())
                    size += slots.size
                    if size > 2_000_000:
                        table += np.bincount(np.concatenate(hit), minlength=cells)
                        hit, size = [], 0
            if hit:
                table += np.bincount(np.concatenate(hit), minlength=cells)
        at = np.flatnonzero(table)
        if len(at):
            yield at.astype(np.int32), table[at]

    found = map_tasks(counts.select("token"), rows, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # a fixed number of cells
    table = np.zeros(cells)
    table[found["cell"].to_numpy()] = found["n"].to_numpy()
    return table.reshape(len(ORDERS), SPELL_SLOTS, 2)


def spell(words: list[str], table: np.ndarray) -> list[float]:
    """Bits of each word and its end."""
    out: dict[bytes, float] = {}
    n = table.sum(2)
    stretch = np.log((table[:, :, 1] + 0.4) / (table[:, :, 0] + 0.4))
    known = np.log1p(n)
    told = (stretch * np.minimum(known, 6.0) / 6.0).ravel()
    gates = np.minimum(known[-1].astype(np.int64), 3)
    by_order = np.arange(len(ORDERS))[:, None] * SPELL_SLOTS
    for run in _chunks(list(dict.fromkeys(words))):
        cost = np.zeros(len(run))
        weight = np.repeat(np.array([[0.15], [0.25], [0.4], [0.5]]), 4 * len(run), axis=1)
        for rows, slots, bit in _walk(run):
            x = told.take(slots + by_order)
            spot = rows * 4 + gates.take(slots[-1])
            w = weight.take(spot, axis=1)
            p = np.clip(_squash((w * x).sum(0)), 1e-4, 1 - 1e-4)
            cost[rows] -= np.log2(np.where(bit > 0, p, 1 - p))
            w += SPELL_RATE * (bit - p) * x
            for k, own in enumerate(weight):
                own[spot] = w[k]
        out.update(zip(run, cost.tolist(), strict=True))
    return [out[w.encode("utf-8", "surrogatepass")] for w in words]


def _frequent(counts: DataFrame) -> list[tuple[str, int]]:
    """At most HEAD of the most frequent words, by count and word: all from the least count that leaves so few.

    The count is found from a histogram of some hundred rows, so that no more than the head itself reaches the driver.
    """
    short = counts.where(F.octet_length("token") <= HEAD_BYTES).withColumn("step", F.floor(8 * F.log2("c")).cast("int"))
    least, total = None, 0
    for r in sorted(short.groupBy("step").agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r["step"]):
        total += r["n"]
        if total > HEAD:
            break
        least = r["step"]
    if least is None:
        return []
    return sorted(((r["token"], r["c"]) for r in short.where(F.col("step") >= least).select("token", "c").collect()), key=lambda x: (-x[1], x[0]))


def _tail_bits(rare: DataFrame, table: np.ndarray, head: Head) -> DataFrame:
    """Per row: known tokens, base and bits of its words beyond the head: (row, token, tf, c), c null if never seen."""
    new_bits = -math.log2(head.new)
    share = math.log2(1 - head.new) - math.log2(max(1, head.tail))
    handle = rare.sparkSession.sparkContext.broadcast(table)
    schema = pa.schema([("row", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("bits", pa.float64())])

    def rows(batches):
        row, base, words = [], [], []

        def spelled():
            columns = [row, [0] * len(row), base, [new_bits + b for b in spell(words, handle.value)]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for batch in batches:
            unseen = batch.column(4).is_valid()
            yield pa.RecordBatch.from_arrays([c.filter(pc.invert(unseen)) for c in batch.columns[:4]], schema=schema)
            for to, c in ((row, 0), (base, 2), (words, 4)):
                to += batch.column(c).filter(unseen).to_pylist()
            if len(words) >= SPELLED:
                yield spelled()
                row, base, words = [], [], []
        if words:
            yield spelled()

    seen = F.col("c").isNotNull()
    columns = rare.select(
        "row", F.when(seen, F.col("tf")).otherwise(0).cast("long").alias("known"), (F.col("tf") * F.log10(F.coalesce("c", F.lit(0)) + 0.1)).alias("base"),
        F.when(seen, -F.log2(F.col("c")) - share).alias("bits"), F.when(~seen, F.col("token")).alias("unseen"),
    )
    return columns.mapInArrow(rows, "row long, known long, base double, bits double")


def score(docs: DataFrame, whole: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    With ``whole`` every decision of a word is coded by mixed predictors, which run on through the text
    (:func:`code_words`); without it classes alone are, in lanes (:func:`code_texts`).

    Texts whose id has remainder 0 modulo 10 are held out of training, rows without id too.  Null and empty texts are the
    end alone, with bits per byte 0; repeated rows are scored and, in training, counted each.
    """
    remains = remainder(F.col("doc_id"), 10)
    counts = saved(corpus_counts(docs.where(remains != 0)))
    totals = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v"), F.sum((F.col("c") == 1).cast("long")).alias("once")).first()
    head = Head(_frequent(counts), totals["n"] or 0, totals["v"], totals["once"] or 0)
    tree = Tree(head) if whole else None
    by_leader, pairs = corpus_cells(docs.where(remains != 0), head, tree)
    if whole:
        tree.learn(head, by_leader, pairs)
    else:
        head.learn_leaders(by_leader)
    table = spelling(counts)
    scanned = saved(_scan(docs, head, tree).withColumn("row", F.monotonically_increasing_id()))

    # one pass over the words beyond the head: the look-up is not made again for those never seen
    rare = scanned.select("row", F.explode("others").alias("w")).select("row", "w.token", "w.tf").join(counts.hint("shuffle_hash"), "token", "left")
    extra = _tail_bits(rare, table, head).groupBy("row").agg(F.sum("known").alias("k"), F.sum("base").alias("b"), F.sum("bits").alias("x"))
    full = scanned.drop("others").join(extra, "row", "left")
    bits = F.col("bits") + F.coalesce("x", F.lit(0.0))
    return full.select(
        "doc_id",
        F.coalesce(remainder(F.col("doc_id"), 10) == 0, F.lit(True)).alias("held_out"),
        "n_tokens",
        (F.col("n_head") + F.coalesce("k", F.lit(0))).alias("n_known"),
        F.lit(head.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("b", F.lit(0.0))).alias("base_score"),
        (-bits * math.log10(2)).alias("score"),
        F.when(F.col("n_bytes") > 0, bits / F.col("n_bytes")).otherwise(F.lit(0.0)).alias("bits_per_byte"),
    )
