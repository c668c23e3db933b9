"""Token counts of texts, by merging all pre-tokens of a batch in step.

A piece model of the byte-pair kind writes a blank as ``▁``, sets one before the text, and then joins, again and
again, the two neighbours whose joint piece has the best score, the first of equals. A character that no piece
holds is counted by its bytes.

Two neighbours are never joined if no piece has such two characters side by side. Texts are cut at all such places,
which leaves pre-tokens of a few characters in any language. Each distinct pre-token of a batch is held once, all of
them as one ragged array of symbols. In each round every pre-token applies the pair of its lowest rank, at
all places where the one-by-one order would do the same, until no pre-token has a pair left.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.arrow import grouped, map_batches, remembered

BLANK = 0x2581
NONE = np.iinfo(np.int32).max
CODE_POINTS = 0x110000


class Pieces(NamedTuple):
    """What merging needs of a model. Symbols are the pieces and all single characters of them."""

    symbol: np.ndarray  # of a character, -1: part of no piece
    letter: np.ndarray  # number of a character among those of longer pieces, 0: in none
    near: np.ndarray  # whether some piece has two letters side by side
    keys: np.ndarray  # of joinable pairs: left symbol * symbols + right symbol, ascending
    joined: np.ndarray  # symbol that such a pair becomes
    rank: np.ndarray  # of a symbol as the outcome of a join, by descending score
    cost: np.ndarray  # tokens of a symbol that is left
    run: int  # blanks are joined in such runs from the left, 0: not known

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbol and rank of joined pairs; the rank is NONE where there is no such piece."""
        key = left.astype(np.int64) * len(self.cost) + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        made = self.joined[at]
        return made, np.where(self.keys[at] == key, self.rank[made], NONE)


def _blank_run(scores: dict[str, float], p: Pieces) -> int:
    """Length of the longest piece of blanks, if a longer run is sure to start with it: all such pieces have one score
    below all others, no other piece has two blanks side by side, and the first join of equals works from the left, so
    the run is done when that many blanks are one piece. Else 0."""
    blanks = {q: s for q, s in scores.items() if len(q) > 1 and set(q) == {chr(BLANK)}}
    others = {q: s for q, s in scores.items() if len(q) > 1 and q not in blanks}
    if not blanks or len(set(blanks.values())) > 1 or any(chr(BLANK) * 2 in q for q in others):
        return 0
    longest = max(map(len, blanks))
    one = surviving(np.full(longest, p.symbol[BLANK], np.int32), np.array([longest]), p)[0] == 1
    return longest if one and min(others.values(), default=0.0) > min(blanks.values()) else 0


def pieces(scores: dict[str, float]) -> Pieces:
    """``scores`` are those of the model's ordinary pieces."""
    longer = [p for p in scores if len(p) > 1]
    letters = sorted({c for p in longer for c in p})
    names = list(scores) + [c for c in letters if c not in scores]
    number = {p: k for k, p in enumerate(names)}
    symbol = np.full(CODE_POINTS, -1, np.int32)
    letter = np.zeros(CODE_POINTS, np.uint16)
    for p, k in number.items():
        if len(p) == 1:
            symbol[ord(p)] = k
    for k, c in enumerate(letters):
        letter[ord(c)] = k + 1
    near = np.zeros((len(letters) + 1,) * 2, bool)
    pairs = {}
    for p in longer:
        for a, b in zip(p, p[1:], strict=False):
            near[letter[ord(a)], letter[ord(b)]] = True
        for cut in range(1, len(p)):
            left, right = number.get(p[:cut]), number.get(p[cut:])
            if left is not None and right is not None:
                pairs[left * len(names) + right] = number[p]
    order = {s: k for k, s in enumerate(sorted({scores[p] for p in longer}, reverse=True))}
    rank = np.array([order.get(scores.get(p), NONE) for p in names] or [NONE], np.int32)
    cost = np.array([1 if p in scores else len(p.encode()) for p in names] or [1], np.int64)
    keys = np.array(sorted(pairs) or [-1], np.int64)
    joined = np.array([pairs.get(k, 0) for k in keys.tolist()], np.int32)
    p = Pieces(symbol, letter, near, keys, joined, rank, cost, 0)
    return p._replace(run=_blank_run(scores, p))


def load_pieces(path: str) -> Pieces:
    """Of a model with byte fallback that leaves characters as they are, sets one blank before a text and keeps
    all others; any other model is refused."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    probe = " a  \tﬁé é　 "
    if model.normalize(probe) != "▁" + probe.replace(" ", "▁"):
        raise ValueError(f"{path} changes texts before it cuts them")
    ids = range(model.get_piece_size())
    if sum(map(model.is_byte, ids)) != 256 or any(map(model.is_unused, ids)):
        raise ValueError(f"{path} has no byte fallback, or unused pieces")
    plain = [k for k in ids if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k))]
    return pieces({model.id_to_piece(k): model.get_score(k) for k in plain})


def surviving(symbols: np.ndarray, lengths: np.ndarray, p: Pieces) -> np.ndarray:
    """Tokens of each sequence of the ragged array after all joins.

    The one-by-one order joins the first pair of the lowest rank, so all places of that rank follow from left to
    right, unless a join makes a pair of the same or a lower rank, which then comes first: at such a
    place a sequence ends its round. Of places that share a symbol the left one counts.
    """
    out = np.zeros(len(lengths), np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    rank = np.full(len(symbols), NONE, np.int32)
    inner = np.flatnonzero(row[1:] == row[:-1])
    rank[inner] = p.lookup(symbols[inner], symbols[inner + 1])[1]
    while len(symbols):
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        sizes = np.diff(np.append(first, len(symbols)))
        low = np.minimum.reduceat(rank, first)
        done = low == NONE
        if done.any():
            out[row[first[done]]] = np.add.reduceat(p.cost[symbols], first)[done]
            on = np.repeat(~done, sizes)
            symbols, row, rank = symbols[on], row[on], rank[on]
            if not len(symbols):
                break
            low, sizes = low[~done], sizes[~done]
        lowest = np.repeat(low, sizes)
        hit = np.flatnonzero(rank == lowest)
        place = np.arange(len(hit))
        fresh = np.concatenate([[True], hit[1:] != hit[:-1] + 1])
        hit = hit[(place - np.maximum.accumulate(np.where(fresh, place, 0))) % 2 == 0]
        made, _ = p.lookup(symbols[hit], symbols[hit + 1])
        # neighbours as they are when the places before have been joined and those after have not
        n = len(symbols)
        before = np.maximum(hit - 1, 0)
        left = symbols[before]
        follows = np.flatnonzero(hit[1:] == hit[:-1] + 2) + 1
        left[follows] = made[follows - 1]
        after = np.minimum(hit + 2, n - 1)
        new_left = np.where((hit > 0) & (row[before] == row[hit]), p.lookup(left, made)[1], NONE)
        new_right = np.where((hit + 2 < n) & (row[after] == row[hit]), p.lookup(made, symbols[after])[1], NONE)
        stops = np.minimum(new_left, new_right) <= lowest[hit]
        if stops.any():
            earlier = np.cumsum(stops) - stops
            begins = np.concatenate([[True], row[hit[1:]] != row[hit[:-1]]])
            base = earlier[np.maximum.accumulate(np.where(begins, np.arange(len(hit)), 0))]
            go = earlier == base
            hit, made = hit[go], made[go]
        symbols[hit] = made
        on = np.ones(n, bool)
        on[hit + 1] = False
        symbols, row, rank = symbols[on], row[on], rank[on]
        at = hit - np.arange(len(hit))
        n = len(symbols)
        for k in (at, at[at > 0] - 1):
            right = np.minimum(k + 1, n - 1)
            inside = (k + 1 < n) & (row[right] == row[k])
            rank[k] = np.where(inside, p.lookup(symbols[k], symbols[right])[1], NONE)
    return out


def count(data: np.ndarray, offsets: np.ndarray, p: Pieces) -> np.ndarray:
    """Tokens of each of the texts that ``data`` holds as UTF-8, one after another."""
    starts = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    chars = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    chars = np.where(chars == 0x20, np.uint32(BLANK), chars)
    full = np.flatnonzero(np.diff(starts))
    if not len(full):
        return np.zeros(len(offsets) - 1, np.int64)
    chars = np.insert(chars, starts[full], BLANK)
    opens = starts[full] + np.arange(len(full))
    letter = p.letter[chars]
    cut = np.ones(len(chars), bool)
    cut[1:] = ~p.near[letter[:-1], letter[1:]]
    cut[opens] = True
    if p.run:  # a word may take the last blank of a run, never one of those before
        blank = chars == BLANK
        edge = blank.copy()
        edge[1:] &= ~blank[:-1]
        edge[opens] = True
        where = np.arange(len(chars))
        since = where - np.maximum.accumulate(np.where(edge, where, 0))
        cut |= blank & (since % p.run == 0)
    first = np.flatnonzero(cut)
    sizes = np.diff(np.append(first, len(chars)))
    tokens = np.zeros(len(first), np.int64)
    one = sizes == 1
    alone = chars[first[one]]
    known = p.symbol[alone]
    width = 1 + (alone > 0x7F) + (alone > 0x7FF) + (alone > 0xFFFF)
    tokens[one] = np.where(known >= 0, p.cost[np.maximum(known, 0)], width)
    if not one.all():
        ends = np.append(first, len(chars)).astype(np.int64) * 2
        whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(letter)])
        coded = whole.filter(pa.array(~one)).dictionary_encode()
        of = coded.indices.to_numpy()
        kinds = np.zeros(len(coded.dictionary), np.int64)
        many = np.flatnonzero(~one)
        kinds[of[::-1]] = many[::-1]  # the first place of each distinct pre-token
        lengths = sizes[kinds]
        begin = np.cumsum(lengths) - lengths
        flat = np.repeat(first[kinds] - begin, lengths) + np.arange(lengths.sum())
        tokens[many] = surviving(p.symbol[chars[flat]], lengths, p)[of]
    out = np.zeros(len(offsets) - 1, np.int64)
    out[full] = np.add.reduceat(tokens, np.searchsorted(first, opens))
    return out


def token_counts(docs: DataFrame, model: str, limit: int = 4096, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row, ``model`` being a path that all executors have.

    A null text is empty, and an empty text has no token. Rows with null or repeated ids are counted each for itself;
    other columns are left out, whatever their names. Nothing is shuffled; a text is held whole, at about 30 bytes a
    character, beside row groups of 2 MB.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        p = remembered(("pieces", model), lambda: load_pieces(model))
        sizes, found = [], []
        for _, _, data, offsets in grouped(batch.column(1)):
            sizes.append(np.diff(offsets))
            found.append(count(data, offsets, p))
        n_tokens = np.concatenate(found)
        columns = [batch.column(0), pa.array(np.concatenate(sizes)), pa.array(n_tokens), pa.array(n_tokens > limit)]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    thin = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return map_batches(thin, run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
