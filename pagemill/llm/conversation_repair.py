"""Cheapest repair of the turn structure of conversations, over a grammar of their role and fault sequences.

A conversation is a sequence of symbols, one per row: what may be done with the row (it must go, or it is kept or gets
another role, at a price if it is cut off) and which role it has. Re-Pair joins the pairs of neighbours that are most
frequent in all conversations to new symbols, again and again, which gives one grammar for all. For each symbol there is
one transfer matrix: the least cost, and the audit rope that goes with it, of passing from one state of the
role pattern to another over the symbol's rows. The matrix of a rule is the min-plus product of its two symbols'
matrices, so rules are worked out bottom-up, once, and a conversation is the product of the few symbols it is
written with. Of equal costs the ASCII-least audit counts; all audits over some rows end with a row's edit, so none
begins with another, and products of least audits are least.

A conversation is cut into blocks of ``BLOCK`` rows; a long one's blocks are multiplied in groups of ``FAN``.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.arrow import forget, map_batches, remembered
from pagemill.llm.digests import joined_sha256
from pagemill.operators.numbering import number_rows
from pagemill.session import materialize

BLOCK, FAN = 512, 8
WHITE = " \t\n\x0b\x0c\r"
INSERT, REROLE, DELETE, TRUNCATED = 3, 3, 4, 3
# States of the pattern (s?(ua)+)?: nothing yet, after s, after u, after a.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
# Inserts that lead from one state to another.
INSERTS = {
    START: {START: "", USER: "I", ASSISTANT: "II"},
    SYSTEM: {SYSTEM: "", USER: "I", ASSISTANT: "II"},
    USER: {USER: "", ASSISTANT: "I"},
    ASSISTANT: {ASSISTANT: "", USER: "I"},
}
ROLES = "sua"
MUST_GO, TERMINALS = 0, 9  # other terminals: 1 + 2 * (place of the initial in ROLES, or 3) + truncated

Rope = str | tuple
Matrix = dict[int, dict[int, tuple[int, Rope]]]
Round = dict[tuple[int, int], int]


class Grammar(NamedTuple):
    """Rules by the round that made them: pair of symbols to a new symbol. The bounds keep it small enough to go to
    every task; they never change a result, only how many symbols a conversation is written with."""

    rounds: tuple[Round, ...]

    @property
    def size(self) -> int:
        return TERMINALS + sum(map(len, self.rounds))


def flat(rope: Rope) -> str:
    parts, todo = [], [rope]
    while todo:
        top = todo.pop()
        if isinstance(top, str):
            parts.append(top)
        else:
            todo += (top[1], top[0])
    return "".join(parts)


def better(a: tuple[int, Rope] | None, b: tuple[int, Rope]) -> tuple[int, Rope]:
    """The cheaper one; of equals the one with the ASCII-least audit."""
    if a is None or b[0] < a[0]:
        return b
    if a[0] < b[0] or a[1] is b[1]:
        return a
    return b if flat(b[1]) < flat(a[1]) else a


def product(a: Matrix, b: Matrix) -> Matrix:
    out: Matrix = {}
    for i, row in a.items():
        own: dict[int, tuple[int, Rope]] = {}
        for k, (cost, rope) in row.items():
            for j, (more, rest) in b[k].items():
                best = own.get(j)
                if best is None or cost + more <= best[0]:
                    own[j] = better(best, (cost + more, (rope, rest)))
        out[i] = own
    return out


def terminal(symbol: int) -> Matrix:
    """Inserts, then the row's edit. In ropes the keeping of a system turn is ``L``, which sorts as ``K`` does there."""
    initial, cut = divmod(symbol - 1, 2)
    price = TRUNCATED * cut
    out: Matrix = {}
    for i, reach in INSERTS.items():
        own: dict[int, tuple[int, Rope]] = {}
        for k, inserts in reach.items():
            paid = INSERT * len(inserts)
            moves = [(k, DELETE, "D")]
            if symbol != MUST_GO:
                to = ASSISTANT if k == USER else USER
                moves.append((to, REROLE + price, "R"))
                if initial == to - 1:
                    moves.append((to, price, "K"))
                if initial == 0 and k == START:
                    moves.append((SYSTEM, price, "L"))
            for j, cost, letter in moves:
                own[j] = better(own.get(j), (paid + cost, inserts + letter))
        out[i] = own
    return out


def matrices(grammar: Grammar) -> list[Matrix]:
    """One matrix per symbol; a rule's symbols come before it."""
    out = [terminal(s) for s in range(TERMINALS)]
    for rules in grammar.rounds:
        for left, right in rules:  # in the order of their symbols
            out.append(product(out[left], out[right]))
    return out


def pair_places(symbols: np.ndarray, row: np.ndarray) -> np.ndarray:
    """First places of pairs of neighbours in one row; of a run of one symbol every second pair."""
    at = np.flatnonzero(row[1:] == row[:-1])
    same = symbols[at] == symbols[at + 1]
    place = np.arange(len(symbols))
    begins = np.ones(len(symbols), bool)
    begins[1:] = (symbols[1:] != symbols[:-1]) | (row[1:] != row[:-1])
    since = place - np.maximum.accumulate(np.where(begins, place, 0)) if len(symbols) else place
    return at[~same | (since[at] % 2 == 0)]


def compress(symbols: np.ndarray, row: np.ndarray, grammar: Grammar) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one round share no symbol but those of a run, so all their places are joined at once."""
    for rules in grammar.rounds:
        keys = np.array([a * grammar.size + b for a, b in rules])
        made = np.array(list(rules.values()))
        order = np.argsort(keys)
        keys, made = keys[order], made[order]
        at = pair_places(symbols, row)
        if not len(at):
            break
        own = symbols[at] * grammar.size + symbols[at + 1]
        k = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
        hit = keys[k] == own
        symbols = symbols.copy()
        symbols[at[hit]] = made[k[hit]]
        on = np.ones(len(symbols), bool)
        on[at[hit] + 1] = False
        symbols, row = symbols[on], row[on]
    return symbols, row


def _ragged(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and row numbers of sequences written with one digit a symbol."""
    lengths = np.array([len(t) for t in texts.to_pylist()], np.int64)
    symbols = np.frombuffer("".join(texts.to_pylist()).encode(), np.uint8).astype(np.int64) - ord("0")
    return symbols, np.repeat(np.arange(len(lengths)), lengths)


def re_pair(sequences: DataFrame, rounds: int = 24, rules: int = 1024) -> Grammar:
    """A grammar for the texts ``sequence``. Each round counts the pairs of neighbours in all sequences and takes the most
    frequent ones that share no symbol with another in such a way that their places could overlap. Ends with a round
    without a repeated pair, or at the bounds; only the most frequent pairs, at most 256, come to the driver."""
    grammar = Grammar(())
    for _ in range(rounds):

        def pairs(batch: pa.RecordBatch, own: Grammar = grammar) -> pa.RecordBatch:
            symbols, row = compress(*_ragged(batch.column(0)), own)
            at = pair_places(symbols, row)
            keys, n = np.unique(symbols[at] * own.size + symbols[at + 1], return_counts=True)
            columns = [pa.array(keys // own.size), pa.array(keys % own.size), pa.array(n.astype(np.int64))]
            return pa.RecordBatch.from_arrays(columns, ["a", "b", "n"])

        counted = map_batches(sequences.select("sequence"), pairs, "a long, b long, n long")
        top = counted.groupBy("a", "b").agg(F.sum("n").alias("n")).where("n > 1").orderBy(F.desc("n"), "a", "b").limit(256).collect()
        chosen: Round = {}
        lefts, rights = set(), set()
        for r in top:
            if grammar.size - TERMINALS + len(chosen) == rules:
                break
            free = r.a not in lefts | rights if r.a == r.b else r.a not in rights and r.b not in lefts
            if free:
                chosen[r.a, r.b] = grammar.size + len(chosen)
                lefts.add(r.a)
                rights.add(r.b)
        if not chosen:
            break
        grammar = Grammar((*grammar.rounds, chosen))
    return grammar


def _written(m: Matrix) -> tuple[list[int], list[str]]:
    """Costs and audits of a matrix as lists, row by row; cost -1 where there is no way."""
    cells = [m[i].get(j) for i in sorted(m) for j in range(4)]
    return [c[0] if c else -1 for c in cells], [flat(c[1]) if c else "" for c in cells]


def _read(costs: list[int], audits: list[str]) -> Matrix:
    cells = list(zip(costs, audits, strict=True))
    return {i: {j: c for j, c in enumerate(cells[4 * i : 4 * i + 4]) if c[0] >= 0} for i in range(len(cells) // 4)}


_CELLS = "costs array<long>, audits array<string>"


def _transfer(blocks: DataFrame, grammar: Grammar) -> DataFrame:
    """(key, block, costs, audits) of each block; the first block has only the row of the first state."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        of = remembered(("matrices", grammar.size, str(grammar)), lambda: matrices(grammar))
        coded = batch.column(2).dictionary_encode()
        symbols, row = compress(*_ragged(coded.dictionary), grammar)
        cuts = np.searchsorted(row, np.arange(len(coded.dictionary) + 1))
        one: Matrix = {START: {START: (0, "")}}
        all_states: Matrix = {i: {i: (0, "")} for i in range(4)}
        known: dict[tuple[int, bool], tuple[list[int], list[str]]] = {}
        out = []
        for seq, block in zip(coded.indices.to_pylist(), batch.column(1).to_pylist(), strict=True):
            if (seq, block == 0) not in known:
                m = one if block == 0 else all_states
                for s in symbols[cuts[seq] : cuts[seq + 1]].tolist():
                    m = product(m, of[s])
                known[seq, block == 0] = _written(m)
            out.append(known[seq, block == 0])
        columns = [batch.column(0), batch.column(1), pa.array([o[0] for o in out], pa.list_(pa.int64())), pa.array([o[1] for o in out], pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays(columns, ["key", "block", "costs", "audits"])

    return map_batches(blocks.select("key", "block", "sequence"), run, f"key string, block long, {_CELLS}")


def _joined(transfer: DataFrame) -> DataFrame:
    """Products of up to ``FAN`` neighbouring blocks of a conversation."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for parts in batch.column(2).to_pylist():
            m = _read(parts[0]["costs"], parts[0]["audits"])
            for p in parts[1:]:
                m = product(m, _read(p["costs"], p["audits"]))
            out.append(_written(m))
        columns = [batch.column(0), batch.column(1), pa.array([o[0] for o in out], pa.list_(pa.int64())), pa.array([o[1] for o in out], pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays(columns, ["key", "block", "costs", "audits"])

    part = F.struct("block", "costs", "audits")
    grouped = transfer.groupBy("key", F.expr(f"block div {FAN}").alias("up")).agg(F.array_sort(F.collect_list(part)).alias("parts"))
    return map_batches(grouped.select("key", F.col("up").alias("block"), "parts"), run, f"key string, block long, {_CELLS}")


def _audits(blocks: DataFrame, grammar: Grammar) -> DataFrame:
    """(key, cost, rope) of the cheapest repair of each conversation."""
    transfer = _transfer(blocks, grammar)
    last = blocks.agg(F.max("block")).first()[0] or 0
    if last:
        long = blocks.where("block = 1").select("key")
        singles = transfer.join(long, "key", "left_anti")
        rest = transfer.join(long, "key", "left_semi")
        while last:
            rest = materialize(_joined(rest), "products")
            last //= FAN
        transfer = singles.unionByName(rest)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for costs, audits in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            best = None
            for j, (cost, rope) in _read(costs, audits)[START].items():
                best = better(best, (cost + INSERT * len(ENDS[j]), rope + ENDS[j]))
            out.append(best)
        columns = [batch.column(0), pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["key", "cost", "rope"])

    return map_batches(transfer.select("key", "costs", "audits"), run, "key string, cost long, rope string")


def _edits(audits: DataFrame) -> DataFrame:
    """(key, pos, before, action, new_role): the lines inserted before each row and what is done with it; inserts after
    the last row have a place of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        rows: list[tuple] = []

        def out() -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
            return pa.RecordBatch.from_arrays(columns, ["key", "pos", "before", "action", "new_role"])

        for batch in batches:
            for key, rope in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                state, pos, lines = START, 1, []
                for letter in rope:
                    role = None
                    if letter == "L":
                        state = SYSTEM
                    elif letter != "D":
                        role = "assistant" if state == USER else "user"
                        state = ASSISTANT if state == USER else USER
                    if letter == "I":
                        lines.append(role + ":")
                        continue
                    action = "K" if letter == "L" else letter
                    rows.append((key, pos, "\n".join(lines) if lines else None, action, role if letter == "R" else None))
                    pos, lines = pos + 1, []
                    if len(rows) >= 8192:
                        yield out()
                        rows.clear()
                if lines:
                    rows.append((key, pos, "\n".join(lines), "I", None))
        yield out()

    return audits.select("key", "rope").mapInArrow(run, "key string, pos long, before string, action string, new_role string")


def _no_null(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with faults set by crc32 of ``conv_id:turn``, nulls being one blank."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), _no_null("role").alias("role"), _no_null("text").alias("text"))
    rows = rows.withColumn("k", F.crc32(F.concat(_no_null("conv_id"), F.lit(":"), _no_null("turn")).cast("binary")) % 20).where("k <> 0")
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


class Repair(NamedTuple):
    """``report``: one row per conversation; ``lines``: (key, pos, before, line) of the repaired conversations, where
    before holds the lines inserted ahead of the row and line is null where the row goes."""

    report: DataFrame
    lines: DataFrame


def repair(turns: DataFrame, every: DataFrame | None = None) -> Repair:
    """Faults and cheapest repair of conversations (conv_id, turn, role, text); ``every`` has further conv_ids to report.

    The report has conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256. Rows are in order of
    turn, nulls first, those of one turn by role, then by the text's SHA-256; repeated rows are repeated turns, so all but
    the first are duplicates. A null role or text is one blank; an empty role has no legal neighbour; a null conv_id is a conversation.
    A conversation without rows has zeros, an empty audit and the digest of the empty string. Other columns are left
    out, whatever their names. An audit is one value, so a conversation's edits, not its texts, must fit a row.
    """
    key = _no_null("conv_id")
    rows = turns.select(key.alias("key"), F.col("turn").cast("long").alias("turn"), _no_null("role").alias("role"), _no_null("text").alias("text"))
    rows = number_rows(rows.withColumn("sha", F.sha2("text", 256)), ["key"], "turn", ["role", "sha"], name="pos")
    rows = materialize(rows, "numbered")
    firsts = rows.groupBy("key", "role", "sha").agg(F.min("pos").alias("pos")).select("key", "pos", F.lit(True).alias("first"))
    bare = F.rtrim(F.col("text"), F.lit(WHITE))
    initial = F.substring("role", 1, 1)
    thin = rows.select("key", "pos", "turn", initial.alias("initial"), (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("cut"))
    thin = thin.join(firsts, ["key", "pos"], "left").withColumn("duplicate", ~F.col("blank") & F.col("first").isNull())
    goes = F.col("blank") | F.col("duplicate")
    thin = thin.withColumn("truncated", ~goes & F.col("cut"))
    number = F.lit(len(ROLES))
    for k, letter in enumerate(ROLES):
        number = F.when(F.col("initial") == letter, k).otherwise(number)
    symbol = F.when(goes, MUST_GO).otherwise(1 + 2 * number + F.col("truncated").cast("int"))
    thin = materialize(thin.select("key", "pos", "turn", "initial", "blank", "duplicate", "truncated", symbol.cast("string").alias("symbol")), "symbols")

    one = lambda name: F.sum(F.col(name).cast("long")).alias(name)
    counts = thin.groupBy("key").agg(
        (F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn")).alias("gaps"), one("blank"), one("duplicate"), one("truncated")
    )
    after = thin.select("key", (F.col("pos") - 1).alias("pos"), F.col("initial").alias("next"))
    pairs = thin.join(after, ["key", "pos"]).where(~F.concat("initial", "next").isin("su", "ua", "au"))
    illegal = pairs.groupBy("key").agg(F.count(F.lit(1)).alias("illegal"))

    block = F.expr(f"(pos - 1) div {BLOCK}").alias("block")
    listed = F.array_sort(F.collect_list(F.struct("pos", "symbol")))
    blocks = thin.groupBy("key", block).agg(F.array_join(listed["symbol"], "").alias("sequence"))
    blocks = materialize(blocks, "sequences")
    audits = materialize(_audits(blocks, re_pair(blocks)), "audits")
    own = F.when(F.col("action") == "K", F.concat("role", F.lit(":"), "text")).when(F.col("action") == "R", F.concat("new_role", F.lit(":"), "text"))
    lines = _edits(audits).join(rows.select("key", "pos", "role", "text"), ["key", "pos"], "left").select("key", "pos", "before", own.alias("line"))
    said = lines.where("before is not null or line is not null").select("key", F.col("pos").alias("at"), F.concat_ws("\n", "before", "line").alias("text"))
    digests = joined_sha256(said, "\n", "repaired_sha256")

    ids = turns.select("conv_id") if every is None else turns.select("conv_id").unionByName(every.select("conv_id"))
    ids = ids.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().withColumn("key", key)
    zero = lambda name: F.coalesce(name, F.lit(0)).cast("long").alias(name)
    report = ids.join(counts, "key", "left").join(illegal, "key", "left").join(audits, "key", "left").join(digests, "key", "left")
    report = report.select(
        "conv_id",
        *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
        F.coalesce(F.translate("rope", "L", "K"), F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
    return Repair(report, lines)
