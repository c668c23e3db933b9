"""Token counts, repair and trie of conversations against brute force."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from pagemill.llm import conversation_repair as repair
from pagemill.llm import conversation_trie as trie
from pagemill.llm import digests, queries, token_counts
from pagemill.llm.arrow import grouped

TURNS = "conv_id long, turn long, role string, text string, key string, pos string, depth string, name string"
MODEL = queries.tokenizer_path("piece_bpe_32k.model")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def flat(rows):
    return sorted(tuple(-1 if v is None else v for v in r) for r in rows)


def given(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]


def ordered(rows):
    """Turns of each conversation: by number, nulls first, then role, then the text's digest."""
    return sorted(rows, key=lambda o: ((o[0] is not None, o[0] or 0), o[1], sha(o[2])))


# --- token counts ---------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=MODEL)


def counted(texts):
    p = token_counts.load_pieces(MODEL)
    return np.concatenate([token_counts.count(data, offsets, p) for _, _, data, offsets in grouped(pa.array(texts, pa.string()))]).tolist()


def test_token_counts_equal_the_library(library):
    rng = random.Random(3)
    parts = ["ab", " ", "  ", "the", "\n", "é", "日", "aaaa", "ion", "ing", " " * 15, " " * 17, "\x00", "<s>", "<0x0A>", "▁", "🙂", "é", "ß", "0", "er", "\t", "."]
    texts = ["", " ", "a", "▁", "</s>"] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(2000)]
    kinds = [(0, 0x7F), (0, 0x7FF), (0xE000, 0x10FFFF)]
    texts += ["".join(chr(rng.randint(*rng.choice(kinds))) for _ in range(rng.randint(0, 40))) for _ in range(1000)]
    texts += ["".join(rng.choice("abcde") for _ in range(rng.randint(0, 200))) for _ in range(300)]
    texts += [f"{a}{' ' * n}{b}" for n in range(60) for a in ("", "a") for b in ("", "b", ".", "日")]
    assert counted(texts) == [len(x) for x in library.encode(texts)]


def test_token_counts_of_long_pre_tokens(library):
    rng = random.Random(4)
    texts = ["x" * 50_000, " " * 50_000, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(50_000)), "日本語" * 20_000, "é" * 30_000]
    assert counted(texts) == [len(x) for x in library.encode(texts)]


def test_merging_is_one_by_one_for_any_scores():
    """Random vocabularies, in which a join may make a pair of the same or a lower rank."""
    rng = random.Random(9)
    for _ in range(300):
        alphabet = "abc"
        words = {"".join(rng.choice(alphabet) for _ in range(rng.randint(2, 5))) for _ in range(rng.randint(1, 14))}
        scores = {c: 0.0 for c in alphabet[: rng.randint(1, 3)]} | {w: -float(rng.randint(1, 8)) for w in words}
        p = token_counts.pieces(scores)
        texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 14))) for _ in range(20)]
        expected = []
        for t in texts:
            own = list(t)
            while True:
                found = [(-scores[a + b], k) for k, (a, b) in enumerate(zip(own, own[1:], strict=False)) if a + b in scores]
                if not found:
                    break
                k = min(found)[1]
                own[k : k + 2] = [own[k] + own[k + 1]]
            expected.append(sum(1 if s in scores else len(s.encode()) for s in own))
        known = {c: p.symbol[ord(c)] for c in alphabet}
        whole = [t for t in texts if all(known[c] >= 0 for c in t)]
        if whole:
            symbols = np.array([known[c] for t in whole for c in t], np.int32)
            got = token_counts.surviving(symbols, np.array([len(t) for t in whole]), p).tolist()
            assert got == [e for t, e in zip(texts, expected, strict=True) if t in whole], scores


def test_token_counts_rows(spark, docs, no_docs, rows, library):
    got = sorted(((-1 if r.doc_id is None else r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(docs, MODEL).collect())
    expected = sorted((-1 if r[0] is None else r[0], len((r[1] or "").encode()), n := len(library.encode(r[1] or "")), n > 4096) for r in rows)
    assert got == expected
    assert token_counts.token_counts(no_docs, MODEL).collect() == []


def test_other_models_are_refused(tmp_path):
    with pytest.raises(Exception):
        token_counts.load_pieces(str(tmp_path / "none.model"))


# --- repair ---------------------------------------------------------------------------------------------------------


def damaged(rows):
    out = defaultdict(list)
    for c, t, r, x, *_ in rows:
        own = out[c]
        r, x = (" " if v is None else v for v in (r, x))
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        x = "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x
        own += [(t, "user" if k == 4 else r, x)] * (0 if k == 0 else 2 if k == 3 else 1)
    return {c: ordered(v) for c, v in out.items()}


def kinds_of(own):
    seen, kinds = set(), []
    for _, r, x in own:
        bare = x.rstrip(" \t\n\x0b\x0c\r")
        kinds.append("blank" if not bare else "duplicate" if (r, x) in seen else "" if bare[-1] in ".!?" else "truncated")
        seen.add((r, x))
    return kinds


def edits(state, role, kind):
    """(next state, cost, letter, new role) of one row."""
    yield state, 4, "D", None
    if kind in ("", "truncated"):
        price, name, to = 3 * (kind != ""), "assistant" if state == 2 else "user", 3 if state == 2 else 2
        yield to, 3 + price, "R", name
        if role[:1] == name[0]:
            yield to, price, "K", role
        if role[:1] == "s" and state == 0:
            yield 1, price, "K", role


def cheapest(own, kinds):
    """(cost, audit, lines) by walking the rows with the best of each state; an insert is tried before each row and at the end."""

    def inserted(best):
        todo = dict(best)
        for _ in range(2):
            for state, (cost, audit, lines) in list(todo.items()):
                to, new = (3, "assistant:") if state == 2 else (2, "user:")
                step = (cost + 3, audit + "I", (*lines, new))
                if to not in todo or step[:2] < todo[to][:2]:
                    todo[to] = step
        return todo

    best = {0: (0, "", ())}
    for (_, role, text), kind in zip(own, kinds, strict=True):
        step = {}
        for state, (cost, audit, lines) in inserted(best).items():
            for to, price, letter, name in edits(state, role, kind):
                new = (cost + price, audit + letter, lines if name is None else (*lines, f"{name}:{text}"))
                if to not in step or new[:2] < step[to][:2]:
                    step[to] = new
        best = step
    best = inserted(best)
    return min((best[s] for s in (0, 3) if s in best), key=lambda v: v[:2])


def every_audit(own, kinds):
    """Least (cost, audit) over all edit scripts with at most two inserts at a place."""
    least = None
    for cuts in itertools.product(range(3), repeat=len(own) + 1):
        todo = [(0, 0, "")]
        for k in range(len(own) + 1):
            new = []
            for state, cost, audit in todo:
                for _ in range(cuts[k]):
                    state, cost, audit = 3 if state == 2 else 2, cost + 3, audit + "I"
                if k == len(own):
                    new.append((state, cost, audit))
                else:
                    new += [(to, cost + price, audit + letter) for to, price, letter, _ in edits(state, own[k][1], kinds[k])]
            todo = new
        for state, cost, audit in todo:
            if state in (0, 3) and (least is None or (cost, audit) < least):
                least = (cost, audit)
    return least


def repaired(rows):
    out = []
    for c, own in damaged(rows).items():
        numbers = [t for t, _, _ in own if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        kinds = kinds_of(own)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        cost, audit, lines = cheapest(own, kinds) if own else (0, "", ())
        counts = [kinds.count(k) for k in ("blank", "duplicate", "truncated")]
        out.append((c, gaps, *counts, illegal, cost, audit, sha("\n".join(lines))))
    return flat(out)


def run_repair(df):
    return flat(repair.repair(repair.damaged(df), df).report.collect())


def odd_turns(seed, convs, longest):
    rng = random.Random(seed)
    roles, texts = ["user", "assistant", "system", None, "tool", "", "ü"], ["a.", "b!", "c", None, "", " x? \n", "zz", "q.", "w? ", "<|\\"]
    rows = [(c, rng.choice([None, 0, 1, 2, 3, 3, 4, 9]), rng.choice(roles), rng.choice(texts)) for c in range(convs) for _ in range(rng.randint(1, 9))]
    rows += [rows[0], rows[0], (None, 1, "user", "x."), (None, None, None, None), (9_000, 0, None, None), (-7, 2, "user", "n.")]
    rows += [(8_000, k, rng.choice(roles[:3]), rng.choice(["t", "t.", "u!"]) * (k % 30 + 1) + f"{k}.") for k in range(longest)]
    return [(*r, "k", "p", "d", "n") for r in rows]


def test_repair_given_conversations(spark, sf_dir):
    assert flat(queries.op11_conversation_repair(spark, sf_dir).collect()) == repaired(given(spark, sf_dir))


def test_repair_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(repair, "BLOCK", 16)  # a conversation of 1,500 turns is many blocks in several groups
    rows = odd_turns(2, 150, 1500)
    df = spark.createDataFrame(rows, TURNS)
    assert run_repair(df) == repaired(rows)
    assert run_repair(df.limit(0)) == []


def test_cheapest_is_the_least_of_all_scripts():
    """The grammar's products against every edit script, and a grammar against the plain product."""
    rng = random.Random(5)
    for _ in range(120):
        n = rng.randint(1, 4)
        own = [(k, rng.choice(["system", "user", "assistant", "tool"]), f"{k}") for k in range(n)]
        kinds = [rng.choice(["", "", "truncated", "blank"]) for _ in range(n)]
        assert cheapest(own, kinds)[:2] == every_audit(own, kinds)
        symbols = [repair.MUST_GO if k == "blank" else 1 + 2 * ("suat".index(o[1][0])) + (k == "truncated") for o, k in zip(own, kinds, strict=True)]
        m = {0: {0: (0, "")}}
        for s in symbols:
            m = repair.product(m, repair.terminal(s))
        best = min((c + 3 * len(repair.ENDS[j]), repair.flat(r).replace("L", "K") + repair.ENDS[j]) for j, (c, r) in m[0].items())
        assert best == every_audit(own, kinds)


def test_grammar_writes_the_same_sequences(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice("123") * rng.randint(1, 5) for _ in range(rng.randint(1, 30))) for _ in range(60)] * 3
    grammar = repair.re_pair(spark.createDataFrame([(t,) for t in texts], "sequence string"))
    assert grammar.size > repair.TERMINALS + 3
    rules = {n: p for r in grammar.rounds for p, n in r.items()}
    symbols, row = repair.compress(*repair._ragged(pa.array(texts)), grammar)
    assert len(symbols) < sum(map(len, texts)) / 3

    def expand(s):
        return [s] if s < repair.TERMINALS else expand(rules[s][0]) + expand(rules[s][1])

    for k, t in enumerate(texts):
        assert [x for s in symbols[row == k].tolist() for x in expand(s)] == [int(c) for c in t]


# --- trie -----------------------------------------------------------------------------------------------------------


def nodes_of(rows):
    own = defaultdict(list)
    for c, t, r, x, *_ in rows:
        if c is not None:
            own[c].append((t, r or "", x or ""))
    own = {c: [(r, x) for _, r, x in ordered(v)] for c, v in own.items()}
    seqs = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        seqs[c] = tuple(own.get(c - c % 5, [])[:h] + own[c][h:])
    members, kids, leaves, saved = defaultdict(list), defaultdict(int), defaultdict(int), defaultdict(int)
    for c in sorted(seqs):
        for d in range(len(seqs[c]) + 1):
            members[seqs[c][:d]].append(c)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    ends = {p: sha(",".join(str(c) for c in m if len(seqs[c]) == len(p))) for p, m in members.items()}
    return flat((m[0], len(p), members[p[:-1]][0] if p else None, len(m), kids[p], leaves[p], saved[p], ends[p]) for p, m in members.items())


def run_trie(df):
    return flat(trie.prefix_trie(*trie.rebuilt(df)).collect())


def test_trie_given_conversations(spark, sf_dir):
    expected = nodes_of(given(spark, sf_dir))
    assert flat(queries.op13_conversation_trie(spark, sf_dir).collect()) == expected
    db = duckdb.connect()
    db.sql(f"create view conversations as select * from '{sf_dir}/conversations.parquet'")
    assert flat(db.sql(queries.ORACLE["op13_conversation_trie"]).fetchall()) == expected


def test_trie_odd_rows(spark):
    rng = random.Random(2)
    rows = [(c, rng.choice([None, 0, 1, 2, 3, 3]), rng.choice(["user", None]), rng.choice(["a", "é", None, ""])) for c in range(60) for _ in range(rng.randint(1, 6))]
    rows += [(c, k, "user", "t" * (k % 3)) for c in (5, 7) for k in range(70)]
    rows += [rows[0], (None, 1, "u", "x"), (104, 0, "user", "a")]
    rows = [(*r, "k", "p", "d", "n") for r in rows]
    df = spark.createDataFrame(rows, TURNS)
    assert run_trie(df) == nodes_of(rows)
    assert run_trie(df.limit(0)) == []


def test_joined_digests(spark, monkeypatch):
    rows = [(k % 3, k, "x" * (k % 7)) for k in range(500)]
    df = spark.createDataFrame(rows, "key long, at long, text string").repartition(4)
    for most in (4096, 3):
        monkeypatch.setattr(digests, "ROWS", most)
        got = {r.key: r.sha256 for r in digests.joined_sha256(df, ",").collect()}
        assert got == {g: sha(",".join(r[2] for r in rows if r[0] == g)) for g in range(3)}
