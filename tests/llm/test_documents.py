"""Operators on documents against brute force, over nulls, ties, repeats, odd characters and empty tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from pagemill.llm import decontaminate, graph, mixing, near_dedup, quality, queries, suffix_dedup, token_output

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_id(rows, df, *columns):
    """Results of the rows with ids; repeated rows must agree."""
    out = {}
    for r in df.collect():
        if r.doc_id is not None:
            value = tuple(r[c] for c in columns)
            assert out.setdefault(r.doc_id, value) == value
    return out


def test_quality_measures(docs, rows):
    got = by_id(rows, quality.quality_rules(docs), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    for doc_id, text, *_ in rows:
        if doc_id is None:
            continue
        t = text or ""
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        windows = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        cover = {k + j for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for j in range(8)}
        failed = len(w) < 20 or 100 * len(cover) > 30 * len(w)
        symbols = sum(c in "#*$%&|<>" for c in t)
        assert got[doc_id][:6] == (len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(cover), failed), doc_id
        assert not (failed and got[doc_id][6])


def test_quality_distance_is_jensen_shannon():
    p, q = np.array([[3.0, 1, 0]]), np.array([0.5, 0.25, 0.25])
    a, m = p[0] / 4, (p[0] / 4 + q) / 2
    expected = sum(x * math.log2(x / y) for x, y in zip(a, m) if x) / 2 + sum(x * math.log2(x / y) for x, y in zip(q, m) if x) / 2
    assert quality.distances(p, q)[0] == pytest.approx(math.sqrt(expected))
    assert quality.distances(np.zeros((1, 3)), q)[0] == 1


def test_quality_keeps_clean_and_drops_junk(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rules = quality.Rules()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    judged = [r for r in quality.quality_rules(docs, rules).collect() if r.doc_id in labels and not r.base_failed]
    good = [r.kept for r in judged if labels[r.doc_id] == 1]
    assert sum(good) / len(good) > 0.97
    kept = quality.kept_rows(docs, rules)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r.kept for r in quality.quality_rules(docs, rules).collect())


def brute_verdicts(rows, rules):
    """(distances, kept) of rows (text, lang) without hashes but for ties, from Counters and fractions of a million."""
    name = lambda w: int(quality.measures(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]))["word_hash"][0])

    def kind(c):
        if c in "abcdefghijklmnopqrstuvwxyz":
            return 0
        for k, members in ((4, "\n"), (3, "\t\x0b\x0c\r "), (5, ".,;:!?'\"()-"), (6, "#*$%&|<>")):
            if c in members:
                return k
        return 1 if "A" <= c <= "Z" else 2 if "0" <= c <= "9" else 7 if ord(c) < 128 else 8

    facts, sums = [], {}
    for text, lang in rows:
        w, chars = WORD.findall(text or ""), Counter(map(kind, text or ""))
        windows = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        cover = {k + j for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for j in range(8)}
        failed = len(w) < 20 or 100 * len(cover) > 30 * len(w)
        facts.append((lang, w, chars, failed))
        if not failed and len(w) >= rules.min_words_judged:
            for of in {lang, None}:
                n, c, v = sums.setdefault(of, [0, Counter(), Counter()])
                sums[of][0] = n + 1
                c.update({k: 1_000_000 * x // chars.total() for k, x in chars.items()})
                v.update({x: 1_000_000 // len(w) * k for x, k in Counter(w).items()})

    def distance(p, q):
        out = sum(x * math.log2(2 * x / (x + q.get(k, 0))) for k, x in p.items() if x)
        return math.sqrt(max(0, (out + sum(x * math.log2(2 * x / (x + p.get(k, 0))) for k, x in q.items() if x)) / 2))

    out = []
    for lang, w, chars, failed in facts:
        of = sums[lang if lang in sums and sums[lang][0] >= rules.min_reference else None]
        top = sorted(of[2], key=lambda x: (-of[2][x], name(x)))[: rules.common_words]
        share = lambda c: {k: x / c.total() for k, x in c.items()}
        fold = lambda c: Counter({x: c[x] for x in top} | {None: c.total() - sum(c[x] for x in top)})
        char = distance(share(chars), share(of[1])) if chars.total() >= rules.min_chars_judged else None
        word = distance(share(fold(Counter(w))), share(fold(of[2]))) if len(w) >= rules.min_words_judged else None
        out.append((char, word, not failed and (char or 0) <= rules.max_char_distance and (word or 0) <= rules.max_word_distance))
    return out


def test_quality_verdicts_by_brute_force(spark, docs, rows, monkeypatch):
    rng, made = np.random.default_rng(5), list(rows)
    for k in range(90):  # three languages with references of their own, one with too few documents, and odd ones out
        lang = ("la", "lb", "lc", "few")[k % 4 if k < 8 else k % 3]
        words = [f"{lang if k % 9 else 'zz'}{int(x)}" for x in rng.zipf(1.4, 150) % 300]
        made.append((1000 + k, " ".join(words), lang, "s", 1, 1, "b", "w"))
    rules = quality.Rules()
    table = spark.createDataFrame(made, docs.schema)
    want = {}
    for row, verdict in zip(made, brute_verdicts([r[1:3] for r in made], rules), strict=True):
        want[row[0]] = verdict
    for shared in (quality.SHARED_LANGUAGES, 1):  # references sent to the tasks, references joined to the documents
        monkeypatch.setattr(quality, "SHARED_LANGUAGES", shared)
        references = quality.language_references(table, rules)
        assert (references.table is not None) == (shared == 1)
        got = quality.judge(table, references, rules).collect()
        assert len(got) == len(made)
        for r in got:
            if r.doc_id is not None:
                assert (r.char_distance, r.word_distance) == pytest.approx(want[r.doc_id][:2], abs=1e-6), r.doc_id
                assert r.kept == want[r.doc_id][2], r.doc_id
        clashing = table.withColumnsRenamed({"bands": "_reference", "window": "_of", "source": "_lang"})
        assert quality.kept_rows(clashing, rules).count() == sum(r.kept for r in got)
    assert {k for k, v in want.items() if k and k >= 1000 and not v[2]}


def test_quality_has_a_reference_for_every_language(spark):
    rules = quality.Rules(min_reference=2)
    made = [(f"l{k}", " ".join(f"w{k}x{j % 40}" if j % 3 else f"n{k}y{i}z{j}" for j in range(90))) for k in range(300) for i in range(2)]
    docs = spark.createDataFrame([(k, t, lang) for k, (lang, t) in enumerate(made)], "doc_id long, text string, lang string")
    references = quality.language_references(docs, rules)
    assert len(references.known) == 301
    assert all(r.kept and r.word_distance < 0.4 for r in quality.judge(docs, references, rules).collect())


def test_quality_empty(no_docs):
    assert quality.quality_rules(no_docs).collect() == []
    assert quality.kept_rows(no_docs).collect() == []


def shingle_set(text, width):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} - {()}


@pytest.mark.parametrize("plan", [near_dedup.WORDS3_85, near_dedup.Plan()])
def test_near_duplicates(docs, rows, plan):
    sets = {}
    for doc_id, text, *_ in rows:
        if doc_id is not None:
            sets[doc_id] = shingle_set(text, plan.width)
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= plan.percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    got = by_id(rows, near_dedup.near_duplicates(docs, plan), "n_shingles", "component_id", "kept")
    assert got == {k: (len(sets[k]), find(k), find(k) == k) for k in sets}
    nulls = near_dedup.near_duplicates(docs, plan).where("doc_id is null").collect()
    assert len(nulls) == 2 and all(r.component_id is None and r.kept for r in nulls)


def test_near_duplicates_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sets = {r.doc_id: shingle_set(r.text, 3) for r in docs.collect()}
    ids = sorted(sets)
    roots = {k: k for k in ids}
    linked = [(a, b) for a in ids for b in ids if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    roots |= graph.union_find([a for a, _ in linked], [b for _, b in linked])
    got = {r.doc_id: r.component_id for r in queries.op6_near_dedup(spark, sf_dir).collect()}
    assert got == roots


def edited_sets(n, seed):
    """Sets of copies of one text: each shingle is changed or lost, as often as the copy has it."""
    rng = np.random.default_rng(seed)
    core, made = rng.integers(1, 2**63, 150).astype(np.uint64), []
    for k in range(n):
        gone, lost = rng.random(150) < rng.uniform(0, 0.25), rng.random(150) < (0.05 if k % 3 else 0)
        own = rng.integers(1, 2**63, (gone & ~lost).sum()).astype(np.uint64)
        made.append(np.unique(np.concatenate([core[~gone & ~lost], own])))
    return made


def set_frame(spark, made):
    return spark.createDataFrame([(k, k, s.tobytes()) for k, s in enumerate(made)], "doc_id long, root long, shingles binary")


def linked_sets(made, percent):
    token = {x: k for k, x in enumerate({int(x) for s in made for x in s})}
    table = np.zeros((len(made), len(token)), np.float32)
    for k, s in enumerate(made):
        table[k, [token[int(x)] for x in s]] = 1
    common, size = table @ table.T, table.sum(1)
    return 100 * common >= percent * (size[:, None] + size[None] - common)


@pytest.mark.parametrize("percent", [80, 85])
def test_pairs_of_near_copies_grow_with_the_copies(spark, percent):
    counts = []
    for n in (300, 600):
        made = edited_sets(n, 7)
        half = n // 2  # a second text, half like the first, has copies of its own
        made[half:] = [np.unique(np.where(s < np.uint64(2**62), s + np.uint64(5), s)) for s in made[half:]]
        linked = linked_sets(made, percent)
        a, b = np.nonzero(np.triu(linked, 1))
        want = graph.union_find(a.tolist(), b.tolist())
        assert len(set(want.values())) >= 2 and n - len(want) > n // 10  # large groups, and many that are in none
        found = [(r.a, r.b) for r in near_dedup.prefix_pairs(set_frame(spark, made), percent).collect()]
        assert len(found) == len(set(found)) and all(x > y for x, y in found)
        found_links = [(x, y) for x, y in found if linked[x, y]]
        assert graph.union_find([x for x, _ in found_links], [y for _, y in found_links]) == want
        counts.append(len(found))
    assert counts[1] < 2 * 600, counts  # of 180,000


@pytest.mark.parametrize("percent", [80, 85])
def test_least_shared_is_a_bound(percent):
    rng = np.random.default_rng(percent)
    for _ in range(3000):
        c = set(rng.choice(40, rng.integers(1, 30), replace=False).tolist())
        a, b = ({x for x in c if rng.random() > 0.15} | set(rng.choice(60, rng.integers(0, 6)).tolist()) for _ in range(2))
        like = lambda x, y: 100 * len(x & y) >= percent * len(x | y)
        if a and b and like(a, b) and not (like(a, c) and like(b, c)):
            for x, y in ((a, b), (b, a)):
                assert 1 <= near_dedup.least_shared(len(x), len(x ^ c), len(c), like(x, c), percent) <= len((x ^ c) & (y ^ c))


def test_near_duplicates_empty(no_docs):
    assert near_dedup.near_duplicates(no_docs).collect() == []


def test_superminhash_is_a_permutation_and_estimates():
    rng = np.random.default_rng(3)
    one = near_dedup.signatures(np.array([12345], np.uint64), np.array([1]), 16)[0]
    assert sorted((one >> np.uint64(32)).tolist()) == list(range(16))
    x = rng.integers(0, 2**63, 300).astype(np.uint64)
    sig = near_dedup.signatures(np.concatenate([np.sort(x[:250]), np.sort(x[50:])]), np.array([250, 250]), 1024)
    assert abs((sig[0] == sig[1]).mean() - 200 / 300) < 0.06


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, 200), (300, 200), (7, 7)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    got = {r.node: r.root for r in graph.components(df).collect()}
    assert got == {k: 0 for k in range(61)} | {100: 100, 200: 100, 300: 100}


@pytest.mark.parametrize("hot", [50_000, 3])
def test_suffix_dedup(docs, rows, hot):
    plan = suffix_dedup.Plan(hot=hot, block_bytes=4096, bucket_bytes=16384)
    got = by_id(rows, suffix_dedup.digest(suffix_dedup.suffix_dedup(docs, plan)), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    first = {}
    texts = {k: (t or "").encode() for k, t, *_ in rows}
    for doc_id in sorted((k for k in texts if k is not None)):
        b = texts[doc_id]
        for s in range(len(b) - 49):
            first.setdefault(b[s : s + 50], doc_id)
    for doc_id, b in texts.items():
        if doc_id is None:
            continue
        gone = np.zeros(len(b) + 1, bool)
        for s in range(len(b) - 49):
            if first[b[s : s + 50]] < doc_id:
                gone[s : s + 50] = True
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        kept = bytes(x for x, g in zip(b, gone) if not g)
        assert got[doc_id] == (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()), doc_id


def test_suffix_dedup_empty(no_docs):
    assert suffix_dedup.suffix_dedup(no_docs).collect() == []


def test_token_output(docs, rows):
    from tokenizers import Tokenizer

    layout = token_output.Layout(queries.tokenizer_path(), length=64, batch=4)
    for layout in (layout, layout._replace(literal_specials=True)):
        tokenizer = Tokenizer.from_file(layout.tokenizer)
        tokenizer.encode_special_tokens = layout.literal_specials
        expected, start = [], 0
        for doc_id, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1] or "")):
            ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
            expected.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
        got = [tuple(r) for r in token_output.token_output(docs, layout).collect()]
        assert sorted(got, key=lambda r: r[1]) == expected


def test_special_tokens_as_the_library_has_them():
    from tokenizers import Tokenizer

    end = "<|endoftext|>"
    texts = [f"Hello {end} world", end, f"a  {end}\n\n {end}b", "plain  text \n", "", f"{end}{end} ", f"x{end[:-1]}", "<|endoftext", "|>next", f"é  {end}  é"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    for literal in (False, True):
        layout = token_output.Layout(queries.tokenizer_path(), literal_specials=literal)
        tokenizer = Tokenizer.from_file(layout.tokenizer)
        tokenizer.encode_special_tokens = literal
        ids, sizes = token_output.Encoder(layout)(data, offsets)
        expected = [[*tokenizer.encode(t, add_special_tokens=False).ids, 2] for t in texts]
        assert sizes.tolist() == [len(x) for x in expected] and ids.tolist() == [i for x in expected for i in x]
        assert literal or sizes[0] == 5


def test_token_folder_is_where_spark_has_it(spark, docs, tmp_path):
    layout = token_output.Layout(queries.tokenizer_path())
    assert token_output.resolved(spark, str(tmp_path)) == f"file://{tmp_path}"
    assert token_output.resolved(spark, f"file://{tmp_path}") == f"file://{tmp_path}"
    with pytest.raises(ValueError):
        token_output.Shard(str(tmp_path), 0)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    before = conf.get("fs.defaultFS")
    conf.set("fs.defaultFS", "nowhere://host/")
    try:
        with pytest.raises(Exception, match="nowhere"):
            token_output.write_tokens(docs, str(tmp_path), layout)
    finally:
        conf.set("fs.defaultFS", before)
    assert not list(tmp_path.iterdir())


def test_token_files_random_access(docs, tmp_path):
    layout = token_output.Layout(queries.tokenizer_path(), length=32, batch=2)
    manifest = token_output.write_tokens(docs, str(tmp_path), layout).collect()
    shard = token_output.Shard(f"file://{tmp_path}", manifest[0].shard)
    n = manifest[0].n_tokens
    whole = np.concatenate(list(shard.ids(0, n)))
    count = -(-n // 32)
    parts = [shard.sequence(k) for k in range(count)]
    assert np.array_equal(np.concatenate([p[0] for p in parts])[:n], whole)
    assert sum(int(p[1].sum()) for p in parts) == n
    assert all(len(p[0]) == 32 for p in parts)


def test_token_output_empty(no_docs):
    assert token_output.token_output(no_docs, token_output.Layout(queries.tokenizer_path())).collect() == []


def test_mixing_against_sql(spark, sf_dir, tmp_path):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    expected = sorted(con.execute(queries.ORACLE["op3_mixing"]).fetchall())
    assert sorted(tuple(r) for r in queries.op3_mixing(spark, sf_dir).collect()) == expected


def test_mixing_budgets(docs, rows):
    got = mixing.mix(docs).collect()
    assert sum(r["size"] for r in got) == sum(len(WORD.findall(t or "")) for _, t, *_ in rows)
    assert all(0 <= r.taken <= 2 * r["size"] for r in got)
    by_source = {}
    for r in got:
        by_source.setdefault((r.source_size, r.target), []).append(r.taken)
    for (_, target), taken in by_source.items():
        assert abs(sum(taken) - target) <= 1
    assert sum(t for _, t in by_source) == pytest.approx(1.5 * sum(s for s, _ in by_source))
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    assert sum(len(WORD.findall(r.text or "")) for r in mixed.collect()) == sum(r.taken for r in got)
    assert sorted(mixing.mix(docs).collect(), key=str) == sorted(got, key=str)


def test_mixing_empty(no_docs):
    assert mixing.mix(no_docs).collect() == []
    assert mixing.mixed(no_docs).collect() == []


def plain(text):
    return re.findall(r"(?:[a-z0-9]|[^\x00-\x7f])+", text.lower())


def test_decontamination(spark, docs, rows):
    passage = rows[-5][1] if len(plain(rows[-5][1] or "")) == 30 else next(t for _, t, *_ in rows if t and len(plain(t)) == 30)
    edited = passage.split()
    edited[-1] = "other"
    items = [(1, passage.upper() + "!!"), (2, "one two"), (3, None), (4, ""), (5, "nothing of this is anywhere in the texts at all"), (1, passage), (None, " ".join(edited))]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.contaminations(docs, table).collect() if r.doc_id is not None}
    expected = set()
    for doc_id, text, *_ in rows:
        own = plain(text or "")
        if doc_id is None:
            continue
        for item_id, item in items:
            q = plain(item or "")
            if not q:
                continue
            width = min(5, len(q))
            bag = Counter(tuple(q[k : k + width]) for k in range(len(q) - width + 1))
            for s in range(len(own) - len(q) + 1):
                w = own[s : s + len(q)]
                other = Counter(tuple(w[k : k + width]) for k in range(len(w) - width + 1))
                if sum((bag & other).values()) >= 0.9 * sum((bag | other).values()):
                    expected.add((doc_id, item_id))
    assert expected and expected <= set(got)
    assert all(s >= 0.8 for s in got.values())
    clean = decontaminate.decontaminated(docs, table)
    assert clean.columns == docs.columns
    met = {text for doc_id, text, *_ in rows if doc_id in {k[0] for k in got}}
    assert sorted((r.doc_id or -1, r.text or "") for r in clean.collect()) == sorted((r[0] or -1, r[1] or "") for r in rows if r[1] not in met)


def test_decontamination_verbatim(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
    texts = {d.doc_id: f" {' '.join(plain(d.text or ''))} " for d in docs}
    expected = {(d, i.item_id) for d, t in texts.items() for i in items if f" {' '.join(plain(i.text))} " in t}
    assert {(r.doc_id, r.item_id) for r in queries.op8_decontaminate(spark, sf_dir).collect()} == expected


def test_decontamination_empty(spark, docs, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    assert decontaminate.contaminations(docs, none).collect() == []
    assert decontaminate.contaminations(no_docs, some).collect() == []


def numbered(name, n):
    return [f"{name}{k}" for k in range(n)]


def test_decontamination_repeated_items(spark):
    """One word replaced in a document with an item that a third of the benchmark repeats: 51 of 61 shingles."""
    own = numbered("w", 60)
    items = [(k, " ".join(own)) for k in range(333)] + [(k, " ".join(numbered(f"o{k}x", 60))) for k in range(333, 1000)]
    table = spark.createDataFrame(items, "item_id long, text string")
    edited = numbered("before", 20) + own[:30] + ["other"] + own[31:] + numbered("after", 20)
    df = spark.createDataFrame([(1, " ".join(edited)), (2, " ".join(numbered("clean", 90)))], "doc_id long, text string")
    for rule in (decontaminate.Match(), decontaminate.Match(block_items=300)):
        got = decontaminate.contaminations(df, table, rule).collect()
        assert {(r.doc_id, r.item_id) for r in got} == {(1, k) for k in range(333)}
        assert {r.first_word for r in got} == {20} and len({r.similarity for r in got}) == 1
    assert [r.doc_id for r in decontaminate.decontaminated(df, table).collect()] == [2]


def test_decontamination_document_shorter_than_item(spark):
    own = numbered("w", 59)
    table = spark.createDataFrame([(1, " ".join(own)), (2, " ".join(numbered("o", 40)))], "item_id long, text string")
    texts = [own[:-1], own[1:], own[5:50], own[:20], own, own[:3]]
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): (round(r.similarity, 6), r.first_word) for r in decontaminate.contaminations(df, table).collect()}
    assert got == {(0, 1): (round(54 / 55, 6), 0), (1, 1): (round(54 / 55, 6), 0), (4, 1): (1.0, 0)}
