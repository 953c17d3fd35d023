"""The training-data operators against brute force, the libraries, held-out labels and edge cases."""

import collections
import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("tickloom.llm")

import public_tokenizers
from pyspark.sql import functions as F
from tickloom.llm import common, decontamination, embeddings, lm_scoring, lm_window, ngram_join, quality, repeats, sentencepieces, sharding, textmodel, token_counts, toxicity
from tickloom.llm.queries import ORACLES, QUERIES, graded

WORDS = [f"w{i:03d}" for i in range(400)]
ODD = ["", None, " ", "  ", "a  b", " lead", "trail ", "a\x00b", "▁x y", "日本語 テスト 🎉", "a\n b\n\n c \n d", "\t x", "<s> </s> <unk> <0x41>", "a<|endoftext|>b <|endoftext|>", "it's don't  we'LL 12 345 ½²", "ﬁne Å ｆｕｌｌ", " nb sp", "x" * 3000, "é" * 300, "a 　b", "\r\n a\r\n\r\nb", "tab\t\tx \t y", "​", "퟿\U0010ffff"]


def _prose(rng, n):
    return " ".join(WORDS[i] for i in rng.integers(0, len(WORDS), n))


def _docs(spark, rows, extra=False):
    df = spark.createDataFrame(list(rows), "doc_id long, text string")
    return df.withColumn("k", F.lit(1)).withColumn("ids", F.lit("x")).withColumn("node", F.lit(2)) if extra else df


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(5)
    base = [_prose(rng, n) for n in (3, 5, 6, 20, 60, 60, 200, 900)]
    out = [*ODD, *base]
    for b in base[3:]:
        w = b.split()
        for _ in range(6):
            v = list(w)
            for _ in range(max(1, len(v) // 60)):
                v[int(rng.integers(len(v)))] = "changed"
            out.append(" ".join(v))
    out += [base[4], base[4].upper(), base[4] + " " + base[5], "one two three four", "One two THREE four", "tail"]
    hot = _prose(rng, 45)
    out += [f"{_prose(rng, 12)} {hot} {_prose(rng, 12)}" for _ in range(90)]
    near = _prose(rng, 70).split()
    for _ in range(80):
        v = list(near)
        for _ in range(int(rng.integers(1, 4))):
            v[int(rng.integers(len(v)))] = WORDS[int(rng.integers(len(WORDS)))]
        out.append(" ".join(v))
    return out


def _set(text):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    w = [x for x in __import__("re").findall("[^\x20\x09-\x0d]+", (text or "").translate(fold))]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def _components(n, edges):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def _brute_groups(texts):
    sets = [_set(t) for t in texts]
    edges = [(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    return sets, _components(len(sets), edges)


@pytest.mark.parametrize("heavy", [None, 3])
def test_ngram_join_is_exact(spark, texts, monkeypatch, heavy):
    if heavy:  # many frequent shingles, so that combinations carry the search; lists of many parts
        monkeypatch.setattr(ngram_join, "LEAST", heavy)
        monkeypatch.setattr(ngram_join, "FEW", heavy)
        monkeypatch.setattr(ngram_join, "BLOCK", 4)
    sets, comp = _brute_groups(texts)
    got = {r.doc_id: r for r in ngram_join.jaccard_groups(_docs(spark, enumerate(texts), extra=True)).collect()}
    assert len(got) == len(texts)
    assert [got[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets]
    assert [got[i].component_id for i in range(len(texts))] == comp


def test_signatures_meet_at_the_threshold():
    rng = np.random.default_rng(9)
    for n in (1, 4, 5, 20, 31, 32, 33, 40, 41, 64, 100, 127, 128, 160, 300):
        for share in (0.0, 0.5, 1.0):
            a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
            keep = ngram_join.needed(len(a))
            for extra in {0, max(0, len(a) * 5 // 4 - len(a))}:
                both = a[rng.permutation(len(a))[: len(a) if extra else keep]]
                b = np.unique(np.concatenate([both, rng.integers(0, 2**63, extra, dtype=np.uint64)]))
                shared = np.intersect1d(a, b)
                if 5 * len(shared) < 4 * len(np.union1d(a, b)):
                    continue
                cls = lambda s: np.where(common.mix(s ^ np.uint64(1)) % np.uint64(100) < np.uint64(int(100 * share)), 2 + (s % np.uint64(2)), 1).astype(np.int8)
                # shingles of one set only: none known, or all of them
                for own in (lambda s: s, lambda s, c=shared: c):
                    x, y = (ngram_join.signatures(len(s), len(s) - len(own(s)), own(s), cls(own(s)))[0] for s in (a, b))
                    assert len(np.intersect1d(x, y)), (n, share, extra)


def test_shared_shingles_stream_over_batches(monkeypatch):
    monkeypatch.setattr(ngram_join, "FEW", 3)
    rng = np.random.default_rng(3)
    rows = sorted((int(t), int(v)) for t, v in zip(rng.integers(0, 30, 200) ** 2 // 30, rng.integers(0, 9, 200)))
    have = collections.defaultdict(set)
    for t, v in rows:
        have[t].add(v)
    want = sorted((t, v, 1 if len(own) <= 3 else 2) for t, own in have.items() if len(own) > 1 for v in own)
    for size in (1, 2, 3, 7, 500):
        batches = [pa.RecordBatch.from_pydict({"t": [r[0] for r in rows[i : i + size]], "node": [r[1] for r in rows[i : i + size]]}) for i in range(0, len(rows), size)]
        assert [tuple(r.values()) for b in ngram_join._shared(iter(batches)) for r in b.to_pylist()] == want


def _thue_morse(n, a, b):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


def test_repetitive_words_are_told_apart(spark):
    rows = [_thue_morse(n, *p) for n in (256, 1024, 2048, 4096, 8192) for p in ("ab", "ba", "cd", "dc")]
    got = ngram_join.jaccard_groups(_docs(spark, enumerate(rows))).collect()
    assert all(r.component_id == r.doc_id for r in got)
    path = public_tokenizers.path("piece_bpe_32k.model")
    enc = sentencepieces.Encoder(path)
    for t in rows:  # one after the other through one cache
        assert enc.encode(t)[0] == enc.sp.encode(t, add_eos=True)
    counter = token_counts.TextCounter(public_tokenizers.path("byte_bpe_50k.json"), {})
    spaced = [f"x {t} y" for t in rows]
    assert counter.count(pa.array(spaced)).tolist() == [counter.engine.whole(t) for t in spaced]


def test_lexicon_parts_equal_hashes():
    lex = common.Lexicon(lambda w: (np.array([len(x) for x in w], np.int64), []), 50)
    words = ["a", "bbb", "cc", "a"]
    same, check = np.full(4, 7, np.uint64), np.array([1, 2, 3, 1], np.uint64)
    for _ in range(2):
        entries = lex.lookup(same, check, words.__getitem__)
        assert lex.size[entries].tolist() == [1, 3, 2, 1]


def test_one_per_group_judges_rows(spark):
    rng = np.random.default_rng(21)
    a, b = _prose(rng, 60), _prose(rng, 60)
    near = " ".join(["changed", *a.split()[1:]])
    rows = [(5, a), (3, a), (5, b), (None, near), (None, "alone here"), (7, b), (7, b), (9, None), (9, None), (None, ""), (2, "tie"), (2, "TIE")]
    docs = _docs(spark, rows, extra=True).withColumnRenamed("node", "a.b")
    kept = ngram_join.one_per_group(docs)
    assert kept.columns == docs.columns
    got = sorted((r.doc_id is None, r.doc_id or 0, (r.text or "").lower()) for r in kept.collect())
    assert got == sorted([(False, 3, a), (False, 5, b), (True, 0, "alone here"), (False, 9, ""), (False, 9, ""), (True, 0, ""), (False, 2, "tie")])
    assert ngram_join.one_per_group(docs.limit(0)).count() == 0
    groups = ngram_join.jaccard_groups(_docs(spark, rows)).collect()
    assert len(groups) == len(rows) and sorted((r.component_id or 0) for r in groups) == [0, 0, 2, 2, 3, 3, 3, 5, 5, 5, 9, 9]


def test_near_pairs_lose_no_link(monkeypatch):
    rng = np.random.default_rng(14)
    sets = []
    for n in (40, 300, 300, 900, 3000, 20000):
        base = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        sets += [np.unique(np.concatenate([base[rng.random(len(base)) > cut], rng.integers(0, 2**63, int(cut * n / 2), dtype=np.uint64)])) for cut in rng.choice([0.0, 0.02, 0.06, 0.1, 0.4], 40)]
    bits = ngram_join._sketches(sets)[1]
    assert all(len(b) <= ngram_join.SMALL_SKETCH for b in bits)
    comp, n = rng.integers(0, 30, len(sets)), np.array([len(s) for s in sets])
    link = lambda i, j: 5 * (both := len(np.intersect1d(sets[i], sets[j]))) >= 4 * (n[i] + n[j] - both)
    want = {(i, j) for i in range(len(sets)) for j in range(i) if comp[i] != comp[j] and i // 40 == j // 40 and link(i, j)}
    got = {(int(max(i, j)), int(min(i, j))) for i, j in zip(*ngram_join.near_pairs(comp, n, bits))}
    assert want <= got and all(comp[i] != comp[j] for i, j in got) and len(got) < 3 * len(want) + 900
    low = lambda k: [s for s in (1, 2, 3) if s * 20 <= k < s * 20 + 70]
    rows = [(s, 0, k, int(comp[k]), int(n[k]), bits[k], low(k)) for s in (1, 2, 3) for k in range(s * 20, s * 20 + 70)]
    every = {(a, b) for s in (1, 2, 3) for a, b in [(j, i) for i, j in got] if all(s * 20 <= x < s * 20 + 70 for x in (a, b))}
    for size in (1, 33, 1000):
        batches = [pa.RecordBatch.from_pylist([dict(zip(("sig", "part", "node", "component", "n", "bits", "low"), r)) for r in rows[k : k + size]]) for k in range(0, len(rows), size)]
        out = [(r["a"], r["b"]) for b in ngram_join._meet(iter(batches)) for r in b.to_pylist()]
        assert set(out) == every and len(out) == len(every)


def test_sketch_bounds_the_difference():
    rng = np.random.default_rng(2)
    a, b = (np.unique(rng.integers(0, 2**63, 300, dtype=np.uint64)) for _ in range(2))
    for kept, new in ((200, 80), (290, 5), (120, 0), (300, 900)):
        c = np.unique(np.concatenate([a[:kept], rng.integers(0, 2**63, new, dtype=np.uint64)]))
        h = ngram_join.hamming(ngram_join.sketch(a), ngram_join.sketch(c))
        assert 0.6 * len(np.setxor1d(a, c)) * (new < 900) <= h <= len(np.setxor1d(a, c))


def test_runs_stream_over_batches():
    rows = [(1, 5), (1, 5), (1, 7), (2, 9), (3, 1), (3, 2), (3, 4), (4, 8), (5, 1), (5, 1)]
    for size in (1, 2, 3, 10):
        batches = [pa.RecordBatch.from_pydict({"sig": [r[0] for r in rows[i : i + size]], "hot": [r[0] == 4 for r in rows[i : i + size]], "prio": [0] * len(rows[i : i + size]), "node": [r[1] for r in rows[i : i + size]]}) for i in range(0, len(rows), size)]
        got = [(r["sig"], r["node"], r["pivot"]) for b in ngram_join._runs(iter(batches)) for r in b.to_pylist()]
        assert sorted(got) == [(1, 5, 5), (1, 7, 5), (3, 1, 1), (3, 2, 1), (3, 4, 1), (4, 8, 8)]


def test_sentencepieces_equal_the_library(spark, texts):
    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepieces.Encoder(path).sp
    got = sentencepieces.decode(sentencepieces.encode(_docs(spark, enumerate(texts), extra=True), path, decoded="same"), path).where("decoded <=> same")
    rows = {r.doc_id: r for r in got.collect()}
    assert len(rows) == len(texts) and rows[0].k == 1
    for i, t in enumerate(texts):
        r, raw = rows[i], (t or "").encode()
        assert list(r.ids) == sp.encode(t or "", add_eos=True), t
        assert r.decoded == sp.decode(list(r.ids))
        assert b"".join(raw[a:b] for a, b in zip(r.span_begin, r.span_end)) == raw
        assert all(a <= b for a, b in zip(r.span_begin, r.span_end)) and r.span_end[-1] == len(raw)
    assert sentencepieces.encode(_docs(spark, []), path).count() == 0


def test_charsmap_takes_the_longest_prefix():
    import struct

    # a double array over the keys "a" -> "x" and "ab" -> "yz", laid out by hand
    unit = lambda label, offset, leaf=False: (offset << 10) | (int(leaf) << 8) | label
    units = [0] * 512
    units[0] = unit(0, 256)
    a = 256 ^ ord("a")
    units[a] = unit(ord("a"), 128, True)
    end = a ^ 128
    units[end] = 0x80000000 | 0
    ab = end ^ ord("b")
    units[ab] = unit(ord("b"), 64, True)
    units[ab ^ 64] = 0x80000000 | 2
    blob = struct.pack("<I", 4 * len(units)) + struct.pack(f"<{len(units)}I", *units) + b"x\0yz\0"
    m = sentencepieces.CharsMap(blob)
    assert m.longest(b"abc", 0) == (2, b"yz") and m.longest(b"ac", 0) == (1, b"x") and m.longest(b"c", 0) is None
    s = {"add_dummy_prefix": True, "remove_extra_whitespaces": True, "escape_whitespaces": True}
    text, start = sentencepieces.normalize("ab  ac ", s, m)
    assert text == "▁yz▁xc" and start.tolist() == [0, 0, 0, 2, 4, 5, 6]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_token_counts_equal_the_library(spark, texts, name):
    path = public_tokenizers.path(name)
    engine = token_counts._engine(path)
    got = {r.doc_id: r for r in token_counts.token_counts(_docs(spark, enumerate(texts), extra=True), path).collect()}
    assert [got[i].n_tokens for i in range(len(texts))] == [engine.whole(t) if t else 0 for t in texts]
    assert [got[i].n_bytes for i in range(len(texts))] == [len((t or "").encode()) for t in texts]
    assert all(got[i].over_limit == (got[i].n_tokens > 512) for i in got)
    assert token_counts.token_counts(_docs(spark, []), path).count() == 0


def test_lexicon_stays_bounded():
    lex = common.Lexicon(lambda w: (np.array([len(x) for x in w], np.int64), []), 50)
    for k in range(20):
        words = [f"{k}-{i}" * (i % 3 + 1) for i in range(40)]
        entries = lex.lookup(*common.chunk_hash(words), words.__getitem__)
        assert lex.size[entries].tolist() == [len(w) for w in words]
        assert len(lex.key) <= 90


@pytest.mark.parametrize("few", [0, 1 << 19])
def test_components_of_few_and_many_edges(spark, monkeypatch, few):
    """A path, a star, a cycle and a loop: the same components within a task and round by round."""
    monkeypatch.setattr(common, "FEW_EDGES", few)
    path = [(i, i + 1) for i in range(100, 160)]
    edges = [*path[::2], *path[1::2], *[(7, k) for k in range(8, 20)], (31, 30), (32, 31), (30, 32), (40, 40)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 7 for i in range(7, 20)}, 30: 30, 31: 30, 32: 30}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_few_edges_take_one_task(spark):
    tracker = spark.sparkContext.statusTracker()
    edges = common.materialize(spark.range(3000).selectExpr("id as a", "id + 1 as b"))
    spark.sparkContext.setJobGroup("few", "few")
    common.components(edges)
    assert len(tracker.getJobIdsForGroup("few")) <= 4
    spark.sparkContext.setJobGroup("other", "other")


def test_ngram_join_sends_a_list_at_most_parts_times(spark, monkeypatch):
    """Rows sent to the meeting of what is apart follow a list's length; no link is lost by it."""
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    monkeypatch.setattr(ngram_join, "PARTS", 3)
    monkeypatch.setattr(ngram_join, "ROUNDS", 0)
    rng = np.random.default_rng(5)
    base = [f"b{k}" for k in range(60)]
    rows = []
    for i in range(60):
        words = list(base)
        for k in rng.choice(60, 2, replace=False):
            words[k] = f"x{i}_{k}"
        rows.append(" ".join(words))
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_groups(_docs(spark, enumerate(rows))).collect()}
    sets = [{" ".join(r.split()[k : k + 5]) for k in range(56)} for r in rows]
    label = list(range(60))
    for _ in range(60):
        for i in range(60):
            for j in range(60):
                if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                    label[i] = label[j] = min(label[i], label[j])
    assert got == dict(enumerate(label))
    lists = ngram_join.parts_of(spark.createDataFrame([(k, 1, 0, 100) for k in range(100)], "node long, sig long, component long, m long"))
    assert lists.count() == 3 * 100
    both = {(min(r.a, r.b), max(r.a, r.b)) for r in lists.alias("x").join(lists.alias("y"), ["sig", "part"]).selectExpr("x.node as a", "y.node as b").where("a < b").collect()}
    assert len(both) == 100 * 99 // 2


def _brute_repeats(raws, length):
    seen = collections.Counter(r[p : p + length] for r in raws for p in range(len(r) - length + 1))
    out = []
    for r in raws:
        runs = []
        for p in range(len(r) - length + 1):
            if seen[r[p : p + length]] > 1:
                if runs and p <= runs[-1][1]:
                    runs[-1][1] = p + length
                else:
                    runs.append([p, p + length])
        out.append([tuple(x) for x in runs])
    return out


@pytest.mark.parametrize(("length", "piece"), [(400, 1 << 20), (150, 700)])
def test_repeats_are_exact(spark, texts, monkeypatch, length, piece):
    monkeypatch.setattr(repeats, "PIECE", piece)
    rng = np.random.default_rng(4)
    passage = _prose(rng, 130)
    rows = [*texts, "De " * 400, "ab" * 900, "x" * 1500, passage, f"{_prose(rng, 40)} {passage} {_prose(rng, 40)}", f"é{passage[:450]} end", passage[200:620] + _prose(rng, 9), f"{passage[:401]}{passage[:401]}", _prose(rng, 3000)]
    raws = [(t or "").encode() for t in rows]
    want = _brute_repeats(raws, length)
    got = {r.doc_id: r for r in repeats.remove_repeats(_docs(spark, enumerate(rows), extra=True), length).collect()}
    assert len(got) == len(rows)
    for i, raw in enumerate(raws):
        assert [tuple(x) for x in got[i].removed] == want[i], i
        at = [0, *[x for r in want[i] for x in r], len(raw)]
        assert bytes(got[i].kept) == b"".join(raw[a:b] for a, b in zip(at[::2], at[1::2]))


def test_ranks_follow_the_order_of_repeated_pairs(spark):
    rng = np.random.default_rng(30)
    rows = [(int(a), int(b)) for a, b in rng.integers(0, 12, (90, 2))]
    seen = collections.Counter(rows)
    got = repeats.ranks(spark.createDataFrame(rows, "a long, b long")).orderBy("rank").collect()
    assert [(r.a, r.b) for r in got] == sorted(x for x in seen if seen[x] > 1) and len({r["rank"] for r in got}) == len(got)
    for n in (136, 150, 255, 400, 1000):
        size, one, two = repeats.offsets_of(n)
        assert size + one + two == n - repeats.WIDE + 1 and one <= size and two <= size + one


def test_repeats_of_repeated_rows(spark):
    rng = np.random.default_rng(8)
    t = _prose(rng, 200)
    got = repeats.remove_repeats(_docs(spark, [(1, t), (1, t), (2, "short"), (2, None)])).collect()
    assert sorted(len(r.kept) for r in got) == [0, 0, 0, 5] and len(got) == 4
    assert repeats.remove_repeats(_docs(spark, [])).count() == 0
    odd = _docs(spark, [(None, t), (3, t)]).withColumn("removed", F.lit("mine")).withColumn("f0", F.lit(7))
    got = repeats.remove_repeats(odd, removed="gone", kept="left").collect()
    assert {(r.removed, r.f0, len(r.left), len(r.gone)) for r in got} == {("mine", 7, 0, 1)}
    # period doubling: repeats of all lengths, and none
    words = [_thue_morse(n, *p) for n in (512, 2048) for p in ("ab", "ba", "cd")]
    want = _brute_repeats([w.encode() for w in words], 400)
    got = {r.doc_id: [tuple(x) for x in r.removed] for r in repeats.remove_repeats(_docs(spark, enumerate(words))).collect()}
    assert [got[i] for i in range(len(words))] == want


def _brute_passages(text, n):
    """Byte runs of the words that repeated runs of n words cover, in each text."""
    words = [[m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", t)] for t in text]
    seen = collections.Counter(tuple(t[a:b] for a, b in w[p : p + n]) for t, w in zip(text, words) for p in range(len(w) - n + 1))
    return [[(w[p][0], w[p + n - 1][1]) for p in range(len(w) - n + 1) if seen[tuple(t[a:b] for a, b in w[p : p + n])] > 1] for t, w in zip(text, words)]


@pytest.mark.parametrize(("words", "piece"), [(51, 1 << 20), (20, 700)])
def test_repeated_passages_of_words_are_exact(spark, texts, monkeypatch, words, piece):
    monkeypatch.setattr(repeats, "PIECE", piece)
    rng = np.random.default_rng(43)
    passage = _prose(rng, words).split()
    inner, short, tiny = " ".join(passage), " ".join(passage[1:]), " ".join(rng.choice(list("abcdefgh"), words + 3))
    rows = [*texts, f"{_prose(rng, 9)} {inner} {_prose(rng, 9)}", f"é {_prose(rng, 70)}\n{'  '.join(passage)}", f"{_prose(rng, 9)} x{inner}", f"{short} {_prose(rng, 9)}", tiny, f"z {tiny}", "b " * 300, inner + " " + _prose(rng, 3000)]
    raws = [(t or "").encode() for t in rows]
    cover = [np.zeros(len(r), bool) for r in raws]
    for want in (_brute_repeats(raws, 400), _brute_passages(raws, words)):
        for c, runs in zip(cover, want):
            for a, b in runs:
                c[a:b] = True
    got = {r.doc_id: r for r in repeats.remove_repeats(_docs(spark, enumerate(rows), extra=True), words=words).collect()}
    assert len(got) == len(rows) and cover[len(texts)].any() and not cover[len(texts) + 3].any()
    for i, raw in enumerate(raws):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], cover[i], [0]]).astype(int))).tolist()
        assert [tuple(x) for x in got[i].removed] == list(zip(edge[::2], edge[1::2])), i
        assert bytes(got[i].kept) == bytes(np.frombuffer(raw, np.uint8)[~cover[i]])


def test_pipeline_cuts_passages_of_over_50_words(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = np.random.default_rng(44)
    passage, item = _prose(rng, 52), _prose(rng, 55)
    assert len(passage) < 400 and len(item) < 400
    texts = [f"{_prose(rng, 40)} {passage} {_prose(rng, 30)}", f"{_prose(rng, 20)} {passage} {_prose(rng, 60)}", f"{_prose(rng, 50)} {item}", f"{_prose(rng, 30)} {item} end", _prose(rng, 90)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stage = dict(pipeline.STAGES)
    cut = stage["suffix-array dedup"](spark, docs, str(tmp_path)).localCheckpoint()
    got = {r.doc_id: r.text for r in cut.collect()}
    assert got == {0: texts[0].replace(passage, ""), 1: texts[1].replace(passage, ""), 2: texts[2].replace(item, ""), 3: texts[3].replace(item, ""), 4: texts[4]}
    # an item that stood twice is cut, but its documents still go
    assert {r.doc_id for r in stage["benchmark decontamination"](spark, cut, str(tmp_path)).collect()} == {0, 1, 4}


def _labelled(spark, sf):
    return spark.read.parquet(f"/root/testdata/{sf}/documents.parquet"), spark.read.parquet(f"/root/testdata/{sf}/labels.parquet")


def test_quality_on_held_out_labels(spark):
    docs, labels = _labelled(spark, "sf0.1")
    held = labels.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3)) == 0)
    model = quality.fit(docs, graded(labels.join(held, "doc_id", "left_anti")), "grade", train_rows=2000)
    assert np.all(np.diff(model.thresholds) > 0)
    got = quality.score(docs, model, 1).join(held, "doc_id").groupBy("quality", "toxic").agg(F.count("*").alias("n"), F.count_if("keep").alias("kept")).collect()
    n = {(r.quality, r.toxic): (r.n, r.kept) for r in got}
    assert n[1, 0][1] >= 0.995 * n[1, 0][0] and n[0, 0][1] <= 0.3 * n[0, 0][0]


def test_toxicity_on_held_out_labels(spark):
    docs, labels = _labelled(spark, "sf0.1")
    labels = labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    held = labels.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3)) == 0)
    links = toxicity.fit(docs, labels.join(held, "doc_id", "left_anti"), ["low_quality", "toxic"], train_rows=2500)
    assert len(links[1].earlier) == 1
    got = toxicity.score(docs, links, ["low_quality", "toxic"]).join(held.select("doc_id", "toxic"), "doc_id").groupBy("toxic").agg(F.count("*").alias("n"), F.count_if("is_toxic").alias("hit")).collect()
    n = {r.toxic: (r.n, r.hit) for r in got}
    assert n[1][1] >= 0.85 * n[1][0] and n[0][1] <= 0.015 * n[0][0]


def test_classifiers_take_odd_inputs(spark, texts):
    docs = _docs(spark, enumerate(texts), extra=True)
    none = spark.createDataFrame([(1, None, None), (None, 1, 1), (10**9, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, graded(none), "grade")
    assert quality.score(docs, model, 1).where("keep").count() == len(texts)
    some = spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(len(texts))], "doc_id long, quality int, toxic int")
    links = toxicity.fit(docs, some, ["quality", "toxic"])
    out = toxicity.score(docs, links, ["quality", "toxic"]).collect()
    assert len(out) == len(texts) and all(0 <= r.p_toxic <= 1 for r in out)
    assert all(not r.is_toxic for r in out if not (r.text or "").strip())
    assert quality.score(_docs(spark, []), model, 1).count() == 0


def test_ordinal_gradient_orders_grades():
    rng = np.random.default_rng(1)
    n = 400
    x = rng.normal(size=n)
    y = np.digitize(x + 0.2 * rng.normal(size=n), [-0.7, 0.6]).astype(float)
    rows = textmodel.Rows(np.zeros(n, np.int64), x, np.arange(n + 1))
    m = quality.fit_rows(rows, y)
    s = rows.dot(m.weights.astype(float))
    assert m.thresholds[0] < m.thresholds[1] and np.corrcoef(m.expected(s), y)[0, 1] > 0.85


def _directory(items, limit):
    out, todo = {}, [("", items)]
    while todo:
        prefix, rows = todo.pop()
        if sum(b for _, b in rows) <= limit or len(rows) == 1:
            out[prefix] = rows
        elif rows:
            todo += [(prefix + str(k), [r for r in rows if (r[0] >> (59 - len(prefix))) & 1 == k]) for k in (0, 1)]
    return {p: r for p, r in out.items() if r}


def test_sharding_is_extendible_hashing(spark):
    rows = [(i, "x" * (7 * i % 400)) for i in range(500)] + [(1000, "y" * 5000), (1001, None), (None, "z" * 10)]
    docs = _docs(spark, rows, extra=True)
    got = sharding.assign(docs, 2000).join(docs.select("doc_id", sharding.key_hash(F.col("doc_id")).alias("h")), "doc_id", "left").collect()
    assert len(got) == len(rows)
    items = [(int(hashlib.md5(("\0" if i is None else str(i)).encode()).hexdigest()[:15], 16), len((t or "").encode())) for i, t in rows]
    want = _directory(items, 2000)
    assert {r.shard_id for r in got} == {"s" + p for p in want}
    assert [r.oversized for r in got if r.doc_id == 1000] == [True] and sum(r.oversized for r in got) == 1
    size = collections.Counter()
    for r in got:
        size[r.shard_id] += r.n_bytes
    assert all(size[r.shard_id] == r.shard_bytes for r in got)


def test_sharding_parts_equal_keys(spark):
    docs = _docs(spark, [(7, "x" * 100)] * 60 + [(8, "y" * 50)])
    got = sharding.assign(docs, 1000).collect()
    size = collections.Counter()
    for r in got:
        size[r.shard_id] += r.n_bytes
    assert len(got) == 61 and max(size.values()) <= 1000
    assert sharding.assign(_docs(spark, []), 1000).count() == 0


def test_written_shards_hold_every_row_once(spark, tmp_path):
    rows = [(7, f"{i:03d}" + "x" * 97) for i in range(60)] + [(None, "n" * 40), (None, None)] + [(100 + i, "y" * 50) for i in range(30)]
    docs = _docs(spark, rows, extra=True)
    directory = {r.shard_id: r for r in sharding.write_shards(docs, str(tmp_path / "out"), 1000).collect()}
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.doc_id or -1, r.text or "") for r in got) == sorted((i or -1, t or "") for i, t in rows) and got[0].k == 1
    size, n = collections.Counter(), collections.Counter(r.shard_id for r in got)
    for r in got:
        size[r.shard_id] += len(r.text or "")
    assert max(size.values()) <= 1000 and set(n) == set(directory)
    assert all(size[s] == r.shard_bytes and n[s] == r.shard_rows for s, r in directory.items())


def test_decontamination_is_exact(spark, texts, monkeypatch):
    rng = np.random.default_rng(6)
    items = [*ODD, *[_prose(rng, n) for n in (3, 5, 8, 30, 30, 200)], texts[-1][:200]]
    docs = [*texts, *[f"{_prose(rng, 50)} {x} {_prose(rng, 400)}" for x in items[-7:]], items[-3].replace("w", "W"), items[-5]]
    isets, dsets = [_set(x) for x in items], [_set(x) for x in docs]
    want = {(d, i) for d, a in enumerate(dsets) for i, b in enumerate(isets) if b and 5 * len(a & b) >= 4 * len(b)}
    idf = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    for block in (1_000_000, 40):
        monkeypatch.setattr(decontamination, "BLOCK", block)
        got = decontamination.matches(_docs(spark, enumerate(docs), extra=True), idf).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
        clean = decontamination.decontaminate(_docs(spark, enumerate(docs)), idf)
        assert {r.doc_id for r in clean.collect()} == set(range(len(docs))) - {d for d, _ in want}
    assert decontamination.matches(_docs(spark, enumerate(docs)), idf.limit(0)).count() == 0


def _vectors(rng, n=700):
    x = rng.normal(size=(n, 64))
    for k in range(0, n, 3):
        x[k] = x[k // 2] + rng.normal(size=64) * rng.choice([0.0, 0.02, 0.3, 0.45])
    rows = [(i, [float(np.float32(a)) for a in v], int(i % 4)) for i, v in enumerate(x)]
    hot = rows[0][1]
    rows += [(n + i, hot, 0) for i in range(60)]
    odd = [None, [], [0.0] * 64, [float("nan")] * 64, [None] + [1.0] * 63, [float("inf")] * 64, [1.0, 2.0]]
    return rows + [(2000 + i, v, 0) for i, v in enumerate(odd)] + [(3000, hot, None)]


def test_embeddings_against_brute_force(spark):
    rows = _vectors(np.random.default_rng(3))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    good = {i: np.array(v, float) for i, v, lab in rows if v and lab is not None and len(v) == 64 and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)}
    label = {i: lab for i, _, lab in rows}
    ids = list(good)
    unit = np.array([good[i] / np.linalg.norm(good[i]) for i in ids])
    close = (unit @ unit.T >= 0.93) & (np.array([label[i] for i in ids])[:, None] == np.array([label[i] for i in ids])[None, :])
    np.fill_diagonal(close, False)
    comp = _components(len(ids), np.argwhere(close))
    links = dict(zip(ids, close.sum(1)))
    root = {i: ids[c] for i, c in zip(ids, comp)}
    got = {r.vec_id: r for r in embeddings.near_duplicates(df).collect()}
    assert len(got) == len(rows)
    found = sum(got[i].n_links for i in ids)
    assert found >= 0.9 * close.sum() and all(got[i].n_links <= links[i] for i in ids)
    same = [i for i in ids if got[i].n_links == links[i]]
    assert len(same) >= 0.97 * len(ids)
    if len(same) == len(ids):
        assert {i: got[i].component_id for i in ids} == root
    for i, _, _ in rows:
        assert got[i].kept == (got[i].component_id == i)
        if i not in good:
            assert got[i].n_links == 0 and got[i].component_id == i
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_embedding_recall_of_planted_pairs(spark):
    """The table's vectors, each third one with partners at given cosines, just above and below the threshold."""
    rng = np.random.default_rng(77)
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("embedding", "label").collect()
    x, label = np.array([r.embedding for r in rows], float), [r.label for r in rows]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    out, labels = [x], list(label)
    for k in range(0, len(x), 3):
        for cos in (0.9305, 0.935, 0.9295, 0.97):
            d = rng.normal(size=x.shape[1])
            d -= (d @ x[k]) * x[k]
            out.append((cos * x[k] + np.sqrt(1 - cos**2) * d / np.linalg.norm(d))[None])
            labels.append(label[k])
    x = np.concatenate(out)
    df = spark.createDataFrame([(i, v.tolist(), lab) for i, (v, lab) in enumerate(zip(x, labels))], "vec_id long, embedding array<double>, label int")
    x = np.array([r.embedding for r in df.orderBy("vec_id").collect()])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    lab = np.array([-1 if v is None else v for v in labels])
    close = (x @ x.T >= 0.93) & (lab[:, None] == lab[None, :]) & (lab >= 0)[:, None]
    np.fill_diagonal(close, False)
    got = embeddings.near_duplicates(df).agg(F.sum("n_links").alias("n")).first().n
    print("recall", got / close.sum(), "of", close.sum())
    assert close.sum() > 3000 and 0.97 * close.sum() <= got <= close.sum()


def test_lm_scores_equal_a_plain_sum(spark, texts):
    docs = _docs(spark, enumerate(texts), extra=True)
    vocab, table = lm_scoring.fit(docs)
    assert np.allclose(np.exp(table.astype(float)).sum(axis=1), 1, atol=1e-4)
    got = {r.doc_id: r for r in lm_scoring.score(docs, (vocab, table)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        ids = vocab.ids(pa.array([t], pa.string()))[0].tolist()
        full = [0, *ids, 0]
        want = sum(float(table[full[k] * lm_scoring.SIZE + full[k + 2], full[k + 1]]) for k in range(len(ids)))
        assert got[i].n_tokens == len(ids) and got[i].log_likelihood == pytest.approx(want, abs=1e-6)
        assert (got[i].mean_log_prob is None) == (not ids)
    counts = lm_scoring.cell_counts(docs.select("text"), vocab)
    assert counts.sum() == sum(r.n_tokens for r in got.values())
    flat = counts.sum(axis=0) / counts.sum()
    plain = -(counts.sum(axis=0) * np.log(np.maximum(flat, 1e-12))).sum()
    assert -(counts * table).sum() < plain  # both sides tell more than frequencies


def test_lm_window_scores_and_grows(spark, texts):
    docs = _docs(spark, enumerate(texts), extra=True)
    model = lm_window.fit(docs)
    got = {r.doc_id: r for r in lm_window.score(docs, model).collect()}
    assert len(got) == len(texts)
    words = [[w.lower() for w in __import__("re").findall("[^\x20\x09-\x0d]+", t or "")] for t in texts]
    assert [got[i].n_tokens for i in got] == [len(words[i]) for i in got] and all((got[i].mean_log_prob is None) == (not words[i]) for i in got)
    leaves = np.arange(len(model.keys) + 1)
    for x in (np.zeros(4, int), np.array([1, 2, 3, 4])):  # the leaves' probabilities sum to one
        assert np.exp(model.log_prob(leaves, np.tile(x, (len(leaves), 1)))).sum() == pytest.approx(1, abs=1e-4)
    n = model.counts[model.counts > 0]
    start = lm_window.Model(model.keys, model.counts[:-1], model.counts[-1])
    w = [lm_window.Words(pa.array([t], pa.string())) for t in texts]
    mass = lambda m: sum(m.log_prob(m.ids(a)[0], a.neighbours(m.ids(a)[1])).sum() for a in w)
    assert mass(start) == pytest.approx((n * np.log(n / n.sum())).sum(), rel=0.01) and mass(model) > mass(start)
    assert sum(r.log_likelihood for r in got.values()) == pytest.approx(sum(model.score(a).sum() for a in w), rel=1e-9)
    more = lm_window.vocabulary(_docs(spark, enumerate([*texts, *[f"new{i} " * 5 for i in range(300)]])).select("text"))
    assert len(more.keys) >= len(model.keys) + 300
    assert lm_window.score(_docs(spark, []), lm_window.fit(_docs(spark, []))).count() == 0


def test_lm_window_changes_follow_the_gradient(monkeypatch):
    """The changes of E by one step against numeric differences of the log-likelihood."""
    rng = np.random.default_rng(6)
    w = lm_window.Words(pa.array([_prose(rng, 40), "a b", _prose(rng, 9), ""], pa.string()))
    keys, n = np.unique(w.hash, return_counts=True)
    model = lm_window.Model(keys[::2], n[::2], int(n[1::2].sum()))
    model.W += rng.normal(0, 0.3, model.W.shape).astype(np.float32)
    leaf, row = model.ids(w)
    x = w.neighbours(row)
    moved = {}
    monkeypatch.setattr(lm_window.Trainer, "_move", lambda self, name, rows, grad: moved.setdefault(name, []).append((rows, grad)))
    lm_window.Trainer(model).learn(leaf, x, row)
    rows, grad = moved["E"][0]
    assert len(np.unique(rows)) == len(rows) and set(rows.tolist()) == set(x.reshape(-1).tolist()) | set(row.tolist()) | {0}
    for r in rng.permutation(len(rows))[:12].tolist() + [0]:
        for k in (0, 7):
            old, out = model.E[rows[r], k], []
            for step in (1e-2, -1e-2):
                model.E[rows[r], k] = old + step
                out.append(model.log_prob(leaf, x).sum())
            model.E[rows[r], k] = old
            assert grad[r, k] == pytest.approx(-(out[0] - out[1]) / 2e-2, abs=3e-3, rel=0.02)


def test_lm_query_tells_rare_words_apart(spark, tmp_path):
    rng = np.random.default_rng(12)
    base = [(i, _prose(rng, 80)) for i in range(150)]
    ends = [f"{a}{b}ing" for a in ("walk", "talk", "read") for b in ("", "s")]
    text = " ".join(f"{w} {e}" for w, e in zip(WORDS, ends))
    junk = " ".join(f"{w} {'zqxj' * 3}{e[-3:]}" for w, e in zip(WORDS, ends))
    _docs(spark, [*base, (900, text), (901, junk), (902, text.replace("walking", "talking"))]).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.log_likelihood for r in QUERIES["op10_lm_scoring"](spark, str(tmp_path)).collect()}
    assert got[900] != pytest.approx(got[901], abs=1e-6) and got[900] != pytest.approx(got[902], abs=1e-6)


def test_components(spark):
    rng = np.random.default_rng(7)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (260, 2))] + [(1000 + i, 1001 + i) for i in range(60)]
    df = spark.createDataFrame(edges, "a long, b long")
    want = _components(1100, edges)
    got = {r.node: r.component for r in common.components(df).collect()}
    assert got == {x: want[x] for e in edges if e[0] != e[1] for x in e}


def test_pipeline_stages(spark, sf_dir):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    kept = pipeline.drop_near_copies(spark, docs, sf_dir)
    assert kept.columns == docs.columns
    ids = sorted(text)
    _, comp = _brute_groups([text[i] for i in ids])
    assert {r.doc_id for r in kept.collect()} == {ids[c] for c in comp}
    cut = {r.doc_id: r.text for r in pipeline.cut_repeats(spark, docs, sf_dir).collect()}
    for i, runs in zip(ids, _brute_repeats([text[i].encode() for i in ids], 400)):
        raw = text[i].encode()
        at = [0, *[x for r in runs for x in r], len(raw)]
        left = b"".join(raw[a:b] for a, b in zip(at[::2], at[1::2])).decode("utf-8", "ignore")
        assert cut.get(i, "") == left or (not left.strip() and i not in cut)
    items = [_set(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    clean = {r.doc_id for r in pipeline.drop_benchmark(spark, docs, sf_dir).collect()}
    assert clean == {i for i in ids if not any(b and 5 * len(_set(text[i]) & b) >= 4 * len(b) for b in items)}
    out = pipeline.run(spark, sf_dir)
    assert set(docs.columns) < set(out.columns) and {r.doc_id for r in out.collect()} <= clean


def test_odd_column_names(spark):
    rows = [(1, "one two three four five six", 2), (None, None, 3), (2, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long").select("doc_id", "text", F.col("n").alias("a.b"), F.lit("w").alias("__words"), F.lit("t").alias("__text"), F.lit(1).alias("f0"), F.lit(2).alias("keep"), F.lit(3).alias("`x`"))
    path = public_tokenizers.path("piece_bpe_32k.model")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, graded(none), "grade")
    out = {
        "encode": sentencepieces.decode(sentencepieces.encode(docs, path), path),
        "toxicity": toxicity.score(docs, toxicity.fit(docs, none.withColumnRenamed("quality", "low_quality"), ["low_quality", "toxic"]), ["low_quality", "toxic"]),
        "quality": quality.score(docs, model, 1),
        "lm": lm_window.score(docs, lm_window.fit(docs)),
        "repeats": repeats.remove_repeats(docs),
        "groups": ngram_join.one_per_group(docs),
    }
    for name, df in out.items():
        got = df.collect()
        assert len(got) == 3 and [c for c in docs.columns if c != "keep"] == [c for c in df.columns if c in docs.columns and c != "keep"], name
        assert sorted((r["a.b"] or 0, r["__words"], r["__text"], r["f0"], r["`x`"]) for r in got) == [(0, "w", "t", 1, 3), (2, "w", "t", 1, 3), (3, "w", "t", 1, 3)], name


def test_pipeline_on_odd_tables(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = np.random.default_rng(41)
    passage = _prose(rng, 150)
    near = _prose(rng, 120)
    texts = [None, "", " ", _prose(rng, 30), near, near + " tail", f"{_prose(rng, 60)} {passage}", f"{passage} {_prose(rng, 60)}", _prose(rng, 4000)]
    rows = [(i if i != 3 else None, t, "en", None, len(t or "")) for i, t in enumerate(texts)] + [(4, near, "en", "s", len(near))]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, table in (("some", rows), ("none", [])):
        d = tmp_path / name
        spark.createDataFrame(table, schema).withColumn("kept", F.lit("mine")).withColumn("removed", F.lit(1)).withColumn("keep", F.lit(2)).write.parquet(str(d / "documents.parquet"))
        spark.createDataFrame([(1, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(str(d / "labels.parquet"))
        spark.createDataFrame([(1, _prose(rng, 40)), (2, None), (3, "")], "item_id long, text string").write.parquet(str(d / "benchmark.parquet"))
        got = pipeline.run(spark, str(d)).collect()
        if not table:
            assert not got
            continue
        ids = sorted((r.doc_id is None, r.doc_id or 0) for r in got)
        # 5 is a near copy of 4, whose repeated row goes; null, empty and blank texts stay
        assert ids == [(False, 0), (False, 1), (False, 2), (False, 4), (False, 6), (False, 7), (False, 8), (True, 0)]
        assert all(r.kept == "mine" and r.removed == 1 and r.keep == 2 for r in got)
        assert {r.doc_id: passage in (r.text or "") for r in got}[6] is False and all(r.n_chars == len(r.text or "") for r in got)


def test_oracles_name_queries():
    assert set(ORACLES) <= set(QUERIES) and all(any(q.startswith(f"op{n}_") for q in QUERIES) for n in range(1, 11))
