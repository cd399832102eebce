"""Operators 1, 2, 4, 7 and 8 against brute force, the public libraries, and round trips."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quire.llm import op1_ngram_jaccard as o1
from quire.llm import op2_byte_bpe as o2
from quire.llm import op4_id_planes as o4
from quire.llm import op7_crf_quality as o7
from quire.llm import op8_chat_format as o8
from quire.llm.common import components, shared_path
from tests.llm.data import documents, empty, lines, prose, rows

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# -- components ------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(k, k + 1) for k in range(40)] + [(rng.randrange(100, 300), rng.randrange(100, 300)) for _ in range(120)]
    edges += [(400, k) for k in range(401, 460)] + [(5, 5), (401, 400)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    alone = {x for x in root if not any(x in e and e[0] != e[1] for e in edges)}
    rng.shuffle(edges)
    got = components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert {(r.node, r.root) for r in got} == {(x, find(x)) for x in root if x not in alone} and len(got) == len(set(got))
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# -- 1 ---------------------------------------------------------------------------------------------------------------

def groups_brute(docs):
    sets = []
    for _, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(ASCII_LOWER))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root, lists = list(range(len(docs))), defaultdict(list)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in enumerate(sets):
        both = Counter(j for g in s for j in lists[g])
        for j, n in both.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                root[find(i)] = find(j)
        for g in s:
            lists[g].append(i)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return Counter((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(docs))


def check_groups(df):
    docs = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    got = o1.similar_groups(df).collect()
    assert Counter(map(tuple, got)) == groups_brute(docs)
    return got


def test_ngram_jaccard(spark):
    got = check_groups(documents(spark))
    assert {r.component_id for r in got if r.doc_id in (1, 2, 3)} == {1}
    assert o1.similar_groups(empty(spark)).count() == 0


def families(seed, originals=True):
    """Groups of near copies, some only linked through others, and passages and lines that unlike documents share."""
    rng = random.Random(seed)
    shared, out, d = [prose(7000 + k, 60) for k in range(3)], [], 0
    for g in range(6):
        base = prose(seed * 100 + g, 120 + 30 * g).split(" ")
        if originals:
            out.append((d := d + 1, " ".join(base)))
        for _ in range((2, 5, 40, 9, 1, 70)[g]):
            w = list(base)
            for _ in range(rng.randrange(0, 9)):
                w[rng.randrange(len(w))] = f"new{rng.randrange(10 ** 6)}"
            out.append((d := d + 1, " ".join(w)))
    for k in range(80):
        out.append((d := d + 1, prose(seed * 500 + k, rng.randrange(1, 90)) + " " + shared[k % 3]))
    chain = prose(seed + 31, 100).split(" ")
    for k in range(30):  # each links with its neighbours alone
        out.append((d := d + 1, " ".join(chain[k * 3 : k * 3 + 60])))
    out += [(d + 1 + k, " ".join(shared[:2])) for k in range(3)] + [(d + 9, "one two three"), (d + 10, "One two three"), (d + 11, "two three")]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("seed,originals", [(1, True), (2, False)])
def test_ngram_jaccard_families(spark, seed, originals):
    check_groups(spark.createDataFrame(families(seed, originals), "doc_id bigint, text string").repartition(5))


def test_ngram_jaccard_hot_and_small_blocks(spark, monkeypatch):
    """All shingles of a big family hot, packs and list blocks of a few elements."""
    for name, value in (("PACKED", 3000), ("HOT", 100_000), ("BLOCK", 8)):
        monkeypatch.setattr(o1, name, value)
    check_groups(spark.createDataFrame(families(3), "doc_id bigint, text string").repartition(2))


def test_ngram_jaccard_packs(monkeypatch):
    """A pack is cut out of arrays made for all: there are as many packs as blocks of documents times buckets."""
    import pyarrow as pa

    texts, calls, unique = [prose(8000 + k, 80) for k in range(30)], [], np.unique
    sets = list(o1.shingles([t.encode() for t in texts]))
    hot = np.sort(sets[0][:20])
    want = sorted((o1._node(s), len(s), int(h)) for s in sets for h in s)
    monkeypatch.setattr(np, "unique", lambda *a, **b: calls.append(1) or unique(*a, **b))
    batch = pa.RecordBatch.from_pydict({"key": pa.array(range(30), pa.int64()), "text": texts})
    for buckets in (3, 500):
        out = pa.Table.from_batches(o1._postings(hot, buckets, 2)([batch]))
        got = []
        for r in out.to_pylist():
            one = pa.table({c: pa.chunked_array([pa.array([r[c]])]) for c in r})
            steps, at, nodes, sizes = (o1._unpacked(one.column(c), kind)[0] for c, kind in (
                ("h", np.uint64), ("at", np.uint32), ("nodes", np.int64), ("sizes", np.uint32)))
            h = np.cumsum(steps, dtype=np.uint64)
            got += zip(nodes[at].tolist(), sizes[at].tolist(), h.tolist())
            assert {x in set(hot.tolist()) for x in h.tolist()} == {r["bucket"] >= buckets}
        assert sorted(got) == want and not calls


def test_ngram_jaccard_tries_members_in_the_join(spark):
    """Of an asker's list, members that cannot link are dropped where the list is joined, before lists are gathered."""
    asked = spark.createDataFrame([(k, 10, 10, h) for k in range(6) for h in (7, 8)], "a bigint, na bigint, ma int, h bigint")
    members = spark.createDataFrame([(h, k, 10, 10) for k in range(6) for h in (7, 8)], "h bigint, node bigint, n bigint, m int")
    groups = spark.createDataFrame([(k, 0) for k in range(5)], "node bigint, root bigint")
    out = o1._candidates(asked, members, groups)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "filter(" not in plan and "root" in plan.split("Join Inner", 1)[1].split("\n", 1)[0]
    assert sorted(map(tuple, out.collect())) == [(k, 5, True) for k in range(5)]


def test_merged_and_probed():
    assert o1.merged([[1, 4, 9], [4], [], [1, 4, 10]]) == [(1, 2), (4, 3), (9, 1), (10, 1)] and o1.merged([]) == []
    a, b = np.array([1, 5, 7]), np.array([0, 5, 6, 7, 9])
    assert o1.probed(a, b) == o1.probed(b, a) == 2 and o1.probed(a[:0], b) == 0


def test_shingles_of_long_texts(monkeypatch):
    from quire.llm import wordhash

    texts = [t.encode() for t in (prose(1, 5000), "", "a b", prose(2, 30), "x" * 5000 + " " + prose(3, 400), " é a\tb")]
    want = [s.tolist() for s in o1.shingles(texts)]
    monkeypatch.setattr(wordhash, "CHUNK", 1000)
    assert [s.tolist() for s in o1.shingles(texts)] == want
    assert [len(s) for s in want[1:3]] == [0, 1] and len(want[5]) == 1


# -- 2 ---------------------------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def bpe():
    path = public_tokenizers.path(o2.VOCABULARY)
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return o2.codec(path, public_tokenizers.PATTERN), tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def hard_texts():
    rng = random.Random(4)
    out = ["a" * n for n in (1, 2, 3, 7, 500, 4001)] + ["ab" * 800, "aab" * 700, "é" * 300, "\U0001f600" * 50, " " * 300 + "x", "\n\n \t"]
    return out + ["".join(rng.choice(a) for _ in range(3000)) for a in ("ab", "abcé ", "0123456789", "aAbB́中", "!?.-_ ")]


def test_bpe_like_the_library(bpe):
    mine, library = bpe
    for t in hard_texts():
        assert mine.encode(t).tolist() == library.encode_ordinary(t) and mine.decode(mine.encode(t).tolist()) == t.encode()


def test_merges_one_by_one(bpe):
    """The queue of a single match, and the queue of all, also for a vocabulary whose ranks fall along a merge."""
    mine, library = bpe
    for t in ("tokenization", "ação", "aaaaaaaaaa", "xyzzyxyzzy" * 9):
        assert o2.merge(t.encode(), mine.ranks.get) == library._encode_single_piece(t.encode())
    rng = random.Random(8)
    for _ in range(60):
        ranks = {bytes([k]): 1000 + k for k in range(256)}
        found = {bytes(rng.choice(b"abc") for _ in range(rng.randrange(2, 6))) for _ in range(30)}
        for k, t in enumerate(rng.sample(sorted(found), len(found))):
            ranks[t] = k
        pieces = [bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 30))) for _ in range(40)]
        other = tiktoken.Encoding("o", pat_str=".+", mergeable_ranks=ranks, special_tokens={})
        want = [other._encode_single_piece(p) for p in pieces]
        assert [o2.merge(p, ranks.get) for p in pieces] == want
        several = [(p, w) for p, w in zip(pieces, want) if p not in ranks]  # whole tokens are looked up before
        got = o2.merge_all([p for p, _ in several], ranks, o2.Pairs(ranks), np.array([1000 + k for k in range(256)]))
        assert [np.frombuffer(x, np.int32).tolist() for x in got] == [w for _, w in several]


def test_bpe_table(spark, bpe, monkeypatch):
    df = documents(spark).withColumn("ids", F.lit("old"))
    got = o2.encoded(df).collect()
    assert len(got) == len(rows()) and set(df.columns) <= set(o2.encoded(df).columns)
    for r in got:
        assert r.ids == bpe[1].encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
    assert o2.encoded(empty(spark)).count() == 0
    texts = [r[1] or "" for r in rows()] * 2
    for name, value in (("CACHED", 50), ("TOGETHER", 200), ("GATHERED", 100), ("CACHED_CHARS", 500)):
        monkeypatch.setattr(o2, name, value)
        fresh = o2.Codec(public_tokenizers.path(o2.VOCABULARY), public_tokenizers.PATTERN)
        ids, counts = (np.concatenate(x) for x in zip(*fresh.encode_all(texts)))
        got = [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
        assert got == [bpe[1].encode_ordinary(t) for t in texts]


def test_bpe_digests(spark, bpe, tmp_path):
    documents(spark).select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    want = Counter()
    for d, t, *_ in rows():
        ids = bpe[1].encode_ordinary(t or "")
        want[d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    got = o2.op2_byte_bpe(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert Counter(map(tuple, got)) == want


# -- 4 ---------------------------------------------------------------------------------------------------------------

def test_planes_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 1000):
        ids = rng.integers(0, 1 << 32, n, dtype=np.uint64).astype("<u4").tobytes()
        assert o4.unplanes(o4.planes(ids), n) == ids


@pytest.mark.parametrize("special_as_text", [False, True])
def test_words_like_the_library(special_as_text):
    path = public_tokenizers.path(o4.VOCABULARY)
    mine, library = o4.Encoder(path, special_as_text), Tokenizer.from_file(path)
    library.encode_special_tokens = special_as_text
    assert mine.findall is not None
    every = "".join(map(chr, range(1, 0x250)))
    plain = "".join(c for c in every if regex.fullmatch(o4.PLAIN, c))
    special = ["abc <|endoftext|> def", "<|startoftext|><|ENDOFTEXT|>x<|endoftext|", "<|endoftext|>"]
    assert (library.encode(special[0], add_special_tokens=False).ids == [5334, 49407, 11649]) != special_as_text
    rng = random.Random(9)
    mixed = ["".join(rng.choice(plain) for _ in range(300)) for _ in range(40)] + [
        " ".join(rng.choice(plain) + "s'll 1½" for _ in range(99)) for _ in range(20)]
    for t in [r[1] or "" for r in rows()] + hard_texts() + special + mixed + [
            every, " ".join(every), plain, " ".join(plain), "It's we'LL ÀÉ İstanbul ǅ ŉ 12 3.5", "é   \x85x"]:
        assert np.frombuffer(mine.encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("block", [64, 65_536])
def test_id_files(spark, block):
    library = Tokenizer.from_file(public_tokenizers.path(o4.VOCABULARY))
    df = documents(spark).withColumn("start", F.lit(1))
    path = shared_path(spark, "test-ids")
    o4.write_ids(df, path, block=block)
    got = o4.read_ids(spark, path).collect()
    want = sorted(((r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "") for r in rows()))
    start = 0
    for r, (has, d, _, t) in zip(sorted(got, key=lambda r: (r.part, r.ordinal)), want, strict=True):
        ids = library.encode(t, add_special_tokens=False).ids + [2]
        assert (r.key, r.start, r.n_tokens) == (d if has else None, start, len(ids))
        assert np.frombuffer(r.ids, "<u4").tolist() == ids
        start += len(ids)
    blocks = spark.read.parquet(path).where("kind = 'blocks'").collect()
    assert sum(b.n_tokens for b in blocks) == start and all(len(b.planes) == 4 and b.n_tokens <= block for b in blocks)


def test_id_files_of_an_empty_table(spark, tmp_path):
    path = shared_path(spark, "test-ids")
    o4.write_ids(empty(spark), path)
    assert o4.read_ids(spark, path).count() == 0
    documents(spark).select("doc_id", "text").where("doc_id >= 100").write.parquet(str(tmp_path / "documents.parquet"))
    library = Tokenizer.from_file(public_tokenizers.path(o4.VOCABULARY))
    start = 0
    got = {r.doc_id: r for r in o4.op4_id_planes(spark, str(tmp_path)).collect()}
    for d, t in sorted((r[0], r[1]) for r in rows() if (r[0] or 0) >= 100):
        ids = library.encode(t, add_special_tokens=False).ids + [2]
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


# -- 7 ---------------------------------------------------------------------------------------------------------------

def sample(n=300):
    rng = random.Random(11)
    out = []
    for d in range(n):
        t, bad = lines(d, 1 + d % 6), d % 5 == 0
        if bad:
            mark = rng.choice(["$$$", "!!", " |", "###"])
            t = "\n".join(x.replace(" ", mark + " ") for x in t.split("\n"))
            t = t.upper() if mark == "!!" else t
            t = "A clean line stands here at first.\n" + t if d % 2 else t
        out.append((d, t, 0 if bad else 1))
    return out


def test_crf_quality(spark):
    data = sample()
    docs = spark.createDataFrame([r[:2] for r in data], "doc_id bigint, text string")
    labels = spark.createDataFrame([(d, q) for d, _, q in data if d % 4], "doc_id bigint, quality int")
    labels = labels.union(spark.createDataFrame([(None, 1), (5, None), (7, 3), (99999, 0)], "doc_id bigint, quality int"))
    model = o7.train(docs, labels)
    got = docs.withColumn("score", o7.quality_score(F.col("text"), model)).collect()
    held = [(r.score, q) for r, (_, _, q) in zip(sorted(got, key=lambda r: r.doc_id), data) if r.doc_id % 4 == 0]
    assert sum((s >= 0.3) == q for s, q in held) / len(held) > 0.9
    odd = documents(spark).withColumn("score", o7.quality_score(F.col("text"), model)).collect()
    assert len(odd) == len(rows()) and all(0 <= r.score <= 1 for r in odd)
    assert len({r.score for r in odd if not (r.text or "").strip()}) == 1
    again = o7.train(docs.repartition(7), labels.repartition(3))
    assert np.allclose(again.weights, model.weights) and again[1:] == pytest.approx(model[1:])
    assert documents(spark).limit(0).withColumn("s", o7.quality_score(F.col("text"), model)).count() == 0


def test_crf_without_labels(spark):
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    model = o7.train(documents(spark), labels)
    assert model.empty == 0.5 and set(o7.scores([b"a b c", b""], model)) == {0.5}


def test_crf_against_all_paths():
    """Marginals of short chains by summing over all label paths; the gradient by finite differences through fit's pieces."""
    rng = np.random.default_rng(3)
    doc = np.repeat([0, 1, 2, 4], [1, 4, 2, 5])
    x, w = rng.normal(size=(len(doc), 3)), rng.normal(size=7)
    got, trans = o7.marginals(x, doc, w), w[3:].reshape(2, 2)
    for d in set(doc.tolist()):
        rows_ = np.flatnonzero(doc == d)
        total, good = 0.0, np.zeros(len(rows_))
        for path in np.ndindex(*[2] * len(rows_)):
            p = np.exp(sum((x[i] @ w[:3]) * y for i, y in zip(rows_, path)) + sum(trans[a, b] for a, b in zip(path, path[1:])))
            total, good = total + p, good + p * np.array(path)
        assert np.allclose(got[rows_], good / total)


def test_line_features_of_cut_texts(monkeypatch):
    from quire.llm import wordhash

    texts = [t.encode() for t in (lines(1, 50), "", "\n\n", "one", lines(2, 3) + "\n", "é é\n\nA$$ b!! | c")]
    doc, size, x = o7.line_features(texts)
    monkeypatch.setattr(wordhash, "CHUNK", 300)
    doc2, size2, x2 = o7.line_features(texts)
    assert (doc == doc2).all() and np.allclose(size, size2) and np.allclose(x, x2)
    assert Counter(doc.tolist()) == {0: 50, 3: 1, 4: 3, 5: 2}


# -- 8 ---------------------------------------------------------------------------------------------------------------

CONVERSATIONS = [(1, 1, "assistant", "b\\<turn user>\n</turn>\n"), (1, 0, "user", "a"), (1, 2, "assistant", ""), (2, 0, None, None),
                 (None, 3, "user", "x"), (None, None, "assistant", "y"), (3, 0, "assistant>\n", "é\U0001f600"), (3, 0, "assistant", "tie"),
                 (3, 0, "assistant", "tie"), (4, 5, "assistant", "z" * 50_000), (5, 0, "assistant", "\\"), (5, 1, "assistant", "\\\\<")]


def test_chat_round_trip(spark):
    df = spark.createDataFrame(CONVERSATIONS, "conv_id bigint, turn bigint, role string, text string").withColumns(
        {"piece": F.lit(1), "loss": F.lit(2)})
    out = o8.formatted(df)
    got = {r.conv_id: r for r in o8.parsed(out).collect()}
    groups = defaultdict(list)
    none_first = lambda v: (v is not None, v)
    for c, t, r, x in sorted(CONVERSATIONS, key=lambda r: tuple(map(none_first, r))):
        groups[c].append((r or "", x or ""))
    assert set(got) == set(groups)
    for c, turns in groups.items():
        said = "".join(x for r, x in turns if r == "assistant")
        r = got[c]
        assert (r.n_turns, r.loss_chars) == (len(turns), len(said))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert sum(r.formatted_chars for r in got.values()) == sum(len(r.formatted) for r in out.collect())
    assert o8.parsed(o8.formatted(df.limit(0))).count() == 0


def render(template, *messages):
    return "".join(t for t, _, _ in o8.compiled(template)([dict(zip(("role", "text"), m)) for m in messages]))


def test_template_language():
    two = [("user", "hi"), ("assistant", "yo")]
    assert render("A{# no #}B{{ 'x' ~ 1 + 2 }}", *two) == "ABx12"
    assert render("{% for m in messages %}{{ loop.index0 }}{{ m['text'] | upper }}{% if loop.first %},{% endif %}{% endfor %}!", *two) == "0HI,1YO!"
    assert render("{% for m in messages -%}  \n {{- m.role }} {%- endfor %}", *two) == "userassistant"
    assert render("{% if false %}a{% elif 1 == 1 and not none %}b{% else %}c{% endif %}") == "b"
    assert render("{% for m in messages %}{% if m.role != 'user' or false %}{{ m.nothing }}x{% else %}-{% endif %}{% endfor %}", *two) == "-x"
    pieces = list(o8.compiled("{% for m in messages %}<{% generation %}{{ m.text }}{% endgeneration %}>{% endfor %}")([{"text": "t"}, {"text": "u"}]))
    assert pieces == [("<", False, 0), ("t", True, 0), (">", False, 0), ("<", False, 1), ("u", True, 1), (">", False, 1)]


def test_constants_are_folded():
    tree = o8.fold(o8.parse("a{{ 'b' | upper }}{% if 1 == 2 %}no{% endif %}{% if true %}c{% endif %}{{ x ~ ('d' + 'e') }}"))
    assert tree == [("text", "aBc"), ("emit", ("~", ("name", "x"), ("const", "de")))]


@pytest.mark.parametrize("bad", [
    "{{ m.__class__() }}", "{% for x in m %}{% endfor %}", "{{ a", "{% if x %}", "{% endif %}", "{{ x | eval }}", "{% include 'f' %}",
    "{{ messages }}", "{{ m[0] }}", "{{ 'a }}", "{{ }}", "{{ 1 + }}", "{% for m in messages %}{% for n in messages %}{% endfor %}{% endfor %}",
    "{{ a b }}", "%} x", "{% for m in messages %}{% endfor %}{% for m in messages %}{% endfor %}"])
def test_templates_that_are_refused(bad):
    with pytest.raises(o8.TemplateError):
        o8.compiled(bad)


def test_values_without_fields_are_refused():
    for bad in ("{% for m in messages %}{{ m.text.upper }}{% endfor %}", "{% for m in messages %}{{ m + 1 }}{% endfor %}"):
        with pytest.raises(o8.TemplateError):
            render(bad, ("user", "x"))
    assert render("{{ m.__class__ }}{{ nothing }}") == ""
