"""The training-data operators against brute force, round trips and held-out labels, with the odd cases of their docstrings."""

import hashlib
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rolegraph.llm import bpe, chat, components, exact_dedup, licenses, near_dedup, packing, quality, toxicity, vectors, warc
from rolegraph.llm.registry import ORACLES, QUERIES

DOC = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " ", "\n\t", "a", "a", "a b", "A  b", "é́ ß İ", "x" * 3000, "the cat " * 900, "<|endoftext|> y", " sep ", "a\x1cb  c"]


def table(spark, texts, extra=True):
    rows = [(i, t, "en", "s", 0, "clash", 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOC + ", score string, __id int")
    return df if extra else df.select("doc_id", "text")


def parquet(spark, tmp_path, **tables):
    for name, df in tables.items():
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, sf, name):
    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got, want = QUERIES[name](spark, sf), c.sql(ORACLES[name])
    cols = list(want.columns)
    assert sorted(map(str, (tuple(r) for r in got.select(cols).collect()))) == sorted(map(str, want.fetchall()))


def shingles(text, size):
    w = (text or "").encode().lower().split()
    return frozenset() if not w else frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1)))


def linked(docs, size, percent):
    sets = {i: shingles(t, size) for i, t in docs}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = {}
    for i, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(i)
    for i, s in sets.items():
        for j in {j for x in s for j in by[x] if j < i}:
            both = len(s & sets[j])
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(s), root(i)) for i, s in sets.items()}


def variants():
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    out = list(ODD)
    base = [word() for _ in range(120)]
    for _ in range(300):  # one large group whose members are about as far from each other as links reach
        w = list(base)
        for _ in range(r.randrange(1, 5)):
            w[r.randrange(len(w))] = word()
        out.append(" ".join(w))
    for _ in range(40):
        w = [word() for _ in range(r.randrange(1, 60))]
        out += [" ".join(w), " ".join(w[:-1] + [word()]), " ".join(w).upper()]
    return out


def test_near_dedup(spark, monkeypatch):
    texts = variants()
    want = linked(list(enumerate(texts)), 4, 80)
    for leaf, block, tile in ((128, 512, 1 << 20), (16, 32, 2000)):
        for k, v in (("LEAF", leaf), ("BLOCK", block), ("TILE", tile)):
            monkeypatch.setattr(near_dedup, k, v)
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(table(spark, texts)).collect()}
        assert got == {i: (n, c, i == c) for i, (n, c) in want.items()}


def test_near_dedup_empty_and_repeated(spark):
    assert near_dedup.near_duplicates(table(spark, [])).count() == 0
    df = spark.createDataFrame([(None, "a b c d e"), (3, "a b c d e"), (3, "a b c d e"), (2, None)], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.component_id) for r in near_dedup.near_duplicates(df).collect()) == [("2", 2), ("3", 3), ("3", 3), ("None", 3)]


def test_near_dedup_keeps_one_row_of_each(spark):
    words = [f"w{i}" for i in range(60)]
    near, other, third = " ".join(words), " ".join(f"v{i}" for i in range(60)), " ".join(f"u{i}" for i in range(60))
    copy = " ".join([*words[:-1], "x"])  # of near
    kept = lambda rows: sorted(((r.doc_id, r.text, r.k) for r in near_dedup.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, k int")).collect()), key=str)
    # (a) A null id that is a near-copy takes no other null id along, nor one without shingles.
    assert kept([(1, near, 0), (None, copy, 0), (None, other, 0), (None, "", 0), (None, None, 0)]) == sorted([(1, near, 0), (None, other, 0), (None, "", 0), (None, None, 0)], key=str)
    # (b) A repeated id leaves with the text that is a near-copy only.
    assert kept([(1, near, 0), (2, copy, 0), (2, other, 0), (2, " ", 0)]) == sorted([(1, near, 0), (2, other, 0), (2, " ", 0)], key=str)
    # (c) One stays of a group whose ids are all null or all equal.
    for i in (None, 7):
        left = kept([(i, near, 0), (i, copy, 0), (i, near.upper(), 0), (i, other, 0), (i, third, 0)])
        assert [t for _, t, _ in left].count(other) == [t for _, t, _ in left].count(third) == 1 and len(left) == 3
    # Of rows that agree in id and text one stays.
    assert [r[:2] for r in kept([(3, near, 0), (3, near, 1), (4, copy, 0), (5, other, 0)])] == [(3, near), (5, other)]


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(50)]
    label = {x: x for e in edges for x in e}
    while True:
        before = dict(label)
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
        if before == label:
            break
    got = {x.id: x.component for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: c for x, c in label.items() if x in got} and all(label[x] == x for x in set(label) - set(got))


@pytest.mark.parametrize("path", [bpe.byte_bpe_path()])
def test_bpe(spark, path):
    r = random.Random(3)
    parts = ["<|endoftext|>", " the", "ing", "'s", "\n\n", "aaaa", "  ", "é", " ", "\x1c", "1", ".", "ab", " ", "漢"]
    texts = ODD + ["".join(r.choice(parts) for _ in range(r.randrange(40))) for _ in range(300)]
    lib = Tokenizer.from_file(path)
    df = bpe.encode(table(spark, texts), path)
    got = {x.doc_id: (x.ids, x.decoded) for x in bpe.decode(df, path).collect()}
    for i, t in enumerate(texts):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert got[i] == (ids, lib.decode(ids, skip_special_tokens=False) if ids else "")


def test_bpe_query(spark, sf):
    lib = Tokenizer.from_file(bpe.byte_bpe_path())
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in QUERIES["op2_bpe_roundtrip"](spark, sf).collect():
        ids = lib.encode(docs[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_chat(monkeypatch):
    r = random.Random(5)
    monkeypatch.setattr(chat, "HELD_TURNS", 7)
    voc = ["hi", "\\", "\\n", "\n", *chat.CONTROL, "<", "é", "[", "x" * 50, "", "|im_end|>"]
    said = lambda: "".join(r.choice(voc) for _ in range(r.randrange(8)))
    for _ in range(400):
        turns = [(r.choice(["user", "assistant"]), said()) for _ in range(r.randrange(1, 30))]
        if r.random() < 0.5:
            turns[0] = ("system", said())
        if r.random() < 0.1:
            turns[r.randrange(len(turns))] = ("sys\ntem\\", turns[0][1])
        budget = r.choice([40, 100, 300])
        c = chat.Conversation(1, budget, r.choice([0, 20, 60]), lambda ts: [len(t) // 3 + 1 for t in ts])
        windows = [w for role, text in turns for w in c.add(role, text)] + list(c.spans(final=True))
        new, loss = [], []
        for w in windows:
            read = chat.read_turns(w[2])
            new += read[w[5] :]
            loss += [chat.unescape(w[2][s["start"] : s["end"]]) for s in w[3]]
            assert turns[0][0] != "system" or read[0] == turns[0]
            assert w[6] <= budget or len(read) - w[5] <= 1 + (w[1] == 0)
        assert new == turns and loss == [t for role, t in turns if role == "assistant"]


def test_chat_query(spark, tmp_path):
    rows = [(1, 0, "user", None), (1, 1, "assistant", "a"), (1, 1, "assistant", "a"), (None, 0, "user", "x"), (2, None, None, "y"), (2, 0, "assistant", "z" * 9000)]
    d = parquet(spark, tmp_path, conversations=spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: r for r in QUERIES["op3_chat_windows"](spark, d).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    said = "</s>[INST] ok [/INST]"
    assert set(got) == {-1, 1, 2, None}
    assert got[-1].turns_sha256 == sha(f"user\n{said}\nassistant\n{said}\n") and got[-1].loss_sha256 == sha(said)
    assert (got[1].n_turns, got[1].loss_chars, got[1].turns_sha256) == (3, 2, sha("user\n\nassistant\na\nassistant\na\n"))
    assert got[2].loss_chars == 9000 and got[2].turns_sha256 == sha("\ny\nassistant\n" + "z" * 9000 + "\n")


def test_warc(spark, tmp_path):
    big, key = "é" * 200, "page_id long, url string, html string"
    rows = [(3, "u", big), (1, "v\r\n%0A", big), (2, None, big), (5, "w", "s"), (4, "w", "s"), (6, "x", None), (None, "y", big), (7, "z", "\r\n\r\n")]
    index = warc.write_archives(warc.with_revisits(spark.createDataFrame(rows, key).withColumn("digest", F.lit("clash")), "page_id", "url", "html"), str(tmp_path / "a")).cache()
    got = {r.key: r for r in warc.read_records(index, str(tmp_path / "a")).collect()}
    for i, url, html in rows:
        body = (html or "").encode()
        r = got[i]
        assert (r.url, r.payload_bytes, r.payload_digest) == (url, len(body), hashlib.sha256(body).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", 1) if html == big and i != 1 else ("response", None))
        assert r.payload == (b"" if r.record_type == "revisit" else body)
    some = index.filter("key in (1, 7)")
    assert {bytes(r.payload) for r in warc.read_records(some, str(tmp_path / "a")).collect()} == {big.encode(), b"\r\n\r\n"}


def test_quotient_filter():
    r = np.random.default_rng(1)
    parts = [r.integers(0, 1 << 63, n, dtype=np.uint64) % np.uint64(700) * np.uint64((1 << 64) // 700) for n in (0, 1, 900, 2000)]
    merged = exact_dedup.CountingQuotientFilter.of(parts[0]).merge(*(exact_dedup.CountingQuotientFilter.unpack(exact_dedup.CountingQuotientFilter.of(p).pack()) for p in parts[1:]))
    f, n = merged.entries()
    want = np.unique(np.concatenate(parts), return_counts=True)
    assert (f == want[0]).all() and (n == want[1]).all()


def test_exact_dedup(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HOT", 2)  # most groups count as hot
    texts = ODD + ["x  y", "x y", " x y"] * 3 + ["hot"] * 400
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(table(spark, texts)).collect()}
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in texts]
    assert got == {i: (norm.index(t), norm.count(t), norm.index(t) == i) for i, t in enumerate(norm)}
    rows = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (2, "a", 3), (None, "a", 4), (5, "b", 5)], "doc_id long, text string, fp int")
    assert sorted(r.kept for r in exact_dedup.exact_dedup(rows).collect()) == [False, False, False, True, True]
    assert sorted(r.doc_id for r in exact_dedup.keep_first(rows).collect()) == [1, 5]


def test_toxicity(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(4))
    rows, labels = [], []
    for i in range(900):
        bad = i % 4 == 0
        sentences = [" ".join(word() for _ in range(6)) for _ in range(r.randrange(1, 12))]
        if bad:
            k = r.randrange(len(sentences))
            sentences[k] += r.choice([" zonk", " krampf" + word(), " blargh"])
        rows.append((i, ". ".join(sentences) + "."))
        labels.append((i, 1, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = toxicity.with_scores(docs, model, located="where").collect()
    out = [x for x in got if zlib.crc32(str(x.doc_id).encode()) % 3 == 1]
    assert np.mean([(x.score >= 0.7) == (x.doc_id % 4 == 0) for x in out]) > 0.97
    spans = [x.text[s.begin : s.end] for x in got if x.doc_id % 4 == 0 for s in x["where"]]
    assert len(spans) > 200 and np.mean([bool(re.search("zonk|krampf|blargh", s)) for s in spans]) > 0.95
    odd = toxicity.with_scores(table(spark, ODD), model, into="own").collect()
    assert len(odd) == len(ODD) and all(0 <= x.own <= 1 for x in odd)
    assert {x.own for x in toxicity.with_scores(table(spark, ["a"]), None, into="own").collect()} == {0.0}


def test_quality(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 8)))
    rows, labels = [], []
    for i in range(500):
        w = [word() for _ in range(r.randrange(30, 200))]
        rows.append((i, " ".join(x + "%%%" for x in w) if i % 3 == 0 else " ".join([w[0]] * len(w)) if i % 3 == 1 and i % 2 else " ".join(w)))
        labels.append((i, int(not (i % 3 == 0 or (i % 3 == 1 and i % 2))), 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    net = quality.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {x.doc_id: x.score for x in quality.with_scores(docs, net).collect()}
    out = [(y, got[i]) for i, y, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(s >= 0.3) == bool(y) for y, s in out]) > 0.93
    odd = quality.with_scores(table(spark, ODD), net, into="own").collect()
    assert len(odd) == len(ODD) and all(0 <= x.own <= 1 for x in odd)


def test_gradient():
    net = quality.Network(3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    texts = [b"hello world, this is text", b"$$$ %%% " * 60]
    x, row = quality.chunks(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    y, w = np.array([1, 0]), np.array([0.5, 0.5])
    _, g = net.gradient(x, row, y, w)
    for k, at in (("filters", (3, 2)), ("embed", (101, 1)), ("hidden", (5, 3)), ("out", (2,)), ("bias", (4,))):
        d = []
        for e in (1e-4, -1e-4):
            net.p[k][at] += e
            d.append(net.gradient(x, row, y, w)[0])
            net.p[k][at] -= e
        assert abs((d[0] - d[1]) / 2e-4 - g[k][at]) < 1e-3


def test_vectors(spark):
    r = np.random.default_rng(8)
    base = r.normal(size=(250, 16))
    x = np.concatenate([base, base[:60] + r.normal(size=(60, 16)) * 0.1, np.repeat(base[:1], 200, 0) + r.normal(size=(200, 16)) * 0.05, base[:20]]).astype(np.float32)
    rows = [(i, [float(v) for v in x[i]], 0) for i in range(len(x))]
    rows += [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] * 16, 0), (903, [None] * 16, 0), (904, [], 0), (905, [1.0, 2.0], 0), (906, [2.0, 4.0], 0)]
    got = {v.vec_id: v for v in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    near = u @ u.T >= 0.9
    assert sum(got[i].n_links for i in range(len(x))) >= 0.99 * (near.sum() - len(x))
    assert all(got[i].n_links <= near[i].sum() - 1 for i in range(len(x)))
    assert all(got[i].n_links == 0 and got[i].component_id == i for i in (900, 901, 902, 903, 904))
    assert got[906].component_id == 905 and got[906].n_links == 1
    assert all(got[i].component_id == 0 for i in range(310, 510))


def test_vectors_recall(spark, sf):
    docs = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    u = np.array([d.embedding for d in docs], np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    want = (u @ u.T >= 0.9).sum() - len(u)
    assert QUERIES["op8_vector_dedup"](spark, sf).agg(F.sum("n_links")).first()[0] >= 0.98 * want


def test_packing(spark):
    r = random.Random(9)
    lib = Tokenizer.from_file(packing.word_bpe_path())
    texts = ODD + [" ".join(r.choice(["cat", "Dog", "running", "é", "'s", "漢字", "<|startoftext|>", "1234"]) for _ in range(r.randrange(700))) for _ in range(60)]
    rows = packing.pack(table(spark, texts), packing.word_bpe_path(), window=256, with_ids=True).collect()
    pieces, sequences = {}, {}
    for p in rows:
        pieces.setdefault(p.doc_id, []).append(p)
        sequences.setdefault(p.sequence_id, []).append(p)
        assert p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes()) and p.length == len(p.ids)
    for i, t in enumerate(texts):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        own = sorted(pieces[i], key=lambda p: p.start)
        assert [x for p in own for x in p.ids] == ids and {p.doc_tokens for p in own} == {len(ids)}
        assert [p.start for p in own] == list(np.cumsum([0] + [p.length for p in own])[:-1])
    for s in sequences.values():
        s.sort(key=lambda p: p.offset)
        total = sum(p.length for p in s)
        assert [p.offset for p in s] == list(np.cumsum([0] + [p.length for p in s])[:-1])
        assert total == 256 or (total < 256 and total & (total - 1) == 0)


def test_licenses(spark):
    filler = "lorem ipsum the version of this license " * 20
    texts = ODD + ["Released under the\nMIT\nLicense. " + filler, filler + "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0", "cc by nc cc by nc", "apache license version 20", "apache license version 2"]
    got = {r.doc_id: r for r in licenses.scan(table(spark, texts)).collect()}
    for i, t in enumerate(texts):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        at = sorted((k, label) for p, label in licenses.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None)
        assert r.base_labels == ",".join(sorted({label for _, label in at}))
        # Every block against every template.
        found = set()
        for label, text in licenses.TEMPLATES:
            words, size = set(text.split()), licenses.SPREAD * len(text.split())
            if any(len(set(w[b : b + size]) & words) >= 0.9 * len(words) for b in range(len(w))):
                found.add(label)
        assert r.labels == ",".join(sorted(found | {label for _, label in at}))


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet").cache()
    kept = docs
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:4]:
        before = {r.doc_id: r.text for r in kept.collect()}
        kept = stage(spark, kept, sf).cache()
        assert kept.columns == docs.columns
        after = {r.doc_id for r in kept.collect()}
        assert after <= set(before) and kept.count() == len(after)
        if name == "exact dedup":
            norm = {}
            for i in sorted(before):
                norm.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", before[i] or ""), i)
            assert after == set(norm.values())
        if name == "near dedup":
            assert after == {i for i, (_, c) in linked(list(before.items()), 5, 80).items() if i == c}
        sizes.append(len(after))
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    clean = [i for i, r in labels.items() if r.toxic == 0]
    left = {r.doc_id for r in corpus_pipeline.STAGES[0][1](spark, docs, sf).collect()}
    assert np.mean([i in left for i in clean]) > 0.95
    packed = corpus_pipeline.STAGES[4][1](spark, kept, sf)
    assert packed.select("doc_id").distinct().count() == sizes[-1]


def test_entry_lists_all():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert "pipeline" in names and {f"op{n}" for n in range(1, 11)} == {x.split("_")[0] for x in names if re.match(r"op\d", x)}
    assert os.path.exists("corpus_pipeline.py")


def test_empty_tables(spark, tmp_path):
    d = parquet(
        spark, tmp_path, documents=spark.createDataFrame([], DOC), labels=spark.createDataFrame([], "doc_id long, quality int, toxic int"), pages=spark.createDataFrame([], "page_id long, url string, html string"),
        conversations=spark.createDataFrame([], "conv_id long, turn long, role string, text string"), embeddings=spark.createDataFrame([], "vec_id long, embedding array<float>, label int"),
    )
    for name, q in QUERIES.items():
        assert q(spark, d).count() == (1 if name.startswith("op3_") else 0), name
