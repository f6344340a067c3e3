"""Very long texts, clashing columns, and settings that only large tables reach."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rolegraph.llm import bpe, components, exact_dedup, labelled, licenses, near_dedup, packing, quality, toxicity, vectors
from rolegraph.llm.registry import QUERIES

R = random.Random(11)
WORDS = [f"{a}{b}{c}" for a in "bdkmt" for b in "aeiou" for c in "nrsl"]
#: Longer than a numpy step (256 KiB), an Arrow batch (4 MiB), and a word without any break.
LONG = [
    " ".join(R.choice(WORDS) for _ in range(80_000)),
    "x" * 300_000,
    "é " * 140_000 + "zonk. " + "\n\n".join(R.choice(WORDS) for _ in range(3000)),
    " ".join(R.choice(WORDS) for _ in range(1_150_000)) + " released under the MIT License",
    "short text",
]
SPACE = r"[\x20\x09-\x0D]+"


@pytest.fixture(scope="module")
def long_docs(spark):
    return spark.createDataFrame(list(enumerate(LONG)), "doc_id long, text string").repartition(2).cache()


def test_long_near_dedup(spark, long_docs):
    near = LONG[0].split(" ")
    near[5] = near[70_000] = "other"
    docs = long_docs.unionByName(spark.createDataFrame([(9, " ".join(near)), (10, LONG[3] + " more")], "doc_id long, text string"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs).collect()}
    sets = {i: {tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} for i, w in ((i, t.lower().split()) for i, t in [*enumerate(LONG)])}
    assert {i: n for i, (n, _) in got.items() if i < 9} == {i: len(s) for i, s in sets.items()}
    assert got[9][1] == 0 and got[10][1] == 3 and all(got[i][1] == i for i in range(len(LONG)))


def test_long_bpe_and_packing(long_docs):
    lib = Tokenizer.from_file(bpe.byte_bpe_path())
    some = long_docs.filter("doc_id <> 3")
    for r in bpe.decode(bpe.encode(some, bpe.byte_bpe_path()), bpe.byte_bpe_path()).select("doc_id", "ids", "decoded").collect():
        assert r.ids == lib.encode(LONG[r.doc_id], add_special_tokens=False).ids and r.decoded == LONG[r.doc_id]
    lib = Tokenizer.from_file(packing.word_bpe_path())
    pieces = {}
    for p in packing.pack(some, packing.word_bpe_path(), with_ids=True).collect():
        pieces.setdefault(p.doc_id, []).append((p.start, p.ids))
    for i, own in pieces.items():
        assert [x for _, ids in sorted(own) for x in ids] == [*lib.encode(LONG[i], add_special_tokens=False).ids, 2]


def test_long_exact_dedup(spark, long_docs):
    docs = long_docs.unionByName(spark.createDataFrame([(20, LONG[3].replace(" ", "\n ", 7)), (21, LONG[0])], "doc_id long, text string"))
    got = {r.doc_id: (r.keep_id, r.text_sha256) for r in exact_dedup.exact_dedup(docs).collect()}
    assert got[20][0] == 3 and got[21][0] == 0
    assert all(got[i] == (i, hashlib.sha256(re.sub(SPACE, " ", t).encode()).hexdigest()) for i, t in enumerate(LONG))
    assert sorted(r.doc_id for r in exact_dedup.keep_first(docs).collect()) == list(range(len(LONG)))


def test_long_scores(long_docs):
    feature = toxicity.Words(np.frombuffer(b"zonk", np.uint8), np.array([0, 4]), toxicity.SEPARATORS, toxicity.VALUES).hashes
    model = toxicity.Model(-12.0, feature, np.array([15.0]))
    got = {r.doc_id: r for r in toxicity.with_scores(long_docs, model, located="where").collect()}
    assert [i for i in sorted(got) if got[i].score > 0.9] == [2] and LONG[2][got[2]["where"][0].begin : got[2]["where"][0].end].endswith("zonk")
    net = quality.Network(5)
    for r in quality.with_scores(long_docs, net).collect():
        t = LONG[r.doc_id].encode()
        assert abs(r.score - net.scores(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0]) < 1e-6


def test_long_licenses(long_docs):
    got = {r.doc_id: r for r in licenses.scan(long_docs).collect()}
    assert got[3].labels == "mit" and got[3].n_words == 1_150_005 and got[3].first_word is not None
    assert all(got[i].labels == "" for i in (0, 1, 2, 4))


def test_long_chat_and_warc(spark, tmp_path):
    turns = [(5, 0, "user", LONG[0]), (5, 1, "assistant", LONG[2] + "</s>"), (6, 0, "assistant", LONG[1])]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    spark.createDataFrame([(i, None, t) for i, t in enumerate([*LONG, LONG[3]])], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r.conv_id: r for r in QUERIES["op3_chat_windows"](spark, str(tmp_path)).collect()}
    assert got[5].turns_sha256 == sha(f"user\n{LONG[0]}\nassistant\n{LONG[2]}</s>\n") and got[5].loss_sha256 == sha(LONG[2] + "</s>") and got[6].loss_chars == 300_000
    got = {r.page_id: r for r in QUERIES["op4_warc_roundtrip"](spark, str(tmp_path)).collect()}
    assert all(got[i].payload_digest == sha(t) for i, t in enumerate(LONG)) and got[len(LONG)].refers_to == 3


def test_stages_keep_clashing_columns(spark):
    r = random.Random(1)
    names = ["__id", "__label", "__score", "__gone", "__sha", "__doc", "__bucket", "score", "doc", "sha", "id", "a.b"]
    text = lambda bad: " ".join(r.choice(WORDS) for _ in range(40)) + (" zonk." if bad else ".")
    rows = [(i, text(i % 3 == 0), *[f"{n}{i}" for n in names]) for i in range(150)]
    rows += [(200, rows[1][1], *rows[1][2:]), (None, rows[2][1], *rows[2][2:]), (201, None, *[None] * len(names))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    labels = spark.createDataFrame([(i, 1 - (i % 3 == 0), int(i % 3 == 0), "x", "y", "z") for i in range(150)], "doc_id long, quality int, toxic int, text string, __id string, label string")
    for stage in (lambda d: toxicity.clean(d, labels), lambda d: quality.good(d, labels), exact_dedup.keep_first, lambda d: near_dedup.one_of_each(d, 5, 80)):
        out = stage(docs)
        assert out.columns == docs.columns
        own = {tuple(x) for x in out.collect()}
        assert own <= {tuple(x) for x in rows} and len(own) >= 90
    assert {x.doc_id for x in exact_dedup.keep_first(docs).collect()} == {*range(150), 201}
    scored = quality.with_scores(docs, None)
    assert scored.columns.count("score") == 1 and {x.score for x in scored.collect()} == {1.0}


def test_decisions_by_row(spark):
    """Of rows that agree in id and text one stays, whatever else they hold; null ids too."""
    docs = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (None, "a", 3), (None, "b", 4), (None, "b", 5), (3, "c", 6)], "doc_id long, text string, k int")
    got = [(x.doc_id, x.text) for x in exact_dedup.keep_first(docs).collect()]
    assert sorted(got, key=str) == sorted([(1, "a"), (None, "b"), (3, "c")], key=str)


@pytest.mark.parametrize(("finish", "block"), [(0, 1 << 18), (40, 30)])
def test_components_in_rounds(spark, monkeypatch, finish, block):
    r = random.Random(2)
    monkeypatch.setattr(components, "BLOCK_EDGES", max(block, finish + 1))
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2001 + i) for i in range(50)] + [(5, 5), (None, 7)]
    label = {x: x for e in edges for x in e if x is not None}
    while True:
        before = dict(label)
        for a, b in edges:
            if a is not None:
                label[a] = label[b] = min(label[a], label[b])
        if before == label:
            break
    got = {x.id: x.component for x in components.components(spark.createDataFrame(edges, "a long, b long"), finish=finish).collect()}
    assert got == {x: c for x, c in label.items() if x != c}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_vectors_of_any_length(spark):
    rows = [(0, [1e200, 2e200, 0.0, 0.0]), (1, [1.0, 2.0, 0.0, 0.0]), (2, [1e-200, 2e-200, 0.0, 1e-300]), (3, [5e-324, 1e-323, 0.0, 0.0]), (4, [-1.0, -2.0, 0.0, 0.0]), (5, [1e308, 1e308, 1e308, 1e308]), (6, [3.0, 3.0, 3.0, 3.0]), (7, [2.0, 4.0, 0.0]), (8, [7.0])]
    got = {v.vec_id: (v.n_links, v.component_id) for v in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {0: (3, 0), 1: (3, 0), 2: (3, 0), 3: (3, 0), 4: (0, 4), 5: (1, 5), 6: (1, 5), 7: (0, 7), 8: (0, 8)}


def test_vector_sketches_bound_the_error():
    r = np.random.default_rng(4)
    for dim in (1, 3, 64, 500):
        u = vectors.unit(r.normal(size=(60, dim)) ** 3)
        m = vectors.sketches(u)
        head = np.ascontiguousarray(m[:, :8]).view(np.float32).astype(np.float64)
        v, e = m[:, 8:].view(np.int8) * head[:, :1], head[:, 1]
        assert (np.abs(u @ u.T - v @ v.T) <= e[:, None] + e[None, :] + e[:, None] * e[None, :]).all()


@pytest.mark.parametrize("dim", [16, 64])
def test_vector_filters_follow_the_rows(dim):
    """Recall at the bound, and random partners of a vector, for tables from a thousand rows to a quarter of a million."""
    r = np.random.default_rng(5)
    partners = []
    for n in (1000, 16_000, 256_000):
        x = vectors.unit(r.normal(size=(1500, dim)))
        z = r.normal(size=x.shape)
        z = vectors.unit(z - (z * x).sum(1, keepdims=True) * x)
        y = 0.9 * x + np.sqrt(1 - 0.81) * z
        (a, f), (b, g) = (vectors.decode(v, *vectors.plan(dim, n, 0.9)) for v in (x, y))
        kx, ky = set(zip(a.tolist(), f.tolist(), strict=True)), set(zip(b.tolist(), g.tolist(), strict=True))
        assert len({i for i, _ in kx & ky}) >= 0.95 * len(x)
        shifted = set(zip(((b + 1) % len(x)).tolist(), g.tolist(), strict=True))
        partners.append(len({i for i, _ in kx & shifted}) / len(x) * n)
    assert partners[2] < 16 * partners[0]  # 256 times the rows


def test_licenses_find_every_block(spark):
    r = random.Random(3)
    voc = [f"w{i}" for i in range(30)]
    templates = [("a", " ".join(voc[:20])), ("b", " ".join(r.choice(voc) for _ in range(40))), ("c", "w1 w2 w3"), ("long", " ".join(f"z{i}" for i in range(120)))]
    texts = []
    for _ in range(150):
        w = [r.choice([*voc, *["foo"] * r.randrange(40)]) for _ in range(r.randrange(150))]
        t = r.choice(templates)[1].split()
        for _ in range(r.randrange(len(t) + 8)):
            t.insert(r.randrange(len(t)), "bar")
        for _ in range(r.randrange(4)):
            t.pop(r.randrange(len(t)))
        at = r.randrange(len(w) + 1)
        w[at:at] = t
        texts.append(" ".join(w))
    got = {x.doc_id: x for x in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), templates=templates, phrases={}).collect()}
    seen = 0
    for i, text in enumerate(texts):
        w, found, best = text.split(), set(), 0.0
        for label, t in templates:
            s, size = set(t.split()), licenses.SPREAD * len(t.split())
            share = max(len(s & set(w[k : k + size])) for k in range(len(w))) / len(s)
            if share >= 0.9:
                found.add(label)
                best = max(best, share)
        assert got[i].labels == ",".join(sorted(found)) and abs(got[i].score - best) < 1e-12
        seen += len(found)
    assert seen > 60
    one = licenses.scan(spark.createDataFrame([(1, "so " * 37 + templates[3][1])], "doc_id long, text string"), templates=[("own", " ".join(f"z{i}" for i in range(60)))], phrases={}).first()
    assert (one.labels, one.score) == ("own", 1.0)
    own = licenses.scan(spark.createDataFrame([(i, "and " + t.upper()) for i, (_, t) in enumerate(licenses.TEMPLATES)], "doc_id long, text string"))
    assert all(licenses.TEMPLATES[x.doc_id][0] in x.labels.split(",") for x in own.collect())


@pytest.mark.parametrize(("name", "module", "label", "modulus", "rest"), [("op6_toxicity", toxicity, "toxic", 3, 1), ("op7_quality", quality, "quality", 5, 0)])
def test_classifier_queries_score_every_row(spark, sf, name, module, label, modulus, rest):
    """The query against scoring each text alone, and held-out labels."""
    sf = "/root/testdata/sf0.01" if label == "toxic" else sf  # the smallest tables have too few toxic examples
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    model = module.train(docs, labels)
    got = {r.doc_id: r for r in QUERIES[name](spark, sf).collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % modulus == rest)
        assert got[i].predicted == int(got[i].score >= (0.7 if label == "toxic" else 0.3)) and 0 <= got[i].score <= 1
    if label == "quality":
        alone = {i: model.scores(np.frombuffer((t or "").encode(), np.uint8), np.array([0, len((t or "").encode())]))[0] for i, t in texts.items()}
    else:
        weights = dict(zip(model.features.tolist(), model.weights.tolist(), strict=True))
        alone = {}
        for i, t in texts.items():
            d = np.frombuffer((t or "").encode(), np.uint8)
            s = toxicity.Sentences(d, np.array([0, len(d)]))
            held = [set() for _ in s.first]
            for f in s.features():
                for n, h in zip(s.of_word.tolist(), f.tolist(), strict=True):
                    held[n].add(h)
            z = [model.bias + sum(weights.get(h, 0.0) for h in x) for x in held]
            alone[i] = 1 - np.prod([1 / (1 + np.exp(v)) for v in z or [model.bias]])
    assert max(abs(alone[i] - got[i].score) for i in texts) < 1e-4
    marked = {r.doc_id: r[label] for r in labels.collect()}
    out = [(marked[i], got[i].score) for i in got if got[i].held_out and marked.get(i) is not None]
    ones, zeros = [s for y, s in out if y == 1], [s for y, s in out if y == 0]
    assert np.mean([(a > b) + 0.5 * (a == b) for a in ones for b in zeros]) > 0.9


def test_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i, f"t{i}", 1) for i in range(50)] + [(60, None, 1), (61, "x" * 99, 1)], "doc_id long, text string, label int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(70)] + [(None, 1)], "doc_id long, quality int")
    got = labelled.sample(docs, labels, "quality", F.col("doc_id") > 3, {1: 5, 0: 100}, 50)
    assert sum(y for _, y in got) <= 5 and sum(1 - y for _, y in got) == 23 and all(int(t[1:]) > 3 for t, _ in got)


def plain_sum_of_squares(sizes, window):
    """Where each piece goes by the rule alone: window number and offset, or None for whole windows."""
    fill, out, counts = [], [], np.zeros(window + 1, np.int64)
    at = {}
    for size in sizes:
        size %= window
        if not size:
            out.append(None)
            continue
        best = (2 * counts[size] + 1, 1, None)
        for level in np.flatnonzero(counts[: window - size + 1]).tolist():
            up = level + size
            change = (counts[level] - 1) ** 2 - counts[level] ** 2 + (0 if up == window else (counts[up] + 1) ** 2 - counts[up] ** 2)
            best = min(best, (change, 0, -level))
        if best[2] is None:
            fill.append(0)
            w = len(fill) - 1
        else:
            w = at[-best[2]].pop()
            counts[-best[2]] -= 1
        out.append((w, fill[w]))
        fill[w] += size
        if fill[w] < window:
            counts[fill[w]] += 1
            at.setdefault(fill[w], []).append(w)
    return out, fill


@pytest.mark.parametrize("sizes", [(500, 3000), (1500, 4000), (20, 1500), (4095, 4097)])
def test_packing_places_every_document_by_the_rule(sizes):
    """However many windows are open: the same windows and offsets as by the rule alone, until the task ends."""
    rng = np.random.default_rng(3)
    lengths = rng.integers(*sizes, 6000).tolist()
    packer, most, placed = packing.SumOfSquares(), 0, {}
    for d, n in enumerate(lengths):
        packer.add(d, np.full(n, d % 1000, "<u2"))
        most = max(most, packer.open)
    want, fill = plain_sum_of_squares(lengths, packing.WINDOW)
    windows = {}
    for window in [*packer.out, *(w for level in packer.at_level.values() for w in level)]:
        at = 0
        for d, start, ids in window:
            if len(ids) < packing.WINDOW:
                placed[d] = (windows.setdefault(id(window), len(windows)), at)
            at += len(ids)
    same = {}
    for d, w in enumerate(want):
        assert (w is None) == (d not in placed)
        if w is not None:
            assert placed[d][1] == w[1] and same.setdefault(w[0], placed[d][0]) == placed[d][0]
    assert packer.open == sum(0 < f < packing.WINDOW for f in fill) and packer.held == 2 * sum(f for f in fill if f < packing.WINDOW)
    assert most > 1000 or sizes == (20, 1500)
    packer.close()
    assert packer.held == packer.open == 0 and sum(len(ids) for w in packer.out for _, _, ids in w) == sum(lengths)
    assert all(sum(len(ids) for *_, ids in w) in (packing.WINDOW, *(1 << k for k in range(12))) for w in packer.out)


def test_packing_holds_no_more_than_its_bound():
    packer = packing.SumOfSquares(64, held=4000)
    for d in range(3000):
        packer.add(d, np.full(40, d, "<u4"))
        assert packer.held <= 4000
    packer.close()
    assert sum(len(ids) for w in packer.out for _, _, ids in w) == 120_000


def test_packing_query_of_documents(spark, sf):
    """The registered query against the library's ids: each in one piece, sequences gapless and full or powers of two."""
    lib, docs = Tokenizer.from_file(packing.word_bpe_path()), {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ids = {i: [*lib.encode(t, add_special_tokens=False).ids, 2] for i, t in docs.items()}
    pieces, seqs = {}, {}
    for r in packing.op9_packing(spark, sf).collect():
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4"))
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert pieces.keys() == ids.keys()
    for i, own in [*pieces.items(), *seqs.items()]:
        at = 0
        for start, n in sorted(own):
            assert start == at and n > 0
            at += n
    assert all(sum(n for _, n in pieces[i]) == len(x) for i, x in ids.items())
    assert all((n := sum(k for _, k in s)) == 4096 or n & (n - 1) == 0 for s in seqs.values())


def test_quality_of_long_texts_in_little_memory():
    """A text of 40 MB takes less than four times its bytes beside it, and steps change no score."""
    import tracemalloc

    net, rng = quality.Network(), np.random.default_rng(2)
    data = rng.integers(32, 127, 3_000_000).astype(np.uint8)
    offs = np.array([0, 0, 10, 700_000, 700_300, len(data)])
    x, row = quality.chunks(data, offs)
    whole = 1 / (1 + np.exp(-net.forward(x, row, 5)[0].astype(np.float64)))
    assert np.abs(net.scores(data, offs) - whole).max() < 1e-6
    assert net.scores(np.zeros(0, np.uint8), np.zeros(3, np.int64)).shape == (2,) and net.scores(data[:0], np.zeros(1, np.int64)).shape == (0,)
    long = np.tile(data, 14)
    tracemalloc.start()
    net.scores(long, np.array([0, len(long)]))
    assert tracemalloc.get_traced_memory()[1] < 4 * len(long)
    tracemalloc.stop()
