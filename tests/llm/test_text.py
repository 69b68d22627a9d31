"""Tokens, packing, token files, chat, quality rules, toxicity and LM scores."""

import collections
import hashlib
import io
import json
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandlake.llm import chat, classlm, gbdt, packing, quality, registry, textkit, tokens, tokenstore, toxicity
from strandlake.session import shared_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [(None, "null id"), (1, None), (2, ""), (3, "a"), (3, "a"), (4, "x" * 70000), (5, "word " * 9000), (6, "é漢 \n\n\t ." * 50), (7, "   \n ")]


def odd(spark):
    return spark.createDataFrame([(i, t, None, "s", 0, 9) for i, t in ODD], "doc_id long, text string, lang string, train string, row long, label long")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_vocabulary())
    t.encode_special_tokens = True
    return lambda x: [*t.encode(x or "", add_special_tokens=False).ids, 0]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=40), st.text("ab'sl 1.\n\té«　\x85\x1c<|", max_size=40)), max_size=4))
def test_ids_are_the_librarys(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_vocabulary())
    t.encode_special_tokens = True
    ids, off = tokens.encoder(tokens.default_vocabulary()).encode(*textkit.flat(pa.array(texts, pa.string())))
    for i, x in enumerate(texts):
        assert ids[off[i] : off[i + 1]].tolist() == [*t.encode(x or "", add_special_tokens=False).ids, 0]


def check_pieces(rows, docs, library, limit=1024):
    left = collections.Counter((i, zlib.crc32(np.array(library(t), "<u4").tobytes())) for i, t in docs)
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_seq[r.sequence_id].append(r)
        by_doc[r.doc_id].append(r)
    for s in by_seq.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= limit and len(s) <= packing.MAX_SEGMENTS
    want = collections.defaultdict(list)
    for i, t in docs:
        want[i].append(library(t))
    for i, texts in want.items():
        if len(texts) > 1:
            assert sum(r.length for r in by_doc[i]) == sum(map(len, texts))
            continue
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(texts[0])
            assert r.ids_crc32 == zlib.crc32(np.array(texts[0][at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(texts[0])
    assert sum(left.values()) == len(docs)
    return sum(len(x) for v in want.values() for x in v) / (limit * len(by_seq))


def test_packing(spark, sf_dir, library):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert check_pieces(registry.QUERIES["op2_packing"](spark, sf_dir).collect(), docs, library) > 0.97
    check_pieces(packing.pack_documents(odd(spark)).collect(), ODD, library)
    assert packing.pack_documents(odd(spark).limit(0)).count() == 0
    r = packing.pack_documents(odd(spark)).first()
    assert len(r.ids) == r.length


def test_vector_packing_holds_all_limits(spark):
    r = random.Random(4)
    sizes = np.array([(r.randint(1, 1000), r.randint(1, 5), r.randint(0, 500)) for _ in range(3000)])
    limits = np.array([1024, 8, 600])
    bins = packing.pack_vectors(sizes, limits)
    for d in range(3):
        assert np.bincount(bins, sizes[:, d]).max() <= limits[d]
    assert (bins.max() + 1) <= 1.25 * max(sizes.sum(0) / limits)
    with pytest.raises(ValueError):
        packing.pack_vectors(np.array([[2000, 1, 1]]), limits)
    assert len(packing.pack_vectors(np.zeros((0, 3), int), limits)) == 0
    df = spark.createDataFrame([(i, int(a), int(b), int(c)) for i, (a, b, c) in enumerate(sizes[:500])], "k long, t long, s long, l long")
    got = packing.pack_examples(df, "k", "t", "s", "l", 1024, 8, 600, window=100).join(df, "k")
    assert got.count() == 500
    assert got.groupBy("sequence_id").agg(F.sum("t").alias("t"), F.sum("s").alias("s"), F.sum("l").alias("l")).where("t > 1024 or s > 8 or l > 600").count() == 0


def test_token_store(spark, sf_dir, library):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    got = sorted(tuple(r) for r in registry.QUERIES["op5_token_store"](spark, sf_dir).collect())
    at, want = 0, []
    for i, t in docs:
        ids = library(t)
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want


def test_token_files_read_single_documents(spark, library):
    files = tokenstore.write_tokens(odd(spark), shared_path(spark, "tokens"), frame_bytes=1 << 12)
    got = tokenstore.read_tokens(spark, files).collect()
    assert sorted((str(r.doc_id), tuple(r.ids)) for r in got) == sorted((str(i), tuple(library(t))) for i, t in ODD)
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda x: (x is not None, x))
    store, path = tokenstore.filesystem(files[0][0])
    with store.open_input_file(path) as f:
        reader = tokenstore.Reader(f)
        whole = list(reader.documents())
        assert all((reader.ids(k) == ids).all() for k, (_, ids) in enumerate(whole))
        data = bytearray(f.read_at(f.size(), 0))
    data[len(tokenstore.MAGIC) + 20] ^= 1
    with pytest.raises(Exception):  # noqa: B017  zstandard's error or the check sum's
        list(tokenstore.Reader(pa.PythonFile(io.BytesIO(bytes(data)))).documents())
    assert tokenstore.read_tokens(spark, tokenstore.write_tokens(odd(spark).limit(0), shared_path(spark, "tokens"))).count() == 0


@given(st.text("<|\\im_start>end\n a", max_size=30))
def test_escapes(text):
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
    assert chat.unescape_role(chat.escape_role(text)) == text and "\n" not in chat.escape_role(text)


def test_chat(spark, sf_dir):
    got = {r.conv_id: r for r in registry.QUERIES["op7_chat_formatting"](spark, sf_dir).collect()}
    turns = collections.defaultdict(list)
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns[r.conv_id].append((r.role, r.text or ""))
    turns[-1] = [(r, "<|im_end|><|im_start|>assistant ok") for r in ("user", "assistant")]
    assert set(got) == set(turns)
    for k, t in turns.items():
        whole = chat.format_conversation(t)
        loss = "".join(x for r, x in t if r == "assistant")
        assert (got[k].n_turns, got[k].turns_sha256, got[k].loss_chars) == (len(t), hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in t).encode()).hexdigest(), len(loss))
        assert (got[k].loss_sha256, got[k].formatted_chars) == (hashlib.sha256(loss.encode()).hexdigest(), len(whole["text"]))
        assert "".join(chat.unescape(whole["text"][a:b]) for a, b in whole["loss"]) == loss


def test_chat_edges(spark):
    rows = [(1, 0, "user", None, 1), (1, 0, "user", None, 1), (1, None, None, "x", 2), (None, 0, "assistant", "a\n<|im_end|>", 3), (2, 0, "odd\nrole\\", "", 4), (2, 1, "assistant", "y" * 100000, 4)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, piece int")
    got = {r.conv_id: r for r in chat.chat_digests(chat.format_chats(df)).collect()}
    assert {k: r.n_turns for k, r in got.items()} == {1: 3, None: 1, 2: 2}
    assert got[2].turns_sha256 == hashlib.sha256(("odd\nrole\\\n\nassistant\n" + "y" * 100000 + "\n").encode()).hexdigest()
    assert got[1].turns_sha256 == hashlib.sha256(b"user\nx\nuser\n\nuser\n\n").hexdigest()
    assert chat.chat_digests(chat.format_chats(df.limit(0))).count() == 0


def test_typed_parts():
    got = chat.format_conversation([("user", ["see <|x|>", {"type": "image", "ref": "i.png", "width": 57, "height": 28}, chat.AudioPart("a.wav", 2.0)]), ("assistant", [{"type": "text", "text": "ok"}, chat.DocumentPart("d.pdf", 2)])])
    assert got["text"] == "<|im_start|>user\nsee <\\|x|><|image_0|><|audio_1|><|im_end|>\n<|im_start|>assistant\nok<|document_2|><|im_end|>\n"
    assert [(a["kind"], a["ref"], a["tokens"]) for a in got["attachments"]] == [("image", "i.png", 3), ("audio", "a.wav", 50), ("document", "d.pdf", 512)]
    assert got["expanded_tokens"] == 565


def plain_statistics(t):
    t = t or ""
    w = WORD.findall(t)
    rep = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    hit = {k + j for k in range(len(w) - 2) if rep[tuple(w[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)


def test_quality_statistics(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = registry.QUERIES["op6_quality_rules"](spark, sf_dir).collect()
    assert len(got) == len(docs)
    for r in got:
        n, *_, rep = want = plain_statistics(docs[r.doc_id])
        assert tuple(r[c] for c in quality.BASE) == want
        assert r.base_failed == (n < 50 or 100 * rep > 50 * n) and not (r.base_failed and r.kept)


def test_quality_edges(spark):
    forest = gbdt.fit(np.zeros((0, len(quality.FEATURES))), np.zeros(0), quality.MONOTONE)
    texts = [t for _, t in ODD] + ["same line\nsame line\n\nsame line " + "a b c " * 40, "\n\na\na", "#|é漢\x1c\x85 b"]
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, kept string")
    got = {r.doc_id: r for r in quality.quality_verdicts(df, forest).collect()}
    for i, t in enumerate(texts):
        assert tuple(got[i][c] for c in quality.BASE) == plain_statistics(t)
    kept = quality.keep_good(df, forest)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}
    assert quality.quality_verdicts(df.limit(0), forest).count() == 0
    empty = quality.train(df.select("doc_id", "text"), spark.createDataFrame([], "doc_id long, quality int"))
    assert not len(empty.roots)


def test_trees_learn_and_stay_monotonic():
    r = np.random.default_rng(0)
    x = r.random((2000, 3))
    y = ((x[:, 0] + 0.3 * r.random(2000) < 0.6) & (x[:, 1] > 0.2)).astype(float)
    f = gbdt.fit(x, y, {0: -1, 1: 1})
    assert ((f.probability(x) > 0.5) == y).mean() > 0.9
    grid = np.repeat(r.random((50, 3)), 20, 0)
    for j, sign in ((0, -1), (1, 1)):
        g = grid.copy()
        g[:, j] = np.tile(np.linspace(0, 1, 20), 50)
        assert (sign * np.diff(f.margin(g).reshape(50, 20), axis=1) >= -1e-12).all()


def test_quality_on_held_out_labels(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    forest = quality.train(docs, labels.where(~held))
    got = quality.quality_verdicts(docs, forest).join(labels.where(held), "doc_id").where("not base_failed").select("kept", "quality").toPandas()
    assert (got.kept == (got.quality == 1)).mean() > 0.98


def test_toxicity_scores_against_loops():
    r = np.random.default_rng(1)
    texts = [b"", b"one", b"Two words", b"a b c d e f g a b", b"x " * 30 + "\u00e9t\u00e9 end".encode()]
    shape = (len(toxicity.WIDTHS) * toxicity.FILTERS,)
    m = toxicity.Model(r.normal(size=(toxicity.WORD_BUCKETS, toxicity.DIM)), r.normal(size=(toxicity.STEM_BUCKETS, toxicity.DIM)), [r.normal(size=(w, toxicity.DIM, toxicity.FILTERS)) for w in toxicity.WIDTHS], r.normal(size=shape), r.normal(size=shape), 0.3)
    buf, off = textkit.flat(pa.array([t.decode() for t in texts]))
    w, s, woff = toxicity.buckets(buf, off)
    want = []
    for i, j in zip(woff[:-1], woff[1:], strict=True):
        e = [m.words[w[k]] + m.stems[s[k]] for k in range(i, j)]
        logit = m.offset
        for k, width in enumerate(toxicity.WIDTHS):
            for f in range(toxicity.FILTERS):
                at = k * toxicity.FILTERS + f
                sums = [sum(float(e[x + t] @ m.filters[k][t, :, f]) for t in range(width) if x + t < len(e)) + m.bias[at] for x in range(len(e))]
                logit += m.weight[at] * max([0.0, *sums])
        want.append(1 / (1 + np.exp(-logit)))
    assert np.allclose(toxicity.score(m, m.tables(), buf, off), want, atol=1e-4)
    parts = [(w[i:j], s[i:j]) for i, j in zip(woff[:-1], woff[1:], strict=True)]
    assert np.allclose(toxicity.probabilities(m, parts), want, atol=1e-4)


def test_toxicity_thresholds_come_from_rows_not_fitted(spark, monkeypatch):
    sizes, fit = [], toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda texts, y: sizes.append(len(y)) or fit(texts, y, epochs=1))
    docs = spark.createDataFrame([(i, f"word{i % 7} " + ("vile filth" if i % 3 == 0 else "kind words"), "en") for i in range(300)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert sizes[1] == sizes[0] - -(-sizes[0] // toxicity.CALIBRATION) and set(model.thresholds) == {"en"}


def test_toxicity_on_held_out_labels(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    got = toxicity.toxicity_scores(docs, model).join(labels, "doc_id").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).select("score", "predicted", "toxic").toPandas()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.5)).all()
    hits = ((got.predicted == 1) & (got.toxic == 1)).sum()
    assert hits / (got.toxic == 1).sum() > 0.85 and hits / max(1, (got.predicted == 1).sum()) > 0.85
    edges = {r.doc_id: r.score for r in toxicity.toxicity_scores(odd(spark), model).collect()}
    assert all(0 <= s <= 1 for s in edges.values()) and edges[1] == edges[2] == edges[7]
    assert toxicity.toxicity_scores(odd(spark).limit(0), model).count() == 0
    bare = toxicity.train(odd(spark), spark.createDataFrame([], "doc_id long, toxic int"))
    assert all(r.score == 0 for r in toxicity.toxicity_scores(odd(spark), bare).collect())


def test_toxicity_learns_from_every_labelled_row(spark):
    """Only the training rows with the largest hashes of their ids, beyond the first 8,000, are toxic."""
    in_fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0
    ids = [r.doc_id for r in spark.range(10500).toDF("doc_id").where(in_fold).orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    assert len(ids) > 8200
    toxic = set(ids[8000:])
    docs = spark.createDataFrame([(i, f"vile filth{i % 7}" if i in toxic else f"kind word{i % 7}", "en") for i in ids], "doc_id long, text string, lang string")
    model = toxicity.train(docs, spark.createDataFrame([(i, int(i in toxic)) for i in ids], "doc_id long, toxic int"))
    new = spark.createDataFrame([(1, "vile filth3", "en"), (2, "kind word3", "en")], "doc_id long, text string, lang string")
    assert {r.doc_id: (r.predicted, r.flagged) for r in toxicity.toxicity_scores(new, model).collect()} == {1: (1, True), 2: (0, False)}


@pytest.mark.parametrize("broadcast", [0, 1_000_000])
def test_toxicity_blocks_hold_all_rows_and_are_averaged(spark, monkeypatch, broadcast):
    monkeypatch.setattr(toxicity, "BROADCAST_LABELS", broadcast)
    monkeypatch.setattr(toxicity, "BLOCK_ROWS", 64)  # shards of about so many rows
    rows = [(i, f"word{i % 7} " + ("vile filth" if i % 3 == 0 else "kind words") * (i % 4), "en" if i % 2 else None) for i in range(300)]
    rows += [(None, "no id", "en"), (7, "again", "en"), (8, None, "en"), (9, "", "en"), (1000, "no label", "en")]
    marks = [*((i, int(i % 3 == 0)) for i in range(300)), (7, 1), (11, None), (None, 1), (2000, 1)]
    blocks = toxicity.training_rows(spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(marks, "doc_id long, toxic int"))
    table = blocks.toArrow()
    assert len(table) > 2
    got = list(toxicity._unpacked(table.to_batches(), None, True))
    learned = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 != 0
    pairs = [(t, y, lang) for i, t, lang in rows if learned(i) for j, y in marks if i == j and y is not None]
    coded = lambda t: tuple(a.tobytes() for a in toxicity.buckets(*textkit.flat(pa.array([t], pa.string())))[:2])
    want = collections.Counter((*(np.frombuffer(a, np.int32).astype("<u2").tobytes() for a in coded(t)), y, lang) for t, y, lang in pairs)
    assert collections.Counter((w.tobytes(), s.tobytes(), int(y), lang) for texts, ys, langs, _ in got for (w, s), y, lang in zip(texts, ys, langs, strict=True)) == want
    folds = [list(toxicity._unpacked(table.to_batches(), f, False)) for f in range(toxicity.CALIBRATION)]
    assert sum(len(y) for f in folds for _, y, _, _ in f) == len(pairs)

    model, past = toxicity._start(3)
    after, memory = toxicity._averaged(toxicity.Rows(blocks, len(table)), model, past, 0, 2, 8, 0.05, 3)
    ends = []
    for texts, y, _, number in got:
        m, p = toxicity._copy(model, past)
        r = np.random.default_rng([3, 0, number])
        ends.append((m, p, len(y), [sum(c) for c in zip(*(toxicity._descend(m, p, texts, y, r, 8, 0.05) for _ in range(2)), strict=True)]))
    n = sum(e[2] for e in ends)
    assert np.allclose(after.weight, sum(e[0].weight * e[2] for e in ends) / n)
    assert np.allclose(after.filters[2], sum(e[0].filters[2] * e[2] for e in ends) / n, atol=1e-5)
    assert np.isclose(memory["o"], sum(e[1]["o"] * e[2] for e in ends) / n)
    for k, name, own in ((0, "words", "e"), (1, "stems", "s")):
        times = sum(e[3][k] for e in ends)
        moved = times > 0
        assert 0 < moved.sum() < 40 and (getattr(after, name)[~moved] == getattr(model, name)[~moved]).all()
        mean = sum(e[3][k][moved, None] * getattr(e[0], name)[moved] for e in ends) / times[moved, None]
        assert np.allclose(getattr(after, name)[moved], mean, atol=1e-5)
        assert np.allclose(memory[own][moved], sum(e[3][k][moved] * e[1][own][moved] for e in ends) / times[moved], atol=1e-5)
    textkit.discard(blocks)


def test_toxicity_thresholds_against_loops(spark):
    r = random.Random(5)
    rows = [(lang, r.choice([0.0, 0.1, 0.25, 0.25, 0.5, 0.9, 1.0, r.random()]), int(r.random() < 0.4)) for lang in ("", "en", "fr") for _ in range(120)]
    rows += [("rare", 0.7, 1)] * 9 + [("one", 0.3, 1)] * 10
    got = toxicity._thresholds(spark.createDataFrame(rows, "lang string, p double, label long"))
    assert set(got) == {"", "en", "fr", "one"} and got["one"] == 0.3
    for lang, cut in got.items():
        own = [(p, y) for at, p, y in rows if at == lang]
        f1 = lambda c: 2 * sum(y for p, y in own if p >= c) / (sum(p >= c for p, _ in own) + sum(y for _, y in own))  # noqa: B023, E731
        assert math.isclose(f1(cut), max(f1(p) for p, _ in own))


def lm_base(docs):
    split = lambda t: [*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]
    train = lambda i: i is None or zlib.crc32(str(i).encode()) % 5 != 1
    c = collections.Counter(w for i, t in docs if train(i) for w in split(t))
    n, d = sum(c.values()), math.log10(sum(c.values()) + 0.5 * (len(c) + 1))
    return [(i, len(split(t)), sum(c[w] > 0 for w in split(t)), n, sum(math.log10(c[w] + 0.5) - d for w in split(t))) for i, t in docs]


def test_lm_scores(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = {r.doc_id: r for r in registry.QUERIES["op8_lm_scoring"](spark, sf_dir).collect()}
    for i, n, known, total, base in lm_base(docs):
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_lm_edges(spark):
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in classlm.lm_scores(odd(spark), frequent=3, classes=4).collect()), key=str)
    assert got == sorted(((a, b, c, d, round(e, 6)) for a, b, c, d, e in lm_base(ODD)), key=str)
    assert classlm.lm_scores(odd(spark).limit(0)).count() == 0


def test_rare_words_with_one_ending_are_told_apart(spark):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 1][:2]
    learn = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 != 1][:60]
    pairs = ["red green blue red green blue red xaing blue", "cat bird dog cat bird dog cat yoing dog"]
    docs = [(i, pairs[k % 2]) for k, i in enumerate(learn)] + [(held[0], "red xaing blue"), (held[1], "red yoing blue")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in classlm.lm_scores(df, frequent=6, classes=8).collect()}
    assert got[held[0]].base_score == pytest.approx(got[held[1]].base_score)
    assert got[held[0]].score > got[held[1]].score + 0.5


def test_classes_of_all_words_against_brute_force(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    marked = classlm._marked(df.repartition(5).localCheckpoint(), 5, 1)
    model = classlm.start(marked, 50, 8)
    dealt = textkit.written(classlm.deal(marked, model, 3), "pieces")
    got = {}
    for r in classlm.class_texts(dealt, classlm.word_classes(dealt, model, 3), model).collect():
        at = np.frombuffer(r.toff, "<i8")
        got |= {i: np.frombuffer(r.cls, np.uint8)[a:b].tolist() for i, a, b in zip(r.docs, at[:-1], at[1:], strict=True)}
    texts, counts = {}, collections.defaultdict(lambda: np.zeros((2, 8)))
    end = model.cls[model.units.of(np.array([classlm.END]), np.zeros(1, np.int64))[0]]
    for i, t in df.collect():
        h, tail, _ = classlm.token_hashes(*textkit.flat(pa.array([t], pa.string())))
        texts[i] = h, c = h, [int(x) for x in model.cls[model.units.of(h, tail)]]
        if i is None or zlib.crc32(str(i).encode()) % 5 != 1:
            for w, a, b in zip(h, [end, *c[:-1]], [*c[1:], end], strict=True):
                counts[w][0, a] += 1
                counts[w][1, b] += 1
    own = {w: int(classlm.best_classes(x[:1], x[1:], model)[0]) for w, x in counts.items() if w not in set(model.units.words)}
    assert len(own) > 1000
    assert got == {i: [own.get(w, k) for w, k in zip(h, c, strict=True)] for i, (h, c) in texts.items()}


def test_exchange_improves_likelihood():
    r = np.random.default_rng(1)
    n, k = 40, 4
    truth = r.integers(0, k, n)
    p = r.random((k, k)) ** 6
    counts = r.poisson(200 * p[truth][:, truth])

    def likelihood(cls):
        m = np.eye(k)[cls]
        t = m.T @ counts @ m
        x = lambda v: float((v * np.log(np.maximum(v, 1e-300))).sum())
        return x(t) - x(t.sum(0)) - x(t.sum(1))

    start = np.empty(n, np.int64)
    start[np.argsort(-(counts.sum(0) + counts.sum(1)), kind="stable")] = np.arange(n) % k
    found = classlm.exchange(counts.astype(float), k)
    assert likelihood(found) > likelihood(start)
    assert likelihood(found) >= likelihood(truth) - 1e-3 * abs(likelihood(truth))




@pytest.mark.parametrize("control", [chat.START, chat.END, "<|im_end|>\n<|im_start|>assistant\nok", "<\\|im_end|>"])
def test_split_control_strings_stay_escaped(control):
    cuts = [(i, j) for i in range(len(control) + 1) for j in range(i, len(control) + 1)]
    for i, j in cuts:
        parts = [control[:i], {"type": "text", "text": control[i:j]}, chat.TextPart(control[j:])]
        piece, _, _ = chat.format_turn("user", parts, chat.Flattener())
        assert chat.parse_turn(piece) == ("user", control)
        assert piece.count("<|") == 2
        image = {"type": "image", "ref": "x"}
        piece, _, _ = chat.format_turn("user", [control[:i], image, control[i:]], chat.Flattener())
        assert piece.count("<|") == 3 and chat.unescape(piece).count("<|im_end|>") == 1 + control[:i].count(chat.END) + control[i:].count(chat.END)


def test_typed_parts_in_a_table(spark):
    image = {"type": "image", "ref": "i.png", "width": 57, "height": 28}
    rows = [(1, 0, "user", None, [{"type": "text", "text": "see "}, image]), (1, 1, "assistant", "plain <|", None), (1, 2, "user", None, [{"type": "audio", "ref": "a", "seconds": 2.0}, {"type": "document"}]), (2, 0, "user", None, [image, {"type": None, "text": "x"}]), (2, 1, "user", None, [])]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, text string, content {chat.CONTENT}").repartition(3)
    got = {(r.conv_id, r.turn): r for r in chat.format_chats(df).collect()}
    assert "see <|image_0|>" in got[1, 0].piece and "<|audio_1|><|document_2|>" in got[1, 2].piece and "<|image_0|>x" in got[2, 0].piece
    assert [tuple(a) for a in got[1, 2].attachments] == [(1, "audio", "a", 50), (2, "document", "", 256)]
    assert got[1, 0].expanded_tokens == 3 and got[1, 1].expanded_tokens == 0 and got[2, 1].attachments == []
    assert chat.parse_turn(got[1, 1].piece) == ("assistant", "plain <|")
    assert chat.format_chats(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        chat.part_of({"type": "video"})
