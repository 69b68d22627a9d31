"""Suffix arrays and transforms: fixed strings, random bytes, and invariants."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandlake.operators import suffix as S

GOLDEN = {
    b"banana": ([5, 3, 1, 0, 4, 2], [3, 2, 5, 1, 4, 0], b"annbaa", 4),
    b"mississippi": ([10, 7, 4, 1, 0, 9, 8, 6, 3, 5, 2], [4, 3, 10, 8, 2, 9, 7, 1, 6, 5, 0], b"ipssmpissii", 5),
    b"abracadabra": ([10, 7, 0, 3, 5, 8, 1, 4, 6, 9, 2], [2, 6, 10, 3, 7, 4, 8, 1, 5, 9, 0], b"ardrcaaaabb", 3),
    b"aaaaaa": ([5, 4, 3, 2, 1, 0], [5, 4, 3, 2, 1, 0], b"aaaaaa", 6),
    b"abababab": ([6, 4, 2, 0, 7, 5, 3, 1], [3, 7, 2, 6, 1, 5, 0, 4], b"bbbbaaaa", 4),
    b"\0\0\0": ([2, 1, 0], [2, 1, 0], b"\0\0\0", 3),
    bytes.fromhex("61006100"): ([3, 1, 2, 0], [3, 1, 2, 0], bytes.fromhex("00616100"), 4),
    bytes.fromhex("FF00807F"): ([1, 3, 2, 0], [3, 0, 2, 1], bytes.fromhex("7FFF8000"), 4),
    b"a": ([0], [0], b"a", 1),
    bytes.fromhex("C3A9C3A9"): ([3, 1, 2, 0], [3, 1, 2, 0], bytes.fromhex("A9C3C3A9"), 4),
}


def naive(t: bytes) -> list[int]:
    return sorted(range(len(t)), key=lambda p: t[p:])


def inverted(bwt: bytes, primary: int) -> bytes:
    full = bwt[:primary] + b"\0" + bwt[primary:]
    key = [(-1 if i == primary else c) for i, c in enumerate(full)]
    nxt = sorted(range(len(full)), key=lambda i: key[i])
    out, at = [], nxt[nxt[0]]
    for _ in range(len(bwt)):
        out.append(at)
        at = nxt[at]
    return bytes(full[i] for i in out)


def words(n: int) -> list[bytes]:
    a, b = b"a", b"ab"
    while len(b) < n:
        a, b = b, b + a
    thue = b"a"
    while len(thue) < n:
        thue += bytes(195 - c for c in thue)
    return [b[:n], thue[:n], b"a" * n, (b"ab" * n)[:n], b"x" + b"\0" * n, bytes(range(256))]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(11)
    found = [*GOLDEN, b"", None, *words(70)]
    found += [bytes(r.choice(alphabet) for _ in range(n)) for n in range(0, 40, 3) for alphabet in (b"a", b"ab", b"\0\xff", bytes(range(256)))]
    return list(enumerate([*found, b"banana", b"nana"]))


@pytest.mark.parametrize("strategy", ["local", "definition", "doubling", "dc3"])
def test_strategies_agree_with_naive_sort(spark, texts, strategy):
    df = spark.createDataFrame(texts, "doc_id long, text binary")
    got = sorted(tuple(r) for r in S.suffix_array(df, strategy=strategy).collect())
    assert got == sorted((i, k, p) for i, t in texts if t for k, p in enumerate(naive(t)))


def test_golden(spark):
    df = spark.createDataFrame(list(enumerate(GOLDEN)), "doc_id long, text binary")
    sa = {}
    for r in S.sa_isa(df).collect():
        sa.setdefault(r.doc_id, {})[r.i] = (r.sa, r.isa)
    b = {r.doc_id: r for r in S.bwt(df).collect()}
    b2 = {r.doc_id: r for r in S.bwt(df, strategy="definition").collect()}
    for i, (_, (s, inv, l, primary)) in enumerate(GOLDEN.items()):
        assert [sa[i][k] for k in range(len(s))] == list(zip(s, inv, strict=True))
        assert (bytes(b[i].bwt), b[i].primary_index) == (l, primary) == (bytes(b2[i].bwt), b2[i].primary_index)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.binary(max_size=50), st.text("ab", max_size=60).map(str.encode)), max_size=6))
def test_local_kernel(texts):
    data = np.frombuffer(b"".join(texts), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    sa = S.sort_suffixes(data, off)
    for t, i, j in zip(texts, off[:-1], off[1:], strict=True):
        assert (sa[i:j] - i).tolist() == naive(t)


def test_bwt_is_a_permutation_and_inverts(spark, texts):
    df = spark.createDataFrame(texts, "doc_id long, text binary")
    by = dict(texts)
    for r in S.bwt(df).collect():
        assert sorted(bytes(r.bwt)) == sorted(by[r.doc_id])
        assert inverted(bytes(r.bwt), r.primary_index) == by[r.doc_id]


def test_auxiliary_indexes(spark):
    df = spark.createDataFrame([(1, "mississippi")], "doc_id long, text string")
    aux = sorted((r.j, r.idx) for r in S.bwt_aux(df, 4)[1].collect())
    assert aux == [(0, 5), (1, 3), (2, 7)]
    for r in (0, 1, 3, 6):
        with pytest.raises(ValueError):
            S.bwt_aux(df, r)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert S.suffix_array(df).count() == 0 and S.suffix_array(df, strategy="doubling").count() == 0 and S.bwt(df).count() == 0


def test_files_udtf_stream(spark, tmp_path):
    from strandlake import sources
    from strandlake.functions import udtf
    from strandlake.streaming import write_index

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.bin").write_bytes(b"banana\0\xff")
    (tmp_path / "in" / "b.bin").write_bytes(b"")
    files = sources.read_files(spark, f"file://{tmp_path}/in", 6)
    assert sorted(bytes(r.text) for r in files.collect()) == [b"banana"]
    df = spark.createDataFrame([(1, "banana"), (2, "abab")], "doc_id long, text string")
    sa = S.suffix_array(df)
    sources.write_binary(sa, f"file://{tmp_path}/sa", width=8)
    assert sorted(map(tuple, sources.read_binary(spark, f"file://{tmp_path}/sa", width=8).collect())) == sorted(map(tuple, sa.collect()))
    sources.write_text(sa.where("doc_id = 1"), f"file://{tmp_path}/txt")
    assert [r.value for r in spark.read.text(f"file://{tmp_path}/txt").collect()] == ["5", "3", "1", "0", "4", "2"]
    udtf.register(spark)
    df.createOrReplaceTempView("udtf_texts")
    assert sorted(map(tuple, spark.sql("select doc_id, s.* from udtf_texts, lateral suffix_array(text) s").collect())) == sorted(map(tuple, sa.collect()))
    assert spark.sql("select b.* from udtf_texts, lateral bwt(text) b where doc_id = 1").collect()[0].primary_index == 4
    df.write.parquet(f"file://{tmp_path}/stream")
    q = write_index(spark.readStream.schema(df.schema).parquet(f"file://{tmp_path}/stream"), f"file://{tmp_path}/index", f"file://{tmp_path}/offsets")
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.read.parquet(f"file://{tmp_path}/index").collect())) == sorted(map(tuple, sa.collect()))


def test_metrics(spark, tmp_path):
    from strandlake.metrics import Recorder

    r = Recorder()
    with r.stage("sort", 1) as note:
        note["rows"] = 3
    with r.stage("sort", 2):
        pass
    assert r.sums(spark).collect()[0].iterations == 2
    r.write_csv(spark, f"file://{tmp_path}/m")
    r.write_json(spark, f"file://{tmp_path}/j")
    assert spark.read.json(f"file://{tmp_path}/j").count() == 2


def long_texts():
    import random

    r, a, b = random.Random(11), b"a", b"ab"
    while len(b) < 60_000:
        a, b = b, b + a
    word = [bytes(r.choices(b"abcdefgh", k=r.randint(2, 9))) for _ in range(500)]
    return {"periodic": b"abc" * 20_000, "fibonacci": b, "words": b" ".join(r.choices(word, k=15_000)), "one_letter": b"z" * 30_000, "bytes": bytes(r.choices(range(256), k=60_000))}


@pytest.mark.parametrize("name", sorted(long_texts()))
def test_long_texts_are_in_order(name):
    text = long_texts()[name]
    sa = S.sort_suffixes(np.frombuffer(text, np.uint8), np.array([0, len(text)])).tolist()
    assert sorted(sa) == list(range(len(text)))
    assert all(text[i:] < text[j:] for i, j in zip(sa, sa[1:]))


@pytest.mark.parametrize("strategy", ["doubling", "dc3"])
def test_long_texts_by_all_strategies(spark, strategy):
    rows = [(i, t[:8000]) for i, t in enumerate(long_texts().values())]
    df = spark.createDataFrame(rows, "doc_id long, text binary")
    got = {(r.doc_id, r["rank"]): r.pos for r in S.suffix_array(df, strategy=strategy).collect()}
    want = {(r.doc_id, r["rank"]): r.pos for r in S.suffix_array(df).collect()}
    assert got == want


@pytest.mark.parametrize("few", [0, S.FEW])
def test_joined_rows_are_one_text(spark, monkeypatch, few):
    """Keys over many rows and blocks; looked up by shuffled and by broadcast joins."""
    from strandlake.metrics import Recorder

    monkeypatch.setattr(S, "FEW", few)
    r = random.Random(3)
    texts = [r.choice(["", None, "ab", "abab", "b" * 40, "abcabc" * 20, "\u00e9a"]) for _ in range(60)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "n long, t string, key string")
    whole = b"".join((t or "").encode() + b"\n" for t in texts)
    rows = {(x.pos, bytes(x.key)) for x in S.joined_suffixes(df, ["n"], "t", block=32).collect()}
    assert rows == {(p, whole[p : p + S.K]) for p in range(len(whole))}
    note = Recorder()
    got = [x.pos for x in S.joined_suffix_array(df, ["n"], "t", recorder=note).orderBy("rank").collect()]
    assert got == naive(whole)
    ties = [n for stage, _, _, n in note.found if stage == "segments"]
    assert ties[0] > 0 and ties[-1] == 0 and all(n is not None for *_, n in note.found)
    assert S.joined_suffix_array(df.limit(0), ["n"], "t").count() == 0


@pytest.mark.parametrize("strategy", ["doubling", "dc3"])
def test_ranks_by_broadcast_and_shuffle_agree(spark, texts, monkeypatch, strategy):
    monkeypatch.setattr(S, "FEW", 0)
    df = spark.createDataFrame(texts, "doc_id long, text binary")
    want = {(i, k, p) for i, t in texts if t for k, p in enumerate(naive(t))}
    assert {tuple(r) for r in S.suffix_array(df, strategy=strategy).collect()} == want


@pytest.mark.parametrize("name", ["sa_isa_part_names", "bwt_rows_part_names", "bwt_isa_part_names"])
def test_no_table_of_bytes_is_broadcast(spark, sf_dir, name):
    """Spark takes what comes from Python or explode for as small as the table read, so it would send out a side of any size."""
    from strandlake import registry

    assert "BroadcastExchange" not in registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("f", [S.sa_isa, S.bwt_rows])
def test_rows_of_one_pass_are_those_of_joins(spark, texts, f):
    df = spark.createDataFrame(texts, "doc_id long, text binary")
    assert sorted(map(tuple, f(df).collect())) == sorted(map(tuple, f(df, strategy="definition").collect()))


@pytest.mark.parametrize("strategy", ["doubling", "dc3"])
def test_texts_are_dealt_out_before_they_become_a_row_a_byte(spark, texts, monkeypatch, strategy):
    monkeypatch.setattr(S, "BLOCK", 8)
    monkeypatch.setattr(S, "SPREAD", 128)
    df = spark.createDataFrame(texts, "doc_id long, text binary").coalesce(1)
    total = sum(len(t or b"") for _, t in texts)
    rows = S.suffixes(df, "doc_id", "text")
    assert rows.rdd.getNumPartitions() == -(-total // 128) > 9
    assert {(r.doc_id, r.pos, bytes(r.key)) for r in rows.collect()} == {(i, p, t[p : p + S.K]) for i, t in texts if t for p in range(len(t))}
    want = {(i, k, p) for i, t in texts if t for k, p in enumerate(naive(t))}
    assert {tuple(r) for r in S.suffix_array(df, strategy=strategy).collect()} == want


def test_ranks_go_back_by_merge(spark, texts):
    df = spark.createDataFrame(texts, "doc_id long, text binary")
    ranks = S.initial_ranks(S.suffixes(df, "doc_id", "text"), "doc_id")
    assert "SortMergeJoin" in ranks._jdf.queryExecution().executedPlan().toString()
