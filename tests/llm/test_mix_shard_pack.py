import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from drawlens.llm import queries as Q
from drawlens.llm.mix import mix
from drawlens.llm.pack import Encoder, pack, unpack
from drawlens.llm.shard import communication_matrix, hypergeometric, shuffle_shards


def test_mix_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = con.sql(Q.ORACLES["op1_mix"])
    order = [want.columns.index(c) for c in ("doc_id", "size", "source_size", "target", "taken")]
    assert sorted(map(tuple, Q.op1_mix(spark, sf_dir).collect())) == sorted(tuple(r[i] for i in order) for r in want.fetchall())


@pytest.mark.parametrize("few", [3, 20_000])
def test_mix_meets_targets(documents, few):
    rows = mix(documents, few=few).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
        assert r.taken <= 2 * r.size and r.taken == r.repeats * r.size
    for group in by.values():
        assert abs(sum(r.taken for r in group) - group[0].target) <= max(r.size for r in group)
        assert group[0].target <= 2 * group[0].source_size
    total = sum(r.size for r in rows)
    assert np.isclose(sum(g[0].target for g in by.values()), 1.5 * total)
    again = {r.doc_id: r.taken for r in mix(documents.repartition(5)).collect()}
    assert again == {r.doc_id: r.taken for r in rows}


def test_water_filling_against_a_loop(spark):
    sizes = {"a": 100, "b": 1, "c": 1000, "d": 7, None: 50}
    docs = spark.createDataFrame([(i, "w " * n, s) for i, (s, n) in enumerate(sizes.items())], "doc_id long, text string, source string")
    got = {r.source: r.target for r in mix(docs).collect()}
    weight, goal, open_, want = dict(zip(sizes, (3, 1, 2, 3, 1), strict=True)), 1.5 * sum(sizes.values()), set(sizes), {}
    while open_:
        level = (goal - sum(want.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not over:
            want |= {s: level * weight[s] for s in open_}
            break
        want |= {s: 2.0 * sizes[s] for s in over}
        open_ -= over
    assert all(np.isclose(got[s], want[s]) for s in sizes)


def test_mix_edges(odd_docs, no_docs):
    rows = mix(odd_docs).collect()
    assert len(rows) == 11 and all(r.taken == 0 for r in rows if r.size == 0)
    assert mix(no_docs).count() == 0
    assert mix(odd_docs.where("text IS NULL")).agg({"taken": "sum"}).first()[0] == 0


def test_matrix_sums_and_law():
    m = communication_matrix([5, 0, 7], [4, 4, 4], 1)
    assert m.sum(axis=1).tolist() == [5, 0, 7] and m.sum(axis=0).tolist() == [4, 4, 4]
    draws = np.array([communication_matrix([6, 6], [6, 6], s)[0, 0] for s in range(4000)])
    assert abs(draws.mean() - 3) < 0.05 and abs(draws.var() - 6 * 0.25 * 6 / 11) < 0.06  # hypergeometric
    with pytest.raises(ValueError):
        communication_matrix([1], [2], 0)


def test_shards_are_whole(documents, odd_docs, no_docs):
    rows = shuffle_shards(documents.select("doc_id"), 7, per_range=4).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in documents.select("doc_id").collect())
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    out = shuffle_shards(odd_docs, 3)
    assert out.count() == 11 and set(out.columns) == {*odd_docs.columns, "slot"}
    assert shuffle_shards(no_docs, 3).count() == 0
    assert Counter(r.shard for r in shuffle_shards(odd_docs.limit(2), 5).collect()).total() == 2


def test_hypergeometric_laws():
    rng = np.random.default_rng(4)
    for good, bad, n in ((30, 50, 25), (70, 20, 60), (5, 400, 390), (3, 3, 3), (0, 9, 4), (9, 0, 4), (6, 7, 0), (6, 7, 13)):
        draws = hypergeometric(rng, *(np.full(40_000, x) for x in (good, bad, n)), large=0)
        law = {x: math.comb(good, x) * math.comb(bad, n - x) / math.comb(good + bad, n) for x in range(max(0, n - bad), min(good, n) + 1)}
        seen = Counter(draws.tolist())
        assert set(seen) <= set(law) and all(abs(seen[x] / 40_000 - q) < 5 * math.sqrt(q / 40_000) + 1e-4 for x, q in law.items()), (good, bad, n)
    good, bad, n = 4 * 10**12, 9 * 10**12, 10**10
    z = (hypergeometric(rng, *(np.full(20_000, x) for x in (good, bad, n))) - n * good / (good + bad)) / math.sqrt(n * good * bad * (good + bad - n) / (good + bad) ** 2 / (good + bad - 1))
    assert abs(z.mean()) < 0.03 and abs(z.std() - 1) < 0.03


def test_matrix_of_more_than_a_billion_rows():
    rows = [10**9 + i for i in range(7)] + [0, 5]
    total = sum(rows)
    shards = [total // 24 + (s < total % 24) for s in range(24)]
    m = communication_matrix(rows, shards, 1)
    assert m.sum(axis=1).tolist() == rows and m.sum(axis=0).tolist() == shards and (m >= 0).all()
    z = (m[:7] / (np.array(rows[:7])[:, None] / 24) - 1) * math.sqrt(10**9 / 24)
    assert np.abs(z).max() < 5


def test_pack_round_trip(documents, odd_docs, no_docs):
    encode = Encoder("byte_bpe_50k")
    for docs, length in ((documents, 2048), (odd_docs, 16)):
        texts = Counter()
        for r in docs.collect():
            texts[r.doc_id, tuple([*encode.tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1])] += 1
        pieces = sorted(pack(docs, length).collect(), key=lambda r: (r.sequence_id, r.offset))
        at, got, tokens = 0, Counter(), []
        for p in pieces:
            assert p.sequence_id * length + p.offset == at and p.length == len(p.ids) // 4 and p.offset + p.length <= length
            at += p.length
            assert p.start == len(tokens)
            tokens += np.frombuffer(p.ids, "<u4").tolist()
            if len(tokens) == p.doc_tokens:
                got[p.doc_id, tuple(tokens)] += 1
                tokens = []
        assert got == texts and not tokens
    assert pack(no_docs).count() == 0


def test_ids_are_those_of_the_untouched_tokenizer(documents):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    plain, encode = Tokenizer.from_file(P.path("byte_bpe_50k.json")), Encoder("byte_bpe_50k", kept=50, width=6)
    rng, some = random.Random(3), ["a", "Zq", " ", " ", "\n", "\t", "\x1c", "\x85", "\xa0", "\u2003", "'s", "12", "!", "\u00e9", "\u65e5\u672c", "\U0001f600", "<|endoftext|>"]
    texts = ["", "x" * 5000, " " * 900 + "a", "hello <|endoftext|> world", "a" * 399 + " b", "\n", " ", "a\nb c\n", "line one.\nLine two's end"]
    texts += ["".join(rng.choices(some[: rng.choice((4, 5, 17))], k=rng.randrange(1, 40))) for _ in range(3000)]
    texts += [r.text for r in documents.limit(40).collect() if r.text]
    for at in range(0, len(texts), 97):
        got = encode(texts[at : at + 97])
        assert [np.frombuffer(x, encode.kind).tolist() for x in got] == [plain.encode(t, add_special_tokens=False).ids for t in texts[at : at + 97]]
    assert unpack(b"\0" + np.array([70000], "<u4").tobytes()).tolist() == [70000] and unpack(np.array([5, 6], "<u2").tobytes()).tolist() == [5, 6]


def test_crc_of_pieces(spark, sf_dir, documents):
    got = {(r.doc_id, r.start): r.ids_crc32 for r in Q.op5_pack(spark, sf_dir).collect()}
    want = {(p.doc_id, p.start): zlib.crc32(bytes(p.ids)) for p in pack(documents).collect()}
    assert got == want


def test_mixing_stage_keeps_null_and_repeated_ids(spark):
    import corpus_pipeline as P

    rows = [(None if i % 3 == 0 else i, "two words" if i % 2 else "three more words", "en", f"s{i % 2}", 9) for i in range(60)]
    rows += [(7, None, "en", "s0", None), (7, "two words", "en", "s1", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    want = Counter({r: 0 for r in docs.collect()})
    for r in mix(docs, through=tuple(docs.columns)).collect():
        want[r.row] += r.repeats
    out = P.mixed(spark, docs, "")
    got = Counter(out.collect())
    assert out.columns == docs.columns and got == +want and any(r.doc_id is None for r in got)
    whole = {r.source: int(r.target // r.source_size) for r in mix(docs).collect()}
    assert got[rows[60]] == whole["s0"]  # a row without words takes no repeats from others with its id


def test_the_cut_falls_between_rows_of_one_id(spark):
    rows = [(None, f"{'w ' * 10}{i}", "a") for i in range(100)] + [(None, "same " * 10, "a")] * 100 + [(i, "x " * 10, "a") for i in range(100)] + [(i % 3, f"y{i} " * 5, "b") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    for few in (1, 20_000):
        out = mix(docs, seed=3, few=few).collect()
        assert len(out) == len(rows)
        for source in "ab":
            mine = [r for r in out if r.source == source]
            assert abs(sum(r.taken for r in mine) - mine[0].target) <= 10 and all(r.taken <= 2 * r["size"] for r in mine)
    duck = duckdb.connect()
    documents = pa.Table.from_pylist([{"doc_id": i, "text": t, "source": s} for i, t, s in rows])
    duck.register("documents", documents)
    key = lambda r: tuple(str(x) for x in r)
    want = sorted(map(key, duck.sql("SELECT doc_id, size, source_size, target, taken FROM (" + Q.ORACLES["op1_mix"] + ")").fetchall()))
    assert sorted(key((r.doc_id, r["size"], r.source_size, r.target, r.taken)) for r in mix(docs).collect()) == want


def test_shards_keep_columns_named_like_helpers(spark):
    names = ["_at", "_part", "_row", "_ends", "_range", "_start", "_h", "a.b", "count"]
    docs = spark.createDataFrame([(i, *range(i, i + 9)) for i in range(100)], ["doc_id", *names])
    out = shuffle_shards(docs, n_shards=7, per_range=5)
    assert out.columns == ["doc_id", *names, "shard", "slot"]
    assert sorted(tuple(r)[:-2] for r in out.collect()) == [(i, *range(i, i + 9)) for i in range(100)]
    assert sorted((r.shard, r.slot) for r in out.collect()) == sorted((i % 7, i // 7) for i in range(100))
