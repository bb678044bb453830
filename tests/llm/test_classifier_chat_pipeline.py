import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from drawlens.llm import chat
from drawlens.llm import queries as Q
from drawlens.llm.chat import Costs, chat_format, repair, role_of
from drawlens.llm.classifier import Network, Shape, chunks, classify, fold, train


def test_chunks_cover_everything():
    shape = Shape(chunk=10, overlap=3)
    for n in (0, 1, 9, 10, 11, 17, 18, 100):
        data = bytes(i % 255 + 1 for i in range(n))
        rows = chunks(data, shape)
        seen = b"".join(bytes(r[: 7 if i < len(rows) - 1 else 10]) for i, r in enumerate(rows))
        assert seen[:n] == data and not any(seen[n:]) and len(rows) == max(1, -(-(n - 3) // 7))


def test_gradient_against_differences():
    net = Network(Shape(chunk=24, overlap=8, width=4, stride=2, vector=3, filters=5))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    net.p["max"] += 0.3
    texts = [b"hello world, this is some text that runs on", b"zzzz", b"abc abc abc abc abc abc abc"]
    rows = [chunks(t, net.shape) for t in texts]
    owner, rows = np.repeat(np.arange(3), [len(r) for r in rows]), np.concatenate(rows)
    labels, weight = np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])

    def loss():
        z = net.combine(net.pool(rows)[0], owner, 3)[0]
        return float((weight * (np.log1p(np.exp(z)) - labels * z)).mean())

    grads = net.gradient(rows, owner, labels, weight)
    rng = np.random.default_rng(0)
    for k, g in grads.items():
        for at in {tuple(rng.integers(0, n) for n in g.shape) for _ in range(6)} if k != "bytes" else {(int(b), 1) for b in b"aeh z"}:
            old, e = net.p[k][at], 1e-5
            net.p[k][at] = old + e
            up = loss()
            net.p[k][at] = old - e
            assert np.isclose((up - loss()) / (2 * e), g[at], atol=2e-4), (k, at)
            net.p[k][at] = old


def test_held_out_accuracy(spark):
    big = "/root/testdata/sf0.01"
    rows = Q.op8_quality_classifier(spark, big).join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id").toPandas()
    held = rows[rows.held_out]
    good, bad = held[held.quality == 1].score.to_numpy(), held[held.quality == 0].score.to_numpy()
    assert (good[:, None] > bad).mean() > 0.9 and (held[held.quality == 1].predicted == 1).mean() > 0.95


def test_scores_depend_on_the_text_alone(spark, odd_docs, no_docs):
    net = Network()
    rows = classify(odd_docs, net).collect()
    assert len(rows) == 11 and all(0 <= r.score <= 1 for r in rows)
    by = {}
    for r, t in zip(rows, odd_docs.collect(), strict=True):
        assert np.isclose(r.score, net.score([(t.text or "").encode()])[0], atol=1e-6)
        by.setdefault(t.text, set()).add(r.score)
    assert all(len(s) == 1 for s in by.values()) and classify(no_docs, net).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert np.isfinite(train(odd_docs, labels).score([b"x"])).all()
    assert spark.range(1).select(fold(F.col("id"))).first()[0] == __import__("zlib").crc32(b"0") % 4


LEGAL = {None: {"system", "user"}, "system": {"user"}, "user": {"assistant"}, "assistant": {"user"}}


def brute(roles, costs):
    """The cheapest repair by trying every role, merge and single insertion for each turn."""
    best = None
    names = ("system", "user", "assistant")
    for plan in itertools.product(itertools.product(names, ("plain", "merge", *names)), repeat=len(roles)):
        last, cost = None, 0
        for role, (new, how) in zip(roles, plan, strict=True):
            cost += costs.relabel * (new != role)
            if how == "merge":
                if last != new:
                    break
                cost += costs.merge
                continue
            if how != "plain":
                if how not in LEGAL[last]:
                    break
                cost, last = cost + costs.insert, how
            if new not in LEGAL[last]:
                break
            last = new
        else:
            cost += {"user": costs.insert, "system": 2 * costs.insert}.get(last, 0)
            best = cost if best is None else min(best, cost)
    return best


def test_texts_beyond_the_bound_are_passed_over(spark):
    texts = ["good words here " * 5, "bad bad bad " * 5] * 20
    docs = spark.createDataFrame([*enumerate(texts), (100, "huge " * 10_000)], "doc_id long, text string")
    labels = spark.createDataFrame([*((i, 1 - i % 2) for i in range(40)), (100, 1)], "doc_id long, quality int")
    for seed in range(4):  # the large one stands anywhere in the order
        network = train(docs, labels, max_bytes=5_000, seed=seed, least_steps=60, epochs=2)
        a, b = network.score([texts[0].encode(), texts[1].encode()])
        assert a > 0.7 > b
    with pytest.raises(ValueError):
        train(docs, labels, max_bytes=10)


@pytest.mark.parametrize("roles", [["user"], ["assistant"], ["system", "system"], ["user", "user", "assistant"], ["assistant", "user", "system"], [None, "user", None], ["system", "assistant", "assistant"]])
def test_repair_is_cheapest(roles):
    costs = Costs()
    states = [role_of(r) for r in roles]
    first, last, _ = chat.settle([chat.reach(states, costs)], costs)[0]
    total = chat.reach(states, costs)[first, last][0] + chat.endings(costs)[last][0]
    assert total == brute(roles, costs)
    assert len(repair(states, first, last, costs)) == len(roles)


def legal(rendered):
    roles = [x for x in rendered.split("<|") if x.split("|>")[0] in ("system", "user", "assistant")]
    names = [x.split("|>")[0] for x in roles]
    last = None
    for n in names:
        assert n in LEGAL[last]
        last = n
    assert last == "assistant" and rendered.count("<|end|>") == len(names)
    return names


def test_chats_become_legal_whatever_the_block(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    by = {}
    for block in (2, 512):
        rows = sorted(chat_format(turns, block=block).collect(), key=lambda r: (r.conv_id, r.turn))
        assert len(rows) == turns.count()
        texts = {}
        for r in rows:
            texts[r.conv_id] = texts.get(r.conv_id, "") + r.rendered
        by[block] = {c: legal(t) for c, t in texts.items()}
        for r in rows:
            assert by[block][r.conv_id][r.position] == r.new_role
    assert by[2].keys() == by[512].keys()


def test_repairs_are_cheapest_end_to_end(spark):
    """Every conversation of up to four turns over all roles, with an unknown one, cut in blocks of two."""
    names, costs = ("system", "user", "assistant", "other"), Costs()
    talks = [roles for n in (1, 2, 3) for roles in itertools.product(names, repeat=n)] + [("assistant", "assistant", "user", "user"), ("system", "user", "other", "system")]
    turns = [(c, t, role, f"{c}.{t}") for c, roles in enumerate(talks) for t, role in enumerate(roles)]
    rows = sorted(chat_format(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"), block=2).collect(), key=lambda r: (r.conv_id, r.turn))
    for c, group in itertools.groupby(rows, key=lambda r: r.conv_id):
        group = list(group)
        cost = sum(costs.relabel * a.startswith("relabel") + costs.merge * a.endswith("merge") + costs.insert * ("+insert" in a) for a in (r.action for r in group))
        cost += {"user": costs.insert, "system": 2 * costs.insert}.get(group[-1].new_role, 0)
        assert cost == brute([r if r != "other" else None for r in talks[c]], costs), talks[c]
        legal("".join(r.rendered for r in group))


def test_equal_and_unnumbered_turns_are_cut_in_blocks(spark):
    turns = spark.createDataFrame([(None, None, "user", "same")] * 40 + [(1, 0, "user", str(i)) for i in range(9)], "conv_id long, turn long, role string, text string")
    rows = chat_format(turns, block=4).collect()
    assert len(rows) == 49 and {r.position for r in rows if r.conv_id is None} == {0} == {r.position for r in rows if r.conv_id == 1}


def test_odd_turns(spark):
    rows = [(1, 0, None, "x"), (1, 0, None, "x"), (1, None, "User", None), (None, 1, "bot", "<|end|>"), (2, 5, "system", "s")]
    got = chat_format(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS position")).collect()
    assert len(got) == 5 and all("<|end|>" not in (r.rendered.replace("<|end|>\n", "")) for r in got)
    assert chat_format(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_stages_take_odd_and_empty_tables(spark, sf_dir, odd_docs, no_docs):
    odd = odd_docs.withColumns({"n_dropped": F.lit("mine"), "repeats": F.lit(7), "_copy": F.lit(8), "_gone": F.lit(9), "_id": F.lit(10), "component_id": F.lit(11)})
    odd = odd.unionByName(odd.where("doc_id = 3").withColumn("doc_id", F.lit(None).cast("long")))
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, odd, sf_dir)
        rows = out.collect()
        assert out.columns == odd.columns and all((r.score, r.n_lines, r.n_dropped, r.repeats, r._copy, r._gone, r._id, r.component_id) == (1, "x", "mine", 7, 8, 9, 10, 11) for r in rows), name
        if name in ("line dedup", "simhash near-dedup"):
            assert any(r.doc_id is None and r.text == "one" for r in rows)
        assert stage(spark, no_docs, sf_dir).count() == 0, name
    assert P.packed(spark, odd, sf_dir).select("doc_id").distinct().count() == 11 and P.packed(spark, no_docs, sf_dir).count() == 0


def test_run_gives_the_stages_one_by_one(spark, tmp_path):
    """The whole pipeline on a small folder: every token of the mixed documents lies in one piece."""
    base, words = "/root/testdata/sf0.001", [f"word{i}" for i in range(500)]
    texts = [" ".join(words[(i * j) % 499] for j in range(1, 60)) for i in range(1, 30)] + ["x", None]
    spark.createDataFrame([(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{base}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in P.STAGES:
        docs = stage(spark, docs, str(tmp_path))
    # where a document lies, and so where it is cut, depends on the order of files; its tokens do not
    got, want = P.run(spark, str(tmp_path)).collect(), docs.collect()
    whole = lambda rows: sorted((r.doc_id, r.doc_tokens) for r in rows if r.start == 0)
    assert whole(got) == whole(want) and sum(r.length for r in got) == sum(n for _, n in whole(want)) > 1000


def test_stages_in_order(spark, sf_dir, documents):
    docs, kept = documents, []
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == documents.columns, name
        out.write.mode("overwrite").parquet(f"{spark.conf.get('spark.sql.warehouse.dir')}/stage-{name.replace(' ', '-')}")
        docs = spark.read.parquet(f"{spark.conf.get('spark.sql.warehouse.dir')}/stage-{name.replace(' ', '-')}")
        kept.append({r.doc_id: r for r in docs.collect()})
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in kept[0] for i in good) >= 0.95 * len(good)
    assert set(kept[0]) >= set(kept[1]) >= set(kept[2]) >= set(kept[3])
    assert all(r.n_chars == len(r.text) for r in kept[1].values())
    pieces = P.STAGES[-1][1](spark, docs, sf_dir)
    assert pieces.select("doc_id").distinct().count() == len(kept[3])
