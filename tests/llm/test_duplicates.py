import random
import re
from collections import defaultdict

import numpy as np
import xxhash
from pyspark.sql import functions as F

from drawlens.llm import line_dedup as line_module
from drawlens.llm import queries as Q
from drawlens.llm.common import components, ranked
from drawlens.llm.line_dedup import band_keys, line_dedup, rolling, shingle_set
from drawlens.llm.simhash import links, near_dedup, near_duplicates, segments, simhash


def roots(ids, edges):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {i: find(i) for i in ids}


def test_components_against_union_find(spark):
    random.seed(2)
    edges = [(i, i + 1) for i in range(200, 260)] + [(random.randrange(150), random.randrange(150)) for _ in range(90)] + [(500, i) for i in range(501, 560)] + [(7, 7)]
    got = {r.id: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = roots({x for e in edges for x in e}, edges)
    assert got == {i: r for i, r in want.items() if i in got} and all(i in got for e in edges if e[0] != e[1] for i in e)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_ranked(spark):
    df = spark.createDataFrame([(i * 37 % 101, i) for i in range(101)], "k int, v int")
    rows = sorted(ranked(df, [F.col("k")], {"before": "v"}).collect(), key=lambda r: r.k)
    assert [r["rank"] for r in rows] == list(range(101)) and [r.before for r in rows] == [sum(x.v for x in rows[:i]) for i in range(101)]


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if hashes and 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    ids = sorted(prints)
    return roots(ids, [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 3])


def test_simhash_against_all_pairs(documents, odd_docs, no_docs):
    for docs in (documents, odd_docs):
        prints = {r.doc_id: plain_print(r.text) for r in docs.collect()}
        want = plain_components(prints)
        got = simhash(docs).collect()
        assert len(got) == docs.count()
        assert all((int(r.fingerprint, 16), r.component_id) == (prints[r.doc_id], want[r.doc_id]) for r in got)
    assert simhash(no_docs).count() == 0


def test_links_of_hot_keys_go_through_blocks(spark):
    rng = random.Random(5)
    prints = {0x0123456789ABCDEF ^ sum(1 << b for b in rng.sample(range(32), rng.randrange(5))) for _ in range(300)} | {rng.getrandbits(63) for _ in range(100)}
    prints = sorted(prints)
    df = spark.createDataFrame([(p, p) for p in prints], "id long, f0 long")
    cuts = segments(64, 32)
    want = roots(prints, [(a, b) for i, a in enumerate(prints) for b in prints[i + 1 :] if (a ^ b).bit_count() <= 3])
    for held in (16, 64, 4096):
        edges = [(r.a, r.b) for r in links(df, 64, cuts, 3, held).collect()]
        assert all((a ^ b).bit_count() <= 3 for a, b in edges)
        assert roots(prints, edges) == want


def shingled(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_duplicates_at_point_eight(spark, odd_docs, no_docs):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghij", k=rng.randrange(2, 9))) for _ in range(3000)]
    texts = []
    for _ in range(60):
        base = rng.choices(words, k=rng.randrange(60, 300))
        texts.append(" ".join(base))
        for changes in (1, 3, 6, 30):
            copy = list(base)
            for _ in range(max(1, changes * len(base) // 300)):
                copy[rng.randrange(len(copy))] = "changed"
            texts.append(" ".join(copy))
    texts += [texts[0]] * 5 + [None, "", "x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [shingled(t or "") for t in texts]
    edges = [(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if (sets[i] == sets[j] == set()) or (sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))]
    want = roots(range(len(texts)), edges)
    got = {r.doc_id: r.component_id for r in near_duplicates(docs, block=8).collect()}
    false = [i for i in got if want[got[i]] != want[i]]
    missed = [i for i in got if want[i] != i and got[i] == i]
    assert not false and len(missed) <= 0.05 * sum(want[i] != i for i in got)
    assert near_duplicates(odd_docs).count() == 11 and near_duplicates(no_docs).count() == 0


def char_shingles(line):
    return {line[i : i + 12] for i in range(max(1, len(line) - 11))}


def plain_lines(rows):
    """What should stay of each document, by comparing every two lines."""
    places = [((d, p), line) for d, t in sorted(rows.items()) for p, line in enumerate((t or "").split("\n")) if line.strip()]
    texts = sorted({line.strip(" ").lower() for _, line in places})
    number, sets = {t: i for i, t in enumerate(texts)}, [char_shingles(t) for t in texts]
    has = defaultdict(set)
    for i, s in enumerate(sets):
        for x in s:
            has[x].add(i)
    edges = [(i, j) for i in range(len(texts)) for j in {j for x in sets[i] for j in has[x]} if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9]
    group, first = roots(range(len(texts)), edges), {}
    for place, line in places:
        first.setdefault(group[number[line.strip(" ").lower()]], place)
    keep = {place for place, line in places if first[group[number[line.strip(" ").lower()]]] == place}
    return {d: "\n".join(x for p, x in enumerate(t.split("\n")) if not x.strip() or (d, p) in keep) for d, t in rows.items() if t is not None}


def test_line_dedup_against_all_pairs(documents, odd_docs, no_docs):
    rows = {r.doc_id: r.text for r in documents.collect()}
    want = plain_lines(rows)
    got = {r.doc_id: r.text for r in line_dedup(documents).collect()}
    differ = sum(got[i] != want[i] for i in want)
    assert set(got) == set(rows) and differ <= 0.02 * len(want)  # a line pair may escape all bands
    out = line_dedup(odd_docs)
    assert out.count() == 11 and set(out.columns) == {*odd_docs.columns, "n_dropped"}
    text = {r.doc_id: r.text for r in out.collect()}
    assert text[8] == "a\nb" and text[0] is None and text[5] == "" and text[2] == " \n\t"
    assert line_dedup(no_docs).count() == 0


def test_large_groups_of_near_lines_join(spark):
    rng = random.Random(1)
    base = [f"word{i}" for i in range(60)]
    lines = []
    for _ in range(120):
        copy = list(base)
        copy[rng.randrange(60)] = f"other{rng.randrange(1000)}"
        lines.append(" ".join(copy))
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    assert sum(r.text != "" for r in line_dedup(docs).collect()) == 1


def test_queries_give_every_document(spark, sf_dir, documents):
    assert Q.op9_line_dedup(spark, sf_dir).count() == documents.count()
    assert np.isclose(Q.op6_simhash(spark, sf_dir).count(), documents.count())


def test_line_recall_over_graded_changes(spark):
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(3, 9))) for _ in range(4000)]
    base, lines = [], []
    for i in range(1500):
        if i % 30 == 0:
            base = rng.choices(words, k=80)
        copy = list(base)
        for at in rng.sample(range(80), rng.randrange(1, 9) if i % 30 else 0):
            copy[at] = rng.choice(words)
        lines.append(" ".join(copy))
    rows = dict(enumerate(lines))
    want, got = plain_lines(rows), {r.doc_id: r.text for r in line_dedup(spark.createDataFrame(list(rows.items()), "doc_id long, text string")).collect()}
    gone, missed = [i for i in rows if want[i] == ""], [i for i in rows if want[i] == "" and got[i] != ""]
    assert len(gone) > 300 and len(missed) <= 0.02 * len(gone)
    assert sum(want[i] != "" and got[i] == "" for i in rows) <= len(missed)  # the first of a part that a missed link splits off


def test_keys_and_sets_of_single_lines():
    text = ["short", "twelve chars", "x" * 40, "caf\u00e9 \U0001f600 and more text", "a line of its own with some words"]
    keys = band_keys(text, 12, 6, 3)
    assert not keys[0].any() and keys[1:].any(axis=1).all()
    for i, line in enumerate(text):  # no line's keys depend on those beside it
        assert (band_keys([line], 12, 6, 3)[0] == keys[i]).all()
        assert len(shingle_set(line, 12)) == len(char_shingles(line))
    codes = np.frombuffer(text[4].encode("utf-32-le"), "<u4")
    for n in (1, 2, 3, 5, 12):
        assert rolling(codes, n).tolist() == [rolling(codes[i : i + n], n)[0] for i in range(len(codes) - n + 1)]


def test_every_two_lines_of_a_large_key_meet(spark):
    rng = random.Random(4)
    said = "this frequent phrase stands in every line of the corpus and gives it most of its shingles while the rest differs"
    lines = [f"{said} {''.join(rng.choices('abcdefghijklmnop ', k=70))}" for _ in range(300)]
    lines = [*lines, *(x[:-1] + "zz" for x in lines[:4])]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    # one band of one value: nearly all lines have one key, and pairs meet nowhere else
    assert [r.doc_id for r in line_dedup(docs, n_bands=1, rows=1).collect() if r.text == ""] == [300, 301, 302, 303]


def test_line_dedup_runs_no_python(documents, monkeypatch):
    plans, store = [], line_module.save

    def seen(df, name):
        plans.append(df)
        return store(df, name)

    monkeypatch.setattr(line_module, "save", seen)
    plans.append(line_dedup(documents))
    assert len(plans) > 6
    assert not [p for p in plans if re.search("Python|Pandas|Arrow", p._jdf.queryExecution().optimizedPlan().toString())]


def test_lines_of_few_or_long_words_are_found(spark):
    """Lines whose word pairs say little: one long word, few words, words that repeat, no words at all."""
    rng = random.Random(9)
    run = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=n))
    long = [run(200) for _ in range(30)]
    groups = [(x := run(300), x[:150] + "-" + x[151:]), ("ha " * 20, "ha " * 300), ("\u65e5\u672c\u8a9e\u306e\u6587\u7ae0" * 2 + "\U0001f600" * 30, "\u65e5\u672c\u8a9e\u306e\u6587\u7ae0" * 2 + "\U0001f600" * 40), (" ".join(long), " ".join(x[:100] + "-" + x[101:] for x in long)), ("the only line of seven words here stands", "the only line of seven words here stands.")]
    rows = [(i * 10 + j, x) for i, group in enumerate(groups) for j, x in enumerate(group)]
    want = plain_lines(dict(rows))
    assert sum(t == "" for t in want.values()) == len(groups)
    assert {r.doc_id: r.text for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == want


def test_line_tails_and_insides_count(spark):
    """Against plain character shingles, over pairs that differ in their last word or inside a long one."""
    rng = random.Random(6)
    run = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    lines = ["Chapter number 1", "Chapter number 2", "Instructions for A", "Instructions for B", "was erlytion that. anea.", "was erlytion that. ansh.", "was erlytion that. ster."]
    long = run(300)
    lines += [long, "X" + long[1:], long[:150] + run(150), "\U0001f600 caf\u00e9\r" + long[:40], "\U0001f600 caf\u00e9\r" + long[:39] + "z"]
    texts = [x.lower() for x in lines]
    sets = [{x[i : i + 12] for i in range(max(1, len(x) - 11))} for x in texts]
    group = roots(range(len(texts)), [(i, j) for j in range(len(texts)) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])])
    got = {r.doc_id: r.text for r in line_dedup(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()}
    assert {i for i in got if got[i]} == {i for i in group if group[i] == i} == set(range(len(lines))) - {8, 11}


def test_texts_that_share_an_id_are_judged_each_by_itself(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(3, a), (7, a), (7, b), (9, b + " x"), (None, a), (None, c), (None, c), (5, "only here"), (5, "only here"), (5, ""), (6, None), (None, ""), (8, c + " y")]
    docs = spark.createDataFrame([(*r, "s", len(r[1] or ""), 1) for r in rows], "doc_id long, text string, source string, n_chars long, name int").repartition(3)
    for block in (2, 256):
        got = sorted(((r.doc_id, r.text) for r in near_dedup(docs, block=block).collect()), key=str)
        assert got == sorted([(3, a), (7, b), (5, "only here"), (5, ""), (8, c + " y"), (None, a), (None, c), (None, c), (None, "")], key=str)  # rows without an id stay
    lead = {(r.doc_id, r.component_id) for r in near_duplicates(docs).collect()}
    assert {(7, 3), (7, 7), (9, 7), (None, 3), (None, 8), (5, 5), (6, 5)} <= lead
    assert near_dedup(docs).columns == docs.columns


def test_lines_that_share_an_id_keep_their_places(spark):
    line = lambda x: f"{x} is a line of its own with {x}{x}{x} and more {x * 12}"
    rows = [(1, line("k")), (7, f"{line('u')}\n{line('k')}"), (7, f"{line('k')}\n{line('v')}"), (7, f"{line('w')}\n\n{line('u')}2"), (9, line("v")), (9, line("z")), (9, line("z")), (None, line("k"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r.doc_id, r.text) for r in line_dedup(docs).collect()]
    found = [x for _, t in got for x in t.split("\n")]
    kept = lambda x: sum(y.startswith(f"{x} is") for y in found)
    assert kept("k") == 2 and kept("u") == kept("v") == kept("w") == 1  # of k one with an id and the one without
    assert kept("z") == 2  # rows of one id and one text count as one document
    assert len(got) == len(rows) and (9, "") in got


def test_near_copies_are_caught_alone_and_after_line_dedup(spark, documents):
    """Documents of the given table with near copies of one to several changed words in fifty."""
    rng = random.Random(12)
    base = [r.text for r in documents.where("length(text) > 600").orderBy("doc_id").limit(120).collect()]
    rows, planted = [(i, t) for i, t in enumerate(base)], {}
    for i, t in enumerate(base):
        words = re.split(r"(\s+)", t)
        at = [k for k in range(0, len(words), 2) if words[k]]
        for k in rng.sample(at, max(1, len(at) // rng.choice((60, 100, 200)))):
            words[k] = f"changed{rng.randrange(10**6)}"
        copy = "".join(words)
        if len(shingled(t) & shingled(copy)) >= 0.8 * len(shingled(t) | shingled(copy)):
            planted[10_000 + i] = i
            rows.append((10_000 + i, copy))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = {r.doc_id for r in near_dedup(docs).collect()}
    assert len(planted) > 60
    caught = sum(i not in left for i in planted) / len(planted)
    lined = {r.doc_id: r.text for r in line_dedup(docs).collect()}
    print("caught", caught, "words left of copies by line dedup", sum(len(lined[i].split()) for i in planted) / sum(len(dict(rows)[i].split()) for i in planted))
    assert caught >= 0.95


def test_near_copies_cost_comparisons_in_proportion(spark, monkeypatch):
    """A group of near copies costs a few exact comparisons a line, not one for every two lines that share a key."""
    rng, counts, similar = random.Random(2), [], line_module._similar
    lines = []
    for _ in range(240):
        copy = [f"word{i}" for i in range(60)]
        copy[rng.randrange(60)] = f"other{rng.randrange(1000)}"
        lines.append(" ".join(copy))

    def seen(pairs, *rest):
        inside = pairs.groupBy("g").count().agg(F.sum(F.expr("count * (count - 1) / 2"))).first()[0] if "g" in pairs.columns else pairs.count()
        counts.append(inside or 0)
        return similar(pairs, *rest)

    monkeypatch.setattr(line_module, "_similar", seen)
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    assert sum(r.text != "" for r in line_dedup(docs).collect()) == 1
    assert 239 <= sum(counts) <= 12 * 240  # each line with the first of its key in each of six bands, or the best


def test_sketches_differ_in_no_more_bits_than_shingles(spark):
    rng = random.Random(3)
    base = "".join(rng.choices("abcde ", k=400))
    lines = [base, base[:300] + base[310:], "ha " * 200, "".join(rng.choices("abcde ", k=900)), "twelve chars", base[5:] + "\U0001f600" * 20]
    rows = line_module._sketches(spark.createDataFrame(list(enumerate(lines)), "h long, line string"), 12).collect()
    sets, bits = [char_shingles(x) for x in lines], {r.h: [b % 2**64 for b in r.bits] for r in rows}
    assert all(r.c == len(lines[r.h]) - 11 and r.ones == sum(b.bit_count() for b in bits[r.h]) <= len(sets[r.h]) for r in rows)
    for i in bits:
        for j in bits:
            assert sum((a ^ b).bit_count() for a, b in zip(bits[i], bits[j], strict=True)) <= len(sets[i] ^ sets[j])
