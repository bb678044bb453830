import hashlib
import random
import re
import time
from collections import Counter

import numpy as np
import pytest

from drawlens.llm import queries as Q
from drawlens.llm.licenses import license_scan, rules, scan, suppress
from drawlens.llm.quality_rules import measure, quality_rules
from drawlens.llm.winnow import _Ranges, edited_fingerprints, fingerprints, gram_hashes, likeness, winnow

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_measure(text):
    words = WORD.findall(text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        dup += bool(WORD.search(line)) and line in seen
        seen.add(line)
    grams = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    marked = {j for i in range(len(words) - 7) if grams[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    out = {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": dup, "n_repeat_words": len(marked)}
    total = max(1, sum(map(len, words)))
    for n in (2, 3, 4, 5, 10):
        first, again, all_of = set(), set(), [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
        for i, g in enumerate(all_of):
            again |= set(range(i, i + n)) if g in first else set()
            first.add(g)
        if n >= 5:
            out[f"dup_{n}"] = sum(len(words[j]) for j in again) / total
        else:
            out[f"top_{n}"] = min(1.0, max((c * len("".join(g)) for g, c in Counter(all_of).items() if c > 1), default=0) / total)
    first, again = set(), 0
    for line in lines:
        again += len(line) if line in first and WORD.search(line) else 0
        first.add(line)
    out["dup_line_share"] = again / max(1, len(text))
    return out


def test_measures_against_plain_python(documents):
    mixed = "\u0441\u043b\u043e\u0432\u043e \u0434\u0432\u0430 \u0442\u0440\u0438 \u0447\u0435\u0442\u044b\u0440\u0435 \u043f\u044f\u0442\u044c"
    texts = [r.text for r in documents.collect()] + ["", " ", "a a a a a a a a a a", "x\nx\n\nx|#", "\u00e9 \u00e9\u2003 ", f"{mixed} one two {mixed} three four five six seven eight nine ten", f"{mixed}\nascii\n{mixed}\nascii"]
    for t in texts:
        got, want = measure(t.encode()), plain_measure(t)
        assert {k: round(float(got[k]), 9) for k in want} == {k: round(float(v), 9) for k, v in want.items()}


def test_verdicts(spark, odd_docs, no_docs):
    clean = " ".join(f"word{i}" for i in range(100))
    docs = spark.createDataFrame([(1, clean), (2, clean + " spam spam eggs" * 40), (3, "short text"), (4, (clean[:300] + "\n") * 4)], "doc_id long, text string")
    got = {r.doc_id: (r.base_failed, r.kept) for r in quality_rules(docs).collect()}
    assert got[1] == (False, True) and not got[2][1] and got[3] == (True, False) and not got[4][1]
    rows = quality_rules(odd_docs).collect()
    assert len(rows) == 11 and all(not r.kept for r in rows if r.n_words < 20) and quality_rules(no_docs).count() == 0


def plain_winnow(text, k, w):
    codes = np.array([ord(c) for c in text], dtype="<u4")
    if not len(codes):
        return []
    h = gram_hashes(codes, k).tolist()
    out = []
    for i in range(max(1, len(h) - w + 1)):
        window = h[i : i + w]
        at = i + len(window) - 1 - window[::-1].index(min(window))
        if not out or out[-1] != (h[at], at):
            out.append((h[at], at))
    return out


@pytest.mark.parametrize("text", ["", "a", "abab" * 60, "x" * 300, "the quick brown fox " * 9 + "☕ end", "".join(chr(97 + i * i % 26) for i in range(500))])
def test_winnowing_against_a_loop(text):
    for k, w in ((5, 4), (24, 96)):
        h, p = winnow(text, k, w)
        assert list(zip(h.tolist(), p.tolist(), strict=True)) == plain_winnow(text, k, w)


def test_shared_passages_are_found():
    rng = np.random.default_rng(0)
    word = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    passage = word(24 + 96 - 1)
    assert set(winnow(word(400) + passage + word(77))[0]) & set(winnow(word(33) + passage + word(500))[0])
    assert likeness(*[np.zeros(0)] * 2) == 1.0


def test_edited_fingerprints_against_plain_python(documents, odd_docs, no_docs):
    for docs in (documents, odd_docs.where("doc_id <> 4"), odd_docs.where("doc_id = 6")):
        rows = sorted(docs.collect(), key=lambda r: r.doc_id)
        want = {}
        for r, nxt in zip(rows, rows[1:] + rows[:1], strict=True):
            t, o = r.text or "", nxt.text or ""
            half = len(t) // 2
            e = t[: len(t) - half] + o[:half]
            a, b, c = ({x for x, _ in plain_winnow(s, 24, 96)} for s in (t, e, o))
            near = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
            want[r.doc_id] = (len(t), hashlib.sha256(e.encode()).hexdigest(), near(a, b), near(a, c))
        found = edited_fingerprints(docs).collect()
        assert {r.doc_id: (r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in found} == want
        text = {r.doc_id: r.text or "" for r in rows}
        for r in found:
            pairs = [(int(x, 16), p) for x, p in zip(r.fingerprint.split(), r.positions, strict=True)]
            assert pairs == plain_winnow(text[r.doc_id], 24, 96) and len(r.edited_positions) == len(r.edited_fingerprint.split())
    assert edited_fingerprints(no_docs).count() == 0 and edited_fingerprints(odd_docs).count() == 11 and fingerprints(odd_docs).count() == 11


def test_fingerprints_of_many_rows_of_one_id(spark):
    """A third of the rows without an id, a third of them one text, and an id of many texts: a chain over all rows."""
    rows = [(None, f"text {i} " * 9) for i in range(60)] + [(None, "the same " * 20)] * 60 + [(50, f"other {i} " * 7) for i in range(60)] + [(50, "again " * 30)] * 30 + [(i, f"own {i} " * 8) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = edited_fingerprints(docs).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_chars) for r in found) == sorted((i is not None, i or 0, len(t)) for i, t in rows)
    # each row's next one: by (id, null first), then by the hash of the text
    hashed = docs.selectExpr("doc_id", "text", "xxhash64(text) AS h").collect()
    chain = sorted(hashed, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.h))
    want = Counter()
    for a, b in zip(chain, chain[1:] + chain[:1], strict=True):
        half = len(a.text) // 2
        want[a.doc_id, hashlib.sha256((a.text[: len(a.text) - half] + b.text[:half]).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.edited_sha256) for r in found) == want


def test_no_id_fills_a_range():
    at = sorted([5] * 500 + list(range(1000)))
    bounds = [at[len(at) * i // 60] for i in range(1, 60)]
    h = sorted(np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 300).tolist() + [77] * 200)
    ranges = _Ranges(bounds, {5: [h[len(h) * i // 20] for i in range(1, 20)]})
    n = ranges.of(np.array([5] * 500 + list(range(1000))), np.array(h + [0] * 1000), np.arange(1500))
    assert np.bincount(n).max() < 80
    order = sorted(range(1500), key=lambda i: (([5] * 500 + list(range(1000)))[i], (h + [0] * 1000)[i]))
    same = n[order]
    assert all(a <= b for a, b, i, j in zip(same, same[1:], order, order[1:]) if not (i < 500 and j < 500 and h[i] == h[j]))


def test_license_rules():
    assert len(rules()) >= 200
    assert {x[0] for x in scan(" released under the mit license by us ")[0]} == {"mit"}
    labels = lambda s: {x[0] for x in scan(f" {s} ")[0]}
    assert labels("licensed under the gnu general public license version 3") == {"gpl-3"}  # the shorter, weaker rule gives way
    assert labels("spdx license identifier bsd 3 clause") == {"bsd-3"}
    assert labels("the creative commons attribution noncommercial license") == {"cc-by-nc"}
    assert labels("commit limited submit license plate") == set()


def test_license_base_against_plain_python(spark, sf_dir, documents, odd_docs, no_docs):
    phrases = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
    want = {}
    for r in documents.collect():
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r.text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places = [(i, label) for label, p in phrases.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        want[r.doc_id] = (len(words), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None), ",".join(sorted({x for _, x in places})))
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in Q.op4_license_scan(spark, sf_dir).collect()}
    assert got == want and any(v[1] for v in want.values())
    for r in Q.op4_license_scan(spark, sf_dir).collect():
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert license_scan(odd_docs).count() == 11 and license_scan(no_docs).count() == 0
    twice = spark.createDataFrame([(1, "Under the MIT License; under the MIT license. CC-BY-NC CC BY NC"), (2, None)], "doc_id long, text string")
    assert [len(r.places) for r in sorted(license_scan(twice).collect())] == [4, 0]


def plain_suppress(hits):
    kept = []
    for start, end, priority, i in sorted(hits, key=lambda h: (h[0], -h[1], -h[2], -h[3])):
        if not any(end <= b and p >= priority for _, b, p, _ in kept):
            kept.append((start, end, priority, i))
    return [a for a in kept if not any(a is not b and a[0] <= b[0] and b[1] <= a[1] and b[2] > a[2] for b in kept)]


def test_suppression_against_all_pairs():
    rng = random.Random(7)
    for n in (0, 1, 5, 40, 200):
        for _ in range(40):
            hits = list({(s := rng.randrange(60), s + rng.randrange(1, 30), rng.randrange(1, 6), -rng.randrange(50)) for _ in range(n)})
            assert suppress(hits) == plain_suppress(hits)


def test_scan_of_a_long_licence_text_is_linear():
    start = time.process_time()
    found, places = scan(" " + "released under the mit license and all rights reserved " * 50_000)
    assert len(places) == 50_000 and len(found) == 100_000 and time.process_time() - start < 20
    assert found[1][1:3] == (6, 9) and found[-1][1:3] == (449_997, 450_000)


def test_gated_scan_equals_all_rules():
    """Over a sentence for every rule and alternative, what the keywords let through is what all rules find."""
    from re import _parser

    for rule in rules():
        text = rule.pattern.pattern.removeprefix("(?<= )(?:").removesuffix(")(?= )")
        matched = False
        for x in {" ".join(e.split()) for e in examples(_parser.parse(text))[:300]}:
            line = f" so {x} then "
            every = suppress([(m.start(), m.end(), r.priority, -i) for i, r in enumerate(rules()) for m in r.pattern.finditer(line)])
            assert [rules()[-i].label for *_, i in every] == [h[0] for h in scan(line)[0]], (rule.label, x)
            matched |= bool(every)
        assert matched, rule.label


def examples(parsed):
    """Texts that a parsed expression matches: every alternative, with and without what is optional."""
    out = [""]
    for op, x in parsed:
        name = str(op)
        if name == "LITERAL":
            more = [chr(x)]
        elif name == "NOT_LITERAL":
            more = ["x"]
        elif name == "IN":
            more = ["1" if str(v) == "CATEGORY_DIGIT" else "x" if str(k) == "CATEGORY" else chr(v if str(k) == "LITERAL" else v[0]) for k, v in x][:4]
        elif name == "BRANCH":
            more = [y for branch in x[1] for y in examples(branch)]
        elif name == "SUBPATTERN":
            more = examples(x[3])
        else:  # a repeat
            assert name in ("MAX_REPEAT", "MIN_REPEAT")
            more = [y * n for n in {x[0], min(x[1], 1)} for y in examples(x[2])]
        out = [a + b for a in out for b in more]
    return out


def test_license_prefilter_drops_no_match():
    from re import _parser

    from drawlens.llm.licenses import FAMILIES, TEXTS

    for label, keys, *texts in [*((label, keys, name, tag) for label, keys, name, tag in FAMILIES), *(t[:3] for t in TEXTS)]:
        for text in texts:
            lost = [x for x in examples(_parser.parse(text)) if not any(f" {k} " in f" {x} " for k in keys.split("|"))]
            assert not lost, (label, lost[:3])
    labels = lambda s: {x[0] for x in scan(f" {s} ")[0]}
    for text, label in {"bsl 1 0": "bsl-1", "afl 3 0": "afl-3", "psf 2 0": "python-2", "gfdl 1 3": "fdl", "0bsd": "bsd-0"}.items():
        assert label in labels(f"spdx license identifier {text}")
    assert "mit" in labels("licensed under the expat license") and "gpl-2" in labels("licensed under the gpl2")
