"""The corpus operators against brute force, and with nulls, empty and repeated rows, empty tables, clashing columns."""

import hashlib
import math
import os
import random
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tarnwork.llm import chat, common, decontaminate, licenses, passages, quality, queries, sentencepieces, simhash, suffixes, tokencount, toxicity

WORDS = "alpha beta gamma delta eps zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ly", "ing", "é"]) + rng.choice(["", "", "", ".", ",", "!\n"]) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    found = [(i, prose(rng, rng.choice([0, 3, 20, 60, 200]))) for i in range(60)]
    found += [(60 + i, found[i * 3][1]) for i in range(8)]  # copies
    found += [(70 + i, found[i * 5][1].replace("alpha", "beta", 1) + " end") for i in range(8)]
    found += [(80 + i, prose(rng, 30) + " " + found[4][1][:400] + " " + prose(rng, 30)) for i in range(6)]  # passages
    found += [(90, None), (91, ""), (92, " \n\t "), (93, "a" * 500), (94, "ab" * 200), (95, "日本語 テキスト ü" * 30), (96, prose(rng, 30000))]
    return found


@pytest.fixture(scope="module")
def docs(spark, texts):
    schema = "doc_id long, text string, lang string, source string, n_chars long, fp int, row string, unit int, bucket int, of int"
    rows = [(i, t, "en" if i % 2 else None, "s", 0, 1, "r", 2, 3, 4) for i, t in texts]
    return spark.createDataFrame(rows, schema).repartition(7)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_simhash_equals_brute_force(spark, docs, texts, empty):
    import xxhash

    def fingerprint(text):
        words = (text or "").encode().lower().split()
        if not words:
            return 0
        grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
        hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    want = {i: fingerprint(t) for i, t in texts}
    forest = common.Forest()
    for a in want:
        for b in want:
            if a < b and (want[a] ^ want[b]).bit_count() <= 4:
                forest.link(a, b)
    got = by_id(simhash.near_duplicates(docs))
    assert {i: r["fp"] % (1 << 64) for i, r in got.items()} == want
    assert {i: r["component_id"] for i, r in got.items()} == {i: forest.root(i) for i in want}
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("total", [1000, 10**8])
def test_pigeonhole_plans_miss_no_pair(spark, total):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    used = simhash.plan(base, total)
    for distance in range(5):
        for x in base[:100].tolist():
            flips = rng.choice(64, distance, replace=False)
            y = x ^ sum(1 << int(b) for b in flips)
            assert any(((x ^ y) & mask).bit_count() <= t for mask, _, t in used)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_suffix_dedup_equals_brute_force(docs, texts, empty):
    first: dict[bytes, int] = {}
    raw = [(i, (t or "").encode()) for i, t in texts]
    for i, t in raw:
        for k in range(len(t) - 49):
            first.setdefault(t[k : k + 50], i)
    got = by_id(suffixes.suffix_dedup(docs))
    for i, t in raw:
        gone = bytearray(len(t))
        for k in range(len(t) - 49):
            if first[t[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], bytes(got[i]["kept"])) == (len(t), sum(gone), spans, kept), i
    assert suffixes.suffix_dedup(empty).count() == 0


def test_suffix_groups_of_any_size_give_the_same(docs):
    """Groups too large for one task's sort meet string by string; the spans are those of the sort."""
    def spans(most):
        return {r["doc_id"]: (r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffixes.suffix_dedup(docs, most=most).collect()}

    assert spans(0) == spans(2) == spans(suffixes.GROUP_SEGMENTS)


def test_suffix_dedup_by_rows(spark):
    """Rows that share an id keep their own spans and do not cover each other; rows without an id neither cover nor are covered."""
    rng = random.Random(12)
    one, two, three = (prose(rng, 40) for _ in range(3))
    rows = [(None, one), (1, one), (1, two), (1, one), (2, two + three), (2, three), (0, "x"), (3, three)]
    found = suffixes.suffix_dedup(spark.createDataFrame([(*r, n) for n, r in enumerate(rows)], "doc_id long, text string, n int"), carry=["n"])
    got = {r["rest"]["n"]: (r["doc_id"], bytes(r["kept"]).decode()) for r in found.collect()}
    assert got == {n: (i, "" if n == 7 else t[len(two) :] if n == 4 else t) for n, (i, t) in enumerate(rows)}


def test_blind_tries_sort():
    rng = random.Random(2)
    strings = [bytes(rng.choice(b"ab") for _ in range(16)) for _ in range(400)] * 2
    one = list(suffixes.sorted_suffixes(b"".join(strings), np.arange(800) * 16, np.zeros(800, int), 16, 8))
    assert [strings[g[0]] for g in one] == sorted(set(strings))
    assert sorted(i for g in one for i in g) == list(range(800))
    two = list(suffixes.sorted_suffixes(b"".join(strings), np.arange(800) * 16, np.arange(800) // 400, 16, 8))
    assert [strings[g[0]] for g in two] == sorted(set(strings[:400])) + sorted(set(strings[400:]))


def test_paragraph_dedup_finds_copied_passages(docs, texts, empty):
    got = by_id(passages.paragraph_dedup(docs))
    raw = {i: (t or "").encode() for i, t in texts}
    assert all(r["n_bytes"] == len(raw[i]) and r["n_removed"] == sum(s["stop"] - s["start"] for s in r["spans"]) for i, r in got.items())
    for i in range(61, 68):  # copies of texts of some length lose nearly all
        if len(raw[i]) > 400:
            assert got[i]["n_removed"] > 0.8 * len(raw[i])
    assert sum(got[i]["n_removed"] > 150 for i in range(80, 86)) == 6
    assert all(got[i]["n_removed"] == 0 for i in (90, 91, 92, 95))
    assert passages.paragraph_dedup(empty).count() == 0


def test_paragraphs_of_any_length_are_found(spark):
    """Six- and seven-word sentences wherever a copy begins, a single one, and a last rest: none is shut out."""
    rng = random.Random(6)
    sentences = lambda *sizes: " ".join(" ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(n)) + "." for n in sizes)
    passage, single, end = sentences(6, 7, 7, 6, 6, 7, 6, 7, 6), sentences(6), sentences(9, 3)
    rows = [(1, f"{passage} {single} {sentences(9, 12)}"), (2, f"{sentences(9, 6)} {passage} {sentences(9)}"), (3, f"{sentences(9)} {single} {sentences(9)}"), (4, sentences(12) + " " + end), (5, sentences(8) + " " + end)]
    got = by_id(passages.paragraph_dedup(spark.createDataFrame(rows, "doc_id long, text string"), least_words=0))
    texts = dict(rows)
    cut = {i: [texts[i][s["start"] : s["stop"]] for s in r["spans"]] for i, r in got.items()}
    assert cut == {1: [], 2: [passage[:-1]], 3: [single[:-1]], 4: [], 5: [end[:-1]]}
    found = passages.paragraphs([t.encode() for t in texts.values()])
    assert (found["last"] - found["first"] >= passages.LONG_SENTENCE).all()


def test_paragraph_classes_equal_all_pairs(spark):
    """Precision and recall of the whole operator: removed paragraphs against all pairs of exact Jaccard similarity, chained."""
    rng = random.Random(18)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    sentence = lambda n: [word() for _ in range(n)]
    pool = [sentence(rng.randint(25, 45)) for _ in range(30)]
    docs: list[tuple[int, list[list[str]]]] = []
    for i in range(60):
        parts = [sentence(rng.randint(7, 40)) for _ in range(3)]
        for _ in range(rng.randint(0, 3)):
            copy = list(rng.choice(pool))
            for _ in range(rng.choice([0, 0, 1, 2])):
                copy[rng.randrange(len(copy))] = word()
            parts.insert(rng.randint(0, len(parts)), copy)
        docs.append((i, parts))
    every = [(i, tuple(p), {tuple(p[k : k + 5]) for k in range(len(p) - 4)}) for i, ps in docs for p in ps]
    forest = common.Forest()
    for a in range(len(every)):
        for b in range(a):
            x, y = every[a][2], every[b][2]
            if len(x & y) >= 0.8 * len(x | y):
                forest.link(a, b)
    first: dict[int, int] = {}
    for n, (i, _, _) in enumerate(every):
        first[forest.root(n)] = min(i, first.get(forest.root(n), i))
    want = {(i, " ".join(p)) for n, (i, p, _) in enumerate(every) if first[forest.root(n)] < i}
    text = {i: " ".join(" ".join(p) + "." for p in ps) for i, ps in docs}
    got = by_id(passages.paragraph_dedup(spark.createDataFrame(list(text.items()), "doc_id long, text string"), least_words=0))
    found = {(i, p.strip()) for i, r in got.items() for s in r["spans"] for p in text[i][s["start"] : s["stop"]].split(".") if p.strip()}
    assert found <= want and len(found) >= 0.97 * len(want) and len(want) > 20


def test_paragraph_dedup_by_rows_and_passages(spark):
    """Rows that share an id are one document, each with its own spans; runs of fewer than twenty words stay."""
    rng = random.Random(19)
    words = lambda n: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(n)) + "."
    long, line = words(30), words(9)
    rows = [(1, long + " " + line), (1, long), (2, words(12) + " " + line + " " + words(12)), (2, long + " " + words(12)), (None, long), (None, None)]
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"]) for r in passages.paragraph_dedup(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, row int")).collect()]
    assert sorted(got, key=str) == sorted([(i, len(t or ""), len(long) - 1 if n == 3 else 0) for n, (i, t) in enumerate(rows)], key=str)


def all_pairs(bodies):
    sets = [{tuple(b.split()[i : i + 5]) for i in range(len(b.split()) - 4)} for b in bodies]
    forest = common.Forest()
    for a in range(len(sets)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                forest.link(a, b)
    return [forest.root(i) for i in range(len(sets))]


@pytest.mark.parametrize("seed", range(6))
def test_similar_paragraphs_equal_all_pairs(seed):
    rng = random.Random(seed)
    bodies = [" ".join(rng.choices(WORDS, k=30)) for _ in range(15)]
    bodies += [b.replace(b.split()[k], "changed", 1) for b in bodies for k in (0, 15)]
    for _ in range(25):  # chains: each one word away from the one before
        w = rng.choice(bodies[-25:]).split()
        w[rng.randrange(len(w))] = "w" + str(rng.randrange(50))
        bodies.append(" ".join(w))
    rng.shuffle(bodies)
    found = common.Forest()
    for a, b in passages.similar(list(range(len(bodies))), [b.encode() for b in bodies], 0.8):
        found.link(a, b)
    want = all_pairs(bodies)
    assert [found.root(i) for i in range(len(bodies))] == want and len(set(want)) < len(bodies)


@pytest.mark.parametrize("block", [7, 1500])
def test_verified_links_in_large_groups(spark, block):
    """Whole groups and band keys give the same classes, up to the recall of the bands."""
    rng = random.Random(4)
    base = " ".join(rng.choices(WORDS, k=60))
    rows = [(1, i, (base + f" tail{i}").encode()) for i in range(40)]
    links = passages.verified_links(spark.createDataFrame(rows, "group long, unit long, body binary"), passages.tune_bands(), block=block)
    got = {r["component"] for r in common.components(links).collect()}
    assert got == {0} and common.components(links).count() == 40


def test_chain_of_similar_paragraphs_costs_in_proportion(spark):
    """A chain of 20,000 paragraphs, each like the next: candidates are one closure, verified by band keys."""
    rng = random.Random(11)
    words, rows = rng.choices(WORDS, k=60), []
    for i in range(20_000):
        words = [*words[1:], f"w{rng.randrange(10**6)}"]
        rows.append((1, i, " ".join(words).encode()))
    df = spark.createDataFrame(rows, "group long, unit long, body binary").repartition(8)
    began = time.time()
    sizes = common.components(passages.verified_links(df, passages.tune_bands(0.8, 0.99))).groupBy("component").count()
    assert sizes.agg({"count": "max"}).first()[0] > 100 and time.time() - began < 180


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_decontamination_equals_brute_force(spark, docs, texts, empty, block):
    items = [(1, texts[4][1][:300]), (2, "alpha beta"), (3, None), (4, ""), (5, texts[9][1][:200].upper()), (5, texts[9][1][:200].upper()), (6, "no such words here")]
    got = by_id(decontaminate.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string"), item_block_bytes=block))
    windows = {}
    for i, t in items:
        w = decontaminate.words((t or "").encode())
        for k in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[k : k + 13]), set()).add(str(i))
    for i, t in texts:
        w = decontaminate.words((t or "").encode())
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if who := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= who
        r = got[i]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items"]) == (len(w), len(hit), len(found), sorted(found)), i
        assert r["items_sha256"] == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        assert r["contaminated"] == (len(hit) > 0 and 20 * len(hit) >= len(w))
    assert decontaminate.decontaminate(empty, spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert not any(r["contaminated"] for r in decontaminate.decontaminate(docs, spark.createDataFrame([], "item_id long, text string")).collect())


def test_near_items_equal_brute_force(spark):
    """Every window of NEAR_SPAN words counts, also where a term's nearest place lies on the wrong side of the rarest term's."""
    rng, filler = random.Random(8), [f"w{k}" for k in range(40)]
    wrong_side = filler[:5] + ["bb"] + filler[:19] + ["aa"] + filler[:20] + ["bb", "cc"] + filler[:5]
    texts = {1: wrong_side} | {i: rng.choices(["aa", "bb", "cc", "dd", "ee"] + filler, k=rng.choice([0, 10, 60, 300])) for i in range(2, 60)}
    items = {"1": "aa bb cc", "2": "cc ee", "3": "aa dd ee bb", "4": "dd dd", "5": "ee nowhere"}
    got = by_id(decontaminate.decontaminate(spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id string, text string")))
    for i, t in texts.items():
        near = {k for k, x in items.items() if any(set(x.split()) - {"nowhere"} <= set(t[a : a + decontaminate.NEAR_SPAN]) for a in range(len(t)))}
        exact = {k for k, x in items.items() if f" {x} " in f" {' '.join(t)} "}
        assert (got[i]["near_items"], got[i]["items"]) == (sorted(near - exact), sorted(exact)), i
    assert got[1]["near_items"] == ["1"]


@pytest.mark.parametrize("block_bytes", [1 << 20, 8])
def test_items_of_several_rows(spark, block_bytes):
    """Rows that repeat an item_id are one item, in either order and in one block or many; repeated rows change nothing."""
    docs = spark.createDataFrame([(1, "xx aa yy bb zz"), (2, "aa qq"), (3, "bb pp cc"), (4, "cc dd ee"), (5, "pp qq aa")], "doc_id long, text string")
    rows = [("7", "aa bb"), ("7", "cc dd ee"), ("7", "aa bb"), (None, "qq aa"), ("8", None), ("9", "pp qq"), ("9", "qq pp")]
    want = None
    for order in (rows, rows[::-1]):
        found = decontaminate.decontaminate(docs, spark.createDataFrame(order, "item_id string, text string"), item_block_bytes=block_bytes)
        got = {r["doc_id"]: (sorted(set(r["items"])), sorted(set(r["near_items"])), r["n_items"]) for r in found.collect()}
        want = want or got
        assert got == want
    assert want == {1: ([], [], 0), 2: ([], [""], 0), 3: ([], [], 0), 4: (["7"], [], 1), 5: (["", "9"], [], 2)}


def test_token_counts_equal_the_library(docs, texts, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    for chunk in (64, 65536):
        got = by_id(tokencount.token_counts(docs, path, chunk))
        assert {i: (r["n_bytes"], r["n_tokens"]) for i, r in got.items()} == {i: (len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in texts}
    assert tokencount.token_counts(empty, path).count() == 0
    counter, rng = tokencount.counter(path), random.Random(6)
    for _ in range(2000):
        t = "".join(rng.choices("ab 'stre\n\t.,0Éσς Σİ你é😀", k=rng.randint(0, 30))) + rng.choice(["", "<|endoftext|>", "x<|startoftext|>"])
        k = rng.randint(1, 9)
        maps = [counter.chunk_map(t[i : i + k]) for i in range(0, max(1, len(t)), k)]
        assert counter.total(counter.combine(maps)) == counter.count(t) == len(library.encode(t, add_special_tokens=False).ids), t


def test_tokens_of_a_text_without_spaces(spark):
    from tokenizers import Tokenizer

    path, rng = public_tokenizers.path("word_bpe_49k.json"), random.Random(20)
    rows = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=300_000)), "1" * 100_000, "ab" * 100_000 + " end", "!?" * 70_000]
    got = by_id(tokencount.token_counts(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), path, 4096))
    library = Tokenizer.from_file(path)
    assert [got[i]["n_tokens"] for i in range(len(rows))] == [len(library.encode(t, add_special_tokens=False).ids) for t in rows]


def test_quality_measures(texts):
    import re

    for _, t in texts[:96]:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        grams = Counter(zip(w, w[1:], w[2:]))
        covered = {i + j for i, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for j in range(3)}
        assert quality.measure(t.encode())[:5] == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))


def test_certified_cutoffs(spark):
    rng = random.Random(7)
    good = [(i, " ".join(rng.choices(WORDS, k=80)), "en") for i in range(4000)]
    bad = [(5000 + i, " ".join(w + "###" for w in rng.choices(WORDS, k=80)), "en") for i in range(300)]
    few = [(9000 + i, " ".join(w + "###" for w in rng.choices(WORDS, k=80)), None) for i in range(20)]
    docs = spark.createDataFrame(good + bad + few + [(10000, None, "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i, *_ in good] + [(i, 0) for i, *_ in bad + few] + [(None, 1), (3, None)], "doc_id long, quality int")
    got = by_id(quality.quality_rules(docs, labels))
    assert all(got[i]["kept"] for i, *_ in good)
    assert not any(got[i]["kept"] for i, *_ in bad)
    assert all(got[i]["kept"] for i, *_ in few)  # too few labels to certify a cutoff for their stratum
    assert got[10000]["base_failed"] and not got[10000]["kept"]
    assert quality.quality_rules(docs.limit(0), labels).count() == 0
    assert quality.quality_rules(docs, labels.limit(0)).where("kept").count() == 4320


def test_quality_equals_brute_force(spark):
    """Cutoffs, rules and kept, from the definition, over strata with and without labels."""
    rng, docs, labels = random.Random(11), [], []
    for i in range(3000):
        bad = rng.random() < 0.3
        text = " ".join(w + ("##" if bad and rng.random() < 0.4 else "") for w in rng.choices(WORDS, k=rng.choice([20, 60, 90]))) + ("\nline again" * rng.choice([0, 0, 6]) if bad else "")
        docs.append((i, text, rng.choice(["en", "de", "", None])))
        labels.append((i, int(not bad)))
    d, lab = spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")
    part = {r["i"]: r["p"] == 0 for r in d.select(F.col("doc_id").alias("i"), F.pmod(F.xxhash64("doc_id"), F.lit(quality.PARTS)).alias("p")).collect()}
    truth, found, cut = dict(labels), {}, {}
    for i, t, s in docs:
        n, chars, symbols, dups, repeats, lines, capitals, marks = quality.measure(t.encode())
        values = {"symbols_per_word": symbols / n, "dup_line_share": dups / lines, "repeat_share": repeats / n, "capital_share": capitals / chars, "mean_word_chars": chars / n, "mark_share": marks / chars}
        found[i] = (s, n < 50 or 100 * repeats > 50 * n, values)
    strata = {s for s, base, _ in found.values() if not base}
    for s in strata:
        mine = [(i, v) for i, (z, base, v) in found.items() if z == s and not base]
        held, chose = [[(truth[i], v) for i, v in mine if part[i] == x] for x in (False, True)]
        for rule, (step, steps) in quality.GRIDS.items():
            level = lambda v: min(steps, int(np.ceil(v[rule] / step)))
            best = None
            for k in sorted({level(v) for _, v in held + chose} - {0}, reverse=True):
                good, lost, bad = (sum(y == want and level(v) >= k for y, v in of) for want, of in ((1, held), (1, chose), (0, chose)))
                if quality.binomial_tail(good, sum(y for y, _ in held), 0.3 / len(quality.GRIDS)) > 0.3 / (len(quality.GRIDS) * len(strata)):
                    break
                gain = bad - quality.GOOD_WEIGHT * lost
                if gain > 0 and (best is None or gain > best[0]):
                    best = (gain, (k - 1) * step)
            if best:
                cut[s, rule] = best[1]
    judged = quality.quality_rules(d, lab, alpha=0.3, delta=0.3)
    got = by_id(judged)
    assert any(rule == "symbols_per_word" for _, rule in cut)
    for i, (s, base, values) in found.items():
        failed = [r for r, v in values.items() if (s, r) in cut and v > cut[s, r]]
        assert (got[i]["base_failed"], got[i]["rules_failed"], got[i]["kept"]) == (base, failed, not base and not failed), i
    shares = {r["stratum"]: r["rule_share"] for r in quality.false_rejections(judged, lab).collect()}
    assert all(x is None or x <= 0.3 for x in shares.values())


def test_binomial_tail():
    assert quality.binomial_tail(0, 10, 0.5) == pytest.approx(0.5**10)
    assert quality.binomial_tail(5, 10, 0.5) == pytest.approx(0.623046875)
    assert quality.binomial_tail(10, 10, 0.5) == 1.0
    for n, k, p in ((1000, 3, 0.01), (1000, 20, 0.01), (300, 299, 0.9), (1, 0, 0.3)):
        assert quality.binomial_tail(k, n, p) == pytest.approx(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)), rel=1e-9)


def test_chat_events_and_round_trip(spark):
    hard = ["\\### Assistant: </turn> ok", "", "a:b#c<d>\\h\\\\l", "é\n### User: x </turn>\n", "x" * 10000]
    for role in ("assistant", "a:# <\\"):
        for t in hard:
            assert chat.parse(chat.render(role, t)[0]) == (role, t)
    rows = [(1, i, r, t) for i, (r, t) in enumerate(zip(["user", "assistant", "assistant", None, "assistant"], hard))] + [(2, None, "user", None), (2, 0, "user", "b"), (2, 0, "user", "b"), (None, 1, "assistant", "c")]
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(chat.message_events(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4), 100))).collect()}
    digest = lambda turns: hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    assert got[1]["n_turns"] == 5 and got[1]["turns_sha256"] == digest((r or "", t) for _, _, r, t in rows[:5])
    said = "".join(t for _, _, r, t in rows[:5] if r == "assistant")
    assert (got[1]["loss_chars"], got[1]["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    assert got[2]["turns_sha256"] == digest([("user", ""), ("user", "b"), ("user", "b")])
    assert got[None]["loss_chars"] == 1

    parts = chat.format_conversations(chat.message_events(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    mixed = spark.createDataFrame(sorted(parts.collect(), key=lambda r: -r["position"]), parts.schema).withColumn("clash", F.lit(1)).repartition(5)
    assert {r["conv_id"]: r for r in chat.read_back(mixed).collect()} == got
    assert chat.read_back(mixed.where("position > 0")).where("conv_id = 1").first()["n_turns"] == 4

    log = [
        (1, 1, "message", 10, "user", "hi"), (1, 2, "message", 11, "assistant", "one"), (1, 3, "delta", 11, None, " two"), (1, 4, "edit", 10, None, "hello"),
        (1, 5, "regenerate", 11, "assistant", "ne"), (1, 6, "delta", None, None, "w"), (1, 7, "delta", 99, None, "lost"), (1, 8, "unknown", 10, None, "lost"),
    ]
    events = spark.createDataFrame(log, "conv_id long, seq long, op string, message_id long, role string, text string").repartition(3)
    assert [chat.parse(r["formatted"]) for r in chat.format_conversations(events).orderBy("position").collect()] == [("user", "hello"), ("assistant", "new")]
    assert chat.format_conversations(events.limit(0)).count() == 0


def test_toxicity_on_held_out_labels(spark, empty):
    rng = random.Random(8)
    docs, labels = [], []
    for i in range(900):
        t = prose(rng, rng.randint(20, 120))
        toxic = i % 4 == 0
        if toxic:
            t += f". {prose(rng, 6)} vile{rng.choice(['a', 'b', 'c'])}thing {prose(rng, 3)}."
        docs.append((i, t))
        labels.append((i, int(toxic)))
    docs += [(5000, None), (5001, "")]
    d, lab = spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(d, lab)
    got = by_id(toxicity.score_documents(d, model))
    held = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 100
    assert sum((got[i]["score"] >= 0.5) == bool(y) for i, y in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[5000]["score"] == got[5001]["score"] < 0.5
    raw = {i: (t or "").encode().decode().lower().encode() for i, t in docs}
    spans = [raw[i][s["start"] : s["end"]] for i, y in labels if y for s in got[i]["offending"]]
    assert spans and all(b"vile" in s for s in spans)
    assert toxicity.score_documents(empty, toxicity.train(empty, lab)).count() == 0


def test_noisy_or_and_its_gradient():
    """The gradient against finite differences, and scores against the definition, sentence by sentence."""
    rng = np.random.default_rng(15)
    per_doc = np.array([1, 4, 2, 3])
    per_sentence = rng.integers(0, 6, per_doc.sum())
    x, y, weight = rng.integers(0, 9, per_sentence.sum()), np.array([0, 1, 1, 0]), np.array([0.1, 0.4, 0.2, 0.3])
    w, bias = rng.normal(0, 0.5, 9), -0.7
    loss, gw, gb = toxicity.gradient(x, per_sentence, per_doc, y, weight, w, bias)
    told, at, s = 0.0, 0, 0
    for n, label, share in zip(per_doc, y, weight):
        none = 1.0
        for _ in range(n):
            none *= 1 - 1 / (1 + math.exp(-(sum(w[x[at : at + per_sentence[s]]]) + bias)))
            at, s = at + per_sentence[s], s + 1
        told -= share * math.log(1 - none if label else none)
    assert loss == pytest.approx(told)
    for k in range(9):
        step = np.eye(9)[k] * 1e-6
        assert gw[k] == pytest.approx((toxicity.gradient(x, per_sentence, per_doc, y, weight, w + step, bias)[0] - toxicity.gradient(x, per_sentence, per_doc, y, weight, w - step, bias)[0]) / 2e-6, abs=1e-6)
    assert gb == pytest.approx((toxicity.gradient(x, per_sentence, per_doc, y, weight, w, bias + 1e-6)[0] - toxicity.gradient(x, per_sentence, per_doc, y, weight, w, bias - 1e-6)[0]) / 2e-6, abs=1e-6)


def test_toxicity_scores_equal_brute_force(spark, docs, texts):
    model = toxicity.Model(np.random.default_rng(16).normal(0, 1, toxicity.BUCKETS), -4.0)
    got = by_id(toxicity.score_documents(docs, model))
    for i, t in texts:
        none, found = 1.0, toxicity.sentences((t or "").encode()) or [[]]
        for s in found:
            none *= 1 - 1 / (1 + math.exp(-max(-30, min(30, model.bias + sum(float(model.weights.astype(np.float32)[f]) for w in s for f in toxicity.word_features(w))))))
        assert got[i]["score"] == pytest.approx(1 - none, abs=1e-5) and got[i]["n_sentences"] == len(found), i


def test_pieces_equal_the_library(spark, docs, texts, empty):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library, pieces = sentencepiece.SentencePieceProcessor(model_file=path), sentencepieces.pieces_of(path)
    got = by_id(sentencepieces.encode(docs, path, 200))
    for i, t in texts:
        assert got[i]["ids"] == library.encode(t or "")
        assert got[i]["round_trip"] and got[i]["decoded"] == (t or "")
    assert sentencepieces.encode(empty, path).count() == 0
    rng = random.Random(9)
    words = sorted({w for _ in range(300) for w in sentencepieces.words("".join(rng.choices("abthe ing.é你\n▁", k=20)))} | {"x" * 100, "▁" * 40})
    for r in sentencepieces.encode_words(spark.createDataFrame([(w,) for w in words], "word string"), pieces).collect():
        ids = [x for k, p in enumerate(r["ids"]) for x in ([p] if p is not None else pieces.fallback(r["word"][r["cuts"][k] : r["cuts"][k + 1]]))]
        assert ids == pieces.encode(r["word"]) == np.frombuffer(pieces.encode_many([r["word"], "x"])[0], "<i4").tolist()


def test_pieces_of_hard_texts(spark):
    """A megabyte without spaces, runs of spaces, line breaks, the space mark itself, characters without a piece: as the library."""
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library, rng = sentencepiece.SentencePieceProcessor(model_file=path), random.Random(17)
    rows = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=1_000_000)), "x" * 100_000, " a", "a ", "  a  b   ", "\n\na\n b \n\n  c", "▁a▁▁b", "é\u0301😀\ue000 ok\x00"]
    rows += ["".join(rng.choices("ab \n▁tionéx你\ue001", k=rng.randint(1, 60))) for _ in range(3000)]
    got = by_id(sentencepieces.encode(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), path))
    for i, t in enumerate(rows):
        assert got[i]["ids"] == library.encode(t), t[:80]
        assert got[i]["decoded"] == t.replace("▁", " ") and got[i]["round_trip"] == ("▁" not in t)


def test_frequent_words_are_counted_whole(spark, monkeypatch):
    texts = ["a b\nb c", "a  a", "b", None, "z" * 50 + " a"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    count = Counter(w for t in texts for w in sentencepieces.words(t or "") if len(w) <= sentencepieces.LATTICE_CHARS)
    for held in (0, 400_000):
        monkeypatch.setattr(sentencepieces, "COUNTED_WORDS", held)
        assert {r["word"]: r["n"] for r in sentencepieces.word_counts(df).collect()} == count
    assert {r["word"] for r in sentencepieces.frequent_words(df, 1).collect()} == {w for w, n in count.items() if n >= 3}


def test_viterbi_fold_of_unigram_lattices(spark):
    score = {"a": -1.0, "b": -1.0, "ab": -1.5, "abc": -9.0, "c": -1.0, "bc": -1.2}
    edges = [(s, e, 0, score["abcx"[s:e]]) for s in range(4) for e in range(s + 1, 5) if "abcx"[s:e] in score]
    df = spark.createDataFrame([("abcx", edges)], "word string, edges array<struct<start:int,stop:int,id:int,score:double>>")
    assert df.select(sentencepieces.fold_viterbi()).first()[0] == [0, 1, 3, 4]


def test_license_spans_equal_brute_force(spark):
    """Spans of random texts over a small alphabet, with templates that repeat and share words."""
    rng = random.Random(14)
    templates = {"x": " ".join(rng.choices("ab", k=30)), "y": " ".join(rng.choices("abc", k=25))}
    spelt = {n: t.split() for n, t in templates.items()}
    texts = {i: rng.choices("abcd", k=rng.randint(0, 80)) for i in range(40)}
    for i in range(20, 40):
        t = spelt[rng.choice("xy")]
        a = rng.randint(0, 10)
        texts[i][5:5] = t[a : a + 8] + ["d"] * rng.randint(0, 8) + t[a + 8 :]
    got = by_id(licenses.license_scan(spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string"), templates))
    seen = 0
    for i, t in texts.items():
        want = []
        for name, tw in spelt.items():
            met = [(p, q) for p in range(len(t) - 4) for q in range(len(tw) - 4) if t[p : p + 5] == tw[q : q + 5]]
            bands, last = [], None
            for d in sorted({p - q for p, q in met}):
                if last is None or d - last > 4:
                    bands.append(set())
                bands[-1].add(d)
                last = d
            for band in bands:
                cells = {(p + j, q + j) for p, q in met if p - q in band for j in range(5)}
                rest = sorted({p for p, _ in cells})
                while rest:
                    n = next((k + 1 for k, (x, y) in enumerate(zip(rest, rest[1:])) if y - x > 5), len(rest))
                    run, rest = rest[:n], rest[n:]
                    if n >= 10:
                        want.append((name, run[0], run[-1], n, len({q for p, q in cells if p in run}) / len(tw)))
        assert sorted(want) == [tuple(s) for s in got[i]["spans"]], i
        seen += len(want)
    assert seen > 20


def test_license_rows_that_share_an_id(spark):
    text = licenses.TEMPLATES["mpl"]
    rows = [(1, text), (1, "nothing"), (None, text), (None, "nothing"), (None, None)]
    got = licenses.license_scan(spark.createDataFrame([(*r, 0, "t") for r in rows], "doc_id long, text string, pos int, template string")).collect()
    assert sorted((str(r["doc_id"]), r["labels"]) for r in got) == [("1", ""), ("1", "mpl"), ("None", ""), ("None", ""), ("None", "mpl")]


def test_license_scan(spark, empty):
    mit = licenses.TEMPLATES["mit"]
    rows = [(1, "Under the MIT License, and cc-by 4.0; the MIT  license."), (2, "x " * 7 + mit), (3, "x y " + mit.replace("free of charge", "entirely free of charge")), (4, None), (5, "apache\nlicense"), (6, "plain text"), (6, "plain text")]
    got = by_id(licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")))
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["base_labels"]) == (3, 2, 10, "cc-by,mit")
    assert got[2]["n_base"] == 0 and got[2]["labels"] == "mit" and got[2]["score"] == 1.0 and [(s["start"], s["n_matched"]) for s in got[2]["spans"] if s["template"] == "mit"] == [(7, len(licenses.words(mit.encode())))]
    assert got[3]["labels"] == "mit" and got[3]["score"] == pytest.approx(1 - 4 / len(licenses.words(mit.encode())))  # four words before the inserted one are no whole gram
    assert (got[4]["n_words"], got[4]["first_word"], got[4]["labels"], got[4]["score"]) == (0, None, "", 0.0)
    assert got[5]["labels"] == "apache" and got[6]["score"] == 0.0
    assert licenses.license_scan(empty).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    from tests.test_queries import DATA, TABLES, table

    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    assert table(queries.QUERIES[name](spark, DATA).toPandas()) == table(con.sql(queries.ORACLE_SQL[name]).df())


def test_pipeline_decides_by_rows(spark, tmp_path):
    """Repeated and null ids: each row is judged by its own text, null-id rows stay, exact repeats count once."""
    rng = random.Random(13)
    one, two, three = (prose(rng, 130) for _ in range(3))
    rows = [(1, one, "en"), (1, "short", "en"), (None, two, "en"), (2, two, "en"), (3, three, "de"), (3, three, "de"), (3, prose(rng, 130), None), (None, "short", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, rows[6][1])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stage = dict(corpus_pipeline.STAGES)
    key = lambda found: sorted((tuple(r) for r in found), key=str)
    kept = stage["quality_rules"](spark, df, str(tmp_path))
    assert key(kept.collect()) == key(rows[:1] + rows[2:7])
    assert key(stage["simhash_near_dedup"](spark, kept, str(tmp_path)).collect()) == key([rows[0], rows[3], rows[4], rows[6]])
    assert key(stage["suffix_array_dedup"](spark, kept, str(tmp_path)).collect()) == key(kept.collect())
    assert key(stage["benchmark_decontamination"](spark, kept, str(tmp_path)).collect()) == key(rows[:1] + rows[2:6])


def test_pipeline_stages(spark, docs, tmp_path):
    rng = random.Random(10)
    rows = [(i, prose(rng, 120), "en", "s", 0) for i in range(40)]
    rows += [(40 + i, rows[i][1], "en", "s", 0) for i in range(5)] + [(50, rows[7][1][:300] + " " + prose(rng, 80), "en", "s", 0), (60, "short", "en", "s", 0), (61, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, rows[3][1])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = df.columns
        stage(spark, df, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        df = spark.read.parquet(f"{tmp_path}/{name}")
        assert df.columns == before
        kept.append({r["doc_id"] for r in df.select("doc_id").collect()})
    assert kept[0] == {*range(45), 50} and kept[1] == {*range(40), 50} and kept[2] == kept[1] and kept[3] == kept[2] - {3}
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in out.collect()} == kept[3] and out.where("not round_trip").count() == 0
    assert df.where("doc_id = 50").first()["text"] != rows[45][1]
